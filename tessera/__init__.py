"""Code and corpus analytics as Spark plans."""
