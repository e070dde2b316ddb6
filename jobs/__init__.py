"""Jobs: each has a command line and a config file, and does its work in a function that takes a session."""
