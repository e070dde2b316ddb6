"""Column functions on names, tags and sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import col

# Fixed values, which results depend on.
TAGS = "PRODUCTION FIX|TODO|FIXME|FIX|HACK|XXX|WORKAROUND|TEMP|ASAMA|BETA"
COPY_SUFFIX = r"(_v\d+|_new|_old|_fix|_copy|_dup|V2|New)$"
REQUIREMENT = r"^([A-Za-z0-9_.\-]+)"
IMPORT_TO_PACKAGE = {
    "pynvml": "nvidia-ml-py",
    "docx": "python-docx",
    "yaml": "pyyaml",
    "llama_cpp": "llama-cpp-python",
    "bson": "pymongo",
    "sklearn": "scikit-learn",
    "PIL": "pillow",
    "dotenv": "python-dotenv",
    "cv2": "opencv-python",
}


def normal_name(name) -> Column:
    return F.translate(F.lower(col(name)), "-.", "__")


def requirement_base(spec) -> Column:
    return F.regexp_extract(col(spec), REQUIREMENT, 1)


def fuzzy_base(name) -> Column:
    """A name in lower case without one suffix that marks copies."""
    return F.lower(F.regexp_replace(col(name), "(?i)" + COPY_SUFFIX, ""))


def tag(line, tags: str = TAGS) -> Column:
    """The leftmost tag of a line in capitals; empty if there is none."""
    return F.upper(F.regexp_extract(col(line), f"(?i)({tags})", 1))


def tag_text(line) -> Column:
    return F.substring(F.btrim(col(line), F.lit(" \t\r\n\f\x0b")), 1, 200)


def shape(kinds, argc) -> Column:
    """A|B|C(n)"""
    return F.concat(F.array_join(col(kinds), "|"), F.lit("("), col(argc).cast("string"), F.lit(")"))


def jaccard_percent(a, b) -> Column:
    """100 for two empty sets, else the share of the union that is common, to one decimal."""
    both, one = F.size(F.array_intersect(col(a), col(b))), F.size(F.array_union(col(a), col(b)))
    return F.when(one == 0, 100.0).otherwise(F.round(100.0 * both / one, 1))


def short_hash(text) -> Column:
    return F.substring(F.md5(col(text)), 1, 12)


def project_name(name) -> Column:
    return F.replace(F.lower(F.trim(col(name))), F.lit(" "), F.lit("-"))


def megabytes(text) -> Column:
    return F.octet_length(col(text)) / F.lit(1048576.0)


def iso_seconds(at) -> Column:
    return F.date_format(col(at), "yyyy-MM-dd'T'HH:mm:ss")
