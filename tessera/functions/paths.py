"""Column functions on paths and whole texts."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def subsystem(path, root: str | None = "_root") -> Column:
    """The first segment of a path with a slash; others belong to `root`."""
    return F.when(F.instr(col(path), "/") > 0, F.split_part(col(path), F.lit("/"), F.lit(1))).otherwise(F.lit(root))


def first_segment(path) -> Column:
    """The first segment, which for a file at the root is its own name."""
    return F.split_part(col(path), F.lit("/"), F.lit(1))


def segments(path) -> Column:
    return F.split(col(path), "/")


def basename(path) -> Column:
    return F.element_at(segments(path), -1)


def depth(path) -> Column:
    return F.size(segments(path)) - 1


def module_path(path, package: bool = False) -> Column:
    """a/b.py is a.b; with package, a/__init__.py is a."""
    out = F.replace(F.regexp_replace(col(path), r"\.py$", ""), F.lit("/"), F.lit("."))
    return F.regexp_replace(out, r"(^|\.)__init__$", "") if package else out


def qualified(*parts) -> Column:
    """Parts joined by dots; null parts are left out."""
    return F.concat_ws(".", *map(col, parts))


def extension(path) -> Column:
    """The last suffix of the file name with its dot; (none) if it has none. A leading dot begins no suffix."""
    return F.coalesce(F.nullif(F.regexp_extract(col(path), r"[^/.][^/]*(\.[^./]+)$", 1), F.lit("")), F.lit("(none)"))


def prefixes(path, sep: str = "/") -> Column:
    """All leading parts of a path, shortest first, the path itself last."""
    parts = F.split(col(path), sep if sep == "/" else "\\" + sep)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat_ws(sep, F.slice(parts, F.lit(1), n)))


def line_count(text) -> Column:
    """Newlines plus one, so that a trailing newline counts one more."""
    return F.char_length(col(text)) - F.char_length(F.replace(col(text), F.lit("\n"), F.lit(""))) + 1


def first_line(text) -> Column:
    return F.split_part(F.btrim(col(text), F.lit(" \t\r\n\f\x0b")), F.lit("\n"), F.lit(1))


def decoded(content) -> Column:
    """Bytes as text: malformed UTF-8 is replaced, a byte order mark is dropped."""
    return F.regexp_replace(F.make_valid_utf8(col(content).cast("string")), "^﻿", "")


#: Where a text ends a line.
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def lines(text) -> Column:
    """The lines of a text as an array; an end of line at the very end begins no further line."""
    cut = F.split(col(text), LINE_ENDS)
    return F.when(F.element_at(cut, -1) == "", F.slice(cut, F.lit(1), F.size(cut) - 1)).otherwise(cut)


def glob_regex(pattern: str) -> str:
    """A shell pattern as an anchored Java regular expression."""
    return fnmatch.translate(pattern).replace("(?s:", "(?s:", 1).replace(r"\Z", r"\z")


def ignored(path, patterns: list[str]) -> Column:
    """Whether a folder of the path is hidden or matches a pattern, or its file name matches one.

    Patterns apply to single names, at any depth; a folder also counts as its name
    with a slash, so `tests/*` matches every folder named tests.
    """
    parts = segments(path)
    folders, name = F.slice(parts, F.lit(1), F.size(parts) - 1), F.element_at(parts, -1)
    plain = [p for p in patterns if not any(c in p for c in "*?[")]
    globs = [glob_regex(p) for p in patterns if p not in plain]

    def hit(x, folder):
        out = x.isin(plain) if plain else F.lit(False)
        for g in globs:
            out = out | x.rlike(g)
            if folder:
                out = out | F.concat(x, F.lit("/")).rlike(g)
        return out | x.startswith(".") if folder else out

    return F.exists(folders, lambda x: hit(x, True)) | hit(name, False)


def tree_rows(path) -> Column:
    """One struct for each level of a path: its prefix, name, depth, and whether it is the file."""
    all_of = prefixes(path)
    return F.transform(all_of, lambda p, i: F.struct(p.alias("prefix"), basename(p).alias("name"), i.alias("depth"), (i == F.size(all_of) - 1).alias("is_file")))
