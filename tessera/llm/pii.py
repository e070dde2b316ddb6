"""Operator 8: personal data, in DataFrame functions only.

Regular expressions propose spans, checks confirm them (Luhn for cards, mod-97
for IBANs, ranges and digit counts otherwise), and words nearby adjust the score.
Spans of the base kinds stay whatever their score; added kinds need a score of
THRESHOLD.

Each kind splits the text at its matches; the offsets of the matches are prefix
sums of the lengths of gaps and matches, by doubling steps, so that a text with
many matches takes n log n time. The patterns differ from their plain forms in
that they are possessive, where nothing that follows can make them give back,
and start at the beginning of a run of their characters or where the last match
ended: from any other place inside the run they would end alike. This keeps them
linear on long runs without changing any match.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import plain, take

THRESHOLD = 0.6
#: Characters on either side of a span in which context words count.
NEAR = 40
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: The same in RE2, for the SQL.
    plain: str
    #: A text without a match of this has no match of pattern.
    hint: str
    context: str
    score: float
    base: bool
    #: Characters that a match has at least.
    least: int


#: Order is the order of kinds in results.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "@", "e-?mail|contact|write|courriel|correo", 0.8, True, 5),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]\.[0-9]", "ip|host|server|address|adresse", 0.7, True, 7),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9]([\x20-]?[0-9])+", "[0-9]", "card|visa|mastercard|credit|carte|karte|tarjeta", 0.7, True, 2),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", "phone|tel|call|mobile|fax", 0.7, True, 4),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?|[A-Z0-9]{11,30})", r"[A-Z]{2}[0-9]{2}((\x20[A-Z0-9]{4}){2,7}(\x20[A-Z0-9]{1,3})?|[A-Z0-9]{11,30})", "[A-Z]{2}[0-9]{2}", "iban|account|bank|konto|compte|cuenta", 0.6, False, 14),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "[0-9]-[0-9]{2}-[0-9]", "ssn|social security", 0.4, False, 11),
)
BONUS = 0.2
SPAN = "array<struct<start:int,end:int,value:string,score:double>>"


def luhn(digits: Column) -> Column:
    """Whether the Luhn sum of a string of digits is a multiple of ten."""
    n = F.char_length(digits)

    def add(total, i):
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def mod97(text: Column) -> Column:
    """Whether an IBAN without blanks leaves 1 when its first four characters go to the end and letters count from 10."""
    turned = F.concat(F.substring(text, 5, 1 << 20), F.substring(text, 1, 4))

    def add(rest, i):
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code < 58, rest * 10 + code - 48).otherwise(rest * 100 + code - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.char_length(turned)), F.lit(0), add) == 1


def confirmed(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        digits = F.regexp_replace(value, r"[\x20-]", "")
        return F.when(F.char_length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.char_length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    if kind == "iban":
        return mod97(F.replace(value, F.lit(" "), F.lit("")))
    if kind == "ssn":
        return ~value.rlike("^(?:000|666|9..)|-00-|-0000$")
    return F.lit(True)


def running(steps: Column, add) -> Column:
    """The inclusive running total of an array by add, in doubling steps."""
    shifts = F.array(*[F.lit(1 << k) for k in range(31)])

    def double(sums, d):
        moved = F.transform(sums, lambda x, i: F.when(i >= d, add(x, F.get(sums, i - d))).otherwise(x))
        return F.when(F.size(sums) > d, moved).otherwise(sums)

    return F.aggregate(shifts, steps, double)


def _cut(df: DataFrame, text: str, kind: Kind) -> DataFrame:
    """Adds __tessera_gaps and __tessera_hits: the text is gap, hit, gap, ..., hit, gap."""
    there = F.col(text).rlike(kind.hint)
    cut = df.withColumn("__tessera_hits", F.when(there, F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    return cut.withColumn("__tessera_gaps", F.when(F.size("__tessera_hits") > 0, F.split(text, kind.pattern, -1)).otherwise(F.array(F.col(text))))


def _score(kind: Kind, i: Column) -> Column:
    """The score of the kind, raised where a context word stands near hit i: in NEAR characters of the text on either side, be they gaps or other hits."""
    gaps, hits = F.col("__tessera_gaps"), F.col("__tessera_hits")
    steps = F.array(*[F.lit(k) for k in range(1, -(-NEAR // kind.least) + 1)])
    at = lambda pieces, k: F.coalesce(F.get(pieces, k), F.lit(""))
    more = lambda near, longer: F.when(F.char_length(near) < NEAR, longer).otherwise(near)
    before = F.aggregate(steps, F.right(at(gaps, i), F.lit(NEAR)), lambda near, k: more(near, F.right(F.concat(at(gaps, i - k), at(hits, i - k), near), F.lit(NEAR))))
    after = F.aggregate(steps, F.left(at(gaps, i + 1), F.lit(NEAR)), lambda near, k: more(near, F.left(F.concat(near, at(hits, i + k), at(gaps, i + k + 1)), F.lit(NEAR))))
    context = F.concat_ws("\n", before, after)
    return F.lit(kind.score) + F.when(context.rlike(f"(?i)(?:{kind.context})"), BONUS).otherwise(0.0)


def _spans(kind: Kind) -> Column:
    """The confirmed spans, from __tessera_gaps, __tessera_hits and __tessera_ends, the offset of the end of each gap."""

    def span(value, i):
        start = F.get(F.col("__tessera_ends"), i)
        ok = confirmed(kind.name, value)
        return F.struct(start.alias("start"), (start + F.char_length(value)).alias("end"), value.alias("value"), F.when(ok, _score(kind, i)).alias("score"), ok.alias("ok"))

    kept = F.filter(F.transform("__tessera_hits", span), lambda s: s.ok if kind.base else s.ok & (s.score >= THRESHOLD))
    return F.transform(kept, lambda s: F.struct(s.start, s.end, s.value, s.score)).cast(SPAN)


def _ends() -> Column:
    steps = F.transform(F.slice("__tessera_gaps", 1, F.size("__tessera_hits")), lambda g, i: F.char_length(g) + F.coalesce(F.when(i > 0, F.char_length(F.get(F.col("__tessera_hits"), i - 1))), F.lit(0)))
    return F.when(F.size("__tessera_hits") > 0, running(steps, lambda a, b: a + b)).otherwise(F.array().cast("array<int>"))


def find(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of df: the key, and for each kind an array of spans by start.

    Offsets are in code points, ends exclusive. Null and empty texts have no spans;
    repeated rows give repeated rows; a null key stays null; an empty table gives
    an empty one; other columns are dropped.
    """
    own = take(df, key, text).select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    return _with_spans(own, "__key").select(F.col("__key").alias(key), *[F.col(f"__tessera_{k.name}").alias(k.name) for k in KINDS])


def _with_spans(df: DataFrame, *keep: str) -> DataFrame:
    """The columns keep, and for each kind its spans in __text."""
    names: list[str] = []
    for kind in KINDS:
        cut = _cut(df, "__text", kind).withColumn("__tessera_ends", _ends())
        found = F.when(F.size("__tessera_hits") > 0, _spans(kind)).otherwise(F.array().cast(SPAN))
        df = cut.select(*keep, *(["__text"] if "__text" not in keep else []), *names, found.alias(f"__tessera_{kind.name}"))
        names.append(f"__tessera_{kind.name}")
    return df


def _listed(kinds) -> Column:
    def of(kind):
        return F.transform(kind.name, lambda s: F.concat_ws(":", F.lit(kind.name), s.start, s.end))

    return F.array_join(F.concat(*map(of, kinds)), ",")


def digest(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The numbers of base spans, the SHA-256 of their list, and the list of all spans."""
    base = [k for k in KINDS if k.base]
    return find(df, key, text).select(key, *[F.size(k.name).cast("long").alias(f"n_{k.name}") for k in base], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(KINDS).alias("spans"))


#: Characters of the chunks that a text is cut into, so that a piece of it is found without reading all before it.
CHUNK = 1024


def _piece(begin: Column, end: Column) -> Column:
    """The characters from begin to end, from __chunks."""
    first = F.floor(begin / CHUNK).cast("int")
    held = F.slice("__chunks", first + 1, F.greatest(F.ceil(end / CHUNK).cast("int") - first, F.lit(0)))
    return F.substring(F.array_join(held, ""), begin - first * CHUNK + 1, end - begin)


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the confirmed spans of its text replaced by a kind in capitals and brackets.

    Spans are those of the text as it was. Where some overlap, their union is replaced,
    by the kind of the one that starts first; of those that start together, the
    longest, then the first in the order of KINDS. Other columns, and texts without
    spans or null, stay as they are; repeated rows stay repeated; an empty table gives
    an empty one. Write the result before filtering on the new text: a pushed filter
    would repeat the whole expression.
    """
    wide, (at,) = plain(df, text)
    names = wide.columns
    found = _with_spans(wide.withColumn("__text", F.coalesce(F.col(at), F.lit(""))), *names, "__text")
    of = lambda n, kind: F.transform(f"__tessera_{kind.name}", lambda s: F.struct(s.start.alias("start"), (-s.end).alias("back"), F.lit(n).alias("kind")))
    found = found.select(*names, "__text", F.array_sort(F.concat(*[of(n, k) for n, k in enumerate(KINDS)])).alias("__spans"))
    found = found.withColumn("__reach", running(F.transform("__spans", lambda s: -s.back), F.greatest))
    spans, reach, many = F.col("__spans"), F.col("__reach"), F.size("__spans") > 0
    first = F.filter(F.sequence(F.lit(0), F.size(spans) - 1), lambda i: (i == 0) | (F.get(spans, i).start >= F.get(reach, i - 1)))
    found = found.withColumn("__first", F.when(many, first))
    union = F.transform("__first", lambda i, j: F.struct(F.get(spans, i).start.alias("start"), F.get(reach, F.coalesce(F.get(F.col("__first"), j + 1), F.size(spans)) - 1).alias("end"), F.get(spans, i).kind.alias("kind")))
    found = found.select(*names, "__text", F.when(many, union).alias("__spans"), F.when(many, F.regexp_extract_all("__text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))).alias("__chunks"))
    marks = F.array(*[F.lit(f"[{k.name.upper()}]") for k in KINDS])
    ends = F.transform("__spans", lambda s, i: F.concat(_piece(F.coalesce(F.get(F.col("__spans"), i - 1).end, F.lit(0)), s.start), F.get(marks, s.kind)))
    last = F.get(F.col("__spans"), F.size("__spans") - 1).end
    new = F.when(F.col("__spans").isNotNull(), F.concat(F.array_join(ends, ""), _piece(last, F.char_length("__text")))).otherwise(F.col("__text"))
    return found.select(*[F.when(F.col(c).isNotNull(), new).alias(c) if c == at else F.col(c) for c in names]).toDF(*df.columns)
