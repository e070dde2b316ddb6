"""The corpus pipeline: documents pass five operators in turn.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. All but the last return the columns of documents; the last one returns, for
each document of the mix and each time it is repeated, its token count and the
digests of its tokens and of the bytes they decode to.

Nulls may stand in any column; repeated documents are documents each until near
dedup keeps one of them; an empty table gives an empty one after every stage; more
columns, names that differ in case only among them, pass through all but the last.
"""

from __future__ import annotations

import public_tokenizers

from tessera.llm import bpe, mixing, pii, quality, simhash
from tessera.llm.base import written

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def quality_rules(spark, docs, sf_dir):
    """Drops the documents that the quality rules reject: null, empty and blank texts among them. Repeated documents are judged alike."""
    return quality.keep(docs)


def near_dedup(spark, docs, sf_dir):
    """Keeps one document of each group of near copies, that of the smallest id.

    Of equal ids the first by text stays, a null id comes last; null and blank texts are
    one group. A very long text is compared as a whole.
    """
    return simhash.one_of_each_group(docs)


def redact(spark, docs, sf_dir):
    """Replaces personal data in the texts; null texts stay null, and texts without any stay as they are."""
    return pii.redact(docs)


def mix(spark, docs, sf_dir):
    """Leaves out and repeats whole documents so that sources come near their targets. Null sources are one source; null and blank texts are left out; equal draws go by id, then size."""
    return mixing.repeated(docs)


def tokenize(spark, docs, sf_dir):
    """Encodes each text, and decodes it again: a row for each document and repeat, with its id. Null and empty texts have no tokens."""
    return bpe.round_trip(docs, VOCABULARY, public_tokenizers.PATTERN)


STAGES = [("quality rules", quality_rules), ("near dedup", near_dedup), ("personal data", redact), ("mixing", mix), ("tokens", tokenize)]
#: Two of the stages, near dedup and tokens, can't be expressed in SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages on all documents; what each one keeps is written once to the shared folder, and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else written(docs, f"stage-{k}"), sf_dir)
    return docs
