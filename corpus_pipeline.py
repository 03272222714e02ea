"""From raw documents to token ids: quality rules, near-dedup, suffix-array dedup, mixing, encoding.

Every stage takes (spark, docs, sf_dir) with docs in the columns of `documents` and all but the last return them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm._tables import shared_checkpoint, table
from quillstack.llm.byte_bpe import digests, round_trip
from quillstack.llm.minhash_dedup import near_duplicates
from quillstack.llm.mixing import mix_sources, mixed_texts
from quillstack.llm.quality_rules import judge
from quillstack.llm.suffix_dedup import remove_repeated_bytes


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the base rule or a certified cutoff rejects."""
    return judge(docs, table(spark, sf_dir, "labels")).filter("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group; rows without an id stay."""
    gone = near_duplicates(docs).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings of 50 bytes and more that an earlier document has, by whole characters."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    cut = remove_repeated_bytes(docs, carry=others, whole_characters=True)
    text = F.col("kept").cast("string")
    values = {"text": text, "n_chars": F.length(text).cast("long"), "doc_id": F.col("doc_id")} | {c: F.col("row")[c] for c in others}
    return cut.select(*(values[c].alias(c) for c in docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Brings sources to their targets: a document is repeated, thinned or left out as its blocks were drawn."""
    _, pieces = mix_sources(docs)
    mixed = mixed_texts(docs, pieces)
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, decoded again for the digest."""
    return digests(round_trip(docs, keep=("doc_id", "source")), "doc_id", "source", "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("mixing", mix),
    ("encoding", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = shared_checkpoint(docs)
    return docs
