"""Training-corpus pipeline: five operators over ``documents``, in order.

Every stage takes and returns the columns of its input, whatever others there
are beside those of ``documents``, but for the last, which returns piece ids.
An empty table stays one.  ``run`` writes each stage's rows to the shared folder
and gives the next one what it reads back.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import decontam, langid, linespread, neardup, pieces
from skein.llm.common import address, as_table, stage_table

#: Stages that sample or sketch have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    return name if name.lower() not in {c.lower() for c in docs.columns} else _fresh(docs, name + "_")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go: null texts, texts without a
    letter, texts of no learnt language.  Repeated rows are judged alike."""
    return langid.keep_identified(spark, docs, langid.learn(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site lines stay in their first document only; texts that lose all
    their words by that go, and ``n_chars``, if there is one, follows the text.

    Null and empty texts stay as they are.  Repeated rows keep the same lines.
    Of ties for the first document the smaller text hash is first.
    """
    lines, removed = _fresh(docs, "lines_before"), _fresh(docs, "lines_removed")
    found = linespread.remove_boilerplate(docs, counts=(lines, removed))
    emptied = (F.col(removed) > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cleaned = found.where(~F.coalesce(emptied, F.lit(False)))
    n_chars = F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    return cleaned.select(*[n_chars.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays.

    It is the one with the smallest id, null ids last; of several rows with
    that id, repeated ones too, the first by file and place in the stage's
    input.  Rows without words (null and empty texts) are in no group and all
    stay, repeated ones too.
    """
    table = as_table(docs)
    rows = neardup.near_duplicates(table).select(F.col("doc_id").isNull().alias("null_id"), "doc_id", "component", "file", "place")
    rows = stage_table(rows, "rows-by-group")
    best = rows.where("component is not null").groupBy("component").agg(F.min(F.struct("null_id", "doc_id", "file", "place")).alias("best"))
    stay = rows.where("component is null").select("file", "place").unionByName(best.select("best.file", "best.place"))
    whole = table.select(F.struct(*table.columns).alias("row"), *address(table))
    return whole.join(stay, ["file", "place"], "left_semi").select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark go.  Null and empty texts are
    clean; rows with one text are judged alike; an empty benchmark takes none."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    key = _fresh(docs, "text_key")
    keyed = docs.withColumn(key, F.xxhash64("text"))
    found = decontam.decontaminate(spark, keyed, benchmark, id_col=key, near=False)
    bad = stage_table(found.where("contaminated").select(F.col("doc_id").alias(key)).distinct(), "contaminated")
    return keyed.join(bad, key, "left_anti").select(docs.columns)


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, ids, n_ids, lossless)`` of every row that is left; a null
    text has null ids.  Repeated rows have equal ids.  Other columns go."""
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("piece_encoding", piece_encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
