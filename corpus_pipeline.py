"""The corpus pipeline: quality rules, language identification, near-duplicate removal, benchmark
decontamination and packing, each on all rows its predecessor kept.

A stage takes (spark, docs, sf_dir). All but the last return the columns of ``docs``; the first one
replaces ``text`` (and ``n_chars``, if present) by the lines that passed. Rows with a null doc_id pass
the filters that look at the row alone; near-dedup treats each of their texts as a document of its
own with an id after all others, so that a group of near copies keeps one row whatever its ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import decontam, langid, neardup, packing, quality
from panelcast.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line-first cleaning: rejected documents go, the others keep their passing lines."""
    judged = quality.judge(docs).filter(F.col("quality.kept"))
    fresh = {"text": F.col("quality.clean_text"), "n_chars": F.length("quality.clean_text").cast("long")}
    return judged.select(*[fresh[c].alias(c) if c in fresh else F.col(f"`{c}`") for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or too far from every language's centroids go."""
    model = langid.fit(docs.filter(~langid.held_out(F.col("doc_id"))))
    return docs.withColumn("__lang", langid.predictor(model)(F.col("text").cast("string"))).filter(~F.col("__lang.rejected")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays: the one with its smallest id, null ids last, once.

    A null id, and every text of an id but the one of the smallest hash, gets an id of its own from the text.
    """
    own, text = F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))
    ids = docs.withColumn("__own", own.isNotNull())
    several = written(docs.filter(own.isNotNull()).groupBy(own.alias("__doc")).agg(F.min(text).alias("__first"), F.max(text).alias("__last"))
                      .filter("__first <> __last").select("__doc", "__first"), "several")
    if several.count():
        ids = ids.join(several, own == F.col("__doc"), "left").withColumn("__own", F.col("__own") & F.coalesce(text == F.col("__first"), F.lit(True)))
    made = F.xxhash64("doc_id", F.col("text").cast("string")).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))  # after any id below 2^62
    ids = ids.withColumn("__id", F.when(F.col("__own"), own).otherwise(made)).select(*docs.columns, "__own", "__id")
    rows = ids.select(F.col("__id").alias("doc_id"), "text", "__own")
    rows = rows.filter("__own").unionByName(rows.filter("NOT __own").dropDuplicates(["doc_id"])).select("doc_id", "text")
    kept = written(neardup.near_duplicates(rows).filter("kept").groupBy(F.col("doc_id").alias("__id")).agg(F.count(F.lit(1)).alias("__rows")), "kept")
    once = ids.filter("__own").join(kept.filter("__rows = 1"), "__id", "left_semi")
    again = ids.filter("__own").join(kept.filter("__rows > 1"), "__id", "left_semi").dropDuplicates(["__id"])  # repeated rows of a kept id
    made_ids = ids.filter("NOT __own").join(kept, "__id", "left_semi").dropDuplicates(["__id"])
    return once.unionByName(again).unionByName(made_ids).select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents and their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("near_dedup", near_dedup),
          ("benchmark_decontamination", benchmark_decontamination), ("best_fit_packing", best_fit_packing)]
#: Language models, tokenisation and packing are not SQL-expressible; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and reread as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
