"""The corpus pipeline: quality rules, toxicity, near duplicates, packing, each stage on what the one before kept.

Every stage is a function of (spark, docs, sf_dir); its result is written as Parquet in the shared folder and read
again as the next stage's documents.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linesift.llm import near_dedup, packing, quality, toxicity
from linesift.llm.queries import tokenizer
from linesift.llm.stage import stage


#: Near duplicates of the corpus share so many percent of their word shingles; op8's contract is its operator's default.
NEAR = 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie in their language's perplexity band."""
    return quality.quality(docs, held_out=True).where("kept").select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learned from their labelled ones, doesn't call toxic."""
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, lexicon).where("predicted = 0").select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The one row with the smallest id of each group, null ids last; of equal rows without words, one."""
    rows = stage(docs.withColumn("_row", F.monotonically_increasing_id()), "near-rows")  # written: the numbers stay
    found = near_dedup.near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), percent=NEAR)
    found = found.select(F.col("doc_id").alias("_row"), "component_id", (F.col("n_shingles") > 0).alias("_words"))
    found = found.join(rows.select("_row", "doc_id", F.md5("text").alias("_text")), "_row")
    # Rows without words are linked with nothing: their group is the id and the text.
    group = [F.when(F.col("_words"), F.col("component_id")), F.when(~F.col("_words"), F.col("doc_id")), F.when(~F.col("_words"), F.col("_text"))]
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "_text", "_row")
    kept = found.groupBy("_words", *[g.alias(f"_g{i}") for i, g in enumerate(group)]).agg(F.min_by("_row", first).alias("_row"))
    return rows.join(stage(kept.select("_row"), "kept-rows"), "_row", "left_semi").select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' token ids, with sequence and offset."""
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"), end_id=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("near duplicates", near_dedup_stage),
    ("packing", packing_stage),
]

#: Models, tokenizers and near duplicates have no SQL; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, function) in enumerate(STAGES):
        out = function(spark, out, sf_dir)
        if i < len(STAGES) - 1:
            out = stage(out, f"pipeline-{name.replace(' ', '-')}")
    return out
