"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

quality rules -> language ID -> MinHash near-dedup -> mixing to target weights -> packing.
Rejected documents and near copies go; all rows that reach mixing get a place in the
mix, and packing turns all of them into token sequences. An empty table passes
through all stages and gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.llm import language_profiles, mixing, near_dedup, packing, quality_rules
from reelspark.llm.shared import kept_names, materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the line-first quality rules keep, with only the lines that pass. Null and empty texts are rejected; repeated rows are judged alike."""
    cleaned = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    names = kept_names(docs.columns, quality_rules.OWN)
    return quality_rules.judge(docs, docs.columns).where("kept").select(*[cleaned.get(c, F.col(k)).alias(c) for c, k in zip(docs.columns, names)])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that could be told; profiles are learned from the documents themselves.

    A text that is null, or has no letter, is rejected. If no row has a language, nothing can be told and none is kept.
    """
    found = language_profiles.identify(docs, language_profiles.fit(docs), docs.columns)
    names = kept_names(docs.columns, language_profiles.OWN)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= 0.01)).select(*[F.col(k).alias(c) for c, k in zip(docs.columns, names)])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest doc_id of each group; of rows that share that doc_id, the least by its other columns. Rows without doc_id stay."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    own, given = docs.toDF(*names), dict(zip(docs.columns, names))  # names of the stage's own cannot clash
    kept = near_dedup.near_duplicates(docs).where("id = component_id").groupBy(F.col("id").alias("kept_id")).agg(F.count(F.lit(1)).alias("kept_rows"))
    met = own.join(kept.hint("shuffle_hash"), F.col(given["doc_id"]) == F.col("kept_id"))
    found = met.where("kept_rows = 1").select(*names).unionByName(own.where(F.col(given["doc_id"]).isNull()))
    if not kept.where("kept_rows > 1").isEmpty():
        least = met.where("kept_rows > 1").groupBy("kept_id").agg(F.min(F.struct(*names)).alias("least_row"))
        found = found.unionByName(least.select("least_row.*"))
    return found.toDF(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the documents in the order of the mix: each file that is written holds runs of it, each in order. All rows stay."""
    return mixing.arranged(docs, ["doc_id", "text"])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of 2048: their ids (little-endian, 32 bits each) and place in document and sequence. A null or empty text is its end id."""
    import public_tokenizers

    return packing.pack(docs, ["doc_id", "source"], public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality), ("language_id", language), ("near_dedup", near_copies), ("mixing", mixed), ("packing", packed)]
#: Language profiles, the schedule and tokenizer ids are not for SQL; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
