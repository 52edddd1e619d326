"""A corpus pipeline of training-data operators: quality rules, near-duplicates,
repeated passages, secrets, packing. Each stage reads all that its predecessor kept;
run() writes each stage's rows to the shared folder and reads them again. A document is
known by its id and its text's hash, so rows that share an id are judged apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import packing, quality, secrets, simhash, substring
from gaugeworks.llm.shared import materialize, reach_workers, text_key

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _same_row() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("__id")) & (text_key() == F.col("__key"))


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base checks or a risk-controlled rule go. A null text has no
    words and goes; rows that agree in id and text go or stay together; an empty table stays
    empty; columns other than those of documents are dropped, here and in every stage."""
    reach_workers(spark)
    docs, labels = docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet")
    verdicts = quality.judged(docs.withColumn("__key", text_key()), labels, keep=("__key",))
    gone = verdicts.where(~F.col("kept")).select(F.col("doc_id").alias("__id"), "__key").distinct()
    return docs.join(gone, _same_row(), "left_anti").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (at least 0.8 of their five-word shingles in common) one
    document stays: that with the smallest id (nulls last), of rows that agree in id and text
    one. Null and word-less texts are one group; an empty table stays empty."""
    reach_workers(spark)
    docs = docs.select(*COLUMNS)
    rows = materialize(simhash.near_copies(docs.withColumn("__key", text_key()), keep=("__key",)).withColumnRenamed("doc_id", "__id"), "pipeline-groups")
    order = F.struct(F.col("__id").isNull().alias("n"), F.col("__id").alias("i"), F.col("__key").alias("k"))
    first = materialize(rows.groupBy("root").agg(F.min(order).alias("m")), "pipeline-first")
    stays = first.select(F.col("m.i").alias("__id"), F.col("m.k").alias("__key"))
    kept = docs.join(stays, _same_row(), "left_semi")
    repeated = materialize(rows.groupBy("__id", "__key").count().where("count > 1").select("__id", "__key"), "pipeline-repeated")
    if repeated.head(1):
        once = kept.join(repeated, _same_row(), "left_semi").dropDuplicates(["doc_id", "text"])
        kept = kept.join(repeated, _same_row(), "left_anti").unionByName(once)
    return kept.select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that occur anywhere else too are cut out of the texts. A null text
    stays null, rows that repeat are copies of each other, an empty table stays empty."""
    reach_workers(spark)
    docs = docs.select(*COLUMNS)
    return _counted(substring.without_factors(docs, substring.factors(docs)))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark. A null text stays null, rows that repeat have equal
    results, an empty table stays empty."""
    reach_workers(spark)
    docs = docs.select(*COLUMNS)
    return _counted(secrets.redacted(docs))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens, packed into sequences. A null text is empty (its end is its one
    token), each of several equal rows is packed, an empty table gives no rows."""
    reach_workers(spark)
    return packing.packed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("secret scans", secret_spans),
    ("best-fit packing", sequences),
]

#: Fingerprint candidates, token ids and best fit have no SQL form; tests/llm compares
#: every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
