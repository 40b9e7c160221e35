"""A corpus from raw documents to packed sequences: the stages, and their run from end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guildward.llm import minhash_dedup, packing, quality_model, quality_rules, secrets_scan
from guildward.llm.common import Work, fresh, sized, without


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from labels of these documents, predicts to be good."""
    model = quality_model.train(docs, _labels(spark, sf_dir))
    score, predicted = fresh(docs.columns, ["score", "predicted"])
    return quality_model.score(docs, model, names=(score, predicted)).where(F.col(predicted) == 1).select(*docs.columns)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that meet the base rules and whose n-grams are likely enough under the trusted text."""
    model = quality_rules.fit(docs, _labels(spark, sf_dir))
    names = fresh(docs.columns, quality_rules.RESULTS)
    return quality_rules.judge(docs, model, names=names).where(F.col(names[-1])).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates (five-word shingles, similarity 0.8).

    A document is an id: rows that repeat one are copies of a document, whatever
    their texts, and the row with the least hash of its columns stays. Rows
    without an id are kept.
    """
    found = minhash_dedup.near_duplicates(docs, width=5, percent=80)
    left = without(docs, Work(spark).table(found.where("not kept").select("doc_id").distinct()))
    twice = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if not twice.limit(1).count():
        return left
    (id_,) = fresh(docs.columns, ["id"])
    again = left.join(sized(twice.withColumnRenamed("doc_id", id_)), F.col("doc_id") == F.col(id_), "left_semi")
    # the least of a hash and the row is found map-side, so an id that repeats without bound needs no large group
    row = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    first = again.groupBy("doc_id").agg(F.min_by(row, F.xxhash64(*docs.columns)).alias("row"))
    first = first.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
    return without(left, twice).unionByName(first)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret in the text replaced by a mark."""
    clean = secrets_scan.redact(docs, secrets_scan.train(secrets_scan.labelled_samples(spark)))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in packed sequences."""
    return packing.pack(packing.measured(docs), shards=max(1, -(-docs.count() // packing.SHARD_DOCS)))


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", rules),
    ("minhash near-dedup", near_dedup),
    ("secret scans", secret_scan),
    ("best-fit packing", best_fit),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents, each written as Parquet and read again before the next."""
    work = Work(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = work.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trained models and sketches can't be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None
