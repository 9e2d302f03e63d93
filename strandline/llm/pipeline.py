"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, then rates of a mixture.

Each stage reads what the one before it wrote, and all but the last return the columns of documents. Models and statistics are fitted on
the stage's own input; labels and benchmark items are read from the data folder.

Defined cases: null and empty texts stay through toxicity and line dedup, which leave a null text null, and count as one text from near-dedup
on; ids may be null or clash: from near-dedup on a document is told by its text, as each text stands once from there, and the label of
an id holds for all documents with that id; repeated rows are one document from near-dedup on; an empty table passes all stages; columns of
any further names pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import decontaminate, line_dedup, mixing, near_dedup, toxicity
from strandline.llm.common import documents, fresh, table_path


def by_text(docs: DataFrame, name: str) -> DataFrame:
    """docs with a column of that name, the digest of the text."""
    return docs.withColumn(name, near_dedup.digest("text"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    (score,) = fresh(docs, "score")
    net = toxicity.fitted(docs, documents(spark, sf_dir, "labels"))
    return toxicity.scored(docs, net, out=score).filter(F.col(score) < toxicity.THRESHOLD).drop(score)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand in many of them; n_chars follows the text."""
    names = fresh(docs, "kept", "n_lines", "n_dropped", "sha")
    out = line_dedup.dedup_lines(docs, names)
    text = F.when(F.col("text").isNull(), F.lit(None).cast("string")).otherwise(F.col(names[0]))
    return out.withColumn("text", text).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the least id (null comes last), of these the least text digest, then the least other columns."""
    node, kept_id = fresh(docs, "node", "kept_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("first")
    kept = near_dedup.classes(docs).groupBy("comp").agg(first).select(F.col("first.node").alias(node), F.col("first.doc_id").alias(kept_id))
    keep = by_text(docs, node).join(kept, node).filter(F.col("doc_id").eqNullSafe(F.col(kept_id)))
    others = [c for c in docs.columns if c != "text"]
    return keep.groupBy(node).agg(F.min(F.struct(*others, "text")).alias("row")).select([F.col("row")[c].alias(c) for c in docs.columns])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, documents(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the rate at which each enters the mixture, and the posteriors it comes from."""
    rows = by_text(docs.select("doc_id", "text", "lang", "source", "n_chars"), "node")
    labels = documents(spark, sf_dir, "labels").select("doc_id", mixing.label_domain().alias("domain")).filter("domain is not null")
    rates = mixing.mixed(rows, rows.select("doc_id", "node").join(labels, "doc_id").select("node", "domain"), mixing.TARGETS, "node")
    return rows.select("node", "doc_id", "lang", "source", "n_chars").join(rates, "node").drop("node")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix),
]

#: Training and iteration can't be put as SQL; tests/llm checks each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        path = table_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
