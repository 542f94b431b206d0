"""The driver's tables in the roles of sources, parts, status rows and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Events and line flags as states.
STATE_OF_EVENT = {"signup": "pending", "view": "running", "click": "converting", "purchase": "done", "error": "failed"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_state(kind: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in STATE_OF_EVENT.items() for x in pair])
    return F.coalesce(F.try_element_at(known, kind), kind)


def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with pages of 100 characters."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.length("text").alias("chars"))
    return docs.withColumn("page_count", F.ceil(F.col("chars") / 100).cast("int"))


def line_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as parts of their orders, with a state, a batch and a text for each."""
    lines = table(spark, sf_dir, "lineitem")
    state = F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45), "failed").when(F.col("l_linestatus") == "F", "done").when(F.col("l_quantity") > 30, "running").otherwise("planned")
    return lines.select(
        F.col("l_orderkey").alias("job_id"),
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        state.alias("state"),
        F.when(F.col("l_quantity") > 5, F.concat(F.lit("b"), (F.col("l_suppkey") % 7).cast("string"))).alias("batch_id"),
        F.when((F.col("l_linestatus") == "F") & (F.col("l_discount") < 0.08), F.lit("text")).alias("full_md"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of several kinds and sizes."""
    i = F.col("doc_id")
    kind = F.element_at(F.array(*[F.lit(s) for s in (".pdf", ".PDF", ".docx", ".xls", ".txt", ".pptx")]), (i % 6 + 1).cast("int"))
    return paged(spark, sf_dir).select(
        "doc_id",
        F.concat(F.lit("/in/doc "), i.cast("string"), kind).alias("path"),
        F.when(i % 17 == 0, F.lit(0).cast("bigint")).when(i % 19 == 0, None).otherwise(F.col("chars").cast("bigint") * 100_000).cast("bigint").alias("length"),
        F.when(i % 23 == 0, F.lit(0)).otherwise(F.col("page_count")).alias("page_count"),
    )
