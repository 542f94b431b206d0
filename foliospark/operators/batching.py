"""Batches of parts for a provider, and their requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: parts in one request.
BATCH = 50


def batches(parts: DataFrame, key: str | list[str], order: list, size: int = BATCH) -> DataFrame:
    """parts with batch_no, from 0: runs of size parts of each key in the given order."""
    w = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*order)
    return parts.withColumn("batch_no", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def request_item() -> Column:
    """One file of a request; page_ranges only where there are any."""
    ranges = F.nullif(F.col("page_ranges"), F.lit(""))
    return F.struct(F.col("upload_name").alias("name"), "data_id", F.col("options.is_ocr").alias("is_ocr"), ranges.alias("page_ranges"))


def requests(batched: DataFrame, key: str = "job_id") -> DataFrame:
    """key, batch_no and the request's JSON, files in the order of part_index; extra_formats only if there are any."""
    files = F.transform(F.array_sort(F.collect_list(F.struct("part_index", request_item().alias("file")))), lambda x: x["file"])
    o = F.first("options")
    grouped = batched.groupBy(key, "batch_no").agg(files.alias("files"), o.alias("options"))
    formats = F.when(F.size("options.extra_formats") > 0, F.col("options.extra_formats"))
    body = F.struct("files", "options.model_version", "options.language", "options.enable_table", "options.enable_formula", formats.alias("extra_formats"))
    return grouped.select(key, "batch_no", F.to_json(body).alias("request"))


def zip_by_position(left: Column, right: Column, names: tuple[str, str] = ("part", "url")) -> Column:
    """Pairs by position, as many as the shorter has."""
    n = F.least(F.size(left), F.size(right))
    pairs = F.arrays_zip(left.alias(names[0]), right.alias(names[1]))
    return F.when(n > 0, F.slice(pairs, F.lit(1), n)).otherwise(F.slice(pairs, 1, 0))


def counts_agree(left: Column, right: Column) -> Column:
    """An error message unless there are as many on both sides."""
    return F.when(F.size(left) != F.size(right), F.format_string("expected %d upload addresses, got %d", F.size(left), F.size(right)))
