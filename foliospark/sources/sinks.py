"""Tables and files that jobs leave behind. State is an append-only log: later rows win, removals are rows."""

from __future__ import annotations

import time
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.state import last_by

#: Bytes handed over at once.
_PIECE = 1 << 20


def _path(spark: SparkSession, path: str):
    """A Hadoop path and its file system, so that any store will do."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _path(spark, path)
    return fs.exists(at)


def next_seq(spark: SparkSession, path: str) -> int:
    """A number behind all in the log: microseconds of the clock, or one more than the last where that is larger."""
    now = time.time_ns() // 1000
    last = spark.read.parquet(path).agg(F.max("seq")).first()[0] if exists(spark, path) else None
    return max(now, (last or 0) + 1)


def append_events(rows: DataFrame, path: str, seq: Column) -> None:
    """Adds rows of jobs or parts to the log, with seq to put them in order."""
    rows.withColumns({"seq": seq, "removed": F.lit(False), "updated_at": F.current_timestamp()}).write.mode("append").parquet(path)


def checked_id(job_id: str) -> str:
    """The id, which must be a plain name, not a path."""
    if not job_id or not job_id.replace("-", "").replace("_", "").isalnum():
        raise ValueError(f"not a job id: {job_id!r}")
    return job_id


def remove(spark: SparkSession, path: str, job_id: str, seq: int) -> None:
    """Marks a job as removed."""
    checked_id(job_id)
    log = spark.read.parquet(path)
    row = spark.range(1).select(*[F.lit(job_id).alias(f.name) if f.name == "job_id" else F.lit(None).cast(f.dataType).alias(f.name) for f in log.schema])
    row.withColumns({"seq": F.lit(seq).cast(log.schema["seq"].dataType), "removed": F.lit(True), "updated_at": F.current_timestamp()}).write.mode("append").parquet(path)


def delete_folder(spark: SparkSession, root: str, *names: str) -> bool:
    """Deletes a folder below root; the names must be plain ones."""
    for name in names:
        if not name or name in (".", "..") or "/" in name or "\\" in name:
            raise ValueError(f"not a name: {name!r}")
    at, fs = _path(spark, "/".join([root.rstrip("/"), *names]))
    return bool(names) and fs.delete(at, True)


def current(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last row of each key, without jobs removed since."""
    log = spark.read.parquet(path)
    gone = log.where("removed").groupBy("job_id").agg(F.max("seq").alias("gone_at"))
    rows = last_by(log.where("not removed"), keys, ["seq"])
    return rows.join(gone, "job_id", "left").where("gone_at is null or seq > gone_at").drop("gone_at", "removed")


def swap(spark: SparkSession, staging: str, path: str) -> None:
    """Puts a finished staging folder in the place of path; if that fails, what was there is put back."""
    (target, fs), (source, _), (old, _) = (_path(spark, p) for p in (path, staging, f"{path}.old"))
    fs.delete(old, True)
    if fs.exists(target) and not fs.rename(target, old):
        raise OSError(f"can't move {path} aside")
    if not fs.rename(source, target):
        fs.rename(old, target)
        raise OSError(f"can't rename {staging}")
    fs.delete(old, True)


def write_bundles(merged: DataFrame, path: str, assets: DataFrame | None = None, name: str = "full_md") -> None:
    """Merged texts (and assets) under a staging folder first, which is renamed when all is written."""
    staging = f"{path}.staging"
    merged.write.mode("overwrite").parquet(f"{staging}/{name}")
    if assets is not None:
        assets.write.mode("overwrite").parquet(f"{staging}/assets")
    swap(merged.sparkSession, staging, path)


def write_file(spark: SparkSession, path: str, content: bytes) -> str:
    to, fs = _path(spark, path)
    out = fs.create(to, True)
    try:
        for begin in range(0, len(content), _PIECE):
            out.write(bytearray(content[begin : begin + _PIECE]))
    finally:
        out.close()
    return path


def write_files(spark: SparkSession, path: str, files: Iterable[tuple[str, bytes]]) -> None:
    """Files with their names below path, in a staging folder first; one file at a time is held."""
    staging = f"{path}.staging"
    at, fs = _path(spark, staging)
    fs.delete(at, True)
    try:
        for name, content in files:
            if name.startswith("/") or ".." in name.split("/"):
                raise ValueError(f"not a name: {name!r}")
            write_file(spark, f"{staging}/{name}", content)
        swap(spark, staging, path)
    except BaseException:
        fs.delete(at, True)
        raise


def published_names(docs: DataFrame, name: str = "source_name", order: str = "job_id") -> DataFrame:
    """docs with published_name: the stem, or for later ones of the same stem the stem and a number."""
    from pyspark.sql import Window

    stem = X.safe_stem(F.col(name))
    n = F.row_number().over(Window.partitionBy(stem).orderBy(order))
    return docs.withColumn("published_name", F.when(n == 1, F.concat(stem, F.lit(".md"))).otherwise(F.concat(stem, F.lit(" ("), n.cast("string"), F.lit(").md"))))
