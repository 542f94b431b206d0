"""State of parts and jobs: an append-only log, reconciled with what a provider says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batching import BATCH, batches


def last_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in the given order, all columns; combines before its shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last"))
    return last.select(*keys, "last.*").select(*rows.columns)


def reconcile(parts: DataFrame, status: DataFrame) -> DataFrame:
    """parts with what status says of them, and matched_by: by data_id first, else by upload_name; of equal keys the last row.

    status(batch_id, ord, data_id, file_name, state, extract_progress, full_zip_url, err_msg, err_code, trace_id). A
    part without a row, and a done one that is downloaded, stays as it is; a null state keeps the old one.
    """
    row = F.struct("state", "extract_progress", "full_zip_url", "err_msg", "err_code", "trace_id")
    by_id = status.where("coalesce(data_id, '') <> ''").groupBy("batch_id", "data_id").agg(F.max_by(row, "ord").alias("by_id"))
    by_name = status.where("coalesce(file_name, '') <> ''").groupBy("batch_id", F.col("file_name").alias("upload_name")).agg(F.max_by(row, "ord").alias("by_name"))
    both = parts.join(by_id, ["batch_id", "data_id"], "left").join(by_name, ["batch_id", "upload_name"], "left")
    open_ = needs_refresh()
    found = F.when(open_, F.coalesce("by_id", "by_name"))
    both = both.withColumn("found", found)
    hit = F.col("found").isNotNull()

    def new(field: str, old: str) -> Column:
        return F.when(hit, F.col(f"found.{field}")).otherwise(F.col(old))

    out = both.withColumns(
        {
            "matched_by": F.when(~hit, None).when(F.col("by_id").isNotNull(), "data_id").otherwise("name"),
            "state": F.coalesce(new("state", "state"), "state"),
            "progress": new("extract_progress", "progress"),
            "full_zip_url": new("full_zip_url", "full_zip_url"),
            "error_message": F.nullif(new("err_msg", "error_message"), F.lit("")),
            "error_code": new("err_code", "error_code"),
            "trace_id": F.coalesce(F.when(hit, F.col("found.trace_id")), "trace_id"),
        }
    )
    return out.select(*parts.columns, "matched_by")


def folded_state(state: str = "state", full_md: str = "full_md") -> Column:
    """The job's state, as an aggregate over its parts: done, failed, running or pending."""
    s, md = F.coalesce(F.col(state), F.lit("")), F.coalesce(F.col(full_md), F.lit(""))
    return (
        F.when((F.count("*") > 0) & F.bool_and(s == "done") & F.bool_and(md != ""), "done")
        .when(F.bool_or(s == "failed"), "failed")
        .when(F.bool_or(s.isin("running", "converting")), "running")
        .otherwise("pending")
    )


def fold_jobs(parts: DataFrame, key: str = "job_id", full_md: str = "full_md") -> DataFrame:
    """key, state, states (distinct, sorted) and ready_to_merge of each job."""
    s, md = F.coalesce("state", F.lit("")), F.coalesce(F.col(full_md), F.lit(""))
    return parts.groupBy(key).agg(
        folded_state("state", full_md).alias("state"),
        F.array_sort(F.collect_set("state")).alias("states"),
        (F.bool_and(s == "done") & F.bool_and(md != "")).alias("ready_to_merge"),
    )


def _full(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) != ""


def is_pending() -> Column:
    return F.col("state").isin("planned", "failed")


def needs_refresh() -> Column:
    return _full("batch_id") & ~((F.coalesce("state", F.lit("")) == "done") & _full("full_md"))


def ready_to_download() -> Column:
    return (F.coalesce("state", F.lit("")) == "done") & ~_full("full_md")


def must_refresh(key: str = "job_id"):
    """Jobs of which any part has a batch and no text."""
    return lambda parts: parts.groupBy(key).agg(F.bool_or(_full("batch_id") & ~_full("full_md")).alias("must_refresh"))


def undone(parts: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return parts.join(done, key, "left_anti")


def submitted(parts: DataFrame, batch_id: Column, failed: Column) -> DataFrame:
    """Pending parts after a submission: waiting for their file, or failed with the job's other parts left alone."""
    now = is_pending()
    return parts.withColumns({"batch_id": F.when(now & ~failed, batch_id).otherwise(F.col("batch_id")), "state": F.when(now & failed, "failed").when(now, "waiting-file").otherwise(F.col("state"))})


def resume(parts: DataFrame, key: str = "job_id", size: int = BATCH) -> DataFrame:
    """Failed parts planned anew, in new batches; the others don't come back."""
    failed = parts.where("state = 'failed'")
    clean = {c: F.lit(None).cast(parts.schema[c].dataType) for c in ("batch_id", "error_code", "error_message") if c in parts.columns}
    return batches(failed.withColumns({**clean, "state": F.lit("planned")}), key, ["part_index"], size)
