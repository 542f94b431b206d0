"""Parts to documents: order, sections, manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

MARKER = "source"


def marker(index: Column, start: Column, end: Column, name: str = MARKER) -> Column:
    paged = (F.coalesce(start, F.lit(0)) != 0) & (F.coalesce(end, F.lit(0)) != 0)
    what = F.when(paged, F.format_string("pages %d-%d", start, end)).otherwise(F.format_string("part %d", index))
    return F.concat(F.lit(f"<!-- {name} "), what, F.lit(" -->"))


def place(start: Column, index: Column) -> Column:
    """What parts are in order of: their first page, or else their number."""
    return F.struct(F.coalesce(F.nullif(start, F.lit(0)), index).alias("at"), index.alias("index"))


def merge_parts(parts: DataFrame, key: str = "job_id", name: str = MARKER) -> DataFrame:
    """key, n_parts, mergeable and full_md of parts(key, part_index, page_start, page_end, state, full_md).

    A job with a part that isn't done or has no text isn't mergeable and has no full_md. Parts of a job meet in one
    row, so a job is bounded by what one document may hold.
    """
    i, a, b = (F.col(c) for c in ("part_index", "page_start", "page_end"))
    section = F.concat(marker(i, a, b, name), F.lit("\n\n"), X.strip(F.col("full_md")))
    ok = F.bool_and((F.coalesce("state", F.lit("")) == "done") & (F.coalesce("full_md", F.lit("")) != ""))
    rows = F.array_sort(F.collect_list(F.struct(place(a, i).alias("place"), section.alias("section"))))
    merged = parts.groupBy(key).agg(F.count("*").alias("n_parts"), ok.alias("mergeable"), rows.alias("rows"))
    text = F.concat(X.rstrip(F.array_join(F.transform("rows", lambda r: r["section"]), "\n\n")), F.lit("\n"))
    return merged.select(key, "n_parts", "mergeable", F.when(F.col("mergeable"), text).alias("full_md"))


def only_text(members: DataFrame, key: list[str], file_name: str = "full.md") -> DataFrame:
    """key, n_found, content and error of the one member of that name in each archive."""
    found = F.col("name").rlike(f"(^|/){file_name.replace('.', '[.]')}$")
    n = F.count_if(found)
    out = members.groupBy(*key).agg(n.alias("n_found"), F.max(F.when(found, F.col("content"))).alias("content"))
    error = F.when(F.col("n_found") != 1, F.format_string("expected one %s, found %d", F.lit(file_name), F.col("n_found")))
    return out.select(*key, "n_found", F.when(error.isNull(), F.decode("content", "UTF-8")).alias("full_md"), error.alias("error"))


MANIFEST_JOB = ("job_id", "source_name", "source_size", "source_sha256", "page_count", "created_at", "completed_at", "options")
MANIFEST_PART = ("data_id", "batch_id", "page_start", "page_end", "page_ranges", "physical", "trace_id")


def manifest(jobs: DataFrame, parts: DataFrame) -> DataFrame:
    """job_id and the manifest's JSON: fields of the job and, in merge order, of its parts; addresses of results stay out."""
    item = F.struct(F.col("part_index").alias("index"), *[F.col(c) for c in MANIFEST_PART if c in parts.columns])
    rows = F.array_sort(F.collect_list(F.struct(place(F.col("page_start"), F.col("part_index")).alias("place"), item.alias("item"))))
    listed = parts.groupBy("job_id").agg(F.transform(rows, lambda r: r["item"]).alias("parts"))
    body = F.struct(*[F.col(c) for c in MANIFEST_JOB if c in jobs.columns], "parts")
    return jobs.join(listed, "job_id", "left").select("job_id", F.to_json(body, {"ignoreNullFields": "false", "pretty": "true"}).alias("manifest"))


SECRET_JOB, SECRET_PART = ("work_dir",), ("full_zip_url", "local_path", "extracted_dir", "full_md")


def public(df: DataFrame, parts: str | None = None) -> DataFrame:
    """Without what isn't for others: columns of jobs and parts, and the same fields in a column of nested parts."""
    out = df.drop(*SECRET_JOB, *SECRET_PART)
    if parts:
        fields = [f.name for f in df.schema[parts].dataType.elementType.fields if f.name in SECRET_PART]
        out = out.withColumn(parts, F.transform(parts, lambda p: p.dropFields(*fields)) if fields else F.col(parts))
    return out


def decorated(df: DataFrame, result_dir: Column, timed_out: Column, enhance_error: Column) -> DataFrame:
    """df with result_dir, timed_out, enhanced, enhanced_path and enhance_error."""
    ok = result_dir.isNotNull() & enhance_error.isNull()
    path = F.when(ok, F.concat(result_dir, F.lit("/full.enhanced.md")))
    return df.withColumns({"result_dir": result_dir, "timed_out": timed_out, "enhanced": ok, "enhanced_path": path, "enhance_error": enhance_error})
