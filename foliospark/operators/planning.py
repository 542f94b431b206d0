"""From sources to parts: routing, page ranges, splits by size, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: Limits in bytes and pages, and the suffixes accepted.
MAX_UPLOAD_BYTES = 200 * 1024 * 1024
TARGET_PART_BYTES = 190 * 1024 * 1024
MAX_PAGES = 200
PDF_SUFFIXES = (".pdf",)
OFFICE_SUFFIXES = (".doc", ".docx", ".ppt", ".pptx", ".xls", ".xlsx")


def route(sources: DataFrame, max_bytes: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """sources(path, length, page_count) with source_type, route (office, logical, physical or rejected) and reason."""
    kind = X.suffix(F.col("path"))
    is_pdf = kind.isin(*PDF_SUFFIXES)
    reason = (
        F.when(F.col("length").isNull(), "missing")
        .when(F.col("length") == 0, "empty")
        .when(~kind.isin(*PDF_SUFFIXES, *OFFICE_SUFFIXES), "unsupported")
        .when(~is_pdf & (F.col("length") > max_bytes), "too large; export it to PDF")
        .when(is_pdf & (F.coalesce("page_count", F.lit(0)) < 1), "no pages")
    )
    way = F.when(reason.isNotNull(), "rejected").when(~is_pdf, "office").when(F.col("length") <= max_bytes, "logical").otherwise("physical")
    return sources.withColumns({"source_type": F.when(is_pdf, "pdf").otherwise("office"), "route": way, "reason": reason})


def ranges_of(page_count: Column, cap: int = MAX_PAGES) -> Column:
    """Ranges of cap pages, 1-based and inclusive, over all pages; none for no pages."""
    starts = F.when(page_count >= 1, F.sequence(F.lit(1), page_count, F.lit(cap))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("page_start"), F.least(s + cap - 1, page_count).alias("page_end")))


def page_ranges(docs: DataFrame, cap: int = MAX_PAGES, page_count: str = "page_count") -> DataFrame:
    """A row for each part: part_index, page_start, page_end, and page_ranges where there are several."""
    n = F.col(page_count).cast("int")
    parts = docs.select("*", F.posexplode(ranges_of(n, cap)).alias("at", "r"))
    several = F.when(n > cap, F.concat_ws("-", F.col("r.page_start").cast("string"), F.col("r.page_end").cast("string")))
    return parts.select(*docs.columns, (F.col("at") + 1).alias("part_index"), "r.page_start", "r.page_end", several.alias("page_ranges"))


def bisect(ranges: DataFrame, page_bytes: str, target: int = TARGET_PART_BYTES, key: str = "job_id") -> DataFrame:
    """ranges(key, page_start, page_end, page_bytes) split at their middles until each has target bytes at most.

    page_bytes is an array with the bytes of every page of the document. A single page over the target comes
    back with oversize = true. All ranges are split at once, level by level, in rounds bounded by
    the logarithm of the longest range; each round is a projection, so the plan has no shuffle.
    """
    size = F.aggregate(F.slice(page_bytes, F.col("page_start"), F.col("page_end") - F.col("page_start") + 1), F.lit(0).cast("bigint"), lambda a, x: a + x)
    longest = ranges.agg(F.max(F.col("page_end") - F.col("page_start") + 1)).first()[0] or 0
    out = ranges
    for _ in range(max(0, int(longest) - 1).bit_length()):
        middle = F.floor((F.col("page_start") + F.col("page_end")) / 2).cast("int")
        halves = F.array(F.struct("page_start", middle.alias("page_end")), F.struct((middle + 1).alias("page_start"), F.col("page_end").alias("page_end")))
        whole = F.array(F.struct("page_start", "page_end"))
        fits = (size <= target) | (F.col("page_start") == F.col("page_end"))
        rest = [c for c in out.columns if c not in ("page_start", "page_end")]
        out = out.select(*rest, F.explode(F.when(fits, whole).otherwise(halves)).alias("r")).select(*rest, "r.page_start", "r.page_end")
    return out.withColumn("part_bytes", size).withColumn("oversize", F.col("part_bytes") > target)


def plan_parts(sources: DataFrame, cap: int = MAX_PAGES, split: DataFrame | None = None) -> DataFrame:
    """Parts of routed sources(job_id, path, route, page_count, office_page_ranges).

    Physical ones are there where split(path, part_index, page_start, page_end, error) says how they are cut; a source
    that couldn't be cut has no parts.
    """
    name = X.base_name(F.col("path"))
    office = sources.where("route = 'office'").withColumns(
        {"part_index": F.lit(1), "page_start": F.lit(None).cast("int"), "page_end": F.lit(None).cast("int"), "page_ranges": F.col("office_page_ranges")}
    )
    both = page_ranges(sources.where("route = 'logical'"), cap).unionByName(office)
    if split is not None:
        cut = split.where("error is null").select("path", "part_index", "page_start", "page_end")
        whole = sources.where("route = 'physical'").join(cut, "path").withColumn("page_ranges", F.lit(None).cast("string"))
        both = both.unionByName(whole.select(*both.columns))
    physical = F.col("route") == "physical"
    ranged = physical | F.col("page_ranges").isNotNull() & (F.col("route") == "logical")
    return both.withColumns(
        {
            "upload_name": F.when(ranged, X.part_file_name(name, F.col("page_start"), F.col("page_end"))).otherwise(name),
            "data_id": X.part_data_id(F.col("job_id"), F.col("part_index"), F.col("page_start"), F.col("page_end")),
            "output_dir": F.concat("path", F.lit(".parts")),
            "physical": physical,
            "state": F.lit("planned"),
        }
    )
