"""Registered queries over the driver's tables, and the same in SQL for DuckDB."""

from __future__ import annotations

import atexit
import io
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import links as L
from ..functions import text as X
from ..operators import archive, batching, enrich, merge, planning, state
from ..sources import files, providers
from ..streaming import fold
from .proxies import event_state, line_parts, paged, sources, table

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_PAGED = "paged AS (SELECT doc_id, text, length(text) AS chars, CAST(ceil(length(text) / 100) AS INTEGER) AS page_count FROM documents)"


def _ranges(cap: int) -> str:
    return f"""ranges AS (SELECT doc_id, page_count, CAST(k + 1 AS INTEGER) AS part_index, CAST(k * {cap} + 1 AS INTEGER) AS page_start,
    CAST(least((k + 1) * {cap}, page_count) AS INTEGER) AS page_end FROM paged, unnest(range(0, (page_count + {cap} - 1) // {cap})) AS t(k))"""


def _plan_sql(cap: int) -> str:
    return f"""WITH {_PAGED}, {_ranges(cap)} SELECT doc_id, part_index, page_start, page_end,
    CASE WHEN page_count > {cap} THEN page_start || '-' || page_end END AS page_ranges FROM ranges"""


def _plan(spark, sf_dir, cap):
    return planning.page_ranges(paged(spark, sf_dir).select("doc_id", "page_count"), cap).select("doc_id", "part_index", "page_start", "page_end", "page_ranges")


@query(_plan_sql(200))
def plan_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir, 200)


@query(_plan_sql(10))
def plan_ranges_small_cap(spark, sf_dir):
    return _plan(spark, sf_dir, 10)


@query(
    f"""WITH {_PAGED}, {_ranges(10)},
    cut AS (SELECT doc_id, part_index, trim(substr(text, (page_start - 1) * 1000 // 10 + 1, 1000), ' ' || chr(10) || chr(9) || chr(13)) AS body, page_start, page_end FROM ranges JOIN paged USING (doc_id))
    SELECT doc_id, count(*) AS n_parts, rtrim(string_agg('<!-- source pages ' || page_start || '-' || page_end || ' -->' || chr(10) || chr(10) || body, chr(10) || chr(10) ORDER BY part_index), ' ' || chr(10) || chr(9) || chr(13)) || chr(10) AS full_md
    FROM cut GROUP BY doc_id"""
)
def merge_documents(spark, sf_dir):
    """The whole way: plan, take each part's text, merge in page order."""
    docs = paged(spark, sf_dir)
    parts = planning.page_ranges(docs, 10)
    body = F.substring(F.col("text"), (F.col("page_start") - 1) * 100 + 1, F.lit(1000))
    # a part of white space alone is done too, so it gets its line feed
    parts = parts.select("doc_id", "part_index", "page_start", "page_end", F.lit("done").alias("state"), F.concat(body, F.lit("\n")).alias("full_md"))
    return merge.merge_parts(parts, "doc_id").select("doc_id", "n_parts", "full_md")


_STEM = """coalesce(nullif(substr(regexp_replace(regexp_replace(regexp_replace({0}, '^(.+)\\.[^.]+$', '\\1'), '[^A-Za-z0-9_.-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g'), 1, 70), ''), 'document')"""


@query(f"SELECT doc_id, {_STEM.format('name')} AS stem FROM (SELECT doc_id, replace(replace(text, chr(10), ' '), '/', ' ') || '.pdf' AS name FROM documents)")
def safe_stem(spark, sf_dir):
    """The whole text as a file name."""
    name = F.concat(F.translate("text", "\n/", "  "), F.lit(".pdf"))
    return table(spark, sf_dir, "documents").select("doc_id", X.safe_stem(name).alias("stem"))


@query(
    f"""WITH {_PAGED}, {_ranges(10)} SELECT doc_id, part_index, printf('j%d.p%04d-%04d', doc_id, page_start, page_end) AS data_id,
    printf('doc-%d.p%04d-%04d.pdf', doc_id, page_start, page_end) AS upload_name FROM ranges"""
)
def part_data_id(spark, sf_dir):
    parts = planning.page_ranges(paged(spark, sf_dir).select("doc_id", "page_count"), 10)
    job, a, b = F.concat(F.lit("j"), F.col("doc_id").cast("string")), F.col("page_start"), F.col("page_end")
    name = F.concat(F.lit("doc "), F.col("doc_id").cast("string"), F.lit(".pdf"))
    return parts.select("doc_id", "part_index", X.part_data_id(job, F.col("part_index"), a, b).alias("data_id"), X.part_file_name(name, a, b).alias("upload_name"))


@query(
    f"""WITH RECURSIVE {_PAGED}, pages AS (SELECT doc_id, page_count, list_transform(range(1, page_count + 1), lambda p: (doc_id * 7 + p * 13) % 50 + 1) AS bytes FROM paged),
    split(doc_id, bytes, a, b) AS (SELECT doc_id, bytes, CAST(1 AS BIGINT), CAST(page_count AS BIGINT) FROM pages WHERE page_count > 0 UNION ALL
      SELECT doc_id, bytes, CASE WHEN h = 0 THEN a ELSE (a + b) // 2 + 1 END, CASE WHEN h = 0 THEN (a + b) // 2 ELSE b END
      FROM split, (VALUES (0), (1)) AS t(h) WHERE a < b AND list_sum(bytes[a:b]) > 400)
    SELECT doc_id, CAST(a AS INTEGER) AS page_start, CAST(b AS INTEGER) AS page_end, CAST(list_sum(bytes[a:b]) AS BIGINT) AS part_bytes,
    list_sum(bytes[a:b]) > 400 AS oversize FROM split WHERE a = b OR list_sum(bytes[a:b]) <= 400"""
)
def bisect_ranges(spark, sf_dir):
    docs = paged(spark, sf_dir).where("page_count > 0")
    size = F.transform(F.sequence(F.lit(1), F.col("page_count")), lambda p: (F.col("doc_id") * 7 + p * 13) % 50 + 1)
    ranges = docs.select("doc_id", F.lit(1).alias("page_start"), F.col("page_count").alias("page_end"), size.alias("bytes"))
    return planning.bisect(ranges, "bytes", 400, "doc_id").drop("bytes")


_SOURCES = """sources AS (SELECT doc_id, '/in/doc ' || doc_id || ['.pdf', '.PDF', '.docx', '.xls', '.txt', '.pptx'][doc_id % 6 + 1] AS path,
    lower(['.pdf', '.PDF', '.docx', '.xls', '.txt', '.pptx'][doc_id % 6 + 1]) AS kind,
    CASE WHEN doc_id % 17 = 0 THEN 0 WHEN doc_id % 19 = 0 THEN NULL ELSE chars * 100000 END AS length, CASE WHEN doc_id % 23 = 0 THEN 0 ELSE page_count END AS page_count FROM paged)"""


@query(
    f"""WITH {_PAGED}, {_SOURCES}, judged AS (SELECT *, CASE WHEN length IS NULL THEN 'missing' WHEN length = 0 THEN 'empty' WHEN kind = '.txt' THEN 'unsupported'
    WHEN kind <> '.pdf' AND length > 209715200 THEN 'too large; export it to PDF' WHEN kind = '.pdf' AND page_count < 1 THEN 'no pages' END AS reason FROM sources)
    SELECT doc_id, CASE WHEN kind = '.pdf' THEN 'pdf' ELSE 'office' END AS source_type,
    CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN kind <> '.pdf' THEN 'office' WHEN length <= 209715200 THEN 'logical' ELSE 'physical' END AS route, reason FROM judged"""
)
def route_source(spark, sf_dir):
    return planning.route(sources(spark, sf_dir)).select("doc_id", "source_type", "route", "reason")


@query(
    f"""WITH {_PAGED}, {_SOURCES}, ok AS (SELECT *, kind = '.pdf' AS pdf FROM sources WHERE length > 0 AND kind <> '.txt' AND length <= 209715200 AND (kind <> '.pdf' OR page_count >= 1)),
    parts AS (SELECT doc_id, path, page_count, CAST(k + 1 AS INTEGER) AS part_index, CASE WHEN pdf THEN k * 200 + 1 END AS a, CASE WHEN pdf THEN least((k + 1) * 200, page_count) END AS b, pdf
      FROM ok, unnest(range(0, CASE WHEN pdf THEN (page_count + 199) // 200 ELSE 1 END)) AS t(k))
    SELECT doc_id, part_index, 'j' || doc_id || CASE WHEN pdf THEN printf('.p%04d-%04d', a, b) ELSE '.part-0001' END AS data_id,
    CASE WHEN pdf AND page_count > 200 THEN printf('doc-%d.p%04d-%04d.pdf', doc_id, a, b) ELSE substr(path, 5) END AS upload_name,
    CASE WHEN NOT pdf THEN '1-20' WHEN page_count > 200 THEN a || '-' || b END AS page_ranges, path || '.parts' AS output_dir FROM parts"""
)
def plan_parts(spark, sf_dir):
    routed = planning.route(sources(spark, sf_dir)).withColumns({"job_id": F.concat(F.lit("j"), F.col("doc_id").cast("string")), "office_page_ranges": F.lit("1-20")})
    return planning.plan_parts(routed).select("doc_id", "part_index", "data_id", "upload_name", "page_ranges", "output_dir")


@query("SELECT doc_id, sha256(text) AS sha FROM documents")
def sha256_text(spark, sf_dir):
    """Texts as the contents of files."""
    held = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return files.with_sha256(held).select("doc_id", F.col("source_sha256").alias("sha"))


@query("SELECT sha256(text) AS sha, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_sources(spark, sf_dir):
    keyed = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    return keyed.groupBy("sha").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query(
    """WITH numbered AS (SELECT l_suppkey, l_orderkey, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1) // 50 AS batch_no FROM lineitem)
    SELECT l_suppkey, CAST(batch_no AS INTEGER) AS batch_no, count(*) AS n, min(l_orderkey) AS first_key, max(l_orderkey) AS last_key FROM numbered GROUP BY 1, 2"""
)
def batch_chunks(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    dealt = batching.batches(lines, "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"])
    return dealt.groupBy("l_suppkey", "batch_no").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first_key"), F.max("l_orderkey").alias("last_key"))


@query(
    """WITH sides AS (SELECT conv_id, list(turn ORDER BY turn) FILTER (role = 'user') AS l, list(turn ORDER BY turn) FILTER (role <> 'user') AS r FROM conversations GROUP BY conv_id)
    SELECT conv_id, CAST(i - 1 AS INTEGER) AS at, l[i] AS part, r[i] AS url, len(l) <> len(r) AS uneven FROM (SELECT conv_id, coalesce(l, []) AS l, coalesce(r, []) AS r FROM sides), unnest(range(1, least(len(l), len(r)) + 1)) AS t(i)"""
)
def zip_positional(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    sides = turns.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.col("turn")))).alias("l"), F.array_sort(F.collect_list(F.when(F.col("role") != "user", F.col("turn")))).alias("r")
    )
    uneven = batching.counts_agree(F.col("l"), F.col("r")).isNotNull().alias("uneven")
    pairs = sides.select("conv_id", uneven, F.posexplode(batching.zip_by_position(F.col("l"), F.col("r"))).alias("at", "p"))
    return pairs.select("conv_id", "at", "p.part", "p.url", "uneven")


@query(
    """WITH parts AS (SELECT doc_id, 'b' || doc_id % 3 AS batch_id, CASE WHEN doc_id % 3 <> 0 THEN 'd' || doc_id END AS data_id, 'n' || doc_id AS name FROM documents),
    status AS (SELECT doc_id * 10 + k AS ord, 'b' || doc_id % 3 AS batch_id, CASE WHEN doc_id % 5 <> 0 AND k < 2 THEN 'd' || doc_id END AS data_id, 'n' || doc_id AS name,
      CASE WHEN k = 0 THEN 'running' WHEN toxic = 1 THEN 'failed' ELSE 'done' END || k AS state FROM labels, unnest(range(0, 3)) AS t(k)),
    by_id AS (SELECT batch_id, data_id, arg_max(state, ord) AS s FROM status WHERE data_id IS NOT NULL GROUP BY 1, 2), by_name AS (SELECT batch_id, name, arg_max(state, ord) AS s FROM status GROUP BY 1, 2)
    SELECT doc_id, coalesce(i.s, n.s, 'waiting-file') AS state, CASE WHEN i.s IS NOT NULL THEN 'data_id' WHEN n.s IS NOT NULL THEN 'name' END AS matched_by
    FROM parts p LEFT JOIN by_id i ON p.batch_id = i.batch_id AND p.data_id = i.data_id LEFT JOIN by_name n ON p.batch_id = n.batch_id AND p.name = n.name"""
)
def reconcile_status(spark, sf_dir):
    i = F.col("doc_id")
    text = i.cast("string")
    batch = F.concat(F.lit("b"), (i % 3).cast("string")).alias("batch_id")
    empty = [F.lit(None).cast("string").alias(c) for c in ("progress", "full_zip_url", "error_code", "error_message", "trace_id", "full_md")]
    parts = table(spark, sf_dir, "documents").select(
        "doc_id", batch, F.when(i % 3 != 0, F.concat(F.lit("d"), text)).alias("data_id"), F.concat(F.lit("n"), text).alias("upload_name"), F.lit("waiting-file").alias("state"), *empty
    )
    rows = table(spark, sf_dir, "labels").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2))))
    k = F.col("k")
    said = F.concat(F.when(k == 0, "running").when(F.col("toxic") == 1, "failed").otherwise("done"), k.cast("string"))
    none = [F.lit(None).cast("string").alias(c) for c in ("extract_progress", "full_zip_url", "err_msg", "err_code", "trace_id")]
    status = rows.select(batch, (i * 10 + k).alias("ord"), F.when((i % 5 != 0) & (k < 2), F.concat(F.lit("d"), text)).alias("data_id"), F.concat(F.lit("n"), text).alias("file_name"), said.alias("state"), *none)
    return state.reconcile(parts, status).select("doc_id", "state", "matched_by")


_LINE_PARTS = """parts AS (SELECT l_orderkey AS job_id, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'R' AND l_quantity > 45 THEN 'failed' WHEN l_linestatus = 'F' THEN 'done' WHEN l_quantity > 30 THEN 'running' ELSE 'planned' END AS state,
    CASE WHEN l_quantity > 5 THEN 'b' || l_suppkey % 7 END AS batch_id, CASE WHEN l_linestatus = 'F' AND l_discount < 0.08 THEN 'text' END AS full_md FROM lineitem)"""


@query(
    f"""WITH {_LINE_PARTS} SELECT job_id, CASE WHEN bool_and(state = 'done' AND full_md IS NOT NULL) THEN 'done' WHEN bool_or(state = 'failed') THEN 'failed'
    WHEN bool_or(state = 'running') THEN 'running' ELSE 'pending' END AS state, array_to_string(list_sort(list(DISTINCT state)), ',') AS states, bool_and(state = 'done' AND full_md IS NOT NULL) AS ready_to_merge FROM parts GROUP BY job_id"""
)
def job_state_fold(spark, sf_dir):
    return state.fold_jobs(line_parts(spark, sf_dir)).withColumn("states", F.array_join("states", ","))


_STATES = "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'click' THEN 'converting' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE event_type END"


@query(f"SELECT user_id, arg_max({_STATES}, row(ts, event_id)) AS state, count(*) AS n_events FROM events GROUP BY user_id")
def event_last_state(spark, sf_dir):
    return fold.last_states(table(spark, sf_dir, "events").withColumn("s", event_state(F.col("event_type"))), "user_id", "s", ["ts", "event_id"])


@query(ORACLE["event_last_state"])
def stream_state_fold(spark, sf_dir):
    """The same fold over the table read as a stream, to its end; each micro-batch goes into a table in the shared folder."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).parquet(path if _is_folder(spark, path) else path.rsplit("/", 1)[0] + "/events*.parquet")
    events = stream.withColumn("s", event_state(F.col("event_type")))
    return fold.fold_into_table(events, "user_id", "s", ["ts", "event_id"], f"{_shared(spark)}/stream-{uuid.uuid4().hex}")


def _shared(spark) -> str:
    """The folder named by spark.checkpoint.dir; a local session without one gets its own, removed at exit."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="foliospark-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return made


def _is_folder(spark, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def _filtered(name: str, condition, sql: str) -> None:
    def run(spark, sf_dir):
        rows = line_parts(spark, sf_dir).where(condition())
        return rows.groupBy("job_id").agg(F.count("*").alias("n"))

    run.__name__ = name
    query(f"WITH {_LINE_PARTS} SELECT job_id, count(*) AS n FROM parts WHERE {sql} GROUP BY job_id")(run)


_filtered("pending_parts", state.is_pending, "state IN ('planned', 'failed')")
_filtered("refresh_set", state.needs_refresh, "batch_id IS NOT NULL AND NOT (state = 'done' AND full_md IS NOT NULL)")
_filtered("ready_to_download", state.ready_to_download, "state = 'done' AND full_md IS NULL")
_filtered("failed_parts", lambda: F.col("state") == "failed", "state = 'failed'")


@query(f"WITH {_LINE_PARTS} SELECT job_id, bool_or(batch_id IS NOT NULL AND full_md IS NULL) AS must_refresh FROM parts GROUP BY job_id")
def refresh_gate(spark, sf_dir):
    return state.must_refresh()(line_parts(spark, sf_dir))


@query(
    f"""WITH {_LINE_PARTS}, numbered AS (SELECT l_suppkey, job_id, (row_number() OVER (PARTITION BY l_suppkey ORDER BY job_id, l_linenumber, l_partkey) - 1) // 5 AS batch_no FROM parts WHERE state = 'failed')
    SELECT l_suppkey, CAST(batch_no AS INTEGER) AS batch_no, count(*) AS n, 'planned' AS state FROM numbered GROUP BY 1, 2"""
)
def resume_failed(spark, sf_dir):
    parts = line_parts(spark, sf_dir).withColumn("part_index", F.struct("job_id", "l_linenumber", "l_partkey"))
    again = state.resume(parts, "l_suppkey", 5)
    return again.groupBy("l_suppkey", "batch_no").agg(F.count("*").alias("n"), F.max("state").alias("state"))


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def incomplete_left_anti(spark, sf_dir):
    return state.undone(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id"), "doc_id")


def _turns(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    index = (F.col("turn") + 1).cast("int")
    return turns.select("conv_id", index.alias("part_index"), F.when(index % 2 == 0, index).alias("page_start"), F.when(index % 2 == 0, index + 1).alias("page_end"), F.lit("done").alias("state"), F.col("text").alias("full_md"))


_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(
    f"""SELECT conv_id, count(*) AS n_parts, bool_and(coalesce(text, '') <> '') AS mergeable, CASE WHEN bool_and(coalesce(text, '') <> '') THEN rtrim(string_agg('<!-- source ' || CASE WHEN turn % 2 = 1 THEN 'pages ' || turn + 1 || '-' || turn + 2 ELSE 'part ' || turn + 1 END
    || ' -->' || chr(10) || chr(10) || trim(text, {_WHITE}), chr(10) || chr(10) ORDER BY turn), {_WHITE}) || chr(10) END AS full_md FROM conversations GROUP BY conv_id"""
)
def merge_ordered(spark, sf_dir):
    return merge.merge_parts(_turns(spark, sf_dir), "conv_id")


@query("SELECT conv_id, count(*) AS n_parts, bool_and(role = 'user' OR length(text) > 40) AS mergeable FROM conversations GROUP BY conv_id")
def merge_completeness(spark, sf_dir):
    done = F.when((F.col("role") == "user") | (F.length("text") > 40), "done").otherwise("running")
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("int").alias("part_index"), F.lit(None).cast("int").alias("page_start"), F.lit(None).cast("int").alias("page_end"), done.alias("state"), F.lit("x").alias("full_md"))
    return merge.merge_parts(turns, "conv_id").select("conv_id", "n_parts", "mergeable")


@query(
    """WITH p AS (SELECT l_orderkey AS k, list(row_number ORDER BY row_number) AS l FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS row_number FROM lineitem) GROUP BY 1)
    SELECT CAST(o_orderkey AS VARCHAR) AS job_id, CAST(coalesce(len(l), 0) AS INTEGER) AS n_parts, o_orderstatus AS source_name, CAST(l[1] AS INTEGER) AS first_index, CAST(l[len(l)] AS INTEGER) AS last_index, false AS leaks FROM orders LEFT JOIN p ON k = o_orderkey"""
)
def manifest(spark, sf_dir):
    """Written as JSON and read again, since layouts of JSON differ between engines."""
    from pyspark.sql import Window

    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("job_id"), F.col("o_orderstatus").alias("source_name"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("job_id"), F.row_number().over(w).alias("part_index"), F.lit(0).alias("page_start"), F.lit(None).cast("int").alias("page_end"))
    written = merge.manifest(jobs, lines)
    read = F.from_json("manifest", "job_id string, source_name string, parts array<struct<index:int>>")
    rows = written.select("job_id", read.alias("m"), F.col("manifest").contains("full_zip_url").alias("leaks"))
    index = F.col("m.parts.index")
    n = F.coalesce(F.size("m.parts"), F.lit(0))
    n = F.when(n < 0, 0).otherwise(n)
    return rows.select(F.col("m.job_id").alias("job_id"), n.alias("n_parts"), F.col("m.source_name").alias("source_name"), F.get(index, F.lit(0)).alias("first_index"), F.get(index, n - 1).alias("last_index"), "leaks")


_HREF = r"""\b(?:[sS][rR][cC]|[hH][rR][eE][fF])\s*=\s*[''"]([^''"]+)[''"]"""


@query(f"SELECT page_id, CAST(len(t) AS INTEGER) AS n_links, t[1] AS first_target FROM (SELECT page_id, regexp_extract_all(html, '{_HREF}', 1) AS t FROM pages)")
def link_extract_html(spark, sf_dir):
    found = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract_all("html", F.lit(L.HTML_LINK), F.lit(2)).alias("t"))
    return found.select("page_id", F.size("t").alias("n_links"), F.get("t", F.lit(0)).alias("first_target"))


def _marked(spark, sf_dir):
    """Documents with links put in: an image of its own, one with query and fragment, a remote one, an anchor, one that is missing."""
    i = F.col("doc_id").cast("string")
    made = F.concat(
        F.lit("![a](images/"), i, F.lit('.png "t")\n[q](files/a%20b.csv?v=1#f) [r](https://x.example/'), i, F.lit(") [s](#top) ![m](images/none.png)\n<img src='images/"), i, F.lit(".png'>\n"), F.col("text")
    )
    return table(spark, sf_dir, "documents").select("doc_id", made.alias("md"))


_MARKED = """marked AS (SELECT doc_id, '![a](images/' || doc_id || '.png "t")' || chr(10) || '[q](files/a%20b.csv?v=1#f) [r](https://x.example/' || doc_id || ') [s](#top) ![m](images/none.png)' || chr(10) || '<img src=''images/' || doc_id || '.png''>' || chr(10) || text AS md FROM documents)"""


@query(f"WITH {_MARKED} SELECT doc_id, array_to_string(regexp_extract_all(md, '!?\\[[^\\]]*\\]\\(([^)\\s]+)(?:\\s+[^)]*)?\\)', 1), ' ') AS targets FROM marked")
def link_extract_md(spark, sf_dir):
    return _marked(spark, sf_dir).select("doc_id", F.array_join(F.regexp_extract_all("md", F.lit(L.MARKDOWN_LINK), F.lit(2)), " ").alias("targets"))


@query(
    f"""WITH {_MARKED}, t AS (SELECT unnest(regexp_extract_all(md, '!?\\[[^\\]]*\\]\\(([^)\\s]+)(?:\\s+[^)]*)?\\)', 1)) AS t FROM marked UNION ALL SELECT unnest(regexp_extract_all(html, '{_HREF}', 1)) FROM pages)
    SELECT CASE WHEN t LIKE 'data:%' THEN 'data' WHEN t LIKE '#%' THEN 'anchor' WHEN regexp_matches(t, '^([A-Za-z][A-Za-z0-9+.-]*:|//)') THEN 'remote' WHEN t LIKE '/%' THEN 'rooted' ELSE 'relative' END AS kind, count(*) AS n FROM t GROUP BY 1"""
)
def link_classify(spark, sf_dir):
    md = _marked(spark, sf_dir).select(F.explode(F.regexp_extract_all("md", F.lit(L.MARKDOWN_LINK), F.lit(2))).alias("t"))
    html = table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit(L.HTML_LINK), F.lit(2))).alias("t"))
    return md.unionByName(html).groupBy(L.link_kind(F.col("t")).alias("kind")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {_MARKED}, led AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN replace(md, 'images/' || doc_id || '.png', printf('assets/part-%04d/images/%d.png', doc_id % 7 + 1, doc_id)) ELSE md END AS md FROM marked)
    SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(md, 'files/a%20b.csv', printf('assets/part-%04d/files/a b.csv', doc_id % 7 + 1)) ELSE md END AS md FROM led"""
)
def rewrite_links(spark, sf_dir):
    i = F.col("doc_id")
    own = F.when(i % 2 == 0, F.array(F.concat(F.lit("images/"), i.cast("string"), F.lit(".png")))).otherwise(F.array().cast("array<string>"))
    both = F.concat(own, F.when(i % 3 == 0, F.array(F.lit("files/a b.csv"))).otherwise(F.array().cast("array<string>")))
    return _marked(spark, sf_dir).select("doc_id", L.rewrite_links(F.col("md"), both, (i % 7 + 1).cast("int")).alias("md"))


@query(
    """SELECT doc_id, 'images/' || doc_id || '.png' AS relative_path FROM documents WHERE doc_id % 2 = 0
    UNION ALL SELECT doc_id, 'files/a b.csv' FROM documents WHERE doc_id % 3 = 0"""
)
def asset_semi_join(spark, sf_dir):
    docs = _marked(spark, sf_dir)
    i = F.col("doc_id")
    have = F.array(F.when(i % 2 == 0, F.concat(F.lit("images/"), i.cast("string"), F.lit(".png"))), F.when(i % 3 == 0, F.lit("files/a b.csv")), F.lit("images/unused.png"))
    assets = docs.select("doc_id", F.explode(F.filter(have, lambda a: a.isNotNull())).alias("relative_path"))
    return archive.used_assets(docs, assets, "doc_id", "md")


@query(
    """WITH m AS (SELECT page_id % 50 AS archive, CASE WHEN page_id % 41 = 0 THEN 'a/../b' WHEN page_id % 43 = 0 THEN '/etc/x' WHEN page_id % 47 = 0 THEN '..' || chr(92) || 'x' ELSE regexp_replace(url, '^[a-z]+://', '') END AS name,
    CASE WHEN page_id % 53 = 0 THEN 40960 ELSE 33188 END AS mode FROM pages)
    SELECT CAST(archive AS VARCHAR) AS archive, count(*) AS n_members, bool_and(NOT (name LIKE '/%' OR list_contains(string_split(replace(name, chr(92), '/'), '/'), '..') OR mode & 61440 = 40960)) AS safe FROM m GROUP BY 1"""
)
def zip_path_safety(spark, sf_dir):
    i = F.col("page_id")
    name = F.when(i % 41 == 0, "a/../b").when(i % 43 == 0, "/etc/x").when(i % 47 == 0, "..\\x").otherwise(F.regexp_replace("url", "^[a-z]+://", ""))
    attr = F.shiftleft(F.when(i % 53 == 0, F.lit(40960)).otherwise(F.lit(33188)).cast("bigint"), 16)
    return archive.archive_safety(table(spark, sf_dir, "pages").select((i % 50).cast("string").alias("archive"), name.alias("name"), attr.alias("external_attr")))


@query("SELECT event_id, CASE WHEN event_id % 4 <> 3 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events")
def json_tolerant(spark, sf_dir):
    i, p = F.col("event_id") % 4, F.col("props")
    wrapped = F.when(i == 0, p).when(i == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(i == 2, F.concat(F.lit("Sure: "), p, F.lit(" done"))).otherwise(F.concat(p, F.lit(" and "), p))
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(X.tolerant_json(wrapped), "$.k", "bigint").alias("k"))


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def json_content_concat(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    content = F.transform("t", lambda x: F.struct(F.lit("text").alias("type"), x["text"].alias("text")))
    reply = F.to_json(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices")))
    return turns.select("conv_id", X.chat_content(reply).alias("text"))


@query("SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || chr(10) || chr(10) || '[…truncated…]' ELSE text END AS body FROM documents")
def truncate_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.truncated(F.col("text"), 500).alias("body"))


@query(
    f"""SELECT conv_id, 'head' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '> ## Document metadata' || chr(10) || '>' || chr(10) || '> ### Sections' || chr(10) || '>' || chr(10) || '> | Section | Summary |' || chr(10) || '> | ---- | ---- |' || chr(10) ||
    string_agg('> | ' || replace(replace(role, '|', '\\|'), chr(10), ' ') || ' | ' || replace(replace(trim(text, {_WHITE}), '|', '\\|'), chr(10), ' ') || ' |', chr(10) ORDER BY turn) || chr(10) || '>' || chr(10) AS block FROM conversations GROUP BY conv_id"""
)
def render_sections(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("title"), F.col("text").alias("summary")))).alias("s"))
    sections = F.transform("s", lambda r: F.struct(r["title"].alias("title"), r["summary"].alias("summary")))
    none = "array<struct<name:string,type:string,description:string>>"
    semantics = F.struct(sections.alias("sections"), F.array().cast(none).alias("entities"), F.array().cast("array<string>").alias("cross_references"), F.array().cast("array<string>").alias("tags"))
    rows = turns.withColumn("semantics", semantics)
    return rows.select("conv_id", enrich.metadata_block(F.lit("head \n"), F.col("semantics"), F.lit(None).cast("string")).alias("block"))


@query("SELECT doc_id, '`#' || lang || '` `#' || source || '` `##x`' AS tags FROM documents")
def render_tags(spark, sf_dir):
    tags = F.array(F.col("lang"), F.concat(F.lit("#"), "source", F.lit(" ")), F.lit("  "), F.lit(" #x"))
    return table(spark, sf_dir, "documents").select("doc_id", X.render_tags(tags).alias("tags"))


@query(
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/gif' WHEN 3 THEN 'image/webp' WHEN 4 THEN 'image/bmp' ELSE 'image/jpeg' END AS mime,
    'data:' || CASE p_partkey % 6 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/gif' WHEN 3 THEN 'image/webp' WHEN 4 THEN 'image/bmp' ELSE 'image/jpeg' END || ';base64,' || to_base64(encode(repeat(p_name, 6))) AS url FROM part"""
)
def data_url(spark, sf_dir):
    name = F.concat("p_name", F.element_at(F.array(*[F.lit(s) for s in (".PNG", ".jpeg", ".gif", ".webp", ".bmp", ".tiff")]), (F.col("p_partkey") % 6 + 1).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", X.mime_of(name).alias("mime"), X.data_url(name, F.encode(F.repeat("p_name", F.lit(6)), "UTF-8")).alias("url"))


@query("SELECT o_orderkey, o_orderstatus AS state, CAST(1 AS INTEGER) AS n_parts, 'data_id,index' AS part_fields FROM orders")
def redact_public(spark, sf_dir):
    part = F.struct(F.lit(1).alias("index"), F.col("o_orderpriority").alias("data_id"), F.lit("u").alias("full_zip_url"), F.lit("l").alias("local_path"), F.lit("e").alias("extracted_dir"), F.lit("m").alias("full_md"))
    jobs = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("state"), F.lit("/w").alias("work_dir"), F.array(part).alias("parts"))
    shown = merge.public(jobs, "parts")
    fields = ",".join(sorted(f.name for f in shown.schema["parts"].dataType.elementType.fields))
    return shown.select("o_orderkey", "state", F.size("parts").alias("n_parts"), F.lit(fields).alias("part_fields")) if "work_dir" not in shown.columns else shown


@query("SELECT label, count(*) FILTER (vec_id % 5 <> 0) AS n_ok, count(*) FILTER (vec_id % 5 = 0) AS n_failed FROM embeddings GROUP BY label")
def image_error_isolation(spark, sf_dir):
    """Every vector as an image for the stub, which refuses some: they come back as rows with an error."""
    i = F.col("vec_id")
    name = F.concat(F.when(i % 5 == 0, "bad-").otherwise("img-"), i.cast("string"), F.lit(".png")).alias("file")
    images = table(spark, sf_dir, "embeddings").select("label", name)
    answers = providers.called(images, "file", providers.StubEnrichment().analyze_image)
    rows = answers.select("label", "file", F.try_variant_get(X.tolerant_json(F.col("answer")), "$.summary", "string").alias("summary"), F.col("error_message").alias("error"))
    return enrich.image_outcomes(rows, "label").select("label", "n_ok", "n_failed")


@query("SELECT CAST(k AS INTEGER) AS attempt, CAST(CASE WHEN k % 2 = 1 THEN k ELSE least(pow(2.0, k), 15) END AS DOUBLE) AS delay FROM unnest(range(0, 8)) AS t(k)")
def backoff_schedule(spark, sf_dir):
    k = F.col("id").cast("int")
    after = F.when(k % 2 == 1, k.cast("string")).otherwise("soon")
    return spark.range(8).select(k.alias("attempt"), X.retry_delay(k, 15, after).alias("delay"))


@query("SELECT doc_id, text AS text FROM documents")
def strip_text(spark, sf_dir):
    pad = F.lit("　 \t\n")
    return table(spark, sf_dir, "documents").select("doc_id", X.strip(F.concat(pad, "text", pad)).alias("text"))


@query("SELECT p_partkey, '\"' || replace(replace(v, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"') || '\"' AS toml FROM (SELECT p_partkey, p_name || '\"' || chr(92) || p_type AS v FROM part)")
def toml_escape(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.toml_string(F.concat("p_name", F.lit('"\\'), "p_type")).alias("toml"))


@query("SELECT l_orderkey, CAST((n - 1) // 50 AS INTEGER) AS batch_no, CAST(count(*) AS INTEGER) AS n_files, bool_or(n % 3 = 0) AS has_ranges FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem) GROUP BY 1, 2")
def upload_requests(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    n = F.col("part_index")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(w).alias("part_index"))
    options = F.struct(F.lit("vlm").alias("model_version"), F.lit(False).alias("is_ocr"), F.lit("ch").alias("language"), F.lit(True).alias("enable_table"), F.lit(True).alias("enable_formula"), F.array().cast("array<string>").alias("extra_formats"))
    parts = lines.select("l_orderkey", "part_index", F.format_string("f%d.pdf", n).alias("upload_name"), F.format_string("j.%d", n).alias("data_id"), F.when(n % 3 == 0, "1-200").otherwise("").alias("page_ranges"), options.alias("options"))
    made = batching.requests(batching.batches(parts, "l_orderkey", ["part_index"]), "l_orderkey")
    files = F.from_json("request", "files array<struct<name:string>>")["files"]
    return made.select("l_orderkey", "batch_no", F.size(files).alias("n_files"), F.col("request").contains("page_ranges").alias("has_ranges"))


@query("SELECT page_id, printf('%s', 'h') || page_id || CASE WHEN n > 1 THEN ' (' || n || ')' ELSE '' END || '.md' AS published_name FROM (SELECT page_id % 40 AS page_id, row_number() OVER (PARTITION BY page_id % 40 ORDER BY page_id) AS n FROM pages)")
def published_names(spark, sf_dir):
    from ..sources.sinks import published_names as named

    docs = table(spark, sf_dir, "pages").select((F.col("page_id") % 40).alias("k"), "page_id", F.concat(F.lit("h"), (F.col("page_id") % 40).cast("string"), F.lit(".html")).alias("source_name"))
    return named(docs, order="page_id").select(F.col("k").alias("page_id"), "published_name")


@query("SELECT doc_id, length(text) > 0 AS ok, CASE WHEN length(text) > 0 THEN '[' || CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || chr(10) || chr(10) || '[…truncated…]' ELSE text END || ']' END AS prompt FROM documents")
def prompt_text(spark, sf_dir):
    ok = X.strip(F.col("text")) != ""
    return table(spark, sf_dir, "documents").select("doc_id", ok.alias("ok"), F.when(ok, X.prompt("[{markdown}]", F.col("text"), 300)).alias("prompt"))


@query("SELECT event_id, (value < 50 OR event_id % 7 = 0) AS retry, event_id % 2 = 0 AS https FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 100 ELSE event_id % 100 END AS value FROM events)")
def retry_predicates(spark, sf_dir):
    i = F.col("event_id")
    status = F.when(i % 7 == 0, 429).when(i % 100 < 50, 500 + i % 100).otherwise(400 + i % 20)
    url = F.concat(F.when(i % 2 == 0, "HTTPS://x/").otherwise("http://x/"), i.cast("string"))
    return table(spark, sf_dir, "events").select("event_id", providers.retryable(status).alias("retry"), providers.https(url).alias("https"))


@query(
    """SELECT event_id, CASE k WHEN 0 THEN 'ok' END AS answer, CASE k WHEN 1 THEN '-60009' WHEN 2 THEN '-60005' WHEN 3 THEN 'ApiError' END AS error_code,
    CASE k WHEN 1 THEN 'busy' WHEN 2 THEN 'no; export Office files to PDF before another try' WHEN 3 THEN 'results are only fetched by https' END AS error_message, k = 1 AS transient
    FROM (SELECT event_id, event_id % 4 AS k FROM events)"""
)
def call_outcomes(spark, sf_dir):
    """Calls that are answered, refused for now, refused for their format, and not sent, each a row."""

    def call(k: int) -> str:
        if k == 3:
            return providers.require_https("http://x")
        return providers.checked({0: {"code": 0, "data": "ok"}, 1: {"code": -60009, "msg": "busy"}, 2: {"code": -60005, "msg": "no"}}[k])["data"]

    asked = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 4).alias("k"))
    return providers.called(asked, "k", call).select("event_id", "answer", "error_code", "error_message", F.coalesce(providers.transient(F.col("error_code")), F.lit(False)).alias("transient"))


@query(
    """WITH m AS (SELECT doc_id % 200 AS archive, doc_id, CASE WHEN doc_id % 3 = 0 THEN 'out/full.md' ELSE 'out/' || doc_id || '.md' END AS name FROM documents),
    n AS (SELECT archive, count(*) FILTER (name = 'out/full.md') AS n_found, min(doc_id) FILTER (name = 'out/full.md') AS one FROM m GROUP BY archive)
    SELECT CAST(archive AS VARCHAR) AS archive, n_found, CASE WHEN n_found = 1 THEN text END AS full_md,
    CASE WHEN n_found <> 1 THEN 'expected one full.md, found ' || n_found END AS error FROM n LEFT JOIN documents ON doc_id = one"""
)
def only_text(spark, sf_dir):
    i = F.col("doc_id")
    name = F.when(i % 3 == 0, "out/full.md").otherwise(F.concat(F.lit("out/"), i.cast("string"), F.lit(".md")))
    members = table(spark, sf_dir, "documents").select((i % 200).cast("string").alias("archive"), name.alias("name"), F.encode("text", "UTF-8").alias("content"))
    return merge.only_text(members, ["archive"])


@query(
    """SELECT page_id, html AS full_md, CASE WHEN page_id % 2 = 0 THEN 'images/x.png' END AS asset, CASE page_id % 5 WHEN 3 THEN 'unsafe member' WHEN 4 THEN 'archive' END AS error
    FROM pages WHERE page_id % 5 < 3 UNION ALL SELECT page_id, NULL, NULL, CASE page_id % 5 WHEN 3 THEN 'unsafe member' ELSE 'broken' END FROM pages WHERE page_id % 5 >= 3"""
)
def result_archives(spark, sf_dir):
    """Pages packed as results: texts and assets come out of whole archives, nothing out of unsafe or broken ones."""

    def pack(batches):
        for batch in batches:
            made = []
            for i, html in zip(batch["page_id"], batch["html"]):
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("out/full.md", html)
                    z.writestr("other.json", "{}")
                    if i % 2 == 0:
                        z.writestr("out/images/x.png", "x")
                    if i % 5 == 3:
                        z.writestr("../x", "x")
                made.append(b"broken" if i % 5 == 4 else out.getvalue())
            yield batch[["page_id"]].assign(content=made)

    packed = table(spark, sf_dir, "pages").select("page_id", "html").mapInPandas(pack, "page_id long, content binary")
    texts, assets = archive.result_parts(packed.select(F.col("page_id").cast("string").alias("path"), "content"))
    both = texts.join(assets.select("path", F.col("relative_path").alias("asset")), "path", "left")
    error = F.when(F.col("error") == "unsafe member", "unsafe member").when(F.col("error").isNotNull(), "broken")
    return both.select(F.col("path").cast("long").alias("page_id"), "full_md", "asset", error.alias("error"))


@query(
    """SELECT conv_id, 'head' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '> ## Document metadata' || chr(10) || '>' || chr(10)
    || '> ### Entities and terms' || chr(10) || '>' || chr(10) || '> | Name | Type | Description |' || chr(10) || '> | ---- | ---- | ---- |' || chr(10)
    || string_agg('> | ' || role || ' | kind | ' || turn || ' \\| x |', chr(10) ORDER BY turn) || chr(10) || '>' || chr(10)
    || '> ### Cross references' || chr(10) || '>' || chr(10) || string_agg('> - see ' || turn, chr(10) ORDER BY turn) || chr(10) || '>' || chr(10)
    || '> ### Tags' || chr(10) || '>' || chr(10) || '> ' || string_agg('`#' || role || '`', ' ' ORDER BY turn) || chr(10) || '>' || chr(10)
    || '> ### Images' || chr(10) || '>' || chr(10) || '> ````json' || chr(10) || '> [ {' || chr(10) || '>   "file" : "' || conv_id || '.png"' || chr(10) || '> } ]' || chr(10) || '> ````' || chr(10) AS block
    FROM conversations GROUP BY conv_id"""
)
def render_metadata(spark, sf_dir):
    """Entities, references, tags and images; references that are blank are left out."""
    one = F.struct("turn", F.col("role").alias("name"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("t"))
    text = lambda t: t["turn"].cast("string")
    entities = F.transform("t", lambda t: F.struct(t["name"].alias("name"), F.lit(" kind").alias("type"), F.concat(text(t), F.lit(" | x")).alias("description")))
    references = F.concat(F.array(F.lit("  ")), F.transform("t", lambda t: F.concat(F.lit(" see "), text(t))))
    semantics = F.struct(
        F.array().cast("array<struct<title:string,summary:string>>").alias("sections"), entities.alias("entities"), references.alias("cross_references"), F.transform("t", lambda t: F.concat(F.lit("#"), t["name"])).alias("tags")
    )
    shown = F.to_json(F.array(F.struct(F.concat(F.col("conv_id").cast("string"), F.lit(".png")).alias("file"))), {"pretty": "true"})
    rows = rows.withColumns({"semantics": semantics, "images_json": shown})
    return rows.select("conv_id", enrich.metadata_block(F.lit("head"), F.col("semantics"), F.col("images_json")).alias("block"))


@query(
    """SELECT vec_id, CASE WHEN vec_id % 5 <> 0 THEN 'chart' END AS type, CASE WHEN vec_id % 5 <> 0 THEN 'n ' || label END AS summary, CASE WHEN vec_id % 5 <> 0 THEN 'a,b' END AS keywords,
    CASE vec_id % 5 WHEN 0 THEN 'the answer is no JSON' END AS error FROM embeddings"""
)
def image_fields(spark, sf_dir):
    """All fields of what is said of an image; an answer that is no JSON is an error."""
    i, label = F.col("vec_id"), F.col("label").cast("string")
    said = F.to_json(F.struct(F.lit("chart").alias("type"), F.concat(F.lit("n "), label).alias("summary"), F.array(F.lit("e")).alias("elements"), F.array(F.lit("f")).alias("key_findings"), F.array(F.lit("a"), F.lit("b")).alias("keywords")))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.lit("f.png").alias("file"), F.when(i % 5 == 0, "sorry").otherwise(F.concat(F.lit("```json\n"), said, F.lit("\n```"))).alias("answer"), F.lit(None).cast("string").alias("error_message"))
    return enrich.image_semantics(rows, "vec_id").select("vec_id", "type", "summary", F.array_join("keywords", ",").alias("keywords"), "error")


@query(
    """WITH p AS (SELECT page_id % 20 AS archive, 'out/assets/' || page_id || CASE page_id % 3 WHEN 0 THEN '.png' WHEN 1 THEN '.JPG' ELSE '.txt' END AS name FROM pages)
    SELECT CAST(archive AS VARCHAR) AS archive, name, CAST(row_number() OVER (PARTITION BY archive ORDER BY name) AS INTEGER) AS image_no FROM p WHERE name NOT LIKE '%.txt'"""
)
def asset_images(spark, sf_dir):
    i = F.col("page_id")
    name = F.concat(F.lit("out/assets/"), i.cast("string"), F.element_at(F.array(F.lit(".png"), F.lit(".JPG"), F.lit(".txt")), (i % 3 + 1).cast("int")))
    return archive.images(table(spark, sf_dir, "pages").select((i % 20).cast("string").alias("archive"), name.alias("name")))


@query("SELECT doc_id, string_agg('> ' || line, chr(10) ORDER BY i) AS quoted FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents) GROUP BY doc_id")
def quote_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.quoted(F.col("text")).alias("quoted"))
