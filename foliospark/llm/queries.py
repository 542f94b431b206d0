"""The queries opN_<name> over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import decontam, fingerprint, htmltext, linededup, minhash, neighbours, pieces, quality, secrets, tokencount
from .common import table

QUERIES: dict = {}
ORACLE: dict = {}


def op1_minhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES["op1_minhash"] = op1_minhash
ORACLE["op1_minhash"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS shingle FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * common >= 75 * (x.n + y.n - common)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.v, r.c FROM r JOIN l ON l.u = r.doc_id),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""


def op2_pieces(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs, digest=True)


QUERIES["op2_pieces"] = op2_pieces


def op3_tokens(spark, sf_dir):
    counted = tokencount.count_tokens(table(spark, sf_dir, "documents"))
    most = F.coalesce(F.array_max("section_tokens"), F.lit(0)).alias("most_in_section")
    listed = F.sha2(F.array_join(F.transform("section_tokens", lambda n: n.cast("string")), ","), 256).alias("section_tokens_sha256")
    return counted.select("doc_id", "n_tokens", F.size("section_tokens").cast("long").alias("n_sections"), "n_outside", "n_crossing", most, listed)


QUERIES["op3_tokens"] = op3_tokens


def op4_html(spark, sf_dir):
    return htmltext.extract(table(spark, sf_dir, "pages"))


QUERIES["op4_html"] = op4_html


def op6_toxicity(spark, sf_dir):
    return neighbours.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES["op6_toxicity"] = op6_toxicity


def op5_secrets(spark, sf_dir):
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


QUERIES["op5_secrets"] = op5_secrets
_ASSIGN = r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?)([A-Za-z0-9+/_.=-]+)"""


def _spans_sql(kind: str, place: int, pattern: str, group: int, least: int) -> str:
    return f"""
SELECT doc_id, {place} AS place, '{kind}' AS kind, begins, begins + len(m[i]) AS upto
FROM (SELECT doc_id, m, i, v, CAST(coalesce(list_sum(list_transform(g[1:i], lambda x: len(x))), 0)
             + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0) AS BIGINT) AS begins
      FROM (SELECT doc_id, string_split_regex(text, '{pattern}') AS g, regexp_extract_all(text, '{pattern}') AS m,
                   regexp_extract_all(text, '{pattern}', {group}) AS v FROM documents WHERE text IS NOT NULL),
           unnest(range(1, len(m) + 1)) AS t(i))
WHERE len(v[i]) >= {least}"""


_MORE = {r.kind: (k, r.pattern, r.least) for k, r in enumerate(secrets.RULES) if not r.base}
_COUNTED = ", ".join(f"count(*) FILTER (place = {k}) AS n_{kind}" for kind, (k, _, _) in _MORE.items())
ORACLE["op5_secrets"] = f"""
WITH s AS ({_spans_sql("assign", 0, _ASSIGN, 2, 6)} UNION ALL {_spans_sql("access", 1, "AKIA[A-Z0-9]+", 0, 20)}
UNION ALL {_spans_sql("hex", 2, "[0-9a-f]{24,}", 0, 24)} UNION ALL {" UNION ALL ".join(_spans_sql(kind, k, pattern, 0, least) for kind, (k, pattern, least) in _MORE.items())}),
a AS (SELECT doc_id, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access, count(*) FILTER (place = 2) AS n_hex, {_COUNTED},
             string_agg(kind || ':' || begins || ':' || upto, ',' ORDER BY begins, place) FILTER (place < 3) AS base,
             string_agg(kind || ':' || begins || ':' || upto, ',' ORDER BY begins, place) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in _MORE)}
FROM documents LEFT JOIN a USING (doc_id)
"""


def op7_quality(spark, sf_dir):
    return quality.grade(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES["op7_quality"] = op7_quality


def op8_lines(spark, sf_dir):
    out = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_lines", "n_deleted", F.length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("text_sha256"))


QUERIES["op8_lines"] = op8_lines
_TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLE["op8_lines"] = f"""
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
each AS (SELECT doc_id, i - 1 AS pos, trim(parts[i], {_TRIM}) AS line FROM split, unnest(range(1, len(parts) + 1)) AS t(i)),
worded AS (SELECT *, len(regexp_extract_all(line, '[^\x09-\x0D\x20]+')) AS words FROM each WHERE line <> ''),
summed AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS done FROM worded),
numbered AS (SELECT * REPLACE (CAST(done AS BIGINT) AS done), CAST(done - words AS BIGINT) AS before FROM summed),
framed AS (
  SELECT *, list(line) OVER r AS r_all, sum(words) OVER r AS r_sum, first(pos) OVER r AS r_from, last(pos) OVER r AS r_to,
         list(line) OVER l AS l_all, sum(words) OVER l AS l_sum, first(pos) OVER l AS l_from, last(pos) OVER l AS l_to
  FROM numbered
  WINDOW r AS (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING),
         l AS (PARTITION BY doc_id ORDER BY done RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
found AS (SELECT doc_id, r_all AS run, r_from AS lo, r_to AS hi FROM framed WHERE r_sum >= 50
          UNION ALL SELECT doc_id, l_all, l_from, l_to FROM framed WHERE l_sum - words >= 50),
ranked AS (SELECT *, min(row(doc_id, lo)) OVER (PARTITION BY run) AS place FROM found),
gone AS (SELECT doc_id, list(DISTINCT pos) AS gone FROM ranked, unnest(range(lo, hi + 1)) AS t(pos) WHERE row(doc_id, lo) > place GROUP BY doc_id),
kept AS (SELECT doc_id, len(parts) AS n_lines, coalesce(len(gone), 0) AS n_deleted,
                array_to_string(list_filter(parts, lambda x, i: gone IS NULL OR NOT list_contains(gone, i - 1)), chr(10)) AS text
         FROM split LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_deleted AS BIGINT) AS n_deleted,
       CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars, sha256(coalesce(text, '')) AS text_sha256
FROM kept
"""


def op9_fingerprint(spark, sf_dir):
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


QUERIES["op9_fingerprint"] = op9_fingerprint


def op10_decontaminate(spark, sf_dir):
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES["op10_decontaminate"] = op10_decontaminate
_WORDS10 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE["op10_decontaminate"] = f"""
WITH d AS (SELECT doc_id, {_WORDS10} AS w FROM documents),
b AS (SELECT item_id, {_WORDS10} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS gram
      FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(i) WHERE len(w) > 0 AND item_id IS NOT NULL),
lengths AS (SELECT DISTINCT n FROM g),
x AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram
      FROM d CROSS JOIN lengths, unnest(range(1, len(w) - n + 2)) AS t(i)),
hits AS (SELECT doc_id, x.n, i, item_id FROM x JOIN g USING (n, gram)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
