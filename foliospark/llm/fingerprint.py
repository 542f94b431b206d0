"""Canonical exact fingerprints of documents, in DataFrame operations only.

The canonical form of a text is in Unicode normal form C with full case folding, each run of
white space one space and none at the ends. Its fingerprint is 128 bits of xxhash64 with two
seeds. Documents in one bucket of the hash are grouped by the canonical bytes themselves, so a
collision would part; a text that collides with another gets its place among them as a suffix.

Likeness of two fingerprints is 1 if they are the same and else 0: an exact digest knows
no more. For a text against its neighbour and its edited text, canonical forms count as the same if their SHA-256 is.

Defined results: a null text counts as empty; equal texts have equal fingerprints, ties and
repeated rows included. "Next" goes down in doc_id, null ids last, rows of one id in the order of
their hashes, and from the last to the first; a single row is its own next. An empty table
gives an empty result. Other columns are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Buckets of hashes with several rows are broadcast up to this number, else joined by a shuffle.
MAX_BROADCAST_BUCKETS = 500_000
#: Rows to a range of doc_id that is sorted by itself, while there are fewer ranges than this.
RANGE_ROWS, MAX_RANGES = 2_000, 65_536
#: The code points that Unicode calls white space.
WHITE = r"[\x09-\x0D\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def canonical(text: Column) -> Column:
    ascii_only = F.octet_length(text) == F.char_length(text)

    def composed(x: Column) -> Column:
        return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(False))

    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed(text), F.lit(True))
    lower = F.when(ascii_only, F.lower(text)).otherwise(composed(folded))
    return F.regexp_replace(F.regexp_replace(lower, WHITE, " "), "^ | $", "")


def _hashes(canon: Column) -> tuple[Column, Column]:
    return F.xxhash64(canon), F.xxhash64(F.lit(1), canon)


def digest(h1: Column, h2: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(h1), 16, "0"), F.lpad(F.hex(h2), 16, "0")))


def exact_groups(docs: DataFrame, digests: DataFrame) -> DataFrame:
    """h1, h2, canon_sha256, group_id (smallest doc_id), n_copies, place of canonical texts that several rows share or whose bucket others share.

    digests has h1, h2 and raw, a hash of the text as it is, of every row of docs; by raw the texts of buckets with
    several rows are found without the canonical forms of all others.
    """
    by_raw = digests.groupBy("h1", "h2", "raw").agg(F.count("*").alias("n"))
    several = by_raw.groupBy("h1", "h2").agg(F.sum("n").alias("n")).where("n > 1")
    shared = cut(by_raw.join(several, ["h1", "h2"], "left_semi").select("raw").distinct())
    few = shared.count() <= MAX_BROADCAST_BUCKETS
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("raw", F.xxhash64("text")).join(F.broadcast(shared) if few else shared, "raw", "left_semi")
    rows = rows.select("doc_id", canonical(F.col("text")).alias("canon"))
    h1, h2 = _hashes(F.col("canon"))
    rows = rows.select("doc_id", "canon", h1.alias("h1"), h2.alias("h2"))
    same = rows.groupBy("h1", "h2", "canon").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("n_copies"))
    same = same.select("h1", "h2", F.sha2("canon", 256).alias("canon_sha256"), "group_id", "n_copies")
    order = Window.partitionBy("h1", "h2").orderBy("canon_sha256")
    return same.withColumn("place", F.row_number().over(order) - 1)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, h1, h2, canon_sha256, next_text, next_sha256: a null text is empty; the next row goes down in doc_id, from the last to the first.

    Rows are sorted in ranges of doc_id whose edges are ids of the table. Rows at the upper
    edge of a range also go to the range above, to stand behind its last row; so each
    text is shuffled once and no task holds more than a range. Hashes of the canonical form go
    along, so that it is made once for a text and not again for its neighbour.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = min(MAX_RANGES, docs.count() // RANGE_ROWS + 1)
    cuts = F.percentile_approx("doc_id", [k / n for k in range(1, n)], 20 * n) if n > 1 else F.array().cast("array<bigint>")
    seen = rows.agg(cuts.alias("cuts"), F.max("doc_id").alias("top")).first()
    top = seen["top"]
    edges = sorted({e for e in seen["cuts"] or [] if e != top})
    steps, width = [], 1
    while width <= len(edges):
        steps.insert(0, width)
        width *= 2
    edge = F.lit(edges).cast("array<bigint>") if edges else F.array().cast("array<bigint>")
    id_ = F.col("doc_id")
    if edges:
        # how many edges lie below the id, by bisection
        at = F.aggregate(
            F.lit(steps),
            F.lit(0),
            lambda low, step: F.when((low + step <= len(edges)) & (F.get(edge, low + step - 1) < id_), low + step).otherwise(low),
        )
    else:
        at = F.lit(0)
    rows = rows.withColumn("range", F.when(id_.isNull(), 0).otherwise(at))
    on_edge = F.get(edge, F.col("range")) == id_ if edges else F.lit(False)
    places = F.filter(
        F.array(
            F.struct(F.col("range").alias("range"), F.lit(0).alias("role")),
            F.when(on_edge, F.struct((F.col("range") + 1).alias("range"), F.lit(1).alias("role"))),
            F.when(id_.eqNullSafe(F.lit(top).cast("bigint")), F.struct(F.lit(0).alias("range"), F.lit(2).alias("role"))),
        ),
        lambda p: p.isNotNull(),
    )
    h1, h2 = _hashes(F.col("canon"))
    rows = rows.withColumn("canon", canonical(F.col("text")))
    rows = rows.select("doc_id", "text", "range", h1.alias("h1"), h2.alias("h2"), F.sha2("canon", 256).alias("canon_sha256"))
    kept = ["doc_id", "text", "h1", "h2", "canon_sha256"]
    rows = rows.select(*kept, F.explode(places).alias("p")).select(*kept, "p.range", "p.role")
    order = Window.partitionBy("range").orderBy(F.col("role") == 2, F.desc_nulls_last("doc_id"), F.xxhash64("text"))
    rows = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("next_sha256", F.lead("canon_sha256").over(order))
    return rows.where("role = 0").select(*kept, "next_text", "next_sha256")


def fingerprints(docs: DataFrame) -> DataFrame:
    """The digest of every row of docs(doc_id, text) beside that of its edited text and the next row's.

    The edited text has the last half of the code points replaced by as many first ones of the
    next text. Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, group_id, n_copies.
    """
    rows = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half))
    rows = rows.withColumn("edited", edited)
    kept = ["doc_id", "n_chars", "h1", "h2", "canon_sha256", "next_sha256"]
    rows = rows.select(*kept, F.xxhash64("text").alias("raw"), F.sha2("edited", 256).alias("edited_sha256"), canonical(F.col("edited")).alias("edited"))
    c, d = _hashes(F.col("edited"))
    rows = rows.select(*kept, "raw", "edited_sha256", c.alias("c"), d.alias("d"), F.sha2("edited", 256).alias("new_sha256"))
    digests = cut(
        rows.select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            "h1",
            "h2",
            "canon_sha256",
            "raw",
            digest(F.col("c"), F.col("d")).alias("edited_fingerprint"),
            (F.col("canon_sha256") == F.col("new_sha256")).cast("double").alias("near_edited"),
            (F.col("canon_sha256") == F.col("next_sha256")).cast("double").alias("near_next"),
        )
    )
    out = digests.join(exact_groups(docs, digests), ["h1", "h2", "canon_sha256"], "left")
    suffix = F.when(F.col("place") > 0, F.concat(F.lit("-"), F.col("place").cast("string"))).otherwise("")
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.concat(digest(F.col("h1"), F.col("h2")), suffix).alias("fingerprint"),
        "edited_fingerprint",
        "near_edited",
        "near_next",
        F.coalesce("group_id", "doc_id").alias("group_id"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
    )
