"""Line dedup by winnowing over line hashes, in DataFrame operations only.

A document is the sequence of its lines that have words. From each line a window reaches to
the right over the fewest lines with `MIN_WORDS` words in all, and from each line one reaches to
the left. The smallest line hash in a window (of equal ones the first) is selected as its fingerprint; every run of
lines that has `MIN_WORDS` words and occurs twice holds a whole window at both places, so both places select the same
line of it: no such run escapes. Positions are joined by fingerprint: one that a single position has goes,
with all the windows that selected it. From the positions that are left matches are extended to both sides, to the ends of
the windows around them, whose contents are compared in 128 bits; as windows begin at the run's first
line and others end at its last, together they reach both ends of the run.

Of equal windows the first, in the order of doc_id and line, stays; the lines of every later
one are deleted. What is deleted is therefore always still there at an earlier place.

Windows are formed once and written to the shared folder. Nothing is collected by group: the first and last position of a
fingerprint and the first window of each content come from aggregations that combine before their shuffle. Fingerprints
are broadcast up to a number, else joined by a shuffle; contents find their way back by an equi-join that may be split.

Defined results: null text stays null, empty text empty; rows that are equal in doc_id and
text count as one document and stay alike; rows that share a doc_id with different texts are
documents in the order of their hashes; null ids come first. Lines are compared without the
white space at their ends; blank lines don't match, and go only inside a run. All columns stay, but
n_lines and n_deleted are replaced; n_chars, where there is one, is counted anew. No row is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

MIN_WORDS = 50
#: Fingerprints of several positions are broadcast up to this number.
MAX_BROADCAST_PRINTS = 1_000_000
_BLANK = r"^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$"
_ROW = ["line_doc", "line_text"]


def _rows(docs: DataFrame) -> DataFrame:
    """docs with what names a document: its id and a hash of its text."""
    return docs.withColumns({"line_doc": F.col("doc_id").cast("long"), "line_text": F.xxhash64(F.col("text").cast("string"))})


def lines(docs: DataFrame) -> DataFrame:
    """A row for each line with words: document, position, hashes, words, and the words before and up to it."""
    split = F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("pos", "line")
    each = _rows(docs.select("doc_id", "text")).select(*_ROW, split)
    bare = F.regexp_replace("line", _BLANK, "")
    each = each.select(*_ROW, "pos", bare.alias("line")).where("line <> ''")
    n_words = F.size(F.split("line", r"[\x09-\x0D\x20]+"))
    each = each.select(*_ROW, "pos", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("h2"), n_words.cast("long").alias("words"))
    each = each.repartition(*_ROW).dropDuplicates([*_ROW, "pos"])
    up_to = F.sum("words").over(Window.partitionBy(*_ROW).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return each.withColumn("done", up_to).withColumn("before", F.col("done") - F.col("words"))


def windows(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Fingerprint and its position, content, first and last line, and document of the windows of every document."""
    right = Window.partitionBy(*_ROW).orderBy("before").rangeBetween(0, min_words - 1)
    left = Window.partitionBy(*_ROW).orderBy("done").rangeBetween(1 - min_words, 0)

    def over(w, kind: str) -> dict:
        return {
            f"{kind}_sum": F.sum("words").over(w),
            f"{kind}_low": F.min(F.struct("h", "pos")).over(w),
            f"{kind}_all": F.xxhash64(F.collect_list("h2").over(w)),
            f"{kind}_from": F.first("pos").over(w),
            f"{kind}_to": F.last("pos").over(w),
        }

    each = lines(docs).withColumns(over(right, "right")).withColumns(over(left, "left"))
    # a window to the left that would do without its last line starts no window to the right
    kinds = F.array(
        *[
            F.when(keep, F.struct(*[F.col(f"{k}_{a}").alias(b) for a, b in (("low.h", "fingerprint"), ("low.pos", "at"), ("all", "content"), ("from", "first"), ("to", "last"))]))
            for k, keep in (
                ("right", F.col("right_sum") >= min_words),
                ("left", (F.col("left_sum") - F.col("words") >= min_words)),
            )
        ]
    )
    found = each.select(*_ROW, F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("k"))
    return found.select("k.*", *_ROW)


def matched(found: DataFrame) -> DataFrame:
    """The windows whose fingerprint was selected at several positions."""
    place = F.struct(*_ROW, "at")
    shared = found.groupBy("fingerprint").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi").select("fingerprint")
    shared = cut(shared)
    return found.join(F.broadcast(shared) if shared.count() <= MAX_BROADCAST_PRINTS else shared, "fingerprint", "left_semi")


def repeated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """line_doc, line_text and the positions of lines to delete, a row for each document with any."""
    found = matched(cut(windows(docs, min_words)))
    place = F.struct(*_ROW, "first")
    first = found.groupBy("fingerprint", "content").agg(F.min(place).alias("place"), F.count("*").alias("n"))
    first = first.where("n > 1").drop("n")
    later = found.join(first, ["fingerprint", "content"]).where(place > F.col("place"))
    gone = later.select(*_ROW, F.explode(F.sequence("first", "last")).alias("pos")).distinct()
    return gone.groupBy(*_ROW).agg(F.collect_list("pos").alias("gone"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with later repeated runs deleted from text, and the columns n_lines and n_deleted."""
    gone = repeated(docs, min_words).select(F.col("line_doc").alias("gone_doc"), F.col("line_text").alias("gone_text"), "gone")
    names = [c for c in docs.columns if c not in ("n_lines", "n_deleted")]
    mine = _rows(docs.select("doc_id", "text", F.struct(*[c for c in names if c != "text"]).alias("doc")))
    both = mine.join(gone, F.col("line_doc").eqNullSafe(F.col("gone_doc")) & (F.col("line_text") == F.col("gone_text")), "left")
    parts = F.split(F.col("text").cast("string"), "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("gone"))
    cleaned = F.array_join(F.transform(kept, lambda i: F.element_at(parts, i + 1)), "\n")
    cleaned = F.when(F.col("gone").isNull(), F.col("text")).otherwise(cleaned)
    n_lines = F.coalesce(F.size(parts), F.lit(0)).cast("long")
    both = both.select("doc", cleaned.alias("cleaned"), n_lines.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_deleted"))
    new = {"text": F.col("cleaned"), "n_chars": F.length("cleaned")}
    columns = [new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col(f"doc.`{c}`") for c in names]
    return both.select(*columns, "n_lines", "n_deleted")
