"""Benchmark decontamination: documents' word windows against a hash set of test n-grams.

The n-grams of the benchmark are hashed on the executors, written once and counted. A table of at most `max_windows`
n-grams and `max_bytes` bytes is broadcast; a larger one is dealt by hash into parts below that size. The documents
are scanned once for each part, and what a scan found is written before the next begins, so that a worker
holds one part at a time. A hash that hits is verified word by word.

Defined results: null and empty texts have no words and no hits; a benchmark row without
an id or without words is passed over; rows that repeat an item_id are further texts of that
item; rows that repeat a doc_id each get their own result; other columns are passed over
(decontaminate keeps them). An empty table gives an empty result, an empty benchmark no hits.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM_LOWER_ONLY, Words, bounded_batches, cut, text_chunks, tidied

WINDOW = 10
MAX_WINDOWS = 1_000_000
MAX_BYTES = 128_000_000
#: Bytes of a gram in a table besides its words: hash, item and place.
_GRAM_BYTES = 24

_GRAMS = "item_id long, n int, h long, gram binary"
_HITS = "struct<n_words:bigint,n_hit:bigint,lo:array<bigint>,hi:array<bigint>,items:array<bigint>>"
_HIT_TYPES = {"n_words": pa.int64(), "n_hit": pa.int64(), **dict.fromkeys(("lo", "hi", "items"), pa.list_(pa.int64()))}
_ADDED = "hits of test grams"


def _grams_of(window: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows: list[tuple] = []
            for row, end, data, offsets in text_chunks(batch.column(1)):
                w = Words(data, offsets, ALNUM_LOWER_ONLY)
                hashes: dict[int, np.ndarray] = {}
                for k in range(end - row):
                    n = min(window, int(w.first[k + 1] - w.first[k]))
                    if ids[row + k] is None or not n:
                        continue
                    if n not in hashes:
                        hashes[n] = w.runs(n).view(np.int64)
                    for i in range(int(w.first[k]), int(w.first[k + 1]) - n + 1):
                        rows.append((ids[row + k], n, int(hashes[n][i]), b" ".join(w.word(j) for j in range(i, i + n))))
            columns = list(zip(*rows)) if rows else [(), (), (), ()]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["item_id", "n", "h", "gram"])

    return run


def test_grams(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (item_id, n, h, gram) of items(item_id, text); shorter items are one gram of all their words."""
    rows = items.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(tidied(_grams_of(window)), _GRAMS).distinct()


class Grams:
    """A part of the test n-grams: by number of words, sorted hashes with their grams and items."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by([("n", "ascending"), ("h", "ascending"), ("item_id", "ascending"), ("gram", "ascending")])
        n = np.asarray(rows["n"])
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, pa.Array]] = {}
        for length in np.unique(n).tolist():
            mine = rows.slice(int(np.searchsorted(n, length)), int((n == length).sum()))
            self.by_length[length] = np.asarray(mine["h"]), np.asarray(mine["item_id"]), mine["gram"].combine_chunks()


def _found(w: Words, grams: Grams) -> tuple[np.ndarray, dict[int, set]]:
    """Where words begin and cease to be hit, as +1 and -1, and the items of each text."""
    edge = np.zeros(len(w.starts) + 1, np.int64)
    items: dict[int, set] = defaultdict(set)
    for n, (hashes, owners, texts) in grams.by_length.items():
        h = w.runs(n).view(np.int64)
        if not len(h):
            continue
        at = np.flatnonzero(hashes[np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)] == h)
        doc = np.searchsorted(w.first, at, "right") - 1
        inside = at + n <= w.first[doc + 1]
        at, doc = at[inside], doc[inside]
        low, high = (np.searchsorted(hashes, h[at], side).tolist() for side in ("left", "right"))
        for i, d, a, b in zip(at.tolist(), doc.tolist(), low, high):
            text = b" ".join(w.word(j) for j in range(i, i + n))
            match = [int(owners[k]) for k in range(a, b) if texts[k].as_py() == text]
            if match:
                edge[i] += 1
                edge[i + n] -= 1
                items[d].update(match)
    return edge, items


def _hits(w: Words, rows: int, grams: Grams, before: list) -> dict[str, list]:
    """n_words, n_hit, ranges [lo, hi) of hit words and items of each text, those that earlier parts found among them."""
    edge, items = _found(w, grams)
    for k, old in enumerate(before):
        np.add.at(edge, w.first[k] + np.array(old["lo"], np.int64), 1)
        np.add.at(edge, w.first[k] + np.array(old["hi"], np.int64), -1)
        items[k].update(old["items"])
    hit = np.cumsum(edge[:-1]) > 0
    total = np.concatenate([[0], np.cumsum(hit)])
    n_hit = total[w.first[1:]] - total[w.first[:-1]]
    out: dict[str, list] = {"n_words": w.counts().tolist(), "n_hit": n_hit.tolist(), "lo": [[]] * rows, "hi": [[]] * rows, "items": [[]] * rows}
    for k in np.flatnonzero(n_hit).tolist():
        mine = np.flatnonzero(hit[w.first[k] : w.first[k + 1]])
        gaps = np.flatnonzero(np.diff(mine) > 1)
        out["lo"][k] = mine[np.concatenate([[0], gaps + 1])].tolist()
        out["hi"][k] = (mine[np.concatenate([gaps, [len(mine) - 1]])] + 1).tolist()
        out["items"][k] = sorted(items[k])
    return out


def _marked(held, at_text: int, first_part: bool):
    """Adds the hits of one part of the grams to those that earlier parts found."""

    def run(batches):
        for batch in batches:
            before = None if first_part else batch.column(batch.num_columns - 1).to_pylist()
            out: dict[str, list] = {k: [] for k in _HIT_TYPES}
            for row, end, data, offsets in text_chunks(batch.column(at_text)):
                found = _hits(Words(data, offsets, ALNUM_LOWER_ONLY), end - row, held.value, before[row:end] if before else [])
                for k, v in found.items():
                    out[k] += v
            hits = pa.StructArray.from_arrays([pa.array(out[k], t) for k, t in _HIT_TYPES.items()], list(_HIT_TYPES))
            names = batch.schema.names if first_part else batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(names))], hits], [*names, _ADDED])

    return run


def _cut_out(held, at_text: int, first_part: bool):
    """Deletes the words that this part of the grams or an earlier one hits, with what stands between words of one span."""

    def run(batches):
        for batch in batches:
            before = None if first_part else batch.column(batch.num_columns - 1).to_pylist()
            names = batch.schema.names if first_part else batch.schema.names[:-1]
            texts: dict[int, str] = {}
            for row, end, data, offsets in text_chunks(batch.column(at_text)):
                w = Words(data, offsets, ALNUM_LOWER_ONLY)
                found = _hits(w, end - row, held.value, before[row:end] if before else [])
                for k, (lo, hi) in enumerate(zip(found["lo"], found["hi"])):
                    if lo:
                        texts[row + k] = _kept(data, offsets, w, k, lo, hi)
            columns = [batch.column(i) for i in range(len(names))]
            if texts:
                kept = columns[at_text].to_pylist()
                for k, text in texts.items():
                    kept[k] = text
                columns[at_text] = pa.array(kept, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _kept(data: np.ndarray, offsets: np.ndarray, w: Words, k: int, lo: list, hi: list) -> str:
    at, kept, first = int(offsets[k]), [], int(w.first[k])
    for a, b in zip(lo, hi):
        kept.append(data[at : w.starts[first + a]].tobytes())
        at = int(w.ends[first + b - 1])
    kept.append(data[at : offsets[k + 1]].tobytes())
    return b"".join(kept).decode()


def _scanned(docs: DataFrame, items: DataFrame, last, window: int = WINDOW, max_windows: int = MAX_WINDOWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """A scan of docs for each part of the grams; last is what the last of them makes of its rows."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.withColumn("text", F.col("text").cast("string"))
    grams = cut(test_grams(items, window))
    size = grams.agg(F.count("*").alias("n"), F.sum(F.octet_length("gram") + _GRAM_BYTES).alias("bytes")).first()
    parts = max(1, -(-size.n // max_windows), -(-(size.bytes or 0) // max_bytes))
    at_text = docs.columns.index("text")
    marked = T.StructType([*docs.schema.fields, T.StructField(_ADDED, T.StructType.fromDDL(f"h {_HITS}")["h"].dataType)])
    out = docs
    for k in range(parts):
        mine = grams if parts == 1 else grams.where(F.pmod("h", F.lit(parts)) == k)
        held = spark.sparkContext.broadcast(Grams(mine.toArrow()))
        step, schema = (_marked, marked) if k < parts - 1 or last is _marked else (last, docs.schema)
        out = out.mapInArrow(tidied(step(held, at_text, k == 0)), schema)
        if k < parts - 1:
            out = cut(out)
    return out


def mark_hits(docs: DataFrame, items: DataFrame, **settings) -> DataFrame:
    """docs with one more column: n_words, n_hit, ranges [lo, hi) of hit words, and items of each row."""
    return _scanned(docs, items, _marked, **settings)


def contamination(docs: DataFrame, items: DataFrame, **settings) -> DataFrame:
    """The digest of the hits: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hits = F.col(f"`{_ADDED}`")
    names = F.array_join(F.array_sort(F.transform(hits["items"], lambda i: i.cast("string"))), ",")
    return mark_hits(rows, items, **settings).select(
        "doc_id",
        hits["n_words"].alias("n_words"),
        hits["n_hit"].alias("n_hit"),
        F.size(hits["items"]).cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
        (hits["n_hit"] > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, remove: str = "spans", **settings) -> DataFrame:
    """docs without its hits; all its columns stay.

    remove="documents" drops each document with a hit. remove="spans" cuts the hit words out
    and keeps every row; n_chars, where there is one, is counted anew.
    """
    if remove == "documents":
        return mark_hits(docs, items, **settings).where(F.col(f"`{_ADDED}`.n_hit") == 0).drop(_ADDED)
    if remove != "spans":
        raise ValueError("remove is spans or documents")
    out = _scanned(docs, items, _cut_out, **settings)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
