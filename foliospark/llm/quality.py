"""Quality by ordinal cumulative-link regression on hashed text.

A text becomes a sparse vector in 2 ** BITS buckets: its words, their last three bytes and their shapes (which kinds of
characters, in what order, how long), how much of it is words said again, and its length. One vector of weights w is
shared by all grades and the thresholds are in order: P(grade <= k) = sigmoid(t_k - w x). That gives an
expected grade and the probability of the upper grades, for selection.

The model is fitted on a bounded sample: of each grade the `EXAMPLES` labelled rows that are smallest by hash of
the id, or as many of them, in that order, as have `MOST_PAIRS` pairs over all grades (each grade its part of that, one row at
least). Every text counts with all its buckets, in the fit and in scoring; what the driver gets is bounded by the
number of texts alone. The sample's grades count by their shares among all labelled rows.

Defined results: null and empty texts have no words and get their score; rows that repeat an id each get their
own; null grades are passed over; with fewer than two grades known all rows get the one grade (0 if none is
known) and a tail probability of 0. Ids, languages and sources are no input of a score. An empty table gives
an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_HASH, NOT_SPACE, Words, bounded_batches, cut, list_array, mix, power_tables, text_chunks, tidied
from .neighbours import held_out

BITS = 16
EXAMPLES = 1_500
MOST_PAIRS = 4_000_000
STEPS = 300
RATE = 0.05
RIDGE = 1e-4
_AS_IS = np.arange(256, dtype=np.uint8)


def _kinds() -> np.ndarray:
    kind = np.zeros(256, np.uint64)
    kind[ord("a") : ord("z") + 1] = 1
    kind[ord("A") : ord("Z") + 1] = 2
    kind[ord("0") : ord("9") + 1] = 3
    for b in range(33, 127):
        if not chr(b).isalnum():
            kind[b] = 4 + b
    kind[128:] = 1
    return kind


_KIND = _kinds()


def vectors(data: np.ndarray, offsets: np.ndarray):
    """(buckets, values) of each text, values of length 1 for words and for style apart."""
    w = Words(data, offsets, NOT_SPACE, _AS_IS)
    count = w.counts()
    length = w.ends - w.starts
    up, down = power_tables(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_HASH[w.data] * up, out=total[1:])
    tail = np.maximum(w.starts, w.ends - 3)
    last = mix((total[w.ends] - total[tail]) * down[tail] + np.uint64(11))
    kind = _KIND[w.data]
    change = np.concatenate([[True], kind[1:] != kind[:-1]]) if len(kind) else np.zeros(0, bool)
    change[w.starts] = True
    runs = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(np.where(change, kind + np.uint64(1), np.uint64(0)) * mix(np.uint64(5) * np.minimum(np.arange(len(data)) - _start_of(w, len(data)), 12).astype(np.uint64)), out=runs[1:])
    shape = mix(runs[w.ends] - runs[w.starts] + np.uint64(22) * np.minimum(length, 15).astype(np.uint64))
    again = np.zeros(len(w.hashes), np.uint64)
    again[1:] = w.hashes[1:] == w.hashes[:-1]
    again = mix(again + np.uint64(33))
    mask = np.uint64((1 << BITS) - 1)
    for k in range(len(count)):
        a, b = w.first[k], w.first[k + 1]
        buckets, values = [], []
        for part, weight in ((w.hashes[a:b], 1.0), (np.concatenate([last[a:b], shape[a:b], again[a:b]]), 2.0)):
            f, n = np.unique((part & mask).astype(np.int64), return_counts=True)
            v = np.sqrt(n)
            buckets.append(f)
            values.append(weight * v / max(1e-9, float(np.sqrt(v @ v))))
        size = int(mix(np.array([44 + min(20, int(b - a).bit_length())], np.uint64))[0] & mask)
        yield np.append(np.concatenate(buckets), size), np.append(np.concatenate(values), 1.0)


def _start_of(w: Words, n: int) -> np.ndarray:
    at = np.zeros(n, np.int64)
    at[w.starts] = w.starts
    return np.maximum.accumulate(at) if n else at


def _vector_rows(batches):
    for batch in batches:
        found = [v for _, _, data, offsets in text_chunks(batch.column(1)) for v in vectors(data, offsets)]
        if found:
            n = np.array([len(f) for f, _ in found])
            columns = [list_array(np.concatenate([x[i] for x in found]).astype(k), n, t) for i, k, t in ((0, np.int32, pa.int32()), (1, np.float32, pa.float32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["grade", "f", "v"])


@dataclass
class Model:
    grades: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k but the last, a row for each score."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -50, 50)))


def likelihood(score: np.ndarray, y: np.ndarray, share: np.ndarray, thresholds: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The negative log likelihood of grades y, weighted by share, and its slopes by score and by threshold."""
    n, k = len(y), len(thresholds) + 1
    edge = np.concatenate([np.full((n, 1), -50.0), np.clip(thresholds[None, :] - score[:, None], -50, 50), np.full((n, 1), 50.0)], axis=1)
    p = 1 / (1 + np.exp(-edge))
    slope = p * (1 - p)
    mine = np.arange(n)
    chance = np.maximum(p[mine, y + 1] - p[mine, y], 1e-12)
    up, low = slope[mine, y + 1] / chance * share, slope[mine, y] / chance * share
    return float(-(share * np.log(chance)).sum()), up - low, np.array([low[y == j + 1].sum() - up[y == j].sum() for j in range(k - 1)])


def _fit(rows: np.ndarray, f: np.ndarray, v: np.ndarray, y: np.ndarray, share: np.ndarray, grades: np.ndarray) -> Model:
    """Maximum likelihood by Adam; thresholds are a first one and positive gaps."""
    n, k = len(y), len(grades)
    w, gaps = np.zeros(1 << BITS), np.concatenate([[0.0], np.zeros(max(0, k - 2))])
    first, second = np.zeros(len(w) + len(gaps)), np.zeros(len(w) + len(gaps))
    begin = np.searchsorted(rows, np.arange(n))

    def thresholds() -> np.ndarray:
        return np.cumsum(np.concatenate([gaps[:1], np.log1p(np.exp(gaps[1:]))]))

    for step in range(1, STEPS + 1):
        t = thresholds()
        score = np.add.reduceat(v * w[f], begin)
        _, g_score, g_t = likelihood(score, y, share, t)
        g_gap = np.cumsum(g_t[::-1])[::-1]
        g_gap[1:] *= 1 / (1 + np.exp(-gaps[1:]))
        g = np.concatenate([np.bincount(f, v * np.repeat(g_score, np.diff(np.append(begin, len(f)))), len(w)) + RIDGE * w, g_gap])
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        move = RATE * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
        w, gaps = w - move[: len(w)], gaps - move[len(w) :]
    return Model(grades, w, thresholds())


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", examples: int = EXAMPLES) -> Model:
    """The model of docs(doc_id, text) and labels(doc_id, label), without held-out rows."""
    bounded_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("grade"))
    known = known.where("id is not null and grade is not null").where(~held_out(F.col("id"))).groupBy("id").agg(F.max("grade").alias("grade"))
    share = {r.grade: r.n for r in known.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    grades = np.array(sorted(share), np.int64)
    if len(grades) < 2:
        return Model(grades if len(grades) else np.zeros(1, np.int64), np.zeros(1 << BITS), np.zeros(0))
    each = [known.where(F.col("grade") == int(g)).orderBy(F.xxhash64("id"), "id").limit(examples) for g in grades]
    chosen = each[0]
    for e in each[1:]:
        chosen = chosen.unionByName(e)
    chosen = cut(chosen)
    whole = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    sample = whole.join(F.broadcast(chosen), "id").groupBy("id").agg(F.max("grade").alias("grade"), F.min("text").alias("text"))
    found = sample.select("grade", "text", "id").mapInArrow(tidied(_with_id(_vector_rows)), "grade int, f array<int>, v array<float>, id long")
    found = cut(found)
    sizes = found.select("grade", "id", F.size("f").alias("n")).orderBy(F.xxhash64("id"), "id").collect()
    taken, room = [], {int(g): MOST_PAIRS // len(grades) for g in grades}
    full = dict(room)
    for r in sizes:
        if room[r.grade] >= r.n or room[r.grade] == full[r.grade]:
            taken.append(r.id)
            room[r.grade] -= r.n
        else:
            room[r.grade] = -1
    if len(taken) < len(sizes):
        found = found.where(F.col("id").isin(taken))
    found = found.orderBy(F.xxhash64("id"), "id").select("grade", "f", "v").toArrow()
    grade = np.asarray(found["grade"])
    n = np.asarray(pc.list_value_length(found["f"]))
    f, v = (np.concatenate([np.asarray(c.flatten()) for c in found[x].chunks]) for x in ("f", "v"))
    y = np.searchsorted(grades, grade)
    size = np.bincount(y, minlength=len(grades))
    weight = np.array([share[int(g)] for g in grades]) / np.maximum(1, size)
    return _fit(np.repeat(np.arange(len(y)), n), f.astype(np.int64), v.astype(float), y, (weight / weight.mean())[y], grades)


def _with_id(rows):
    def run(batches):
        for batch in batches:
            for out in rows(iter([batch])):
                yield pa.RecordBatch.from_arrays([*out.columns, batch.column(2)], ["grade", "f", "v", "id"])

    return run


def _score_rows(held):
    def run(batches):
        model: Model = held.value
        for batch in batches:
            score = [float(v @ model.weights[f]) for _, _, data, offsets in text_chunks(batch.column(1)) for f, v in vectors(data, offsets)]
            if score:
                above = model.above(np.array(score))
                expected = model.grades[0] + above @ np.diff(model.grades)
                tail = above[:, -1] if above.shape[1] else np.zeros(len(score))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(expected.astype(float)), pa.array(tail)], ["doc_id", "expected_grade", "tail_probability"])

    return run


def grade(docs: DataFrame, labels: DataFrame, keep_from: float = 0.5, **settings) -> DataFrame:
    """doc_id, held_out, expected_grade, tail_probability (of the top grade) and kept of every row of docs(doc_id, text)."""
    model = fit(docs, labels, **settings)
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(tidied(_score_rows(held)), "doc_id long, expected_grade double, tail_probability double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "expected_grade", "tail_probability", (F.col("tail_probability") >= keep_from).alias("kept"))
