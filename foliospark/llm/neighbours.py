"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Features are words and their first 4, 5 and 6 bytes (A-Z lower-cased), as 64-bit hashes. From labelled rows a
bounded sample of `EXAMPLES` of each label is taken, the smallest by hash of the id. All features of the sample are
indexed. Inverse document frequencies count all documents, and are multiplied by 1 + ln(1 + the feature's chi-square
with the label in the sample): no feature is dropped, and what tells the labels apart weighs more than the topic. (With the
frequencies alone the nearest are those of the same topic, and most toxic texts are missed.) The examples' vectors make an inverted index in blocks of `BLOCK`
examples with the largest weight of each feature in each block. A search looks into the `HEAD` blocks with the
largest bounds first, and then into those that can still change the nearest `NEIGHBOURS`, so it is exact.

The votes of the nearest, for and against, are weighted by cosine: a far example counts little, and a text
that shares one feature with every example isn't near any. They become a score by isotonic regression over the examples, each
judged by the others, with the weights that make the sample like the labelled rows. A text without features
has a vote of 0. Ids, languages and sources are no input of a score.

The index is broadcast: 2 * EXAMPLES vectors over their own features at most, whatever the corpus.

Defined results: null and empty texts have no features and get their score; rows that repeat an id each get
their own; a label that is null is passed over; without both labels among the examples every score is the share
of ones (0 without any). Other columns stay out of sight. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_LOWER_ONLY, BYTE_HASH, Words, bounded_batches, cut, give_back, list_array, mix, power_tables, text_chunks, tidied

EXAMPLES = 2_000
NEIGHBOURS = 15
BLOCK = 64
HEAD = 4
#: Examples by likeness to which the index is put in order, lists kept by block at most, and texts searched for at once.
PIVOTS = 32
LONG_LISTS = 2_048
QUERIES = 64
#: Features of texts that wait for a search together, about.
WAITING = 1 << 18
#: More than the share by which sums of LONG_LISTS products of positive numbers in single precision can be off, twice.
MARGIN = 4e-4
#: Texts whose scores a worker keeps, for the next copy.
KNOWN = 20_000
PREFIXES = (4, 5, 6)


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every word's features, and the text of each."""
    doc = np.repeat(np.arange(len(w.first) - 1), w.counts())
    length = w.ends - w.starts
    up, down = power_tables(len(w.data))
    total = np.zeros(len(w.data) + 1, np.uint64)
    np.cumsum(BYTE_HASH[w.data] * up, out=total[1:])
    found, of = [w.hashes], [doc]
    for k in PREFIXES:
        long = length > k
        at = w.starts[long]
        found.append(mix((total[at + k] - total[at]) * down[at] + np.uint64(k)))
        of.append(doc[long])
    return np.concatenate(found).view(np.int64), np.concatenate(of)


def _held_rows(wanted):
    """For each row: the features among those of the broadcast vocabulary, and how often."""

    def run(batches):
        vocabulary = np.asarray(wanted.value)
        for batch in batches:
            lists: list[list[np.ndarray]] = [[], []]
            sizes = []
            for row, end, data, offsets in text_chunks(batch.column(2)):
                for f, n in _vectors(data, offsets, vocabulary):
                    lists[0].append(f)
                    lists[1].append(n)
                    sizes.append(len(f))
            if sizes:
                flat = [np.concatenate([np.zeros(0, np.int64), *x]) for x in lists]
                columns = [list_array(flat[0].astype(np.int32), np.array(sizes), pa.int32()), list_array(flat[1].astype(np.int32), np.array(sizes), pa.int32())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["id", "y", "f", "n"])

    return run


class _Starts:
    """Where the features with certain first bits begin in a sorted vocabulary of evenly spread hashes."""

    def __init__(self, vocabulary: np.ndarray):
        self.vocabulary = vocabulary
        bits = len(vocabulary).bit_length()
        self.shift, self.below = 64 - bits, 1 << (bits - 1)
        least = np.arange(-self.below, self.below, dtype=np.int64) << self.shift
        self.start = np.minimum(np.searchsorted(vocabulary, least), len(vocabulary) - 1).astype(np.int32)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are in the vocabulary, and their places."""
        at = self.start[(h >> self.shift) + self.below]
        met = self.vocabulary[at]
        equal = met == h
        low = np.flatnonzero(met < h)
        while len(low):
            low = low[at[low] < len(self.vocabulary) - 1]
            at[low] += 1
            met, wanted = self.vocabulary[at[low]], h[low]
            equal[low] = met == wanted
            low = low[met < wanted]
        hit = np.flatnonzero(equal)
        return hit, at[hit].astype(np.int64)


_STARTS: list[_Starts] = []


def _starts(vocabulary: np.ndarray) -> _Starts:
    """Kept for the vocabulary that was used last."""
    if not _STARTS or _STARTS[0].vocabulary is not vocabulary:
        _STARTS[:] = [_Starts(vocabulary)]
    return _STARTS[0]


def _vectors(data: np.ndarray, offsets: np.ndarray, vocabulary: np.ndarray):
    """(places in the vocabulary, counts) of each text."""
    rows = len(offsets) - 1
    if not len(vocabulary) or not len(data):
        for _ in range(rows):
            yield np.zeros(0, np.int64), np.zeros(0, np.int64)
        return
    h, of = features(Words(data, offsets, ALNUM_LOWER_ONLY))
    hit, at = _starts(vocabulary).find(h)
    key, n = np.unique(of[hit] * len(vocabulary) + at, return_counts=True)
    doc, f = np.divmod(key, len(vocabulary))
    edge = np.searchsorted(doc, np.arange(rows + 1))
    for a, b in zip(edge[:-1], edge[1:]):
        yield f[a:b], n[a:b]


def _distinct_features(batches):
    for batch in batches:
        found, sizes = [], []
        for row, end, data, offsets in text_chunks(batch.column(1)):
            rows = end - row
            if len(data):
                h, of = features(Words(data, offsets, ALNUM_LOWER_ONLY))
                order = np.lexsort((h, of))
                h, of = h[order], of[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
                found.append(h[new])
                sizes.append(np.bincount(of[new], minlength=rows))
            else:
                sizes.append(np.zeros(rows, np.int64))
        if sizes:
            flat = np.concatenate([np.zeros(0, np.int64), *found])
            yield pa.RecordBatch.from_arrays([batch.column(0), list_array(flat, np.concatenate(sizes), pa.int64())], ["y", "f"])


def _frequencies(wanted):
    """How many rows of a partition hold each feature, one row for each partition."""

    def run(batches):
        vocabulary = np.asarray(wanted.value)
        n = np.zeros(len(vocabulary), np.int64)
        rows = 0
        for batch in batches:
            for row, end, data, offsets in text_chunks(batch.column(0)):
                rows += end - row
                for f, _ in _vectors(data, offsets, vocabulary):
                    n[f] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.flatnonzero(n), -1).astype(np.int32)), pa.array(np.append(n[n > 0], rows))], ["f", "n"])

    return run


# ---------------------------------------------------------------- index


class Index:
    """Inverted lists of the examples' features, in blocks of `BLOCK` examples.

    Examples stand in the order of their likeness to a few of them, so that a block holds what is alike and its maxima are
    tight. Long lists are kept by block, with the largest weight in each: a bound of what a block can add. Short lists,
    with hardly more postings than blocks, are read whole. A search adds up the short lists, looks into the blocks with the
    largest bounds, and then into all that can still change the nearest. What it finds so, in single precision, decides only
    who is compared; cosines and their order are in double precision, the short lists' sums and the products of the other
    features.
    """

    def __init__(self, edge: np.ndarray, f: np.ndarray, n: np.ndarray, labels: np.ndarray, ids: np.ndarray, idf: np.ndarray):
        """Features and counts of the examples end to end, in order of example and feature."""
        self.edge, self.f, self.n = edge, f.astype(np.int32), n.astype(np.int32)
        self.labels, self.ids, self.idf = labels, ids, idf
        self._weigh()
        size = len(labels)
        #: The first example with the same vector; it is compared for all of them.
        first: dict[bytes, int] = {}
        self.same = np.array([first.setdefault(xxhash.xxh3_128_digest(self.f[a:b].tobytes() + self.n[a:b].tobytes()), k) for k, (a, b) in enumerate(zip(edge[:-1], edge[1:]))], np.int64)
        at = np.arange(min(PIVOTS, size)) * size // max(1, min(PIVOTS, size))
        near, group = np.zeros(size), np.zeros(size, np.int64)
        for k, pivot in enumerate(at.tolist()):
            mine = slice(edge[pivot], edge[pivot + 1])
            cosine = np.bincount(self._row(), self._products(self.f[mine], self.weight[mine], slice(None)), size)
            group, near = np.where(cosine > near, k, group), np.maximum(cosine, near)
        #: Examples by place.
        self.row = np.lexsort((-near, group))
        posted = np.bincount(self.f, minlength=len(idf))
        common = np.argsort(-posted, kind="stable")[:LONG_LISTS]
        common = common[posted[common] > -(-size // BLOCK) // 2]
        self.column = np.full(len(idf), -1, np.int32)
        self.column[common] = np.arange(len(common))
        self.n_long = len(common)
        short = np.flatnonzero(self.column[self.f] < 0).astype(np.int32)
        self.posting = short[np.argsort(self.f[short], kind="stable")]
        self.first = np.searchsorted(self.f[self.posting], np.arange(len(idf) + 1))
        self._lists()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("weight", "_tables", "_room", "place", "short", "places", "long_edge", "long_column", "long_weight")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._weigh()
        self._lists()

    def _row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.labels), dtype=np.int32), np.diff(self.edge))

    def _weigh(self) -> None:
        """The examples' weights, of length 1 each."""
        self._tables = self._room = None
        row = self._row()
        self.weight = (1 + np.log(np.maximum(self.n, 1))) * self.idf[self.f]
        length = np.sqrt(np.bincount(row, self.weight * self.weight, len(self.labels)))
        self.weight /= np.where(length > 0, length, 1)[row]

    def _lists(self) -> None:
        """Places and weights of the short lists, and what of each example's vector is in long ones."""
        self.places = self._places()
        self.place, self.short = self.places[self._row()[self.posting]], self.weight[self.posting]
        column = self.column[self.f]
        long = np.flatnonzero(column >= 0)
        self.long_edge, self.long_column, self.long_weight = np.searchsorted(long, self.edge), column[long], self.weight[long]

    def _places(self) -> np.ndarray:
        place = np.empty(len(self.row), np.int32)
        place[self.row] = np.arange(len(self.row))
        return place

    def _products(self, f: np.ndarray, q: np.ndarray, at: np.ndarray | slice) -> np.ndarray:
        """The weights at some places of the examples' vectors times those that a vector gives their features."""
        self._spread(f, q)
        out = self._room[self.f[at]] * self.weight[at]
        self._room[f] = 0
        return out

    def _spread(self, f: np.ndarray, q: np.ndarray) -> None:
        if self._room is None:
            self._room = np.zeros(len(self.idf))
        self._room[f] = q

    @property
    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """The long lists' weights by block, feature and example, and their maxima by feature and block."""
        if self._tables is None:
            blocks = max(1, -(-len(self.row) // BLOCK))
            weights = np.zeros((blocks, self.n_long, BLOCK), np.float32)
            long = np.flatnonzero(self.column[self.f] >= 0)
            at = self._places()[self._row()[long]]
            weights[at // BLOCK, self.column[self.f[long]], at % BLOCK] = self.weight[long]
            self._tables = weights, np.ascontiguousarray(weights.max(2, initial=0).T)
        return self._tables

    def close(self) -> None:
        """Lets go of what a search sets up for itself."""
        self._tables = self._room = None

    def vector(self, f: np.ndarray, n: np.ndarray) -> np.ndarray:
        v = (1 + np.log(np.maximum(n, 1))) * self.idf[f]
        length = math.sqrt(float(v @ v))
        return v / length if length else v

    def nearest(self, f: np.ndarray, n: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        return self.nearest_many([(f, n)], k, [skip])[0]

    def nearest_many(self, queries: list[tuple], k: int, skips: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each (features, counts) the k examples with the largest cosines above 0, ties to the smaller example, and the cosines."""
        weights, most = self.tables
        blocks, size = len(weights), len(weights) * BLOCK
        vectors = [self.vector(f, n) for f, n in queries]
        wide = np.zeros((len(queries), self.n_long))
        sums = np.zeros((len(queries), size))
        for i, ((f, _), q) in enumerate(zip(queries, vectors)):
            column = self.column[f]
            common = column >= 0
            wide[i, column[common]] = q[common]
            f, q = f[~common], q[~common]
            n = self.first[f + 1] - self.first[f]
            end = np.cumsum(n)
            at = np.arange(int(end[-1]) if len(end) else 0) + np.repeat(self.first[f] - end + n, n)
            sums[i] = np.bincount(self.place[at], np.repeat(q, n) * self.short[at], size)
        long, scores = wide.astype(np.float32), sums.astype(np.float32)
        bound = long @ most + scores.reshape(len(queries), blocks, BLOCK).max(2)
        scored = np.zeros((len(queries), blocks), bool)
        left = scores.reshape(len(queries), blocks, BLOCK)

        def look(wanted: np.ndarray) -> None:
            for b in np.flatnonzero(wanted.any(0)).tolist():
                who = np.flatnonzero(wanted[:, b])
                left[who, b] += long[who] @ weights[b]
            scored[wanted] = True

        if skips is not None:
            hidden = [(i, int(np.flatnonzero(self.row == s)[0])) for i, s in enumerate(skips) if s >= 0]
        else:
            hidden = []

        def least() -> np.ndarray:
            seen = np.where(np.repeat(scored, BLOCK, axis=1), scores, 0)
            for i, at in hidden:
                seen[i, at] = 0
            return np.partition(seen, size - k, axis=1)[:, size - k] if size >= k else np.zeros(len(queries), np.float32)

        head = np.zeros_like(scored)
        np.put_along_axis(head, np.argpartition(-bound, min(HEAD, blocks) - 1, axis=1)[:, : min(HEAD, blocks)], True, axis=1)
        look(head)
        look(~scored & (bound > 0) & (bound >= least()[:, None] * (1 - MARGIN)))
        kth = least()
        for i, at in hidden:
            scores[i, at] = 0
        wanted = np.repeat(scored, BLOCK, axis=1) & (scores > 0) & (scores >= kth[:, None] * (1 - MARGIN))
        return [self._compared(wide[i], sums[i], np.flatnonzero(wanted[i]), k) for i in range(len(queries))]

    def _compared(self, wide: np.ndarray, sums: np.ndarray, places: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest of the examples at some places, from a query's weights in the long lists and its sums over the short ones."""
        rows = self.row[places]
        of, back = np.unique(self.same[rows], return_inverse=True)
        ranges_ = zip(self.long_edge[of].tolist(), self.long_edge[of + 1].tolist())
        product = np.array([wide[self.long_column[a:b]] @ self.long_weight[a:b] for a, b in ranges_], np.float64)
        cosine = (sums[self.places[of]] + product)[back]
        top = np.lexsort((rows, -np.round(cosine, 12)))[:k]
        return rows[top], cosine[top]


def build_index(rows: list[tuple], labels: np.ndarray, ids: np.ndarray, idf: np.ndarray) -> Index:
    """rows: (features, counts) of the examples in order."""
    f, n = (np.concatenate([np.zeros(0, np.int64), *[np.asarray(r[i], np.int64) for r in rows]]) for i in (0, 1))
    return Index(np.cumsum([0, *[len(r[0]) for r in rows]]), f, n, labels, ids, idf)


def _votes(index: Index, queries: list[tuple], k: int, skips: list[int] | None = None):
    """For each query the neighbours' cosines, for label 1 less those for 0, as a share of k; and the neighbours."""
    for at in range(0, len(queries), QUERIES):
        for best, cosine in index.nearest_many(queries[at : at + QUERIES], k, skips and skips[at : at + QUERIES]):
            yield round(float(cosine @ (2 * index.labels[best] - 1)) / k, 9), best


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps of the weighted least-squares rising fit: where each begins, and its value."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b, c in zip(x[order].tolist(), y[order].tolist(), w[order].tolist()):
        if pools and pools[-1][0] == a:
            pools[-1][1] += b * c
            pools[-1][2] += c
        else:
            pools.append([a, b * c, c])
    out: list[list[float]] = []
    for p in pools:
        out.append(p)
        while len(out) > 1 and out[-2][1] * out[-1][2] >= out[-1][1] * out[-2][2]:
            last = out.pop()
            out[-1][1] += last[1]
            out[-1][2] += last[2]
    return np.array([p[0] for p in out]), np.array([p[1] / p[2] for p in out])


@dataclass
class Model:
    vocabulary: np.ndarray
    index: Index
    starts: np.ndarray
    values: np.ndarray
    k: int

    def scores(self, vectors: list[tuple]) -> list[tuple[float, np.ndarray]]:
        """Score and nearest examples of each vector; equal vectors are searched for once."""
        if not hasattr(self, "known") or len(self.known) > KNOWN:
            self.known: dict[bytes, tuple[float, np.ndarray]] = {}
        keys = [xxhash.xxh3_128_digest(f.tobytes() + n.tobytes()) for f, n in vectors]
        new = {key: v for key, v in zip(keys, vectors) if key not in self.known}
        for key, (vote, best) in zip(new, _votes(self.index, list(new.values()), self.k)):
            at = max(0, int(np.searchsorted(self.starts, vote, "right")) - 1)
            self.known[key] = (float(self.values[at]) if len(self.values) else 0.0), best
        return [self.known[key] for key in keys]


def _judged(model: Model, column: pa.Array):
    """Score and nearest examples of each text, as many as a search takes at once."""
    waiting: list[tuple] = []
    held = 0
    for _, _, data, offsets in text_chunks(column):
        for vector in _vectors(data, offsets, model.vocabulary):
            waiting.append(vector)
            held += len(vector[0])
            if len(waiting) == QUERIES or held > WAITING:
                yield from model.scores(waiting)
                waiting, held = [], 0
    yield from model.scores(waiting)


def _score_rows(held):
    def run(batches):
        model: Model = held.value
        for batch in batches:
            scores, evidence, sizes = [], [], []
            for s, best in _judged(model, batch.column(1)):
                scores.append(s)
                evidence.append(model.index.ids[best[:3]])
                sizes.append(len(evidence[-1]))
            if scores:
                flat = np.concatenate([np.zeros(0, np.int64), *evidence]).astype(np.int64)
                columns = [pa.array(scores, pa.float64()), list_array(flat, np.array(sizes), pa.int64())]
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in (0, *range(2, batch.num_columns))], *columns], [batch.schema.names[0], *batch.schema.names[2:], "score", "evidence"])

    return run


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def chi_square(a: np.ndarray, n: np.ndarray, n0: int, n1: int) -> np.ndarray:
    """Of features in n examples, a of them with label 1, against the label; 0 where there is nothing to tell."""
    gap = a * (n0 - n + a) - (n - a) * (n1 - a)
    below = n * (n0 + n1 - n) * float(n0) * n1
    return np.where(below > 0, (n0 + n1) * gap * gap / np.maximum(below, 1), 0.0)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", examples: int = EXAMPLES, k: int = NEIGHBOURS) -> Model:
    """The model of docs(doc_id, text) and labels(doc_id, label), without held-out rows; what it collects is bounded."""
    spark = docs.sparkSession
    bounded_batches(spark)
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("y"))
    known = known.where("id is not null and y is not null").where(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    share = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect() if r.y in (0, 1)}
    ids = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(examples) for y in (0, 1)]
    chosen = cut(ids[0].unionByName(ids[1]))
    whole = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    sample = cut(whole.join(F.broadcast(chosen), "id").groupBy("id").agg(F.max("y").alias("y"), F.min("text").alias("text")))
    each = sample.select("y", "text").mapInArrow(tidied(_distinct_features), "y int, f array<long>")
    counts = each.select("y", F.explode("f").alias("f")).groupBy("f").agg(F.sum("y").alias("a"), F.count("*").alias("n"))
    size = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    counts = counts.toArrow().sort_by("f")
    vocabulary, a, n = (np.asarray(counts[x]) for x in ("f", "a", "n"))
    informed = 1 + np.log1p(chi_square(a.astype(float), n.astype(float), n0, n1))
    held = spark.sparkContext.broadcast(vocabulary)
    seen = whole.select("text").mapInArrow(tidied(_frequencies(held)), "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).toArrow()
    at, n = np.asarray(seen["f"]), np.asarray(seen["n"])
    df, rows = np.zeros(len(vocabulary)), int(n[at < 0].sum())
    df[at[at >= 0]] = n[at >= 0]
    idf = (np.log((1 + rows) / (1 + df)) + 1) * informed
    found = sample.select("id", "y", "text").mapInArrow(tidied(_held_rows(held)), "id long, y int, f array<int>, n array<int>")
    found = found.orderBy(F.xxhash64("id"), "id").toArrow()
    y = np.asarray(found["y"]).astype(float)
    edge = np.append(0, np.cumsum(np.asarray(pc.list_value_length(found["f"])))).astype(np.int64)
    f, n = (np.concatenate([np.zeros(0, np.int32), *[np.asarray(c.flatten()) for c in found[x].chunks]]) for x in ("f", "n"))
    index = Index(edge, f, n, y, np.asarray(found["id"]).astype(np.int64), idf)
    del found, counts, seen, f, n
    each = [(index.f[a:b], index.n[a:b]) for a, b in zip(edge[:-1], edge[1:])]
    votes = np.array([vote for vote, _ in _votes(index, each, k, list(range(len(each))))])
    index.close()
    held.unpersist()
    give_back()
    weight = {v: share.get(v, 0) / max(1, size.get(v, 0)) for v in (0, 1)}
    starts, values = isotonic(votes, y, np.array([weight[int(v)] for v in y])) if len(y) else (np.zeros(0), np.zeros(0))
    return Model(vocabulary, index, starts, values, k)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (0 to 1) and evidence (ids of the nearest examples, three at most), without its text."""
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidied(_score_rows(held)), "doc_id long, score double, evidence array<long>")


def toxicity(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence of every row of docs(doc_id, text)."""
    out = score(docs, fit(docs, labels, **settings))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def _reject(held, at_text: int):
    def run(batches):
        model: Model = held.value
        for batch in batches:
            keep = [s < 0.5 for s, _ in _judged(model, batch.column(at_text))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def reject(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """docs without the rows whose score is 0.5 or more; all columns stay."""
    model = fit(docs, labels, **settings)
    held = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.withColumn("text", F.col("text").cast("string"))
    return docs.mapInArrow(tidied(_reject(held, docs.columns.index("text"))), docs.schema)
