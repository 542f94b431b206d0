"""Near duplicates by MinHash with tensored banding, verified on full shingle sets.

A document's set holds the hashes of its distinct shingles of five words. One collection of `HALF_BANDS` half
bands of `ROWS` minhashes each is computed; table keys are the pairs of half bands, so 3 * 32 minhashes serve
496 tables of 6 rows each, which would take 2976. Two sets of likeness s meet in a table unless fewer
than two half bands agree; for s = 0.75 that has a chance of 7e-7.

The way to whole results without pairs of all members of a group:

1. Documents with one and the same set (by a 128-bit digest) are one class; the classes go on.
2. A half band that no other class shares is dropped before keys are formed, so only classes that can
   meet anything get keys.
3. In each bucket one class leads, the one that most others meet, and each class proposes the leader that it
   shares most buckets with. Proposals are verified and true links joined into components.
4. Buckets whose members are all of one component are done. The classes in the others are held against each
   other, pair by pair of different components that share two half bands, in cells of bounded size, where sizes allow a
   link. Members of the largest component of a half band aren't held against each other. So no link between components is
   missed, whatever the size of a bucket.

Pairs are verified in two exact steps. A bitmap of each set, in which a member flips one of 2048 bits, bounds the
difference of two sets from below and drops most pairs that aren't links; on the rest full sets are compared.

Defined results: null and empty texts have empty sets and link with nothing; rows that
repeat a doc_id are one vertex, linked by the set of any of them; rows with a null doc_id
link with nothing and are kept. Only doc_id and text are read; an empty table gives an
empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_SPACE, ROWS_TO_A_TASK, Words, bounded_batches, cut, list_array, mix, ranges, settled, text_chunks, tidied

SHINGLE = 5
THRESHOLD = 75
HALF_BANDS = 32
ROWS = 3
BITMAP_WORDS = 32
CELL = 1024
#: Ids of so many documents are broadcast at most; more are joined by a shuffle.
MAX_BROADCAST_IDS = 1_000_000

_RNG = np.random.default_rng(7)
_MULTIPLY = _RNG.integers(0, 2**63, HALF_BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, HALF_BANDS * ROWS, dtype=np.uint64)


def shingles(w: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, text by text, and how many each text has; short texts are one shingle."""
    n = w.counts()
    count = np.where(n >= size, n - size + 1, (n > 0).astype(n.dtype))
    out = np.zeros(int(count.sum()), np.uint64)
    ends = np.cumsum(count)
    long = n >= size
    if long.any():
        runs = w.runs(size)
        step = ranges(count[long])
        out[np.repeat((ends - count)[long], count[long]) + step] = runs[np.repeat(w.first[:-1][long], count[long]) + step]
    for k in np.flatnonzero((n > 0) & ~long).tolist():
        mine = w.hashes[w.first[k] : w.first[k + 1]]
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for x in mine:
                h = h * np.uint64(0xD1342543DE82EF95) + x
            h = h + np.uint64(len(mine))
        out[ends[k] - 1] = mix(np.array([h], np.uint64))[0]
    return out, count


def _sets(w: Words, size: int) -> list[np.ndarray]:
    """Each text's set, sorted."""
    h, count = shingles(w, size)
    ends = np.cumsum(count)
    return [np.unique(h[e - c : e]) for e, c in zip(ends, count)]


def half_bands(sets: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A row of half bands for each set, of sets that aren't empty, laid end to end."""
    begin = np.cumsum(count) - count
    bands = np.empty((len(count), HALF_BANDS), np.uint64)
    for band in range(HALF_BANDS):
        h = np.full(len(count), band + 1, np.uint64)
        for k in range(band * ROWS, (band + 1) * ROWS):
            h = h * np.uint64(0x9E3779B97F4A7C15) + mix(np.minimum.reduceat(sets * _MULTIPLY[k] + _ADD[k], begin))
        bands[:, band] = mix(h)
    return bands


def bitmaps(sets: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A row of words for each set: the bits that its members flip, each one."""
    bits = BITMAP_WORDS * 64
    at = (mix(sets) >> np.uint64(17)) % np.uint64(bits)
    flips = np.bincount(np.repeat(np.arange(len(count)), count) * bits + at.astype(np.int64), minlength=len(count) * bits)
    return np.packbits(flips.astype(np.uint8) & 1, bitorder="little").view(np.uint64).reshape(len(count), BITMAP_WORDS)


def _signatures(size: int):
    import xxhash

    def run(batches):
        for batch in batches:
            n_sets, digests, bands, maps, n_full = [], [], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], []
            for row, end, data, offsets in text_chunks(batch.column(1)):
                sets = _sets(Words(data, offsets, NOT_SPACE), size)
                count = np.array([len(s) for s in sets])
                n_sets.append(count)
                digests += [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                full = count > 0
                if full.any():
                    flat = np.concatenate(sets)
                    bands.append(half_bands(flat, count[full]).ravel())
                    maps.append(bitmaps(flat, count[full]).ravel())
                n_full.append(full)
            if n_sets:
                wide = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                full = np.concatenate(n_full)
                columns = [pa.array(c) for c in (np.concatenate(n_sets).astype(np.int64), wide[:, 0].copy(), wide[:, 1].copy())]
                columns += [list_array(np.concatenate(x).view(np.int64), full * n, pa.int64()) for x, n in ((bands, HALF_BANDS), (maps, BITMAP_WORDS))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_shingles", "d1", "d2", "bands", "bitmap"])

    return run


def _full_sets(size: int):
    def run(batches):
        for batch in batches:
            flat, count = [], []
            for _, _, data, offsets in text_chunks(batch.column(1)):
                for s in _sets(Words(data, offsets, NOT_SPACE), size):
                    flat.append(s)
                    count.append(len(s))
            if count:
                values = np.concatenate(flat).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), list_array(values, np.array(count), pa.int64())], ["id", "members"])

    return run


# ---------------------------------------------------------------- components


def _checksum(edges: DataFrame) -> int:
    return edges.agg(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()[0]


def components(links: DataFrame) -> DataFrame:
    """id, component (its smallest id) of the ids in links(u, v), by alternating large and small stars.

    Each step is a join and an aggregation that combines before its shuffle; nothing but a
    count and a checksum reaches the driver. Ids that are the smallest of their component,
    or have no links, don't come back.
    """
    edges, n = settled(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while n:
        tasks = -(-2 * n // ROWS_TO_A_TASK)
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(tasks)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(low, "u")
        small = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(near.select("u", F.col("m").alias("v"))).coalesce(tasks).distinct()
        edges, n = settled(small)
        now = n, _checksum(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))


# ---------------------------------------------------------------- candidates


def _shared_bands(classes: DataFrame) -> DataFrame:
    """id and its half bands, sorted, that other classes have too, where there are two of them at least."""
    each = classes.select("id", F.explode("bands").alias("band"))
    shared = each.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    mine = each.join(shared, "band").groupBy("id").agg(F.array_sort(F.collect_set("band")).alias("bands"))
    return mine.where(F.size("bands") > 1)


def _buckets(bands: DataFrame) -> DataFrame:
    """key, id and the bucket's size: pairs of half bands, in buckets of several classes."""
    first = bands.select("id", "bands", F.explode(F.sequence(F.lit(0), F.size("bands") - 2)).alias("i"))
    keys = first.select("id", F.explode(F.expr("transform(slice(bands, i + 2, size(bands)), x -> xxhash64(bands[i], x))")).alias("key"))
    return keys.join(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")


def _may_be_alike(n_u: Column, n_v: Column, map_u: Column, map_v: Column, percent: int) -> Column:
    """False only for sets that can't be alike enough: by their sizes, and by bits that only one of them flips."""
    sizes = F.least(n_u, n_v) * 100 >= F.greatest(n_u, n_v) * percent
    apart = F.aggregate(F.zip_with(map_u, map_v, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, x: s + x)
    return sizes & (apart * (100 + percent) <= (n_u + n_v) * (100 - percent))


class _Verifier:
    """Holds pairs of ids against each other: by bitmaps, then by full sets."""

    def __init__(self, docs: DataFrame, signed: DataFrame, percent: int, shingle: int):
        self.docs = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
        self.signed = signed.where("n_shingles > 0").select(F.col("doc_id").alias("id"), "n_shingles", "bitmap")
        self.percent, self.shingle = percent, shingle

    def likely(self, pairs: DataFrame) -> DataFrame:
        for x in ("u", "v"):
            pairs = pairs.join(self.signed.toDF(x, f"n_{x}", f"map_{x}"), x)
        alike = _may_be_alike(*[F.col(c) for c in ("n_u", "n_v", "map_u", "map_v")], self.percent)
        return pairs.where(alike).select("u", "v").distinct()

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (u, v) whose sets are alike enough."""
        pairs, n = settled(pairs)
        if not n:
            return pairs
        ids, n = settled(pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id"))).distinct())
        ids = F.broadcast(ids) if n <= MAX_BROADCAST_IDS else ids
        sets = cut(self.docs.join(ids, "id", "left_semi").mapInArrow(tidied(_full_sets(self.shingle)), "id long, members array<long>"))
        a = sets.select(F.col("id").alias("u"), F.col("members").alias("set_u"))
        b = sets.select(F.col("id").alias("v"), F.col("members").alias("set_v"))
        common = F.size(F.array_intersect("set_u", "set_v"))
        union = F.size("set_u") + F.size("set_v") - common
        return pairs.join(b, "v").join(a, "u").where(common * 100 >= union * self.percent).select("u", "v")


def _proposals(buckets: DataFrame) -> DataFrame:
    """(u, v): each id with the leader that it shares most buckets with."""
    weight = buckets.groupBy("id").agg(F.sum("n").alias("weight"))
    rows = buckets.select("key", "id").join(weight, "id")
    leads = rows.groupBy("key").agg(F.max(F.struct("weight", "id")).alias("lead"))
    near = buckets.select("key", "id").join(leads, "key").select("id", F.col("lead.id").alias("other")).where("id <> other")
    near = near.groupBy("id", "other").agg(F.count("*").alias("n"))
    best = near.groupBy("id").agg(F.max(F.struct("n", "other")).alias("best"))
    return best.select(F.greatest("id", "best.other").alias("u"), F.least("id", "best.other").alias("v")).distinct()


def _open(buckets: DataFrame, label: DataFrame) -> DataFrame:
    """id and component of the members of buckets that hold more than one component."""
    rows = buckets.select("key", "id").join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_ = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    return rows.join(open_, "key", "left_semi").select("id", "component").distinct()


def _size_class(n: Column, percent: int) -> Column:
    """Sets of classes that are more than one apart differ too much in size to be alike."""
    return F.floor(F.ln(n) / math.log(1.001 * 100 / percent)).cast("int")


def _cells(members: DataFrame, bands: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share two half bands and may be alike, formed in cells of about CELL by CELL rows, each pair once.

    Half bands of one component are left out. In each of the others the members fall into groups, by the class of their size
    and by whether they are of the component that most of its members are of. Groups of classes that are
    one apart at most meet, but not two of that component; so a large group of copies is copied as often as others need it.
    """
    each = members.join(bands, "id").join(signed, "id").withColumn("k", _size_class(F.col("n_shingles"), percent))
    narrow = each.select("component", "k", F.explode("bands").alias("band"))
    counts = narrow.groupBy("band", "component", "k").agg(F.count("*").alias("n"))
    main = counts.groupBy("band", "component").agg(F.sum("n").alias("n")).groupBy("band").agg(F.max(F.struct("n", "component")).getField("component").alias("main"), F.count("*").alias("several"))
    main = cut(main.where("several > 1").drop("several"))
    group = (2 * F.col("k") + (F.col("component") != F.col("main")).cast("int")).alias("g")
    sizes = counts.join(main, "band").groupBy("band", "main", group).agg(F.ceil(F.sum("n") / CELL).cast("int").alias("blocks"))
    sizes = cut(sizes.groupBy("band", "main").agg(F.map_from_entries(F.collect_list(F.struct("g", "blocks"))).alias("blocks")))
    rows = each.select("*", F.explode("bands").alias("band")).join(sizes, "band").withColumn("g", group)
    own = F.try_element_at("blocks", F.col("g"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), own).cast("int"))
    g, i = F.col("g"), F.col("block")

    def n_blocks(other: Column) -> Column:
        return F.coalesce(F.try_element_at(F.col("blocks"), other), F.lit(0))

    near = F.filter(F.sequence(2 * F.col("k") - 2, 2 * F.col("k") + 3), lambda o: (n_blocks(o) > 0) & ((g % 2 == 1) | (F.pmod(o, F.lit(2)) == 1)))

    def cell(a: Column, p: Column, b: Column, q: Column) -> Column:
        return F.struct(a.alias("a"), p.alias("p"), b.alias("b"), q.alias("q"))

    first = F.transform(F.filter(near, lambda o: o >= g), lambda o: F.transform(F.sequence(F.when(o == g, i).otherwise(0), n_blocks(o) - 1), lambda j: cell(g, i, o, j)))
    second = F.transform(F.filter(near, lambda o: o <= g), lambda o: F.transform(F.sequence(F.lit(0), F.when(o == g, i).otherwise(n_blocks(o) - 1)), lambda j: cell(o, j, g, i)))
    fields = ("id", "component", "bands", "n_shingles", "bitmap")
    left, right = (rows.select("band", F.explode(F.flatten(x)).alias("cell"), *[F.col(c).alias(f"{c}_{y}") for c in fields]).select("band", "cell.*", *[f"{c}_{y}" for c in fields]) for x, y in ((first, "u"), (second, "v")))
    apart = F.expr("component_u <> component_v and (a <> b or p <> q or id_u < id_v)")
    alike = _may_be_alike(*[F.col(f"{c}_{y}") for c in ("n_shingles", "bitmap") for y in ("u", "v")], percent)
    common = F.array_intersect("bands_u", "bands_v")
    once = (F.col("band") == F.get(common, F.lit(0))) & (F.size(common) > 1)
    pairs = left.join(right, ["band", "a", "p", "b", "q"]).where(apart & alike & once)
    return pairs.select(F.greatest("id_u", "id_v").alias("u"), F.least("id_u", "id_v").alias("v")).distinct()


def signatures(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, digest of the set (d1, d2), half bands and bitmap of every row of docs(doc_id, text)."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidied(_signatures(shingle)), "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, bitmap array<long>")


def near_duplicates(docs: DataFrame, percent: int = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs(doc_id, text)."""
    signed = cut(signatures(docs, shingle))
    full = signed.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("d1", "d2").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"))
    bands = cut(_shared_bands(classes))
    buckets, _ = settled(_buckets(bands))
    verifier = _Verifier(docs, signed, percent, shingle)
    links = verifier.links(verifier.likely(_proposals(buckets)))
    label = components(links)
    members, n = settled(_open(buckets, label))
    if n:
        more = verifier.links(_cells(members, bands, verifier.signed, percent))
        label = components(label.select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(more))
    named = full.groupBy("d1", "d2").agg(F.min("doc_id").alias("id")).join(label, "id", "left")
    named = named.select("d1", "d2", F.coalesce("component", "id").alias("component"))
    out = signed.select("doc_id", "n_shingles", "d1", "d2").join(named, ["d1", "d2"], "left")
    own = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    component = F.when(own, F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """docs with one row of each group of near duplicates: that of the smallest doc_id. All columns stay.

    Rows without words stay. Of rows with words that repeat a doc_id, the one with the
    smallest text stays. The texts are not shuffled while the ids to be dropped are few
    enough to be broadcast (MAX_BROADCAST_IDS).
    """
    found = cut(near_duplicates(docs, **settings))
    gone = found.where("not kept").select("doc_id").distinct()
    twice = found.where("kept and n_shingles > 0 and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    key, hidden = "id as a number", "place among rows of its id"
    rows = docs.withColumn(key, F.col("doc_id").cast("long"))

    def among(ids: DataFrame, how: str) -> DataFrame:
        ids = ids.select(F.col("doc_id").alias(key))
        return rows_left.join(F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids, key, how)

    rows_left = rows
    rows_left = among(gone, "left_anti")
    if not twice.isEmpty():
        again = among(twice, "left_semi").where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
        order = Window.partitionBy(key).orderBy("text")
        again = again.withColumn(hidden, F.row_number().over(order)).where(F.col(f"`{hidden}`") == 1).drop(hidden)
        empty = among(twice, "left_semi").where(~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
        rows_left = among(twice, "left_anti").unionByName(empty).unionByName(again)
    return rows_left.select(*docs.columns)
