"""Near-duplicates by b-bit MinHash.

Each document's set of distinct word shingles gets 128 minima; their low four bits, packed, are its signature, and bands of
four minima give candidates. Documents with equal sets are one class from the start, with a number of its own. In each
bucket signatures estimate the similarity of candidates from bit counts, corrected for chance collisions: first of every
member and the bucket's least one, then of all pairs that those links have not joined yet. Only pairs that may reach the
threshold join classes to a cluster, so a chain of loosely similar texts joins nothing. Pairs of a cluster are
compared on the full sets. Both comparisons go block by block: a pair of blocks holds a bounded number of classes and sends on
the links of a spanning forest, so no link between bucket mates is lost, no group is gathered and no group's pairs
are emitted. Components follow the links that the full sets confirm. Joins are shuffled: Spark broadcasts by a compressed size, which
classes with their bands and signatures exceed many times once the driver holds them.

There are as many bands as leave a pair at the threshold without a common bucket with a probability below 1e-7; the
estimate rejects such a pair only beyond five standard deviations. Sets are told apart by 128-bit hashes of their 64-bit
shingle hashes.

Null and empty texts, and texts of white space, have empty sets and are linked with nothing: each is its own
component. Documents with fewer words than a shingle have one shingle, the whole sequence. Repeated rows
have equal sets and so share a component. A row with a null id belongs to its component, but names
it only if no row of it has an id (then null). Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_path, map_rows, packed, shuffled, tasks_for, texts, trimmed, unpacked, written
from .graph import components
from .hashing import mix, shingle_sets

MINIMA, ROWS, BITS = 128, 4, 4
BANDS = MINIMA // ROWS
#: Probability with which a pair at the threshold may miss all buckets.
MISSED = 1e-7
WORDS_OF_SIGNATURE = MINIMA * BITS // 64
_RNG = np.random.Generator(np.random.PCG64(77))
_A = _RNG.integers(1, 1 << 63, MINIMA, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 1 << 63, MINIMA, dtype=np.uint64)

SKETCH = "doc_id long, n_shingles long, set binary, bands array<long>, signature binary"


def identity(shingles: np.ndarray) -> bytes:
    """128-bit identity of a set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of 128 hash functions; sets of any size, in blocks."""
    least = np.full(MINIMA, np.uint64(0xFFFFFFFFFFFFFFFF))
    for a in range(0, len(shingles), 2048):
        part = shingles[a : a + 2048]
        for k in range(0, MINIMA, 32):  # blocks that stay in the cache
            np.minimum(least[k : k + 32], (part[None, :] * _A[k : k + 32, None] + _B[k : k + 32, None]).min(1), out=least[k : k + 32])
    return mix(least)


def bands_for(threshold: float) -> int:
    """The fewest bands that a pair at the threshold hardly ever misses."""
    return min(BANDS, math.ceil(math.log(MISSED) / math.log(1 - threshold**ROWS)))


def band_keys(least: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key for each band; bands have keys of their own."""
    h = np.arange(bands, dtype=np.uint64)
    for k in range(ROWS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + least[: bands * ROWS][k::ROWS])
    return h.view(np.int64)


def pack(least: np.ndarray) -> np.ndarray:
    """The low four bits of each minimum, sixteen to a 64-bit word."""
    low = (least & np.uint64(15)).reshape(-1, 16)
    return (low << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(1, dtype=np.uint64)


def sketches(docs: DataFrame, width: int, bands: int) -> DataFrame:
    def factory():
        def work(ids, ts):
            sets = shingle_sets(ts, width)
            mins = [minima(s) if len(s) else None for s in sets]
            return {
                "doc_id": pa.array(ids, pa.int64()),
                "n_shingles": [len(s) for s in sets],
                "set": pa.array([identity(s) if len(s) else None for s in sets], pa.binary()),
                "bands": pa.array([None if m is None else band_keys(m, bands) for m in mins], pa.list_(pa.int64())),
                "signature": pa.array([None if m is None else pack(m).tobytes() for m in mins], pa.binary()),
            }

        return work

    return map_rows(texts(docs), factory, SKETCH)


def same_minima(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many of the packed minima agree, for all pairs of two blocks of signatures, by bit counts."""
    out = np.zeros((len(x), len(y)), np.int16)
    for k in range(WORDS_OF_SIGNATURE):
        d = x[:, None, k] ^ y[None, :, k]
        d |= d >> np.uint64(2)  # any differing bit of four shows in the lowest
        d |= d >> np.uint64(1)
        out += 16 - np.bitwise_count(d & np.uint64(0x1111111111111111)).astype(np.int16)
    return out


def least_agreeing(threshold: float) -> int:
    """Agreements below which a pair does not reach the threshold: five standard deviations under the expected number."""
    p = threshold + (1 - threshold) / (1 << BITS)  # corrected for chance collisions of the low bits
    return max(0, math.floor(MINIMA * p - 5 * math.sqrt(MINIMA * p * (1 - p))))


def estimate(agreeing: np.ndarray) -> np.ndarray:
    """Similarity from the number of agreeing minima, corrected for chance collisions."""
    chance = 1 / (1 << BITS)
    return np.maximum(0.0, (agreeing / MINIMA - chance) / (1 - chance))


#: Bits of the filter that says which ids may be wanted: of fixed size, so it is sent to all executors.
FILTER_BITS = 1 << 23


def _slots(ids: Column) -> Column:
    return F.pmod(F.xxhash64(ids), F.lit(FILTER_BITS))


def possible(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows whose id may be among the wanted: a bitmap of fixed size, read before any text moves. A full bitmap keeps all rows."""
    words = wanted.select(_slots(F.col("doc_id")).alias("s")).groupBy(F.floor(F.col("s") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("bits")).toArrow()
    table = np.zeros(FILTER_BITS // 64, np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value.view(np.uint64)
        for b in batches:
            s = b.column(2).to_numpy().astype(np.uint64)
            yield b.filter(pa.array((bits[s // np.uint64(64)] >> (s % np.uint64(64))) & np.uint64(1) == 1)).select([0, 1])

    return docs.withColumn("s", _slots(F.col("doc_id"))).mapInArrow(run, "doc_id long, text string")


def full_sets(docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """``(class, shingles)`` of the wanted ``(class, doc_id, set)``."""
    rows = texts(docs)
    named = classes.where("doc_id is not null")
    found = possible(rows.where("doc_id is not null"), named).join(shuffled(named), "doc_id").select("class", "set", "text")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {}
            for cls, want, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), shingle_sets(b.column(2).to_pylist(), width), strict=True):
                if len(s) and identity(s) == want:  # of repeated ids, the row that has the set
                    out[cls] = s.tobytes()
            if out:
                yield pa.RecordBatch.from_pydict({"class": pa.array(list(out), pa.int64()), "shingles": pa.array(list(out.values()), pa.binary())})

    def any_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [s for s in shingle_sets(b.column(0).to_pylist(), width) if len(s)]
            if sets:
                yield pa.RecordBatch.from_pydict({"set": pa.array([identity(s) for s in sets], pa.binary()), "shingles": pa.array([s.tobytes() for s in sets], pa.binary())})

    out = found.mapInArrow(trimmed(own), "class long, shingles binary")
    unnamed = classes.where("doc_id is null")
    if unnamed.limit(1).count():  # of rows without an id, any may hold a wanted set
        out = out.unionByName(rows.where("doc_id is null").select("text").mapInArrow(any_, "set binary, shingles binary").join(shuffled(unnamed), "set").select("class", "shingles"))
    return out


#: Classes, and bytes, that one side of a block pair holds (on average: classes are dealt by a hash).
BLOCK_SETS, BLOCK_BYTES = 256, 8 << 20


def block_links(rows: DataFrame, compare: Callable[[list, list], np.ndarray]) -> DataFrame:
    """``rows``: (cluster, class, payload) -> links ``(a, b)`` that join what ``compare`` finds alike in each cluster.

    A cluster is cut into blocks; each pair of blocks is one group of rows, compared in memory, and gives the links of a
    spanning forest. Rows that repeat a class are harmless.
    """
    size = F.octet_length("payload").cast("long")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum(size) / BLOCK_BYTES)).cast("int")
    counts = rows.groupBy("cluster").agg(blocks.alias("n"), F.count("*").alias("members")).where("members > 1").drop("members")
    own = rows.join(shuffled(counts), "cluster").withColumn("p", F.pmod(F.xxhash64("class"), F.col("n")).cast("int"))
    keep = ["class", "payload"]
    left = own.select("cluster", F.col("p").alias("i"), F.explode(F.sequence(F.col("p"), F.col("n") - 1)).alias("j"), F.lit(0).alias("side"), *keep)
    right = own.where("p > 0").select("cluster", F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("i"), F.col("p").alias("j"), F.lit(1).alias("side"), *keep)
    dealt = left.unionByName(right).repartition(tasks_for(rows.sparkSession), "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "side", "class")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, sides = None, ([], [])
        for batch in batches:
            for cluster, i, j, side, cls, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (cluster, i, j) != name:
                    yield from _forest(name, sides, compare)
                    name, sides = (cluster, i, j), ([], [])
                sides[side].append((cls, payload))
        yield from _forest(name, sides, compare)

    return dealt.mapInArrow(trimmed(run), "a long, b long")


def _forest(name, sides: tuple[list, list], compare) -> Iterator[pa.RecordBatch]:
    """Links from the least class of each piece to the others of it."""
    if name is None:
        return
    left = sides[0]
    right = left if name[1] == name[2] else sides[1]
    if not left or not right:
        return
    parent = {c: c for c, _ in (*left, *right)}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(*(k.tolist() for k in np.nonzero(compare([p for _, p in left], [p for _, p in right]))), strict=True):
        a, b = find(left[x][0]), find(right[y][0])
        if a != b:
            parent[max(a, b)] = min(a, b)
    out = [(find(c), c) for c in parent if find(c) != c]
    if out:
        a, b = zip(*out, strict=True)
        yield pa.RecordBatch.from_pydict({"a": list(a), "b": list(b)})


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each left set shares with each right set."""

    def entries(sets):
        values = np.concatenate(sets)
        order = np.argsort(values, kind="stable")
        return values[order], np.repeat(np.arange(len(sets)), [len(s) for s in sets])[order]

    lv, lo = entries(left)
    rv, ro = entries(right)
    out = np.zeros(len(left) * len(right), np.int64)
    both = np.intersect1d(lv, rv)
    la, lb = np.searchsorted(lv, both, "left"), np.searchsorted(lv, both, "right")
    ra, rb = np.searchsorted(rv, both, "left"), np.searchsorted(rv, both, "right")
    nl, nr = lb - la, rb - ra
    rare = nl * nr <= 256

    def flat(start, count):
        """Positions start, start + 1, ... of each stretch."""
        return np.arange(count.sum()) + np.repeat(start - np.concatenate([[0], np.cumsum(count)[:-1]]), count)

    at = np.flatnonzero(rare)
    for k in range(0, len(at), 20_000):  # few pairs each: added up one by one
        c = at[k : k + 20_000]
        r = flat(ra[c], nr[c])
        of = np.repeat(nl[c], nr[c])
        pairs = lo[flat(np.repeat(la[c], nr[c]), of)] * len(right) + np.repeat(ro[r], of)
        out += np.bincount(pairs, minlength=len(out))
    dense = out.reshape(len(left), len(right)).astype(np.float32)
    at = np.flatnonzero(~rare)
    for k in range(0, len(at), 2048):  # many pairs each: as a product of matrices
        c = at[k : k + 2048]
        a, b = np.zeros((len(left), len(c)), np.float32), np.zeros((len(right), len(c)), np.float32)
        a[lo[flat(la[c], nl[c])], np.repeat(np.arange(len(c)), nl[c])] = 1
        b[ro[flat(ra[c], nr[c])], np.repeat(np.arange(len(c)), nr[c])] = 1
        dense += a @ b.T
    return dense


def likely(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """``(a, b, signature of a, of b)`` -> the pairs that agree in enough minima."""
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(-1, WORDS_OF_SIGNATURE) for k in (2, 3))
            d = x ^ y
            d |= d >> np.uint64(2)
            d |= d >> np.uint64(1)
            agree = MINIMA - np.bitwise_count(d & np.uint64(0x1111111111111111)).astype(np.int64).sum(1)
            yield batch.select([0, 1]).filter(pa.array(agree >= least))


def alike_signatures(least: int) -> Callable[[list, list], np.ndarray]:
    """Pairs of packed signatures that agree in enough minima and are not joined yet; a payload ends with the number of its piece."""

    def compare(left: list, right: list) -> np.ndarray:
        x, y = (np.frombuffer(b"".join(s), np.uint64).reshape(-1, WORDS_OF_SIGNATURE + 1) for s in (left, right))
        return (same_minima(x, y) >= least) & (x[:, None, -1] != y[None, :, -1])

    return compare


def alike_sets(percent: int) -> Callable[[list, list], np.ndarray]:
    """Pairs of sets with 100 * intersection >= percent * union."""

    def compare(left: list, right: list) -> np.ndarray:
        x, y = ([np.frombuffer(s, np.uint64) for s in sets] for sets in (left, right))
        common = common_counts(x, y)
        return 100 * common >= percent * (np.add.outer([len(s) for s in x], [len(s) for s in y]) - common)

    return compare


def likely_links(heads: DataFrame, least: int) -> DataFrame:
    """``(a, b)``: links that join all classes which share a bucket and whose signatures agree in enough minima."""
    spark = heads.sparkSession
    buckets = heads.select(F.explode("bands").alias("band"), "class")
    centres = buckets.groupBy("band").agg(F.min("class").alias("centre"), F.max("class").alias("other")).where("centre < other").select("band", "centre")
    shared, shared_path = written(buckets.join(shuffled(centres), "band"), "buckets")
    signed = heads.select("class", "signature")
    mates = shared.where("class <> centre").select(F.col("centre").alias("a"), F.col("class").alias("b")).distinct()
    mates = mates.join(shuffled(signed.withColumnsRenamed({"class": "b", "signature": "sb"})), "b").join(shuffled(signed.withColumnsRenamed({"class": "a", "signature": "sa"})), "a")
    star, _ = written(mates.select("a", "b", "sa", "sb").mapInArrow(lambda batches: likely(batches, least), "a long, b long"), "star")
    joined = components(star).withColumnsRenamed({"node": "class", "component": "piece"})
    shared = shared.select("band", "class").join(shuffled(joined), "class", "left").withColumn("piece", F.coalesce("piece", "class"))
    apart = shared.groupBy("band").agg(F.min("piece").alias("low"), F.max("piece").alias("high")).where("low < high").select("band")
    payload = F.concat("signature", F.unhex(F.lpad(F.hex("piece"), 16, "0")))
    rows = shared.join(shuffled(apart), "band").join(shuffled(signed), "class").select(F.col("band").alias("cluster"), "class", payload.alias("payload"))
    cross, _ = written(block_links(rows, alike_signatures(least)), "cross")
    drop_path(spark, shared_path)
    return star.unionByName(cross)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``: component_id is the least id that links lead to."""
    threshold = percent / 100
    sketch, _ = written(sketches(docs, width, bands_for(threshold)), "sketches")
    heads = sketch.where("set is not null").groupBy("set").agg(F.min_by(F.struct("bands", "signature"), F.struct(F.col("doc_id").isNull(), "doc_id")).alias("h"), F.min("doc_id").alias("doc_id"))
    heads, heads_path = written(heads.select(F.monotonically_increasing_id().alias("class"), "set", "doc_id", "h.bands", "h.signature"), "classes")
    clusters, _ = written(components(likely_links(heads, least_agreeing(threshold))).withColumnsRenamed({"node": "class", "component": "cluster"}), "clusters")
    wanted = heads.join(shuffled(clusters), "class", "left_semi").select("class", "doc_id", "set")
    sized, sized_path = written(clusters.join(shuffled(full_sets(docs, wanted, width)), "class").select("cluster", "class", F.col("shingles").alias("payload")), "sets")
    links, _ = written(block_links(sized, alike_sets(percent)), "links")
    drop_path(docs.sparkSession, sized_path)
    return _result(sketch, heads, components(links))


def _result(sketch: DataFrame, heads: DataFrame, groups: DataFrame) -> DataFrame:
    """Documents with the least id of their component."""
    at = heads.select("class", "set", "doc_id").join(shuffled(groups.withColumnsRenamed({"node": "class"})), "class", "left")
    at = at.withColumn("component", F.coalesce("component", "class"))
    least = at.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_set = at.select("set", "component").join(shuffled(least), "component").select("set", "component_id")
    out = sketch.select("doc_id", "n_shingles", "set").join(shuffled(by_set), "set", "left")
    component = F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: of each component the one with the least id.

    Of rows that repeat id and text one stays. Rows without an id stay if any of them does.
    """
    found, _ = written(near_duplicates(docs, width, percent).select("doc_id", "kept"), "kept")
    stay = found.where("kept").select("doc_id").distinct()
    rows = packed(docs, doc_id=F.col("doc_id").cast("long"), text=F.col("text"))
    rows = rows.alias("d").join(shuffled(stay.alias("s")), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")), "left_semi")
    if found.where("kept").groupBy("doc_id").count().where("count > 1").limit(1).count():
        rows = rows.dropDuplicates(["doc_id", "text"])
    return unpacked(rows, docs.columns)
