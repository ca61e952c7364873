"""Pairs of nodes that few edges connect, by blocks of an adjacency matrix in bits.

Nodes of all groups are numbered in one order and dealt to blocks of ``BLOCK``; a tile holds which nodes of one block reach which of
another, a bit each. A step multiplies tiles of edges by tiles of the last step's pairs. A task holds three tiles at a time, and no path
becomes a row: dense groups have far more paths than pairs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans.stages import drop_path, shuffled, tasks_for, written

from .ranking import positions

#: Nodes of a block (a multiple of 64), and rows of a tile that are turned into pairs at once.
BLOCK, SLAB = 8192, 64
TILE = "a int, b int, tile binary"


def _packed(bits: np.ndarray) -> bytes:
    return zlib.compress(bits, 1)


def _bits(tile: bytes) -> np.ndarray:
    """A tile as rows of 64-bit words."""
    return np.frombuffer(bytearray(zlib.decompress(tile)), np.uint64).reshape(BLOCK, BLOCK // 64)


def _members(row: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(row.view(np.uint8), bitorder="little"))


def _batch(a: int, b: int, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    if bits.any():
        yield pa.RecordBatch.from_arrays([pa.array([a], pa.int32()), pa.array([b], pa.int32()), pa.array([_packed(bits)], pa.binary())], names=["a", "b", "tile"])


def _from_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles of edges ``(a, b, u, v)`` that come sorted by ``(a, b)``."""
    at, bits = None, None
    for batch in batches:
        a, b, u, v = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        ends = [0, *(np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1).tolist(), len(a)]
        for low, high in zip(ends[:-1], ends[1:], strict=True):
            if low == high:
                continue
            if at != (a[low], b[low]):
                if at is not None:
                    yield from _batch(*at, bits)
                at, bits = (a[low], b[low]), np.zeros((BLOCK, BLOCK // 64), np.uint64)
            own = v[low:high]
            np.bitwise_or.at(bits.view(np.uint8), (u[low:high], own >> 3), (1 << (own & 7)).astype(np.uint8))
    if at is not None:
        yield from _batch(*at, bits)


def _product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(a, b, left, right)``: for each node of the left tile, all that its neighbours reach in the right one."""
    for batch in batches:
        for k in range(batch.num_rows):
            a, b, left, right = (c[k].as_py() for c in batch.columns)
            left, right = _bits(left), _bits(right)
            out = np.zeros_like(right)
            for r in np.flatnonzero(left.any(axis=1)):
                out[r] = np.bitwise_or.reduce(right[_members(left[r])], axis=0)
            yield from _batch(a, b, out)


def _new(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(a, b, seen, tile)`` that come sorted by ``(a, b, seen)``: pairs of different nodes that the products hold and no earlier step."""
    at, bits, own = None, None, np.arange(BLOCK)

    def close() -> Iterator[pa.RecordBatch]:
        if at is not None:
            if at[0] == at[1]:
                bits.view(np.uint8)[own, own >> 3] &= ~(1 << (own & 7)).astype(np.uint8)
            yield from _batch(*at, bits)

    for batch in batches:
        for k in range(batch.num_rows):
            a, b, seen, tile = (c[k].as_py() for c in batch.columns)
            if at != (a, b):
                yield from close()
                at, bits = (a, b), np.zeros((BLOCK, BLOCK // 64), np.uint64)
            bits = bits & ~_bits(tile) if seen else bits | _bits(tile)
    yield from close()


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(a, b, steps, tile, left, right)``, with the nodes of both blocks as lists of structs, as pairs of nodes."""
    for batch in batches:
        for k in range(batch.num_rows):
            a, b, steps, tile = (batch.column(c)[k].as_py() for c in range(4))
            left, right = (batch.column(c)[k].values for c in (4, 5))
            keys, bits = left.type.num_fields - 1, _bits(tile)
            for low in range(0, BLOCK, SLAB):
                slab = bits[low : low + SLAB]
                if not slab.any():
                    continue
                u, v = np.nonzero(np.unpackbits(slab.view(np.uint8), axis=1, bitorder="little"))
                u = u + low
                if a == b:
                    u, v = u[u < v], v[u < v]
                if len(u):
                    one, other = pa.array(u), pa.array(v)
                    own = [left.field(c).take(one) for c in range(keys)]
                    yield pa.RecordBatch.from_arrays([*own, left.field(keys).take(one), right.field(keys).take(other), pa.array(np.full(len(u), steps, np.int32))], names=[*(left.type[c].name for c in range(keys)), "i", "j", "steps"])


def within(edges: DataFrame, keys: list[str], steps: int) -> DataFrame:
    """``(keys, i, j, steps)`` with i < j: pairs of a group that at most so many edges ``(keys, i, j)`` connect, and the fewest."""
    spark = edges.sparkSession
    n = 4 * tasks_for(spark)
    edges, held = written(edges.select(*keys, "i", "j").where("i <> j").dropna(subset=keys), "edges")
    kind = {c.name: c.dataType.simpleString() for c in edges.schema}
    ends = edges.select(*keys, F.col("i").alias("node")).union(edges.select(*keys, "j")).distinct()
    nodes, _ = written(positions(ends, [], [*keys, "node"], "at").withColumn("at", F.col("at") - 1), "nodes")

    def numbered(rows: DataFrame, end: str, out: str) -> DataFrame:
        return rows.join(nodes.select(*keys, F.col("node").alias(end), F.col("at").alias(out)), [*keys, end])

    both = numbered(numbered(edges, "i", "u"), "j", "v").select("u", "v")
    both = both.union(both.select("v", "u"))
    dealt = both.select(*[F.floor(F.col(c) / BLOCK).cast("int").alias(o) for c, o in (("u", "a"), ("v", "b"))], *[F.pmod(c, F.lit(BLOCK)).cast("int").alias(c) for c in "uv"])
    one, _ = written(dealt.repartition(n, "a", "b").sortWithinPartitions("a", "b").mapInArrow(_from_edges, TILE), "reach")
    drop_path(spark, held)
    found = [one]
    for k in range(2, steps + 1):
        left = one.select("a", F.col("b").alias("__m"), F.col("tile").alias("left")).repartition(n, "__m")
        right = found[-1].select(F.col("a").alias("__m"), "b", F.col("tile").alias("right")).repartition(n, "__m")
        met = left.join(shuffled(right), "__m").select("a", "b", "left", "right")
        if k == steps:  # no step follows that needs both directions
            met = met.where("a <= b")
        reached = met.mapInArrow(_product, TILE).withColumn("seen", F.lit(False))
        for f in found:
            # earlier tiles only of what is reached now are needed, others come out empty
            reached = reached.unionByName(f.withColumn("seen", F.lit(True)))
        rows = reached.select("a", "b", "seen", "tile").repartition(n, "a", "b").sortWithinPartitions("a", "b", "seen")
        found.append(written(rows.mapInArrow(_new, TILE), "reach")[0])
    tiles = None
    for k, f in enumerate(found, 1):
        f = f.where("a <= b").select("a", "b", F.lit(k).alias("steps"), "tile")
        tiles = f if tiles is None else tiles.union(f)
    member = F.struct("at", F.struct(*keys, "node").alias("m"))
    blocks = nodes.groupBy(F.floor(F.col("at") / BLOCK).cast("int").alias("a")).agg(F.transform(F.sort_array(F.collect_list(member)), lambda x: x["m"]).alias("left"))
    rows = tiles.repartition(n, "a", "b", "steps").join(blocks, "a").join(blocks.select(F.col("a").alias("b"), F.col("left").alias("right")), "b")
    schema = ", ".join([*(f"`{c}` {kind[c]}" for c in keys), f"i {kind['i']}", f"j {kind['j']}", "steps int"])
    return rows.select("a", "b", "steps", "tile", "left", "right").mapInArrow(_pairs, schema)
