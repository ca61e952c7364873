"""Hard-negative mining by distributed radix selection.

A request asks for the first ``k`` rows of an anchor by (score descending, id ascending), among rows of its label or of others, with
scores between two bounds. First come the requests for positives, one for each anchor; then one for each anchor and positive, whose bounds
are shares of the positive's score.

1. Vectors are quantised, written once and packed into blocks of rows; anchors into blocks of their own. Each pair of blocks is one
   unit of work: a product of matrices inside a task. Scores are never stored.
2. The key of a row in a request is its distance below the upper bound. In each round, tasks count rows by the next digit of the key, no
   further than their own ``k``-th row, since the ``k``-th of all rows cannot come later. The counts of all tasks are summed, and the digit
   that holds the ``k``-th row becomes the range of the next round. Where the score is settled and more rows than ``k`` share it, the digits
   of the id follow.
3. A request is settled once its range holds few rows (``FEW``) or one key. A last pass gathers the rows up to that range, no more than ``k`` from
   each pair of blocks, and a window ranks these few.

No task holds more than two blocks and a strip of their scores, and what moves between tasks is bounded by ``k`` for each request and block,
however many rows score alike.

Rows with a null id, label or vector, or any null or non-finite component, take no part. A vector that is shorter than another is
continued by zeros. Rows that repeat an id are rows of their own: an anchor is no partner of itself, but may be of its repeats. Anchors
without positives, and positives without negatives, have no rows. Other columns, whatever their names, are ignored. An empty table gives
an empty result. Scores are exact: products that may leave 2**53 are computed with whole numbers; those outside a long are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_path, quoted, tasks_for, trimmed, written

#: Rows and anchors of a block at most; anchors whose scores a task holds at a time.
BLOCK_ROWS, BLOCK_ANCHORS, STRIP = 8192, 8192, 64
#: Values of a digit, and how many rows of a range are few.
RADIX, FEW = 256, 32
#: Requests: bounds, how many, whether of the anchor's label; the range of keys still open (by score, then by id), and whether it is settled.
REQUEST = "anchor long, request int, low long, high long, k int, same boolean, key_at long, key_width long, id_at long, id_width long, settled boolean"
FIELDS = [f.split()[0] for f in REQUEST.split(", ")]


def quantised(rows: DataFrame, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """``(rid, vec_id, label, vector)`` of the rows that take part: components are ``floor(scale * x)``."""
    x = F.col(quoted(vector_col)).cast("array<double>")
    held = rows.select(F.col(quoted(id_col)).cast("long").alias("vec_id"), label.cast("long").alias("label"), x.alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    held = held.where("vec_id is not null and label is not null and vector is not null").where(finite)
    return held.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "label", F.transform("vector", lambda v: F.floor(v * scale).cast("double")).alias("vector"))


def packed_blocks(rows: DataFrame, blocks: int, name: str) -> DataFrame:
    """One row for each block: its number, and rids, ids, labels and vectors (rows one after the other, as doubles) as bytes."""
    schema = f"{name} int, n int, dim int, rids binary, ids binary, labels binary, vectors binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        got = pa.Table.from_batches(held).combine_chunks()
        number = got["block"].to_numpy()
        lists = got["vector"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        for k in np.unique(number).tolist():
            mine = np.flatnonzero(number == k)
            sizes = offsets[mine + 1] - offsets[mine]
            dim = int(sizes.max())
            matrix = np.zeros((len(mine), dim))
            at = np.arange(dim)
            inside = at[None] < sizes[:, None]
            matrix[inside] = values[(offsets[mine][:, None] + at)[inside]]
            held_as = [got[c].to_numpy()[mine].astype(np.int64).tobytes() for c in ("rid", "vec_id", "label")]
            yield pa.RecordBatch.from_pydict({name: pa.array([k], pa.int32()), "n": pa.array([len(mine)], pa.int32()), "dim": pa.array([dim], pa.int32()), "rids": [held_as[0]], "ids": [held_as[1]], "labels": [held_as[2]], "vectors": [matrix.tobytes()]})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int")).repartitionById(blocks, F.col("block"))
    return dealt.select("block", "rid", "vec_id", "label", "vector").mapInArrow(trimmed(run), schema)


class Block:
    """Rids, ids, labels and vectors of a packed block."""

    def __init__(self, n: int, dim: int, rids: bytes, ids: bytes, labels: bytes, vectors: bytes):
        self.rids, self.ids, self.labels = (np.frombuffer(x, np.int64) for x in (rids, ids, labels))
        self.vectors = np.frombuffer(vectors).reshape(n, dim)
        self.most = float(np.abs(self.vectors).max(initial=0.0))


def scores(anchors: np.ndarray, rows: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products as whole numbers."""
    d = min(anchors.shape[1], rows.shape[1])
    if exact:
        return np.rint(anchors[:, :d] @ rows[:, :d].T).astype(np.int64)
    whole = [[[int(x) for x in v] for v in m[:, :d].tolist()] for m in (anchors, rows)]
    return np.array([[sum(x * y for x, y in zip(a, b, strict=True)) for b in whole[1]] for a in whole[0]], object).astype(np.int64)


class Blocks:
    """The rows and the anchors as written blocks, and how pairs of them meet."""

    def __init__(self, rows: DataFrame, is_anchor: Column):
        spark = rows.sparkSession
        self.spark, self.paths = spark, []
        self.rows = self._kept(rows, "vectors")
        self.anchors = self.rows.where(is_anchor)
        n, m, self.first_id, self.last_id = self.rows.agg(F.count("*"), F.count_if(is_anchor), F.min("vec_id"), F.max("vec_id")).first()
        tasks = tasks_for(spark)
        self.row_blocks = max(min(tasks, -(-n // 256)), -(-n // BLOCK_ROWS), 1)
        self.anchor_blocks = max(-(-m // BLOCK_ANCHORS), 1)
        self.block_of = F.pmod(F.xxhash64("anchor"), F.lit(self.anchor_blocks)).cast("int")
        self.packed_rows = self._kept(packed_blocks(self.rows, self.row_blocks, "row_block"), "row-blocks")
        self.packed_anchors = self._kept(packed_blocks(self.anchors, self.anchor_blocks, "anchor_block"), "anchor-blocks")
        norm = F.aggregate("vector", F.lit(0.0), lambda s, v: s + v * v)
        self.reach = int(self.rows.agg(F.max(norm)).first()[0] or 0) + 1  # no score lies beyond the largest square of a length

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        out, path = written(df, name)
        self.paths.append(path)
        return out

    def drop(self) -> None:
        drop_path(self.spark, *self.paths)

    def pairs(self, requests: DataFrame, run, schema: str) -> DataFrame:
        """``run(rows, anchors, requests)`` for each pair of blocks; requests are columns of arrays, in the order of their anchors."""
        named = F.sort_array(F.collect_list(F.struct(*FIELDS)))
        asked = requests.groupBy(self.block_of.alias("anchor_block")).agg(named.alias("requests")).join(self.packed_anchors, "anchor_block")
        asked = asked.select("anchor_block", F.struct("n", "dim", "rids", "ids", "labels", "vectors").alias("anchors"), "requests")
        asked = asked.withColumn("row_block", F.explode(F.sequence(F.lit(0), F.lit(self.row_blocks - 1))))
        rows = self.packed_rows.select("row_block", F.struct("n", "dim", "rids", "ids", "labels", "vectors").alias("rows"))
        rows = rows.withColumn("anchor_block", F.explode(F.sequence(F.lit(0), F.lit(self.anchor_blocks - 1))))
        parts = self.row_blocks * min(self.anchor_blocks, 16)
        keys = ["row_block", "anchor_block"]
        met = rows.repartition(parts, *keys).join(asked.repartition(parts, *keys), keys).select("rows", "anchors", "requests")

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in range(b.num_rows):
                    r, a = (Block(**b.column(c)[k].as_py()) for c in (0, 1))
                    lists = b.column(2)
                    some = lists.values.slice(lists.offsets[k].as_py(), lists.offsets[k + 1].as_py() - lists.offsets[k].as_py())
                    yield from run(r, a, {f: some.field(j).to_numpy(zero_copy_only=False) for j, f in enumerate(FIELDS)})

        return met.mapInArrow(trimmed(task), schema)


def each_request(rows: Block, anchors: Block, asked: dict[str, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(request's place, scores, places of the rows inside its bounds and labels)``, by strips of anchors."""
    by = np.argsort(anchors.rids)
    where = by[np.searchsorted(anchors.rids[by], asked["anchor"])]
    exact = rows.most * anchors.most * max(rows.vectors.shape[1], 1) < 2**53
    wanted, of = np.unique(where, return_inverse=True)
    for a in range(0, len(wanted), STRIP):
        strip = wanted[a : a + STRIP]
        s = scores(anchors.vectors[strip], rows.vectors, exact)
        for k in np.flatnonzero((of >= a) & (of < a + STRIP)).tolist():
            row, place = s[of[k] - a], where[k]
            inside = (row >= asked["low"][k]) & (row <= asked["high"][k]) & ((rows.labels == anchors.labels[place]) == asked["same"][k])
            if asked["same"][k]:
                inside &= rows.rids != anchors.rids[place]
            yield k, row, np.flatnonzero(inside)


def before(digits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The digits that occur and how often, in order, up to that of the ``k``-th row."""
    n = np.bincount(digits, minlength=1)
    at = np.flatnonzero(n)
    upto = int(np.searchsorted(np.cumsum(n[at]), k)) + 1
    return at[:upto], n[at[:upto]]


def width_of_digit(width: int, radix: int) -> int:
    """Keys that share a digit, so that ``radix`` digits cover the range."""
    return -(-width // radix)


def histograms(rows: Block, anchors: Block, asked: dict[str, np.ndarray], radix: int) -> Iterator[pa.RecordBatch]:
    """``(anchor, request, digit, n)``: how many rows of this block have the next digit in each open request. Digit -1 counts rows before the range."""
    out: list[tuple[np.ndarray, ...]] = []
    for k, score, at in each_request(rows, anchors, asked):
        key = asked["high"][k] - score[at]
        low, width, need = int(asked["key_at"][k]), int(asked["key_width"][k]), int(asked["k"][k])
        earlier = int((key < low).sum())
        inside = at[(key >= low) & (key - low < width)]
        if width > 1:
            digits = (asked["high"][k] - score[inside] - low) // width_of_digit(width, radix)
        else:  # the score is settled: by id
            start, span = int(asked["id_at"][k]), int(asked["id_width"][k])
            ids = rows.ids[inside]
            earlier += int((ids < start).sum())
            ids = ids[(ids >= start) & (ids - start < span)]
            digits = (ids - start) // width_of_digit(span, radix)
        found, n = before(digits.astype(np.int64), max(need - earlier, 0)) if len(digits) and need > earlier else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if earlier:
            found, n = np.append(-1, found), np.append(earlier, n)
        if len(found):
            out.append((np.full(len(found), asked["anchor"][k]), np.full(len(found), asked["request"][k], np.int32), found.astype(np.int32), n))
    if out:
        a, r, d, n = (np.concatenate(x) for x in zip(*out, strict=True))
        yield pa.RecordBatch.from_pydict({"anchor": pa.array(a), "request": pa.array(r), "digit": pa.array(d), "n": pa.array(n.astype(np.int64))})


def gathered(rows: Block, anchors: Block, asked: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """``(anchor, request, k, score, rid, vec_id)`` of the rows up to the end of each request's range, no more than ``k`` of this block."""
    out = []
    for k, score, at in each_request(rows, anchors, asked):
        key = asked["high"][k] - score[at]
        end, last = int(asked["key_at"][k]) + int(asked["key_width"][k]) - 1, int(asked["id_at"][k]) + int(asked["id_width"][k]) - 1
        one = int(asked["key_width"][k]) == 1
        at = at[(key < end) | ((key == end) & ((rows.ids[at] <= last) | (not one)))]
        at = at[np.lexsort([rows.ids[at], -score[at]])][: int(asked["k"][k])]
        if len(at):
            out.append((np.full(len(at), asked["anchor"][k]), np.full(len(at), asked["request"][k], np.int32), np.full(len(at), asked["k"][k], np.int32), score[at], rows.rids[at], rows.ids[at]))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["anchor", "request", "k", "score", "rid", "vec_id"])


def refined(requests: DataFrame, counted: DataFrame, radix: int, few: int) -> DataFrame:
    """Requests after a round: each open range becomes that of the digit with the ``k``-th row, or stays whole if there are fewer rows."""
    n = counted.groupBy("anchor", "request", "digit").agg(F.sum("n").alias("n"))
    digits = n.groupBy("anchor", "request").agg(F.sort_array(F.collect_list(F.struct("digit", "n"))).alias("digits"))  # radix + 1 at most
    start = F.struct(F.lit(0).cast("long").alias("before"), F.lit(-2).alias("digit"), F.lit(0).cast("long").alias("n"))

    def step(s, d):
        enough = s["before"] + s["n"] >= F.col("k")
        return F.when(enough, s).otherwise(F.struct((s["before"] + s["n"]).alias("before"), d["digit"].alias("digit"), d["n"].alias("n")))

    met = requests.join(digits, ["anchor", "request"], "left").withColumn("at", F.aggregate(F.coalesce("digits", F.array().cast("array<struct<digit:int,n:bigint>>")), start, step))
    digit, held = F.col("at.digit"), F.col("at.n")
    found = F.col("at.before") + held >= F.col("k")  # else all rows qualify: the range stays
    by_score = F.col("key_width") > 1
    key_step, id_step = (F.expr(f"({c} + {radix - 1}) div {radix}") for c in ("key_width", "id_width"))
    moves = found & (digit >= 0)
    settled = ~found | (held <= few) | (~by_score & (id_step == 1))
    changed = {
        "key_at": F.when(moves & by_score, F.col("key_at") + digit * key_step).otherwise(F.col("key_at")),
        "key_width": F.when(moves & by_score, F.least(key_step, F.col("key_width") - digit * key_step)).otherwise(F.col("key_width")),
        "id_at": F.when(moves & ~by_score, F.col("id_at") + digit * id_step).otherwise(F.col("id_at")),
        "id_width": F.when(moves & ~by_score, F.least(id_step, F.col("id_width") - digit * id_step)).otherwise(F.col("id_width")),
        "settled": settled,
    }
    return met.select(*[changed.get(f, F.col(f)).alias(f) for f in FIELDS])


def selected(blocks: Blocks, requests: DataFrame, radix: int = RADIX, few: int = FEW) -> DataFrame:
    """``(anchor, request, rank, rid, vec_id, score)``: the first ``k`` rows of each request ``(anchor, request, low, high, k, same)``."""
    spark = blocks.spark
    span = (blocks.last_id - blocks.first_id + 1) if blocks.first_id is not None else 1
    opened = {"key_at": F.lit(0).cast("long"), "key_width": F.col("high") - F.col("low") + 1, "id_at": F.lit(blocks.first_id or 0).cast("long"), "id_width": F.lit(span).cast("long"), "settled": F.lit(False)}
    table, path = written(requests.where("high >= low").withColumns(opened).select(*FIELDS), "requests")
    done: list[DataFrame] = []
    while True:
        open_ = table.where("not settled")
        if not open_.limit(1).count():
            break
        done.append(table.where("settled"))
        table, path = written(refined(open_, blocks.pairs(open_, partial(histograms, radix=radix), "anchor long, request int, digit int, n long"), radix, few), "requests")
        blocks.paths.append(path)
    for d in done:
        table = table.unionByName(d)
    blocks.paths.append(path)
    got = blocks.pairs(table, gathered, "anchor long, request int, k int, score long, rid long, vec_id long")
    rank = F.row_number().over(Window.partitionBy("anchor", "request").orderBy(F.desc("score"), "vec_id", "rid"))
    return got.withColumn("rank", rank).where("rank <= k").select("anchor", "request", "rank", "rid", "vec_id", "score")


def hard_negatives(rows: DataFrame, label: Column, is_anchor: Column, positives: int = 5, negatives: int = 10, low_percent: int = 30, high_percent: int = 90, id_col: str = "vec_id", vector_col: str = "embedding", radix: int = RADIX, few: int = FEW) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``; ``is_anchor`` is a condition on ``vec_id`` and ``label``."""
    blocks = Blocks(quantised(rows, label, id_col, vector_col), is_anchor)
    anchors = blocks.anchors.select(F.col("rid").alias("anchor"))
    reach = F.lit(blocks.reach).cast("long")
    nearest = selected(blocks, anchors.select("anchor", F.lit(0).alias("request"), (-reach).alias("low"), reach.alias("high"), F.lit(positives).alias("k"), F.lit(True).alias("same")), radix, few)
    nearest = blocks._kept(nearest, "positives")
    # bounds in whole numbers: the least score at or above the one share, the greatest at or below the other
    low = F.expr(f"-((-score * {low_percent} - pmod(-score * {low_percent}, 100)) div 100)")
    high = F.expr(f"(score * {high_percent} - pmod(score * {high_percent}, 100)) div 100")
    asked = nearest.select("anchor", F.col("rank").alias("request"), low.cast("long").alias("low"), high.cast("long").alias("high"), F.lit(negatives).alias("k"), F.lit(False).alias("same"))
    found = selected(blocks, asked, radix, few)
    pairs = nearest.select("anchor", F.col("rank").alias("request"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = blocks.anchors.select(F.col("rid").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    out = found.join(pairs, ["anchor", "request"]).join(named, "anchor")
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


#: The same in DuckDB: each anchor against all rows.
SQL = """
with numbered as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), scored as (
  select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, cast(list_inner_product(a.v, b.v) as bigint) as score
  from numbered a join numbered b on a.vec_id <> b.vec_id
  where a.vec_id % 100 = 0
), positives as (
  select anchor_id, other_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5
)
select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, other_id) as integer) as rank,
  other_id as negative_id, positive_score, score as negative_score
from positives join scored using (anchor_id)
where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, other_id) <= 10
"""
