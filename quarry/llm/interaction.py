"""Filter interaction audit: what each of five filters removes, in each of their 120 orders.

A document that fails several filters is removed by the first of them in the order. ``FIRST`` says, for each of the 32 sets of
failures and each order, at which step that is, so a document needs its set of failures alone, whatever the number of orders.

1. Arrow batches turn each text into the set of filters that it fails by itself, its digest (SHA-256) and its part.
2. The last filter asks for the text's copies: the least id of each digest that occurs twice. Digests that hold a thousandth of all
   rows or more are at most a thousand and are broadcast; the others, of which no key is hot, meet in a join. Labels meet in a
   join by id.
3. In each task, documents are counted by part, set of failures and label; the counts index the table, and ``np.bincount`` adds them up
   by part, order and step. The tasks' partial arrays are summed.

Null texts are empty texts: they fail the first filter and are copies of one another. Null parts are the empty part. A null id is
neither smaller nor larger than any other: such rows are no copies and have none by it, and have no labels. Rows that repeat
an id count each; equal texts among them are not smaller than one another. Of several labels of an id, one that says 1 is
enough. Other columns, whatever their names, are ignored. An empty table has no parts and gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, trimmed, written

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
#: The filter at each order and step, and the step at which each set of failures (bit k: filter k) is removed; STEPS: never.
PLACE = np.array([[FILTERS.index(c) for c in order] for order in ORDERS])
FAILS = (np.arange(1 << STEPS)[:, None, None] >> PLACE[None]) & 1
FIRST = np.where(FAILS.any(2), FAILS.argmax(2), STEPS)

#: Filter settings: words at least, percent of distinct words at least, percent of capitals at most, and the marks of code.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, MARKS = 50, 65, 5, b"#$%&*|"
CAPITALS = bytes(range(65, 91))
#: A digest is hot from this share of the rows on, so that so many are hot at most.
HOT_SHARE = 1000
#: Parts that a task counts before it passes their counts on.
PARTS_HELD = 4096

COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def own_failures(text: str) -> int:
    """The filters, but for the one on copies, that a text fails; bit k stands for filter k."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at the ASCII white space
    n = len(words)
    few = n < MIN_WORDS
    repetitive = 100 * len(set(words)) < MIN_DISTINCT * n
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    return few | repetitive << 1 | (100 * capitals > MAX_CAPITALS * len(text)) << 2 | any(c in raw for c in MARKS) << 3


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``(doc_id, part, fails, digest)`` of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ts = b.column(2).to_pylist()
            fails = pa.array([own_failures(t) for t in ts], pa.int32())
            digest = pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in ts], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fails, digest], ["doc_id", "part", "fails", "digest"])

    empty = F.lit("")
    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.coalesce(F.col(quoted(part_col)).cast("string"), empty).alias("part"), F.coalesce(F.col(quoted(text_col)).cast("string"), empty).alias("text"))
    return rows.mapInArrow(trimmed(run), "doc_id long, part string, fails int, digest binary")


def with_copies(rows: DataFrame) -> DataFrame:
    """``rows`` (written, so that they are computed once) with the bit of the filter on copies in ``fails``."""
    heads = rows.groupBy("digest").agg(F.min("doc_id").alias("head"), F.count("*").alias("n")).where("n > 1 and head is not null")
    heads, _ = written(heads, "copies")
    hot = F.col("n") * HOT_SHARE >= rows.count()
    # at most HOT_SHARE rows
    near = heads.where(hot).select("digest", F.col("head").alias("hot_head"))
    far = heads.where(~hot).select("digest", "head")
    met = rows.join(F.broadcast(near), "digest", "left").join(far.hint("merge"), "digest", "left")
    later = F.coalesce(F.col("doc_id") > F.coalesce("hot_head", "head"), F.lit(False))
    return met.select("doc_id", "part", F.col("fails").bitwiseOR(later.cast("int") * (1 << FILTERS.index("E"))).alias("fails"))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with ``good`` and ``toxic``, 1 where a label of the id says so."""
    good, toxic = (F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic")))
    by_id = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(good, toxic)
    none = F.lit(0)
    met = rows.where("doc_id is not null").join(by_id, "doc_id", "left").select("part", "fails", F.coalesce("good", none).alias("good"), F.coalesce("toxic", none).alias("toxic"))
    return met.unionByName(rows.where("doc_id is null").select("part", "fails", none.alias("good"), none.alias("toxic")))


def by_order(counts: np.ndarray) -> np.ndarray:
    """Counts ``(part, fails, good, toxic)`` to ``(part, order, step, COUNTS)``, by the table of first failures."""
    parts = len(counts)
    part, fails, good, toxic = np.nonzero(counts)
    n = counts[part, fails, good, toxic]
    out = np.zeros((parts, len(ORDERS), STEPS, len(COUNTS)), np.int64)

    def summed(weight: np.ndarray) -> np.ndarray:
        """Removals by part, order and step; the last step holds what no filter removes."""
        at = (part[:, None] * len(ORDERS) + np.arange(len(ORDERS))) * (STEPS + 1) + FIRST[fails]
        flat = np.bincount(at.ravel(), np.repeat(weight, len(ORDERS)), parts * len(ORDERS) * (STEPS + 1))
        return np.rint(flat).astype(np.int64).reshape(parts, len(ORDERS), STEPS + 1)

    removed = summed(n)
    out[..., 0] = removed.sum(2, keepdims=True) - removed[..., :STEPS].cumsum(2)
    out[..., 1] = removed[..., :STEPS]
    for k in range(STEPS):
        at = PLACE == k
        failing = np.bincount(part, n * (fails >> k & 1), parts).astype(np.int64)
        alone = np.bincount(part, n * (fails == 1 << k), parts).astype(np.int64)
        out[:, at, 2] = failing[:, None] - out[:, at, 1]
        out[:, at, 3] = alone[:, None]
        out[:, at, 6] = out[:, at, 1].sum(1, keepdims=True)
    out[..., 4] = summed(n * good)[..., :STEPS]
    out[..., 5] = summed(n * toxic)[..., :STEPS]
    return out


def audited(rows: DataFrame, held: int = PARTS_HELD) -> DataFrame:
    """``(part, filter_order, step, COUNTS)`` from ``(part, fails, good, toxic)``; all orders and steps of each part. A task passes its counts on
    whenever it has ``held`` parts."""
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[str, int] = {}
        counts = np.zeros((16, 1 << STEPS, 2, 2), np.int64)

        def partial() -> Iterator[pa.RecordBatch]:
            names = list(of)
            for a in range(0, len(names), 64):
                some = names[a : a + 64]
                table = by_order(counts[a : a + len(some)]).reshape(-1, len(COUNTS))
                orders = np.tile(np.repeat(ORDERS, STEPS), len(some))
                steps = np.tile(np.arange(1, STEPS + 1, dtype=np.int32), len(some) * len(ORDERS))
                part = pa.array(some).take(pa.array(np.repeat(np.arange(len(some)), len(ORDERS) * STEPS)))
                yield pa.RecordBatch.from_arrays([part, pa.array(orders.tolist()), pa.array(steps), *[pa.array(c) for c in table.T.copy()]], [f.split()[0] for f in schema.split(", ")])

        for b in batches:
            coded = b.column(0).dictionary_encode()
            names = coded.dictionary.to_pylist()
            place = np.array([of.setdefault(p, len(of)) for p in names], np.int64)
            if len(of) > len(counts):
                counts = np.concatenate([counts, np.zeros((2 * len(of) - len(counts), *counts.shape[1:]), np.int64)])
            part = place[coded.indices.to_numpy()] if b.num_rows else np.zeros(0, np.int64)
            fails, good, toxic = (b.column(k).to_numpy() for k in (1, 2, 3))
            flat = np.bincount(((part << STEPS | fails) * 2 + good) * 2 + toxic, minlength=counts.size)
            counts += flat.reshape(counts.shape)
            if len(of) >= held:
                yield from partial()
                of, counts = {}, np.zeros((16, *counts.shape[1:]), np.int64)
        yield from partial()

    partial = rows.select("part", "fails", "good", "toxic").mapInArrow(trimmed(run), schema)
    return partial.groupBy("part", "filter_order", "step").agg(*[F.sum(c).alias(c) for c in COUNTS])


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)``."""
    rows, _ = written(failures(docs), "failures")
    return audited(with_labels(with_copies(rows), labels))


#: The same in DuckDB: sets of failures are counted by part first, then met with the orders.
SQL = """
with cleaned as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents
), measured as (
  select doc_id, part, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as words,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) as capitals, min(doc_id) over (partition by text) as head
  from cleaned
), named as (
  select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id
), failed as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
    case when len(words) < 50 then 'A' else '' end || case when 100 * len(list_distinct(words)) < 65 * len(words) then 'B' else '' end
      || case when 100 * capitals > 5 * length(text) then 'C' else '' end || case when regexp_matches(text, '[#$%&*|]') then 'D' else '' end
      || case when doc_id > head then 'E' else '' end as fails
  from measured left join named using (doc_id)
), counted as (
  select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from failed group by part, fails
), letters(f) as (
  values ('A'), ('B'), ('C'), ('D'), ('E')
), orders as (
  select a.f || b.f || c.f || d.f || e.f as filter_order
  from letters a join letters b on b.f <> a.f join letters c on c.f not in (a.f, b.f) join letters d on d.f not in (a.f, b.f, c.f)
    join letters e on e.f not in (a.f, b.f, c.f, d.f)
), steps(step) as (
  values (1), (2), (3), (4), (5)
), places as (
  select filter_order, step, substr(filter_order, step, 1) as f, substr(filter_order, 1, step - 1) as before from orders, steps
), met as (
  select part, filter_order, step, f, n, good, toxic, fails, contains(fails, f) as failing,
    len(list_filter(string_split(before, ''), lambda x: x <> '' and contains(fails, x))) > 0 as gone
  from counted, places
), summed as (
  select part, filter_order, step, f,
    sum(case when not gone and not failing then n else 0 end) as kept,
    sum(case when not gone and failing then n else 0 end) as removed,
    sum(case when gone and failing then n else 0 end) as redundant,
    sum(case when fails = f then n else 0 end) as unique_fails,
    sum(case when not gone and failing then good else 0 end) as good_lost,
    sum(case when not gone and failing then toxic else 0 end) as toxic_lost
  from met group by part, filter_order, step, f
)
select part, filter_order, cast(step as integer) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed,
  cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost,
  cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, f) as bigint) as shapley
from summed
"""
