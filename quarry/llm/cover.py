"""Substring deduplication by difference-cover anchors.

A window is ``length`` (20) consecutive words of one document. Two equal windows at any two places have an anchor in common: the places
whose number modulo 7 is 0, 1 or 3 are a difference cover, so that some shift below 7 takes both windows' starts to such places, and the
14 words from there lie inside both.

1. Documents are numbered and written once. Copies, byte for byte, of a document with a smaller id are removed whole if they have a
   window; they need no more work.
2. The words of the others are hashed, and windows of 14 words at cover places only are dealt by their hash. Those that occur
   again are shared anchors. A task that meets a hash twice knows that already and deals one of its places only.
3. Each shared anchor extends to the windows of 20 words around it. Their 128-bit identities are dealt; of equal ones all but the first
   (by id, then start) are removed. A task settles what it can among its own windows and deals one of each.
4. Removed windows become spans of words, which meet the texts again.

Where a passage fills a third of the corpus, each task deals one row for each of its windows, whatever the passage's frequency.

Words are runs of other bytes than ASCII white space, unchanged; nothing but their bytes counts. Null texts have no words; texts with fewer
words than a window lose none. Windows never cross documents, and are judged on the input. Ids order documents; rows that repeat an id are
documents of their own, neither of which is earlier; a null id is neither earlier nor later than any other, so such rows lose
only what they repeat themselves. Other columns, whatever their names, are ignored (``without_repeated_words`` keeps them).
An empty table gives an empty table. Windows are compared by 128-bit hashes, copies by SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, quoted, tasks_for, trimmed, unpacked, written
from .hashing import BASE, between, mix, powers, prefix
from .suffixes import marked, merged, numbered

#: The length of a window, the period, and the places modulo the period that are the cover.
LENGTH, PERIOD, COVER = 20, 7, (0, 1, 3)
#: Bytes of text that are hashed together, and bytes from which on a word is hashed by itself.
BATCH_BYTES, LONG_WORD = 1 << 20, 1 << 16
#: Bytes of text whose anchors one task gathers, and windows that a task settles together.
GATHERED, TOGETHER = 32 << 20, 1 << 19
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_edges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[data], [True]]).astype(np.int8)))
    return edge[0::2], edge[1::2]


def word_hashes(raw: bytes, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each word, ``(2, n)``. Very long words are hashed by themselves, so that the arrays stay small."""
    long = np.flatnonzero(ends - starts >= LONG_WORD)
    if not len(long):
        return np.stack([between(prefix(data, row), starts, ends) for row in (0, 1)])
    out = np.empty((2, len(starts)), np.uint64)
    a = 0
    for k in [*long.tolist(), len(starts)]:
        if a < k:
            part = data[starts[a] : ends[k - 1]]
            out[:, a:k] = [between(prefix(part, row), starts[a:k] - starts[a], ends[a:k] - starts[a]) for row in (0, 1)]
        if k < len(starts):
            out[:, k] = np.frombuffer(hashlib.blake2b(raw[starts[k] : ends[k]], digest_size=16).digest(), np.uint64)
        a = k + 1
    return out


class Words:
    """Consecutive words: the number of each one's text, its index there, and its hashes. ``fresh``: the index from which
    words have not been in an earlier stretch of the same text."""

    def __init__(self, number: np.ndarray, index: np.ndarray, hashes: np.ndarray, fresh: int = 0):
        self.number, self.index, self.hashes, self.fresh = number, index, hashes, fresh

    def runs(self, length: int) -> np.ndarray:
        """Places from which on ``length`` words of one text follow that were not all in an earlier stretch."""
        n = len(self.number) - length + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        return np.flatnonzero((self.number[:n] == self.number[length - 1 :]) & (self.index[length - 1 :] >= self.fresh))

    def identities(self, at: np.ndarray, length: int, rows: int) -> np.ndarray:
        """``rows`` 64-bit hashes of the ``length`` words from each place on, the same wherever they stand."""
        out = np.empty((rows, len(at)), np.uint64)
        for r in range(rows):
            sums = np.zeros(len(self.number) + 1, np.uint64)
            np.cumsum(mix(self.hashes[r] + BASE) * powers(len(self.number)), out=sums[1:])
            out[r] = between(sums, at, at + length)
        return out


def stretches(raws: list[bytes], length: int = LENGTH) -> Iterator[Words]:
    """The words of the texts: short texts together, a long one in stretches that overlap by a window less one word."""
    group: list[tuple[int, bytes]] = []
    size = 0

    def together() -> Words:
        raw = b"\n".join([t for _, t in group])
        data = np.frombuffer(raw, np.uint8)
        starts, ends = word_edges(data)
        limits = np.cumsum([len(t) + 1 for _, t in group])
        counts = np.diff(np.concatenate([[0], np.searchsorted(starts, limits)]))
        first = np.cumsum(counts) - counts
        return Words(np.repeat([n for n, _ in group], counts), np.arange(len(starts)) - np.repeat(first, counts), word_hashes(raw, data, starts, ends))

    for number, raw in enumerate(raws):
        if len(raw) <= BATCH_BYTES:
            if group and size + len(raw) > BATCH_BYTES:
                yield together()
                group, size = [], 0
            group.append((number, raw))
            size += len(raw) + 1
            continue
        seen, at = 0, 0
        carried = np.zeros((2, 0), np.uint64)
        while at < len(raw):
            stop = at + BATCH_BYTES
            while stop < len(raw):  # to the end of a word, whose length has no bound
                space = np.flatnonzero(_SPACE[np.frombuffer(raw[stop : stop + BATCH_BYTES], np.uint8)])
                stop += int(space[0]) if len(space) else BATCH_BYTES
                if len(space):
                    break
            part = raw[at:stop]
            data = np.frombuffer(part, np.uint8)
            starts, ends = word_edges(data)
            hashes = np.concatenate([carried, word_hashes(part, data, starts, ends)], 1)
            first = seen - carried.shape[1]
            seen += len(starts)
            yield Words(np.full(hashes.shape[1], number), np.arange(first, seen), hashes, fresh=seen - len(starts))
            carried, at = hashes[:, -(length - 1) :], stop
    if group:
        yield together()


def is_cover(index: np.ndarray) -> np.ndarray:
    return np.isin(index % PERIOD, COVER)


def anchored(words: Words, length: int) -> np.ndarray:
    """Places of the cover at which an anchor begins."""
    at = words.runs(length - PERIOD + 1)
    return at[is_cover(words.index[at])]


def shared_anchors(rows: DataFrame, parts: int, length: int) -> DataFrame:
    """``(rid, start)`` of the anchors whose words occur again, from ``(rid, text)``."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rids = b.column(0).to_numpy()
            for words in stretches([t.encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()], length):
                at = anchored(words, length)
                if not len(at):
                    continue
                h = words.identities(at, length - PERIOD + 1, 1)[0]
                _, once, of, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                known = n[of] > 1
                witness = np.zeros(len(known), bool)
                witness[once[n > 1]] = True
                hashes, rid, start = h.view(np.int64), rids[words.number[at]], words.index[at].astype(np.int32)
                place = (rid * 31 + start) % parts  # those that are known to be shared go anywhere
                part = np.where(known & ~witness, place, hashes % parts).astype(np.int32)
                state = np.where(witness, 1, np.where(known, 2, 0)).astype(np.int8)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (part, hashes, rid, start, state)], ["part", "hash", "rid", "start", "state"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            sure = b.column(4).to_numpy() == 2
            if sure.any():
                yield b.select([2, 3]).filter(pa.array(sure))
            held.append(b.filter(pa.array(~sure)))
        if not held:
            return
        got = pa.Table.from_batches(held)
        _, of, n = np.unique(got["hash"].to_numpy(), return_inverse=True, return_counts=True)
        shared = (n[of] > 1) | (got["state"].to_numpy() == 1)
        yield from got.select(["rid", "start"]).filter(pa.array(shared)).to_batches(max_chunksize=100_000)

    dealt = rows.mapInArrow(trimmed(hashed), "part int, hash long, rid long, start int, state byte").repartitionById(parts, F.col("part"))
    return dealt.mapInArrow(trimmed(again), "rid long, start int")


#: Windows on their way: identity, id (0 where null) and whether it is null, row, start.
WINDOW = ["h0", "h1", "doc", "no_id", "rid", "start"]


def settled(t: dict[str, np.ndarray]) -> np.ndarray:
    """Which windows are known to repeat an earlier one. The others stand for them wherever they are compared next."""
    by = np.lexsort([t["start"], t["rid"], t["doc"], t["no_id"], t["h1"], t["h0"]])
    h0, h1, doc, no_id, rid = (t[c][by] for c in ("h0", "h1", "doc", "no_id", "rid"))
    new = np.ones(len(by), bool)
    new[1:] = (h0[1:] != h0[:-1]) | (h1[1:] != h1[:-1])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]  # has the least id of the equal ones, if any has an id
    own = np.zeros(len(by), bool)  # an earlier start in the same row
    own[1:] = ~new[1:] & (rid[1:] == rid[:-1])
    later = ~no_id & ~no_id[first] & (doc > doc[first])
    removed = np.zeros(len(by), bool)
    removed[by] = own | later
    return removed


#: What windows travel as: one by one until they are settled; then as blocks of (row, start), one for each part of the rows.
MOVED = "part int, h0 long, h1 long, doc long, no_id boolean, rid long, start int, rids array<long>, starts array<int>"
BLOCK = "part int, rids array<long>, starts array<int>"


def blocks(rid: np.ndarray, start: np.ndarray, parts: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """``(part, rids, starts)``: windows by the part of their row."""
    part = rid % parts
    by = np.argsort(part, kind="stable")
    part = part[by]
    new = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    offsets = pa.array(np.append(new, len(by)).astype(np.int32))
    return pa.array(part[new].astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(rid[by])), pa.ListArray.from_arrays(offsets, pa.array(start[by].astype(np.int32)))


def removed_windows(rows: DataFrame, parts: int, length: int) -> DataFrame:
    """``(rid, starts)`` of the windows that repeat an earlier one, from ``(rid, doc_id, text, anchors)``."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        names = [f.split()[0] for f in MOVED.split(", ")]

        def sent() -> Iterator[pa.RecordBatch]:
            t = {c: np.concatenate([x[c] for x in held]) for c in WINDOW}
            gone = settled(t)
            if gone.any():
                part, rids, starts = blocks(t["rid"][gone], t["start"][gone], parts)
                none = [pa.nulls(len(part), k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32())]
                yield pa.RecordBatch.from_arrays([part, *none, rids, starts], names)
            t = {c: x[~gone] for c, x in t.items()}
            # to the task of their identity; those that only their own row can remove, to that of the row
            part = np.where(t["no_id"], t["rid"] % parts, t["h0"].view(np.int64) % parts).astype(np.int32)
            columns = [t["h0"].view(np.int64), t["h1"].view(np.int64), t["doc"], t["no_id"], t["rid"], t["start"].astype(np.int32)]
            none = [pa.nulls(len(part), pa.list_(k)) for k in (pa.int64(), pa.int32())]
            yield pa.RecordBatch.from_arrays([*[pa.array(x) for x in (part, *columns)], *none], names)

        n = 0
        for b in batches:
            rids, doc, flags = b.column(0).to_numpy(), b.column(1), b.column(3)
            no_id, ids = np.asarray(doc.is_null()), doc.fill_null(0).to_numpy()
            offsets = flags.offsets.to_numpy()
            number = np.repeat(np.arange(b.num_rows), np.diff(offsets))
            shared = np.unique(number << 40 | flags.values.to_numpy()[offsets[0] : offsets[-1]].astype(np.int64))
            for words in stretches([t.encode("utf-8", "surrogatepass") for t in b.column(2).to_pylist()], length):
                at = words.runs(length)
                name = words.number.astype(np.int64) << 40 | words.index
                hit = np.concatenate([[0], np.cumsum(np.isin(name, shared))])
                at = at[hit[at + PERIOD] > hit[at]]  # one of the anchors inside the window is shared
                if not len(at):
                    continue
                h0, h1 = words.identities(at, length, 2)
                k = words.number[at]
                held.append({"h0": h0, "h1": h1, "doc": ids[k], "no_id": no_id[k], "rid": rids[k], "start": words.index[at]})
                n += len(at)
                if n >= TOGETHER:
                    yield from sent()
                    held, n = [], 0
        if held:
            yield from sent()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            block = np.asarray(b.column(7).is_valid())
            if block.any():
                yield b.filter(pa.array(block)).select([0, 7, 8])
            held.append(b.select(range(7)).filter(pa.array(~block)))
        got = pa.Table.from_batches(held) if held else None
        if not got:
            return
        t = {c: got[c].to_numpy() for c in WINDOW}
        gone = settled(t)
        if gone.any():
            yield pa.RecordBatch.from_arrays([*blocks(t["rid"][gone], t["start"][gone], parts)], [f.split()[0] for f in BLOCK.split(", ")])

    def by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(1).flatten().to_numpy(), b.column(2).flatten().to_numpy()) for b in batches if b.num_rows]
        if not held:
            return
        rid, start = (np.concatenate([x[k] for x in held]) for k in (0, 1))
        by = np.lexsort([start, rid])
        rid, start = rid[by], start[by]
        new = np.flatnonzero(np.concatenate([[True], rid[1:] != rid[:-1]]))
        ends = np.append(new[1:], len(rid))
        for a in range(0, len(new), 4096):
            some, last = new[a : a + 4096], ends[a : a + 4096]
            offsets = np.append(some, last[-1]) - some[0]
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(start[some[0] : last[-1]]))
            yield pa.RecordBatch.from_arrays([pa.array(rid[some]), lists], ["rid", "starts"])

    settled_ = rows.mapInArrow(trimmed(windows), MOVED).repartitionById(parts, F.col("part")).mapInArrow(trimmed(first), BLOCK)
    return settled_.repartitionById(parts, F.col("part")).mapInArrow(trimmed(by_row), "rid long, starts array<int>")


def repeated_words(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(rid, whole, starts)`` of written rows ``(rid, doc_id, text)``: starts of the windows that are removed, or ``whole`` where the row is
    a copy of a document with a smaller id."""
    if length < PERIOD:
        raise ValueError(f"windows have {PERIOD} words at least")
    spark = rows.sparkSession
    size = F.octet_length("text").cast("long")
    seen, seen_path = written(rows.where(size >= 2 * length - 1).select("rid", "doc_id", size.alias("size"), F.sha2("text", 256).alias("sha")), "cover-rows")
    total = seen.agg(F.sum("size")).first()[0] or 0
    heads = seen.groupBy("sha").agg(F.min("doc_id").alias("head"), F.count("*").alias("n")).where("n > 1 and head is not null").select("sha", "head")
    copies, copies_path = written(seen.join(heads, "sha").where("doc_id > head").select("rid"), "copies")
    standing = rows.where(size >= 2 * length - 1)
    parts = max(tasks_for(spark), -(-total // GATHERED))
    shared = shared_anchors(standing.select("rid", "text"), parts, length)
    shared = shared.join(copies, "rid", "left_anti")
    flags, flags_path = written(shared.groupBy("rid").agg(F.collect_list("start").alias("anchors")), "anchors")
    likely = marked(standing, flags).where("maybe").join(flags, "rid").select("rid", "doc_id", "text", "anchors")
    starts = removed_windows(likely, parts, length).select("rid", F.lit(False).alias("whole"), "starts")
    whole = copies.select("rid", F.lit(True).alias("whole"), F.array().cast("array<int>").alias("starts"))
    out, _ = written(starts.unionByName(whole), "windows")  # a row is in one of them at most
    drop_path(spark, seen_path, copies_path, flags_path)
    return out


def with_windows(rows: DataFrame, length: int) -> DataFrame:
    """Numbered rows ``(rid, text, row)`` with ``whole`` and ``starts``, null where nothing is removed; ``row`` has a ``doc_id``."""
    found = repeated_words(rows.select("rid", F.col("row").getField("doc_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), length)
    likely = marked(rows, found)
    met = likely.where("maybe").drop("maybe").join(found, "rid", "left")
    none = {"whole": F.lit(None).cast("boolean"), "starts": F.lit(None).cast("array<int>")}
    return met.unionByName(likely.where("not maybe").drop("maybe").withColumns(none))


def kept_words(text: str, whole: bool | None, starts: list[int] | None, length: int) -> tuple[int, list[bytes]]:
    """The number of words, and those that no removed window covers."""
    words = text.encode("utf-8", "surrogatepass").split()
    if whole and len(words) >= length:
        return len(words), []
    if not starts:
        return len(words), words
    kept, at = [], 0
    cut = merged([x for s in starts for x in (s, s + length)])
    for a, b in zip(cut[0::2], cut[1::2], strict=True):
        kept += words[at:a]
        at = b
    return len(words), kept + words[at:]


def removed_words(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)``; the digest is that of the kept words, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text, whole, starts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n, kept = kept_words(text, whole, starts, length)
                out.append((doc, n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            if out:
                d, n, r, h = zip(*out, strict=True)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(d, pa.int64()), "n_words": n, "n_removed": r, "kept_sha256": h})

    rows = with_windows(numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text"), length)
    rows = rows.select(F.col("row").getField("doc_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "whole", "starts")
    return rows.mapInArrow(trimmed(run), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs``, all columns, with the repeated words gone: a text that loses words is its kept words joined by one space, any other stays as
    it is. Null texts stay null."""
    held = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text"), F.struct(*[F.col(quoted(c)) for c in docs.columns if c != text_col]).alias("others"))
    found = with_windows(numbered(held, "text"), length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ts = []
            for text, whole, starts in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                n, kept = kept_words(text or "", whole, starts, length)
                ts.append(text if len(kept) == n else b" ".join(kept).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ts, pa.string())], ["row", "text"])

    picked = found.select(F.col("row").getField("others").alias("row"), "text", "whole", "starts")
    return unpacked(picked.mapInArrow(trimmed(run), picked.select("row", "text").schema), docs.columns, **{text_col: F.col("text")})


#: The same in DuckDB: each window as text.
SQL = """
with split as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents
), placed as (
  select doc_id, unnest(words) as word, generate_subscripts(words, 1) as i, len(words) as n from split
), windows as (
  select doc_id, word, i, n, case when i + 19 <= n then string_agg(word, ' ') over (partition by doc_id order by i rows between current row and 19 following) end as window_text
  from placed
), judged as (
  select doc_id, word, i, n, window_text is not null and row_number() over (partition by window_text order by doc_id, i) > 1 as again from windows
), covered as (
  select doc_id, word, i, n, max(case when again then 1 else 0 end) over (partition by doc_id order by i rows between 19 preceding and current row) = 1 as gone from judged
), summed as (
  select doc_id, cast(count(*) as bigint) as n_words, cast(count(*) filter (gone) as bigint) as n_removed, coalesce(string_agg(word, ' ' order by i) filter (not gone), '') as kept
  from covered group by doc_id
)
select doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from split left join summed using (doc_id)
"""
