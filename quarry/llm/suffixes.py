"""Suffix-array deduplication of byte strings that occur more than once.

The array is sparse: every 200-byte string has an anchor, the place of the least 100-byte hash inside it, whose bytes depend on
nothing but the string, and a suffix begins at each anchor. A unit is a suffix with the run of neighbouring strings that
have its anchor, so a unit knows at most 100 bytes before the anchor and 200 from it on. Strings are equal only if the bytes
from their anchors are, so equal strings stand in suffixes that sort side by side.

1. Rows are written once with a number. Anchors whose 100 bytes occur once in the corpus are set aside: units are dealt by
   the hash of these bytes, those that a task has met before are known to be shared and only one of them is dealt so.
2. The other suffixes are dealt into ranges by sampled splitters of their leading tokens (8 bytes each), ties by row and
   place, so that a passage that fills a third of the corpus spreads over as many ranges as it needs. There are as many
   ranges as the suffixes' bytes need.
3. Each range is sorted by multikey quicksort over its tokens. Neighbours with 100 bytes in common are one group; inside
   it, equal units repeat as a whole, and the strings of the others are compared byte by byte.
4. The first and the last group of a range may go on in the next one. Where a group does, each of its ranges sends one row with its
   distinct strings, by 128-bit hashes, and they are compared across all boundaries; a group of very many ranges is compared
   in as many parts as it needs.

Documents of equal bytes are removed whole; one of them stands for all in steps 2 to 4. Only step 4 trusts a hash,
of 128 bits; the hashes of step 1 can only keep a unit that step 3 then finds to be alone.

Texts are UTF-8; null is empty; texts below 200 bytes have nothing to remove. Matches never cross documents, and
strings are judged on the input. Repeated rows are documents of their own, equal ids included, so their texts match.
Rows with null ids are kept. Other columns, whatever their names, are ignored (``without_repeats`` keeps them).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, quoted, tasks_for, trimmed, unpacked, written
from .hashing import between, prefix
from .pii import may_be, word_filter

LENGTH, KMER = 200, 100
WINDOW = LENGTH - KMER + 1  # hashes inside a string
#: Bytes that are hashed together; places take the low 24 bits beside a hash, so twice as many are below 2**24.
BATCH_BYTES = 512 << 10
#: Bytes of a token, tokens of a suffix, and tokens that splitters look at: those that reach over the anchor's bytes.
TOKEN = 8
TOKENS, LEADING = LENGTH // TOKEN, KMER // TOKEN + 1
#: Bytes of text whose anchors one task gathers, bytes of suffixes in a range, and suffixes sampled for each range.
ANCHOR_BYTES, RANGE_BYTES, SAMPLED = 32 << 20, 3 << 20, 64
#: Bytes of a stretch that is drawn as one, and suffixes that are drawn at most (some 110 bytes each, on the driver).
SAMPLED_BYTES, MOST_SAMPLED = 4096, 1 << 20
#: Ranges of a group whose strings are compared together.
TOGETHER = 16

RECORD = "part int, stretch binary, left int, rid long, first int"
#: Repeated stretches of a row; or the strings of a group at a range's edge.
FOUND = "rid long, spans array<int>, anchor binary, part int, rids array<long>, places array<int>, h0 array<long>, h1 array<long>"


def sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    """The least value of each ``width`` neighbours, by doubling."""
    out, have = h, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def stretches(raws: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """(number, offset, bytes) of the texts, in groups below 2**24 bytes; a very long text comes in overlapping stretches."""
    group, size = [], 0
    for number, raw in enumerate(raws):
        if len(raw) < LENGTH:
            continue
        for a in range(0, len(raw) - LENGTH + 1, BATCH_BYTES):
            part = raw[a : a + BATCH_BYTES + LENGTH - 1]
            if group and size + len(part) > 2 * BATCH_BYTES:
                yield group
                group, size = [], 0
            group.append((number, a, part))
            size += len(part)
    if group:
        yield group


class Units:
    """The units of a group of stretches: arrays of text number, first string, number of strings, place and hash of the anchor."""

    def __init__(self, group: list[tuple[int, int, bytes]]):
        self.raw = b"".join([p for _, _, p in group])
        data = np.frombuffer(self.raw, np.uint8)
        sizes = np.array([len(p) for _, _, p in group])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        at = np.arange(len(data) - KMER + 1)
        kmers = between(prefix(data), at, at + KMER)
        low = np.uint64((1 << 24) - 1)
        owner = (sliding_least((kmers & ~low) | at.astype(np.uint64), WINDOW) & low).astype(np.int64)
        owner = owner[: len(data) - LENGTH + 1]
        part = np.repeat(np.arange(len(group)), sizes)[: len(owner)]
        place = np.arange(len(owner))
        place = place[place <= ends[part] - LENGTH]  # strings that stay inside their text
        part = part[place]
        owner, tied = self._kept(owner[place], part, place, kmers)
        new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (part[1:] != part[:-1])]))
        self.start = place[new]
        self.count = np.diff(np.append(new, len(place)))
        self.number = np.array([n for n, _, _ in group])[part[new]]
        offset = np.array([a for _, a, _ in group]) - starts
        self.first = self.start + offset[part[new]]
        anchor = owner[new]
        self.hash = kmers[anchor]
        self.left = anchor - self.start
        self.tied = tied[new]

    @staticmethod
    def _kept(owner: np.ndarray, part: np.ndarray, place: np.ndarray, kmers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where equal 100 bytes come more than once in a string, the last of them is the anchor for as long as the strings hold it, so that runs
        of one character or line have few units. Equal strings may then differ in their anchor's place, not in its bytes, and stand in
        one unit: the second array says where that may be."""
        value = kmers[owner]
        new = np.ones(len(owner), bool)
        new[1:] = (value[1:] != value[:-1]) | (part[1:] != part[:-1])
        moved = np.zeros(len(owner), bool)
        moved[1:] = ~new[1:] & (owner[1:] != owner[:-1])
        tied = np.zeros(len(owner), bool)
        starts, run = np.append(np.flatnonzero(new), len(owner)), np.cumsum(new) - 1
        for r in np.unique(run[moved]).tolist():
            a, b = starts[r], starts[r + 1]
            first, last = place[a], place[b - 1]
            tied[a:b] = True
            again = first + np.flatnonzero(kmers[first : last + WINDOW] == value[a])
            p = first
            while p <= last:
                held = again[np.searchsorted(again, p + WINDOW - 1, "right") - 1]
                owner[a + p - first : a + min(held, last) - first + 1] = held
                p = held + 1
        return owner, tied


def shared_anchors(rows: DataFrame, parts: int) -> DataFrame:
    """``(rid, first)`` of the units whose anchor's bytes occur again, from ``(rid, text)``."""

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rids = b.column(0).to_numpy()
            for group in stretches([t.encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()]):
                u = Units(group)
                _, once, of, n = np.unique(u.hash, return_index=True, return_inverse=True, return_counts=True)
                shared = (n > 1) | (np.bincount(of, u.tied) > 0)
                known = shared[of]
                witness = np.zeros(len(known), bool)
                witness[once[shared]] = True
                hashes, rid, first = u.hash.view(np.int64), rids[u.number], u.first.astype(np.int32)
                place = (rid * 31 + first) % parts  # those that are known to be shared go anywhere
                part = np.where(known & ~witness, place, hashes % parts).astype(np.int32)
                state = np.where(witness, 1, np.where(known, 2, 0)).astype(np.int8)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (part, hashes, rid, first, state)], ["part", "hash", "rid", "first", "state"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            state = b.column(4).to_numpy()
            sure = state == 2
            if sure.any():
                yield b.select([2, 3]).filter(pa.array(sure))
            held.append(b.filter(pa.array(~sure)))
        if not held:
            return
        got = pa.Table.from_batches(held)
        hashes, state = got["hash"].to_numpy(), got["state"].to_numpy()
        _, of, n = np.unique(hashes, return_inverse=True, return_counts=True)
        shared = (n[of] > 1) | (state == 1)
        yield from got.select(["rid", "first"]).filter(pa.array(shared)).to_batches(max_chunksize=100_000)

    dealt = rows.mapInArrow(trimmed(units), "part int, hash long, rid long, first int, state byte").repartitionById(parts, F.col("part"))
    return dealt.mapInArrow(trimmed(again), "rid long, first int")


def tokens_of(raw: bytes, starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` tokens from each start, in the order of their bytes; what lies beyond an end is zero."""
    data = np.frombuffer(raw + bytes(n * TOKEN), np.uint8)
    out = np.empty((n, len(starts)), np.uint64)
    step = np.arange(TOKEN)
    for k in range(n):
        at = starts + k * TOKEN
        word = data[at[:, None] + step]
        word[(at[:, None] + step) >= ends[:, None]] = 0
        out[k] = word.view(">u8")[:, 0]
    return out


def weights(raw: bytes, starts: np.ndarray, ends: np.ndarray, rid: np.ndarray, first: np.ndarray) -> np.ndarray:
    """What splitters are compared with: the leading tokens, row and place of each suffix, as one string of bytes."""
    table = np.vstack([tokens_of(raw, starts, ends, LEADING), rid.astype(np.uint64), first.astype(np.uint64)])
    return np.ascontiguousarray(table.T).astype(">u8").view(f"S{(LEADING + 2) * TOKEN}")[:, 0]


def suffixes(rows: DataFrame, cuts: np.ndarray | None = None) -> DataFrame:
    """Records of the flagged units of ``(rid, text, firsts)``; ``part`` is the range of each by the splitters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rids, flags = b.column(0).to_numpy(), b.column(2)
            offsets = flags.offsets.to_numpy()
            number = np.repeat(np.arange(b.num_rows), np.diff(offsets))
            wanted = np.sort(number << 40 | flags.values.to_numpy()[offsets[0] : offsets[-1]].astype(np.int64))
            for group in stretches([t.encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()]):
                u = Units(group)
                name = u.number.astype(np.int64) << 40 | u.first
                mine = np.flatnonzero(np.isin(name, wanted, assume_unique=True))
                if not len(mine):
                    continue
                rid, first = rids[u.number[mine]], u.first[mine].astype(np.int32)
                start, end = u.start[mine], u.start[mine] + u.count[mine] - 1 + LENGTH
                part = np.zeros(len(mine), np.int32)
                if cuts is not None and len(cuts):
                    part = np.searchsorted(cuts, weights(u.raw, start + u.left[mine], end, rid, first), "right").astype(np.int32)
                bytes_ = pa.array([u.raw[x:y] for x, y in zip(start.tolist(), end.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(part), bytes_, pa.array(u.left[mine].astype(np.int32)), pa.array(rid), pa.array(first)], ["part", "stretch", "left", "rid", "first"])

    return rows.mapInArrow(trimmed(run), RECORD)


def splitters(rows: DataFrame, flagged: int, n: int) -> np.ndarray:
    """``n - 1`` splitters from a sample of some ``SAMPLED`` suffixes for each range, ``MOST_SAMPLED`` in all.

    What is drawn are stretches of ``SAMPLED_BYTES``, not rows, so that a long row gives its share. A draw that finds nothing is repeated with
    a larger share.
    """
    none = np.zeros(0, f"S{(LEADING + 2) * TOKEN}")
    if n < 2 or not flagged:
        return none
    share = min(1.0, min(SAMPLED * n, MOST_SAMPLED) / flagged)
    while True:
        drawn = F.filter("firsts", lambda x: F.pmod(F.xxhash64("rid", F.floor(x / SAMPLED_BYTES)), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
        sample = rows.withColumn("firsts", drawn).where(F.size("firsts") > 0)
        got = suffixes(sample).select(F.expr(f"substring(stretch, left + 1, {LEADING * TOKEN})").alias("lead"), "rid", "first").toArrow()
        if got.num_rows or share == 1.0:
            break
        share = min(1.0, share * 8)
    if not got.num_rows:
        return none
    lead = got["lead"].to_pylist()
    ends = np.cumsum([len(x) for x in lead])
    table = np.sort(weights(b"".join(lead), ends - [len(x) for x in lead], ends, got["rid"].to_numpy(), got["first"].to_numpy()))
    return np.unique(table[[len(table) * k // n for k in range(1, n)]])


def multikey_quicksort(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows by their tokens: three-way partition by one token, equal rows go on with the next.

    Small parts are sorted outright. The stack holds parts still to be ordered, so depth is no matter.
    """
    n = len(columns[0])
    order = np.arange(n)
    stack = [(0, n, 0)]
    while stack:
        a, b, depth = stack.pop()
        if b - a < 2 or depth == len(columns):
            continue
        rows = order[a:b]
        if b - a <= 4096:
            order[a:b] = rows[np.lexsort([columns[d][rows] for d in range(len(columns) - 1, depth - 1, -1)])]
            continue
        v = columns[depth][rows]
        sample = np.sort(v[:: len(v) // 255])
        pivot = sample[len(sample) // 2]
        less, equal = rows[v < pivot], rows[v == pivot]
        order[a:b] = np.concatenate([less, equal, rows[v > pivot]])
        m, e = a + len(less), a + len(less) + len(equal)
        stack += [(a, m, depth), (m, e, depth + 1), (e, b, depth)]
    return order


def common_bytes(tokens: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """How many leading bytes each suffix in the order has in common with the one before it; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    going = np.ones(len(order), bool)
    going[:1] = False
    for t in tokens:
        d = t[order]
        d = d ^ np.concatenate([d[:1], d[:-1]])
        lead = np.full(len(d), TOKEN)
        for k in range(TOKEN):  # bytes before the first that differs
            lead = np.where((lead == TOKEN) & ((d >> np.uint64(8 * (TOKEN - 1 - k))) & np.uint64(255) != 0), k, lead)
        out += np.where(going, lead, 0)
        going &= lead == TOKEN
    size = sizes[order]
    return np.minimum(out, np.minimum(size, np.concatenate([size[:1], size[:-1]])))


def same_strings(raw: bytes, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the strings that begin at a and at b are equal, byte by byte."""
    data = np.frombuffer(raw, np.uint8)
    out = np.ones(len(a), bool)
    for k in range(0, len(a), 50_000):
        x, y, alike = a[k : k + 50_000], b[k : k + 50_000], np.ones(len(a[k : k + 50_000]), bool)
        for off in range(0, LENGTH, 40):
            step = np.arange(off, off + 40)
            alike &= (data[x[:, None] + step] == data[y[:, None] + step]).all(1)
        out[k : k + 50_000] = alike
    return out


def tied(stretch: bytes, left: int) -> bool:
    """Whether the anchor's bytes come twice in the unit; if not, its strings all differ."""
    anchor = stretch[left : left + KMER]
    return stretch.find(anchor) < left or stretch.find(anchor, left + 1) > 0


def compare_range(stretch: list[bytes], left: np.ndarray, rid: np.ndarray, first: np.ndarray) -> Iterator[tuple]:
    """Sorts the suffixes of a range and compares neighbours: ``(rid, spans)`` of what repeats, and ``(anchor, rids, places, h0, h1)`` of the
    distinct strings of the groups at its edges."""
    n = len(stretch)
    sizes = np.fromiter(map(len, stretch), np.int64, n)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    raw = b"".join(stretch)
    tokens = tokens_of(raw, starts + left, ends, TOKENS)
    order = multikey_quicksort([*tokens, rid, first])
    group = np.cumsum(common_bytes(tokens, sizes - left, order) < KMER) - 1
    of_row = np.empty(n, np.int64)
    of_row[order] = group
    members = np.bincount(group)
    edge = (of_row == 0) | (of_row == group[-1])
    # units that are equal as a whole
    kinds: dict[tuple[int, bytes], int] = {}
    kind = np.fromiter((kinds.setdefault((x, s), len(kinds)) for x, s in zip(left.tolist(), stretch, strict=True)), np.int64, n)
    copies = np.bincount(kind)
    _, one = np.unique(kind, return_index=True)  # a unit of each kind
    different = np.bincount(of_row[one], minlength=len(members))  # kinds in each group
    whole = copies[kind] > 1
    for k in np.flatnonzero(whole).tolist():
        yield int(rid[k]), [int(first[k]), int(first[k] + sizes[k])]
    # strings of the kinds that have company, may have it in another range, or may repeat their own
    looked = one[(different[of_row[one]] > 1) | edge[one] | np.fromiter((tied(stretch[k], int(left[k])) for k in one.tolist()), bool, len(one))]
    if not len(looked):
        return
    count = sizes[looked] - LENGTH + 1
    unit = np.repeat(np.arange(len(looked)), count)
    at = np.arange(len(unit)) - np.repeat(np.cumsum(count) - count, count) + starts[looked][unit]
    data = np.frombuffer(raw, np.uint8)
    sums = prefix(data)
    h = between(sums, at, at + LENGTH)
    del sums
    by = np.argsort(h, kind="stable")
    new = np.concatenate([[True], h[by][1:] != h[by][:-1]])
    run = np.cumsum(new) - 1
    head = at[by][new][run]
    alike = np.ones(len(at), bool)
    check = np.flatnonzero(~new)
    alike[check] = same_strings(raw, at[by[check]], head[check])
    repeated = np.zeros(len(at), bool)
    repeated[by] = np.bincount(run, minlength=1)[run] > 1
    leader = np.zeros(len(at), bool)  # one string of each content
    leader[by[new]] = True
    for r in np.unique(run[~alike]).tolist():  # equal hashes of different strings: told apart by the strings themselves
        of: dict[bytes, list[int]] = {}
        for k in by[run == r].tolist():
            of.setdefault(raw[at[k] : at[k] + LENGTH], []).append(k)
        for ks in of.values():
            repeated[ks], leader[ks] = len(ks) > 1, False
            leader[ks[0]] = True
    again = repeated | whole[looked][unit]
    sent = leader & edge[looked][unit]
    place = first[looked][unit] + at - starts[looked][unit]
    bounds = np.concatenate([[0], np.cumsum(count)]).tolist()
    for k, row in enumerate(looked.tolist()):
        a, b = bounds[k], bounds[k + 1]
        mine = place[a:b][again[a:b]]
        if len(mine) and not whole[row]:
            gap = np.flatnonzero(np.diff(mine) > 1)
            yield int(rid[row]), np.stack([mine[np.concatenate([[0], gap + 1])], mine[np.concatenate([gap, [len(mine) - 1]])] + LENGTH], 1).ravel().tolist()
    if sent.any():
        other = prefix(data, 1)
        for g in {0, int(group[-1])}:
            out = np.flatnonzero(sent & (of_row[looked][unit] == g))
            if len(out):
                row = looked[unit[out[0]]]
                start = int(starts[row] + left[row])
                anchor = hashlib.blake2b(raw[start : start + KMER], digest_size=16).digest()
                yield anchor, rid[looked][unit[out]], place[out], h[out].view(np.int64), between(other, at[out], at[out] + LENGTH).view(np.int64)


def _found(rows: list[tuple], part: int) -> pa.RecordBatch:
    spans, edges = [r for r in rows if len(r) == 2], [r for r in rows if len(r) > 2]
    none, nothing = [None] * len(spans), [None] * len(edges)
    cols = [
        pa.array([r[0] for r in spans] + nothing, pa.int64()), pa.array([r[1] for r in spans] + nothing, pa.list_(pa.int32())), pa.array(none + [r[0] for r in edges], pa.binary()), pa.array([part] * len(rows), pa.int32()),
        *[pa.array(none + [r[k] for r in edges], pa.list_(t)) for k, t in ((1, pa.int64()), (2, pa.int32()), (3, pa.int64()), (4, pa.int64()))],
    ]
    return pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in FOUND.split(", ")])


def across_ranges(found: DataFrame) -> DataFrame:
    """``(rid, spans)`` of strings that stand in several ranges of one group."""
    edges = found.where("anchor is not null").select("anchor", "part", "rids", "places", "h0", "h1")
    several = edges.groupBy("anchor").agg(F.count_distinct("part").alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / TOGETHER).cast("int")).drop("n")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for anchor, parts, rids, places, h0, h1 in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), *(b.column(k) for k in range(2, 6)), strict=True):
                rids, places, h0, h1 = (x.values.to_numpy() for x in (rids, places, h0, h1))
                of = (h0 % parts).astype(np.int64)
                for k in range(parts):
                    at = of == k
                    yield pa.RecordBatch.from_arrays([pa.array([anchor], pa.binary()), pa.array([k], pa.int32()), *[pa.array([x[at]], t) for x, t in ((rids, pa.list_(pa.int64())), (places, pa.list_(pa.int32())), (h0, pa.list_(pa.int64())), (h1, pa.list_(pa.int64())))]], ["anchor", "k", "rids", "places", "h0", "h1"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, []

        def ended():
            rids, places, h0, h1 = (np.concatenate([x[k] for x in held]) for k in range(4))
            by = np.lexsort((h1, h0))
            same = (h0[by][1:] == h0[by][:-1]) & (h1[by][1:] == h1[by][:-1])
            again = np.zeros(len(by), bool)
            again[by[1:][same]] = again[by[:-1][same]] = True
            for a in range(0, int(again.sum()), 50_000):
                at = np.flatnonzero(again)[a : a + 50_000]
                spans = np.stack([places[at], places[at] + LENGTH], 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(rids[at]), pa.array(list(spans), pa.list_(pa.int32()))], ["rid", "spans"])

        for b in batches:
            for anchor, k, *cols in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), *(b.column(j) for j in range(2, 6)), strict=True):
                if (anchor, k) != name:
                    if held:
                        yield from ended()
                    name, held = (anchor, k), []
                held.append([c.values.to_numpy() for c in cols])
        if held:
            yield from ended()

    parts = edges.join(several, "anchor").select("anchor", "parts", "rids", "places", "h0", "h1").mapInArrow(split, "anchor binary, k int, rids array<long>, places array<int>, h0 array<long>, h1 array<long>")
    return parts.repartition(tasks_for(found.sparkSession), "anchor", "k").sortWithinPartitions("anchor", "k").mapInArrow(compare, "rid long, spans array<int>")


def marked(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rows`` with ``maybe``: false for those whose number is surely not among the wanted. A bitmap of fixed size says so; from some ten
    million wanted rows on it is full and spares nothing."""
    bitmap, _ = written(word_filter(wanted.select(F.xxhash64("rid").alias("term"))), "row-filter")
    return rows.withColumn("bitmap", bitmap.scalar()).withColumn("maybe", may_be(F.xxhash64("rid"), F.col("bitmap"))).drop("bitmap")


def repeated_spans(rows: DataFrame) -> DataFrame:
    """``(rid, spans)`` of written rows ``(rid, text)``: pairs of byte offsets, start and end in turn, unordered, that cover all
    repeated strings of a row."""
    spark = rows.sparkSession
    size = F.octet_length("text").cast("long")
    seen, seen_path = written(rows.select("rid", size.alias("size"), F.sha2("text", 256).alias("sha")).where(F.col("size") >= LENGTH), "suffix-rows")
    total = seen.agg(F.sum("size")).first()[0] or 0
    groups = seen.groupBy("sha").agg(F.min("rid").alias("head"), F.count("*").alias("n")).where("n > 1").select("sha", "head")
    copies, copies_path = written(seen.join(groups, "sha").select("rid", "size", (F.col("rid") == F.col("head")).alias("stands")), "copies")
    shared = shared_anchors(rows.where(size >= LENGTH), max(tasks_for(spark), -(-total // ANCHOR_BYTES)))
    shared = shared.join(copies.where("not stands").select("rid"), "rid", "left_anti")
    flags, flags_path = written(shared.groupBy("rid").agg(F.collect_list("first").alias("firsts")), "shared")
    flagged = flags.agg(F.sum(F.size("firsts"))).first()[0] or 0
    n = max(tasks_for(spark), -(-flagged * (LENGTH + KMER // 2) // RANGE_BYTES))
    joined = marked(rows, flags).where("maybe").join(flags, "rid").select("rid", "text", "firsts")
    cuts = splitters(joined, flagged, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)  # RANGE_BYTES on average
        if not held:
            return
        got = pa.Table.from_batches(held)
        del held
        part = got["part"][0].as_py()
        found: list[tuple] = []
        for x in compare_range(got["stretch"].to_pylist(), got["left"].to_numpy().astype(np.int64), got["rid"].to_numpy(), got["first"].to_numpy().astype(np.int64)):
            found.append(x)
            if len(found) == 20_000:
                yield _found(found, part)
                found = []
        if found:
            yield _found(found, part)

    found, found_path = written(suffixes(joined, cuts).repartitionById(n, F.col("part")).mapInArrow(trimmed(run), FOUND), "found")
    whole = copies.select("rid", F.array(F.lit(0), F.col("size").cast("int")).alias("spans"))
    spans = found.where("rid is not null").select("rid", "spans").unionByName(across_ranges(found)).unionByName(whole)
    spans, _ = written(spans.groupBy("rid").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")
    drop_path(spark, seen_path, copies_path, flags_path, found_path)
    return spans


def merged(flat: list[int]) -> list[int]:
    """Spans in order, those that touch or overlap as one."""
    out: list[int] = []
    for a, b in sorted(zip(flat[0::2], flat[1::2], strict=True)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += (a, b)
    return out


def numbered(docs: DataFrame, text_col: str) -> DataFrame:
    """``(rid, text, row)``, written once: a number, the text, and all other columns as a struct."""
    others = [F.col(quoted(c)) for c in docs.columns if c != text_col] or [F.lit(0).alias("none")]
    rows, _ = written(docs.select(F.monotonically_increasing_id().alias("rid"), F.col(quoted(text_col)).cast("string").alias("text"), F.struct(*others).alias("row")), "rows")
    return rows


def with_spans(rows: DataFrame) -> DataFrame:
    """Numbered rows with their spans, null where nothing repeats. Only rows that may have spans meet them."""
    spans = repeated_spans(rows.select("rid", F.coalesce("text", F.lit("")).alias("text")))
    likely = marked(rows, spans)
    met = likely.where("maybe").drop("maybe").join(spans, "rid", "left")
    return met.unionByName(likely.where("not maybe").drop("maybe").withColumn("spans", F.lit(None).cast("array<int>")))


def removed_bytes(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text, spans in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                cut = merged(spans or [])
                kept, at = [], 0
                for x, y in zip(cut[0::2], cut[1::2], strict=True):
                    kept.append(raw[at:x])
                    at = y
                kept.append(raw[at:])
                left = b"".join(kept)
                out.append((doc, len(raw), len(raw) - len(left), len(cut) // 2, hashlib.sha256(left).hexdigest()))
            if out:
                d, n, r, s, h = zip(*out, strict=True)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(d, pa.int64()), "n_bytes": n, "n_removed": r, "n_spans": s, "kept_sha256": h})

    rows = with_spans(numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text"))
    rows = rows.select(F.col("row").getField("doc_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "spans")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def character_spans(text: str, cut: list[int]) -> str:
    """The text without the spans; a character goes only if all its bytes do."""
    raw = text.encode("utf-8", "surrogatepass")
    kept, at = [], 0
    for x, y in zip(cut[0::2], cut[1::2], strict=True):
        while x < y and raw[x] & 0xC0 == 0x80:  # begins inside a character: that one stays
            x += 1
        while y > x and y < len(raw) and raw[y] & 0xC0 == 0x80:
            y -= 1
        kept.append(raw[at:x])
        at = y
    kept.append(raw[at:])
    return b"".join(kept).decode("utf-8", "surrogatepass")


def without_repeats(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs``, all columns, with repeated passages removed from the text (whole characters) and ``n_chars`` set anew.

    Null texts stay null.
    """
    found = with_spans(numbered(docs, text_col)).select("row", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ts = [character_spans(t, merged(s)) if t and s else t for t, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ts, pa.string())], ["row", "text"])

    out = found.mapInArrow(run, found.select("row", "text").schema)
    changed = {text_col: F.col("text")}
    if chars_col in docs.columns:
        changed[chars_col] = F.length("text").cast(docs.schema[chars_col].dataType)
    return unpacked(out, docs.columns, **changed)
