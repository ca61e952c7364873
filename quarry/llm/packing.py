"""Best-fit packing by a grouping genetic algorithm on islands.

Pieces of at most 4096 tokens are dealt by a hash into shards of bounded size. Each shard is packed by several
islands: a population begins with best-fit decreasing and randomised best-fit packings; crossover
injects whole well-filled bins of one parent into the other, drops the bins that hold the same pieces
again, and puts the displaced pieces back: first by replacing pieces of a bin where that fills it better, then by best fit,
longest first. Between epochs each island's elite migrates to its neighbour. An island stops once its packing has as few
bins as a lower bound allows. The best packing of a shard counts; pieces of bins that stayed open are dealt
anew over fewer shards, until one shard is left or no bin is open. ``report`` says what the search gained in each shard.

Null and empty texts are one piece of one token (the end id). Rows with null ids and repeated rows are pieces like any
other; other columns, whatever their names, are ignored. Pieces without an id are dealt by their place in the written table, all
others by id, number, length and checksum.
"""

from __future__ import annotations

import os
import random
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_path, texts, trimmed, written

CAPACITY = 4096
END_ID = 1
#: Pieces of a shard, islands of a shard, epochs between migrations, packings of an island, children of an epoch at most, and
#: without a better one before it ends.
SHARD_PIECES, ISLANDS, EPOCHS, POPULATION, CHILDREN, PATIENCE = 8192, 2, 2, 6, 100, 25
#: A bin is full, and settled, from this share of its capacity on.
SETTLED = 0.999

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"
COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


#: Bytes of words and their ids in a generation of those that a Python worker keeps.
BYTES_KEPT = 40 << 20
#: Chunks that are one word of the tokenizer, or one and a run of marks: letters whose lower case is one letter, in its simple form,
#: and marks that begin nothing else for the tokenizer.
LETTERS = "A-Za-z\\x{C0}-\\x{D6}\\x{D8}-\\x{F6}\\x{F8}-\\x{12F}\\x{131}-\\x{148}\\x{14A}-\\x{17E}"
MARKS = r".,;:!?*$%&#+=~@()\[\]{}"
#: Bytes of text that are encoded together.
BATCH_BYTES = 4 << 20


class TextIds:
    """Ids of texts, as unsigned 32-bit numbers.

    The tokenizer drops white space and no token spans it, so what stands between spaces is independent. A word and the
    end mark behind it are separate words of the tokenizer as well. Of the distinct words of a batch those not met before
    are encoded, all at once; the tokens that close a word tell them apart. Ids are then gathered for all places. Words
    are kept in two generations of bounded size.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocabulary = self.tok.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0

    def _each(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        if not words:
            return []
        ids = np.array(self.tok.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = (4 * (np.flatnonzero(self.closes[ids]) + 1)).tolist()
        if len(ends) != len(words):
            raise ValueError("words and tokens that close one differ in number")
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _known(self, texts: list[str], encode) -> list[bytes]:
        """The ids of each text; those not kept are encoded together."""
        found = list(map(self.young.get, texts))
        new = [t for t, x in zip(texts, found, strict=True) if x is None]
        if not new:
            return found
        fresh = list(map(self.old.get, new))
        unseen = [t for t, x in zip(new, fresh, strict=True) if x is None]
        learnt = iter(encode(unseen))
        fresh = [next(learnt) if x is None else x for x in fresh]
        self.young.update(zip(new, fresh, strict=True))
        self.size += sum(map(len, new)) + sum(map(len, fresh)) + 180 * len(new)
        if self.size > BYTES_KEPT:
            self.old, self.young, self.size = self.young, {}, 0
        fresh = iter(fresh)
        return [next(fresh) if x is None else x for x in found]

    def documents(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each closed by the end id, and where each text's ids end."""
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        chunks = coded.dictionary
        plain = pc.match_substring_regex(chunks, f"^[{LETTERS}]+[{MARKS}]*$")
        low = pc.utf8_lower(chunks.filter(plain))
        split = pc.extract_regex(low, f"^(?P<word>[^{MARKS}]+)(?P<run>[{MARKS}]*)$")
        words, runs = (pc.struct_field(split, k).dictionary_encode() for k in (0, 1))
        words_known = self._known(words.dictionary.to_pylist(), self._words)
        runs_known = self._known(runs.dictionary.to_pylist(), self._each)
        units = [*words_known, *runs_known, *self._known(chunks.filter(pc.invert(plain)).to_pylist(), self._each), b"", END_ID.to_bytes(4, "little")]
        pool = np.frombuffer(b"".join(units), "<u4")
        sizes = np.fromiter(map(len, units), np.int64, len(units)) // 4
        starts = np.cumsum(sizes) - sizes
        end = len(units) - 1
        is_plain = plain.to_numpy(zero_copy_only=False)
        first, second = np.empty(len(chunks), np.int64), np.full(len(chunks), end - 1)
        first[is_plain] = words.indices.to_numpy()
        first[~is_plain] = len(words_known) + len(runs_known) + np.arange(len(chunks) - int(is_plain.sum()))
        second[is_plain] = len(words_known) + runs.indices.to_numpy()
        at = coded.indices.to_numpy()
        offsets = lists.offsets.to_numpy()
        last = offsets[1:] - offsets[0]
        which = np.insert(np.stack([first[at], second[at]], 1).ravel(), 2 * last, end)  # an end id behind each text
        count = sizes[which]
        upto = np.cumsum(count)
        flat = pool[np.arange(upto[-1] if len(upto) else 0) + np.repeat(starts[which] - (upto - count), count)]
        return flat, upto[2 * last + np.arange(len(last))]


_loaded: dict[str, TextIds] = {}


def ids_of(path: str) -> TextIds:
    """The tokenizer, kept for all tasks of a Python worker."""
    if path not in _loaded:
        _loaded[path] = TextIds(path)
    return _loaded[path]


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches put together up to a number of bytes."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(x.nbytes for x in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Each document's ids and the end id, cut into pieces of ``capacity`` tokens; the last may be shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ids_of(tokenizer)
        for b in gathered(batches, BATCH_BYTES):
            ids, ends = encoder.documents(b.column(1))
            raw = memoryview(ids).cast("B")
            first = np.concatenate([[0], ends[:-1]])
            number = -(-(ends - first) // capacity)  # pieces of each text
            row = np.repeat(np.arange(b.num_rows), number)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
            start = first[row] + piece * capacity
            length = np.minimum(ends[row] - start, capacity)
            sums = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(start.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(length), pa.array(sums, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts(docs).mapInArrow(trimmed(run), PIECES)


class Packing:
    """Bins of item numbers, with their free room."""

    def __init__(self, bins: list[list[int]], fills: list[int], capacity: int):
        self.bins, self.fills, self.capacity = bins, fills, capacity

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first, then the squared fill, which prefers few nearly empty bins over many half full ones."""
        return -len(self.bins), sum([(f / self.capacity) ** 2 for f in self.fills])

    def assignment(self, n: int) -> list[int]:
        out = [0] * n
        for b, items in enumerate(self.bins):
            for i in items:
                out[i] = b
        return out


def of_assignment(a: list[int], lengths: list[int], capacity: int) -> Packing:
    bins: list[list[int]] = [[] for _ in range(max(a, default=-1) + 1)]
    for i, b in enumerate(a):
        bins[b].append(i)
    bins = [b for b in bins if b]
    return Packing(bins, [sum([lengths[i] for i in b]) for b in bins], capacity)


def best_fit(items: list[int], lengths: list[int], bins: list[list[int]], fills: list[int], capacity: int) -> Packing:
    """Puts each item into the fullest bin that has room. Bins by free room; one bit for each room that occurs."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for b, f in enumerate(fills):
        room[capacity - f].append(b)
        mask |= 1 << (capacity - f)
    for i in items:
        n = lengths[i]
        above = mask >> n
        if above:
            free = n + (above & -above).bit_length() - 1
            b = room[free].pop()
            if not room[free]:
                mask ^= 1 << free
            bins[b].append(i)
        else:
            free, b = capacity, len(bins)
            bins.append([i])
            fills.append(0)
        fills[b] += n
        room[free - n].append(b)
        mask |= 1 << (free - n)
    return Packing(bins, fills, capacity)


def least_bins(lengths: list[int], capacity: int) -> int:
    """A bound that no packing is below: by the sum, by pieces that cannot share a bin, and by how many fit beside each other.

    For every length k up to half a bin, pieces above ``capacity - k`` are alone, those above one half have a bin each, and
    what the shorter ones (k or more) need beyond the room beside those takes further bins.
    """
    x = np.sort(np.asarray(lengths, np.int64))
    if not len(x):
        return 0
    upto = np.concatenate([[0], np.cumsum(x)])
    half = int(np.searchsorted(x, capacity // 2, "right"))
    best = -(-int(upto[-1]) // capacity)
    k = np.concatenate([[0], np.unique(x[:half])])
    low, high = np.searchsorted(x, k, "left"), np.searchsorted(x, capacity - k, "right")
    high = np.maximum(high, half)
    room = (high - half) * capacity - (upto[high] - upto[half])
    best = max(best, int((len(x) - half + np.maximum(0, -(-(upto[half] - upto[np.minimum(low, half)] - room) // capacity))).max()))
    for m in range(2, 9):  # pieces above capacity / (m + 1): at most m to a bin
        best = max(best, -(-int((x * (m + 1) > capacity).sum()) // m))
    return best


#: Bins with more pieces are not searched for replacements: with that many, best fit leaves little room.
SEARCHED = 16


def replace(bins: list[list[int]], fills: list[int], displaced: list[int], lengths: list[int], capacity: int, order: list[int]) -> list[int]:
    """Puts displaced pieces into bins in exchange for one or two that leave more room unused; returns what is displaced then.

    Each exchange fills a bin better, so the displaced pieces become shorter and the search ends.
    """
    out = sorted((lengths[i], i) for i in displaced)
    for b in order:
        items = bins[b]
        if len(items) > SEARCHED:
            continue
        while out:
            free, best, gone, at = capacity - fills[b], 0, (), -1
            if not free:
                break
            ways = [((), 0)] + [((i,), lengths[i]) for i in items]
            if len(items) <= 6:
                ways += [((i, j), lengths[i] + lengths[j]) for k, i in enumerate(items) for j in items[k + 1 :]]
            for removed, size in ways:
                k = bisect_right(out, (size + free, 1 << 60)) - 1
                if k >= 0 and out[k][0] - size > best:
                    best, gone, at = out[k][0] - size, removed, k
            if not best:
                break
            _, new = out.pop(at)
            for i in gone:
                items.remove(i)
                insort(out, (lengths[i], i))
            items.append(new)
            fills[b] += best
    return [i for _, i in out]


def crossover(into: Packing, donor: Packing, lengths: list[int], rnd: random.Random) -> Packing:
    """Well-filled bins of the donor replace what they overlap; some bins with room are broken up too."""
    cap = donor.capacity
    good = sorted(range(len(donor.bins)), key=lambda b: -donor.fills[b])
    good = good[: max(1, len(good) // 2)]
    chosen = [b for b in good if rnd.random() < 0.3]
    held = {i for b in chosen for i in donor.bins[b]}
    loose = sorted(range(len(into.bins)), key=lambda b: into.fills[b])
    broken = set(loose[:2]) | {b for b in loose[: len(loose) // 3] if rnd.random() < 0.05}
    bins = [list(donor.bins[b]) for b in chosen]
    fills = [donor.fills[b] for b in chosen]
    displaced = []
    for b, items in enumerate(into.bins):
        if b in broken or not held.isdisjoint(items):
            displaced += [i for i in items if i not in held]
        else:
            bins.append(list(items))
            fills.append(into.fills[b])
    order = list(range(len(bins)))
    rnd.shuffle(order)
    displaced = replace(bins, fills, displaced, lengths, cap, order)
    displaced.sort(key=lambda i: (-lengths[i], i))
    return best_fit(displaced, lengths, bins, fills, cap)


def evolve(lengths: list[int], packings: list[Packing], rnd: random.Random, capacity: int) -> list[Packing]:
    """An epoch on one island; returns its population, elite first."""
    n = len(lengths)
    least = least_bins(lengths, capacity)
    if not packings:
        packings = [best_fit(sorted(range(n), key=lambda i: (-lengths[i], i)), lengths, [], [], capacity)]
        while len(packings) < POPULATION and len(packings[0].bins) > least:  # nearly descending: lengths are blurred
            blurred = [-x * rnd.uniform(0.8, 1.25) for x in lengths]
            packings.append(best_fit(sorted(range(n), key=blurred.__getitem__), lengths, [], [], capacity))
    idle, best = 0, None
    for _ in range(CHILDREN):
        packings.sort(key=Packing.fitness, reverse=True)
        del packings[POPULATION:]
        idle = idle + 1 if packings[0] is best else 0
        best = packings[0]
        if len(best.bins) <= least or idle == PATIENCE:
            break  # no packing has fewer bins, or children no longer help
        a, b = sorted(rnd.sample(range(len(packings)), 2)) if len(packings) > 1 else (0, 0)
        packings.append(crossover(packings[a], packings[b], lengths, rnd))
    packings.sort(key=Packing.fitness, reverse=True)
    return packings[:POPULATION]


STATE = "shard int, island int, items array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long>>, population array<array<int>>, n_bins int, square double, first int, least int"


def _epoch(states: DataFrame, epoch: int, capacity: int) -> DataFrame:
    """Runs an epoch on each island; a state may carry the neighbour's elite in ``guest``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                lengths = [x["length"] for x in r["items"]]
                rnd = random.Random(f"{r['shard']}/{r['island']}/{epoch}")
                found = [of_assignment(a, lengths, capacity) for a in [*(r["population"] or []), *([r["guest"]] if r["guest"] else [])]]
                found = evolve(lengths, found, rnd, capacity)
                n_bins, square = found[0].fitness()
                first = r["first"] or len(best_fit(sorted(range(len(lengths)), key=lambda i, x=lengths: (-x[i], i)), lengths, [], [], capacity).bins)
                out = {k: r[k] for k in ("shard", "island", "items")} | {"population": [p.assignment(len(lengths)) for p in found], "n_bins": -n_bins, "square": square, "first": first, "least": least_bins(lengths, capacity)}
                yield pa.RecordBatch.from_pylist([out], schema=STATE_ARROW)

    return states.mapInArrow(trimmed(run), STATE)


_ITEM = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
STATE_ARROW = pa.schema([("shard", pa.int32()), ("island", pa.int32()), ("items", pa.list_(_ITEM)), ("population", pa.list_(pa.list_(pa.int32()))), ("n_bins", pa.int32()), ("square", pa.float64()), ("first", pa.int32()), ("least", pa.int32())])


def islands(pieces: DataFrame, shards: int, level: int, capacity: int) -> DataFrame:
    """The last state of every island: each shard's items and the packings found for them."""
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    item = F.struct(*[F.col(k) for k in keys])
    shard = F.pmod(F.xxhash64(F.col("doc_id"), F.col("piece"), F.col("length"), F.col("ids_crc32"), F.lit(level), F.col("twin")), F.lit(shards)).cast("int")
    items = pieces.select(shard.alias("shard"), item.alias("item")).groupBy("shard").agg(F.array_sort(F.collect_list("item")).alias("items"))
    states = items.select("shard", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "items", F.lit(None).cast("array<array<int>>").alias("population"), F.lit(None).cast("array<int>").alias("guest"), F.lit(None).cast("int").alias("first"))
    states = states.repartition(max(1, shards * ISLANDS), "shard", "island")
    for epoch in range(EPOCHS):
        states, _ = written(_epoch(states, epoch, capacity), "packing")
        if epoch + 1 < EPOCHS:
            elite = states.select("shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("population")[0].alias("guest"))
            states = states.select("shard", "island", "items", "population", "first").join(elite, ["shard", "island"])
    return states


def best_islands(states: DataFrame) -> DataFrame:
    return states.groupBy("shard").agg(F.max_by(F.struct("items", F.col("population")[0].alias("bins"), "n_bins", "first", "least"), F.struct(-F.col("n_bins"), F.col("square"), -F.col("island"))).alias("best"))


def report(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``(shard, n_pieces, n_least, n_best_fit, n_bins)`` of a first level: the bins that the lengths need at least, that best-fit
    decreasing takes, and that the search found."""
    rows = _numbered(pieces)
    best = best_islands(islands(rows, max(1, -(-rows.count() // SHARD_PIECES)), 0, capacity))
    return best.select("shard", F.size("best.items").alias("n_pieces"), F.col("best.least").alias("n_least"), F.col("best.first").alias("n_best_fit"), F.col("best.n_bins").alias("n_bins"))


def _numbered(pieces: DataFrame) -> DataFrame:
    """Pieces of a written table with a number ``twin`` that deals rows without an id apart: they may be many and all alike."""
    return pieces.withColumn("twin", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(F.lit(0).cast("long")))


def _pack_shards(pieces: DataFrame, shards: int, level: int, capacity: int) -> DataFrame:
    """Packs each shard on its islands and returns placed pieces."""
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    best = best_islands(islands(pieces, shards, level, capacity))
    rows = best.select("shard", F.explode(F.arrays_zip(F.col("best.items").alias("i"), F.col("best.bins").alias("b"))).alias("x"))
    base = F.lit(level).cast("long") * F.lit(1 << 56) + F.col("shard").cast("long") * F.lit(1 << 24)
    return rows.select(*[F.col(f"x.i.{k}").alias(k) for k in keys], (base + F.col("x.b")).alias("sequence_id"))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a written table) with ``sequence_id`` and gapless ``offset``.

    A sequence lies in one shard, and a shard is bounded, so no step gathers more than a shard.
    """
    done, level = [], 0
    open_, before = pieces.select("doc_id", "piece", "start", "length", "ids_crc32"), None
    while True:
        n = open_.count()
        if n == 0:
            break
        shards = max(1, -(-n // SHARD_PIECES))
        placed, path = written(_pack_shards(_numbered(open_), shards, level, capacity), "packed")
        if shards == 1 or n == before:
            done.append(placed)
            break
        fill = placed.groupBy("sequence_id").agg((F.sum("length") >= int(SETTLED * capacity)).alias("settled"))
        marked, _ = written(placed.join(fill, "sequence_id"), "marked")
        drop_path(pieces.sparkSession, path)
        done.append(marked.where("settled").drop("settled"))
        open_, before, level = marked.where("not settled").drop("settled", "sequence_id"), n, level + 1
    if not done:
        return pieces.sparkSession.createDataFrame([], PACKED)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    w = Window.partitionBy("sequence_id").orderBy("doc_id", "piece", "start").rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("offset", F.coalesce(F.sum("length").over(w), F.lit(0)).cast("long")).select(*COLUMNS)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    pieces, _ = written(token_pieces(docs, tokenizer, capacity), "pieces")
    return pack(pieces, capacity)
