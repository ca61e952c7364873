"""Transcript parsing by a hidden Markov model, and canonical turns.

A transcript is text, in one part or in several that follow each other. Each line that is not blank has an observation: what
kind of speaker marker begins it (or none), whether it asks, how long it is, and whether a blank line stands before
it. Hidden states are a role, and whether the line begins a turn of it or goes on. Viterbi finds the likeliest states. The
forward step is a product in (max, +), so a conversation of any length is parsed part by part: each part gives the best
score from every state to every state, a scan over these small matrices fixes the states between parts, and all parts are
then traced by themselves. The outcome is that of one pass over the whole. A marker is taken off only where the
states say that a turn begins; a line that goes on keeps all it has.

Start, transition and emission probabilities are counted from transcripts whose lines have labels, with add-one smoothing; the
features of an observation are independent given the state. There are as many counts as states and observations, whatever
the corpus.

Null and empty texts, and blank ones, have no lines and render as nothing. Blank lines inside a turn are kept; those at the
end of a part count for nothing. Parts of equal number keep an order by a second number. Labels of -1 teach nothing.
Rows with a null conversation are conversation -1. Other columns, whatever their names, are ignored.

For tables of turns, ``write_transcripts`` makes transcripts with the labels of their lines. There a row repeated word for word is
a turn each time; turns of equal number are in the order of a hash of role and text where they are too many for one
part, else of role and text. A role that is not among ``ROLES`` is written as it is and its lines are unlabelled.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

ROLES = ("system", "user", "assistant", "tool")
STATES = [(r, begins) for r in ROLES for begins in (True, False)]
#: Turns of a part, and equal turns of a part, as ``write_transcripts`` makes them.
SEGMENT = 256
#: Words that a marker may be, by role; the style in which a transcript writes it varies.
MARKERS = {"system": ("system", "instructions", "sys"), "user": ("user", "human", "q", "customer"), "assistant": ("assistant", "ai", "bot", "a", "agent"), "tool": ("tool", "function", "observation")}
STYLES = ("{}: ", "### {}\n", "<{}> ", "[{}] ", "**{}**: ", "{} - ")
_MARKER = re.compile(r"^\s*(?:#{1,4}\s*|\*\*|<\|?|\[)?\s*([A-Za-z]{1,12})\s*(?:\|?>|\]|\*\*:?|:| - |$)\s*")
_ROLE_OF = {w: r for r, ws in MARKERS.items() for w in ws}
KINDS = ("none", "other", *ROLES)
#: An observation: kind of marker, whether the line asks, its length class, whether a blank line stands before it.
SHAPE = (len(KINDS), 2, 3, 2)
N_OBSERVATIONS = len(KINDS) * 2 * 3 * 2

PARTS = "conv_id long, segment long, part long, text string, labels array<int>"
PARSED = "conv_id long, segment long, part long, n_lines long, n_turns long, states array<int>, labels array<int>, rendered string"
KEYS = ["conv_id", "segment", "part"]


def lines_of(text: str) -> list[tuple[str, int]]:
    """Lines that are not blank, each with the number of blank lines before it."""
    out, blank = [], 0
    for line in text.split("\n"):
        if line.strip():
            out.append((line, blank))
            blank = 0
        else:
            blank += 1
    return out


def observe(line: str, blank_before: bool) -> tuple[int, str]:
    """The observation of a line, and the line without its marker."""
    m = _MARKER.match(line)
    kind, rest = "none", line
    if m:
        role = _ROLE_OF.get(m[1].lower())
        kind = role or "other"
        rest = line[m.end() :] if role else line
    asks = rest.rstrip().endswith("?")
    size = 0 if len(rest) < 20 else 1 if len(rest) < 200 else 2
    return ((KINDS.index(kind) * 2 + asks) * 3 + size) * 2 + bool(blank_before), rest


def observations(text: str) -> list[int]:
    return [observe(line, blank > 0)[0] for line, blank in lines_of(text)]


class Hmm:
    """Log probabilities of transitions and observations; a last state, outside, stands before the first line."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: np.ndarray):
        def normal(counts):
            c = counts + 1.0
            return np.log(c / c.sum(-1, keepdims=True))

        n = len(STATES)
        self.outside = n
        self.step = np.full((n + 1, n + 1), -np.inf)
        self.step[:n, :n], self.step[n, :n] = normal(step), normal(start)
        self.emit = np.full((n + 1, N_OBSERVATIONS), -np.inf)
        seen = emit.reshape(n, *SHAPE)
        self.emit[:n] = sum(self._feature(normal(seen.sum(tuple(k for k in range(1, 5) if k != f))), f) for f in range(1, 5))
        for j, (role, begins) in enumerate(STATES):  # a turn goes on only with its own role
            if not begins:
                self.step[n, j] = -np.inf
                self.step[[i for i, (other, _) in enumerate(STATES) if other != role], j] = -np.inf

    @staticmethod
    def _feature(logs: np.ndarray, f: int) -> np.ndarray:
        """Log probabilities of one feature of the observation, for all observations."""
        shape = [len(logs), 1, 1, 1, 1]
        shape[f] = logs.shape[1]
        return np.broadcast_to(logs.reshape(shape), (len(logs), *SHAPE)).reshape(len(logs), -1)

    def entry(self) -> np.ndarray:
        """Scores before the first line."""
        e = np.full(len(STATES) + 1, -np.inf)
        e[self.outside] = 0.0
        return e

    def matrix(self, seen: list[int]) -> np.ndarray:
        """Best score from the state before the part to the state at its end."""
        m = np.full_like(self.step, -np.inf)
        np.fill_diagonal(m, 0.0)
        for o in seen:
            m = (m[:, :, None] + self.step[None, :, :]).max(1) + self.emit[None, :, o]
        return m

    def path(self, seen: list[int], entry: np.ndarray, end: int | None) -> tuple[list[int], int]:
        """The best states, those that end in ``end`` if it is given, and the state before them."""
        back, score = [], entry
        for o in seen:
            ways = score[:, None] + self.step
            back.append(ways.argmax(0))
            score = ways.max(0) + self.emit[:, o]
        at = int(score.argmax()) if end is None else end
        out = []
        for b in reversed(back):
            out.append(at)
            at = int(b[at])
        return out[::-1], at


def train(parts: DataFrame) -> Hmm:
    """Counts over all labelled lines of ``PARTS``; part 0 of segment 0 begins a conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int, int], int] = defaultdict(int)
        for b in batches:
            for _, segment, part, text, labels in zip(*(c.to_pylist() for c in b.columns), strict=True):
                before = None
                for k, (o, s) in enumerate(zip(observations(text), labels or [], strict=False)):
                    if s < 0:
                        before = None
                        continue
                    counts[2, s, o] += 1
                    if before is not None:
                        counts[1, before, s] += 1
                    elif k == 0 and segment == 0 and part == 0:
                        counts[0, 0, s] += 1
                    before = s
        if counts:
            k, a, c = zip(*counts, strict=True)
            yield pa.RecordBatch.from_pydict({"kind": pa.array(k, pa.int32()), "a": pa.array(a, pa.int32()), "b": pa.array(c, pa.int32()), "n": pa.array(list(counts.values()), pa.int64())})

    rows = parts.select(*KEYS, "text", "labels").mapInArrow(run, "kind int, a int, b int, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect()
    tables = [np.zeros(len(STATES)), np.zeros((len(STATES), len(STATES))), np.zeros((len(STATES), N_OBSERVATIONS))]
    for r in rows:
        if r["kind"] == 0:
            tables[0][r["b"]] += r["n"]
        else:
            tables[r["kind"]][r["a"], r["b"]] += r["n"]
    return Hmm(*tables)


def render(text: str, states: list[int], first: bool, last: bool) -> str:
    """Canonical turns of a part. A turn is closed where the next one begins, or at the end of the last part."""
    out, inside = [], not first
    for (line, blank), s in zip(lines_of(text), states, strict=True):
        role, begins = STATES[s]
        if begins or not inside:
            out.append(("<|end|>\n" if inside else "") + f"<|{role}|>\n")
            rest = observe(line, blank > 0)[1] if begins else line
            out += [rest, "\n"] if rest else []
        else:
            out += ["\n" * blank, line, "\n"]
        inside = True
    return "".join(out) + ("<|end|>\n" if last and inside else "")


def parse(parts: DataFrame, hmm: Hmm) -> DataFrame:
    """``PARSED`` of written ``PARTS``: each line's state, and canonical turns that, joined in order, are the conversation's."""
    shared = parts.sparkSession.sparkContext.broadcast(hmm)
    known = "conv_id long, segment long, part long"

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [shared.value.matrix(observations(t)).ravel().tolist() for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.list_(pa.float64()))], [*KEYS, "matrix"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Scores before each part, and the state at its end: forward over a conversation's matrices, then back."""
        model = shared.value
        name, score, rows, back = None, None, [], []

        def ended():
            at, ends = int(score.argmax()), []
            for b in reversed(back):
                ends.append(at)
                at = int(b[at])
            ends.reverse()
            for a in range(0, len(rows), 10_000):
                some = rows[a : a + 10_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(some), pa.int64()), pa.array([r[0] for r in some], pa.int64()), pa.array([r[1] for r in some], pa.int64()), pa.array([r[2].tolist() for r in some], pa.list_(pa.float64())),
                     pa.array(ends[a : a + 10_000], pa.int32()), pa.array([a + k == 0 for k in range(len(some))]), pa.array([a + k + 1 == len(rows) for k in range(len(some))])],
                    [*KEYS, "entry", "end", "is_first", "is_last"],
                )

        for b in batches:
            for conv, segment, part, matrix in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if conv != name:
                    if rows:
                        yield from ended()
                    name, score, rows, back = conv, model.entry(), [], []
                rows.append((segment, part, score))
                ways = score[:, None] + np.array(matrix).reshape(model.step.shape)
                back.append(ways.argmax(0).astype(np.int8))
                score = ways.max(0)
                score = score - score.max()
        if rows:
            yield from ended()

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            out = []
            for conv, segment, part, text, labels, entry, end, first, last in zip(*(c.to_pylist() for c in b.columns), strict=True):
                states, _ = model.path(observations(text), np.array(entry), end)
                out.append((conv, segment, part, len(states), sum(STATES[s][1] for s in states), states, labels, render(text, states, first, last)))
            if out:
                kinds = [pa.int64()] * 5 + [pa.list_(pa.int32())] * 2 + [pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], [f.split()[0] for f in PARSED.split(", ")])

    base = parts.select(*KEYS, F.coalesce("text", F.lit("")).alias("text"), "labels")
    scored = base.mapInArrow(matrices, f"{known}, matrix array<double>").repartition("conv_id").sortWithinPartitions(*KEYS)
    entries, _ = written(scored.mapInArrow(scan, f"{known}, entry array<double>, end int, is_first boolean, is_last boolean"), "chat-entries")
    return base.join(entries, KEYS).select(*KEYS, "text", "labels", "entry", "end", "is_first", "is_last").mapInArrow(trace, PARSED)


def parse_transcripts(transcripts: DataFrame, hmm: Hmm) -> DataFrame:
    """``(conv_id, part, n_turns, n_lines, rendered)`` of ``(conv_id, part, text)``: text as it is given, without labels."""
    parts = transcripts.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(-1)).alias("conv_id"), F.lit(0).cast("long").alias("segment"), F.coalesce(F.col("part").cast("long"), F.lit(-1)).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.lit(None).cast("array<int>").alias("labels"))
    # parts of equal number are told apart by a number of their own
    numbered, _ = written(parts.withColumn("segment", F.col("part")).withColumn("part", F.monotonically_increasing_id()), "chat-parts")
    return parse(numbered, hmm).select("conv_id", F.col("segment").alias("part"), "n_turns", "n_lines", "rendered")


# -- transcripts of tables of turns --------------------------------------------------------------------------


def speak(role: str, text: str, conv: int, turn: int) -> str:
    """A turn as a transcript writes it: each conversation has a style; every fifth later turn lacks its marker."""
    if turn and (conv * 7 + turn * 3) % 5 == 0:
        return "\n" + text
    words = MARKERS.get(role, (role or "other",))
    word = words[conv % len(words)]
    return STYLES[conv % len(STYLES)].format(word.capitalize() if conv % 2 else word) + text


def write_transcripts(conversations: DataFrame) -> DataFrame:
    """``PARTS`` of ``(conv_id, turn, role, text)``: turns in order, in parts of bounded length, and the state of each line.

    A part is numbered by its turns' numbers, so no conversation is gathered to be cut; equal rows are counted before they
    move.
    """
    c = conversations.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(-1)).alias("conv_id"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    c = c.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    c = c.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / SEGMENT)))).withColumn("copies", F.least(F.lit(SEGMENT), F.col("n") - F.col("k") * SEGMENT).cast("int"))
    c = c.withColumn("segment", F.floor(F.col("turn") / SEGMENT))
    # more rows than turn numbers: turns of one number are dealt by their text, equal ones in parts of their own
    many = c.groupBy("conv_id", "segment").agg(F.ceil(F.sum("copies") / (4 * SEGMENT)).alias("parts")).where("parts > 1")
    place = (F.pmod(F.col("turn"), F.lit(SEGMENT)) * F.col("parts") + F.pmod(F.xxhash64("role", "text"), F.col("parts"))) * (1 << 30) + F.col("k")
    seg = c.join(many, ["conv_id", "segment"], "left").withColumn("part", F.when(F.col("parts").isNull(), F.lit(0).cast("long")).otherwise(place.cast("long")))
    turns = seg.groupBy("conv_id", "segment", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "copies"))).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, labels = [], []
            for conv, turns in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True):
                said, states = [], []
                for t in turns:
                    text = speak(t["role"], t["text"], conv, t["turn"])
                    n = len(lines_of(text))
                    own = [STATES.index((t["role"], k == 0)) if t["role"] in ROLES else -1 for k in range(n)]
                    said += [text] * t["copies"]
                    states += own * t["copies"]
                texts.append("\n".join(said))
                labels.append(states)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(texts, pa.string()), pa.array(labels, pa.list_(pa.int32()))], [f.split()[0] for f in PARTS.split(", ")])

    return turns.mapInArrow(run, PARTS)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """``(conv_id, segment, part, held_out, n_turns, n_lines, n_labelled, n_right, accuracy, rendered)`` of every conversation, part by part.

    Conversations whose crc32 leaves 1 modulo 3 are held out: the model never sees their labels.
    """
    parts, _ = written(write_transcripts(conversations), "chat-parts")
    held = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(3)) == 1
    hmm = train(parts.where(~held))
    role = F.array(*[F.lit(r) for r, _ in STATES])
    right = F.size(F.filter(F.zip_with("states", "labels", lambda s, y: (y >= 0) & (role[s] == role[F.greatest(y, F.lit(0))])), lambda x: x))
    labelled = F.size(F.filter("labels", lambda y: y >= 0))
    out = parse(parts, hmm).select(*KEYS, held.alias("held_out"), "n_turns", "n_lines", labelled.cast("long").alias("n_labelled"), right.cast("long").alias("n_right"), "rendered")
    accuracy = F.when(F.col("n_labelled") > 0, F.col("n_right") / F.col("n_labelled")).otherwise(F.lit(1.0))
    return out.select(*KEYS, "held_out", "n_turns", "n_lines", "n_labelled", "n_right", accuracy.alias("accuracy"), "rendered")
