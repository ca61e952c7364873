"""Toxicity by class-conditional Kneser-Ney models.

Two models of the characters of words, order five with marks for a word's ends, are learnt from toxic and
from ordinary documents. Counts of the highest order belong to a class; all lower orders are Kneser-Ney
continuation counts that both classes share, so that an expression too rare in one class backs off to the
same distribution in both. A word's score is the difference of its two log-likelihoods; a document's
features are that difference per character over the whole text (length-normalised), and how much of it
comes from words that speak clearly for the toxic class. A logistic function, fitted across two folds so that no
document is scored with its own class counts, turns features into a score between 0 and 1.

Counts come from every labelled row outside the held-out third, keyed by the n-gram itself. They are turned into
log-likelihood differences by joins: one number for each distinct n-gram of the highest order, and one for each context,
which is what an unseen n-gram in that context gets, since the shared lower orders cancel. A Python worker
loads these two columns (12 bytes an n-gram); nothing of the corpus goes to the driver but the sample of the logistic fit
(``FIT_ROWS`` labelled rows, chosen by a hash of the id).

Null and empty texts, and texts without letters, have no features and get the score of a text of neutral features.
Labels that are null are ignored; of repeated labels the greatest holds. If either class has no rows, all
scores are 0. Repeated documents and rows with null ids are scored like any other; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_path, texts, trimmed, written

ORDER = 5
#: Characters that the lowest order allows for.
CHARACTERS = 1 << 19
DISCOUNT = 0.75
FIT_ROWS = 20_000
THRESHOLD = 0.7
#: Words, and their characters, that a task keeps: with their scores, or counted before they are added to the partial counts.
WORDS_KEPT, CHARACTERS_KEPT = 40_000, 1 << 20
WORD = re.compile(r"[^\W\d_]+")
FEATURES = 4
SCORES = "doc_id long, held_out boolean, score double, predicted int"

_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit identity of the characters side by side."""
    h = np.full(len(columns[0]), len(columns), np.uint64)
    for c in columns:
        h = (h ^ c) * _K1
        h ^= h >> np.uint64(29)
    h *= _K2
    return h ^ (h >> np.uint64(32))


def codes_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers and characters: a row for each predicted character, with the four before it (0 before the word)."""
    flat = np.frombuffer("".join([f"\x02{w}\x03" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(sizes)
    word = np.repeat(np.arange(len(words)), sizes)
    within = np.arange(len(flat)) - np.repeat(ends - sizes, sizes)
    at = np.flatnonzero(within)
    codes = np.zeros((ORDER, len(at)), np.uint64)
    codes[-1] = flat[at]
    for k in range(1, ORDER):
        codes[-1 - k] = np.where(within[at] >= k, flat[np.maximum(at - k, 0)], np.uint64(0))
    return word[at], codes


SUMS = ["o0", "t0", "o2", "t2"]
#: Whose class counts a score stands on: both folds, or the one that a document of the fit is not in.
CHOICES = {"02": ("o0 + o2", "t0 + t2"), "0": ("o0", "t0"), "2": ("o2", "t2")}
#: Distinct n-grams that a task holds before it sends its partial counts on.
GRAMS_KEPT = 150_000


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic, fold) -> partial counts of 5-grams by fold and class."""
    counts: dict[str, list[int]] = {}
    size = 0
    held: tuple[np.ndarray, np.ndarray] | None = None  # characters, sums

    def gathered():
        word, codes = codes_of(list(counts))
        weights = np.array(list(counts.values()), np.int64)[word]
        if held is not None:
            codes, weights = np.concatenate([held[0], codes], 1), np.concatenate([held[1], weights])
        _, first, inverse = np.unique(_mix(list(codes)), return_index=True, return_inverse=True)
        return codes[:, first], np.stack([np.bincount(inverse, weights[:, k], len(first)) for k in range(4)], 1).astype(np.int64)

    def rows():
        codes, sums = held
        names = np.ascontiguousarray(np.maximum(codes, 1).astype("<u4").T).view(f"<U{ORDER}")[:, 0]
        for a in range(0, len(names), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(names[a : a + 20_000].tolist()), *[pa.array(sums[a : a + 20_000, k]) for k in range(4)]], ["gram", *SUMS])

    for b in batches:
        for text, toxic, fold in zip(*(c.to_pylist() for c in b.columns), strict=True):
            k = (2 if fold else 0) + toxic
            for w, n in Counter(WORD.findall(text.lower())).items():
                known = counts.get(w)
                if known is None:
                    known = counts[w] = [0, 0, 0, 0]
                    size += len(w)
                known[k] += n
            if len(counts) > WORDS_KEPT or size > CHARACTERS_KEPT:
                held = gathered()
                counts.clear()
                size = 0
                if held[0].shape[1] > GRAMS_KEPT:
                    yield from rows()
                    held = None
    if counts:
        held = gathered()
    if held is not None:
        yield from rows()


def _identities(name: str):
    """Rows that begin with a string of ``name`` -> its identity and the other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                flat = np.frombuffer("".join(b.column(0).to_pylist()).encode("utf-32-le", "surrogatepass"), "<u4").reshape(b.num_rows, -1)
                codes = np.where(flat == 1, 0, flat).astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(_mix(list(codes.T)).view(np.int64)), *b.columns[1:]], ["id", *b.schema.names[1:]])

    return run


_loaded: dict[tuple[str, str], Scores] = {}


class Scores:
    """Toxic minus ordinary log-likelihood: of each known n-gram, and of any other n-gram in each known context."""

    def __init__(self, grams: tuple[np.ndarray, np.ndarray], contexts: tuple[np.ndarray, np.ndarray]):
        self.grams, self.contexts = grams, contexts

    @staticmethod
    def load(uri: str, choice: str) -> Scores:
        """One choice of folds of a written model; a Python worker keeps it for its tasks."""
        if (uri, choice) not in _loaded:
            for other in [k for k in _loaded if k[0] != uri]:
                del _loaded[other]
            _loaded[uri, choice] = Scores(*(_column(f"{uri}/{part}", f"s{choice}") for part in ("grams", "contexts")))
        return _loaded[uri, choice]

    def words(self, words: list[str]) -> np.ndarray:
        """Each word's score."""
        word, codes = codes_of(words)
        known, score = _looked_up(self.grams, _mix(list(codes)))
        _, rest = _looked_up(self.contexts, _mix(list(codes[:-1])))
        return np.bincount(word, np.where(known, score, rest), len(words))


def _column(uri: str, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Identities in order, and one column of a written table."""
    fs, path = pafs.FileSystem.from_uri(uri)
    ids, values = [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
    for info in fs.get_file_info(pafs.FileSelector(path)):
        if info.path.endswith(".parquet"):
            with fs.open_input_file(info.path) as f:
                got = pq.ParquetFile(f).read(["id", name])
            ids.append(got["id"].to_numpy())
            values.append(got[name].to_numpy())
    ids, values = np.concatenate(ids), np.concatenate(values)
    order = np.argsort(ids)
    return ids[order], values[order]


def _looked_up(table: tuple[np.ndarray, np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each identity is in the table, and its value; 0 where it is not."""
    known, values = table
    if not len(known):
        return np.zeros(len(ids), bool), np.zeros(len(ids), np.float32)
    wanted = ids.view(np.int64)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    found = known[at] == wanted
    return found, np.where(found, values[at], np.float32(0))


def features(scores: np.ndarray, chars: int) -> list[float]:
    """Per character over the text; share, sum and peak of the words that speak clearly for the toxic class."""
    if not len(scores):
        return [0.0] * FEATURES
    clear = np.maximum(scores - 3.0, 0)
    return [float(scores.sum() / max(chars, 1)), float(np.log1p(clear.sum())), float(np.log1p(clear.sum()) / np.log(len(scores) + 2)), float(min(scores.max(), 12.0))]


class Scorer:
    """Features of texts; keeps the scores of words up to a number of them and of their characters."""

    def __init__(self, scores: Scores):
        self.scores, self.known, self.size = scores, {}, 0

    def batch(self, ts: list[str]) -> list[list[float]]:
        split = [WORD.findall(t.lower()) for t in ts]
        known = self.known
        if len(known) > WORDS_KEPT or self.size > CHARACTERS_KEPT:
            known.clear()
            self.size = 0
        new = list({w for ws in split for w in ws if w not in known})
        while new:
            part, size = [], 0
            while new and size < 1 << 16:
                part.append(new.pop())
                size += len(part[-1])
            known.update(zip(part, self.scores.words(part).tolist(), strict=True))
            self.size += size
        return [features(np.fromiter(map(known.__getitem__, ws), np.float64, len(ws)), sum(map(len, ws))) for ws in split]


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, text, toxic, fold)`` of labelled rows whose crc32 leaves 0 or 2; the rest is never read."""
    crc = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    y = y.where(crc != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # sorted and merged whatever the labels' size, so that a small corpus behaves like a large one
    return texts(docs).where(crc != 1).join(y.hint("merge"), "doc_id").withColumn("fold", (crc == 2).cast("int"))


def gram_counts(training: DataFrame) -> DataFrame:
    """``(gram, o0, t0, o2, t2)``: counts of each 5-gram over all training rows, by class and fold. \\x01 stands before a word."""
    partial = training.select("text", "toxic", "fold").mapInArrow(trimmed(_count_words), "gram string, " + ", ".join(f"{s} long" for s in SUMS))
    return partial.groupBy("gram").agg(*[F.sum(s).alias(s) for s in SUMS])


def lower_orders(grams: DataFrame) -> DataFrame:
    """``(g, p)``: the shared Kneser-Ney probability of the last character of each 4-gram after the three before it.

    A continuation count is the number of distinct characters before an n-gram; a context's sums are over the n-grams
    that begin with it.
    """
    counted = grams.select(F.expr(f"substring(gram, 2, {ORDER - 1})").alias("g")).groupBy("g").agg(F.count("*").alias("c"))
    orders = {ORDER - 1: counted}
    for n in range(ORDER - 2, 0, -1):
        counted = counted.groupBy(F.expr(f"substring(g, 2, {n})").alias("g")).agg(F.count("*").alias("c"))
        orders[n] = counted
    total = float(orders[1].agg(F.sum("c")).first()[0] or 0)
    p = orders[1].select("g", ((F.col("c") + 0.1) / (total + 0.1 * CHARACTERS)).alias("p"))
    for n in range(2, ORDER):
        rows = orders[n].withColumns({"h": F.expr(f"substring(g, 1, {n - 1})"), "rest": F.expr(f"substring(g, 2, {n - 1})")})
        contexts = rows.groupBy("h").agg(F.sum("c").alias("whole"), F.count("*").alias("kinds"))
        seen = F.greatest(F.col("c") - DISCOUNT, F.lit(0.0))
        rows = rows.join(contexts, "h").join(p.withColumnRenamed("g", "rest"), "rest")
        p = rows.select("g", ((seen + DISCOUNT * F.col("kinds") * F.col("p")) / F.col("whole")).alias("p"))
    return p


def score_tables(training: DataFrame) -> str:
    """Writes the models' log-likelihood differences; the address of the folder with ``grams`` and ``contexts``."""
    counts, counts_path = written(gram_counts(training), "toxic-grams")
    lower, lower_path = written(lower_orders(counts), "toxic-lower")
    rows = counts.withColumns({"h": F.expr(f"substring(gram, 1, {ORDER - 1})"), "g": F.expr(f"substring(gram, 2, {ORDER - 1})")})
    sums = {f"{c}{k}": F.expr(x) for k, (o, t) in CHOICES.items() for c, x in (("o", o), ("t", t))}
    rows = rows.select("gram", "h", "g", *[x.alias(f"n_{k}") for k, x in sums.items()])
    contexts = rows.groupBy("h").agg(*[F.sum(f"n_{k}").alias(f"all_{k}") for k in sums], *[F.count_if(F.col(f"n_{k}") > 0).alias(f"kinds_{k}") for k in sums])
    contexts, contexts_path = written(contexts, "toxic-contexts")

    def held_back(k: str) -> Column:
        """The share of a class's distribution after a context that its lower orders have."""
        return F.when(F.col(f"all_{k}") > 0, DISCOUNT * F.col(f"kinds_{k}") / F.col(f"all_{k}")).otherwise(F.lit(1.0))

    def likelihood(k: str) -> Column:
        seen = F.when(F.col(f"all_{k}") > 0, F.greatest(F.col(f"n_{k}") - DISCOUNT, F.lit(0.0)) / F.col(f"all_{k}")).otherwise(F.lit(0.0))
        return seen + held_back(k) * F.col("p")

    def differences(of) -> list[Column]:
        return [(F.log(of(f"t{k}")) - F.log(of(f"o{k}"))).cast("float").alias(f"s{k}") for k in CHOICES]

    scored = rows.join(contexts, "h").join(lower, "g").select("gram", *differences(likelihood))
    schema = "id long, " + ", ".join(f"s{k} float" for k in CHOICES)
    _, uri = written(scored.mapInArrow(_identities("gram"), schema), "toxic-model", sub="grams")
    contexts.select("h", *differences(held_back)).mapInArrow(_identities("h"), schema).write.parquet(f"{uri}/contexts")
    drop_path(training.sparkSession, counts_path, lower_path, contexts_path)
    return uri


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (the constant last) by Newton steps with a small ridge."""
    scale = x.std(0) + 1e-9
    a = np.hstack([x / scale, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + 1e-2 * w
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / scale, w[-1])


class Model:
    """Where the models are, and logistic weights."""

    def __init__(self, uri: str, weights: np.ndarray):
        self.uri, self.weights = uri, weights

    def scorer(self) -> Scorer:
        return Scorer(Scores.load(self.uri, "02"))

    def scores(self, scorer: Scorer, ts: list[str]) -> list[float]:
        x = np.array(scorer.batch(ts)).reshape(len(ts), FEATURES)
        return (1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))).tolist()


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model | None:
    """The model, or None where a class has no rows."""
    training, training_path = written(training_rows(docs, labels), "toxic-training")
    by_class = {r["toxic"]: r["n"] for r in training.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(by_class) < 2:
        return None
    uri = score_tables(training)
    share = min(1.0, fit_rows / sum(by_class.values()))
    sample = training.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        other = {0: Scorer(Scores.load(uri, "2")), 1: Scorer(Scores.load(uri, "0"))}  # counts of the fold it is not in
        for b in batches:
            ts, ys, folds = (b.column(k).to_pylist() for k in (1, 2, 3))
            for f in (0, 1):
                at = [k for k, x in enumerate(folds) if x == f]
                if at:
                    yield pa.RecordBatch.from_pydict({"x": pa.array(other[f].batch([ts[k] for k in at]), pa.list_(pa.float64())), "y": pa.array([ys[k] for k in at], pa.int32())})

    got = sample.mapInArrow(trimmed(run), "x array<double>, y int").toArrow()
    drop_path(docs.sparkSession, training_path)
    y = got["y"].to_numpy().astype(float)
    if len(y) == 0 or y.min() == y.max():
        return None
    return Model(uri, logistic(np.array(got["x"].to_pylist()), y))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every document."""
    model = fit(docs, labels)
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    rows = texts(docs).select("doc_id", "text", F.coalesce(held, F.lit(False)).alias("held_out"))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for b in batches:
            s = model.scores(scorer, b.column(1).to_pylist())
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "held_out": b.column(2), "score": pa.array(s, pa.float64()), "predicted": pa.array([int(x >= THRESHOLD) for x in s], pa.int32())})

    return rows.mapInArrow(trimmed(run), SCORES)


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below the threshold; all of them if no model can be learnt."""
    model = fit(texts(docs, id_col, text_col), labels)
    if model is None:
        return docs
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for b in batches:
            s = model.scores(scorer, [t or "" for t in b.column(at).to_pylist()])
            yield b.filter(pa.array([x < THRESHOLD for x in s], pa.bool_()))

    return docs.mapInArrow(trimmed(run), docs.schema)
