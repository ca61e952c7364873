"""Difference-cover deduplication, filter audit and hard negatives against plain versions, odd input included."""

import hashlib
import random
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import common, cover, interaction, negatives, suffixes

from .conftest import SCHEMA, prose, rows
from .test_corpus import plain_removal

# -- words -------------------------------------------------------------------------------------------------


def plain_words(docs, length=20):
    """Per row the kept words: a window goes if it starts earlier in a smaller id or in the same row."""
    split = [(i, (t or "").encode().split()) for i, t in docs]
    first = {}
    for i, w in split:
        if i is not None:
            for s in range(len(w) - length + 1):
                key = tuple(w[s : s + length])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone, seen = set(), set()
        for s in range(len(w) - length + 1):
            key = tuple(w[s : s + length])
            if key in seen or i is not None and first[key] < i:
                gone.update(range(s, s + length))
            seen.add(key)
        out.append((i, len(w), [x for k, x in enumerate(w) if k not in gone]))
    return out


def digests(docs):
    return sorted(((i, n, n - len(k), hashlib.sha256(b" ".join(k)).hexdigest()) for i, n, k in plain_words(docs)), key=str)


def passages():
    """Passages shared at every shift modulo the period, windows of just 20 and 19 words, null and repeated ids."""
    rnd = random.Random(9)
    long = prose(rnd, 150).split()
    out = [(100, " ".join(long))]
    for k in range(21):
        a = rnd.randint(0, 60)
        n = (19, 20, 21, 40, 75)[k % 5]
        out.append((k, prose(rnd, k) + " " + " ".join(long[a : a + n]) + " " + prose(rnd, 5)))
    out += [(7, " ".join(long[5:60])), (None, " ".join(long)), (None, " ".join(long[:30] + long[:30])), (200, "tick " * 70), (201, "tick " * 30), (202, " ".join(long)), (202, " ".join(long)), (300, "\n".join(long[40:90])), (301, "Tick " * 30)]
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_words_equal_the_plain_version(spark, parts):
    both = [(i, t) for i, t, *_ in rows()] + passages()
    df = spark.createDataFrame(both, "doc_id long, text string").repartition(parts)
    assert sorted(map(tuple, cover.removed_words(df).collect()), key=str) == digests(both)


def test_words_of_long_texts(spark, monkeypatch):
    """Stretches that are much shorter than the texts, and words that are longer than a stretch."""
    rnd = random.Random(4)
    giant = "x" * 400
    a = prose(rnd, 500).split()
    b = [*a[100:300], giant, *a[290:480], giant, *prose(rnd, 30).split()]
    both = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join([*b[150:260], giant, giant])), (4, "y" * 3000), (5, " ".join(a[3:] + a[:200]))]
    for name, value in (("BATCH_BYTES", 200), ("LONG_WORD", 150)):
        monkeypatch.setattr(cover, name, value)
    for words in cover.stretches([t.encode() for _, t in both]):
        assert len(words.number) < 700
    raws = [t.encode() for _, t in both]
    keys = defaultdict(set)
    for words in cover.stretches(raws):
        at = words.runs(20)
        for number, index, h in zip(words.number[at].tolist(), words.index[at].tolist(), words.identities(at, 20, 1)[0].tolist(), strict=True):
            assert (number, index) not in keys[tuple(raws[number].split()[index : index + 20])]
            keys[tuple(raws[number].split()[index : index + 20])].add((number, index))
            assert keys.setdefault(h, tuple(raws[number].split()[index : index + 20])) == tuple(raws[number].split()[index : index + 20])
    assert sum(len(v) for v in keys.values() if isinstance(v, set)) == sum(max(len(r.split()) - 19, 0) for r in raws)
    df = spark.createDataFrame(both, "doc_id long, text string").repartition(2)
    assert sorted(map(tuple, cover.removed_words(df).collect()), key=str) == digests(both)


def test_every_two_places_share_an_anchor():
    for i in range(cover.PERIOD):
        for j in range(cover.PERIOD):
            assert any(cover.is_cover(np.array([i + d, j + d])).all() for d in range(cover.PERIOD))


def test_texts_without_repeated_words(spark, docs, nothing):
    got = sorted(((r["doc_id"], r["text"]) for r in cover.without_repeated_words(docs).collect()), key=str)
    want = []
    for (i, t, *_), (_, n, kept) in zip(rows(), plain_words([(r[0], r[1]) for r in rows()]), strict=True):
        want.append((i, t if len(kept) == n else b" ".join(kept).decode()))
    assert got == sorted(want, key=str)
    assert cover.without_repeated_words(docs).columns == SCHEMA.names
    assert cover.removed_words(nothing).count() == cover.without_repeated_words(nothing).count() == 0


# -- filters -----------------------------------------------------------------------------------------------


def plain_failures(docs):
    """Per row its part and the filters it fails, by regular expressions and a loop over all rows."""
    import re

    out = []
    for i, text, part in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = ""
        fails += "A" if len(words) < 50 else ""
        fails += "B" if 100 * len(set(words)) < 65 * len(words) else ""
        fails += "C" if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text) else ""
        fails += "D" if re.search(r"[#$%&*|]", text) else ""
        fails += "E" if i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs) else ""
        out.append((i, part or "", fails))
    return out


def plain_audit(docs, labels):
    good, toxic = ({i for i, q, t in labels if (q, t)[k] == 1 and i is not None} for k in (0, 1))
    found = plain_failures(docs)
    out = {}
    for part in {p for _, p, _ in found}:
        mine = [(i, f) for i, p, f in found if p == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(gone)
                failing = [x for x in mine if f in x[1]]
                alone = sum(x[1] == f for x in mine)
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), alone, sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), f]
        for k, v in out.items():
            if k[0] == part:
                v[6] = shapley[v[6]]
    return out


def filter_rows():
    rnd = random.Random(12)
    marks = ["", "#", "|x", "SHOUT LOUD "]
    out = []
    for k in range(60):
        n = rnd.choice([0, 10, 49, 50, 80])
        words = prose(rnd, n).split() if k % 3 else ["same", "few", "words"] * (n // 3)
        out.append((rnd.choice([None, *range(40)]), rnd.choice(marks) + " ".join(words) + rnd.choice(["", " ", "\x1c"]), rnd.choice(["a", "b", "", None])))
    out += [(rnd.randint(0, 90), out[5][1], "hot") for _ in range(40)] + [(3, None, "b"), (9, None, None), (8, "", "b"), (10**12, "É" * 30 + "AB", "c")]
    return out


def test_filters_equal_the_plain_version(spark, monkeypatch):
    docs = filter_rows()
    labels = [(k, k % 2, k % 3 == 0) for k in range(0, 60, 2)] + [(4, 0, 1), (4, 1, 0), (None, 1, 1), (5, None, None)]
    df = spark.createDataFrame([(i, t, s, "clash") for i, t, s in docs], "doc_id long, text string, source string, part string").repartition(4)
    known = spark.createDataFrame([(i, q, None if t is None else int(t)) for i, q, t in labels], "doc_id long, quality int, toxic int")
    want = plain_audit(docs, [(i, q, None if t is None else int(t)) for i, q, t in labels])
    rows_, _ = common.written(interaction.failures(df), "failures")
    for share, held in ((1000, 4096), (3, 1)):  # few copies are hot; a task passes its counts on after each batch
        monkeypatch.setattr(interaction, "HOT_SHARE", share)
        got = interaction.audited(interaction.with_labels(interaction.with_copies(rows_), known), held).collect()
        assert len(got) == len(want) == 600 * len({s or "" for _, _, s in docs})
        for r in got:
            assert list(r)[3:] == want[r["part"], r["filter_order"], r["step"]]
    assert interaction.filter_interactions(df, known).count() == len(want)


def test_filters_of_nothing(spark, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interaction.filter_interactions(nothing, labels).count() == 0


def test_first_failures():
    for fails in range(32):
        for k, order in enumerate(interaction.ORDERS):
            first = next((s for s, c in enumerate(order) if fails >> interaction.FILTERS.index(c) & 1), 5)
            assert interaction.FIRST[fails, k] == first


# -- negatives ---------------------------------------------------------------------------------------------


def plain_negatives(vectors, positives=5, negatives_=10):
    import math

    rows_ = [(k, i, lab, [math.floor(256 * x) for x in v]) for k, (i, v, lab) in enumerate(vectors) if None not in (i, v, lab) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, i, lab, v in rows_:
        if i % 100:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(v, w, strict=False)), j, n, m) for n, j, m, w in rows_ if n != k))
        for s, j, *_ in [x for x in scored if x[3] == lab][:positives]:
            fit = [x for x in scored if x[3] != lab and -30 * s <= -100 * x[0] <= -90 * s][:negatives_]
            out += [(i, j, r, x[1], -s, -x[0]) for r, x in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, vectors, **settings):
    df = spark.createDataFrame([(i, v, lab, "clash") for i, v, lab in vectors], "vec_id long, embedding array<double>, label int, rank string").repartition(3)
    got = negatives.hard_negatives(df, F.col("label"), F.col("vec_id") % 100 == 0, **settings)
    return sorted(tuple(r) for r in got.collect())


def test_negatives_equal_the_plain_version(spark):
    rnd = random.Random(8)
    vectors = [(k, [rnd.gauss(0.3, 0.5) for _ in range(6)], rnd.randrange(3)) for k in range(0, 700, 3)]
    vectors += [(1001 + k, [0.5, 0.5], 1) for k in range(150)] + [(2000, [0.5, 0.5, 0.1], 0), (2100, [0.0] * 6, 1), (2200, [-0.4], 2)]  # ties, other lengths
    vectors += [(300, [0.2, 0.4], 2), (300, [0.2, 0.4], 2), (5, [0.5, 0.5], 0)]  # ids that repeat
    vectors += [(1, None, 1), (2, [0.1, None], 1), (3, [0.1, float("nan")], 1), (4, [float("inf")], 1), (None, [0.5], 0), (400, [0.3], None), (500, [], 0)]
    want = plain_negatives(vectors)
    assert len(want) > 300
    assert mined(spark, vectors) == want


def test_negatives_among_ties_of_ids(spark):
    """More rows of one score than are gathered, so that the digits of ids decide; then one id that holds them all."""
    near = [(100, [1.0, 0.0], 0), (200, [1.0, 0.0], 0), (300, [0.9, 0.1], 0)]
    many = near + [(7 * k + 1000003, [0.5, 0.25], 1) for k in range(120)]
    assert mined(spark, many, radix=64, few=4) == plain_negatives(many)
    same = near + [(77, [0.5, 0.25], 1) for _ in range(60)] + [(5, [0.5, 0.2], 1), (-3, [0.5, 0.25], 2)]
    assert mined(spark, same, radix=64, few=4) == plain_negatives(same)


def test_negatives_of_large_components(spark):
    rnd = random.Random(3)
    vectors = [(k * 50, [rnd.uniform(0, 2.0**19), rnd.uniform(0, 2.0**19)], k % 2) for k in range(30)]
    assert mined(spark, vectors) == plain_negatives(vectors)


def test_negatives_of_nothing(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(100, [1.0], 0)]) == []
    assert mined(spark, [(1, [1.0], 0), (2, [1.0], 1)]) == []


# -- suffixes: runs of one character, few long texts ---------------------------------------------------------


def test_runs_have_few_units():
    for t in (b"a" * 20000, b"=-" * 10000, b"0123456789abcdefghi\n" * 1000):
        for group in suffixes.stretches([t]):
            u = suffixes.Units(group)
            assert int((u.count - 1 + suffixes.LENGTH).sum()) < 3 * len(t) and u.tied.all()
            assert int(u.count.sum()) == len(t) - suffixes.LENGTH + 1


def test_strings_that_repeat_inside_a_run(spark):
    rnd = random.Random(2)
    texts = ["a" * 250, "b" * 199 + "c", "xy" * 110, prose(rnd, 60) + "-" * 230 + prose(rnd, 20), prose(rnd, 50) + "-" * 201, "0123456789abcdefghi\n" * 12, "q" * 200 + prose(rnd, 40) + "q" * 200]
    texts += ["r" * 120 + prose(rnd, 20) + "r" * 120, "s" * 330 + "t" * 330, "t" * 200]
    got = suffixes.removed_bytes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    assert sorted(tuple(r)[1:] for r in got) == plain_removal([t.encode() for t in texts])


@pytest.mark.parametrize("giant", [False, True])
def test_few_long_texts_fill_all_ranges(spark, giant):
    """Splitters come from suffixes, so that few long rows, or one among many, are spread as well."""
    rnd = random.Random(7)
    passages_ = [prose(rnd, 60) for _ in range(60)]
    long = [" ".join(rnd.choice(passages_) + prose(rnd, 3) for _ in range(60)) for _ in range(40)]
    texts = [" ".join(long), *[p for p in passages_]] if giant else long
    rows_ = spark.createDataFrame(list(enumerate(texts)), "rid long, text string").repartition(4)
    flags = suffixes.shared_anchors(rows_, 4).groupBy("rid").agg(F.collect_list("first").alias("firsts"))
    joined = rows_.join(flags, "rid").select("rid", "text", "firsts").cache()
    flagged, n = joined.agg(F.sum(F.size("firsts"))).first()[0], 19
    cuts = suffixes.splitters(joined, flagged, n)
    sizes = [r["count"] for r in suffixes.suffixes(joined, cuts).groupBy("part").count().collect()]
    assert len(sizes) >= n - 2 and sum(sizes) == flagged and max(sizes) < 3 * flagged / n
