"""Operators take whole texts and whole corpora."""

import collections
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import pii, toxicity


def test_terms_disclose_from_anywhere_in_any_document(spark):
    filler = "plain words stand here " * 20
    rows = [(k, filler + chr(97 + k % 26) * 3) for k in range(200)]
    rows += [(200, "Quillon " + filler + "write to q@x.org now"), (201, filler + "Quillon " + filler + "Quillon")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(docs, support=1).collect()}
    assert "term:0:7" in spans[200].split(",")
    at = len(filler)
    assert spans[201].split(",") == [f"term:{at}:{at + 7}", f"term:{2 * at + 8}:{2 * at + 15}"]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs, support=1).collect()}
    assert "Quillon" not in clean[200] + clean[201] and "<EMAIL>" in clean[200]
    assert clean[5] == rows[5][1]


def plain_kneser_ney(data, classes=(1, 0)):
    """Word score by dictionaries: class counts of order five over shared continuation counts."""
    order, d = 5, toxicity.DISCOUNT

    def windows(w):
        s = "\x01" * (order - 1) + "\x02" + w + "\x03"
        return [s[i - order + 1 : i + 1] for i in range(order, len(s))]

    top = {c: collections.Counter(g for text, y in data if y == c for w in text.split() for g in windows(w)) for c in classes}
    lower = {order: set().union(*top.values())}
    counts = {}
    for n in range(order - 1, 0, -1):
        counts[n] = collections.Counter(g[1:] for g in lower[n + 1])
        lower[n] = set(counts[n])
    total = sum(counts[1].values())

    def p(g):
        if len(g) == 1:
            return (counts[1][g] + 0.1) / (total + 0.1 * toxicity.CHARACTERS)
        after = {x: c for x, c in counts[len(g)].items() if x[:-1] == g[:-1]}
        if not after:
            return p(g[1:])
        return (max(after.get(g, 0) - d, 0) + d * len(after) * p(g[1:])) / sum(after.values())

    def q(c, g):
        after = [n for x, n in top[c].items() if x[:-1] == g[:-1]]
        return (max(top[c][g] - d, 0) + d * len(after) * p(g[1:])) / sum(after) if after else p(g[1:])

    return lambda w: sum(math.log(q(1, g)) - math.log(q(0, g)) for g in windows(w))


def test_word_scores_equal_plain_kneser_ney(spark):
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 9))) for _ in range(400)]
    data = [(" ".join(words[k::40]), k % 2) for k in range(40)]
    training = spark.createDataFrame([(t, y, k // 2 % 2) for k, (t, y) in enumerate(data)], "text string, toxic int, fold int").repartition(3)
    uri = toxicity.score_tables(training)
    asked = [*words[:60], "a", "eeeee", "zzzz", "abz", "abcdé" * 8]
    for choice, rows in (("02", data), ("0", [x for k, x in enumerate(data) if k // 2 % 2 == 0]), ("2", [x for k, x in enumerate(data) if k // 2 % 2])):
        got = toxicity.Scores.load(uri, choice).words(asked)
        if choice != "02":
            continue  # lower orders are shared by the folds too: checked for all rows
        want = plain_kneser_ney(rows)
        assert np.allclose(got, [want(w) for w in asked], atol=1e-4)
    assert abs(toxicity.Scores.load(uri, "02").words(["zzzz"])[0]) < 20


def test_counts_are_the_same_however_they_are_flushed(spark, monkeypatch):
    rnd = random.Random(4)
    data = [(" ".join("".join(rnd.choice("abcde") for _ in range(5)) for _ in range(50)), k % 2, k // 2 % 2) for k in range(60)]
    training = spark.createDataFrame(data, "text string, toxic int, fold int")
    whole = sorted(map(tuple, toxicity.gram_counts(training).collect()))
    batches = list(training.toArrow().to_batches())
    monkeypatch.setattr(toxicity, "WORDS_KEPT", 20)
    monkeypatch.setattr(toxicity, "GRAMS_KEPT", 50)
    sums = collections.defaultdict(lambda: np.zeros(4, int))
    for b in toxicity._count_words(iter([b.slice(k, 1) for b in batches for k in range(b.num_rows)])):
        for g, *n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            sums[g] += n
    assert sorted((g, *n.tolist()) for g, n in sums.items()) == whole


def plain_terms(data, threshold, support):
    """Added spans by counts of whole documents."""
    n = max(len(data), 2)
    spans, entities, terms = [], [], []
    for text in data:
        found = []
        for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")):
            found += [(m.start(), m.end(), kind, m[0].lower()) for m in re.finditer(pattern, text) if kind == "email" or all(int(x) < 256 for x in m[0].split("."))]
        spans.append(found)
        entities.append({f[2:] for f in found})
        terms.append({w.lower() for w in re.findall(r"[^\W\d_]+", text)})
    df_e, df_t, both = (collections.Counter() for _ in range(3))
    for e, t in zip(entities, terms, strict=True):
        df_e.update(e)
        df_t.update(t)
        both.update((x, y) for x in e for y in t)
    degree = {}
    for (e, t), b in both.items():
        if min(b, df_e[e], df_t[t]) >= support and df_e[e] < n:
            d = math.log2(n * b / (df_t[t] * df_e[e])) / math.log2(n / df_e[e])
            if d >= threshold - 1e-12:
                degree[t] = max(degree.get(t, 0), d)
    out = []
    for text, found in zip(data, spans, strict=True):
        places = [m for m in re.finditer(r"[^\W\d_]+", text) if m[0].lower() in degree]
        out.append([f"term:{m.start()}:{m.end()}" for m in places if not any(a < m.end() and m.start() < b for a, b, *_ in found)])
    return out


@pytest.mark.parametrize("support", [1, 2])
def test_added_spans_equal_plain_counts(spark, support):
    rnd = random.Random(7)
    names = ["".join(rnd.choice("abcdefgé") for _ in range(6)) for _ in range(400)]
    data = []
    for k in range(160):
        words = [rnd.choice(["the", "and", "of", "to"]) if rnd.random() < 0.5 else rnd.choice(names) for _ in range(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 2)):
            who = rnd.randrange(12)
            words += [f"Aster{'abcdefghijkl'[who]}", f"u{who}@ex{who}.org" if who % 3 else f"10.0.0.{who}"]
        rnd.shuffle(words)
        data.append(" ".join(words))
    data += [data[3], data[3], "éu1@ex1.org Asterb", ""]
    docs = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: [s for s in r["spans"].split(",") if s.startswith("term")] for r in pii.find_personal_data(docs, support=support).collect()}
    want = plain_terms(data, pii.DISCLOSURE, support)
    assert [got[k] for k in range(len(data))] == want and sum(map(len, want)) > 20


def test_long_texts_take_time_in_proportion(spark):
    rnd = random.Random(8)
    many = " ".join(str(rnd.randrange(1000, 9999)) for _ in range(40_000))
    mails = " ".join(f"a{k}@b.org tel" for k in range(20_000))
    docs = spark.createDataFrame([(1, many), (2, mails), (3, mails), (4, "x" * 300_000), (5, "é" * 5000 + " 1.2.3.4 " + "日本" * 3000)], "doc_id long, text string")
    spark.range(1).select(pii.base_spans(F.lit("a@b.c 1.2.3.4"))).collect()
    begun = time.perf_counter()
    got = {r["doc_id"]: r["n"] for r in docs.select("doc_id", F.size(pii.base_spans(F.col("text"))).alias("n")).collect()}
    assert got[2] == 20_000 and got[5] == 1 and time.perf_counter() - begun < 10
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert clean[4] == "x" * 300_000 and clean[1] == many
    assert clean[2].count("<EMAIL>") == 20_000 and clean[5] == "é" * 5000 + " <IP> " + "日本" * 3000


def test_overlapping_spans_are_replaced_together(spark):
    spans = "array<struct<start:int,end:int,mark:string>>"
    text = "".join(chr(97 + k % 26) for k in range(5000))
    cases = [[], [(0, 5000, "A")], [(3, 9, "A"), (5, 20, "B"), (15, 25, "C")], [(0, 1, ""), (1, 2, "B"), (1000, 3100, "C"), (4999, 5000, "D")], [(1020, 1030, "A"), (2048, 2048, "B"), (2049, 4096, "C")]]
    df = spark.createDataFrame([(k, text, c) for k, c in enumerate(cases)], f"id int, text string, s {spans}")
    got = {r["id"]: r["t"] for r in df.select("id", pii.replaced(F.col("text"), F.col("s")).alias("t")).collect()}
    for k, c in enumerate(cases):
        out, at, k2 = [], 0, 0
        while k2 < len(c):
            a, b, mark = c[k2]
            k2 += 1
            while k2 < len(c) and c[k2][0] < b:
                b, k2 = max(b, c[k2][1]), k2 + 1
            out += [text[at:a], mark]
            at = b
        assert got[k] == "".join(out) + text[at:]


def test_terms_are_generalised_or_removed(spark):
    rows = [(k, f"filler words {chr(97 + k % 26)} number {k}") for k in range(300)]
    rows += [(300 + k, f"{n} and others wrote from q@x.org {m}") for k, (n, m) in enumerate([("Quillon", "XYZ"), ("Quillon", "XYZ"), ("Quillon", "XYZ"), ("Quillon", "also")])]
    rows += [(310, "Quillon XYZ quillon")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.sanitise(docs, removal=2.0).collect()}
    assert got[300].startswith("<NAME>") and "<EMAIL>" in got[300] and "<ACRONYM>" in got[300] and got[310] == "<NAME> <ACRONYM> <WORD>"
    gone = {r["doc_id"]: r["text"] for r in pii.sanitise(docs, removal=0.8).collect()}
    assert gone[310].strip() == "" and gone[5] == rows[5][1]


def test_near_duplicates_broadcast_nothing_that_grows(spark, docs, monkeypatch):
    """What Spark's limit of a broadcast is held against is compressed; the classes are many times larger in the driver."""
    from quarry.llm import neardup

    plans, write = [], neardup.written

    def noted(df, *a, **b):
        out = write(df, *a, **b)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(neardup, "written", noted)
    found = neardup.one_of_each(docs)
    found.collect()
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) >= 5 and not any("BroadcastHashJoin" in p for p in plans)
