"""Operators that look at the whole corpus, against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import chat, graph, neardup, pii, sharding, suffixes, toxicity

from .conftest import SCHEMA, rows


def plain_components(data, width, percent):
    """All pairs on full sets."""
    sets = []
    for _, t in data:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        k = min(width, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    parent = list(range(len(data)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(data)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(data):
        best[find(i)] = min(best.get(find(i), d), d)
    return sorted((d, len(s), best[find(i)]) for i, ((d, _), s) in enumerate(zip(data, sets, strict=True)))


def near_copies(n, seed=3):
    """A hot group of near copies, some of which link only through others."""
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abcdeinorst") for _ in range(5)) for _ in range(150)]
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(rnd.randint(0, 9)):
            w[rnd.randrange(len(w))] = f"w{rnd.randrange(1000)}"
        out.append((k, " ".join(w)))
    return out


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_lose_no_link(spark, monkeypatch, width, percent):
    monkeypatch.setattr(neardup, "BLOCK_SETS", 16)  # several blocks
    data = [(r[0], r[1]) for r in rows() if r[0] is not None] + [(k + 100, t) for k, t in near_copies(90)]
    got = neardup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), width, percent).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == plain_components(data, width, percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_of_odd_input(spark, docs, nothing):
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    assert neardup.near_duplicates(nothing).count() == 0
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(6) == 1 and 7 not in ids and 8 not in ids
    assert 14 in ids and ids.count(None) == 2


def test_a_chain_of_loose_copies_joins_nothing(spark):
    """Neighbours share half of their shingles: bucket mates by chance, links never; rows grow with the documents."""
    rnd = random.Random(6)
    words = ["".join(rnd.choice("abcdeinorst") for _ in range(6)) for _ in range(30 * 1001)]
    data = [(k, " ".join(words[30 * k : 30 * k + 90])) for k in range(1000)]
    data += [(2000 + k, data[k][1].replace(" ", " x ", 1)) for k in range(0, 1000, 100)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    heads = neardup.sketches(df, 3, neardup.bands_for(0.85)).select(F.monotonically_increasing_id().alias("class"), "bands", "signature")
    heads = neardup.written(heads, "heads")[0]
    assert neardup.likely_links(heads, neardup.least_agreeing(0.85)).count() < len(data) / 10
    got = neardup.near_duplicates(df, 3, 85).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == plain_components(data, 3, 85)


def test_names_do_not_clash(spark, docs):
    odd = docs.withColumns({"__id": F.lit(1), "__key": F.lit("k"), "__spans": F.lit(2), "__terms": F.lit(3), "row": F.lit(4), "terms": F.lit(5), "spans": F.lit(6), "text_": F.lit(7)})
    for out in (neardup.one_of_each(odd), suffixes.without_repeats(odd), pii.sanitise(odd)):
        assert out.columns == odd.columns
        r = out.where("doc_id = 14").first()
        assert (r["__id"], r["__key"], r["__spans"], r["__terms"], r["row"], r["terms"], r["spans"]) == (1, "k", 2, 3, 4, 5, 6)


def test_estimates_are_close():
    rnd = np.random.default_rng(1)
    a = np.unique(rnd.integers(0, 1 << 62, 900, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:700], rnd.integers(0, 1 << 62, 200, dtype=np.uint64)]))
    agree = int(((neardup.minima(a) & np.uint64(15)) == (neardup.minima(b) & np.uint64(15))).sum())
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((agree / neardup.MINIMA - 1 / 16) / (1 - 1 / 16) - true) < 0.15


def test_common_counts():
    rnd = np.random.default_rng(2)
    left = [np.unique(rnd.integers(0, 300, rnd.integers(1, 90), dtype=np.uint64)) for _ in range(40)]
    right = [np.unique(rnd.integers(0, 300, rnd.integers(1, 90), dtype=np.uint64)) for _ in range(30)]
    got = neardup.common_counts(left, right)
    assert all(got[i, j] == len(np.intersect1d(x, y)) for i, x in enumerate(left) for j, y in enumerate(right))


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (8, 7), (20, 20)] + [(100, 100 + k) for k in range(1, 40)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert {got[k] for k in (1, 2, 3, 4, 5)} == {1} and {got[k] for k in (7, 8, 9)} == {7} and got[139] == 100 and got[20] == 20


def plain_removal(texts, n=suffixes.LENGTH):
    counts = collections.Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if counts[t[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        left = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(t), len(t) - len(left), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out)


suffixes_between = suffixes.between


def _few(sums, a, b):
    return suffixes_between(sums, a, b) & np.uint64(7)


def repeats(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abé日c") for _ in range(rnd.randint(1, 6)))
    shared = [" ".join(word() for _ in range(rnd.randint(30, 120))) for _ in range(6)]
    out = []
    for _ in range(60):
        t = " ".join(word() for _ in range(rnd.randint(0, 80)))
        for _ in range(rnd.randint(0, 3)):
            s = rnd.choice(shared)
            a, b = sorted((rnd.randrange(len(s)), rnd.randrange(len(s))))
            t += s[a:b] + word()
        out.append(t)
    return [*out, "ab" * 400, "ab" * 150, "x" * 199, "x" * 200, out[5], out[5]]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeated_strings(spark, seed):
    texts = repeats(seed)
    got = suffixes.removed_bytes(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)).collect()
    assert sorted(tuple(r)[1:] for r in got) == plain_removal([t.encode() for t in texts])


@pytest.mark.parametrize("parts", [1, 40])
def test_repeated_strings_over_many_ranges(spark, monkeypatch, parts):
    """Few bytes a range: groups are split, their strings compared across boundaries."""
    monkeypatch.setattr(suffixes, "RANGE_BYTES", 60_000 // parts)
    rnd = random.Random(9)
    passage = "".join(rnd.choice("abcdef ") for _ in range(420))
    texts = repeats(5) + ["".join(rnd.choice("xyz ") for _ in range(rnd.randint(0, 300))) + passage[rnd.randint(0, 60) : rnd.randint(330, 420)] + "".join(rnd.choice("xyz ") for _ in range(90)) for _ in range(80)]
    got = suffixes.removed_bytes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()
    assert sorted(tuple(r)[1:] for r in got) == plain_removal([t.encode() for t in texts])


def test_strings_are_compared_by_bytes(spark, monkeypatch):
    """Hashes of strings that say little: results stand on the bytes."""
    monkeypatch.setattr(suffixes, "between", lambda sums, a, b: _few(sums, a, b) if len(a) and (b - a)[0] == suffixes.LENGTH else suffixes_between(sums, a, b))
    raws = [t.encode() for t in repeats(6)[:30]]
    group = next(suffixes.stretches(raws))
    u = suffixes.Units(group)
    rows_ = list(suffixes.compare_range([u.raw[a : a + n - 1 + suffixes.LENGTH] for a, n in zip(u.start.tolist(), u.count.tolist(), strict=True)], u.left, u.number.astype(np.int64), u.first.astype(np.int64)))
    gone = [bytearray(len(r)) for r in raws]
    for rid, spans in [r for r in rows_ if len(r) == 2]:
        for a, b in zip(spans[0::2], spans[1::2], strict=True):
            gone[rid][a:b] = b"\1" * (b - a)
    left = [bytes(c for c, g in zip(r, f, strict=True) if not g) for r, f in zip(raws, gone, strict=True)]
    want = plain_removal(raws)
    assert sorted((len(r), len(r) - len(x)) for r, x in zip(raws, left, strict=True)) == sorted(w[:2] for w in want)


def test_repeated_strings_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BATCH_BYTES", 700)  # long texts in overlapping stretches
    texts = repeats(4)
    rows_ = [p for g in suffixes.stretches([t.encode() for t in texts]) for p in g]
    assert any(a > 0 for _, a, _ in rows_)
    units = [suffixes.Units(g) for g in suffixes.stretches([t.encode() for t in texts])]
    assert sum(int(u.count.sum()) for u in units) == sum(max(0, len(t.encode()) - suffixes.LENGTH + 1) for t in texts)


def test_repeated_strings_of_odd_input(spark, docs, nothing):
    got = suffixes.removed_bytes(docs).collect()
    assert sorted(tuple(r)[1:] for r in got) == plain_removal([(r[1] or "").encode() for r in rows()])
    out = suffixes.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert all(r["text"] is None or len(r["text"]) == r["n_chars"] for r in out.collect())
    assert suffixes.removed_bytes(nothing).count() == 0


def test_multikey_quicksort():
    rnd = np.random.default_rng(3)
    cols = [rnd.integers(0, 5, 30_000), rnd.integers(-3, 9, 30_000), rnd.integers(0, 1 << 40, 30_000)]
    order = suffixes.multikey_quicksort(cols)
    want = np.lexsort(cols[::-1])
    assert all((c[order] == c[want]).all() for c in cols)


def toxic_corpus(spark, n=900):
    rnd = random.Random(8)
    bad = ["zorblat", "zorbling", "zorbed", "zorbish"]
    docs, labels = [], []
    for k in range(n):
        w = ["".join(rnd.choice("abcdeinorst") for _ in range(rnd.randint(2, 8))) for _ in range(rnd.randint(5, 120))]
        y = int(rnd.random() < 0.3)
        for _ in range(3 * y):
            w[rnd.randrange(len(w))] = rnd.choice(bad)
        docs.append((k, " ".join(w)))
        labels.append((k, y))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_toxicity_of_held_out_rows(spark):
    docs, labels, truth = toxic_corpus(spark)
    got = [r for r in toxicity.score_documents(docs, labels).collect() if r["held_out"]]
    right = sum(r["predicted"] == truth[r["doc_id"]] for r in got)
    assert len(got) > 200 and right / len(got) > 0.95


def test_held_out_labels_play_no_part(spark):
    docs, labels, _ = toxic_corpus(spark, 300)
    crc = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    turned = labels.withColumn("toxic", F.when(crc == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, labels).collect()}
    b = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, turned).collect()}
    assert all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_toxicity_of_odd_input(spark, docs, nothing):
    _, labels, _ = toxic_corpus(spark, 30)
    assert toxicity.score_documents(docs, labels).count() == docs.count()
    assert all(r["score"] == 0 for r in toxicity.score_documents(docs, labels.limit(0)).collect())
    assert toxicity.score_documents(nothing, labels).count() == 0
    assert toxicity.without_toxic(docs, labels.limit(0)).count() == docs.count()


def test_compaction(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store")
    data = [(k, None if k == 3 else "x" * (k % 7) * 100, k) for k in range(100)] + [(None, "no id", 1), (5, "again", 2)]
    df = spark.createDataFrame(data, "doc_id long, text string, shard int")
    arrival = sharding.arrival_of(F.col("doc_id"), F.col("text"), 10)
    assert store.append(df, arrival) == 1
    before = store.shards().count()
    assert store.compact(target=8000) == 2
    after = store.shards().collect()
    assert len(after) < before and sum(s["rows"] for s in after) == len(data)
    got = store.read().select("doc_id", "text", "shard").collect()
    assert sorted(map(str, got)) == sorted(map(str, df.collect()))
    with pytest.raises(sharding.Conflict):
        store.commit(1, store.shards(), df.schema, {})
    assert store.append(df.limit(3), arrival) == 3 and store.read().count() == len(data) + 3
    assert store.compact(target=8000, keep_versions=2) == 4 and store.versions() == [3, 4]
    assert store.read(3).count() == store.read().count() == len(data) + 3


def test_the_loser_of_a_race_starts_again(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store")
    df = spark.createDataFrame([(k, "x") for k in range(20)], "doc_id long, text string")
    commit, lost = store.commit, []

    def late(base, *rest):
        if not lost:
            lost.append(base)
            commit(base, *rest)  # another writer takes the version
        return commit(base, *rest)

    store.commit = late
    assert store.append(df, F.lit(1)) == 2
    assert len([p for p in (tmp_path / "store" / "data").iterdir()]) == 1  # what the lost attempt wrote is gone


def test_schemas_merge_or_are_refused(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store")
    a = spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string")
    store.append(a, F.lit(1))
    store.append(a.select("doc_id", "text").withColumn("n", F.lit(7)), F.lit(2))
    assert sorted(map(tuple, store.read().select("doc_id", "text", "lang", "n").collect()), key=str) == [(1, "a", "en", None), (1, "a", None, 7)]
    assert store.compact() == 3
    assert sorted(map(tuple, store.read().select("doc_id", "text", "lang", "n").collect()), key=str) == [(1, "a", "en", None), (1, "a", None, 7)]
    with pytest.raises(sharding.SchemaChange):
        store.append(a.withColumn("lang", F.lit(1)), F.lit(3))
    assert store.versions() == [3]


def test_store_of_odd_input(spark, tmp_path, nothing):
    names = ["__to", "__number", "__shard", "__arrival", "shard", "arrival", "row", "write", "bytes", "a.b", "__p", "__i"]
    df = spark.createDataFrame([(1, "t", *names), (1, "t", *names), (2, None, *names)], ["doc_id", "text", *names])
    store = sharding.ShardStore(spark, f"file://{tmp_path}/odd")
    store.append(df, F.floor(F.col("doc_id")))
    store.compact()
    assert store.read().columns == df.columns and sorted(map(str, store.read().collect())) == sorted(map(str, df.collect()))
    empty = sharding.ShardStore(spark, f"file://{tmp_path}/empty")
    assert empty.compact() == 0
    assert empty.append(nothing, F.lit(1)) == 1 and empty.compact() == 1 and empty.read().count() == 0
    assert empty.append(nothing.select("doc_id", "text"), F.lit(1)) == 2 and empty.read().columns == nothing.columns
    assert sharding.compacted_documents(nothing).count() == 0


def test_plan_in_ranges_equals_a_plain_one(spark):
    rnd = random.Random(5)
    shards = [(f"s{k}", "w", rnd.choice([10, 5000, 300_000, 2_000_000, 40 << 20]) + k, 1, k) for k in range(300)]
    got = {r["shard"]: r["merged"] for r in sharding.plan(spark.createDataFrame(shards, sharding.SHARDS), 4 << 20).collect()}
    runs, upto = collections.defaultdict(list), collections.Counter()
    for name, _, size, _, _ in shards:
        tier = sum(size >= sharding.TIER_BYTES * sharding.FANOUT**k for k in range(sharding.TIERS))
        if size < 4 << 20:
            runs[tier, upto[tier] // (4 << 20)].append(name)
            upto[tier] += size
    want = {s[0]: s[0] for s in shards} | {n: f"t-{t}-{r}" for (t, r), names in runs.items() if len(names) > 1 for n in names}
    assert got == want


def test_compaction_equals_sql(spark, tmp_path):
    import duckdb

    rnd = random.Random(3)
    docs = spark.createDataFrame([(k, "ä" * rnd.randrange(5000)) for k in range(600)], "doc_id long, text string")
    path = str(tmp_path / "documents.parquet")
    docs.toPandas().to_parquet(path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    got = sharding.compacted_documents(docs)
    assert sorted(map(tuple, got.select("doc_id", "arrival", "shard", "n_bytes", "text_sha256").collect())) == sorted(con.sql(sharding.SQL).fetchall())


def conversations(spark, n=60, turns=9):
    rnd = random.Random(9)
    out = []
    for c in range(n):
        for t in range(turns):
            role = "system" if t == 0 and c % 3 == 0 else "user" if t % 2 else "assistant"
            q = "?" if role == "user" else "."
            out.append((c, t, role, "\n".join("".join(rnd.choice("abcde ") for _ in range(30)) + q for _ in range(rnd.randint(1, 3)))))
    return out


def test_chat_roles_are_recovered(spark):
    data = conversations(spark)
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    got = chat.format_conversations(df).collect()
    assert len(got) == 60
    held = [r for r in got if r["held_out"]]
    assert 10 < len(held) < 30 and sum(r["n_right"] for r in held) / sum(r["n_labelled"] for r in held) > 0.95
    assert all(r["rendered"].count("<|end|>") == r["n_turns"] for r in got)


def test_held_out_conversations_teach_nothing(spark):
    data = conversations(spark)
    turned = [(c, t, {"user": "assistant", "assistant": "user"}.get(r, r) if zlib.crc32(str(c).encode()) % 3 == 1 else r, x) for c, t, r, x in data]
    schema = "conv_id long, turn long, role string, text string"
    keep = lambda d: chat.write_transcripts(spark.createDataFrame(d, schema)).where(F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(3)) != 1)
    a, b = chat.train(keep(data)), chat.train(keep(turned))
    assert np.array_equal(a.step, b.step) and np.array_equal(a.emit, b.emit)


def test_transcripts_given_as_text(spark):
    df = spark.createDataFrame(conversations(spark), "conv_id long, turn long, role string, text string")
    hmm = chat.train(chat.write_transcripts(df))
    text = "Human: what is this?\n\nAssistant: an answer of some length, as they are\nQ: is no marker in here, it goes on\n\nA\nHuman: and this?\nAssistant: it is that."
    given = spark.createDataFrame([(1, 0, text), (2, 0, None), (3, 0, " \n\n "), (4, 1, "Assistant: b."), (4, 0, "Human: a?"), (None, None, "Human: x?")], "conv_id long, part long, text string")
    got = {(r["conv_id"], r["part"]): r for r in chat.parse_transcripts(given, hmm).collect()}
    assert got[1, 0]["rendered"].startswith("<|user|>\nwhat is this?\n<|end|>\n<|assistant|>\nan answer")
    for line in ("is no marker in here, it goes on", "and this?\n<|end|>\n<|assistant|>\nit is that.\n<|end|>\n"):
        assert line in got[1, 0]["rendered"]
    assert got[2, 0]["rendered"] == got[3, 0]["rendered"] == ""
    assert got[4, 0]["rendered"] + got[4, 1]["rendered"] == "<|user|>\na?\n<|end|>\n<|assistant|>\nb.\n<|end|>\n"
    assert got[-1, -1]["n_turns"] == 1


def test_markers_go_only_where_a_turn_begins():
    goes_on, begins = chat.STATES.index(("assistant", False)), chat.STATES.index(("assistant", True))
    text = "AI: x\nQ: y\nA\n\nAI: z"
    assert chat.render(text, [begins, goes_on, goes_on, begins], True, True) == "<|assistant|>\nx\nQ: y\nA\n<|end|>\n<|assistant|>\nz\n<|end|>\n"
    assert chat.render("more\n\nstill", [goes_on, goes_on], False, False) == "more\n\nstill\n"


def test_chat_parts_equal_one_pass(spark, monkeypatch):
    df = spark.createDataFrame(conversations(spark, 6, 40), "conv_id long, turn long, role string, text string")
    whole_parts = chat.written(chat.write_transcripts(df), "whole")[0]
    hmm = chat.train(whole_parts)
    whole = {r["conv_id"]: (r["rendered"], r["states"]) for r in chat.parse(whole_parts, hmm).collect()}
    monkeypatch.setattr(chat, "SEGMENT", 7)
    parts = collections.defaultdict(list)
    for r in chat.parse(chat.written(chat.write_transcripts(df), "parts")[0], hmm).collect():
        parts[r["conv_id"]].append((r["segment"], r["part"], r["rendered"], r["states"]))
    assert all(len(p) == 6 for p in parts.values())
    same = [c for c in whole if sum((x[3] for x in sorted(parts[c])), []) == whole[c][1]]
    assert len(same) >= 5  # a blank line between two parts is not seen: that may move a state
    assert all("".join(x[2] for x in sorted(parts[c])).replace("\n\n", "\n") == whole[c][0].replace("\n\n", "\n") for c in same)


def test_viterbi_is_the_best_path():
    rnd = np.random.default_rng(5)
    n = len(chat.STATES)
    hmm = chat.Hmm(rnd.integers(0, 9, n).astype(float), rnd.integers(0, 9, (n, n)).astype(float), rnd.integers(0, 9, (n, chat.N_OBSERVATIONS)).astype(float))
    seen = rnd.integers(0, chat.N_OBSERVATIONS, 5).tolist()
    states, before = hmm.path(seen, hmm.entry(), None)
    assert before == hmm.outside

    def score(path):
        at, s = hmm.outside, 0.0
        for p, o in zip(path, seen, strict=True):
            s += hmm.step[at, p] + hmm.emit[p, o]
            at = p
        return s

    import itertools

    best = max(score(p) for p in itertools.product(range(n), repeat=5))
    assert abs(score(states) - best) < 1e-9
    m = hmm.matrix(seen[:2])[hmm.outside]
    assert abs(max((m[:, None] + hmm.matrix(seen[2:])).max(0)) - best) < 1e-9


def test_chat_of_odd_input(spark):
    data = [(1, 0, None, None), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, None, "assistant", ""), (2, 5, "critic", "x: y\n\n\nz")]
    schema = "conv_id long, turn long, role string, text string"
    got = {r["conv_id"]: r for r in chat.format_conversations(spark.createDataFrame(data, schema)).collect()}
    assert set(got) == {1, -1, 2} and (got[1]["n_lines"], got[1]["n_labelled"]) == (5, 4) and got[2]["n_labelled"] == 0 and got[2]["accuracy"] == 1.0
    assert chat.format_conversations(spark.createDataFrame([], schema)).count() == 0
    odd = spark.createDataFrame([(1, 0, "user", "a", 1, 2, 3, 4)], schema + ", segment int, part int, turns int, n int")
    assert chat.format_conversations(odd).count() == 1
    many = [(6, 0, "user", f"line {k}") for k in range(3000)] + [(7, 0, "user", "the same")] * 3000
    got = chat.format_conversations(spark.createDataFrame(many, schema)).collect()
    for c in (6, 7):
        assert sum(r["n_lines"] for r in got if r["conv_id"] == c) >= 3000 and len([r for r in got if r["conv_id"] == c]) > 1
