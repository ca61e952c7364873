"""Operators that work text by text, against the libraries or a plain version."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import sentencepiece
import xxhash
from tokenizers import Tokenizer

from quarry.llm import fingerprints, media, packing, pieces, pii

from .conftest import rows


def texts():
    return [r[1] or "" for r in rows()]


def test_pieces_equal_the_library(spark, docs, nothing):
    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    want = sorted((len(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(sp.decode(i).encode()).hexdigest()) for i in map(sp.encode, texts()))
    got = pieces.encode_documents(docs, path).collect()
    assert sorted(tuple(r)[1:] for r in got) == want
    assert pieces.encode_documents(nothing, path).count() == 0


def test_pieces_of_random_texts():
    path = P.path("piece_bpe_32k.model")
    sp, model = sentencepiece.SentencePieceProcessor(model_file=path), pieces.PieceModel(path)
    rnd = random.Random(2)
    for _ in range(3000):
        t = "".join(rnd.choice("abcdetnsoi  .,\né日▁<0x>1") for _ in range(rnd.randint(0, 40)))
        ids = sp.encode(t)
        assert model.encode(t) == ids
        assert model.decode(ids) == sp.decode(ids)


def test_media_round_trip(spark, docs, nothing):
    want = set()
    for t in texts():
        e = t.encode()
        p = e + bytes(max(64, -(-len(e) // 64) * 64) - len(e))
        want.add((len(e), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    addresses, base = media.media_table(docs)
    got = media.read_media(addresses, base).collect()
    assert len(got) == len(texts())
    assert {tuple(r)[1:5] for r in got} == want
    heads = media.header_metadata(addresses, base).collect()
    assert {(r["n_bytes"], r["payload_bytes"]) for r in heads} == {w[:2] for w in want}
    by_hash = {}
    for r in got:  # equal texts, equal values
        assert by_hash.setdefault((r["payload_sha256"], r["n_bytes"]), tuple(r)[1:]) == tuple(r)[1:]
    assert media.media_features(nothing).count() == 0


def test_media_shards_are_tar(spark, docs, tmp_path):
    import tarfile

    addresses, _ = media.media_table(docs)
    a = addresses.first()
    with tarfile.open(a["shard"]) as t:
        assert f"{a['digest']}.png" in t.getnames()


def plain_canonical(t):
    import unicodedata

    n = unicodedata.normalize("NFKC", t)
    n = unicodedata.normalize("NFKC", n.casefold())
    return re.sub(r"\s+", " ", n).strip()


def test_fingerprints(spark, docs, nothing):
    data = [(r[0], r[1] or "") for r in rows()]
    got = fingerprints.edit_likeness(docs).collect()
    assert len(got) == len(data)
    canon = [plain_canonical(t) for _, t in data]
    for r in got:  # each row by a text that it may stand for
        mine = [k for k, (i, t) in enumerate(data) if i == r["doc_id"] and len(t) == r["n_chars"] and xxhash.xxh3_128_hexdigest(canon[k].encode()) == r["fingerprint"]]
        assert mine
        copies = [data[k][0] for k in range(len(data)) if canon[k] == canon[mine[0]]]
        assert r["members"] == len(copies)
        assert r["group_id"] == min((i for i in copies if i is not None), default=None)
    alone = [(i, t) for i, t in data if i is not None and sum(1 for j, _ in data if j == i) == 1]
    ordered = sorted(data, key=lambda x: (x[0] is None, -(x[0] or 0)))
    by_id = {r["doc_id"]: r for r in got}
    for i, t in alone:
        k = ordered.index((i, t))
        nxt = ordered[k + 1]
        if nxt[0] is None or sum(1 for j, _ in data if j == nxt[0]) > 1:
            continue
        n = len(t) // 3
        e = t[: len(t) - n] + nxt[1][:n] if n else t
        r = by_id[i]
        assert r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert r["edited_fingerprint"] == xxhash.xxh3_128_hexdigest(plain_canonical(e).encode())
        assert r["near_next"] == float(plain_canonical(t) == plain_canonical(nxt[1]))
        assert r["near_edited"] == float(plain_canonical(t) == plain_canonical(e))
    assert fingerprints.edit_likeness(nothing).count() == 0


def test_each_document_has_one_next(spark):
    """Without ids, and with many of them: every text but for the first is some document's next."""
    for data in ([(None, f"text {k}" * 9) for k in range(300)], [(k if k % 3 else None, f"text {k} " * 9) for k in range(300)], [(7, "only one text")]):
        got = fingerprints.edit_likeness(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect()
        want = {hashlib.sha256((t[: len(t) - len(t) // 3] + n[: len(t) // 3]).encode()).hexdigest(): (t, n) for _, t in data for _, n in data}
        pairs = [want[r["edited_sha256"]] for r in got]
        assert len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(data)


def test_equal_digests_are_compared_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "digest", lambda c: str(len(c)))
    data = [(1, "abc"), (2, "abd"), (3, "ABC"), (4, "abd "), (5, "wxyz")]
    batches = spark.createDataFrame(data, "doc_id long, text string")
    rows_ = [(i, str(len(fingerprints.canonical(t))), fingerprints.canonical(t)) for i, t in data]
    monkeypatch.setattr(fingerprints, "fingerprints", lambda d: spark.createDataFrame(rows_, fingerprints.GROUPS))
    got = {(r["fingerprint"], r["group_id"], r["members"]) for r in fingerprints.fingerprint_groups(batches).collect()}
    assert got == {("3", 1, 2), ("3", 2, 2)}


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(t):
    def ok(kind, v):
        d = re.sub(r"[^0-9]", "", v)
        if kind == "ip":
            return all(int(x) <= 255 for x in v.split("."))
        if kind == "card":
            return 14 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(d[::-1])) % 10 == 0
        return kind == "email" or 10 <= len(d) <= 15

    return sorted((m.start(), k, m.end(), n) for k, (n, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, t) if ok(n, m[0]))


def test_personal_data(spark, docs, nothing):
    got = pii.find_personal_data(docs, support=1).collect()
    want = sorted((r[0] is None, r[0] or 0, hashlib.sha256(",".join(f"{n}:{a}:{b}" for a, _, b, n in plain_spans(r[1] or "")).encode()).hexdigest()) for r in rows())
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["base_sha256"]) for r in got) == want
    found = {r["doc_id"]: r for r in got}
    assert (found[11]["n_email"], found[11]["n_ip"], found[11]["n_card"], found[11]["n_phone"]) == (1, 1, 1, 1)
    assert "term:" in found[11]["spans"]  # its rare words disclose its entities
    assert found[14]["spans"] == ""
    assert pii.find_personal_data(nothing).count() == 0


def test_sanitise_keeps_columns_and_rows(spark, docs):
    out = pii.sanitise(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    text = {r["doc_id"]: r["text"] for r in out.collect()}
    assert "<EMAIL>" in text[11] and "bob.smith" not in text[11] and "<IP>" in text[11] and "10.0.0.256" in text[11]
    assert text[0] is None and text[14] == dict((r[0], r[1]) for r in rows())[14]


def test_tokens_of_chunks_equal_the_library():
    path = P.path("word_bpe_49k.json")
    tok, rnd = Tokenizer.from_file(path), random.Random(4)
    ts = texts() + ["".join(rnd.choice("aAbé ÉßİıſŉĸẞΣĀżÞ日.,;'s!?*$%&#+=~@()[]{}\n\t10<|>̀") for _ in range(rnd.randint(0, 30))) for _ in range(2000)]
    flat, ends = packing.TextIds(path).documents(pa.array(ts))
    for t, a, b in zip(ts, [0, *ends.tolist()], ends.tolist(), strict=False):
        assert flat[a:b].tolist() == [*tok.encode(t, add_special_tokens=False).ids, 1]


def test_packing(spark, docs, nothing):
    path = P.path("word_bpe_49k.json")
    got = packing.pack_documents(docs, path, 64).collect()
    tok = Tokenizer.from_file(path)
    want = []
    for r in rows():
        ids = np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(r[0] or 0, k, a, len(ids[a : a + 64]), zlib.crc32(ids[a : a + 64].tobytes())) for k, a in enumerate(range(0, len(ids), 64))]
    assert sorted((r["doc_id"] or 0, *tuple(r)[1:5]) for r in got) == sorted(want)
    used = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used.get(r["sequence_id"], 0)
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(used.values()) <= 64 and len(used) <= 1.02 * -(-sum(used.values()) // 64) + 1
    assert packing.pack_documents(nothing, path).count() == 0


def test_packing_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_PIECES", 100)
    rnd = random.Random(1)
    data = [(k, 0, 0, rnd.randint(1, 60), 0) for k in range(450)]
    got = packing.pack(spark.createDataFrame(data, packing.PIECES), 100).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(450))
    assert len({r["sequence_id"] for r in got}) <= 1.05 * sum(d[3] for d in data) / 100 + 1


def test_packing_reports_what_the_search_gained(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_PIECES", 700)
    rnd = random.Random(2)
    pieces_ = [(k, 0, 0, rnd.randint(900, 2600), 0) for k in range(1400)]
    got = packing.report(spark.createDataFrame(pieces_, packing.PIECES)).collect()
    assert sum(r["n_pieces"] for r in got) == 1400
    assert all(r["n_least"] <= r["n_bins"] <= r["n_best_fit"] for r in got) and any(r["n_bins"] < r["n_best_fit"] for r in got)


def test_pieces_take_time_in_proportion():
    import time

    model = pieces.PieceModel(P.path("piece_bpe_32k.model"))
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    rnd = random.Random(4)
    seconds = []
    for n in (20_000, 160_000):
        t = "".join(rnd.choice("abcdetnsoi") for _ in range(n))
        begun = time.perf_counter()
        ids = model.encode(t)
        seconds.append(time.perf_counter() - begun)
        assert ids == sp.encode(t)
    assert seconds[1] < 24 * seconds[0] + 0.5


def test_kept_words_are_bounded(monkeypatch):
    words = pieces._Words(pieces.PieceModel(P.path("piece_bpe_32k.model")))
    monkeypatch.setattr(pieces, "BYTES_KEPT", 5000)
    rnd = random.Random(5)
    texts_ = [" ".join("".join(rnd.choice("abcde") for _ in range(6)) for _ in range(20)) for _ in range(30)]
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for t in texts_:
        (ids, n, text), *_ = list(pieces._encoded(words, pa.array([t])))
        assert ids == ",".join(map(str, sp.encode(t))) and n == len(sp.encode(t)) and text[1:] == t
        assert words.size < 60_000


def test_genetic_search_beats_best_fit():
    rnd = random.Random(6)
    cases = {"halves": [rnd.randint(900, 2600) for _ in range(1500)], "triples": [rnd.randint(1100, 1500) for _ in range(600)]}
    gained = 0
    for lengths in cases.values():
        n = len(lengths)
        first = packing.best_fit(sorted(range(n), key=lambda i: -lengths[i]), lengths, [], [], 4096)
        found = packing.evolve(lengths, [], random.Random(1), 4096)[0]
        assert sorted(i for b in found.bins for i in b) == list(range(n))
        assert all(sum(lengths[i] for i in b) == f <= 4096 for b, f in zip(found.bins, found.fills, strict=True))
        assert -(-sum(lengths) // 4096) <= len(found.bins) <= len(first.bins)
        gained += len(first.bins) - len(found.bins)
    assert gained >= 5


def test_small_packings_are_the_least():
    import itertools

    def fewest(lengths, capacity):
        """The least number of bins by trying all ways."""
        best = len(lengths)

        def go(k, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if k == len(lengths):
                best = len(bins)
                return
            for b in range(len(bins)):
                if bins[b] + lengths[k] <= capacity:
                    bins[b] += lengths[k]
                    go(k + 1, bins)
                    bins[b] -= lengths[k]
            go(k + 1, [*bins, lengths[k]])

        go(0, [])
        return best

    rnd = random.Random(7)
    for _ in itertools.repeat(None, 60):
        lengths = [rnd.randint(1, 10) for _ in range(rnd.randint(1, 9))]
        found = packing.evolve(lengths, [], rnd, 12)[0]
        assert len(found.bins) == fewest(sorted(lengths, reverse=True), 12) >= packing.least_bins(lengths, 12)
