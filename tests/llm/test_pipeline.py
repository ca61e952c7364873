"""The whole pipeline against plain versions of its stages, one after the other."""

import random
import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from .test_corpus import plain_components


def corpus():
    """Clean and toxic prose, near copies, a passage in several documents, personal data, empty and null texts, a long text."""
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choice("abcdeinorst") for _ in range(rnd.randint(3, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    passage, docs, toxic = prose(70), [], set()
    for k in range(360):
        words = prose(rnd.randint(40, 120)).split(" ")
        if k % 4 == 0:
            toxic.add(k)
            for _ in range(6):
                words[rnd.randrange(len(words))] = rnd.choice(["zorblat", "zorbling", "zorbish", "kwexzorb"])
        if k % 30 == 7:
            words.insert(len(words) // 2, passage)
        if k % 25 == 3:
            words.insert(5, f"user{k}@mail{k}.org")
        docs.append((k, " ".join(words)))
    base = docs[9][1].split(" ")
    for j in range(5):
        copy = list(base)
        copy[20 + j] = "changed"
        docs.append((400 + j, " ".join(copy)))
    docs += [(500, docs[10][1]), (501, ""), (502, None), (503, prose(9000)), (504, " ".join(vocabulary[:2]))]
    return docs, toxic


def without(texts, n=200):
    """Characters whose bytes all lie in strings of n bytes that occur again go."""
    counts = {}
    raws = [t.encode() for t in texts]
    for r in raws:
        for i in range(len(r) - n + 1):
            counts[r[i : i + n]] = counts.get(r[i : i + n], 0) + 1
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - n + 1):
            if counts[r[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        out.append(bytes(c for c, g in zip(r, gone, strict=True) if not g).decode())
    return out


def test_pipeline_equals_plain_stages(spark, tmp_path):
    docs, toxic = corpus()
    home = str(tmp_path / "data")
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i, _ in docs if i < 360], "doc_id long, quality int, toxic int").write.parquet(f"{home}/labels.parquet")
    got = {(r["doc_id"], r["piece"]): r for r in corpus_pipeline.run(spark, home).collect()}

    left = [(i, t) for i, t in docs if i not in toxic]  # the model must tell these words
    kept = {i for i, _, c in plain_components(left, 5, 80) if i == c}
    left = [(i, t) for i, t in left if i in kept]
    texts = without([t or "" for _, t in left])
    texts = [re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "<EMAIL>", t) for t in texts]
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = {}
    for (i, _), t in zip(left, texts, strict=True):
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4")
        for k, a in enumerate(range(0, len(ids), 4096)):
            want[i, k] = (a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes()))
    assert got.keys() == want.keys()
    assert {k: (r["start"], r["length"], r["ids_crc32"]) for k, r in got.items()} == want
    used = {}
    for r in sorted(got.values(), key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used.get(r["sequence_id"], 0)
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(used.values()) <= 4096 and len(used) <= -(-sum(used.values()) // 4096) + 1


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    home = str(tmp_path / "data")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{home}/labels.parquet")
    for rows in ([], [(1, None, None, None, None), (None, "a text", "en", None, 6), (1, "a text", "en", "s", 6)]):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, home)
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
            assert (out.count() == 0) == (not rows)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, home).count() == len(rows)
