"""Document fingerprints: canonical exact digests.

A text is canonical after Unicode normalisation (NFKC, case folding, NFKC again) and after every run of
white space became one space. Its fingerprint is the 128-bit XXH3 of that form; documents of one
fingerprint are compared byte for byte before they share a group.

Null texts are empty texts and share the empty fingerprint. Rows with a null id are kept and order after
all others. Repeated rows are separate documents; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import unicodedata

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, tasks_for, texts, written

GROUPS = "doc_id long, fingerprint string, canonical string"


def canonical(text: str) -> str:
    """The folded form that a fingerprint stands for."""
    if text.isascii():
        return " ".join(text.lower().split())
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split())


def digest(canon: str) -> str:
    return xxhash.xxh3_128_hexdigest(canon.encode("utf-8", "surrogatepass"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint, canonical)`` of each document."""

    def factory():
        def work(ids, ts):
            canon = [canonical(t) for t in ts]
            return {"doc_id": pa.array(ids, pa.int64()), "fingerprint": [digest(c) for c in canon], "canonical": canon}

        return work

    return map_rows(texts(docs), factory, GROUPS)


def fingerprint_groups(docs: DataFrame) -> DataFrame:
    """``(fingerprint, check, group_id, members)`` of the documents that have a copy: groups of equal canonical bytes.

    The grouping key is the digest and, inside its bucket, the canonical text itself, which the aggregate compares byte by byte;
    texts of equal digests but other bytes are groups of their own. ``group_id`` is the least id, ``check`` the
    SHA-256 of the text, by which rows find their group. Copies in one task are one row before anything moves, so a
    group with a third of all rows sends one row per task.
    """
    groups = fingerprints(docs).groupBy("fingerprint", "canonical").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("members"))
    return groups.where("members > 1").select("fingerprint", F.sha2("canonical", 256).alias("check"), "group_id", "members")


def edited(text: str, nxt: str) -> str:
    """The text whose last third (by code points) is replaced by as many first ones of the next."""
    k = len(text) // 3
    return text[: len(text) - k] + nxt[:k] if k else text


def edit_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited form, how alike they and the next document's are, and each document's group of copies.

    The next document is the one that follows in descending id, nulls last, and the first follows the last; equal ids and nulls
    are in the order of a hash of the text, then of the text. Documents are dealt into ranges of that order; the first
    document of the following range travels along as a guest, so no task sees more than its own range. A
    likeness is 1.0 where digests and canonical bytes are equal, else 0.0. A document without a copy is its own
    group; of copies without any id the group is null.
    """
    spark = docs.sparkSession
    groups, _ = written(fingerprint_groups(docs), "fingerprint-groups")
    rows = texts(docs).withColumn("h", F.xxhash64("text"))
    parts = tasks_for(spark)
    seen = rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10000).alias("cuts"), F.count("*").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    if not seen["n"]:
        return spark.createDataFrame([], EDIT.replace("check string", "group_id long, members long"))
    cuts = sorted({int(c) for c in seen["cuts"] or []})
    # a row's range: how many cuts are not above its id; rows without an id go below all others, by their hash
    cut_array = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    below = max(1, -(-parts * seen["nulls"] // seen["n"]))
    by_hash = F.least(F.floor((F.col("h").cast("double") / 2.0**64 + 0.5) * below), F.lit(below - 1))
    rank = F.when(F.col("doc_id").isNull(), -by_hash).otherwise(F.size(F.filter(cut_array, lambda c: c <= F.col("doc_id"))) + 1).cast("int")
    ranged = rows.withColumn("part", rank)
    low = F.min(F.when(F.col("doc_id").isNull(), F.col("h")))
    heads = sorted(((r["part"], r["top"], r["low"]) for r in ranged.groupBy("part").agg(F.max("doc_id").alias("top"), low.alias("low")).collect()), reverse=True)  # a row for each range
    held = [p for p, _, _ in heads]
    # the head of each range visits the range above; the greatest id visits the last range, after its own rows
    above = {p: held[i - 1] for i, p in enumerate(held)}  # i = 0 wraps round to the lowest range
    tops, lows = [t for _, t, _ in heads if t is not None], [x for _, _, x in heads if x is not None]
    visit = F.element_at(F.create_map(*[F.lit(x) for kv in above.items() for x in kv]), F.col("part"))
    guests = ranged.where(F.col("doc_id").isin(tops) | (F.col("doc_id").isNull() & F.col("h").isin(lows)))
    guests = guests.withColumn("to", visit).select(F.col("to").alias("part"), "doc_id", "text", "h", F.lit(True).alias("guest"))
    both = ranged.select("part", "doc_id", "text", "h", F.lit(False).alias("guest")).unionByName(guests)
    dealt = both.repartitionById(parts, F.pmod("part", F.lit(parts))).sortWithinPartitions("part", "guest", F.col("doc_id").desc_nulls_last(), "h", "text")
    found = dealt.select("part", "doc_id", "text", "guest").mapInArrow(_edit_stream, EDIT).withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_chars"), F.lit(SALTS)).cast("int"))
    spread = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a hot group is met by several tasks
    out = found.join(spread, ["fingerprint", "check", "salt"], "left")
    group = F.when(F.col("members").isNull(), F.col("doc_id")).otherwise(F.col("group_id"))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", group.alias("group_id"), F.coalesce("members", F.lit(1)).cast("long").alias("members"))


SALTS = 8
EDIT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, check string"


def _edit_stream(batches):
    """One document is held back until the one after it, or the range's guest, is there."""
    held = None  # part, id, text, canonical

    def row(part, doc, text, canon, nxt, nxt_canon):
        e = edited(text, nxt)
        ec = canon if e == text else canonical(e)
        fp, efp = digest(canon), digest(ec)
        check = hashlib.sha256(canon.encode("utf-8", "surrogatepass")).hexdigest()
        return (doc, len(text), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), fp, efp, float(fp == efp and canon == ec), float(canon == nxt_canon), check)

    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("check", pa.string())])
    for b in batches:
        out = []
        for part, doc, text, guest in zip(*(c.to_pylist() for c in b.columns), strict=True):
            canon = canonical(text)
            if held and held[0] == part:
                out.append(row(*held, text, canon))
            held = None if guest else (part, doc, text, canon)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
