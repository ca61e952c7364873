"""Personal data: base patterns, and information-theoretic sanitisation of what discloses them.

Base spans are e-mail addresses, IP addresses, card and phone numbers. Each is a protected entity. From the corpus come
the number of documents with an entity, with a term, and with both, wherever in the text they stand. A term discloses an
entity by the share of the entity's information that it carries: PMI(term; entity) / IC(entity). Every occurrence, in any
document, of a term at or above a threshold is added as a span of kind ``term``. Sanitising generalises such terms to the
class of their form (name, acronym, word) and removes those that say nearly all. An estimate needs support: an entity,
a term, and both together must stand in ``SUPPORT`` documents at least.

All of it is DataFrame functions, and the work on a text grows with its length (times a logarithm): places are running sums
by doubling, no array is appended to. Offsets count code points, ends are exclusive. Null and empty texts have no
spans. Repeated rows get equal spans and count as several documents in the statistics. Rows with null ids are kept; other
columns, whatever their names, are ignored (``sanitise`` keeps them). Terms and entities are counted by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_path, packed, quoted, row_key, texts, unpacked, written

#: The kinds in their order, and their patterns. Possessive repeats and the look-behind change no match;
#: they keep long runs of one character class from being read again from each of their characters.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
TERM = "term"
WORD = r"\p{L}+"
#: Terms that are too frequent to disclose anything and are set aside before rows move; a bound on that list alone.
FREQUENT = 4096
#: Share of an entity's information from which a term is added, and from which it is removed outright.
DISCLOSURE, REMOVAL = 0.8, 0.95
#: Documents that an estimate stands on.
SUPPORT = 2
#: Bits of the filter that says which words may be disclosing terms: of fixed size, so it is sent to all executors.
#: A full filter (from some ten million terms) lets every word through to the join, which decides in any case.
FILTER_BITS = 1 << 23
#: A row of a small table is dealt to so many tasks, so that a hot term or entity is spread.
SALTS = 8
#: Characters of the stretches that a text is cut from.
STRETCH = 1024

PLACES = "array<struct<start:int,order:int,end:int,kind:string>>"
TERMS = "array<struct<start:int,end:int,degree:double,form:string>>"


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)``, where value is worked out once."""
    return F.transform(F.array(value), fn)[0]


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """The first value, the first two combined, the first three, ...: by doubling the reach."""
    rounds = F.when(F.size(values) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(values))).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    steps = F.transform(rounds, lambda k: F.pow(F.lit(2), k).cast("int"))
    return F.aggregate(steps, values, lambda acc, step: F.transform(acc, lambda x, i: F.when(i >= step, combine(x, acc[i - step])).otherwise(x)))


def found(text: Column, pattern: str) -> Column:
    """All leftmost matches, as structs of start, end and value.

    Ends are running sums of the lengths of matches and of what stands before each.
    """
    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"), F.transform(F.split(text, pattern, -1), F.length).alias("gaps"))

    def placed(x: Column) -> Column:
        sizes = F.zip_with(x["values"], F.slice(x["gaps"], 1, F.size(x["values"])), lambda v, g: F.length(v) + g)
        return let(running(sizes, lambda a, b: a + b), lambda ends: F.zip_with(x["values"], ends, lambda v, e: F.struct((e - F.length(v)).alias("start"), e.alias("end"), v.alias("value"))))

    return let(parts, placed)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits has a Luhn sum that ten divides."""
    back = F.reverse(d)
    each = F.transform(
        F.sequence(F.lit(1), F.length(d)),
        lambda i: (F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)),
    )
    return F.aggregate(each, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        d = digits(value)
        return F.when(F.length(d).between(14, 19), luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits(value)).between(10, 15)
    return F.lit(True)


#: What a text must hold for a pattern to be worth a search.
NEEDED = {"email": "@", "ip": ".", "card": "", "phone": "+"}


def base_spans(text: Column) -> Column:
    """Base spans by start, then kind: structs of start, order, end, kind and value."""
    return F.array_sort(F.concat(*[_of_kind(text, order, kind) for order, kind in enumerate(KINDS)]))


def _of_kind(text: Column, order: int, kind: str) -> Column:
    spans = F.filter(found(text, PATTERNS[kind]), lambda s: valid(kind, s["value"]))
    spans = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value")))
    if not NEEDED[kind]:
        return spans
    empty = F.array().cast("array<struct<start:int,order:int,end:int,kind:string,value:string>>")
    return F.when(text.contains(NEEDED[kind]), spans).otherwise(empty)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def term_of(word: Column) -> Column:
    return F.xxhash64(F.lower(word))


def terms_of(text: Column) -> Column:
    """The distinct terms of a text: hashes of its words in lower case."""
    return F.array_distinct(F.transform(F.filter(F.split(text, r"[^\p{L}]+"), lambda w: w != ""), term_of))


def spread(small: DataFrame, salts: int = SALTS) -> DataFrame:
    """Each row once for each salt; the other side of a join picks one of them by ``salt_of``."""
    return small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def salt_of(*columns: str, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def base_table(docs: DataFrame) -> DataFrame:
    """``(key, doc_id, spans, entities, terms, same)``; entities, terms and a hash of the text where it has spans."""
    rows = texts(docs).withColumn("found", base_spans(F.col("text")))
    entities = F.array_distinct(F.transform("found", lambda s: F.xxhash64(s["kind"], F.when(s["kind"] == "email", F.lower(s["value"])).otherwise(digits(s["value"])))))
    has = F.size("found") > 0
    spans = F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["order"].alias("order"), s["end"].alias("end"), s["kind"].alias("kind")))
    none = F.lit(None).cast("array<bigint>")
    return rows.select(
        row_key(F.col("doc_id"), F.col("text")).alias("key"), "doc_id", spans.alias("spans"),
        F.when(has, entities).otherwise(none).alias("entities"), F.when(has, terms_of(F.col("text"))).otherwise(none).alias("terms"), F.when(has, F.sha2("text", 256)).alias("same"),
    )


def term_documents(docs: DataFrame, support: int) -> DataFrame:
    """``(term, df_term)``: in how many documents each term stands, over all documents; rarer ones than the support are left out."""
    return texts(docs).select(F.explode(terms_of(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df_term")).where(F.col("df_term") >= support)


def disclosure(base: DataFrame, of_term: DataFrame, threshold: float, support: int) -> DataFrame:
    """``(entity, term, degree)`` of all degrees from ``threshold`` on.

    The degree is the share of the entity's information that the term carries, by counts of whole documents. A term and
    an entity meet in at most as many documents as have the entity, so a degree from the threshold on needs
    ``df_term <= n * (df_entity / n) ** threshold``. Pairs beyond that are never formed; no other pair is left out.
    Documents of equal text form their pairs once, with their number.
    """
    n = float(max(base.count(), 2))
    alike = base.where(F.size("spans") > 0).groupBy("same").agg(F.count("*").alias("rows"), F.first("entities").alias("entities"), F.first("terms").alias("terms"))
    alike, alike_path = written(alike, "pii-alike")
    of_entity = alike.select("rows", F.explode("entities").alias("entity")).groupBy("entity").agg(F.sum("rows").alias("df_entity")).where(F.col("df_entity") >= support)
    of_entity, _ = written(of_entity.withColumn("most", n * F.pow(F.col("df_entity") / n, F.lit(threshold)) * (1 + 1e-9)), "pii-entities")
    most = of_entity.agg(F.max("most")).first()[0] or 0.0
    frequent, _ = written(of_term.where(F.col("df_term") > most).orderBy(F.col("df_term").desc(), "term").limit(FREQUENT).select("term"), "pii-frequent")
    terms = alike.select("same", F.explode("terms").alias("term")).join(F.broadcast(frequent), "term", "left_anti").withColumn("salt", salt_of("same"))
    terms = terms.join(spread(of_term.where(F.col("df_term") <= most)), ["term", "salt"]).drop("salt")
    entities = alike.select("same", "rows", F.explode("entities").alias("entity")).withColumn("salt", salt_of("same")).join(spread(of_entity), ["entity", "salt"]).drop("salt")
    together = terms.join(entities, "same").where(F.col("df_term") <= F.col("most"))
    counted = together.groupBy("entity", "term").agg(F.sum("rows").alias("both"), F.first("df_term").alias("df_term"), F.first("df_entity").alias("df_entity")).where(F.col("both") >= support)
    pmi = F.log2(F.lit(n) * F.col("both") / (F.col("df_term").cast("double") * F.col("df_entity")))
    information = F.log2(F.lit(n) / F.col("df_entity"))
    degree = F.when(information > 0, pmi / information).otherwise(F.lit(0.0))
    degrees, _ = written(counted.select("entity", "term", degree.alias("degree")).where(F.col("degree") >= threshold), "pii-degrees")
    drop_path(base.sparkSession, alike_path)
    return degrees


def word_filter(terms: DataFrame) -> DataFrame:
    """One row: a bitmap of fixed size over the terms' hashes, as an array of 64-bit words."""
    words = FILTER_BITS // 64
    slot = F.pmod("term", F.lit(FILTER_BITS))
    bits = terms.select(F.floor(slot / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    every = terms.sparkSession.range(words).select(F.col("id").cast("int").alias("word")).join(bits, "word", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))), lambda x: x["bits"]).alias("bitmap"))


def may_be(term: Column, bitmap: Column) -> Column:
    slot = F.pmod(term, F.lit(FILTER_BITS))
    return F.bit_get(bitmap[F.floor(slot / 64).cast("int")], F.pmod(slot, F.lit(64)).cast("int")) == 1


def form_of(word: Column) -> Column:
    """The class that a term is generalised to."""
    return F.when(word.rlike(r"^\p{Lu}{2,}$"), "ACRONYM").when(word.rlike(r"^\p{Lu}"), "NAME").otherwise("WORD")


def term_places(docs: DataFrame, disclosing: DataFrame) -> DataFrame:
    """``(key, terms)``: every place of a disclosing term, of rows that have any."""
    filter_, _ = written(word_filter(disclosing.select("term")), "pii-filter")
    bitmap = F.col("bitmap")
    maybe = F.exists(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), lambda w: may_be(term_of(w), bitmap))
    places = F.filter(found(F.col("text"), WORD), lambda s: may_be(term_of(s["value"]), bitmap))
    rows = texts(docs).withColumn("bitmap", filter_.scalar()).where(maybe).select(row_key(F.col("doc_id"), F.col("text")).alias("key"), F.explode(places).alias("s"))
    rows = rows.select("key", "s.start", "s.end", term_of(F.col("s.value")).alias("term"), form_of(F.col("s.value")).alias("form"))
    hits = rows.withColumn("salt", salt_of("key", "start")).join(spread(disclosing), ["term", "salt"])
    return hits.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", "end", "degree", "form"))).alias("terms"))  # repeated rows share a key


def apart(spans: Column, terms: Column) -> Column:
    """The terms that touch no base span: no base span before one ends behind its start, none behind it starts before its end."""
    far = (1 << 31) - 1
    row = "array<struct<start:int,order:int,end:int,degree:double,form:string>>"
    both = F.array_sort(F.concat(
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("order"), s["end"].alias("end"), F.lit(None).cast("double").alias("degree"), F.lit("").alias("form"))).cast(row),
        F.transform(terms, lambda t: F.struct(t["start"].alias("start"), F.lit(1).alias("order"), t["end"].alias("end"), t["degree"].alias("degree"), t["form"].alias("form"))).cast(row),
    ))

    def kept(u: Column) -> Column:
        before = running(F.transform(u, lambda x: F.when(x["order"] == 0, x["end"]).otherwise(0)), F.greatest)
        after = F.reverse(running(F.reverse(F.transform(u, lambda x: F.when(x["order"] == 0, x["start"]).otherwise(far))), F.least))
        seen = F.zip_with(F.zip_with(u, before, lambda x, b: F.struct(x.alias("x"), b.alias("b"))), after, lambda y, a: F.struct(y["x"].alias("x"), y["b"].alias("b"), a.alias("a")))
        free = F.filter(seen, lambda y: (y["x"]["order"] == 1) & (y["b"] <= y["x"]["start"]) & (y["a"] >= y["x"]["end"]))
        return F.transform(free, lambda y: F.struct(y["x"]["start"].alias("start"), y["x"]["end"].alias("end"), y["x"]["degree"].alias("degree"), y["x"]["form"].alias("form")))

    return F.when(F.size(spans) == 0, terms).otherwise(let(both, kept))


def marks(docs: DataFrame, threshold: float = DISCLOSURE, support: int = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """``(key, doc_id, spans)`` of every row, and ``(key, terms)`` of those with disclosing terms."""
    base, _ = written(base_table(docs), "pii-base")
    of_term, of_term_path = written(term_documents(docs, support), "pii-terms")
    degrees = disclosure(base, of_term, threshold, support)
    drop_path(docs.sparkSession, of_term_path)
    disclosing, _ = written(degrees.groupBy("term").agg(F.max("degree").alias("degree")), "pii-disclosing")
    terms, _ = written(term_places(docs, disclosing), "pii-places")
    return base.select("key", "doc_id", "spans"), terms


def find_personal_data(docs: DataFrame, threshold: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """One row per document: counts by kind, digest of the base spans, and all spans by start, then kind."""
    base, terms = marks(docs, threshold, support)
    rows = base.join(terms, "key", "left").withColumn("added", F.when(F.col("terms").isNull(), F.array().cast(TERMS)).otherwise(apart(F.col("spans"), F.col("terms"))))
    added = F.transform("added", lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS)).alias("order"), s["end"].alias("end"), F.lit(TERM).alias("kind"))).cast(PLACES)
    every = F.array_sort(F.concat(F.col("spans").cast(PLACES), added))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return rows.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(F.col("spans")), 256).alias("base_sha256"), joined(every).alias("spans"))


def stretch(chunks: Column, a: Column, b: Column) -> Column:
    """Characters from a up to b of a text that is given in stretches."""
    first, last = F.floor(a / STRETCH).cast("int"), F.floor((b - 1) / STRETCH).cast("int")
    within = F.substring(chunks[first], a % STRETCH + 1, b - a)
    over = F.concat(F.substring(chunks[first], a % STRETCH + 1, F.lit(STRETCH)), F.array_join(F.slice(chunks, first + 2, last - first - 1), ""), F.substring(chunks[last], F.lit(1), (b - 1) % STRETCH + 1))
    return F.when(a >= b, "").when(first == last, within).otherwise(over)


def replaced(text: Column, spans: Column) -> Column:
    """The text with spans (structs of start, end, mark in order) replaced; spans that overlap are one, with the first one's mark."""

    def regions(x: Column) -> Column:
        s, ends = x["s"], x["ends"]
        heads = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.when(i == 0, True).otherwise(s[i]["start"] >= ends[i - 1]))
        return let(heads, lambda h: F.transform(h, lambda at, k: F.struct(
            F.when(k == 0, 0).otherwise(ends[at - 1]).alias("before"), s[at]["start"].alias("start"), F.when(k + 1 < F.size(h), ends[h[k + 1] - 1]).otherwise(ends[F.size(s) - 1]).alias("end"), s[at]["mark"].alias("mark"))))

    def assembled(x: Column) -> Column:
        parts = F.transform(x["regions"], lambda r: F.concat(stretch(x["chunks"], r["before"], r["start"]), r["mark"]))
        return F.concat(F.array_join(parts, ""), stretch(x["chunks"], x["regions"][F.size(x["regions"]) - 1]["end"], F.length(text)))

    merged = let(F.struct(spans.alias("s"), running(F.transform(spans, lambda s: s["end"]), F.greatest).alias("ends")), regions)
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0))
    return F.when(F.size(spans) == 0, text).otherwise(let(F.struct(merged.alias("regions"), chunks.alias("chunks")), assembled))


def sanitise(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = DISCLOSURE, removal: float = REMOVAL, support: int = SUPPORT) -> DataFrame:
    """``docs`` with base spans replaced by a mark of their kind and disclosing terms by one of their form; terms from ``removal``
    on are removed. Null texts stay null.

    Overlapping spans are replaced together by the first one's mark. All columns stay, whatever their names.
    """
    base, terms = marks(texts(docs, id_col, text_col), threshold, support)
    spans = base.where(F.size("spans") > 0).groupBy("key").agg(F.first("spans").alias("spans"))
    found_, _ = written(spans.join(terms, "key", "full_outer"), "pii-marks")
    text = F.col(quoted(text_col)).cast("string")
    key = row_key(F.col(quoted(id_col)).cast("long"), F.coalesce(text, F.lit("")))
    # texts move only if they may have marks
    filter_, _ = written(word_filter(found_.select(F.xxhash64("key").alias("term"))), "pii-marked")
    likely = packed(docs, key=key).withColumn("bitmap", filter_.scalar()).withColumn("maybe", may_be(F.xxhash64("key"), F.col("bitmap"))).drop("bitmap")
    bare = likely.where("not maybe").drop("maybe")
    rows = likely.where("maybe").drop("maybe").join(found_, "key", "left").withColumn("text", F.col("row").getField(text_col).cast("string"))
    typed = "array<struct<start:int,end:int,mark:string>>"
    none = F.array().cast(PLACES)
    plain = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")).alias("mark"))).cast(typed)
    free = apart(F.coalesce("spans", none), F.col("terms"))
    general = F.transform(free, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["degree"] >= removal, "").otherwise(F.concat(F.lit("<"), s["form"], F.lit(">"))).alias("mark"))).cast(typed)
    cuts = F.array_sort(F.concat(F.coalesce(plain, F.array().cast(typed)), F.when(F.col("terms").isNull(), F.array().cast(typed)).otherwise(general)))
    marked = F.col("spans").isNotNull() | F.col("terms").isNotNull()
    cleaned = F.when(marked & F.col("text").isNotNull(), let(F.struct(cuts.alias("c"), F.col("text").alias("t")), lambda x: replaced(x["t"], x["c"]))).otherwise(F.col("text"))
    return unpacked(rows, docs.columns, **{text_col: cleaned}).unionByName(unpacked(bare, docs.columns, **{text_col: F.col("row").getField(text_col).cast("string")}))
