"""Personal data: exact patterns, and information-theoretic sanitisation.

Main path: DataFrame functions only.

Base.  E-mail addresses, IP addresses, card and phone numbers are found by
pattern, leftmost and non-overlapping per kind, and checked (parts up to 255,
Luhn, 8 to 15 digits).  Positions are sums of the lengths of the matches and of
the gaps between them, in code points.  The patterns below match what the plain
ones match, but start only where a run of their characters starts (or where the
last match ended, \\G), and never backtrack, so that long runs cost linear time.

Method.  Every valid base value is a protected entity c.  Terms (lower-cased
words of four or more letters or digits, first a letter) of a row that holds c
co-occur with it, however far off.  With N rows in the corpus, n_t that hold term
t, n_c that hold c and n_tc that hold both, the disclosure of c by t is
PMI / IC(c) = log(N n_tc / (n_t n_c)) / log(N / n_c): 1 if t occurs with c only.
Terms with a support n_tc of SUPPORT or more are generalised at a disclosure of
GENERALISE, to the class of their form (a name, an acronym, a code or a word), and
removed at REMOVE, at every occurrence in each row that holds that entity; rows without protected entities are left as they are.  Each row counts its
distinct terms and entities once.  Before the two are paired, entities and terms
in fewer than SUPPORT rows go, and pairs in which the term is too frequent to
reach GENERALISE even if it were in every row of the entity.  Only rows with
entities, a small part, are ever shuffled.

Cases: a null or empty text has no span (and stays as it is); very long texts
with many matches use sums in two levels of blocks; repeated rows count and are
returned each; ids play no part, so rows with null or shared ids have their own
terms; ties don't arise (spans are ordered by kind and start; a term that two
entities give different actions is removed); an empty table gives an empty result; further columns of docs
may have any name, those of sanitize() are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize, table

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for the pattern to be tried.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
TERM = r"\p{L}[\p{L}\p{N}]{3,}+"
SUPPORT = 3
GENERALISE = 0.9
REMOVE = 0.95
#: Candidate terms are broadcast up to this number and this many bytes (both looked at first), beyond joined by a shuffle.
BROADCAST_TERMS, BROADCAST_BYTES = 100_000, 8 << 20
BLOCK = 256
NO_TERMS = "cast(array() as array<struct<start: bigint, end: bigint, form: string>>)"


def _running(a: Column, merge, empty: str = "bigint") -> Column:
    """Running sums or maxima of an array of longs, in blocks."""
    none = F.expr(f"cast(array() as array<{empty}>)")

    def small(x):
        return F.aggregate(x, none, lambda acc, v: F.concat(acc, F.array(F.coalesce(merge(F.try_element_at(acc, F.lit(-1)), v), v))))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / F.lit(BLOCK)).cast("int")), lambda b: small(F.slice(a, b * BLOCK + 1, BLOCK)))
    ends = small(F.transform(blocks, lambda b: F.element_at(b, -1)))
    before = F.concat(F.array(F.lit(None).cast("bigint")), ends)
    return F.when(F.size(a) == 0, none).otherwise(F.flatten(F.zip_with(blocks, F.slice(before, 1, F.size(blocks)), lambda b, e: F.transform(b, lambda v: F.coalesce(merge(e, v), v)))))


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return ~F.exists(F.split(value, r"\."), lambda p: ~p.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"))
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(8, 15)

    def luhn(d):
        at = lambda i: F.substring(d, i, F.lit(1)).cast("int")
        doubled = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        n = F.length(d)
        return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + F.when((n - i) % 2 == 1, doubled(at(i))).otherwise(at(i))) % 10 == 0

    return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(F.lit(False))


def _found(text: Column, kind: str) -> Column:
    """Array of structs start, end, value: valid matches."""
    values = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    gaps = F.split(text, PATTERNS[kind], -1)
    steps = F.zip_with(F.slice(gaps, 1, F.size(values)), F.concat(F.array(F.lit("")), values), lambda g, v: (F.length(g) + F.length(v)).cast("long"))
    starts = _running(F.slice(steps, 1, F.size(values)), lambda a, b: a + b)
    all_of = F.transform(
        F.arrays_zip(starts.alias("s"), values.alias("v")),
        lambda x: F.struct(x["s"].alias("start"), (x["s"] + F.length(x["v"])).cast("long").alias("end"), x["v"].alias("value")),
    )
    tried = text.contains(HINTS[kind]) if kind == "email" else text.rlike(HINTS[kind])
    none = F.expr("cast(array() as array<struct<start: bigint, end: bigint, value: string>>)")
    return F.when(tried, F.filter(all_of, lambda x: _valid(kind, x["value"]))).otherwise(none)


def find(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns keep of docs, a column of matches per kind, and found_text: the text where there are any."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select(*[F.col(c) for c in keep], *[_found(text, k).alias(f"found_{k}") for k in KINDS], text.alias("found_text"))
    return found.withColumn("found_text", F.when(_any_found(), F.col("found_text")))


def _spans(kind: str, a: Column) -> Column:
    return F.transform(a, lambda x: F.concat(F.lit(f"{kind}:"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string")))


def _any_found() -> Column:
    out = F.lit(False)
    for k in KINDS:
        out = out | (F.size(f"found_{k}") > 0)
    return out


def _each(kind: str, f) -> Column:
    """f(match, entity name) of every match of a kind."""
    return F.transform(f"found_{kind}", lambda x: f(x, F.concat(F.lit(f"{kind}:"), x["value"])))


def _numbered(found: DataFrame) -> DataFrame:
    """found in the shared folder, with a number per row."""
    return materialize(found.withColumn("found_row", F.monotonically_increasing_id()), "pii")


def _terms(text: Column) -> Column:
    """The distinct terms of a text, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def disclosures(found: DataFrame, texts: DataFrame) -> DataFrame:
    """(entity, term, disclosure, action) of terms that disclose an entity.
    found: the columns of find(); texts: all texts of the corpus."""
    return _disclosing(_numbered(found), texts)[0]


def _disclosing(found: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """disclosures() of numbered rows, and (found_row, entity, term) of the rows that hold such a pair."""
    names = found.select("found_row", F.explode(F.array_distinct(F.concat(*[_each(k, lambda x, name: name) for k in KINDS]))).alias("entity"))
    entities = materialize(names.groupBy("entity").agg(F.count("*").alias("n_c")).where(F.col("n_c") >= SUPPORT), "entities")
    held = materialize(names.join(entities, "entity"), "held")
    words = found.join(held.select("found_row").distinct(), "found_row", "left_semi").select("found_row", F.explode(_terms(F.col("found_text"))).alias("term"))
    wanted = materialize(words.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT).select("term"), "wanted")
    every = texts.select(F.explode(_terms(F.col("text").cast("string"))).alias("term"))
    n_wanted, n_bytes = wanted.agg(F.count("*"), F.sum(F.octet_length("term"))).first()
    if n_wanted <= BROADCAST_TERMS and (n_bytes or 0) <= BROADCAST_BYTES:
        counted = every.join(F.broadcast(wanted), "term").groupBy("term").agg(F.count("*").alias("n_t"))
    else:
        counted = every.groupBy("term").agg(F.count("*").alias("n_t")).join(wanted, "term")
    counted = materialize(counted, "terms")
    total = float(texts.count())
    ratio = lambda n: 1 + F.log2(F.least(F.lit(1.0), F.col(n) / F.col("n_t"))) / F.log2(F.greatest(F.lit(2.0), F.lit(total) / F.col("n_c")))
    pairs = materialize(held.join(words.join(counted, "term"), "found_row").where(ratio("n_c") >= GENERALISE), "near")
    near = pairs.groupBy("entity", "term", "n_c", "n_t").agg(F.count("*").alias("n_tc")).where(F.col("n_tc") >= SUPPORT)
    scored = near.select("entity", "term", ratio("n_tc").alias("disclosure")).where(F.col("disclosure") >= GENERALISE)
    risky = materialize(scored.withColumn("action", F.when(F.col("disclosure") >= REMOVE, "remove").otherwise("generalise")), "risky")
    return risky, pairs.select("found_row", "entity", "term")


def _term_spans(found: DataFrame, risky: DataFrame, pairs: DataFrame) -> DataFrame:
    """found with found_term: every occurrence of the terms that disclose an entity of the row."""
    own = materialize(pairs.join(risky.select("entity", "term", "action"), ["entity", "term"]).groupBy("found_row", "term").agg(F.max("action").alias("action")), "own")
    text = F.col("found_text")
    values, gaps = F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.split(text, TERM, -1)
    steps = F.zip_with(F.slice(gaps, 1, F.size(values)), F.concat(F.array(F.lit("")), values), lambda g, v: (F.length(g) + F.length(v)).cast("long"))
    starts = _running(F.slice(steps, 1, F.size(values)), lambda a, b: a + b)
    rows = found.join(own.select("found_row").distinct(), "found_row", "left_semi")
    each = rows.select("found_row", F.explode(F.arrays_zip(starts.alias("s"), values.alias("v"))).alias("y"))
    each = each.select("found_row", F.lower("y.v").alias("term"), F.col("y.s").alias("start"), (F.col("y.s") + F.length("y.v")).cast("long").alias("end"), F.col("y.v").alias("value"))
    form = F.when(F.col("action") == "generalise", _class_of(F.col("value"))).otherwise("").alias("form")
    spans = each.join(own, ["found_row", "term"]).groupBy("found_row").agg(F.array_sort(F.collect_list(F.struct("start", "end", form))).alias("found_term"))
    return found.join(spans, "found_row", "left").withColumn("found_term", F.coalesce("found_term", F.expr(NO_TERMS)))


def _class_of(term: Column) -> Column:
    """What a generalised term is replaced with."""
    return F.when(term.rlike(r"\p{N}"), "[CODE]").when(term == F.upper(term), "[ACRONYM]").when(term.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")


def analyse(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows without entities, rows with them and with found_term): together all
    of docs, its columns in the struct row, beside the columns of find().  The
    patterns run once over every text; the rows go to the shared folder."""
    # Clashing names: docs' own columns go into one struct.
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    every = _numbered(find(packed, ["row"]))
    some = every.where(_any_found())
    return every.where(~_any_found()), _term_spans(some, *_disclosing(some, docs))


def digests(docs: DataFrame) -> DataFrame:
    """Counts, base_sha256 and spans of every row."""
    thin = _numbered(find(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"]))
    with_any = thin.where(_any_found())
    full = thin.where(~_any_found()).withColumn("found_term", F.expr(NO_TERMS)).unionByName(_term_spans(with_any, *_disclosing(with_any, docs)))
    base = F.concat_ws(",", F.concat(*[_spans(k, F.col(f"found_{k}")) for k in KINDS]))
    every = F.concat_ws(",", F.concat(*[_spans(k, F.col(f"found_{k}")) for k in KINDS], _spans("term", F.col("found_term"))))
    return full.select("doc_id", *[F.size(f"found_{k}").cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(base, 256).alias("base_sha256"), every.alias("spans"))


PLACEHOLDER = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}


def _sanitised(text: Column) -> Column:
    """text with its spans replaced; what several spans cover is replaced once."""
    masked = lambda kind: lambda x, name: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(PLACEHOLDER[kind]).alias("as"))
    one = [_each(k, masked(k)) for k in KINDS]
    terms = F.transform("found_term", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["form"].alias("as")))
    spans = F.array_sort(F.concat(*one, terms))
    reach = _running(F.transform(spans, lambda x: x["end"]), lambda a, b: F.greatest(a, b))
    before = F.concat(F.array(F.lit(0).cast("long")), reach)
    parts = F.transform(
        F.arrays_zip(spans.alias("x"), F.slice(before, 1, F.size(spans)).alias("b")),
        lambda y: F.concat(
            F.when(y["x"]["start"] > y["b"], F.substring(text, (y["b"] + 1).cast("int"), (y["x"]["start"] - y["b"]).cast("int"))).otherwise(""),
            F.when(y["x"]["end"] > y["b"], y["x"]["as"]).otherwise(""),
        ),
    )
    return F.concat(F.array_join(parts, ""), F.substring(text, (F.element_at(before, -1) + 1).cast("int"), F.length(text)))


def sanitize(docs: DataFrame) -> DataFrame:
    """docs with entities masked and disclosing terms generalised or removed in
    text; n_chars, where there is one, counts the new text."""
    clean, found = analyse(docs)
    clean = clean.select("row.*")
    new = found.withColumn("new", _sanitised(F.coalesce(F.col("row.text").cast("string"), F.lit(""))))
    field = {"text": F.col("new").cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        field["n_chars"] = F.length("new").cast(docs.schema["n_chars"].dataType)
    changed = new.select(*[field.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
    return clean.unionByName(changed)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
