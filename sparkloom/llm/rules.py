"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger keeps the measurements
and one long whose bit r is set if rule r fails.  A policy is a named, versioned
mask: a document passes if it fails none of the mask's rules, so a new policy or
an ablation reads the ledger, never the texts.

Cases: a null or empty text has no words and fails few_words only; very long
texts take time and memory in proportion to their words; repeated rows give
repeated ledger rows; null ids are kept; an empty table gives an empty ledger;
further columns of docs are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ._common import table

#: Bit by bit: the name, and the failure condition over the ledger's measurements.
RULES = (
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("capitals", "2 * n_upper > n_ascii_letters"),
    ("doubled_words", "10 * n_doubled > 3 * n_words"),
    ("word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 14 * n_words)"),
    ("duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
)
BIT = {name: 1 << r for r, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]
#: Versioned policies. duplicate_lines is measured, but only the strict policy acts on it: short clean texts repeat lines.
POLICIES = {
    "base-1": BASE,
    "prose-1": sum(BIT.values()) - BIT["duplicate_lines"],
    "strict-1": sum(BIT.values()),
}
PRODUCTION = "prose-1"
WINDOW = 5
LONG = 20_000
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_doubled", "n_upper", "n_ascii_letters")


def _repeated(words: list[bytes]) -> int:
    """Words that lie in a WINDOW-word window which occurs twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    if len(words) <= LONG:
        windows = list(zip(*(words[k:] for k in range(WINDOW))))
        if len(set(windows)) == n:
            return 0
        seen, again = set(), set()
        for w in windows:
            (again if w in seen else seen).add(w)
        covered, end = 0, 0
        for i, w in enumerate(windows):
            if w in again:
                covered += i + WINDOW - max(i, end)
                end = i + WINDOW
        return covered
    import numpy as np

    number: dict[bytes, int] = {}
    base = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    ids = base[:n]
    for k in range(1, WINDOW):  # numbers of exact prefixes: no hash, no collision
        ids = np.unique(ids * len(number) + base[k : k + n], return_inverse=True)[1]
    twice = np.bincount(ids)[ids] > 1
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, np.flatnonzero(twice), 1)
    np.add.at(cover, np.flatnonzero(twice) + WINDOW, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of a whole text, in the order of MEASURES."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes.split knows exactly the white space \\x20, \\x09-\\x0D
    letters = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    upper = len(raw) - len(raw.translate(None, letters))
    lines, dups, seen = 0, 0, set()
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                dups += 1
            seen.add(line)
    joined = b"".join(words)
    return (
        len(words),
        len(joined) - _continuations(joined),
        len(raw) - len(raw.translate(None, b"#*$%&|<>")),
        dups,
        _repeated(words),
        lines,
        sum(map(bytes.__eq__, words, words[1:])),
        upper,
        upper + len(raw) - len(raw.translate(None, letters.lower())),
    )


def _continuations(raw: bytes) -> int:
    """UTF-8 continuation bytes: what a text has in bytes beyond code points."""
    return len(raw) - len(raw.translate(None, bytes(range(0x80, 0xC0))))


def _measure_batches(batches):
    import numpy as np
    import pyarrow as pa

    for b in batches:
        rows = np.array([measure(t.as_py()) for t in b.column(1)], np.int64).reshape(-1, len(MEASURES))
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(rows[:, k]) for k in range(rows.shape[1]))], names=["doc_id", *MEASURES])


def with_bits(measured: DataFrame) -> DataFrame:
    bits = F.lit(0).cast("long")
    for name, fails in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(BIT[name])).otherwise(0).cast("long"))
    return measured.withColumn("failed_bits", bits)


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and failed_bits, for every row of docs."""
    schema = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)
    return with_bits(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_measure_batches, schema))


def passes(policy: str = PRODUCTION):
    return F.col("failed_bits").bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0


def ablations(book: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """Per rule of the policy: documents that fail it, that fail it alone (and
    would come back without it), and that the policy without it would keep."""
    mask = POLICIES[policy]
    own = F.col("failed_bits").bitwiseAND(F.lit(mask).cast("long"))
    used = [name for name, bit in BIT.items() if bit & mask]
    sums = [
        x
        for name in used
        for x in (
            F.count_if(own.bitwiseAND(F.lit(BIT[name]).cast("long")) != 0).alias(f"fail_{name}"),
            F.count_if(own == BIT[name]).alias(f"only_{name}"),
            F.count_if(own.bitwiseAND(F.lit(mask & ~BIT[name]).cast("long")) == 0).alias(f"kept_{name}"),
        )
    ]
    stack = ", ".join(f"'{n}', fail_{n}, only_{n}, kept_{n}" for n in used)
    return book.agg(*sums).selectExpr(f"stack({len(used)}, {stack}) as (rule, n_failed, n_failed_alone, n_kept_without)")


def _measured_batches(batches):
    import numpy as np
    import pyarrow as pa

    for b in batches:
        rows = np.array([measure(t.as_py()) for t in b.column(0).field("text")], np.int64).reshape(-1, len(MEASURES))
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(rows[:, k]) for k in range(rows.shape[1]))], names=["row", *MEASURES])


def marked(docs: DataFrame) -> DataFrame:
    """The rows of docs, in the struct row, with their measurements and failed_bits: a ledger beside its documents."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    schema = StructType([*packed.schema, *(StructField(m, LongType()) for m in MEASURES)])
    return with_bits(packed.mapInArrow(_measured_batches, schema))


def keep_passing(docs: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """The rows of docs that a policy keeps, by the bits of their ledger, in one pass without a shuffle."""
    return marked(docs).where(passes(policy)).select("row.*")


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = ledger(table(spark, sf_dir, "documents"))
    failed = F.col("failed_bits").bitwiseAND(F.lit(BASE).cast("long")) != 0
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & passes()).alias("kept"), "failed_bits",
    )


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the strict policy does, from the ledger's bits alone."""
    return ablations(ledger(table(spark, sf_dir, "documents")), "strict-1")


OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT rid, i, list_slice(w, i, i + 4) AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) > 5)),
hit AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT i + j) AS n FROM hit, range(5) r(j) GROUP BY rid),
ln AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
lines AS (SELECT rid, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM ln
          WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
             (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) AS up,
             (length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g'))) AS alpha,
             coalesce(lines.n, 0) AS n_lines,
             len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS doubled
      FROM d LEFT JOIN rep USING (rid) LEFT JOIN lines USING (rid)),
b AS (SELECT *, ((n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT
             + 4 * (10 * n_symbols > n_words)::BIGINT + 8 * (2 * up > alpha)::BIGINT + 16 * (10 * doubled > 3 * n_words)::BIGINT
             + 32 * (n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 14 * n_words))::BIGINT
             + 64 * (10 * n_dup_lines > 3 * n_lines)::BIGINT)::BIGINT AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed_bits & 3) <> 0 AS base_failed, (failed_bits & 63) = 0 AS kept, failed_bits FROM b
"""
ABLATIONS_SQL = f"""
WITH l AS ({OP10_SQL}), r(rule, bit) AS (VALUES {", ".join(f"('{name}', {bit})" for name, bit in BIT.items())})
SELECT rule, count(*) FILTER (failed_bits & bit <> 0)::BIGINT AS n_failed, count(*) FILTER (failed_bits = bit)::BIGINT AS n_failed_alone,
       count(*) FILTER (failed_bits & ~bit = 0)::BIGINT AS n_kept_without FROM l, r GROUP BY rule
"""
