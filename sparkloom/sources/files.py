"""Sources and sinks: lines, raw bytes with padded rows, length-prefixed byte strings."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="sparkloom-")
    return f"{root.rstrip('/')}/sparkloom-{name}-{uuid.uuid4().hex}"


def write_and_read(df: DataFrame, name: str, kind: str = "parquet") -> DataFrame:
    path = shared_path(df.sparkSession, name)
    df.write.format(kind).save(path)
    reader = df.sparkSession.read.format(kind)
    return (reader if kind == "text" else reader.schema(df.schema)).load(path)


def vector(spark: SparkSession, values: list, dtype: str) -> DataFrame:
    return spark.createDataFrame([(values,)], f"a array<{dtype}>").select(F.posexplode("a").alias("i", "v"))


def constant(spark: SparkSession, size: int, value, dtype: str) -> DataFrame:
    return spark.range(size).select(F.col("id").alias("i"), F.lit(value).cast(dtype).alias("v"))


def wrap_bytes(df: DataFrame, column: str, columns: int, row_bytes: int) -> DataFrame:
    """(i0, i1, v) of unsigned bytes: rows of row_bytes bytes, of which the first columns count."""
    if row_bytes < columns:
        raise ValueError("rows overlap")
    c = F.col(column)
    short = F.raise_error(F.lit("fewer bytes than a row has columns"))
    df = df.select(F.when(F.length(c) >= columns, c).otherwise(short).alias(column))
    rows = df.select(c, F.explode(F.sequence(F.lit(0), F.floor((F.length(c) - columns) / row_bytes).cast("int"))).alias("i0"))
    cells = rows.select(c, "i0", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("i1"))
    at = F.substring(F.hex(c), (F.col("i0") * row_bytes + F.col("i1")) * 2 + 1, F.lit(2))
    return cells.select("i0", "i1", F.conv(at, 16, 10).cast("int").alias("v"))


def read_lines(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """(value) per line of text files, or per file."""
    return spark.read.text(path, wholetext=whole_files)


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, i, line)"""
    return df.select(key, F.posexplode(F.split(text, "\n")).alias("i", "line"))


def length_header(n: Column) -> Column:
    """Header of a byte string of n bytes: one byte below 128, two below 32256, else
    254 or 255 and two or three bytes."""
    byte = lambda v, width: F.lpad(F.hex(v.cast("bigint")), 2 * width, "0")
    return F.unhex(
        F.when(n < 128, byte(n, 1)).when(n < 32256, byte(n + 32768, 2)).when(n < 65536, F.concat(F.lit("FE"), byte(n, 2))).otherwise(F.concat(F.lit("FF"), byte(n, 3)))
    )


def encode_bytes(b: Column) -> Column:
    return F.concat(length_header(F.octet_length(b)), b)


def decode_bytes(b: Column) -> Column:
    at = lambda k, n: F.conv(F.hex(F.substring(b, k, n)), 16, 10).cast("int")
    first = at(1, 1)
    size = F.when(first < 128, 1).when(first < 254, 2).when(first == 254, 3).otherwise(4)
    return F.substring(b, size + 1, F.length(b))


def hex_dump(b: Column, columns: int = 16) -> Column:
    """Hex bytes, a gap after every eight, and printable characters; a line per columns
    bytes (-1: one line), which has its offset in front and a line feed behind where
    there are several; (empty) and (null) for what has no bytes."""
    n = F.octet_length(b)
    width = F.greatest(n, F.lit(1)) if columns == -1 else F.least(F.lit(columns), F.greatest(n, F.lit(1)))
    several = n > width

    def line(k):
        part = F.substring(b, k * width + 1, width)
        pairs = F.regexp_replace(F.lower(F.hex(part)), "(..)", "$1 ")
        gapped = F.regexp_replace(pairs, "(.{24})(?=.)", "$1 ")
        text = F.regexp_replace(F.decode(part, "ISO-8859-1"), r"[^\x20-\x7E]", ".")
        shift = F.when(several, F.concat(F.lpad(F.lower(F.hex((k * width).cast("bigint"))), 4, "0"), F.lit("  "))).otherwise("")
        return F.concat(shift, gapped, F.lit(" |"), text, F.lit("|"), F.when(several, "\n").otherwise(""))

    lines = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(n, F.lit(1)) - 1) / width).cast("int")), line)
    return F.when(b.isNull(), "(null)").when(n == 0, "(empty)").otherwise(F.array_join(lines, ""))
