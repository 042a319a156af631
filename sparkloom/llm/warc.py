"""WARC archives as a Python data source.

Reading plans one partition per archive file, smallest pieces of work first, from
a listing of the folder.  A partition scans its file record by record: the record
header is parsed first; predicates on record_type and the other header columns
that Spark pushes down are decided on it, and where they fail, or where only
header columns are asked for (option payload=false), the block is skipped by
seeking or, within gzip members, by inflating into nothing.  Writing makes
gzipped archives, a member per record, and rolls to a new file beyond
max_file_bytes, so that files stay units of work of one size.

Paths may be local, file:, or any scheme that pyarrow.fs can open.

Deduplication: of records with equal payloads of at least min_bytes bytes, that
with the smallest page_id is written as response, the others as revisit records
with no payload, which refer to it.

Cases: null or empty html is an empty payload, and like any other deduplicated;
long payloads are held one at a time; an archive that is cut off, in a header, a
payload or a gzip member, is an error, also where that record is skipped; rows that repeat a page_id are records
each, of rows with the smallest page_id in common all are responses; a null
page_id makes a record without an id, never the target of a revisit unless no row
of its payload has one (then all are responses); an empty table gives no archive
and an empty result; further columns are ignored, a null url is an empty target.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from ._common import scratch_path, table

SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, payload_bytes long, payload binary"
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
WRITE_SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAX_FILE_BYTES = 32 << 20
STEP = 1 << 20


def _store(path: str):
    """(file system, path there) of a path or URI."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def record(row: dict) -> bytes:
    """The bytes of a WARC record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["payload_bytes"]
    block = http + (row["payload"] or b"" if row["record_type"] != "revisit" else b"")
    uri = (row["target_uri"] or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{row['record_id']}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{row['payload_digest']}",
        *([f"WARC-Refers-To: <{row['refers_to']}>", f"WARC-Profile: {PROFILE}"] if row["record_type"] == "revisit" else []), f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Plain:
    """Bytes of an uncompressed archive."""

    def __init__(self, f):
        self.f, self.buffer = f, bytearray()

    def fill(self) -> bool:
        more = self.f.read(STEP)
        self.buffer += more
        return bool(more)

    def until(self, mark: bytes) -> bytes | None:
        """What stands before the mark; None at the end of the archive."""
        at = 0
        while (end := self.buffer.find(mark, at)) < 0:
            at = max(0, len(self.buffer) - len(mark))
            if not self.fill():
                if self.buffer.strip():
                    raise EOFError("the archive ends within a record")
                return None
        out = bytes(self.buffer[:end])
        del self.buffer[: end + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self.fill():
                raise EOFError("the archive ends within a record")
        with memoryview(self.buffer) as view:
            out = bytes(view[:n])
        del self.buffer[:n]
        return out

    def skip(self, n: int) -> None:
        ahead = n - len(self.buffer)
        if ahead > 0:
            self.buffer.clear()
            if ahead > 1:
                self.f.seek(ahead - 1, 1)
            n = 1  # the last byte is read, which shows that it is there
        self.take(n)


class _Gzip(_Plain):
    """Bytes of an archive of gzip members."""

    def __init__(self, f):
        super().__init__(f)
        self.raw, self.member, self.within = b"", zlib.decompressobj(31), False

    def fill(self) -> bool:
        while True:
            if self.member.eof:
                self.raw, self.member, self.within = self.member.unused_data or self.raw, zlib.decompressobj(31), False
            if not self.raw and not (raw := self.f.read(STEP)):
                if self.within:
                    raise EOFError("the archive ends within a gzip member")
                return False
            elif not self.raw:
                self.raw = raw
            self.within = True
            out = self.member.decompress(self.raw, STEP)
            self.raw = b"" if self.member.eof else self.member.unconsumed_tail
            if out:
                self.buffer += out
                return True

    def skip(self, n: int) -> None:
        while n > len(self.buffer):
            n -= len(self.buffer)
            self.buffer.clear()
            if not self.fill():
                raise EOFError("the archive ends within a record")
        del self.buffer[:n]


def records(f, gzipped: bool, wanted: dict[str, set], with_payload: bool):
    """Rows of SCHEMA of an archive, after the header predicates in wanted."""
    stream = _Gzip(f) if gzipped else _Plain(f)
    while True:
        head = stream.until(b"\r\n\r\n")
        if head is None:
            return
        lines = head.decode("utf-8", "surrogatepass").lstrip("\r\n").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:80]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        row = {c: fields.get(h) for c, h in HEADERS.items()}
        for c in ("record_id", "refers_to"):
            row[c] = row[c].strip("<>") if row[c] else None
        if row["payload_digest"]:
            row["payload_digest"] = row["payload_digest"].rpartition(":")[2]
        length = int(fields["content-length"])
        if any(row[c] not in values for c, values in wanted.items()):
            stream.skip(length + 4)
            continue
        size, payload = length, None
        if "application/http" in fields.get("content-type", ""):
            before = len(inner := stream.until(b"\r\n\r\n") or b"") + 4
            for line in inner.split(b"\r\n")[1:]:
                k, _, v = line.partition(b":")
                if k.strip().lower() == b"content-length":
                    size = int(v)
        else:
            before = 0
        if with_payload and row["record_type"] != "revisit":
            payload = stream.take(length - before)
            stream.skip(4)
        else:
            stream.skip(length - before + 4)
        yield (*row.values(), size, payload)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.with_payload = options.get("payload", "true").lower() != "false"
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column in HEADERS:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted.get(column, values) & values
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        store, path = _store(self.path)
        info = store.get_file_info(path)
        if info.type == fs.FileType.File:
            return [_File(self.path)]
        found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
        names = sorted((-x.size, x.base_name) for x in found if x.base_name.endswith((".warc", ".warc.gz")))
        return [_File(f"{self.path.rstrip('/')}/{name}") for _, name in names]

    def read(self, partition):
        import pyarrow as pa

        if partition is None:
            return
        schema = pa.schema([(c, pa.string()) for c in HEADERS] + [("payload_bytes", pa.int64()), ("payload", pa.binary())])
        store, path = _store(partition.path)
        with store.open_input_file(path) as f:
            rows, size = [], 0
            for row in records(f, path.endswith(".gz"), self.wanted, self.with_payload):
                rows.append(row)
                size += len(row[-1] or b"") + 500
                if size > 4 * STEP:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


class _Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class WarcWriter(DataSourceArrowWriter):
    """Each attempt of a task writes under names of its own, with a prefix that
    readers pass over; commit() gives those of the successful attempts their final names."""

    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.most = int(options.get("max_file_bytes", MAX_FILE_BYTES))

    def write(self, iterator):
        import uuid

        from pyspark import TaskContext

        store, path = _store(self.path)
        store.create_dir(path, recursive=True)
        own, names, out, size = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", [], None, 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None or size >= self.most:
                        if out:
                            out.close()
                        names.append(f"part-{own}-{len(names):04d}.warc.gz")
                        out, size = store.open_output_stream(f"{path}/{names[-1]}.tmp", compression=None), 0
                    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                    member = pack.compress(record(row)) + pack.flush()
                    out.write(member)
                    size += len(member)
        finally:
            if out:
                out.close()
        return _Written(names)

    def commit(self, messages):
        store, path = _store(self.path)
        for name in (n for m in messages if m for n in m.names):
            store.move(f"{path}/{name}.tmp", f"{path}/{name}")

    def abort(self, messages):
        store, path = _store(self.path)
        for name in (n for m in messages if m for n in m.names):
            store.delete_file(f"{path}/{name}.tmp")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def digest(payload: Column) -> Column:
    """Bare upper-case base32 of SHA-1: eight times 20 bits, four digits each."""
    hexes = F.sha1(payload)
    digits = F.concat(*[F.lpad(F.conv(F.substring(hexes, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)])
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def archive_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Rows of WRITE_SCHEMA for pages (page_id, url, html).  Payloads are grouped
    by digest and length; only those two and the id are shuffled to find the
    response of each group, with map-side minima, and the join back is to a side
    unique on the key, so that a common payload is split by AQE."""
    payload = F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b""))
    asked = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    hashed = asked.withColumns({"payload_digest": digest(F.col("payload")), "payload_bytes": F.octet_length("payload").cast("long")})
    key = ["payload_digest", "payload_bytes"]
    first = hashed.select(*key, "page_id").where(F.col("payload_bytes") >= min_bytes).groupBy(*key).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    urn = lambda c: F.concat(F.lit("urn:page:"), F.col(c).cast("string"))
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    # a hash join: payloads are dealt by their digest, but not sorted; a partition of first is small
    return hashed.join(first.hint("shuffle_hash"), key, "left").select(
        F.coalesce(urn("page_id"), F.lit("urn:page:")).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), F.col("url").alias("target_uri"),
        F.when(again, urn("first")).alias("refers_to"), "payload_digest", "payload_bytes", F.when(~again, F.col("payload")).alias("payload"),
    )


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    register(pages.sparkSession)
    archive_records(pages, min_bytes).write.format("warc").mode("append").save(path)


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    number = lambda c: F.expr(f"try_cast(nullif(substr({c}, 10), '') as bigint)")
    read = read_archives(spark, path)
    # the size of a response is that of the payload that was read back
    return read.select(
        number("record_id").alias("page_id"), F.coalesce(F.octet_length("payload").cast("long"), F.col("payload_bytes")).alias("payload_bytes"),
        "payload_digest", "record_type", number("refers_to").alias("refers_to"),
    )


OP6_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p),
b AS (SELECT *, list_transform(range(0, 40), lambda i: strpos('0123456789abcdef', h[i + 1]) - 1) AS d FROM f),
s AS (SELECT *, list_transform(range(0, 32), lambda k: list_sum(list_transform(range(0, 5), lambda j:
        (((d[((5 * k + j) // 4) + 1]::BIGINT >> (3 - ((5 * k + j) % 4))::INT) & 1) << (4 - j)::INT)))) AS q FROM b)
SELECT page_id, n AS payload_bytes, array_to_string(list_transform(q, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x::INT + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM s
"""
