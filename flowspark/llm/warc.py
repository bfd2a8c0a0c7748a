"""WARC archives as a chunked record table.

A record is one or more rows (record_id, chunk_no, data, ...) in order, so that no
payload needs to be a single value, and what is shuffled and sorted are rows of a chunk:
the writer streams chunks into one gzip member per record and holds their running SHA-256
against the one announced, the reader streams them out again with a running SHA-256, and
both hold one chunk at a time. ``warc`` is a Spark data source; files that tasks wrote are
moved into place when the job commits, under names of their own, so a lost executor or a
second attempt leaves nothing and a second job adds to the first.
"""

from __future__ import annotations

import gzip
import hashlib
import itertools
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from flowspark.llm.common import key_in_table, key_table, map_texts
from flowspark.session import durable
from flowspark.sources.pcap import put_in_place

CHUNK_BYTES = 1 << 20
#: What a writer takes; payload_bytes and payload_digest (SHA-256, hex) are those of the full payload.
RECORD = "record_id string, record_type string, target_uri string, refers_to string, payload_bytes bigint, payload_digest string, chunk_no bigint, data binary"
#: What a reader gives: the same, with is_last; length and digest come from the bytes read so far.
CHUNK = RECORD + ", is_last boolean"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _one_line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record_head(record_type: str, record_id: str, uri: str | None, refers_to: str | None, size: int, digest: str | None) -> bytes:
    """WARC and HTTP headers of a record. A revisit has no payload, but its HTTP headers keep the length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <{_one_line(record_id)}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {_one_line(uri)}")
    if digest is not None:
        lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if record_type == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_one_line(refers_to or '')}>"]
    block = len(http) + (0 if record_type == "revisit" else size)
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {block}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    final: str


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite
        self.job = f"{time.time_ns():019d}-{uuid.uuid4().hex[:8]}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        task = TaskContext.get()
        system, folder = _open(self.path)
        system.create_dir(folder, recursive=True)
        final = f"{folder}/part-{self.job}-{task.partitionId():05d}.warc.gz"
        temporary = f"{folder}/_attempt-{task.partitionId():05d}-{task.taskAttemptId()}"
        with system.open_output_stream(temporary) as out:
            member, left, running, digest = None, 0, None, None
            for batch in iterator:
                for k in range(batch.num_rows):
                    r = {name: column[k].as_py() for name, column in zip(batch.schema.names, batch.columns, strict=True)}
                    if r["chunk_no"] == 0:
                        if left:
                            raise ValueError(f"a record ended {left} bytes short of its length")
                        member, running = zlib.compressobj(1, wbits=31), hashlib.sha256()
                        digest = None if r["record_type"] == "revisit" else r["payload_digest"]
                        left = 0 if r["record_type"] == "revisit" else r["payload_bytes"]
                        out.write(member.compress(record_head(r["record_type"], r["record_id"], r["target_uri"], r["refers_to"], r["payload_bytes"], r["payload_digest"])))
                    elif member is None:
                        raise ValueError("a record's chunks are not in order")
                    out.write(member.compress(r["data"] or b""))
                    running.update(r["data"] or b"")
                    left -= len(r["data"] or b"")
                    if left < 0:
                        raise ValueError("a record is longer than its length says")
                    if left == 0:
                        if digest is not None and running.hexdigest() != digest:
                            raise ValueError(f"{r['record_id']} is not what its digest says")
                        out.write(member.compress(b"\r\n\r\n") + member.flush())
                        member = None
            if left:
                raise ValueError(f"the last record ended {left} bytes short of its length")
        return Written(temporary, final)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = _open(self.path)
        put_in_place(system, folder, [(m.temporary, m.final) for m in messages if m is not None], self.overwrite)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = _open(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(m.temporary)


@dataclass
class Archive(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    def __init__(self, path: str, with_data: bool, chunk_bytes: int) -> None:
        self.path, self.with_data, self.chunk_bytes = path, with_data, chunk_bytes

    def partitions(self) -> list[InputPartition]:
        system, folder = _open(self.path)
        found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return [Archive(f.path) for f in sorted(found, key=lambda f: f.path) if f.base_name.endswith(".warc.gz")]

    def read(self, partition: Archive | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        system, _ = _open(self.path)
        rows, size = [], 0
        with system.open_input_stream(partition.path, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
            for row in read_records(stream, self.chunk_bytes):
                size += len(row[7])
                rows.append(row if self.with_data else (*row[:7], None, row[8]))
                if size > 4 * self.chunk_bytes or len(rows) >= 10_000:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)


KINDS = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.bool_()]
NAMES = ["record_id", "record_type", "target_uri", "refers_to", "payload_bytes", "payload_digest", "chunk_no", "data", "is_last"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], NAMES)


def _fields(stream) -> dict[str, str]:
    """Header lines up to the empty one, names in lower case; bytes that are no UTF-8 are Latin-1. Lines that begin with white
    space go on with the one before."""
    out, name = {}, None
    while (line := stream.readline().rstrip(b"\r\n")):
        try:
            text = line.decode("utf-8")
        except UnicodeDecodeError:
            text = line.decode("iso-8859-1")
        if text[0] in " \t" and name is not None:
            out[name] += " " + text.strip()
            continue
        name, _, value = text.partition(":")
        name = name.strip().lower()
        out[name] = value.strip()
    return out


class _Block:
    """The bytes of a record, as many as its header says."""

    def __init__(self, stream, size: int, record: str) -> None:
        self.stream, self.left, self.record = stream, size, record

    def read(self, n: int) -> bytes:
        data = self.stream.read(min(n, self.left)) if self.left else b""
        if self.left and n and not data:
            raise EOFError(f"{self.record} ends {self.left} bytes early")
        self.left -= len(data)
        return data

    def readline(self) -> bytes:
        """A line of the record; one that the record's end cuts has no line end."""
        line = self.stream.readline(self.left) if self.left else b""
        self.left -= len(line)
        return line


class _Parts:
    """The payload of a block in chunked transfer encoding (RFC 9112, 7.1). What doesn't begin with the size of a part is taken as it is."""

    def __init__(self, block: _Block) -> None:
        self.block, self.part, self.ended, self.plain = block, 0, False, b""
        self._size(block.readline(), True)

    def _size(self, line: bytes, first: bool = False) -> None:
        digits = line.split(b";")[0].strip()
        if digits and all(c in b"0123456789abcdefABCDEF" for c in digits):
            self.part = int(digits, 16)
            self.ended = self.part == 0
        elif first:
            self.plain, self.part = line, -1
        else:
            self.ended = True

    def read(self, n: int) -> bytes:
        if self.part < 0:
            data, self.plain = self.plain[:n], self.plain[n:]
            return data or self.block.read(n)
        if self.ended or not self.block.left:
            return b""
        data = self.block.read(min(n, self.part))
        self.part -= len(data)
        if not self.part:
            self.block.readline()
            self._size(self.block.readline())
        return data


def _full(body, n: int) -> bytes:
    """``n`` bytes, fewer at the end."""
    out = bytearray()
    while len(out) < n and (data := body.read(n - len(out))):
        out += data
    return bytes(out)


#: Records that have no payload of a page.
ABOUT = ("warcinfo", "request", "metadata")


def read_records(stream, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple]:
    """Rows of CHUNK from a stream of WARC records, as this library or others write them.

    The length in a record's own header decides where it ends. Responses lose their HTTP header and chunked transfer
    encoding; responses without HTTP, and resource, conversion and continuation records, are payload as they are. Records of ABOUT are
    passed over. A revisit has one row without data; its length is that its HTTP header tells (none: 0), its digest that of its
    own header. Digests other than SHA-256 keep their prefix.
    """
    while (version := stream.readline()):
        if not version.strip():
            continue
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {version[:40]!r}")
        head = _fields(stream)
        record, kind, uri = head.get("warc-record-id", "").strip("<>"), head.get("warc-type", ""), head.get("warc-target-uri")
        block = _Block(stream, int(head.get("content-length", "0")), record)
        http, body = {}, block
        if kind in ("response", "revisit") and head.get("content-type", "application/http").startswith("application/http"):
            status = block.readline()
            if status and not status.startswith(b"HTTP/"):
                raise ValueError(f"no HTTP block: {status[:40]!r}")
            http = _fields(block)
        if kind == "revisit":
            yield record, kind, uri, head.get("warc-refers-to", "").strip("<>") or None, int(http.get("content-length") or 0), head.get("warc-payload-digest", "").removeprefix("sha256:"), 0, b"", True
        elif kind not in ABOUT:
            if http.get("transfer-encoding", "").lower() == "chunked":
                body = _Parts(block)
            running, done, number = hashlib.sha256(), 0, 0
            data = _full(body, chunk_bytes)
            while True:
                following = _full(body, chunk_bytes) if len(data) == chunk_bytes else b""
                running.update(data)
                done += len(data)
                yield record, kind, uri, None, done, running.hexdigest(), number, data, not following
                if not following:
                    break
                data, number = following, number + 1
        while block.read(chunk_bytes):
            pass


class WarcSource(DataSource):
    """Options: path; with_data (default true); chunk_bytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return CHUNK

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options["path"], self.options.get("with_data", "true") == "true", int(self.options.get("chunk_bytes", CHUNK_BYTES)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options["path"], overwrite)


FACTS = ("payload_bytes", "payload_digest", "record_type", "refers_to")


def _named(df: DataFrame, *without: str) -> Column:
    """The columns of ``df`` but for some, as one, so that no name among them meets those made here."""
    return F.struct(F.lit(None).cast("int").alias("no column"), *(F.col(f"`{c}`") for c in df.columns if c not in without))


def shared_payloads(df: DataFrame, id_col: str, payload_col: str, least_bytes: int = 100) -> DataFrame:
    """(digest, refers_to, members) of payloads of at least ``least_bytes`` bytes that several rows have: refers_to is their smallest id,
    null if none has one. A payload that a third of the rows share is counted before the shuffle."""
    data = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b""))
    long = df.select(F.col(f"`{id_col}`").alias("id"), data.alias("data")).where(F.octet_length("data") >= least_bytes)
    return durable(long.groupBy(F.sha2("data", 256).alias("digest")).agg(F.min("id").alias("refers_to"), F.count(F.lit(1)).alias("members")).where("members > 1"))


def _marked(rows: DataFrame, shared: DataFrame, least_bytes: int) -> DataFrame:
    """``rows`` (id, payload_bytes, payload_digest and others) with record_type and refers_to."""
    alone = F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))
    rows = rows.withColumn("met", F.when(F.col("payload_bytes") >= least_bytes, F.col("payload_digest")).otherwise(alone))
    rows = rows.join(shared.select(F.col("digest").alias("met"), F.col("refers_to").alias("first")), "met", "left").drop("met")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id"))
    return rows.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("first"))).drop("first")


def mark_revisits(df: DataFrame, id_col: str, payload_col: str, least_bytes: int = 100) -> DataFrame:
    """``df`` with payload_bytes, payload_digest, record_type and refers_to.

    Of rows with equal payloads of at least ``least_bytes`` bytes, that with the smallest
    id is the response and the others revisit it; rows that repeat that id are responses
    too. Null payloads count as empty. Null ids revisit a payload that some id has.
    Columns of those four names in ``df`` are replaced, others pass unchanged.

    A payload that a third of the rows share is counted before the shuffle, and its
    rows meet their response in a join whose large partitions adaptive execution splits.
    Leave payloads out of ``df`` but for ``payload_col``, which is not in the result: only
    its length and digest go through the join.
    """
    data = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b""))
    rows = df.select(_named(df, payload_col, *FACTS).alias("row"), F.col(f"`{id_col}`").alias("id"), F.octet_length(data).cast("long").alias("payload_bytes"), F.sha2(data, 256).alias("payload_digest"))
    return _marked(rows, shared_payloads(df, id_col, payload_col, least_bytes), least_bytes).select("row.*", *FACTS).drop("no column")


def chunk_payloads(df: DataFrame, payload_col: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``df`` with the payload in chunks: columns chunk_no and data, one row at least (null counts as empty), each row's
    chunks in order."""
    rows = df.withColumn("whole", F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))).drop(payload_col)
    last = F.greatest(F.lit(0), F.ceil(F.octet_length("whole") / chunk_bytes).cast("int") - 1)
    rows = rows.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), last)))
    return rows.withColumn("data", F.expr(f"substring(whole, chunk_no * {chunk_bytes} + 1, {chunk_bytes})")).drop("whole")


def digest_chunks(chunks: DataFrame) -> DataFrame:
    """(record_id, payload_bytes, payload_digest) of rows (record_id, chunk_no, data): for payloads that come in chunks
    and are too large for one value. A task holds a chunk and the running digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        record, running, size, done = None, None, 0, []
        for batch in itertools.chain(batches, [None]):
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True) if batch is not None else [(None, 0, None)]
            for name, number, data in rows:
                if number == 0:
                    if running is not None:
                        done.append((record, size, running.hexdigest()))
                    record, running, size = name, hashlib.sha256(), 0
                elif name != record:
                    raise ValueError(f"{name} has no first chunk")
                running.update(data or b"")
                size += len(data or b"")
            if len(done) > 1000 or batch is None:
                yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.string()))], ["record_id", "payload_bytes", "payload_digest"])
                done = []

    rows = chunks.select("record_id", "chunk_no", "data").repartition("record_id").sortWithinPartitions("record_id", "chunk_no")
    return map_texts(rows, run, "record_id string, payload_bytes bigint, payload_digest string")


def warc_records(df: DataFrame, id_col: str, payload_col: str, least_bytes: int = 100, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``df`` as chunk rows with payload_bytes, payload_digest, record_type and refers_to (see ``mark_revisits``), without
    ``payload_col``; revisits have one row without data. Other columns pass unchanged, whatever their names.

    Digests that several rows share are made a bit table of bounded size; payloads that it excludes are responses where they
    lie and are not shuffled. The others are cut into chunks, which meet what was found out about their row; a full
    table only means that more payloads travel. ``df`` is read three times.
    """
    shared = shared_payloads(df, id_col, payload_col, least_bytes)
    data = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b""))
    rows = df.select(_named(df, payload_col, *FACTS).alias("row"), F.col(f"`{id_col}`").alias("id"), data.alias("payload"), F.sha2(data, 256).alias("payload_digest"), F.octet_length(data).cast("long").alias("payload_bytes"))
    rows = key_in_table(rows, F.xxhash64("payload_digest"), *key_table(shared.select(F.xxhash64("digest").alias("h")), shared.count()), "may_share")
    meets = F.col("may_share") & (F.col("payload_bytes") >= least_bytes)
    made = ["row", "payload_bytes", "payload_digest", "record_type", "refers_to", "chunk_no", "data"]
    alone = chunk_payloads(rows.where(~meets), "payload", chunk_bytes).withColumns({"record_type": F.lit("response"), "refers_to": F.lit(None).cast(shared.schema["refers_to"].dataType)}).select(made)
    several = rows.where(meets)
    marks = _marked(several.select("id", "payload_bytes", "payload_digest"), shared, least_bytes).distinct()
    marks = marks.select(F.col("id").alias("of_id"), F.col("payload_digest").alias("of_digest"), "record_type", "refers_to")
    chunks = chunk_payloads(several.withColumn("number", F.monotonically_increasing_id()), "payload", chunk_bytes)
    met = chunks.join(marks, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("payload_digest") == F.col("of_digest")))
    met = met.where("record_type = 'response' or chunk_no = 0").withColumn("data", F.when(F.col("record_type") == "response", F.col("data")).otherwise(F.lit(b"")))
    return alone.union(met.sortWithinPartitions("number", "chunk_no").select(made)).select("row.*", *FACTS, "chunk_no", "data").drop("no column")


def write_warc(chunks: DataFrame, path: str, mode: str = "append") -> None:
    """Write rows of RECORD, each record's rows in order within a partition; one archive a partition. By default they are
    added to those in the folder; ``mode`` overwrite replaces them."""
    chunks.sparkSession.dataSource.register(WarcSource)
    columns = [part.split()[0] for part in RECORD.split(", ")]
    chunks.select(*[F.col(c).cast(k) for c, k in (part.split() for part in RECORD.split(", "))]).toDF(*columns).write.format("warc").mode(mode).save(path)


def read_warc(spark: SparkSession, path: str, with_data: bool = True) -> DataFrame:
    """Rows of CHUNK; without data, lengths and digests still come from all bytes. A folder without archives is empty."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("with_data", str(with_data).lower()).load(path)
