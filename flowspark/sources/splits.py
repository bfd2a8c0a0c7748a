"""Ranges of one capture file as partitions, with the rows of a sequential read.

A capture has no marks between records: a record's place follows from the lengths of all before it. Ranges of a file are
measured in parallel. Each looks for the first place from which a chain of plausible record headers leads on, walks the
headers to the range's end and tells where it began, where it stopped and how many records lie between. A payload
may look like headers, so a beginning is only a guess: range after range, it must be where the range before stopped, from the
file's first record on. A range whose guess was wrong is walked again from where it really begins, up to the first record that
the guess has also led to; from there on both walks are the same. The result is therefore exact for every file; guesses only
decide how much of it was found in parallel.
"""

from __future__ import annotations

import itertools
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.session import durable
from flowspark.sources.formats import ERF_HEAD, MAGIC, MAGIC_NANO, PCAP_HEAD, SNAPLEN, as_batch, erf_row, is_packet, opened, pcap_row

#: Headers in a row that make a guess, and seconds that may lie between two of them.
LINKS, MOST_SECONDS_BETWEEN = 8, 86_400
SCAN_BYTES, BUFFER_BYTES, MEETING_BYTES, ROWS_A_BATCH, BYTES_A_BATCH = 1 << 18, 1 << 22, 1 << 13, 4096, 1 << 24
SPLIT_BYTES = 128 << 20
PLAN = "path string, place int, number int, start bigint, stop bigint, first bigint, records bigint, task int"


class PcapLayout:
    """Records of a PCAP file, whose header tells byte order, unit of time and link type."""

    def __init__(self, head: bytes) -> None:
        order = next((o for o in "<>" if len(head) == PCAP_HEAD and struct.unpack(o + "I", head[:4])[0] in (MAGIC, MAGIC_NANO)), None)
        if order is None:
            raise ValueError("no PCAP file")
        self.order, self.start, self.head = order, PCAP_HEAD, 16
        self.unit = 10**9 if struct.unpack(order + "I", head[:4])[0] == MAGIC_NANO else 10**6
        most, self.link = struct.unpack(order + "II", head[16:24])
        self.most = max(most, SNAPLEN)
        self.fields = struct.Struct(order + "IIII")

    def size(self, buffer: bytes, at: int) -> int:
        return 16 + self.fields.unpack_from(buffer, at)[2]

    def is_packet(self, buffer: bytes, at: int) -> bool:
        return True

    def row(self, buffer: bytes, at: int, end: int) -> tuple:
        return pcap_row(self.fields.unpack_from(buffer, at), buffer[at + 16 : end], self.unit, self.link)

    def plausible(self, data: np.ndarray) -> np.ndarray:
        """Places at which a record header may stand."""
        word = lambda k: _words(data, self.order, 4, k)
        part, caplen, wlen = word(4), word(8), word(12)
        return np.flatnonzero((part < self.unit) & (caplen <= self.most) & (wlen > 0) & (caplen <= wlen) & (wlen <= 1 << 20))

    def second(self, buffer: bytes, at: int) -> int | None:
        """The time of a plausible header, else None."""
        sec, part, caplen, wlen = self.fields.unpack_from(buffer, at)
        return sec if part < self.unit and caplen <= self.most and 0 < wlen <= 1 << 20 and caplen <= wlen else None


class ErfLayout:
    """Records of an ERF file: 16 bytes of header each, no file header."""

    start, head = 0, ERF_HEAD

    def size(self, buffer: bytes, at: int) -> int:
        size = struct.unpack_from(">H", buffer, at + 10)[0]
        if size < ERF_HEAD:
            raise ValueError("no ERF record: shorter than its header")
        return size

    def is_packet(self, buffer: bytes, at: int) -> bool:
        return is_packet(buffer[at + 8])

    def row(self, buffer: bytes, at: int, end: int) -> tuple:
        return erf_row(buffer[at : at + ERF_HEAD], buffer[at + ERF_HEAD : end])

    def plausible(self, data: np.ndarray) -> np.ndarray:
        kind, size, wire = data[8 : len(data) - 7].astype(np.int64) & 0x7F, _words(data, ">", 2, 10), _words(data, ">", 2, 14)
        return np.flatnonzero((kind > 0) & (kind < 32) & (size >= ERF_HEAD) & (wire > 0))

    def second(self, buffer: bytes, at: int) -> int | None:
        kind, size, wire = buffer[at + 8] & 0x7F, *struct.unpack_from(">H2xH", buffer, at + 10)
        return struct.unpack_from("<I", buffer, at + 4)[0] if 0 < kind < 32 and size >= ERF_HEAD and wire else None


def _words(data: np.ndarray, order: str, width: int, shift: int) -> np.ndarray:
    """The unsigned numbers ``shift`` bytes behind each place at which 16 bytes are left."""
    n = len(data) - 15
    places = range(width) if order == ">" else range(width - 1, -1, -1)
    out = np.zeros(n, np.int64)
    for k in places:
        out = out << 8 | data[shift + k : shift + k + n]
    return out


def layout_of(kind: str, file) -> PcapLayout | ErfLayout | None:
    """The layout of a file; None where it is too short to have one."""
    if kind == "erf":
        return ErfLayout()
    head = file.read_at(PCAP_HEAD, 0)
    return PcapLayout(head) if len(head) == PCAP_HEAD else None


class Walk:
    """Whole records of an open file from ``at`` on, through one buffer; beyond ``stop`` only what a record needs is read."""

    def __init__(self, file, layout, at: int, stop: int | None = None, buffer_bytes: int = BUFFER_BYTES) -> None:
        self.file, self.layout, self.at, self.most = file, layout, at, buffer_bytes
        self.size = file.size()
        self.stop = self.size if stop is None else stop
        self.buffer, self.base = b"", at

    def _hold(self, n: int) -> bool:
        """Have ``n`` bytes from ``at`` in the buffer; whether the file has them."""
        if self.at + n > self.size:
            return False
        if not (self.base <= self.at and self.at + n <= self.base + len(self.buffer)):
            self.base = self.at
            self.buffer = self.file.read_at(max(n, min(self.most, self.stop - self.at)), self.at)
        return self.at + n <= self.base + len(self.buffer)

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(place in the buffer, place behind it) of each record. A last one that is cut ends the walk, where it begins."""
        while self._hold(self.layout.head):
            size = self.layout.size(self.buffer, self.at - self.base)
            if not self._hold(size):
                return
            place = self.at - self.base
            self.at += size
            yield place, place + size


def guess(file, layout, start: int, stop: int) -> int | None:
    """The first place in [start, stop) from which LINKS plausible headers, or all up to the file's end, follow each other."""
    size = file.size()
    for at in range(start, stop, SCAN_BYTES):
        here = file.read_at(min(SCAN_BYTES + layout.head - 1, size - at), at)
        if len(here) < layout.head:
            return None
        for place in layout.plausible(np.frombuffer(here, np.uint8)).tolist():
            if at + place >= stop:
                return None
            if _leads_on(file, layout, at + place, size, here, at):
                return at + place
    return None


def _leads_on(file, layout, at: int, size: int, here: bytes, base: int) -> bool:
    before = None
    for _ in range(LINKS):
        if at == size:
            return True
        inside = base <= at and at + layout.head <= base + len(here)
        head = here[at - base : at - base + layout.head] if inside else file.read_at(layout.head, at)
        second = layout.second(head, 0) if len(head) == layout.head else None
        if second is None or (before is not None and abs(second - before) > MOST_SECONDS_BETWEEN):
            return False
        before, at = second, at + layout.size(head, 0)
        if at > size:
            return False
    return True


def measure(file, layout, start: int, stop: int) -> tuple[int, int]:
    """Where a walk from ``start`` is at or beyond ``stop``, and the packets it has passed. A cut last record ends the file."""
    walk, records = Walk(file, layout, start, stop), 0
    if start < stop:
        for place, _ in walk:
            records += layout.is_packet(walk.buffer, place)
            if walk.at >= stop:
                return walk.at, records
        return max(walk.size, stop), records
    return start, 0


def measure_again(file, layout, start: int, stop: int, begun: int, stopped: int, records: int) -> tuple[int, int]:
    """``measure`` from ``start``, where a walk from ``begun`` is known to end at ``stopped`` after ``records`` packets: the two
    go on by turns until they meet, after a few records as a rule."""
    walks = [Walk(file, layout, at, stop, MEETING_BYTES) for at in (start, begun)]
    steps, passed = [iter(w) for w in walks], [0, 0]
    while walks[0].at != walks[1].at:
        behind = int(walks[1].at < walks[0].at)
        step = next(steps[behind], None)
        if step is not None:
            passed[behind] += layout.is_packet(walks[behind].buffer, step[0])
        if step is None or walks[behind].at >= stop:  # they don't meet
            return measure(file, layout, start, stop)
    return stopped, passed[0] + records - passed[1]


@dataclass(frozen=True)
class CaptureFile:
    path: str
    size: int


def files_of(path: str) -> list[CaptureFile]:
    """The file, or the files of a folder in order of name."""
    system, plain = opened(path)
    info = system.get_file_info(plain)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(plain)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
    return [CaptureFile(f.path, f.size) for f in sorted(found, key=lambda f: f.path)]


def plan_ranges(spark: SparkSession, path: str, kind: str, files: list[CaptureFile], split_bytes: int) -> DataFrame:
    """One row a range with packets (``PLAN``): the bytes it holds, the number in its file of its first packet, its packets, and
    the task that reads it. Neighbouring ranges share a task, so that small ranges don't make as many tasks."""
    tasks = tasks_of(spark, files, split_bytes)
    counts = [-(-f.size // split_bytes) for f in files]
    table = spark.createDataFrame([(f.path, place, f.size, n, before) for place, (f, n, before) in enumerate(zip(files, counts, itertools.accumulate(counts, initial=0))) if n], "path string, place int, size bigint, n bigint, before bigint")
    table = table.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    task = ((F.col("before") + F.col("k")) * tasks).cast("decimal(38,0)") / max(1, sum(counts))
    table = table.select("path", "place", F.col("k").cast("int").alias("number"), (F.col("k") * split_bytes).alias("start"), F.least("size", (F.col("k") + 1) * split_bytes).alias("stop"), F.floor(task).cast("int").alias("task"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                with opened(path)[0].open_input_file(r["path"]) as file:
                    layout = layout_of(kind, file)
                    begun = None if layout is None else layout.start if r["number"] == 0 else guess(file, layout, max(r["start"], layout.start), r["stop"])
                    stopped, records = (None, 0) if begun is None else measure(file, layout, begun, r["stop"])
                rows.append({**r, "begun": begun, "stopped": stopped, "records": records})
            yield pa.RecordBatch.from_pylist(rows, _MEASURED)

    def stitched(rows: pd.DataFrame) -> pd.DataFrame:
        """Ranges of one file in order (one row for each ``split_bytes`` of it): each begins where the one before stopped."""
        rows, out, at, first = rows.sort_values("number"), [], None, 0
        with opened(path)[0].open_input_file(rows["path"].iloc[0]) as file:
            layout = layout_of(kind, file)
            for r in rows.itertuples():
                at = (layout.start if layout else r.stop) if at is None else at
                if at >= r.stop:
                    continue
                if r.begun == at:
                    stopped, records = int(r.stopped), int(r.records)
                elif pd.isna(r.begun):
                    stopped, records = measure(file, layout, at, int(r.stop))
                else:
                    stopped, records = measure_again(file, layout, at, int(r.stop), int(r.begun), int(r.stopped), int(r.records))
                if records:
                    out.append((r.path, r.place, r.number, at, stopped, first, records, r.task))
                at, first = stopped, first + records
        return pd.DataFrame(out, columns=[c.split()[0] for c in PLAN.split(", ")])

    found = table.repartitionById(tasks, "task").mapInArrow(measured, "path string, place int, number int, start bigint, stop bigint, task int, begun bigint, stopped bigint, records bigint")
    return durable(found.groupBy("path").applyInPandas(stitched, PLAN))


_MEASURED = pa.schema([("path", pa.string()), ("place", pa.int32()), ("number", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("task", pa.int32()), *((n, pa.int64()) for n in ("begun", "stopped", "records"))])


def tasks_of(spark: SparkSession, files: list[CaptureFile], split_bytes: int) -> int:
    """Tasks for the ranges of ``files``: one for each, but not more than four a core or one for each SPLIT_BYTES of input."""
    ranges = sum(-(-f.size // split_bytes) for f in files)
    return max(1, min(ranges, max(4 * spark.sparkContext.defaultParallelism, -(-sum(f.size for f in files) // SPLIT_BYTES))))


def rows_between(file, layout, start: int, stop: int, number: int) -> Iterator[pa.RecordBatch]:
    """The packets of [start, stop) as batches; ``number`` is the first one's pkt_no."""
    walk, rows, held = Walk(file, layout, start, stop), [], 0
    if start >= stop:
        return
    for place, end in walk:
        if layout.is_packet(walk.buffer, place):
            rows.append((number, *layout.row(walk.buffer, place, end)))
            number += 1
            held += end - place
            if len(rows) == ROWS_A_BATCH or held >= BYTES_A_BATCH:
                yield as_batch(rows)
                rows, held = [], 0
        if walk.at >= stop:
            break
    if rows:
        yield as_batch(rows)


def read_ranges(spark: SparkSession, path: str, kind: str, schema: str, files: list[CaptureFile], split_bytes: int) -> DataFrame:
    """Packets of ``files``; neighbouring ranges share a task."""
    plan = plan_ranges(spark, path, kind, files, split_bytes)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with opened(path)[0].open_input_file(r["path"]) as file:
                    yield from rows_between(file, layout_of(kind, file), r["start"], r["stop"], (r["place"] << 40) + r["first"])

    return plan.repartitionById(tasks_of(spark, files, split_bytes), "task").mapInArrow(read, schema)
