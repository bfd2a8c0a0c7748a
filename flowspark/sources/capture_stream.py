"""Captures in a growing folder as a stream.

An offset is a place in the folder read in order of name: a file, a byte in it at which a record begins, and the
packets before that byte. It stays small however many files there are. Files are written one after the other (names
ascend, as those of rotated captures do) and only grow at their end, so the bytes before an offset never change: a
batch that is run again after a restart reads the same records with the same numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSourceStreamReader, InputPartition

from flowspark.sources.formats import opened
from flowspark.sources.splits import SPLIT_BYTES, CaptureFile, Walk, files_of, layout_of, rows_between


@dataclass
class Stretch(InputPartition):
    path: str
    start: int
    stop: int
    number: int


def boundaries(file, layout, start: int, split_bytes: int, stop: int | None = None) -> Iterator[tuple[int, int]]:
    """(byte, packets passed) at about every ``split_bytes``, and last where whole records (or ``stop``) end."""
    walk, records, last = Walk(file, layout, start), 0, start
    if stop is None or start < stop:
        for place, _ in walk:
            records += layout.is_packet(walk.buffer, place)
            if stop is not None and walk.at >= stop:
                break
            if walk.at - last >= split_bytes:
                last = walk.at
                yield walk.at, records
    yield walk.at, records


class CaptureStreamReader(DataSourceStreamReader):
    def __init__(self, path: str, kind: str, split_bytes: int = SPLIT_BYTES) -> None:
        self.path, self.kind, self.split_bytes = path, kind, split_bytes
        self.known: dict | None = None  # the last offset told: the walk goes on from there

    def initialOffset(self) -> dict:
        return {"file": "", "place": 0, "byte": 0, "records": 0}

    def _files(self) -> list[CaptureFile]:
        try:
            return files_of(self.path)
        except FileNotFoundError:
            return []

    def latestOffset(self) -> dict:
        """The end of the last whole record there is. Of the last file only what came since the last call is walked."""
        files = self._files()
        if not files:
            return self.known or self.initialOffset()
        place, last = len(files) - 1, files[-1]
        known = self.known if self.known and self.known["file"] == last.path else None
        with opened(self.path)[0].open_input_file(last.path) as file:
            layout = layout_of(self.kind, file)
            at, records = (known["byte"], known["records"]) if known and known["byte"] else (layout.start if layout else 0, 0)
            if layout:
                *_, (at, more) = boundaries(file, layout, at, 1 << 62)
                records += more
        self.known = {"file": last.path, "place": place, "byte": at, "records": records}
        return self.known

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        due = [f for f in self._files() if start["file"] <= f.path <= end["file"]]
        begun = bool(due) and due[0].path == start["file"]
        place = start["place"] if begun or not start["file"] else start["place"] + 1
        for k, f in enumerate(due):
            with opened(self.path)[0].open_input_file(f.path) as file:
                layout = layout_of(self.kind, file)
                if layout is None:
                    continue
                resumed = k == 0 and begun and start["byte"] > 0
                at, number = (start["byte"], start["records"]) if resumed else (layout.start, 0)
                number += (place + k) << 40
                passed = 0
                for stop, records in boundaries(file, layout, at, self.split_bytes, end["byte"] if f.path == end["file"] else None):
                    if stop > at:
                        out.append(Stretch(f.path, at, stop, number + passed))
                    at, passed = stop, records
        return out

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        with opened(self.path)[0].open_input_file(partition.path) as file:
            yield from rows_between(file, layout_of(self.kind, file), partition.start, partition.stop, partition.number)

    def commit(self, end: dict) -> None:
        """Nothing is held for a batch."""
