import struct

import pytest

from flowspark.sources import capture_stream, splits
from flowspark.sources.pcap import FORMATS, PACKETS, read_packets, stream_packets, write_packets
from tests.packets import ethernet, ipv4, stream, udp


def like_headers(number, steps, caplen):
    """A payload that holds a chain of plausible record headers."""
    return b"".join(struct.pack("<IIII", number % 7 + 1, k, caplen, caplen) + b"A" * caplen for k in range(steps))


def frames(n=300):
    out = []
    for k in range(n):
        body = like_headers(k, 12, 20) if k % 3 == 0 else like_headers(k, 40, 7)[: 13 * (k % 29)] if k % 3 == 1 else b"x" * (k % 50)
        out.append((k * 20_000, ethernet(ipv4("10.0.0.1", "10.0.0.2", 17, udp(1, 2, body)))))
    return out


def pcap(records, order="<", magic=splits.MAGIC):
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 1)
    return out + b"".join(struct.pack(order + "IIII", us // 10**6, us % 10**6, len(f), len(f)) + f for us, f in records)


def rows(df):
    return sorted((r.pkt_no, r.us, r.wlen, bytes(r.pkt)) for r in df.collect())


@pytest.mark.parametrize("kind, split", [("pcap", 700), ("pcap", 50_000), ("erf", 1000)])
def test_ranges_of_a_file_give_the_sequential_rows(spark, tmp_path, kind, split):
    path = str(tmp_path / kind)
    write_packets(stream(spark, frames()).coalesce(1), path, kind)
    spark.dataSource.register(FORMATS[kind])
    whole = rows(spark.read.format(kind).load(path))
    assert len(whole) == 300 and rows(read_packets(spark, path, kind, split_bytes=split)) == whole


def test_wrong_guesses_are_walked_again(spark, tmp_path):
    """Ranges that begin inside payloads full of headers: many first guesses are wrong, no row is."""
    (tmp_path / "a.pcap").write_bytes(pcap(frames()))
    path = str(tmp_path)
    plan = splits.plan_ranges(spark, path, "pcap", splits.files_of(path), 700).collect()
    file = splits.opened(path)[0].open_input_file(str(tmp_path / "a.pcap"))
    layout = splits.layout_of("pcap", file)
    guesses = [splits.guess(file, layout, r.number * 700, (r.number + 1) * 700) for r in plan if r.number]
    assert sum(g != r.start for g, r in zip(guesses, [r for r in plan if r.number], strict=True)) > 10
    assert sum(r.records for r in plan) == 300 and all(a.stop == b.start for a, b in zip(sorted(plan)[:-1], sorted(plan)[1:], strict=True))


@pytest.mark.parametrize("order, magic", [("<", splits.MAGIC), (">", splits.MAGIC), ("<", splits.MAGIC_NANO)])
def test_byte_orders_and_cut_files(spark, tmp_path, order, magic):
    data = pcap(frames(100), order, magic)
    for name, cut in (("a", len(data)), ("b", len(data) - 5), ("c", 30), ("d", 24), ("e", 10), ("f", 0)):
        (tmp_path / f"{name}.pcap").write_bytes(data[:cut])
    spark.dataSource.register(FORMATS["pcap"])
    whole = rows(spark.read.format("pcap").load(str(tmp_path)))
    assert len(whole) == 199 and rows(read_packets(spark, str(tmp_path), split_bytes=999)) == whole


def test_a_record_longer_than_ranges(spark, tmp_path):
    records = [(0, b"a" * 100), (10, b"b" * 9000), (20, b"c" * 10), (30, b"d" * 5000)]
    (tmp_path / "a.pcap").write_bytes(pcap(records))
    got = rows(read_packets(spark, str(tmp_path), split_bytes=500))
    assert [(n, us, p) for n, us, _, p in got] == [(k, us, f) for k, (us, f) in enumerate(records)]


def test_no_capture(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(b"no capture at all, but long enough")
    with pytest.raises(Exception, match="no PCAP file"):
        read_packets(spark, str(tmp_path), split_bytes=10).count()
    with pytest.raises(FileNotFoundError):
        read_packets(spark, str(tmp_path / "none"))


def run_stream(spark, source, out, state):
    query = stream_packets(spark, source).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return rows(spark.read.parquet(out)) if query.lastProgress else []


def test_stream_of_a_growing_folder(spark, tmp_path):
    """Restarts over a file that grows, also in the middle of a record, and over new files: each packet once, as in batch."""
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    first, second = pcap(frames(60)), pcap(frames(90)[60:])
    cut = len(first) // 2
    file = tmp_path / "in" / "1.pcap"
    file.write_bytes(first[:10])  # not even a header
    spark.createDataFrame([], PACKETS).write.parquet(out)
    assert run_stream(spark, source, out, state) == []
    file.write_bytes(first[:cut])
    some = run_stream(spark, source, out, state)
    assert 0 < len(some) < 60
    file.write_bytes(first)
    (tmp_path / "in" / "2.pcap").write_bytes(second[:24])
    assert len(run_stream(spark, source, out, state)) == 60
    (tmp_path / "in" / "2.pcap").write_bytes(second)
    (tmp_path / "in" / "3.pcap").write_bytes(first)
    got = run_stream(spark, source, out, state)
    assert got == rows(spark.read.format("pcap").load(source)) and len(got) == 150
    assert run_stream(spark, source, out, state) == got


def test_offsets_of_a_stream(tmp_path):
    data = pcap(frames(50))
    (tmp_path / "1.pcap").write_bytes(data)
    (tmp_path / "2.pcap").write_bytes(data[:5000])
    reader = capture_stream.CaptureStreamReader(str(tmp_path), "pcap", split_bytes=2000)
    assert capture_stream.CaptureStreamReader(str(tmp_path / "none"), "pcap").latestOffset()["file"] == ""
    start, end = reader.initialOffset(), reader.latestOffset()
    parts = reader.partitions(start, end)
    assert len(parts) > 4 and [p.start for p in parts if p.path.endswith("1.pcap")][1:] == [p.stop for p in parts if p.path.endswith("1.pcap")][:-1]
    numbers = [n for p in parts for b in reader.read(p) for n in b.column(0).to_pylist()]
    assert numbers == sorted(numbers) and numbers[:50] == list(range(50)) and numbers[50] == 1 << 40
    (tmp_path / "2.pcap").write_bytes(data)
    later = reader.latestOffset()
    more = [n for p in reader.partitions(end, later) for b in reader.read(p) for n in b.column(0).to_pylist()]
    assert numbers + more == [*range(50), *range(1 << 40, (1 << 40) + 50)]
    again = [n for p in capture_stream.CaptureStreamReader(str(tmp_path), "pcap").partitions(end, later) for b in reader.read(p) for n in b.column(0).to_pylist()]
    assert again == more and later["place"] == 1 and reader.partitions(later, later) == []


class Counted:
    """An open file that tells how many bytes were read."""

    def __init__(self, file):
        self.file, self.read = file, 0

    def size(self):
        return self.file.size()

    def read_at(self, n, at):
        out = self.file.read_at(n, at)
        self.read += len(out)
        return out


def test_small_ranges_read_no_more_than_they_hold(spark, tmp_path):
    """Ranges of 4 KiB: each reads what it holds and a record's end, and they share some tasks."""
    data = pcap(frames(3000))
    (tmp_path / "a.pcap").write_bytes(data)
    files = splits.files_of(str(tmp_path))
    file = Counted(splits.opened(str(tmp_path))[0].open_input_file(files[0].path))
    layout = splits.layout_of("pcap", file)
    plan = sorted(splits.plan_ranges(spark, str(tmp_path), "pcap", files, 4096).collect())
    assert len(plan) > 100 and sum(r.records for r in plan) == 3000
    n = sum(b.num_rows for r in plan for b in splits.rows_between(file, layout, r.start, r.stop, r.first))
    assert n == 3000 and file.read < 2 * len(data)
    assert read_packets(spark, str(tmp_path), split_bytes=4096).rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism


def test_a_wrong_guess_is_walked_only_until_it_meets(tmp_path):
    """From every guess in a range's first records, true or not, the measure is that of a walk from the true one."""
    (tmp_path / "a.pcap").write_bytes(pcap(frames(2000)))
    file = Counted(splits.opened(str(tmp_path))[0].open_input_file(str(tmp_path / "a.pcap")))
    layout, stop = splits.layout_of("pcap", file), file.size() - 10
    places = sorted({splits.guess(file, layout, at, stop) for at in range(24, 8000, 40)})
    want, met = splits.measure(file, layout, 24, stop), 0
    for begun in places:
        known = splits.measure(file, layout, begun, stop)
        file.read = 0
        assert splits.measure_again(file, layout, 24, stop, begun, *known) == want
        met += file.read < file.size() / 4
    assert len(places) > 20 and met > len(places) / 2
