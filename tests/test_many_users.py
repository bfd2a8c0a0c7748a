from functools import reduce

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from flowspark.plans import packet_queries
from flowspark.sources.pcap import decode
from tests.oracle import connect, same

DIALOGUES, TRACKERS = ["effective_tcp_window", "flow_continuity"], ["track_gnutella", "track_dc", "track_edonkey", "track_ftp", "track_torrent", "track_irc"]


@pytest.fixture(scope="module")
def many(spark, sf_dir, tmp_path_factory):
    """The events of sf0.001 also of users about the ends of ports and of 16 bits."""
    out = str(tmp_path_factory.mktemp("users"))
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    parts = [e.withColumns({"event_id": F.col("event_id") + 1000 * k, "user_id": F.col("user_id") + shift}) for k, shift in enumerate((0, 64_508, 65_531, 68_800, 150_000))]
    union = parts[0]
    for p in parts[1:]:
        union = union.union(p)
    union.coalesce(1).write.parquet(f"{out}/events.parquet")
    return out


@pytest.mark.parametrize("name", [*DIALOGUES, *TRACKERS, "checksum_adjust", "pcap_round_trip"])
def test_users_beyond_16_bits_stay_apart(spark, sf_dir, many, name):
    con = connect(sf_dir)
    con.execute(f"CREATE OR REPLACE VIEW events AS SELECT * FROM read_parquet('{many}/events.parquet/*.parquet')")
    same(entry.queries()[name](spark, many), con, entry.oracle_sql()[name])


def test_frames_of_many_users_are_well_formed(spark, many):
    rows = decode(packet_queries.from_event_frames(spark, many)).where("ip_version = 4").select("pkt_no", "src_ip", "sport")
    e = spark.read.parquet(f"{many}/events.parquet").select(F.col("event_id").alias("pkt_no"), "user_id")
    got = rows.join(e, "pkt_no").select("user_id", "src_ip", "sport").distinct().collect()
    assert all(r.src_ip == f"10.{r.user_id >> 16}.{r.user_id >> 8 & 255}.{r.user_id & 255}" and (r.sport is None or r.sport >= 1024) for r in got)
    assert any(r.user_id > 150_000 for r in got)


def test_frames_of_few_users_are_those_of_the_sql(spark, sf_dir):
    own, sql = packet_queries.from_event_frames(spark, sf_dir), packet_queries.from_event_bytes(spark, sf_dir)
    assert own.count() > 0 and own.exceptAll(sql).count() == 0


@pytest.mark.parametrize("name", ["packet_fields", "packet_flow_totals", "packet_flow_report", "anonymize_pattern_fill", "anonymize_hashed", "cooking_then_str_search", "cooking", "cooking_disordered", "defragment", "anonymize_prefix_preserving_map"])
def test_shown_addresses_and_ports_are_those_of_the_sql(spark, sf_dir, many, name):
    con = connect(sf_dir)
    con.execute(f"CREATE OR REPLACE VIEW events AS SELECT * FROM read_parquet('{many}/events.parquet/*.parquet')")
    same(entry.queries()[name](spark, many), con, entry.oracle_sql()[name])


def test_address_and_port_tell_the_user(spark):
    """Also where the SQL's four hex digits of an IPv6 address are all that is left of a longer number."""
    ends = [0, 64_512, 65_536, 68_811, 1_032_192, 1 << 20, (1 << 20) + 4096, (1 << 24) - 300]
    users = spark.createDataFrame([(u,) for end in ends for u in range(max(0, end - 300), end + 300)], "u long").selectExpr("u", f"CAST({packet_queries.PORT} AS INT) AS sport")
    six = users.withColumn("src_ip", F.expr("'2001:0db8:0000:0000:0000:0000:0000:' || lower(lpad(hex(u), 4, '0'))"))
    four = users.withColumn("src_ip", F.expr("'10.' || u div 65536 || '.' || u div 256 % 256 || '.' || u % 256"))
    for rows in (six, four):
        got = packet_queries.numbered(rows.selectExpr("u AS user", "src_ip AS own", "src_ip", "sport", "sport AS port")).collect()
        assert all(1024 <= r.port <= 65535 and r.sport == 1024 + r.user for r in got)
        assert all(r.src_ip == (r.own if ":" in r.own else f"10.0.{r.user >> 8}.{r.user & 255}") for r in got)
    assert six.select("src_ip", "sport").distinct().count() == users.distinct().count()


def test_mapped_addresses_beyond_16_bits(spark, sf_dir, tmp_path):
    """The column is the SQL's, the packets themselves keep every new address apart."""
    kind = "CASE WHEN id % 3 = 0 THEN 'click' ELSE 'error' END AS event_type"
    events = spark.range(80_000).selectExpr("id AS event_id", "TIMESTAMP '2024-01-01' AS ts", "id AS user_id", kind, "1.0D AS value", "'x' AS props")
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = connect(sf_dir)
    con.execute(f"CREATE OR REPLACE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    same(entry.queries()["anonymize_map"](spark, str(tmp_path)), con, entry.oracle_sql()["anonymize_map"])
    packets = decode(packet_queries.from_event_frames(spark, str(tmp_path)))
    own, new = packets, packet_queries._changed(packets, "IP,SRC_IP,MAP")
    assert new.select("src_ip").distinct().count() == own.select("src_ip").distinct().count() > 65_536


def test_prefixes_are_those_of_the_sql_up_to_24_bits(spark, sf_dir, tmp_path):
    """Users of one, of eight and of up to sixteen bits before the last eight; below 65,536 the frames are those of all queries."""
    ends = [0, 255, 256, 65_535, 65_536, 66_113, 131_071, 131_072, 1 << 20, (1 << 24) - 1]
    rows = [(k, u, "view", "x") for k, u in enumerate(e + d for e in ends for d in (0, 1, 5, 77) if e + d < 1 << 24)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, props string").selectExpr("event_id", "TIMESTAMP '2024-01-01' AS ts", "user_id", "event_type", "1.0D AS value", "props")
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = connect(sf_dir)
    con.execute(f"CREATE OR REPLACE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    same(entry.queries()["anonymize_prefix_preserving_map"](spark, str(tmp_path)), con, entry.oracle_sql()["anonymize_prefix_preserving_map"])
    own, all_ = packet_queries.from_event_prefixes(spark, sf_dir), packet_queries.from_event_frames(spark, sf_dir)
    assert own.count() > 0 and own.exceptAll(all_).count() == 0


@pytest.fixture(scope="module")
def watched(spark, sf_dir, tmp_path_factory):
    """The events of sf0.001 also of users whose ports would be 2233, 2811 and between 20000 and 29999, the first time and once ports begin anew."""
    out = str(tmp_path_factory.mktemp("watched"))
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    moved = [e.withColumns({"event_id": F.col("event_id") + 1000 * k, "user_id": F.col("user_id") + again + port - 1024}) for k, (again, port) in enumerate((a, p) for a in (0, 64_512) for p in (1024, 2225, 2805, 19_995, 20_010, 24_995, 29_995))]
    reduce(lambda a, b: a.union(b), moved).coalesce(1).write.parquet(f"{out}/events.parquet")
    return out


@pytest.mark.parametrize("name", ["bpf_filters", "track_grid_ftp", "track_monitor"])
def test_ports_of_users_are_none_that_is_watched(spark, sf_dir, watched, name):
    con = connect(sf_dir)
    con.execute(f"CREATE OR REPLACE VIEW events AS SELECT * FROM read_parquet('{watched}/events.parquet/*.parquet')")
    same(entry.queries()[name](spark, watched), con, entry.oracle_sql()[name])


def test_client_ports_keep_users_apart(spark):
    ends = [0, 35_000, 64_512, 65_536, 68_811, 1 << 20, (1 << 20) + 4096, (1 << 24) - 300]
    users = spark.createDataFrame([(u,) for end in ends for u in range(max(0, end - 300), end + 300)], "u long").distinct()
    rows = users.selectExpr(f"CAST({packet_queries.CLIENT_PORT} AS INT) AS port", "lpad(hex(u), 4, '0') AS six").collect()
    assert all(30_000 <= r.port <= 65_535 for r in rows) and len(set(rows)) == len(rows) == users.count()
