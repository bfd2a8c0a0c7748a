"""The registered queries over the driver's tables, and the SQL that gives the same rows.

The events table is the record stream: a record's position is event_id, its length the
value in cents, its flow the user, its protocol the event type, its payload props.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.functions import anonymize as anon
from flowspark.operators import aggregates, filters, flows, trackers, values, windows
from flowspark.plans import apps
from flowspark.sources.records import from_events

QUERIES: dict = {}
ORACLE_SQL: dict = {}

#: The record stream in SQL.
E = """WITH e AS (SELECT event_id AS pkt_no, epoch_us(ts) AS us, CAST(round(value * 100) AS BIGINT) AS wlen, user_id AS flow_key,
event_type AS proto, props AS payload, CAST(user_id % 4 AS INTEGER) AS sensor FROM events)"""
HOUR, DAY = 3_600_000_000, 86_400_000_000
STATS_SQL = "count(v) AS count, CAST(sum(v) AS BIGINT) AS sum, CAST(sum(v * v) AS BIGINT) AS sum2, min(v) AS min, max(v) AS max"


def query(sql: str | None):
    """Register a function of the record stream under its name."""

    def wrap(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(from_events(spark, sf_dir))

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE_SQL[f.__name__] = E + sql if not sql.startswith("WITH") else sql
        return f

    return wrap


def table_query(sql: str | None):
    """Register a function of (spark, sf_dir)."""

    def wrap(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return wrap


# -- counters and values ----------------------------------------------------


@query(" SELECT count(*) AS value FROM e")
def pkt_counter(e):
    return aggregates.pkt_counter(e)


@query(" SELECT CAST(sum(wlen) AS BIGINT) AS value FROM e")
def byte_counter(e):
    return aggregates.byte_counter(e)


@query(" SELECT count(*) AS total, count(*) FILTER (WHERE proto = 'click') AS clicks FROM e")
def counter_before_after_filter(e):
    return e.agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("proto") == "click", 1)).alias("clicks"))


@query(" SELECT pkt_no, (us // 1000000) * 4294967296 + ((us % 1000000) * 4294967296) // 1000000 AS time, wlen AS size FROM e")
def pktinfo_ts_size(e):
    return values.pktinfo(values.pktinfo(e, values.TIME).withColumnRenamed("value", "time"), values.SIZE).select("pkt_no", "time", F.col("value").alias("size"))


@query(" SELECT pkt_no, coalesce(us - lag(us) OVER (ORDER BY pkt_no), 0) AS gap FROM e")
def gap(e):
    return values.gap(e).select("pkt_no", "gap")


@query(" SELECT CAST(sum(wlen) FILTER (WHERE proto = 'view') + sum(wlen) FILTER (WHERE proto = 'click') AS BIGINT) AS value FROM e")
def binop_add(e):
    return values.binop(aggregates.byte_counter(e.where("proto = 'view'")), aggregates.byte_counter(e.where("proto = 'click'")), values.ADD)


@query(" SELECT CAST(sum(wlen) FILTER (WHERE proto = 'click') - sum(wlen) FILTER (WHERE proto = 'view') AS BIGINT) AS value FROM e")
def binop_sub(e):
    return values.binop(aggregates.byte_counter(e.where("proto = 'click'")), aggregates.byte_counter(e.where("proto = 'view'")), values.SUB)


@query(""" SELECT pkt_no, (strlen(payload) + coalesce(list_sum(list_transform(string_split(payload, ''), lambda c: ascii(c))), 0)) % 500009 AS hash FROM e""")
def payload_hash(e):
    return e.select("pkt_no", values.byte_hash(F.col("payload")).alias("hash"))


# -- statistics and histograms ----------------------------------------------


@query(f" SELECT {STATS_SQL} FROM (SELECT wlen AS v FROM e)")
def stats_every(e):
    return aggregates.stats(e, F.col("wlen"))


@query(f" SELECT {STATS_SQL} FROM (SELECT wlen AS v FROM e WHERE pkt_no > (SELECT min(pkt_no) FROM e))")
def stats_skip_first(e):
    return aggregates.stats(e, F.col("wlen"), "1")


@query(f" SELECT {STATS_SQL} FROM (SELECT CAST(sum(wlen) AS BIGINT) AS v FROM e GROUP BY (us - (SELECT min(us) FROM e)) // {HOUR})")
def stats_periodic(e):
    return aggregates.stats(e, F.col("wlen"), "1h")


@query(f" SELECT sensor, {STATS_SQL} FROM (SELECT sensor, wlen AS v FROM e) GROUP BY sensor")
def stats_by_sensor(e):
    return aggregates.stats(e, F.col("wlen"), by=["sensor"])


@query(""" , b AS (SELECT CASE WHEN wlen < 1000 THEN 0 WHEN wlen >= 20000 THEN 19 ELSE (wlen - 1000) // 1000 END AS bin, count(*) AS n FROM e GROUP BY 1)
SELECT k AS bin, coalesce(n, 0) AS count FROM generate_series(0, 19) AS g(k) LEFT JOIN b ON bin = k""")
def dist(e):
    return aggregates.dist(e, F.col("wlen"), 1000, 20000, 1000)


@query(""" , b AS (SELECT CAST(CASE WHEN wlen < 1000 THEN 0 WHEN wlen > 20000 THEN 19 WHEN wlen = 1000 THEN 19 ELSE least(19, ceil((wlen - 1001) / 1000.0)) END AS BIGINT) AS bin, count(*) AS n FROM e GROUP BY 1)
SELECT k AS bin, coalesce(n, 0) AS count FROM generate_series(0, 19) AS g(k) LEFT JOIN b ON bin = k""")
def dist_legacy(e):
    return aggregates.dist(e, F.col("wlen"), 1000, 20000, 1000, exact_legacy=True)


@query(""" , d AS (SELECT pkt_no, wlen, us * 1000 AS ns, us * 1000 + (wlen * 8000) // 1 AS due FROM e),
l AS (SELECT *, lag(due) OVER (ORDER BY pkt_no) AS before FROM d),
n AS (SELECT *, CASE WHEN before IS NULL THEN 1 WHEN ns - before < -120000000000 OR ns - before > 120000000000 THEN 1 ELSE 0 END AS new,
      greatest(0, ns - before) // 8000 AS silence FROM l),
i AS (SELECT *, sum(new) OVER (ORDER BY pkt_no) AS burst FROM n),
b AS (SELECT burst, sum(wlen) AS bytes, count(*) AS packets, sum(CASE WHEN new = 1 AND before IS NOT NULL THEN silence END) AS gap FROM i GROUP BY burst),
c AS (SELECT CASE WHEN bytes < 1000 THEN 0 WHEN bytes >= 41000 THEN 11 ELSE (bytes - 1000) // 4000 + 1 END AS category, bytes, packets, 1 AS bursts, 0 AS gap_bytes, 0 AS gaps FROM b
UNION ALL SELECT CASE WHEN gap < 1000 THEN 0 WHEN gap >= 41000 THEN 11 ELSE (gap - 1000) // 4000 + 1 END, 0, 0, 0, gap, 1 FROM b WHERE gap IS NOT NULL)
SELECT CAST(category AS BIGINT) AS category, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(packets) AS BIGINT) AS packets, CAST(sum(bursts) AS BIGINT) AS bursts,
CAST(sum(gap_bytes) AS BIGINT) AS gap_bytes, CAST(sum(gaps) AS BIGINT) AS gaps FROM c GROUP BY 1""")
def burst_histogram(e):
    return aggregates.burst(e, 1000, 41000, 4000, 0, 120 * 10**9, 120 * 10**9, 1)


@query(" SELECT flow_key AS value, count(*) AS packets, CAST(sum(wlen) AS BIGINT) AS bytes FROM e GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_by_packets(e):
    return aggregates.top(e, F.col("flow_key"), 10)


@query(" SELECT flow_key AS value, count(*) AS packets, CAST(sum(wlen) AS BIGINT) AS bytes FROM e GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 10")
def top_by_bytes(e):
    return aggregates.top(e, F.col("flow_key"), 10, aggregates.BY_BYTES)


@query(f""" , c AS (SELECT us // {DAY} AS period, flow_key AS value, count(*) AS packets, CAST(sum(wlen) AS BIGINT) AS bytes FROM e GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY period ORDER BY packets DESC, value) AS INTEGER) AS rank FROM c) SELECT * FROM r WHERE rank <= 3""")
def top_reset(e):
    return aggregates.top(e, F.col("flow_key"), 3, reset="24h")


# -- filters and samplers ---------------------------------------------------


@query(" SELECT min(us) AS first_us, max(us) AS last_us, count(*) AS packets FROM e WHERE us BETWEEN (SELECT min(us) FROM e) + 3600000000 AND (SELECT min(us) FROM e) + 36000000000")
def startstop_relative(e):
    return filters.startstop(e, "+1h", "+10h").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count(F.lit(1)).alias("packets"))


@query(" SELECT pkt_no, us FROM e WHERE us BETWEEN epoch_us(TIMESTAMP '2024-01-05 00:00:00') AND epoch_us(TIMESTAMP '2024-01-05 12:00:00')")
def startstop_absolute(e):
    return filters.startstop(e, "2024-01-05 00:00:00", "+12h").select("pkt_no", "us")


@query(" SELECT pkt_no FROM (SELECT pkt_no, row_number() OVER (ORDER BY pkt_no) AS n FROM e) WHERE n % 20 = 0")
def sample_periodic(e):
    return filters.sample_periodic(e, 20).select("pkt_no")


@query(" SELECT pkt_no FROM e WHERE ('0x' || substr(md5('42:' || pkt_no), 1, 8))::BIGINT % 100 < 10")
def sample_probabilistic(e):
    return filters.sample_probabilistic(e, 10).select("pkt_no")


def _mix_sql() -> str:
    """The three rounds of the mix as nested selects."""
    inner = "SELECT pkt_no, flow_key, (flow_key + 2654435769) & 4294967295 AS a, ((xor(sensor, 6)) + 2654435769) & 4294967295 AS b, ((flow_key | (sensor << 16)) + 6564987) & 4294967295 AS c FROM e"
    word = lambda x: f"(({x}) & 4294967295)"
    for right, left, last in ((13, 8, 13), (12, 16, 5), (3, 10, 15)):
        inner = f"SELECT pkt_no, flow_key, {word(f'xor({word("a - b - c")}, c >> {right})')} AS a, b, c FROM ({inner})"
        inner = f"SELECT pkt_no, flow_key, a, {word(f'xor({word("b - c - a")}, a << {left})')} AS b, c FROM ({inner})"
        inner = f"SELECT pkt_no, flow_key, a, b, {word(f'xor({word("c - a - b")}, b >> {last})')} AS c FROM ({inner})"
    return f" SELECT pkt_no, flow_key, c % 1024 AS hash FROM ({inner}) WHERE c % 1024 < 256"


@query(_mix_sql())
def hash_sample(e):
    h = filters.flow_hash(F.col("flow_key"), F.col("sensor"), F.lit(6), F.col("flow_key"), F.col("sensor"))
    return filters.hash_sample(e.withColumn("hash", h), F.col("hash"), 256).select("pkt_no", "flow_key", "hash")


@query(" SELECT pkt_no FROM e WHERE contains(substr(payload, 3, 8), 'k\": 1')")
def str_search_offset_depth(e):
    return e.where(filters.str_search(F.col("payload"), "k|22|: 1", 2, 8)).select("pkt_no")


@query(" SELECT pkt_no FROM e WHERE contains(payload, ': 7') OR contains(payload, ': 42}')")
def str_search_alternatives(e):
    return e.where(filters.str_search(F.col("payload"), ": 7||: 42}")).select("pkt_no")


@query(" SELECT pkt_no FROM e WHERE regexp_matches(payload, '\": [1-3]5')")
def regexp_search(e):
    return e.where(filters.regexp(F.col("payload"), '": [1-3]5')).select("pkt_no")


# -- windows and thresholds -------------------------------------------------

BUCKET_SQL = f""" , o AS (SELECT min(us) AS f, max(us) AS l FROM e), b AS (SELECT (us - f) // {HOUR} AS bucket, CAST(sum(wlen) AS BIGINT) AS v FROM e, o GROUP BY 1),
g AS (SELECT CAST(k AS BIGINT) AS bucket, f + (k + 1) * {HOUR} AS end_us, coalesce(v, 0) AS value FROM o, generate_series(0, (l - f) // {HOUR} - 1) AS s(k) LEFT JOIN b ON b.bucket = k)"""


@query(BUCKET_SQL + " SELECT * FROM g")
def bucket_reset(e):
    return windows.bucket(e, F.col("wlen"), "1h")


@query(BUCKET_SQL + " SELECT bucket, end_us, CAST(sum(value) OVER (ORDER BY bucket) AS BIGINT) AS value FROM g")
def bucket_cumulative(e):
    return windows.bucket(e, F.col("wlen"), "1h", reset=False)


@query(" SELECT pkt_no, wlen AS value FROM e WHERE wlen > 20000")
def threshold_gt(e):
    return windows.threshold(e, F.col("wlen"), windows.GT, 20000).select("pkt_no", "value")


@query(" SELECT pkt_no, wlen AS value FROM e WHERE wlen < 50 ORDER BY pkt_no LIMIT 5")
def threshold_lt_count(e):
    return windows.threshold(e, F.col("wlen"), windows.LT, 50, 5).select("pkt_no", "value")


@query(" SELECT pkt_no, wlen AS value FROM e WHERE wlen = 4200")
def threshold_eq(e):
    return windows.threshold(e, F.col("wlen"), windows.EQ, 4200).select("pkt_no", "value")


@query(" SELECT pkt_no, value FROM (SELECT pkt_no, wlen AS value, wlen - lag(wlen) OVER (ORDER BY pkt_no) AS d FROM e) WHERE d > 15000")
def threshold_delta(e):
    return windows.threshold(e, F.col("wlen"), windows.DIFF_GT, 15000).select("pkt_no", "value")


@query(f""" , m AS (SELECT pkt_no, CAST(sum(wlen) OVER (PARTITION BY sensor ORDER BY us RANGE BETWEEN {HOUR - 1} PRECEDING AND CURRENT ROW) AS BIGINT) AS value FROM e) SELECT * FROM m WHERE value > 60000""")
def threshold_moving_window(e):
    return windows.moving_window(e, F.col("wlen"), "1h", "sensor").where("value > 60000").select("pkt_no", "value")


@query(f""" , o AS (SELECT min(us) AS f, max(us) AS l FROM e),
b AS (SELECT (us - f) // {DAY} AS bucket, count(*) AS n, CAST(sum(wlen) AS BIGINT) AS s, count(wlen) AS c, CAST(sum(wlen * wlen) AS BIGINT) AS s2, min(wlen) AS mi, max(wlen) AS ma FROM e, o GROUP BY 1)
SELECT CAST(k AS BIGINT) AS bucket, concat_ws(' ', coalesce(n, 0), coalesce(s, 0), coalesce(c, 0), coalesce(s, 0), coalesce(s2, 0), coalesce(mi, 0), coalesce(ma, 0)) AS line
FROM o, generate_series(0, (l - f) // {DAY}) AS g(k) LEFT JOIN b ON b.bucket = k""")
def res2file_lines(e):
    rows = e.withColumn("one", F.lit(1))
    return windows.res2file(rows, "24h", [(windows.COUNT, "one"), (windows.COUNT, "wlen"), (windows.STATS, "wlen")])


# -- flows and trackers -----------------------------------------------------

ISLANDS = f""" , l AS (SELECT *, CASE WHEN us - lag(us) OVER w > {12 * HOUR} OR lag(us) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY flow_key ORDER BY us, pkt_no)),
i AS (SELECT *, sum(new) OVER (PARTITION BY flow_key ORDER BY us, pkt_no) AS session FROM l),
f AS (SELECT flow_key, session, min(us) AS start_us, max(us) AS end_us, count(*) AS packets, CAST(sum(wlen) AS BIGINT) AS bytes FROM i GROUP BY 1, 2)"""


@query(ISLANDS + " SELECT flow_key, start_us, end_us, packets, bytes FROM f")
def expired_flows(e):
    return flows.expired_flows(e, ["flow_key"], "12h")


@query(ISLANDS + " SELECT flow_key, start_us, end_us, packets, bytes FROM f WHERE packets >= 3")
def expired_flows_min_pkts(e):
    return flows.expired_flows(e, ["flow_key"], "12h", 3)


@query(ISLANDS + """ SELECT count(*) FILTER (WHERE packets >= 3) AS sent_flows, count(*) FILTER (WHERE packets < 3) AS ignored_flows,
CAST(sum(packets) FILTER (WHERE packets >= 3) AS BIGINT) AS sent_packets, CAST(sum(packets) FILTER (WHERE packets < 3) AS BIGINT) AS ignored_packets, CAST(0 AS BIGINT) AS dropped_flows FROM f""")
def expired_flows_stats(e):
    return flows.ignored_flows(e, ["flow_key"], "12h", 3)


def _edges_sql(column: str, test: str, edges: list[int]) -> str:
    low = [None, *edges]
    parts = [" AND ".join([test, f"{column} IS NOT NULL", *([f"{column} > {a}"] if a is not None else []), *([f"{column} <= {b}"] if b is not None else [])]) for a, b in zip(low, [*edges, None], strict=True)]
    return "[" + ", ".join(f"count(*) FILTER (WHERE {p})" for p in parts) + "]"


def _report_sql() -> str:
    sides = []
    for d in (0, 1):
        t = f"dir = {d}"
        sides += [
            f"count(*) FILTER (WHERE {t}) AS packets{d}", f"CAST(coalesce(sum(wlen) FILTER (WHERE {t}), 0) AS BIGINT) AS bytes{d}", f"min(wlen) FILTER (WHERE {t}) AS min_length{d}", f"max(wlen) FILTER (WHERE {t}) AS max_length{d}",
            f"min(us) FILTER (WHERE {t}) AS first_us{d}", f"max(us) FILTER (WHERE {t}) AS last_us{d}", f"CAST(coalesce(sum(distance) FILTER (WHERE {t}), 0) AS BIGINT) AS distance_sum{d}",
            f"CAST(coalesce(sum(wlen * wlen) FILTER (WHERE {t} AND distance IS NOT NULL), 0) AS BIGINT) AS length_sum2_{d}", f"{_edges_sql('wlen', t, flows.LENGTH_EDGES[:-1])} AS lengths{d}", f"{_edges_sql('distance', t, flows.DISTANCE_EDGES)} AS distances{d}",
        ]
    return ISLANDS.replace(str(12 * HOUR), str(6 * HOUR)) + f""",
x AS (SELECT *, min(us) OVER s AS first_us, proto = 'view' AS forward, first_value(proto = 'view') OVER (PARTITION BY flow_key, session ORDER BY us, pkt_no) AS lead_dir FROM i WINDOW s AS (PARTITION BY flow_key, session)),
y AS (SELECT *, (us - first_us) // {4 * HOUR} AS slice, CASE WHEN forward = lead_dir THEN 0 ELSE 1 END AS dir FROM x),
z AS (SELECT *, us - lag(us) OVER (PARTITION BY flow_key, session, slice, dir ORDER BY us, pkt_no) AS distance FROM y),
r AS (SELECT flow_key, session, slice, min(first_us) AS flow_start_us, min(us) AS start_us, max(us) AS end_us, {", ".join(sides)} FROM z GROUP BY 1, 2, 3)
SELECT * EXCLUDE (session), CAST(session AS BIGINT) AS session, CAST(CASE WHEN lead(session) OVER k = session THEN 2 WHEN lead(session) OVER k IS NOT NULL THEN 1 ELSE 4 END AS INTEGER) AS end_reason,
CASE WHEN slice = 0 AND first_us0 IS NOT NULL AND first_us1 IS NOT NULL THEN first_us1 - first_us0 END AS latency_us FROM r WINDOW k AS (PARTITION BY flow_key ORDER BY session, slice)"""


@query(_report_sql())
def flow_report(e):
    return flows.flow_report(e, ["flow_key"], F.col("proto") == "view", "6h", "4h")


@query(f""" , s AS (SELECT sensor, (us // 3600000000) AS slot, CAST(sum(wlen) * 8 AS BIGINT) AS bits FROM e GROUP BY 1, 2),
m AS (SELECT sensor, CAST(sum(bits) OVER (PARTITION BY sensor ORDER BY slot RANGE BETWEEN 9 PRECEDING AND CURRENT ROW) AS BIGINT) * 1000000 // {10 * HOUR} AS rate FROM s)
SELECT sensor, CAST(min(rate) AS BIGINT) AS min_rate_1h, CAST(max(rate) AS BIGINT) AS max_rate_1h FROM m GROUP BY 1""")
def flow_rates(e):
    return flows.rates(e, ["sensor"], ("1h",))


@query(ISLANDS.replace(str(12 * HOUR), str(8 * HOUR)) + " SELECT pkt_no FROM (SELECT pkt_no, max(CASE WHEN proto = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY flow_key, session ORDER BY us, pkt_no) AS c FROM i) WHERE c = 1")
def tracker_session(e):
    return trackers.claimed(e, ["flow_key"], F.col("proto") == "purchase", "8h").where("claimed").select("pkt_no")


@query(" SELECT pkt_no, CASE WHEN proto = 'error' THEN 'fault' WHEN wlen > 10000 THEN 'large' WHEN contains(payload, ': 1') THEN 'one' END AS color FROM e")
def color_priority(e):
    tests = {"fault": F.col("proto") == "error", "large": F.col("wlen") > 10000, "one": filters.str_search(F.col("payload"), ": 1")}
    return trackers.color(e, tests).select("pkt_no", "color")


# -- anonymisation ----------------------------------------------------------


@query(" , f AS (SELECT flow_key, min(pkt_no) AS first_at FROM e GROUP BY 1), n AS (SELECT flow_key, row_number() OVER (ORDER BY first_at) AS n FROM f) SELECT pkt_no, n AS flow_key_map FROM e JOIN n USING (flow_key)")
def anon_map(e):
    return anon.map_first_seen(e, ["flow_key"]).select("pkt_no", "flow_key_map")


@query(" SELECT pkt_no, substr(repeat('TEST', CAST(ceil(length(payload) / 4.0) AS INTEGER)), 1, length(payload)) AS filled, 'TEST' AS replaced, substr(payload, 1, 4) AS stripped FROM e")
def anon_fill_replace_strip(e):
    p = F.col("payload")
    return e.select("pkt_no", anon.pattern_fill(p, "TEST").alias("filled"), anon.replace(p, "TEST").alias("replaced"), anon.strip(p, 4).alias("stripped"))


@query(" SELECT pkt_no, md5(payload) AS md5, sha1(payload) AS sha1, sha256(payload) AS sha256, rpad(substr(md5(payload), 1, length(payload)), CAST(length(payload) AS INTEGER), '0') AS padded FROM e")
def anon_hashed(e):
    p = F.col("payload")
    return e.select("pkt_no", anon.hashed(p, "MD5").alias("md5"), anon.hashed(p, "SHA").alias("sha1"), anon.hashed(p, "SHA_2", anon.SHORTEN).alias("sha256"), anon.hashed(p, "MD5", anon.PAD).alias("padded"))


@query(" SELECT pkt_no, strlen(payload) AS zeros FROM e")
def anon_zero(e):
    return e.select("pkt_no", F.octet_length(anon.zero(F.col("payload"))).cast("long").alias("zeros"))


@query(" SELECT pkt_no, regexp_replace(payload, '(K\": )([0-9]+)', '\\1NN', 'i') AS payload FROM e")
def anon_regexp(e):
    return e.select("pkt_no", anon.regexp(F.col("payload"), '(K": )([0-9]+)', [None, "NN"]).alias("payload"))


@query(None)
def anon_prefix_preserving(e):
    ips = e.select("pkt_no", F.concat_ws(".", F.lit("10"), (F.col("flow_key") % 7).cast("string"), (F.col("flow_key") % 250).cast("string"), F.col("sensor").cast("string")).alias("src_ip"))
    return anon.anonymize_ip(ips, b"0123456789abcdefFEDCBA9876543210", ("src_ip",))


def _drawn(salt: str) -> str:
    return f"((('0x' || substr(md5('{salt}:' || flow_key), 1, 13))::BIGINT + 1) / 4503599627370497.0)"


@query(f" SELECT pkt_no, CAST(1 + floor({_drawn('u')} * 100) AS BIGINT) AS uniform, 50.0 + 5.0 * sqrt(-2 * ln({_drawn('r')})) * cos(2 * pi() * {_drawn('a')}) AS gaussian FROM e")
def anon_map_distribution(e):
    return e.select("pkt_no", anon.map_distribution(F.col("flow_key"), "UNIFORM", 1, 100).alias("uniform"), anon.map_distribution(F.col("flow_key"), "GAUSSIAN", 50.0, 5.0).alias("gaussian"))


# -- scopes and applications ------------------------------------------------


@query(" SELECT sensor, count(*) AS packets, CAST(sum(wlen) AS BIGINT) AS bytes FROM e GROUP BY sensor")
def scope_vector(e):
    return e.groupBy("sensor").agg(F.count(F.lit(1)).alias("packets"), F.sum("wlen").cast("long").alias("bytes"))


@query(" SELECT sensor, us // 1000000 AS second, count(*) AS packets, CAST(sum(wlen) * 8 AS BIGINT) AS bits FROM e GROUP BY 1, 2")
def netload(e):
    return apps.netload(e)


@query(f""" SELECT sensor, us // {HOUR} AS slot, count(*) AS packets, CAST(sum(wlen) AS BIGINT) AS bytes, count(*) FILTER (WHERE proto = 'view') AS view_packets,
CAST(coalesce(sum(wlen) FILTER (WHERE proto = 'view'), 0) AS BIGINT) AS view_bytes, count(*) FILTER (WHERE proto = 'click') AS click_packets, CAST(coalesce(sum(wlen) FILTER (WHERE proto = 'click'), 0) AS BIGINT) AS click_bytes FROM e GROUP BY 1, 2""")
def bandwidth_by_protocol(e):
    return apps.bandwidth(e, {"view": F.col("proto") == "view", "click": F.col("proto") == "click"}, "1h")


@query(f""" , a AS (SELECT '24h' AS width, CAST(sum(wlen) AS BIGINT) AS v FROM e GROUP BY us // {DAY} UNION ALL SELECT '1h', CAST(sum(wlen) AS BIGINT) FROM e GROUP BY us // {HOUR}) SELECT width, {STATS_SQL} FROM a GROUP BY width""")
def load_statistics(e):
    return apps.load_statistics(e, ["24h", "1h"])


@query(""" , c AS (SELECT CASE WHEN proto IN ('view', 'click') THEN 'web' WHEN proto = 'purchase' THEN 'shop' ELSE 'other' END AS app, CASE WHEN sensor < 2 THEN 'in' ELSE 'out' END AS direction, flow_key AS host, count(*) AS packets, CAST(sum(wlen) AS BIGINT) AS bytes FROM e GROUP BY 1, 2, 3),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY app, direction ORDER BY bytes DESC, host) AS INTEGER) AS rank FROM c) SELECT * FROM r WHERE rank <= 3""")
def application_monitor(e):
    tests = {"web": F.col("proto").isin("view", "click"), "shop": F.col("proto") == "purchase"}
    return apps.application_monitor(e, tests, F.when(F.col("sensor") < 2, "in").otherwise("out"), F.col("flow_key"), 3)


@query(f""" , d AS (SELECT flow_key, min(us) AS since FROM e WHERE proto = 'purchase' AND wlen > 10000 GROUP BY 1)
SELECT count(*) AS packets, CAST(sum(wlen) AS BIGINT) AS bytes FROM e JOIN d USING (flow_key) WHERE us >= since""")
def dynamic_filter(e):
    return apps.dynamic_filter(e, ["flow_key"], (F.col("proto") == "purchase") & (F.col("wlen") > 10000)).agg(F.count(F.lit(1)).alias("packets"), F.sum("wlen").cast("long").alias("bytes"))


@query(""" , a AS (SELECT flow_key, count(*) AS sent FROM e GROUP BY 1), b AS (SELECT flow_key, count(*) AS received FROM e WHERE pkt_no % 33 <> 0 GROUP BY 1)
SELECT flow_key, sent, coalesce(received, 0) AS received, sent - coalesce(received, 0) AS lost FROM a LEFT JOIN b USING (flow_key)""")
def packet_loss(e):
    return apps.packet_loss(e, e.where("pkt_no % 33 <> 0"), ["flow_key"])


SPAN_BYTES = 16


@table_query(f"""WITH d AS (SELECT row_number() OVER () AS doc, source, regexp_extract_all(hex(encode(text)), '..') AS h FROM documents WHERE text IS NOT NULL AND source IS NOT NULL),
b AS (SELECT doc, source, unnest(list_transform(h, lambda x: CAST('0x' || x AS BIGINT))) AS x, generate_subscripts(h, 1) AS k FROM d),
s AS (SELECT source, ({' + '.join(f'lag(x, {k}) OVER w * {pow(257, k, 1 << 32)}' for k in range(SPAN_BYTES))}) % 4294967296 AS fingerprint FROM b WINDOW w AS (PARTITION BY doc ORDER BY k))
SELECT fingerprint, count(DISTINCT source) AS destinations FROM s WHERE fingerprint % 256 = 0 GROUP BY 1 HAVING count(DISTINCT source) >= 3""")
def common_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of 16 bytes of every document."""
    return apps.common_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text", "source", SPAN_BYTES, 3)


@table_query("SELECT CAST(date_trunc('day', l_shipdate) AS DATE) AS day, CAST(sum(l_quantity) AS BIGINT) AS bytes, count(*) AS packets FROM lineitem GROUP BY 1")
def link_utilisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.groupBy(F.to_date("l_shipdate").alias("day")).agg(F.sum("l_quantity").cast("long").alias("bytes"), F.count(F.lit(1)).alias("packets"))
