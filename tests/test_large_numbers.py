from pyspark.sql import functions as F

from flowspark.operators import aggregates
from flowspark.plans import apps

HOUR = 3_600_000_000


def test_squares_of_sums_pass_64_bits(spark):
    """Four hours of 4e9 bytes each: the squares add up to more than a long holds."""
    rows = spark.createDataFrame([(k, (k // 2) * HOUR, 2_000_000_000) for k in range(8)], "pkt_no long, us long, wlen long")
    got = {r.width: r for r in apps.load_statistics(rows, ["24h", "1h"]).collect()}
    assert int(got["1h"].sum2) == 4 * 4_000_000_000**2 > 2**63 and int(got["24h"].sum2) == 16_000_000_000**2
    assert (got["1h"]["count"], got["1h"].sum, got["1h"].min, got["1h"].max) == (4, 16_000_000_000, 4_000_000_000, 4_000_000_000)
    r = aggregates.stats(rows, F.col("wlen"), "1h").first()
    assert int(r.sum2) == 4 * 4_000_000_000**2
