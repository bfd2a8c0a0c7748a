import random

import numpy as np
import pytest

from flowspark.plans import apps


def naive(data, span):
    return [sum(b * 257 ** (span - 1 - k) for k, b in enumerate(data[i : i + span])) % 2**32 for i in range(len(data) - span + 1)]


@pytest.mark.parametrize("span", [1, 2, 16, 150])
def test_rolling_fingerprints_equal_those_of_each_span(span):
    r = random.Random(span)
    payloads = [bytes(r.randrange(256) for _ in range(n)) for n in (0, span - 1, span, span + 1, 1000, 3, 400)]
    prints, whose, _ = apps.rolling_fingerprints(payloads, span)
    assert prints.dtype == np.uint32 and list(zip(whose.tolist(), prints.tolist(), strict=True)) == [(k, x) for k, p in enumerate(payloads) for x in naive(p, span)]


@pytest.mark.parametrize("skip_zeros", [False, True])
def test_common_fingerprints_against_each_span(spark, monkeypatch, skip_zeros):
    """Small stretches, a hot content, nulls, zero bytes, contents that go to one destination again and again."""
    monkeypatch.setattr(apps, "BYTES_AT_ONCE", 200)
    r = random.Random(3)
    worm, rows = bytes(r.choice(b"ab\0c") for _ in range(60)), [(None, "x"), (b"", "x"), (b"short", None)]
    for k in range(300):
        rest = bytes(r.randrange(256) for _ in range(r.randrange(40)))
        rows.append((rest + worm + rest if k % 3 else rest, f"host{k % 7 if k % 5 else 0}"))
    seen = {}
    for data, where in rows:
        for i, x in enumerate(naive(data, 8) if data and where else []):
            if x & 3 == 0 and not (skip_zeros and 0 in data[i : i + 8]):
                seen.setdefault(x, set()).add(where)
    df = spark.createDataFrame(rows, "data binary, d string").repartition(4)
    got = {r.fingerprint: r.destinations for r in apps.common_fingerprints(df, "data", "d", 8, 3, mask=3, skip_zeros=skip_zeros).collect()}
    assert got == {x: len(d) for x, d in seen.items() if len(d) >= 3} and got
    assert apps.common_fingerprints(df.limit(0), "data", "d", 8, 3).count() == 0
