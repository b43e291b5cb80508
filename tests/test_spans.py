"""Cache spans against a walk request by request."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from sitestance.operators import policy

T0 = datetime(2016, 1, 1, tzinfo=timezone.utc)


def by_hand(rows, ttl):
    missed, last = set(), {}
    for key, at, row in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1], r[2])):
        if key not in last or at >= last[key] + ttl:
            last[key] = at
            missed.add(row)
    return {row: None if key is None else row not in missed for key, _, row in rows}


def requests(kind, draw):
    """Times of one key over up to eight years."""
    day = timedelta(days=1)
    return {
        "sparse": lambda: [T0 + draw.uniform(0, 2900) * day for _ in range(40)],
        "dense": lambda: [T0 + draw.uniform(0, 60) * day for _ in range(3000)],
        "periodic": lambda: [T0 + k * day / 4 for k in range(1600)],
        "whole_spans": lambda: [T0 + 7 * k * day for k in range(400)],
        "just_short": lambda: [T0 + k * (7 * day - timedelta(microseconds=1)) for k in range(300)],
        "ties": lambda: [T0 + draw.randrange(30) * day for _ in range(300)],
        "before_the_epoch": lambda: [datetime(1969, 12, 1, tzinfo=timezone.utc) + draw.uniform(0, 60) * day for _ in range(200)],
    }[kind]()


@pytest.mark.parametrize("ttl, batch", [(7, 10_000), (7, 7), (1, 64)])
def test_misses_are_those_of_a_walk(spark, ttl, batch):
    draw = random.Random(ttl * batch)
    kinds = ["sparse", "dense", "periodic", "whole_spans", "just_short", "ties", "before_the_epoch"]
    rows = [(kind, at) for kind in kinds for at in requests(kind, draw)] + [(None, T0)] * 3
    draw.shuffle(rows)
    rows = [(key, at, i) for i, (key, at) in enumerate(rows)]
    frame = spark.createDataFrame(rows, "origin string, ts timestamp, page_id long").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = {r["page_id"]: r["cached"] for r in policy.cache_hits(frame, ttl_days=ttl).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == by_hand(rows, timedelta(days=ttl))


def test_shuffles_do_not_depend_on_the_time_covered(spark, monkeypatch):
    counts = []
    written = policy._written

    def counting(df, *rest):
        counts[-1] += df._jdf.queryExecution().executedPlan().toString().count("Exchange ")
        return written(df, *rest)

    monkeypatch.setattr(policy, "_written", counting)
    for days in (10, 2900):
        counts.append(0)
        rows = [("o", T0 + timedelta(days=days * i / 50), i) for i in range(50)]
        hits = policy.cache_hits(spark.createDataFrame(rows, "origin string, ts timestamp, page_id long"))
        counts[-1] += hits._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    assert counts[0] == counts[1] <= 8


def test_no_requests(spark):
    frame = spark.createDataFrame([], "origin string, ts timestamp, page_id string")
    assert policy.cache_hits(frame).count() == 0
