"""Rolling distinct users against brute force, over awkward clicks and chunk borders."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliomill.llm import queries, rolling

SCHEMA = "click_id long, ts timestamp_ntz, client_id long, kind string, chunk int, key string, minute string, n long, _c string, d0 int"
EPOCH = datetime(1970, 1, 1)


def brute(rows, windows, hot):
    taken, alone = {}, []
    for i, ts, user, kind, *_ in rows:
        if ts is None or kind is None:
            continue
        click = ((ts - EPOCH) // timedelta(minutes=1), kind, user is None, user or 0)
        if i is None:
            alone.append(click)
        else:
            taken[i] = min(click, taken.get(i, click))
    clicks = [*alone, *taken.values()]
    by_kind = defaultdict(list)
    for m, kind, none, user in clicks:
        by_kind[kind].append((m, None if none else user))
    out = []
    for kind, own in by_kind.items():
        for minute in {m for m, _ in own}:
            within = lambda length: [u for m, u in own if minute - length < m <= minute and u is not None]
            many = within(hot[1])
            out.append((kind, minute, *(len(set(within(n))) for n in windows.values()), sum(many.count(u) >= hot[2] for u in set(many))))
    return sorted(out)


def clicks_near_borders(seed, n=1500):
    rng, rows = random.Random(seed), []
    for i in range(n):
        minute = rng.choice([1440 * 19_723 - 720, 1440 * 19_724 - 5, 1440 * 19_726, -1440, -3]) + rng.choice([rng.randrange(1500), rng.randrange(20)])
        ts = EPOCH + timedelta(minutes=minute, seconds=rng.randrange(60), microseconds=rng.choice([0, 999_999]))
        user = rng.choice([None, 0, 0, 0, -7, rng.randrange(40)])
        row = (rng.choice([i, i, i, i // 3, None]), rng.choice([ts] * 20 + [None]), user, rng.choice(["view", "view", "click", "", None]), 1, "x", "y", 2, "z", 3)
        rows += [row] * rng.choice([1, 1, 1, 3])
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows, windows, hot = clicks_near_borders(seed), {"a": 10, "b": 60, "c": 720}, ("h", 720, 5)
    got = sorted(tuple(r) for r in rolling.rolling_users(spark.createDataFrame(rows, SCHEMA), windows, hot).collect())
    assert got == brute(rows, windows, hot) and len(got) > 500


@pytest.mark.parametrize(("windows", "hot"), [({"one": 1, "odd": 37}, ("h", 61, 2)), ({"long": 2000, "two": 2}, ("h", 1999, 7)), ({"w": 5}, ("h", 1, 1))])
def test_other_windows(spark, windows, hot):
    rows = clicks_near_borders(3, 700)
    got = sorted(tuple(r) for r in rolling.rolling_users(spark.createDataFrame(rows, SCHEMA), windows, hot).collect())
    assert got == brute(rows, windows, hot)


def test_small_batches_split_no_timeline(spark):
    rows, windows, hot = clicks_near_borders(4, 900), {"a": 10}, ("h", 720, 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(tuple(r) for r in rolling.rolling_users(spark.createDataFrame(rows, SCHEMA), windows, hot, slots=3).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(rows, windows, hot)


def test_empty_and_zoned(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert rolling.rolling_users(frame, {"a": 10}, ("h", 720, 5)).count() == 0
    zoned = spark.sql("SELECT 1L AS click_id, timestamp_micros(-1L) AS ts, 5L AS client_id, 'k' AS kind")
    assert [tuple(r) for r in rolling.rolling_users(zoned, {"a": 10}, ("h", 720, 5)).collect()] == [("k", -1, 1, 0)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 120), max_size=40), st.integers(1, 70), st.integers(1, 6))
def test_planes(minutes, length, least):
    planes = [sum(1 << m for m in set(minutes) if minutes.count(m) >= k) for k in range(1, least + 1)]
    got = rolling.windowed_planes(planes, length)[-1]
    spread = rolling.dilate(planes[0], length)
    for t in range(200):
        inside = sum(t - length < m <= t for m in minutes)
        assert (got >> t & 1, spread >> t & 1) == (inside >= least, inside >= 1)


def test_query_is_whole(spark, sf):
    clicks = spark.read.parquet(f"{sf}/clicks.parquet")
    assert queries.op11_rolling_users(spark, sf).count() == clicks.where("ts IS NOT NULL AND kind IS NOT NULL").selectExpr("kind", "date_trunc('minute', ts)").distinct().count()
