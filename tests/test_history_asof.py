"""As-of history by one merged timeline, against a plain scan of every trade."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from marketsig.operators import series, topk

DAY = dt.datetime(2026, 1, 1)


def _rows(seed: int, n: int, keys: list, tie) -> list[tuple]:
    rnd = random.Random(seed)
    return [(rnd.choice(keys), rnd.choice([None] + [DAY + dt.timedelta(hours=rnd.randrange(40))] * 12), tie(i), rnd.choice([None, i * 1.5]))
            for i in range(n)]


def _expected(decisions, trades, k):
    out = []
    for key, ts, i, _ in decisions:
        before = [t for t in trades if None not in (key, ts, t[0], t[1]) and t[0] == key and t[1] < ts]
        before.sort(key=lambda t: (t[1], t[2]), reverse=True)
        out.append((i, [(t[2], t[3]) for t in before[:k]]))
    return sorted(out, key=repr)


def _frames(spark, decisions, trades, tie="long"):
    return (spark.createDataFrame(decisions, "k string, ts timestamp_ntz, id long, note double"),
            spark.createDataFrame(trades, f"k string, ts timestamp_ntz, t {tie}, price double"))


def _got(out):
    return sorted(((r.id, [(h.t, h.price) for h in r.history]) for r in out.collect()), key=repr)


@pytest.mark.parametrize("chunk,k", [(1, 1), (3, 2), (7, 5), (None, 3)])
def test_equals_a_scan_of_all_trades(spark, chunk, k):
    keys = ["a"] * 6 + ["b", "c", None]
    decisions, trades = _rows(1, 160, keys, lambda i: i), _rows(2, 120, keys, lambda i: 10_000 - i)
    d, t = _frames(spark, decisions, trades)
    out = topk.history_asof(d, t, "k", "ts", "id", "t", k, ["t", "price"], **({"chunk_rows": chunk} if chunk else {}))
    assert out.columns == ["k", "ts", "id", "note", "history"]
    assert _got(out) == _expected(decisions, trades, k)


def test_long_runs_of_either_kind_and_repeated_rows(spark):
    trades = [("a", DAY, i, None) for i in range(3)] + [("a", DAY + dt.timedelta(days=3), 100 + i, 1.0) for i in range(40)]
    decisions = [("a", DAY + dt.timedelta(hours=1 + i), 7, None) for i in range(50)] * 2 + [("a", DAY + dt.timedelta(days=9), 8, None), ("b", DAY, 9, 0.0)]
    d, t = _frames(spark, decisions, trades)
    assert _got(topk.history_asof(d, t, "k", "ts", "id", "t", 5, ["t", "price"], chunk_rows=4)) == _expected(decisions, trades, 5)


def test_text_ties_and_empty_sides(spark):
    keys = ["a", "b"]
    decisions, trades = _rows(3, 40, keys, lambda i: i), _rows(4, 40, keys, lambda i: f"t{i:03d}")
    d, t = _frames(spark, decisions, trades, "string")
    assert _got(topk.history_asof(d, t, "k", "ts", "id", "t", 2, ["t", "price"], chunk_rows=5)) == _expected(decisions, trades, 2)
    assert _got(topk.history_asof(d, t.limit(0), "k", "ts", "id", "t", 2, ["t", "price"])) == _expected(decisions, [], 2)
    assert topk.history_asof(d.limit(0), t, "k", "ts", "id", "t", 2, ["t", "price"]).count() == 0


def test_a_hot_time_is_split_by_kind_and_tie(spark):
    rows = [("a", DAY, i % 2, i * 997 % 4096) for i in range(4096)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, kind int, t long").withColumn("kind", F.col("kind").cast("tinyint"))
    out = series.index_series_adaptive(df, "k", "ts", [F.col("ts"), F.col("kind"), F.col("t")], max_block_rows=64, tie=["kind", "t"])
    got = [(r.kind, r.t) for r in out.orderBy("_pos").collect()]
    assert got == sorted((k, t) for _, _, k, t in rows)
