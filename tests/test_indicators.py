import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketsig.operators import indicators as ind

# Golden series and values from FIXTURES.md section 3.
SAW20 = [100, 102, 101, 105, 103, 106, 108, 107, 110, 109, 111, 115, 113, 112, 116, 118, 117, 119, 121, 120]
SERIES = {
    "saw20": SAW20,
    "up14": list(range(1, 15)),
    "down14": list(range(14, 0, -1)),
    "flat14": [5] * 14,
    "short13": list(range(0, 13)),
    "single": [10],
}
GOLD = {  # rsi(last), macd, signal, histogram
    "saw20": (75.0, 4.769932949942685, 3.8512623857802617, 0.9186705641624235),
    "up14": (100.0, 3.0306842369932863, 2.0565879685620025, 0.9740962684312837),
    "down14": (0.0, -3.030684236993287, -2.056587968562005, -0.9740962684312819),
    "flat14": (None, 0.0, 0.0, 0.0),
    "short13": (None, 2.7769696387567, 1.8130639014541807, 0.9639057373025195),
    "single": (None, 0.0, 0.0, 0.0),
}
SAW_RSI = [None] * 13 + [71.42857142857143, 75.0, 75.0, 75.0, 73.33333333333333, 80.0, 75.0]


def _frame(spark):
    t0 = dt.datetime(2026, 1, 1)
    rows = [(k, t0 + dt.timedelta(hours=7 * i), i, float(v))
            for k, vals in SERIES.items() for i, v in enumerate(vals)]
    return spark.createDataFrame(rows, "ticker string, ts timestamp_ntz, seq long, close double")


def _close(a, b, tol=1e-9):
    if a is None or b is None:
        return a is None and b is None
    return abs(a - b) <= tol * max(1.0, abs(b))


@pytest.mark.parametrize("chunk", [None, 3])
def test_goldens(spark, chunk):
    d = ind.with_position(_frame(spark), "ticker", "ts", "seq", block_unit="day")
    if chunk:
        d = ind.rsi(d, "ticker", "close", chunk_rows=chunk + 14)
        d = ind.macd(d, "ticker", "close", chunk_rows=chunk)
    else:
        d = ind.rsi(d, "ticker", "close")
        d = ind.macd(d, "ticker", "close")
    rows = {(r.ticker, r._pos): r for r in d.collect()}
    for k, vals in SERIES.items():
        last = rows[(k, len(vals) - 1)]
        g = GOLD[k]
        assert _close(last.rsi, g[0]), (k, last.rsi)
        assert _close(last.macd, g[1]), (k, last.macd)
        assert _close(last.signal, g[2]), (k, last.signal)
        assert _close(last.histogram, g[3]), (k, last.histogram)
    for i, want in enumerate(SAW_RSI):
        assert _close(rows[("saw20", i)].rsi, want), (i, rows[("saw20", i)].rsi)


def test_properties(spark):
    ev = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    d = ind.indicator_table(ev, "user_id", "ts", "value", "event_id")
    bad = d.filter((F.col("rsi") < 0) | (F.col("rsi") > 100)
                   | (F.abs(F.col("histogram") - (F.col("macd") - F.col("signal"))) > 1e-9))
    assert bad.count() == 0
    assert d.count() == ev.count()
    # chunking must not change the result
    small = ind.with_position(ev, "user_id", "ts", "event_id")
    small = ind.macd(small, "user_id", "value", chunk_rows=7).select("event_id", F.col("signal").alias("s2"))
    j = d.join(small, "event_id").filter(F.abs(F.col("signal") - F.col("s2")) > 1e-9)
    assert j.count() == 0


def test_latest_closed_form_matches_goldens(spark):
    last = {r.ticker: r for r in ind.latest_indicators(_frame(spark), "ticker", "ts", "close", "seq").collect()}
    for k, g in GOLD.items():
        r = last[k]
        assert _close(r.rsi, g[0]) and _close(r.macd, g[1]) and _close(r.signal, g[2]), (k, r)
        assert _close(r.histogram, g[3]), k


def test_latest_closed_form_matches_full_series(spark):
    ev = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    full = ind.latest(ind.indicator_table(ev, "user_id", "ts", "value", "event_id")
                      .select("user_id", "rsi", "macd", "signal", ind.IDX), "user_id")
    fast = ind.latest_indicators(ev, "user_id", "ts", "value", "event_id")
    j = full.alias("a").join(fast.alias("b"), "user_id")
    bad = j.filter((F.abs(F.col("a.macd") - F.col("b.macd")) > 1e-9)
                   | (F.abs(F.col("a.signal") - F.col("b.signal")) > 1e-9)
                   | ~F.col("a.rsi").eqNullSafe(F.col("b.rsi")) & (F.abs(F.col("a.rsi") - F.col("b.rsi")) > 1e-9))
    assert j.count() == 150 and bad.count() == 0


def _brute(values, period=14, fast=12, slow=26, signal=9):
    """Plain recurrences on one series (the reference's pandas semantics)."""
    out, g, l = [], [], []
    ef = es = sg = None
    for i, v in enumerate(values):
        d = 0.0 if i == 0 else v - values[i - 1]
        g.append(max(d, 0.0))
        l.append(max(-d, 0.0))
        if i + 1 < period:
            r = None
        else:
            sg_, sl_ = sum(g[-period:]), sum(l[-period:])
            r = None if sl_ == 0 and sg_ == 0 else (100.0 if sl_ == 0 else 100 - 100 / (1 + sg_ / sl_))
        af, as_, ag = 2 / (fast + 1), 2 / (slow + 1), 2 / (signal + 1)
        ef = v if ef is None else (1 - af) * ef + af * v
        es = v if es is None else (1 - as_) * es + as_ * v
        sg = (ef - es) if sg is None else (1 - ag) * sg + ag * (ef - es)
        out.append((r, ef - es, sg))
    return out


def test_random_series_against_brute_force(spark):
    import random
    rnd = random.Random(7)
    series = {}
    for k in range(40):
        n = rnd.choice([1, 2, 13, 14, 15, 30, 61])
        base = [round(rnd.uniform(1, 50), 2) for _ in range(n)]
        if k % 5 == 0:
            base = [5.0] * n                                   # flat: RSI NULL
        series[f"s{k}"] = base
    t0 = dt.datetime(2026, 1, 1)
    rows = [(k, t0 + dt.timedelta(minutes=i), i, v) for k, vs in series.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "ticker string, ts timestamp_ntz, seq long, close double")
    d = ind.with_position(df, "ticker", "ts", "seq", block_unit="hour")
    d = ind.rsi(ind.macd(d, "ticker", "close", chunk_rows=5), "ticker", "close", chunk_rows=17)
    got = {(r.ticker, r._pos): r for r in d.collect()}
    last = {r.ticker: r for r in ind.latest_indicators(df, "ticker", "ts", "close", "seq").collect()}
    for k, vs in series.items():
        want = _brute(vs)
        for i, (r, m, s) in enumerate(want):
            g = got[(k, i)]
            assert _close(g.rsi, r) and _close(g.macd, m) and _close(g.signal, s), (k, i)
        assert _close(last[k].rsi, want[-1][0]) and _close(last[k].signal, want[-1][2]), k


@pytest.mark.parametrize("chunk", [3, 10, None])
def test_ema_long_and_short_spans_against_recurrence(spark, chunk):
    """Carries reach every later chunk: long spans over many small chunks stay exact."""
    import random
    rnd = random.Random(7)
    xs = [50 + rnd.uniform(-20, 20) for _ in range(3000)]
    df = spark.createDataFrame([("A", i, x) for i, x in enumerate(xs)], "ticker string, _pos long, x double")
    spans = (1, 2, 1000, 5000)
    got = ind.ema(df, "ticker", {f"e{s}": ("x", s) for s in spans}, "_pos", chunk_rows=chunk).collect()
    rows = {r["_pos"]: r for r in got}
    assert len(rows) == len(xs)
    for s in spans:
        a, y = 2.0 / (s + 1), xs[0]
        for i, x in enumerate(xs):
            y = a * x + (1 - a) * y
            assert _close(rows[i][f"e{s}"], y, 1e-8), (s, i, rows[i][f"e{s}"], y)


def test_ema_of_span_one_alone(spark):
    df = spark.createDataFrame([("A", 0, 4.0), ("A", 1, 6.0)], "ticker string, _pos long, x double")
    assert sorted((r["_pos"], r.e) for r in ind.ema(df, "ticker", {"e": ("x", 1)}, "_pos").collect()) == [(0, 4.0), (1, 6.0)]


def _pandas_macd(values, fast=12, slow=26, signal=9):
    import pandas as pd
    x = pd.Series(values, dtype="float64")
    m = x.ewm(span=fast, adjust=False).mean() - x.ewm(span=slow, adjust=False).mean()
    return m, m.ewm(span=signal, adjust=False).mean()


@pytest.mark.parametrize("chunk", [None, 4, 25])
def test_missing_prices_equal_pandas(spark, chunk):
    """NULL and NaN prices: leading ones, long gaps over many chunks, trailing ones, none but NULL."""
    import random

    import pandas as pd
    rnd = random.Random(23)
    series = {"none": [None] * 30, "one": [None, None, 7.0, None], "first": [3.0] + [None] * 40,
              "gap": [5.0, 6.0] + [None] * 60 + [9.0, 4.0, None, 8.0], "all": [rnd.uniform(1, 9) for _ in range(90)],
              "nan": [float("nan"), 2.0, float("nan"), float("nan"), 5.0, 1.0, None, 3.0]}
    for k in range(25):
        share = rnd.choice([0.05, 0.5, 0.95])
        series[f"r{k}"] = [None if rnd.random() < share else round(rnd.uniform(-50, 50), 2) for _ in range(rnd.choice([3, 40, 120]))]
    df = spark.createDataFrame([(k, i, v) for k, vs in series.items() for i, v in enumerate(vs)], "k string, _pos long, x double")
    got = {(r.k, r["_pos"]): r for r in ind.macd(df, "k", "x", chunk_rows=chunk).collect()}
    spans = {(r.k, r["_pos"]): r for r in ind.ema(df.withColumn("y", F.col("x") * 2), "k", {"a": ("x", 3), "b": ("y", 40), "c": ("x", 1)},
                                                  chunk_rows=chunk).collect()}
    assert len(got) == len(spans) == df.count()
    for k, vs in series.items():
        x = pd.Series(vs, dtype="float64")
        m, s = _pandas_macd(vs)
        a, b, c = (x * f for f in (1, 2, 1))
        a, b, c = (v.ewm(span=n, adjust=False).mean() for v, n in ((a, 3), (b, 40), (c, 1)))
        for i in range(len(vs)):
            r, e = got[(k, i)], spans[(k, i)]
            for have, want in ((r.macd, m[i]), (r.signal, s[i]), (r.histogram, m[i] - s[i]), (e.a, a[i]), (e.b, b[i]), (e.c, c[i])):
                want = None if want != want else float(want)
                assert (have is None) == (want is None) and (want is None or abs(have - want) <= 1e-9 * max(1.0, abs(want))), (k, i, have, want)


def test_macd_plan_has_one_checkpoint(spark, monkeypatch):
    from marketsig.operators import series
    calls = []
    monkeypatch.setattr(ind, "materialize", lambda d: calls.append(1) or series.materialize(d))
    df = spark.createDataFrame([("a", i, float(i % 7)) for i in range(50)], "k string, _pos long, x double")
    assert ind.macd(df, "k", "x", chunk_rows=6).count() == 50 and len(calls) == 1
