"""Technical indicators over every series at once: delta, rolling mean, RSI,
EMA, MACD, the per-series indicator table, its latest row and its reading.

Semantics follow the reference's pandas code:

* RSI is the *simple* rolling mean of gains and losses over ``period`` rows.
  The first row has no delta but counts as gain 0 / loss 0, so RSI is first
  defined on row ``period`` (1-based).  Loss 0 and gain > 0 gives 100, both 0
  gives NULL (pandas NaN), gain 0 gives 0.
* EMA is ``adjust=False``: y0 = x0, yt = (1-a) y(t-1) + a xt, a = 2/(span+1).

Both run without a per-series window over all rows (see ``series``).  EMA is
a linear recurrence, so it is evaluated as a blocked scan: inside each chunk
running sums give every value as a local part plus a weight of the value at the
chunk's first price, and the values that enter a chunk are a fold of the few
chunks before it that still have weight.  MACD carries its three values (fast,
slow, signal) through one such scan.  Gaps (NULL prices) are counted in rows:
the longer the gap, the less the old value weighs (pandas, ``ignore_na=False``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketsig.operators.series import (DEFAULT_CHUNK_ROWS, IDX, UNIT_SECONDS, _bucket, _names,
                                        index_series, index_series_adaptive, materialize, over_chunks)

# Largest exponent used inside a chunk: (1-a)^(-i) stays below e^600.
_MAX_EXP = 600.0
# A value weighed by less than e^-100 does not change a sum of doubles of like size.
_NO_WEIGHT = 100.0


def with_position(df: DataFrame, keys: str | Sequence[str], ts: str, tie: str | None = None,
                  block_unit: str | None = None, idx_col: str = IDX, size_col: str | None = None) -> DataFrame:
    """Position of each row in its series ordered by ``(ts, tie)``.

    Rows are ranked in parallel inside time blocks.  By default the blocks
    adapt to the data (days, split into hours and minutes where one series
    is dense); a fixed ``block_unit`` (e.g. ``'year'`` for daily bars) skips
    the sizing pass when the series are known to be sparse.
    """
    order = [F.col(ts)] + ([F.col(tie)] if tie else [])
    if block_unit is None:
        return index_series_adaptive(df, keys, ts, order, idx_col, size_col, tie=tie)
    block = (_bucket(df, ts, block_unit) if block_unit in UNIT_SECONDS
             else F.date_trunc(block_unit, F.col(ts)))
    return index_series(df, keys, order, block, idx_col, size_col)


def price_delta(df: DataFrame, keys, price: str, out: str = "delta",
                idx_col: str = IDX, chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Difference from the previous row of the series (NULL on the first)."""
    def compute(fr, w):
        return fr.withColumn(out, F.col(price) - F.lag(price, 1).over(w))
    return over_chunks(df, keys, 1, compute, idx_col, chunk_rows)


def rolling_mean(df: DataFrame, keys, x: str, n: int, out: str,
                 idx_col: str = IDX, chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Mean of the last ``n`` rows, NULL until ``n`` rows exist."""
    def compute(fr, w):
        mean = F.avg(x).over(w.rowsBetween(-(n - 1), 0))
        return fr.withColumn(out, F.when(F.col(idx_col) >= n - 1, mean))
    return over_chunks(df, keys, n - 1, compute, idx_col, chunk_rows)


def rsi(df: DataFrame, keys, price: str, period: int = 14, out: str = "rsi",
        idx_col: str = IDX, chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """RSI(period) on every row (W1 delta, W2 gain/loss split, W3 means).

    The ratio of the two means equals the ratio of the two sums, so sums are
    used; ``try_divide`` keeps ANSI mode from raising on a zero loss.
    """
    def compute(fr, w):
        fr = fr.withColumn("_d", F.coalesce(F.col(price) - F.lag(price, 1).over(w), F.lit(0.0)))
        frame = w.rowsBetween(-(period - 1), 0)
        gain = F.sum(F.greatest(F.col("_d"), F.lit(0.0))).over(frame)
        loss = F.sum(F.greatest(-F.col("_d"), F.lit(0.0))).over(frame)
        fr = fr.withColumn("_g", gain).withColumn("_l", loss)
        val = (F.when(F.col(idx_col) < period - 1, F.lit(None))
               .when(F.col("_l") == 0, F.when(F.col("_g") == 0, F.lit(None)).otherwise(F.lit(100.0)))
               .otherwise(100.0 - F.try_divide(F.lit(100.0), 1.0 + F.try_divide(F.col("_g"), F.col("_l")))))
        return fr.withColumn(out, val.cast("double")).drop("_d", "_g", "_l")
    return over_chunks(df, keys, period, compute, idx_col, chunk_rows)


def ema_chunk_rows(spans: Sequence[int], cap: int = DEFAULT_CHUNK_ROWS) -> int:
    """Largest chunk for which (1-a)^(-i) stays finite for every span."""
    if any(s < 1 for s in spans):
        raise ValueError("EMA spans must be at least 1")
    # a span of 1 needs no powers
    worst = max((-math.log1p(-2.0 / (s + 1)) for s in spans if s > 1), default=0.0)
    return max(1, min(cap, int(_MAX_EXP / worst))) if worst else cap


class _Ema:
    """One EMA of the scan: its input, its weights, and the columns of its running local part."""

    def __init__(self, out: str, x: str, span: int):
        self.out, self.x, self.a = out, x, 2.0 / (span + 1)
        self.log_q = math.log1p(-self.a) if span > 1 else None
        self.local, self.weight = f"_l_{out}", f"_w_{out}"

    def keep(self, d: Column) -> Column:
        """What the value before weighs in a value ``d`` rows later, q^d / (q^d + a)."""
        if self.log_q is None:
            return F.lit(0.0)
        p = F.exp(F.lit(self.log_q) * d)
        return F.when(d == 1, F.lit(1.0 - self.a)).otherwise(p / (p + F.lit(self.a)))

    def log_keep(self, d: Column) -> Column:
        return F.lit(self.log_q) * d - F.log(F.exp(F.lit(self.log_q) * d) + F.lit(self.a))

    def decay(self) -> float:
        """A bound of the decay of ``keep`` for each row passed, whatever the gaps between prices."""
        u, least = -self.log_q, 1.0
        while u < 700.0:
            least = min(least, math.log1p(self.a * math.exp(u)) / u)
            u *= 1.05
        return -self.log_q * least * 0.9


class _Signal:
    """An EMA of the difference of two EMAs of one input; it has a value at every row that they have."""

    def __init__(self, out: str, fast: _Ema, slow: _Ema, span: int):
        self.out, self.fast, self.slow, self.a = out, fast, slow, 2.0 / (span + 1)
        self.log_q = math.log1p(-self.a)
        self.local, self.by_fast, self.by_slow = f"_l_{out}", f"_wf_{out}", f"_ws_{out}"


def _enter(emas: list[_Ema], signals: list[_Signal], state, known: Column, x1: Column, d: Column) -> dict[str, Column]:
    """Every value at a chunk's first price ``x1``, ``d`` rows after the price that ``state`` belongs to."""
    now = {e.out: F.when(known, state(e.out) * e.keep(d) + (F.lit(1.0) - e.keep(d)) * x1).otherwise(x1) for e in emas}
    for s in signals:
        held = F.exp(F.lit(s.log_q) * (d - 1))  # the rows between repeat the difference
        before = held * state(s.out) + (F.lit(1.0) - held) * (state(s.fast.out) - state(s.slow.out))
        new = F.lit(1.0 - s.a) * before + F.lit(s.a) * (now[s.fast.out] - now[s.slow.out])
        now[s.out] = F.when(known, new).otherwise(F.lit(0.0))
    return now


def _leave(emas: list[_Ema], signals: list[_Signal], local, now: dict[str, Column], rows: Column) -> dict[str, Column]:
    """Every value ``rows`` rows after the chunk's first price, from the local parts up to there."""
    then = {e.out: local(e.local) + local(e.weight) * now[e.out] for e in emas}
    for s in signals:
        then[s.out] = (F.exp(F.lit(s.log_q) * rows) * now[s.out] + local(s.local)
                       + local(s.by_fast) * now[s.fast.out] - local(s.by_slow) * now[s.slow.out])
    return then


def _locals(d: DataFrame, w: Window, pos: Column, x: str, emas: list[_Ema], signals: list[_Signal]) -> DataFrame:
    """The running parts of a chunk that do not depend on the chunks before.

    From the chunk's first price on, an EMA is ``local + weight * (its value there)``: each further price
    multiplies the weight by ``keep``.  A signal is such a running sum over the local parts of its EMAs.
    """
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    price = F.when(~F.isnan(F.col(x).cast("double")), F.col(x).cast("double"))
    d = d.withColumn(f"_x_{x}", price)
    at = F.when(F.col(f"_x_{x}").isNotNull(), pos)
    d = (d.withColumn(f"_at_{x}", F.min(at).over(run)).withColumn(f"_to_{x}", F.max(at).over(run))
         .withColumn(f"_x1_{x}", F.first(f"_x_{x}", ignorenulls=True).over(run))
         .withColumn("_gap", at - F.max(at).over(w.rowsBetween(Window.unboundedPreceding, -1))))
    gap, value = F.col("_gap"), F.col(f"_x_{x}")
    none = F.lit(0.0)
    for e in emas:
        if e.log_q is None:
            later = F.col(f"_to_{x}") > F.col(f"_at_{x}")
            d = (d.withColumn(e.local, F.when(later, F.last(f"_x_{x}", ignorenulls=True).over(run)).otherwise(none))
                 .withColumn(e.weight, F.when(later, none).otherwise(F.lit(1.0))))
            continue
        steps = F.sum(F.when(gap == 1, F.lit(1.0)).otherwise(none)).over(run)
        jumps = F.sum(F.when(gap > 1, e.log_keep(gap)).otherwise(none)).over(run)
        d = d.withColumn("_log", F.lit(e.log_q) * steps + jumps)
        share = F.when(gap == 1, F.lit(e.a)).otherwise(F.lit(1.0) - e.keep(gap))
        d = (d.withColumn(e.weight, F.exp("_log"))
             .withColumn(e.local, F.exp("_log") * F.sum(F.when(gap.isNotNull(), share * value * F.exp(-F.col("_log")))
                                                        .otherwise(none)).over(run)).drop("_log"))
    for s in signals:
        rows = (pos - F.col(f"_at_{x}")).cast("double")

        def summed(part: Column) -> Column:
            grown = F.when(rows > 0, part * F.exp(F.lit(-s.log_q) * rows)).otherwise(none)
            return F.when(rows >= 0, F.lit(s.a) * F.exp(F.lit(s.log_q) * rows) * F.sum(grown).over(run)).otherwise(none)

        d = (d.withColumn(s.local, summed(F.col(s.fast.local) - F.col(s.slow.local)))
             .withColumn(s.by_fast, summed(F.col(s.fast.weight))).withColumn(s.by_slow, summed(F.col(s.slow.weight))))
    return d.drop("_gap")


def _carries(d: DataFrame, keys: list[str], x: str, emas: list[_Ema], signals: list[_Signal], C: int) -> DataFrame:
    """(keys, chunk, state): the values at the last price before each chunk, one row a chunk.

    A chunk with a price maps the state before it to the one behind it; the state is the fold of the last
    ``n`` such maps, beyond which nothing before has weight in a double.
    """
    names = [e.local for e in emas] + [e.weight for e in emas] + [c for s in signals for c in (s.local, s.by_fast, s.by_slow)]
    outs = [e.out for e in emas] + [s.out for s in signals]
    here = F.struct(F.col(f"_at_{x}").alias("at"), F.col(f"_to_{x}").alias("to"), F.col(f"_x1_{x}").alias("x1"), *names)
    ends = d.groupBy(*keys, "_ec").agg(F.max_by(here, F.when(F.col(f"_x_{x}").isNotNull(), F.col("_ei"))).alias("_end"))
    slowest = min([e.decay() for e in emas if e.log_q is not None] + [-s.log_q for s in signals], default=_MAX_EXP)
    n = math.ceil(_NO_WEIGHT / (slowest * C)) + 2
    chunks = Window.partitionBy(*keys).orderBy("_ec")
    found = ends.filter("_end is not null").withColumn("_gap", F.col("_end.at") - F.lag("_end.to").over(chunks))
    last = F.collect_list(F.struct("_end", F.coalesce("_gap", F.lit(0)).cast("double").alias("gap"))).over(chunks.rowsBetween(1 - n, 0))
    start = F.struct(F.lit(False).alias("known"), *[F.lit(0.0).alias(o) for o in outs])

    def behind(state: Column, chunk: Column) -> Column:
        end = chunk["_end"]
        now = _enter(emas, signals, lambda o: state[o], state["known"], end["x1"], chunk["gap"])
        then = _leave(emas, signals, lambda c: end[c], now, (end["to"] - end["at"]).cast("double"))
        return F.struct(F.lit(True).alias("known"), *[then[o].alias(o) for o in outs])

    states = found.select(*keys, "_ec", F.struct(F.col("_end.to").alias("to"), F.aggregate(last, start, behind).alias("v")).alias("_state"))
    before = chunks.rowsBetween(Window.unboundedPreceding, -1)
    return (ends.select(*keys, "_ec").join(states, [*keys, "_ec"], "left")
            .select(*keys, "_ec", F.last("_state", ignorenulls=True).over(before).alias(f"_s_{x}"))
            .filter(F.col(f"_s_{x}").isNotNull()))


def _scan(df: DataFrame, keys: list[str], emas: list[_Ema], signals: list[_Signal], idx_col: str, C: int) -> DataFrame:
    pos = F.col(idx_col)
    inputs = list(dict.fromkeys(e.x for e in emas))
    of = {x: ([e for e in emas if e.x == x], [s for s in signals if s.fast.x == x]) for x in inputs}
    d = df.withColumn("_ec", F.floor(pos / F.lit(C)).cast("long")).withColumn("_ei", pos % F.lit(C))
    w = Window.partitionBy(*keys, "_ec").orderBy("_ei")
    for x in inputs:
        d = _locals(d, w, pos, x, *of[x])
    d = materialize(d)  # feeds the chunk ends and the rows
    out = d
    for x in inputs:
        out = out.join(_carries(d, keys, x, *of[x], C), [*keys, "_ec"], "left")
    for x in inputs:
        state, at = F.col(f"_s_{x}"), F.col(f"_at_{x}")
        value = lambda o: state["v"][o]
        now = _enter(*of[x], value, state.isNotNull(), F.col(f"_x1_{x}"), (at - state["to"]).cast("double"))
        then = _leave(*of[x], F.col, now, (pos - at).cast("double"))
        own, signed = of[x]
        held = {e.out: value(e.out) for e in own}  # no price in the chunk so far
        for s in signed:
            left = F.exp(F.lit(s.log_q) * (pos - state["to"]).cast("double"))
            held[s.out] = left * value(s.out) + (F.lit(1.0) - left) * (held[s.fast.out] - held[s.slow.out])
        out = out.withColumns({o: F.when(at.isNull(), held[o]).otherwise(then[o]) for o in then})
    return out.select(*[c for c in df.columns if c not in {e.out for e in emas} | {s.out for s in signals}],
                      *[e.out for e in emas], *[s.out for s in signals])


def ema(df: DataFrame, keys, specs: dict[str, tuple[str, int]], idx_col: str = IDX,
        chunk_rows: int | None = None) -> DataFrame:
    """Add one EMA column per ``specs[out] = (x_column, span)``.

    ``df`` must carry the series position ``idx_col`` (``with_position``).  A NULL (or NaN) input repeats
    the value before it and weakens it for the next one, as pandas does: after ``d`` rows the old value
    weighs q^d against the new one's a.  Rows before the first input are NULL.  The frame is checkpointed
    once.  A span of 1 is the newest input.
    """
    keys = _names(keys)
    C = chunk_rows or ema_chunk_rows([s for _, s in specs.values()])
    return _scan(df, keys, [_Ema(out, x, span) for out, (x, span) in specs.items()], [], idx_col, C)


def macd(df: DataFrame, keys, price: str, fast: int = 12, slow: int = 26, signal: int = 9,
         idx_col: str = IDX, chunk_rows: int | None = None) -> DataFrame:
    """``macd`` = EMA(fast) - EMA(slow), ``signal`` = EMA(signal) of it, ``histogram`` = macd - signal.

    One scan with three values carried from chunk to chunk, and one checkpoint.  NULL prices repeat
    ``macd``, and the signal goes on towards it; rows before the first price are NULL.
    """
    keys = _names(keys)
    C = chunk_rows or ema_chunk_rows([fast, slow, signal])
    f, s = _Ema("_ema_fast", price, fast), _Ema("_ema_slow", price, slow)
    d = _scan(df, keys, [f, s], [_Signal("signal", f, s, signal)] if signal > 1 else [], idx_col, C)
    d = d.withColumn("macd", F.col(f.out) - F.col(s.out)).drop(f.out, s.out)
    if signal == 1:
        d = d.withColumn("signal", F.col("macd"))
    d = d.withColumn("histogram", F.col("macd") - F.col("signal"))
    return d.select(*[c for c in d.columns if c not in ("macd", "signal", "histogram")], "macd", "signal", "histogram")


def indicator_table(df: DataFrame, keys, ts: str, price: str, tie: str | None = None,
                    period: int = 14, fast: int = 12, slow: int = 26, signal: int = 9,
                    block_unit: str | None = None) -> DataFrame:
    """Every row of every series with rsi, macd, signal and histogram,
    plus its position ``_pos`` in the series."""
    d = with_position(df, keys, ts, tie, block_unit)
    d = macd(d, keys, price, fast, slow, signal)
    return rsi(d, keys, price, period)


def latest(df: DataFrame, keys, order: str = IDX) -> DataFrame:
    """The last row of each series, as a partial (map-side) aggregate."""
    keys = _names(keys)
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_last"))
            .select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest]))


# The interpretation thresholds the reference asks its model to
# apply -- RSI above 70 is overbought, below 30 oversold; MACD above its
# signal is bullish, below is bearish; a positive histogram means rising
# momentum.
RSI_OVERBOUGHT = 70.0
RSI_OVERSOLD = 30.0


def interpret(df: DataFrame, rsi_col: str = "rsi") -> DataFrame:
    """Rule-based reading of the indicators (the model call is not built)."""
    r, m, s, h = F.col(rsi_col), F.col("macd"), F.col("signal"), F.col("histogram")
    zone = (F.when(r > RSI_OVERBOUGHT, "overbought").when(r < RSI_OVERSOLD, "oversold")
            .when(r.isNotNull(), "neutral"))
    trend = F.when(m > s, "bullish").when(m < s, "bearish").otherwise("neutral")
    momentum = F.when(h > 0, "increasing").when(h < 0, "decreasing").otherwise("flat")
    votes = (F.when(m > s, 1).when(m < s, -1).otherwise(0)
             + F.when(r < RSI_OVERSOLD, 1).when(r > RSI_OVERBOUGHT, -1).otherwise(0))
    outlook = F.when(votes > 0, "bullish").when(votes < 0, "bearish").otherwise("neutral")
    return (df.withColumn("rsi_zone", zone).withColumn("macd_trend", trend)
            .withColumn("momentum", momentum).withColumn("outlook", outlook))


def rounded(c: str | Column, digits: int) -> Column:
    """Python-style rounding (exact binary value, half-to-even)."""
    from marketsig.functions.scalar import py_round
    return py_round(c, digits)


def _geo(s: float, p: float, m: Column) -> Column:
    """sum_{u=0..m} s^(m-u) p^u as a column of m (closed form)."""
    if abs(s - p) < 1e-12:
        return (m + 1.0) * F.pow(F.lit(s), m)
    return (F.pow(F.lit(s), m + 1.0) - F.pow(F.lit(p), m + 1.0)) / F.lit(s - p)


def latest_indicators(df: DataFrame, keys, ts: str, price: str, tie: str | None = None,
                      period: int = 14, fast: int = 12, slow: int = 26, signal: int = 9,
                      block_unit: str | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """W7 + W8 at the last row only: rsi, macd, signal, histogram of each
    series' newest row (plus ``carry`` columns of that row), without
    computing them for every row.

    The last value of a linear recurrence is a weighted sum of the inputs
    whose weights depend only on m, the number of rows after the input:

    * EMA(a, q=1-a): weight q^m for the first row, a q^m otherwise;
    * signal = EMA(g, s=1-g) of (EMA_fast - EMA_slow), macd_0 = 0: for a
      row i >= 1 the weight is g [a_f G(s, q_f, m) - a_s G(s, q_s, m)], for
      the first row g [q_f G(s, q_f, m-1) - q_s G(s, q_s, m-1)], where
      G(s, p, m) = sum_{u<=m} s^(m-u) p^u.

    So MACD is one partial aggregate per series (skew-safe); RSI comes from
    the last ``period`` + 1 values, collected (bounded) by the same aggregate.
    """
    keys = _names(keys)
    cols = [price] + list(carry)
    d = with_position(df.select(*keys, ts, *([tie] if tie else []), *[c for c in cols if c != ts]),
                      keys, ts, tie, block_unit, size_col="_len")
    m = (F.col("_len") - 1 - F.col(IDX)).cast("double")
    first = F.col(IDX) == 0
    af, asl, ag = 2.0 / (fast + 1), 2.0 / (slow + 1), 2.0 / (signal + 1)
    qf, qs, qg = 1 - af, 1 - asl, 1 - ag
    x = F.col(price)
    w_fast = F.when(first, F.pow(F.lit(qf), m)).otherwise(af * F.pow(F.lit(qf), m))
    w_slow = F.when(first, F.pow(F.lit(qs), m)).otherwise(asl * F.pow(F.lit(qs), m))
    w_sig = F.when(first, ag * (qf * _geo(qg, qf, m - 1.0) - qs * _geo(qg, qs, m - 1.0)))\
        .otherwise(ag * (af * _geo(qg, qf, m) - asl * _geo(qg, qs, m)))
    # RSI of the last row needs only the last `period` + 1 values: a list of
    # at most that many items per series, kept by the same partial aggregate.
    tail = F.collect_list(F.when(m <= period, F.struct(F.col(IDX).alias("i"), x.alias("v"))))
    agg = d.groupBy(*keys).agg(
        F.sum(x * (w_fast - w_slow)).alias("macd"), F.sum(x * w_sig).alias("signal"),
        F.max("_len").alias("_len"), F.array_sort(tail).alias("_tail"),
        F.max_by(F.struct(*[F.col(c) for c in dict.fromkeys([ts, *cols])]), F.col(IDX)).alias("_last"))
    v = F.transform("_tail", lambda e: e["v"])
    n = F.size("_tail")
    deltas = F.zip_with(F.slice(v, 2, n), F.slice(v, 1, n - 1), lambda a, b: a - b)
    gain = F.aggregate(deltas, F.lit(0.0), lambda acc, dd: acc + F.greatest(dd, F.lit(0.0)))
    loss = F.aggregate(deltas, F.lit(0.0), lambda acc, dd: acc + F.greatest(-dd, F.lit(0.0)))
    rsi_val = (F.when(F.col("_len") < period, F.lit(None))
               .when(loss == 0, F.when(gain == 0, F.lit(None)).otherwise(F.lit(100.0)))
               .otherwise(100.0 - F.try_divide(F.lit(100.0), 1.0 + F.try_divide(gain, loss))))
    return agg.select(*keys, "macd", "signal", (F.col("macd") - F.col("signal")).alias("histogram"),
                      rsi_val.cast("double").alias("rsi"),
                      *[F.col(f"_last.{c}").alias(c) for c in dict.fromkeys([ts, *cols])])
