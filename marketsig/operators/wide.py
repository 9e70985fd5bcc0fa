"""Single-pass assembly input: everything a ticker's state needs, as one aggregate per ticker.

Landed rows of all kinds (quotes, price bars, scored headlines) are placed in their series once,
newest last, and one conditional aggregate per ticker then yields

* the newest quote's columns (``max_by``),
* the recency-weighted news sums and counts (A6),
* the class counts of the newest ``headlines`` scored rows (A1-A5): a row's place from the end says
  whether it is one of them, so nothing is collected,
* RSI, MACD and signal at the newest bar (W8): the closed-form weights depend only on a bar's place
  from the end; the series' first bar weighs differently, and its share is put right afterwards,
* presence flags for the error gate (F7).

All of these are partial aggregates; the only list holds ``period`` + 1 bars.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketsig.functions.scalar import time_literal
from marketsig.operators import sentiment
from marketsig.operators.indicators import _geo, with_position
from marketsig.operators.series import IDX

# The kinds of landed rows.
QUOTE, BAR, NEWS = "quote", "bar", "news"


def wide_state(rows: DataFrame, as_of, key: str = "ticker", ts: str = "ts", tie: str | None = None,
               price: str = "price", score: str = "score", carry: Sequence[str] = (), kind: str | None = None,
               label: Callable[[Column], Column] | None = None, months: int = 1, headlines: int = 10,
               lookback_minutes: int = sentiment.LOOKBACK_MINUTES, recent_minutes: int = sentiment.RECENT_MINUTES,
               period: int = 14, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """One row per ``key`` of ``rows``.

    ``rows`` has ``key``, ``ts``, ``tie`` (a unique tie-breaker), ``price`` and ``score``.  With ``kind``
    a row is what that column says; without, every row is a quote, a bar and a scored headline at once.
    ``label`` turns a score into positive / negative / neutral for the count path (default: the
    thresholds of A4).  Output: ``key``, ``has_quote`` and the ``carry`` columns of the newest quote,
    ``bars`` (bars in the look-back), rsi / macd / signal / histogram, ``raw_score`` / score / alert /
    direction / articles_count, and the count path's columns of the newest headlines.
    """
    label = label or sentiment.sentiment_label
    a = time_literal(as_of, dict(rows.dtypes).get(ts, "timestamp_ntz"))
    wanted = dict.fromkeys([key, *([kind] if kind else []), ts, *([tie] if tie else []), price, score, *carry])
    d = with_position(rows.select(*wanted), [key, kind] if kind else key, ts, tie, size_col="_len")
    is_kind = (lambda k: F.col(kind) == k) if kind else (lambda k: F.lit(True))
    left = F.col("_len") - 1 - F.col(IDX)  # rows after this one
    m = left.cast("double")

    bar = is_kind(BAR) & (F.col(ts) >= a - F.make_ym_interval(F.lit(0), F.lit(months)))
    af, asl, ag = 2.0 / (fast + 1), 2.0 / (slow + 1), 2.0 / (signal + 1)
    qf, qs, qg = 1 - af, 1 - asl, 1 - ag

    def weights(n: Column) -> tuple[Column, Column]:
        return (af * F.pow(F.lit(qf), n) - asl * F.pow(F.lit(qs), n),
                ag * (af * _geo(qg, qf, n) - asl * _geo(qg, qs, n)))

    x = F.col(price).cast("double")
    w_macd, w_signal = weights(m)
    first = F.min_by(F.struct(x.alias("x"), m.alias("m")), F.when(bar, F.col(IDX)))
    tail = F.collect_list(F.when(bar & (left <= period), F.struct(F.col(IDX).alias("i"), x.alias("v"))))

    s = F.col(score)
    news = is_kind(NEWS) & s.isNotNull()
    seen = news & (F.col(ts) >= a - sentiment._minutes(lookback_minutes))
    weight = F.when(F.col(ts) >= a - sentiment._minutes(recent_minutes), 2.0).otherwise(1.0)
    head = news & (left < headlines)
    said = label(s)

    agg = d.groupBy(key).agg(
        F.max(F.when(is_kind(QUOTE), True)).alias("_q"),
        F.max_by(F.struct(F.lit(0).alias("_"), *carry), F.when(is_kind(QUOTE), F.col(IDX))).alias("_quote"),
        F.count_if(bar).alias("bars"),
        F.sum(F.when(bar, x * w_macd)).alias("_macd"), F.sum(F.when(bar, x * w_signal)).alias("_signal"),
        first.alias("_first"), F.array_sort(tail).alias("_tail"),
        sentiment.exact_sum(F.when(seen, s * weight)).alias("_sw"), F.sum(F.when(seen, weight)).alias("_tw"),
        F.count_if(seen).alias("articles_count"),
        *[F.count_if(head & (said == c)).alias(f"{c}_count") for c in ("positive", "negative", "neutral")],
        F.count_if(head).alias("total_headlines"))

    # the first bar is the series' start value, not a step of the recurrence
    fx, fm = F.col("_first.x"), F.col("_first.m")
    f_macd, f_signal = weights(fm)
    macd = F.col("_macd") + fx * (F.pow(F.lit(qf), fm) - F.pow(F.lit(qs), fm) - f_macd)
    sig = F.col("_signal") + fx * (ag * (qf * _geo(qg, qf, fm - 1.0) - qs * _geo(qg, qs, fm - 1.0)) - f_signal)
    v = F.transform("_tail", lambda e: e["v"])
    n = F.size("_tail")
    steps = F.when(n > 1, F.zip_with(F.slice(v, F.lit(2), n - 1), F.slice(v, F.lit(1), n - 1), lambda p, q: p - q)).otherwise(
        F.array().cast("array<double>"))
    gain = F.aggregate(steps, F.lit(0.0), lambda acc, e: acc + F.greatest(e, F.lit(0.0)))
    loss = F.aggregate(steps, F.lit(0.0), lambda acc, e: acc + F.greatest(-e, F.lit(0.0)))
    rsi = (F.when(F.col("bars") < period, F.lit(None))
           .when(loss == 0, F.when(gain == 0, F.lit(None)).otherwise(F.lit(100.0)))
           .otherwise(100.0 - F.try_divide(F.lit(100.0), 1.0 + F.try_divide(gain, loss))))
    out = agg.select(
        key, F.coalesce("_q", F.lit(False)).alias("has_quote"), *[F.col(f"_quote.{c}").alias(c) for c in carry], "bars",
        rsi.cast("double").alias("rsi"), macd.alias("macd"), sig.alias("signal"),
        F.coalesce(F.try_divide("_sw", "_tw"), F.lit(0.0)).alias("raw_score"), "articles_count",
        "positive_count", "negative_count", "neutral_count", "total_headlines")
    return sentiment.alert_columns(out.withColumn("histogram", F.col("macd") - F.col("signal")))
