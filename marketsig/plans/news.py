"""The news plan -- fallback, insert-ignore by URL, score only new rows,
recency-weighted score and alert per ticker -- as one lazy DataFrame plan."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketsig.functions.scalar import seen_at
from marketsig.operators import keys, sentiment
from marketsig.operators.series import materialize


def ingest(primary: DataFrame, secondary: DataFrame, existing: DataFrame,
           score: Callable[[DataFrame], DataFrame], key: str = "ticker",
           order: Sequence[str] = ("created_at", "pos")) -> tuple[DataFrame, DataFrame]:
    """Returns ``(fetched, inserted)`` -- the tickers
    whose fetch was non-empty and the new rows, scored, in ``existing``'s
    columns (M14, M15)."""
    # The incoming batch is read three times below (fetched tickers, the
    # insert-ignore, the scorer): materialize it once.
    feed = materialize(keys.fallback(primary, secondary, key))
    fetched = feed.select(key).distinct()  # an article without a URL is not stored, but was fetched
    fresh = keys.insert_ignore(feed.filter(F.coalesce(F.col("url"), F.lit("")) != ""), existing, "url", list(order))
    return fetched, score(fresh).select(*existing.columns)


def signals_from(stored: DataFrame, fetched: DataFrame, as_of, universe: DataFrame, key: str = "ticker",
                 lookback_minutes: int = sentiment.LOOKBACK_MINUTES,
                 recent_minutes: int = sentiment.RECENT_MINUTES) -> DataFrame:
    """F5/A6-A8 over the stored rows of the fetched tickers; a ticker whose
    fetch was empty gets score 0 and count 0 without reading stored news
    (M16)."""
    recent = (stored.join(fetched, key, "left_semi")
              .withColumn("_seen", seen_at("created_at", "published_at")))
    alerts = sentiment.weighted_scores(recent, as_of, key, "_seen", "sentiment_score",
                                       lookback_minutes, recent_minutes)
    return (universe.select(key).join(alerts, key, "left")
            .na.fill({"raw_score": 0.0, "score": 0.0, "alert": False, "articles_count": 0,
                      "direction": "neutral"}))


def news_signals(primary: DataFrame, secondary: DataFrame, existing: DataFrame,
                 score: Callable[[DataFrame], DataFrame], as_of, universe: DataFrame,
                 key: str = "ticker", order: Sequence[str] = ("created_at", "pos"),
                 lookback_minutes: int = sentiment.LOOKBACK_MINUTES,
                 recent_minutes: int = sentiment.RECENT_MINUTES) -> tuple[DataFrame, DataFrame]:
    """P1 in one plan; returns ``(signals, inserted)``.

    ``existing`` and the feeds carry ``key, url, headline, created_at,
    published_at`` (+ ``sentiment_score`` on ``existing``).  See ``ingest``
    and ``signals_from`` for the steps.
    """
    fetched, inserted = ingest(primary, secondary, existing, score, key, order)
    stored = existing.unionByName(inserted)
    signals = signals_from(stored, fetched, as_of, universe, key, lookback_minutes, recent_minutes)
    return signals, inserted
