"""Table schemas (K1) and their constraints.

Fixed values: the four stored tables with the column types, NOT NULL columns,
VARCHAR lengths, DECIMAL precisions and the allowed trade actions of the
reference's DDL.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass(frozen=True)
class TableSpec:
    name: str
    schema: T.StructType
    key: tuple[str, ...] = ()
    not_null: tuple[str, ...] = ()
    max_len: dict = field(default_factory=dict)
    decimals: dict = field(default_factory=dict)
    allowed: dict = field(default_factory=dict)
    partition_by: tuple[str, ...] = ("dt",)


def _f(name, typ, nullable=True):
    return T.StructField(name, typ, nullable)


S, D, L, TS, B = T.StringType(), T.DoubleType(), T.LongType(), T.TimestampType(), T.BooleanType()

MARKET_QUOTES = TableSpec(
    "market_quotes",
    T.StructType([_f("id", L, False), _f("ticker", S, False),
                  *[_f(c, D) for c in ("current_price", "change", "percent_change", "high", "low",
                                       "open", "previous_close")],
                  _f("timestamp", TS, False)]),
    key=("ticker", "timestamp"),
    not_null=("id", "ticker", "timestamp"),
    max_len={"ticker": 10},
    decimals={"current_price": (12, 4), "change": (12, 4), "percent_change": (8, 4), "high": (12, 4),
              "low": (12, 4), "open": (12, 4), "previous_close": (12, 4)},
)

SENTIMENT_SCORES = TableSpec(
    "sentiment_scores",
    T.StructType([_f("id", L, False), _f("ticker", S, False), _f("headline", S, False),
                  _f("sentiment", S, False), _f("score", D, False), _f("timestamp", TS, False)]),
    key=("id",),
    not_null=("id", "ticker", "headline", "sentiment", "score", "timestamp"),
    max_len={"ticker": 10, "sentiment": 20},
    decimals={"score": (6, 4)},
)

TRADE_LEDGER = TableSpec(
    "trade_ledger",
    T.StructType([_f("id", L, False), _f("ticker", S, False), _f("action", S, False), _f("price", D),
                  _f("quantity", T.IntegerType()), _f("reasoning", S), _f("sentiment_avg", D),
                  _f("rsi", D), _f("macd", D), _f("approved", B, False),
                  _f("portfolio_manager_reasoning", S), _f("timestamp", TS, False)]),
    key=("id",),
    not_null=("id", "ticker", "action", "approved", "timestamp"),
    max_len={"ticker": 10},
    decimals={"price": (12, 4), "sentiment_avg": (6, 4), "rsi": (6, 2), "macd": (12, 4)},
    allowed={"action": ("BUY", "SELL", "HOLD")},
)

NEWS_STAGING = TableSpec(
    "news_staging",
    T.StructType([_f("id", S, False), _f("ticker", S, False), _f("source", S, False),
                  _f("headline", S, False), _f("url", S, False), _f("published_at", TS),
                  _f("sentiment_score", D), _f("created_at", TS, False)]),
    key=("url",),
    not_null=("id", "ticker", "source", "headline", "url", "created_at"),
    max_len={"ticker": 10, "source": 50},
)

TABLES = {t.name: t for t in (MARKET_QUOTES, SENTIMENT_SCORES, TRADE_LEDGER, NEWS_STAGING)}
