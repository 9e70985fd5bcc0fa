"""The summary and detail tables as DataFrames of formatted strings
(terminal colours, emoji and panels are not built)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketsig.functions.scalar import fixed, signed_fixed
from marketsig.functions.template import render

# Sentiment cell texts of the summary table.
SENTIMENT_CELL = {"positive": "+ Positive", "negative": "- Negative", "neutral": "~ Neutral"}
SUMMARY_COLUMNS = ["ticker", "price", "change", "news_score", "sentiment", "rsi", "decision", "confidence"]


def _nan(c):
    return F.coalesce(c, F.lit("nan"))


def summary_table(signals: DataFrame, key: str = "ticker") -> DataFrame:
    """P5: eight text cells per ticker; an error row shows ERROR then dashes."""
    err = F.col("error").isNotNull()
    sent = F.coalesce(*[F.when(F.col("avg_sentiment") == k, F.lit(v)) for k, v in SENTIMENT_CELL.items()],
                      F.lit("neutral"))
    cells = {
        "price": F.concat(F.lit("$"), _nan(fixed("current_price", 2))),
        "change": F.concat(F.lit("$"), _nan(fixed("change", 2)), F.lit(" ("),
                           _nan(signed_fixed("percent_change", 2)), F.lit("%)")),
        "news_score": F.when(F.col("news_alert") | (F.col("news_score") != 0), signed_fixed("news_score", 3))
        .otherwise(F.lit("-")),
        "sentiment": sent,
        "rsi": _nan(fixed("rsi", 1)),
        "decision": F.coalesce(F.col("decision"), F.lit("HOLD")),
        "confidence": F.coalesce(F.col("confidence"), F.lit("LOW")),
    }
    out = [F.col(key).alias("ticker")]
    for name in SUMMARY_COLUMNS[1:]:
        dash = F.lit("ERROR") if name == "price" else F.lit("-")
        out.append(F.when(err, dash).otherwise(cells[name]).alias(name))
    return signals.select(*out, F.col("news_alert").alias("alert"))


DETAIL = """Decision: {decision}
Confidence: {confidence}
Reasoning: {reasoning}
{news_line}
Sentiment Analysis:
  Overall: {avg_sentiment} (Score: {avg_score:.3f})
  Positive: {positive_ratio:.1%} | Negative: {negative_ratio:.1%}

Technical Indicators:
  RSI: {rsi:.2f}
  MACD: {macd:.4f}

Analysis:
{analysis}
"""


def detail_rows(signals: DataFrame, key: str = "ticker") -> DataFrame:
    """One detail text per ticker, or ``Error: ...`` for an error row."""
    # a ticker without news has no news line
    news_line = F.coalesce(F.concat(F.lit("\nNews: score="), signed_fixed("news_score", 3), F.lit(" ("),
                         F.upper("news_direction"), F.lit("), "), F.col("news_count").cast("string"),
                         F.lit(" articles"), F.when(F.col("news_alert"), F.lit(" ALERT")).otherwise(F.lit(""))), F.lit(""))
    from marketsig.plans.prompts import ANALYSIS
    reading = {"rsi", "rsi_zone", "macd", "signal", "macd_trend", "momentum", "outlook"}
    analysis = (F.coalesce(render(ANALYSIS), F.lit("N/A")) if reading <= set(signals.columns)
                else F.lit("N/A"))
    body = render(DETAIL, {"news_line": news_line, "analysis": analysis})
    text = F.when(F.col("error").isNotNull(), F.concat(F.lit("Error: "), F.col("error"))).otherwise(body)
    return signals.select(F.col(key).alias("ticker"), text.alias("detail"))

