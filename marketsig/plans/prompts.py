"""Prompt tables for offline inference, built from the assembled
signals.  The model calls themselves are not built."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketsig.functions.scalar import fixed, ymd
from marketsig.functions.template import render

# The reference's prompt texts, with its format specs.
TECHNICAL_PROMPT = """You are a technical analysis specialist. Analyze the following market data and technical indicators for {ticker}:

Market Data:
- Current Price: ${current_price:.2f}
- Change: ${change:.2f} ({percent_change:.2f}%)
- High: ${high:.2f}
- Low: ${low:.2f}
- Previous Close: ${previous_close:.2f}

Technical Indicators:
- RSI (14): {rsi:.2f}
- MACD: {macd:.4f}
- MACD Signal: {signal:.4f}
- MACD Histogram: {histogram:.4f}

Provide a concise technical analysis (2-3 sentences) focusing on:
1. RSI interpretation (overbought >70, oversold <30)
2. MACD trend and momentum
3. Overall technical signal (bullish/bearish/neutral)"""

NEWS_ALERT_BLOCK = """

SENTINEL NEWS ALERT (last 1 hour, time-weighted):
- Aggregate News Score: {news_score:.3f} ({news_dir})
- Articles Analyzed: {news_count}
- ALERT: Strong {news_dir} signal detected from recent news
"""

DECISION_PROMPT = """You are a Portfolio Manager making critical trading decisions. Use your reasoning capabilities to validate this trade signal.

TICKER: {ticker}

SENTIMENT ANALYSIS:
- Overall Sentiment: {avg_sentiment}
- Sentiment Score: {avg_score:.2f} (-1 to 1 scale)
- Positive: {positive_ratio:.1%}
- Negative: {negative_ratio:.1%}
- Neutral: {neutral_ratio:.1%}
- Headlines Analyzed: {total_headlines}

TECHNICAL ANALYSIS:
- RSI: {rsi:.2f}
- MACD: {macd:.4f}
- MACD Signal: {signal:.4f}
- MACD Histogram: {histogram:.4f}
- Specialist Analysis: {analysis}

MARKET DATA:
- Current Price: ${current_price:.2f}
- Change: ${change:.2f} ({percent_change:.2f}%)
- High: ${high:.2f}
- Low: ${low:.2f}
- Previous Close: ${previous_close:.2f}
{history_context}{news_context}
INSTRUCTIONS:
1. Use <think> tags to show your Chain of Thought reasoning
2. In your <think> block, analyze:
   - Alignment between sentiment and technical signals
   - Risk factors and potential conflicts
   - Market conditions and price action
   - Historical patterns (if available)
   - Why you accept or reject this signal
3. After </think>, provide your final decision in this exact format:

DECISION: [BUY/SELL/HOLD]
CONFIDENCE: [HIGH/MEDIUM/LOW]
REASONING: [One sentence explanation]

Be decisive and clear. Your reasoning in <think> must justify your final decision."""

# Our stand-in for the specialist model's text: the E4 rule-based reading.
ANALYSIS = ("RSI {rsi:.2f} ({rsi_zone}); MACD {macd:.4f} vs signal {signal:.4f} "
            "({macd_trend}, momentum {momentum}); outlook {outlook}.")


def prompt_table(signals: DataFrame, history: DataFrame | None = None, key: str = "ticker") -> DataFrame:
    """One row per ticker without an error: ``technical_prompt`` (E5) and
    ``decision_prompt`` (E6).  ``history`` (key, history_context) is the J3
    block; the news block appears only when the alert fired."""
    s = signals.filter(F.col("error").isNull())
    if history is not None:
        s = s.join(history.select(key, "history_context"), key, "left")
    else:
        s = s.withColumn("history_context", F.lit(""))
    s = s.withColumn("history_context", F.coalesce("history_context", F.lit("")))
    news = F.when(F.col("news_alert"), render(NEWS_ALERT_BLOCK, {"news_dir": F.upper("news_direction")}))\
        .otherwise(F.lit(""))
    s = s.withColumn("analysis", F.coalesce(render(ANALYSIS), F.lit("N/A"))).withColumn("news_context", news)
    return s.select(key, render(TECHNICAL_PROMPT).alias("technical_prompt"),
                    render(DECISION_PROMPT).alias("decision_prompt"))


# The history block of the decision prompt.
HISTORY_HEADER = "\n\nHISTORICAL CONTEXT (Past 5 trades for this stock):\n"


def history_line(ts, action, price, sentiment_avg, rsi, reasoning) -> Column:
    """One trade's history line without its number (formatted once per row)."""
    return F.concat(ymd(ts), F.lit(": "), F.col(action), F.lit(" at $"), fixed(price, 2),
                    F.lit(" (Sentiment: "), fixed(sentiment_avg, 2), F.lit(", RSI: "), fixed(rsi, 1),
                    F.lit(") - "), F.col(reasoning), F.lit("\n"))


def history_context(hist) -> Column:
    """Numbered history lines (newest first) under the header;
    empty when there is no earlier trade."""
    h = F.col(hist) if isinstance(hist, str) else hist
    lines = F.transform(h, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    return F.when(F.size(h) > 0, F.concat(F.lit(HISTORY_HEADER), F.array_join(lines, "")))\
        .otherwise(F.lit(""))


def history_block(ledger: DataFrame, key: str = "ticker", k: int = 5) -> DataFrame:
    """J3 now-mode + E6: each ticker's ``k`` latest ledger trades (newest
    first, larger id first on equal times) as the decision prompt's history
    block -- (key, history_context) for ``prompt_table``."""
    from marketsig.operators.topk import latest_k
    lines = ledger.select(key, "timestamp", "id",
                          history_line("timestamp", "action", "price", "sentiment_avg", "rsi", "reasoning")
                          .alias("line"))
    h = latest_k(lines, key, [F.col("timestamp").desc(), F.col("id").desc()], k, ["line"])
    return h.select(key, history_context(F.transform("latest", lambda x: x["line"])).alias("history_context"))
