"""P5/P6 cells against hand-formatted values (Python format specs of the
reference's summary table and detail panel)."""

from marketsig.plans import report

COLS = ("ticker string, current_price double, change double, percent_change double, news_score double, "
        "news_alert boolean, news_count long, news_direction string, avg_sentiment string, avg_score double, "
        "positive_ratio double, negative_ratio double, rsi double, macd double, decision string, "
        "confidence string, reasoning string, error string")


def _rows(spark):
    return spark.createDataFrame([
        ("AAPL", 184.89, -10.67, -5.46, 0.75, True, 3, "positive", "positive", 0.75, 0.75, 0.0, 71.42857142857143,
         4.769932949942685, "BUY", "HIGH", "Strong.", None),
        ("MSFT", 272.14, 5.96, 2.24, 0.0, False, 0, "neutral", "neutral", 0.0, 0.0, 0.0, None, 0.0,
         "HOLD", "LOW", "No reasoning provided", None),
        ("TSLA", None, None, None, 0.0, False, 0, "neutral", None, None, None, None, None, None, None, None, None,
         "Failed to fetch market data for TSLA"),
    ], COLS)


def test_summary_cells(spark):
    got = {r.ticker: r for r in report.summary_table(_rows(spark)).collect()}
    a = got["AAPL"]
    assert (a.price, a.change, a.news_score, a.sentiment, a.rsi, a.decision, a.confidence) == (
        "$184.89", "$-10.67 (-5.46%)", "+0.750", "+ Positive", "71.4", "BUY", "HIGH")
    m = got["MSFT"]
    assert (m.change, m.news_score, m.sentiment, m.rsi) == ("$5.96 (+2.24%)", "-", "~ Neutral", "nan")
    t = got["TSLA"]
    assert (t.price, t.change, t.news_score, t.sentiment, t.rsi, t.decision, t.confidence) == (
        "ERROR", "-", "-", "-", "-", "-", "-")


def test_detail_text(spark):
    got = {r.ticker: r.detail for r in report.detail_rows(_rows(spark)).collect()}
    assert got["TSLA"] == "Error: Failed to fetch market data for TSLA"
    a = got["AAPL"]
    assert "Decision: BUY\nConfidence: HIGH\nReasoning: Strong.\n" in a
    assert "News: score=+0.750 (POSITIVE), 3 articles ALERT" in a
    assert "Overall: positive (Score: 0.750)" in a and "Positive: 75.0% | Negative: 0.0%" in a
    assert "RSI: 71.43" in a and "MACD: 4.7699" in a


def test_prompt_templates_match_python_format(spark):
    """The Spark renderer must produce exactly what Python's str.format makes
    of the same template (the reference builds its prompts with f-strings)."""
    import random

    from pyspark.sql import functions as F

    from marketsig.functions.template import render
    from marketsig.plans.prompts import DECISION_PROMPT, TECHNICAL_PROMPT
    rnd = random.Random(5)
    ties = [0.125, 2.675, 1.005, -0.0, 0.0, -0.125, 12.345, 0.0005, 99.995, -1.005]
    floats = ["current_price", "change", "percent_change", "high", "low", "previous_close", "rsi", "macd",
              "signal", "histogram", "avg_score", "positive_ratio", "negative_ratio", "neutral_ratio"]
    rows = []
    for i in range(300):
        vals = {c: (rnd.choice(ties) if rnd.random() < 0.3 else round(rnd.uniform(-500, 500), rnd.choice([2, 3, 7])))
                for c in floats}
        vals.update(ticker=f"T{i}", avg_sentiment=rnd.choice(["positive", "neutral"]), total_headlines=rnd.randint(0, 9),
                    analysis="x", history_context="", news_context="")
        rows.append(vals)
    schema = ", ".join([f"{c} double" for c in floats] + ["ticker string", "avg_sentiment string",
                                                          "total_headlines long", "analysis string",
                                                          "history_context string", "news_context string"])
    df = spark.createDataFrame([tuple(r[c] for c in floats) + (r["ticker"], r["avg_sentiment"], r["total_headlines"],
                                                              r["analysis"], r["history_context"], r["news_context"])
                                for r in rows], schema)
    got = {r.ticker: (r.t, r.d) for r in df.select("ticker", render(TECHNICAL_PROMPT).alias("t"),
                                                   render(DECISION_PROMPT).alias("d")).collect()}
    bad = [r["ticker"] for r in rows
           if got[r["ticker"]] != (TECHNICAL_PROMPT.format(**r), DECISION_PROMPT.format(**r))]
    assert not bad, bad[:5]


def test_signed_and_percent_formats(spark):
    from marketsig.functions.scalar import percent, py_round, signed_fixed
    xs = [-0.0, 0.0, -0.0004, 0.0004, 1.2345, -1.2345, 0.0625, 2.675, -2.675, 123456.7895]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    got = {r.i: r for r in df.select("i", signed_fixed("x", 3).alias("s"), percent("x", 1).alias("p"),
                                     py_round("x", 2).alias("r")).collect()}
    for i, x in enumerate(xs):
        assert got[i].s == f"{x:+.3f}", (x, got[i].s)
        assert got[i].p == f"{x:.1%}", (x, got[i].p)
        # Python's round, except that negative zero is returned as 0.0.
        assert repr(got[i].r) == repr(round(x, 2) + 0.0), (x, got[i].r)


def test_history_block_now_mode(spark):
    import datetime as dt

    from marketsig.plans.prompts import history_block
    t0 = dt.datetime(2026, 1, 20)
    rows = [(i, "AAPL", t0 + dt.timedelta(days=i // 2), "BUY" if i % 2 else "HOLD", 100.0 + i, 0.125 * i, 50.0 + i,
             f"r{i}") for i in range(8)] + [(99, "MSFT", t0, "SELL", 10.0, -0.5, 30.0, "x")]
    led = spark.createDataFrame(rows, "id long, ticker string, timestamp timestamp, action string, price double, "
                                      "sentiment_avg double, rsi double, reasoning string")
    got = {r.ticker: r.history_context for r in history_block(led).collect()}
    lines = got["AAPL"].split("\n")
    assert lines[2] == "HISTORICAL CONTEXT (Past 5 trades for this stock):"
    assert lines[3] == f"1. 2026-01-23: BUY at $107.00 (Sentiment: {0.875:.2f}, RSI: 57.0) - r7"
    assert len([x for x in lines if x[:2] in ("1.", "2.", "3.", "4.", "5.", "6.")]) == 5
    assert got["MSFT"].endswith("1. 2026-01-20: SELL at $10.00 (Sentiment: -0.50, RSI: 30.0) - x\n")


def test_ledger_round_trip_into_prompts(spark, tmp_path):
    """P4 -> C1-C7 -> K4 append -> read back -> J3 now mode -> E6 prompts."""
    import datetime as dt

    from marketsig.operators import sinks
    from marketsig.plans import catalog, prompts, signals
    from marketsig.schemas import TRADE_LEDGER
    sig = catalog._signal_inputs(spark, "/root/testdata/sf0.001")
    root = str(tmp_path / "tables")
    sinks.create_tables(spark, root, [TRADE_LEDGER])
    for day in (1, 2):                                    # two decision runs
        rejects = sinks.append(signals.ledger_rows(sig, dt.datetime(2024, 2, day)), root, TRADE_LEDGER)
        assert rejects.count() == 0
    ledger = sinks.read_table(spark, root, TRADE_LEDGER)
    ok = sig.filter("error IS NULL").count()
    assert ledger.count() == 2 * ok and ledger.select("id").distinct().count() == 2 * ok
    table = prompts.prompt_table(sig, prompts.history_block(ledger)).collect()
    assert len(table) == ok
    p = table[0].decision_prompt
    assert "HISTORICAL CONTEXT (Past 5 trades for this stock):\n1. 2024-02-02: " in p
    assert "\n2. 2024-02-01: " in p and "INSTRUCTIONS:" in p
