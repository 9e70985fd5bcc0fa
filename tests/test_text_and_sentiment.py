import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketsig.functions.text import clean_headline, decision_or_default, parse_decision
from marketsig.operators import sentiment as S

# FIXTURES.md section 4.
HEADLINES = [
    ("<b>Apple</b> soars - Reuters", "Apple soars"),
    ("Nvidia up 5% | Bloomberg News", "Nvidia up 5%"),
    ("Fed holds - The Wall Street Journal", "Fed holds"),
    ("Tesla - Model Y - Reuters", "Tesla - Model Y"),
    ("x - Reuters | Bloomberg", "x - Reuters"),
    ("AMD beats - Q3 results", "AMD beats - Q3 results"),
    ("Intel cuts jobs - CNBC.com", "Intel cuts jobs - CNBC.com"),
    ("Netflix -Reuters", "Netflix -Reuters"),
    ("Apple - A", "Apple - A"),
    ("Deal - reuters", "Deal - reuters"),
    ("- Reuters", "- Reuters"),
    ("Stock falls - Up Next Week\n", "Stock falls"),
    ("5 < 6 and 7 > 3", "5 3"),
    ("Meta  \n rises\t2%", "Meta rises 2%"),
]

# FIXTURES.md section 5: reply -> (thinking, decision, confidence, reasoning).
REPLIES = [
    ("<think> a\nb </think>\nDECISION: BUY\nCONFIDENCE: HIGH\nREASONING: Strong.\nmore", "a\nb", "BUY", "HIGH", "Strong."),
    ("decision: sell\nconfidence: medium", "", "SELL", "MEDIUM", "No reasoning provided"),
    ("**DECISION:** BUY", "", "HOLD", "LOW", "No reasoning provided"),
    ("DECISION: [SELL]", "", "HOLD", "LOW", "No reasoning provided"),
    ("<think>DECISION: BUY</think>DECISION: HOLD", "DECISION: BUY", "HOLD", "LOW", "No reasoning provided"),
    ("<think>unclosed DECISION: BUY", "", "BUY", "LOW", "No reasoning provided"),
    ("DECISION: BUY DECISION: SELL", "", "BUY", "LOW", "No reasoning provided"),
    ("REASONING:\nnext line", "", "HOLD", "LOW", "next line"),
    ("<think>a</think>x<think>b</think>DECISION:SELLING", "a", "SELL", "LOW", "No reasoning provided"),
    ("REASONING: foo\r\nmore", "", "HOLD", "LOW", "foo"),
    ("", "", "HOLD", "LOW", "No reasoning provided"),
]


def test_clean_headline(spark):
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(HEADLINES)], "i int, h string")
    got = {r.i: r.c for r in df.select("i", clean_headline("h").alias("c")).collect()}
    for i, (_, want) in enumerate(HEADLINES):
        assert got[i] == want, (HEADLINES[i][0], got[i])


def test_parse_decision(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(REPLIES)], "i int, r string")
    got = {x.i: x.d for x in df.select("i", parse_decision("r").alias("d")).collect()}
    for i, (_, th, dec, conf, why) in enumerate(REPLIES):
        d = got[i]
        assert (d.thinking_process, d.decision, d.confidence, d.reasoning) == (th, dec, conf, why), REPLIES[i][0]
        assert d.approved == (dec in ("BUY", "SELL"))


def test_failed_reply(spark):
    df = spark.createDataFrame([(None, "timeout")], "r string, e string")
    d = df.select(decision_or_default("r", "e").alias("d")).first().d
    assert (d.decision, d.confidence, d.approved) == ("HOLD", "LOW", False)
    assert d.reasoning == "Error in decision making: timeout"


def test_label_and_tie(spark):
    df = spark.createDataFrame([(0.05, 0.15, 0.80), (0.4, 0.4, 0.2)], "n double, u double, p double")
    out = S.classify(df, F.log("n"), F.log("u"), F.log("p")).collect()
    assert out[0].sentiment == "positive" and abs(out[0].confidence - 0.8) < 1e-12
    assert abs(out[0].score - 0.75) < 1e-12
    assert out[1].sentiment == "negative"


@pytest.mark.parametrize("counts,score,label,ratios", [
    ((6, 2, 2), 0.4, "positive", (0.6, 0.2, 0.2)),
    ((7, 1, 2), 0.6, "positive", (0.7, 0.1, 0.2)),
    ((6, 4, 0), 0.2, "neutral", (0.6, 0.4, 0.0)),
])
def test_count_path(spark, counts, score, label, ratios):
    rows = [("T", c) for c, n in zip(("positive", "negative", "neutral"), counts) for _ in range(n)]
    df = spark.createDataFrame(rows, "ticker string, sentiment string")
    universe = spark.createDataFrame([("T",), ("EMPTY",)], "ticker string")
    out = {r.ticker: r for r in S.count_path(df, "ticker", universe=universe).collect()}
    t = out["T"]
    assert abs(t.avg_score - score) < 1e-12 and t.avg_sentiment == label
    assert tuple(round(x, 12) for x in (t.positive_ratio, t.negative_ratio, t.neutral_ratio)) == ratios
    e = out["EMPTY"]
    assert (e.total_headlines, e.avg_score, e.avg_sentiment, e.positive_ratio) == (0, 0.0, "neutral", 0.0)


def test_weighted(spark):
    as_of = dt.datetime(2026, 1, 27, 12, 0)
    m = lambda k: as_of - dt.timedelta(minutes=k)
    rows = [("A", m(5), 0.9), ("A", m(30), 0.3), ("A", m(61), -1.0),
            ("B", m(15), 0.5), ("B", m(60), -0.4),
            ("C", m(120), 0.5), ("D", m(5), 0.8), ("E", m(5), 0.6), ("F", m(1), None)]
    df = spark.createDataFrame(rows, "ticker string, created_at timestamp_ntz, sentiment_score double")
    universe = spark.createDataFrame([(t,) for t in "ABCDEFG"], "ticker string")
    out = {r.ticker: r for r in S.from_alert(S.weighted_scores(df, as_of, universe=universe)).collect()}
    assert abs(out["A"].raw_score - 0.7) < 1e-12 and out["A"].articles_count == 2
    assert out["A"].avg_sentiment == "positive"
    assert abs(out["B"].raw_score - 0.2) < 1e-12 and out["B"].articles_count == 2
    assert out["B"].avg_sentiment == "neutral"
    for t in "CFG":
        assert (out[t].score, out[t].alert, out[t].articles_count, out[t].direction) == (0.0, False, 0, "neutral")
    assert out["D"].alert and not out["E"].alert
    assert abs(out["A"].positive_ratio - 0.7) < 1e-12 and abs(out["A"].neutral_ratio - 0.3) < 1e-12


def test_alert_uses_unrounded(spark):
    df = spark.createDataFrame([("X", 0.69996, 3), ("Y", 0.20004, 1)], "ticker string, raw_score double, articles_count long")
    out = {r.ticker: r for r in S.from_alert(S.alert_columns(df)).collect()}
    assert out["X"].score == 0.7 and out["X"].alert is False
    assert out["Y"].avg_sentiment == "neutral"


def test_default_lexicon_scorer(spark):
    df = spark.createDataFrame([("Apple soars on record profit",), ("Intel misses, shares plunge",), ("Fed holds",)],
                               "headline string")
    out = {r.headline: r for r in S.lexicon_scorer()(df).collect()}
    assert out["Apple soars on record profit"].sentiment == "positive"
    assert out["Intel misses, shares plunge"].sentiment_score < 0
    assert out["Fed holds"].sentiment == "neutral"


def test_missing_text_and_probabilities(spark):
    from marketsig.functions.scalar import argmax_label
    df = spark.createDataFrame([(None,), ("",)], "headline string")
    out = S.lexicon_scorer()(df).collect()
    assert [r.sentiment for r in out] == ["neutral", "neutral"] and all(r.n_tokens == 0 for r in out)
    p = spark.createDataFrame([(None, 0.5, 0.5)], "n double, u double, p double")
    assert p.select(argmax_label("n", "u", "p").alias("l")).first().l is None


def test_weighted_random_against_brute_force(spark):
    """Random rows on and around the 15- and 60-minute boundaries: the Spark
    aggregate equals the rule computed row by row in Python."""
    import random
    rnd = random.Random(3)
    as_of = dt.datetime(2026, 1, 27, 12, 0)
    offsets = [0, 1, 14, 15, 16, 30, 59, 60, 61, 120, -5]            # minutes before as_of
    rows = []
    for t in "ABCDEFGH":
        for _ in range(rnd.randint(0, 12)):
            m = rnd.choice(offsets)
            sec = rnd.choice([0, 0, 1, -1])
            score = rnd.choice([None, round(rnd.uniform(-1, 1), 2), 0.9, -0.95])
            rows.append((t, as_of - dt.timedelta(minutes=m, seconds=sec), score))
    df = spark.createDataFrame(rows, "ticker string, created_at timestamp_ntz, sentiment_score double")
    got = {r.ticker: r for r in S.weighted_scores(df, as_of).collect()}
    for t in {r[0] for r in rows}:
        kept = [(ts, s) for tt, ts, s in rows if tt == t and s is not None and ts >= as_of - dt.timedelta(hours=1)]
        w = [2.0 if ts >= as_of - dt.timedelta(minutes=15) else 1.0 for ts, _ in kept]
        raw = sum(s * x for (_, s), x in zip(kept, w)) / sum(w) if kept else 0.0
        g = got.get(t)
        if not kept:
            assert g is None or g.articles_count == 0
            continue
        assert g.articles_count == len(kept)
        assert abs(g.raw_score - raw) < 1e-9
        assert g.alert == (abs(g.raw_score) >= 0.7)
        assert g.direction == ("positive" if raw > 1e-12 else "negative" if raw < -1e-12 else g.direction)


def test_lexicon_counts_of_odd_texts(spark):
    """Empty ends, accents, digits, missing texts, one-class lexicons and columns named like the helper's own."""
    import re

    from pyspark.sql import functions as F

    from marketsig.operators import sentiment
    texts = [None, "", "...", "a", " gain", "gain ", "GAIN loss, gains! x", "é gain\nbeatsé", "beat1beats", "gain" * 3, "loss " * 500]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").withColumns({"tokens": F.lit("t"), "Hits": F.lit("h")})
    for lexicon in (sentiment.DEFAULT_LEXICON, {"gain": "positive"}, {}):
        out = sentiment.lexicon_counts(df, "text", lexicon)
        assert out.columns == [*df.columns, "n_tokens", "n_pos", "n_neg"]
        for r in out.collect():
            words = re.findall("[a-z]+", (r.text or "").lower())
            counts = [sum(lexicon.get(w) == c for w in words) for c in ("positive", "negative")]
            assert (r.tokens, r.Hits, r.n_tokens, r.n_pos, r.n_neg) == ("t", "h", len(words), *counts), r
