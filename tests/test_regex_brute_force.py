"""Random strings through the Spark expressions and through character scanners
written from the rules' wording, without regular expressions: outputs must agree."""

import random

from marketsig.functions.text import clean_headline, parse_decision

# Letters that a case-blind match takes for ASCII ones.
ALIKE = {"\u0130": "i", "\u0131": "i", "\u017f": "s", "\u212a": "k"}


def without_tags(text):
    """A tag is "<", one or more characters other than ">", then ">"."""
    kept, at = [], 0
    while at < len(text):
        close = text.find(">", at) if text[at] == "<" else -1
        if close > at + 1:
            at = close + 1
        else:
            kept.append(text[at])
            at += 1
    return "".join(kept)


def scan_headline(text):
    """No tags, no publisher after the last dash or bar, single spaces."""
    text = without_tags(text).strip()
    bar = max(text.rfind("-"), text.rfind("|"))
    name = text[bar + 1:].lstrip()
    if (bar > 0 and text[bar - 1].isspace() and text[bar + 1:bar + 2].isspace() and len(name) > 1
            and "A" <= name[0] <= "Z" and all(c.isspace() or (c.isascii() and c.isalpha()) for c in name)):
        text = text[:bar - 1]
    return " ".join(text.split())


def blind(text):
    return "".join(ALIKE.get(c, c.lower() if c.isascii() else c) for c in text)


def after(answer, label):
    """Places of the first character other than white space behind each ``label``."""
    seen = blind(answer)
    at = seen.find(label)
    while at >= 0:
        place = at + len(label)
        while place < len(answer) and answer[place].isspace():
            place += 1
        yield place
        at = seen.find(label, at + 1)


def scan_word(answer, label, words, default):
    for place in after(answer, label):
        for word in words:
            if blind(answer[place:]).startswith(word):
                return answer[place:place + len(word)].upper()
    return default


def scan_reply(reply):
    inside, rest, at = [], [], 0
    while True:
        begin = reply.find("<think>", at)
        end = reply.find("</think>", begin + 7) if begin >= 0 else -1
        if end < 0:
            break
        inside.append(reply[begin + 7:end].strip())
        rest.append(reply[at:begin])
        at = end + 8
    answer = "".join([*rest, reply[at:]]).strip()
    lines = (answer[p:].split("\n")[0].strip() for p in after(answer, "reasoning:") if p < len(answer))
    return ((inside or [""])[0], scan_word(answer, "decision:", ("buy", "sell", "hold"), "HOLD"),
            scan_word(answer, "confidence:", ("high", "medium", "low"), "LOW"),
            next(lines, "No reasoning provided"))


PIECES = ["Apple", "soars", " - ", " | ", "-", "|", "Reuters", "Bloomberg News", "Q3", ".com", "<b>", "</b>",
          "<", ">", " ", "  ", "\t", "\n", "\r\n", "\r", "\x0b", "\x0c", " ", " ", "　", "\x1c",
          "\x1f", "\x85", "x", "A", "é", "Ü", "5%", "DECISION:", "decision: ", "CONFIDENCE: ", "REASONING:",
          "BUY", "sell", "Hold", "HIGH", "medium", "low", "<think>", "</think>", "[", "]", "**",
          "ſell", "BUſ", "HIGK", "hİgh", "ﬀ"]


def _strings(seed, n):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 14))) for _ in range(n)]


def test_clean_headline_random(spark):
    xs = _strings(11, 1500)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, h string")
    got = {r.i: r.c for r in df.select("i", clean_headline("h").alias("c")).collect()}
    bad = [(x, got[i], scan_headline(x)) for i, x in enumerate(xs) if got[i] != scan_headline(x)]
    assert not bad, bad[:5]


def test_parse_decision_random(spark):
    xs = _strings(23, 1500)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, r string")
    got = {r.i: tuple(r.d)[:2] + (r.d.reasoning, r.d.thinking_process) for r in df.select("i", parse_decision("r").alias("d")).collect()}
    bad = []
    for i, x in enumerate(xs):
        inside, decision, confidence, why = scan_reply(x)
        if got[i] != (decision, confidence, why, inside):
            bad.append((x, got[i], scan_reply(x)))
    assert not bad, bad[:5]
