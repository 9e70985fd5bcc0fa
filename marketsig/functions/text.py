"""Text expressions: headline cleaning (X1) and model-reply parsing.

All are native regex expressions.  Java regex differs from Python's ``re`` in
two places that matter here, so the patterns carry flags:
``(?U)`` makes ``\\s`` Unicode-aware like Python's, and ``(?d)`` makes ``.``
stop only at ``\\n`` (Java's ``.`` also stops at ``\\r``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's whitespace (str.isspace, and re's \s on str patterns) also has
# the ASCII separators 0x1C-0x1F, which Java's Unicode \s lacks.
_WS = r"[\s\x{1c}-\x{1f}]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Python ``str.strip()``: Unicode whitespace at both ends."""
    return F.regexp_replace(_col(c), rf"(?U)^{_WS}+|{_WS}+$", "")


def clean_headline(c) -> Column:
    """Tags -> strip -> one publisher suffix -> collapse whitespace.

    The suffix is whitespace, ``-`` or ``|``, whitespace, a capital letter and
    one or more letters/spaces to the end (e.g. `` - Reuters``).
    """
    t = F.regexp_replace(_col(c), "<[^>]+>", "")
    t = strip(t)
    t = F.regexp_replace(t, rf"(?U){_WS}[-|]{_WS}+[A-Z][A-Za-z\s\x{{1c}}-\x{{1f}}]+$", "")
    t = F.regexp_replace(t, rf"(?U){_WS}+", " ")
    return strip(t)


# Defaults and accepted words of the decision reply format.
DEFAULT_DECISION = "HOLD"
DEFAULT_CONFIDENCE = "LOW"
DEFAULT_REASONING = "No reasoning provided"
ERROR_PREFIX = "Error in decision making: "
ACTIONS = ("BUY", "SELL", "HOLD")
CONFIDENCES = ("HIGH", "MEDIUM", "LOW")


def thinking(reply) -> Column:
    """Text of the first ``<think>...</think>`` block, stripped ('' if none)."""
    return strip(F.regexp_extract(_col(reply), r"(?s)<think>(.*?)</think>", 1))


def final_answer(reply) -> Column:
    """The reply with every think block removed, stripped."""
    return strip(F.regexp_replace(_col(reply), r"(?s)<think>.*?</think>", ""))


def _first(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def parse_decision(reply) -> Column:
    """struct(decision, confidence, reasoning, thinking_process,
    approved, full_response) from a model reply.

    First match wins, matching ignores case, values are upper-cased; a NULL
    reply (failed call) gives the HOLD / LOW defaults with approved false.
    """
    r = _col(reply)
    ans = final_answer(r)
    acts = "|".join(ACTIONS)
    confs = "|".join(CONFIDENCES)
    decision = F.coalesce(F.upper(_first(ans, rf"(?iU)DECISION:{_WS}*({acts})")), F.lit(DEFAULT_DECISION))
    confidence = F.coalesce(F.upper(_first(ans, rf"(?iU)CONFIDENCE:{_WS}*({confs})")),
                            F.lit(DEFAULT_CONFIDENCE))
    reasoning = F.coalesce(F.nullif(strip(F.regexp_extract(ans, rf"(?iUd)REASONING:{_WS}*(.+?)(?:\n|$)", 1)),
                                    F.lit("")),
                           F.lit(DEFAULT_REASONING))
    ok = F.struct(decision.alias("decision"), confidence.alias("confidence"),
                  reasoning.alias("reasoning"), thinking(r).alias("thinking_process"),
                  decision.isin("BUY", "SELL").alias("approved"), r.alias("full_response"))
    return ok


def failed_decision(error) -> Column:
    """The decision recorded when the model call failed."""
    return F.struct(F.lit(DEFAULT_DECISION).alias("decision"),
                    F.lit(DEFAULT_CONFIDENCE).alias("confidence"),
                    F.concat(F.lit(ERROR_PREFIX), _col(error)).alias("reasoning"),
                    F.lit("").alias("thinking_process"), F.lit(False).alias("approved"),
                    F.lit("").alias("full_response"))


def decision_or_default(reply, error=None) -> Column:
    """Parsed decision, or the E9 default when the reply is NULL."""
    err = _col(error) if error is not None else F.lit("no reply")
    return F.when(_col(reply).isNull(), failed_decision(err)).otherwise(parse_decision(reply))
