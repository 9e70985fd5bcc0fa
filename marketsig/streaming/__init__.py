"""Structured Streaming: the monitoring loop (R1), stateful URL dedup (R2,
R3), sliding weighted scores (R4), alerts (R5) and late data (R6)."""
