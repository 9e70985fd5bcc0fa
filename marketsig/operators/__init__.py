"""DataFrame operators: series indicators, sentiment, top-k, keys and
constraints, sinks."""
