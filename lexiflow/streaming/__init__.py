"""Structured Streaming entry points (the batch operators applied per micro-batch)."""

from lexiflow.streaming.keyterms import start_keyterm_stream  # noqa: F401
