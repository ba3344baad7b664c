"""Structured Streaming jobs."""

from aerostrata.streaming.count_window import CountWindow
from aerostrata.streaming.pipeline import (
    drop_repeats, kafka_observations, observation_stream, scorer, watch_freshness, write_metrics,
)

__all__ = [
    "CountWindow", "drop_repeats", "kafka_observations", "observation_stream", "scorer",
    "watch_freshness", "write_metrics",
]
