"""Inputs and outputs."""

from aerostrata.sources.files import read_batch_json, read_csv
from aerostrata.sources.frames import decode_frames
from aerostrata.sources.tables import create_tables, scan_observations, scan_with_metrics

__all__ = [
    "create_tables", "decode_frames", "read_batch_json", "read_csv", "scan_observations",
    "scan_with_metrics",
]
