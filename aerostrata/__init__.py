"""Spark-native analytics for fleets of multi-sensor air-quality stations."""

from aerostrata.session import build_session, configure, scratch_dir

__all__ = ["build_session", "configure", "scratch_dir"]
__version__ = "0.1.0"
