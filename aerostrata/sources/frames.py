"""Raw nine-byte sensor frames as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_FRAME_BYTES = 9


def _word(frame: Column, first_byte: int) -> Column:
    """Big-endian 16-bit word; the check byte after each word is not looked at."""
    return F.conv(F.hex(F.substring(frame, first_byte + 1, 2)), 16, 10).cast("double")


def decode_frames(df: DataFrame, frame: str = "frame") -> DataFrame:
    """Add CO2, temperature and humidity from a binary frame; a short frame gives NULL."""
    f = F.col(frame)
    whole = F.octet_length(f) >= _FRAME_BYTES
    return df.withColumns({
        "co2_ppm": F.when(whole, _word(f, 0)),
        "scd_temp_c": F.when(whole, F.lit(-45.0) + F.lit(175.0) * _word(f, 3) / F.lit(65536.0)),
        "scd_humidity_pct": F.when(whole, F.lit(100.0) * _word(f, 6) / F.lit(65536.0)),
    })
