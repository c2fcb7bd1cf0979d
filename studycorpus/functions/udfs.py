"""The few Python helpers: per row, batched through Arrow."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import fixed_values as V


def _first_decoding(data: bytes) -> str:
    for name in ("utf-8", *V.LEGACY_ENCODINGS):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            pass
    return data.decode("utf-8", "replace")


@F.pandas_udf(StringType())
def decode_legacy(content: pd.Series) -> pd.Series:
    """Text of bytes that are not valid UTF-8."""
    return content.map(_first_decoding, na_action="ignore")


def _damage(text: str) -> int:
    marks = sum(text.count(m) for m in V.MOJIBAKE_MARKERS)
    controls = sum("\x80" <= ch <= "\x9f" for ch in text)
    return 100 * text.count("�") + 8 * marks + 4 * controls


def _undo(name: str) -> str:
    readings = [name]
    for wrong in ("latin-1", "cp1252"):
        try:
            readings.append(name.encode(wrong).decode("utf-8"))
        except UnicodeError:
            pass
    return min(readings, key=_damage)


@F.pandas_udf(StringType())
def undo_mojibake(name: pd.Series) -> pd.Series:
    """Least damaged reading of a name; null stays null."""
    return name.map(_undo, na_action="ignore")
