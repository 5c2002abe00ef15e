"""The reports are batch jobs; the stateless row functions serve a stream unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textassay.functions.patterns import corrupt
from textassay.functions.repair import repair
from textassay.functions.text import input_flags


def annotate(rows: DataFrame, text: str = "text") -> DataFrame:
    """Corruption flag, repaired text and length flags; no state, no shuffle."""
    flags = input_flags(F.col(text))
    return rows.withColumns({"corrupt": corrupt(F.col(text)), "repaired": repair(F.col(text)), **flags})
