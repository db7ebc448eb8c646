"""What a query does and how long it takes."""

from __future__ import annotations

import contextlib
import io
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


@dataclass
class Timed:
    plan: str
    rows: int
    seconds: float


def explain_analyze(df: DataFrame) -> Timed:
    """Run a query to its end without keeping its rows: its plan, the number of rows and the wall clock."""
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain(mode="formatted")
    seen = Observation()
    start = time.monotonic()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
    return Timed(text.getvalue(), seen.get["rows"], time.monotonic() - start)
