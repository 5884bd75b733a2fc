"""Join helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.fixed_values import ALLERGENS, COUNTRIES, DICTIONARY_TOP, NUTRITION_TERMS, SUSTAINABILITY_LABELS

# A built dictionary never exceeds its per-kind caps plus the fixed sets.
DICTIONARY_MAX_ROWS = (sum(DICTIONARY_TOP.values()) + 64 + len(ALLERGENS) + len(SUSTAINABILITY_LABELS)
                       + len(NUTRITION_TERMS) + len(COUNTRIES))


# Rows of products or documents that one task parses or analyses.
ROWS_PER_TASK = 10_000


def spread(df: DataFrame, *keys: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The rows of ``df`` over tasks of about ``rows_per_task`` (by ``keys``, if any): a small compressed file is read
    by one task, however many rows it has, and what is derived from a row is many times its size."""
    n = -(-df.count() // rows_per_task)
    if n <= 1:
        return df
    if keys:
        return df.repartition(n, *keys)
    # filters on what is parsed later aren't moved below a generator, so not into the task that reads the file
    return df.repartition(n).select(F.explode(F.array(F.struct(*df.columns))).alias("_row")).select("_row.*")


def broadcast_if_small(df: DataFrame, max_rows: int = DICTIONARY_MAX_ROWS) -> DataFrame:
    """Broadcast ``df`` only after checking it holds at most ``max_rows`` rows
    (a limit-pushed probe that reads at most max_rows + 1 rows); otherwise
    return it unchanged so the planner uses a shuffle join."""
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df
