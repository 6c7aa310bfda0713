"""Alert rules: a catalogue of patterns, and numeric ranges."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Default ranges (lowest, highest allowed); None leaves a side open.
DEFAULT_RANGES = {
    "weight": (200, 500),
    "logp": (-5, 5),
    "donors": (None, 5),
    "acceptors": (None, 10),
    "charge": (-2, 2),
    "rotatable_bonds": (None, 8),
    "heavy_atoms": (15, 50),
}


#: patterns of a catalogue, at most; each is an expression of the row's projection
MOST_RULES = 2000


def read_rules(catalogue: DataFrame, name: str = "name", pattern: str = "pattern", most: int = MOST_RULES) -> list[tuple[str, str]]:
    """The (name, pattern) pairs of a catalogue table, each once, by name; rows without a pattern are left out.

    A catalogue is configuration: one of more than `most` rules is refused.
    """
    rules = catalogue.where(F.col(pattern).isNotNull()).select(F.coalesce(F.col(name), F.lit("")), pattern).distinct()
    found = sorted(tuple(r) for r in rules.limit(most + 1).collect())
    if len(found) > most:
        raise ValueError(f"the catalogue has more than {most} rules")
    return found


def _found(text: str, pattern: str) -> Column:
    """Whether the pattern is in the text; one of letters, digits and spaces only is looked up without a regex."""
    return F.contains(F.col(text), F.lit(pattern)) if re.fullmatch("[A-Za-z0-9 ]+", pattern) else F.col(text).rlike(pattern)


def rules_found(df: DataFrame, patterns: Sequence[tuple[str, str]], text: str = "text", out: str = "rules") -> DataFrame:
    """Add the names of the rules found in a row, in the order of the catalogue; an empty array for null texts."""
    hits = [F.when(_found(text, pattern), F.lit(name)) for name, pattern in patterns]
    nothing = F.array().cast("array<string>")
    return df.withColumn(out, F.filter(F.array(*hits), lambda n: n.isNotNull()) if hits else nothing)


def rule_alerts(
    df: DataFrame,
    patterns: Sequence[tuple[str, str]],
    text: str = "text",
    ranges: dict[str, tuple[float | None, float | None]] | None = None,
) -> DataFrame:
    """Add `alerts`, the number of catalogue patterns found plus ranges broken, and 0/1 `alert`.

    The catalogue is configuration, so it becomes one expression per pattern in the row's own
    projection: no join, no shuffle, and the text is read once.
    """
    hits = [F.coalesce(_found(text, pattern), F.lit(False)).cast("int") for _, pattern in patterns]
    for column, (low, high) in (ranges or {}).items():
        broken = F.lit(False)
        if low is not None:
            broken = broken | (F.col(column) < low)
        if high is not None:
            broken = broken | (F.col(column) > high)
        hits.append(F.coalesce(broken, F.lit(False)).cast("int"))
    # in pairs, so that the sum of a large catalogue is no deep expression
    while len(hits) > 1:
        hits = [a + b for a, b in zip(hits[::2], hits[1::2])] + hits[len(hits) - len(hits) % 2 :]
    return df.withColumn("alerts", hits[0] if hits else F.lit(0)).withColumn("alert", (F.col("alerts") > 0).cast("int"))
