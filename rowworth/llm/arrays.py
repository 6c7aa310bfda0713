"""Array columns worked through in order, in time in proportion to their length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# an append copies an array, so elements are gathered in parts of this many
_PART = 128


def scanned(items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], element: str) -> Column:
    """All elements that `step(state, item)` gives, which returns the next state and an array of `element`."""
    zero = F.struct(
        start.alias("at"), F.array().cast(f"array<{element}>").alias("part"), F.array().cast(f"array<array<{element}>>").alias("done")
    )

    def run(state, item):
        at, made = step(state["at"], item)
        full = F.size(state["part"]) >= _PART
        return F.struct(
            at.alias("at"),
            F.when(full, made).otherwise(F.concat(state["part"], made)).alias("part"),
            F.when(full, F.concat(state["done"], F.array(state["part"]))).otherwise(state["done"]).alias("done"),
        )

    return F.aggregate(items, zero, run, lambda state: F.concat(F.flatten(state["done"]), state["part"]))
