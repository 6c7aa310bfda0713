"""Column expressions. All are plain built-ins, so they stay in generated code and also
work on a streaming DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the token pattern for structure strings.
TOKEN_PATTERN = (
    r"(\[[^\]]+]|Br?|Cl?|N|O|S|P|F|I|b|c|n|o|s|p|\(|\)|\.|=|#|-|\+|\\\\|\/|:|~|@|\?|>|\*|\$|\%[0-9]{2}|[0-9])"
)
# Fixed value: stands for infinity after cleaning (with its sign).
INFINITY_STANDS_FOR = 1e9


def valid_key(key: Column, pattern: str | None = None) -> Column:
    """Non-empty, and matching `pattern` if there is one."""
    ok = F.length(F.trim(key)) > 0
    return ok & key.rlike(pattern) if pattern else ok


def canonical_key(key: Column) -> Column:
    """Equal items collide: case folded, runs of white space made one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.lower(key), r"[ \t\r\n]+", " "))


def binarize_outcome(outcome: Column, active: str = "Active") -> Column:
    return outcome.eqNullSafe(F.lit(active)).cast("int")


def seeded_key(id_col: Column, seed: int) -> Column:
    """Sort key of a seeded shuffle."""
    return F.md5(F.concat(F.lit(f"{seed}:"), id_col.cast("string")))


def draw_bound(share: float) -> str:
    """A bound on `seeded_key`, which lets about that share of distinct ids pass."""
    return f"{min(int(share * (1 << 52)), (1 << 52) - 1):013x}" + ("g" if share >= 1 else "")


def sanitize_numeric(values: Column) -> Column:
    """In an array of numbers: NaN to 0, infinities to a large finite number."""
    return F.transform(
        values,
        lambda x: F.when(F.isnan(x), F.lit(0.0))
        .when(x == float("inf"), F.lit(INFINITY_STANDS_FOR))
        .when(x == float("-inf"), F.lit(-INFINITY_STANDS_FOR))
        .otherwise(x),
    )


def numeric_descriptors(columns: Sequence[Column]) -> Column:
    """Named numeric expressions as one clean feature array."""
    return sanitize_numeric(F.array(*[F.coalesce(c.cast("double"), F.lit(float("nan"))) for c in columns]))


def tokenize(text: Column, pattern: str = TOKEN_PATTERN) -> Column:
    """All matches of the pattern's first group, left to right."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def hashed_fingerprint(tokens: Column, radius: int = 2, bits: int = 1024) -> Column:
    """Sorted distinct set bits: every run of 1..radius+1 tokens is hashed into `bits` slots."""

    def runs(t: Column, width: int) -> Column:
        if width == 1:
            return F.coalesce(F.transform(t, lambda token: F.concat_ws(" ", token)), F.array().cast("array<string>"))
        starts = F.when(F.size(t) >= width, F.sequence(F.lit(0), F.size(t) - width)).otherwise(
            F.array().cast("array<int>")
        )
        return F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(t, i + k) for k in range(width)]))

    def fingerprint(t: Column) -> Column:
        grams = F.array_distinct(F.concat(*[runs(t, width) for width in range(1, radius + 2)]))
        slots = F.transform(grams, lambda g: F.conv(F.substring(F.md5(g), 1, 8), 16, 10).cast("long") % bits)
        # no null is among them, and this sorts without calling a comparator expression
        return F.sort_array(F.array_distinct(slots))

    # bound to a variable, so that the tokens are not worked out again for every run
    return F.transform(F.array(tokens), fingerprint)[0]


def tanimoto_bits(a: Column, b: Column) -> Column:
    """Shared over all set bits of two fingerprints; 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def tanimoto(a: Column, b: Column) -> Column:
    """<a,b> / (|a|^2 + |b|^2 - <a,b>); 0 for two zero vectors."""
    shared = dot(a, b)
    rest = dot(a, a) + dot(b, b) - shared
    return F.when(rest != 0, shared / rest).otherwise(F.lit(0.0))


def acq_greedy(mean: Column) -> Column:
    return mean


def acq_ucb(mean: Column, variance: Column, beta: float = 2.0, explore: int = 1) -> Column:
    """mean + beta * sd. The lowest are picked, so `explore=-1` is what favours uncertain rows."""
    return mean + F.lit(explore * beta) * F.sqrt(variance)


def class_weight(label: Column, n_pos: Column, n_neg: Column) -> Column:
    """sqrt(n / n_class); 1 when a class is empty."""
    n = n_pos + n_neg
    weight = F.when(label == 1, F.sqrt(n / n_pos)).otherwise(F.sqrt(n / n_neg))
    return F.when((n_pos == 0) | (n_neg == 0), F.lit(1.0)).otherwise(weight)
