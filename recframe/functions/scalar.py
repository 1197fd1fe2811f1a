"""Column functions for click-log fields, scores and bags; all of them stay inside code generation where Spark can."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def missing_to_zero(field: Column) -> Column:
    """An absent or empty field is the text '0', so that it shares the code of a genuine zero."""
    return F.coalesce(F.nullif(F.trim(field), F.lit("")), F.lit("0"))


def hex_to_int(field: Column) -> Column:
    """Hexadecimal text to BIGINT; 32-bit hashes keep their full unsigned range."""
    return F.conv(field, 16, 10).cast("bigint")


def hash_cap(value: Column, limit: int) -> Column:
    """Ids folded into [0, limit) where a positive limit is set."""
    return F.pmod(value, F.lit(limit)) if limit > 0 else value


def cardinality_cap(n: Column, limit: int) -> Column:
    return F.least(n, F.lit(limit)) if limit > 0 else n


def clamp_negative(x: Column) -> Column:
    return F.greatest(x, F.lit(0).cast("int"))


def dense_log(x: Column) -> Column:
    """log(x + 1) of a clamped count."""
    return F.log1p(F.greatest(x.cast("double"), F.lit(0.0)))


def hashed_unit(key: Column, salt: str = "") -> Column:
    """A number in [0, 1) settled by the key alone: the first 32 bits of an MD5 digest."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def keep_after_subsampling(label: Column, key: Column, rate: float, salt: str = "") -> Column:
    """Every positive row, and the negative ones except a share of ``rate``."""
    return ~((label == 0) & (hashed_unit(key, salt) < rate))


def clamp_score(p: Column, threshold: float) -> Column:
    """Into [t, 1 - t], if 0 < t < 1."""
    return F.greatest(F.lit(threshold), F.least(p, F.lit(1 - threshold))) if 0 < threshold < 1 else p


def score_class(p: Column) -> Column:
    """Half to even: 0.5 is class 0."""
    return F.rint(p).cast("int")


def score_class_half_up(p: Column, classes: int = 2) -> Column:
    """The variant of analysis reports: floor(p + 0.5), clamped to the classes there are."""
    return F.least(F.greatest(F.floor(p + 0.5), F.lit(0)), F.lit(classes - 1)).cast("int")


def misclassified(predicted: Column, target: Column) -> Column:
    return (predicted != target).cast("int")


def offsets_to_lengths(offset: Column, total: Column, order: WindowSpec) -> Column:
    """Start offsets in ``order`` to run lengths; the last run ends at ``total``."""
    return F.coalesce(F.lead(offset).over(order), total) - offset


def lengths_to_offsets(length: Column, order: WindowSpec) -> Column:
    """Run lengths in ``order`` to exclusive start offsets."""
    return F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - length


def in_range(ident: Column, low: Column, high: Column) -> Column:
    return (ident >= low) & (ident < high)


# Vectors as ARRAY<DOUBLE>


def as_doubles(v: Column | str) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def square_norm(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def rounded(x: Column, digits: int = 4) -> Column:
    """Rounded, and never minus zero."""
    return F.round(x, digits) + F.lit(0.0)


def warm_up_then_decay(step: Column, base: float, warm_up: int, decay_start: int, decay_steps: int, floor: float = 1e-7) -> Column:
    """A learning rate: linear warm-up, held, then quadratic decay to ``floor`` and frozen there.

    Steps count from 1; between the end of the warm-up and the start of the decay the last rate holds.
    """
    held = base * (warm_up - 1) / warm_up if warm_up else base
    left = (F.lit(decay_start + decay_steps) - step) / F.lit(float(max(decay_steps, 1)))
    decayed = F.greatest(F.lit(floor), F.lit(base) * left * left)
    last = max(floor, base * (1.0 / max(decay_steps, 1)) ** 2)
    return (
        F.when(step < warm_up, F.lit(base) * (F.lit(1.0) - (F.lit(warm_up) - step) / F.lit(float(max(warm_up, 1)))))
        .when(step < decay_start, F.lit(held))
        .when(step < decay_start + decay_steps, decayed)
        .otherwise(F.lit(last))
    )


def power_rule(n: Column, largest_scale: Column, alpha: float) -> Column:
    """Embedding width by popularity: at least 1, rint(scale x n^-alpha)."""
    return F.greatest(F.lit(1.0), F.rint(largest_scale * F.pow(n.cast("double"), F.lit(-alpha))))


def to_power_of_two(d: Column) -> Column:
    return F.pow(F.lit(2.0), F.rint(F.log2(d)))
