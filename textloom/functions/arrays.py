"""Padding, truncation, masks, and class choice on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def keep_first(ids: Column, n: Column | int) -> Column:
    return F.slice(ids, F.lit(1), _lit(n))


def keep_last(ids: Column, n: Column | int) -> Column:
    return F.slice(ids, F.greatest(F.size(ids) - _lit(n), F.lit(0)) + 1, _lit(n))


def drop_front_keep_first(ids: Column, longest: Column | int, n: Column | int) -> Column:
    """Cut from the front down to ``longest``, then keep the first ``n``."""
    start = F.greatest(F.size(ids) - _lit(longest), F.lit(0)) + 1
    return F.slice(ids, start, F.least(_lit(longest), _lit(n)))


def pad_end(ids: Column, n: Column | int, value=0) -> Column:
    missing = F.greatest(_lit(n) - F.size(ids), F.lit(0))
    return F.concat(ids, F.array_repeat(F.lit(value), missing))


def attention_mask(ids: Column, n: Column | int) -> Column:
    """Ones for tokens, zeros for padding; ``ids`` must not be padded yet."""
    return pad_end(F.array_repeat(F.lit(1), F.size(ids)), n)


def zero_vector(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), dim)


def l2_norm(values: Column) -> Column:
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(values: Column) -> Column:
    from .text import let

    return let(l2_norm(values), lambda norm: F.transform(values, lambda x: x / norm))


def dense(entries: Column, value: str) -> Column:
    """Field ``value`` of entries sorted by ``idx``, as an array indexed by ``idx``.

    Gaps are zero and the array ends at the last entry, so reading past it gives null.
    """

    def filled(entry: Column, i: Column) -> Column:
        last = F.coalesce(F.get(entries, i - 1)["idx"], F.lit(-1))
        return F.concat(F.array_repeat(F.lit(0.0), entry["idx"] - last - 1), F.array(entry[value]))

    return F.flatten(F.transform(entries, filled))


def class_at(probability: Column, cut: float = 0.5) -> Column:
    """1 strictly above the cut."""
    return F.when(probability > cut, 1).otherwise(0)


def argmax(scores: Column) -> Column:
    """Index of the first maximum."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def percent(share: Column) -> Column:
    """``%.2f%%`` of ``100 * share``, ties decided by the exact binary value.

    The JVM formats the shortest decimal form, half up. Where that form ends in
    a third decimal 5, the sign of what the double lacks of it is found by
    multiplying its two exact halves, and the text is rounded down if needed.
    """
    x = share * 100
    k = F.round(x * 1000)
    spread = x * 134217729.0
    high = spread - (spread - x)
    lack = (high * 1000 - k) + (x - high) * 1000
    tie = (F.round(x, 3) == x) & (F.abs(k) % 10 == 5)
    even_below = F.floor(k / 10) % 2 == 0
    down = tie & ((lack < 0) | ((lack == 0) & even_below))
    return F.format_string("%.2f%%", F.when(down, (k - 5) / 1000).otherwise(x))


def last_path_part(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _lit(n: Column | int) -> Column:
    return n if isinstance(n, Column) else F.lit(n)
