"""Vectors as arrays: list literals, carriers, complex parts, amplitudes and phases.

Raw integers come in pairs: slot 2p is the imaginary, slot 2p + 1 the real part of pair p.
All functions are built-in expressions; a null vector gives null.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pair positions of the carriers in a raw buffer of 192 pairs.
LLTF_PAIRS = [*range(6, 32), *range(33, 59)]
HTLTF_PAIRS = [64 + p for p in (*range(2, 59), *range(70, 127))]
OVERLAP_LLTF = list(range(52))
OVERLAP_HTLTF = [*range(4, 30), *range(84, 110)]
RAW_INTS = 384
VARIANTS = {"lltf_only": LLTF_PAIRS, "htltf_only": HTLTF_PAIRS, "lltf_htltf": LLTF_PAIRS + HTLTF_PAIRS}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def parse_list(text: Column | str) -> Column:
    """Integers of a list literal; null where it doesn't parse."""
    return F.from_json(text, "array<int>")


def list_text(v: Column | str) -> Column:
    """The list literal of integers, without spaces."""
    v = F.col(v) if isinstance(v, str) else v
    return F.concat(F.lit("["), F.array_join(v.cast("array<string>"), ","), F.lit("]"))


def gather(v: Column | str, positions: Sequence[int]) -> Column:
    """The elements at 0-based positions, in their order."""
    v = F.col(v) if isinstance(v, str) else v
    return F.when(v.isNotNull(), F.transform(F.array(*map(F.lit, positions)), lambda i: F.get(v, i)))


def gather_pairs(v: Column | str, pairs: Sequence[int]) -> Column:
    """Both integers of each pair, flat."""
    return gather(v, [s for p in pairs for s in (2 * p, 2 * p + 1)])


def part(v: Column | str, offset: int) -> Column:
    """Every second element from 0-based ``offset``."""
    v = F.col(v) if isinstance(v, str) else v
    return F.filter(v, lambda _, i: i % 2 == offset)


def imag(v: Column | str) -> Column:
    return part(v, 0)


def real(v: Column | str) -> Column:
    return part(v, 1)


def amplitude(re: Column | str, im: Column | str) -> Column:
    return F.zip_with(re, im, lambda a, b: F.sqrt(a.cast("double") * a + b.cast("double") * b))


def phase(re: Column | str, im: Column | str) -> Column:
    """Angles in (-pi, pi]."""
    return F.zip_with(im, re, lambda b, a: F.atan2(b.cast("double"), a.cast("double")))


def sin_cos(angles: Column) -> Column:
    """Sines, then cosines."""
    return F.concat(F.transform(angles, F.sin), F.transform(angles, F.cos))


def conj_product(ar: Column, ai: Column, br: Column, bi: Column) -> tuple[Column, Column]:
    """Real and imaginary part of a * conj(b), of scalars."""
    return ar * br + ai * bi, ai * br - ar * bi


def realify(re: Column, im: Column, mode: str) -> Column:
    """``real``, ``abs-real`` or ``magnitude`` of a complex scalar."""
    if mode == "real":
        return re
    if mode == "abs-real":
        return F.abs(re)
    if mode == "magnitude":
        return F.sqrt(re * re + im * im)
    raise ValueError(f"unknown mode {mode}")


def mean(v: Column | str) -> Column:
    """Mean of a vector, null for an empty one."""
    v = F.col(v) if isinstance(v, str) else v
    return F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v))


def median(v: Column) -> Column:
    """Median of a vector, null for an empty one; the two middle elements are averaged."""
    return let(
        F.array_sort(v),
        lambda s: F.when(F.size(s) > 0, (F.get(s, ((F.size(s) - 1) / 2).cast("int")) + F.get(s, (F.size(s) / 2).cast("int"))) / 2),
    )


def standardise(v: Column | str, means: Column | str, stds: Column | str) -> Column:
    """(x - mean) / std by element."""
    centred = F.zip_with(v, means, lambda x, m: x - m)
    return F.zip_with(centred, stds, lambda x, s: x / s)


def first_argmax(v: Column | str) -> Column:
    """0-based position of the largest element, the lowest on ties."""
    return F.array_position(v, F.array_max(v)) - 1
