"""Vector expressions over array<double> columns; all of them run inside Spark's generated code
or higher-order functions, none needs Python workers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Norms up to this count as zero.
EPSILON = 2.220446049250313e-16
DOUBLES = "array<double>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once for the row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def is_finite(v: Column) -> Column:
    """Non-null, not empty, and every element a finite number (false for null)."""
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) > 0) & good, F.lit(False))


def normalise(v: Column) -> Column:
    """The vector at unit length; null where it isn't finite or its norm counts as zero."""
    return let(norm(v), lambda n: F.when(is_finite(v) & (n > EPSILON) & (n < float("inf")), F.transform(v, lambda x: x / n)))


def is_unit(v: Column, tolerance: float = 1e-10) -> Column:
    return F.coalesce(F.abs(norm(v) - 1) <= tolerance, F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in [-1, 1]; null where a side has no direction."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(normalise(a), normalise(b))))


def mean(vectors: Column) -> Column:
    """Element-wise mean of an array of vectors of one dimension, which holds at least one."""
    count = F.size(vectors)
    return F.transform(F.get(vectors, F.lit(0)), lambda _, i: F.aggregate(vectors, F.lit(0.0), lambda s, v: s + F.get(v, i)) / count)


def fuse(modalities: Sequence[Column], strict: bool = False) -> Column:
    """Mean of the modalities that are there, normalised.

    Null where none is there, where the dimensions differ, where the mean has no direction, or,
    if ``strict``, where one is missing.
    """
    given = F.array_compact(F.array(*(m.cast(DOUBLES) for m in modalities)))

    def of(vs: Column) -> Column:
        first = F.size(F.get(vs, F.lit(0)))
        fits = (F.size(vs) == len(modalities)) if strict else (F.size(vs) > 0)
        same = F.forall(vs, lambda v: F.size(v) == first)
        return F.when(fits & same, normalise(mean(vs)))

    return let(given, of)


def fusion_errors(modalities: Sequence[Column], strict: bool = False) -> Column:
    """array<string> of what keeps ``fuse`` from a result; empty if nothing does."""
    given = F.array_compact(F.array(*(m.cast(DOUBLES) for m in modalities)))
    first = F.size(F.get(given, F.lit(0)))
    tests = [
        (F.size(given) == 0, "no modality available"),
        ((F.size(given) < len(modalities)) if strict else F.lit(False), "modality missing"),
        (~F.forall(given, lambda v: F.size(v) == first), "dimensions differ"),
        (~F.forall(given, is_finite), "not finite"),
        ((F.size(given) > 0) & fuse(modalities, strict).isNull(), "no direction"),
    ]
    return F.array_compact(F.array(*(F.when(t, F.lit(m)) for t, m in tests)))


def select_modalities(names: Sequence[str], known: Sequence[str] = ("text", "image", "audio", "temporal")) -> list[str]:
    """Checked list of modality names: not empty, known, and without repeats."""
    chosen = list(names)
    if not chosen or len(set(chosen)) < len(chosen) or set(chosen) - set(known):
        raise ValueError(f"modalities {chosen!r}: choose distinct names of {list(known)}")
    return chosen


def blend(a: Column, b: Column, share: Column) -> Column:
    """normalise((1 - share) * a + share * b); null where the blend has no direction."""
    return normalise(F.zip_with(a, b, lambda x, y: (1 - share) * x + share * y))


def with_noise(v: Column, level: Column, *keys: Column) -> Column:
    """The vector with uniform noise of up to ``level`` in each element, a hash of keys and place."""

    def of(x: Column, i: Column) -> Column:
        prefix = F.substring(F.sha2(F.concat_ws(":", *(k.cast("string") for k in keys), i.cast("string")), 256), 1, 8)
        return x + level * (F.conv(prefix, 16, 10).cast("double") / F.lit(4294967295.0) * 2 - 1)

    return F.transform(v, of)


def apply_matrix(rows: Sequence[Sequence[float]], v: Column) -> Column:
    """Matrix (a literal) times vector."""
    return F.array(*(dot(F.array(*map(F.lit, map(float, r))), v) for r in rows))


def fingerprint(*columns: Column) -> Column:
    """SHA-256 of the columns' JSON, a stable name for their values inside Spark."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def rounded(v: Column, digits: int = 9) -> Column:
    """Elements rounded, with -0.0 as 0.0, for comparisons between engines."""
    return F.transform(v, lambda x: F.round(x, digits) + F.lit(0.0))
