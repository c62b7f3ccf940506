"""Array arithmetic as built-in expressions, for vectors of any length."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it inside ``body``.

    An expression named inside a lambda is otherwise worked out again for every
    array element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(v: Column | str) -> Column:
    return F.aggregate(_col(v), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y))


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine; 0 when either vector is all zero."""
    return let(
        norm(a) * norm(b),
        lambda size: F.when(size == 0, F.lit(0.0)).otherwise(
            dot(a, b) / F.nullif(size, F.lit(0.0))
        ),
    )


def unit(v: Column | str) -> Column:
    """L2-normalised copy; a zero vector stays zero."""
    v = _col(v)
    return let(
        norm(v),
        lambda size: F.transform(
            v, lambda x: F.when(size == 0, F.lit(0.0)).otherwise(x / F.nullif(size, F.lit(0.0)))
        ),
    )


def euclidean(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(
        total(
            F.zip_with(
                _col(a),
                _col(b),
                lambda x, y: (x.cast("double") - y) * (x.cast("double") - y),
            )
        )
    )


def floor_and_scale(v: Column | str, floor: float = 1e-10) -> Column:
    """Raise every weight to at least ``floor`` and make the weights sum to 1."""
    raised = F.transform(_col(v), lambda x: F.greatest(x, F.lit(floor)))
    return let(
        raised,
        lambda r: let(total(r), lambda size: F.transform(r, lambda x: x / size)),
    )


def jensen_shannon(p: Column | str, q: Column | str, base: float = math.e) -> Column:
    """Jensen-Shannon distance (the square root) of two strictly positive
    distributions; natural logarithm unless another base is given."""
    pairs = F.zip_with(_col(p), _col(q), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    kl = F.aggregate(
        pairs,
        F.lit(0.0),
        lambda s, e: s
        + e["x"] * F.log(2 * e["x"] / (e["x"] + e["y"]))
        + e["y"] * F.log(2 * e["y"] / (e["x"] + e["y"])),
    )
    return F.sqrt(F.greatest(kl / (2 * math.log(base)), F.lit(0.0)))
