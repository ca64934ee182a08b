"""Column builders: vectors, tags, keysets. All are built-in expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: white space as Python's str.split sees it
UNICODE_SPACE = "[\\s\\x1c-\\x1f\\x85\\p{Z}]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for a row: an expression used in a lambda is else computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def doubles(vec: Column) -> Column:
    return vec.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double, from left to right."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(vec: Column) -> Column:
    return F.sqrt(dot(vec, vec))


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def l2_normalize(vec: Column) -> Column:
    """Unit vector in double; zeros where the norm is 0 or not finite."""
    unit = lambda v, n: F.when(finite(n) & (n > 0), F.transform(v, lambda x: x / n)).otherwise(F.transform(v, lambda x: F.lit(0.0)))
    return let(doubles(vec), lambda v: let(norm(v), lambda n: unit(v, n)))


def cosine(a: Column, b: Column) -> Column:
    """0 where either norm is 0."""
    of = lambda x, y, nx, ny: F.when((nx == 0) | (ny == 0), F.lit(0.0)).otherwise(F.try_divide(dot(x, y), nx * ny))
    return let(F.struct(norm(a).alias("a"), norm(b).alias("b")), lambda n: of(a, b, n["a"], n["b"]))


def clip_norm(vec: Column, most: float) -> Column:
    """vec scaled down to norm `most` if its norm is finite and greater (most > 0)."""
    clipped = lambda v, n: F.when(finite(n) & (n > most) & (F.lit(most) > 0), F.transform(v, lambda x: x * (F.lit(most) / n))).otherwise(v)
    return let(doubles(vec), lambda v: let(norm(v), lambda n: clipped(v, n)))


def f16_round(x: Column) -> Column:
    """x rounded to half precision, half to even; for |x| < 65520."""
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(x))), F.lit(-14)) - 10)
    return F.when((x == 0) | x.isNull(), x).otherwise(F.rint(x / step) * step)


def blend(cf: Column, tag: Column, w_cf: Column | float, w_tag: Column | float) -> Column:
    """norm(w_cf * norm(cf) + w_tag * norm(tag)) in double."""
    w_cf, w_tag = (w if isinstance(w, Column) else F.lit(float(w)) for w in (w_cf, w_tag))
    return l2_normalize(F.zip_with(l2_normalize(cf), l2_normalize(tag), lambda x, y: w_cf * x + w_tag * y))


def tokens(tag_string: Column) -> Column:
    """The tags of a string, in order, repeats kept."""
    return F.filter(F.split(F.coalesce(tag_string, F.lit("")), UNICODE_SPACE), lambda x: x != "")


def multiplier(category: Column, weights: dict[int, float]) -> Column:
    """Weight of a category, 1.0 for one that has none."""
    return reduce(lambda c, kv: c.when(category == kv[0], F.lit(float(kv[1]))), sorted(weights.items()), F.when(F.lit(False), F.lit(1.0))).otherwise(F.lit(1.0))


def idf(n_posts: Column | int, post_count: Column) -> Column:
    n = n_posts if isinstance(n_posts, Column) else F.lit(n_posts)
    return F.ln((n.cast("double") + 1.0) / (post_count.cast("double") + 1.0)) + 1.0


def keyset_after(columns: list[str], values: list) -> Column:
    """(columns) > (values) in lexicographic order, in a form that reaches the Parquet scan."""
    out = F.lit(False)
    for k in range(len(columns)):
        same = reduce(lambda a, b: a & b, (F.col(c) == F.lit(v) for c, v in zip(columns[:k], values)), F.lit(True))
        out = out | (same & (F.col(columns[k]) > F.lit(values[k])))
    return out
