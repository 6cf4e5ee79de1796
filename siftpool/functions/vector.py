"""Array-column expressions for feature vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null if either vector is zero."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y).cast("double") * (x - y).cast("double")), F.lit(0.0), lambda s, x: s + x)


def concat(*parts: Column) -> Column:
    """Vectors of several sources end to end, in the order given."""
    return F.concat(*parts)


def split(v: Column, dims: list[int]) -> list[Column]:
    """The inverse of concat for parts of known lengths."""
    out, at = [], 1
    for d in dims:
        out.append(F.slice(v, at, d))
        at += d
    return out


def softmax_concat(weights: list[float], parts: list[Column]) -> Column:
    """Each part times its softmax weight, end to end."""
    import math

    total = sum(math.exp(w) for w in weights)

    def scaled(part: Column, k: float) -> Column:
        return F.transform(part, lambda x: x.cast("double") * k)

    return F.concat(*[scaled(p, math.exp(w) / total) for w, p in zip(weights, parts, strict=True)])


def pad(v: Column, size: Column | int, value: float = 0.0) -> Column:
    """v followed by `value` up to `size` elements."""
    size = size if isinstance(size, Column) else F.lit(size)
    return F.concat(v, F.array_repeat(F.lit(value), F.greatest(size - F.size(v), F.lit(0)).cast("int")))


def padded_size(longest: Column, multiple: int = 4) -> Column:
    """The least multiple of `multiple`, less one, that holds `longest` elements and one more."""
    return F.ceil((longest + 1) / F.lit(float(multiple))) * multiple - 1


def pad_2d(rows: Column, size: Column | int, value: float = 0.0) -> Column:
    """A square matrix of `size` rows that holds `rows`, an array of arrays, in its first rows and columns."""
    size = size if isinstance(size, Column) else F.lit(size)
    empty = F.array_repeat(F.lit(value), size.cast("int"))
    wide = F.transform(rows, lambda r: pad(r, size, value))
    return F.concat(wide, F.array_repeat(empty, F.greatest(size - F.size(rows), F.lit(0)).cast("int")))


def offset_codes(codes: Column, width: int = 512) -> Column:
    """Categories of several features as codes of one table: the i-th plus 1 + i * width."""
    return F.transform(codes, lambda x, i: x + 1 + i * width)


def crop(items: Column, most: int, key: Column, seed: int = 0) -> Column:
    """At most `most` elements of an array, drawn by the key and kept in their order."""
    from siftpool.functions.math import hash_uniform

    placed = F.transform(items, lambda x, i: F.struct(hash_uniform(F.concat(key.cast("string"), F.lit("/"), i.cast("string")), seed).alias("u"), i.alias("i"), x.alias("x")))
    kept = F.slice(F.array_sort(placed), 1, most)
    return F.transform(F.array_sort(F.transform(kept, lambda p: F.struct(p["i"].alias("i"), p["x"].alias("x")))), lambda p: p["x"])


def centred(v: Column) -> Column:
    """The elements less their mean."""
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)
    return F.transform(v, lambda x: x - mean)


def mean_vector(vector: str, dim: int) -> Column:
    """The mean over a group's vectors, element by element."""
    return F.array(*[F.avg(F.col(vector)[i].cast("double")) for i in range(dim)])


def one_hot(value: Column, choices: list, unknown: bool = True) -> Column:
    """Indicators of the choices, and a last one for any other value."""
    flags = [F.coalesce(value == c, F.lit(False)).cast("int") for c in choices]
    if unknown:
        flags.append((~F.coalesce(value.isin(choices), F.lit(False))).cast("int"))
    return F.array(*flags)


def is_written(v: Column) -> Column:
    """Whether any element differs from zero."""
    return F.exists(v, lambda x: x != 0)
