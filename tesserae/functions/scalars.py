"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def coverage_lower_bound(hits: Column, samples: Column, z: Column) -> Column:
    """The Wilson lower bound of hits / samples: 0 without samples, the plain ratio where z is 0."""
    h, n, z = (c.cast("double") for c in (hits, samples, z))
    p = h / n
    wilson = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    return F.when(n <= 0, F.lit(0.0)).when(z == 0, p).otherwise(wilson)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double; null where a norm is zero or the dimensions differ."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def l2_normalize(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm))


def leaf_name(path: Column) -> Column:
    """The last segment of a path written with either slash."""
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def content_key_set(names: Column, sizes: Column) -> Column:
    """The key of a set of files, from names and sizes in one group."""
    return F.concat(F.lit("img:"), F.sha1(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", names, sizes.cast("string")))), "\n")))


def content_key_file(size: Column, extension: Column) -> Column:
    return F.concat(F.lit("vid:"), F.sha1(F.concat_ws(":", size.cast("string"), extension)))


def sample_budget(pages: Column, floor: float, per_root: float) -> Column:
    """Pages to look at: all up to the floor, then the floor and some for each root of the pages; rounds half to even."""
    return F.when(pages <= floor, pages.cast("int")).otherwise(F.least(pages, F.rint(F.lit(floor) + F.lit(per_root) * F.sqrt(pages))).cast("int"))


def frame_budget(seconds: Column, base: float, per_minute: float, least: float, most: float) -> Column:
    """Frames to look at; ``most`` 0 is no bound."""
    want = F.lit(base) + F.lit(per_minute) * seconds / 60
    want = F.least(want, F.lit(most)) if most > 0 else want
    return F.when(seconds <= 0, F.lit(least)).otherwise(F.greatest(F.lit(least), F.rint(want))).cast("int")


def trigrams(text: Column) -> Column:
    """The distinct trigrams of each word, padded by two spaces before and one after; words are of a to z, digits and Chinese characters."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9\u4e00-\u9fff]+"), lambda w: w != "")

    def cut(w: Column) -> Column:
        padded = F.concat(F.lit("  "), w, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(words, cut)))


def trigram_similarity(a: Column, b: Column) -> Column:
    x, y = trigrams(a), trigrams(b)
    both = F.size(F.array_union(x, y))
    return F.when(both > 0, F.size(F.array_intersect(x, y)) / both).otherwise(F.lit(0.0))


def digest(vec: Column | str) -> Column:
    """A sum over all elements of a vector, each times its place."""
    return F.aggregate(F.zip_with(vec, F.sequence(F.lit(1), F.size(vec)), lambda v, i: v * i), F.lit(0.0), lambda a, y: a + y)


def json_number(json: Column, path: str = "$") -> Column:
    return F.get_json_object(json, path).try_cast("double")
