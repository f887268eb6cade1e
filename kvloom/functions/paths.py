"""Slash-separated paths: a leading slash and repeated ones vanish, a final slash addresses the empty key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROOT = "root"


def parts(path: Column) -> Column:
    """The segments of a path as an array; the last is the key."""
    cut = F.split(path, "/")
    inner = F.filter(F.slice(cut, 1, F.size(cut) - 1), lambda x: x != "")
    return F.concat(inner, F.array(F.element_at(cut, -1)))


def namespace(segments: Column) -> Column:
    """The namespace that holds the key, as root/a/b."""
    return F.array_join(F.concat(F.array(F.lit(ROOT)), parent(segments)), "/")


def parent(segments: Column) -> Column:
    return F.slice(segments, 1, F.greatest(F.size(segments) - 1, F.lit(0)))


def key(segments: Column) -> Column:
    return F.element_at(segments, -1)


def prefixes(segments: Column, strict: bool = False) -> Column:
    """The ancestors of a path, itself included unless strict."""
    n = F.size(segments) - (1 if strict else 0)
    empty = F.array().cast("array<array<string>>")
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.slice(segments, 1, i))).otherwise(empty)


def resolve(path: Column) -> Column:
    """Segments of a directory path; at the start, the name root means the root itself."""
    cut = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.when(F.element_at(F.concat(cut, F.array(F.lit(""))), 1) == ROOT, F.slice(cut, 2, F.greatest(F.size(cut), F.lit(1)))).otherwise(cut)


def store_name(ns: Column) -> Column:
    """The name shown for a namespace."""
    return F.replace(ns, F.lit("/"), F.lit("_"))
