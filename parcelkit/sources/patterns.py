"""Files as elements: paths with placeholders, read from Spark's own listing."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_HOLE = re.compile(r"\{(\w+)\}")


def to_regex(pattern: str, replacements: Sequence[str], values: dict[str, Sequence[str]] | None = None) -> tuple[str, list[str]]:
    """A Java regex for the pattern, and the placeholders in the order of its groups.

    A placeholder that comes again must hold the same text; * is any text within a folder, and a
    bracket expression is any one character. A placeholder with ``values`` is one of these.
    """
    keys: list[str] = []
    out, at = [], 0
    for m in re.finditer(r"\{(\w+)\}|\*+|\[!?[^\]]*\]|\?", pattern):
        out.append(re.escape(pattern[at : m.start()]))
        at = m.end()
        if not m[1]:
            out.append("[^/]*" if m[0][0] == "*" else "[^/]")
        elif m[1] not in replacements:
            raise ValueError(f"unknown placeholder: {m[1]}")
        elif m[1] in keys:
            out.append(f"\\{keys.index(m[1]) + 1}")
        else:
            keys.append(m[1])
            options = (values or {}).get(m[1])
            out.append("([^/]+?)" if options is None else f"({'|'.join(map(re.escape, sorted(options, key=len, reverse=True)))})")
    return "^" + "".join(out) + re.escape(pattern[at:]) + "$", keys


def parse(paths: DataFrame, pattern: str, replacements: Sequence[str], path: Column | None = None, values: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """The paths that fit, with the placeholders' values as columns."""
    regex, keys = to_regex(pattern, replacements, values)
    p = F.col("path") if path is None else path
    return paths.where(p.rlike(regex)).select(*[F.regexp_extract(p, regex, k + 1).alias(key) for k, key in enumerate(keys)], p.alias("path"))


def validate(patterns: dict[str, dict], replacements: Sequence[str], types: Sequence[str], mandatory: Sequence[str] = ("pattern",), optional: Sequence[str] = ("space", "format", "mask", "confounds", "mappings", "reference")) -> None:
    """Raises unless every type has a pattern, no key is stray, and some pattern has all placeholders."""
    for t in types:
        if t not in patterns:
            raise ValueError(f"no pattern for {t}")
    found: set[str] = set()
    whole = False
    for t, spec in patterns.items():
        for one in spec if isinstance(spec, list) else [spec]:
            if missing := [k for k in mandatory if k not in one]:
                raise ValueError(f"{t} lacks {missing}")
            if stray := [k for k in one if k not in (*mandatory, *optional)]:
                raise ValueError(f"{t} has stray keys: {stray}")
            holes = set(_HOLE.findall(one["pattern"]))
            if holes - set(replacements):
                raise ValueError(f"{t} has unknown placeholders: {holes - set(replacements)}")
            found |= holes
            whole |= holes == set(replacements)
    if found != set(replacements):
        raise ValueError(f"placeholders that occur in no pattern: {set(replacements) - found}")
    if not whole:
        raise ValueError("no pattern has all placeholders")


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Paths under the folder, relative to it; file contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    return found.select(F.regexp_extract("path", re.escape(folder.rstrip("/")) + "/(.*)$", 1).alias("path"))


class PatternSource:
    """Types of data as tables of paths, keyed by placeholders.

    ``patterns`` maps a type to a dict with its pattern and, nested, those of what belongs to it, or
    to a list of such dicts. ``values`` limits placeholders to what they may be.
    """

    def __init__(self, types: Sequence[str], patterns: dict, replacements: Sequence[str], files: DataFrame, partial_pattern_ok: bool = False, values: dict[str, Sequence[str]] | None = None):
        validate(patterns, replacements, types)
        self.values = values or {}
        self.types, self.patterns, self.replacements, self.files = list(types), patterns, list(replacements), files
        self.partial = partial_pattern_ok

    def _one(self, spec: dict) -> DataFrame:
        base = parse(self.files, spec["pattern"], self.replacements, values=self.values)
        keys = [c for c in base.columns if c != "path"]
        most = base.groupBy(*keys).count().agg(F.max("count")).first()[0]
        if most is None:
            raise ValueError(f"no file fits {spec['pattern']}")
        if most > 1:
            raise ValueError(f"more than one file of an element fits {spec['pattern']}")
        for name, nested in spec.items():
            if isinstance(nested, dict) and "pattern" in nested:
                inner = parse(self.files, nested["pattern"], self.replacements, values=self.values)
                on = [c for c in inner.columns if c != "path" and c in keys]
                struct = F.struct(F.col("path").alias("path"), *[F.lit(v).alias(k) for k, v in nested.items() if isinstance(v, str) and k != "pattern"])
                base = base.join(inner.select(*on, struct.alias(name)), on, "left" if self.partial else "inner")
        extra = [F.lit(v).alias(k) for k, v in spec.items() if isinstance(v, str) and k != "pattern"]
        return base.select("*", *extra)

    def data(self, kind: str) -> DataFrame:
        """Keys, path and nested structs of a type; a list of patterns gives an array of structs."""
        spec = self.patterns[kind]
        if not isinstance(spec, list):
            return self._one(spec)
        parts = []
        for k, one in enumerate(spec):
            df = self._one(one)
            keys = [c for c in df.columns if c in self.replacements]
            parts.append(df.select(*keys, F.struct(F.lit(k).alias("place"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in ("path", "src", "dst")]).alias("item")))
        every = reduce(DataFrame.unionByName, parts)
        keys = [c for c in every.columns if c != "item"]
        return every.groupBy(*keys).agg(F.array_sort(F.collect_list("item")).alias("items"))

    def elements(self) -> DataFrame:
        """Elements that every type has: the type with most keys, reduced by the others on the keys they share."""
        found = sorted((self.data(t) for t in self.types), key=lambda d: -sum(c in self.replacements for c in d.columns))
        out = found[0].select(*[k for k in self.replacements if k in found[0].columns]).distinct()
        for other in found[1:]:
            out = semi(out, other, [k for k in out.columns if k in other.columns])
        return out

    def __getitem__(self, element: dict | Sequence[str]) -> dict[str, DataFrame]:
        values = element if isinstance(element, dict) else dict(zip(self.replacements, element, strict=True))
        return {t: reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]) if kv[0] in d.columns else d, values.items(), self.data(t)) for t in self.types}


def semi(elements: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Elements whose shared keys occur in ``other``."""
    return elements.join(other.select(*keys).distinct(), list(keys), "left_semi")
