"""A path language for semi-structured values: dotted names, [n], [-n], [] for every element, and ['quoted.name']."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EVERY = "*"
_STEP = re.compile(r"""\.?(?P<name>[^.\[\]]+)|\[(?P<every>\*?)\]|\[(?P<index>-?\d+)\]|\['(?P<single>[^']+)'\]|\["(?P<double>[^"]+)"\]""")


class PathError(ValueError):
    """A path that can't be read."""


def parse_path(path: str) -> list[str | int]:
    """Steps of a path: names, indexes and EVERY. Empty parts and open brackets are errors."""
    steps: list[str | int] = []
    at = 0
    if not path or path.startswith(".") or path.endswith(".") or ".." in path:
        raise PathError(f"empty part in {path!r}")
    while at < len(path):
        m = _STEP.match(path, at)
        if not m:
            raise PathError(f"can't read {path!r} at {at}")
        if m["index"] is not None:
            steps.append(int(m["index"]))
        elif m["every"] is not None:
            steps.append(EVERY)
        else:
            steps.append(m["name"] or m["single"] or m["double"])
        at = m.end()
    return steps


def _key(name: str) -> str:
    return "$['" + name.replace("'", "\\'") + "']" if "'" not in name else f'$["{name}"]'


def _steps(v: Column, steps: list[str | int]) -> Column:
    """The value at some steps; those without a place from the end are one lookup."""
    path = "$"
    for s in steps:
        if isinstance(s, int) and s < 0:
            inner = F.try_variant_get(v, path, "array<variant>")
            v, path = F.try_element_at(inner, F.lit(s)), "$"
        else:
            path += f"[{s}]" if isinstance(s, int) else _key(s)[1:]
    return F.try_variant_get(v, path, "variant") if path != "$" else v


def let(v: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f uses it."""
    return F.get(F.transform(F.array(v), f), F.lit(0))


def _apply(v: Column, sql: str) -> Column:
    """The same for an expression of v written in SQL, which is built in one step."""
    return F.get(F.call_function("transform", F.array(v), F.expr(f"v -> {sql}")), F.lit(0))


_TEXT = "CASE WHEN schema_of_variant(v) = 'STRING' OR schema_of_variant(v) RLIKE '^(BIGINT|DECIMAL|DOUBLE|INT)' THEN try_variant_get(v, '$', 'string') END"
_CONTENT = f"""CASE WHEN schema_of_variant(v) LIKE 'ARRAY%' THEN array_join(filter(transform(try_variant_get(v, '$', 'array<variant>'),
  p -> coalesce(CASE WHEN schema_of_variant(p) = 'STRING' THEN try_variant_get(p, '$', 'string') END, try_variant_get(p, '$.text', 'string'))), x -> x IS NOT NULL), '') ELSE coalesce({_TEXT}, '') END"""
_FLOAT = "CASE schema_of_variant(v) WHEN 'BOOLEAN' THEN NULL WHEN 'STRING' THEN try_cast(trim(try_variant_get(v, '$', 'string')) AS double) ELSE try_variant_get(v, '$', 'double') END"
_GOLD = """CASE schema_of_variant(v) WHEN 'BOOLEAN' THEN try_variant_get(v, '$', 'boolean')
  WHEN 'STRING' THEN CASE WHEN lower(trim(try_variant_get(v, '$', 'string'))) IN ('yes', 'true', 'y', '1') THEN true WHEN lower(trim(try_variant_get(v, '$', 'string'))) IN ('no', 'false', 'n', '0') THEN false END
  ELSE CASE try_variant_get(v, '$', 'double') WHEN 1 THEN true WHEN 0 THEN false END END"""
_ALL = f"""filter(transform(CASE WHEN schema_of_variant(v) LIKE 'ARRAY%' THEN transform(try_variant_get(v, '$', 'array<variant>'), v -> {_TEXT}) ELSE array({_TEXT}) END, x -> trim(x)), x -> length(x) > 0)"""


def resolve(v: Column, path: str) -> Column:
    """The value at a path of a variant; null where there is none. [] gives an array of what its elements have."""
    steps = parse_path(path)
    if EVERY not in steps:
        return _steps(v, steps)
    cut = steps.index(EVERY)
    items = F.try_variant_get(_steps(v, steps[:cut]), "$", "array<variant>")
    rest = steps[cut + 1 :]
    if not rest:
        return items
    if EVERY in rest:
        raise PathError("only one [] is read as an array; use nested tables for more")
    return F.filter(F.transform(items, lambda x: _steps(x, rest)), lambda x: x.isNotNull())


def kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def text(v: Column) -> Column:
    """A string value, else null; numbers as they are written."""
    return _apply(v, _TEXT)


def content_text(v: Column) -> Column:
    """Text of a message body: a string, or the text parts of a list of parts; anything else is empty."""
    return _apply(v, _CONTENT)


def as_float(v: Column) -> Column:
    """A number, also one written as text; a boolean is none."""
    return _apply(v, _FLOAT)


def gold_flag(*vs: Column) -> Column:
    """The first value that is a clear yes or no: a boolean, exactly 0 or 1, or a yes or no word; graded values are none."""
    return F.coalesce(*[_apply(v, _GOLD) for v in vs])


def first_present(v: Column, *ps: str) -> Column:
    """The first path with a value that isn't null; empty texts and lists are values."""
    got = [resolve(v, p) for p in ps]
    return F.coalesce(*[F.when(~F.is_variant_null(g), g) for g in got])


def first_text(v: Column, *ps: str) -> Column:
    """The first path with visible text."""
    texts = F.call_function("transform", F.array(*[resolve(v, p) for p in ps]), F.expr(f"v -> {_CONTENT}"))
    return F.get(F.call_function("filter", texts, F.expr("t -> length(trim(t)) > 0")), F.lit(0))


def references(v: Column, *ps: str) -> Column:
    """Reference answers: a text or a list of texts at the first path that has any visible one; else null."""
    lists = F.call_function("transform", F.array(*[resolve(v, p) for p in ps]), F.expr(f"v -> {_ALL}"))
    return F.get(F.call_function("filter", lists, F.expr("r -> size(r) > 0")), F.lit(0))
