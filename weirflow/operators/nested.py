"""Flat relational tables from deeply nested records.

A merged schema of all records is inferred first: every path with the kinds of
value found there. Each path at which an array occurs becomes a child table;
its rows carry a surrogate key, the key of the parent row and their place in
the parent's array. An object or single value in place of an array is an array
of one.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_PATHS = 20_000


@dataclass(frozen=True)
class MergedSchema:
    """Path -> kinds of value found there, over all records; array levels don't show in paths."""

    kinds: dict[str, frozenset[str]]

    def array_paths(self) -> list[str]:
        return sorted((p for p, k in self.kinds.items() if p and "array" in k), key=lambda p: (p.count("."), p))

    def fields(self, path: str) -> list[str]:
        """Paths of scalar fields below ``path`` that lie in no deeper array."""
        arrays = self.array_paths()
        head = f"{path}." if path else ""
        found = []
        for p, kinds in self.kinds.items():
            if p.startswith(head) and p != path and kinds & {"string", "number", "boolean"}:
                if not any((p == a or p.startswith(f"{a}.")) and a.startswith(head) and a != path for a in arrays):
                    found.append(p)
        return sorted(found)


def _walk(value: object, path: str, found: set[tuple[str, str]]) -> None:
    stack = [(value, path)]
    while stack:
        v, p = stack.pop()
        if isinstance(v, dict):
            found.add((p, "object"))
            stack += [(x, f"{p}.{k}" if p else k) for k, x in v.items()]
        elif isinstance(v, list):
            found.add((p, "array"))
            stack += [(x, p) for x in v]
        elif v is not None:
            found.add((p, "boolean" if isinstance(v, bool) else "string" if isinstance(v, str) else "number"))


def _object(text: str | None) -> dict | None:
    """The JSON object of a text, even one wrapped as a JSON string."""
    try:
        value = json.loads(text)
        if isinstance(value, str):
            value = json.loads(value)
    except (ValueError, TypeError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: set[tuple[str, str]] = set()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            value = _object(text)
            if value is not None:
                _walk(value, "", found)
    rows = sorted(found)
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], ["path", "kind"])


def infer_merged_schema(df: DataFrame, json_column: str, max_paths: int = MAX_PATHS) -> MergedSchema:
    """The merged schema of all records of a JSON column; texts that hold no JSON object add nothing.

    Each partition sends its distinct paths only. More than ``max_paths``
    paths mean that data stand in field names, which is an error.
    """
    rows = df.select(json_column).mapInArrow(_paths, "path string, kind string").distinct().limit(max_paths + 1).collect()
    if len(rows) > max_paths:
        raise ValueError(f"more than {max_paths} paths: field names hold data")
    kinds = defaultdict(set)
    for path, kind in rows:
        kinds[path].add(kind)
    return MergedSchema({p: frozenset(k) for p, k in kinds.items()})


def schema_of_type(kind: T.DataType, path: str = "") -> dict[str, frozenset[str]]:
    """Paths and kinds of a column type, for records that are no text; no row is read."""
    if isinstance(kind, T.StructType):
        found = {path: frozenset({"object"})}
        for f in kind.fields:
            found |= schema_of_type(f.dataType, f"{path}.{f.name}" if path else f.name)
        return found
    if isinstance(kind, T.ArrayType):
        below = schema_of_type(kind.elementType, path)
        return below | {path: below[path] | {"array"}}
    return {path: frozenset({"string" if isinstance(kind, T.StringType) else "boolean" if isinstance(kind, T.BooleanType) else "number"})}


def json_object(text: Column) -> Column:
    """The text's JSON object as a variant, even one wrapped as a JSON string; null if it is none.

    The first sign tells objects from other values, so each text is parsed once.
    """
    is_object = lambda t: t.rlike(r"\A[ \t\r\n]*\{")
    inner = F.try_variant_get(F.when(text.rlike(r"\A[ \t\r\n]*\""), F.try_parse_json(text)), "$", "string")
    return F.when(is_object(text), F.try_parse_json(text)).when(is_object(inner), F.try_parse_json(inner))


def _path(parts: list[str]) -> str:
    return "$" + "".join("['" + p.replace("\\", "\\\\").replace("'", "\\'") + "']" for p in parts)


def elements(value: Column) -> Column:
    """The elements of an array; any other value but null as an array of one."""
    whole = F.try_variant_get(value, "$", "array<variant>")
    return F.coalesce(whole, F.when(value.isNotNull() & ~F.is_variant_null(value), F.array(value)))


def flatten_records(roots: DataFrame, value: str, schema: MergedSchema, key: Column) -> dict[str, DataFrame]:
    """Tables by path: '' for the records, and one for each path at which an array occurs.

    Columns: ``_sk`` (surrogate key), ``_parent_sk``, ``_pos`` (place in the
    parent's array from 0, null elements counted), ``_value`` (the element as a
    variant), the columns of ``roots`` but for the record itself, and the
    parent's own element as ``_parent``. Null elements keep their place but
    give no row. Repeated records give repeated rows with equal keys.
    """
    keep = [F.col(c) for c in roots.columns if c != value]
    root = roots.select(
        F.sha2(F.concat_ws("\x1f", F.lit(""), key), 256).alias("_sk"), F.lit(None).cast("string").alias("_parent_sk"),
        F.lit(0).alias("_pos"), F.col(value).alias("_value"), F.lit(None).cast("variant").alias("_parent"), *keep,
    ).where(F.col("_value").isNotNull())
    tables = {"": root}
    arrays = schema.array_paths()
    for path in arrays:
        above = max((a for a in ["", *arrays] if a != path and (a == "" or path.startswith(f"{a}."))), key=len)
        parts = path[len(above) :].lstrip(".").split(".")
        held = F.try_variant_get("_value", _path(parts), "variant")
        rows = tables[above].select(
            F.col("_sk").alias("_parent_sk"), F.col("_value").alias("_parent"), *keep, F.posexplode(elements(held)).alias("_pos", "_value")
        )
        rows = rows.where(F.col("_value").isNotNull() & ~F.is_variant_null("_value"))
        sk = F.sha2(F.concat_ws("\x1f", "_parent_sk", F.lit(path), F.col("_pos")), 256)
        tables[path] = rows.select(sk.alias("_sk"), "_parent_sk", "_pos", "_value", "_parent", *keep)
    return tables


def field(column: str, *parts: str) -> Column:
    """The scalar at a path of a variant column as text; null for objects, arrays and what is missing."""
    at = F.try_variant_get(column, _path(list(parts)), "variant")
    whole = F.try_variant_get(at, "$", "array<variant>").isNotNull() | F.try_variant_get(at, "$", "map<string,variant>").isNotNull()
    return F.when(~whole, F.try_variant_get(at, "$", "string"))


def scalar_columns(child: DataFrame, path: str, schema: MergedSchema) -> DataFrame:
    """A child table with each scalar field of the merged schema as a text column named by its dotted path."""
    head = f"{path}." if path else ""
    named = [(p, p[len(head) :]) for p in schema.fields(path)]
    return child.select("_sk", "_parent_sk", "_pos", *[field("_value", *rest.split(".")).alias(rest.replace(".", "__")) for _, rest in named])
