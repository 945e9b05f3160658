"""Nested metadata as VARIANT: predicate trees (B10, A13) and the depth rule."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_DEPTH = 5


def nested(metadata: Column) -> Column:
    """A map of strings as one VARIANT object: values that are JSON keep their structure, others are strings."""
    return F.to_variant_object(F.transform_values(
        metadata, lambda _, v: F.coalesce(F.try_parse_json(v), v.cast("variant"))))


def _objects(values: Column) -> Column:
    return F.filter(values, lambda v: F.schema_of_variant(v).startswith("OBJECT<"))


def deeper_than(variant: Column, levels: int) -> Column:
    """Whether objects lie in objects on more than `levels` levels, the outermost being the first. Lists are values like
    any other; null for null. Level by level, the objects of the next are taken from the values of the last."""
    found = _objects(F.array(variant))
    for _ in range(levels):
        found = _objects(F.flatten(F.transform(found, lambda o: F.map_values(o.cast("map<string,variant>")))))
    return F.when(variant.isNotNull(), F.size(found) > 0)


def too_deep(metadata: Column, levels: int = MAX_DEPTH) -> Column:
    """B20 for a map of strings: only values that look like objects are parsed; the map is the first level."""
    inner = F.map_values(F.map_filter(metadata, lambda _, v: F.ltrim(v).startswith("{")))
    return F.coalesce(F.exists(F.transform(inner, F.try_parse_json), lambda v: deeper_than(v, levels - 1)), F.lit(False))


def matches(tree: dict, columns: list[str], variant: Column | None = None) -> Column:
    """A predicate tree as one condition, which Spark pushes down and prunes by like any other.

    `{"lang": "en", "n": {"$gte": 3}}` asks for all of its entries; `$and` and `$or` take lists of trees; a field takes a
    value or operators `$eq $ne $in $nin $gt $gte $lt $lte`. A field is a column of the table or a path of names, joined
    by dots, into `variant`; without a variant other fields are missing. Missing and null fields match `$ne` and `$nin`
    only. Strings are compared with a value's text, numbers with numbers. An empty tree matches every row.
    """
    parts = []
    for name, wanted in tree.items():
        if name in ("$and", "$or"):
            if not wanted:
                raise ValueError(f"{name} needs at least one condition")
            parts.append(reduce(and_ if name == "$and" else or_, [matches(t, columns, variant) for t in wanted]))
        elif name.startswith("$"):
            raise ValueError(f"unknown operator {name}")
        else:
            tests = wanted if isinstance(wanted, dict) else {"$eq": wanted}
            parts += [_test(name, op, value, columns, variant) for op, value in tests.items()]
    return reduce(and_, parts, F.lit(True))


def _test(name: str, op: str, value, columns: list[str], variant: Column | None) -> Column:
    get = lambda v: _field(name, v, columns, variant)
    equal = lambda v: F.coalesce(get(v) == _literal(v), F.lit(False))
    among = lambda vs: F.exists(F.array(*[equal(v) for v in vs]), lambda x: x) if vs else F.lit(False)
    if op == "$eq":
        return equal(value)
    if op == "$ne":
        return ~equal(value)
    if op == "$in":
        return among(list(value))
    if op == "$nin":
        return ~among(list(value))
    compare = {"$gt": Column.__gt__, "$gte": Column.__ge__, "$lt": Column.__lt__, "$lte": Column.__le__}.get(op)
    if compare is None:
        raise ValueError(f"unknown operator {op}")
    return F.coalesce(compare(get(value), _literal(value)), F.lit(False))


def _literal(value) -> Column:
    return F.lit(value).cast("decimal(38,9)") if isinstance(value, int) and not isinstance(value, bool) else F.lit(value)


def _field(name: str, value, columns: list[str], variant: Column | None) -> Column:
    """The field as the type of the value it is compared with."""
    if name in columns:
        return F.col(f"`{name}`")
    if variant is None:
        return F.lit(None)
    if not all(name.split(".")) or '"' in name:
        raise ValueError(f"not a field: {name!r}")
    path = "$" + "".join(f'["{part}"]' for part in name.split("."))
    if isinstance(value, bool):
        kinds, kind = ("BOOLEAN",), "boolean"
    elif isinstance(value, (int, float)):
        kinds, kind = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "decimal(38,9)" if isinstance(value, int) else "double"
    else:
        return F.try_variant_get(variant, path, "string")
    found = F.schema_of_variant(F.try_variant_get(variant, path, "variant"))
    return F.when(F.regexp_extract(found, "^[A-Z]+", 0).isin(*kinds), F.try_variant_get(variant, path, kind))
