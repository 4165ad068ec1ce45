"""The JSON predicate language, compiled to Spark columns.

Conditions are {field: value}, {field: {op: value}}, {"$and": [...]} and {"$or": [...]}. A leaf is null or
false where it doesn't hold, and there is no negation, so a filter needs no wrapping and its leaves on
typed columns reach the Parquet scan.
"""

from __future__ import annotations

import dataclasses
import functools
import json
import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skarn.schema import FieldType, type_of

LEAVES = ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin", "$contains")


@dataclass
class Condition:
    """A node: $and, $or or $not with children, or a leaf with field and value. `$true` always holds."""

    op: str
    field: str = ""
    value: object = None
    children: list[Condition] = dataclasses.field(default_factory=list)


def parse_filter(source: str | dict | Condition | None, strict: bool = False) -> Condition:
    """The tree of a filter, given as JSON text or as what it means. An empty text is no filter; {} matches nothing.

    All keys of an object and all operators of a field must hold. With strict, only the first counts:
    $and, else $or, else the alphabetically first key, and of that the alphabetically first operator.
    """
    if isinstance(source, Condition):
        return source
    if source is None or source == "":
        return Condition("$true")
    spec = json.loads(source) if isinstance(source, str) else source
    if not isinstance(spec, dict):
        raise ValueError("a filter must be a JSON object")
    return _parse(spec, strict)


def _parse(spec: dict, strict: bool) -> Condition:
    if not spec:
        return Condition("$eq", "", None)
    keys = sorted(spec)
    if strict:
        keys = [next((k for k in ("$and", "$or") if k in spec), keys[0])]
    parts = []
    for key in keys:
        value = spec[key]
        if key in ("$and", "$or"):
            if not isinstance(value, list):
                raise ValueError(f"{key} needs a list")
            parts.append(Condition(key, children=[_parse(c, strict) for c in value]))
        elif isinstance(value, dict):
            ops = sorted(value)
            if not ops:
                parts.append(Condition("$eq", key, None))
            for op in ops[:1] if strict else ops:
                if op not in LEAVES:
                    raise ValueError(f"Unknown filter operator: {op}")
                parts.append(Condition(op, key, value[op]))
        else:
            parts.append(Condition("$eq", key, value))
    return parts[0] if len(parts) == 1 else Condition("$and", children=parts)


def parse_legacy(spec: str | dict) -> Condition:
    """The older form: {"field", "op", "value"}, and "and", "or" (lists) and "not" (one condition)."""
    spec = json.loads(spec) if isinstance(spec, str) else spec
    for key in ("and", "or"):
        if key in spec:
            return Condition(f"${key}", children=[parse_legacy(c) for c in spec[key]])
    if "not" in spec:
        return Condition("$not", children=[parse_legacy(spec["not"])])
    names = {"==": "eq", "=": "eq", "!=": "ne", ">": "gt", ">=": "gte", "<": "lt", "<=": "lte"}
    op = "$" + names.get(spec["op"], spec["op"].lstrip("$"))
    if op not in LEAVES:
        raise ValueError(f"Unknown filter operator: {spec['op']}")
    return Condition(op, spec["field"], spec.get("value"))


def from_match_range(spec: dict | None, array_fields: frozenset[str] | set[str] = frozenset()) -> dict | None:
    """Conditions of the match/range form ({"and": [{field: {"match": {"value": x}}}, ...]}) as a filter.

    A match on an array field becomes $contains. Other kinds of condition, as geo, are left out.
    """
    out: list[dict] = []
    for cond in (spec or {}).get("and", []):
        for name, kind in cond.items():
            if "match" in kind:
                value = kind["match"].get("value")
                out.append({name: {"$contains": value} if name in array_fields else value})
            elif "range" in kind:
                out.append({name: {f"${k}": kind["range"][k] for k in ("gte", "gt", "lte", "lt") if k in kind["range"]}})
    return None if not out else out[0] if len(out) == 1 else {"$and": out}


def selectivity(cond: Condition) -> float:
    """A rough estimate of the part of rows that a condition keeps."""
    if cond.op == "$true":
        return 1.0
    if cond.op == "$and":
        return functools.reduce(operator.mul, map(selectivity, cond.children), 1.0)
    if cond.op == "$or":
        return min(1.0, sum(map(selectivity, cond.children)))
    if cond.op == "$not":
        return 1.0 - selectivity(cond.children[0])
    return {"$eq": 0.1, "$ne": 0.9, "$in": 0.2, "$nin": 0.8, "$contains": 0.1}.get(cond.op, 0.3)


class _Value:
    """A field of a row, as each type it can have. None stands for a type that it never has."""

    has: Column
    string: Column | None = None
    whole: Column | None = None
    real: Column | None = None
    flag: Column | None = None
    strings: Column | None = None
    wholes: Column | None = None

    @property
    def number(self) -> list[Column]:
        return [c.cast("double") for c in (self.whole, self.real) if c is not None]


class _Typed(_Value):
    """A column: its type is known, and null means that the key is missing."""

    def __init__(self, column: Column, kind: FieldType | None) -> None:
        self.has = column.isNotNull()
        at = {FieldType.STRING: "string", FieldType.INT: "whole", FieldType.FLOAT: "real", FieldType.BOOL: "flag", FieldType.STRING_ARRAY: "strings", FieldType.INT_ARRAY: "wholes"}.get(kind)
        if at:
            setattr(self, at, column)


class _Dynamic(_Value):
    """A key of a JSON document: the type is each row's own."""

    def __init__(self, document: Column, key: str) -> None:
        name = key.replace("\\", "\\\\").replace('"', '\\"')
        v = F.try_variant_get(document, f'$["{name}"]', "variant")
        kind = F.schema_of_variant(v)
        self.has = v.isNotNull()

        def when(pattern: str, t: str) -> Column:
            return F.when(kind.rlike(pattern), F.try_variant_get(document, f'$["{name}"]', t))

        self.string = when("^STRING$", "string")
        self.whole = when("^(TINYINT|SMALLINT|INT|BIGINT)$", "bigint")
        self.real = when("^(FLOAT|DOUBLE|DECIMAL.*)$", "double")
        self.flag = when("^BOOLEAN$", "boolean")
        self.strings = when("^ARRAY<STRING>$", "array<string>")
        self.wholes = when("^ARRAY<(TINYINT|SMALLINT|INT|BIGINT)>$", "array<bigint>")


class _Missing(_Value):
    def __init__(self) -> None:
        self.has = F.lit(False)


def _any(parts: list[Column]) -> Column:
    return functools.reduce(operator.or_, parts) if parts else F.lit(False)


_COMPARE = {"$eq": operator.eq, "$gt": operator.gt, "$gte": operator.ge, "$lt": operator.lt, "$lte": operator.le}


def _compare(v: _Value, op: str, x: object, strict: bool) -> Column:
    """Comparison of values of one type; anything else doesn't hold."""
    test = _COMPARE[op]
    if isinstance(x, bool):
        if v.flag is None:
            return F.lit(False)
        if op == "$eq":
            return v.flag == F.lit(x)
        if not strict:
            raise ValueError(f"{op} has no meaning for a boolean")
        return {"$gt": v.flag != F.lit(x), "$gte": v.flag.isNotNull(), "$lt": F.lit(False), "$lte": v.flag == F.lit(x)}[op]
    if isinstance(x, str):
        return test(v.string, F.lit(x)) if v.string is not None else F.lit(False)
    if isinstance(x, int):
        parts = [test(v.whole, F.lit(x).cast("bigint"))] if v.whole is not None else []
        if v.real is not None:
            parts.append(test(v.real.cast("bigint"), F.lit(x).cast("bigint")) if strict else test(v.real.cast("double"), F.lit(float(x))))
        return _any(parts)
    if isinstance(x, float):
        return _any([test(c, F.lit(x)) for c in v.number])
    return F.lit(False)


def _among(v: _Value, values: object) -> Column:
    if not isinstance(values, list):
        return F.lit(False)
    if values and isinstance(values[0], str):
        mine = [x for x in values if isinstance(x, str)]
        return v.string.isin(mine) if v.string is not None and mine else F.lit(False)
    mine = [int(x) for x in values if isinstance(x, (int, float)) and not isinstance(x, bool)]
    return v.whole.isin(mine) if v.whole is not None and mine else F.lit(False)


def _leaf(v: _Value, op: str, x: object, strict: bool) -> Column:
    if op == "$ne":  # a value of another type differs
        same = _compare(v, "$eq", x, strict)
        return v.has & ~F.coalesce(same, F.lit(False))
    if op == "$in":
        return _among(v, x)
    if op == "$nin":
        return v.has & ~F.coalesce(_among(v, x), F.lit(False))
    if op == "$contains":
        if isinstance(x, str):
            return F.array_contains(v.strings, x) if v.strings is not None else F.lit(False)
        if isinstance(x, int) and not isinstance(x, bool):
            return F.array_contains(v.wholes, F.lit(x).cast("bigint")) if v.wholes is not None else F.lit(False)
        return F.lit(False)
    return _compare(v, op, x, strict)


def compile_filter(source: str | dict | Condition | None, schema: T.StructType, json_column: str | None = None, strict: bool = False) -> Column:
    """The condition as a column: true where it holds, false or null elsewhere, so for use in filter().

    Fields of the schema are typed columns, where null means that the key is missing. Other fields are looked
    up in json_column (JSON text), if that is given; without it they are missing everywhere.
    """
    types = {f.name: type_of(f.dataType) for f in schema.fields}
    document = F.try_parse_json(F.col(json_column)) if json_column else None

    def value(name: str) -> _Value:
        if name in types and name != json_column:
            return _Typed(F.col(f"`{name}`"), types[name])
        return _Dynamic(document, name) if document is not None and name else _Missing()

    def build(c: Condition) -> Column:
        if c.op == "$true":
            return F.lit(True)
        if c.op == "$and":
            return functools.reduce(operator.and_, map(build, c.children), F.lit(True)) if c.children else F.lit(True)
        if c.op == "$or":
            return _any([build(x) for x in c.children])
        if c.op == "$not":
            return ~F.coalesce(build(c.children[0]), F.lit(False))
        return _leaf(value(c.field), c.op, c.value, strict)

    return build(parse_filter(source, strict))


def matches(source: str | dict | Condition | None, schema: T.StructType, json_column: str | None = None, strict: bool = False) -> Column:
    """The condition as a column that is never null."""
    return F.coalesce(compile_filter(source, schema, json_column, strict), F.lit(False))


def where(df: DataFrame, source: str | dict | Condition | None, json_column: str | None = None, strict: bool = False) -> DataFrame:
    """The rows of df that a filter matches."""
    cond = parse_filter(source, strict)
    return df if cond.op == "$true" else df.filter(compile_filter(cond, df.schema, json_column, strict))
