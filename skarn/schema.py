"""Document schemas: declared metadata fields, their types and validation."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import types as T

MAX_SCHEMA_BYTES = 3072
MAX_RECORD_BYTES = (1 << 20) + (64 << 10)


class FieldType(Enum):
    STRING = "string"
    INT = "int"
    FLOAT = "float"
    BOOL = "bool"
    STRING_ARRAY = "string[]"
    INT_ARRAY = "int[]"

    @classmethod
    def parse(cls, name: FieldType | str) -> FieldType:
        if isinstance(name, cls):
            return name
        for t in cls:
            if t.value == name:
                return t
        raise ValueError(f"Unknown field type: {name}")

    def spark(self) -> T.DataType:
        return {
            FieldType.STRING: T.StringType(),
            FieldType.INT: T.LongType(),
            FieldType.FLOAT: T.DoubleType(),
            FieldType.BOOL: T.BooleanType(),
            FieldType.STRING_ARRAY: T.ArrayType(T.StringType()),
            FieldType.INT_ARRAY: T.ArrayType(T.LongType()),
        }[self]

    def accepts(self, value: object) -> bool:
        """Whether a JSON value is of this type. null is of none; an integer is a float too, a float no integer."""
        whole = isinstance(value, int) and not isinstance(value, bool)
        if self is FieldType.STRING:
            return isinstance(value, str)
        if self is FieldType.INT:
            return whole
        if self is FieldType.FLOAT:
            return whole or isinstance(value, float)
        if self is FieldType.BOOL:
            return isinstance(value, bool)
        if not isinstance(value, list):
            return False
        return all(isinstance(v, str) for v in value) if self is FieldType.STRING_ARRAY else all(isinstance(v, int) and not isinstance(v, bool) for v in value)


def type_of(spark_type: T.DataType) -> FieldType | None:
    """The field type that values of a Spark type have in filters."""
    if isinstance(spark_type, T.StringType):
        return FieldType.STRING
    if isinstance(spark_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return FieldType.INT
    if isinstance(spark_type, (T.FloatType, T.DoubleType, T.DecimalType)):
        return FieldType.FLOAT
    if isinstance(spark_type, T.BooleanType):
        return FieldType.BOOL
    if isinstance(spark_type, T.ArrayType):
        return {FieldType.STRING: FieldType.STRING_ARRAY, FieldType.INT: FieldType.INT_ARRAY}.get(type_of(spark_type.elementType))
    return None


@dataclass
class FieldDef:
    name: str
    type: FieldType
    nullable: bool = True


@dataclass
class Schema:
    """Declared fields. Documents may have other keys too; those are stored but not checked."""

    fields: list[FieldDef] = field(default_factory=list)

    def add_field(self, name: str, type: FieldType | str, nullable: bool = True) -> Schema:
        if self.has_field(name):
            raise ValueError(f"Field already exists: {name}")
        self.fields.append(FieldDef(name, FieldType.parse(type), nullable))
        return self

    def has_field(self, name: str) -> bool:
        return any(f.name == name for f in self.fields)

    def get_field(self, name: str) -> FieldDef | None:
        return next((f for f in self.fields if f.name == name), None)

    @classmethod
    def from_dict(cls, spec: dict[str, str | dict]) -> Schema:
        """{'name': 'int'} or {'name': {'type': 'int', 'nullable': false}}."""
        out = cls()
        for name, t in spec.items():
            if isinstance(t, dict):
                out.add_field(name, t["type"], t.get("nullable", True))
            else:
                out.add_field(name, t)
        return out

    @classmethod
    def from_json(cls, text: str) -> Schema:
        return cls.from_dict(json.loads(text))

    def to_dict(self) -> dict[str, dict]:
        return {f.name: {"type": f.type.value, "nullable": f.nullable} for f in self.fields}

    def to_json(self) -> str:
        text = json.dumps(self.to_dict())
        if len(text.encode()) >= MAX_SCHEMA_BYTES:
            raise ValueError("schema is too large")
        return text

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.type.spark(), True) for f in self.fields])

    def validate(self, metadata: dict) -> None:
        """Raises unless declared fields have their types. An explicit null has no type, so it fails."""
        for f in self.fields:
            if f.name not in metadata:
                if not f.nullable:
                    raise ValueError(f"Missing required field: {f.name}")
            elif not f.type.accepts(metadata[f.name]):
                raise ValueError(f"Field {f.name} is not of type {f.type.value}")
