"""Typed access to one field of a record, and float comparisons.

A record is either a STRUCT of typed columns (table inputs) or a VARIANT (JSON inputs).
Every accessor yields NULL for "no value": the field is missing or has another type.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .gotext import double_text

OPS = (">", ">=", "<", "<=", "==", "!=")

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def compare(op: str, left: Column, right: float) -> Column:
    """IEEE comparison with a constant: NaN compares false, except for ``!=``."""
    if op not in OPS:
        raise ValueError(f"unknown comparison {op!r}")
    right = float(right)
    if math.isnan(right):
        return F.when(left.isNotNull(), F.lit(op == "!="))
    const = F.lit(right)
    if op == "!=":
        return left != const
    test = {">": left > const, ">=": left >= const, "<": left < const,
            "<=": left <= const, "==": left == const}[op]
    return test & ~F.isnan(left)


def steps(name: str | tuple) -> tuple:
    """A field name as the steps of its path: texts go into maps, numbers into lists."""
    return name if isinstance(name, tuple) else (name,)


def _variant_path(name: str | tuple) -> str:
    path = "$"
    for step in steps(name):
        quote = '"' if "'" in str(step) else "'"
        path += f"[{step}]" if isinstance(step, int) else f"[{quote}{step}{quote}]"
    return path


def _variant_kind(record: Column, name: str) -> tuple[Column, Column]:
    path = _variant_path(name)
    return F.schema_of_variant(F.try_variant_get(record, path, "variant")), F.lit(path)


def _struct_type(record_type: T.DataType, name: str | tuple) -> T.DataType | None:
    for step in steps(name):
        if isinstance(record_type, T.StructType) and step in record_type.names:
            record_type = record_type[step].dataType
        elif isinstance(record_type, T.ArrayType) and isinstance(step, int):
            record_type = record_type.elementType
        else:
            return None
    return record_type


def unreachable(record_type: T.DataType | None, name: str | tuple) -> str | None:
    """Why no record of a typed table can have this path: a value on the way has no such member. None for paths that are only missing."""
    here = "record"
    for step in steps(name):
        listed = isinstance(record_type, T.ArrayType)
        if listed and isinstance(step, str) or isinstance(record_type, T.StructType) and isinstance(step, int) or isinstance(
                record_type, (*_NUMERIC, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)) or (
                isinstance(record_type, T.StringType) and isinstance(step, str)):
            return f"{here} is {'a list' if listed else record_type.simpleString()}, it has no member {step!r}"
        here += f"[{step}]" if isinstance(step, int) else f".{step}"
        record_type = _struct_type(record_type, step)
    return None


def _member(record: Column, name: str | tuple) -> Column:
    """The column of a path that ``_struct_type`` knows; places beyond a list are NULL."""
    for step in steps(name):
        record = F.get(record, step) if isinstance(step, int) else record.getField(step)
    return record


def number_field(record: Column, record_type: T.DataType, name: str) -> Column:
    """DOUBLE value of a numeric field; booleans and numeric text are not numbers."""
    if isinstance(record_type, T.VariantType):
        kind, _ = _variant_kind(record, name)
        numeric = kind.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(kind, F.lit("DECIMAL"))
        return F.when(numeric, F.try_variant_get(record, _variant_path(name), "double"))
    if isinstance(_struct_type(record_type, name), _NUMERIC):
        return _member(record, name).cast("double")
    return F.lit(None).cast("double")


def text_field(record: Column, record_type: T.DataType, name: str) -> Column:
    """Text of any present field: strings as they are, other values printed."""
    if isinstance(record_type, T.VariantType):
        path = _variant_path(name)
        kind, _ = _variant_kind(record, name)
        numeric = kind.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(kind, F.lit("DECIMAL"))
        return (
            F.when(kind == "VOID", F.lit("<nil>"))
            .when(numeric, double_text(F.try_variant_get(record, path, "double")))
            .otherwise(F.try_variant_get(record, path, "string"))
        )
    kind = _struct_type(record_type, name)
    if kind is None:
        return F.lit(None).cast("string")
    value = _member(record, name)
    if isinstance(kind, (T.DoubleType, T.DecimalType)):
        return double_text(value)
    if isinstance(kind, T.FloatType):
        return double_text(value.cast("string").cast("double"))
    return value.cast("string")


def string_field(record: Column, record_type: T.DataType, name: str) -> Column:
    """The field only when it is a string."""
    if isinstance(record_type, T.VariantType):
        kind, _ = _variant_kind(record, name)
        return F.when(kind == "STRING", F.try_variant_get(record, _variant_path(name), "string"))
    if isinstance(_struct_type(record_type, name), T.StringType):
        return _member(record, name)
    return F.lit(None).cast("string")


def boolean_field(record: Column, record_type: T.DataType, name: str) -> Column:
    """The field only when it is a boolean."""
    if isinstance(record_type, T.VariantType):
        kind, _ = _variant_kind(record, name)
        return F.when(kind == "BOOLEAN", F.try_variant_get(record, _variant_path(name), "boolean"))
    if isinstance(_struct_type(record_type, name), T.BooleanType):
        return _member(record, name)
    return F.lit(None).cast("boolean")


ACCESSORS = {"number": number_field, "text": text_field, "string": string_field, "boolean": boolean_field}


def record_kind(df) -> T.DataType:
    """Type of the ``record`` column of a records DataFrame."""
    return df.schema["record"].dataType


def present_field(record: Column, record_type: T.DataType, name: str) -> Column:
    """TRUE when the field exists and is not null, else NULL."""
    if isinstance(record_type, T.VariantType):
        kind, _ = _variant_kind(record, name)
        return F.when(kind != "VOID", F.lit(True))
    if _struct_type(record_type, name) is None:
        return F.lit(None).cast("boolean")
    return F.when(_member(record, name).isNotNull(), F.lit(True))


def _elements(of: str, into: str):
    """Accessor of a list field: its elements of one kind, others left out; NULL when the field is no list."""
    kinds = ("STRING",) if of == "string" else ("BIGINT", "DOUBLE", "FLOAT", "DECIMAL")

    def read(record: Column, record_type: T.DataType, name: str | tuple) -> Column:
        if isinstance(record_type, T.VariantType):
            kind, _ = _variant_kind(record, name)
            values = F.try_variant_get(record, _variant_path(name), "array<variant>")
            fits = lambda v: F.rlike(F.schema_of_variant(v), F.lit("^(" + "|".join(kinds) + ")"))
            return F.when(F.startswith(kind, F.lit("ARRAY")), F.transform(F.filter(values, fits), lambda v: F.try_variant_get(v, "$", into)))
        kind = _struct_type(record_type, name)
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType if of == "string" else _NUMERIC):
            return _member(record, name).cast(f"array<{into}>")
        return F.lit(None).cast(f"array<{into}>")

    return read


def length_field(record: Column, record_type: T.DataType, name: str | tuple) -> Column:
    """Characters of a text or elements of a list; NULL for anything else."""
    if isinstance(record_type, T.VariantType):
        kind, _ = _variant_kind(record, name)
        listed = F.size(F.try_variant_get(record, _variant_path(name), "array<variant>"))
        return F.when(kind == "STRING", F.length(F.try_variant_get(record, _variant_path(name), "string"))).when(
            F.startswith(kind, F.lit("ARRAY")), listed)
    kind = _struct_type(record_type, name)
    if isinstance(kind, T.StringType):
        return F.length(_member(record, name))
    return F.size(_member(record, name)) if isinstance(kind, T.ArrayType) else F.lit(None).cast("int")


ACCESSORS |= {"present": present_field, "texts": _elements("string", "string"), "numbers": _elements("number", "double"), "length": length_field}


def static_kind(record_type: T.DataType | None, name: str) -> str | None:
    """Accessor kind of a typed table column; None for JSON records."""
    kind = _struct_type(record_type, name)
    if isinstance(kind, T.StringType):
        return "string"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    return "number" if isinstance(kind, _NUMERIC) else None
