"""Registering Python functions as SQL functions, their types read from the hints."""

from __future__ import annotations

import functools
import typing
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import types as T

_SIMPLE = {int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bool: T.BooleanType(), bytes: T.BinaryType()}


def spark_type(hint: object) -> T.DataType:
    """The Spark type of a Python hint: int, float, str, bool, bytes, X | None, list[X], dict[K, V]."""
    if hint in _SIMPLE:
        return _SIMPLE[hint]
    args = [a for a in typing.get_args(hint) if a is not type(None)]
    origin = typing.get_origin(hint)
    if origin is list:
        return T.ArrayType(spark_type(args[0]))
    if origin is dict:
        return T.MapType(spark_type(args[0]), spark_type(args[1]))
    if len(args) == 1:
        return spark_type(args[0])
    raise TypeError(f"no Spark type for {hint!r}")


def signature(f: Callable) -> tuple[list[T.DataType], T.DataType]:
    hints = typing.get_type_hints(f)
    if "return" not in hints:
        raise TypeError("the function's result needs a type hint")
    result = hints.pop("return")
    return [spark_type(h) for h in hints.values()], spark_type(result)


def register(spark: SparkSession, name: str, f: Callable):
    """Makes ``f`` callable in SQL; values travel in Arrow batches. A value comes as its hint says: numbers given where text is
    hinted come as text, whole numbers where a float is hinted as floats, and so on inside lists and maps."""
    from pyspark.sql.functions import udf

    takes, result = signature(f)
    casts = [_cast(t) for t in takes]

    @functools.wraps(f)
    def typed(*values):
        return f(*(cast(v) for cast, v in zip(casts, values, strict=True)))

    typed.__annotations__ = {}
    return spark.udf.register(name, udf(typed, result, useArrow=True))


def _cast(kind: T.DataType) -> Callable:
    """A value to the Python type that stands for the Spark type; null stays null."""
    if isinstance(kind, T.ArrayType):
        inner = _cast(kind.elementType)
        return lambda v: None if v is None else [inner(x) for x in v]
    if isinstance(kind, T.MapType):
        key, value = _cast(kind.keyType), _cast(kind.valueType)
        return lambda v: None if v is None else {key(k): value(x) for k, x in dict(v).items()}
    python = {t: p for p, t in _SIMPLE.items()}[kind]
    return lambda v: v if v is None or isinstance(v, python) and not (python is int and isinstance(v, bool)) else python(v)
