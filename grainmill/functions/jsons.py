"""JSON as text: canonical form, digests, shapes, values of a key at any depth, content that may or may not be JSON."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


@F.pandas_udf(StringType())
def canonical(text: pd.Series) -> pd.Series:
    """Keys sorted at every depth, no white space, characters as they are; null where the text is not JSON. Spark writes keys as they come."""

    def one(s):
        try:
            return None if s is None else json.dumps(json.loads(s), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    return text.map(one)


def instances(text: Column, key: str) -> Column:
    """The whole numbers that stand under a key at any depth of a JSON text, in no order. Strings that hold such text count as well."""
    return F.transform(F.regexp_extract_all(text, F.lit(rf'"{key}"\s*:\s*(-?\d+)(?![\d.eE])')), lambda x: x.try_cast("long"))


def decoded(text: Column) -> Column:
    """The value of a text that is JSON, as a variant; null where it is not."""
    return F.try_parse_json(text)


@F.pandas_udf(StringType())
def shape(text: pd.Series) -> pd.Series:
    """The kinds of a JSON value, down to four levels: object{key:kind}, array[kinds], string, integer, number, boolean, null."""

    def of(value, depth):
        if isinstance(value, dict):
            return "object" if not depth else "object{" + ",".join(f"{k}:{of(v, depth - 1)}" for k, v in sorted(value.items())) + "}"
        if isinstance(value, list):
            return "array" if not depth else "array[" + "|".join(sorted({of(v, depth - 1) for v in value})) + "]"
        return {bool: "boolean", int: "integer", float: "number", str: "string", type(None): "null"}[type(value)]

    def one(s):
        try:
            return None if s is None else of(json.loads(s), 4)
        except ValueError:
            return "malformed"

    return text.map(one)


@F.pandas_udf(ArrayType(LongType()))
def duplicate_keys(text: pd.Series) -> pd.Series:
    """[repeated keys at any depth, NaN or infinite numbers] of a JSON text; null where it is not JSON."""

    def one(s):
        twice, wrong = 0, 0

        def pairs(items):
            nonlocal twice
            twice += len(items) - len({k for k, _ in items})
            return dict(items)

        def constant(_):
            nonlocal wrong
            wrong += 1

        try:
            json.loads(s, object_pairs_hook=pairs, parse_constant=constant)
        except (ValueError, TypeError):
            return None
        return [twice, wrong]

    return text.map(one)
