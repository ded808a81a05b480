"""JSON of any shape as columns: kinds of values and entries of a VARIANT, and a bounded copy of a text."""

from __future__ import annotations

import json
import math
from itertools import islice

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Bounds of a copy, and what stands for values below the deepest level.
MAX_DEPTH, MAX_KEYS, MAX_KEY, MAX_ITEMS = 12, 200, 100, 500
TOO_DEEP = "<maximum nesting reached>"


def parsed(text: Column) -> Column:
    """The value of a JSON text; null where it is none."""
    return F.from_json(text, "variant")


def kind(v: Column) -> Column:
    """missing, null, bool, int, float, text, list or map."""
    of = F.schema_of_variant(v)
    # whole numbers beyond 64 bits are decimals; shorter decimals without a fraction were written with one
    large = F.regexp_like(of, F.lit(r"^DECIMAL\((19|[23][0-9]),0\)$"))
    return (
        F.when(v.isNull(), "missing").when(of == "VOID", "null").when(of == "BOOLEAN", "bool").when((of == "BIGINT") | large, "int").when(of == "STRING", "text")
        .when(of.startswith("ARRAY"), "list").when(of.startswith("OBJECT"), "map").otherwise("float")
    )


def field(v: Column, name: str) -> Column:
    """The value of a key, null where v is no map or has no such key."""
    return F.try_variant_get(v, f'$["{name}"]', "variant")


# These tests look at v once each, so that rules made of many of them stay small plans.
_KINDS = {
    "bool": "BOOLEAN", "text": "STRING", "map": "OBJECT.*", "list": "ARRAY.*", "int": r"BIGINT|DECIMAL\((19|[23][0-9]),0\)",
    "number": r"BIGINT|DOUBLE|FLOAT|DECIMAL\(.*\)",
}


def is_kind(v: Column, name: str) -> Column:
    """Whether v is a bool, text, map, list, int or number; false where it is missing."""
    return F.coalesce(F.regexp_like(F.schema_of_variant(v), F.lit(f"(?s)^({_KINDS[name]})$")), F.lit(False))


def is_null(v: Column) -> Column:
    """Missing or null."""
    return F.coalesce(F.schema_of_variant(v) == "VOID", F.lit(True))


def number(v: Column) -> Column:
    """A number as double; null for all else, true and false among them."""
    return F.when(is_kind(v, "number"), F.try_variant_get(v, "$", "double"))


def whole(v: Column) -> Column:
    """A whole number as long; null for all else, and beyond 64 bits."""
    return F.when(is_kind(v, "int"), F.try_variant_get(v, "$", "bigint"))


def flag(v: Column) -> Column:
    return F.when(is_kind(v, "bool"), F.try_variant_get(v, "$", "boolean"))


def text(v: Column) -> Column:
    return F.when(is_kind(v, "text"), F.try_variant_get(v, "$", "string"))


def items(v: Column) -> Column:
    """The values of a list as an array; null for all else."""
    return F.try_variant_get(v, "$", "array<variant>")


def entries(v: Column) -> Column:
    """(key, value) for each key of a map, by key; null where v is no map."""
    return F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))


def _walk(value: object, depth: int) -> object:
    if isinstance(value, dict | list) and depth >= MAX_DEPTH:
        return TOO_DEEP
    if isinstance(value, dict):
        return {k[:MAX_KEY]: _walk(v, depth + 1) for k, v in islice(value.items(), MAX_KEYS)}
    if isinstance(value, list):
        return [_walk(v, depth + 1) for v in islice(value, MAX_ITEMS)]
    if depth >= MAX_DEPTH:
        return TOO_DEEP
    return None if isinstance(value, float) and not math.isfinite(value) else value


@F.pandas_udf(StringType())
def _copies(texts: pd.Series, name: pd.Series, extra: pd.Series) -> pd.Series:
    """Bounded copies; where `name` is not null of the map under that key (else {}), in which `extra`, if told, is true."""

    def one(text: str | None, name: str | None, extra: str | None) -> str | None:
        try:
            value = None if text is None else json.loads(text)
        except (ValueError, RecursionError):
            text = value = None
        if name is None:
            if text is None:
                return None
            out = _walk(value, 0)
        else:
            inner = value.get(name) if isinstance(value, dict) else None
            out = _walk(inner if isinstance(inner, dict) else {}, 0)
            if extra is not None:
                out = {k: v for k, v in out.items() if k != extra} | {extra: True}
        return json.dumps(out, ensure_ascii=False, separators=(",", ":"))

    return pd.Series([one(*row) for row in zip(texts, name, extra, strict=True)], dtype=object)


def bounded(text_: Column) -> Column:
    """A JSON text again, made safe to keep.

    Maps keep their first 200 keys, cut to 100 characters (of keys that are equal then the last value stays), lists their
    first 500 values, and below 12 levels stands a mark; numbers that are not finite become null. Null where the text is no
    JSON or nested beyond what the parser takes (about a thousand levels). Nesting of any depth has no form as a column
    expression that the analyzer resolves, so batches of texts are walked in Python.
    """
    return _copies(text_, F.lit(None).cast("string"), F.lit(None).cast("string"))


def bounded_map(text_: Column, name: str, extra: str, told: Column) -> Column:
    """A bounded copy of the map under a key of a JSON text ({} for all else); where told, its key `extra` is true."""
    return _copies(text_, F.lit(name), F.when(told, extra))
