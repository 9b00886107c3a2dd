"""Whether JSON holds other JSON, by structure, as expressions over VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Json = dict | list | str | int | float | bool | None


def json_contains(document: Column, wanted: Json) -> Column:
    """Whether a document (VARIANT) holds what is wanted, a value known when the query is written.

    An object holds an object if it has each of its keys with a value that holds the one wanted; an array holds an array
    if for each element wanted one of its own holds it, in any order and number; numbers, strings, booleans and null
    hold their equals. A document that is an array also holds a plain value that is one of its elements, at the top
    only. False where the document is null in SQL.
    """
    holds = _holds(document, wanted)
    if not isinstance(wanted, dict | list):
        holds = holds | _holds(document, [wanted])
    return F.coalesce(holds, F.lit(False))


def _path(key: str) -> str:
    if '"' in key or "\\" in key:
        raise ValueError(f"a key with quotes or backslashes has no path: {key}")
    return f'$["{key}"]'


def _kind(v: Column) -> Column:
    return F.upper(F.regexp_extract(F.schema_of_variant(v), "^[A-Za-z]+", 0))


def _some(elements: Column, wanted: Json) -> Column:
    return F.exists(elements, lambda x: F.coalesce(_holds(x, wanted), F.lit(False)))


def _holds(v: Column, wanted: Json) -> Column:
    if isinstance(wanted, dict):
        out = _kind(v) == "OBJECT"
        for key, value in wanted.items():
            out = out & F.coalesce(_holds(F.try_variant_get(v, _path(key), "variant"), value), F.lit(False))
        return out
    if isinstance(wanted, list):
        own = F.try_variant_get(v, "$", "array<variant>")
        out = _kind(v) == "ARRAY"
        for value in wanted:
            out = out & _some(own, value)
        return out
    if wanted is None:
        return F.is_variant_null(v)
    if isinstance(wanted, bool):
        return (_kind(v) == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == wanted)
    if isinstance(wanted, str):
        return (_kind(v) == "STRING") & (F.try_variant_get(v, "$", "string") == wanted)
    number = "decimal(38,10)" if isinstance(wanted, int) else "double"
    return _kind(v).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT") & (F.try_variant_get(v, "$", number) == F.lit(wanted).cast(number))
