"""Python-literal parsing of model output (the only per-row Python in the library).

The source evaluates model output with ``eval``; a syntax/type/name error marks
the row as a parse failure. ``ast.literal_eval`` gives the same accept/reject
split on literal text without executing anything (JSON ``true``/``null`` are
rejected, Python quotes, ``None`` and trailing commas accepted). The result is
re-emitted as JSON so the rest of the stage reads it with ``from_json``.
Arrow-batched (Arrow UDF, ``ROWS_AT_ONCE`` texts as Python objects at a time, so that a worker holds little
beside its batch); placed after filters so nothing is parsed twice.
"""

from __future__ import annotations

import ast
import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

# Ship this module's functions to Python workers by value: a worker whose path does
# not include the package (e.g. a driver started from another folder) can still run them.
try:
    import sys as _sys

    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: fall back to by-reference pickling
    pass

LITERAL_SCHEMA = Ty.StructType([
    Ty.StructField("shape", Ty.StringType()), Ty.StructField("js", Ty.StringType()),
    Ty.StructField("err", Ty.StringType()), Ty.StructField("id_int", Ty.ArrayType(Ty.BooleanType())),
])

NAMES = LITERAL_SCHEMA.names
ARROW_TYPE = pa.struct(list(zip(NAMES, [pa.string(), pa.string(), pa.string(), pa.list_(pa.bool_())], strict=True)))
ROWS_AT_ONCE = 256


def _shape(v) -> str:
    if isinstance(v, dict):
        return "dict"
    if isinstance(v, list):
        return "list"
    return "other"


def parse_one(text):
    """``(shape, json, error, per list element: is its ``id`` an int)`` of one literal text."""
    if text is None:
        return None, None, "null", None
    try:
        v = ast.literal_eval(text)
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError) as e:
        return None, None, f"syntax:{type(e).__name__}", None
    try:
        js = json.dumps(v, ensure_ascii=False)
    except (TypeError, ValueError) as e:   # sets, bytes, complex …
        return None, None, f"syntax:{type(e).__name__}", None
    id_int = None
    if isinstance(v, list):
        id_int = [isinstance(x, dict) and type(x.get("id")) is int for x in v]
    return _shape(v), js, None, id_int


def parse_texts(texts: pa.Array) -> pa.Array:
    """``parse_one`` of every text as structs."""
    parts = [pa.array([dict(zip(NAMES, parse_one(t), strict=True)) for t in texts.slice(lo, ROWS_AT_ONCE).to_pylist()], ARROW_TYPE)
             for lo in range(0, len(texts), ROWS_AT_ONCE)]
    return pa.concat_arrays(parts) if parts else pa.array([], ARROW_TYPE)


@F.arrow_udf(LITERAL_SCHEMA)
def _parse_literal(texts: pa.Array) -> pa.Array:
    return parse_texts(texts)


def parse_literal(c) -> Column:
    """Struct ``(shape, js, err, id_int)``; ``err`` is NULL on success."""
    return _parse_literal(F.col(c) if isinstance(c, str) else c)
