"""Event-parameter lookup (a keyed read from the repeated key/value field).

`get(params, array_position(params.key, k) - 1)`: the key array is a struct
field projection, the position search and the indexed read are all
code-generated (a lambda-based `filter` would fall out of whole-stage codegen
and cost several times more per row). No explode. A missing key gives NULL
(position 0 -> index -1 -> NULL). When a key repeats, the first entry wins;
`strict` raises instead, as a warehouse's scalar subquery does (counted by
`size` and `array_remove`, also generated code).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from touchline.schema import PAGE_LOCATION_PARAM, SESSION_ID_PARAM

_FIELDS = {"int": "int_value", "string": "string_value"}


def event_param(key: str, kind: str = "int", params: str = "event_params", strict: bool = False) -> Column:
    field = _FIELDS[kind]
    keys = F.col(f"{params}.key")
    pos = F.array_position(keys, F.lit(key))
    value = F.get(F.col(params), (pos - 1).cast("int"))["value"][field]
    if not strict:
        return value
    repeated = F.size(keys) - F.size(F.array_remove(keys, F.lit(key))) > 1
    return F.when(repeated, F.raise_error(F.lit(f"more than one event parameter {key}"))).otherwise(value)


def session_id(strict: bool = False) -> Column:
    return event_param(SESSION_ID_PARAM, "int", strict=strict)


def page_location(strict: bool = False) -> Column:
    return event_param(PAGE_LOCATION_PARAM, "string", strict=strict)
