"""The run log: payloads, results and the newest entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def payload_valid(payload: Column | str) -> Column:
    """Whether a text is a JSON object; null and what can't be parsed are not."""
    c = F.col(payload) if isinstance(payload, str) else payload
    return F.coalesce(F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT"), F.lit(False))


def payload_fault(payload: Column | str) -> Column:
    """Why a text is no payload: `missing` (null), `no json` or `no object`; null for a JSON object."""
    c = F.col(payload) if isinstance(payload, str) else payload
    parsed = F.try_parse_json(c)
    return F.when(c.isNull(), "missing").when(parsed.isNull(), "no json").when(~F.schema_of_variant(parsed).startswith("OBJECT"), "no object")


def payload_default(payload: Column, key: str, value: str) -> Column:
    """A map of strings with value at key if the key is missing; a null that is there stays."""
    return F.when(F.map_contains_key(payload, key), payload).otherwise(F.map_concat(payload, F.create_map(F.lit(key), F.lit(value))))


def exit_code(ok: Column | str) -> Column:
    return F.when(F.col(ok) if isinstance(ok, str) else ok, 0).otherwise(1)


def log_tail(log: DataFrame, n: int = 20, *, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """The n newest rows (one at least), the oldest of them first."""
    newest = log.orderBy(*[F.desc(c) for c in order]).limit(max(1, n))
    return newest.orderBy(*order)
