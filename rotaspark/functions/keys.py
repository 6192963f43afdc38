"""Keys, fingerprints and JSON texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from rotaspark.functions.temporal import iso, py_text


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def raw_json(columns: Iterable[str]) -> Column:
    """FN-27: the row's raw cells as JSON, keys sorted, empty cells as ''."""
    fields = [_text(F.col(f"`{name}`")).alias(name) for name in sorted(columns)]
    return F.to_json(F.struct(*fields))


def call_key(
    reference: Column,
    call_id: Column,
    direction: Column,
    agent: Column,
    start: Column,
    clearing_party: Column,
    payload: Column,
) -> Column:
    """FN-21: identity of a call leg; the payload joins in only without any reference."""
    parts = [_text(reference), _text(call_id), _text(direction), _text(agent), _text(py_text(start)),
             _text(clearing_party)]
    material = F.concat_ws("|", *parts)
    anonymous = (_text(reference) == "") & (_text(call_id) == "")
    return F.sha2(F.when(anonymous, F.concat_ws("|", material, payload)).otherwise(material), 256)


def interaction_key(shared: Column, reference: Column, call_id: Column, key: Column) -> Column:
    """FN-22."""
    return F.coalesce(shared, reference, call_id, key)


def serial_or_hash(serial: Column, columns: Iterable[str]) -> Column:
    """FN-23: a blank serial becomes the hash of the whole row."""
    return F.coalesce(serial, F.sha2(raw_json(columns), 256))


def agent_day_key(business_date: Column, client: Column) -> Column:
    """FN-24."""
    return F.concat(F.date_format(business_date, "yyyyMMdd"), F.lit("-"), client)


def gap_key(day_key: Column, gap_type: Column, start: Column, end: Column, basis: Column) -> Column:
    """FN-24."""
    return F.sha2(F.concat_ws("|", day_key, gap_type, iso(start), iso(end), basis), 256)


def fingerprint(version: str, *parts: str | bytes) -> str:
    """FN-25: driver-side policy fingerprint."""
    digest = hashlib.sha256(version.encode())
    for part in parts:
        digest.update(b"\0" + (part if isinstance(part, bytes) else part.encode()))
    return digest.hexdigest()


def source_list(keys: Column) -> Column:
    """FN-26: sorted distinct source keys of an array, as JSON."""
    return F.to_json(F.array_sort(F.array_distinct(keys)))
