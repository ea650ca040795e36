"""Normalisation of identifiers as people type them (``7``, `` cust-0007 ``, ``abc``)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidewagon.functions.columns import padded


def _clean(raw: Column) -> Column:
    return F.regexp_replace(F.upper(raw), r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def _numbered(raw: Column, prefix: str, width: int) -> Column:
    """Keep a prefixed id; otherwise use its digits as the number, or else the text itself.

    The digits must fit a 32-bit integer, so ``99999999999`` stays text.
    """
    text = _clean(raw)
    number = F.regexp_replace(text, "[^0-9]", "").try_cast("int")
    return (
        F.when(raw.isNull() | raw.rlike(r"^\s*$"), F.lit(None).cast("string"))
        .when(text.startswith(prefix), text)
        .when(number.isNotNull(), padded(prefix, number, width))
        .otherwise(F.concat(F.lit(prefix), text))
    )


def normalize_customer_id(raw: Column) -> Column:
    return _numbered(raw, "CUST-", 4)


def normalize_vehicle_id(raw: Column) -> Column:
    return _numbered(raw, "VEH-", 3)


def normalize_order_id(raw: Column) -> Column:
    """Real order ids carry hex characters, so an unprefixed one loses its letters here."""
    return _numbered(raw, "ORD-", 5)


def normalize_warehouse_id(raw: Column) -> Column:
    text = _clean(raw)
    return (
        F.when(raw.isNull() | raw.rlike(r"^\s*$"), F.lit(None).cast("string"))
        .when(text.startswith("WH-"), text)
        .otherwise(F.concat(F.lit("WH-"), text))
    )
