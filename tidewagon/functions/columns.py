"""Column-to-column helpers shared by the operators. All stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidewagon.schemas import MINUTE_MS, ORDER_UNTRACKED, SLA_HOURS, SLA_RISK_MINUTES

# Total order of events of one key: event time, then arrival order.
ARRIVAL = ("timestamp", "seq")


def last_of(fields: list, condition: Column | None = None) -> Column:
    """Aggregate: the fields of the last event, or of the last that meets the condition (else null).

    The fields are in ``<result>.fields``. The greatest struct that begins with the arrival order says
    the same as ``max_by`` but keeps the order only once in its buffer.
    """
    event = F.struct(*ARRIVAL, F.struct(*fields).alias("fields"))
    return F.max(event if condition is None else F.when(condition, event))


def now_ms(clock: str | int) -> Column:
    """The "current time" of an operator: ``"event"`` (each event's own time) or epoch millis."""
    if clock == "event":
        return F.col("timestamp")
    return F.lit(int(clock)).cast("long")


def whole_minutes(ms: Column) -> Column:
    """Millis to minutes, truncated toward zero (-59 999 ms is 0 minutes)."""
    return F.call_function("div", ms, F.lit(MINUTE_MS).cast("long"))


def minutes_to_sla(clock: str | int) -> Column:
    return whole_minutes(F.col("sla_timestamp") - now_ms(clock))


def sla_tracked(clock: str | int) -> Column:
    """Non-terminal order event that is within the risk threshold or already past its deadline."""
    return ~F.col("status").isin(*ORDER_UNTRACKED) & (minutes_to_sla(clock) <= SLA_RISK_MINUTES)


def percent(part: Column, whole: Column, empty: float) -> Column:
    """``100 * part / whole``, or ``empty`` when there is nothing to divide by."""
    return F.when(whole > 0, F.lit(100.0) * part / whole).otherwise(F.lit(empty))


def count_where(condition: Column) -> Column:
    """Number of rows for which ``condition`` holds; null counts as no."""
    return F.count(F.when(condition, F.lit(1)))


def array_or_empty(values: Column) -> Column:
    return F.coalesce(values, F.array().cast("array<string>"))


def iso_utc(ms: Column) -> Column:
    """Epoch millis as ISO-8601 UTC with the fraction only when there is one; 0 becomes null.

    Built from the date and the time of day rather than ``date_format`` so that it does not depend
    on the session time zone.
    """
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / 86_400_000).cast("int"))
    rest = F.pmod(ms, F.lit(86_400_000))
    part = lambda unit, size: F.lpad(
        F.pmod(F.floor(rest / unit), F.lit(size)).cast("string"), 2, "0")
    frac = F.pmod(rest, F.lit(1000))
    tail = F.when(frac == 0, F.lit("Z")).otherwise(
        F.concat(F.lit("."), F.lpad(frac.cast("string"), 3, "0"), F.lit("Z")))
    text = F.concat(day.cast("string"), F.lit("T"), part(3_600_000, 24), F.lit(":"),
                    part(60_000, 60), F.lit(":"), part(1000, 60), tail)
    return F.when(ms != 0, text)


def lenient_number(value: Column, type_name: str, default) -> Column:
    """Parse a number leniently: what cannot be read becomes ``default``."""
    return F.coalesce(value.try_cast(type_name), F.lit(default).cast(type_name))


def sla_deadline(priority: Column, created_ms: Column) -> Column:
    """Deadline of an order from its priority: creation time plus the hours granted."""
    hours = F.create_map(*[F.lit(x) for kv in SLA_HOURS.items() for x in kv])
    return created_ms + hours[priority] * F.lit(3_600_000).cast("long")


def padded(prefix: str, number: Column, width: int) -> Column:
    """``prefix`` plus the number, zero-padded to ``width``; a longer number is kept whole."""
    text = number.cast("string")
    return F.concat(F.lit(prefix), F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0")))


def like_term(column: Column, term: str, literal: bool = False) -> Column:
    """Case-insensitive substring match. ``%`` and ``_`` in the term are wildcards unless ``literal``."""
    if literal:
        return F.lower(column).contains(term.lower())
    return F.lower(column).like("%" + term.lower() + "%")
