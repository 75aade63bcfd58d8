"""Column expressions used across operators (all JVM-side built-ins)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens import schemas as S


def col_or(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: str | Column) -> Column:
    """Cast to decimal(18,2) (half away from zero, as the reference rounds)."""
    return col_or(c).cast(S.MONEY)


def staging_money(c: str | Column) -> Column:
    """Text -> decimal(15,2) like the staging table; NULL when unparsable."""
    return _try_decimal(F.trim(col_or(c)), 15, 2)


def _try_decimal(c: Column, p: int, s: int) -> Column:
    return c.try_cast(f"decimal({p},{s})")


def ts_lit(value: dt.datetime | str) -> Column:
    """A timestamp literal (session time zone UTC)."""
    if isinstance(value, dt.datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S")
    return F.lit(value).cast("timestamp")


def add_hours(ts: str | Column, hours: str | Column) -> Column:
    return F.timestamp_add("HOUR", col_or(hours), col_or(ts))


def add_seconds(ts: str | Column, seconds: str | Column) -> Column:
    return F.timestamp_add("SECOND", col_or(seconds), col_or(ts))


def epoch_seconds_between(later: str | Column, earlier: str | Column) -> Column:
    """``EXTRACT(EPOCH FROM later - earlier)`` as a decimal number of seconds."""
    return ((F.unix_micros(col_or(later)) - F.unix_micros(col_or(earlier))).cast("decimal(38,6)")
            / F.lit(1_000_000))


def round1(c: str | Column) -> Column:
    """Round to one decimal place, half up, as decimal(20,1)."""
    return F.round(col_or(c).cast("decimal(38,10)"), 1).cast("decimal(20,1)")


def sla_hours(exception_type: str | Column) -> Column:
    """Hours allowed for an exception type; default for unknown types."""
    m = F.create_map(*[x for k, v in S.SLA_HOURS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[col_or(exception_type)], F.lit(S.SLA_DEFAULT_HOURS))


def sla_deadline(created_at: str | Column, exception_type: str | Column) -> Column:
    return add_hours(created_at, sla_hours(exception_type))


def is_sla_breached(status: str | Column, deadline: str | Column, as_of: Column) -> Column:
    """Not APPROVED/CLOSED and the deadline has passed (NULL deadline -> false)."""
    return F.coalesce(~col_or(status).isin(S.DONE_STATUSES) & (col_or(deadline) < as_of), F.lit(False))


def time_remaining_seconds(deadline: str | Column, as_of: Column) -> Column:
    """``EXTRACT(EPOCH FROM deadline - as_of)::INT`` (negative when late)."""
    return F.round(epoch_seconds_between(col_or(deadline), as_of), 0).cast("int")


def remaining_text(seconds: str | Column) -> Column:
    """Display text of a remaining time: ``Xh Ym``, ``Ym`` under an hour,
    ``Breached`` when negative, a dash when unknown."""
    s = col_or(seconds)
    hours = F.floor(s / 3600)
    minutes = F.floor((s % 3600) / 60).cast("string")
    return (F.when(s.isNull(), F.lit("—"))
            .when(s < 0, F.lit("Breached"))
            .when(hours > 0, F.concat(hours.cast("string"), F.lit("h "), minutes, F.lit("m")))
            .otherwise(F.concat(minutes, F.lit("m"))))


def tolerance_confidence(amount_diff: str | Column) -> Column:
    """100 - min(20, diff * 100) as decimal(5,2)."""
    d = col_or(amount_diff)
    return (F.lit(100) - F.least(F.lit(S.TOLERANCE_MAX_PENALTY).cast("decimal(18,2)"),
                                 d * F.lit(100))).cast(S.CONFIDENCE)


def retry_delay_seconds(attempts: str | Column) -> Column:
    """2^attempts * 10 seconds."""
    return (F.pow(F.lit(2.0), col_or(attempts)).cast("long") * S.RETRY_BASE_SECONDS).cast("int")


def sha256_hex(c: str | Column) -> Column:
    return F.sha2(col_or(c), 256)


def round1_ratio(p: str | Column, q: str | Column) -> Column:
    """p/q rounded half up to one decimal, exactly, as decimal(20,1)
    (integer arithmetic: floor((20p + q) / 2q) / 10; NULL when q is 0)."""
    num = col_or(p).cast("decimal(38,0)") * 20 + col_or(q).cast("decimal(38,0)")
    den = col_or(q).cast("decimal(38,0)") * 2
    tenths = ((num - num % den) / den).cast("decimal(38,0)")
    return F.when(col_or(q) != 0, (tenths / 10).cast("decimal(20,1)"))
