"""Log times as UTC milliseconds since 1970, in BIGINT arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Month names in access logs, three letters each.
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"

_HOUR, _MINUTE = r"(?:0\d|1[0-4])", r"[0-5]\d"
#: Z, or a sign with hh:mm, hhmm or hh; a colon or two digits that don't form a minute spoil it.
_ZONE = rf"(?:[Zz]|[+-]{_HOUR}(?::{_MINUTE}|{_MINUTE}|(?!:)(?!\d\d)))"
_CLF = r"^\d{2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2}"
_ISO = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}"


def zone_minutes(zone: Column) -> Column:
    """Offset of a text that matches a zone; 0 for Z and for no zone."""
    digits = F.regexp_replace(zone, "[+:Zz-]", "")
    size = F.coalesce(F.rpad(digits, 4, "0").try_cast("int"), F.lit(0))
    return F.when(F.startswith(zone, F.lit("-")), -1).otherwise(1) * (F.floor(size / 100) * 60 + size % 100)


def _ms(date: Column, clock: Column, offset: Column) -> Column:
    """``date`` yyyy-MM-dd and ``clock`` HH:mm:ss, both checked for digits; null if out of range. Second 60 counts."""
    hour, minute, second = (F.substring(clock, at, 2).try_cast("int") for at in (1, 4, 7))
    days = F.unix_date(date.try_cast("date")).cast("long")
    seconds = days * 86_400 + hour * 3600 + minute * 60 + second - offset * 60
    return F.when(clock.rlike(r"^(?:[01]\d|2[0-3]):[0-5]\d:(?:[0-5]\d|60)$"), seconds * 1000)


def _clf_zone(tail: Column) -> Column:
    """The zone at the beginning of what follows the time; empty if there is none, null if it is spoilt."""
    found = F.regexp_extract(tail, f"^ ({_ZONE})", 1)
    return F.when(tail.isin("", " +0000"), F.lit("")).when((found == "") & tail.rlike("^ ."), F.lit(None)).otherwise(found)


def clf_parts_ms(date: Column, clock: Column, tail: Column) -> Column:
    """``10/Oct/2023``, ``13:55:36`` and what follows; the clock is known to be one."""
    days = F.unix_date(_clf_date(date).try_cast("date")).cast("long")
    seconds = sum(F.substring(clock, at, 2).try_cast("int") * unit for at, unit in ((1, 3600), (4, 60), (7, 1)))
    zone = F.when(tail.isin("", " +0000"), F.lit(0)).otherwise(zone_minutes(_clf_zone(tail)))
    return (days * 86_400 + seconds - zone * 60) * 1000


def _clf_date(text: Column) -> Column:
    at = F.instr(F.lit(MONTHS), F.lower(F.substring(text, 4, 3)))
    month = F.lpad(F.when(at % 3 == 1, (at + 2) / 3).cast("int").cast("string"), 2, "0")
    return F.concat(F.substring(text, 8, 4), F.lit("-"), month, F.lit("-"), F.substring(text, 1, 2))


def clf_ms(text: Column) -> Column:
    """``10/Oct/2023:13:55:36 +0000``. A blank after the time must be followed by a zone; anything else after it is ignored."""
    zone = _clf_zone(F.substring(text, 21, 1 << 20))
    return F.when(zone.isNotNull(), _clf(text, zone))


def _clf(text: Column, zone: Column) -> Column:
    return F.when(text.rlike(_CLF), _ms(_clf_date(text), F.substring(text, 13, 8), zone_minutes(zone)))


def with_clf(df: DataFrame, text: str, out: str) -> DataFrame:
    """``clf_ms`` in two steps, so that nothing is computed twice and the generated code stays small."""
    zoned = df.withColumn("_zone", _clf_zone(F.substring(text, 21, 1 << 20)))
    return zoned.withColumn(out, F.when(F.col("_zone").isNotNull(), _clf(F.col(text), F.col("_zone")))).drop("_zone")


def _iso_extra(text: Column) -> Column:
    """Fraction and zone behind the time; null if a point or comma has no digits."""
    tail = F.substring(text, 20, 1 << 20)
    return F.when(tail.rlike(r"^[.,](?!\d)"), F.lit(None)).otherwise(F.regexp_extract(tail, rf"^(?:[.,]\d+)?{_ZONE}?", 0))


def _iso(text: Column, extra: Column) -> Column:
    fraction = F.coalesce(F.rpad(F.regexp_extract(extra, r"^[.,](\d{1,3})", 1), 3, "0").try_cast("long"), F.lit(0))
    zone = F.regexp_replace(extra, r"^[.,]\d+", "")
    return F.when(text.rlike(_ISO), _ms(F.substring(text, 1, 10), F.substring(text, 12, 8), zone_minutes(zone)) + fraction)


def iso_prefix(text: Column) -> Column:
    """Struct (ms, used): the time at the beginning of ``text`` and how many characters it takes; both null if there is none."""
    extra = _iso_extra(text)
    ms = F.when(extra.isNotNull(), _iso(text, extra))
    return F.struct(ms.alias("ms"), F.when(ms.isNotNull(), F.length(extra) + 19).alias("used"))


def with_iso(df: DataFrame, text: str, ms: str, used: str) -> DataFrame:
    """``iso_prefix`` in steps, as two columns."""
    step = df.withColumn("_extra", F.when(F.col(text).rlike(_ISO), _iso_extra(F.col(text))))
    step = step.withColumn(ms, F.when(F.col("_extra").isNotNull(), _iso(F.col(text), F.col("_extra"))))
    return step.withColumn(used, F.when(F.col(ms).isNotNull(), F.length("_extra") + 19)).drop("_extra")


def _dated(at: Column, rest: str) -> Column:
    """The year in four characters or as many as it takes, a sign only if it is negative, and the rest by a pattern, which would put a plus before years beyond 9999."""
    return F.concat(F.format_string("%04d", F.year(at)), F.date_format(at, rest))


def utc_text(ms: Column) -> Column:
    """``2023-10-10 13:55:36``; the session's time zone must be UTC."""
    return _dated(F.timestamp_millis(ms), "-MM-dd HH:mm:ss")


def minute_of(ms: Column) -> Column:
    return F.floor(ms / F.lit(60_000)).cast("long")


def minute_label(minute: Column) -> Column:
    return _dated(F.timestamp_millis(minute * 60_000), "-MM-dd HH:mm")
