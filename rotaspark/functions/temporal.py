"""Dates, times, durations and interval arithmetic on TIMESTAMP_NTZ columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rotaspark.functions.text import clean_text, strip

NTZ = "timestamp_ntz"

# Accepted shapes, in order of preference. The regular
# expression decides cheaply which formatter runs, so a value is never pushed
# through formatters it cannot satisfy.
DATE_FORMATS = (
    (r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", "yyyy-M-d"),
    (r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$", "yyyy/M/d"),
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "M/d/yyyy"),
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "d/M/yyyy"),
)
HEADER_DATE_FORMATS = (DATE_FORMATS[2], DATE_FORMATS[0], DATE_FORMATS[3])
_MDY = r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} +"
DATETIME_FORMATS = (
    (rf"^{_MDY}[0-9]{{1,2}}:[0-9]{{1,2}}:[0-9]{{1,2}} +[aApP][mM]$", "M/d/yyyy h:m:s a"),
    (rf"^{_MDY}[0-9]{{1,2}}:[0-9]{{1,2}} +[aApP][mM]$", "M/d/yyyy h:m a"),
    (rf"^{_MDY}[0-9]{{1,2}}:[0-9]{{1,2}}:[0-9]{{1,2}}$", "M/d/yyyy H:m:s"),
    (rf"^{_MDY}[0-9]{{1,2}}:[0-9]{{1,2}}$", "M/d/yyyy H:m"),
    (r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2} +[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}$", "yyyy-M-d H:m:s"),
    (r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2} +[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}$", "yyyy/M/d H:m:s"),
)
_ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}([.,][0-9]{1,6})?)?)?$"
_ISO_BASIC = r"^[0-9]{8}(T[0-9]{6})?$"
FILENAME_DATE = r"(?<![0-9])([0-9]{4}-[0-9]{2}-[0-9]{2})(?![0-9])"


def _first_format(text: Column, formats, parse) -> Column:
    tries = [F.when(text.rlike(shape), parse(text, fmt)) for shape, fmt in formats]
    return F.coalesce(*tries)


def parse_date(c: Column, formats=DATE_FORMATS, is_clean: bool = False) -> Column:
    """FN-06: date by ordered formats."""
    return _first_format(clean_text(c, is_clean), formats, lambda t, f: F.try_to_date(t, f))


def parse_header_date(c: Column, is_clean: bool = False) -> Column:
    return parse_date(c, HEADER_DATE_FORMATS, is_clean)


def _to_ntz(text: Column, fmt: str) -> Column:
    # Spark's formatter wants exactly one blank where the shape allows several.
    single = F.when(text.contains("  "), F.regexp_replace(text, " +", " ")).otherwise(text)
    return F.try_to_timestamp(F.upper(single), F.lit(fmt)).cast(NTZ)


def parse_datetime(c: Column, is_clean: bool = False) -> Column:
    """FN-07: timestamp without zone; ISO first, then the six ordered formats."""
    text = clean_text(c, is_clean)
    iso = F.when(text.rlike(_ISO), F.replace(text, F.lit(","), F.lit(".")).try_cast(NTZ))
    basic = F.when(
        text.rlike(_ISO_BASIC),
        F.coalesce(
            F.when(F.length(text) == 8, F.try_to_timestamp(text, F.lit("yyyyMMdd"))),
            F.when(F.length(text) == 15, F.try_to_timestamp(text, F.lit("yyyyMMdd'T'HHmmss"))),
        ).cast(NTZ),
    )
    slashed = [f for f in DATETIME_FORMATS if "/" in f[1]]
    dashed = [f for f in DATETIME_FORMATS if "/" not in f[1]]
    # No shape mixes the two separators, so each value meets its own family only.
    return F.when(text.contains("/"), _first_format(text, slashed, _to_ntz)).otherwise(
        F.coalesce(iso, _first_format(text, dashed, _to_ntz), basic)
    )


def time_of_day_seconds(c: Column, is_clean: bool = False) -> Column:
    """FN-08: seconds of day from `H:M[:S]` with or without AM/PM."""
    text = F.upper(clean_text(c, is_clean))
    shape = r"^([0-9]{1,2}):([0-9]{1,2})(?::([0-9]{1,2}))?( *[AP]M)?$"
    part = lambda i: F.nullif(F.regexp_extract(text, shape, i), F.lit("")).cast("int")
    hour, minute, second = part(1), part(2), F.coalesce(part(3), F.lit(0))
    half = F.right(text, F.lit(2))
    twelve = text.rlike("[AP]M$")
    hour24 = F.when(~twelve & (hour < 24), hour).when(
        twelve & hour.between(1, 12), F.pmod(hour, F.lit(12)) + F.when(half == "PM", 12).otherwise(0)
    )
    valid = text.rlike(shape) & (minute < 60) & (second < 60)
    return F.when(valid, hour24 * 3600 + minute * 60 + second).cast("int")


def day_fraction_seconds(c: Column) -> Column:
    """FN-08 for a numeric cell: fraction of a day, rounded half to even."""
    seconds = F.bround(c.cast("double") * 86400).try_cast("int")
    return F.when((seconds >= 0) & (seconds < 86400), seconds)


def duration_seconds(c: Column, is_clean: bool = False) -> Column:
    """FN-09: `H:M:S` (fractional S), `H:M`, or plain seconds; half-even rounding."""
    text = clean_text(c, is_clean)
    parts = F.split(text, ":")
    whole = lambda i: F.when(
        strip(F.get(parts, F.lit(i))).rlike("^[+-]?[0-9]{1,15}$"),
        strip(F.get(parts, F.lit(i))).try_cast("bigint"),
    )

    def rounded(piece: Column) -> Column:
        piece = strip(piece)
        numeric = piece.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
        return F.when(numeric, F.bround(piece.try_cast("double")).try_cast("bigint"))

    n = F.size(parts)
    piece = lambda text_, count: F.substring_index(text_, ":", count).cast("bigint")
    # The usual whole-number shapes are cut out directly; the rest is split and checked.
    return (
        F.when(
            text.rlike("^[0-9]{1,6}:[0-9]{1,3}:[0-9]{1,3}$"),
            piece(text, 1) * 3600 + piece(F.substring_index(text, ":", 2), -1) * 60 + piece(text, -1),
        )
        .when(text.rlike("^[0-9]{1,9}$"), text.cast("bigint"))
        .when(n == 3, whole(0) * 3600 + whole(1) * 60 + rounded(F.get(parts, F.lit(2))))
        .when(n == 2, whole(0) * 3600 + rounded(F.get(parts, F.lit(1))) * 60)
        .when(n == 1, rounded(text))
    )


def filename_date(name: Column) -> Column:
    """FN-14: the date in a file name, only when all dates in it agree."""
    found = F.regexp_extract_all(name, F.lit(FILENAME_DATE), F.lit(1))
    agree = (F.size(found) > 0) & (F.array_min(found) == F.array_max(found))
    return F.when(agree, F.try_to_date(F.array_min(found), "yyyy-MM-dd"))


def add_seconds(ts: Column, seconds: Column) -> Column:
    """FN-29: `ts` moved by seconds; NULL where that leaves the years 1 to 9999."""
    sane = F.when(F.abs(seconds) < F.lit(400_000_000_000), seconds)
    days = F.floor(sane / F.lit(86_400)).cast("int")
    rest = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.pmod(sane, F.lit(86_400)).cast("decimal(18,6)"))
    moved = ts + F.make_dt_interval(days) + rest
    return F.when(F.year(moved).between(1, 9999), moved)


def overnight_end(start: Column, end: Column) -> Column:
    """FN-28: an end before its start belongs to the next day."""
    return F.when(end < start, end + F.expr("INTERVAL 1 DAY")).otherwise(end)


def whole_minutes(start: Column, end: Column) -> Column:
    """FN-18: completed minutes between two timestamps, never negative."""
    return F.greatest(F.lit(0).cast("bigint"), F.timestamp_diff("MINUTE", start, end))


def quarter_start(ts: Column) -> Column:
    """FN-19: start of the 15-minute interval holding `ts`."""
    return F.window(ts, "15 minutes")["start"]


def quarter_end(start: Column) -> Column:
    return start + F.expr("INTERVAL 15 MINUTES")


def hour_start(ts: Column) -> Column:
    """FN-20."""
    return F.date_trunc("hour", ts).cast(NTZ)


def last_instant(end: Column) -> Column:
    """Last microsecond inside a half-open interval."""
    return end - F.expr("INTERVAL '0.000001' SECOND")


def touched_dates(start: Column, end: Column) -> Column:
    """FN-32: array of dates touched by `[start, end)`."""
    return F.sequence(F.to_date(start), F.to_date(last_instant(end)))


def iso(c: Column) -> Column:
    """ISO text of a timestamp, seconds precision unless it carries microseconds."""
    plain = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(c, "SSSSSS")
    return F.when(fraction == "000000", plain).otherwise(F.concat(plain, F.lit("."), fraction))


def py_text(c: Column) -> Column:
    """`YYYY-MM-DD HH:MM:SS[.ffffff]`, the text that goes into call keys."""
    return F.replace(iso(c), F.lit("T"), F.lit(" "))
