"""Dates, clocks, tokens and labels as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_tokens(name: Column) -> Column:
    """Parts of a name between hyphens, underscores and spaces, without empty ones."""
    return F.filter(F.split(name, r"[-_\s]+"), lambda x: x != "")


def compact_date(token: Column) -> Column:
    """`ddmmyy` to an ISO date, years from 70 in the last century; empty if it is no date."""
    year = F.substring(token, 5, 2).cast("int")
    year = F.when(year < 70, year + 2000).otherwise(year + 1900)
    date = F.concat_ws("-", year.cast("string"), F.substring(token, 3, 2), F.substring(token, 1, 2)).try_cast("date")
    return F.coalesce(F.when(token.rlike(r"^\d{6}$"), date.cast("string")), F.lit(""))


def time_token(token: Column) -> Column:
    """`hhHmm` to hh:mm; empty otherwise."""
    return F.when(token.rlike(r"^\d{2}H\d{2}$"), F.concat(F.substring(token, 1, 2), F.lit(":"), F.substring(token, 4, 2))).otherwise(F.lit(""))


def utc_clock(text: Column) -> Column:
    """Digits of a clock to hh:mm:ss; empty under four digits."""
    digits = F.regexp_replace(F.coalesce(text, F.lit("")), r"\D", "")
    six = F.lpad(digits, 6, "0")
    clock = F.concat_ws(":", F.substring(six, 1, 2), F.substring(six, 3, 2), F.substring(six, 5, 2))
    return F.when(F.length(digits) >= 4, clock).otherwise(F.lit(""))


def first_decoded(tokens: Column, decode) -> Column:
    """The first token that `decode` understands, decoded; empty if there is none."""
    return F.coalesce(F.get(F.filter(F.transform(tokens, decode), lambda x: x != ""), F.lit(0)), F.lit(""))


def header_date(text: Column) -> Column:
    """`Weekday, Month d, yyyy` or without the weekday to an ISO date; empty otherwise."""
    bare = F.regexp_replace(text, r"^\s*[A-Za-z]+,\s*(?=[A-Za-z])", "")
    return F.coalesce(F.to_date(F.try_to_timestamp(bare, F.lit("MMMM d, yyyy"))).cast("string"), F.lit(""))


def header_time(text: Column) -> Column:
    """`h:mm AM` or `h AM` to hh:mm; empty otherwise."""
    parsed = F.coalesce(F.try_to_timestamp(text, F.lit("h:mm a")), F.try_to_timestamp(text, F.lit("h a")))
    return F.coalesce(F.date_format(parsed, "HH:mm"), F.lit(""))


def clean_header(text: Column) -> Column:
    """White space collapsed; cut at a colon unless it begins with `UTC time`."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.lower(flat).startswith("utc time"), flat).otherwise(F.trim(F.substring_index(flat, ":", 1)))


def first_filled(*cols: Column) -> Column:
    """The first that is neither null nor empty; empty if there is none."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cols), F.lit(""))


def _nearest(x: Column) -> Column:
    """The nearest whole number of a number that is not negative; halves go up."""
    return F.floor(x + 0.5).cast("long")


def _div(x: Column, n: int) -> Column:
    return ((x - x % n) / n).cast("long")


def _at_least(x: Column, digits: int) -> Column:
    """A whole number with leading zeros up to so many digits (format_string does the same many times slower)."""
    text = x.cast("string")
    return F.when(x < 10 ** (digits - 1), F.lpad(text, digits, "0")).otherwise(text)


def duration_label(seconds: Column, decimals: int = 3) -> Column:
    """mm:ss.fff, never below zero; --:-- for null, NaN and infinity."""
    scale = 10**decimals
    units = _nearest(F.greatest(seconds, F.lit(0.0)) * scale)
    minutes, rest = _div(units, 60 * scale), units % (60 * scale)
    label = F.concat(_at_least(minutes, 2), F.lit(":"), _at_least(_div(rest, scale), 2), F.lit("."), _at_least(rest % scale, decimals))
    return F.when(seconds.isNull() | F.isnan(seconds) | (F.abs(seconds) == float("inf")), "--:--").otherwise(label)


def clock_label(seconds: Column) -> Column:
    """HH:MM:SS.mmm of a number of seconds."""
    ms = _nearest(F.greatest(seconds, F.lit(0.0)) * 1000)
    parts = _div(ms, 3_600_000), _div(ms, 60_000) % 60, _div(ms, 1000) % 60
    return F.concat(F.concat_ws(":", *(_at_least(p, 2) for p in parts)), F.lit("."), _at_least(ms % 1000, 3))


def seconds_of(text: Column) -> Column:
    """Seconds from `seconds`, `MM:SS` or `HH:MM:SS`, fractions allowed; null otherwise."""
    p = F.split(text, ":")
    d = lambda i: p[i].try_cast("double")
    return F.when(F.size(p) == 1, d(0)).when(F.size(p) == 2, d(0) * 60 + d(1)).when(F.size(p) == 3, d(0) * 3600 + d(1) * 60 + d(2))


TIME_PATTERN = r"(\d{2})[:'.](\d{2})[:'.](\d{2})"
DATE_PATTERN = r"(\d{1,4})[/.-](\d{1,2})[/.-](\d{1,4})"


def noisy_timestamp(text: Column) -> Column:
    """Date and time anywhere in recognised text: Y-M-D, else D-M-Y, else M-D-Y; two-digit years are of this century."""
    found = F.struct(F.split(F.regexp_extract(text, DATE_PATTERN, 0), "[/.-]").alias("d"), F.split(F.regexp_extract(text, TIME_PATTERN, 0), "[:'.]").alias("t"))
    # both patterns are matched once a row: the lambda's variable is a value, not an expression to be repeated
    return F.transform(F.array(found), _stamp)[0]


def _stamp(found: Column) -> Column:
    clock = [F.get(found["t"], F.lit(i)).try_cast("int") for i in (0, 1, 2)]
    a, b, c = (F.get(found["d"], F.lit(i)).try_cast("int") for i in (0, 1, 2))
    year = F.when(c < 100, c + 2000).otherwise(c)
    date = lambda y, m, d: F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")).try_cast("date")
    day = F.when(a > 1000, date(a, b, c)).otherwise(F.coalesce(date(year, b, a), date(year, a, b)))
    valid = (clock[0] < 24) & (clock[1] < 60) & (clock[2] < 60)
    stamp = F.concat_ws(" ", day.cast("string"), F.concat_ws(":", *(F.lpad(x.cast("string"), 2, "0") for x in clock)))
    return F.when(valid & day.isNotNull(), stamp.try_cast("timestamp_ntz"))


def noisy_clock(text: Column) -> Column:
    """hh:mm:ss from text with stray spaces, dots or commas, or a missing second colon; null if out of range."""
    flat = F.translate(text, " .,", "\0::")
    flat = F.regexp_replace(flat, "\0", "")
    pattern = r"(\d{2}):(\d{2}):?(\d{2})"
    full = F.when(flat.rlike(r"\d{2}:\d{2}:\d{2}"), F.regexp_extract(flat, r"(\d{2}:\d{2}:\d{2})", 1)).otherwise(
        F.when(flat.rlike(pattern), F.concat_ws(":", *(F.regexp_extract(flat, pattern, i) for i in (1, 2, 3)))))
    p = F.split(full, ":")
    return F.when((p[0].cast("int") < 24) & (p[1].cast("int") < 60) & (p[2].cast("int") < 60), full)


def overlay_date(text: Column) -> Column:
    """The first M/D/20YY in text, or null."""
    return F.nullif(F.regexp_extract(text, r"(\d{1,2}/\d{1,2}/20\d{2})", 1), F.lit(""))


def absolute_time(date: Column, clock: Column, seconds: Column, utc_offset_hours: float = 4.0) -> Column:
    """Local date and clock (with or without seconds) to UTC, plus seconds since the log's start, to the microsecond."""
    start = F.concat_ws(" ", date.cast("string"), F.when(F.length(clock) == 5, F.concat(clock, F.lit(":00"))).otherwise(clock)).try_cast("timestamp_ntz")
    return start + F.make_dt_interval(secs=(seconds - utc_offset_hours * 3600).cast("decimal(18,6)"))


def time_of_day_label(stamp: Column) -> Column:
    return F.date_format(stamp, "HH:mm:ss.SSS")


def lap_label(lap: Column) -> Column:
    return F.when(lap < 0, "PIT").when(lap == 0, "OUT").otherwise(lap.cast("string"))


def range_label(low: Column, high: Column) -> Column:
    return F.concat_ws("/", low.cast("int").cast("string"), high.cast("int").cast("string"))


def delta_label(delta: Column) -> Column:
    """Signed seconds, +0.00; empty for null."""
    hundredths = _nearest(F.abs(delta) * 100)
    label = F.concat(F.when(delta < 0, "-").otherwise("+"), _div(hundredths, 100).cast("string"), F.lit("."), _at_least(hundredths % 100, 2))
    return F.when(delta.isNotNull(), label).otherwise(F.lit(""))


def delta_class(delta: Column) -> Column:
    return F.when(delta < 0, "faster").when(delta > 0, "slower").otherwise("even")


def group_name(start: Column, stem: Column) -> Column:
    """File name of a recording: its start, else unknown_ and the first clip's stem."""
    return F.concat(F.coalesce(F.date_format(start, "yyyy-MM-dd_HH-mm-ss"), F.concat(F.lit("unknown_"), stem)), F.lit(".mp4"))
