"""Event times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinefuse.functions.payload import bind, unmark

# Payload keys that may hold the event time, in order of precedence.
TIME_KEYS = ("timestamp", "time", "date", "pubMillis", "event_timestamp")

# Numbers above this are milliseconds; range of the proleptic calendar in seconds.
MILLIS_ABOVE = 1e11
FIRST_SECOND = -62135596800.0
LAST_SECOND = 253402300799.0

_JSON_NUMBER = r"\A-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?\z"
_PLAIN_ISO = (
    r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}"
    r"(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?(?:Z|[+-][0-9]{2}:[0-9]{2})?)?\z"
)
_ANY_ISO = (
    r"(?s)\A(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{8})"
    r"(?:.[0-9]{2}(?::?[0-9]{2}(?::?[0-9]{2}(?:[.,][0-9]+)?)?)?(?:Z|[+-][0-9]{2}(?::?[0-9]{2})?)?)?\z"
)


def iso_time(text: Column) -> Column:
    """ISO-8601 text to timestamp, null when it is something else. Times without zone are UTC."""
    dashed = F.regexp_replace(text, r"\A([0-9]{4})([0-9]{2})([0-9]{2})", "$1-$2-$3")
    spaced = F.regexp_replace(dashed, r"(?s)\A(.{10}).", "$1T")
    timed = F.regexp_replace(spaced, r"T([0-9]{2})([0-9]{2})([0-9]{2})", "T$1:$2:$3")
    timed = F.regexp_replace(timed, r"T([0-9]{2}):?([0-9]{2})(?=\z|[Z+-])", "T$1:$2:00")
    timed = F.regexp_replace(timed, r"T([0-9]{2})(?=\z|[Z+-])", "T$1:00:00")
    zoned = F.regexp_replace(timed, r"(T.*[+-][0-9]{2})([0-9]{2})\z", "$1:$2")
    zoned = F.regexp_replace(zoned, r"(T.*[+-][0-9]{2})\z", "$1:00")
    unusual = F.replace(zoned, F.lit(","), F.lit("."))
    return F.when(text.rlike(_PLAIN_ISO), F.try_to_timestamp(text)).when(
        text.rlike(_ANY_ISO), F.try_to_timestamp(unusual)
    )


# Names in written dates.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_WEEKDAY = r"\b(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s*"
_MONTH = rf"({'|'.join(MONTHS)})[a-z]*\.?"
_DAY = r"(\d{1,2})(?:st|nd|rd|th)?"
_GAP = r"[-/., ]*"
_CLOCK = r"(\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:[.,](\d{1,9}))?)?\s*([ap])?(?:(?<=[ap])\.?m\.?)?\s*(z\b|utc|gmt|[+-]\d{2}:?\d{2})?"
# Shapes of dates, with the groups that hold year, month and day; 0 is the first of its kind.
_WRITTEN = (
    (rf"\A{_DAY}{_GAP}(?:of )?{_MONTH}{_GAP}(\d{{4}}|\d{{2}})\z", 3, 2, 1),
    (rf"\A{_MONTH}{_GAP}{_DAY}[-/., ]+(\d{{4}}|\d{{2}})\z", 3, 1, 2),
    (rf"\A(\d{{4}}){_GAP}{_MONTH}{_GAP}{_DAY}\z", 1, 2, 3),
    (rf"\A{_MONTH}{_GAP}(\d{{4}})\z", 2, 1, 0),
    (r"\A(\d{4})(\d{2})(\d{2})\z", 1, 2, 3),
    (r"\A(\d{4})[-/](\d{1,2})\z", 1, 2, 0),
    (r"\A(\d{4})\z", 1, 0, 0),
)
_NUMBERS = r"\A(\d{1,4})[-/. ](\d{1,2})[-/. ](\d{1,4})\z"
#: Years of two digits from this one on are of the last century.
LAST_CENTURY = 70


def mixed_time(text: Column) -> Column:
    """Text of any usual form to timestamp, null when it is none of them; without zone it is UTC.

    ISO-8601 first. Else a clock (with seconds, fraction, am or pm, Z, UTC, GMT or an offset) may stand before, behind or
    in a date. Of three numbers a first one of four digits or above 31 is the year, followed by month
    and day; otherwise the year is last, and the first is the month unless it is above 12 or
    the second is: 01/02/2024 is the second of January, 13/02/2024 the thirteenth of February.
    Month names may stand anywhere in a date; weekdays are left out. A clock without a date is null.
    """
    return F.coalesce(iso_time(text), _written_time(text))


def _written_time(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.trim(text)), _WEEKDAY, "")
    packed = F.regexp_replace(plain, r"\A(\d{8})(\d{2})(\d{2})(\d{2})\z", "$1 $2:$3:$4")

    def read(whole: Column) -> Column:
        date = F.regexp_replace(F.regexp_replace(whole, _CLOCK, " "), r"\A[\s,]+|[\s,t]+\z", "")
        return bind(F.regexp_replace(date, r"\s+", " "), lambda d: bind(_date_parts(d), lambda day: _at_clock(whole, d, day)))

    return bind(packed, read)


def _at_clock(whole: Column, date: Column, day: Column) -> Column:
    part = lambda k: F.regexp_extract(whole, _CLOCK, k)
    number = lambda digits: F.when(digits == "", 0).otherwise(digits.try_cast("int"))
    hour = number(part(1))
    hour = F.when(part(5) == "", hour).when(hour > 12, None).otherwise(hour % 12 + F.when(part(5) == "p", 12).otherwise(0))
    fraction = F.rpad(F.left(part(4), F.lit(6)), 6, "0")
    second = F.concat(F.when(part(3) == "", "0").otherwise(part(3)), F.lit("."), fraction).try_cast("decimal(8,6)")
    zone = F.when(part(6).rlike(r"\A[+-]"), F.regexp_replace(part(6), r"\A(...):?(..)\z", "$1:$2")).otherwise("UTC")
    return F.when(
        (date != "") & ((part(1) != "") | ~F.contains(whole, F.lit(":"))),
        F.try_make_timestamp(day["year"], day["month"], day["day"], hour, number(part(2)), second, zone),
    )


def _date_parts(date: Column) -> Column:
    """Year, month and day of a written date, null where it has none of the shapes."""
    group = lambda pattern, k: F.regexp_extract(date, pattern, k)

    def fields(year: Column, month: Column, day: Column) -> Column:
        return F.struct(year.alias("year"), month.try_cast("int").alias("month"), day.try_cast("int").alias("day"))

    def full(year: Column) -> Column:
        value = year.try_cast("int")
        return F.when(F.length(year) > 2, value).when(value < LAST_CENTURY, value + 2000).otherwise(value + 1900)

    def month_number(name: Column) -> Column:
        return F.when(name.rlike(r"\A\d"), name).otherwise(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), name).cast("string"))

    a, b, c = (group(_NUMBERS, k) for k in (1, 2, 3))
    year_first = (F.length(a) > 2) | (a.try_cast("int") > 31)
    chosen = F.when(date.rlike(_NUMBERS) & year_first, fields(full(a), b, c)).when(
        date.rlike(_NUMBERS), F.when(a.try_cast("int") > 12, fields(full(c), b, a)).otherwise(fields(full(c), a, b))
    )
    for pattern, year, month, day in _WRITTEN:
        first = F.lit("1")
        found = fields(full(group(pattern, year)), month_number(group(pattern, month)) if month else first, group(pattern, day) if day else first)
        chosen = chosen.when(date.rlike(pattern), found)
    return chosen


def epoch_time(number: Column) -> Column:
    """Seconds or milliseconds since 1970 to timestamp; null outside years 1 to 9999."""
    seconds = F.when(number > MILLIS_ABOVE, number / 1000.0).otherwise(number)
    micros = F.rint(seconds * 1e6).cast("long")
    return F.when(seconds.between(FIRST_SECOND, LAST_SECOND), F.timestamp_micros(micros))


def time_value(record: Column) -> Column:
    """Value of the first time key a record has, null value included."""
    chosen = F.when(F.map_contains_key(record, TIME_KEYS[0]), F.try_element_at(record, F.lit(TIME_KEYS[0])))
    for key in TIME_KEYS[1:]:
        chosen = chosen.when(F.map_contains_key(record, key), F.try_element_at(record, F.lit(key)))
    return chosen


def time_number(value: Column) -> Column:
    """Number in a marked payload value; `true` and `false` count as 1 and 0."""
    return (
        F.when(value.rlike(_JSON_NUMBER), value.try_cast("double"))
        .when(value == "true", F.lit(1.0))
        .when(value == "false", F.lit(0.0))
    )


def event_time(value: Column, number: Column) -> Column:
    """Event time from a marked payload value (see `payload.mark_text`) and its `time_number`.

    Null when the value cannot be read; later time keys are not tried.
    """
    is_text = ~value.rlike(r"\A[\[{]")
    return F.when(number.isNotNull(), epoch_time(number)).when(is_text, iso_time(unmark(value)))
