"""Functions of the query box's SQL that Spark lacks, as temporary SQL functions (no Python in them).

STRFTIME, DATETIME, JULIANDAY and UNIXEPOCH take text, or a Julian day as a number, and up to two
modifiers: 'start of day|month|year' and '+N seconds|minutes|hours|days|months|years'; months and
years go on into the next month where a day doesn't exist.  GLOB(pattern, text) knows *, ? and
[...].  What can't be read as a moment, or another modifier, gives null.  Names that Spark has
already keep their Spark meaning: DATE gives a date, UPPER and LOWER fold all letters.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Letters of a format and their Spark pattern.
FORMATS = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "j": "DDD", "e": "d", "I": "hh", "p": "a", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm"}

_MOMENT = """CASE WHEN lower(t) = 'now' THEN CAST(current_timestamp() AS TIMESTAMP_NTZ)
 WHEN try_cast(t AS DOUBLE) IS NOT NULL THEN TIMESTAMP_NTZ '1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, CAST(round((CAST(t AS DOUBLE) - 2440587.5) * 86400, 3) AS DECIMAL(18, 6)))
 WHEN t RLIKE '^[0-9]{2}:[0-9]{2}' THEN try_cast('2000-01-01 ' || t AS TIMESTAMP_NTZ)
 WHEN t RLIKE '^[0-9]{4}-[0-9]{2}-[0-9]{2}' THEN try_cast(t AS TIMESTAMP_NTZ) END"""

_COUNT = "try_cast(regexp_extract(m, '^ *([+-]?[0-9]+([.][0-9]+)?) +[a-z]+ *$', 1) AS DOUBLE)"
_SECONDS = "CASE regexp_extract(m, '([a-z]+?)s? *$', 1) WHEN 'second' THEN 1 WHEN 'minute' THEN 60 WHEN 'hour' THEN 3600 WHEN 'day' THEN 86400 END"
_MONTHS = "CASE regexp_extract(m, '([a-z]+?)s? *$', 1) WHEN 'month' THEN 1 WHEN 'year' THEN 12 END"
_MOVED = f"""CASE WHEN m IS NULL THEN t
 WHEN lower(trim(m)) IN ('start of day', 'start of month', 'start of year') THEN CAST(date_trunc(substr(lower(trim(m)), 10), t) AS TIMESTAMP_NTZ)
 WHEN {_COUNT} IS NULL THEN NULL
 WHEN {_SECONDS} IS NOT NULL THEN t + make_dt_interval(0, 0, 0, CAST(round({_COUNT} * {_SECONDS}, 3) AS DECIMAL(18, 6)))
 WHEN {_MONTHS} IS NOT NULL THEN CAST(date_add(add_months(trunc(t, 'MONTH'), CAST({_COUNT} * {_MONTHS} AS INT)), day(t) - 1) AS TIMESTAMP_NTZ) + (t - CAST(date_trunc('DAY', t) AS TIMESTAMP_NTZ)) END"""


def _pattern(p: str) -> str:
    """SQL for the regular expression of a GLOB pattern; what lies in brackets stays."""
    outside = r"(?![^\\[]*\\])"
    for sought, put in ((r"([.^$+(){}|\\\\])", r"\\\\$1"), ("[*]", ".*"), ("[?]", ".")):
        p = f"regexp_replace({p}, '{sought}{outside}', '{put}')"
    return p


def statements() -> list[str]:
    """CREATE statements, in the order in which the functions need each other."""
    head = "CREATE OR REPLACE TEMPORARY FUNCTION"
    args = "t STRING DEFAULT 'now', m1 STRING DEFAULT NULL, m2 STRING DEFAULT NULL"
    moment = "_moved(_moved(_moment(t), m1), m2)"
    text = "replace(f, '%%', chr(1))"
    for letter, pattern in FORMATS.items():
        text = f"replace({text}, '%{letter}', date_format(w, '{pattern}'))"
    text = f"replace({text}, '%w', CAST(dayofweek(w) - 1 AS STRING))"
    text = f"replace({text}, '%f', date_format(w, 'ss.SSS'))"
    text = f"replace({text}, '%s', CAST(_epoch(w) AS STRING))"
    days = "(unix_date(CAST(w AS DATE)) + 2440587.5D + (hour(w) * 3600 + minute(w) * 60 + CAST(date_format(w, 'ss.SSS') AS DOUBLE)) / 86400)"
    return [
        f"{head} _moment(t STRING) RETURNS TIMESTAMP_NTZ RETURN {_MOMENT}",
        f"{head} _moved(t TIMESTAMP_NTZ, m STRING) RETURNS TIMESTAMP_NTZ RETURN {_MOVED}",
        f"{head} _epoch(w TIMESTAMP_NTZ) RETURNS BIGINT RETURN unix_date(CAST(w AS DATE)) * 86400L + hour(w) * 3600 + minute(w) * 60 + CAST(date_format(w, 'ss') AS INT)",
        f"{head} _written(f STRING, w TIMESTAMP_NTZ) RETURNS STRING RETURN replace({text}, chr(1), '%')",
        f"{head} _julian(w TIMESTAMP_NTZ) RETURNS DOUBLE RETURN {days}",
        f"{head} strftime(f STRING, {args}) RETURNS STRING RETURN _written(f, {moment})",
        f"{head} datetime({args}) RETURNS STRING RETURN date_format({moment}, 'yyyy-MM-dd HH:mm:ss')",
        f"{head} julianday({args}) RETURNS DOUBLE RETURN _julian({moment})",
        f"{head} unixepoch({args}) RETURNS BIGINT RETURN _epoch({moment})",
        f"{head} glob(p STRING, s STRING) RETURNS BOOLEAN RETURN s RLIKE ('(?s)^' || {_pattern('p')} || '$')",
    ]


def create(spark: SparkSession) -> None:
    for text in statements():
        spark.sql(text)
