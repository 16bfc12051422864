"""Scalar column builders (JVM-side expressions, no Python UDFs).

Each function takes column names or ``Column`` objects and returns a
``Column`` so it stays inside whole-stage codegen.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes (str.isspace()).
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Byte units of the size formatter, 1024 steps.
BYTE_UNITS = ["Bytes", "KB", "MB", "GB"]

# ISO-8601 layouts (fraction printed only when non-zero).
ISO_SECONDS = "yyyy-MM-dd'T'HH:mm:ss"
ISO_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
UPLOAD_STAMP = "yyyyMMdd_HHmmss"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ilike(x, pattern: str) -> Column:
    """case-insensitive LIKE; ``%``/``_`` are live wildcards, and a
    backslash escapes them or itself.  Before any other character it escapes
    that character (which then stands for itself); at the end it is literal."""
    safe = re.sub(r"\\(.?)", lambda m: m[0] if m[1] in ("%", "_", "\\") and m[1] else (m[1] or r"\\"), pattern, flags=re.S)
    return _c(x).ilike(safe)


def strip(x) -> Column:
    """Python ``str.strip()`` -- all Unicode whitespace at both ends."""
    return F.btrim(_c(x), F.lit(PY_WHITESPACE))


def blank_to_null(x) -> Column:
    """Strip, and an empty result counts as an absent argument."""
    return F.nullif(strip(x), F.lit(""))


def isoformat(x) -> Column:
    """timestamp -> ISO-8601 text as Python's ``isoformat()`` prints it."""
    c = _c(x)
    return (F.when(c.isNull(), F.lit(None).cast("string"))
            .when(F.date_format(c, "SSSSSS") == "000000", F.date_format(c, ISO_SECONDS))
            .otherwise(F.date_format(c, ISO_MICROS)))


def parse_upload_stamp(x) -> Column:
    """``YYYYMMDD_HHMMSS`` -> ISO text, also with the ``_n`` of a further
    upload in the same second; anything else is kept raw."""
    c = _c(x)
    parsed = F.try_to_timestamp(F.substring(c, 1, 15), F.lit(UPLOAD_STAMP))
    ok = c.rlike(r"^[0-9]{8}_[0-9]{6}(_[0-9]+)?$") & parsed.isNotNull()
    return F.when(ok, isoformat(parsed)).otherwise(c)


def format_upload_stamp(x) -> Column:
    """timestamp -> ``YYYYMMDD_HHMMSS``."""
    return F.date_format(_c(x), UPLOAD_STAMP)


def epoch_seconds_between(start, end) -> Column:
    """seconds from ``start`` to ``end`` (works on TIMESTAMP_NTZ)."""
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end)) / F.lit(1e6)


def round2(x) -> Column:
    """round to 2 decimals, half away from zero."""
    return F.round(_c(x), 2)


def ceil_div(n, size) -> Column:
    """F8: page count = ceil(n / size) on integers."""
    n, size = _c(n), _c(size) if not isinstance(size, int) else F.lit(size)
    return F.floor((n + size - F.lit(1)) / size).cast("bigint")


def json_text(x, key: str) -> Column:
    """top-level ``->>`` access: strings unquoted, objects as JSON text,
    JSON null as SQL null.  Dotted keys are taken literally."""
    return F.from_json(_c(x), "map<string,string>")[key]


def json_has_key(x, key: str) -> Column:
    """Top-level key present, also when its value is JSON null."""
    return F.array_contains(F.json_object_keys(_c(x)), F.lit(key))


def basename_no_ext(x) -> Column:
    """last path element without its extension (query and fragment cut)."""
    last = F.element_at(F.split(F.regexp_replace(_c(x), r"[?#].*$", ""), "/"), -1)
    return F.regexp_replace(last, r"\.[^.]*$", "")


def format_bytes(x) -> Column:
    """0 -> '0 Bytes'; else 1024-step unit, at most 2 decimals, no trailing zeros."""
    b = _c(x).cast("double")
    idx = F.floor(F.log(1024.0, b)).cast("int")
    idx = F.least(F.greatest(idx, F.lit(0)), F.lit(len(BYTE_UNITS) - 1))
    scaled = F.round(b / F.pow(F.lit(1024.0), idx), 2)
    text = F.regexp_replace(F.format_string("%.2f", scaled), r"\.?0+$", "")
    units = F.array(*[F.lit(u) for u in BYTE_UNITS])
    return (F.when(b == 0, F.lit("0 Bytes"))
            .otherwise(F.concat(text, F.lit(" "), F.element_at(units, idx + 1))))


def format_number(x) -> Column:
    """thousands separators on an integer value."""
    return F.format_number(_c(x).cast("bigint"), 0)


def percent(num, den) -> Column:
    """guarded ratio * 100 (0 when the denominator is not positive)."""
    n, d = _c(num), _c(den)
    return F.when(d > 0, F.lit(100.0) * n / d).otherwise(F.lit(0.0))
