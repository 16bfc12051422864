"""Small DuckDB SQL snippets used by the oracle texts (the independent check)."""

from __future__ import annotations


def iso_sql(c: str) -> str:
    """ISO-8601 text as Python prints it (fraction only when non-zero)."""
    return (f"case when {c} is null then null when strftime({c}, '%f') = '000000' "
            f"then strftime({c}, '%Y-%m-%dT%H:%M:%S') else strftime({c}, '%Y-%m-%dT%H:%M:%S.%f') end")


# The same character set as vellum.functions.scalar.PY_WHITESPACE, written
# as a DuckDB string expression (chr() code points).
_WS_CODES = [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
             0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
WS_SQL = " || ".join(f"chr({c})" for c in _WS_CODES)


def strip_sql(c: str) -> str:
    return f"trim({c}, {WS_SQL})"
