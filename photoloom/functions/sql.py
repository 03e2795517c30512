"""DuckDB texts of the key functions, for the oracles."""

from __future__ import annotations

from photoloom.functions.keys import EMPTY_SHA256


def place_sql(c: str) -> str:
    stripped = rf"replace(regexp_replace(nfc_normalize({c}), '^\s+|\s+$', '', 'g'), '\', '/')"
    return rf"nullif(lower(trim(regexp_replace('/' || {stripped} || '/', '/(?:\.?/)+', '/', 'g'), '/')), '')"


def category_sql(c: str) -> str:
    return rf"nullif(lower(regexp_replace({c}, '^\s+|\s+$', '', 'g')), '')"


def content_sql(c: str) -> str:
    return f"nullif(nullif(lower(regexp_extract({c}, '([0-9a-fA-F]{{64}})', 1)), ''), '{EMPTY_SHA256}')"
