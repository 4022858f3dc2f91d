"""Names that depend on the names before them: JSON keys of headers, file names in a folder."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable
from itertools import chain, count

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _numbered(names: Iterable[tuple[str, str]], mark: str, same: Callable[[str], str]) -> list[str]:
    """Names given as (stem, end), told apart by numbers between the two.

    Each wish has an endless row of suffixes: none, then 2, 3 and so on. Equal wishes share a row and go on where the one
    before stopped, past every name that is given by then, so that many equal ones take time in proportion.
    """
    rows: dict[str, Iterable[str]] = {}
    given: dict[str, str] = {}
    for stem, end in names:
        row = rows.setdefault(same(stem + end), chain([""], (f"{mark}{n}" for n in count(2))))
        name = next(x for x in (stem + suffix + end for suffix in row) if same(x) not in given)
        given[same(name)] = name
    return list(given.values())


def json_keys(headers: Iterable[str]) -> list[str]:
    """Distinct keys for a header row: blank ones become column_N, repeats take the first free base_2, base_3 and so on."""
    return _numbered(((header if header.strip() else f"column_{place}", "") for place, header in enumerate(headers, 1)), "_", str)


def folded(name: str) -> str:
    """Equal for names that may be one file on some file systems."""
    return unicodedata.normalize("NFC", name.lower())


def file_names(names: Iterable[str]) -> list[str]:
    """Names for files of one folder, in order: a taken one gets -2, -3 and so on before its extension."""
    def parts(name: str) -> tuple[str, str]:
        at = name.rfind(".")
        return (name[:at], name[at:]) if at > 0 else (name, "")

    return _numbered(map(parts, names), "-", folded)


def json_keys_column(headers: Column) -> Column:
    """json_keys on an array column: one small array for each table, in Arrow batches."""

    @F.pandas_udf("array<string>")
    def keys(batch: pd.Series) -> pd.Series:
        return batch.map(lambda h: json_keys(list(h)))

    return keys(headers)


def file_names_column(names: Column) -> Column:
    """file_names on an array column of the names of one folder."""

    @F.pandas_udf("array<string>")
    def claimed(batch: pd.Series) -> pd.Series:
        return batch.map(lambda n: file_names(list(n)))

    return claimed(names)
