"""Printed forms of values, as parsers need them."""

from __future__ import annotations

import numpy as np


def value_text(kind: str, value) -> str:
    """Floats print shortest and without an exponent, booleans in lower case, empty cells as nothing."""
    if kind == "empty" or value is None:
        return ""
    if kind == "bool":
        return "true" if value else "false"
    if kind == "float":
        if value != value or value in (float("inf"), float("-inf")):
            return "NaN" if value != value else "inf" if value > 0 else "-inf"
        return np.format_float_positional(value, unique=True, trim="-")
    return str(value)
