"""String formats: fixed values that a conforming implementation must share, in one place.

The patterns match from the first character to the last; Column expressions anchor them with ``\\z``, as ``$`` also
matches before a final line feed.  White space is that of scripts, which is wider than ASCII's.
"""

from __future__ import annotations

import re

# fixed values
WHITE = r"\s\x0B\x{A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
DATE_TIME = r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})"
DATE = "[0-9]{4}-[0-9]{2}-[0-9]{2}"
EMAIL = r"[^{w}@]+@[^{w}@]+\.[^{w}@]+"
URI = "[a-zA-Z][a-zA-Z0-9+.-]*://[^{w}]+"
TOKEN = "[A-Za-z0-9][A-Za-z0-9_.-]{0,31}"
NAMES = ("uuid", "date-time", "date", "email", "uri")

#: Bits of the formats, in the order of their names.
BIT = {name: 1 << k for k, name in enumerate(NAMES)}
_PYTHON_WHITE = r"\s﻿"
_PATTERNS = {name: re.compile(p.replace("{w}", _PYTHON_WHITE)) for name, p in zip(NAMES, (UUID, DATE_TIME, DATE, EMAIL, URI), strict=True)}
_HINT = re.compile(r"[-@:]")


def whole(pattern: str) -> str:
    """A pattern for a Column expression that must match a value from end to end."""
    return f"^{pattern.replace('{w}', WHITE)}\\z"


def bits(value: str) -> int:
    """Bits of the formats that a string has; the dates exclude each other by their patterns."""
    if not _HINT.search(value):  # each format has one of these marks
        return 0
    return sum(BIT[name] for name, pattern in _PATTERNS.items() if pattern.fullmatch(value))


def names(mask: int) -> list[str]:
    return [name for name in NAMES if mask & BIT[name]]
