"""Python values as SQL literals."""

from __future__ import annotations

from collections.abc import Iterable


def text(value: str) -> str:
    """A string literal; control and non-ASCII characters are escaped."""
    out = []
    for char in value:
        if char in "'\\":
            out.append("\\" + char)
        elif " " <= char <= "~":
            out.append(char)
        else:
            out.append(f"\\u{ord(char):04x}" if ord(char) < 0x10000 else f"\\U{ord(char):08x}")
    return "'" + "".join(out) + "'"


def texts(values: Iterable[str]) -> str:
    """An array of string literals."""
    items = ", ".join(text(value) for value in values)
    return f"array({items})" if items else "CAST(array() AS array<string>)"


def one_of(expression: str, values: Iterable[str]) -> str:
    return f"{expression} IN ({', '.join(text(value) for value in values)})"


def any_of(conditions: Iterable[str]) -> str:
    return "(" + " OR ".join(conditions) + ")"
