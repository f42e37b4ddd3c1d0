"""Lenient JSON for Arrow workers: text in a text, lists that are no lists, strict numbers."""

from __future__ import annotations

import json


def _no(x: str) -> None:
    raise ValueError(x)


def parse(text: str | None) -> object:
    """The value of a JSON text, None where it is null or can't be parsed. A JSON string holding JSON counts as that JSON.

    NaN and Infinity aren't JSON. A string that holds no JSON comes back as it is.
    """
    if text is None:
        return None
    try:
        value = json.loads(text, parse_constant=_no)
    except (ValueError, RecursionError):
        return None
    while isinstance(value, str):
        try:
            inner = json.loads(value, parse_constant=_no)
        except (ValueError, RecursionError):
            return value
        value = inner
    return value


def as_list(value: object) -> list:
    """A list as it is, None as an empty one, anything else as a list of one."""
    return value if isinstance(value, list) else [] if value is None else [value]
