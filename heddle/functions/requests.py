"""What a request may ask for, checked before any plan is built."""

from __future__ import annotations

import re

from heddle.functions import fixed_values as V


def _matching(value: str, pattern: str, what: str) -> str:
    value = value.strip()
    if not re.match(pattern, value):
        raise ValueError(f"invalid {what}")
    return value


def symbol(value: str) -> str:
    return _matching(value, V.SYMBOL_PATTERN, "gene symbol")


def screen_id(value: str) -> str:
    return _matching(value, V.SCREEN_ID_PATTERN, "screen id")


def context(value: str) -> str:
    return _matching(value, V.CONTEXT_PATTERN, "context")


def organism(value: str | None) -> str:
    """human or mouse from any known name; human if nothing is said; an unknown name is an error, not human."""
    if value is None or not value.strip():
        return "human"
    known = V.ORGANISM_ALIASES.get(value.strip().lower())
    if known is None:
        raise ValueError(f"unknown organism {value!r}")
    return known
