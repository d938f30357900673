"""Reading JSON payloads that may be torn or encoded twice (runs in Arrow batches on Python workers)."""

from __future__ import annotations

import json
from collections.abc import Iterator

FIELD_TYPES = ("string", "number", "boolean", "array")


def read_payload(text: str | None) -> dict | None:
    """The object in ``text``; a JSON text of a JSON text counts; None where there is no readable object."""
    value: object = text
    try:
        for _ in range(3):
            if not isinstance(value, str):
                break
            value = json.loads(value)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def leaves(value: dict, prefix: str = "") -> Iterator[tuple[str, object]]:
    """Leaf paths joined by dots; only objects are entered."""
    for key, item in value.items():
        path = f"{prefix}.{key}" if prefix else key
        if isinstance(item, dict):
            yield from leaves(item, path)
        else:
            yield path, item


def field_type(value: object) -> str | None:
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, str):
        return "string"
    return "array" if isinstance(value, list) else "number"


def at_path(value: dict, path: str) -> object:
    """The value at a dotted path; a key that itself holds the dots comes first."""
    if path in value:
        return value[path]
    head, dot, rest = path.partition(".")
    while dot:
        if isinstance(inner := value.get(head), dict) and (found := at_path(inner, rest)) is not None:
            return found
        more, dot, rest = rest.partition(".")
        head = f"{head}.{more}"
    return None
