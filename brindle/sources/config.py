"""Typed configurations: JSON texts against a schema of (type, default, check)."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from typing import Any

Schema = Mapping[str, tuple[type, Any, Callable[[Any], bool]]]


def load(text: str, schema: Schema) -> dict[str, Any]:
    """The settings of a JSON object with defaults; unknown and repeated keys, other types (a boolean is no number) and values out of range raise ValueError."""

    def once(pairs):
        keys = [k for k, _ in pairs]
        if len(keys) != len(set(keys)):
            raise ValueError("repeated key")
        return dict(pairs)

    given = json.loads(text, object_pairs_hook=once)
    if not isinstance(given, dict) or set(given) - set(schema):
        raise ValueError(f"unknown settings: {sorted(set(given) - set(schema)) if isinstance(given, dict) else given!r}")
    out = {}
    for name, (kind, default, fits) in schema.items():
        value = given.get(name, default)
        if type(value) is not kind and not (kind is float and type(value) is int) or not fits(value):
            raise ValueError(f"{name}: {value!r}")
        out[name] = value
    return out


def problem(text: str, schema: Schema) -> str | None:
    """What load would refuse, or None."""
    try:
        load(text, schema)
    except ValueError as e:
        return str(e)
    return None
