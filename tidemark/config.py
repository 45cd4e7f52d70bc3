"""Settings of a project, from a JSON file beside it."""

from __future__ import annotations

import json
from collections.abc import Collection
from dataclasses import dataclass, fields
from pathlib import Path

FILE = "tidemark.config.json"


@dataclass(frozen=True)
class Config:
    """Each setting is None where it isn't given."""

    dir: str | None = None
    name: str | None = None
    target: str | None = None
    prefixes: list[str] | None = None
    out: str | None = None
    targets: list[str] | None = None
    includePrefixes: list[str] | None = None
    excludePrefixes: list[str] | None = None
    maxBodyBytes: int | None = None
    redactHeaders: list[str] | None = None


def load(folder: str = ".") -> Config | None:
    """The settings in ``folder`` itself, None where there is no file; a malformed file is an error."""
    path = Path(folder) / FILE
    if not path.exists():
        return None
    try:
        found = json.loads(path.read_text(encoding="utf-8"))
    except ValueError as error:
        raise ValueError(f"Failed to parse {path}: {error}") from None
    if not isinstance(found, dict):
        raise ValueError(f"Invalid settings in {path}: expected an object.")
    known = {f.name for f in fields(Config)}
    return Config(**{k: v for k, v in found.items() if k in known})


def layer(options: dict, explicit: Collection[str], overrides: dict) -> dict:
    """Options with settings laid under those that were given explicitly."""
    return options | {k: v for k, v in overrides.items() if v is not None and k not in explicit}
