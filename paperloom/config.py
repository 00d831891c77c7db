"""Settings from a file, a dict or the defaults."""

from __future__ import annotations

import dataclasses
import json
import os

from .schemas import Settings, TypeSetting


def load_settings(path: str | None = None, values: dict | None = None) -> Settings:
    """A path wins over values, values over the defaults. Unknown names are an error, not silence.

    Files are JSON, or YAML where a YAML parser is installed. types may change fields of single entity types.
    """
    if path is not None:
        with open(path, encoding="utf-8") as f:
            if os.path.splitext(path)[1] in (".yaml", ".yml"):
                try:
                    import yaml
                except ImportError as e:
                    raise ValueError("no YAML parser is installed; use JSON") from e
                values = yaml.safe_load(f)
            else:
                values = json.load(f)
    values = dict(values or {})
    known = {f.name for f in dataclasses.fields(Settings)}
    if unknown := set(values) - known:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    base = Settings()
    types = dict(base.types)
    for name, changes in (values.pop("types", None) or {}).items():
        if name not in types:
            raise ValueError(f"unknown entity type: {name!r}")
        changes = {k: tuple(v) if isinstance(v, list) else v for k, v in changes.items()}
        types[name] = TypeSetting(**(dataclasses.asdict(types[name]) | changes))
    return dataclasses.replace(base, types=types, **values)
