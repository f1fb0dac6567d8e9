"""Where the store and its index are, from arguments, a config file or defaults."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass
from pathlib import Path

from factloom.requests import SetupError

CONFIG_NAME, DEFAULT_STORE = "factloom.toml", ".factloom/graph"


@dataclass(frozen=True)
class Settings:
    store: Path
    fts_store: Path
    index: Path
    config: Path | None
    values: dict


def nearest_config(start: Path) -> Path | None:
    """The config file of start or of its nearest ancestor that has one."""
    for folder in (start, *start.parents):
        if (folder / CONFIG_NAME).is_file():
            return folder / CONFIG_NAME
    return None


def resolve(start: str | Path, store: str | None = None, config: str | None = None, fts_store: str | None = None) -> Settings:
    """An explicit store wins over an explicit config, that over the nearest one, that over the default.

    Full text lives in the graph's store unless told otherwise; the index lies beside it."""
    base = Path(start)
    found = Path(config) if config else nearest_config(base)
    if config and not found.is_file():
        raise SetupError(f"no config file {config}")
    values = tomllib.loads(found.read_text()) if found else {}
    home = found.parent if found else base
    named = values.get("store", {})
    graph = Path(store) if store else home / named.get("path", DEFAULT_STORE)
    text = Path(fts_store) if fts_store else (home / named["fts_path"] if named.get("fts_path") and not store else graph)
    return Settings(graph, text, text.with_suffix(".index"), found, values)
