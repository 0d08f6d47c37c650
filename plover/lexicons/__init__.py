"""Word lists of the index. Index and queries must use the same ones."""

from __future__ import annotations

import json
from functools import cache
from importlib import resources


@cache
def load(name: str) -> dict:
    """A word list by name; works from a folder and from a zipped package."""
    return json.loads(resources.files(__package__).joinpath(f"{name}.json").read_text("utf-8"))


def stopwords() -> list[str]:
    return load("stopwords")["stopwords"]


def aspects() -> dict[str, dict[str, list[str]]]:
    return load("aspects")["aspects"]
