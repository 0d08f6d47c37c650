"""The collection's configuration: read, checked, selected from, and identified."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass
from pathlib import Path

REQUIRED = ("apiBaseUrl", "apiVersion", "specificationUrl", "selectedOn")
_HANDLE = re.compile(r"[A-Za-z0-9_]{1,15}")


@dataclass(frozen=True)
class Account:
    handle: str
    user_id: str
    cohort: str


@dataclass(frozen=True)
class CollectionConfig:
    settings: dict
    accounts: tuple[Account, ...]

    @property
    def identity(self) -> str:
        """Digest of the canonical JSON (sorted keys): the same for any spelling of the same configuration."""
        whole = {**self.settings, "accounts": [vars(a) for a in self.accounts]}
        return hashlib.sha256(json.dumps(whole, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()

    def select(self, handles: list[str] | None = None, cohort: str | None = None) -> tuple[Account, ...]:
        """The accounts named, or of a cohort, in configured order; a name that isn't configured is an error."""
        wanted = {h.removeprefix("@").lower() for h in handles or []}
        if unknown := wanted - {a.handle.lower() for a in self.accounts}:
            raise ValueError(f"not configured: {', '.join(sorted(unknown))}")
        return tuple(a for a in self.accounts if (not wanted or a.handle.lower() in wanted) and cohort in (None, a.cohort))


def parse_config(value: dict) -> CollectionConfig:
    for key in REQUIRED:
        if not str(value.get(key) or "").strip():
            raise ValueError(f"{key} must be a non-empty string")
    accounts, seen = [], set()
    for i, entry in enumerate(value.get("accounts") or []):
        handle, user_id = str(entry.get("handle", "")).removeprefix("@"), entry.get("expectedUserId")
        if not _HANDLE.fullmatch(handle):
            raise ValueError(f"accounts[{i}].handle is not valid: {handle}")
        if not (isinstance(user_id, str) and user_id.isascii() and user_id.isdigit()):
            raise ValueError(f"accounts[{i}].expectedUserId must be a string of digits")
        for name in (handle.lower(), f"#{user_id}"):
            if name in seen:
                raise ValueError(f"accounts[{i}] is there twice")
            seen.add(name)
        accounts.append(Account(handle, user_id, str(entry.get("cohort", ""))))
    if not accounts:
        raise ValueError("no accounts")
    return CollectionConfig({k: v for k, v in value.items() if k != "accounts"}, tuple(accounts))


def read_config(path: str) -> CollectionConfig:
    return parse_config(json.loads(Path(path).read_text("utf-8")))
