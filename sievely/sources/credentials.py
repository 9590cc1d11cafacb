"""Credentials by an ordered chain of providers, resolved where they are used.

A chain is data (names, paths, commands) and is what plans and closures hold; the secret itself is looked up in the worker
that sends it and never becomes part of a plan, a column or a log.
"""

from __future__ import annotations

import json
import os
import subprocess
import tomllib
from collections.abc import Callable
from dataclasses import dataclass

#: Seconds that a command may take.
COMMAND_SECONDS = 30


def _environment(name: str) -> str | None:
    return os.environ.get(name)


def _in_file(load: Callable) -> Callable[[str], str | None]:
    """A provider of "path#key.key": the value there, or None."""

    def find(place: str) -> str | None:
        path, _, keys = place.partition("#")
        try:
            with open(os.path.expanduser(path), "rb") as f:
                value = load(f)
        except (OSError, ValueError):
            return None
        for key in keys.split("."):
            value = value.get(key) if isinstance(value, dict) else None
        return value if isinstance(value, str) else None

    return find


def _command(line: str) -> str | None:
    try:
        done = subprocess.run(line.split(), stdin=subprocess.DEVNULL, capture_output=True, timeout=COMMAND_SECONDS, check=True)
    except (OSError, subprocess.SubprocessError):
        return None
    return done.stdout.decode("utf-8", "replace")


PROVIDERS: dict[str, Callable[[str], str | None]] = {"env": _environment, "toml": _in_file(tomllib.load), "json": _in_file(json.load), "command": _command}


@dataclass(frozen=True)
class Chain:
    """Providers in order, as "kind:what": env:NAME, toml:PATH#key.key, json:PATH#key.key, command:PROGRAM ARGUMENTS."""

    providers: tuple[str, ...]

    @classmethod
    def of(cls, *providers: str) -> Chain:
        for p in providers:
            if p.partition(":")[0] not in PROVIDERS or not p.partition(":")[2]:
                raise ValueError(f"no such source of a key: {p.partition(':')[0]}")
        return cls(providers)

    def resolve(self) -> str | None:
        """The first that is there and not blank; a process looks once."""
        if self not in _resolved:
            found = (PROVIDERS[kind](what) for kind, _, what in (p.partition(":") for p in self.providers))
            _resolved[self] = next((x.strip() for x in found if x and x.strip()), None)
        return _resolved[self]


_resolved: dict[Chain, str | None] = {}
