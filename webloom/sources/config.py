"""Settings: defaults, then a TOML file, then the environment (WEBLOOM_<SECTION>_<NAME>)."""

from __future__ import annotations

import dataclasses
import os
import tomllib
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Scrape:
    extractor: str = "auto"
    respect_robots: bool = False
    agent: str = "*"


@dataclass(frozen=True)
class Crawl:
    max_depth: int = 2
    max_pages: int = 100
    gap_ms: int = 1000


@dataclass(frozen=True)
class Search:
    limit: int = 10
    title_weight: float = 2.0
    snippet_weight: float = 1.0


@dataclass(frozen=True)
class Cache:
    path: str = ""
    ttl_s: int = 86_400


@dataclass(frozen=True)
class Settings:
    scrape: Scrape = field(default_factory=Scrape)
    crawl: Crawl = field(default_factory=Crawl)
    search: Search = field(default_factory=Search)
    cache: Cache = field(default_factory=Cache)


def _typed(value, kind: str):
    if kind == "bool":
        return value if isinstance(value, bool) else str(value).strip().lower() in ("1", "true", "yes", "on")
    return {"int": int, "float": float, "str": str}[kind](value)


def load(path: str | None = None, environ: dict[str, str] | None = None) -> Settings:
    """ValueError for a key that isn't known or a value that doesn't fit."""
    env = os.environ if environ is None else environ
    given: dict = {}
    if path:
        with open(path, "rb") as f:
            given = tomllib.load(f)
    sections = {}
    for s in dataclasses.fields(Settings):
        kind = s.default_factory
        known = {f.name: str(f.type) for f in dataclasses.fields(kind)}
        values = dict(given.pop(s.name, {}))
        if extra := set(values) - set(known):
            raise ValueError(f"unknown setting {s.name}.{min(extra)}")
        for name in known:
            if (v := env.get(f"WEBLOOM_{s.name}_{name}".upper())) is not None:
                values[name] = v
        sections[s.name] = kind(**{k: _typed(v, known[k]) for k, v in values.items()})
    if given:
        raise ValueError(f"unknown section {min(given)}")
    return Settings(**sections)
