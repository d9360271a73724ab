"""The declared mapping of records: which fields are the id, title, text, group, date, filters, display; ranking; kinds."""

from __future__ import annotations

import dataclasses
import math
import os
import tomllib
from dataclasses import dataclass, field
from typing import Any

FORMATS = ("auto", "jsonl", "json", "csv", "tsv", "sqlite")


class BadConfig(ValueError):
    pass


@dataclass
class Fields:
    id: str | None = None
    title: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    group: str | None = None
    group_name: str | None = None
    date: list[str] = field(default_factory=list)
    filters: list[str] = field(default_factory=list)
    display: list[str] = field(default_factory=list)
    empty_values: list[str] = field(default_factory=list)

    def check(self) -> None:
        if self.group_name and not self.group:
            raise BadConfig("group_name needs group")
        paths = [self.id, self.group, self.group_name, *self.title, *self.text, *self.date, *self.filters, *self.display]
        if any(p is not None and not p.strip() for p in paths):
            raise BadConfig("a field path is empty")


@dataclass
class Boost:
    field: list[str]
    weight: float
    equals: str | None = None


@dataclass
class Rank:
    title_weight: float = 2.0
    boost: list[Boost] = field(default_factory=list)


@dataclass
class About:
    name: str | None = None
    description: str | None = None
    record: str = "record"
    group: str = "group"


@dataclass
class SourceConfig:
    paths: list[str] = field(default_factory=list)
    format: str = "auto"
    sql: str | None = None


@dataclass
class KindConfig:
    name: str = ""
    record: str = "record"
    group: str = "group"
    paths: list[str] = field(default_factory=list)
    format: str = "auto"
    sql: str | None = None
    fields: Fields = field(default_factory=Fields)


@dataclass
class MemoryConfig:
    path: str | None = None
    namespace: str = "default"
    read: list[str] = field(default_factory=list)
    budget: int = 800
    briefing_budget: int = 600
    max_chars: int = 400
    half_life: dict[str, float] = field(default_factory=dict)
    pin: list[str] = field(default_factory=list)


@dataclass
class Config:
    about: About = field(default_factory=About)
    source: SourceConfig = field(default_factory=SourceConfig)
    fields: Fields = field(default_factory=Fields)
    rank: Rank = field(default_factory=Rank)
    memory: MemoryConfig = field(default_factory=MemoryConfig)
    kinds: list[KindConfig] = field(default_factory=list)

    def validate(self) -> Config:
        self.fields.check()
        if not (math.isfinite(self.rank.title_weight) and self.rank.title_weight >= 0):
            raise BadConfig("title_weight must be a number of at least 0")
        for b in self.rank.boost:
            if not b.field or any(not p.strip() for p in b.field):
                raise BadConfig("a boost needs a field")
            if not (math.isfinite(b.weight) and b.weight > -1):
                raise BadConfig("a boost's weight must be above -1")
        m = self.memory
        for name, value, lo, hi in (("budget", m.budget, 50, 20_000), ("briefing_budget", m.briefing_budget, 50, 20_000), ("max_chars", m.max_chars, 40, 4_000)):
            if not lo <= value <= hi:
                raise BadConfig(f"memory.{name} must lie in {lo}..{hi}")
        if any(not (math.isfinite(d) and d >= 0) for d in m.half_life.values()):
            raise BadConfig("half-lives must be at least 0")
        names = []
        for k in self.kinds:
            k.name = kind_name(k.name)
            k.fields.check()
            names.append(k.name)
        if len(set(names)) != len(names):
            raise BadConfig("kinds must have different names")
        for s in (self.source, *self.kinds):
            if s.format not in FORMATS:
                raise BadConfig(f"unknown format {s.format!r}")
        return self

    def mappings(self) -> list[tuple[str | None, Fields]]:
        """(kind, fields): one without a kind, or one for each kind."""
        return [(k.name, k.fields) for k in self.kinds] or [(None, self.fields)]

    def filter_fields(self) -> list[str]:
        own = ["_kind"] if self.kinds else []
        return list(dict.fromkeys(own + [p for _, f in self.mappings() for p in f.filters]))

    def has(self, role: str) -> bool:
        return any(bool(getattr(f, role)) for _, f in self.mappings())

    def to_dict(self) -> dict:
        return dataclasses.asdict(self)


def kind_name(raw: str) -> str:
    """Lower case letters, digits and dashes; runs of anything else are one underscore."""
    out = ""
    for c in raw.strip().lower():
        out += c if c.isalnum() or c == "-" else "" if out.endswith("_") else "_"
    return out.strip("_") or "records"


_MANY = {"title", "date", "field"}
_NESTED = {"about": About, "source": SourceConfig, "fields": Fields, "rank": Rank, "memory": MemoryConfig}
_LISTS = {"kinds": KindConfig, "boost": Boost}


def _build(cls: type, data: dict[str, Any], where: str) -> Any:
    known = {f.name for f in dataclasses.fields(cls)}
    if unknown := set(data) - known:
        raise BadConfig(f"unknown key {sorted(unknown)[0]!r} in {where}")
    args = {}
    for k, v in data.items():
        if k in _LISTS and isinstance(v, list):
            v = [_build(_LISTS[k], x, f"{where}.{k}") for x in v]
        elif k in _NESTED and isinstance(v, dict):
            v = _build(_NESTED[k], v, f"{where}.{k}")
        elif k in _MANY and isinstance(v, str):
            v = [v]
        args[k] = v
    try:
        return cls(**args)
    except TypeError as e:
        raise BadConfig(f"{where}: {e}") from None


def from_dict(data: dict[str, Any]) -> Config:
    return _build(Config, data, "config").validate()


def load(path: str) -> Config:
    """Read a TOML file; relative source paths are taken from its folder."""
    with open(path, "rb") as f:
        config = from_dict(tomllib.load(f))
    base = os.path.dirname(os.path.abspath(path))
    at = lambda p: p if p == "-" or os.path.isabs(p) else os.path.join(base, p)
    for s in (config.source, *config.kinds):
        s.paths = [at(p) for p in s.paths]
    if config.memory.path and not config.memory.path.startswith("~"):
        config.memory.path = at(config.memory.path)
    return config
