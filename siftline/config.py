"""Settings of the engine: a YAML file with ``${ENV}``, defaults and checks."""

from __future__ import annotations

import os
import socket
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any


@dataclass
class Embedder:
    base_url: str = ""
    model: str = ""
    api_key: str = ""
    dimensions: int = 768
    timeout_seconds: float = 60.0


@dataclass
class Worker:
    pool_size: int = 3
    max_retries: int = 3
    queue_size: int = 0
    queue_bytes: int = 0  # a micro-batch by its bytes and not by its files
    lease_seconds: float = 60.0

    def queue(self) -> int:
        return self.queue_size if self.queue_size > 0 else 10 * self.pool_size


@dataclass
class Chunker:
    size: int = 512  # words
    overlap: int = 64


@dataclass
class Search:
    default_limit: int = 5


@dataclass
class Upload:
    max_size_mb: int = 50
    allow_blank: bool = False  # files without words complete, with no chunks, and don't fail


@dataclass
class ApiKey:
    key: str = ""
    namespaces: list[str] = field(default_factory=list)


@dataclass
class Auth:
    api_keys: list[ApiKey] = field(default_factory=list)


@dataclass
class Namespace:
    name: str = ""
    description: str = ""


@dataclass
class Config:
    embedder: Embedder = field(default_factory=Embedder)
    worker: Worker = field(default_factory=Worker)
    chunker: Chunker = field(default_factory=Chunker)
    search: Search = field(default_factory=Search)
    upload: Upload = field(default_factory=Upload)
    auth: Auth = field(default_factory=Auth)
    namespaces: list[Namespace] = field(default_factory=list)
    instance_id: str = field(default_factory=socket.gethostname)

    def check(self) -> Config:
        c = self.chunker
        if c.size < 1 or c.overlap < 0 or c.overlap >= c.size:
            raise ValueError("chunker.overlap must be from 0 to below chunker.size")
        if self.worker.max_retries < 1:
            raise ValueError("worker.max_retries must be at least 1")
        if self.embedder.dimensions < 1:
            raise ValueError("embedder.dimensions must be at least 1")
        return self


_LISTS = {"api_keys": ApiKey, "namespaces": Namespace}


def _fill(kind: type, values: dict[str, Any] | None) -> Any:
    made = kind()
    for f in fields(kind):
        value = (values or {}).get(f.name)
        if value is None:
            continue
        default = getattr(made, f.name)
        if is_dataclass(default):
            value = _fill(type(default), value)
        elif isinstance(default, list) and f.name in _LISTS and all(isinstance(v, dict) for v in value):
            value = [_fill(_LISTS[f.name], v) for v in value]
        elif isinstance(default, (int, float)) and not value:
            continue  # zero stands for the default
        setattr(made, f.name, value)
    return made


def load(path: str) -> Config:
    """The settings in a YAML file; unset variables are empty."""
    import re

    import yaml

    with open(path, encoding="utf-8") as f:
        text = re.sub(r"\$\{(\w+)\}|\$(\w+)", lambda m: os.environ.get(m[1] or m[2], ""), f.read())
    return _fill(Config, yaml.safe_load(text)).check()
