"""Tables and trees: CSV as lines of tabs; JSON, YAML and TOML as indented JSON."""

from __future__ import annotations

import datetime
import json
import math
from decimal import Decimal
from typing import Any


def csv(content: bytes) -> str:
    """Each record joined by tabs.  Strict: as many fields in each record as in the
    first, quotes only around a whole field."""
    text = content.decode("utf-8", "replace").replace("\r\n", "\n")
    records: list[list[str]] = []
    record: list[str] = []
    i, n = 0, len(text)
    while i < n:
        if not record and text[i] == "\n":
            i += 1  # blank line
            continue
        if text[i] == '"':
            value, i = _quoted(text, i + 1)
        else:
            end = min(x for x in (text.find(",", i), text.find("\n", i), n) if x >= 0)
            value, i = text[i:end], end
            if '"' in value:
                raise ValueError('parsing CSV: bare " in a field')
        record.append(value)
        if i < n and text[i] == ",":
            i += 1
            if i == n or text[i] == "\n":
                record.append("")
            else:
                continue
        if i < n and text[i] != "\n":
            raise ValueError('parsing CSV: extraneous " in a field')
        i += 1
        if records and len(record) != len(records[0]):
            raise ValueError("parsing CSV: wrong number of fields")
        records.append(record)
        record = []
    return "".join("\t".join(r) + "\n" for r in records)


def _quoted(text: str, i: int) -> tuple[str, int]:
    parts = []
    while True:
        end = text.find('"', i)
        if end < 0:
            raise ValueError('parsing CSV: missing " at the end of a field')
        parts.append(text[i:end])
        if text[end + 1 : end + 2] != '"':
            return "".join(parts), end + 1
        parts.append('"')
        i = end + 2


def _number(x: float) -> str:
    if math.isnan(x) or math.isinf(x):
        raise ValueError(f"unsupported value: {x}")
    if x == 0:
        return "-0" if math.copysign(1, x) < 0 else "0"
    if 1e-6 <= abs(x) < 1e21:
        plain = format(Decimal(repr(x)), "f")
        return plain.rstrip("0").rstrip(".") if "." in plain else plain
    mantissa, exponent = repr(x).split("e")
    sign, digits = exponent[0] if exponent[0] in "+-" else "+", exponent.lstrip("+-").lstrip("0")
    return f"{mantissa.removesuffix('.0')}e{sign}{digits if sign == '-' else digits.zfill(2)}"


def _string(s: str) -> str:
    out = json.dumps(s, ensure_ascii=False)
    for c in "<>&\u2028\u2029":
        out = out.replace(c, f"\\u{ord(c):04x}")
    return out


def indented(value: Any, pad: str = "") -> str:
    """JSON with sorted keys and two spaces for each level."""
    inner = pad + "  "
    if isinstance(value, dict):
        if not all(isinstance(k, str) for k in value):
            raise ValueError("a key is no string")
        rows = [f"{inner}{_string(k)}: {indented(value[k], inner)}" for k in sorted(value, key=lambda k: k.encode())]
        return "{\n" + ",\n".join(rows) + f"\n{pad}}}" if rows else "{}"
    if isinstance(value, list):
        return "[\n" + ",\n".join(inner + indented(v, inner) for v in value) + f"\n{pad}]" if value else "[]"
    if isinstance(value, (datetime.datetime, datetime.date, datetime.time)):
        s = value.isoformat()
        return _string(s.replace("+00:00", "Z"))
    if isinstance(value, float):
        return _number(value)
    return _string(value) if isinstance(value, str) else json.dumps(value)


def json_text(content: bytes) -> str:
    def refuse(name: str) -> Any:
        raise ValueError(f"parsing JSON: {name}")

    return indented(json.loads(content.decode("utf-8", "replace"), parse_int=float, parse_constant=refuse))


def toml_text(content: bytes) -> str:
    import tomllib

    return indented(tomllib.loads(content.decode("utf-8")))


def yaml_text(content: bytes) -> str:
    """The first document; yes, no, on and off are strings."""
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    Loader.yaml_implicit_resolvers = {k: [r for r in v if r[0] != "tag:yaml.org,2002:bool"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
    import re

    Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile("^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))
    try:
        first = next(iter(yaml.load_all(content.decode("utf-8", "replace"), Loader)), None)
    except yaml.YAMLError as e:
        raise ValueError(f"parsing YAML: {e}") from e
    return indented(first)
