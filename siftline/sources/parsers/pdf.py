"""Text of PDF files: objects, streams, fonts' character maps, text operators.

Objects are found by their ``n g obj`` headers and inside object streams, so damaged
cross-reference tables do no harm.  Only Flate streams are decoded.  An encrypted file
is an error; an unreadable page is skipped.
"""

from __future__ import annotations

import re
import zlib
from typing import Any

from siftline.sources.parsers.office import check_magic

_WHITE = b"\x00\t\n\f\r "
_TOKEN = re.compile(
    rb"[\x00\t\n\f\r ]+|%[^\r\n]*|(?P<open><<)|(?P<close>>>)|(?P<hex><[^<>]*>)|(?P<name>/[^\x00\t\n\f\r ()<>\[\]{}/%]*)"
    rb"|(?P<list>\[)|(?P<end>\])|(?P<string>\()|(?P<word>[^\x00\t\n\f\r ()<>\[\]{}/%]+)|(?P<stray>.)",
    re.DOTALL,
)
#: Ligatures and private code points that stand for letters.
LIGATURES = {
    "\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\ufb05": "ſt", "\ufb06": "st",
    "\ue001": "fi", "\ue002": "fl", "\ue003": "ff", "\ue004": "ffi", "\ue005": "ffl",
}
#: Fixed value: a shift in a TJ array below this is a space between words.
WORD_SHIFT = -50


class Ref(int):
    """The number of an object."""


class Word(bytes):
    """A keyword or number as it stands."""


def literal_end(data: bytes, i: int) -> int:
    """The place after the closing parenthesis of a string that begins before i."""
    depth = 1
    while i < len(data) and depth:
        c = data[i]
        i += 2 if c == 0x5C else 1
        depth += (c == 0x28) - (c == 0x29)
    return i


def literal_string(body: bytes) -> bytes:
    simple = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}

    def escape(m: re.Match) -> bytes:
        c = m[1]
        if c[0] in b"01234567":
            return bytes([int(c, 8) & 255])
        return b"" if c[:1] in b"\r\n" else simple.get(c, c)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", escape, body, flags=re.DOTALL)


def hex_string(body: bytes) -> bytes:
    digits = bytes(c for c in body if c not in _WHITE)
    try:
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode("latin-1"))
    except ValueError:
        return b""


def parse_value(data: bytes, i: int) -> tuple[Any, int]:
    """One object of the file's syntax at i, and where it ends; Word("") at the end."""
    while m := _TOKEN.match(data, i):
        kind, i = m.lastgroup, m.end()
        if kind is None or kind in ("stray", "close"):
            if kind == "close":
                return Word(b">>"), i
            continue
        if kind == "open":
            items: list[Any] = []
            while True:
                v, i = parse_value(data, i)
                if isinstance(v, Word) and v in (b">>", b""):
                    break
                _push(items, v)
            return {k: v for k, v in zip(items[::2], items[1::2], strict=False) if isinstance(k, str)}, i
        if kind == "list":
            items = []
            while True:
                v, i = parse_value(data, i)
                if isinstance(v, Word) and v in (b"]", b""):
                    return items, i
                _push(items, v)
        if kind == "end":
            return Word(b"]"), i
        if kind == "string":
            end = literal_end(data, i)
            return literal_string(data[i : end - 1]), end
        if kind == "hex":
            return hex_string(m[0][1:-1]), i
        if kind == "name":
            return m[0][1:].decode("latin-1"), i
        return Word(m[0]), i
    return Word(b""), len(data)


def _push(items: list[Any], v: Any) -> None:
    if v == b"R" and isinstance(v, Word) and len(items) >= 2 and all(isinstance(x, Word) and x.isdigit() for x in items[-2:]):
        items[-2:] = [Ref(int(items[-2]))]
    else:
        items.append(v)


class File:
    def __init__(self, data: bytes) -> None:
        self.objects: dict[int, Any] = {}
        self.streams: dict[int, bytes] = {}
        for m in re.finditer(rb"(?<![0-9])(\d{1,10})[\x00\t\n\f\r ]+\d{1,5}[\x00\t\n\f\r ]+obj\b", data):
            n = int(m[1])
            self.objects[n], end = parse_value(data, m.end())
            s = re.compile(rb"[\x00\t\n\f\r ]*stream(\r\n|\n|\r)?").match(data, end)
            self.streams.pop(n, None)
            if s and isinstance(self.objects[n], dict):
                stop = data.find(b"endstream", s.end())
                self.streams[n] = data[s.end() : stop if stop >= 0 else len(data)]
        if re.search(rb"/Encrypt[\x00\t\n\f\r ]+\d", data):
            raise ValueError("encrypted PDF")
        for n in [k for k, o in self.objects.items() if isinstance(o, dict) and o.get("Type") == "ObjStm"]:
            self._object_stream(n)

    def _object_stream(self, n: int) -> None:
        data, head = self.stream(n), self.objects[n]
        count, first = int(self.get(head.get("N")) or 0), int(self.get(head.get("First")) or 0)
        numbers = [int(x) for x in data[:first].split()[: 2 * count] if x.isdigit()]
        for k, at in zip(numbers[::2], numbers[1::2], strict=False):
            if k not in self.objects:
                self.objects[k] = parse_value(data, first + at)[0]

    def get(self, v: Any) -> Any:
        for _ in range(20):
            if not isinstance(v, Ref):
                return v
            v = self.objects.get(int(v))
        return None

    def stream(self, n: int) -> bytes:
        head, raw = self.objects.get(n), self.streams.get(n, b"")
        filters = self.get(head.get("Filter")) if isinstance(head, dict) else None
        for f in filters if isinstance(filters, list) else [filters]:
            f = self.get(f)
            if f in ("FlateDecode", "Fl"):
                raw = zlib.decompressobj().decompress(raw)
            elif f is not None:
                raise ValueError(f"filter {f}")
        return raw

    def contents(self, v: Any) -> bytes:
        """A stream, or the streams of a list, one after the other."""
        if isinstance(v, Ref) and isinstance(self.get(v), list):
            v = self.get(v)
        return b"\n".join(self.stream(int(r)) for r in (v if isinstance(v, list) else [v]) if isinstance(r, Ref))

    def pages(self) -> list[tuple[Any, Any]]:
        """(contents, resources) of each page in order; resources are inherited."""
        root = next((o for o in self.objects.values() if isinstance(o, dict) and o.get("Type") == "Catalog"), None)
        out: list[tuple[Any, Any]] = []
        seen: set[int] = set()

        def walk(ref: Any, resources: Any) -> None:
            if isinstance(ref, Ref) and int(ref) in seen:
                return
            seen.add(int(ref) if isinstance(ref, Ref) else -1)
            node = self.get(ref)
            if isinstance(node, dict):
                resources = node.get("Resources", resources)
                kids = self.get(node.get("Kids"))
                if isinstance(kids, list):
                    for kid in kids:
                        walk(kid, resources)
                else:
                    out.append((node.get("Contents"), resources))

        if root:
            walk(root.get("Pages"), None)
        else:  # no catalog: all pages that there are
            out = [(o.get("Contents"), o.get("Resources")) for _, o in sorted(self.objects.items()) if isinstance(o, dict) and o.get("Type") == "Page"]
        return out

    def font_maps(self, resources: Any) -> dict[str, dict[int, str]]:
        fonts = self.get((self.get(resources) or {}).get("Font")) or {}
        maps = {}
        for name, ref in fonts.items():
            to = (self.get(ref) or {}).get("ToUnicode") if isinstance(self.get(ref), dict) else None
            if isinstance(to, Ref):
                maps[name] = parse_cmap(self.stream(int(to)))
        return maps

    def text_of(self, data: bytes, resources: Any, seen: frozenset[int] = frozenset()) -> str:
        """Text of a content stream; of its forms, by name, if it has none itself."""
        found = content_text(data, self.font_maps(resources))
        if found.strip():
            return found
        forms = self.get((self.get(resources) or {}).get("XObject")) or {}
        out = []
        for _, ref in sorted(forms.items()):
            form = self.get(ref)
            if isinstance(ref, Ref) and int(ref) not in seen and isinstance(form, dict) and form.get("Subtype") == "Form":
                out.append(self.text_of(self.stream(int(ref)), form.get("Resources", resources), seen | {int(ref)}))
        return "".join(out)


def hex_token(token: bytes) -> int:
    """The number in <...> of one to four bytes, else -1."""
    body = re.sub(rb"\s", b"", token[1:-1]) if token[:1] == b"<" and token[-1:] == b">" else b""
    return int(body, 16) if re.fullmatch(rb"[0-9A-Fa-f]{1,8}", body) else -1


def parse_cmap(data: bytes) -> dict[int, str]:
    out: dict[int, str] = {}

    def target(hexed: bytes) -> str:
        return hex_string(hexed[1:-1].rjust(4, b"0")).decode("utf-16-be", "replace")

    for m in re.finditer(rb"beginbfchar\b(.*?)endbfchar", data, re.DOTALL):
        tokens = re.findall(rb"<[^>]*>", m[1])
        out |= {hex_token(a): target(b) for a, b in zip(tokens[::2], tokens[1::2], strict=False)}
    for m in re.finditer(rb"beginbfrange\b(.*?)endbfrange", data, re.DOTALL):
        for low, high, to in re.findall(rb"(<[^>]*>)\s*(<[^>]*>)\s*(<[^>]*>)", m[1]):
            a, b, first = hex_token(low), hex_token(high), target(to)
            if 0 <= a <= b < a + 65_536 and first:
                out |= {a + k: first[:-1] + chr(ord(first[-1]) + k) for k in range(b - a + 1) if ord(first[-1]) + k < 0x110000}
    out.pop(-1, None)
    return out


def decode_bytes(raw: bytes) -> str:
    """UTF-16 with a mark, else Latin-1 without control characters."""
    if raw[:2] == b"\xfe\xff":
        s = raw[2:].decode("utf-16-be", "replace")
    else:
        s = "".join(chr(c) for c in raw if c >= 32 or c in b"\n\r\t")
    return "".join(LIGATURES.get(c, c) for c in s)


def decode_string(raw: bytes, cmap: dict[int, str] | None) -> str:
    """Two bytes to a character if the font's map has all of these, else one."""
    if cmap:
        if len(raw) % 2 == 0:
            pairs = [int.from_bytes(raw[i : i + 2]) for i in range(0, len(raw), 2)]
            if pairs and all(p in cmap for p in pairs):
                return "".join(cmap[p] for p in pairs)
        if any(c in cmap for c in raw):
            return "".join(cmap.get(b, "") for b in raw)
    return decode_bytes(raw)


def number(v: Any) -> float:
    try:
        return float(v)
    except (TypeError, ValueError):
        return 0.0


def array_text(items: list[Any], cmap: dict[int, str] | None) -> str:
    out = []
    for v in items:
        if isinstance(v, Word):
            out.append(" " if number(v) < WORD_SHIFT else "")
        elif isinstance(v, bytes):
            out.append(decode_string(v, cmap))
    return "".join(out)


def content_text(data: bytes, fonts: dict[str, dict[int, str]] | None = None) -> str:
    """What the text operators between BT and ET show, lines by their positions."""
    out: list[str] = []
    operands: list[Any] = []
    inside, cmap, last_y, i = False, None, None, 0

    def line(always: bool = False) -> None:
        if always or (out and not out[-1].endswith("\n")):
            out.append("\n")

    def show(text: str) -> None:
        if text:
            out.append(text)

    while True:
        v, i = parse_value(data, i)
        if not isinstance(v, Word) or re.fullmatch(rb"[-+.0-9]+", v):
            operands.append(v)
            continue
        if v == b"":
            return "".join(out)
        top = operands[-1] if operands else None
        if v == b"ID":  # image bytes up to EI between white space
            m = re.compile(rb"[\x00\t\n\f\r ]EI(?=[\x00\t\n\f\r ]|$)").search(data, i)
            i = m.end() if m else len(data)
        elif v == b"BT":
            inside, last_y = True, None
        elif v == b"ET":
            inside = False
            line()
        elif v == b"Tf" and len(operands) >= 2:
            cmap = (fonts or {}).get(operands[-2]) if isinstance(operands[-2], str) else None
        elif inside:
            if v == b"Tj" and isinstance(top, bytes):
                show(decode_string(top, cmap))
            elif v == b"TJ" and isinstance(top, list):
                show(array_text(top, cmap))
            elif v in (b"'", b'"') and isinstance(top, bytes):
                line(True)
                show(decode_string(top, cmap))
            elif v in (b"Td", b"TD"):
                line()
            elif v == b"T*":
                line(True)
            elif v == b"Tm" and len(operands) >= 6:
                y = number(operands[-1])
                if last_y is not None and abs(y - last_y) > 1.0:
                    line()
                last_y = y
        operands = []


def clean_header(data: bytes) -> bytes:
    """Without white space before the header and at the end of its line."""
    data = data.lstrip(b" \t\r\n")
    first, sep, rest = data.partition(b"\n")
    return first.rstrip(b" \t") + sep + rest if sep and len(first) < 20 else data


def pdf(content: bytes) -> str:
    content = clean_header(content)
    try:
        check_magic(content, b"%PDF-")
    except ValueError as e:
        raise ValueError(f"invalid PDF: {e}") from e
    file = File(content)
    pages = []
    for contents, resources in file.pages():
        try:
            text = file.text_of(file.contents(contents), resources)
        except (ValueError, zlib.error, RecursionError):
            continue  # an unreadable page
        if text:
            pages.append(text)
    return "\n".join(pages).strip()
