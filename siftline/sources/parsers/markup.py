"""HTML and XML: text between tags, one stretch to a line."""

from __future__ import annotations

from xml.parsers import expat
from html.parser import HTMLParser

#: White space in the sense of the trimming functions here.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


class _Html(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[str] = []
        self.silent: str | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.silent = tag

    def handle_endtag(self, tag: str) -> None:
        if tag == self.silent:
            self.silent = None

    def handle_data(self, data: str) -> None:
        if self.silent is None and (line := data.strip(SPACES)):
            self.lines.append(line)


def html(content: bytes) -> str:
    p = _Html()
    p.feed(content.decode("utf-8", "replace"))
    p.close()
    return "\n".join(p.lines).strip(SPACES)


def character_data(content: bytes, on_text, on_end=None) -> None:
    """Call on_text for each stretch of text and on_end for the local name of each
    closing tag."""
    p = expat.ParserCreate(namespace_separator=" ")
    parts: list[str] = []

    def flush(*_) -> None:
        if parts:
            whole = "".join(parts).strip(SPACES)
            parts.clear()
            if whole:
                on_text(whole)

    def end(name: str) -> None:
        flush()
        if on_end:
            on_end(name.rpartition(" ")[2])

    p.CharacterDataHandler = parts.append
    p.StartElementHandler = p.CommentHandler = p.ProcessingInstructionHandler = flush
    p.StartCdataSectionHandler = p.EndCdataSectionHandler = flush
    p.EndElementHandler = end
    try:
        p.Parse(content, True)
    except expat.ExpatError as e:
        raise ValueError(f"decoding XML token: {e}") from e
    flush()


def xml(content: bytes) -> str:
    lines: list[str] = []
    character_data(content, lines.append)
    return "".join(f"{line}\n" for line in lines)
