"""Plain text, rich text and mail."""

from __future__ import annotations

import email.parser
import re

#: Groups of rich text that hold no text of the document.
RTF_SKIPPED = frozenset(
    "fonttbl colortbl stylesheet info pict header footer headerl headerr footerl footerr footnote object themedata colorschememapping datastore latentstyles fldinst".split()
)


def text(content: bytes) -> str:
    return content.decode("utf-8", "replace")


#: Plain text (a backslash at the end, too), a brace, an escaped character, the end of a
#: line, or a control: letters, if any, with a number and a space that belong to it.
_RTF = re.compile(rb"([^\\{}]+|\\\Z)|([{}])|\\([\\{}])|\\[\r\n]|\\([A-Za-z]*)[-0-9]* ?")


def rtf(content: bytes) -> str:
    """The text between controls, without groups that RTF_SKIPPED names; outside of all
    groups such a name skips nothing."""
    out: list[bytes] = []
    depth = silent = 0  # silent: the depth of the group that is skipped
    for m in _RTF.finditer(content):
        plain, brace, escaped, word = m.groups()
        if brace == b"{":
            depth += 1
        elif brace == b"}":
            silent = 0 if silent >= depth else silent
            depth = max(depth - 1, 0)
        elif silent:
            continue
        elif word is None:
            out.append(plain or escaped or b"")
        elif word.decode() in RTF_SKIPPED:
            silent = depth
        else:
            out.append({b"par": b"\n", b"line": b"\n", b"tab": b"\t"}.get(word, b""))
    return b"".join(out).decode("utf-8", "replace").strip()


def eml(content: bytes) -> str:
    """Four headers and the body as it is sent."""
    head, sep, body = content.partition(b"\r\n\r\n")
    other = content.partition(b"\n\n")
    if not sep or (other[1] and len(other[0]) < len(head)):
        head, sep, body = other
    if b":" not in head:
        raise ValueError("parsing mail: no header")
    headers = email.parser.BytesHeaderParser().parsebytes(head)
    lines = []
    for name in ("Subject", "From", "To", "Date"):
        value = re.sub(r"\r?\n[ \t]+", " ", str(headers.get(name) or ""))
        if value:
            lines.append(f"{name}: {value}\n")
    return "".join(lines) + "\n" + body.decode("utf-8", "replace")
