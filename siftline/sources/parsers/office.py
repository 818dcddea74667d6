"""Office files: a ZIP archive with one XML member that holds the text."""

from __future__ import annotations

import io
import zipfile

from siftline.sources.parsers.markup import SPACES, character_data


def check_magic(content: bytes, magic: bytes) -> None:
    if len(content) < len(magic):
        raise ValueError(f"file too small ({len(content)} bytes)")
    if not content.startswith(magic):
        raise ValueError(f"unexpected header {content[: len(magic)]!r}")


def zip_xml_text(content: bytes, member: str, breaks: frozenset[str]) -> str:
    """Text of a member; each stretch has a space after it, which a break at the end
    of a tag turns into a line feed."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        raise ValueError(f"opening archive: {e}") from e
    if member not in archive.namelist():
        raise ValueError(f'file "{member}" not found in archive')
    out: list[str] = []

    def at_end(name: str) -> None:
        if name in breaks and out:
            out[-1] = out[-1].removesuffix(" ")
            out.append("\n")

    character_data(archive.read(member), lambda t: out.append(f"{t} "), at_end)
    return "".join(out).strip(SPACES)


def _office(content: bytes, kind: str, member: str, breaks: str) -> str:
    try:
        check_magic(content, b"PK")
    except ValueError as e:
        raise ValueError(f"invalid {kind}: {e}") from e
    return zip_xml_text(content, member, frozenset(breaks.split()))


def odt(content: bytes) -> str:
    return _office(content, "ODT", "content.xml", "p h line-break table-row")


def docx(content: bytes) -> str:
    return _office(content, "DOCX", "word/document.xml", "p br tr")
