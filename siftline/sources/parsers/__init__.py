"""One function for each format: bytes to text, or ValueError."""

from __future__ import annotations

from collections.abc import Callable

from siftline.sources.parsers import data, markup, office, pdf, plain

Parser = Callable[[bytes], str]

PARSERS: dict[str, Parser] = {
    ".txt": plain.text,
    ".md": plain.text,
    ".markdown": plain.text,
    ".html": markup.html,
    ".htm": markup.html,
    ".csv": data.csv,
    ".json": data.json_text,
    ".yaml": data.yaml_text,
    ".yml": data.yaml_text,
    ".toml": data.toml_text,
    ".xml": markup.xml,
    ".rtf": plain.rtf,
    ".eml": plain.eml,
    ".odt": office.odt,
    ".docx": office.docx,
    ".pdf": pdf.pdf,
}


def register(extension: str, parser: Parser) -> None:
    """Add a format in this process (on a cluster: in a module the workers import)."""
    PARSERS[extension.lower()] = parser


def supported_extensions() -> list[str]:
    return sorted(PARSERS)


def parse(extension: str, content: bytes) -> str:
    parser = PARSERS.get(extension)
    if parser is None:
        raise ValueError(f'unsupported file format: "{extension}"')
    return parser(content)
