"""Formats: bytes to text."""

import io
import zipfile
import zlib

import pytest

from siftline.sources import parsers
from siftline.sources.parsers import data, markup, office, pdf, plain


def make_pdf(streams, compress=False, resources=b"", extra=b""):
    kids = b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(streams)))
    out = b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n"
    out += b"2 0 obj\n<< /Type /Pages /Kids [%s] /Count %d %s >>\nendobj\n" % (kids, len(streams), resources)
    for i, s in enumerate(streams):
        body = zlib.compress(s) if compress else s
        flate = b"/Filter /FlateDecode" if compress else b""
        out += b"%d 0 obj\n<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>\nendobj\n" % (10 + 2 * i, 11 + 2 * i)
        out += b"%d 0 obj\n<< /Length %d %s >>\nstream\n%s\nendstream\nendobj\n" % (11 + 2 * i, len(body), flate, body)
    return out + extra + b"trailer << /Root 1 0 R >>\n%%EOF"


def shown(*operators):
    """What a text object with these operators shows."""
    return pdf.content_text(b"BT " + b" ".join(operators) + b" ET")


def utf16(text):
    return ("\ufeff" + text).encode("utf-16-be")


def test_strings_are_shown():
    for text in ("quartz", "two words", "a-b/c", ""):
        want = f"{text}\n" if text else ""
        raw = text.encode()
        assert shown(b"(%s) Tj" % raw) == shown(b"<%s> Tj" % raw.hex().encode()) == shown(b"[(%s)] TJ" % raw) == want
        spaced = b" ".join(b"%02X" % c for c in raw)
        assert shown(b"/F7 9.5 Tf 12 700 Td", b"<%s> Tj" % spaced) == want
    assert shown(b"(nested (one (two)) end) Tj") == "nested (one (two)) end\n"


def test_shifts_in_arrays_are_spaces_below_the_limit():
    for shift in range(-60, 20, 3):
        gap = " " if shift < pdf.WORD_SHIFT else ""
        assert shown(b"[(left) %d (right)] TJ" % shift) == f"left{gap}right\n"
    assert shown(b"[(x) %d (y)] TJ" % pdf.WORD_SHIFT) == "xy\n" and shown(b"(z) TJ") == ""


def test_lines_follow_positions():
    move = {b"T*": True, b"0 -9 Td": True, b"0 -9 TD": True, b"1 0 0 1 5 300 Tm": True, b"1 0 0 1 60 400.5 Tm": False}
    for operator, breaks in move.items():
        assert shown(b"1 0 0 1 5 400 Tm (p) Tj", operator, b"(q) Tj") == ("p\nq\n" if breaks else "pq\n"), operator
    # quotes start a line, also where one has just begun
    for quote in (b"(q) '", b'3 4 (q) "'):
        assert shown(b"(p) Tj", quote) == "p\nq\n"
        assert shown(b"(p) Tj T*", quote) == "p\n\nq\n" and shown(quote) == "\nq\n"
    assert pdf.content_text(b"BT (p) Tj ET BT (q) Tj ET") == "p\nq\n"


def test_what_is_no_text_is_passed_over():
    for junk in (b"(out) Tj", b"% (remark) Tj\n", b"BI /H 2 /W 2 ID \xff(y) Tj BT\x00 EI", b"<< /K (v) >> DP", b") ] }"):
        assert pdf.content_text(junk + b" BT (in) Tj ET " + junk) == "in\n", junk
    assert pdf.content_text(b"") == "" and shown(b"(p) Tj ) ]", b"(q) Tj") == "pq\n"


def test_string_syntax():
    for c in range(256):
        assert pdf.literal_string(b"\\%03o" % c) == bytes([c])
    for name, c in zip("nrtbf", "\n\r\t\b\f", strict=True):
        assert pdf.literal_string(b"<\\" + name.encode() + b">") == f"<{c}>".encode()
    assert pdf.literal_string(b"split\\\r\n here") == b"split here" and pdf.literal_string(rb"\q\(") == b"q("
    assert pdf.hex_string(b"7") == b"p" and pdf.hex_string(b"7\n0 7") == b"pp" and pdf.hex_string(b"no") == b""
    assert pdf.hex_token(b"<7F>") == pdf.hex_token(b"<00 7f>") == 0x7F and pdf.hex_token(b"<7F000001>") == 0x7F000001
    assert [pdf.hex_token(t) for t in (b"<>", b"<7F00000001>", b"7F", b"(7F)")] == [-1] * 4
    assert [pdf.number(v) for v in (b"-7.25", b"+8", b".5", b"--1", None)] == [-7.25, 8, 0.5, 0, 0]


def test_characters():
    assert pdf.decode_bytes(utf16("π = 3")) == "π = 3" and pdf.decode_bytes(b"\x07bell\x7f\xe9") == "bell\x7fé"
    # the values that must be these
    want = {"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\ufb05": "ſt", "\ufb06": "st", "\ue001": "fi", "\ue002": "fl", "\ue003": "ff", "\ue004": "ffi", "\ue005": "ffl"}
    assert want == pdf.LIGATURES
    for ligature, letters in want.items():
        assert pdf.decode_bytes(utf16(f"<{ligature}>")) == f"<{letters}>"
        # through a font's map they stay as the map says
        assert pdf.decode_string(b"\x00\x09", {9: ligature}) == ligature


def test_cmap():
    m = pdf.parse_cmap(b"2 beginbfchar <0107> <03C0>\n<0108> <00660069> endbfchar 1 beginbfrange <0200> <0219> <0061> endbfrange")
    assert m[0x107] == "π" and m[0x108] == "fi" and "".join(m[0x200 + k] for k in range(26)) == "abcdefghijklmnopqrstuvwxyz" and len(m) == 28
    assert pdf.decode_string(b"\x02\x07\x02\x08", m) == "hi" and pdf.decode_string(b"plain", m) == "plain"
    assert pdf.decode_string(bytes([1, 2, 1]), {1: "y", 2: "o"}) == "yoy"


def test_whole_pdfs():
    pages = [b"BT (page %d) Tj ET" % i for i in range(1, 4)]
    for n in (1, 2, 3):
        for compress in (False, True):
            assert pdf.pdf(make_pdf(pages[:n], compress)) == "\n\n".join(f"page {i}" for i in range(1, n + 1))
    fonts = b"/Resources << /Font << /G << /ToUnicode 90 0 R >> >> >>"
    cmap = b"90 0 obj\n<< >>\nstream\n1 beginbfchar\n<2A> <2603>\nendbfchar\nendstream\nendobj\n"
    assert pdf.pdf(make_pdf([b"BT /G 9 Tf <2A> Tj ET"], resources=fonts, extra=cmap)) == "☃"
    forms = b"/Resources << /XObject << /Zed 91 0 R /Any 92 0 R >> >>"
    body = b"".join(b"%d 0 obj\n<< /Subtype /Form >>\nstream\nBT (%s) Tj ET\nendstream\nendobj\n" % x for x in ((91, b"later"), (92, b"sooner")))
    assert pdf.pdf(make_pdf([b"/Any Do"], resources=forms, extra=body)) == "sooner\nlater"
    packed = b"%PDF-1.5\n1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj 5 0 obj <</Type/ObjStm/N 2/First 9>> stream\n2 0 3 26 <</Kids[3 0 R]>>          <</Contents 11 0 R>> endstream endobj 11 0 obj <<>> stream\nBT (packed) Tj ET\nendstream endobj"
    assert pdf.pdf(packed) == "packed"
    for before, after in ((b"\n\t ", b"%PDF-1.4 \t\n"), (b"", b"%PDF-1.4\r\n%\xb5\xb6\r\n")):
        assert pdf.pdf(before + make_pdf(pages[:1]).replace(b"%PDF-1.4\n", after)) == "page 1"
    kept = b"%PDF-1.6\r%\x80\x81\r\n1 0 obj"
    assert pdf.clean_header(kept) == kept and pdf.clean_header(b"  " + kept) == kept
    for bad in (b"", b"%PD", b"plain words", bytes(range(40))):
        with pytest.raises(ValueError, match="invalid PDF"):
            pdf.pdf(bad)
    with pytest.raises(ValueError, match="encrypted"):
        pdf.pdf(make_pdf(pages[:1]) + b" << /Encrypt 7 0 R >>")


def zipped(member, xml):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(member, xml)
    return out.getvalue()


def test_office():
    w = '<w:document xmlns:w="u"><w:p><w:r><w:t>Hel</w:t></w:r><w:r><w:t>lo</w:t></w:r></w:p><w:p><w:t>World</w:t></w:p></w:document>'
    assert office.docx(zipped("word/document.xml", w)) == "Hel lo\nWorld"
    assert office.odt(zipped("content.xml", '<o xmlns:text="t"><text:p>Hello</text:p><text:h>World</text:h></o>')) == "Hello\nWorld"
    for f, kind in ((office.docx, "DOCX"), (office.odt, "ODT")):
        with pytest.raises(ValueError, match=f"invalid {kind}"):
            f(b"not a zip")
        with pytest.raises(ValueError, match="not found in archive"):
            f(zipped("other.xml", "<a/>"))
    office.check_magic(b"PK\x03", b"PK")
    for bad in (b"", b"P", b"XX"):
        with pytest.raises(ValueError):
            office.check_magic(bad, b"PK")


def test_rtf():
    assert plain.rtf(rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}{\info{\author Me}}Hello \b bold\b0  text\par next\line x\tab y}") == "Hello bold text\nnext\nx\ty"
    assert plain.rtf(rb"{\rtf1 \{100\} caf\'e9 \~ \*}") == "{100} caf'e9 ~ *"
    # the values that must be these
    names = "fonttbl colortbl stylesheet info pict header footer headerl headerr footerl footerr footnote object themedata colorschememapping datastore latentstyles fldinst"
    assert plain.RTF_SKIPPED == set(names.split())
    for name in names.split():
        assert plain.rtf(b"{\\rtf1 seen{\\%s unseen{deeper}still} after}" % name.encode()) == "seen after"
    # what follows a backslash and is no letter: a hyphen, digits and one space go, others stay
    assert plain.rtf(rb"{\rtf1 co\-operate a\ b \~c \-12 d}") == "cooperate ab ~c d"
    assert plain.rtf(rb"\header text {\header gone} on") == "text  on" and plain.rtf(rb"} a} b \\") == "a b \\" and plain.rtf(b"x\\") == "x\\"
    assert plain.rtf(rb"{\rtf1 go {\field{\*\fldinst HYPERLINK http://x}{\fldrslt there}}}") == "go *there"


def test_mail():
    m = b"From: a@b.c\r\nSubject: Hi\r\n there\r\nX: y\r\n\r\nBody =3D\r\n\r\nmore"
    assert plain.eml(m) == "Subject: Hi there\nFrom: a@b.c\n\nBody =3D\r\n\r\nmore"
    with pytest.raises(ValueError):
        plain.eml(b"no header")


def test_csv():
    assert data.csv(b'a,b\n\n"x ""q"", y",\n1,"two\nlines"\n') == 'a\tb\nx "q", y\t\n1\ttwo\nlines\n'
    for bad in (b"a,b\n1\n", b'a,b"c\n', b'"a"b,c\n', b'"open'):
        with pytest.raises(ValueError):
            data.csv(bad)


def test_trees():
    assert data.json_text(b'{"b": [1, 2.50, 1e21, 1e-7, true, null], "a": {"<x>": "\xc3\xa9 & \xe2\x80\xa8"}, "e": {}, "f": []}') == (
        '{\n  "a": {\n    "\\u003cx\\u003e": "é \\u0026 \\u2028"\n  },\n  "b": [\n    1,\n    2.5,\n    1e+21,\n    1e-7,\n    true,\n    null\n  ],\n  "e": {},\n  "f": []\n}'
    )
    assert data.yaml_text(b"b: yes\na: true\nd: 2024-01-02T03:04:05Z\n---\nz: 1") == '{\n  "a": true,\n  "b": "yes",\n  "d": "2024-01-02T03:04:05Z"\n}'
    assert data.yaml_text(b"") == "null"
    assert data.toml_text(b"x = 1\n[t]\nwhen = 2024-01-02T03:04:05Z\nf = 1.0") == '{\n  "t": {\n    "f": 1,\n    "when": "2024-01-02T03:04:05Z"\n  },\n  "x": 1\n}'
    for f, bad in ((data.json_text, b"{"), (data.json_text, b"[NaN]"), (data.yaml_text, b"1: x"), (data.yaml_text, b"a: .nan"), (data.yaml_text, b"a: [") , (data.toml_text, b"x ="), (data.toml_text, b"x = inf")):
        with pytest.raises(ValueError):
            f(bad)


def test_markup():
    assert markup.xml(b"<a> x <b>y<!-- c -->z</b><![CDATA[ <raw> ]]>&amp;</a>") == "x\ny\nz\n<raw>\n&\n"
    with pytest.raises(ValueError, match="XML"):
        markup.xml(b"<a>")
    page = b"<title>T</title><script>var a='</p>';</script><style>p{}</style><p>One <b>two</b> &amp; &copy;<!-- no --><p>three"
    assert markup.html(page) == "T\nOne\ntwo\n& ©\nthree"


def test_registry():
    assert len(parsers.supported_extensions()) == 16
    assert parsers.parse(".txt", b"a\xff") == "a�"
    with pytest.raises(ValueError, match='unsupported file format: ".exe"'):
        parsers.parse(".exe", b"")
