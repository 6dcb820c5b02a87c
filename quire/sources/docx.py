"""Word documents of paragraphs with roles, written and read with zipfile and XML text alone."""

from __future__ import annotations

import io
import re
import zipfile
from xml.sax.saxutils import escape, unescape

#: The style of each role, and the parts that a document needs.
STYLES = {"heading": "Heading1", "subheading": "Heading2", "footnote": "FootnoteText", "running_head": "Header", "page_number": "Footer"}
NAMESPACE = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
TYPES = (
    '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
)
RELATIONS = (
    '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" '
    'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
)
#: XML 1.0 can't hold these.
_FORBIDDEN = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def _paragraph(text: str, style: str | None, italic: bool = False) -> str:
    properties = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    run = "<w:rPr><w:i/></w:rPr>" if italic else ""
    return f'<w:p>{properties}<w:r>{run}<w:t xml:space="preserve">{escape(_FORBIDDEN.sub("", text))}</w:t></w:r></w:p>'


def write(pages: list[tuple[list[tuple[str, str]], str | None]]) -> bytes:
    """A file of pages, each its paragraphs (text, role) and the note of a page that failed; pages are broken apart."""
    body = []
    for number, (paragraphs, note) in enumerate(pages):
        if number:
            body.append('<w:p><w:r><w:br w:type="page"/></w:r></w:p>')
        if note:
            body.append(_paragraph(note, None, True))
        body += [_paragraph(text, STYLES.get(role)) for text, role in paragraphs]
    document = f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{NAMESPACE}"><w:body>{"".join(body)}</w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, data in (("[Content_Types].xml", TYPES), ("_rels/.rels", RELATIONS), ("word/document.xml", document)):
            # The same date always, so that reruns agree.
            archive.writestr(zipfile.ZipInfo(name, (2000, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def read(content: bytes) -> tuple[int, list[tuple[str, str]]]:
    """How many page breaks a file has, and its paragraphs with their styles."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        document = archive.read("word/document.xml").decode()
    found = re.findall(r'<w:p>(?:<w:pPr><w:pStyle w:val="(\w+)"/></w:pPr>)?<w:r>(?:<w:rPr><w:i/></w:rPr>)?<w:t xml:space="preserve">(.*?)</w:t></w:r></w:p>', document, re.S)
    return document.count('w:type="page"'), [(unescape(text), style) for style, text in found]
