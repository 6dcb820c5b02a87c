"""PDF files without a library: searchable pages written, and page images read back.

What is written is an image per page with the recognized text laid over it
invisibly.  What is read is the page tree and, of each page, its own full image;
drawing text and vectors would need a renderer, so pages without an image are
rows with an error.
"""

from __future__ import annotations

import re
import zlib

import numpy as np

from quire.sources import png

#: Points to an inch, pixels to an inch of a page image, least and most font size.
POINTS, DPI, LEAST_FONT, MOST_FONT = 72, 300, 4.0, 12.0
MAGIC = b"%PDF"
_OBJECT = re.compile(rb"(?<![0-9])(\d+) (\d+) obj\b")
_REF = re.compile(rb"(\d+) \d+ R")


def font_size(height: float) -> float:
    return min(MOST_FONT, max(LEAST_FONT, 0.6 * height))


def _escaped(text: str) -> bytes:
    return re.sub(rb"([\\()])", rb"\\\1", text.encode("latin-1", "replace"))


def write(pages: list[dict]) -> bytes:
    """A file of pages (width, height in pixels, image: PNG, JPEG or none, lines: (x, y, w, h, text), note: shown on a page that failed)."""
    objects: list[bytes] = []

    def add(body: bytes) -> int:
        objects.append(body)
        return len(objects)

    def stream(head: bytes, data: bytes) -> int:
        return add(b"<< " + head + b" /Length %d >>\nstream\n" % len(data) + data + b"\nendstream")

    catalog, tree = add(b""), add(b"")
    # Codes are UTF-16 units; the font has no glyphs of its own, as its text isn't drawn.
    units = stream(b"", b"/CIDInit /ProcSet findresource begin 12 dict begin begincmap /CMapName /U def 1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0000> <FFFF> <0000> endbfrange endcmap end end")
    described = add(b"<< /Type /FontDescriptor /FontName /Hidden /Flags 4 /FontBBox [0 0 1000 1000] /ItalicAngle 0 /Ascent 800 /Descent -200 /CapHeight 700 /StemV 80 >>")
    below = add(b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Hidden /CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) /Supplement 0 >> /FontDescriptor %d 0 R /DW 500 >>" % described)
    hidden = add(b"<< /Type /Font /Subtype /Type0 /BaseFont /Hidden /Encoding /Identity-H /DescendantFonts [%d 0 R] /ToUnicode %d 0 R >>" % (below, units))
    shown = add(b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>")
    kids = []
    for page in pages:
        w, h = page["width"] * POINTS / DPI, page["height"] * POINTS / DPI
        content, image = [], b""
        if page.get("image"):
            number = stream(*_image(page["image"]))
            image = b" /XObject << /Im0 %d 0 R >>" % number
            content.append(b"q %.2f 0 0 %.2f 0 0 cm /Im0 Do Q" % (w, h))
        for x, y, _, line_h, text in page.get("lines", ()):
            left, base = x * POINTS / DPI, h - (y + line_h) * POINTS / DPI
            content.append(b"BT /F0 %.2f Tf 3 Tr %.2f %.2f Td <%s> Tj ET" % (font_size(line_h * POINTS / DPI), left, base, text.encode("utf-16-be").hex().upper().encode()))
        if page.get("note"):
            content.append(b"BT /F1 10 Tf 0 Tr 20 %.2f Td (%s) Tj ET" % (h / 2, _escaped(page["note"])))
        drawn = stream(b"", b"\n".join(content))
        kids.append(add(b"<< /Type /Page /Parent %d 0 R /MediaBox [0 0 %.2f %.2f] /Resources << /Font << /F0 %d 0 R /F1 %d 0 R >>%s >> /Contents %d 0 R >>" % (tree, w, h, hidden, shown, image, drawn)))
    objects[catalog - 1] = b"<< /Type /Catalog /Pages %d 0 R >>" % tree
    objects[tree - 1] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    out, places = bytearray(b"%PDF-1.7\n"), []
    for number, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n" % number + body + b"\nendobj\n"
    table = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer << /Size %d /Root %d 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, catalog, table))


def _image(content: bytes) -> tuple[bytes, bytes]:
    head = b"/Type /XObject /Subtype /Image /Width %d /Height %d /BitsPerComponent 8 /ColorSpace /%s /Filter /%s"
    if content.startswith(png.JPEG):
        w, h = png.size(content)
        return head % (w, h, b"DeviceRGB", b"DCTDecode"), content
    pixels = png.gray(png.decode(content))
    return head % (pixels.shape[1], pixels.shape[0], b"DeviceGray", b"FlateDecode"), zlib.compress(pixels.tobytes())


class File:
    """Objects of a file that are written out one by one; files whose objects are packed into streams can't be opened."""

    def __init__(self, content: bytes):
        if not content.startswith(MAGIC):
            raise ValueError("not a PDF file")
        self.objects: dict[int, tuple[bytes, bytes]] = {}
        at = 0
        while found := _OBJECT.search(content, at):
            stop, begin = content.find(b"endobj", found.end()), content.find(b"stream", found.end())
            if 0 <= begin < stop:
                head = content[found.end() : begin]
                data = begin + len(b"stream") + (2 if content[begin + 6 : begin + 8] == b"\r\n" else 1)
                size = self._length(head, content)
                end = data + size if size is not None else content.find(b"endstream", data)
                self.objects[int(found[1])] = (head, content[data:end])
                at = max(content.find(b"endobj", end), end)
            else:
                self.objects[int(found[1])] = (content[found.end() : stop if stop >= 0 else len(content)], b"")
                at = stop if stop >= 0 else len(content)
        root = [head for head, _ in self.objects.values() if re.search(rb"/Type\s*/Catalog\b", head)]
        if not root:
            raise ValueError("the file has no page tree that can be read")
        self.pages = self._kids(int(re.search(rb"/Pages\s+(\d+)", root[-1])[1]), set())

    @staticmethod
    def _length(head: bytes, content: bytes) -> int | None:
        found = re.search(rb"/Length\s+(\d+)(\s+\d+\s+R)?", head)
        if found is None:
            return None
        if not found[2]:
            return int(found[1])
        there = re.search(rb"(?<![0-9])%s \d+ obj\s*(\d+)" % found[1], content)
        return int(there[1]) if there else None

    def _kids(self, number: int, seen: set[int]) -> list[int]:
        head = self.objects.get(number, (b"", b""))[0]
        kids = re.search(rb"/Kids\s*\[(.*?)\]", head, re.S)
        if number in seen or not kids:
            return [number]
        return [page for ref in _REF.findall(kids[1]) for page in self._kids(int(ref), seen | {number})]

    def image(self, page: int) -> tuple[bytes, int, int]:
        """A page's image as a JPEG or PNG file, with its size."""
        head = self.objects[page][0]
        found = re.search(rb"/Resources\s+(\d+) \d+ R", head)
        head += self.objects.get(int(found[1]), (b"", b""))[0] if found else b""
        for ref in _REF.findall(head):
            inner, data = self.objects.get(int(ref), (b"", b""))
            if not re.search(rb"/Subtype\s*/Image\b", inner):
                continue
            w, h = (int(re.search(rb"/%s\s+(\d+)" % side, inner)[1]) for side in (b"Width", b"Height"))
            if b"/DCTDecode" in inner:
                return data, w, h
            samples = 3 if b"/DeviceRGB" in inner else 1
            pixels = np.frombuffer(zlib.decompress(data), np.uint8, w * h * samples)
            return png.encode(pixels.reshape((h, w) if samples == 1 else (h, w, 3))), w, h
        raise ValueError("the page has no image of its own; it would have to be rendered")

    def hidden_text(self, page: int) -> list[str]:
        """The texts that are laid over a page, if they are written as UTF-16 units."""
        found = re.search(rb"/Contents\s+(\d+)", self.objects[page][0])
        drawn = self.objects.get(int(found[1]), (b"", b""))[1] if found else b""
        return [bytes.fromhex(t.decode()).decode("utf-16-be") for t in re.findall(rb"<([0-9A-F]*)> Tj", drawn)]
