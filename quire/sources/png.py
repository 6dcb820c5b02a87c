"""PNG files to and from arrays, and frames of plain TIFF files, with numpy and zlib alone."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: How the files begin.
PNG, JPEG, TIFF = b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff", (b"II*\0", b"MM\0*")
#: Samples of a pixel by PNG colour type.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def encode(pixels: np.ndarray) -> bytes:
    """A PNG of 8-bit gray (h, w), RGB (h, w, 3) or RGBA (h, w, 4) pixels."""
    h, w = pixels.shape[:2]
    kind = {1: 0, 3: 2, 4: 6}[1 if pixels.ndim == 2 else pixels.shape[2]]
    rows = np.zeros((h, 1 + pixels.size // h), np.uint8)
    rows[:, 1:] = pixels.reshape(h, -1)

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def _chunks(content: bytes):
    at = len(PNG)
    while at + 8 <= len(content):
        size, name = struct.unpack_from(">I4s", content, at)
        yield name, content[at + 8 : at + 8 + size]
        at += size + 12


def _unfiltered(data: bytes, h: int, stride: int, step: int) -> np.ndarray:
    """Rows of bytes with the filters taken off; step is the bytes of a pixel."""
    raw = np.frombuffer(data, np.uint8)
    if len(raw) < h * (stride + 1):
        raise ValueError("the image is cut off")
    raw = raw[: h * (stride + 1)].reshape(h, stride + 1)
    out = np.zeros((h, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y in range(h):
        kind, row = raw[y, 0], raw[y, 1:].copy()
        if kind == 1:
            for k in range(step):
                row[k::step] = np.add.accumulate(row[k::step], dtype=np.uint8)
        elif kind == 2:
            row += above
        elif kind in (3, 4):
            _by_neighbours(row, above, step, kind == 4)
        elif kind:
            raise ValueError(f"unknown filter {kind}")
        out[y] = above = row
    return out


def _by_neighbours(row: np.ndarray, above: np.ndarray, step: int, paeth: bool) -> None:
    values, up = row.tolist(), above.tolist()
    for i, v in enumerate(values):
        a, b, c = (values[i - step] if i >= step else 0), up[i], (up[i - step] if i >= step else 0)
        if paeth:
            guess = a + b - c
            near = min(((abs(guess - a), 0, a), (abs(guess - b), 1, b), (abs(guess - c), 2, c)))
            values[i] = (v + near[2]) & 255
        else:
            values[i] = (v + (a + b) // 2) & 255
    row[:] = values


def decode(content: bytes) -> np.ndarray:
    """Pixels of a PNG without interlacing: (h, w) or (h, w, samples), 8 bits each."""
    head, data, palette = None, [], None
    for name, body in _chunks(content):
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            data.append(body)
    if not content.startswith(PNG) or head is None:
        raise ValueError("not a PNG file")
    w, h, bits, kind, _, _, interlaced = head
    if interlaced or bits == 16:
        raise ValueError("interlaced and 16-bit files aren't read")
    samples = SAMPLES[kind]
    stride = -(-w * samples * bits // 8)
    rows = _unfiltered(zlib.decompress(b"".join(data)), h, stride, max(1, samples * bits // 8))
    if bits < 8:
        flat = np.unpackbits(rows, axis=1).reshape(h, -1, bits)[:, :w]
        rows = (flat * (1 << np.arange(bits)[::-1])).sum(2).astype(np.uint8)
        if kind == 0:
            rows = (rows.astype(int) * 255 // ((1 << bits) - 1)).astype(np.uint8)
    pixels = rows.reshape(h, w, samples)
    if kind == 3:
        return palette[pixels[:, :, 0]]
    return pixels[:, :, 0] if samples == 1 else pixels


def gray(pixels: np.ndarray) -> np.ndarray:
    """Luma of the pixels; transparency is ignored."""
    if pixels.ndim == 2:
        return pixels
    if pixels.shape[2] == 2:
        return pixels[:, :, 0]
    # The weights of red, green and blue, in 65536ths, rounded.
    weights = np.array([19595, 38470, 7471])
    return ((pixels[:, :, :3].astype(np.int64) * weights).sum(2) + 32768 >> 16).astype(np.uint8)


def size(content: bytes) -> tuple[int, int]:
    """Width and height as PNG or JPEG files state them."""
    if content.startswith(PNG):
        return struct.unpack_from(">II", content, 16)
    at = 2
    while content.startswith(JPEG) and at + 9 <= len(content):
        mark, length = content[at + 1], struct.unpack_from(">H", content, at + 2)[0]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack_from(">HH", content, at + 5)
            return w, h
        at += 2 + length
    raise ValueError("not an image that is known here")


def tiff_frames(content: bytes):
    """Each frame of a TIFF file as pixels or an error message; plain and deflated strips of 8-bit or bilevel pixels."""
    order = "<" if content.startswith(TIFF[0]) else ">"
    at = struct.unpack_from(order + "I", content, 4)[0]
    while at:
        (count,) = struct.unpack_from(order + "H", content, at)
        tags: dict[int, list[int]] = {}
        for k in range(count):
            tag, kind, n = struct.unpack_from(order + "HHI", content, at + 2 + 12 * k)
            width = {1: 1, 3: 2, 4: 4}.get(kind)
            if width:
                place = at + 10 + 12 * k if width * n <= 4 else struct.unpack_from(order + "I", content, at + 10 + 12 * k)[0]
                tags[tag] = list(struct.unpack_from(f"{order}{n}{ {1: 'B', 3: 'H', 4: 'I'}[kind]}", content, place))
        try:
            yield _frame(content, tags), None
        except (ValueError, KeyError, zlib.error, struct.error) as error:
            yield None, f"{type(error).__name__}: {error}"
        (at,) = struct.unpack_from(order + "I", content, at + 2 + 12 * count)


def _frame(content: bytes, tags: dict[int, list[int]]) -> np.ndarray:
    # 256 and 257 are the size, 258 bits, 259 compression, 262 what 0 means, 273 and 279 the strips, 277 samples.
    w, h, bits, samples = tags[256][0], tags[257][0], tags.get(258, [1])[0], tags.get(277, [1])[0]
    packing = tags.get(259, [1])[0]
    if packing not in (1, 8, 32946) or bits not in (1, 8):
        raise ValueError(f"compression {packing} with {bits} bits isn't read")
    strips = [content[a : a + n] for a, n in zip(tags[273], tags[279])]
    data = b"".join(zlib.decompress(s) if packing != 1 else s for s in strips)
    stride = -(-w * samples * bits // 8)
    if len(data) < stride * h:
        raise ValueError("the frame is cut off")
    rows = np.frombuffer(data, np.uint8, stride * h).reshape(h, stride)
    if bits == 1:
        rows = np.unpackbits(rows, axis=1)[:, :w] * np.uint8(255)
    pixels = rows.reshape(h, w) if samples == 1 else rows.reshape(h, w, samples)[:, :, : 3 if samples < 4 else 4]
    return 255 - pixels if tags.get(262, [1])[0] == 0 else pixels
