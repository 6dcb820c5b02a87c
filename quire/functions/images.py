"""Image operators (binary to binary) as Arrow UDFs over gray arrays; PNG files are read and written with numpy, other formats need Pillow."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.sources import png


def otsu_threshold(gray: np.ndarray) -> int:
    """The level that splits the histogram with the largest variance between the parts; the first of several."""
    count = np.bincount(gray.ravel(), minlength=256).astype(float)
    below, total = np.cumsum(count), count.sum()
    mass = np.cumsum(count * np.arange(256))
    above = total - below
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = np.where((below > 0) & (above > 0), below * above * (mass / below - (mass[-1] - mass) / above) ** 2, -1.0)
    return int(np.argmax(spread))


def otsu(gray: np.ndarray) -> np.ndarray:
    return np.where(gray > otsu_threshold(gray), 255, 0).astype(np.uint8)


def adaptive_gaussian(gray: np.ndarray, window: int = 11, offset: float = 2.0) -> np.ndarray:
    """White where a pixel exceeds the Gaussian mean of its surroundings less an offset; window is made odd, 3 at least."""
    window = max(3, window | 1)
    sigma = 0.3 * ((window - 1) * 0.5 - 1) + 0.8
    at = np.arange(window) - window // 2
    kernel = np.exp(-(at**2) / (2 * sigma**2))
    kernel /= kernel.sum()
    padded = np.pad(gray.astype(float), window // 2, mode="edge")
    rows = sum(k * padded[:, i : i + gray.shape[1]] for i, k in enumerate(kernel))
    mean = sum(k * rows[i : i + gray.shape[0]] for i, k in enumerate(kernel))
    return np.where(gray > mean - offset, 255, 0).astype(np.uint8)


def components_of(dark: np.ndarray) -> np.ndarray:
    """Labels of 8-connected dark regions (0: not dark), by spreading the least label until nothing changes."""
    label = np.where(dark, np.arange(1, dark.size + 1).reshape(dark.shape), 0)
    while True:
        padded = np.pad(np.where(dark, label, dark.size + 1), 1, constant_values=dark.size + 1)
        least = np.min([padded[1 + a : 1 + a + dark.shape[0], 1 + b : 1 + b + dark.shape[1]] for a in (-1, 0, 1) for b in (-1, 0, 1)], axis=0)
        least = np.where(dark, least, 0)
        if (least == label).all():
            return label
        label = least


def despeckle(gray: np.ndarray, least_area: int = 6) -> np.ndarray:
    """Dark regions of fewer pixels become white."""
    label = components_of(gray <= 128)
    size = np.bincount(label.ravel())
    small = (size[label] < least_area) & (label > 0)
    return np.where(small, 255, gray).astype(np.uint8)


def skew_angle(gray: np.ndarray, most: float = 5.0, step: float = 0.1) -> float:
    """The angle at which row sums vary most: half degrees first, then steps around the best; 0 if below a step."""
    y, x = np.nonzero(gray <= 128)
    if not len(x):
        return 0.0

    def spread(angle: float) -> float:
        rows = np.round(y - x * np.tan(np.radians(angle))).astype(int)
        return float(np.var(np.bincount(rows - rows.min())))

    coarse = max(np.arange(-most, most + 0.25, 0.5), key=lambda a: (spread(a), -abs(a)))
    fine = max(np.arange(coarse - 0.5, coarse + 0.5 + step / 2, step), key=lambda a: (spread(a), -abs(a)))
    return 0.0 if abs(fine) < step else float(fine)


def deskew(gray: np.ndarray, most: float = 5.0, step: float = 0.1) -> np.ndarray:
    """The image sheared back by its skew, white at the border."""
    angle = skew_angle(gray, most, step)
    if not angle:
        return gray
    h, w = gray.shape
    source = np.arange(h)[:, None] + np.round(np.arange(w) * np.tan(np.radians(angle))).astype(int)[None, :]
    inside = (source >= 0) & (source < h)
    return np.where(inside, gray[np.clip(source, 0, h - 1), np.arange(w)[None, :]], 255).astype(np.uint8)


PROCESSORS = {"grayscale": lambda g: g, "otsu": otsu, "adaptive_gaussian": adaptive_gaussian, "despeckle": despeckle, "deskew": deskew, "bilevel": lambda g: np.where(g > 128, 255, 0).astype(np.uint8)}


def read_gray(content: bytes) -> np.ndarray:
    """A page image's gray pixels: PNG files and single TIFF frames as they are, other formats through Pillow where it is installed."""
    if content.startswith(png.PNG):
        return png.gray(png.decode(content))
    if content.startswith(png.TIFF):
        pixels, error = next(png.tiff_frames(content))
        if error is None:
            return png.gray(pixels)
    from PIL import Image

    return np.asarray(Image.open(io.BytesIO(content)).convert("L"))


def crop(gray: np.ndarray, left: int, top: int, right: int, bottom: int) -> np.ndarray:
    """The pixels of a box that is already padded and clamped; an empty one is an error."""
    if right <= left or bottom <= top:
        raise ValueError("the box has no pixels")
    return gray[top:bottom, left:right]


def shrink(gray: np.ndarray, most: int = 1400) -> np.ndarray:
    """The image with its longest edge at most so long, each pixel the mean of those it stands for."""
    h, w = gray.shape
    scale = min(1.0, most / max(h, w))
    rows, columns = max(1, round(h * scale)), max(1, round(w * scale))
    if (rows, columns) == (h, w):
        return gray
    # A running sum over rows and columns gives each cell's total.
    y, x = np.linspace(0, h, rows + 1).round().astype(int), np.linspace(0, w, columns + 1).round().astype(int)
    total = np.zeros((h + 1, w + 1))
    total[1:, 1:] = gray.cumsum(0, dtype=float).cumsum(1)
    cells = total[y[1:]][:, x[1:]] - total[y[:-1]][:, x[1:]] - total[y[1:]][:, x[:-1]] + total[y[:-1]][:, x[:-1]]
    return (cells / (np.diff(y)[:, None] * np.diff(x)[None, :]) + 0.5).astype(np.uint8)


KIND = T.StructType([T.StructField("content", T.BinaryType()), T.StructField("error", T.StringType())])


def _many(work, contents: pd.Series, *more: pd.Series) -> pd.DataFrame:
    out = []
    for content, *values in zip(contents, *more):
        try:
            out.append((png.encode(work(read_gray(content), *values)), None))
        except Exception as error:  # errors are data: the page is marked and the run goes on
            out.append((None, f"{type(error).__name__}: {error}"))
    return pd.DataFrame(out, columns=["content", "error"])


def chain(*names: str):
    """A column function binary -> struct(content, error): the named processors one after the other, stopping at the first error."""
    def work(gray: np.ndarray) -> np.ndarray:
        for name in names:
            gray = PROCESSORS[name](gray)
        return gray

    def run(contents: pd.Series) -> pd.DataFrame:
        return _many(work, contents)

    return F.pandas_udf(run, KIND)


def cropped(content, left, top, right, bottom):
    """A column struct(content, error): the box's pixels of a page image."""
    def run(contents: pd.Series, a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        return _many(crop, contents, a, b, c, d)

    return F.pandas_udf(run, KIND)(content, left, top, right, bottom)


def downscaled(content, most: int = 1400):
    """A column struct(content, error): the image with its longest edge at most so long."""
    def run(contents: pd.Series) -> pd.DataFrame:
        return _many(lambda gray: shrink(gray, most), contents)

    return F.pandas_udf(run, KIND)(content)
