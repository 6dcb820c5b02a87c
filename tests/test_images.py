"""Image operators on small arrays."""

import numpy as np

from quire.functions import images


def test_otsu_splits_two_levels():
    gray = np.array([[10, 12, 200], [11, 210, 205]], np.uint8)
    assert (images.otsu(gray) == np.array([[0, 0, 255], [0, 255, 255]])).all()


def test_despeckle_keeps_large_regions():
    gray = np.full((12, 12), 255, np.uint8)
    gray[1, 1] = 0
    gray[4:8, 4:8] = 0
    gray[8, 8] = 0  # touches the square at its corner
    out = images.despeckle(gray)
    assert out[1, 1] == 255 and (out[4:8, 4:8] == 0).all() and out[8, 8] == 0


def test_deskew_finds_the_angle():
    gray = np.full((200, 300), 255, np.uint8)
    for row in range(20, 180, 20):
        for x in range(300):
            gray[row + round(x * np.tan(np.radians(2.0))) if row + round(x * np.tan(np.radians(2.0))) < 200 else 199, x] = 0
    assert abs(images.skew_angle(gray) - 2.0) <= 0.2
    assert abs(images.skew_angle(images.deskew(gray))) <= 0.2
    assert images.skew_angle(np.full((5, 5), 255, np.uint8)) == 0.0


def test_adaptive_threshold_follows_the_background():
    gray = np.tile(np.linspace(60, 250, 60).astype(np.uint8), (40, 1))
    gray[20, 5] = 20
    gray[20, 55] = 150
    out = images.adaptive_gaussian(gray)
    assert out[20, 5] == 0 and out[20, 55] == 0 and out[5, 30] == 255
