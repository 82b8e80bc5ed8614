"""Feature vectors of images, as raw arrays of RGB bytes: 1,296 numbers in six weighted blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Canvas, background rule, block weights.
CANVAS, LIGHT, RANGE, MARGIN = 96, 247, 12, 0.015
W_GREY, W_EDGE, W_COLOR, W_ORIENT, W_PROJECT, W_FREQUENCY = 2.0, 1.25, 0.75, 1.25, 0.75, 1.0
DIMENSIONS = 1_296


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x)
    return x / norm if norm > 1e-12 else np.zeros_like(x)


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area means on a grid, by summed areas; enlarging repeats pixels."""
    h, w = image.shape[:2]
    ys, xs = np.linspace(0, h, height + 1), np.linspace(0, w, width + 1)
    y0, x0 = np.floor(ys[:-1]).astype(int), np.floor(xs[:-1]).astype(int)
    y1, x1 = np.maximum(np.ceil(ys[1:]).astype(int), y0 + 1).clip(max=h), np.maximum(np.ceil(xs[1:]).astype(int), x0 + 1).clip(max=w)
    area = np.zeros((h + 1, w + 1, *image.shape[2:]))
    area[1:, 1:] = image.astype(float).cumsum(0).cumsum(1)
    total = area[y1][:, x1] - area[y0][:, x1] - area[y1][:, x0] + area[y0][:, x0]
    count = ((y1 - y0)[:, None] * (x1 - x0)[None, :]).astype(float)
    return total / (count[..., None] if image.ndim == 3 else count)


def _pooled(plane: np.ndarray, cells: int) -> np.ndarray:
    step = plane.shape[0] // cells
    return plane.reshape(cells, step, cells, step).mean(axis=(1, 3))


def _hsv(rgb: np.ndarray) -> np.ndarray:
    """Hue, saturation and value, each from 0 to 1, of channels from 0 to 1."""
    top, low = rgb.max(axis=2), rgb.min(axis=2)
    span = np.where(top > low, top - low, 1.0)
    r, g, b = (rgb[..., i] for i in range(3))
    hue = np.select([top == low, top == r, top == g], [0.0, ((g - b) / span) % 6, (b - r) / span + 2], (r - g) / span + 4) / 6
    return np.stack([hue, np.where(top > 0, (top - low) / np.where(top > 0, top, 1.0), 0.0), top], axis=2)


def trimmed(rgb: np.ndarray) -> np.ndarray:
    """An image without its light, colourless border, but for a small margin; one without any content as it is."""
    grey = rgb @ np.array([0.299, 0.587, 0.114])
    content = (grey < LIGHT) | (np.ptp(rgb.astype(int), axis=2) > RANGE)
    if not content.any():
        return rgb
    h, w = content.shape
    ys, xs = np.flatnonzero(content.any(1)), np.flatnonzero(content.any(0))
    my, mx = max(2, int(h * MARGIN)), max(2, int(w * MARGIN))
    return rgb[max(0, ys[0] - my) : min(h, ys[-1] + my + 1), max(0, xs[0] - mx) : min(w, xs[-1] + mx + 1)]


def features(rgb: np.ndarray) -> np.ndarray:
    """Vector of an image (height, width, 3): trimmed, shrunk to fit, and set in the middle of a white square."""
    rgb = trimmed(rgb)
    scale = min(1.0, CANVAS / max(rgb.shape[:2]))
    h, w = max(1, round(rgb.shape[0] * scale)), max(1, round(rgb.shape[1] * scale))
    canvas = np.full((CANVAS, CANVAS, 3), 255.0)
    top, left = (CANVAS - h) // 2, (CANVAS - w) // 2
    canvas[top : top + h, left : left + w] = resize(rgb, h, w) if scale < 1 else rgb
    canvas /= 255
    grey = canvas @ np.array([0.299, 0.587, 0.114])
    dark = 1 - grey
    gy, gx = np.gradient(grey)
    strength, angle = np.hypot(gx, gy), np.mod(np.arctan2(gy, gx), np.pi)
    bins = np.minimum((angle / np.pi * 8).astype(int), 7)
    cell = np.arange(CANVAS) // (CANVAS // 4)
    orient = np.zeros((4, 4, 8))
    np.add.at(orient, (cell[:, None].repeat(CANVAS, 1), cell[None, :].repeat(CANVAS, 0), bins), strength)
    hist = lambda plane, n: np.histogram(plane, n, (0.0, 1.0))[0].astype(float)
    color = [hist(planes[..., c], 16) for planes in (canvas, _hsv(canvas)) for c in range(3)] + [hist(grey, 32)]
    profile = _pooled(dark, 32)
    low = np.log1p(np.abs(np.fft.rfft2(_pooled(dark, 48))[:16, :9]))
    low[0, 0] = 0.0
    blocks = [
        (_pooled(dark, 24), W_GREY), (_pooled(strength, 16), W_EDGE), (np.concatenate(color), W_COLOR), (orient, W_ORIENT),
        (np.concatenate([profile.mean(0), profile.mean(1)]), W_PROJECT), (low, W_FREQUENCY),
    ]
    return _unit(np.concatenate([_unit(b.ravel()) * w for b, w in blocks])).astype(np.float32)


def orientation(data: bytes) -> int:
    """The EXIF orientation (1 to 8) of a JPEG file's bytes; 1 where none is said."""
    at = 2
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        block = data[at + 4 : at + 2 + size]
        if data[at + 1] == 0xE1 and block[:6] == b"Exif\0\0":
            tiff = block[6:]
            order = "little" if tiff[:2] == b"II" else "big"
            n = lambda i, k: int.from_bytes(tiff[i : i + k], order)
            first = n(4, 4)
            for i in range(n(first, 2)):
                entry = first + 2 + 12 * i
                if n(entry, 2) == 0x0112:
                    value = n(entry + 8, 2)
                    return value if 1 <= value <= 8 else 1
        at += 2 + size
    return 1


def upright(rgb: np.ndarray, turned: int) -> np.ndarray:
    """An image as it is to be seen, by its EXIF orientation."""
    if turned in (5, 6, 7, 8):
        rgb = rgb.transpose(1, 0, 2)
    flips = {2: (1,), 3: (0, 1), 4: (0,), 6: (1,), 7: (0, 1), 8: (0,)}.get(turned, ())
    return np.flip(rgb, flips) if flips else rgb


def decoded(spark, data: bytes) -> np.ndarray:
    """Upright RGB pixels of an image file's bytes, by the JVM's reader; unreadable bytes are an error."""
    reader = getattr(getattr(spark.sparkContext._jvm.org.apache.spark.ml.image, "ImageSchema$"), "MODULE$")
    found = reader.decode("query", bytearray(data))
    if found.isEmpty():
        raise ValueError("the image cannot be read")
    row = found.get().getStruct(0)
    pixels = np.frombuffer(bytes(row.get(5)), np.uint8).reshape(row.getInt(1), row.getInt(2), row.getInt(3))
    rgb = pixels.repeat(3, 2) if pixels.shape[2] == 1 else pixels[:, :, 2::-1]
    return upright(rgb, orientation(data))


def features_of(rgb: np.ndarray) -> np.ndarray:
    return features(np.ascontiguousarray(rgb))


def image_features(df: DataFrame, key: str = "key") -> DataFrame:
    """key and vector of rows (key, height, width, data): data holds RGB bytes by row; a broken row has a null vector."""

    @F.pandas_udf("array<float>")
    def vector(height: pd.Series, width: pd.Series, data: pd.Series) -> pd.Series:
        def one(h: int, w: int, d: bytes) -> list[float] | None:
            if d is None or not h or not w or len(d) != h * w * 3:
                return None
            return features(np.frombuffer(d, np.uint8).reshape(int(h), int(w), 3)).tolist()

        return pd.Series([one(*x) for x in zip(height, width, data)])

    return df.select(key, vector("height", "width", "data").alias("vector"))


def read_images(spark, path: str) -> DataFrame:
    """key (origin), height, width, data of an image folder, decoded by the JVM; grey and BGR(A) become RGB."""
    raw = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")

    @F.pandas_udf("binary")
    def rgb(n: pd.Series, data: pd.Series) -> pd.Series:
        def one(c: int, d: bytes) -> bytes:
            a = np.frombuffer(d, np.uint8).reshape(-1, c)
            return (a.repeat(3, 1) if c == 1 else a[:, 2::-1]).tobytes()

        return pd.Series([one(c, d) for c, d in zip(n, data)])

    return raw.select(F.col("origin").alias("key"), "height", "width", rgb("nChannels", "data").alias("data"))
