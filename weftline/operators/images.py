"""Images as tables of pixels. Input is a table with Spark's image struct, one row per image."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weftline.registry import transform

PIXELS = "origin string, x int, y int, channel string, value int"
MAX_PIXELS = 500_000
NAMES = {1: "gray", 3: "rgb", 4: "rgba"}


def _planes(data: bytes, height: int, width: int, channels: int, color: str) -> list[tuple[str, np.ndarray]]:
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        r = g = b = a[:, :, 0]
        alpha = np.full((height, width), 255, np.uint8)
    else:  # stored as blue, green, red and perhaps alpha
        b, g, r = a[:, :, 0], a[:, :, 1], a[:, :, 2]
        alpha = a[:, :, 3] if channels == 4 else np.full((height, width), 255, np.uint8)
    gray = a[:, :, 0] if channels == 1 else ((r.astype(np.int64) * 19595 + g.astype(np.int64) * 38470 + b.astype(np.int64) * 7471 + 0x8000) >> 16).astype(np.uint8)
    every = {"r": r, "g": g, "b": b, "a": alpha, "gray": gray}
    color = color.lower()
    if color in ("rgba", "rgb"):
        return [(c, every[c]) for c in color]
    if color in ("gray", "grey", "l"):
        return [("gray", gray)]
    name = {"red": "r", "green": "g", "blue": "b", "alpha": "a"}.get(color, color)
    if name not in every:
        raise ValueError(f"unknown colour format or channel {color}")
    return [(name, every[name])]


def _pixels(images: DataFrame, color: str, max_pixels: int, sample_step: int | None) -> DataFrame:
    _planes(b"\0", 1, 1, 1, color)  # the name is checked before any job

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for origin, h, w, n, data in zip(*[batch.column(k).to_pylist() for k in range(5)]):
                step = int(sample_step) if sample_step else max(1, int((h * w / max_pixels) ** 0.5)) if h * w > max_pixels else 1
                for name, plane in _planes(data, h, w, n, color):
                    part = plane[::step, ::step]
                    ys, xs = np.indices(part.shape, np.int32)
                    size = part.size
                    yield pa.RecordBatch.from_arrays([pa.array([origin] * size, pa.string()), pa.array((xs * step).ravel(), pa.int32()), pa.array((ys * step).ravel(), pa.int32()), pa.array([name] * size), pa.array(part.ravel().astype(np.int32))], names=["origin", "x", "y", "channel", "value"])

    flat = images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").where("height > 0 and width > 0")
    return flat.mapInArrow(read, PIXELS)


@transform("image_to_dataframe", image="IMAGE", color_format="STRING", max_pixels="INTEGER", sample_step="INTEGER")
def image_to_dataframe(image: DataFrame, color_format: str = "rgba", max_pixels: int = MAX_PIXELS, sample_step: int | None = None) -> DataFrame:
    """``x, y, channel, value`` of the pixels, channel by channel (rgba, rgb or gray).

    Images over ``max_pixels`` are thinned by an even step. With several images see ``origin`` in pixels().
    """
    return _pixels(image, color_format or "rgba", int(max_pixels), sample_step).drop("origin")


def pixels(images: DataFrame, color_format: str = "rgba", sample_step: int = 1) -> DataFrame:
    """As image_to_dataframe, of many images, with the ``origin`` of each pixel and without thinning."""
    return _pixels(images, color_format, MAX_PIXELS, sample_step)


@transform("extract_channel", image="IMAGE", channel="STRING", max_pixels="INTEGER", sample_step="INTEGER")
def extract_channel(image: DataFrame, channel: str = "gray", max_pixels: int = MAX_PIXELS, sample_step: int | None = None) -> DataFrame:
    """``x, y, channel, value`` of one channel: r, g, b, a (or their names) or gray."""
    return _pixels(image, channel or "gray", int(max_pixels), sample_step).drop("origin")


@transform("image_metadata", image="IMAGE")
def image_metadata(image: DataFrame) -> DataFrame:
    """``width, height, channels, format, mode`` of each image; unreadable ones are left out."""
    mode = F.when(F.col("image.nChannels") == 1, "L").when(F.col("image.nChannels") == 3, "RGB").when(F.col("image.nChannels") == 4, "RGBA")
    ending = F.upper(F.regexp_extract("image.origin", r"\.([A-Za-z0-9]+)$", 1))
    return image.where("image.height > 0").select(F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"), F.when(ending == "JPG", "JPEG").otherwise(ending).alias("format"), mode.alias("mode"))
