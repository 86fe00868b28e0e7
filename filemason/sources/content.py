"""File content: texts, digests and images."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as V

# Files whose texts are held in a Python worker at a time.
READ_ROWS = 128


def _read(path: str, max_chars: int | None) -> str | None:
    try:
        with open(path, encoding="utf-8", errors="ignore") as f:
            return f.read() if max_chars is None else f.read(max_chars)
    except OSError:
        return None


def read_texts(files: DataFrame, max_chars: int | None = None, max_file_size_kb: int | None = None) -> DataFrame:
    """Add ``text``: the content of document and code files, undecodable bytes dropped and line ends unified;
    NULL for other files and for those that can't be read.

    Whole texts by default; ``max_chars`` bounds what is read of a file, and files above
    ``max_file_size_kb`` are not opened at all.
    """
    wanted = F.col("file_type").isin(V.TEXT_TYPES)
    if max_file_size_kb is not None:
        wanted &= F.col("size") <= max_file_size_kb * 1024
    rows = files.withColumn("_wanted", wanted)
    schema = T.StructType([*files.schema.fields, T.StructField("text", T.StringType())])

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), READ_ROWS):
                part = frame.iloc[at:at + READ_ROWS]
                texts = [_read(p, max_chars) if w else None for p, w in zip(part["path"], part["_wanted"])]
                yield part.drop(columns="_wanted").assign(text=texts)

    return rows.mapInPandas(read, schema)


def hash_files(files: DataFrame, algorithm: str = "sha256", chunk_size: int = 1 << 20) -> DataFrame:
    """Add ``content_hash`` by reading each file in chunks; NULL if it cannot be read."""
    schema = T.StructType([*files.schema.fields, T.StructField("content_hash", T.StringType())])

    def one(path: str) -> str | None:
        digest = hashlib.new(algorithm)
        try:
            with open(path, "rb") as f:
                while chunk := f.read(chunk_size):
                    digest.update(chunk)
        except OSError:
            return None
        return digest.hexdigest()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(content_hash=[one(p) for p in frame["path"]])

    return files.mapInPandas(run, schema)


def with_content_hash(files: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """Add ``content_hash``, by the bytes, of files that share their size with another; the others are never opened (NULL)."""
    from ..operators.duplicates import same_size_only

    hashed = hash_files(same_size_only(files).select("seq", "path"), algorithm).select("seq", "content_hash")
    return files.join(hashed, "seq", "left")


def read_images(spark: SparkSession, *paths: str) -> DataFrame:
    """``(path, image)`` decoded by Spark's image source."""
    loaded = spark.read.format("image").option("recursiveFileLookup", "true").load(list(paths))
    plain = F.regexp_replace("image.origin", "^file:(//)?", "")
    return loaded.select(F.url_decode(F.replace(plain, F.lit("+"), F.lit("%2B"))).alias("path"), "image")


def _starts(hex_prefix: str) -> Column:
    return F.hex("head").startswith(hex_prefix)


def _file_heads(files: DataFrame, size: int = 65536) -> DataFrame:
    """Add ``head``: the first bytes of each file, where formats and Exif blocks are declared."""
    schema = T.StructType([*files.schema.fields, T.StructField("head", T.BinaryType())])

    def one(path: str) -> bytes:
        try:
            with open(path, "rb") as f:
                return f.read(size)
        except OSError:
            return b""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(head=[one(p) for p in frame["path"]])

    return files.mapInPandas(run, schema)


def image_features(files: DataFrame, images: DataFrame) -> DataFrame:
    """Add ``imagemetadata`` to image files: sizes, shape, mode, format and Exif flag, or an error."""
    rows = _file_heads(files.where("file_type = 'image'").select("seq", "path")).join(images, "path", "left")
    width, height = F.col("image.width"), F.col("image.height")
    ok = F.coalesce(width > 0, F.lit(False))
    mode = F.when(F.col("image.nChannels") == 1, "L").when(F.col("image.nChannels") == 3, "RGB").otherwise("RGBA")
    kind = (
        F.when(_starts("89504E47"), "PNG").when(_starts("FFD8FF"), "JPEG").when(_starts("47494638"), "GIF")
        .when(_starts("424D"), "BMP").when(_starts("49492A00") | _starts("4D4D002A"), "TIFF")
    )
    values = {
        "width": width, "height": height, "mode": mode, "format": kind, "aspect_ratio": width / height,
        "total_pixels": width * height, "is_landscape": width > height, "is_portrait": height > width,
        "is_square": F.abs(width - height) < 10, "has_exif": F.hex("head").contains("457869660000"),
    }
    fields = [F.when(ok, c).alias(n) for n, c in values.items()]
    fields.append(F.when(~ok, F.lit("cannot identify image file")).alias("extraction_error"))
    found = rows.select("seq", F.struct(*fields).alias("imagemetadata"))
    return files.join(found, "seq", "left")


def _overlap(n: int) -> np.ndarray:
    """8 × n weights: how much of each of n cells lies in each eighth of the side."""
    edges = np.arange(9) * n / 8
    cells = np.arange(n)
    inside = np.minimum(edges[1:, None], cells + 1) - np.maximum(edges[:-1, None], cells)
    return np.clip(inside, 0, None) / (n / 8)


def _average_hash(data: bytes, height: int, width: int, channels: int) -> int | None:
    if height <= 0 or width <= 0:
        return None
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(float)
    grey = pixels[..., 0] if channels == 1 else pixels[..., :3] @ np.array([0.114, 0.587, 0.299])
    small = _overlap(height) @ grey @ _overlap(width).T
    bits = (small > small.mean()).astype(np.uint64).ravel()
    return int((bits << np.arange(63, -1, -1, dtype=np.uint64)).sum().astype(np.int64))


@F.pandas_udf(T.LongType())
def average_hash(image: pd.DataFrame) -> pd.Series:
    """64-bit average hash of an image struct: 8 × 8 grey means, a bit where a cell is above the mean.

    Cells are area averages; the first cell is the highest bit."""
    values = [_average_hash(d, h, w, c) for d, h, w, c in
              zip(image["data"], image["height"], image["width"], image["nChannels"])]
    return pd.Series(values, dtype="Int64")


def hash_text(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def image_hashes(files: DataFrame, images: DataFrame) -> DataFrame:
    """``(seq, hash)`` of the image files that could be decoded."""
    found = images.where("image.width > 0").select("path", average_hash("image").alias("hash"))
    return files.where("file_type = 'image'").select("seq", "path").join(found, "path").select("seq", "hash")
