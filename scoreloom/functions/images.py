"""Images of questions (F12 to F14): bytes, sizes from headers, data URLs, and scaling down where an image library is at hand."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .scoring import bytes_of, col, data_url, mime_type

#: Longest edge that an image may have, and quality of a new JPEG.
LONG_EDGE, QUALITY = 1024, 85


def image_bytes(value: Column | str, kind: str) -> Column:
    """binary columns as they are (empty is none), text by base64."""
    return F.when(F.length(col(value)) > 0, col(value)) if kind == "binary" else bytes_of(value)


def _size(data: bytes | None) -> tuple[int | None, int | None]:
    """Width and height by the header of a PNG, GIF or JPEG."""
    if not data:
        return None, None
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big")
    if data[:4] == b"GIF8" and len(data) >= 10:
        return int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little")
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(data) and data[at] == 0xFF:
            kind, length = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):  # a frame's header
                return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
            at += 1 if kind == 0xFF else 2 + max(2, length)
    return None, None


def _sizes(data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_size(x) for x in data], columns=["width", "height"], dtype="Int32")


def png_size(data: Column | str) -> Column:
    """Width and height of a PNG as expressions: two big-endian numbers at fixed places."""
    number = lambda at: F.conv(F.hex(F.substring(col(data), at, 4)), 16, 10).cast("int")
    png = (F.hex(F.substring(col(data), 1, 8)) == "89504E470D0A1A0A") & (F.length(col(data)) >= 24)
    return F.when(png, F.struct(number(17).alias("width"), number(21).alias("height")))


def image_size(data: Column | str) -> Column:
    """Width and height; Python looks at what is no PNG alone."""
    png = png_size(data)
    return F.when(png.isNotNull(), png).otherwise(F.pandas_udf(_sizes, "struct<width:int,height:int>")(F.when(png.isNull(), col(data))))


#: Channels of a PNG's colour types.
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _whole_png(data: bytes) -> bool:
    """Chunks with right checksums up to the end mark, and pixels that inflate to as many bytes as the header asks for."""
    at, header, packed = 8, None, []
    while at + 12 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        kind, body, after = data[at + 4 : at + 8], data[at + 8 : at + 8 + size], at + 12 + size
        if after > len(data) or zlib.crc32(body, zlib.crc32(kind)) != int.from_bytes(data[after - 4 : after], "big"):
            return False
        if kind == b"IHDR" and size == 13:
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
        at = after
    else:
        return False
    if header is None or header[3] not in _CHANNELS or not header[0] or not header[1]:
        return False
    width, height, depth, colour, _, _, interlaced = header
    line = lambda n: 1 + -(-n * depth * _CHANNELS[colour] // 8)
    # passes of an interlaced image: first column and line, and steps of either
    passes = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)) if interlaced else ((0, 0, 1, 1),)
    sizes = ((-(-(width - x) // dx), -(-(height - y) // dy)) for x, y, dx, dy in passes)
    wanted = sum(line(w) * h for w, h in sizes if w > 0 and h > 0)
    inflate, got = zlib.decompressobj(), 0
    try:
        for part in packed:
            # a megabyte at a time, so that a small file can't fill the memory
            while part:
                got += len(inflate.decompress(part, 1 << 20))
                part = inflate.unconsumed_tail
        return got + len(inflate.flush()) >= wanted
    except zlib.error:
        return False


def _whole_jpeg(data: bytes) -> bool:
    """Segments up to the scans, a frame among them, and the end mark after the last scan."""
    at, frame = 2, False
    while at + 4 <= len(data) and data[at] == 0xFF:
        kind, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if kind == 0xFF:
            at += 1
        elif kind == 0xDA:
            return frame and data.find(b"\xff\xd9", at + 2 + size) >= 0
        elif size < 2:
            return False
        else:
            frame |= 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
            at += 2 + size
    return False


def _whole(data: bytes | None) -> bool | None:
    if data is None:
        return None
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return _whole_png(data)
    if data[:3] == b"\xff\xd8\xff":
        return _whole_jpeg(data)
    if data[:4] == b"GIF8":
        return _size(data)[0] is not None and data.rstrip(b"\0")[-1:] == b";"
    # other kinds by their first bytes alone, as SQL does
    return data[:2] == b"BM" or (data[:4] == b"RIFF" and data[8:12] == b"WEBP")


def decodes(data: Column | str) -> Column:
    """Whether an image can be read to its end: PNG by chunks and pixels, JPEG and GIF by their marks."""
    return F.pandas_udf(lambda parts: parts.map(lambda x: None if x is None else _whole(bytes(x))), "boolean")(col(data))


def _scaled(data: bytes | None) -> bytes | None:
    """The image in a new size, as PNG if it has an alpha channel, else as JPEG; null where it can't be read or there is no library."""
    try:
        from PIL import Image
    except ImportError:
        return None
    try:
        image = Image.open(io.BytesIO(data))
        image.load()
    except Exception:  # whatever a broken image raises
        return None
    image.thumbnail((LONG_EDGE, LONG_EDGE), Image.Resampling.LANCZOS)
    out = io.BytesIO()
    if image.mode in ("RGBA", "LA"):
        image.save(out, "PNG", optimize=True)
    else:
        (image if image.mode in ("RGB", "L") else image.convert("RGB")).save(out, "JPEG", quality=QUALITY, optimize=True, progressive=True)
    return out.getvalue()


def _all_scaled(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for data in parts:
        yield data.map(lambda x: None if x is None else _scaled(x))


def message_image(data: Column | str) -> Column:
    """(url, warning) of an image: small ones as they are, large ones scaled down, none of what is no image."""
    size = image_size(data)
    edge = F.greatest(size["width"], size["height"])
    large = F.pandas_udf(_all_scaled, "binary")(F.when(edge > LONG_EDGE, col(data)))
    return (
        F.when(col(data).isNull(), F.struct(F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("warning")))
        .when(edge.isNull() | (mime_type(data) == "application/octet-stream"), F.struct(F.lit(None).cast("string").alias("url"), F.lit("image_decode_failed").alias("warning")))
        .when(edge <= LONG_EDGE, F.struct(data_url(data).alias("url"), F.lit(None).cast("string").alias("warning")))
        .when(large.isNotNull(), F.struct(data_url(large).alias("url"), F.lit(None).cast("string").alias("warning")))
        .otherwise(F.struct(F.lit(None).cast("string").alias("url"), F.lit("image_too_large").alias("warning")))
    )
