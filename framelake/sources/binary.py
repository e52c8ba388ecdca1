"""Structure of binary files, read in Arrow batches: preview containers, JPEG sizes, JPEGs embedded in TIFF-like files.

Nothing is decoded to pixels.  Damaged input gives null or an empty list, never
an error.
"""

from __future__ import annotations

import struct
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the formats.
CHUNK_MAGIC = b"AgHg"  # container: big-endian u16 header length at 4, u64 data length at 8, u64 padding at 16, name at 24
SOF_MARKERS = (0xC0, 0xC1, 0xC2, 0xC3)  # JPEG frames: u16 height and width after length and precision
LOSSLESS = 0xC3
BARE_MARKERS = {0x01, 0xD8, *range(0xD0, 0xD8)}  # JPEG markers without a length
SUB_IFD, EXIF_IFD, JPEG_OFFSET, JPEG_LENGTH, STRIP_OFFSETS, STRIP_LENGTHS = 0x014A, 0x8769, 0x0201, 0x0202, 0x0111, 0x0117
MOST_HOPS, MOST_ENTRIES, LEAST_JPEG = 16, 1000, 1024
TYPE_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8}


def chunks(data: bytes) -> Iterator[tuple[str, int, int]]:
    """Name, offset and length of every chunk of a preview container."""
    at = 0
    while at + 24 <= len(data) and data[at : at + 4] == CHUNK_MAGIC:
        (head,) = struct.unpack_from(">H", data, at + 4)
        length, pad = struct.unpack_from(">QQ", data, at + 8)
        if head < 24:
            return
        yield data[at + 24 : at + head].partition(b"\0")[0].decode("ascii", "replace"), at + head, length
        at += head + length + pad


def jpeg_frame(data: bytes) -> tuple[int, int, int] | None:
    """Width, height and frame marker of a JPEG, from its first frame header."""
    at, end = 2, len(data)
    while at + 9 <= end:
        if data[at] != 0xFF:
            at += 1
        elif data[at + 1] == 0xFF:
            at += 1
        elif data[at + 1] in BARE_MARKERS:
            at += 2
        elif data[at + 1] in SOF_MARKERS:
            height, width = struct.unpack_from(">HH", data, at + 5)
            return width, height, data[at + 1]
        else:
            at += 2 + struct.unpack_from(">H", data, at + 2)[0]
    return None


def embedded_jpegs(data: bytes) -> list[tuple[int, int]]:
    """Offset and length of the decodable JPEGs that the image folders of a TIFF-like file point to, largest first.

    Folders are followed breadth first, each once; a chain of next folders for
    at most MOST_HOPS, folders within a folder begin a chain of their own.
    """
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        return []

    def values(kind: int, count: int, at: int) -> list[int]:
        size = TYPE_SIZES.get(kind, 0) * count
        if not size or count > MOST_ENTRIES:
            return []
        start = at if size <= 4 else struct.unpack_from(order + "I", data, at)[0]
        code = {1: "B", 3: "H", 4: "I", 13: "I", 16: "Q"}.get(kind)
        return list(struct.unpack_from(f"{order}{count}{code}", data, start)) if code and start + size <= len(data) else []

    todo, hops, found = deque([(struct.unpack_from(order + "I", data, 4)[0], 1)]), {}, set()
    while todo:
        at, hop = todo.popleft()
        # a folder reached again on a shorter chain is followed again, since more may lie behind it
        if hop > MOST_HOPS or hops.get(at, MOST_HOPS + 1) <= hop or at < 8 or at + 2 > len(data):
            continue
        hops[at] = hop
        (n,) = struct.unpack_from(order + "H", data, at)
        if n > MOST_ENTRIES or at + 2 + 12 * n > len(data):
            continue
        tags = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            tags[tag] = values(kind, count, at + 10 + 12 * i)
        todo.extend((to, 1) for to in tags.get(SUB_IFD, []) + tags.get(EXIF_IFD, []))
        if at + 6 + 12 * n <= len(data):
            todo.append((struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0], hop + 1))
        found |= {*zip(tags.get(JPEG_OFFSET, []), tags.get(JPEG_LENGTH, [])), *(zip(tags.get(STRIP_OFFSETS, []), tags.get(STRIP_LENGTHS, [])) if len(tags.get(STRIP_OFFSETS, [])) == 1 else ())}

    def usable(span: tuple[int, int]) -> bool:
        part = data[span[0] : span[0] + span[1]]
        frame = jpeg_frame(part) if part[:2] == b"\xff\xd8" and len(part) >= LEAST_JPEG else None
        return frame is not None and frame[2] != LOSSLESS

    return sorted(filter(usable, found), key=lambda s: (-s[1], s[0]))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())])))
def container_chunks(content: pd.Series) -> pd.Series:
    return content.map(lambda b: [{"name": n, "offset": o, "length": k} for n, o, k in chunks(bytes(b))], na_action="ignore")


@F.pandas_udf(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))
def jpeg_size(content: pd.Series) -> pd.DataFrame:
    frames = [jpeg_frame(bytes(b)) if b is not None else None for b in content]
    return pd.DataFrame({"width": pd.array([f and f[0] for f in frames], dtype="Int32"), "height": pd.array([f and f[1] for f in frames], dtype="Int32")})


@F.pandas_udf(T.BinaryType())
def largest_embedded_jpeg(content: pd.Series) -> pd.Series:
    def pick(b):
        spans = embedded_jpegs(bytes(b)) if b is not None else []
        return bytes(b)[spans[0][0] : spans[0][0] + spans[0][1]] if spans else None

    return content.map(pick)


def best_level(levels: Column, size: int) -> Column:
    """Of array<struct<edge, ...>> the least edge of at least ``size``, else the greatest."""
    up = F.filter(levels, lambda s: s.edge >= size)
    return F.when(F.size(up) > 0, F.array_min(up)).otherwise(F.array_max(levels))
