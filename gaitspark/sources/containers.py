"""Durations, rates and sizes of MP4, MOV and AVI files from their boxes and headers, read in tasks without their media."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
import pyarrow.fs as afs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_importable

#: The containers of videos, by extension.
VIDEOS = (".mp4", ".mov", ".avi")
#: Bytes of an index (moov box, AVI header list) that are read; a longer one is an error of its file.
MOST_INDEX = 256 << 20
FIELDS = "duration_s double, frame_rate_hz double, total_frames long, width_pixels int, height_pixels int, codec string, frames_estimated boolean, container_s double, error string"


class Broken(ValueError):
    """The file isn't what its extension says, or says nothing usable."""


def boxes(data: bytes, lo: int, hi: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start, end) of the boxes between two places of an index."""
    while lo + 8 <= hi:
        size, kind, skip = int.from_bytes(data[lo : lo + 4], "big"), data[lo + 4 : lo + 8], 8
        if size == 1 and lo + 16 <= hi:
            size, skip = int.from_bytes(data[lo + 8 : lo + 16], "big"), 16
        size = size or hi - lo
        if size < skip or lo + size > hi:
            raise Broken("a box runs over its parent's end")
        yield kind, lo + skip, lo + size
        lo += size


def inside(data: bytes, span: tuple[int, int], *way: bytes) -> tuple[int, int] | None:
    """The span of the first box at the end of a way of kinds."""
    for kind in way:
        span = next(((a, b) for k, a, b in boxes(data, *span) if k == kind), None)
        if span is None:
            return None
    return span


def clock(data: bytes, at: int) -> tuple[int, int]:
    """(units a second, units) of a movie or media header, whose fields are wider from version 1 on."""
    wide = data[at] == 1
    where, form = (at + 20, ">IQ") if wide else (at + 12, ">II")
    return struct.unpack_from(form, data, where)


def index(f: BinaryIO, length: int) -> bytes:
    """The content of the moov box, which may come after the media."""
    at = 0
    while at + 8 <= length:
        f.seek(at)
        head = f.read(16)
        size, kind, skip = int.from_bytes(head[:4], "big"), head[4:8], 8
        if size == 1:
            size, skip = int.from_bytes(head[8:16], "big"), 16
        size = size or length - at
        if size < skip:
            raise Broken("a box is shorter than its header")
        if kind == b"moov":
            if at + size > length or size > MOST_INDEX:
                raise Broken("the index is cut off or too long")
            f.seek(at + skip)
            return f.read(size - skip)
        at += size
    raise Broken("there is no index")


def mp4(f: BinaryIO, length: int) -> dict:
    data = index(f, length)
    whole = (0, len(data))
    movie = inside(data, whole, b"mvhd")
    scale, units = clock(data, movie[0]) if movie else (0, 0)
    out = {"container_s": units / scale if scale else None}
    for kind, *track in boxes(data, *whole):
        handler = inside(data, tuple(track), b"mdia", b"hdlr") if kind == b"trak" else None
        if not handler or data[handler[0] + 8 : handler[0] + 12] != b"vide":
            continue
        media, table = inside(data, tuple(track), b"mdia", b"mdhd"), inside(data, tuple(track), b"mdia", b"minf", b"stbl")
        if not media or not table:
            raise Broken("the video track has no sample table")
        scale, units = clock(data, media[0])
        times, described = inside(data, table, b"stts"), inside(data, table, b"stsd")
        frames = played = 0
        if times:
            n = int.from_bytes(data[times[0] + 4 : times[0] + 8], "big")
            for count, delta in struct.iter_unpack(">II", data[times[0] + 8 : min(times[1], times[0] + 8 + 8 * n)]):
                frames, played = frames + count, played + count * delta
        duration = (units or played) / scale if scale else None
        header = inside(data, tuple(track), b"tkhd")
        width, height = (x >> 16 for x in struct.unpack_from(">II", data, header[1] - 8)) if header else (0, 0)
        if described and not (width and height):
            width, height = struct.unpack_from(">HH", data, described[0] + 8 + 32)
        codec = data[described[0] + 12 : described[0] + 16].decode("latin-1").strip() if described else None
        rate = frames * scale / played if played else None
        return out | {"duration_s": duration, "frame_rate_hz": rate, "total_frames": frames or None, "width_pixels": width, "height_pixels": height, "codec": codec, "frames_estimated": False}
    return out


def chunks(data: bytes, lo: int, hi: int) -> Iterator[tuple[bytes, int, int]]:
    while lo + 8 <= hi:
        size = int.from_bytes(data[lo + 4 : lo + 8], "little")
        yield data[lo : lo + 4], lo + 8, min(hi, lo + 8 + size)
        lo += 8 + size + size % 2


def avi(f: BinaryIO, length: int) -> dict:
    head = f.read(24)
    if head[:4] != b"RIFF" or head[8:12] != b"AVI " or head[12:16] != b"LIST" or head[20:24] != b"hdrl":
        raise Broken("there is no header list")
    size = int.from_bytes(head[16:20], "little") - 4
    if size > MOST_INDEX:
        raise Broken("the header list is too long")
    data = f.read(size)
    if len(data) < size:
        raise Broken("the header list is cut off")
    main = next(((a, b) for k, a, b in chunks(data, 0, len(data)) if k == b"avih"), None)
    if not main or main[1] - main[0] < 40:
        raise Broken("there is no main header")
    micros, *_, frames, _, _, _, width, height = struct.unpack_from("<10I", data, main[0])
    rate = 1e6 / micros if micros else None
    codec = None
    for kind, a, b in chunks(data, 0, len(data)):
        if kind == b"LIST" and data[a : a + 4] == b"strl":
            own = next(((x, y) for k, x, y in chunks(data, a + 4, b) if k == b"strh"), None)
            if own and data[own[0] : own[0] + 4] == b"vids":
                codec = data[own[0] + 4 : own[0] + 8].decode("latin-1").strip("\x00 ").lower() or None
                scale, per = struct.unpack_from("<II", data, own[0] + 20)
                rate = per / scale if scale and per else rate
                frames = struct.unpack_from("<I", data, own[0] + 32)[0] or frames
                break
    duration = frames / rate if rate and frames else None
    return {"duration_s": duration, "container_s": duration, "frame_rate_hz": rate, "total_frames": frames or None, "width_pixels": width, "height_pixels": height, "codec": codec, "frames_estimated": False}


def opened(uri: str):
    """A file that can be read at any place, in a task. A local one is named file:/x or file:///x, or by its path."""
    if uri.startswith("file:"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    store, path = afs.FileSystem.from_uri(uri) if "://" in uri else (afs.LocalFileSystem(), uri)
    return store.open_input_file(path)


def inspected(uri: str) -> dict:
    suffix = uri[uri.rfind(".") :].lower()
    if suffix not in VIDEOS:
        raise Broken(f"{suffix or 'a file without extension'} is not one of {', '.join(VIDEOS)}")
    with opened(uri) as f:
        return (avi if suffix == ".avi" else mp4)(f, f.size())


def video_files(rows: DataFrame) -> DataFrame:
    """rows (..., uri) without uri, with what each file's container says (FIELDS). Only heads and indexes are read, at the
    places where they are; a file that can't be used has an error."""
    ensure_importable(rows.sparkSession)
    kept = [c for c in rows.columns if c != "uri"]
    names = [x.split()[0] for x in FIELDS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for uri in pdf["uri"]:
                try:
                    found.append(inspected(uri))
                except (ValueError, OSError, IndexError, struct.error) as e:
                    found.append({"error": str(e) or "unreadable"})
            made = pd.DataFrame(found, index=pdf.index).reindex(columns=names).astype({"total_frames": "Int64", "width_pixels": "Int32", "height_pixels": "Int32"})
            yield pd.concat([pdf[kept], made.astype(object).where(made.notna(), None)], axis=1)

    out = rows.mapInPandas(run, ", ".join([*[f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept], FIELDS]))
    wrong = F.when(F.coalesce("duration_s", F.lit(0.0)) <= 0, "no positive duration").when(F.coalesce("frame_rate_hz", F.lit(0.0)) <= 0, "no positive frame rate").when((F.coalesce("width_pixels", F.lit(0)) <= 0) | (F.coalesce("height_pixels", F.lit(0)) <= 0), "no frame size")
    return out.withColumn("error", F.coalesce("error", wrong))
