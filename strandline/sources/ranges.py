"""Lines of files that Spark's own splits cannot cut, and estimates from a few ranges of large ones.

A file in 16- or 32-bit units is dealt out as byte ranges of whole units.  A line belongs to the range in which it begins, so every
range finds its lines by itself: it looks back one unit, and reads on to the end of its last line.  Compressed files are streams that
only one task can read.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a range.
RANGE = 32 << 20
#: Bytes of the ranges of one task, where there are many.
TASK = 128 << 20
#: Bytes read at once.
STEP = 1 << 20
#: Bytes of UTF-8 that do not begin a character.
CONTINUED = bytes(range(0x80, 0xC0))
#: Codecs of UTF-8, and all in which a range of a file shows where its characters begin.
UTF_8 = ("utf-8", "utf-8-sig")
RANGED = (*UTF_8, "ascii", "latin-1", "iso-8859-1", "cp1252", "windows-1252", "cp1251", "windows-1251", "utf-16", "utf-16-le", "utf-16-be",
          "utf-32")
#: Lines handed over at once.
ROWS = 10_000
LINES_SCHEMA = "path string, block long, at long, line string"
_UNITS = {"utf-16-le": "<u2", "utf-16-be": ">u2", "utf-32-le": "<u4", "utf-32-be": ">u4"}
_MARKS = [(codecs.BOM_UTF32_LE, "utf-32-le"), (codecs.BOM_UTF32_BE, "utf-32-be"), (codecs.BOM_UTF16_LE, "utf-16-le"),
          (codecs.BOM_UTF16_BE, "utf-16-be")]


def unit_codec(head: bytes, name: str) -> tuple[str, int]:
    """Codec with its byte order, and the length of the mark that says so; without a mark the low byte comes first."""
    for mark, codec in _MARKS:
        if head.startswith(mark) and codec[:6] == name[:6]:
            return codec, len(mark)
    return (name if name in _UNITS else f"{name[:6]}-le"), 0


def range_lines(read, codec: str, begin: int, start: int, end: int, step: int = STEP) -> Iterator[str]:
    """Lines that begin at ``start`` or later and before ``end``; ``read(at, n)`` gives bytes, ``begin`` is the text's first.

    LF, CR and CRLF end a line; the last line needs no end.
    """
    dtype, unit = _UNITS[codec], int(_UNITS[codec][2])
    at = begin if start <= begin else start - unit
    parts: list[bytes] | None = [] if start <= begin else None      # of the open line
    left = b""
    if parts is not None and begin >= end:
        return
    while True:
        data = left + read(at, step)
        got = len(data) - len(left)
        at, last = at + got, got == 0
        if last:
            data = data[:len(data) - len(data) % unit]              # half a unit at the end of a broken file
            left = b""
        else:
            left = data[len(data) - len(data) % unit:]
            data = data[:len(data) - len(left)]
            if len(data) >= unit and np.frombuffer(data[-unit:], dtype)[0] == 13:   # its line feed may follow
                left, data = data[-unit:] + left, data[:-unit]
        u = np.frombuffer(data, dtype)
        follows = np.append(u[1:], 0)[:len(u)]
        place = at - len(left) - len(data)                          # of this piece
        seen = 0
        for e in np.flatnonzero((u == 10) | ((u == 13) & (follows != 10))).tolist():
            if parts is not None:
                stop = e - 1 if u[e] == 10 and e > seen and u[e - 1] == 13 else e
                parts.append(data[seen * unit:stop * unit])
                yield b"".join(parts).decode(codec, "replace")
            seen, parts = e + 1, []
            if place + seen * unit >= end:
                return
        if parts is not None:
            parts.append(data[seen * unit:])
        elif place + len(data) >= end:
            return
        if last:
            if parts and (rest := b"".join(parts)):
                yield rest.decode(codec, "replace")
            return


def _batches(path: str, block: int, lines: Iterator[str]) -> Iterator[pd.DataFrame]:
    kept, at = [], 0
    for line in lines:
        kept.append(line)
        if len(kept) == ROWS:
            yield pd.DataFrame({"path": path, "block": block, "at": range(at, at + ROWS), "line": kept})
            kept, at = [], at + ROWS
    yield pd.DataFrame({"path": path, "block": block, "at": range(at, at + len(kept)), "line": kept})


def dealt(files: DataFrame, step: int) -> DataFrame:
    """``files`` (``path, size, ...``) with a row for every ``start`` of a range of ``step`` bytes, dealt out over tasks.

    Their number is given: Spark would take the few bytes of the ranges' places for little work and make it one task.
    """
    n = files.agg(F.sum(F.greatest(F.ceil(F.col("size") / step), F.lit(1)))).first()[0] or 1
    tasks = min(n, max(4 * files.sparkSession.sparkContext.defaultParallelism, n * step // TASK))
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(step).cast("long"))
    return files.withColumn("start", F.explode(starts)).repartition(int(tasks), "path", "start")


def wide_lines(files: DataFrame, size: int = RANGE) -> DataFrame:
    """``path, block, at, line`` of files in 16- or 32-bit units (``path, wide, size``), ranges of ``size`` bytes dealt out over tasks."""
    step = size - size % 4
    ranges = dealt(files.select("path", "wide", "size"), step)

    def read(batches):
        from .opening import open_input
        for pdf in batches:
            for path, name, start in zip(pdf["path"], pdf["wide"], pdf["start"]):
                with open_input(path) as f:
                    def at(place, n):
                        f.seek(place)
                        return f.read(n)
                    codec, begin = unit_codec(at(0, 4), name)
                    yield from _batches(path, start, range_lines(at, codec, begin, start, start + step))
    return ranges.mapInPandas(read, LINES_SCHEMA)


def text_range(read, start: int, end: int, size: int) -> bytes:
    """UTF-8 bytes of the characters that begin at ``start`` or later and before ``end``; ``read(at, n)`` gives bytes."""
    lead = lambda b: len(b) - len(b.lstrip(CONTINUED))
    data = read(start, min(end, size) - start + 3)
    first = lead(data[:3]) if start else 0
    last = min(end, size) - start
    return data[first:last + lead(data[last:last + 3])] if end < size else data[first:]


def wide_range(read, codec: str, start: int, end: int, size: int) -> bytes:
    """As :func:`text_range`, of 16- or 32-bit units; ``start`` and ``end`` are whole units."""
    data = read(start, min(end, size) - start + 2)
    last = min(end, size) - start
    if codec[:6] != "utf-16":
        return data[:last]
    low = lambda b: len(b) == 2 and 0xDC00 <= np.frombuffer(b, _UNITS[codec])[0] < 0xE000
    return data[2 if start and low(data[:2]) else 0:last + 2 if end < size and low(data[last:last + 2]) else last]


def decoded_range(read, codec: str, start: int, end: int, size: int) -> str:
    """The text of a range; broken bytes are replaced.  Texts of neighbouring ranges joined are the text of both, wherever they are cut."""
    if codec in UTF_8:
        return text_range(read, start, end, size).decode("utf-8", "replace")
    if codec[:6] in ("utf-16", "utf-32"):
        codec = unit_codec(read(0, 4), codec)[0]
        return wide_range(read, codec, start, end, size).decode(codec, "replace")
    return read(start, min(end, size) - start).decode(codec, "replace")


def _parts(path: str, texts) -> Iterator[pa.RecordBatch]:
    """``path, part, content`` for ``(part, text)``; the mark at a file's beginning is no text."""
    for part, text in texts:
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([part], pa.int64()), pa.array(
            [text[1:] if part == 0 and text.startswith("\ufeff") else text], pa.string())], ["path", "part", "content"])


def text_parts(files: DataFrame, size: int, codec: str = "utf-8") -> DataFrame:
    """``path, part, content`` of files (``path, place, size``): values of about ``size`` bytes, joined they are the file.

    The codec must show where a character begins (``RANGED``).
    """
    def read(batches):
        from .opening import open_input
        for b in batches:
            for path, place, total, start in zip(*(b.column(c).to_pylist() for c in ("path", "place", "size", "start"))):
                with open_input(place) as f:
                    def at(position, n):
                        f.seek(position)
                        return f.read(n)
                    yield from _parts(path, [(start // size, decoded_range(at, codec, start, start + size, total))])
    return dealt(files.select("path", "place", "size"), size).mapInArrow(read, "path string, part long, content string")


def stream_parts(files: DataFrame, size: int, codec: str) -> DataFrame:
    """As :func:`text_parts` of files (``path, place, compression``) that are read from their beginning, piece by piece by one task each."""
    def cut(pieces):
        held, n, part = [], 0, 0
        for piece in pieces:
            while n + len(piece) >= size:
                yield part, "".join([*held, piece[:size - n]])
                held, piece, n, part = [], piece[size - n:], 0, part + 1
            held.append(piece)
            n += len(piece)
        if n or not part:
            yield part, "".join(held)

    def read(batches):
        for b in batches:
            for path, place, compression in zip(*(b.column(c).to_pylist() for c in ("path", "place", "compression"))):
                yield from _parts(path, cut(text_pieces(place, compression, codec)))
    return files.select("path", "place", "compression").repartition("path").mapInArrow(read, "path string, part long, content string")


# Stream forms of the compressions a setting may name; Snappy has none that all writers share.
STREAMS = {"gzip": "gzip", "zstd": "zstd", "bzip2": "bz2", "lz4": "lz4", "brotli": "brotli", "deflate": "zlib", "none": None,
           "uncompressed": None}


def _cut(pieces: Iterator[str], terminator: str | None) -> Iterator[str]:
    """Lines of a text that comes in pieces; without a terminator LF, CR and CRLF end a line."""
    parts: list[str] = []
    held = ""
    for piece in pieces:
        piece = held + piece
        keep = 1 if terminator is None else len(terminator) - 1
        held = ""
        if terminator is None:
            if piece.endswith("\r"):
                held, piece = "\r", piece[:-1]
            cut = piece.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        else:
            cut = piece.split(terminator)
            tail = max((k for k in range(1, keep + 1) if cut[-1].endswith(terminator[:k])), default=0)
            held, cut[-1] = cut[-1][len(cut[-1]) - tail:], cut[-1][:len(cut[-1]) - tail]
        parts.append(cut[0])
        for more in cut[1:]:
            yield "".join(parts)
            parts = [more]
    if held and terminator is None:
        yield "".join(parts)
    elif rest := "".join(parts) + held:
        yield rest


def text_pieces(path: str, compression: str, encoding: str | None) -> Iterator[str]:
    """A file's text from its beginning, decompressed and decoded piece by piece."""
    import zlib

    from .opening import open_input
    kind = STREAMS[compression]
    decode = codecs.getincrementaldecoder(encoding or "utf-8")("replace" if encoding else "surrogateescape")
    with open_input(path) as f:
        source = pa.CompressedInputStream(f, kind) if kind and kind != "zlib" else f
        inflate = zlib.decompressobj() if kind == "zlib" else None
        while data := source.read(STEP):
            yield decode.decode(inflate.decompress(data) if inflate else data)
        yield decode.decode(inflate.flush() if inflate else b"", True)


def stream_lines(files: DataFrame, compression: str, encoding: str | None, terminator: str | None) -> DataFrame:
    """``path, block, at, line`` of whole files (``path``), decompressed and decoded piece by piece by one task each.

    Without ``encoding`` the bytes come as they are, for the charset to be told from them.
    """
    def read(batches):
        for pdf in batches:
            for path in pdf["path"]:
                for rows in _batches(path, 0, _cut(text_pieces(path, compression, encoding), terminator)):
                    rows["line"] = [t.encode("utf-8", "surrogateescape") for t in rows["line"]]
                    yield rows
    as_bytes = files.select("path").repartition("path").mapInPandas(read, LINES_SCHEMA.replace("line string", "line binary"))
    return as_bytes.withColumn("line", F.col("line").cast("string"))


def estimate_lines(files: DataFrame, windows: int = 16, window_bytes: int = 1 << 16) -> DataFrame:
    """``path, size, lines, error, bytes_read`` of files (``path``) from ``windows`` evenly spaced ranges of each.

    ``lines`` is the size over the mean length of the lines between the first and last line end of the ranges; ``error`` is twice
    its standard error from the ranges' differing means, as lines.  A file no larger than its ranges is read whole: ``lines`` is
    exact, ``error`` 0.  A file that cannot be read has nulls.
    """
    def one(path):
        from .opening import open_input
        try:
            with open_input(path) as f:
                size = f.size()
                if size <= windows * window_bytes:
                    data = f.read(size)
                    return size, float(data.count(b"\n") + (size > 0 and not data.endswith(b"\n"))), 0.0, size
                found = []
                for k in range(windows):
                    f.seek(k * (size - window_bytes) // (windows - 1) if windows > 1 else 0)
                    data = f.read(window_bytes)
                    first, last, n = data.find(b"\n"), data.rfind(b"\n"), data.count(b"\n")
                    found.append((n - 1, last - first) if n > 1 else (n, len(data)))
                n, span = np.array(found, float).T
                density = n.sum() / span.sum()
                spread = np.sqrt(((n - density * span) ** 2).sum() / max(1, windows - 1) / windows) / span.mean()
                return size, size * density, 2 * size * spread, windows * window_bytes
        except OSError:
            return None, None, None, None

    def read(batches):
        for pdf in batches:
            yield pd.DataFrame([(p, *one(p)) for p in pdf["path"]], columns=["path", "size", "lines", "error", "bytes_read"]) \
                .astype({"size": "Int64", "bytes_read": "Int64"})
    return files.select("path").repartition("path").mapInPandas(
        read, "path string, size long, lines double, error double, bytes_read long")
