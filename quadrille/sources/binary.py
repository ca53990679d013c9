"""Shared pieces of the binary mesh formats: bounded reads and positioned writes.

Both formats are single files with fixed-width sections, so a task can read or
write its own rows at computed offsets of a file on shared storage.  No section
passes through the driver.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.plans.prefix import running_sum
from quadrille.plans.staging import width


class FormatError(RuntimeError):
    pass


class Cursor:
    """Sequential header reader that checks every count against the bytes left."""

    def __init__(self, path: str) -> None:
        try:
            self.file = open(path, "rb")
        except OSError as e:
            raise FormatError(f"cannot open {path}: {e.strerror}") from None
        self.path = path
        self.size = os.fstat(self.file.fileno()).st_size

    @property
    def at(self) -> int:
        return self.file.tell()

    @property
    def left(self) -> int:
        return max(self.size - self.at, 0)

    def take(self, fmt: str) -> tuple:
        n = struct.calcsize("<" + fmt)
        if n > self.left:
            raise FormatError(f"{self.path} is truncated")
        return struct.unpack("<" + fmt, self.file.read(n))

    def text(self, n: int) -> str:
        if n > self.left:
            raise FormatError(f"{self.path} is truncated or its counts are corrupt")
        return self.file.read(n).decode("utf-8", "surrogateescape")

    def section(self, count: int, item: int) -> int:
        """Skip ``count`` items of ``item`` bytes and return where they start."""
        if count > self.left // item:
            raise FormatError(f"{self.path} is truncated or its counts are corrupt")
        start = self.at
        self.file.seek(count * item, os.SEEK_CUR)
        return start

    def close(self) -> None:
        self.file.close()

    def __enter__(self) -> Cursor:
        return self

    def __exit__(self, *exc) -> None:
        self.close()


def read_array(path: str, offset: int, count: int, dtype: str) -> np.ndarray:
    return np.fromfile(path, dtype=dtype, count=count, offset=offset)


def slices(total: int, size: int = 1 << 20) -> list[tuple[int, int]]:
    return [(a, min(a + size, total)) for a in range(0, total, size)] or [(0, 0)]


def create(path: str, header: bytes, size: int) -> None:
    """A file of its final size with ``header`` in place."""
    try:
        with open(path, "wb") as f:
            f.write(header)
            f.truncate(size)
    except OSError as e:
        raise FormatError(f"cannot open {path} for writing: {e.strerror}") from None


def write_rows(df: DataFrame, path: str, position: str, sections: list[tuple[int, str, str]]) -> int:
    """Write columns at ``base + position * width`` for ``(base, column, dtype)`` sections.

    Tasks write runs of consecutive positions; writing again after a retry puts
    the same bytes in the same place.
    """
    columns = [c for _, c, _ in sections]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        written = 0
        fd = os.open(path, os.O_WRONLY)
        try:
            for b in batches:
                b = b.sort_values(position)
                where = b[position].to_numpy(np.int64)
                cuts = np.flatnonzero(np.diff(where) != 1) + 1
                for base, column, dtype in sections:
                    data = b[column].to_numpy().astype(dtype)
                    start = 0
                    for stop in [*cuts, len(data)]:
                        if stop > start:
                            os.pwrite(fd, data[start:stop].tobytes(),
                                      base + int(where[start]) * data.dtype.itemsize)
                        start = stop
                written += len(b)
        finally:
            os.close(fd)
        yield pd.DataFrame({"n": [written]})

    rows = df.select(position, *columns).repartitionByRange(width(df.sparkSession), position) \
        .sortWithinPartitions(position)
    return rows.mapInPandas(run, "n bigint").agg(F.sum("n")).first()[0] or 0


def write_ragged(df: DataFrame, path: str, sections: list[tuple[int, str, str, str]]) -> None:
    """Write array columns for ``(base, start, column, dtype)``: ``start`` counts items before the row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fd = os.open(path, os.O_WRONLY)
        try:
            for b in batches:
                for base, start, column, dtype in sections:
                    item = np.dtype(dtype).itemsize
                    lengths = b[column].map(len).to_numpy()
                    starts = b[start].to_numpy(np.int64)
                    ends = starts + lengths
                    cuts = [*(np.flatnonzero(starts[1:] != ends[:-1]) + 1), len(b)]
                    first = 0
                    for stop in cuts:
                        if stop > first:
                            data = np.concatenate([np.asarray(v, dtype=dtype)
                                                   for v in b[column].iloc[first:stop]])
                            os.pwrite(fd, data.tobytes(), base + int(starts[first]) * item)
                        first = stop
        finally:
            os.close(fd)
        yield pd.DataFrame({"n": [0]})

    names = list(dict.fromkeys(c for _, s, c, _ in sections for c in (s, c)))
    key = sections[0][1]
    rows = df.select(*names).repartitionByRange(width(df.sparkSession), key).sortWithinPartitions(key)
    rows.mapInPandas(run, "n bigint").agg(F.sum("n")).first()


def write_lines(lines: DataFrame, keys: list[str], path: str, header: str = "", footer: str = "") -> None:
    """Write the ``line`` column in the order of ``keys``, one per line, as one text file."""
    sized = lines.withColumn("bytes", F.octet_length("line").cast("bigint") + 1)
    placed = running_sum(sized, keys, "bytes", "offset", exclusive=True)
    total = placed.agg(F.max(F.col("offset") + F.col("bytes"))).first()[0] or 0
    head, foot = header.encode(), footer.encode()
    create(path, head, len(head) + total)
    base = len(head)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fd = os.open(path, os.O_WRONLY)
        try:
            for b in batches:
                start, buffer, end = None, [], None
                for offset, line in zip(b["offset"], b["line"]):
                    data = (line + "\n").encode()
                    if end is not None and offset != end:
                        os.pwrite(fd, b"".join(buffer), base + start)
                        buffer, start = [], None
                    start = int(offset) if start is None else start
                    buffer.append(data)
                    end = int(offset) + len(data)
                if buffer:
                    os.pwrite(fd, b"".join(buffer), base + start)
        finally:
            os.close(fd)
        yield pd.DataFrame({"n": [0]})

    placed.select("offset", "line").mapInPandas(run, "n bigint").agg(F.sum("n")).first()
    with open(path, "ab") as f:
        f.write(foot)
