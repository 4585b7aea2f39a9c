"""bigWig files as a data source: the file's own index gives the partitions, and filters on chrom, start and end leave out its blocks.

    read_bigwig(spark, path).where("chrom = 'chr1' and start < 5000 and end > 1000")

The driver walks the index (a few dozen bytes for each block of about 512 values), tasks read and inflate their blocks. Paths are those of pyarrow's file systems:
local or shared folders, or stores such as hdfs:// where their libraries are there.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from genolith.sources.text import FormatError

#: Compressed bytes of a partition.
PART = 4 << 20
# fixed values of the format: magic numbers of the file, of its tree of names and of its index, and the kinds of sections
_FILE, _NAMES, _INDEX = 0x888FFC26, 0x78CA8C91, 0x2468ACE0
_BEDGRAPH, _VARIABLE, _FIXED = 1, 2, 3
SCHEMA = "chrom string, start bigint, end bigint, score double"


@dataclass
class Blocks(InputPartition):
    """Offsets and sizes of blocks in the file, in file order."""

    blocks: list[tuple[int, int]]


@dataclass
class Bounds:
    """What filters leave: names (all if none), and values with start < before and end > after."""

    chroms: set[str] | None = None
    before: float = float("inf")
    after: float = float("-inf")

    def add(self, f: Filter) -> None:
        column, value = f.attribute[0], getattr(f, "value", None)
        if column == "chrom" and isinstance(f, (EqualTo, In)):
            names = {value} if isinstance(f, EqualTo) else set(f.value)
            self.chroms = names if self.chroms is None else self.chroms & names
        elif column == "start" and isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
            self.before = min(self.before, value + (not isinstance(f, LessThan)))
        elif column == "end" and isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
            self.after = max(self.after, value - (not isinstance(f, GreaterThan)))


class _File:
    """Random access, with the byte order that the magic number shows."""

    def __init__(self, path: str):
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
        self.raw = system.open_input_file(at)
        head = self.read(0, 64)
        self.order = next((o for o in "<>" if len(head) == 64 and struct.unpack(f"{o}I", head[:4])[0] == _FILE), "")
        if not self.order:
            raise FormatError(f"{path} is no bigWig file")
        _, _, _, self.names_at, _, self.index_at, _, _, _, _, self.inflated, _ = struct.unpack(f"{self.order}IHHQQQHHQQIQ", head)

    def read(self, at: int, size: int) -> bytes:
        return bytes(self.raw.read_at(size, at))

    def take(self, form: str, at: int) -> tuple:
        form = self.order + form
        return struct.unpack(form, self.read(at, struct.calcsize(form)))

    def names(self) -> list[tuple[str, int, int]]:
        """Name, number and length of each chrom."""
        magic, _, key, _, _, _ = self.take("IIIIQQ", self.names_at)
        if magic != _NAMES:
            raise FormatError("the tree of names is damaged")
        out, todo = [], [self.names_at + 32]
        while todo:
            at = todo.pop()
            leaf, _, count = self.take("BBH", at)
            width = key + 8
            body = self.read(at + 4, count * width)
            for i in range(count):
                name, rest = body[i * width : i * width + key], body[i * width + key : (i + 1) * width]
                if leaf:
                    out.append((name.rstrip(b"\0").decode(), *struct.unpack(f"{self.order}II", rest)))
                else:
                    todo.append(struct.unpack(f"{self.order}Q", rest)[0])
        return out

    def blocks(self, wanted: set[int] | None, before: float, after: float) -> Iterator[tuple[int, int]]:
        """Offset and size of the blocks that may hold values of the wanted chroms with start < before and end > after; subtrees without any aren't read."""
        if self.take("I", self.index_at)[0] != _INDEX:
            raise FormatError("the index is damaged")
        todo = [self.index_at + 48]
        while todo:
            at = todo.pop()
            leaf, _, count = self.take("BBH", at)
            width, form = (32, "IIIIQQ") if leaf else (24, "IIIIQ")
            body = self.read(at + 4, count * width)
            for i in range(count):
                a, lo, b, hi, *place = struct.unpack_from(self.order + form, body, i * width)
                if wanted is not None and not any(a <= c <= b for c in wanted):
                    continue
                if a == b and (lo >= before or hi <= after):
                    continue
                if leaf:
                    yield place[0], place[1]
                else:
                    todo.append(place[0])

    def values(self, at: int, size: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """Chrom, starts, ends and values of one block."""
        data = self.read(at, size)
        data = zlib.decompress(data) if self.inflated else data
        chrom, start, _, step, span, kind, _, count = struct.unpack_from(f"{self.order}IIIIIBBH", data)
        o = self.order
        if kind == _BEDGRAPH:
            x = np.frombuffer(data, np.dtype([("s", f"{o}u4"), ("e", f"{o}u4"), ("v", f"{o}f4")]), count, 24)
            return chrom, x["s"].astype(np.int64), x["e"].astype(np.int64), x["v"].astype(float)
        if kind == _VARIABLE:
            x = np.frombuffer(data, np.dtype([("s", f"{o}u4"), ("v", f"{o}f4")]), count, 24)
            return chrom, x["s"].astype(np.int64), x["s"].astype(np.int64) + span, x["v"].astype(float)
        if kind == _FIXED:
            s = start + step * np.arange(count, dtype=np.int64)
            return chrom, s, s + span, np.frombuffer(data, f"{o}f4", count, 24).astype(float)
        raise FormatError(f"a section of kind {kind}")


class BigWigReader(DataSourceReader):
    def __init__(self, path: str, part: int):
        self.path, self.part, self.bounds = path, part, Bounds()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            self.bounds.add(f)
            yield f  # blocks are left out as wholes, so Spark looks at the rows again

    def partitions(self) -> list[Blocks]:
        file, b = _File(self.path), self.bounds
        wanted = None if b.chroms is None else {number for name, number, _ in file.names() if name in b.chroms}
        parts, size = [Blocks([])], 0
        for block in sorted(file.blocks(wanted, b.before, b.after)):
            if size >= self.part:
                parts.append(Blocks([]))
                size = 0
            parts[-1].blocks.append(block)
            size += block[1]
        return parts

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        file = _File(self.path)
        names = {number: name for name, number, _ in file.names()}
        for at, size in partition.blocks:
            chrom, s, e, v = file.values(at, size)
            yield pa.record_batch([pa.array([names[chrom]] * len(s)), pa.array(s), pa.array(e), pa.array(v)], ["chrom", "start", "end", "score"])


class BigWig(DataSource):
    """Options: path, partBytes (compressed bytes of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "bigwig"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BigWigReader:
        return BigWigReader(self.options["path"], int(self.options.get("partbytes", PART)))


def read_bigwig(spark: SparkSession, path: str, part: int = PART) -> DataFrame:
    """(chrom, start, end, score): the values of a bigWig file, as `read_bedgraph` gives those of a bedGraph file.

    Turns the session's setting for filters of Python sources on, which they need.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BigWig)
    return spark.read.format("bigwig").option("partBytes", part).load(path)
