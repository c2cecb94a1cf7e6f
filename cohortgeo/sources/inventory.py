"""File census and video headers."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import astuple, dataclass
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CACHE = ".cache"


class FileCensus(DataSource):
    """format("file_census").load(root): every file under a root with its size, hidden ones too (Spark's own sources skip those). A
    partition per entry of the root. The root must be a folder that executors see."""

    @classmethod
    def name(cls) -> str:
        return "file_census"

    def schema(self) -> str:
        return "path string, bytes long, cached boolean, partial boolean"

    def reader(self, schema) -> DataSourceReader:
        return _CensusReader(self.options["path"])


class _CensusReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(n) for n in sorted(os.listdir(self.root))] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        top = os.path.join(self.root, partition.value)
        found = [top] if os.path.isfile(top) else (os.path.join(d, f) for d, _, names in os.walk(top) for f in names)
        for path in found:
            relative = os.path.relpath(path, self.root)
            cached = CACHE in PurePosixPath(relative).parts
            yield relative, os.path.getsize(path), cached, cached and path.endswith((".lock", ".incomplete"))


def census(spark: SparkSession, root: str) -> DataFrame:
    """Files, bytes and partial files of the payload and of the cache."""
    spark.dataSource.register(FileCensus)
    return (
        spark.read.format("file_census").load(root).groupBy("cached").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.count_if("partial").alias("partials"))
    )


@dataclass(frozen=True)
class Probe:
    codec: str
    width: int
    height: int
    sample_count: int
    duration_seconds: float
    fps: float


def boxes(data: bytes, start: int, end: int) -> dict[str, list[tuple[int, int]]]:
    """Bodies of the MP4 boxes between two places, by type, in order. Size 1: the size is in 64 bits; size 0: to the end."""
    out: dict[str, list[tuple[int, int]]] = {}
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if start + 16 > end:
                raise ValueError("a 64-bit box size is cut off")
            (size,) = struct.unpack_from(">Q", data, start + 8)
            head = 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box at byte {start} has an impossible size")
        out.setdefault(kind.decode("latin-1"), []).append((start + head, start + size))
        start += size
    return out


def probe(data: bytes) -> Probe:
    """The first video track's codec, size, samples, seconds and frame rate; raises where there is none."""
    inside = lambda at: boxes(data, *at)
    top = boxes(data, 0, len(data))
    for track in map(inside, inside(top["moov"][0]).get("trak", [])) if "moov" in top else ():
        media = inside(track["mdia"][0]) if {"mdia", "tkhd"} <= track.keys() else {}
        if not {"hdlr", "mdhd", "minf"} <= media.keys() or data[media["hdlr"][0][0] + 8 :][:4] != b"vide":
            continue
        width, height = (v >> 16 for v in struct.unpack_from(">II", data, track["tkhd"][0][1] - 8))
        head = media["mdhd"][0][0]
        scale, ticks = struct.unpack_from(">IQ", data, head + 20) if data[head] == 1 else struct.unpack_from(">II", data, head + 12)
        info = inside(media["minf"][0])
        table = inside(info["stbl"][0]) if "stbl" in info else {}
        if "stsz" not in table:
            raise ValueError("the video track has no sample sizes")
        (count,) = struct.unpack_from(">I", data, table["stsz"][0][0] + 8)
        codec = data[table["stsd"][0][0] + 12 :][:4].decode("latin-1") if "stsd" in table else "unknown"
        seconds = ticks / scale if scale else 0.0
        return Probe(codec, width, height, count, seconds, count / seconds if seconds else 0.0)
    raise ValueError("no video track")


def probe_videos(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, probe columns, error) of video files; a file that can't be read has an error and no probe."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, data in zip(batch["path"], batch["content"]):
                try:
                    rows.append((path, *astuple(probe(bytes(data))), None))
                except (ValueError, struct.error, KeyError) as e:
                    rows.append((path, None, None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "codec", "width", "height", "sample_count", "duration_seconds", "fps", "error"])

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    schema = "path string, codec string, width int, height int, sample_count long, duration_seconds double, fps double, error string"
    return files.mapInPandas(run, schema)
