"""Recordings in header and sample files: a metadata table first, samples only of the records that are still wanted.

read_headers (in tables) scans headers; with_signals adds samples to the rows of any table with a path column, one Arrow
batch map that opens just those files, wherever pyarrow can: local, HDFS or object stores. The same decoding backs a
data source named `wfdb`, whose partitions are folders. Its records are narrowed by an option, not by pushed filters:
Spark 4.1 keeps those of one scan for the next scan of the same table, which then lacks rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from plumbline.functions.filters import resampled
from plumbline.sources.staging import share_package
from plumbline.sources.tables import read_headers, usable_headers

#: Bits of a sample in the formats of sample files, and the value that stands for a missing one.
BITS = {"8": 8, "80": 8, "212": 12, "16": 16, "61": 16, "24": 24, "32": 32}
MISSING = {"80": -128, "212": -2048, "16": -32768, "61": -32768, "24": -(2**23), "32": -(2**31)}
#: Units a millivolt where a header gives none.
GAIN = 200.0


class Unreadable(ValueError):
    """A record whose files are absent, cut short or not understood."""


@dataclass(frozen=True)
class Lead:
    file: str
    format: str
    offset: int
    gain: float
    baseline: float
    first: int
    name: str


@dataclass(frozen=True)
class Header:
    fs: float
    samples: int
    leads: list[Lead]


def parsed(text: str) -> Header:
    """A header's record line and signal lines; comments are not looked at."""
    lines = [x.strip() for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")]
    try:
        top = lines[0].split()
        if "/" in top[0]:
            raise Unreadable("records of several segments aren't read")
        fs = float(re.match(r"[0-9.]+", top[2]).group()) if len(top) > 2 else 250.0
        samples = int(top[3]) if len(top) > 3 else 0
        leads = []
        for line in lines[1 : 1 + int(top[1])]:
            part = line.split(maxsplit=8)
            kind = re.fullmatch(r"(\d+)(?:x1)?(?::\d+)?(?:\+(\d+))?", part[1])
            gain = re.match(r"([-+0-9.eE]+)?(?:\(([-+0-9]+)\))?", part[2] if len(part) > 2 else "")
            zero = float(part[4]) if len(part) > 4 else 0.0
            leads.append(Lead(part[0], kind.group(1), int(kind.group(2) or 0), float(gain.group(1) or 0) or GAIN, float(gain.group(2)) if gain.group(2) else zero, int(part[5]) if len(part) > 5 else 0, part[8] if len(part) > 8 else ""))
    except (IndexError, AttributeError, ValueError) as e:
        raise Unreadable(f"not a header: {e}") from e
    if len(leads) != int(top[1]) or not leads or any(x.format not in BITS for x in leads):
        raise Unreadable("signal lines are missing or have a format that isn't read")
    return Header(fs, samples, leads)


def whole_numbers(raw: bytes, kind: str) -> np.ndarray:
    """The samples of one file as integers."""
    if kind == "212":
        b = np.frombuffer(raw[: len(raw) // 3 * 3], np.uint8).astype(np.int32).reshape(-1, 3)
        two = np.column_stack([b[:, 0] | (b[:, 1] & 0x0F) << 8, b[:, 2] | (b[:, 1] & 0xF0) << 4]).ravel()
        return np.where(two >= 2048, two - 4096, two)
    if kind == "24":
        b = np.frombuffer(raw[: len(raw) // 3 * 3], np.uint8).astype(np.int32).reshape(-1, 3)
        three = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
        return np.where(three >= 2**23, three - 2**24, three)
    if kind == "80":
        return np.frombuffer(raw, np.uint8).astype(np.int32) - 128
    width = BITS[kind] // 8
    return np.frombuffer(raw[: len(raw) // width * width], {"8": "i1", "16": "<i2", "61": ">i2", "32": "<i4"}[kind]).astype(np.int64)


def decoded(header: Header, read: Callable[[str], bytes]) -> np.ndarray:
    """Leads by samples in physical units; missing samples are NaN. read: a file's bytes by its name."""
    rows: list[np.ndarray | None] = [None] * len(header.leads)
    for file in dict.fromkeys(x.file for x in header.leads):
        own = [i for i, x in enumerate(header.leads) if x.file == file]
        first = header.leads[own[0]]
        flat = whole_numbers(read(file)[first.offset :], first.format)
        n = header.samples or len(flat) // len(own)
        if len(flat) < n * len(own):
            raise Unreadable(f"{file} is cut short")
        table = flat[: n * len(own)].reshape(n, len(own)).T
        for i, x in zip(own, table, strict=True):
            lead = header.leads[i]
            # Differences, from the first value on.
            x = np.cumsum(x) + lead.first if lead.format == "8" else x
            values = (x - lead.baseline) / lead.gain
            rows[i] = np.where(x == MISSING[lead.format], np.nan, values) if lead.format in MISSING else values
    return np.vstack(rows)


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path) if re.match(r"\w+:/", path) else f"file://{path}")


def opened(path: str) -> bytes:
    system, at = located(path)
    with system.open_input_stream(at) as f:
        return f.read()


def signal_of(path: str, leads: int | None, rate: float | None, fill: float | None) -> tuple[np.ndarray, float]:
    """Leads by samples of the record whose files begin with path, and their rate."""
    try:
        header = parsed(opened(f"{path}.hea").decode("latin-1"))
        folder = path.rsplit("/", 1)[0]
        x = decoded(header, lambda name: opened(f"{folder}/{name}"))
    except OSError as e:
        raise Unreadable(str(e)) from e
    if leads is not None and len(x) != leads:
        raise Unreadable(f"{len(x)} leads instead of {leads}")
    if rate is not None and rate != header.fs:
        shared = math.gcd(round(rate), round(header.fs))
        # A filter spreads what is missing over its width, so missing samples are filled before it.
        x = np.vstack([resampled(np.nan_to_num(v, nan=fill or 0.0), round(rate) // shared, round(header.fs) // shared) for v in x])
    return (x if fill is None else np.nan_to_num(x, nan=fill)), rate or header.fs


def with_signals(df: DataFrame, path: str = "path", leads: int | None = 12, rate: float | None = None, fill: float | None = 0.0, fail: bool = False) -> DataFrame:
    """df with signal (leads by samples, floats), fs and problem.

    path: what the names of a record's files begin with. An unreadable record has a null signal and says why, or with
    fail ends the job. rate: resampled on reading, so that full-rate samples never leave the task. fill: what stands for
    missing samples (None: NaN).
    """
    share_package(df.sparkSession)
    source = df.withColumn("_path", F.col(path))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A few records at a time: one has megabytes of samples.
            for start in range(0, batch.num_rows, 16):
                own = batch.slice(start, 16)
                signals, rates, problems = [], [], []
                for at in own.column("_path").to_pylist():
                    try:
                        if at is None:
                            raise Unreadable("no path")
                        x, fs = signal_of(at, leads, rate, fill)
                        signals.append([v.astype(np.float32) for v in x])
                        rates.append(fs)
                        problems.append(None)
                    except Unreadable as e:
                        if fail:
                            raise ValueError(f"{at}: {e}") from e
                        signals.append(None)
                        rates.append(None)
                        problems.append(str(e))
                more = [pa.array(signals, pa.list_(pa.list_(pa.float32()))), pa.array(rates, pa.float64()), pa.array(problems, pa.string())]
                yield pa.RecordBatch.from_arrays([*[own.column(c) for c in kinds], *more], [*kinds, "signal", "fs", "problem"])

    schema = ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + ", signal array<array<float>>, fs double, problem string"
    return source.mapInArrow(run, schema)


def cohort_records(spark: SparkSession, folder: str, low: float = 18, high: float = 89, limit: int | None = None, rate: float | None = None, leads: int = 12) -> DataFrame:
    """Readable records of usable age and sex, the first in order of their paths if limited: record_id, path, age, sex, signal, fs.

    The limit holds for headers, before samples are read, so that it names the same records on every run.
    """
    chosen = usable_headers(read_headers(spark, folder), low, high)
    chosen = chosen.orderBy("path").limit(limit) if limit is not None else chosen
    return with_signals(chosen, "path", leads, rate).where("problem is null").drop("problem")


@dataclass
class Folder(InputPartition):
    """Headers directly in a folder, or anywhere below it."""

    path: str
    below: bool


class RecordReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.samples = options["path"].rstrip("/"), options.get("samples", "true").lower() == "true"
        self.leads, self.rate = (kind(options[n]) if n in options else None for n, kind in (("leads", int), ("rate", float)))
        self.fail, self.folders = options.get("fail", "false").lower() == "true", int(options.get("folders", 64))
        self.wanted = set(options["ids"].split(",")) if "ids" in options else None

    def partitions(self) -> list[Folder]:
        """Folders, level by level until there are enough: each is listed where it is read."""
        system, top = located(self.path)
        out, level = [], [top]
        while level and len(level) < self.folders:
            lower = [i.path for at in level for i in system.get_file_info(pafs.FileSelector(at)) if i.type == pafs.FileType.Directory]
            out += [Folder(at, False) for at in level]
            level = lower
        return out + [Folder(at, True) for at in level]

    def read(self, partition: Folder) -> Iterator[tuple]:
        system, _ = located(self.path)
        for info in sorted(system.get_file_info(pafs.FileSelector(partition.path, recursive=partition.below)), key=lambda i: i.path):
            name = info.base_name
            if info.type != pafs.FileType.File or not name.endswith(".hea") or (self.wanted is not None and name[:-4] not in self.wanted):
                continue
            path = info.path[:-4]
            try:
                if self.samples:
                    x, fs = signal_of(path, self.leads, self.rate, 0.0)
                    yield name[:-4], path, fs, len(x), [v.astype(np.float32).tolist() for v in x], None
                else:
                    header = parsed(opened(info.path).decode("latin-1"))
                    yield name[:-4], path, header.fs, len(header.leads), None
            except Unreadable as e:
                if self.fail:
                    raise ValueError(f"{path}: {e}") from e
                yield (name[:-4], path, None, None, None, str(e)) if self.samples else (name[:-4], path, None, None, str(e))


class Records(DataSource):
    """spark.read.format("wfdb").load(folder). Options: samples (false: headers only), ids, leads, rate, fail, folders."""

    @classmethod
    def name(cls) -> str:
        return "wfdb"

    def schema(self) -> str:
        signal = ", signal array<array<float>>" if self.options.get("samples", "true").lower() == "true" else ""
        return f"record_id string, path string, fs double, n_leads int{signal}, problem string"

    def reader(self, schema) -> RecordReader:
        return RecordReader(dict(self.options))


def register(spark: SparkSession) -> None:
    share_package(spark)
    spark.dataSource.register(Records)
