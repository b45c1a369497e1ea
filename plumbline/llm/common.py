"""What several operators share: reading tables, cutting lineage, walking texts in bounded pieces."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parents[1]

#: Spaces of the word rules that name \x20 and \x09-\x0D, inside a character class.
BLANKS = r"\x20\x09-\x0D"

#: Bytes of one batch that goes to a Python worker, so that a worker's memory doesn't follow the texts' lengths.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")

_own_folder: list[str] = []
#: What each Spark context has been given, by its id: the package, and files by name.
_given: dict[str, set[str]] = {}


def own_folder() -> str:
    """A folder of this process on this machine, removed when it ends."""
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="plumbline-"))
        atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
    return _own_folder[0]


def package_zip() -> str:
    """This package as a zip file, named by its content."""
    sources = {str(f.relative_to(PACKAGE.parent)): f.read_bytes() for f in sorted(PACKAGE.rglob("*.py"))}
    digest = hashlib.sha256(repr(sources).encode()).hexdigest()[:16]
    path = Path(own_folder()) / f"{PACKAGE.name}-{digest}.zip"
    if not path.exists():
        with zipfile.ZipFile(path, "w") as z:
            for name, content in sources.items():
                z.writestr(name, content)
    return str(path)


def share_package(spark: SparkSession) -> None:
    """Sends this package to Python workers, wherever they run, and lets them read small batches.

    A batch size that the job has set itself stays.
    """
    context = spark.sparkContext
    given = _given.setdefault(context.applicationId, set())
    if "" not in given:
        given.add("")
        context.addPyFile(package_zip())
    name, size = BATCH_BYTES
    if not context.getConf().contains(name):
        spark.conf.set(name, size)


def share_file(spark: SparkSession, path: str) -> str:
    """Sends a file of the driver to every executor and returns the name by which shared_path finds it there."""
    name = Path(path).name
    given = _given.setdefault(spark.sparkContext.applicationId, set())
    if path not in given:
        given.add(path)
        spark.sparkContext.addFile(path)
    return name


def shared_path(name: str) -> str:
    """Where a task finds a file that share_file has sent."""
    return SparkFiles.get(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    share_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where it is unset, a local master gets a folder of its own; on a cluster that is an error, since no folder of one
    machine is seen by the others.
    """
    named = spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share: intermediate tables go there")
    return own_folder()


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a table in the shared folder: lineage ends there, and lost executors take nothing along."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Most bits of a key filter: what it broadcasts is 16 MB at most, however many keys there are.
FILTER_BITS = 1 << 27


def likely_among(rows: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """The rows whose key is in the one column of keys, and few others: what a join may then shuffle instead of all.

    Keys are hashed into a bitmap of 16 bits a key, so that at most one in 16 other rows stays; above FILTER_BITS more of
    them stay, none of the keys' own ever goes. A null key counts as one more key.
    """
    bits = 1 << 15
    n = keys.count()
    while bits < min(16 * n, FILTER_BITS):
        bits *= 2

    def place(of: Column) -> Column:
        return F.pmod(F.xxhash64(of), F.lit(bits))

    at = place(F.col(keys.columns[0]))
    maps = keys.select(F.bitmap_bucket_number(at).alias("_bucket"), F.bitmap_bit_position(at).alias("_bit")).groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    bit = F.bitmap_bit_position(place(key))
    byte = F.conv(F.hex(F.substring("_map", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    inside = byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (bit % 8 + 1).cast("int"))) != 0
    # A written table: the plan above it doesn't repeat the grouping, and its size is the bitmap's.
    maps = written(maps, "key-filter")
    return rows.join(F.broadcast(maps), F.bitmap_bucket_number(place(key)) == F.col("_bucket")).where(inside).select(*rows.columns)


def in_pieces(texts: list[str], chars: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters each, at least one text a range."""
    start, total = 0, 0
    for i, text in enumerate(texts):
        total += len(text)
        if total >= chars:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
