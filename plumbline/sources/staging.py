"""Where intermediate tables go, and how Python workers get this package."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parents[1]
#: Bytes of one batch that goes to a Python worker, where rows are packed blocks.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
#: How tables of packed blocks are written. A task reads a row group into memory at once, so its size is looked at after
#: every row, not every hundred, and is not compressed, since it would be the compressed size that is bounded.
GROUPS = {"compression": "none", "parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}
_own: list[str] = []
#: Contexts that have been given the package, by their id.
_given: set[str] = set()


def _own_folder() -> str:
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="plumbline-core-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def share_package(spark: SparkSession) -> None:
    """Sends this package to Python workers, wherever they run."""
    context = spark.sparkContext
    if context.applicationId in _given:
        return
    _given.add(context.applicationId)
    sources = {str(f.relative_to(PACKAGE.parent)): f.read_bytes() for f in sorted(PACKAGE.rglob("*.py"))}
    path = Path(_own_folder()) / f"{PACKAGE.name}-core-{hashlib.sha256(repr(sources).encode()).hexdigest()[:16]}.zip"
    if not path.exists():
        with zipfile.ZipFile(path, "w") as z:
            for name, content in sources.items():
                z.writestr(name, content)
    context.addPyFile(str(path))


def staged(df: DataFrame, name: str, packed: bool = False) -> DataFrame:
    """The same rows from a table that driver and executors share: lineage ends there, and lost executors take nothing along.

    The folder is spark.checkpoint.dir's. Where that is unset, a local master gets a folder of this process; on a
    cluster it is an error. packed: rows hold blocks of up to some megabytes.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share: intermediate tables go there")
        folder = _own_folder()
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.options(**(GROUPS if packed else {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
