"""Session-level plumbing: reading tables, cutting lineage, shipping the package to executors."""

from __future__ import annotations

import atexit
import io
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_own_dirs: dict[str, str] = {}


def read_table(spark: SparkSession, directory: str, name: str, *columns: str) -> DataFrame:
    """The parquet table `name` of `directory`, narrowed to `columns` when given.

    The bibliographic reference list is stored as `doc_references`; it may be asked for as `references`.
    """
    name = "doc_references" if name == "references" else name
    frame = spark.read.parquet(f"{directory}/{name}.parquet")
    return frame.select(*columns) if columns else frame


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in spark.checkpoint.dir.

    Only where the setting is absent and the session is local (tests) a folder of our own is made.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _own_dirs[app] = tempfile.mkdtemp(prefix="folioscope-")
        atexit.register(shutil.rmtree, _own_dirs[app], True)
    return _own_dirs[app]


def durable(frame: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write `frame` once to the shared folder and read it back.

    Later steps reread the files instead of recomputing the plan, whichever executors are lost meanwhile.
    Columnar files are several times smaller than a checkpointed RDD, and readers still prune columns.
    """
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/folioscope/{label}-{uuid.uuid4().hex}"
    writer = frame.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable on executors, so that functions sent to them can be named by module."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, source.relative_to(root.parent))
    target = f"{shared_dir(spark)}/folioscope-{uuid.uuid4().hex}.zip"
    # through Spark's own file system, whatever the shared folder lies on
    place = spark._jvm.org.apache.hadoop.fs.Path(target)
    out = place.getFileSystem(context._jsc.hadoopConfiguration()).create(place)
    out.write(packed.getvalue())
    out.close()
    context.addPyFile(target)
    _shipped.add(context.applicationId)
