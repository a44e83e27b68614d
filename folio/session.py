"""Session helpers: local sessions for tests, and lineage cuts that survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, partitions: int = 8, memory: str = "6g") -> SparkSession:
    """A session for tests and benchmarks on one machine; clusters bring their own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("folio")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. ``spark.checkpoint.dir`` decides; a temporary folder is
    used only where that setting is absent and the session is local (tests)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="folio-checkpoint-")
    sc.setCheckpointDir(own)
    return sc.getCheckpointDir()


_written: list[tuple[SparkSession, str]] = []


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may be gone already; the folder is a scratch folder
        pass


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        _remove(spark, path)


class Scratch:
    """Tables written by one operator call; ``drop`` removes those that are no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_dir(self.spark).rstrip('/')}/folio-{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        _written.append((self.spark, path))
        out = self.spark.read.schema(df.schema).parquet(path)
        out._folio_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_folio_path", None)
        if path:
            _remove(self.spark, path)
            _written[:] = [w for w in _written if w[1] != path]


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage without
    executor-local state, so a lost executor costs nothing that was written."""
    return Scratch(df.sparkSession).write(df, name)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application, so that Python workers can import it
    wherever they run."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="folio-ship-")  # on the driver, which serves it while it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / f"folio-{uuid.uuid4().hex[:8]}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)
