"""Session helpers: table access and intermediate tables in the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings for a session of our own (tests, bench). A given session keeps its own settings.
LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cores: int = 8, memory: str = "8g", partitions: int | None = None, **extra: str) -> SparkSession:
    """A local session for tests and the bench."""
    conf = LOCAL_CONF | {
        "spark.master": f"local[{cores}]",
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": str(partitions or cores),
    }
    spark = SparkSession.builder.config(map=conf | extra).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the Python workers of a session this package, once, wherever they run."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    package = Path(__file__).parent
    folder = tempfile.mkdtemp(prefix="photoloom-code-")
    atexit.register(shutil.rmtree, folder, True)
    archive = Path(folder) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One of the parquet tables of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is the one named by ``spark.checkpoint.dir``. Only where a session names none (tests, local runs)
    a temporary folder is made, and the session then keeps it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="photoloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class SharedFiles:
    """Folders and small files wherever Hadoop reaches them, seen from the driver."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        hadoop = self._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self._conf), hadoop

    def exists(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.exists(at)

    def folders(self, path: str) -> list[str]:
        """Names of the folders in a folder, sorted."""
        fs, at = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory())

    def text(self, path: str) -> str:
        fs, at = self._at(path)
        stream = fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()


_SCOPES: list[list[Workspace]] = []
_OPEN: list[Workspace] = []


@contextmanager
def intermediate_tables() -> Iterator[None]:
    """Deletes at its end what operators called inside it have written to the shared folder; read their results before.

    Without it those tables last as long as the application.
    """
    own: list[Workspace] = []
    _SCOPES.append(own)
    try:
        yield
    finally:
        _SCOPES.remove(own)
        for w in own:
            w.close()


class Workspace:
    """Intermediate tables of one operator call, written to the shared folder as parquet.

    Written tables cut the lineage and survive the loss of executors. They are deleted when the application ends, or with
    the innermost ``intermediate_tables`` around the call.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._folder = SharedFiles(spark)._at(self.root)
        _OPEN.append(self)
        if _SCOPES:
            _SCOPES[-1].append(self)

    def path(self, label: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{label}"

    def write(self, df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
        """Writes ``df`` and returns the table read back."""
        path = self.path(label)
        df.write.parquet(path, partitionBy=partition_by)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that ``write`` returned, once nothing reads it any more."""
        for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            self._delete(file)

    def close(self) -> None:
        fs, at = self._folder
        fs.delete(at, True)
        if self in _OPEN:
            _OPEN.remove(self)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def _close_all() -> None:
    """Spark's process outlives the last session until Python has ended."""
    for w in list(_OPEN):
        try:
            w.close()
        except Exception:  # noqa: BLE001 - the process may be gone
            return
