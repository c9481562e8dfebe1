"""Session helpers: builder with the engine's defaults, shared scratch folder, lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANKS = " \t\n\r\x0b\x0c"
CHECKPOINT_DIR = "spark.checkpoint.dir"
_own_dirs: dict[str, str] = {}


def build_session(app: str = "noetia", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with UTC, AQE and skew handling on; master and partition count only where given."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; on a cluster the setting is required, as a
    machine-local folder would not be seen by other executors.
    """
    own = spark.conf.get(CHECKPOINT_DIR, None)
    if own:
        return own.rstrip("/")
    sc = spark.sparkContext
    if (was := sc.getCheckpointDir()) is not None:
        return was.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
    if sc.applicationId not in _own_dirs:
        _own_dirs[sc.applicationId] = tempfile.mkdtemp(prefix="noetia-")
    return _own_dirs[sc.applicationId]


_scratch: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder for intermediate tables, within the shared folder; it is deleted when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        path = f"{shared_dir(spark)}/noetia-{app}-{uuid.uuid4().hex[:8]}"
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _scratch[app] = path
    return _scratch[app]


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows as a table into the shared folder and read them back.

    The files are columnar and survive the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._noetia_path = path
    return out


def cut_by(df: DataFrame, key: str, buckets: int | None = None) -> DataFrame:
    """As :func:`cut`, in buckets of a hash of ``key``: joins and aggregations on it read the rows where they lie.

    As many buckets as the session has shuffle partitions, if not given. Meant for tables that are read many times.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"noetia_{uuid.uuid4().hex}"
    path = f"{scratch_dir(spark)}/{name}"
    df.repartition(n, key).write.format("parquet").bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out._noetia_path, out._noetia_table = path, name
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`cut` or :func:`cut_by` that no plan reads any more."""
    path = getattr(df, "_noetia_path", None)
    if path is None:
        return
    if (name := getattr(df, "_noetia_table", None)) is not None:
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    jvm = df.sparkSession._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="noetia-ship-")) / "noetia_ship.zip"
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(to))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def norm_id(c: Column | str) -> Column:
    """An id in lower case without blanks around it; blank becomes null."""
    c = F.col(c) if isinstance(c, str) else c
    t = F.lower(F.btrim(c, F.lit(BLANKS)))
    return F.when(F.length(t) > 0, t)
