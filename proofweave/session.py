"""Session settings and the shared scratch folder.

Nothing here starts a cluster: :func:`build_session` is a convenience for tests, the bench and the
command line. Library code takes the session it is given.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark settings that every entry point of this repository uses.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session for tests and command lines; ``conf`` keys may use ``__`` for the dot."""
    builder = SparkSession.builder.master(master).appName("proofweave")
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only where the session names none (tests, local runs) a temporary folder of this machine is set,
    which is right there because driver and executors are one process.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    here = getattr(shared_dir, "local", None)
    if here is None or not os.path.isdir(here):
        here = shared_dir.local = tempfile.mkdtemp(prefix="proofweave-")
        atexit.register(_remove_local, here)
    return f"file://{here}"


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/proofweave/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    atexit.register(drop_path, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch path; a session that has ended leaves the clean-up to the folder's owner."""
    try:
        jvm = spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the JVM may be gone at interpreter exit
        pass


def shuffle_width(spark: SparkSession) -> int:
    """The session's shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers: if a worker finds it, as on an installed cluster,
    nothing is done; else the driver serves it to all executors as a zip. Asked once per context."""
    sc = spark.sparkContext
    if getattr(ship, "done", None) == sc.applicationId:
        return
    ship.done = sc.applicationId

    def found(_):
        import importlib.util

        return importlib.util.find_spec("proofweave") is not None

    found.__module__ = "__main__"  # so that it is pickled whole: the worker may not know this module
    if sc.parallelize([0], 1).map(found).collect()[0]:
        return
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    held = tempfile.mkdtemp(prefix="proofweave-zip-")
    atexit.register(_remove_local, held)
    shutil.copytree(os.path.join(root, "proofweave"), os.path.join(held, "src", "proofweave"), ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(os.path.join(held, "proofweave"), "zip", os.path.join(held, "src")))
