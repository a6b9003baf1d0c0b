"""Session and table helpers shared by queries, tests and the benchmark."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, memory: str = "16g") -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("ferrywake")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import this package wherever the driver was started; on a cluster it is shipped with the job."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    ensure_importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the session names; only a session without one (tests) gets a local folder."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = context.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import atexit
        import shutil
        import tempfile

        own = tempfile.mkdtemp(prefix=f"ferrywake-{os.getpid()}-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        named = "file://" + own
    context.setCheckpointDir(named)


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors share, below the one that spark.checkpoint.dir names."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def materialize(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage, survives the loss of executors."""
    import uuid

    spark = df.sparkSession
    path = f"{shared_folder(spark)}/ferrywake-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for t in tables:
        for f in {name.rsplit("/", 1)[0] for name in t.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
