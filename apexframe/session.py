"""Session helpers: a tuned local session and shipping of the package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python tasks can import it anywhere."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="apexframe-")) / "apexframe.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which every executor can reach.

    Where a session names none, the context's checkpoint folder is used. On one machine (tests) a folder of our own is set
    there; on a cluster, where a local folder would be lost to the others, an error names the setting.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        known = context._jsc.sc().getCheckpointDir()
        if not known.isDefined():
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            context.setCheckpointDir(f"file:///tmp/apexframe-checkpoints-{os.getuid()}")
            known = context._jsc.sc().getCheckpointDir()
        base = known.get()
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/apexframe/{label}-{uuid.uuid4().hex}")
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toUri().toString()


def kept(df: DataFrame, label: str) -> DataFrame:
    """df written below the shared folder and read back: what is used many times is made once."""
    folder = shared_dir(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def local_session(cores: int = 8, memory: str = "12g", name: str = "apexframe") -> SparkSession:
    """A session on one machine, as tests and the benchmark use it."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
