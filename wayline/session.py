"""Sessions and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(name: str, columns: list[str]) -> str:
    """name, with underscores put before it while a column (in any case of letters) has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path below spark.checkpoint.dir, which driver and executors share.

    Only a local master, where driver and executors are one process, gets a temporary folder if none is named; on a
    cluster that is an error, as its machines do not see each other's folders. The paths of one application share a
    parent, so that they can be removed together when it has ended.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir")
    if not root:
        found = context._jsc.sc().getCheckpointDir()
        if not found.isDefined():
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="wayline-"))
            found = context._jsc.sc().getCheckpointDir()
        root = found.get()
    return f"{root}/wayline-{context.applicationId}/{tag}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors, computed once."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session, where they could not import it by themselves."""
    root = Path(__file__).resolve().parents[1]
    found = {Path(p or ".").resolve() for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]}
    context = spark.sparkContext
    if root in found or getattr(context, "_wayline_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="wayline-")) / "wayline.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.glob("wayline/**/*.py")):
            z.write(p, p.relative_to(root))
    context.addPyFile(str(archive))
    context._wayline_shipped = True
