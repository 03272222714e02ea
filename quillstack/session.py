"""Sessions for local runs, and making the package importable on executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent


def local_session(cpus: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    os.environ["PYTHONPATH"] = os.pathsep.join(dict.fromkeys([str(ROOT), *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("quillstack")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; a temporary one where that is unset and all is local."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        place = tempfile.mkdtemp(prefix="quillstack-")
    return f"{place.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as written to a new shared folder and read again: its lineage ends there."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys to as many tasks as shuffles have: for work that is long for the size of its rows, as a small file is read by one
    task. The number is given, so that small partitions are not put together again."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def ship_package(spark: SparkSession) -> None:
    """Sends the package to executors that cannot import it: nothing to do where PYTHONPATH names its folder."""
    context = spark.sparkContext
    known = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT in known or any(str(f).endswith("quillstack.zip") for f in context.listFiles):
        return
    archive = Path(tempfile.mkdtemp(prefix="quillstack-")) / "quillstack.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in [*sorted((ROOT / "quillstack").rglob("*.py")), *ROOT.glob("corpus_pipeline.py")]:
            z.write(f, f.relative_to(ROOT))
    context.addPyFile(str(archive))
