"""Session settings and the shared folder that cuts lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "gazetta", cores: str = "*", **conf: str) -> SparkSession:
    """A session with AQE and UTC. Partition counts are left to AQE unless given."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    return SparkSession.builder.appName(app).master(f"local[{cores}]").config(map=settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local session that names none gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    found = os.path.join(tempfile.gettempdir(), f"gazetta-shared-{os.getuid()}")
    spark.sparkContext.setCheckpointDir(found)
    return found


def stash_dir(spark: SparkSession) -> str:
    """Where this application keeps what it writes for itself; ``release`` deletes it."""
    return f"{shared_dir(spark)}/stash/{spark.sparkContext.applicationId}"


def stash(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage and survives lost executors: whoever needs the rows
    again reads the files. ``release`` deletes them.
    """
    spark = df.sparkSession
    path = f"{stash_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``df`` to be broadcast where it has ``most`` rows at most, which are counted first; beyond that a join shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once a row, through an array of one.

    Filters on an ordinary column are moved below it and repeat its
    expression, for each of their terms; on long expressions that costs time and outgrows generated code.
    """
    made = F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))
    return df.select(*[F.col(c) for c in df.columns if c not in columns], made)


def release(spark: SparkSession) -> None:
    """Delete what ``stash`` has written for this application."""
    path = spark._jvm.org.apache.hadoop.fs.Path(stash_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
