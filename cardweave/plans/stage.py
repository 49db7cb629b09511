"""Cut a plan: write a table where driver and executors can both read it, and delete it when it is of no more use."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: What is written inside each open ``passing`` block.
_OPEN: list[list[DataFrame]] = []
#: Folders of sessions in one process that name none, by application.
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, a session in one process (``local[...]``, as in tests) gets a
    folder of its own. On a cluster that would be another folder on each machine,
    so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = _OWN.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        _OWN[spark.sparkContext.applicationId] = root
    return root.rstrip("/")


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"


def stage(df: DataFrame, *partition_by: str, outlive: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends here.

    What several later steps use is worked out once, survives lost executors, and
    is a short plan to them. ``outlive``: it stays after the ``passing`` block, up to the end of the block around that, if there is one.
    """
    path = new_folder(df.sparkSession)
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stage_path = path
    blocks = _OPEN[: len(_OPEN) - outlive]
    if blocks:
        blocks[-1].append(out)
    return out


def drop_stage(*tables: DataFrame) -> None:
    """Delete what ``stage`` wrote, once nothing reads it any more."""
    for df in tables:
        path = getattr(df, "_stage_path", None)
        if path:
            jvm = df.sparkSession._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def passing() -> Iterator[None]:
    """What is staged inside is deleted at the end of the block; results are staged to outlive it, or written elsewhere by then."""
    _OPEN.append([])
    try:
        yield
    finally:
        drop_stage(*_OPEN.pop())
