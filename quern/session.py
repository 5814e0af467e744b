"""Small helpers around the session: tables, lineage cuts, registries."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Make this package importable on every executor, wherever the driver found it; once per context.

    Batch functions are pickled by reference. The archive is handed to Spark, which serves it to
    executors that come later too.
    """
    context = spark.sparkContext
    if getattr(context, "_quern_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="quern-code-"), "quern.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for where, _, names in os.walk(home):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(where, name)
                out.write(full, os.path.relpath(full, os.path.dirname(home)))
    context.addPyFile(archive)
    context._quern_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the project's parquet tables."""
    ship(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    The folder is the cluster's ``spark.checkpoint.dir``. A session without one gets a folder of its own only
    if it runs in one process; on a cluster, where executors would each write to their own disk, it is refused. Spark removes what is no longer
    used if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if shared is None and not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="quern-checkpoint-"))
    return _plausible(df.checkpoint(eager=True))


def _plausible(df: DataFrame) -> DataFrame:
    """``df``, which is read from a checkpoint, without an estimate of its size that is beyond all storage.

    A checkpoint keeps the estimate of the plan that wrote it. That of a join is the product of both sides, so over rounds
    that each join the last its digits grow as a power of the rounds, until they fill the driver's memory.
    """
    session = df.sparkSession
    if df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 2**63:
        return df
    return DataFrame(session._jsparkSession.internalCreateDataFrame(df._jdf.queryExecution().toRdd(), df._jdf.schema(), False), session)


def evaluated(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are computed once, here.

    Chains of dependent expressions are otherwise merged and pushed into filters, where
    their size multiplies beyond what can be compiled; a generated row stops both.
    """
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def arrow_safe(text: str) -> str:
    """``text`` without lone surrogates, which Arrow cannot hold."""
    try:
        text.encode("utf-8")
        return text
    except UnicodeEncodeError:
        return text.encode("utf-8", "replace").decode("utf-8")
