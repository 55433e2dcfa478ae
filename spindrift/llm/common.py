"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words where a contract says ``[^\x20\x09-\x0D]+``.
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, UPPER.lower())


def words_of(text: Column) -> Column:
    """The array of space-separated words; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """How many space-separated words a text has (null: 0), without building them."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Take the shared folder that the cluster names in ``spark.checkpoint.dir``.  Where it is
    unset, a local run gets a folder of its own and a cluster one in the shared warehouse."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        local = sc.master == "local" or sc.master.startswith("local[")
        shared = f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
        sc.setCheckpointDir(named or (tempfile.mkdtemp(prefix="spindrift-ckpt-") if local else shared))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there, with no lineage.  Shuffle
    files that nothing refers to any more are released then, not whenever the driver next collects
    its garbage: a loop of small rounds would pile them up on the executors' disks."""
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def forgetful(df: DataFrame) -> DataFrame:
    """A checkpointed table without the size that was guessed for it.  The guess for a join is the
    product of its sides, so in a loop of joins the number of its digits would double every round
    until planning takes longer than the work."""
    spark, jdf = df.sparkSession, df._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(jdf.queryExecution().toRdd(), jdf.schema(), False), spark)


def apart(df: DataFrame, key: str) -> DataFrame:
    """Deal an aggregate by another hash than its key's.  A join on the key then has a plain
    exchange on both sides, so that a hot key can be split at run time."""
    return df.repartition(F.xxhash64(F.lit(1), key))
