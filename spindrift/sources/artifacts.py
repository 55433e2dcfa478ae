"""Cluster artifacts, sets of output files, ids seen before, and sources that come in pages."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from spindrift.sources import atomic, files

# The files and columns of cluster artifacts.
RECORD_COLUMNS = ("idx", "id", "text", "cluster_id", "sim_to_centroid", "dist_to_centroid", "rank_in_cluster")
SUMMARY_SCHEMA = "cluster_id long, size long"
ROWS_PER_FILE = 200_000

# The files of each set of outputs, and their formats.
RETRIEVAL_SET = {"summary_csv": "csv", "summary_json": "json", "packets_jsonl": "json", "evidence_csv": "csv", "chunks_csv": "csv"}
CURATION_SET = {"picked": "parquet", "summary": "json", "manifest_by_category": "json", "small_counter": "csv", "cluster_summary_by_category": "csv"}
EVALUATION_SET = {"metrics_long": "csv", "summary_vs_base": "csv", "runtime": "csv", "best_finetuned_by_full_valid_combo": "json", "predictions_minimal": "csv"}


def write_artifacts(records: DataFrame, centroids: DataFrame, path: str, config: Mapping | None = None) -> None:
    """Records (``RECORD_COLUMNS``), centroids (cluster_id, size, centroid) and the clusters by
    size, the largest first; ``meta.json`` comes last, so a folder that has it is whole.

    What other layouts hold as arrays are columns of the records.
    """
    missing = set(RECORD_COLUMNS) - set(records.columns)
    if missing:
        raise ValueError(f"records lack {sorted(missing)}")
    spark = records.sparkSession
    files.write_shards(records.select(*RECORD_COLUMNS), f"{path}/records", ROWS_PER_FILE)
    files.write_shards(centroids.select("cluster_id", "size", "centroid"), f"{path}/centroids", ROWS_PER_FILE)
    summary = spark.read.parquet(f"{path}/centroids").where("size > 0").select("cluster_id", "size")
    files.write_csv(summary.orderBy(F.col("size").desc(), "cluster_id"), f"{path}/cluster_summary.csv")
    n = spark.read.parquet(f"{path}/records").count()
    dim = spark.read.parquet(f"{path}/centroids").agg(F.max(F.size("centroid"))).first()[0] or 0
    atomic.replace_json(spark, f"{path}/meta.json", dict(config or {}) | {"N": n, "D": dim})


def read_artifacts(spark: SparkSession, path: str, columns: Sequence[str] = RECORD_COLUMNS) -> dict[str, DataFrame | dict | None]:
    """``records`` (only the columns asked are read; order them by idx where order matters),
    ``centroids`` and ``summary`` (None where absent) and ``meta``.

    Reads what ``write_artifacts`` wrote, and folders that hold ``records_*.parquet``,
    ``centroids.npy`` and ``cluster_summary.csv``.
    """
    own = atomic.exists(spark, f"{path}/records")
    records = spark.read.parquet(f"{path}/records" if own else f"{path}/records_*.parquet").select(*columns)
    centroids = None
    if atomic.exists(spark, f"{path}/centroids"):
        centroids = spark.read.parquet(f"{path}/centroids")
    elif atomic.exists(spark, f"{path}/centroids.npy"):
        centroids = read_array(spark, f"{path}/centroids.npy", "array<double>").select(F.col("idx").alias("cluster_id"), F.col("value").alias("centroid"))
    has = {x: atomic.exists(spark, f"{path}/{x}") for x in ("cluster_summary.csv", "meta.json")}
    return {
        "records": records, "centroids": centroids,
        "summary": files.read_csv(spark, f"{path}/cluster_summary.csv", SUMMARY_SCHEMA) if has["cluster_summary.csv"] else None,
        "meta": atomic.read_json(spark, f"{path}/meta.json") if has["meta.json"] else None,
    }


def membership_mismatches(records: DataFrame, membership: DataFrame) -> DataFrame:
    """(idx, cluster_id, value) where the records and an array of clusters (idx, value) differ, or
    only one of them has the row."""
    r = records.select(F.col("idx").cast("long").alias("idx"), F.col("cluster_id").cast("long").alias("cluster_id"))
    m = membership.select("idx", F.col("value").cast("long").alias("value"))
    return r.join(m, "idx", "full_outer").where(~F.col("cluster_id").eqNullSafe(F.col("value")))


def read_array(spark: SparkSession, path: str, kind: str = "double", member: str | None = None) -> DataFrame:
    """(idx, value) of a numpy file, or of one member of a set of them, in blocks of rows.

    ``kind`` is ``long`` or ``double``, or an array of them for two dimensions; an array of other
    dimensions is an error.  One task reads the file, which may have 2 GB at most; larger arrays
    belong in Parquet.
    """
    flat = kind.removeprefix("array<").removesuffix(">")
    nested, number = flat != kind, {"long": np.int64, "double": np.float64}[flat]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                array = np.load(io.BytesIO(content.as_buffer()), allow_pickle=False)
                array = array[member] if member else array
                if array.ndim != 1 + nested:
                    raise ValueError(f"{array.ndim} dimensions where {kind} has {1 + nested}")
                step = max(1, (1 << 20) // max(1, array.shape[-1] if nested else 1))
                for at in range(0, len(array), step):
                    part = np.ascontiguousarray(array[at : at + step], number)
                    value = pa.array(part.reshape(-1))
                    if nested:
                        value = pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * array.shape[1], value)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part))), value], ["idx", "value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(blocks, f"idx long, value {kind}")


def write_set(outputs: Mapping[str, DataFrame], formats: Mapping[str, str], path: str) -> None:
    """Every output of a set in its format, each whole or not there; the list of them comes last."""
    if set(outputs) != set(formats):
        raise ValueError(f"the set is {sorted(formats)}, got {sorted(outputs)}")
    writers = {"csv": files.write_csv, "json": files.write_json_lines, "parquet": files.write_shards}
    spark = next(iter(outputs.values())).sparkSession
    for name, df in outputs.items():
        writers[formats[name]](df, f"{path}/{name}")
    schemas = {name: df.schema.jsonValue() for name, df in outputs.items()}
    atomic.replace_json(spark, f"{path}/outputs.json", schemas)


def set_readable(spark: SparkSession, formats: Mapping[str, str], path: str) -> bool:
    """Whether every output of a set is there and reads: a malformed line, a missing file or a
    missing list of them is no.  An output without rows is readable."""
    if not atomic.exists(spark, f"{path}/outputs.json"):
        return False
    try:
        schemas = atomic.read_json(spark, f"{path}/outputs.json")
        for name, kind in formats.items():
            if name not in schemas or not atomic.exists(spark, f"{path}/{name}/_SUCCESS"):
                return False
            schema = StructType.fromJson(schemas[name])
            if kind == "csv":  # nested columns are JSON text there
                nested = ("array", "struct", "map")
                schema = StructType([f if f.dataType.typeName() not in nested else type(f)(f.name, StringType()) for f in schema.fields])
                rows = spark.read.schema(schema).options(header=True, multiLine=True, escape='"', mode="FAILFAST").csv(f"{path}/{name}")
            elif kind == "json":
                rows = files.read_json_strict(spark, f"{path}/{name}", schema)
            else:
                rows = spark.read.schema(schema).parquet(f"{path}/{name}")
            rows.write.format("noop").mode("overwrite").save()
    except (ValueError, PySparkException, Py4JJavaError):
        return False
    return True


def seen_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id) of ids seen before: a folder that ``add_seen`` filled, or a file with one JSON list.
    Nothing there is no ids."""
    if not atomic.exists(spark, path):
        return spark.createDataFrame([], "id string")
    if atomic.exists(spark, f"{path}/_SUCCESS"):
        return spark.read.schema("id string").parquet(path)
    one = spark.read.text(path, wholetext=True)
    return one.select(F.explode(F.from_json("value", "array<string>")).alias("id")).where("id IS NOT NULL").distinct()


def add_seen(ids: DataFrame, path: str) -> None:
    """Append the ids that aren't there yet, each once; only the new ones are written."""
    new = ids.select(F.col(ids.columns[0]).cast("string").alias("id")).where("id IS NOT NULL").distinct()
    new.join(seen_ids(ids.sparkSession, path), "id", "left_anti").write.mode("append").parquet(path)


Page = Callable[[int], tuple[Sequence[Mapping], int]]


def new_since_seen(
    spark: SparkSession, page: Page, seen: DataFrame, schema: StructType | str, limit: int = 200, key: str = "id", pause: Callable[[], None] = lambda: None
) -> DataFrame:
    """Rows of a paged source, newest first, up to the first one seen before, at most ``limit``.

    ``page(k)`` gives the rows of page k, from 1, and how many pages there are.  Rows without a key
    are passed over; ``pause`` is called between pages.  Each page's keys are looked up in the table
    of seen ids, which never comes to the driver; the driver holds ``limit`` rows at most and a page.
    """
    found: list[Mapping] = []
    number = 1
    while len(found) < limit:
        rows, pages = page(number)
        rows = [r for r in rows if r.get(key)]
        known = {r[0] for r in seen.where(F.col("id").isin([str(r[key]) for r in rows])).distinct().collect()} if rows else set()
        stop = next((k for k, r in enumerate(rows) if str(r[key]) in known), None)
        found += rows[:stop]
        if stop is not None or number >= pages or len(found) >= limit:
            break
        number += 1
        pause()
    names = StructType.fromDDL(schema).names if isinstance(schema, str) else schema.names
    return spark.createDataFrame([tuple(r.get(c) for c in names) for r in found[:limit]], schema)
