"""File sources and sinks: strict and lenient readers, alias resolution, artifact writers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Schema = StructType | str


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet with its columns pruned at the scan; filters on the result are pushed down."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_json_strict(spark: SparkSession, path: str, schema: Schema) -> DataFrame:
    """JSON lines; a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json_lenient(spark: SparkSession, path: str, schema: Schema) -> DataFrame:
    """JSON lines; malformed lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_csv(spark: SparkSession, path: str, schema: Schema) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_universe(spark: SparkSession, path: str, column: str) -> DataFrame:
    """Ordered distinct labels of a CSV column, trimmed and lower-cased, with their position."""
    raw = spark.read.option("header", True).csv(path).select(F.lower(F.trim(column)).alias("label"), F.monotonically_increasing_id().alias("pos"))
    return raw.where("label <> ''").groupBy("label").agg(F.min("pos").alias("pos"))


def empty(spark: SparkSession, schema: Schema) -> DataFrame:
    """No rows, with a schema."""
    return spark.createDataFrame([], schema)


def pick_alias(df: DataFrame, names: Sequence[str]) -> Column:
    """The first of several column names that exists, else null; nested names use dots."""
    for n in names:
        top, _, rest = n.partition(".")
        if top in df.columns and (not rest or rest in df.select(f"{top}.*").columns):
            return F.col(n)
    return F.lit(None).cast("string")


def first_present(df: DataFrame, names: Sequence[str]) -> Column:
    """The first value that isn't blank among the aliases that exist."""
    have = [n for n in names if n.partition(".")[0] in df.columns]
    return F.coalesce(*(F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in have), F.lit(""))


def resolve_split(splits: Mapping[str, DataFrame], candidates: Sequence[str]) -> DataFrame:
    """The split under the first candidate name that exists."""
    for c in candidates:
        if c in splits:
            return splits[c]
    raise KeyError(f"none of {list(candidates)} among {sorted(splits)}")


# The keys of a run manifest that hold ids, the most advanced first, and the stages
# of an incremental run with their other names.
SCOPE_KEYS = ("downstream_source_ids", "generation_completed_source_ids", "inserted_source_ids")
STAGES = ("fetch", "generation", "retrieval", "judge", "similarity", "faithfulness")
STAGE_NAMES = {"generate": "generation", "retrieve": "retrieval", "recommend": "similarity", "recommendation": "similarity"}


def scope_ids(payload: Mapping | Sequence, keys: Sequence[str] = SCOPE_KEYS) -> list[str]:
    """Ids of a list, or of a run manifest by key priority (the first list that isn't empty):
    stripped, in order, once each.  A payload without any list is an error."""
    if isinstance(payload, Mapping):
        lists = [payload[k] for k in keys if k in payload]
        ids = next((x for x in lists if x), lists[0] if lists else None)
    else:
        ids = payload
    if not isinstance(ids, list | tuple):
        raise ValueError(f"a list of ids or a manifest with one of {list(keys)} is needed")
    return list(dict.fromkeys(t for t in (str(x or "").strip() for x in ids) if t))


def normalize_stages(value: str | Sequence[str]) -> list[str]:
    """Stages in their order from names, other names or ``all``; unknown or none is an error."""
    names = value.split(",") if isinstance(value, str) else value
    asked = {STAGE_NAMES.get(n, n) for n in (str(x).strip().lower() for x in names) if n}
    if not asked or asked - {*STAGES, "all"} and "all" not in asked:
        raise ValueError(f"stages must be among {list(STAGES)}, got {sorted(asked)}")
    return [x for x in STAGES if x in asked or "all" in asked]


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def write_shards(df: DataFrame, path: str, rows_per_file: int = 200_000, mode: str = "overwrite") -> None:
    """Parquet shards of bounded row counts; Spark's commit protocol makes the replace atomic."""
    df.write.mode(mode).option("maxRecordsPerFile", rows_per_file).option("compression", "zstd").parquet(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with nested columns as JSON text."""
    nested = {f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "struct", "map")}
    flat = df.select(*(F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns))
    flat.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def cache_covers(cached: DataFrame, wanted: DataFrame, key: str) -> bool:
    """Whether a cache holds every wanted key (a superset may serve a subset)."""
    return wanted.join(cached.select(key), key, "left_anti").isEmpty()


def cache_action(cached: DataFrame | None, fresh: DataFrame, key: str) -> str:
    """write (no cache), skip (cache covers), upgrade (fresh covers the cache), or skip."""
    if cached is None:
        return "write"
    if cache_covers(cached, fresh, key):
        return "skip"
    return "upgrade" if cache_covers(fresh, cached, key) else "skip"


def gather(cached: DataFrame, wanted: DataFrame, key: str, position: str) -> DataFrame:
    """Cached rows for the wanted keys, in the wanted order."""
    return wanted.select(key, position).join(cached, key).orderBy(position)
