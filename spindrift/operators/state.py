"""What a run keeps between sessions: the sampler's epochs and the best checkpoints."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators.sampling import epoch_sample
from spindrift.sources import atomic


class EpochSampler:
    """Epochs of ``sampling.epoch_sample`` whose state lies in a folder.

    Every epoch writes what it chose and each item's usage after it as tables, and its number last,
    by an atomic replace: an epoch that was cut off is drawn again, with the same rows.  Usage never
    comes to the driver.  ``schedule`` holds the quotas of each epoch; the last ones go on.  ``pool``
    has one row per source and item.
    """

    def __init__(self, pool: DataFrame, source: str, item: str, schedule: Sequence[Mapping[str, int]], seed: str, path: str, replay: bool = False):
        if not schedule:
            raise ValueError("a schedule of one epoch or more is needed")
        self.spark, self.path, self.seed = pool.sparkSession, path, seed
        self.pool, self.source, self.item = pool.select(source, item), source, item
        self.schedule = [dict(q) for q in schedule]
        self.epoch, self._replay = 0, False
        sizes = {r[0]: r[1] for r in self.pool.groupBy(source).count().collect()}  # a row a source
        self.frozen = {"sizes": sizes, "schedule": self.schedule, "seed": seed}
        if atomic.exists(self.spark, self._state):
            kept = atomic.read_json(self.spark, self._state)
            wrong = [k for k, v in json.loads(json.dumps(self.frozen)).items() if kept.get(k) != v]
            if wrong:
                raise ValueError(f"the state in {path} is of another sampler: {', '.join(wrong)} differ")
            self.epoch, self._replay = int(kept["epoch"]), replay and int(kept["epoch"]) > 0

    @property
    def _state(self) -> str:
        return f"{self.path}/state.json"

    def chosen(self, epoch: int) -> DataFrame:
        """The rows of an epoch drawn before, from 1."""
        return self.spark.read.parquet(f"{self.path}/epoch={epoch}/chosen")

    def usage(self) -> DataFrame:
        """(source, item, usage) after the epochs drawn."""
        if not self.epoch:
            return self.pool.withColumn("usage", F.lit(0).cast("long"))
        return self.spark.read.parquet(f"{self.path}/epoch={self.epoch}/usage")

    def draw(self) -> DataFrame:
        """The next epoch; after a restore with ``replay``, first the last one once more, as it was."""
        if self._replay:
            self._replay = False
            return self.chosen(self.epoch)
        new = self.epoch + 1
        quotas = self.schedule[min(self.epoch, len(self.schedule) - 1)]
        found = epoch_sample(self.usage(), self.source, self.item, "usage", quotas, f"{self.seed}:{new}")
        found.write.mode("overwrite").parquet(f"{self.path}/epoch={new}/chosen")
        taken = self.chosen(new).groupBy(self.source, self.item).agg(F.count("*").alias("_n"))
        after = self.usage().join(taken, [self.source, self.item], "left")
        after = after.select(self.source, self.item, (F.col("usage") + F.coalesce("_n", F.lit(0))).alias("usage"))
        after.write.mode("overwrite").parquet(f"{self.path}/epoch={new}/usage")
        atomic.replace_json(self.spark, self._state, self.frozen | {"epoch": new})
        self.epoch = new
        return self.chosen(new)


class BestCheckpoints:
    """The ``k`` best checkpoints by a metric, in a manifest that a resumed run takes up.

    Equal metrics prefer the earlier step.  ``resume`` needs a manifest of the same metric, direction
    and ``k``, with finite metrics and different steps; anything else is a ValueError.
    """

    def __init__(self, spark: SparkSession, path: str, metric: str, k: int, greater_is_better: bool = True, resume: bool = False):
        if k < 1:
            raise ValueError("k must be 1 or more")
        self.spark, self.path = spark, path
        self.frozen = {"metric_name": metric, "greater_is_better": greater_is_better, "top_k": k}
        self.records: list[dict] = self._restored() if resume else []

    def _restored(self) -> list[dict]:
        try:
            kept = atomic.read_json(self.spark, self.path)
        except json.JSONDecodeError as e:
            raise ValueError(f"{self.path} holds no manifest: {e}") from e
        records = kept.get("best_records") if isinstance(kept, dict) else None
        if not isinstance(records, list):
            raise ValueError("best_records must be a list")
        differ = {k: (kept.get(k), v) for k, v in self.frozen.items() if kept.get(k) != v}
        if differ:
            raise ValueError(f"the manifest is of other settings: {differ}")
        try:
            out = [{"metric": float(r["metric"]), "step": int(r["step"]), "path": str(r["path"])} for r in records]
        except (KeyError, TypeError, ValueError) as e:
            raise ValueError(f"a record of {self.path} isn't whole: {e!r}") from e
        if not all(math.isfinite(r["metric"]) for r in out):
            raise ValueError("a recorded metric isn't finite")
        if len({r["step"] for r in out}) < len(out):
            raise ValueError("a step is recorded twice")
        if len(out) > self.frozen["top_k"]:
            raise ValueError(f"{len(out)} records, more than {self.frozen['top_k']}")
        return self._ordered(out)

    def _ordered(self, records: list[dict]) -> list[dict]:
        sign = -1 if self.frozen["greater_is_better"] else 1
        return sorted(records, key=lambda r: (sign * r["metric"], r["step"]))

    def offer(self, step: int, metric: float, path: str) -> list[dict]:
        """Take a checkpoint in if it is among the best; the records that fell out (the new one, too,
        if it isn't) are returned, for their files to be removed.  A step offered again replaces its
        record; a metric that isn't finite falls out."""
        new = {"metric": float(metric), "step": int(step), "path": path}
        old = [r for r in self.records if r["step"] != step]
        ranked = self._ordered([*old, new]) if math.isfinite(new["metric"]) else [*self.records, new]
        k = self.frozen["top_k"]
        if math.isfinite(new["metric"]):
            self.records, out = ranked[:k], ranked[k:]
        else:
            out = [new]
        atomic.replace_json(self.spark, self.path, self.frozen | {"best_records": self.records})
        return out
