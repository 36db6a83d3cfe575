"""A stack that grows batch by batch, without its frames being read again.

Each cell keeps count, mean, sum of squares off the mean, extremes, and a KLL sketch of its values. A batch is aggregated to the
same columns and merged with what is there, cell by cell: moments by the parallel update of mean and squares, sketches by
theirs. The new state goes to a folder of its own and counts from the moment that a manifest names it. Manifests are numbered, and each
number can be created once, so of two writers that start from the same version one fails, and a run that dies before its
manifest has changed nothing. The manifest also holds the last batch of every source; a batch that is not later than it is left
out, so a rerun (as of a stream's micro-batch) adds nothing twice.

Quantiles come from the sketch: exact up to about ``k`` values in a cell, beyond that with a rank that is off by about 2.3 / k ** 0.97 of the
values (1.33 % for 200, 0.68 % for 400) at 99 % confidence.

Scale: values are combined into sketches before the shuffle, so a group of a third of all frames is no hot key, and a cell's
state has a bounded size whatever the number of frames. Merging reads and writes the state once a batch: a row for each cell.

NaN and null values are no values. Rows with a null group or coordinate are a cell like others. Repeated rows count each time; an empty
batch changes nothing but the manifest; other columns play no part.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumeria.functions.columns import valued
from plumeria.functions.shared import _located, delete

CELL = ["group_id", "x", "y"]
KINDS = "group_id int, x int, y int, n long, mean double, m2 double, min double, max double, sketch binary"


class Conflict(RuntimeError):
    """Another writer has committed since this one read the manifest."""


def summary(px: DataFrame, k: int) -> DataFrame:
    """A row of KINDS for each cell."""
    v = F.col("v").cast("double")
    rows = valued(px).groupBy(*(F.col(c).cast("int").alias(c) for c in CELL)).agg(
        F.count("*").alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count("*")).alias("m2"), F.min(v).alias("min"), F.max(v).alias("max"), F.kll_sketch_agg_double(v, k).alias("sketch")
    )
    return rows.select(*(name.split()[0] for name in KINDS.split(", ")))


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two tables of KINDS, one row a cell, as one."""
    b = b.select(*(F.col(c).alias(f"b_{c}") for c in b.columns))
    both = a.join(b, [F.col(c).eqNullSafe(F.col(f"b_{c}")) for c in CELL], "full_outer")
    here, there = F.col("n").isNotNull(), F.col("b_n").isNotNull()
    n, m, apart = F.col("n"), F.col("b_n"), F.col("b_mean") - F.col("mean")
    either = lambda c, f: F.when(here & there, f).otherwise(F.coalesce(c, f"b_{c}")).alias(c)
    return both.select(
        *(F.when(here, F.col(c)).otherwise(F.col(f"b_{c}")).alias(c) for c in CELL),
        either("n", n + m), either("mean", F.col("mean") + apart * m / (n + m)), either("m2", F.col("m2") + F.col("b_m2") + apart * apart * n * m / (n + m)),
        either("min", F.least("min", "b_min")), either("max", F.greatest("max", "b_max")), either("sketch", F.kll_sketch_merge_double("sketch", "b_sketch")),
    )


class IncrementalStack:
    """The stack kept in a folder of a store that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, k: int = 400):
        self.spark, self.path, self.k = spark, path.rstrip("/"), k

    def _manifests(self) -> Iterator[tuple[int, dict | None]]:
        """(number, manifest) from the last on; None for one that was not written whole."""
        system, folder = _located(self.spark, f"{self.path}/manifests")
        if not system.exists(folder):
            return
        for name in sorted((f.getPath().getName() for f in system.listStatus(folder) if f.getPath().getName().isdigit()), reverse=True):
            text = "".join(r[0] for r in self.spark.read.text(f"{self.path}/manifests/{name}", wholetext=True).collect())
            try:
                yield int(name), json.loads(text)
            except ValueError:
                yield int(name), None

    def _current(self) -> tuple[int, dict]:
        """The highest number there is, and the last whole manifest."""
        highest = 0
        for number, manifest in self._manifests():
            highest = max(highest, number)
            if manifest is not None:
                return highest, manifest
        return highest, {"state": None, "before": None, "sources": {}}

    def _commit(self, number: int, manifest: dict) -> None:
        system, file = _located(self.spark, f"{self.path}/manifests/{number:012d}")
        try:
            out = system.create(file, False)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName() or system.exists(file):
                raise Conflict(f"version {number} was committed by another writer") from e
            raise
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()

    def _state(self, manifest: dict) -> DataFrame:
        return self.spark.read.schema(KINDS).parquet(f"{self.path}/{manifest['state']}") if manifest["state"] else self.spark.createDataFrame([], KINDS)

    def add(self, px: DataFrame, source: str, batch: int) -> bool:
        """Merges a batch of pixels; False if the source's batch, or a later one, is in already. Raises :class:`Conflict` if another writer was first."""
        number, manifest = self._current()
        if batch <= manifest["sources"].get(source, batch - 1):
            return False
        name = f"state-{uuid.uuid4().hex}"
        merged(self._state(manifest), summary(px, self.k)).write.parquet(f"{self.path}/{name}")
        try:
            self._commit(number + 1, {"state": name, "before": manifest["state"], "sources": manifest["sources"] | {source: batch}})
        except Conflict:
            delete(self.spark, [f"{self.path}/{name}"])
            raise
        if manifest["before"]:  # readers of the last version may still be at work, those of the one before not
            delete(self.spark, [f"{self.path}/{manifest['before']}"])
        return True

    def result(self, quantiles: tuple[float, ...] = (0.5,)) -> DataFrame:
        """(group_id, x, y, n, mean, stddev, min, max, q): q has the quantiles, each the least value with that share of the values up to it."""
        at = F.array(*(F.kll_sketch_get_quantile_double("sketch", F.lit(q)) for q in quantiles))
        return self._state(self._current()[1]).select(*CELL, "n", "mean", F.sqrt(F.greatest(F.lit(0.0), F.col("m2") / F.col("n"))).alias("stddev"), "min", "max", at.alias("q"))
