"""Structured Streaming jobs: re-derivation of affected works, evidence of the newest run, and the state of claims.

Each keeps a :class:`~tesserae.streaming.keyed.KeyedTable`, whose merges have effect once; however a stream is split into
batches, and in whatever order its rows come, the table ends as one batch of all rows would leave it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tesserae.streaming.keyed import KeyedTable

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _start(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, once: bool, mode: str = "append"):
    writer = stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def derive_incrementally(samples: DataFrame, derive: Callable[[DataFrame], DataFrame], table: KeyedTable, checkpoint: str, once: bool = True):
    """A query over a stream of samples: each batch derives its works anew by ``derive`` (ids) and replaces what ``table`` has of them."""

    def batch(rows: DataFrame, number: int) -> None:
        ids = rows.select("work_id").distinct()
        table.merge(number, derive(ids), ids)

    return _start(samples, batch, checkpoint, once)


def newest_run(rows: DataFrame) -> DataFrame:
    """Evidence of each work's greatest run alone."""
    top = rows.groupBy("work_id").agg(F.max("run_id").alias("run_id"))
    return rows.join(top, ["work_id", "run_id"], "left_semi")


def merge_runs(table: KeyedTable, rows: DataFrame, number: int) -> None:
    """Merge a batch of evidence into ``table``, rows of which are known by work, run and id.

    Against the greatest run that the table has of a work, rows of an older one are refused; those of the same run are
    added to it, a row that comes again replacing itself; a newer run replaces all that the work has.
    """
    new = newest_run(rows).dropDuplicates(["work_id", "id"])
    top = new.select("work_id", "run_id").distinct()
    held = table.of(top.select("work_id"))
    was = held.groupBy("work_id").agg(F.max("run_id").alias("held"))
    current = top.join(was, "work_id", "left").where(F.col("held").isNull() | (F.col("run_id") >= F.col("held"))).select("work_id", "run_id")
    accepted = new.join(current, ["work_id", "run_id"], "left_semi")
    stay = held.join(current, ["work_id", "run_id"], "left_semi").join(accepted.select("work_id", "id"), ["work_id", "id"], "left_anti")
    table.merge(number, accepted.unionByName(stay), current.select("work_id"))


def record_runs(samples: DataFrame, table: KeyedTable, checkpoint: str, once: bool = True):
    """A query over a stream of evidence (work_id, run_id, id, ...) that keeps each work's greatest run, whenever older ones come."""
    return _start(samples, lambda rows, number: merge_runs(table, rows, number), checkpoint, once)


class ClaimState(StatefulProcessor):
    """The claims of one (work, field).

    For each value the last event, by time and then id; for the field the last event that asserts a value. A value that
    is not the last asserted one of a single-valued field is not held, even if the last asserted one has been denied
    since: asserting it had removed the others.
    """

    def __init__(self, single: tuple[str, ...]):
        self.single = single

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.values = handle.getMapState("values", "value string", "at long, id long, negated boolean")
        self.last = handle.getValueState("asserted", "value string, at long, id long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        work, field = key
        newest: dict[str, tuple] = {}
        asserted = None
        for r in rows:
            event = (r["at"], r["id"])
            if r["value"] not in newest or event > newest[r["value"]][:2]:
                newest[r["value"]] = (*event, r["negated"])
            if not r["negated"] and (asserted is None or event > asserted[1:]):
                asserted = (r["value"], *event)
        changed = {}
        for value, (at, number, negated) in newest.items():
            was = self.values.getValue((value,))
            if was is None or (at, number) > (was[0], was[1]):
                self.values.updateValue((value,), (at, number, negated))
                changed[value] = (at, number, negated)
        if field in self.single:
            held = self.last.get()
            if held is not None and (asserted is None or (held[1], held[2]) > asserted[1:]):
                asserted = tuple(held)
            elif asserted is not None:
                self.last.update(asserted)
                if held is not None and held[0] not in changed:
                    changed[held[0]] = tuple(self.values.getValue((held[0],)))
        for value, (at, number, negated) in changed.items():
            holds = negated or field not in self.single or (value, at, number) == asserted
            yield Row(work_id=work, field=field, value=value, negated=negated, holds=holds)

    def close(self) -> None:
        pass


CLAIMS = "work_id long, field string, value string, negated boolean"


def fold_stream(claims: DataFrame, single: list[str], table: KeyedTable, checkpoint: str, once: bool = True):
    """A query over a stream of claims (id, work_id, field, value, negated, created_at) that keeps ``table`` (:data:`CLAIMS`, by work, field and value) at what holds now.

    The state is in RocksDB on the executors and in the checkpoint; a batch sends on the values whose state has changed.
    """
    spark = claims.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    at = F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(-(1 << 63)))  # a claim of no time is before all others
    states = claims.select("id", "work_id", "field", "value", "negated", at.alias("at")).groupBy("work_id", "field")
    changes = states.transformWithState(ClaimState(tuple(single)), f"{CLAIMS}, holds boolean", "Update", "None")

    def batch(rows: DataFrame, number: int) -> None:
        table.merge(number, rows.where("holds").drop("holds"), rows.select("work_id", "field", "value"))

    spark.conf.set(name, ROCKS)
    try:
        return _start(changes, batch, checkpoint, once, "update")
    finally:
        spark.conf.set(name, before)


def latest(rows: DataFrame) -> DataFrame:
    """The last event of each (work, field, value)."""
    w = W.partitionBy("work_id", "field", "value").orderBy(F.desc("created_at"), F.desc("id"))
    return rows.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")
