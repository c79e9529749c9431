"""Batch scoring of images by pluggable scorers, with tensor steps computed once for all that share them; replacement picks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: name -> (stage, step): a step takes and gives an array (rows, height, width, channels) and its parameters; stages may not go back.
STEPS: dict[str, tuple[int, Callable[..., np.ndarray]]] = {}


def step(name: str, stage: int):
    def add(f):
        STEPS[name] = stage, f
        return f

    return add


@step("pad_square", 0)
def pad_square(x: np.ndarray, value: float = 0.0) -> np.ndarray:
    """Rows and columns added evenly on both sides, the odd one at the end."""
    side = max(x.shape[1:3])
    by = [((side - n) // 2, side - n - (side - n) // 2) for n in x.shape[1:3]]
    return np.pad(x, ((0, 0), *by, (0, 0)), constant_values=value)


@step("scale", 1)
def scale(x: np.ndarray, divisor: float = 255.0) -> np.ndarray:
    return x / divisor


@step("channel_order", 2)
def channel_order(x: np.ndarray, order: tuple[int, ...] = (2, 1, 0)) -> np.ndarray:
    return x[..., list(order)]


@step("normalize", 3)
def normalize(x: np.ndarray, mean: float | tuple[float, ...] = 0.5, std: float | tuple[float, ...] = 0.5) -> np.ndarray:
    return (x - np.asarray(mean)) / np.asarray(std)


Plan = tuple[tuple[str, tuple[tuple[str, object], ...]], ...]


def plan(*steps: tuple[str, dict]) -> Plan:
    """Checked steps, in a form that can be compared."""
    for name, _ in steps:
        if name not in STEPS:
            raise ValueError(f"step {name} is not known")
    stages = [STEPS[name][0] for name, _ in steps]
    if stages != sorted(stages):
        raise ValueError("steps are out of order")
    return tuple((name, tuple(sorted(args.items()))) for name, args in steps)


def prepared(x: np.ndarray, plans: list[Plan]) -> dict[Plan, np.ndarray]:
    """The tensor of each plan; a beginning that plans share is computed once."""
    done: dict[Plan, np.ndarray] = {(): x}
    for p in plans:
        for k in range(1, len(p) + 1):
            if p[:k] not in done:
                name, args = p[k - 1]
                done[p[:k]] = STEPS[name][1](done[p[: k - 1]], **dict(args))
    return {p: done[p] for p in plans}


@dataclass(frozen=True)
class Scorer:
    """A model: ``load`` is called once in a task and gives a function from a full batch of tensors to (rows, outputs)."""

    name: str
    load: Callable[[], Callable[[np.ndarray], np.ndarray]]
    steps: Plan = ()
    batch: int = 16
    sigmoid: bool = False
    most_images: int = 0
    outputs: tuple[str, ...] = field(default=("score",))

    def run(self, model: Callable[[np.ndarray], np.ndarray], x: np.ndarray) -> np.ndarray:
        """Scores of any number of rows, in batches filled up with zeros to the fixed size."""
        parts = []
        for k in range(0, len(x), self.batch):
            part = x[k : k + self.batch]
            full = np.concatenate([part, np.zeros((self.batch - len(part), *x.shape[1:]), x.dtype)])
            parts.append(np.asarray(model(full))[: len(part)])
        out = np.concatenate(parts)
        return 1 / (1 + np.exp(-out)) if self.sigmoid else out


SCHEMA = "sample_id long, work_id long, backend string, output string, score double, error string"


def score(images: DataFrame, scorers: list[Scorer], shape: tuple[int, int, int]) -> DataFrame:
    """Rows of SCHEMA for (sample_id, work_id, ordinal, pixels), pixels being ``shape`` flattened.

    A scorer looks at a work's first ``most_images`` samples (0: all). Where it fails on a batch it is tried row by row,
    and a row on which it fails has a row with the error and no score; other rows and scorers are unaffected.
    """
    w = W.partitionBy("work_id").orderBy("ordinal", "sample_id")
    capped = any(s.most_images for s in scorers)
    rows = images.select("sample_id", "work_id", (F.row_number().over(w) if capped else F.lit(0)).alias("k"), "pixels")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = {s.name: s.load() for s in scorers}
        for b in batches:
            if not b.num_rows:
                continue
            ids, works, k = (b.column(c).to_numpy(zero_copy_only=False) for c in ("sample_id", "work_id", "k"))
            x = np.asarray(b.column("pixels").flatten()).astype(np.float64).reshape(-1, *shape)
            ready = prepared(x, [s.steps for s in scorers])
            for s in scorers:
                at = np.flatnonzero((k <= s.most_images) | (s.most_images == 0))
                if len(at):
                    out, errors = _scored(s, models[s.name], ready[s.steps][at])
                    yield _rows(s, ids[at], works[at], out, errors)

    return rows.mapInArrow(each, SCHEMA)


def _scored(s: Scorer, model, x: np.ndarray) -> tuple[np.ndarray, list[str | None]]:
    try:
        return s.run(model, x), [None] * len(x)
    except Exception:  # a model may fail in any way; what failed is found row by row and recorded
        out, errors = np.full((len(x), len(s.outputs)), np.nan), [None] * len(x)
        for i in range(len(x)):
            try:
                out[i] = s.run(model, x[i : i + 1])[0]
            except Exception as e:
                errors[i] = str(e)[:2000]
        return out, errors


def _rows(s: Scorer, ids: np.ndarray, works: np.ndarray, out: np.ndarray, errors: list[str | None]) -> pa.RecordBatch:
    n = len(s.outputs)
    failed = np.array([e is not None for e in errors])
    each = np.where(failed, 1, n)  # a failed row once, others once for each output
    row = np.repeat(np.arange(len(ids)), each)
    col = np.concatenate([np.arange(c) for c in each]) if len(each) else np.zeros(0, int)
    score_ = out[row, col].astype(np.float64)
    bad = failed[row]
    output = pa.array([None if b else s.outputs[c] for b, c in zip(bad, col)], pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[row]), pa.array(works[row]), pa.array([s.name] * len(row), pa.string()), output, pa.array(score_, mask=bad), pa.array([errors[r] for r in row], pa.string())],
        names=["sample_id", "work_id", "backend", "output", "score", "error"],
    )


def outcome(scored: DataFrame) -> DataFrame:
    """(work_id, backends, failed, verdict): a work is an error only if no backend scored any of its samples."""
    by = scored.groupBy("work_id").agg(F.countDistinct(F.when(F.col("score").isNotNull(), F.col("backend"))).alias("backends"), F.countDistinct(F.when(F.col("error").isNotNull(), F.col("backend"))).alias("failed"))
    return by.withColumn("verdict", F.when(F.col("backends") == 0, "error").when(F.col("failed") > 0, "partial").otherwise("ok"))


def replaced(picks: DataFrame, pages: DataFrame) -> DataFrame:
    """(work_id, ordinal, pick) after rejected picks are replaced, in order of picks.

    ``picks`` (work_id, pick, first, last) has the zone of each pick, ``pages`` (work_id, page, usable, first) all pages with
    the beginning of their zone; zones of a work lie apart. A pick that is not usable gives way to the next usable page of
    its zone that is no pick, else to the one before; without any it goes. A zone is one group, however large its work;
    picks are numbered by their place in the zone and the picks of the zones before, which are added up by zone.
    """

    zones = picks.groupBy("work_id", "first").agg(F.array_sort(F.collect_list(F.col("pick").cast("int"))).alias("picks"), F.max("last").alias("last"))  # of one zone
    able = pages.where("usable").groupBy("work_id", "first").agg(F.array_sort(F.collect_list(F.col("page").cast("int"))).alias("usable"))
    zones = zones.join(able, ["work_id", "first"], "left").withColumn("usable", F.coalesce(F.filter("usable", lambda q: q.between(F.col("first"), F.col("last"))), F.filter("picks", lambda q: F.lit(False))))

    def step(state: Column, pick: Column) -> Column:
        free = F.filter("usable", lambda q: ~F.array_contains(state["taken"], q))
        other = F.coalesce(F.array_min(F.filter(free, lambda q: q > pick)), F.array_max(F.filter(free, lambda q: q < pick)))
        got = F.when(F.array_contains("usable", pick), pick).otherwise(other)
        found = F.array_compact(F.array(got))
        return F.struct(F.concat(state["taken"], found).alias("taken"), F.concat(state["out"], found).alias("out"))

    start = F.struct(F.col("picks").alias("taken"), F.filter("picks", lambda q: F.lit(False)).alias("out"))
    rows = zones.select("work_id", "first", F.posexplode(F.array_sort(F.aggregate("picks", start, step, lambda state: state["out"]))).alias("place", "pick"))
    n = rows.groupBy("work_id", "first").agg(F.count("*").alias("n"))
    before = n.select("work_id", "first", (F.sum("n").over(W.partitionBy("work_id").orderBy("first")) - F.col("n")).alias("before"))
    return rows.join(before, ["work_id", "first"]).select("work_id", (F.col("before") + F.col("place")).cast("int").alias("ordinal"), "pick")
