"""Helpers shared by the operators: reading, shared-folder tables, bounded blocks, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_SHARED = "/tmp/tesserae-shared"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where that is unset, as in tests, one of this machine, for a local master alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and the executors share")
        found = DEFAULT_SHARED
    return f"{found.rstrip('/')}/tesserae-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, and a lost executor loses none of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def as_text(c: Column | str) -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def small(df: DataFrame, most_rows: int, weight: str | None = None, most_weight: int = 0) -> DataFrame:
    """``df`` (a written table) with a broadcast hint if it has at most ``most_rows`` rows and ``weight`` adds up to at most ``most_weight``, else as it is, to be shuffled."""
    found = df.agg(F.count("*").alias("n"), (F.sum(weight) if weight else F.lit(0)).alias("w")).first()
    return F.broadcast(df) if found.n <= most_rows and (found.w or 0) <= most_weight else df


class Hashes(dict):
    """The hash of each word, kept for some."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 400_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


_resident: dict[str, object] = {}


def resident(key: str, make: Callable[[], object]):
    """A worker's one large object, such as an encoder; making another drops it."""
    if key not in _resident:
        _resident.clear()
        _resident[key] = make()
    return _resident[key]


def release(keep: str = "") -> None:
    """Drop a worker's large object unless its key begins with ``keep``."""
    for key in [k for k in _resident if not keep or not k.startswith(keep)]:
        del _resident[key]


ROWS = 1024


def arrow_map(df: DataFrame, each: Callable[[pa.RecordBatch], Iterator[dict] | dict | None], schema: str, holds: str = "") -> DataFrame:
    """Map Arrow batches, some rows at a time, to dicts of columns; ``schema`` is DDL, ``holds`` begins the key of what :func:`resident` keeps."""

    def run(batches):
        target = None
        release(holds)
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            out = each(batch)
            for columns in [out] if isinstance(out, dict) else out or ():
                target = target or arrow_schema(schema)
                yield pa.RecordBatch.from_arrays([as_array(columns[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def filtered(docs: DataFrame, keep: Callable[[list[str]], list[bool]], text: str = "text", holds: str = "") -> DataFrame:
    """The rows of ``docs`` whose texts are to be kept; columns may have any names."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    at = docs.columns.index(text)

    def run(batches):
        release(holds)
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            yield batch.filter(pa.array(keep(texts(batch, names[at])), pa.bool_()))

    plain = docs.toDF(*names)
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def as_array(values, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, type=kind)


def arrow_schema(ddl: str) -> pa.Schema:
    """An Arrow schema for the flat DDL used in this subpackage."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}
    return pa.schema([pa.field(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [x or "" for x in batch.column(name).to_pylist()]


def grouped_batches(batches, keys: list[str], most: int = 200_000) -> Iterator[pa.Table]:
    """Re-cut the batches of a partition sorted by ``keys`` so that no group is divided between two tables.

    A table has few rows more than ``most`` unless one group alone has more; callers bound the groups.
    """
    import pyarrow.compute as pc

    held: list[pa.Table] = []
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not t.num_rows:
            continue
        last = t.slice(t.num_rows - 1)
        same = pa.array([True] * t.num_rows)
        for k in keys:
            value = last.column(k)[0]
            hit = pc.equal(t.column(k), value) if value.is_valid else pc.is_null(t.column(k))
            same = pc.and_(same, pc.fill_null(hit, False).combine_chunks() if isinstance(hit, pa.ChunkedArray) else hit)
        first = pc.index(same, True).as_py()
        if first == 0 and held and not _joins(held[-1], t, keys):
            yield pa.concat_tables(held)
            held = []
        if first:
            yield pa.concat_tables([*held, t.slice(0, first)])
            held = []
        held.append(t.slice(first))
    if held:
        yield pa.concat_tables(held)


def _joins(left: pa.Table, right: pa.Table, keys: list[str]) -> bool:
    return all(left.column(k)[left.num_rows - 1].as_py() == right.column(k)[0].as_py() for k in keys)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b) by random-priority contraction: rows (node, component).

    Each round every node picks, in its closed neighbourhood, the node of least priority, and the graph is
    contracted along the picks, so its edges become fewer until none is left; an expected logarithmic number of
    rounds. ``component`` names one member, not necessarily the smallest. Every round is a written table; joins on
    nodes are plain equi-joins, so a node of very many edges is divided by the skew join.
    """

    def priority(c: str, k: int) -> Column:
        return F.struct(F.xxhash64(F.lit(k), F.col(c)).alias("p"), F.col(c).alias("n"))

    e = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    picks: list[DataFrame] = []
    for k in range(rounds):
        if e.isEmpty():
            break
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pick = both.groupBy("a").agg(F.min(priority("b", k)).alias("m")).select(F.col("a").alias("node"), F.least(priority("a", k), F.col("m"))["n"].alias("to"))
        pick = written(pick, "picks")
        picks.append(pick)
        left = e.join(pick.select(F.col("node").alias("a"), F.col("to").alias("a2")), "a").select("a2", "b")
        both = left.join(pick.select(F.col("node").alias("b"), F.col("to").alias("b2")), "b").where("a2 <> b2")
        e = written(both.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "edges")
    else:
        if not e.isEmpty():
            raise RuntimeError(f"components: not contracted after {rounds} rounds")
    if not picks:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).where("false")
    out = picks[0].select("node", F.col("to").alias("component"))
    for pick in picks[1:]:
        step = pick.select(F.col("node").alias("component"), F.col("to"))
        out = out.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return written(out, "components")
