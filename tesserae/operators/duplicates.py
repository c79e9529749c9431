"""Exact copies, nearest neighbours and leader groups."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.operators.graph import components
from tesserae.sources.shared import store

BLOCK = 4096
#: Rows of a block that are multiplied at once, blocks of a table at most (they grow beyond it), pivots and the vectors they are chosen from.
TILE, MOST_BLOCKS = 256, 1 << 16
PIVOTS, SAMPLED = 64, 4096
#: Pairs of a component that one task takes one by one; a component of more is solved in rounds.
ONE_TASK = 500_000
#: Pairs that are listed of a vector at once, and rounds over them before what is left is taken by components.
LISTED, ROUNDS = 32, 12
#: Vectors that one task lists the pairs of, vectors of a block that is sent to it, and rows multiplied at once.
MOST_ASKED, SENT, STRIP = 1 << 15, 2048, 1024


def exact(items: DataFrame, library: DataFrame, key: str = "content_key") -> DataFrame:
    """Items whose content is in the library: (item, work)."""
    return items.select("item", key).join(library.select("work", key), key).select("item", "work")


def blocked(vectors: DataFrame, block: int = 1024) -> DataFrame:
    """(b, ids, mat): vectors packed in blocks of about ``block`` rows; the number of blocks follows the table."""
    n = vectors.count()
    parts = max(1, -(-n // block))
    rows = vectors.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    return rows.groupBy("b").agg(F.collect_list(F.struct("id", "vec")).alias("rows"))  # a block's own rows


class Pivots:
    """Vectors that all others are measured against: few, far from each other, from a sample of bounded size."""

    def __init__(self, vectors: DataFrame, number: int = PIVOTS, sampled: int = SAMPLED):
        rows = vectors.select("vec").orderBy(F.xxhash64("id"), "id").limit(sampled).toArrow()
        x = _units(rows.column("vec").combine_chunks()) if rows.num_rows else np.zeros((0, 1))
        chosen, far = [], np.full(len(x), np.inf)
        while len(chosen) < min(number, len(x)):
            k = int(far.argmax())
            if far[k] <= 1e-9:
                break  # what is left are copies
            chosen.append(k)
            far = np.minimum(far, _distances(x, x[[k]])[:, 0])
        self.at = x[chosen]


def _units(vec: pa.Array) -> np.ndarray:
    x = np.asarray(vec.flatten()).reshape(len(vec), -1).astype(np.float64)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(norm > 0, x / np.where(norm > 0, norm, 1), 0)


def _kind(vectors: DataFrame) -> str:
    """How the numbers of ``vec`` are packed: in four bytes if they have four."""
    return "<f4" if vectors.schema["vec"].dataType.elementType.simpleString() == "float" else "<f8"


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T))


def packed(vectors: DataFrame, pivots: Pivots, block: int, parts: int, given: bool = False) -> DataFrame:
    """(block, ids, mat, lo, hi): unit vectors in blocks of neighbours, dealt by the nearest pivot and the distance from it, with the least and greatest distance of each block's vectors from every pivot.

    ``given`` leaves the vectors as they are, of :func:`_kind`, in blocks that may lie about several pivots.
    """
    at = pivots.at
    element = vectors.schema["vec"].dataType.elementType.simpleString()
    kind = _kind(vectors)

    def measure(batches):
        for batch in batches:
            if batch.num_rows:
                d = _distances(_units(batch.column("vec")), at)
                near = d.argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vec"), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(near)), near])], names=["id", "vec", "cell", "d"])

    def pack(batches):
        from pyspark import TaskContext

        held, size, made, cell = [], 0, TaskContext.get().partitionId() << 20, None

        def out():
            t = pa.Table.from_batches(held)
            x = _units(t.column("vec").combine_chunks())
            d = _distances(x, at)
            mat = np.asarray(t.column("vec").combine_chunks().flatten()).astype(kind) if given else x.astype("<f8")
            columns = [[made], [t.column("id").to_numpy().astype("<i8").tobytes()], [mat.tobytes()], [d.min(0)], [d.max(0)]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64())))], names=["block", "ids", "mat", "lo", "hi"])

        for batch in batches:
            cells, k = batch.column("cell").to_numpy(), 0
            while k < batch.num_rows:
                if size and (size == block or not given and cells[k] != cell):  # a block lies about one pivot
                    yield out()
                    held, size, made = [], 0, made + 1
                cell = cells[k]
                part = batch.slice(k, min(block - size, len(cells) - k if given else int(np.searchsorted(cells, cell, "right")) - k))
                held.append(part)
                size, k = size + part.num_rows, k + part.num_rows
        if size:
            yield out()

    rows = vectors.select(F.col("id").cast("long").alias("id"), "vec").mapInArrow(measure, f"id long, vec array<{element}>, cell int, d double")
    dealt = rows.repartitionByRange(parts, "cell", "d", "id") if parts > 1 else rows.coalesce(1)
    return dealt.sortWithinPartitions("cell", "d", "id").mapInArrow(pack, "block long, ids binary, mat binary, lo array<double>, hi array<double>")


def meetings(blocks: DataFrame, least: float) -> DataFrame:
    """(block, other): the pairs of blocks, each with itself too, that may hold a pair of cosine ``least``.

    The distance of such a pair is sqrt(2 - 2 * least) at most, so by the triangle inequality the distances of its two
    vectors from a pivot differ by no more; blocks whose distances from some pivot are further apart never meet. The
    intervals of all blocks, at most :data:`MOST_BLOCKS` rows, are what every task compares a block with.
    """
    reach = np.sqrt(2 - 2 * least) + 1e-6 if least > 0 else np.inf
    every = blocks.select("block", "lo", "hi").orderBy("block").toArrow()
    names = every.column("block").to_numpy()
    lo, hi = (np.asarray(every.column(c).combine_chunks().flatten()).reshape(len(names), -1) for c in ("lo", "hi"))
    shared = blocks.sparkSession.sparkContext.broadcast((names, lo, hi))

    def meet(batches):
        names, lo, hi = shared.value
        for batch in batches:
            for b in batch.column("block").to_pylist():
                k = int(np.searchsorted(names, b))
                apart = np.maximum(lo[k:] - hi[k], lo[k] - hi[k:]).max(1, initial=-np.inf)
                other = names[k:][apart <= reach]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(other), b)), pa.array(other)], names=["block", "other"])

    return blocks.select("block").repartition(max(1, min(len(names), 4096)), "block").mapInArrow(meet, "block long, other long")


def pairs(vectors: DataFrame, least: float, block: int = BLOCK, write=store) -> DataFrame:
    """(a, b, score) with a < b of all pairs of ``vectors`` (id, vec) with cosine of at least ``least``; exact.

    Vectors are packed in blocks of neighbours; only pairs of blocks that :func:`meetings` leaves are shipped, and
    inside a pair of blocks only tiles whose intervals are near enough are multiplied, so what is met follows how the vectors lie, and is
    all pairs of blocks if they fill their space evenly. Only pairs that reach the bound leave a task.
    """
    n = vectors.count()
    if not n:
        return vectors.select(F.col("id").cast("long").alias("a"), F.col("id").cast("long").alias("b"), F.lit(0.0).alias("score")).where("false")
    block = max(block, -(-n // MOST_BLOCKS))
    other = [F.col("ids").alias("ids2"), F.col("mat").alias("mat2")]
    if n <= block:  # one block, which meets itself
        pivots = Pivots(vectors, 1, 1)
        met = packed(vectors, pivots, block, 1).select(F.lit(True).alias("same"), "ids", "mat", *other)
    else:
        pivots = Pivots(vectors)
        blocks = write(packed(vectors, pivots, block, -(-n // block)))
        met = meetings(blocks, least).join(blocks.select(F.col("block").alias("other"), *other), "other").join(blocks.select("block", "ids", "mat"), "block")
        met = met.select((F.col("block") == F.col("other")).alias("same"), "ids", "mat", "ids2", "mat2")
    at, reach = pivots.at, np.sqrt(2 - 2 * least) + 1e-6 if least > 0 else np.inf

    def read(row: pa.RecordBatch, k: str):
        ids = np.frombuffer(row.column("ids" + k)[0].as_py(), "<i8")
        return ids, np.frombuffer(row.column("mat" + k)[0].as_py(), "<f8").reshape(len(ids), -1)

    def tiles(x: np.ndarray):
        for a in range(0, len(x), TILE):
            d = _distances(x[a : a + TILE], at)
            yield a, x[a : a + TILE], d.min(0), d.max(0)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                (ia, va), (ib, vb) = read(row, ""), read(row, "2")
                others = list(tiles(vb))
                for i0, x, lo, hi in tiles(va):
                    near = [t for t in others if max((lo - t[3]).max(initial=-np.inf), (t[2] - hi).max(initial=-np.inf)) <= reach]
                    if not near:
                        continue
                    score = np.round(x @ np.concatenate([t[1] for t in near]).T, 9)
                    at_b = np.concatenate([t[0] + np.arange(len(t[1])) for t in near])
                    i, j = np.nonzero(score >= least)
                    found, a, b = score[i, j], ia[i0 + i], ib[at_b[j]]
                    if row.column("same")[0].as_py():
                        found, a, b = (v[a < b] for v in (found, a, b))
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(found)], names=["a", "b", "score"])

    return met.mapInArrow(run, "a long, b long, score double")


def nearest(queries: DataFrame, vectors: DataFrame, k: int, block: int = 1024) -> DataFrame:
    """(query_id, id, score, k): of each query (id, vec) the ``k`` likest of all vectors, itself left out, by score, then id; exact.

    Each block of queries meets each block of vectors in a task of its own, and only ``k`` rows of each query leave it.
    """
    packed, asked = blocked(vectors, block), blocked(queries, block)
    n = packed.agg(F.max("b").alias("n"))
    sent = asked.crossJoin(F.broadcast(n)).select(F.col("rows").alias("left"), F.explode(F.sequence(F.lit(0), "n")).alias("b"))  # one row beside each block
    met = sent.join(packed.select("b", F.col("rows").alias("right")), "b").select("left", "right")

    def run(batches):
        for batch in batches:
            for j in range(batch.num_rows):
                one = batch.slice(j, 1)
                (ia, va), (ib, vb) = (_unit(one.column(c)) for c in ("left", "right"))
                score = np.round(va @ vb.T, 9)
                score[ia[:, None] == ib[None, :]] = -np.inf
                by = np.argsort(ib, kind="stable")
                ib, score = ib[by], score[:, by]
                order = np.argsort(-score, axis=1, kind="stable")[:, :k]
                got = np.take_along_axis(score, order, 1)
                row, col = np.nonzero(got > -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(ia[row]), pa.array(ib[order[row, col]]), pa.array(got[row, col])], names=["query_id", "id", "score"])

    w = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return met.mapInArrow(run, "query_id long, id long, score double").withColumn("k", F.row_number().over(w)).where(F.col("k") <= k)


def _unit(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    ids, vec = column.flatten().flatten()  # of the slice alone, unlike values
    ids = ids.to_numpy(zero_copy_only=False)
    x = np.asarray(vec.flatten()).reshape(len(ids), -1).astype(np.float64)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return ids, np.where(norm > 0, x / np.where(norm > 0, norm, 1), 0)


def leader_groups(edges: DataFrame, write, one_task: int = ONE_TASK) -> DataFrame:
    """(leader, member, score): the greedy groups of the pairs taken strongest first, (score, a, b) descending.

    Of two free works the smaller becomes leader, a leader takes a free work; pairs at a member, or of two leaders, drop
    out. Pairs of different connected components have no effect on each other: a component of at most ``one_task``
    pairs is taken one by one inside a task, many components a task; larger ones are solved together in rounds.
    """
    edges = write(edges.select("a", "b", "score"))
    of = components(edges, write)
    rows = write(edges.join(of.withColumnRenamed("node", "a"), "a"))
    small, large = parted(rows, one_task)

    def solve(batches):
        component, leads, members = None, set(), set()
        for batch in batches:
            out = []
            for c, a, b, score in zip(*(batch.column(k).to_pylist() for k in ("component", "a", "b", "score"))):
                if c != component:
                    component, leads, members = c, set(), set()
                if a in members or b in members or (a in leads and b in leads):
                    continue
                leader, member = (b, a) if b in leads else (a, b)
                leads.add(leader)
                members.add(member)
                out.append((leader, member, score))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64()))], names=["leader", "member", "score"])

    order = [F.asc("component"), F.desc("score"), F.desc("a"), F.desc("b")]
    done = small.select("component", F.col("a").cast("long"), F.col("b").cast("long"), F.col("score").cast("double")).repartition("component").sortWithinPartitions(*order).mapInArrow(solve, "leader long, member long, score double")
    large = large.select("a", "b", "score")
    return done if large.isEmpty() else done.unionByName(in_rounds(large, write))


class Strongest:
    """The ``k`` strongest pairs of each of some vectors with those of the blocks that it is shown, by score, then the other's id, both descending.

    Of the pairs of one vector that is the order of (score, a, b). Products in single precision only tell which pairs
    may enter a list; scores are computed in double precision, alike from both ends, and rounded as those of :func:`pairs` are.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, at: np.ndarray, least: float, k: int):
        self.ids, self.x, self.least, self.k = ids, x, least, k
        self.single = x.astype(np.float32)
        self.slack = (x.shape[1] + 8) * 2e-7
        self.score, self.other = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)
        self.reach = np.sqrt(2 - 2 * least) + 1e-6 if least > 0 else np.inf
        d = _distances(x, at)
        self.strips = [(r, min(r + STRIP, len(ids)), d[r : r + STRIP].min(0), d[r : r + STRIP].max(0)) for r in range(0, len(ids), STRIP)]

    def meet(self, ids: np.ndarray, y: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        single = np.ascontiguousarray(y.astype(np.float32).T)
        for start, stop, low, high in self.strips:
            if max((low - hi).max(initial=-np.inf), (lo - high).max(initial=-np.inf)) <= self.reach:
                self._strip(start, stop, ids, y, single)

    def _strip(self, start: int, stop: int, ids: np.ndarray, y: np.ndarray, single: np.ndarray) -> None:
        s = self.single[start:stop] @ single
        floor = np.maximum(self.score[start:stop, -1], self.least)
        at = np.flatnonzero(s >= (floor - self.slack).astype(np.float32)[:, None])
        i, j = np.divmod(at, len(ids))
        many = np.flatnonzero(np.bincount(i, minlength=stop - start) > 4 * self.k)
        if len(many):  # of a row's own candidates those that may be among its k best, itself aside
            bound = np.full(stop - start, -np.inf)
            n = min(self.k + 1, len(ids))
            bound[many] = np.partition(s[many], -n, axis=1)[:, -n] - 2 * self.slack
            stay = s.ravel()[at] >= bound[i]
            i, j = i[stay], j[stay]
        i = i + start
        for c in range(0, len(i), 1 << 16):
            self._enter(i[c : c + (1 << 16)], j[c : c + (1 << 16)], ids, y)

    def _enter(self, i: np.ndarray, j: np.ndarray, ids: np.ndarray, y: np.ndarray) -> None:
        other, score = ids[j], np.round((self.x[i] * y[j]).sum(1), 9)
        last, by = self.score[i, -1], self.other[i, -1]
        stay = (other != self.ids[i]) & (score >= self.least) & ((score > last) | ((score == last) & (other > by)))
        i, other, score = i[stay], other[stay], score[stay]
        if not len(i):
            return
        rows = np.unique(i)
        i = np.concatenate([np.repeat(rows, self.k), i])
        score, other = np.concatenate([self.score[rows].ravel(), score]), np.concatenate([self.other[rows].ravel(), other])
        order = np.lexsort((-other, -score, i))
        i, score, other = i[order], score[order], other[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        best = place < self.k
        self.score[i[best], place[best]], self.other[i[best], place[best]] = score[best], other[best]

    def rows(self):
        for r in range(0, len(self.ids), STRIP):
            held = self.score[r : r + STRIP] > -np.inf
            offsets = pa.array(np.concatenate([[0], held.sum(1).cumsum()]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v[r : r + STRIP][held])) for v in (self.other, self.score)]
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[r : r + STRIP]), *lists], names=["id", "others", "scores"])


def listed(asked: DataFrame, vectors: DataFrame, least: float, k: int = LISTED, write=store) -> DataFrame:
    """(id, others, scores): of each of ``asked`` (id, vec) its ``k`` strongest pairs with ``vectors`` of cosine of at least ``least``, strongest first, as :class:`Strongest` orders them; exact.

    Up to :data:`MOST_ASKED` vectors are asked in one task, and every block of vectors that may hold a near one is sent to it
    and met as it comes, so a task holds the lists and one block, and no pair leaves it that is in no list.
    """
    m, n = asked.count(), vectors.count()
    schema = "id long, others array<bigint>, scores array<double>"
    if not m or not n:
        return asked.sparkSession.createDataFrame([], schema)
    pivots, kind = Pivots(vectors), _kind(vectors)
    most = max(STRIP, min(MOST_ASKED, -(-m // 16)))
    groups = write(packed(asked, pivots, most, max(1, -(-5 * m // (4 * most))), True))  # a fifth of room, since ranges are not equal
    bounds = groups.select("block", "lo", "hi").orderBy("block").toArrow()
    names = {b: g for g, b in enumerate(bounds.column("block").to_pylist())}
    low, high = (np.asarray(bounds.column(c).combine_chunks().flatten()).reshape(len(names), -1) for c in ("lo", "hi"))
    at, reach = pivots.at, np.sqrt(2 - 2 * least) + 1e-6 if least > 0 else np.inf

    def numbered(batches):
        for batch in batches:
            g = pa.array([[names[b]] for b in batch.column("block").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([g, pa.array([False] * batch.num_rows), *(batch.column(c) for c in ("ids", "mat", "lo", "hi"))], names=["g", "sent", "ids", "mat", "lo", "hi"])

    def meeting(batches):
        for batch in batches:
            lo, hi = (np.asarray(batch.column(c).flatten()).reshape(batch.num_rows, -1) for c in ("lo", "hi"))
            g = pa.array([np.flatnonzero(np.maximum(low - hi[r], lo[r] - high).max(1, initial=-np.inf) <= reach).astype(np.int32) for r in range(batch.num_rows)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([g, pa.array([True] * batch.num_rows), *(batch.column(c) for c in ("ids", "mat", "lo", "hi"))], names=["g", "sent", "ids", "mat", "lo", "hi"])

    def run(batches):
        here, now = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                g, sent, ids, mat, lo, hi = (batch.column(c)[r].as_py() for c in range(6))
                if g != here and now is not None:
                    yield from now.rows()
                ids = np.frombuffer(ids, "<i8")
                x = np.frombuffer(mat, kind).reshape(len(ids), -1).astype(np.float64)
                norm = np.linalg.norm(x, axis=1, keepdims=True)
                x = np.where(norm > 0, x / np.where(norm > 0, norm, 1), 0)
                if sent:
                    now.meet(ids, x, np.asarray(lo), np.asarray(hi))
                else:
                    here, now = g, Strongest(ids, x, at, least, k)
        if now is not None:
            yield from now.rows()

    row = "g array<int>, sent boolean, ids binary, mat binary, lo array<double>, hi array<double>"
    blocks = packed(vectors, pivots, SENT, max(1, min(-(-n // SENT), 1 << 12)), True)
    both = groups.mapInArrow(numbered, row).unionByName(blocks.mapInArrow(meeting, row)).withColumn("g", F.explode("g"))
    return both.repartitionById(len(names), F.col("g")).sortWithinPartitions("g", "sent").mapInArrow(run, schema)


def near_groups(vectors: DataFrame, least: float, write=store, k: int = LISTED, rounds: int = ROUNDS, one_task: int = ONE_TASK) -> DataFrame:
    """(leader, member, score): what :func:`leader_groups` gives of :func:`pairs`, without ever writing or shuffling all pairs.

    Of each vector the ``k`` strongest pairs are listed. A free one whose list is full may have more pairs, all of them
    weaker than its last one (``cut``); above that its strongest pair left is known, and a pair fires when it is the
    strongest known one at its free ends. When nothing fires, the free ones that may still have pairs are listed
    again, against each other and the leaders alone. So what is written grows with the vectors; what is multiplied,
    all pairs once and few again, grows with their square.
    """
    key = F.struct("score", "a", "b")
    done, asked, every = [], vectors, vectors
    both = lambda: reduce(DataFrame.unionByName, done)
    while True:
        lists = write(listed(asked, every, least, k, write))
        one = lambda o, s: (s.alias("score"), F.least("id", o).alias("a"), F.greatest("id", o).alias("b"))
        last = F.struct(*one(F.element_at("others", -1), F.element_at("scores", -1)))
        cuts = write(lists.where(F.size("others") == k).select(F.col("id").alias("w"), last.alias("cut")))
        left = lists.select("id", F.explode(F.arrays_zip("others", "scores")).alias("e")).select(*one(F.col("e.others"), F.col("e.scores"))).distinct()
        left = write(_standing(left.withColumns({"la": F.lit(False), "lb": F.lit(False)}), both() if done else None))
        number = 0
        while True:
            number += 1
            new = write(_by_components(left, cuts, write, one_task) if number == rounds else _fired(left, cuts, key))
            empty = new.isEmpty()
            if not empty or not done:
                done.append(new)
            if empty and number != rounds:
                break
            left = write(_standing(left, new))
        gone = both()
        leaders, members = gone.select(F.col("leader").alias("id")).distinct(), gone.select(F.col("member").alias("id"))
        waiting = cuts.select(F.col("w").alias("id")).union(left.select("a")).union(left.select("b")).distinct()
        free = write(lists.select("id").join(waiting, "id", "left_semi").join(leaders, "id", "left_anti").join(members, "id", "left_anti"))
        if free.isEmpty():
            return gone
        every = write(vectors.join(free.union(leaders), "id", "left_semi"))
        asked = every.join(free, "id", "left_semi")


def _standing(left: DataFrame, new: DataFrame | None) -> DataFrame:
    """The pairs (score, a, b, la, lb: who leads) that ``new`` groups leave: none of a member, and none of two leaders."""
    if new is None:
        return left
    state = new.select(F.col("leader").alias("n"), F.lit(True).alias("s")).union(new.select("member", F.lit(False))).groupBy("n").agg(F.bool_and("s").alias("s"))
    rows = left.join(state.toDF("a", "sa"), "a", "left").join(state.toDF("b", "sb"), "b", "left").where("coalesce(sa, true) and coalesce(sb, true)")
    return rows.select("score", "a", "b", F.coalesce("sa", "la").alias("la"), F.coalesce("sb", "lb").alias("lb")).where("not (la and lb)")


def _grouped(a, b, lb):
    """(leader, member) of a pair that fires."""
    return F.when(lb, b).otherwise(a).alias("leader"), F.when(lb, a).otherwise(b).alias("member")


def _fired(left: DataFrame, cuts: DataFrame, key) -> DataFrame:
    """(leader, member, score) of the pairs that come before every other one, known or not, at their free ends."""
    ends = left.select(F.col("a").alias("w"), "la", key.alias("key")).union(left.select("b", "lb", key)).where("not la")
    first = ends.groupBy("w").agg(F.max("key").alias("best")).join(cuts, "w", "left").where("cut is null or best >= cut").drop("cut")
    rows = left.withColumn("key", key).join(first.toDF("a", "fa"), "a", "left").join(first.toDF("b", "fb"), "b", "left")
    return rows.where("(la or key = fa) and (lb or key = fb)").select(*_grouped(F.col("a"), F.col("b"), F.col("lb")), "score")


def _by_components(left: DataFrame, cuts: DataFrame, write, one_task: int) -> DataFrame:
    """The same of all pairs of components of at most ``one_task`` pairs and cuts, which a task takes one by one.

    Below its cut a free end is unsure, and so is a free end that a pair joins with an unsure one; pairs of the unsure wait.
    """
    of = components(left.select("a", "b"), write)
    rows = left.select("score", "a", "b", "la", "lb", F.lit(None).cast("long").alias("w")).join(of.withColumnRenamed("node", "a"), "a")
    ends = cuts.select("cut.score", "cut.a", "cut.b", F.lit(False).alias("la"), F.lit(False).alias("lb"), "w").join(of.withColumnRenamed("node", "w"), "w")
    small, _ = parted(write(rows.unionByName(ends)), one_task)

    def solve(batches):
        component, leads, members, unsure = None, set(), set(), set()
        for batch in batches:
            out = []
            for c, score, a, b, la, lb, w in zip(*(batch.column(k).to_pylist() for k in ("component", "score", "a", "b", "la", "lb", "w"))):
                if c != component:
                    component, leads, members, unsure = c, set(), set(), set()
                if w is not None:
                    if w not in leads and w not in members:
                        unsure.add(w)
                    continue
                for n in (n for n, leading in ((a, la), (b, lb)) if leading):
                    leads.add(n)
                    unsure.discard(n)
                if a in members or b in members or (a in leads and b in leads):
                    continue
                if a in unsure or b in unsure:
                    unsure.update({a, b} - leads)
                    continue
                leader, member = (b, a) if b in leads else (a, b)
                leads.add(leader)
                members.add(member)
                out.append((leader, member, score))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64()))], names=["leader", "member", "score"])

    order = [F.asc("component"), F.desc("score"), F.desc("a"), F.desc("b"), F.asc_nulls_first("w")]
    return small.select("component", "score", "a", "b", "la", "lb", "w").repartition("component").sortWithinPartitions(*order).mapInArrow(solve, "leader long, member long, score double")


def parted(rows: DataFrame, one_task: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` of components of at most ``one_task`` rows, and of larger ones.

    There are fewer larger ones than rows over ``one_task``, so their names go to every task: rows are not dealt by
    component, which for a component of nearly all rows would be one task.
    """
    more = rows.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > one_task).select("component")
    return rows.join(F.broadcast(more), "component", "left_anti"), rows.join(F.broadcast(more), "component", "left_semi")


def in_rounds(edges: DataFrame, write) -> DataFrame:
    """The same for components of any size: a pair fires when it comes before every other remaining pair at its free ends; all pairs that may fire do so in one round, which gives what taking them one by one gives."""
    key = F.struct("score", "a", "b")
    left = write(edges.select("a", "b", "score"))
    state = None  # (work, leader): who leads is its own leader
    out = None
    while not left.isEmpty():
        rows = left.withColumn("key", key)
        if state is not None:
            rows = rows.join(state.select(F.col("work").alias("a"), F.lit(True).alias("la")), "a", "left").join(state.select(F.col("work").alias("b"), F.lit(True).alias("lb")), "b", "left")
        else:
            rows = rows.withColumns({"la": F.lit(None).cast("boolean"), "lb": F.lit(None).cast("boolean")})
        rows = write(rows)
        free = rows.where("la is null").select(F.col("a").alias("w"), "key").union(rows.where("lb is null").select(F.col("b").alias("w"), "key"))
        first = free.groupBy("w").agg(F.max("key").alias("best"))
        fire = rows.join(first.select(F.col("w").alias("a"), F.col("best").alias("fa")), "a", "left").join(first.select(F.col("w").alias("b"), F.col("best").alias("fb")), "b", "left")
        fire = fire.where("(la is not null or key = fa) and (lb is not null or key = fb)")
        lead = F.when(F.col("la").isNotNull(), F.col("a")).when(F.col("lb").isNotNull(), F.col("b")).otherwise(F.col("a"))
        new = write(fire.select(lead.alias("leader"), F.when(lead == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("member"), "score"))
        out = new if out is None else out.union(new)
        leaders = new.select(F.col("leader").alias("work"))
        state = write((leaders if state is None else state.union(leaders)).distinct())
        gone = out.select("member")
        rest = left.join(gone.select(F.col("member").alias("a")), "a", "left_anti").join(gone.select(F.col("member").alias("b")), "b", "left_anti")
        rest = rest.join(state.select(F.col("work").alias("a"), F.lit(True).alias("la")), "a", "left").join(state.select(F.col("work").alias("b"), F.lit(True).alias("lb")), "b", "left").where("la is null or lb is null")
        left = write(rest.select("a", "b", "score"))
    return out if out is not None else edges.select(F.col("a").alias("leader"), F.col("b").alias("member"), "score").where("false")


def resolve(paths: DataFrame, works: DataFrame) -> DataFrame:
    """What each found path is, by its content: known content, changed content of a known path, or a new work.

    ``paths`` (path, content_key), ``works`` (work, path, content_key): (path, outcome, work).
    """
    by_key = works.groupBy("content_key").agg(F.min("work").alias("by_content"))
    by_path = works.groupBy("path").agg(F.max("work").alias("by_path"))
    rows = paths.join(by_key, "content_key", "left").join(by_path, "path", "left")
    outcome = F.when(F.col("by_content").isNotNull() & F.col("by_content").eqNullSafe(F.col("by_path")), "same").when(F.col("by_content").isNotNull(), "moved").when(F.col("by_path").isNotNull(), "changed").otherwise("new")
    return rows.select("path", outcome.alias("outcome"), F.coalesce("by_content", "by_path").alias("work"))


def absent(known: DataFrame, listing: DataFrame) -> DataFrame:
    """Known paths that the listing lacks; none if it lacks them all."""
    there = known.join(listing.select("path").distinct(), "path", "left_semi").limit(1).select(F.lit(True).alias("any"))
    return known.join(listing.select("path").distinct(), "path", "left_anti").crossJoin(F.broadcast(there)).drop("any")
