"""Operator 6: SimHash near-duplicates by pigeonhole blocks.

A fingerprint has a bit set if more than half of the document's shingle hashes have it set. Two fingerprints that differ
in at most three bits agree in two of five blocks, so fingerprints meet under each pair of blocks and are verified by
their Hamming distance. What meets is distinct fingerprints, never copies of documents: each stands for its documents.
Under a key of more than :data:`GROUP` fingerprints a leader is compared with all, and only what is not connected then
is compared further, dealt out in slots of that many at most, so no task holds an unbounded group and no group costs its
square (:func:`links`). Of the links in a group only a spanning forest leaves the task, which loses no
connection. Components are found by contraction (``common.components``).

Words are runs of characters other than the six ASCII white-space characters, A-Z lower-cased.

Defined results: a null or empty text has fingerprint zero, linked like any other. A document of null doc_id has its
fingerprint, and the component of the documents that have the same one (null if none has a doc_id); it links nothing.
Rows of one doc_id are each linked by their own text. Equal rows have equal results; columns beside doc_id and text have no effect; texts are hashed whole.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import Hashes, arrow_map, arrow_schema, components, grouped_batches, small, table, texts, written

SHINGLE = 3
DISTANCE = 3
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
GROUP = 512
SMALL = 24
#: Keys of more nodes than a group that are broadcast.
FEW_KEYS = 20_000
#: Words of 64 bits of the two fingerprints of :func:`similar`, and the bits of the second in which similar texts may differ.
BLOCK_WORDS, WORDS = 6, 4
SIMILAR_BITS = 46
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA24BAED4963EE407, 0x9FB21C651E98DF25], np.uint64)
_STEP = np.uint64(0xFF51AFD7ED558CCD)
_hashes = Hashes()


def fingerprint(text: str) -> int:
    """The fingerprint as an unsigned number."""
    import xxhash

    words = text.encode().lower().split()  # lower-cases A-Z alone
    if not words:
        return 0
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), seed=42)]
    else:
        line = b" ".join(words)
        ends, at = [], -1
        for w in words:
            at += len(w) + 1
            ends.append(at)
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], 42) for a, b in zip([0, *(e + 1 for e in ends)], ends[SHINGLE - 1 :])]
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[k : k + (1 << 16)], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, f), f being the fingerprint as a signed long."""

    def each(batch: pa.RecordBatch):
        found = np.array([fingerprint(t) for t in texts(batch)], np.uint64)
        return {"doc_id": batch.column("doc_id"), "f": pa.array(found.view(np.int64))}

    return arrow_map(docs.select("doc_id", "text"), each, "doc_id long, f long")


def sketches(docs: DataFrame, blocks: int = BLOCK_WORDS, verified: int = WORDS) -> DataFrame:
    """(doc_id, text) to (doc_id, b0, b1, ..., v0, v1, ...): fingerprints of several words, of the distinct pairs of words for blocks and of the distinct five-word shingles for verification."""
    names = [f"b{k}" for k in range(blocks)] + [f"v{k}" for k in range(verified)]

    def each(batch: pa.RecordBatch):
        rows = []
        for t in texts(batch):
            words = t.encode().lower().split()
            h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
            rows.append(np.concatenate([wide_fingerprint(h, 2, blocks), wide_fingerprint(h, 5, verified)]))
        columns = np.array(rows, np.uint64).view(np.int64)
        return {"doc_id": batch.column("doc_id")} | {n: pa.array(np.ascontiguousarray(columns[:, k])) for k, n in enumerate(names)}

    return arrow_map(docs.select("doc_id", "text"), each, "doc_id long, " + ", ".join(f"{n} long" for n in names))


def wide_fingerprint(words: np.ndarray, shingle: int, size: int) -> np.ndarray:
    """``size`` words of fingerprint of the distinct shingles of hashed words; a bit is 1 if set in over half of them."""
    n = max(1, len(words) - shingle + 1) if len(words) else 0
    h = np.zeros(n, np.uint64)
    for k in range(min(shingle, len(words))):
        h = h * _STEP + words[k : k + n]
    h = np.unique(h)
    ones = np.zeros(64 * size, np.int64)
    for a in range(0, len(h), 255):
        part = h[a : a + 255, None] * _MIX[None, :size]
        part ^= part >> np.uint64(29)
        part *= _STEP
        part ^= part >> np.uint64(32)
        ones += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")


def block_keys(words: list[str]) -> Column:
    """The keys of a fingerprint of some words: the word, the pair of its blocks and the bits of both."""

    def bits(f: str, k: int) -> Column:
        at, size = BLOCKS[k]
        return F.shiftrightunsigned(F.col(f), at).bitwiseAND(F.lit((1 << size) - 1))

    pairs = list(combinations(range(len(BLOCKS)), len(BLOCKS) - DISTANCE))
    return F.array(*[F.lit((t * len(pairs) + n) << 32).cast("long").bitwiseOR(F.shiftleft(bits(f, a), 13)).bitwiseOR(bits(f, b)) for t, f in enumerate(words) for n, (a, b) in enumerate(pairs)])


def differing(f: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The number of differing bits of rows of words."""
    return np.bitwise_count(f ^ g).sum(-1, dtype=np.int64)


def links_in_group(f: np.ndarray, node: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links in one group of rows of words: every fingerprint is compared once with all not yet reached."""
    a, b = [], []
    rest = np.arange(len(f))
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            at = todo.pop()
            near = differing(f[rest], f[at]) <= distance
            if near.any():
                reached = rest[near]
                a.append(np.full(len(reached), node[at]))
                b.append(node[reached])
                todo.extend(reached.tolist())
                rest = rest[~near]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def links(found: DataFrame, blocks: list[str], words: list[str], distance: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """Links (a, b) that connect the same nodes as all links of ``found`` that meet under a key.

    ``found`` has node and columns of longs; ``blocks`` give the keys, and nodes are linked if ``words`` differ in at
    most ``distance`` bits.

    Under a key of at most ``group`` nodes all are compared. Under a larger one every node is compared with a leader, one
    for each key, chosen by hash. What these links connect needs no comparison with its like: only keys whose nodes still are
    in several components go on, and there the nodes of the largest component, dealt out in slots, are compared with the
    others, and the others with each other. So one large group of near copies costs a pass, not its square.
    """
    keyed = found.select("node", F.explode(block_keys(blocks)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = written(keyed.join(sizes, "key").join(found.select("node", *words), "node").select("key", "node", *words, "n"), "met")
    few = met.where(F.col("n") <= group).select("key", F.lit(0).alias("s1"), F.lit(0).alias("s2"), "node", *words)
    out = written(_compared(few, words, distance), "links")
    hot = met.where(F.col("n") > group)
    if hot.isEmpty():
        return out
    order = F.xxhash64("key", "node").alias("order")
    lead = small(written(hot.groupBy("key").agg(F.min(F.struct(order, "node", *words)).alias("lead")), "leaders"), FEW_KEYS)
    d = sum((F.bit_count(F.col(w).bitwiseXOR(F.col("lead")[w])) for w in words), F.lit(0))
    stars = hot.join(lead, "key").where((F.col("node") != F.col("lead.node")) & (d <= distance)).select(F.col("lead.node").alias("a"), F.col("node").alias("b"))
    out = written(out.union(stars).distinct(), "links")
    parts = components(out).select("node", "component")
    hot = written(hot.select("key", "node", *words).join(parts, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component"), "hot-keys")
    per = hot.groupBy("key", "c").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "c")).alias("top"), F.sum("n").alias("n")).where("n > top.n")
    slots = lambda n: F.ceil(n / group).cast("int")
    per = small(written(per.select("key", F.col("top.c").alias("top"), slots(F.col("top.n")).alias("n1"), slots(F.col("n") - F.col("top.n")).alias("n2")), "open-keys"), FEW_KEYS)
    rows = hot.join(per, "key")
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    within, others = rows.where("c = top"), rows.where("c <> top")
    met = within.select("key", own("n1").alias("s1"), every("n2").alias("s2"), "node", *words)
    met = met.union(others.select("key", every("n1").alias("s1"), own("n2").alias("s2"), "node", *words))  # with each other too, in one slot
    pairs = others.where("n2 > 1").withColumn("s", own("n2")).withColumn("o", every("n2"))
    met = met.union(pairs.select("key", (-1 - F.least("s", "o")).alias("s1"), F.greatest("s", "o").alias("s2"), "node", *words))
    return out.union(_compared(met, words, distance))


def _compared(met: DataFrame, words: list[str], distance: int) -> DataFrame:
    """(a, b): a forest of the links in each group (key, s1, s2) of nodes."""
    met = met.repartition("key", "s1", "s2").sortWithinPartitions("key", "s1", "s2")

    def run(batches):
        target = arrow_schema("a long, b long")
        for t in grouped_batches(batches, ["key", "s1", "s2"]):
            key, s1, s2, node = (t.column(c).to_numpy() for c in ("key", "s1", "s2", "node"))
            f = np.stack([t.column(c).to_numpy() for c in words], 1).view(np.uint64)
            new = np.r_[True, (key[1:] != key[:-1]) | (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])]
            starts = np.flatnonzero(new)
            size = np.diff(np.r_[starts, len(f)])
            which = np.repeat(np.arange(len(starts)), size)
            few = size[which] <= SMALL
            out_a, out_b = [], []
            for step in range(1, min(SMALL, int(size.max()))):
                i = np.flatnonzero((which[step:] == which[:-step]) & few[step:])
                i = i[differing(f[i], f[i + step]) <= distance]
                out_a.append(node[i])
                out_b.append(node[i + step])
            for a, n in zip(starts[size > SMALL].tolist(), size[size > SMALL].tolist()):
                x, y = links_in_group(f[a : a + n], node[a : a + n], distance)
                out_a.append(x)
                out_b.append(y)
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], schema=target)

    return met.mapInArrow(run, "a long, b long")


def _components(of: DataFrame, blocks: list[str], words: list[str], distance: int, group: int) -> DataFrame:
    """(words, component_id): the smallest doc_id that can be reached, for each distinct fingerprint of ``of``."""
    same = list(dict.fromkeys([*words, *blocks]))
    node = F.col(same[0]) if len(same) == 1 else F.xxhash64(*same)
    found = of.where("doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("least")).withColumn("node", node)
    found = written(found, "distinct-fingerprints")
    parts = components(links(found, blocks, words, distance, group))
    named = found.join(parts, "node", "left").select(*same, "least", F.coalesce("component", "node").alias("part"))
    least = named.groupBy("part").agg(F.min("least").alias("component_id"))
    return written(named.join(least, "part").select(*same, "component_id"), "fingerprint-components")


def near_duplicates(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row."""
    of = written(fingerprints(docs), "fingerprints")
    named = _components(of, ["f"], ["f"], DISTANCE, group)
    return of.join(named, "f", "left").select("doc_id", F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), "component_id")


def similar(docs: DataFrame, bits: int = SIMILAR_BITS, group: int = GROUP) -> DataFrame:
    """(doc_id, component_id): groups of texts whose five-word shingles are alike in about 0.8 or more.

    The wide form for whole corpora: texts meet under the pairs of blocks of six fingerprints of their pairs of words,
    which near copies change less than longer shingles, and are linked if their fingerprints of five-word shingles, of 256 bits,
    differ in at most ``bits``; at a similarity of 0.8 the expected number is 39, with a deviation of 6. Texts whose first
    fingerprints differ in at most three bits in any of the six words surely meet, others by chance: README has the
    measured recall. Fingerprints are known by a 64-bit hash of all their words.
    """
    of = written(sketches(docs), "sketches")
    blocks, words = [f"b{k}" for k in range(BLOCK_WORDS)], [f"v{k}" for k in range(WORDS)]
    named = _components(of, blocks, words, bits, group)
    return of.join(named, [*words, *blocks], "left").select("doc_id", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: XXH64 and components are not SQL; tests/llm/test_ops.py has the brute force.
SQL = None
