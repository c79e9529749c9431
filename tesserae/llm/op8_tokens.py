"""Operator 8: token ids in a fixed-width bit-packed file format.

Ids take the least bits that the vocabulary needs. The files are a Parquet table of blocks: each block holds whole
documents, their doc_ids and counts (the offsets within the block), and the packed ids; blocks stand in shards, in
ascending order of doc_id, with the block's first token within its shard. So a document is found by its block's doc_ids,
and a token position by shard and block start, and either is read by unpacking one block with numpy.

A piece's ids do not depend on its neighbours, so each distinct piece of a block of texts is merged once, all of them at the
same time in numpy; texts with unusual characters or special tokens, and pieces of more than :data:`LONG` bytes, go to the
tokenizers library. No cache outlives a block. A text of more than :data:`BLOCK_CHARS` characters is cut at white space and its parts
are encoded one after another, so the memory of a worker is bounded by a block, the ids of one text, and the longest run without white space.

Defined results: a null or empty text is the end id alone. A null doc_id sorts first; rows of one doc_id are ordered by
text. Columns beside doc_id and text have no effect; texts are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.llm.common import arrow_map, arrow_schema, as_text, release, resident, small, table, texts, written
from tesserae.llm.op1_bpe import byte_letters
from tesserae.llm.pieces import PairTable, code_points, distinct, letters, merge_all

BLOCK_IDS = 1 << 16
FEW_SHARDS = 100_000
BLOCK_CHARS = 1 << 21
#: Pieces of more bytes are merged by the library, whose time does not grow with the square of a piece.
LONG = 64
#: Characters that are not plain: on all others every Unicode version and regex engine agrees, see op1_bpe.PLAIN.
PLAIN = "[^\x00-\x1b\x20-\x84\x86-\xb1\xb4-\xb8\xba\xbb\xbf-įıĲ-ɏ‐-‧‰-⁞₠-₿]"
TABLE = 0x20C1


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` in ``bits`` bits each, lowest first, in 64-bit little-endian words; 64 ids fill ``bits`` words."""
    rows = -(-len(ids) // 64)
    padded = np.zeros(rows * 64, np.uint64)
    padded[: len(ids)] = ids
    columns, out = padded.reshape(rows, 64), np.zeros((rows, bits), np.uint64)
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        out[:, word] |= columns[:, k] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= columns[:, k] >> np.uint64(64 - shift)
    return out.astype("<u8").tobytes()[: -(-len(ids) * bits // 8)]


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    """The ``n`` ids that :func:`pack` packed."""
    rows = -(-n // 64)
    words = np.frombuffer(data.ljust(rows * bits * 8, b"\0"), "<u8").reshape(rows, bits)
    out, mask = np.empty((rows, 64), np.uint64), np.uint64((1 << bits) - 1)
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        value = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            value = value | words[:, word + 1] << np.uint64(64 - shift)
        out[:, k] = value & mask
    return out.ravel()[:n].astype(np.uint32)


def portions(text: str, size: int) -> list[str]:
    """``text`` in parts of at most ``size`` characters, each but the first beginning with white space, which no piece crosses; a longer run without any stays whole."""
    out, at = [], 0
    while len(text) - at > size:
        end = max(text.rfind(c, at + 1, at + size + 1) for c in " \n")
        if end < 0:
            end = min((e for c in " \n" if (e := text.find(c, at + size)) >= 0), default=len(text))
        out.append(text[at:end])
        at = end
    return [*out, text[at:]] if at < len(text) or not out else out


class Encoder:
    """The library's ids: merges of all distinct pieces of a block at once, and the library itself for what is unusual."""

    SPACE, LETTER, DIGIT, OTHER, ODD = range(5)

    def __init__(self, file: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        spec = json.loads(file)
        self.tokenizer = Tokenizer.from_str(file.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens") or ()}
        self.bits = max([*vocab.values(), *self.special.values()]).bit_length()
        pairs = [x.split(" ") if isinstance(x, str) else x for x in spec["model"]["merges"]]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.uint16)
        self.ranks = PairTable(np.array([(vocab[a], vocab[b]) for a, b in pairs]), np.arange(len(pairs)))
        spelt = {b: c for c, b in byte_letters().items()}
        self.inner, self.last = (np.array([vocab[spelt[b] + tail] for b in range(256)], np.uint16) for tail in ("", end))
        self.kind, self.lower = np.full(TABLE, self.ODD, np.uint8), np.arange(TABLE, dtype=np.uint32)
        usual = re.compile(PLAIN)
        for i in range(TABLE - 1):
            if not usual.match(c := chr(i)):
                self.kind[i] = self.SPACE if c.isspace() else self.DIGIT if re.match(r"\d", c) else self.LETTER if re.match(r"[^\W_]", c) else self.OTHER
                self.lower[i] = ord(c.lower())

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def pieces(self, codes: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of each piece of lower-cased code points: contractions, runs of letters, digits, and runs of others."""
        before = np.r_[np.uint8(self.SPACE), kind[:-1]]
        edge = (kind != before) | (kind == self.DIGIT)
        at = np.flatnonzero((codes == 39) & (before != self.OTHER))
        one, two = (np.r_[codes, 0, 0][at + k] for k in (1, 2))
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l")))
        edge[at[short | long] + 1] = False
        rest = np.r_[at[short] + 2, at[long] + 3]
        rest = rest[rest < len(codes)]
        edge[rest] = True
        bounds = np.flatnonzero(edge)
        ends = np.r_[bounds[1:], len(codes)]
        real = kind[bounds] != self.SPACE
        return bounds[real], ends[real]

    def encode_distinct(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and number of ids of each piece."""
        here = codes[letters(starts, ends - starts)]
        size = np.add.reduceat(1 + (here > 0x7F) + (here > 0x7FF), np.r_[0, np.cumsum(ends - starts)[:-1]])  # bytes; the table ends before four-byte letters
        data = np.frombuffer(here.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        symbols = self.inner[data]
        symbols[np.cumsum(size) - 1] = self.last[data[np.cumsum(size) - 1]]
        big = size > LONG
        if not big.any():
            return merge_all(symbols, size, self.ranks, self.made)
        ids, n = merge_all(symbols[np.repeat(~big, size)], size[~big], self.ranks, self.made)
        few, parts = iter(np.split(ids, np.cumsum(n)[:-1])), []
        for k, b in enumerate(big.tolist()):
            parts.append(self.whole(codes[starts[k] : ends[k]].astype("<u4").tobytes().decode("utf-32-le")) if b else next(few))
        return np.concatenate(parts), np.array([len(x) for x in parts])

    def encode_block(self, block: list[str]) -> list[np.ndarray]:
        odd = [any(x in t for x in self.special) for t in block]
        raw = code_points("\n".join(block) + "\n")
        size = np.array([len(t) + 1 for t in block])
        begin = np.cumsum(size) - size
        kind = self.kind[np.minimum(raw, TABLE - 1)]
        odd = np.logical_or.reduceat(kind == self.ODD, begin) | np.array(odd)
        if odd.any():
            kind[np.repeat(odd, size)] = self.SPACE
        codes = self.lower[np.minimum(raw, TABLE - 1)]
        starts, ends = self.pieces(codes, kind)
        first, which = distinct(codes, starts, ends)
        if not len(first):
            return [self.whole(t) if o else np.zeros(0, np.uint32) for t, o in zip(block, odd.tolist())]
        ids, n = self.encode_distinct(codes, starts[first], ends[first])
        many = n[which]
        every = ids[letters((np.cumsum(n) - n)[which], many)].astype(np.uint32)
        total = np.r_[0, np.cumsum(many)]
        cuts = total[np.searchsorted(starts, np.r_[begin, len(raw)])].tolist()
        return [self.whole(t) if o else every[a:b] for t, o, a, b in zip(block, odd.tolist(), cuts, cuts[1:])]

    def encode_many(self, many: list[str]) -> Iterator[np.ndarray]:
        at = 0
        while at < len(many):
            if len(many[at]) > BLOCK_CHARS:
                yield np.concatenate([self.encode_block([p])[0] for p in portions(many[at], BLOCK_CHARS)])
                at += 1
                continue
            end, chars = at, 0
            while end < len(many) and chars < BLOCK_CHARS and len(many[end]) <= BLOCK_CHARS:
                chars += len(many[end])
                end += 1
            yield from self.encode_block(many[at:end])
            at = end


def encoder(file: bytes) -> Encoder:
    """The worker's encoder of one vocabulary."""
    return resident(f"tokens {sha256(file).hexdigest()}", lambda: Encoder(file))


BLOCK_SCHEMA = "shard long, start long, n_ids long, bits int, docs array<long>, sizes array<int>, packed binary"


def blocks(docs: DataFrame, path: str | None = None, end_id: int = 1, block_ids: int = BLOCK_IDS) -> DataFrame:
    """The blocks of ``docs`` (doc_id, text), to be written; every shard is one partition of a range of doc_ids."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # about 3 MB, bounded by the vocabulary
    ranged = docs.select("doc_id", as_text("text").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        release("tokens")
        enc, shard, start, held, size = encoder(shared.value), TaskContext.get().partitionId(), 0, [], 0
        target, end = arrow_schema(BLOCK_SCHEMA), np.array([end_id], np.uint32)

        def block():
            ids = np.concatenate([x for _, x in held])
            row = {"shard": shard, "start": start, "n_ids": len(ids), "bits": enc.bits, "docs": [d for d, _ in held], "sizes": [len(x) for _, x in held], "packed": pack(ids, enc.bits)}
            return pa.RecordBatch.from_pylist([row], schema=target)

        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), enc.encode_many(texts(batch))):
                held.append((doc, np.concatenate([ids, end])))
                size += len(ids) + 1
                if size >= block_ids:
                    yield block()
                    start, size, held = start + size, 0, []
        if held:
            yield block()

    return ranged.mapInArrow(run, BLOCK_SCHEMA)


def placed(files: DataFrame) -> DataFrame:
    """The blocks with the number of ids in all shards before theirs."""
    ends = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = ends.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("before"))  # a row for each shard, not for each block
    return files.join(small(written(before, "shards"), FEW_SHARDS), "shard")


def read_documents(files: DataFrame, digest=lambda ids: zlib.crc32(ids.astype("<u4").tobytes())) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""

    def each(batch: pa.RecordBatch):
        out: dict = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
        for r in batch.to_pylist():
            ids, at = unpack(r["packed"], r["n_ids"], r["bits"]), 0
            for doc, n in zip(r["docs"], r["sizes"]):
                for k, v in zip(out, (doc, r["before"] + r["start"] + at, n, digest(ids[at : at + n]))):
                    out[k].append(v)
                at += n
        return out

    return arrow_map(placed(files), each, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_some(files: DataFrame, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of some documents: only the blocks that hold one of them are unpacked."""
    wanted = set(doc_ids)

    def each(batch: pa.RecordBatch):
        out: dict = {"doc_id": [], "ids": []}
        for r in batch.to_pylist():
            ids, at = unpack(r["packed"], r["n_ids"], r["bits"]), 0
            for doc, n in zip(r["docs"], r["sizes"]):
                if doc in wanted:
                    out["doc_id"].append(doc)
                    out["ids"].append(ids[at : at + n].tolist())
                at += n
        return out

    held = files.where(F.arrays_overlap("docs", F.array(*[F.lit(d).cast("long") for d in sorted(wanted)])))
    return arrow_map(held, each, "doc_id long, ids array<int>")


def read_range(files: DataFrame, first: int, n: int) -> DataFrame:
    """(start, ids): the ids at positions ``first`` to ``first + n`` of all ids, a row for each block that holds some; only those are unpacked."""

    def each(batch: pa.RecordBatch):
        out: dict = {"start": [], "ids": []}
        for r in batch.to_pylist():
            begin = r["before"] + r["start"]
            a, b = max(0, first - begin), min(r["n_ids"], first + n - begin)
            out["start"].append(begin + a)
            out["ids"].append(unpack(r["packed"], r["n_ids"], r["bits"])[a:b].tolist())
        return out

    begin = F.col("before") + F.col("start")
    return arrow_map(placed(files).where((begin < first + n) & (begin + F.col("n_ids") > first)), each, "start long, ids array<int>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_documents(written(blocks(table(spark, sf_dir, "documents")), "token-blocks"))


#: A tokenizer is not SQL; tests/llm/test_ops.py compares with the library and round trips.
SQL = None
