"""Operator 1: BPE encoding and decoding.

Encoding is exact byte-pair merging in linear time: Aho-Corasick gives every token that starts at a position, the
longest is tried first, and a token may follow another only if the pair is compatible, that is, if no merge would
have crossed the boundary between them before both were built. A run of pairwise compatible tokens is the encoding
that the merges give, so a position that has no continuation is dead for good, and the search steps back at most once
over each position. Decoding gathers bytes by a table of offsets.

Defined results: a null text counts as empty; an empty text has no tokens, the digest of an empty string and an empty
decoded text. A null doc_id is carried. Rows are independent: ties, repeated rows and columns beside doc_id and text
have no effect. Texts of any length are encoded whole, piece by piece.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tesserae.llm.common import arrow_map, resident, table, texts

#: Fixed values of the byte-level format: the bytes that are written as themselves.
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Characters on which every Unicode version and regex engine agrees; other texts are cut by the library's splitter.
PLAIN = "[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧‰-⁞₠-₿]"
#: The same pieces for texts of such characters, where letters are the word characters that are no digits.
PLAIN_PIECES = r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
CACHED_PIECES = 250_000
KEPT_PAIRS = 1_000_000
BLOCK_CHARS = 1_000_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    rest = [b for b in range(256) if b not in set(PRINTED)]
    return {chr(b): b for b in PRINTED} | {chr(256 + k): b for k, b in enumerate(rest)}


class Merges:
    """Vocabulary, pair-compatibility table and offsets of one byte-level BPE file; tokens are numbered by rank."""

    def __init__(self, file: bytes):
        import ahocorasick

        spec = json.loads(file)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        spell = lambda word: bytes(letters[c] for c in word)
        pairs = [x.split(" ") if isinstance(x, str) else x for x in spec["model"]["merges"]]
        base = [(letters[c], c) for c in vocab if len(c) == 1]
        self.spelt = [bytes([b]) for b, _ in base]
        self.id = [vocab[c] for _, c in base]
        rank = {c: k for k, (_, c) in enumerate(base)}
        self.parts = [(k, k) for k in range(len(base))]
        self.bases = len(base)
        self.merge: dict[tuple[int, int], int] = {}
        for a, b in pairs:
            pair, k = (rank[a], rank[b]), len(self.spelt)
            if pair in self.merge or a + b in rank:
                raise ValueError(f"two merges make {a + b}")
            rank[a + b] = self.merge[pair] = k
            self.parts.append(pair)
            self.spelt.append(spell(a + b))
            self.id.append(vocab[a + b])
        self.table: dict[int, bool] = {}
        self.size = np.array([len(w) for w in self.spelt])
        self.sizes = self.size.tolist()
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, word in enumerate(self.spelt):
            if k < self.bases or self.compatible(*self.parts[k], k):
                self.automaton.add_word(word.decode("latin-1"), k)
        self.automaton.make_automaton()
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens") or ()}
        blob = {i: w for i, w in zip(self.id, self.spelt)} | {i: w.encode() for w, i in self.special.items()}
        self.length = np.zeros(max(blob) + 1, np.int64)
        self.length[list(blob)] = [len(w) for w in blob.values()]
        self.offset = np.cumsum(self.length) - self.length
        self.blob = np.frombuffer(b"".join(blob[i] for i in sorted(blob)), np.uint8)

    def compatible(self, a: int, b: int, before: int = 1 << 60) -> bool:
        """Whether no merge of rank under ``before`` crosses the boundary of a and b, undoing the later-built of the two step by step."""
        while True:
            if self.merge.get((a, b), before) < before:
                return False
            if a < self.bases and b < self.bases:
                return True
            if a > b:
                before, a = a, self.parts[a][1]
            else:
                before, b = b + 1, self.parts[b][0]

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The compatibility of many pairs."""
        keys, which = np.unique(left * len(self.spelt) + right, return_inverse=True)
        table, n = self.table, len(self.spelt)
        if len(table) > KEPT_PAIRS:
            table.clear()
        for key in keys.tolist():
            if key not in table:
                table[key] = self.compatible(*divmod(key, n))
        return np.array([table[k] for k in keys.tolist()], bool)[which]

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ranks of the tokens of each piece; all pass the automaton in one go, apart by a letter in no token.

        If the leftmost longest tokens already tile a piece and are pairwise compatible, they are its encoding; only
        the other pieces need all matches and the search.
        """
        if not pieces:
            return []
        text = "Ā".join([p.decode("latin-1") for p in pieces])
        found = np.fromiter(chain.from_iterable(self.automaton.iter_long(text)), np.int64).reshape(-1, 2)
        length = np.array([len(p) for p in pieces])
        begins = np.cumsum(length + 1) - length - 1
        of = np.searchsorted(begins, found[:, 0], "right") - 1
        good = np.bincount(of, self.size[found[:, 1]], len(pieces)) == length
        inner = np.flatnonzero(of[1:] == of[:-1])
        good[of[inner[~self.fits(found[inner, 1], found[inner + 1, 1])]]] = False
        cuts = np.searchsorted(of, np.arange(len(pieces) + 1)).tolist()
        tokens = found[:, 1].tolist()
        every = [tokens[a:b] for a, b in zip(cuts, cuts[1:])]
        rest = np.flatnonzero(~good).tolist()
        for k, ranks in zip(rest, self.search([pieces[k] for k in rest])):
            every[k] = ranks
        return every

    def search(self, pieces: list[bytes]) -> list[list[int]]:
        """The backtracking search over all matches."""
        if not pieces:
            return []
        text = "Ā".join([p.decode("latin-1") for p in pieces])
        found = np.fromiter(chain.from_iterable(self.automaton.iter(text)), np.int64).reshape(-1, 2)
        begin = found[:, 0] - self.size[found[:, 1]] + 1
        by = np.lexsort((self.size[found[:, 1]], begin))
        tokens = found[by, 1].tolist()
        last = (np.cumsum(np.bincount(begin, minlength=len(text) + 1)) - 1).tolist()  # the longest at each position
        size, table, compatible, n = self.sizes, self.table, self.compatible, len(self.spelt)
        every, start = [], 0
        for piece in pieces:
            out: list[int] = []
            tried: list[int] = []
            dead: set[int] = set()
            pos, end = start, start + len(piece)
            at, floor = last[pos], last[pos - 1] if pos else -1
            while pos < end:
                while at > floor:
                    token = tokens[at]
                    if pos + size[token] not in dead:
                        if not out:
                            break
                        key = out[-1] * n + token
                        if (fits := table.get(key)) is None:
                            fits = table[key] = compatible(out[-1], token)
                        if fits:
                            break
                    at -= 1
                if at > floor:
                    out.append(token)
                    tried.append(at)
                    pos += size[token]
                    at, floor = last[pos], last[pos - 1]
                else:
                    dead.add(pos)
                    if not out:
                        raise ValueError("the vocabulary lacks a byte")
                    pos -= size[out.pop()]
                    at, floor = tried.pop() - 1, last[pos - 1] if pos else -1
            every.append(out)
            start = end + 1
        return every

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ``ids`` by the offset table; tokens outside it have none."""
        size = self.length[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.blob[np.repeat(self.offset[ids] - (ends - size), size) + np.arange(total)].tobytes()


class Encoder:
    """Cuts texts into pieces and encodes each distinct piece once."""

    def __init__(self, file: bytes):
        self.file, self.merges, self._split = file, Merges(file), None
        self.named: dict[str, str] = {}
        self.packed: dict[str, bytes] = {}
        self.find, self.unusual = re.compile(PLAIN_PIECES).findall, re.compile(PLAIN).search
        self.names = [str(i) for i in self.merges.id]
        special = "|".join(map(re.escape, sorted(self.merges.special, key=len, reverse=True)))
        self.special = re.compile(f"({special})") if special else None

    def pieces(self, text: str) -> list[str]:
        if not self.unusual(text):
            return self.find(text)
        if self._split is None:
            from tokenizers import Tokenizer

            self._split = Tokenizer.from_str(self.file.decode()).pre_tokenizer
        return [text[a:b] for a, b in dict.fromkeys(span for _, span in self._split.pre_tokenize_str(text))]

    def learn(self, words: set[str]) -> None:
        """Encode the pieces not yet known; the caches are emptied, not trimmed, when they are full."""
        if len(self.named) > CACHED_PIECES:
            self.named.clear()
            self.packed.clear()
        new = [w for w in words if w not in self.named]
        ids, names = self.merges.id, self.names
        for piece, ranks in zip(new, self.merges.encode_pieces([w.encode() for w in new])):
            self.named[piece] = ",".join([names[k] for k in ranks])
            self.packed[piece] = array("i", [ids[k] for k in ranks]).tobytes()

    def cut(self, text: str) -> list[str]:
        """The pieces of a text, special tokens among them."""
        if not self.special or not self.special.search(text):
            return self.pieces(text)
        runs = self.special.split(text)
        return [w for k, run in enumerate(runs) for w in ([run] if k % 2 else self.pieces(run) if run else ())]

    def encode_many(self, many: list[str]) -> Iterator[tuple[str, np.ndarray]]:
        """For each text its ids, as decimal numbers joined by commas and as an array; new pieces are learnt a block at a time."""
        at = 0
        while at < len(many):
            block, chars = [], 0
            while at < len(many) and chars < BLOCK_CHARS:
                block.append(self.cut(many[at]))
                chars += len(many[at])
                at += 1
            self.learn(set().union(*block).difference(self.merges.special))
            self.named.update((w, str(i)) for w, i in self.merges.special.items())
            self.packed.update((w, array("i", [i]).tobytes()) for w, i in self.merges.special.items())
            for words in block:
                yield ",".join(map(self.named.__getitem__, words)), np.frombuffer(b"".join(map(self.packed.__getitem__, words)), np.int32)

    def encode(self, text: str) -> tuple[str, np.ndarray]:
        return next(self.encode_many([text]))

    def decode(self, ids: np.ndarray) -> str:
        return self.merges.decode(ids).decode("utf-8", errors="replace")


def encoder(file: bytes) -> Encoder:
    """The worker's encoder of one vocabulary."""
    return resident(f"bpe {sha256(file).hexdigest()}", lambda: Encoder(file))


def read_vocabulary(path: str | None = None) -> bytes:
    """A vocabulary file (about 2 MB, bounded by the vocabulary), read on the driver and broadcast."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, "rb") as f:
        return f.read()


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) to (doc_id, n_tokens, ids binary of little-endian int32, ids_text, decoded)."""
    file = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def each(batch: pa.RecordBatch):
        enc, ids = encoder(file.value), batch.column("doc_id")
        for k, (as_text, tokens) in enumerate(enc.encode_many(texts(batch))):
            yield {"doc_id": ids.slice(k, 1), "n_tokens": [len(tokens)], "ids": [tokens.tobytes()], "ids_text": [as_text], "decoded": [enc.decode(tokens)]}

    return arrow_map(docs.select("doc_id", "text"), each, "doc_id long, n_tokens long, ids binary, ids_text string, decoded string", "bpe")


def digests(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """What :func:`encode_decode` gives, as digests; and the ids as an array if asked for."""
    file = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def each(batch: pa.RecordBatch):
        enc = encoder(file.value)
        out: dict = {"doc_id": batch.column("doc_id"), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        every = []
        for as_text, tokens in enc.encode_many(texts(batch)):
            out["n_tokens"].append(len(tokens))
            out["ids_sha256"].append(sha256(as_text.encode()).hexdigest())
            out["decoded_sha256"].append(sha256(enc.decode(tokens).encode()).hexdigest())
            if with_ids:
                every.append(tokens)
        if with_ids:
            offsets = np.cumsum([0, *out["n_tokens"]]).astype(np.int32)
            out["ids"] = pa.ListArray.from_arrays(offsets, np.concatenate(every))
        return out

    schema = "doc_id long, n_tokens long, " + "ids array<int>, " * with_ids + "ids_sha256 string, decoded_sha256 string"
    return arrow_map(docs.select("doc_id", "text"), each, schema, "bpe")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


#: Not expressible in SQL; tests/llm/test_ops.py compares it with the tokenizers library.
SQL = None
