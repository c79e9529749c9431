"""Operator 5: benchmark decontamination by the q-gram lemma.

A benchmark item of m bytes that occurs in a text with at most k edits shares with it at least m + 1 - q - kq of its
q-grams, and they lie on diagonals (text position less item position) at most k apart. So the q-grams that a text
shares with an item are counted in diagonal bands that overlap by k; bands that reach the bound are retained, and the
region they span is verified by banded alignment of the whole item.

Texts and items are lower-cased and their white space runs become one space; positions are bytes of that form.

An item shorter than a q-gram is searched exactly, as whole words, by an automaton in the same pass.

Memory: what is held for a stretch of text is its longest common stretches with the items, not the pairs of positions, so
a text and an item of one repeated letter take no more than others; they are held in bounded numbers.

Defined results: one row for each (document, item) with an occurrence within the budget, the one of least edits, then
least position; documents without any have no row. A null or empty text and a null or empty item have no occurrence.
Equal items are each reported; equal documents are each reported. Texts are searched whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import arrow_map, as_text, filtered, table, texts
from tesserae.llm.pieces import powers

Q = 12
EDIT_RATE = 0.05
#: Items are held by the driver and tasks in blocks of about so many characters; a larger benchmark takes several passes.
BLOCK_CHARS = 2_000_000
SCAN = 1 << 19
TABLE_BITS = 22
#: Common stretches are held so many at a time, more only if one text position or one item has more.
STRETCHES = 1_000_000
FIRST = 256

_BASE = 0x9E3779B97F4A7C15
_POW = [np.uint64(pow(_BASE, 1 << k, 1 << 64)) for k in range(3)]


def normal(text: str) -> bytes:
    return " ".join(text.lower().split()).encode()


def budget(size: int, rate: float = EDIT_RATE, q: int = Q) -> int:
    """Edits allowed for an item: its share of the size, as far as the lemma still asks for a shared q-gram."""
    return max(0, min(int(size * rate), (size - q) // q))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each 12-gram of bytes."""
    h = data.astype(np.uint64) + np.uint64(1)
    two = h[:-1] * _POW[0] + h[1:]
    four = two[:-2] * _POW[1] + two[2:]
    eight = four[:-4] * _POW[2] + four[4:]
    h = eight[: len(data) - Q + 1] * _POW[2] + four[8 : 8 + len(data) - Q + 1]
    return h ^ (h >> np.uint64(29))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of bytes times powers: equal stretches have equal differences, up to a power."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data) + 1)[:-1], out=out[1:])
    return out


class Index:
    """The q-grams of a block of items: hash -> places, with a table that rejects most foreign hashes.

    The places of a gram are ordered by the byte before them, so that for a text position those that continue a common
    stretch are left out: what is enumerated are common stretches, each once, however long or periodic they are.
    """

    def __init__(self, items: list[tuple[int, str]]):
        by_text: dict[bytes, list[int]] = {}
        for i, text in items:
            by_text.setdefault(normal(text), []).append(i)
        by_text.pop(b"", None)
        self.short = {t: sorted(ids) for t, ids in sorted(by_text.items()) if len(t) < Q}
        self.words = self._short_automaton()
        self.items = [(t, sorted(ids)) for t, ids in sorted(by_text.items()) if len(t) >= Q]
        data = [np.frombuffer(t, np.uint8) for t, _ in self.items]
        self.size = np.array([len(t) for t in data], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        pool = np.concatenate([np.zeros(0, np.uint8), *data])
        self.sums = prefix_sums(pool)
        grams = [gram_hashes(t) for t in data]
        hashes = np.concatenate([np.zeros(0, np.uint64), *grams])
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(g)) for g in grams)])
        before = np.where(place > 0, pool[np.maximum(0, self.begin[item] + place - 1)] if len(pool) else 0, FIRST)
        by = np.lexsort((before, hashes))
        self.item, self.place = item[by].astype(np.int32), place[by].astype(np.int32)
        self.hashes, self.first, which, self.count = np.unique(hashes[by], return_index=True, return_inverse=True, return_counts=True)
        self.continued = which * 512 + before[by]
        self.present = np.zeros(1 << TABLE_BITS, bool)
        self.present[self.hashes >> np.uint64(64 - TABLE_BITS)] = True
        self.most = int(self.size.max()) if len(self.size) else 0
        self.edits = np.array([budget(n) for n in self.size.tolist()], np.int64)
        self.bound = self.size + 1 - Q - self.edits * Q
        self.least = max(1, int(self.bound.min())) if len(self.bound) else 1
        self.reach = self.most + int(self.edits.max()) if len(self.edits) else 0

    def _short_automaton(self):
        """Items of fewer than Q bytes, to be found as whole words."""
        if not self.short:
            return None
        import ahocorasick

        out = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for t in self.short:
            out.add_word(t.decode(), t)
        out.make_automaton()
        return out

    def stretches(self, data: np.ndarray):
        """(item, diagonal, first place, number of q-grams) of every longest common stretch, a bounded number of them at a time, all of an item together."""
        if len(data) < Q or not self.items:
            return
        h = gram_hashes(data)
        at = np.flatnonzero(self.present[h >> np.uint64(64 - TABLE_BITS)])
        gram = np.searchsorted(self.hashes, h[at])
        gram[gram == len(self.hashes)] = 0
        same = self.hashes[gram] == h[at]
        at, gram = at[same], gram[same]
        if len(at) < self.least:  # no band can have as many shared q-grams as the lemma asks for
            return
        before = np.where(at > 0, data[np.maximum(0, at - 1)], FIRST + 1)
        low, high = (np.searchsorted(self.continued, gram * 512 + before + k) for k in (0, 1))
        left, n = low - self.first[gram], self.count[gram] - (high - low)
        at, left, n, low, high = (x[n > 0] for x in (at, left, n, low, high))
        if not len(at):
            return
        sums, ends = prefix_sums(data), np.cumsum(n)
        parts = int(-(-ends[-1] // STRETCHES))
        cuts = np.unique(np.searchsorted(ends, np.arange(1, parts) * STRETCHES))
        for part in range(parts):
            found = []
            for a, b in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(at)].tolist()):
                m = n[a:b]
                step = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
                go = np.repeat(left[a:b], m)
                flat = np.where(step < go, np.repeat(low[a:b], m) - go + step, np.repeat(high[a:b], m) + step - go)
                mine = flat if parts == 1 else flat[self.item[flat] % parts == part]
                t = np.repeat(at[a:b], m) if parts == 1 else np.repeat(at[a:b], m)[self.item[flat] % parts == part]
                found.append((t, mine))
            t, flat = (np.concatenate(x) for x in zip(*found))
            if not len(t):  # no item of this part occurs
                continue
            item, place = self.item[flat].astype(np.int64), self.place[flat].astype(np.int64)
            size = self._common(sums, t, item, place, np.minimum(self.size[item] - place, len(data) - t))
            yield item, t - place, place, size - Q + 1

    def _common(self, sums: np.ndarray, t: np.ndarray, item: np.ndarray, place: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many bytes are equal from a text position and an item position on, Q at least; by halving, on prefix sums."""
        low, high, p = np.full(len(t), Q), most.copy(), self.begin[item] + place
        power = powers(max(len(sums), len(self.sums)))
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            mid = (low[open_] + high[open_] + 1) // 2
            x, y = t[open_], p[open_]
            same = (sums[x + mid] - sums[x]) * power[y] == (self.sums[y + mid] - self.sums[y]) * power[x]
            low[open_[same]] = mid[same]
            high[open_[~same]] = mid[~same] - 1

    def regions(self, data: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, least and greatest diagonal) of the bands that reach the bound of the lemma, joined where they meet; an item position counts once in a band."""
        out: list[tuple[int, int, int]] = []
        for item, diagonal, place, n in self.stretches(data):
            k = self.edits[item]
            diagonal, width = diagonal + self.most, 2 * k + 16
            band = diagonal // width
            extra = (diagonal % width < k) & (band > 0)  # a band reaches k beyond its width, so these count in the band before too
            item, diagonal, place, n, width = (np.concatenate([x, x[extra]]) for x in (item, diagonal, place, n, width))
            band = np.concatenate([band, band[extra] - 1])
            by = np.lexsort((place, band, item))
            item, band, diagonal, place, n, width = (x[by] for x in (item, band, diagonal, place, n, width))
            new = np.r_[True, (item[1:] != item[:-1]) | (band[1:] != band[:-1])]
            starts, group = np.flatnonzero(new), np.cumsum(new) * (self.most + 1)
            reached = np.maximum.accumulate(group + place + n)
            done = np.maximum(place, np.where(new, 0, np.r_[0, reached[:-1]] - group))
            total = np.add.reduceat(np.maximum(0, place + n - done), starts)
            enough = np.flatnonzero(total >= self.bound[item[starts]])
            low, high = np.minimum.reduceat(diagonal, starts)[enough] - self.most, np.maximum.reduceat(diagonal, starts)[enough] - self.most
            for i, lo, hi in zip(item[starts[enough]].tolist(), low.tolist(), high.tolist()):
                if out and out[-1][0] == i and lo <= out[-1][2] + 2 * int(self.edits[i]) + 1:
                    out[-1] = (i, out[-1][1], max(hi, out[-1][2]))
                else:
                    out.append((i, lo, hi))
        return out

    def occurrences(self, text: bytes) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits) of the best verified occurrence of each item, short ones numbered after the others."""
        best: dict[int, tuple[int, int, int]] = {}
        for a in range(0, max(1, len(text) - Q + 1), SCAN):  # stretches of text that overlap by a whole occurrence
            part = text[a : a + SCAN + self.reach]
            for i, lo, hi in self.regions(np.frombuffer(part, np.uint8)):
                item, k = self.items[i][0], int(self.edits[i])
                if (was := best.get(i)) and was[0] == 0:
                    continue
                x, y = max(0, lo - k), min(len(part), hi + len(item) + k)
                exact = part.find(item, x, y)
                if exact >= 0:
                    found = (0, a + exact, a + exact + len(item))
                elif k and (hit := align(item, part[x:y], k)):
                    found = (hit[0], a + x + hit[1], a + x + hit[2])
                else:
                    continue
                best[i] = min(was, found) if was else found
        return [(i, a, b, d) for i, (d, a, b) in sorted(best.items())] + self.short_occurrences(text)

    def short_occurrences(self, text: bytes) -> list[tuple[int, int, int, int]]:
        if not self.words:
            return []
        found: dict[bytes, int] = {}
        spelt = text.decode()
        for end, t in self.words.iter(spelt):
            if t not in found:
                at = end + 1 - len(t.decode())
                if not (at and spelt[at - 1].isalnum() and spelt[at].isalnum()) and not (end + 1 < len(spelt) and spelt[end + 1].isalnum() and spelt[end].isalnum()):
                    found[t] = len(spelt[:at].encode())
        return [(len(self.items) + k, found[t], found[t] + len(t), 0) for k, t in enumerate(self.short) if t in found]

    def names(self, i: int) -> list[int]:
        """The item_ids of an item found."""
        return self.items[i][1] if i < len(self.items) else list(self.short.values())[i - len(self.items)]


def align(item: bytes, region: bytes, k: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best place of the whole item in the region, if it takes at most k edits.

    Row by row over the item, the cells of the band of diagonals that the region leaves; the start is carried along.
    """
    m, n = len(item), len(region)
    y = np.frombuffer(region, np.uint8)
    big = 1 << 30
    span = max(0, n - m) + 2 * k + 1  # diagonals -k .. n - m + k
    column = np.arange(span) - k  # column of each cell in row 0
    cost = np.where((column >= 0) & (column <= n), 0, big).astype(np.int64)
    start = column.copy()
    steps = np.arange(span)
    for row, letter in enumerate(item, 1):
        j = column + row
        inside = (j >= 1) & (j <= n)
        miss = np.where(inside, y[np.clip(j - 1, 0, max(0, n - 1))] != letter, True) if n else np.ones(span, bool)
        diag = np.where(inside, cost + miss, big)
        up = np.r_[cost[1:], big] + 1
        base = np.where((j >= 0) & (j <= n), np.minimum(diag, up), big)
        origin = np.where(diag <= up, start, np.r_[start[1:], 0])
        key = base - steps
        least = np.minimum.accumulate(key)
        fresh = np.r_[True, key[1:] < least[:-1]]
        origin = origin[np.maximum.accumulate(np.where(fresh, steps, 0))]
        cost, start = np.where((j >= 0) & (j <= n), least + steps, big), origin
        if cost.min() > k:
            return None
    end = int(cost.argmin())
    return (int(cost[end]), int(start[end]), int(column[end] + m)) if cost[end] <= k else None


SCHEMA = "doc_id long, item_id long, start long, end long, edits long"


def blocks(benchmark: DataFrame, most_chars: int) -> list[DataFrame]:
    """The items in as many blocks as their size asks for."""
    chars = benchmark.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    n = int(chars // most_chars) + 1
    return [benchmark.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k) for k in range(n)]


def occurrences(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, start, end, edits); ``benchmark`` has item_id and text, and is read in blocks of bounded size."""
    spark, out = docs.sparkSession, None
    for block in blocks(benchmark.select("item_id", as_text("text").alias("text")), block_chars):
        index = spark.sparkContext.broadcast(Index([(r.item_id, r.text) for r in block.collect() if r.item_id is not None]))
        part = arrow_map(docs.select("doc_id", "text"), _searcher(index), SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out


def _searcher(shared):
    def each(batch: pa.RecordBatch):
        index, rows = shared.value, {k.split()[0]: [] for k in SCHEMA.split(", ")}
        for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
            for i, a, b, d in index.occurrences(normal(text)):
                for item in index.names(i):
                    for k, v in zip(rows, (doc, item, a, b, d)):
                        rows[k].append(v)
        return rows

    return each


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no item occurs, with their columns; a document of null doc_id is searched and judged too."""
    spark, parts = docs.sparkSession, blocks(benchmark.select("item_id", as_text("text").alias("text")), BLOCK_CHARS)
    out = docs
    for block in parts:
        out = _without(out, spark.sparkContext.broadcast(Index([(0, r.text) for r in block.collect()])))
    return out


def _without(docs: DataFrame, shared) -> DataFrame:
    return filtered(docs, lambda many: [not shared.value.occurrences(normal(t)) for t in many])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occurrences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Edit distance to parts of a text is not SQL; tests/llm/test_ops.py has the brute force.
SQL = None
