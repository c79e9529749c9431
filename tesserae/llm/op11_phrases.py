"""Operator 11: phrase collocation mining by multikey three-way quicksort of suffix pointers.

Every word of the corpus is the start of a suffix of at most four words within its piece. Suffixes are routed globally by
their leading words: bounds taken from a bounded sample cut the order of all suffixes into ranges of about :data:`RANGE`
characters of text, so a frequent word is divided at its second, third or fourth word, and no range holds a group
that grows. Inside a range a three-way quicksort compares one word at a time: the pointers equal to the pivot are all
places of a phrase, so their number is its count, and they alone are sorted further, by the next word, down to the
fourth; a part with fewer places than a phrase needs is abandoned (:func:`count_phrases`). Phrases that begin a bound
may go on in the next range: those, a few a range, are put out whatever their count, and added up.

Before they travel, a task sorts some millions of suffixes, adds up equal ones and packs each range's into one row: its
words once, and columns of word numbers, so a passage repeated any number of times is one suffix of a task.

Scores are then joins of counts with counts (:func:`score`), in decimals, so nothing rounds or overflows.

Pieces are what stands between ``. , ; : ! ?`` and line ends (\\n, \\v, \\f, \\r); words are runs of other characters than space and tab, A-Z lower-cased.

Defined results: a null or empty text has no words; a null ``lang`` is the language ``und``, one with documents that say so.
A language without candidates has no row. Repeated rows count each; doc_id and other columns have no effect. Texts are taken whole, in stretches, so a long one takes no
more memory than others. The bounds depend on a sample; results do not.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm.common import arrow_map, arrow_schema, grouped_batches, table, written

LEAST = 30
WORDS = 4
TOP = 2000
SHARE = 80
#: Characters of text a range, suffixes sampled for each bound, and positions that a task sorts at once.
RANGE = 8_000_000
SAMPLED = 200
POSITIONS = 500_000
#: Characters of a text that are taken at once, and the tasks that share a language's ranking.
STRETCH = 1 << 20
SALTS = 16
SCALE = 2_000_000
_DELIMITERS = b".,;:!?\n\x0b\x0c\r"
_FOLDED = bytes.maketrans(bytes(range(65, 91)) + _DELIMITERS, bytes(range(97, 123)) + b"." * len(_DELIMITERS))
END = b"."


def tokens(text: str) -> list[bytes]:
    """The words, and an :data:`END` for each delimiter, which no word can be."""
    return text.encode().translate(_FOLDED).replace(END, b" . ").split()


def stretches(text: str):
    """The tokens of ``text``, some at a time, cut at white space or delimiters."""
    at, n = 0, len(text)
    while at < n:
        end = min(n, at + STRETCH)
        while end < n and text[end] not in " \t.,;:!?\n\x0b\x0c\r":
            end += 1
        yield tokens(text[at:end])
        at = end


class Numbers(dict):
    """The number of each word, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Suffixes:
    """Suffixes of some texts: sorted, equal ones added up, and cut at bounds."""

    def __init__(self, bounds: list[tuple], width: int = WORDS):
        self.bounds, self.width = bounds, width
        self.start([])

    def start(self, carried: list[bytes]) -> None:
        self.numbers, self.langs, self.held, self.size, self.carried, self.tail = Numbers({END: 0}), {}, [], 0, carried, []

    def add(self, lang: str, words: list[bytes], ends: bool) -> None:
        """The next words of a text, which ``ends`` with them or goes on."""
        words, self.carried = self.carried + words, []
        self.tail = [] if ends else (self.tail + words)[1 - self.width :]
        ids = np.fromiter(map(self.numbers.__getitem__, [*words, END] if ends else words), np.int64, len(words) + ends)
        self.held.append((self.langs.setdefault(lang, len(self.langs)), ids))
        self.size += len(ids)

    def packed(self):
        """(range, lang, words, ids, n) of what is held; the last words of a text that goes on wait for the next ones."""
        if self.size:
            yield from self._sorted(np.concatenate([x for _, x in self.held]), np.repeat([k for k, _ in self.held], [len(x) for _, x in self.held]), len(self.tail))
        self.start(self.tail)

    def _sorted(self, ids: np.ndarray, lang: np.ndarray, waiting: int):
        width, words, langs = self.width, list(self.numbers), sorted(self.langs)
        order = [0, *sorted(range(1, len(words)), key=words.__getitem__)]
        words = [words[k] for k in order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        of_lang = np.array([langs.index(x) for x in self.langs], np.int64)
        n, ids = len(ids), np.concatenate([rank[ids], np.zeros(width, np.int64)])
        columns = [of_lang[lang], ids[:n]]
        for k in range(1, width):
            columns.append(np.where(columns[-1] > 0, ids[k : n + k], 0))
        at = np.flatnonzero(columns[1][: n - waiting])
        bits, keys = len(words).bit_length(), []
        columns = [c[at] for c in columns]
        for c in columns:  # several words a sort key
            if keys and used + bits < 63:
                keys[-1], used = keys[-1] << bits | c, used + bits
            else:
                keys, used = [*keys, c.astype(np.int64)], max(bits, len(langs).bit_length())
        order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
        new = np.zeros(len(at), bool)
        new[:1] = True
        for k in keys:
            k = k[order]
            new[1:] |= k[1:] != k[:-1]
        starts = np.flatnonzero(new)
        count = np.diff(np.r_[starts, len(at)])
        columns = [c[order[starts]] for c in columns]
        edges = [0, *(self._place(b, columns, langs, words) for b in self.bounds), len(starts)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            cuts = [a, *(a + np.flatnonzero(np.diff(columns[0][a:b])) + 1).tolist(), b] if b > a else []
            for x, y in zip(cuts, cuts[1:]):
                used, inner = np.unique(np.stack([c[x:y] for c in columns[1:]]), return_inverse=True)
                yield k, langs[columns[0][x]], b" ".join(words[u] for u in used.tolist()), _narrow(inner.ravel()), _narrow(count[x:y])

    def _place(self, bound: tuple, columns: list, langs: list, words: list) -> int:
        """The first suffix that is not below ``bound``."""
        lo, hi = 0, len(columns[0])
        for c, value, names in zip(columns, bound, [langs, *[words] * self.width]):
            if names is words:
                rank = bisect_left(words, value, 1) if value else 0
                found = not value or rank < len(words) and words[rank] == value
            else:
                rank = bisect_left(langs, value)
                found = rank < len(langs) and langs[rank] == value
            a = lo + int(np.searchsorted(c[lo:hi], rank, "left"))
            if not found:
                return a
            lo, hi = a, lo + int(np.searchsorted(c[lo:hi], rank, "right"))
        return lo


def _narrow(x: np.ndarray) -> bytes:
    """Numbers as bytes, the first of which is the width of one."""
    size = next(s for s in (1, 2, 4, 8) if not len(x) or int(x.max()) < 1 << 8 * s)
    return bytes([size]) + x.astype(f"<u{size}").tobytes()


def _wide(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<u{b[0]}", offset=1).astype(np.int64)


def count_phrases(columns: list[np.ndarray], weights: np.ndarray, least: int):
    """(pointer, depth, count) of every phrase of ``least`` places and more: multikey three-way quicksort of pointers to suffixes.

    ``columns`` has the words' numbers, 0 after the last; the phrase is the first ``depth`` words of the suffix pointed at.
    """
    todo = [(np.arange(len(weights)), 0)]
    while todo:
        p, depth = todo.pop()
        w = weights[p]
        if int(w.sum()) < least:
            continue  # abandoned: nothing in it occurs often enough
        key = columns[depth][p]
        pivot = sorted((key[0], key[len(key) // 2], key[-1]))[1]
        below, same = key < pivot, key == pivot
        if not same.all():
            todo += [(p[below], depth), (p[~(below | same)], depth)]
            p, w = p[same], w[same]
        n = int(w.sum())
        if pivot and n >= least:
            yield int(p[0]), depth + 1, n
            if depth + 1 < len(columns):
                todo.append((p, depth + 1))


def bounds_of(docs: DataFrame, ranges: int, share: float, width: int = WORDS) -> list[tuple]:
    """At most ``ranges`` - 1 suffixes that cut a sample of all suffixes into even ranges, ascending."""
    if ranges < 2:
        return []
    names = [f"w{k}" for k in range(width)]

    def each(batch: pa.RecordBatch):
        rnd, out = np.random.default_rng(int(batch.num_rows)), []
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            for words in stretches(text or ""):
                for at in np.flatnonzero(rnd.random(len(words)) < share).tolist():
                    if words[at] != END:
                        suffix = words[at : at + width]
                        suffix = suffix[: suffix.index(END)] if END in suffix else suffix
                        out.append((lang, *suffix, *[b""] * (width - len(suffix))))
        return dict(zip(["lang", *names], zip(*out))) if out else None

    sample = written(arrow_map(docs, each, "lang string, " + ", ".join(f"{n} binary" for n in names)), "suffix-sample")
    ranged = sample.repartitionByRange(ranges, "lang", *names)
    least = ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("lang", *names)).alias("m")).select("m.*").distinct()
    found = sorted((r[0], *map(bytes, r[1:])) for r in least.collect())  # a row for each range
    return found[1:]


def routed(docs: DataFrame, bounds: list[tuple], width: int = WORDS) -> DataFrame:
    """(range, lang, words, ids, n): packed suffixes, some for each task, range and language."""
    schema = "range int, lang string, words binary, ids binary, n binary"
    shared = docs.sparkSession.sparkContext.broadcast(bounds)

    def run(batches):
        target, held = arrow_schema(schema), Suffixes(shared.value, width)

        def out():
            rows = list(held.packed())
            return [pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), target)], schema=target)] if rows else []

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                more = stretches(text or "")
                words = next(more, None)
                while words is not None:
                    after = next(more, None)
                    held.add(lang, words, after is None)
                    if held.size >= POSITIONS:
                        yield from out()
                    words = after
        yield from out()

    return docs.mapInArrow(run, schema)


def phrase_counts(docs: DataFrame, least: int = LEAST, width: int = WORDS, chars: int = RANGE) -> DataFrame:
    """(lang, phrase, words, n) of every phrase of at most ``width`` words that occurs ``least`` times, and of the empty phrase, whose count is that of all words; ``docs`` has lang and text."""
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    total = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    ranges = -(-total // chars)
    bounds = bounds_of(docs, ranges, min(1.0, SAMPLED * ranges * 4 / max(total, 1)), width)
    schema = "lang string, phrase string, words int, n long"
    shared = docs.sparkSession.sparkContext.broadcast(bounds)

    def count(batches):
        target = arrow_schema(schema)
        for t in grouped_batches(batches, ["range"], 1):
            at, end = t.column("range")[0].as_py(), t.column("range")[t.num_rows - 1].as_py()
            ranges = t.column("range").to_numpy()
            for k in range(at, end + 1):
                a, b = np.searchsorted(ranges, [k, k + 1])
                if b > a:
                    yield from _of_range(t.slice(int(a), int(b - a)), {x for x in (shared.value[k - 1] if k else None, shared.value[k] if k < len(shared.value) else None) if x}, least, width, target)

    packed = routed(docs, bounds, width).repartition(max(1, len(bounds) + 1), "range").sortWithinPartitions("range")
    found = packed.mapInArrow(count, schema).groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))
    return found.where((F.col("n") >= least) | (F.col("words") == 0))


def _of_range(t: pa.Table, edges: set[tuple], least: int, width: int, target: pa.Schema):
    """Batches of the counts of one range; ``edges`` are its bounds, whose beginnings are counted in part."""
    rows: dict[str, list] = {}
    for r in t.select(["lang", "words", "ids", "n"]).to_pylist():
        rows.setdefault(r["lang"], []).append(r)
    for lang, parts in rows.items():
        numbers, blocks, counts = Numbers({b"": 0}), [[] for _ in range(width)], []
        for r in parts:
            own = [b"" if w == END else w for w in r["words"].split(b" ")]
            to = np.fromiter(map(numbers.__getitem__, own), np.int64, len(own))
            for block, c in zip(blocks, to[_wide(r["ids"])].astype(np.int32).reshape(width, -1)):
                block.append(c)
            counts.append(_wide(r["n"]))
        columns, weights, words = [np.concatenate(b) for b in blocks], np.concatenate(counts), list(numbers)
        out = [("", 0, int(weights.sum()))]
        partial = {tuple(numbers.get(w) for w in x[1 : 1 + d]) for x in edges if x[0] == lang for d in range(1, width + 1)}
        partial = {x for x in partial if all(x)}  # words of this range, none after the last
        for x in partial:
            hit = np.ones(len(weights), bool)
            for c, w in zip(columns, x):
                hit &= c == w
            if n := int(weights[hit].sum()):
                out.append((b" ".join(words[w] for w in x).decode(), len(x), n))
        for p, depth, n in count_phrases(columns, weights, least):
            x = tuple(int(c[p]) for c in columns[:depth])
            if x not in partial:
                out.append((b" ".join(words[w] for w in x).decode(), depth, n))
        columns = [[lang] * len(out), *zip(*out)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)


def _decimal(c: Column | int) -> Column:
    return (F.lit(c) if isinstance(c, int) else c).cast("decimal(19,0)")


def score(counts: DataFrame, width: int = WORDS, share: int = SHARE) -> DataFrame:
    """(lang, phrase, words, a, l, r, score, inside) of every phrase of two words and more: its weakest cut, and the greatest count of a longer one that holds it, null if none."""
    cut = F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(k.alias("k"), F.array_join(F.slice("w", 1, k), " ").alias("left"), F.array_join(F.slice("w", k + 1, F.size("w")), " ").alias("right")))
    phrases = counts.where("words > 1").withColumn("w", F.split("phrase", " "))
    cuts = phrases.select("lang", "phrase", "words", F.col("n").alias("a"), F.explode(cut).alias("c")).select("*", "c.*").drop("c")
    known = counts.where(F.col("words").between(1, width - 1))
    both = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    both = both.join(known.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    value = F.expr(f"cast({SCALE} as decimal(8,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    weakest = both.select("lang", "phrase", "words", "a", F.struct(value.alias("score"), "k", "l", "r").alias("m")).groupBy("lang", "phrase", "words", "a").agg(F.min("m").alias("m"))
    at = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda d: F.transform(F.sequence(F.lit(1), F.col("words") - d + 1), lambda i: F.array_join(F.slice("w", i, d), " "))))
    inside = phrases.where("words > 2").select("lang", F.explode(F.array_distinct(at)).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("inside"))
    return weakest.join(inside, ["lang", "phrase"], "left").select("lang", "phrase", "words", "a", "m.l", "m.r", "m.score", "inside")


def collocations(docs: DataFrame, least: int = LEAST, width: int = WORDS, share: int = SHARE, top: int = TOP, chars: int = RANGE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases that no longer one of ``share`` per cent of their count holds."""
    counts = written(phrase_counts(docs, least, width, chars), "phrase-counts")
    best = score(counts, width, share).where(F.col("inside").isNull() | (_decimal(100) * _decimal(F.col("inside")) < _decimal(share) * _decimal(F.col("a"))))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    best = best.withColumn("_s", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_s").orderBy(*order))).where(F.col("rank") <= top)  # what is not first among some is not first of all
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    total = counts.where("words = 0").select("lang", "n")
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL = rf"""
WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS t FROM documents),
ws AS (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM piece),
total AS (SELECT lang, sum(len(w)) AS n FROM ws GROUP BY lang),
gram AS (SELECT lang, array_to_string(w[i:i + d - 1], ' ') AS phrase, d FROM (SELECT lang, w, d, unnest(range(1, len(w) - d + 2)) AS i FROM ws, (SELECT unnest([1, 2, 3, 4]) AS d))),
f AS (SELECT lang, phrase, d, count(*)::HUGEINT AS n FROM gram GROUP BY ALL HAVING count(*) >= {LEAST}),
cand AS (SELECT lang, phrase, d, n, string_split(phrase, ' ') AS w FROM f WHERE d > 1),
cut AS (SELECT c.lang, c.phrase, c.n AS a, l.n AS l, r.n AS r, k, (2000000::HUGEINT * c.n) // (l.n + r.n) AS score
  FROM (SELECT *, unnest(range(1, d)) AS k FROM cand) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:c.d], ' ')),
weak AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
held AS (SELECT lang, array_to_string(w[i:i + e - 1], ' ') AS phrase, max(n) AS inside
  FROM (SELECT *, unnest(range(1, d - e + 2)) AS i FROM (SELECT *, unnest(range(2, d)) AS e FROM cand)) GROUP BY ALL),
best AS (SELECT weak.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM weak LEFT JOIN held USING (lang, phrase) WHERE inside IS NULL OR 100 * inside < {SHARE} * a)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM best JOIN total USING (lang) WHERE rank <= {TOP}
"""
