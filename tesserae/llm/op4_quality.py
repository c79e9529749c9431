"""Operator 4: quality rules with line sequence labelling.

Lines of a text are labelled content or boilerplate by Viterbi decoding of a linear-chain conditional random field, and
the share of word characters in content lines decides retention, together with the base rules. A line is described by
its looks and by whether it is boilerplate of its host (operator 7: on more than a tenth of the host's distinct pages).

The field is trained on sequences that change label. A line of a document of quality 0 is boilerplate; a line of a document
of quality 1 is content unless it is boilerplate of its host; and a document of quality 1 is used a second time with
stretches of lines of documents of quality 0 spliced in before, after and within, and without the mark of its host, so
that the moves between labels and the looks alone are learnt too. The sample is bounded and documented: :data:`SAMPLE` documents of each
quality, those of least hash of doc_id, and of each a stretch of :data:`SAMPLE_LINES` lines from a place chosen by hash.

Words are runs of characters other than the six ASCII white-space characters.

Defined results: a null or empty text has no words, hence base_failed and not kept. Where no document is labelled with
both qualities the field knows nothing and its verdict is to keep. A null host is a host of its own. Rows of one doc_id
are judged each by its own text, and count once in training, by their least text; a null doc_id is carried; columns
beside doc_id, text and the host have no effect; texts are labelled whole.
"""

from __future__ import annotations

import string
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import arrow_map, table, texts
from tesserae.llm.op7_lines import marked_lines

SAMPLE = 1500
SAMPLE_LINES = 32
KEEP_SHARE = 0.5
#: Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
MIN_WORDS, WINDOW, REPEAT_PERCENT = 10, 5, 20

_UPPER, _DIGIT = string.ascii_uppercase.encode(), string.digits.encode()
_PUNCT = bytes(b for b in string.punctuation.encode() if b not in b".,;:'\"-()?")
_TAILS = bytes(range(0x80, 0xC0))  # the bytes of UTF-8 that begin no code point


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of five that occur twice or more in the text."""
    n = len(words)
    if n <= WINDOW:
        return 0
    number: dict[bytes, int] = {}
    a = np.array([number.setdefault(w, len(number)) for w in words])
    if len(number) == n:
        return 0
    pairs = np.unique(a[:-1] * len(number) + a[1:], return_inverse=True)[1]
    fours = np.unique(pairs[:-2] * (n + 1) + pairs[2:], return_inverse=True)[1]
    _, which, count = np.unique(fours[:-1] * (n + 1) + a[WINDOW - 1 :], return_inverse=True, return_counts=True)
    hit = np.zeros(n + 1, np.int64)
    twice = np.flatnonzero(count[which] > 1)
    np.add.at(hit, twice, 1)
    np.add.at(hit, twice + WINDOW, -1)
    return int((np.cumsum(hit)[:n] > 0).sum())


def base_rules(text: str) -> dict:
    raw = text.encode()
    words = raw.split()
    seen: set[bytes] = set()
    doubled = 0
    for line in raw.split(b"\n"):
        if line in seen:
            doubled += 1
        elif line.strip():
            seen.add(line)
    repeated = repeated_words(words)
    return {
        "n_words": len(words), "word_chars": len(raw.translate(None, SPACES + _TAILS)), "n_symbols": len(raw) - len(raw.translate(None, SYMBOLS)),
        "n_dup_lines": doubled, "n_repeat_words": repeated, "base_failed": len(words) < MIN_WORDS or 100 * repeated > REPEAT_PERCENT * len(words),
    }


FEATURES = 15
HOST = FEATURES - 1


def line_features(raw: bytes, marks: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A row of features and the number of word characters, for each line with a word; ``marks`` has a 1 for each line that is its host's boilerplate."""
    rows, sizes, seen = [], [], set()
    lines = raw.split(b"\n")
    for line, mark in zip(lines, marks or "0" * len(lines)):
        words = line.split()
        if not words:
            continue
        size = sum(map(len, words))
        chars = size - (len(line) - len(line.translate(None, _TAILS)))
        upper = size - len(line.translate(None, _UPPER + SPACES))
        symbols = size - len(line.translate(None, SYMBOLS + SPACES))
        rare = size - len(line.translate(None, _PUNCT + SPACES))
        digits = size - len(line.translate(None, _DIGIT + SPACES))
        distinct = len(set(words)) / len(words)
        mean = chars / len(words)
        rows.append((1.0, min(len(words), 100) / 100, len(words) < 4, symbols / size > 0.02, symbols / size, upper / size > 0.3, upper / size, rare / size, digits / size, distinct < 0.5 and len(words) > 8, distinct, min(mean, 20) / 20, line in seen, words[-1][-1:] in b".!?:;\"'", mark == "1"))
        sizes.append(chars)
        seen.add(line)
    return np.array(rows, float).reshape(-1, FEATURES), np.array(sizes, float)


def viterbi(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best labels (1: content) for rows of scores of (boilerplate, content); ties go to content."""
    m00, m01, m10, m11 = moves.ravel().tolist()
    a, b = scores[0].tolist()
    came = []
    for s0, s1 in scores[1:].tolist():
        c0, c1 = b + m10 >= a + m00, b + m11 >= a + m01
        came.append((c0, c1))
        a, b = (b + m10 if c0 else a + m00) + s0, (b + m11 if c1 else a + m01) + s1
    out = [b >= a]
    for pair in reversed(came):
        out.append(pair[out[-1]])
    return np.array(out[::-1], bool)


def sequences(sample: list[tuple[int, np.ndarray]], seed: int = 0) -> tuple[list[np.ndarray], list[np.ndarray], list[float]]:
    """Features, label of every line (1: content) and weight of the training sequences made of (quality, features of a document)."""
    rng = np.random.default_rng(seed)
    good, bad = ([f for q, f in sample if q == y] for y in (1, 0))
    x, y, weight = [], [], []
    for f in bad:
        x.append(f)
        y.append(np.zeros(len(f), int))
        weight.append(1 / len(bad))
    for f in good:
        x.append(f)
        y.append(1 - f[:, HOST].astype(int))
        weight.append(0.5 / len(good))
        plain = f.copy()
        plain[:, HOST] = 0
        at = int(rng.integers(0, len(f) + 1))
        parts, labels = [], []
        for part in (None, plain[:at], None, plain[at:], None):
            if part is not None:
                label = 1 - f[len(f) - len(part) :, HOST] if len(labels) > 2 else 1 - f[: len(part), HOST]
            else:
                other = bad[int(rng.integers(len(bad)))]
                size, begin = int(rng.integers(0, 5)), int(rng.integers(len(other)))
                part = other[begin : begin + size].copy()
                part[:, HOST] = 0
                label = np.zeros(len(part))
            parts.append(part)
            labels.append(label.astype(int))
        x.append(np.concatenate(parts)[: 2 * SAMPLE_LINES])
        y.append(np.concatenate(labels)[: 2 * SAMPLE_LINES])
        weight.append(0.5 / len(good))
    return x, y, weight


def train(features: list[np.ndarray], labels: list[np.ndarray], weights: list[float], steps: int = 150, rate: float = 0.2, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights (2, FEATURES) and moves (2, 2) of greatest conditional likelihood of the labels of lines, by gradient ascent with Adam.

    Forward and backward sums run over all sequences at once, longest first: the lines at one place of all sequences that
    reach it stand together, so no row is a filler.
    """
    order = sorted(range(len(features)), key=lambda k: -len(features[k]))
    most = len(features[order[0]])
    reach = [sum(len(f) > t for f in features) for t in range(most)]
    at = np.cumsum([0, *reach])
    x = np.concatenate([features[k][t][None] for t in range(most) for k in order[: reach[t]]])
    y = np.array([labels[k][t] for t in range(most) for k in order[: reach[t]]])
    which = np.concatenate([np.arange(n) for n in reach])
    by = np.array([weights[k] for k in order])[which][:, None]
    later = np.arange(at[1], at[-1])
    before = np.concatenate([np.zeros(0, int), *(at[t - 1] + np.arange(reach[t]) for t in range(1, most))])
    gold = np.eye(2)[y]
    moved = np.zeros((2, 2))
    np.add.at(moved, (y[before], y[later]), by[later, 0])
    theta, m, v = np.zeros(2 * FEATURES + 4), 0.0, 0.0
    for step in range(1, steps + 1):
        w, moves = theta[: 2 * FEATURES].reshape(2, FEATURES), theta[2 * FEATURES :].reshape(2, 2)
        s = x @ w.T
        fore, back = s.copy(), np.zeros_like(s)
        for t in range(1, most):
            was, now = fore[at[t - 1] : at[t - 1] + reach[t]], slice(at[t], at[t + 1])
            fore[now] += np.stack([np.logaddexp(was[:, 0] + moves[0, j], was[:, 1] + moves[1, j]) for j in (0, 1)], 1)
        for t in range(most - 1, 0, -1):
            then = s[at[t] : at[t + 1]] + back[at[t] : at[t + 1]]
            back[at[t - 1] : at[t - 1] + reach[t]] = np.stack([np.logaddexp(then[:, 0] + moves[i, 0], then[:, 1] + moves[i, 1]) for i in (0, 1)], 1)
        total = np.logaddexp.reduce(s[: reach[0]] + back[: reach[0]], axis=1)
        p = np.exp(fore + back - total[which][:, None])
        pairs = np.exp(fore[before][:, :, None] + moves + (s + back)[later][:, None, :] - total[which[later]][:, None, None])
        up = np.concatenate([(((gold - p) * by).T @ x).ravel(), (moved - (pairs * by[later][..., None]).sum(0)).ravel()]) / 8 - decay * theta
        m, v = 0.9 * m + 0.1 * up, 0.99 * v + 0.01 * up * up
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return theta[: 2 * FEATURES].reshape(2, FEATURES), theta[2 * FEATURES :].reshape(2, 2)


def stretch(f: np.ndarray, text: str) -> np.ndarray:
    """A stretch of :data:`SAMPLE_LINES` lines, its place chosen by a hash of the text."""
    spare = len(f) - SAMPLE_LINES
    return f if spare <= 0 else f[(at := zlib.crc32(text.encode()) % (spare + 1)) : at + SAMPLE_LINES]


def fit(marked: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray] | None:
    """The field, from (doc_id, text, marks) of at most ``sample`` documents of each quality; None if one quality has none."""
    known = labels.select("doc_id", "quality").where("doc_id is not null")
    chosen = None
    for q in (0, 1):
        part = known.where(F.col("quality") == q).groupBy("doc_id").agg(F.max("quality").alias("q")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.union(part)

    def each(batch: pa.RecordBatch):
        found = [(q, stretch(line_features(t.encode(), m)[0], t)) for t, m, q in zip(texts(batch), batch.column("marks").to_pylist(), batch.column("q").to_pylist())]
        found = [(q, f) for q, f in found if len(f)]
        return {"q": [q for q, _ in found], "f": [f.ravel().tolist() for _, f in found]}

    once = marked.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", F.col("q").cast("long").alias("q")).agg(F.min(F.struct("text", "marks")).alias("m"))
    rows = arrow_map(once.select("q", "m.text", "m.marks"), each, "q long, f array<double>").collect()  # at most 2 * sample rows, a doc_id once for each quality
    rows = [(q, np.array(f).reshape(-1, FEATURES)) for q, f in sorted((r.q, tuple(r.f)) for r in rows)]
    if len({q for q, _ in rows}) < 2:
        return None
    return train(*sequences(rows))


def label_lines(text: str, field: tuple[np.ndarray, np.ndarray], marks: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each line with a word: whether it is content, and its word characters."""
    f, size = line_features(text.encode(), marks)
    return (viterbi(f @ field[0].T, field[1]), size) if len(f) else (np.zeros(0, bool), size)


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_content_lines long, n_boilerplate_lines long, content_share double"


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, keep_share: float = KEEP_SHARE, host: str = "source") -> DataFrame:
    """(doc_id, text, host) to the base counts, the labelled lines, the content share (null where nothing was learnt) and the verdict."""
    marked = marked_lines(docs.select("doc_id", "text", host), "text", host)
    field = fit(marked, labels, sample)

    def each(batch: pa.RecordBatch):
        rows = []
        for text, marks in zip(texts(batch), batch.column("marks").to_pylist()):
            row, lines, rest, share = base_rules(text), None, None, None
            if field is not None:
                content, size = label_lines(text, field, marks)
                lines, share = int(content.sum()), float(size[content].sum() / size.sum()) if len(size) else 0.0
                rest = len(content) - lines
            rows.append(row | {"kept": not row["base_failed"] and (share is None or share >= keep_share), "n_content_lines": lines, "n_boilerplate_lines": rest, "content_share": share})
        return {k: [r[k] for r in rows] for k in rows[0]} | {"doc_id": batch.column("doc_id")}

    return arrow_map(marked.select("doc_id", "text", "marks"), each, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: A trained field is not SQL; tests/llm/test_ops.py has the brute force of the base columns and held-out accuracy.
SQL = None
