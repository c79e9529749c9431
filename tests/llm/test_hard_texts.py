"""Texts that are long, repetitive or wrapped, for secrets and benchmark items."""

import json
import random
import time
import tracemalloc
from base64 import b64encode

import pytest

from tesserae.llm import op2_license, op3_secrets, op5_decontam, op8_tokens


def der(tag, data):
    n = len(data)
    size = bytes([n]) if n < 128 else bytes([128 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + data


def rsa(extra):
    return der(0x30, der(2, b"\0") + b"".join(der(2, bytes([1 + k]) * k) for k in (64, 3, 64, 32, 32, 32, 32, 30 + extra)))


#: How the lines of a key are joined, and what stands around it.
WRAPPINGS = {
    "plain": ("\n", "", ""),
    "json": ("\\n", '{"key": "-----BEGIN PRIVATE KEY-----\\n', '\\n-----END PRIVATE KEY-----\\n"}'),
    "json in json": ("\\\\n", '{"a": "{\\"key\\": \\"-----BEGIN PRIVATE KEY-----\\\\n', '\\\\n-----END'),
    "json crlf": ("\\r\\n", '"-----BEGIN PRIVATE KEY-----\\r\\n', "\\r\\n-----END"),
    "indented": ("\n    ", "key: |\n    -----BEGIN PRIVATE KEY-----\n    ", "\n    -----END PRIVATE KEY-----\nnext: 1"),
    "tabs": ("\n\t", "\t", "\n"),
    "trailing blanks": ("  \n", "-----BEGIN PRIVATE KEY-----  \n", "  \n-----END"),
    "trailing crlf": (" \r\n", "x:\r\n", "\r\n"),
    "literals": ('"\n    "', 'key = ("', '")'),
    "joined literals": ('" +\n  "', 'String k = "', '";'),
    "joined with line ends": ('\\n" +\n  "', 'k = "-----BEGIN PRIVATE KEY-----\\n" +\n  "', '\\n" +\n  "-----END PRIVATE KEY-----";'),
    "sign first": ('"\n  + "', 'k = "', '"'),
    "same line": ("' + '", "k = '", "'"),
    "backslash": ("\\\n", 'k = "', '"'),
    "comment": ("\n# ", "# ", "\n# end"),
    "quoted mail": ("\n> ", "> ", "\n> bye"),
    "blanks alone": (" ", "-----BEGIN PRIVATE KEY----- ", " -----END PRIVATE KEY-----"),
}


@pytest.mark.parametrize("extra", range(3))
@pytest.mark.parametrize("name", WRAPPINGS)
def test_wrapped_keys(name, extra):
    gap, before, after = WRAPPINGS[name]
    letters = b64encode(rsa(extra)).decode()
    body = gap.join(letters[k : k + 64] for k in range(0, len(letters), 64))
    assert op3_secrets.confirmed_spans(before + body + after) == [(len(before), len(before) + len(body), "der")]
    broken = body[:100] + ("A" if body[100] != "A" else "B") + body[101:-12]
    assert op3_secrets.confirmed_spans(before + broken + after) == []


@pytest.mark.parametrize("before", ["", "a", "ab", "abc30", "3", "0x"])
def test_hexadecimal_keys_anywhere(before):
    for extra in range(2):
        body = rsa(extra).hex()
        for text in (body, body.upper()):
            at = len("x: " + before)
            assert op3_secrets.confirmed_spans(f"x: {before}{text}7f {text}") == [(at, at + len(text), "der"), (at + len(text) + 3, at + 2 * len(text) + 3, "der")]
    assert op3_secrets.confirmed_spans(rsa(0).hex()[:-2]) == []


def test_tokens_in_runs():
    part = lambda x: b64encode(json.dumps(x).encode()).decode().rstrip("=").replace("+", "-").replace("/", "_")
    head, body = part({"alg": "HS256", "é": "ü"}), part({"sub": 1})
    token, bare = f"{head}.{body}.{part('signed')}", f"{part({'alg': 'none'})}.{body}."
    for before in ("", "x=", "eyJ", "a.b.", "eyJhIjoxfQ.", "eyJeyJ", "k"):
        for t in (token, bare):
            assert op3_secrets.confirmed_spans(f"{before}{t}") == [(len(before), len(before) + len(t), "jwt")]
    assert [s[:2] for s in op3_secrets.confirmed_spans(f"{token} {token}.{token}")] == [(0, len(token)), (len(token) + 1, 2 * len(token) + 1), (2 * len(token) + 2, 3 * len(token) + 2)]
    for bad in (f"{part({'alg': 1})}.{body}.x", f"{head}.{part([1])}.xx", f"{head}.{body}.", f"{head}..xx", f"{head}.{body}"):
        assert op3_secrets.confirmed_spans(bad) == []


def test_long_texts_take_their_share_of_time():
    """Ten times the text takes some ten times the time, not a hundred: ten megabytes of a mail attachment in seconds."""
    rnd = random.Random(2)
    texts = {
        "lines": "\n".join(b64encode(rnd.randbytes(57)).decode() for _ in range(130_000)),
        "key lines": "\n".join("MIIEowIBAAKC" + "A" * 64 for _ in range(100_000)),
        "token beginnings": "eyJ" * 300_000,
        "open objects": "eyJhIjp7" * 40_000 + ".eyJhIjoxfQ.x",
        "hexadecimal beginnings": "3083ffffff020100" * 100_000,
        "blanks": ("A" * 60 + " \t" * 50_000 + "\n") * 10,
        "empty lines": "A" * 60 + "\n \n" * 300_000,
    }
    for name, text in texts.items():
        began = time.process_time()
        assert op3_secrets.confirmed_spans(text) == []
        assert time.process_time() - began < 12, name  # one to three seconds; a quadratic search takes minutes


def test_repeats_of_words_that_begin_a_license():
    """Each start walks a few steps that are looked up: two megabytes of one word in seconds."""
    automata = op2_license.compiled(op2_license.TEMPLATES)
    for text in ("copyright " * 200_000, "redistribution and use in " * 60_000, "permission is hereby granted " * 50_000):
        began = time.process_time()
        op2_license.scan(text, automata)
        assert time.process_time() - began < 12, text[:30]


def edits(item, text):
    """The least edits of an item in a text, by the whole table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, row[0] = row[0], i
        for j in range(1, len(text) + 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != text[j - 1]))
    return min(row)


REPETITIVE = {
    "equal signs": (["=" * 400], lambda r: "".join("=" * r.randrange(1, 600) + r.choice("abc") for _ in range(1700))),
    "dashes": (["question " + "-" * 200 + " answer", "a second item of some length"], lambda r: "\n".join("-" * r.randrange(60, 157) + f" {k}" for k in range(4000))),
    "zeros": (["0 " * 150], lambda r: "\n".join(" ".join("0" for _ in range(r.randrange(1, 90))) + f" x{k}" for k in range(6000))),
}


@pytest.mark.parametrize("name", REPETITIVE)
def test_repetitive_texts(name):
    """Long texts of many common stretches, of which a part belongs to no item."""
    items, make = REPETITIVE[name]
    text = op5_decontam.normal(make(random.Random(7)))
    index = op5_decontam.Index(list(enumerate(items)))
    got = {index.names(i)[0]: e for i, *_, e in index.occurrences(text)}
    for i, x in enumerate(op5_decontam.normal(t) for t in items):
        exact = x in text
        assert not exact or got.get(i) == 0
        if i in got:
            assert got[i] <= op5_decontam.budget(len(x))


@pytest.mark.parametrize("n_items", [1, 2, 7])
@pytest.mark.parametrize("name", REPETITIVE)
def test_repetitive_texts_by_brute_force(monkeypatch, name, n_items):
    """Any number of items and few stretches at a time; parts that hold no item are empty."""
    monkeypatch.setattr(op5_decontam, "STRETCHES", 50)
    rnd = random.Random(n_items)
    items, make = REPETITIVE[name]
    items = (items + ["an item that is not there at all", "ab" * 40, "~" * 30, "nor this one, which is longer", "12 34 56 78 90 12 34", "zz zz zz zz zz zz"])[:n_items]
    whole = op5_decontam.normal(make(rnd))
    for size in (300, 1500):
        text = whole[:size]
        index = op5_decontam.Index(list(enumerate(items)))
        got = {index.names(i)[0]: e for i, *_, e in index.occurrences(text)}
        normal = [op5_decontam.normal(t) for t in items]
        assert got == {i: e for i, x in enumerate(normal) if (e := edits(x, text)) <= op5_decontam.budget(len(x))}


def test_pipeline_stage_with_a_repetitive_page(spark, tmp_path):
    import corpus_pipeline as p

    spark.createDataFrame([(0, "=" * 400), (1, "a question of the benchmark, word for word")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    page = REPETITIVE["equal signs"][1](random.Random(1))  # some run of signs is the item but for a letter
    rule = "\n".join("=" * 11 + f" {k}" for k in range(30_000))
    docs = spark.createDataFrame([(1, page), (2, "x " * 50 + "a question of the benchmark, word for word"), (3, "clean"), (4, rule)], "doc_id long, text string")
    assert {r.doc_id for r in dict(p.STAGES)["decontamination"](spark, docs, str(tmp_path)).collect()} == {3, 4}


@pytest.fixture(scope="module")
def encoder():
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        return op8_tokens.Encoder(f.read())


def test_long_texts_are_encoded_in_portions(encoder, monkeypatch):
    """Cuts at white space change no ids: contractions, special tokens, combining marks, runs without white space, and texts of white space alone."""
    rnd = random.Random(5)
    pieces = ["it's", "we'll", "'s", "12", "naïve", "é", "́x", "日本", "<|endoftext|>", "!?", "a" * 70, "x" * 9, "ΟΔΟΣ", " ", "\n", "\t", " ", "\x85"]
    many = ["".join(rnd.choice(pieces) + rnd.choice(["", " ", "\n", "  \n"]) for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    many += ["", " ", " " * 200, "\n" * 65, "z" * 300, "z" * 64, "z" * 65, " " + "z" * 64, "z" * 64 + " ", "z" * 100 + " y", "a b " * 100]
    want = [x.ids for x in encoder.tokenizer.encode_batch_fast(many, add_special_tokens=False)]
    for size in (1, 2, 7, 64):
        monkeypatch.setattr(op8_tokens, "BLOCK_CHARS", size)
        assert [x.tolist() for x in encoder.encode_many(many)] == want
        for text in many:
            cut = op8_tokens.portions(text, size)
            assert "".join(cut) == text and all(p[0] in " \n" for p in cut[1:])
            assert all(len(p) <= size or not {" ", "\n"} & {*p[1:]} for p in cut)


def test_memory_of_one_long_text(encoder):
    """Four times the text takes but its own ids more: the work of a portion is freed before the next one."""
    rnd = random.Random(6)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9))) for _ in range(50_000)]
    peaks = []
    for n in (400_000, 1_600_000):
        text = " ".join(rnd.choice(words) for _ in range(n))
        tracemalloc.start()
        (ids,) = encoder.encode_many([text])
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert ids.nbytes < 4 * len(text)
    assert peaks[1] - peaks[0] < 10 * 1_200_000 * 6.5, peaks  # of 1.2 M words of 6.5 characters; before, 60 bytes a character
