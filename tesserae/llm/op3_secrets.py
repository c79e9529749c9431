"""Operator 3: secret scans with structural confirmation.

Base spans are patterns. The method looks at runs of base64 or hexadecimal letters, decodes them and reports a span only
if the bytes have the structure of a secret: a DER key whose nested lengths close exactly, an OpenSSH private key whose
length-prefixed fields fill it, or a signed token whose header and payload are JSON objects with an algorithm.

Kinds beside the base ones: ``der`` (PKCS#1, PKCS#8 or SEC1 private key), ``openssh``, ``jwt``. A base64 block may run
over several lines; a key in it begins at a line and ends where its own lengths say, which has to be the end of a line or
of the block, or armour ("-----"), so that text before or after it in the same letters does not hide it. Lines may be indented,
marked as comments or quotations, followed by blanks, broken by an escaped line end (backslash and n, as in JSON), or be string literals
one after the other, joined by a sign or not; lines of forty letters and more may have a blank alone between them. A key in hexadecimal letters may
begin anywhere in them. All searches take time in proportion to the text.

Defined results: a null or empty text has no spans, its digest is that of an empty string. Positions are code points,
ends exclusive. Rows are independent; a null doc_id is carried; columns beside doc_id and text have no effect; texts are
scanned whole. Spans of the method may overlap base spans; base spans stay.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tesserae.llm.common import arrow_map, table, texts

ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "der", "jwt", "openssh")

RUN = re.compile(r"[A-Za-z0-9_.-]+")
BLOCK = re.compile(r"[A-Za-z0-9+/_-]{40,}+")
LINE = re.compile(r"[A-Za-z0-9+/_-]{1,76}+(?![A-Za-z0-9+/_-])")
#: What may stand between two lines of a block: a line end with blanks and marks around it, or the ends of two string literals.
GAP = re.compile(r"""(?>(?:\\*+["']?+[\x20\t\r]*+(?:[+,&.\\][\x20\t\r]*+)?+\n[\x20\t]*+(?:[#>*|;][\x20\t]*+)?+(?:[+.][\x20\t]*+(?=["']))?+["']?+)+|["'][\x20\t]*+(?:[+.,][\x20\t]*+)?+["'])""")
PADDING = re.compile("={0,2}")
HEXES = re.compile(r"[0-9A-Fa-f]{64,}")
#: A sequence whose first item is version 0 or 1, as all keys looked for begin.
HEX_KEY = re.compile(r"30(?:[0-7][0-9A-Fa-f]|81..|82....|83......)02010[01]")


def assign_spans(text: str, lower: str) -> list[tuple[int, int, str]]:
    if not ("pass" in lower or "secret" in lower or "token" in lower or "api" in lower):
        return []
    return [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 6]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The base kinds, by start and then kind as listed."""
    lower = text.lower()
    found = assign_spans(text, lower)
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tag and content of each item of a DER sequence body; None unless the lengths close exactly."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 128:
            n = size & 127
            if not 1 <= n <= 4 or at + n > len(data):
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
            if size < 128:
                return None  # not the shortest form
        if at + size > len(data):
            return None
        out.append((tag, data[at : at + size]))
        at += size
    return out


def der_size(head: bytes) -> int | None:
    """The bytes of the item that begins with ``head``."""
    if len(head) < 2 or not head[1] & 128:
        return 2 + head[1] if len(head) > 1 else None
    n = head[1] & 127
    return 2 + n + int.from_bytes(head[2 : 2 + n], "big") if 1 <= n <= 4 and len(head) >= 2 + n else None


#: Algorithm identifiers of RSA and elliptic-curve keys, and of the keys of the given sizes that are plain octets.
RSA, EC = bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a8648ce3d0201")
OCTET_KEYS = {bytes.fromhex("2b656e"): 32, bytes.fromhex("2b656f"): 56, bytes.fromhex("2b6570"): 32, bytes.fromhex("2b6571"): 57}


def is_pkcs1(items: list[tuple[int, bytes]]) -> bool:
    """A version and at least eight positive integers."""
    return len(items) >= 9 and all(t == 2 for t, _ in items[:9]) and items[0][1] in (b"\0", b"\1") and all(v and not v[0] & 128 for _, v in items[:9])


def is_sec1(items: list[tuple[int, bytes]]) -> bool:
    """Version 1, a private number of 20 to 66 bytes, and closed tagged fields."""
    return [t for t, _ in items[:2]] == [2, 4] and items[0][1] == b"\1" and 20 <= len(items[1][1]) <= 66 and all(t in (0xA0, 0xA1) and der_items(v) is not None for t, v in items[2:])


def is_pkcs8(items: list[tuple[int, bytes]]) -> bool:
    """A version, an algorithm, and an octet string that holds the key which the algorithm asks for."""
    if [t for t, _ in items[:3]] != [2, 0x30, 4] or items[0][1] not in (b"\0", b"\1") or any(t not in (0xA0, 0xA1, 0x81) for t, _ in items[3:]):
        return False
    algorithm, inner = der_items(items[1][1]), der_items(items[2][1])
    if not algorithm or algorithm[0][0] != 6 or not inner or len(inner) != 1:
        return False
    (oid, (tag, value)) = algorithm[0][1], inner[0]
    if oid in (RSA, EC):
        fields = der_items(value) if tag == 0x30 else None
        return bool(fields) and (is_pkcs1 if oid == RSA else is_sec1)(fields)
    return tag == 4 and len(value) == OCTET_KEYS[oid] if oid in OCTET_KEYS else tag in (2, 4, 0x30)


def is_der_key(data: bytes) -> bool:
    """A PKCS#1, PKCS#8 or SEC1 private key: one sequence, closed exactly, with the fields of one of them."""
    top = der_items(data)
    if not top or len(top) != 1 or top[0][0] != 0x30 or not (items := der_items(top[0][1])):
        return False
    return is_pkcs1(items) or is_pkcs8(items) or is_sec1(items)


def is_openssh_key(data: bytes) -> bool:
    """An OpenSSH private key: magic, three named fields, a count, and as many public keys and one private block to the end."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)

    def field() -> bytes | None:
        nonlocal at
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        at += 4 + size
        return data[at - size : at]

    for _ in range(3):
        if field() is None:
            return False
    count, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    return 1 <= count <= 16 and all(field() is not None for _ in range(count + 1)) and at == len(data)


def unbase64(text: str) -> bytes | None:
    plain = re.sub(r"[\r\n=]", "", text).replace("-", "+").replace("_", "/")
    if len(plain) % 4 == 1:
        return None
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except binascii.Error:
        return None


MAGIC = "b3BlbnNzaC1rZXktdjE"


def key_letters(plain: str, at: int) -> int | None:
    """How many base64 letters the key that begins at ``at`` has by its own lengths; only the lengths are decoded."""

    def read(a: int, n: int) -> bytes:
        got = unbase64(plain[at + a // 3 * 4 : at + (a + n + 2) // 3 * 4]) or b""
        return got[a % 3 : a % 3 + n]

    if plain.startswith(MAGIC, at):
        size = 15
        for step in range(3):
            if len(n := read(size, 4)) < 4:
                return None
            size += 4 + int.from_bytes(n, "big")
        if not 1 <= (count := int.from_bytes(read(size, 4), "big")) <= 16:
            return None
        size += 4
        for step in range(count + 1):
            if len(n := read(size, 4)) < 4:
                return None
            size += 4 + int.from_bytes(n, "big")
    elif plain[at] == "M":
        head = read(0, 9)
        if not head or head[0] != 0x30 or (size := der_size(head)) is None:
            return None
        begin = 2 + (head[1] & 127 if head[1] & 128 else 0)
        if read(begin, 3) not in (b"\2\1\0", b"\2\1\1"):
            return None
    else:
        return None
    return -(-size * 4 // 3)


def blocks(text: str):
    """The (start, end) of the lines of each base64 block, and where it ends."""
    if "\\" in text:
        text = text.replace("\\n", " \n").replace("\\r", "  ")  # every place stays
    at = 0
    while m := BLOCK.search(text, at):
        lines, at = [m.span()], m.end()
        while True:
            gap = GAP.match(text, at)
            if not gap and text[at : at + 1] == " " and at - lines[-1][0] >= 40:
                nxt = LINE.match(text, at + 1)
            else:
                nxt = gap and LINE.match(text, gap.end())
            if not nxt:
                break
            lines.append(nxt.span())
            at = nxt.end()
        at = PADDING.match(text, at).end()
        yield lines, at


def block_keys(text: str, lines: list[tuple[int, int]], end: int) -> list[tuple[int, int, str]]:
    """The keys in one base64 block: each begins at a line and ends at the end of a line or at armour."""
    plain = "".join(text[a:b] for a, b in lines)
    begins, ends, n = [], {}, 0  # letters before a place, and the place
    for a, b in lines:
        begins.append((n, a))
        at = text.find("-----", a + 1, b)
        while at >= 0:
            ends[n + at - a] = at
            at = text.find("-----", at + 1, b)
        n += b - a
        ends[n] = b
    ends[n] = end  # with its padding
    found, done = [], 0
    for n, a in begins:
        if n < done or (size := key_letters(plain, n)) is None or n + size not in ends or plain.find("-----", n, n + size) >= 0 or not (data := unbase64(plain[n : n + size])):
            continue
        if kind := "openssh" if is_openssh_key(data) else "der" if is_der_key(data) else None:
            done = n + size
            found.append((a, ends[done], kind))
    return found


def hex_keys(text: str, start: int) -> list[tuple[int, int, str]]:
    """The keys in a run of hexadecimal letters; each letter of it is decoded twice, for even and odd places."""
    both, found, done = {}, [], 0
    for m in HEX_KEY.finditer(text):
        at = m.start()
        if at < done:
            continue
        if (odd := at % 2) not in both:
            both[odd] = memoryview(bytes.fromhex(text[odd : len(text) - (len(text) - odd) % 2]))
        data = both[odd][at // 2 :]
        size = der_size(bytes(data[:6]))
        if size and size <= len(data) and is_der_key(data[:size]):
            done = at + 2 * size
            found.append((start + at, start + done, "der"))
    return found


JSON = json.JSONDecoder()


def header_start(segment: str) -> int | None:
    """Where in ``segment`` a base64 header begins that goes to its end: a JSON object with an algorithm.

    The letters are decoded once for each place modulo four. Where a parse has failed, objects that begin before that
    place would fail there too, so each is read once.
    """
    decoded, failed, at = {}, {}, segment.find("eyJ")
    while at >= 0:
        phase = at % 4
        if phase not in decoded:
            decoded[phase] = (unbase64(segment[phase:]) or b"").decode("latin-1")
        data, k = decoded[phase], (at - phase) // 4 * 3
        if data and k >= failed.get(phase, 0):
            try:
                head, end = JSON.raw_decode(data, k)
                if not data[end:].strip() and isinstance(head.get("alg"), str):
                    return at
                failed[phase] = end
            except json.JSONDecodeError as e:
                failed[phase] = e.pos
            except RecursionError:
                pass
        at = segment.find("eyJ", at + 1)
    return None


def is_object(segment: str) -> bool:
    try:
        return isinstance(json.loads(unbase64(segment) or b""), dict)
    except (ValueError, RecursionError):
        return False


def signed_tokens(text: str, start: int) -> list[tuple[int, int, str]]:
    """The signed tokens in a run of letters and dots: a header, a payload that is a JSON object, and a signature, empty only if the algorithm is none."""
    parts, found, k = text.split("."), [], 0
    ends, at = [], start
    for p in parts:
        ends.append(at := at + len(p))
        at += 1
    while k + 2 < len(parts):
        head, payload, signature = parts[k : k + 3]
        if payload and "eyJ" in head and (a := header_start(head)) is not None and is_object(payload):
            none = JSON.raw_decode((unbase64(head[a:]) or b"").decode("latin-1"))[0]["alg"] == "none"
            if unbase64(signature) is not None if signature else none:
                found.append((ends[k] - len(head) + a, ends[k + 2], "jwt"))
                k += 3
                continue
        k += 1
    return found


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """What the method adds: candidates that decode to the structure of a secret."""
    found = []
    if "eyJ" in text:
        at = 0
        while (k := text.find("eyJ", at)) >= 0:
            run = RUN.match(text, k)
            found += signed_tokens(run[0], k)
            at = run.end()
    for lines, end in blocks(text):
        found += block_keys(text, lines, end)
    for m in HEXES.finditer(text):
        found += hex_keys(m[0], m.start())
    return found


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to counts, the digest of the base spans, and all spans."""

    def each(batch: pa.RecordBatch):
        out: dict = {"doc_id": batch.column("doc_id"), "n_assign": [], "n_access": [], "n_hex": [], "base_sha256": [], "spans": []}
        for text in texts(batch):
            base = base_spans(text)
            for kind in KINDS[:3]:
                out[f"n_{kind}"].append(sum(k == kind for *_, k in base))
            out["base_sha256"].append(sha256(joined(base).encode()).hexdigest())
            every = sorted({*base, *confirmed_spans(text)}, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))
            out["spans"].append(joined(every))
        return out

    return arrow_map(docs.select("doc_id", "text"), each, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


#: Leftmost matching with positions and decoding is not SQL; tests/llm/test_ops.py has the brute force.
SQL = None
