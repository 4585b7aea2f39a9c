"""Secret scans with structural confirmation.

Patterns name assignments, access ids and long hex strings. Beyond them, runs of base64 or hexadecimal characters are candidates for
what no pattern can tell: a candidate is decoded and parsed, and is reported only where it is the encoding of a private key
(nested tags and lengths that fill each other exactly) or a signed token (a header that names its algorithm, a signature of that
algorithm's length). Armour, line breaks inside a candidate and encodings inside encodings are followed.
"""

from __future__ import annotations

import binascii
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genolith.llm.common import bound_batches

#: Kinds by pattern, then those that only parsing finds; spans with the same start are given in this order.
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "key", "token")
#: Shortest candidate in characters, and how many encodings inside encodings are followed.
LEAST, DEPTH = 32, 3

_ASSIGN = re.compile("(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{32,}")
#: Line breaks inside a candidate, as they are or written as an escape.
_BREAK = r"(?:\r?\n|\\r\\n|\\n)[\x20\t]*"
_RUN = re.compile(rf"[A-Za-z0-9+/_-]{{{LEAST},}}(?:{_BREAK}[A-Za-z0-9+/_-]{{4,}})*={{0,2}}")
_BREAKS = re.compile(_BREAK)
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(e[wy][A-Za-z0-9_-]{6,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)(?:\.([A-Za-z0-9_-]*)\.([A-Za-z0-9_-]*))?")
_ARMOUR = re.compile(rf"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----(?:{_BREAK})?\Z")
_ARMOUR_END = re.compile(rf"(?:{_BREAK})?-----END [A-Z0-9 ]*PRIVATE KEY-----")
#: Texts in which any of the above can match, for one pass in Arrow.
_SOME = rf"[A-Za-z0-9+/_-]{{{LEAST}}}|AKIA[A-Z0-9]{{12}}|(?i:password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?[A-Za-z0-9+/_.=-]{{8}}|e[wy][A-Za-z0-9_-]{{6,}}\.[A-Za-z0-9_-]{{2,}}\."

# Fixed values of the encodings: tags, object identifiers (as encoded), the magic of one key format, lengths of signatures in bytes.
_SEQUENCE, _INTEGER, _BITS, _OCTETS, _OID, _PARAMS, _PUBLIC = 0x30, 0x02, 0x03, 0x04, 0x06, 0xA0, 0xA1
_RSA, _EC, _DSA = bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a8648ce3d0201"), bytes.fromhex("2a8648ce380401")
_CURVES = {bytes.fromhex("2b656e"): 32, bytes.fromhex("2b656f"): 56, bytes.fromhex("2b6570"): 32, bytes.fromhex("2b6571"): 57}
_PKCS5, _PKCS7 = bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d0107")
_OPENSSH = b"openssh-key-v1\0"
_SIGNATURES = {"HS256": (32, 32), "HS384": (48, 48), "HS512": (64, 64), "ES256": (64, 64), "ES256K": (64, 64), "ES384": (96, 96), "ES512": (132, 132), "EdDSA": (64, 114), "RS256": (64, 2048), "RS384": (64, 2048), "RS512": (96, 2048), "PS256": (96, 2048), "PS384": (128, 2048), "PS512": (160, 2048)}

_URL_SAFE = str.maketrans("-_", "+/")


class Encoded:
    """Bytes that a run of characters encodes from one of its places on; parts are decoded when they are asked for."""

    def __init__(self, run: str, at: int, hexadecimal: bool):
        self.run, self.at, self.hexadecimal = run, at, hexadecimal
        self.size = (len(run) - at) // 2 if hexadecimal else (len(run) - at) * 3 // 4

    def get(self, lo: int, n: int) -> bytes:
        n = max(0, min(n, self.size - lo))
        if self.hexadecimal:
            return bytes.fromhex(self.run[self.at + 2 * lo : self.at + 2 * (lo + n)])
        first = lo // 3
        part = self.run[self.at + 4 * first : self.at + 4 * -(-(lo + n) // 3)]
        if len(part) % 4 == 1:
            part = part[:-1]
        return binascii.a2b_base64(part + "=" * (-len(part) % 4))[lo - 3 * first :][:n]

    def characters(self, n: int) -> int:
        """Characters that the first n bytes take."""
        return 2 * n if self.hexadecimal else -(-4 * n // 3)


def _head(data: Encoded, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the content of the element at `at`; none where its length is not minimal or passes `end`."""
    b = data.get(at, 5)
    if len(b) < 2:
        return None
    n, size = b[1], 2
    if n == 0x81 and len(b) > 2 and b[2] >= 0x80:
        n, size = b[2], 3
    elif n == 0x82 and len(b) > 3 and b[2]:
        n, size = b[2] << 8 | b[3], 4
    elif n == 0x83 and len(b) > 4 and b[2]:
        n, size = b[2] << 16 | b[3] << 8 | b[4], 5
    elif n >= 0x80:
        return None
    return (b[0], at + size, at + size + n) if at + size + n <= end else None


def _elements(data: Encoded, at: int, end: int, most: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill at..end exactly; none where they don't or are more than `most`."""
    found = []
    while at < end:
        e = _head(data, at, end) if len(found) < most else None
        if e is None:
            return None
        found.append(e)
        at = e[2]
    return found


def _natural(data: Encoded, e: tuple[int, int, int]) -> bool:
    """A positive integer without needless leading zeros."""
    b = data.get(e[1], 2)
    return e[0] == _INTEGER and e[2] > e[1] and len(b) > 0 and b[0] < 0x80 and not (b[0] == 0 and (e[2] - e[1] == 1 or b[1] < 0x80))


def _inner(data: Encoded, at: int, end: int) -> str | None:
    """What private key the one element that fills at..end is."""
    outer = _head(data, at, end)
    if outer is None or outer[0] != _SEQUENCE or outer[2] != end:
        return None
    first = _head(data, outer[1], end)
    if first is None or first[0] not in (_INTEGER, _SEQUENCE):
        return None
    if first[0] == _INTEGER and first[2] - first[1] != 1:
        return None
    parts = _elements(data, outer[1], end, 10)
    if not parts or len(parts) < 2:
        return None
    if first[0] == _SEQUENCE:  # an encrypted key: algorithm, then the secret
        oid = _head(data, first[1], first[2])
        sealed = oid and oid[0] == _OID and data.get(oid[1], oid[2] - oid[1]).startswith(_PKCS5) and len(parts) == 2 and parts[1][0] == _OCTETS and parts[1][2] - parts[1][1] >= 32
        return "pkcs8 encrypted" if sealed else None
    version = data.get(first[1], 1)[0]
    numbers, rest = parts[1:9], parts[9:]
    if version <= 1 and len(numbers) == 8 and all(_natural(data, e) for e in numbers) and (not rest if version == 0 else [e[0] for e in rest] == [_SEQUENCE]):
        n = numbers[0]
        return f"rsa {8 * (n[2] - n[1] - (data.get(n[1], 1) == b'\0'))}" if n[2] - n[1] >= 32 else None
    if version == 0 and len(parts) == 6 and all(_natural(data, e) for e in parts[1:]) and parts[1][2] - parts[1][1] >= 64:
        return "dsa"
    if version == 1 and parts[1][0] == _OCTETS and 16 <= parts[1][2] - parts[1][1] <= 72:
        extra = [e[0] for e in parts[2:]]
        inside = [_head(data, e[1], e[2]) for e in parts[2:]]
        if extra in ([], [_PARAMS], [_PUBLIC], [_PARAMS, _PUBLIC]) and all(i and i[0] == (_OID if e[0] == _PARAMS else _BITS) and i[2] == e[2] for i, e in zip(inside, parts[2:], strict=True)):
            return f"ec {8 * (parts[1][2] - parts[1][1])}" if extra else None
    if version <= 1 and len(parts) >= 3 and parts[1][0] == _SEQUENCE and parts[2][0] == _OCTETS:
        oid = _head(data, parts[1][1], parts[1][2])
        if oid is None or oid[0] != _OID:
            return None
        name, (_, lo, hi) = data.get(oid[1], min(oid[2] - oid[1], 16)), parts[2]
        if name in _CURVES:
            seed = _head(data, lo, hi)
            return f"pkcs8 curve {8 * _CURVES[name]}" if seed and seed[0] == _OCTETS and seed[2] == hi and hi - seed[1] == _CURVES[name] else None
        if name == _RSA:
            return f"pkcs8 {key}" if (key := _inner(data, lo, hi)) else None
        if name == _EC:
            inside = _elements(data, *(_head(data, lo, hi) or (0, 0, 0))[1:], 4)
            return "pkcs8 ec" if inside and len(inside) >= 2 and inside[0][0] == _INTEGER and inside[1][0] == _OCTETS else None
        if name == _DSA:
            x = _head(data, lo, hi)
            return "pkcs8 dsa" if x and x[2] == hi and _natural(data, x) else None
    if version == 3 and parts[1][0] == _SEQUENCE:
        oid = _head(data, parts[1][1], parts[1][2])
        return "pkcs12" if oid and oid[0] == _OID and data.get(oid[1], 9).startswith(_PKCS7) else None
    return None


def _der(data: Encoded) -> tuple[str, int] | None:
    """The private key that begins here, with its size in bytes."""
    outer = _head(data, 0, data.size)
    if outer is None or outer[0] != _SEQUENCE or outer[2] < 40:
        return None
    kind = _inner(data, 0, outer[2])
    return (kind, outer[2]) if kind else None


def _openssh(data: Encoded) -> tuple[str, int] | None:
    """Length-prefixed strings after the magic: cipher, key derivation and its options, public keys, private part."""
    if data.get(0, len(_OPENSSH)) != _OPENSSH:
        return None
    at = len(_OPENSSH)

    def string() -> bytes | None:
        nonlocal at
        n = int.from_bytes(data.get(at, 4))
        if at + 4 + n > data.size:
            return None
        at += 4 + n
        return data.get(at - n, min(n, 64))

    cipher, kdf, options = string(), string(), string()
    count = int.from_bytes(data.get(at, 4))
    at += 4
    if cipher is None or kdf is None or options is None or not 1 <= count <= 16:
        return None
    for _ in range(count):
        if string() is None:
            return None
    private = string()
    if private is None or len(private) < 16 or (cipher == b"none") != (kdf == b"none"):
        return None
    if cipher == b"none" and private[:4] != private[4:8]:
        return None
    return f"openssh {cipher.decode('latin-1')}", at


def _plain(part: str) -> bytes | None:
    """Decoded bytes of one part of a token."""
    if len(part) % 4 == 1:
        return None
    return binascii.a2b_base64(part.translate(_URL_SAFE) + "=" * (-len(part) % 4))


def _object(part: str) -> dict | None:
    try:
        found = json.loads(_plain(part) or b"")
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def _token(m: re.Match) -> str | None:
    """The algorithm of a signed (three parts) or encrypted (five) token; none where header, claims and signature don't fit each other."""
    head = _object(m[1])
    alg = head.get("alg") if head else None
    if not isinstance(alg, str):
        return None
    if m[4] is not None:
        vector, tag = _plain(m[3]), _plain(m[5])
        return f"encrypted {alg}" if isinstance(head.get("enc"), str) and vector and tag and len(vector) in (12, 16) and 16 <= len(tag) <= 32 else None
    least, most = _SIGNATURES.get(alg, (1, 0))
    signature = _plain(m[3])
    if signature is None or not least <= len(signature) <= most:
        return None
    return f"signed {alg}" if _object(m[2]) is not None else None


_STARTS = re.compile("M[A-I]|b3BlbnNzaC1rZXktdjEA|LS0tLS1CRUdJTi")
_HEX_RUN = re.compile("[0-9A-Fa-f]{64,}")


def _readable(data: bytes) -> bool:
    """Whether decoded bytes begin like text: what stands inside them may be encoded again."""
    return len(data) >= LEAST and all(b in b"\t\n\r" or 32 <= b < 127 for b in data[:LEAST])


def _inside(data: bytes, depth: int) -> str | None:
    if depth <= 1 or not _readable(data):
        return None
    found = _confirmed(data.decode("latin-1"), depth - 1)
    return f"encoded {found[0][3]}|{found[0][0]}" if found else None


def _candidates(run: str, depth: int) -> Iterator[tuple[str, int, int, str]]:
    """kind, start, end and detail of what is confirmed in one run of characters (without its line breaks)."""
    for m in _HEX_RUN.finditer(run):
        part, at = m[0], 0
        if what := _inside(bytes.fromhex(part[: len(part) // 2 * 2]), depth):
            detail, kind = what.rsplit("|", 1)
            yield kind, m.start(), m.end(), detail
            continue
        while (at := part.find("30", at)) >= 0:
            found = _der(Encoded(part, at, True))
            if found:
                yield "key", m.start() + at, m.start() + at + 2 * found[1], found[0]
            at += 2 * found[1] if found else 1
    plain = run.translate(_URL_SAFE)
    whole = Encoded(plain, 0, False)
    if depth > 1 and _readable(whole.get(0, LEAST)) and (what := _inside(whole.get(0, whole.size), depth)):
        detail, kind = what.rsplit("|", 1)
        yield kind, 0, len(run), detail
        return
    at, tried = 0, {0}  # characters stand for the same bytes from all places four apart, so one look into a text for each alignment
    while m := _STARTS.search(plain, at):
        data, at = Encoded(plain, m.start(), False), m.start() + 1
        found = _openssh(data) if m[0].startswith("b3") else _der(data) if m[0].startswith("M") else None
        if m[0].startswith("LS") and m.start() % 4 not in tried:
            tried.add(m.start() % 4)
            if what := _inside(data.get(0, data.size), depth):
                detail, kind = what.rsplit("|", 1)
                yield kind, m.start(), len(run), detail
                return
        if found:
            at = m.start() + data.characters(found[1])
            yield "key", m.start(), at, found[0]


def _confirmed(text: str, depth: int = DEPTH) -> list[tuple[str, int, int, str]]:
    """Spans of private keys and tokens that decode and parse as such; an armoured key's span has its armour."""
    found = []
    for m in _TOKEN.finditer(text):
        if what := _token(m):
            found.append(("token", m.start(), m.end(), what))
    for m in _RUN.finditer(text):
        raw = m[0].rstrip("=")
        gaps = [(b.start(), b.end()) for b in _BREAKS.finditer(raw)] if len(raw) and ("\n" in raw or "\\" in raw) else []
        run = _BREAKS.sub("", raw) if gaps else raw

        def place(at: int, last: bool) -> int:
            """Where the character `at` of the joined run stands in the text (for an end: behind the one before it)."""
            at -= last
            for lo, hi in gaps:
                if at < lo:
                    break
                at += hi - lo
            return m.start() + at + last

        for kind, lo, hi, what in _candidates(run, depth):
            start, end = place(lo, False), place(hi, True)
            end += len(text[end : end + 2]) - len(text[end : end + 2].lstrip("="))
            if kind == "key" and (before := _ARMOUR.search(text, max(0, start - 100), start)) and (after := _ARMOUR_END.match(text, end)):
                start, end = before.start(), after.end()
            found.append((kind, start, end, what))
    return found


def find(text: str) -> list[tuple[str, int, int, str]]:
    """kind, start, end (code points, end exclusive) and detail of every secret of a text, by start, then in the order of KINDS."""
    found = [("assign", m.start(), m.end(), "") for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    found += [("access", m.start(), m.end(), "") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", m.start(), m.end(), "") for m in _HEX.finditer(text)]
    found += _confirmed(text)
    return sorted(set(found), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("detail", pa.string())]))


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and secrets (array of kind, start, end, detail) of every document, over its whole text.

    One Arrow pass without a shuffle: a text goes through Python only where one regular expression over the batch says that it may
    hold something. A null or empty text has an empty array; rows with a null or repeated key are all returned, each for itself; an
    empty table gives an empty result; other columns are ignored. A text of any length takes time in proportion: runs don't overlap, and
    from each place at which a key could begin only its tags and lengths are read. Candidates of under LEAST characters and more than DEPTH
    encodings inside each other aren't followed, a token begins where its run of characters begins.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = pc.match_substring_regex(batch.column(1), _SOME).fill_null(False)
            at = pc.indices_nonzero(some).to_pylist()
            out: list[list] = [[] for _ in range(batch.num_rows)]
            for i, t in zip(at, batch.column(1).take(pa.array(at, pa.int64())).to_pylist(), strict=True):
                out[i] = [{"kind": k, "start": s, "end": e, "detail": d} for k, s, e, d in find(t)]
            yield pa.record_batch([batch.column(0), pa.array(out, _FOUND)], [key, "secrets"])

    kind = docs.select(key).schema[0].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string").alias("text")).mapInArrow(run, f"`{key}` {kind}, secrets array<struct<kind: string, start: bigint, end: bigint, detail: string>>")


def listed(spans: Column, keep: Callable[[Column], Column] | None = None) -> Column:
    """`kind:start:end` of the spans (of those that `keep` takes), comma-joined."""
    chosen = F.filter(spans, keep) if keep else spans
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the sha256 of their spans and all spans as text."""
    s = F.col("secrets")
    counts = [F.size(F.filter(s["kind"], lambda x: x == F.lit(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select(key, *counts, F.sha2(listed(s, lambda x: x["kind"].isin(*BASE)), 256).alias("base_sha256"), listed(s).alias("spans"))
