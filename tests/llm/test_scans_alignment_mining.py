"""Secret scans, cross-tokenizer alignment and hard-negative mining against brute-force versions."""

import base64
import collections
import hashlib
import json
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from genolith.llm import alignment, queries, secrets
from genolith.llm.negatives import hard_negatives

# --- encodings to be found


def tlv(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x81, n]) if n < 256 else bytes([0x82, n >> 8, n & 255])
    return bytes([tag]) + size + body


def integer(n):
    return tlv(2, n.to_bytes(n.bit_length() // 8 + 1, "big"))


def big(bits, seed):
    return random.Random(seed).getrandbits(bits) | 1 << bits - 1 | 1


RSA = tlv(0x30, integer(0) + b"".join(integer(big(b, i)) for i, b in enumerate((1024, 17, 1020, 512, 512, 512, 512, 512))))
PKCS8 = tlv(0x30, integer(0) + tlv(0x30, tlv(6, bytes.fromhex("2a864886f70d010101")) + b"\x05\x00") + tlv(4, RSA))
CURVE = tlv(0x30, integer(0) + tlv(0x30, tlv(6, bytes.fromhex("2b6570"))) + tlv(4, tlv(4, bytes(range(100, 132)))))
EC = tlv(0x30, integer(1) + tlv(4, bytes(range(1, 33))) + tlv(0xA0, tlv(6, bytes.fromhex("2a8648ce3d030107"))) + tlv(0xA1, tlv(3, b"\0\4" + bytes(64))))
PUBLIC = tlv(0x30, tlv(0x30, tlv(6, bytes.fromhex("2a864886f70d010101")) + b"\x05\x00") + tlv(3, b"\0" + tlv(0x30, integer(big(1024, 0)) + integer(65537))))
SEALED = tlv(0x30, tlv(0x30, tlv(6, bytes.fromhex("2a864886f70d01050d")) + tlv(0x30, tlv(4, b"saltsalt"))) + tlv(4, bytes(range(64))))


def counted(b):
    return len(b).to_bytes(4) + b


OPENSSH = b"openssh-key-v1\0" + counted(b"none") + counted(b"none") + counted(b"") + (1).to_bytes(4) + counted(counted(b"ssh-ed25519") + counted(bytes(32))) + counted(b"abcdabcd" + counted(b"ssh-ed25519") + bytes(100))


def b64(b):
    return base64.b64encode(b).decode()


def url(b):
    return base64.urlsafe_b64encode(b).decode().rstrip("=")


def token(head, claims=b'{"sub":"x"}', signature=bytes(32)):
    return ".".join((url(json.dumps(head).encode()), url(claims), url(signature)))


def armoured(der, name="RSA PRIVATE KEY", end="\n"):
    text = b64(der)
    return f"-----BEGIN {name}-----{end}" + end.join(text[i : i + 64] for i in range(0, len(text), 64)) + f"{end}-----END {name}-----"


def added(text):
    return [(k, text[s:e], d) for k, s, e, d in secrets.find(text) if k in ("key", "token")]


@pytest.mark.parametrize(("secret", "detail"), [
    (b64(RSA), "rsa 1024"), (b64(PKCS8), "pkcs8 rsa 1024"), (b64(CURVE), "pkcs8 curve 256"), (b64(EC), "ec 256"), (b64(SEALED), "pkcs8 encrypted"), (b64(OPENSSH), "openssh none"), (url(RSA), "rsa 1024"),
    (RSA.hex(), "rsa 1024"), (RSA.hex().upper(), "rsa 1024"), (armoured(RSA), "rsa 1024"), (armoured(PKCS8, "PRIVATE KEY", "\\n"), "pkcs8 rsa 1024"), (armoured(OPENSSH, "OPENSSH PRIVATE KEY", "\r\n"), "openssh none"),
    (b64(armoured(EC, "EC PRIVATE KEY").encode()), "encoded ec 256"), (armoured(EC, "EC PRIVATE KEY").encode().hex(), "encoded ec 256"), (b64(b64(armoured(CURVE, "PRIVATE KEY").encode()).encode()), "encoded encoded pkcs8 curve 256"),
    (token({"alg": "HS256"}), "signed HS256"), (token({"alg": "RS256", "kid": "a"}, signature=bytes(256)), "signed RS256"), (b64(f'{{"jwt": "{token({"alg": "ES256"}, signature=bytes(64))}"}}'.encode()), "encoded signed ES256"),
])
def test_confirmed_secrets(secret, detail):
    text = f"Ünïcode 😀 before, {secret} and after"
    (found,) = added(text)
    assert found[1:] == (secret, detail)


@pytest.mark.parametrize("clean", [
    b64(PUBLIC), armoured(PUBLIC, "PUBLIC KEY"), b64(RSA[:-9]), b64(RSA[:9] + b"\x03" + RSA[10:]), b64(CURVE[:-1] + b"")[:-4], hashlib.sha256(b"x").hexdigest().upper(), b64(random.Random(1).randbytes(3000)), "M" * 500, "MII" * 200, b64(OPENSSH[:80]),
    token({"typ": "JWT"}), token({"alg": "HS256"}, signature=bytes(31)), token({"alg": "none"}, signature=b""), token({"alg": "HS256"}, claims=b"[1]"), "eyJhbGciOiJI.eyJ9.AAAA", "https://example.org/" + "path/" * 40, "lorem ipsum " * 50,
])
def test_candidates_that_do_not_parse(clean):
    assert not added(f"before {clean} after")


def base_spans(text):
    """The base kinds straight from their statement."""
    assign = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    found = [("assign", m.start(), m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_secret_scan(spark):
    rng = random.Random(5)
    bits = ["password", "PassWd", "secret", "Token", "apikey", "API_KEY", "=", ": ", '"', "'", " ", "AKIA", "ABCDEFGH1234", "0123456789abcdef" * 2, "deadbeef", "\n", "é", "😀", "xyz12345", b64(CURVE), "ſecret=12345678"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 14))) for _ in range(400)] + [None, "", "a" * 300_000, f"x {token({'alg': 'HS256'})}"]
    rows = [*enumerate(texts), (None, "password=abcdefgh"), (3, texts[3])]
    docs = spark.createDataFrame([(k, t, 1, "y") for k, t in rows], "doc_id long, text string, secrets int, kind string")
    out = secrets.digest(secrets.scan(docs)).collect()
    want = []
    for k, t in rows:
        base = base_spans(t or "")
        spans = sorted([*base, *((a, s, e) for a, s, e, _ in secrets._confirmed(t or ""))], key=lambda s: (s[1], secrets.KINDS.index(s[0])))
        listed = [",".join(f"{a}:{s}:{e}" for a, s, e in x) for x in (base, spans)]
        want.append((k, *(sum(b[0] == kind for b in base) for kind in secrets.BASE), hashlib.sha256(listed[0].encode()).hexdigest(), listed[1]))
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, want))
    assert any("key:" in w[-1] for w in want) and any("token:" in w[-1] for w in want)
    assert secrets.digest(secrets.scan(docs.where("false"))).count() == 0


def test_secret_scan_takes_linear_time():
    for bad in ("LS0tLS1CRUdJTi" * 20_000, "MIICAQAC" * 30_000, "308201020201" * 20_000, "eyJ.ey." * 40_000, ("A" * 40 + "\n") * 6_000, "token=" + " " * 300_000, "-----BEGIN PRIVATE KEY-----" * 10_000):
        start = time.perf_counter()
        assert not [s for s in secrets.find(bad) if s[0] == "token"]
        assert time.perf_counter() - start < 4


# --- alignment


@pytest.fixture(scope="module")
def aligner():
    left, right = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")
    return alignment.Aligner(open(left).read(), open(right, "rb").read())


def aligned(al, text):
    """ids left and right, groups as text, and links, by the statement: whole texts, one pass over the ends."""
    if not text:
        return [], [], "", []
    a, b = al.a.encode(f" {text}", add_special_tokens=False).ids, al.b.encode(text)
    x, y = [al.a_bytes[i] for i in a], [al.b_bytes[i] for i in b]
    if not b"".join(x) == b"".join(y) == f" {text}".encode():
        return [], [], "", []
    ends = [np.cumsum(list(map(len, z))).tolist() for z in (x, y)]
    groups, links, i, j = [], [], 0, 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        p, q = ends[0].index(cut) + 1, ends[1].index(cut) + 1
        groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
        links += [(u, v) for u in a[i:p] for v in b[j:q]]
        i, j = p, q
    return a, b, ";".join(groups), links


BITS = ["a", "b", "the", "\n", " ", "  ", "\t", "\r", "\r\n", ";", "'s", "é", "ﬁ", "中文", "😀", "▁", "<s>", "<|endoftext|>", "\xa0", "​", "᠎", "\x1c", "\x85", "　", "\0", "<0x41>", "//", "{", "123", "́", "ПРИВЕТ", "हा", " x", "straße", "ing"]


def test_parts_align_like_whole_texts(aligner):
    rng = random.Random(2)
    texts = [None, "", " ", "\n", "  ", *("".join(rng.choice(BITS) for _ in range(rng.randrange(1, 15))) for _ in range(3000))]
    counts, sums, links = aligner.align(pa.array(texts, pa.string()))
    held = [collections.Counter() for _ in texts]
    for d, a, b, n in zip(*(links[c].tolist() for c in ("doc", "a", "b", "n")), strict=True):
        held[d][a, b] += n
    for i, t in enumerate(texts):
        a, b, groups, pairs = aligned(aligner, t)
        assert counts[i].tolist() == [len(a), len(b), groups.count("|"), len(pairs)], repr(t)
        assert sums[i] == (hashlib.sha256(groups.encode()).hexdigest() if a else "") and held[i] == collections.Counter(pairs)
    assert sum(s == "" for s in sums) > 100  # texts with the piece's own space mark don't come back


def test_alignment_over_documents(spark, aligner):
    rng = random.Random(3)
    texts = [None, "", *(" ".join(rng.choice(["the", "token", "aligns", "Straße", "x\ny", "tokenizers", "…"]) for _ in range(rng.randrange(1, 40))) for _ in range(60))]
    rows = [*enumerate(texts), (5, texts[5]), (None, texts[6]), (99, "long words " * 20_000)]
    docs = spark.createDataFrame([(k, t, 1, "z") for k, t in rows], "doc_id long, text string, chunk int, pair string").repartition(3)
    out, pairs = alignment.align(docs, queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model"), chunk=2_000)
    found = [aligned(aligner, t) for _, t in rows]
    count = collections.Counter(p for f in found for p in set(f[3]))
    most = collections.defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    want = [(k, len(f[0]), len(f[1]), f[2].count("|"), len(f[3]), sum(count[p] == most[p[0]] for p in f[3]), sum(count[p] for p in f[3]), hashlib.sha256(f[2].encode()).hexdigest() if f[0] else "") for (k, _), f in zip(rows, found, strict=True)]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    assert {(r.a, r.b): (r["count"], r.best) for r in pairs.collect()} == {p: (n, n == most[p[0]]) for p, n in count.items()}
    empty, none = alignment.align(docs.where("false"), queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model"))
    assert empty.count() == none.count() == 0


# --- hard negatives


def mined(rows, positives=5, negatives=3, low=50, high=95):
    """The statement over all pairs."""
    best = {}
    for i, lab, vec, anchor in rows:
        if i is not None and lab is not None and vec and all(c is not None for c in vec):
            best[i] = min(best[i], (lab, vec, anchor)) if i in best else (lab, vec, anchor)
    out = []
    for i, (lab, vec, anchor) in best.items():
        if not anchor:
            continue
        scored = sorted((-sum(x * y for x, y in zip(vec, v, strict=True)), j, k) for j, (k, v, _) in best.items() if j != i and len(v) == len(vec))
        for minus, j, _ in [s for s in scored if s[2] == lab][:positives]:
            fit = [s for s in scored if s[2] != lab and low * -minus <= 100 * -s[0] <= high * -minus]
            out += [(i, j, r, s[1], -minus, -s[0]) for r, s in enumerate(fit[:negatives], 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["clustered", "tied", "copies"])
def test_hard_negatives_against_brute_force(spark, kind):
    rng = np.random.default_rng(4)
    n = 260
    if kind == "clustered":
        x = np.floor(256 * (rng.normal(size=(6, 5))[rng.integers(6, size=n)] + 0.4 * rng.normal(size=(n, 5)))).astype(int)
    elif kind == "tied":
        x = rng.integers(-2, 3, size=(n, 3))
    else:
        x = np.where(rng.random(n)[:, None] < 0.5, 7, rng.integers(-9, 10, size=(n, 4)))
    rows = [(i, int(rng.integers(3)), v.tolist(), i % 4 == 0) for i, v in enumerate(x)]
    rows += [(None, 1, [1] * x.shape[1], True), (900, None, [1] * x.shape[1], True), (901, 1, None, True), (902, 1, [1, None], True), (903, 1, [], True), (904, 1, [5, 5], True), (905, 2, [5, 4], False), (906, 1, [5, 5], False), (0, 2, [0] * x.shape[1], True), rows[8]]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, label int, vec array<long>, mark boolean, leaf int, score int").repartition(5)
    out = hard_negatives(df, F.col("mark"), sample=100, leaves=6, shard=40, bucket=5, block=16)
    assert sorted(map(tuple, out.collect())) == mined(rows)


def test_hard_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, label int, vec array<long>")
    assert hard_negatives(empty, F.col("vec_id") % 2 == 0).count() == 0
    alone = spark.createDataFrame([(0, 1, [3])], "vec_id long, label int, vec array<long>")
    assert hard_negatives(alone, F.col("vec_id") % 2 == 0).count() == 0


# --- mended faults of earlier operators


def test_chosen_words_do_not_collide():
    """Words whose letters follow the parity of their place's bits meet in any polynomial modulo a power of two."""
    from genolith.llm.shingles import shingle_sets

    for n in (1024, 2048, 4096):
        word = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
        other = word.translate(str.maketrans("ab", "ba"))
        one, two, same = shingle_sets(pa.array([word, other, f" {word}\n"]))
        assert one != two and one == same


@pytest.mark.parametrize("markup", ["<div" * 250_000, "<div>x" * 100_000, "<p>a <b " * 100_000, "<b>" * 100_000 + "<hr>" * 100_000, "<svg>" * 100_000, "<a '" * 100_000 + ">", "<li><b>" * 50_000 + "<li>x" * 50_000, "<!--" * 200_000, "<h1>x<header>" * 50_000])
def test_broken_and_deep_markup_takes_linear_time(markup):
    from genolith.llm.html import Page

    start = time.perf_counter()
    page = Page(markup)
    e, _ = page.best()
    page.text(page.path(e) if e >= 0 else None)
    assert time.perf_counter() - start < 10  # the quadratic parser took hours


def test_alignment_stores_a_row_a_document(spark, monkeypatch):
    made, plain = [], alignment.stored
    monkeypatch.setattr(alignment, "stored", lambda df: made.append(plain(df)) or made[-1])
    docs = spark.createDataFrame([(i, f"one{i} two{i % 7} three  four{i}\n" * 4) for i in range(300)] + [(300, None), (301, "")], "doc_id long, text string").coalesce(1)
    out, _ = alignment.align(docs, queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model"))
    rows = {r.doc_id: r for r in out.collect()}
    assert len(rows) == 302 and rows[300].n_links == rows[301].n_links == 0 < rows[5].n_links <= rows[5].count_sum
    each = made[0].where("pair is not null").collect()
    assert len(each) == 302 and max(len(r.pair) for r in each) <= 60  # a chunk of documents was one row
