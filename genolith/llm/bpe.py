"""Exact BPE encoding by backtracking over Aho-Corasick matches, and decoding by an offset table.

The vocabulary is read from the json file of a public tokenizer with byte symbols, a word-end suffix
and ids in merge order. Each run without white space is encoded once per worker and kept in a bounded cache.

Backtracking: an automaton finds the longest vocabulary entry that starts at each position. Entries are laid
down greedily; two neighbours may stand side by side only if merging in rank order would not have crossed their
border (the pair-compatibility table, filled as pairs occur). Where no entry fits, the last one is replaced by
its next shorter prefix, and an end position once given up is never tried again, so the time is linear.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genolith.llm.common import bound_batches

#: Runs and pre-tokens kept per worker at most (about 200 bytes each), and compatible pairs (about 100 bytes each); a full cache of runs steps back into a second
#: one, from which frequent runs return.
CACHE, PAIRS = 80_000, 250_000
FLUSH = 1 << 20
#: Characters whose normal form, lower case and class are the same in every version of Unicode that the libraries have (tests compare all of them): Latin, Greek, Cyrillic,
#: punctuation, currency, kana, ideographs and Hangul syllables. A text with any other is normalised and cut by the tokenizers library itself.
_UNUSUAL = regex.compile(r"[^\x00-\u024f\u0384-\u038a\u038c\u038e-\u03a1\u03a3-\u03ce\u0400-\u0482\u048a-\u04ff\u1e00-\u1ef9\u2010-\u2027\u2030-\u205e\u20a0-\u20ac\u3001-\u3020\u3041-\u3096\u309b-\u30ff\u4e00-\u9fa5\uac00-\ud7a3\uff01-\uff5e]")
_SPACE = r"\t-\r\x20\x85\p{Z}"
_PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{_SPACE}\p{{L}}\p{{N}}]+")
_ODD, _RUNS = regex.compile(r"[\x1c-\x1f]"), regex.compile(rf"[^{_SPACE}]+")


def _byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte, as byte-level vocabularies write them."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary(dict):
    """Maps a run without white space to its ids as little-endian 32-bit bytes; missing ones are encoded on demand."""

    def __init__(self, text: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(text)
        spec = json.loads(text)
        model, symbols = spec["model"], _byte_symbols()
        self.symbols = symbols
        end = model["end_of_word_suffix"] or ""
        if not end:
            raise ValueError("the vocabulary needs a word-end suffix")

        def inner(token: str) -> str:
            """Bytes as characters below 256; the last byte of a word as 256 more."""
            body = token.removesuffix(end)
            s = "".join(chr(symbols[c]) for c in body)
            return s if body == token else s[:-1] + chr(ord(s[-1]) + 256)

        ids = model["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.special_ids = {t: np.array([i], "<u4").tobytes() for t, i in special.items()}
        n = max([*ids.values(), *special.values()]) + 1
        self.left, self.right, self.size, self.merged = list(range(n)), list(range(n)), [1] * n, {}
        for m in model["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            x = ids[a + b]
            self.left[x], self.right[x] = ids[a], ids[b]
            self.merged[ids[a], ids[b]] = x
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        inside: dict[str, int] = {}
        for t, i in ids.items():
            if t not in special:
                inside[inner(t)] = i
                self.size[i] = len(inner(t))
        for s, i in inside.items():
            self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        self.shorter = [-1] * n  # the longest proper prefix that is an entry
        for s, i in inside.items():
            for k in range(len(s) - 1, 0, -1):
                if s[:k] in inside:
                    self.shorter[i] = inside[s[:k]]
                    break
        self.fits: dict[int, bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # decoding: the written form of entry i is blob[offset[i]:offset[i + 1]], with a space before it
        names = [""] * n
        for t, i in (ids | special).items():
            names[i] = t
        forms = [b" " + t.encode() for t in names]
        self.blob = np.frombuffer(b"".join(forms), np.uint8)
        self.offset = np.concatenate(([0], np.cumsum([len(f) for f in forms])))

    def compatible(self, a: int, b: int) -> bool:
        """Whether a and b stay apart when their text is merged in rank order.

        Takes the two entries apart at their common border, always the one that was merged later, and asks each time
        whether the two parts that face each other would have merged before that.
        """
        before = len(self.left)
        while True:
            m = self.merged.get((a, b))
            if m is not None and m < before:
                return False
            part_a, part_b = self.right[a], self.left[b]
            if part_a == a and part_b == b:
                return True
            if part_b == b or (a > b and part_a != a):
                before, a = a, part_a
            else:
                before, b = b + 1, part_b  # at equal rank the pair on the left merges first

    def encode(self, word: str) -> list[int]:
        """Ids of one pre-token, given as its UTF-8 bytes read as Latin-1."""
        s = word[:-1] + chr(ord(word[-1]) + 256)
        n = len(s)
        longest = [-1] * (n + 1)
        size, fits = self.size, self.fits
        for end, i in self.automaton.iter(s):
            longest[end + 1 - size[i]] = i  # ends rise, so the longest comes last
        out: list[int] = []
        dead, at, x = set(), 0, longest[0]
        while at < n:
            last = out[-1] if out else -1
            while x >= 0:
                if at + size[x] not in dead:
                    ok = last < 0 or fits.get((last, x))
                    if ok is None:
                        if len(fits) >= PAIRS:
                            fits.clear()
                        ok = fits[last, x] = self.compatible(last, x)
                    if ok:
                        break
                x = self.shorter[x]
            if x >= 0:
                out.append(x)
                at += size[x]
                x = longest[at]
            else:
                dead.add(at)
                x = out.pop()
                at -= size[x]
        return out

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            if len(self.pieces) >= CACHE:
                self.pieces.clear()
            found = self.pieces[piece] = np.array(self.encode(piece), "<u4").tobytes()
        return found

    def __missing__(self, run: str) -> bytes:
        found = self.older.get(run)
        if found is None:
            found = b"".join(self._piece(p.encode().decode("latin-1")) for p in _PIECES.findall(run))
        if len(self) >= CACHE:
            self.older = dict(self)
            self.clear()
        self[run] = found
        return found

    def _ids(self, part: str) -> list[bytes]:
        """Ids of the runs of a text without special tokens."""
        if not part.isascii():
            if _UNUSUAL.search(part):
                cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
                return [self._piece("".join(chr(self.symbols[c]) for c in piece)) for piece, _ in cut]
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ")  # one character at a time: no final sigma
        # str.split also cuts at U+001C to U+001F, which are no white space here
        part = part.lower()
        return [*map(self.__getitem__, _RUNS.findall(part) if _ODD.search(part) else part.split())]

    def ids(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit bytes."""
        parts = self.special.split(text) if self.special and "<|" in text else [text]
        return b"".join(self.special_ids[x] if k % 2 else b"".join(self._ids(x)) for k, x in enumerate(parts) if x)

    def text(self, ids: np.ndarray) -> bytes:
        """The written forms of the ids, joined by spaces."""
        start, width = self.offset[ids], self.offset[ids + 1] - self.offset[ids]
        total = int(width.sum())
        at = np.repeat(start - (np.cumsum(width) - width), width) + np.arange(total)
        return self.blob[at][1:].tobytes()


_loaded: dict[int, Vocabulary] = {}


def vocabulary(text: str) -> Vocabulary:
    """The vocabulary of a tokenizer file, built once per worker."""
    if hash(text) not in _loaded:
        _loaded.clear()
        _loaded[hash(text)] = Vocabulary(text)
    return _loaded[hash(text)]


def encode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", decode: bool = False) -> DataFrame:
    """key, n_tokens, ids (little-endian 32-bit), and decoded if asked for, one row per row of docs.

    path: a tokenizer file that the driver can open; its contents go to the workers in a broadcast (under 2 MB).
    A null or empty text has no ids and decodes to an empty string. Keys may be null or repeated; other columns are ignored, rows stay
    as they are, and no row depends on another, so nothing is shuffled.
    """
    bound_batches(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(Path(path).read_text())
    names = ["key", "n_tokens", "ids", *["decoded"] * decode]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(spec.value)
        for batch in batches:
            keys, texts, done, out, size = batch.column(0), batch.column(1), 0, [], 0
            for i in range(batch.num_rows):
                out.append(v.ids(texts[i].as_py() or ""))
                size += len(out[-1])
                if size > FLUSH or i == batch.num_rows - 1:
                    cols = [keys.slice(done, len(out)), pa.array([len(x) // 4 for x in out], pa.int64()), pa.array(out, pa.binary())]
                    if decode:
                        cols.append(pa.array([v.text(np.frombuffer(x, "<u4")) for x in out], pa.binary()).cast(pa.string()))
                    yield pa.record_batch(cols, names)
                    done, out, size = i + 1, [], 0

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n_tokens long, ids binary" + ", decoded string" * decode)
    return rows.withColumnRenamed("key", key)
