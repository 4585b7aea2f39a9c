"""Token-id files: one zstandard frame per document against a shared dictionary, with an offset index.

Layout below a folder (any file system that Spark writes to; Spark's commit protocol makes it whole or absent):

* `dictionary`: one row with the dictionary, its sha256, the id width in bytes, and the sha256 of the tokenizer file.
* `blocks`: rows of about a megabyte with `part, block` (their order is document order), `start` (ids of this part
  before the block), `tokens`, `dictionary` (sha256), `payload` (the frames one after another) and the index arrays `keys`,
  `offsets` (one more than keys) and `counts`, so one short document is read by slicing its frame.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import accumulate
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genolith.llm.common import bound_batches, stored

#: The dictionary is trained on this many documents at most, of at most SAMPLE_CHARS characters each.
SAMPLE, SAMPLE_CHARS, DICTIONARY_BYTES = 2_000, 20_000, 65_536
#: Parts of texts and pre-tokens that a worker remembers at most (about 200 bytes each), and bytes of text that are encoded at a time.
BLOCK, LEVEL, CACHE, FLUSH = 1 << 20, 3, 600_000, 4_000_000
_SPACE = r"\t-\r\x20\x85\p{Z}"
_PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_PARTS = regex.compile(rf"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
#: White space other than single spaces and line breaks between visible characters.
_LOOSE = r"[ \n][ \n]|\A[ \n]|[ \n]\z|[\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


class _Numbers(dict):
    """Numbers keys in the order of their first use and lists those not yet taken."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self.new.append(key)
        self[key] = n = len(self)
        return n


class _Ids:
    """Numbered keys and the ids of each: flat[first[i]:first[i + 1]]."""

    def __init__(self) -> None:
        self.numbers, self.first, self.flat = _Numbers(), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def add(self, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.first = np.concatenate((self.first, self.first[-1] + np.cumsum(sizes)))
        self.flat = np.concatenate((self.flat, ids))

    def of(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of keys n, one after another, and how many each has."""
        start, sizes = self.first[n], self.first[n + 1] - self.first[n]
        return self.flat[np.repeat(start - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())], sizes


class Encoder:
    """Encodes whole texts with the tokenizers library, whose model sees each distinct pre-token once while the caches hold it.

    A text is cut where white space follows a visible character: no pre-token reaches across, so a part has the same ids wherever
    it stands. Parts are kept without the space that most begin with; the first part of a text and all parts of a text with other white space stand after a tab.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(plain)]
        self.symbols = str.maketrans({b: 256 + i for i, b in enumerate(hidden)})  # how byte-level vocabularies write a byte
        self.parts, self.pieces = _Ids(), _Ids()

    def _learn(self) -> None:
        """Encode the parts that were numbered since the last call."""
        new, self.parts.numbers.new = self.parts.numbers.new, []
        if not new:
            return
        if len(self.pieces.numbers) > CACHE:
            self.pieces = _Ids()
        real = (x[1:] if x[0] == "\t" else x if x[0] == "\n" else f" {x}" for x in new)
        cut = [(x,) if x.isascii() and x[:1] == " " and x[1:].isalpha() else _PIECES.findall(x) for x in real]
        each, counts = self.pieces.numbers.__getitem__, np.fromiter(map(len, cut), np.int64, len(cut))
        n = np.fromiter((each(p) for x in cut for p in x), np.int64, counts.sum())
        unseen, self.pieces.numbers.new = self.pieces.numbers.new, []
        tokenize = self.tokenizer.model.tokenize
        space = self.symbols[32]
        written = (p.replace(" ", chr(space)) if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(self.symbols) for p in unseen)
        ids = [[t.id for t in tokenize(w)] for w in written]
        self.pieces.add(np.fromiter(map(len, ids), np.int64, len(ids)), np.fromiter((i for x in ids for i in x), np.uint32))
        ids, sizes = self.pieces.of(n)
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(counts)))]
        self.parts.add(np.diff(ends), ids)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; null counts as empty."""
        if len(self.parts.numbers) > CACHE:
            self.parts = _Ids()
        texts = texts.fill_null("")
        whole = np.zeros(len(texts), bool)  # special tokens cut across parts
        for s in self.special:
            whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        loose = pc.match_substring_regex(texts, _LOOSE).to_numpy(zero_copy_only=False) & ~whole
        plain = texts.filter(pa.array(~(whole | loose)))
        cut = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise("\t", plain, ""), "\n", " \n"), " ")
        parts = cut.flatten().dictionary_encode()
        known = np.fromiter(map(self.parts.numbers.__getitem__, parts.dictionary.to_numpy(zero_copy_only=False)), np.int64, len(parts.dictionary))
        rest = {i: [self.parts.numbers["\t" + x] for x in _PARTS.findall(texts[i].as_py())] for i in np.flatnonzero(loose).tolist()}
        self._learn()
        at = known[parts.indices.to_numpy()]
        ids, sizes = self.parts.of(at)
        ends = np.concatenate(([0], np.cumsum(sizes)))[cut.offsets.to_numpy()[1:]]
        each = iter(np.split(ids, ends[:-1]))
        out = []
        for i in range(len(texts)):
            if whole[i]:
                out.append(np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32))
            elif loose[i]:
                out.append(self.parts.of(np.array(rest[i], np.int64))[0])
            else:
                out.append(next(each))
        return out


_encoders: dict[str, Encoder] = {}


def encoder(spec: str) -> Encoder:
    name = hashlib.sha256(spec.encode()).hexdigest()
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = Encoder(spec)
    return _encoders[name]


def _runs(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most FLUSH bytes of text; a longer text stands alone."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + FLUSH, "right")))
        yield lo, hi
        lo = hi


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if len(data) >= 8 else None


def _train(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples themselves as raw content where there are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        raw = b"".join(samples)[:DICTIONARY_BYTES]
        return raw if len(raw) >= 8 else b""


def write_tokens(docs: DataFrame, path: str, tokenizer: str, text: str = "text", key: str = "doc_id", end_id: int | None = 0) -> None:
    """Encode every whole text, append end_id, and write the ids in ascending order of the key below path.

    tokenizer: a file that the driver can open; its contents are broadcast. A null text counts as empty. Null keys come first; rows
    with equal keys are ordered by a hash of their text, equal rows stay all. Other columns are ignored. An
    empty table gives an empty store.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    spec = Path(tokenizer).read_text()
    short = docs.where(F.col(key).isNotNull() & F.length(text).between(1, SAMPLE_CHARS))
    chosen = short.select(key).orderBy(F.xxhash64(key), key).limit(SAMPLE)
    texts = [r[0] for r in short.join(F.broadcast(chosen.distinct()), key, "left_semi").select(text).limit(SAMPLE).collect()]
    enc = encoder(spec)
    width = 2 if enc.tokenizer.get_vocab_size() <= 1 << 16 else 4
    end = np.array([] if end_id is None else [end_id], f"<u{width}")

    def packed(ids: np.ndarray) -> bytes:
        return np.concatenate((ids.astype(end.dtype), end)).tobytes()

    trained = _train([packed(x) for x in enc.encode(pa.array(sorted(texts), pa.string()))])
    name = hashlib.sha256(trained).hexdigest()
    spark.createDataFrame([(trained, name, width, hashlib.sha256(spec.encode()).hexdigest())], "dictionary binary, sha256 string, width int, tokenizer string").coalesce(1).write.parquet(f"{path}/dictionary")
    given = spark.sparkContext.broadcast((spec, trained))

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(given.value[0])
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(given.value[1]))
        for batch in batches:
            for lo, hi in _runs(batch.column(3)):
                part = batch.slice(lo, hi - lo)
                ids = [packed(x) for x in e.encode(part.column(3))]
                yield pa.record_batch([*part.columns[:3], pa.array([len(x) // width for x in ids], pa.int64()), pa.array([press.compress(x) for x in ids], pa.binary())], ["key", "tie", "rid", "count", "frame"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, start, keys, counts, parts, size = TaskContext.get().partitionId(), 0, 0, [], [], [], 0

        def row():
            return pa.RecordBatch.from_pylist([{"part": part, "block": block, "start": start, "tokens": sum(counts), "dictionary": name, "payload": b"".join(parts), "keys": keys, "offsets": list(accumulate(map(len, parts), initial=0)), "counts": counts}], schema=_BLOCKS)

        for batch in batches:
            for k, c, f in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                keys.append(k)
                counts.append(c)
                parts.append(f)
                size += len(f)
                if size >= BLOCK:
                    yield row()
                    block, start, keys, counts, parts, size = block + 1, start + sum(counts), [], [], [], 0
        if keys:
            yield row()

    rows = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("rid"), F.col(text).alias("text"))
    made = stored(rows.mapInArrow(frames, "key long, tie long, rid long, count long, frame binary"))  # the range sampling reads it again
    order = [F.col("key").asc_nulls_first(), "tie", "rid"]
    made.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(blocks, _BLOCKS_SQL).write.parquet(f"{path}/blocks")


_BLOCKS = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("tokens", pa.int64()), ("dictionary", pa.string()), ("payload", pa.binary()), ("keys", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])
_BLOCKS_SQL = "part int, block int, start long, tokens long, dictionary string, payload binary, keys array<long>, offsets array<long>, counts array<long>"


def read_tokens(spark: SparkSession, path: str, wanted: list[int] | None = None) -> DataFrame:
    """key, start (ids of all documents before it), n_tokens and ids (little-endian 32-bit) of the documents of a store.

    wanted: only these keys; blocks without them are skipped and only their frames are decompressed.
    """
    head = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(head.dictionary).hexdigest() != head.sha256:
        raise ValueError("the dictionary does not have the recorded hash")
    rows = spark.read.schema(_BLOCKS_SQL).parquet(f"{path}/blocks")
    totals = {r.part: r.n for r in rows.groupBy("part").agg(F.sum("tokens").alias("n")).collect()}  # one row per written part
    before = dict(zip(sorted(totals), accumulate((totals[p] for p in sorted(totals)), initial=0)))
    given = spark.sparkContext.broadcast((bytes(head.dictionary), head.sha256, head.width, before))
    keep = None if wanted is None else frozenset(wanted)
    if keep is not None:
        rows = rows.where(F.exists("keys", lambda k: k.isin(*keep) if keep else F.lit(False)))

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained, name, width, ahead = given.value
        unpress = zstandard.ZstdDecompressor(dict_data=_dictionary(trained))
        for batch in batches:
            for i in range(batch.num_rows):
                part, start, used, payload, keys, offsets, counts = (batch.column(c)[i].as_py() for c in range(7))
                if used != name:
                    raise ValueError("a block was written with another dictionary")
                at = list(accumulate(counts, initial=ahead[part] + start))
                pick = [j for j, k in enumerate(keys) if keep is None or k in keep]
                found = [np.frombuffer(unpress.decompress(payload[offsets[j] : offsets[j + 1]], max_output_size=counts[j] * width), f"<u{width}").astype("<u4").tobytes() for j in pick]
                if any(len(f) != 4 * counts[j] for f, j in zip(found, pick, strict=True)):
                    raise ValueError("a frame does not hold the recorded number of ids")
                yield pa.record_batch([pa.array([keys[j] for j in pick], pa.int64()), pa.array([at[j] for j in pick], pa.int64()), pa.array([counts[j] for j in pick], pa.int64()), pa.array(found, pa.binary())], ["key", "start", "n_tokens", "ids"])

    return rows.select("part", "start", "dictionary", "payload", "keys", "offsets", "counts").mapInArrow(ids, "key long, start long, n_tokens long, ids binary")
