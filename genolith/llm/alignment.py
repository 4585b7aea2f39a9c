"""Cross-tokenizer alignment: which tokens of one tokenizer stand over which tokens of another.

A byte offset at which tokens of both tokenizers end cuts a text into groups; all tokens of one side in a group are linked to all of the
other. Each Arrow partition aligns with DuckDB: tables of token intervals, an ASOF join of ends to find the cuts, window sums to number the
groups, range joins of intervals with groups to find the links. Spark merges the partial counts of id pairs and hands the totals back.

No token of either side reaches across the place where a space or line break follows a visible character, and what stands
between two such places has the same tokens everywhere. So a text is cut there, and every distinct part is aligned once a worker.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from genolith.llm.common import BATCH_ROWS, bound_batches, stored
from genolith.llm.tokenstore import _LOOSE, _runs

#: Bytes of text whose pairs are counted together before Spark merges them, and distinct parts that a worker remembers at most.
CHUNK, CACHE = 4_000_000, 400_000
#: Pairs in a row: rows are small, since readers and writers of Parquet hold hundreds of them at once.
SLICE = 4_096
_CUT = re.compile(r"(?<=[^\s᠎])(?=[ \n])")

_ALIGN = """
    create or replace temp table cuts as
        select a.part, a.hi, row_number() over (order by a.hi) as g, coalesce(lag(a.hi) over (order by a.hi), 0) as lo
        from a asof join b on a.hi <= b.hi where a.hi = b.hi;
    create or replace temp table spans as
        select part, g, lo, hi, g - min(g) over (partition by part) as nth, sum(1) over (partition by part) as n_groups from cuts;
    create or replace temp table in_a as select s.part, s.g, a.i, a.id from a asof join spans s on a.hi <= s.hi;
    create or replace temp table in_b as select s.part, s.g, b.i, b.id from b asof join spans s on b.hi <= s.hi;
    create or replace temp table crossed as
        select s.part, a.id as a, b.id as b, count(*) as n
        from spans s join in_a a on a.g = s.g join b on b.lo >= s.lo and b.lo < s.hi group by all;
"""


class Aligner:
    """Tokens, groups and links of texts; distinct parts are numbered, and DuckDB holds the links of each."""

    def __init__(self, left: str, right: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import duckdb
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(left), sentencepiece.SentencePieceProcessor(model_proto=right)
        self.a.encode_special_tokens = True
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        self.a_bytes = {i: bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        b = self.b
        pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        self.a_size = np.zeros(max(self.a_bytes) + 1, np.int64)
        self.a_size[list(self.a_bytes)] = list(map(len, self.a_bytes.values()))
        self.b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.b_size = np.fromiter(map(len, self.b_bytes), np.int64)
        self.mark = b.piece_to_id("▁")
        self.cuttable = not any("▁" in p.lstrip("▁") or "\n" in p for i, p in enumerate(pieces) if not b.is_byte(i))
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        self.reset()

    def reset(self) -> None:
        self.numbers: dict[str, int] = {}
        self.groups: list[str] = []
        self.sizes = np.zeros((0, 5), np.int64)  # ids of both sides, groups, links, and whether the bytes are those of the text
        self.db.execute("create or replace temp table links (part int, a int, b int, n bigint)")

    def _ids(self, parts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        left = [e.ids for e in self.a.encode_batch(parts, add_special_tokens=False)]
        right = self.b.encode([p[1:] if p[0] == " " else p for p in parts], num_threads=1)
        # the model puts a space before every text but an empty one, so a part that has none loses that token
        return left, [[self.mark] if p == " " else r if p[0] == " " else r[1:] if r[:1] == [self.mark] else [] for p, r in zip(parts, right, strict=True)]

    def learn(self, parts: list[str]) -> None:
        """Align parts not seen before; they get the next numbers."""
        first, n = len(self.groups), len(parts)
        left, right = self._ids(parts)
        raw = [p.encode() for p in parts]
        fits = np.fromiter((b"".join(map(self.a_bytes.__getitem__, x)) == r == b"".join(map(self.b_bytes.__getitem__, y)) for x, y, r in zip(left, right, raw, strict=True)), bool, n)
        if not fits.all():
            left, right = [x if f else [] for x, f in zip(left, fits, strict=True)], [y if f else [] for y, f in zip(right, fits, strict=True)]
        sizes = np.zeros((n, 5), np.int64)
        sizes[:, 0], sizes[:, 1], sizes[:, 4] = list(map(len, left)), list(map(len, right)), fits

        def intervals(ids: list[list[int]], counts: np.ndarray, size: np.ndarray) -> pa.Table:
            flat = np.array(list(chain.from_iterable(ids)), np.int64)
            width = size[flat]
            ends = np.cumsum(width)
            return pa.table({"part": first + np.repeat(np.arange(n), counts), "i": np.arange(len(flat)), "id": flat, "lo": ends - width, "hi": ends})

        self.db.register("a", intervals(left, sizes[:, 0], self.a_size))
        self.db.register("b", intervals(right, sizes[:, 1], self.b_size))
        self.db.execute(_ALIGN)
        self.db.execute("insert into links select part, a, b, n from crossed")
        found = self.db.execute("select part, sum(n)::bigint as n from crossed group by part").fetchnumpy()
        sizes[found["part"] - first, 3] = found["n"]
        found = self.db.execute("select part, any_value(n_groups)::bigint as n from spans group by part").fetchnumpy()
        sizes[found["part"] - first, 2] = found["n"]
        sides = []
        for side in ("in_a", "in_b"):
            x = self.db.execute(f"select g, id::varchar as id from {side} order by i").fetchnumpy()
            ids, ends = x["id"].tolist(), np.cumsum(np.bincount(x["g"] - 1, minlength=sizes[:, 2].sum())).tolist()
            sides.append([ids[lo] if hi == lo + 1 else ",".join(ids[lo:hi]) for lo, hi in zip([0, *ends], ends)])
        groups = list(map("|".join, zip(*sides, strict=True)))
        ends = np.cumsum(sizes[:, 2]).tolist()
        self.groups += [";".join(groups[lo:hi]) for lo, hi in zip([0, *ends], ends)]
        self.sizes = np.concatenate((self.sizes, sizes))

    def parts(self, texts: pa.Array) -> list[np.ndarray]:
        """The part numbers of each text behind a space; those of null and empty texts are none."""
        if len(self.numbers) > CACHE:
            self.reset()
        texts = texts.fill_null("")
        loose = pc.match_substring_regex(texts, _LOOSE).to_numpy(zero_copy_only=False) if self.cuttable else np.ones(len(texts), bool)
        plain = texts.filter(pa.array(~loose))
        cut = pc.split_pattern(pc.replace_substring(plain, "\n", " \n"), " ")
        flat = cut.flatten().dictionary_encode()
        known = [p if p[:1] == "\n" else f" {p}" for p in flat.dictionary.to_pylist()]
        rest = {i: _CUT.split(f" {texts[i].as_py()}") if self.cuttable else [f" {texts[i].as_py()}"] for i in np.flatnonzero(loose).tolist()}
        new = [p for p in dict.fromkeys(chain(known, *rest.values())) if p not in self.numbers]
        for lo in range(0, len(new), 20_000):
            some = new[lo : lo + 20_000]
            self.learn(some)
            self.numbers.update(zip(some, range(len(self.numbers), len(self.numbers) + len(some)), strict=True))
        at = np.fromiter((self.numbers.get(p, -1) for p in known), np.int64, len(known))[flat.indices.to_numpy()]
        each = iter(np.split(at, cut.offsets.to_numpy()[1:-1] - cut.offsets.to_numpy()[0]))
        empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
        out = [np.fromiter(map(self.numbers.__getitem__, rest[i]), np.int64) if loose[i] else next(each) for i in range(len(texts))]
        return [x[:0] if e or not self.sizes[x, 4].all() else x for x, e in zip(out, empty, strict=True)]

    def align(self, texts: pa.Array) -> tuple[np.ndarray, list[str], dict[str, np.ndarray]]:
        """Counts of each text (ids left and right, groups, links), the sha256 of its groups, and links: text, a, b, n (by text and ids)."""
        parts = self.parts(texts)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        doc, flat = np.repeat(np.arange(len(parts)), lengths), np.concatenate(parts) if parts else np.zeros(0, np.int64)
        counts = np.zeros((len(parts), 4), np.int64)
        np.add.at(counts, doc, self.sizes[flat, :4])
        pick = self.groups.__getitem__
        sums = [hashlib.sha256(";".join(map(pick, p.tolist())).encode()).hexdigest() if len(p) else "" for p in parts]
        self.db.register("uses", pa.table({"doc": doc.astype(np.int32), "part": flat.astype(np.int32)}))
        links = self.db.execute("select u.doc, l.a, l.b, sum(u.n * l.n)::bigint as n from (select doc, part, count(*) as n from uses group by all) u join links l on l.part = u.part group by all order by all").fetchnumpy()
        return counts, sums, links


_aligners: dict[str, Aligner] = {}


def aligner(left: str, right: bytes) -> Aligner:
    name = hashlib.sha256(left.encode() + right).hexdigest()
    if name not in _aligners:
        _aligners.clear()
        _aligners[name] = Aligner(left, right)
    return _aligners[name]


class _Chunk:
    """Documents whose pairs are counted together."""

    def __init__(self) -> None:
        self.keys, self.counts, self.sums, self.links, self.docs, self.size = [], [], [], [], 0, 0

    def add(self, keys: pa.Array, counts: np.ndarray, sums: list[str], links: dict[str, np.ndarray], size: int) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.sums += sums
        self.links.append((links["doc"].astype(np.int64) + self.docs, links["a"].astype(np.int64) << 32 | links["b"].astype(np.int64), links["n"].astype(np.int64)))
        self.docs += len(keys)
        self.size += size

    def rows(self, number: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """A row for each document, then one for each SLICE of the chunk's distinct pairs."""
        doc, pair, n = (np.concatenate(x) for x in zip(*self.links, strict=True))
        distinct, at, held = np.unique(pair, return_inverse=True, return_counts=True)
        ends = np.concatenate(([0], np.searchsorted(doc, np.arange(self.docs), "right"))).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x, pa.int64())) for x in (at, n)]
        given = dict(zip(schema.names, (np.full(self.docs, number), pa.concat_arrays(self.keys), *np.concatenate(self.counts).T, pa.array(self.sums, pa.string()), *lists), strict=False))
        for lo in range(0, self.docs, BATCH_ROWS):
            hi = min(self.docs, lo + BATCH_ROWS)
            yield pa.record_batch([pa.array(given[f.name][lo:hi]).cast(f.type) if f.name in given else pa.nulls(hi - lo, f.type) for f in schema], schema)
        for lo in range(0, len(distinct), SLICE):
            some = slice(lo, lo + SLICE)
            row = {"chunk": number, "first": lo, "a": distinct[some] >> 32, "b": distinct[some] & 0xFFFFFFFF, "docs": held[some]}
            yield pa.record_batch([pa.array([row.get(f.name)], f.type) for f in schema], schema)


def align(docs: DataFrame, left: str, right: str, text: str = "text", key: str = "doc_id", chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Alignment of the tokens of every whole text by two tokenizers: a row per document, and a row per linked pair of ids.

    left: file of a byte-level BPE of the tokenizers library, applied to a space and the text; right: model of a sentencepiece BPE with byte
    fallback that puts a space before a text itself. The strings of special tokens are plain text. Both are opened on the driver and broadcast.

    Documents: key, n_a, n_b, n_groups, n_links, n_best (links whose pair's count is the highest of its left id, ties included), count_sum (of
    the pairs' counts over all links), groups_sha256. Pairs: a, b, count (documents that hold the pair linked), best. A null or empty text, or one whose tokens don't give
    back its bytes, has zeros and ''. Rows with a null or repeated key count as documents of their own; an empty table gives empty results; other
    columns are ignored.

    Scale: one pass over the texts. Pairs are counted by chunk of CHUNK bytes before they are shuffled, so a pair that stands in every document
    is a row for each chunk, not for each document; what a document keeps is one number for each of its distinct pairs.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    given = spark.sparkContext.broadcast((Path(left).read_text(), Path(right).read_bytes()))
    base = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = base.schema[0].dataType.simpleString()
    sql = f"chunk bigint, key {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, sum string, pair array<int>, times array<bigint>, first int, a array<int>, b array<int>, docs array<int>"
    schema = to_arrow_schema(StructType.fromDDL(sql))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, one, number = aligner(*given.value), _Chunk(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo, hi in _runs(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                one.add(part.column(0), *e.align(part.column(1)), pc.sum(pc.binary_length(part.column(1))).as_py() or 0)
                if one.size >= chunk:
                    yield from one.rows(number, schema)
                    one, number = _Chunk(), number + 1
        if one.docs:
            yield from one.rows(number, schema)

    made = stored(base.mapInArrow(run, sql))
    slices = made.where("first is not null").select("chunk", "first", F.posexplode(F.arrays_zip("a", "b", "docs")).alias("i", "p"))
    each = slices.select("chunk", (F.col("first") + F.col("i")).alias("at"), F.col("p.a").alias("a"), F.col("p.b").alias("b"), F.col("p.docs").alias("docs"))
    totals = stored(each.groupBy("a", "b").agg(F.sum("docs").alias("count")))
    most = totals.groupBy("a").agg(F.max("count").alias("most"))
    pairs = totals.join(most, "a").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))
    back = each.join(pairs, ["a", "b"]).select(F.col("chunk").alias("of"), "at", "count", "best")

    def score(part: pa.Table, marks: pa.Table) -> pa.Table:
        at = marks["at"].to_numpy()
        count, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        count[at], best[at] = marks["count"].to_numpy(), marks["best"].to_numpy()
        p, t = (pc.list_flatten(part[c]).to_numpy() for c in ("pair", "times"))
        ends = np.concatenate(([0], np.cumsum(pc.list_value_length(part["pair"]).to_numpy())))
        total = [np.diff(np.concatenate(([0], np.cumsum(x[p] * t)))[ends]) for x in (best, count)]
        return pa.table([*(part[c] for c in ("key", "n_a", "n_b", "n_groups", "n_links")), *(pa.array(x, pa.int64()) for x in total), part["sum"]], [key, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    # the documents of a chunk meet its pairs in a group of bounded size
    whole = made.where("first is null").select("chunk", "key", "n_a", "n_b", "n_groups", "n_links", "sum", "pair", "times")
    out = whole.groupBy("chunk").cogroup(back.groupBy("of")).applyInArrow(score, f"`{key}` {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")
    return out, pairs
