"""Sequence and mutation vocabulary of single-base substitutions, as columns and small dimension tables."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASES = "ACGT"
#: 32 trinucleotides with centre C or T, by (centre, 5', 3').
CONTEXTS = [f + c + t for c in "CT" for f in BASES for t in BASES]
#: Mutation classes; the third means T for a centre C and C for a centre T.
CLASSES = ("N->A", "N->G", "N->T/C")
CONFIGURATIONS = ("C/T-centered", "A/G-centered")


def revcomp(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def _alt(centre: str, k: int) -> str:
    return "AG"[k] if k < 2 else ("T" if centre == "C" else "C")


def cosmic_labels() -> list[str]:
    """96 labels such as A[C>A]A, contexts times classes."""
    return [f"{c[0]}[{c[1]}>{_alt(c[1], k)}]{c[2]}" for c in CONTEXTS for k in range(3)]


def display_order() -> list[int]:
    """Permutation of the labels for display: by (mutation, 5', 3')."""
    labels = cosmic_labels()
    return sorted(range(96), key=lambda i: (labels[i][2:5], labels[i][0], labels[i][6]))


def dim_context(spark: SparkSession) -> DataFrame:
    """(index, label, trinucleotide, class, mutation), 96 rows."""
    rows = [(3 * i + k, label, c, k, label[2:5]) for i, c in enumerate(CONTEXTS) for k in range(3) for label in [cosmic_labels()[3 * i + k]]]
    return spark.createDataFrame(rows, "index int, label string, trinucleotide string, class int, mutation string")


def format_cosmic(trinucleotide: Column, alt: Column) -> Column:
    return F.concat(F.substring(trinucleotide, 1, 1), F.lit("["), F.substring(trinucleotide, 2, 1), F.lit(">"), alt, F.lit("]"), F.substring(trinucleotide, 3, 1))


def unformat_cosmic(label: Column) -> tuple[Column, Column]:
    """(trinucleotide, alt) of a label."""
    return F.concat(F.substring(label, 1, 1), F.substring(label, 3, 1), F.substring(label, 7, 1)), F.substring(label, 5, 1)


def canonical(trinucleotide: Column, alt: Column) -> tuple[Column, Column, Column]:
    """(configuration, trinucleotide, alt): purine-centred mutations are turned to the other strand with configuration 1."""
    flip = F.substring(trinucleotide, 2, 1).isin("A", "G")
    return F.when(flip, 1).otherwise(0), F.when(flip, revcomp(trinucleotide)).otherwise(trinucleotide), F.when(flip, F.translate(alt, "ACGT", "TGCA")).otherwise(alt)


def mutation_class(alt: Column) -> Column:
    return F.when(alt == "A", 0).when(alt == "G", 1).otherwise(2)


def is_base(c: Column) -> Column:
    """One letter of ACGT: multi-base alleles don't pass."""
    return (F.length(c) == 1) & c.isin(*BASES)


def _counter(k: int) -> Callable[[pa.StringScalar], np.ndarray | None]:
    """Counts of the 5**k words of k letters of ACGT and N in a text, in this order; None for a text that has no word."""
    code = np.full(256, 4, np.int64)
    for letters in (BASES, BASES.lower()):
        code[[ord(b) for b in letters]] = range(4)

    def count(text: pa.StringScalar) -> np.ndarray | None:
        raw = np.frombuffer(text.as_buffer(), np.uint8)
        c = code[raw[(raw & 0xC0) != 0x80]]  # one code for each character of more than one byte
        if len(c) < k:
            return None
        at = np.zeros(len(c) - k + 1, np.int64)
        for j in range(k):
            at = at * 5 + c[j : len(c) - k + 1 + j]
        return np.bincount(at, minlength=5**k)

    return count


def kmer_counts(sequences: DataFrame, key: str, seq: str, k: int = 3) -> DataFrame:
    """(key, kmer, n) of sequences in either case, where every letter but A, C, G and T counts as N.

    Counted per row in numpy over Arrow batches, so at most 5**k rows leave a row and none is made for a position. Rows with equal keys are added up.
    """
    count = _counter(k)
    names = np.array(["".join(x) for x in itertools.product([*BASES, "N"], repeat=k)], object)
    kind = sequences.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(1)):
                n = count(text)
                if n is not None:
                    found = np.flatnonzero(n)
                    yield pa.record_batch([batch.column(0).take(pa.array(np.full(len(found), i))), pa.array(names[found], pa.string()), pa.array(n[found], pa.int64())], [key, "kmer", "n"])

    rows = sequences.where(F.col(seq).isNotNull()).select(key, seq).mapInArrow(run, f"`{key}` {kind}, kmer string, n long")
    return rows.groupBy(key, "kmer").agg(F.sum("n").alias("n"))


def context_frequencies(sequences: DataFrame, key: str, seq: str) -> DataFrame:
    """(key, configuration, trinucleotide, freq): counts in both orientations; 3-mers with N are spread as a pseudocount of one 64th each.

    Each of the 3 mutations of a context has the same frequency, so a long form with 96 contexts is this table joined with dim_context.
    """
    turned = str.maketrans("ACGT", "TGCA")
    words = ["".join(x) for x in itertools.product([*BASES, "N"], repeat=3)]
    cells = [(c, x) for c in (0, 1) for x in CONTEXTS]
    places = np.array([words.index(x[::-1].translate(turned) if c else x) for c, x in cells])
    count = _counter(3)
    unknown = np.array(["N" in w for w in words])
    kind = sequences.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, n) for i, text in enumerate(batch.column(1)) if (n := count(text)) is not None]
            if found:
                table = np.stack([np.append(n[places], n[unknown].sum()) for _, n in found])
                arrays = pa.ListArray.from_arrays(pa.array(np.arange(len(table) + 1) * table.shape[1], pa.int32()), pa.array(table.ravel()))
                yield pa.record_batch([batch.column(0).take(pa.array([i for i, _ in found])), arrays], [key, "n_"])

    rows = sequences.where(F.col(seq).isNotNull()).select(key, seq).mapInArrow(run, f"`{key}` {kind.simpleString()}, n_ array<long>")
    sums = rows.groupBy(key).agg(*[F.sum(F.get("n_", i)).alias(f"n{i}_") for i in range(len(cells) + 1)])  # one row a key is shuffled, not one for each word
    pseudo = F.col(f"n{len(cells)}_") / 64
    full = F.array(*[F.struct(F.lit(c).alias("configuration"), F.lit(x).alias("trinucleotide"), (F.col(f"n{i}_") + pseudo).alias("freq")) for i, (c, x) in enumerate(cells)])
    return sums.select(key, F.explode(full).alias("x_")).select(key, "x_.*")  # 64 rows a key: the dense form of the result itself


def region_length(freq: DataFrame, key: str) -> DataFrame:
    """Sum of the 2 x 96 context frequencies: three times the number of 3-mers."""
    return freq.groupBy(key).agg((F.sum("freq") * 3).alias("length"))


def mutation_weight(raw: Column, cluster_size: Column) -> Column:
    """min(raw, 1), divided by the cluster size when that is above 3; null for a weight that is no number."""
    w = F.least(raw.try_cast("double"), F.lit(1.0))
    return w / F.when(cluster_size > 3, cluster_size).otherwise(1)


def exponential_quantile(alpha: float, rate: Column) -> Column:
    return -F.log1p(F.lit(-alpha)) / rate


def masked_fraction(seq: Column) -> Column:
    """Share of lower-case and N bases: masked / (total + 1)."""
    return F.length(F.regexp_replace(seq, "[^a-zN]", "")) / (F.length(seq) + 1)


def subsequence_code(context: Column, positions: list[int]) -> Column:
    """Base-4 code of the bases at the positions (0-based): an index into a one-hot of 4**len columns."""
    code = F.lit(0)
    for p in positions:
        code = code * 4 + F.instr(F.lit(BASES), F.substring(context, p + 1, 1)) - 1
    return code


def strip_version(gene_id: Column) -> Column:
    return F.regexp_replace(gene_id, r"\.[^.]*$", "")
