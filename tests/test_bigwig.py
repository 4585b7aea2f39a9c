"""bigWig files, written here block by block, against the same values as bedGraph."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from genolith.operators import intervals as iv
from genolith.plans.compose import Feature, feature_values
from genolith.sources import text as tx
from genolith.sources.bigwig import BigWig, Bounds, _File, read_bigwig

CHROMS = {"chr1": (0, 9000), "chr2": (1, 5000), "chrX": (2, 700)}


def sections(o):
    """(chrom, start, end, block, rows) of all three kinds."""
    out = []
    for i in range(12):
        rows = [(i * 500 + j * 20, i * 500 + j * 20 + 15, float(i + j) / 4) for j in range(20)]
        out.append((0, rows, struct.pack(f"{o}IIIIIBBH", 0, rows[0][0], rows[-1][1], 0, 0, 1, 0, len(rows)) + b"".join(struct.pack(f"{o}IIf", *r) for r in rows)))
    rows = [(s, s + 7, s / 8) for s in (5, 30, 400, 1200)]
    out.append((1, rows, struct.pack(f"{o}IIIIIBBH", 1, 5, 1207, 0, 7, 2, 0, 4) + b"".join(struct.pack(f"{o}If", s, v) for s, _, v in rows)))
    rows = [(100 + 50 * j, 100 + 50 * j + 50, j / 2) for j in range(10)]
    out.append((2, rows, struct.pack(f"{o}IIIIIBBH", 2, 100, 600, 50, 50, 3, 0, 10) + b"".join(struct.pack(f"{o}f", v) for _, _, v in rows)))
    return out


def write(path, o="<", packed=True, per_leaf=5):
    found = sections(o)
    names = struct.pack(f"{o}IIIIQQ", 0x78CA8C91, 4, 4, 8, 3, 0) + struct.pack(f"{o}BBH", 1, 0, 3) + b"".join(n.encode().ljust(4, b"\0") + struct.pack(f"{o}II", *v) for n, v in CHROMS.items())
    data, places = b"", []
    start = 64 + len(names)
    for chrom, rows, block in found:
        block = zlib.compress(block) if packed else block
        places.append((chrom, rows[0][0], chrom, rows[-1][1], start + len(data), len(block)))
        data += block
    index_at = start + len(data)
    groups = [places[i : i + per_leaf] for i in range(0, len(places), per_leaf)]
    body = struct.pack(f"{o}BBH", 0, 0, len(groups))
    at = index_at + 48 + 4 + 24 * len(groups)
    leaves = b""
    for g in groups:
        ends = (g[-1][2], max(x[3] for x in g)) if g[0][0] == g[-1][2] else (g[-1][2], g[-1][3])
        body += struct.pack(f"{o}IIIIQ", g[0][0], g[0][1], *ends, at + len(leaves))
        leaves += struct.pack(f"{o}BBH", 1, 0, len(g)) + b"".join(struct.pack(f"{o}IIIIQQ", *x) for x in g)
    index = struct.pack(f"{o}IIQIIIIQII", 0x2468ACE0, per_leaf, len(places), 0, 0, 2, 700, index_at, 1, 0) + body + leaves
    head = struct.pack(f"{o}IHHQQQHHQQIQ", 0x888FFC26, 4, 0, 64, start, index_at, 0, 0, 0, 0, 1 << 15 if packed else 0, 0)
    path.write_bytes(head + names + data + index)
    return [(list(CHROMS)[c], s, e, v) for c, rows, _ in found for s, e, v in rows]


@pytest.mark.parametrize(("order", "packed"), [("<", True), (">", False)])
def test_values_partitions_and_filters(spark, tmp_path, order, packed):
    path = tmp_path / "a.bw"
    want = sorted(write(path, order, packed))
    df = read_bigwig(spark, str(path), part=150)
    assert sorted(map(tuple, df.collect())) == want and df.rdd.getNumPartitions() > 2
    some = df.where("chrom = 'chr1' and start < 2000 and `end` > 1100")
    assert sorted(map(tuple, some.collect())) == [r for r in want if r[0] == "chr1" and r[1] < 2000 and r[2] > 1100]
    assert sorted(map(tuple, df.where(F.col("chrom").isin("chr2", "chrX")).collect())) == [r for r in want if r[0] != "chr1"]
    assert df.where("chrom = 'chr9'").count() == 0
    file = _File(f"file:{path}")
    assert len(list(file.blocks(None, 1e9, -1))) == 14 and len(list(file.blocks({0}, 2000, 1100))) == 2 and len(list(file.blocks({2}, 1e9, -1))) == 1
    reader = BigWig({"path": str(path)}).reader(None)
    reader.bounds = Bounds({"chr2"})
    assert [len(p.blocks) for p in reader.partitions()] == [1]


def test_same_means_as_bedgraph(spark, tmp_path):
    rows = write(tmp_path / "a.bw")
    (tmp_path / "a.bedgraph").write_text("".join(f"{c}\t{s}\t{e}\t{v}\n" for c, s, e, v in rows))
    regions = spark.createDataFrame([(i, c, s, s + 333) for i, (c, s) in enumerate([("chr1", 0), ("chr1", 700), ("chr1", 5400), ("chr2", 20), ("chr2", 3000), ("chrX", 90)])], "locus long, chrom string, start long, end long")
    got, want = ({r.locus: r["mean"] for r in iv.weighted_mean(regions, t, ["locus"]).collect()} for t in (read_bigwig(spark, str(tmp_path / "a.bw")), tx.read_bedgraph(spark, str(tmp_path / "a.bedgraph"))))
    assert got == pytest.approx(want) and want[4] is None
    feature = {r.locus: r.num for r in feature_values(spark, regions, Feature(str(tmp_path / "a.bw"), "standardize"), 500).collect()}
    assert feature == pytest.approx(want)
    (tmp_path / "b.bw").write_bytes(b"no" * 50)
    with pytest.raises(Exception, match="no bigWig"):
        read_bigwig(spark, str(tmp_path / "b.bw")).count()
