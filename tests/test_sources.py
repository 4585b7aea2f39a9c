import pytest

from genolith.functions import sequence as sq
from genolith.operators import mutations as mu
from genolith.operators import tensor as tn
from genolith.sources import text as tx
from genolith.sources.store import Dataset


def put(path, text):
    path.write_text(text)
    return str(path)


def test_bed_and_errors(spark, tmp_path):
    p = put(tmp_path / "a.bed", "#h\nc1\t0\t10\nc1\t20\t30\n")
    assert [(r.start, r.feature) for r in tx.read_bed(spark, p, sort=True).collect()] == [(0, "1"), (20, "1")]
    with pytest.raises(tx.FormatError):
        tx.read_bed(spark, put(tmp_path / "b.bed", "#only\n"))
    with pytest.raises(tx.FormatError):
        tx.read_bed(spark, put(tmp_path / "c.bed", "c1\t5\n"))


def test_bed12_round_trip(spark, tmp_path):
    line = "c1\t100\t190\t0\t0\t+\t100\t190\t0,0,0\t2\t10,20\t0,70"
    r = tx.read_bed12(spark, put(tmp_path / "r.bed", line + "\n"))
    assert [(b.start, b.end) for b in r.first().blocks] == [(100, 110), (170, 190)]
    assert tx.check_region_ids(r)
    assert tx.format_bed12(r.withColumnRenamed("name", "locus")).first()[0] == line


def test_gtf_filter_and_format(spark, tmp_path):
    text = 'c1\tx\tgene\t11\t20\t.\t+\t.\tgene_id "g1"; gene_name "A B";\nc1\tx\texon\t11\t12\t.\t+\t.\tgene_id "g1";\n'
    g = tx.read_gtf(spark, put(tmp_path / "a.gtf", text))
    genes = tx.filter_records(g, "gene", ["gene_name"], {"gene_id": ["g1"]})
    assert tx.format_records(genes, "{seqname}\\t{start}\\t{gene_name}", zero_based=True).first()[0] == "c1\t10\tA B"
    with pytest.raises(tx.FormatError):
        tx.format_records(g, "{gene_name}")
    with pytest.raises(tx.FormatError):
        tx.format_records(genes.where("false"), "{start}")


def test_fasta_vcf_and_cells(spark, tmp_path):
    fa = tx.read_fasta(spark, put(tmp_path / "a.fa", ">c1 x\nacgtac\nGTTCAN\n>c2\nTTT\n"), chunk=4)
    assert [r.seq for r in fa.where("chrom = 'c1'").orderBy("chunk").collect()] == ["ACGTA", "TACGTT", "TTCAN"]
    head = "##x\n##contig=<ID=c1,length=12>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts\n"
    body = "c1\t2\t.\tC\tT,G\t.\tPASS\tclusterSize=5;VAF=0.4\tGT\t1\nc1\t3\t.\tG\tA\t.\tPASS\t.\tGT\t1\nc1\t4\t.\tA\tG\t.\tPASS\t.\tGT\t1\nc1\t5\t.\tA\tAT\t.\tPASS\t.\tGT\t1\nc1\t6\t.\tC\tA\t.\tq10\t.\tGT\t1\n"
    p = put(tmp_path / "a.vcf", head + body)
    v = tx.read_vcf(spark, p, weight="VAF")
    assert sorted(r.id for r in v.collect()) == ["c1:2:C:G", "c1:2:C:T", "c1:3:G:A", "c1:4:A:G"]
    cells = {r.id: (r.configuration, r.context) for r in mu.to_cells(mu.with_context(v, fa, 4)).where("ok").collect()}
    assert cells == {"c1:2:C:T": (0, "A[C>T]G"), "c1:2:C:G": (0, "A[C>G]G"), "c1:3:G:A": (1, "A[C>T]G")}  # the wrong REF at 4 falls out
    assert tx.contig_sizes(spark, p).first().asDict() == {"chrom": "c1", "size": 12}
    notes = spark.createDataFrame([("c1", 1, 0.5)], "chrom string, pos0 long, logp double")
    lines = [r.value for r in tx.annotate_vcf(spark, p, notes, {"logp": "Float"}).orderBy("rank").collect()]
    assert lines[2].startswith("##INFO=<ID=logp") and lines[3].startswith("#CHROM") and "VAF=0.4;logp=0.5" in lines[4]


def test_vocabulary():
    labels = sq.cosmic_labels()
    assert len(labels) == 96 == len(set(labels)) and labels[0] == "A[C>A]A" and sorted(sq.display_order()) == list(range(96))


def test_parse_region():
    assert tn.parse_region("chr2:1,000-2_000") == ("chr2", 1000, 2000)
    assert tn.parse_region("chr2:5") == ("chr2", 5, None) and tn.parse_region("chr2") == ("chr2", 0, None)
    with pytest.raises(ValueError):
        tn.parse_region("chr2:9-3")


def test_dataset_store(spark, tmp_path):
    regions = spark.createDataFrame([(0, "c1", 0, 10, 10.0), (1, "c1", 10, 20, 10.0), (2, "c2", 0, 5, 5.0)], "locus long, chrom string, start long, end long, length double")
    ds = Dataset.create(spark, str(tmp_path / "d"), "toy", regions)
    assert "there are no features" in ds.problems()
    ds.add_feature("gc", regions.selectExpr("locus", "length as num"), "continuous", "minmax")
    with pytest.raises(ValueError):
        ds.add_feature("bad", regions.selectExpr("locus", "length as num"), "strand", "minmax")
    assert ds.problems() == []
    obs = spark.createDataFrame([(0, "A[C>A]A", 0, 1.0), (0, "A[C>A]A", 2, 0.5)], "configuration int, context string, locus long, weight double")
    ds.add_sample("s1", obs)
    ds.add_sample("s2", obs)
    ds.add_sample("s1", obs.limit(1))
    assert ds.list_samples() == ["s1", "s2"] and ds.observations(["s1"]).count() == 1
    assert ds.remove_sample("s2") and not ds.remove_sample("zz") and ds.list_samples() == ["s1"]
    with pytest.raises(ValueError):
        ds.observations(["s2"])
    cut = ds.slice(str(tmp_path / "e"), ["c2"])
    assert cut.table("regions").count() == 1 and cut.table("observations").where("locus <> 2").isEmpty()
    ds.remove_feature("gc")
    assert ds.features().isEmpty() and ds.list_features().isEmpty()
    with pytest.raises(KeyError):
        ds.edit_feature("zz", grp="x")
