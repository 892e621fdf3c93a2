"""Block-gzip files by ranges of blocks, and ordered scans of files that are split among tasks."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from veltra.sources import annotations, blocks, genesets, lines, tables, variants

HEADER = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + "\t".join(f"S{i}" for i in range(6))


def call(pos, i):
    return ("0/0", "0/1", "1/1", "./.")[(pos * 7 + i) % 4]


def body(n, chroms=4):
    per = n // chroms
    return [
        f"chr{c}\t{p * 10}\t.\tA\tC\t50\tPASS\tGENE=G{p % 5};CONSEQUENCE=missense_variant;CADD={p % 40}\tGT\t" + "\t".join(call(p, i) for i in range(6))
        for c in range(1, chroms + 1) for p in range(1, per + 1)
    ]


def block_file(path, text, sizes=(700, 40, 9000, 1)):
    """text in blocks of mixed sizes, so that lines cross them in all ways."""
    data, at, k = text.encode(), 0, 0
    with open(path, "wb") as f:
        while at < len(data):
            f.write(blocks.block(data[at : at + sizes[k % len(sizes)]]))
            at += sizes[k % len(sizes)]
            k += 1
        f.write(blocks.block(b""))


@pytest.mark.parametrize("step", [50, 333, 4096, 1 << 20])
@pytest.mark.parametrize("end", ["\n", ""])
def test_ranges_share_out_all_lines(tmp_path, step, end):
    rng = random.Random(step)
    text = "\n".join("x" * rng.choice((0, 1, 30, 700, 3000)) + str(i) for i in range(60)) + end
    path = tmp_path / "a.vcf.gz"
    block_file(path, text)
    assert gzip.open(path, "rt").read() == text  # it is a gzip file, too
    size = path.stat().st_size
    got = []
    with open(path, "rb") as f:
        for start in range(0, size, step):
            got += blocks.lines_of(f, size, start, min(size, start + step))
    assert [x.decode() for x in got] == text.removesuffix("\n").split("\n")


def test_a_block_file_equals_its_text(spark, tmp_path):
    text = HEADER + "\n" + "\n".join([*body(400), "chr9\t5\tshort"]) + "\n"
    (tmp_path / "plain.vcf").write_text(text)
    block_file(tmp_path / "b.vcf.gz", text, (600,))
    for options in ({}, {"sample_subset": ["S4", "S1", "absent"]}, {"region": ("chr2", 300, 700)}, {"sample_subset": ["S5"], "region": ("chr4", 1, 50), "sparse": True}):
        plain, packed = (variants.read_vcf(spark, str(tmp_path / x), **options) for x in ("plain.vcf", "b.vcf.gz"))
        assert sorted(plain.samples) == sorted(packed.samples)
        for name in ("sites", "variants", "genotypes"):
            a, b = (sorted(map(str, getattr(t, name).drop("site").collect())) for t in (plain, packed))
            assert a == b and a, (options, name)


def test_filters_and_samples_reach_the_reader(spark, tmp_path):
    path = str(tmp_path / "b.vcf.gz")
    block_file(path, HEADER + "\n" + "\n".join(body(2000)) + "\n", (900,))
    options = {"path": path, "rangebytes": "2000", "samples": "S2", "sorted": "true"}
    whole, region = blocks.VcfReader(options), blocks.VcfReader(options)
    left = list(region.pushFilters([blocks.EqualTo(("chrom",), "chr3"), blocks.GreaterThanOrEqual(("pos",), 1000), blocks.LessThan(("pos",), 1100), blocks.EqualTo(("value",), "x")]))
    assert left == [blocks.EqualTo(("value",), "x")]
    every, some = whole.partitions(), region.partitions()
    assert len(every) > 16 and 1 <= len(some) <= 8  # where chromosomes change, a range stays
    rows = [r for p in some for b in region.read(p) for r in b.to_pylist()]
    assert [r["pos"] for r in rows] == list(range(1000, 1100, 10)) and {len(r["value"].split("\t")) for r in rows} == {10}
    df = blocks.block_lines(spark, path).where("chrom = 'chr3' and pos >= 1000 and pos < 1100")
    assert df.count() == 10
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "vcf_blocks" in plan and "chr3" not in plan and "1100" not in plan  # Spark has nothing left to compare


def test_written_blocks_are_read_again(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([(x,) for x in body(3000)], "value string").repartition(3)
    blocks.write_blocks(rows, path, HEADER)
    files = [x for x in (tmp_path / "out").iterdir() if not x.name.startswith(".")]
    assert len(files) == 3 and all(gzip.open(x, "rt").read().startswith("##fileformat") for x in files)
    back = blocks.block_lines(spark, path).where("chrom is not null")
    assert sorted(r.value for r in back.collect()) == sorted(body(3000))
    assert variants.read_vcf(spark, path, ["S0"], blocks=True).samples == ["S0"]


def test_what_is_no_block_file(tmp_path):
    with gzip.open(tmp_path / "plain.vcf.gz", "wt") as f:
        f.write(HEADER + "\n")
    assert not blocks.is_blocks(str(tmp_path / "plain.vcf.gz"))
    assert blocks.block_size(b"\x1f\x8b\x08\x04") is None and blocks.block_size(b"") is None
    with pytest.raises(FileNotFoundError):
        blocks.is_blocks(str(tmp_path / "absent.vcf.gz"))


@pytest.fixture
def small_blocks(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "512")
    yield
    spark.conf.set(key, before)


def test_first_and_last_hold_on_split_files(spark, tmp_path, small_blocks):
    clinvar = ["# from somewhere", "#Symbol\tGeneID\tNumber_Pathogenic"] + [f"G{i % 40}\t{i}\t{i}" for i in range(400)] + ["", "short"]
    (tmp_path / "clinvar.tsv").write_text("\n".join(clinvar) + "\n")
    assert spark.read.text(str(tmp_path / "clinvar.tsv")).rdd.getNumPartitions() > 4
    found = {r.symbol: r.gene_id for r in tables.read_clinvar(spark, str(tmp_path / "clinvar.tsv")).collect()}
    assert found == {f"G{i}": 360 + i for i in range(40)}
    vep = ["## x", "#Uploaded_variation\tSYMBOL\tConsequence\tCADD_PHRED"] + [f"v{i % 30}\tA{i}\tmissense\t{9 if i >= 60 else i % 7}" for i in range(300)]
    (tmp_path / "vep.tsv").write_text("\n".join(vep))
    best = {r.key: (r.gene, r.cadd) for r in annotations.read_vep(spark, str(tmp_path / "vep.tsv")).collect()}
    assert best == {f"v{i}": (f"A{60 + i}", 9.0) for i in range(30)}  # of equals the first
    annovar = ["Chr\tStart\tRef\tAlt\tGene.refGene\tExonicFunc.refGene"] + [f"1\t{i % 50}\tA\tC\tB{i}\tstopgain" for i in range(300)]
    (tmp_path / "annovar.txt").write_text("\r\n".join(annovar))
    last = {r.key: r.gene for r in annotations.read_annovar(spark, str(tmp_path / "annovar.txt")).collect()}
    assert last == {f"1:{i}:A:C": f"B{250 + i}" for i in range(50)}
    with pytest.raises(ValueError, match="no header"):
        annotations.read_vep(spark, str(tmp_path / "annovar.txt"))


def test_numbers_of_lines_in_split_files(spark, tmp_path, small_blocks):
    (tmp_path / "d").mkdir()
    for name, n in (("a", 500), ("b", 300)):
        (tmp_path / "d" / name).write_text("\n".join(f"{name}{i}" for i in range(n)))
    got = {r.value: r.line for r in lines.numbered_lines(spark, str(tmp_path / "d")).collect()}
    assert got == {f"{name}{i}": i for name, n in (("a", 500), ("b", 300)) for i in range(n)}
    gmt = [f"S{i % 20}\tabout\tA{i}\tB{i}" for i in range(200)]
    (tmp_path / "sets.gmt").write_text("\n".join(gmt))
    sets = genesets.read_gmt(spark, str(tmp_path / "sets.gmt")).where("ord = 0").collect()
    assert {r.pathway: r.gene for r in sets} == {f"S{i}": f"A{180 + i}" for i in range(20)}
    (tmp_path / "bad.gmt").write_text("\n".join([*(f"S{i}\tabout\tA\tB" for i in range(100)), "S7\tabout\tA\tB", "short\tx"]))
    with pytest.raises(genesets.GmtError, match="line 8: duplicate name; line 101: duplicate name; line 102: fewer than 3 fields"):
        genesets.validate_gmt(spark, str(tmp_path / "bad.gmt"))


def test_lines_keep_their_order(spark, tmp_path, small_blocks):
    (tmp_path / "a.txt").write_text("\n".join(f"line {i}" for i in range(400)))
    rows = lines.ordered_lines(spark, str(tmp_path / "a.txt")).repartition(3).orderBy("line").collect()
    assert [r.value for r in rows] == [f"line {i}" for i in range(400)]
    assert lines.first_line(lines.ordered_lines(spark, str(tmp_path / "a.txt")), F.col("value").endswith("7")) == "line 7"
    assert lines.first_line(lines.ordered_lines(spark, str(tmp_path / "a.txt")), F.lit(False)) is None


def test_calls_by_table_function(spark, tmp_path):
    from veltra.functions.table_functions import register_table_functions

    text = [HEADER, *body(40), "chr1\t7\trs7\tA\tC,G\t.\tPASS\tCADD=3,x;GENE=.;FLAG\tGT:DP\t0/1:3\t1|2:4\t2/2\t./1\t1\t0/0", "chr1\t5\tshort", ""]
    (tmp_path / "a.vcf").write_text("\n".join(text))
    register_table_functions(spark)
    run = lambda call: spark.sql(f"SELECT * FROM vcf_calls(TABLE({{t}}), {call})", t=spark.read.text(str(tmp_path / "a.vcf")))
    names = ",".join(f"S{i}" for i in range(6))
    df = run(f"samples => '{names}', info => 'CADD double, GENE, FLAG string, NONE int'")
    assert df.dtypes[5:] == [("allele", "int"), ("cadd", "double"), ("gene", "string"), ("flag", "string"), ("none", "bigint"), ("sample_id", "string"), ("dosage", "int"), ("valid", "boolean")]
    got = sorted(map(tuple, df.where("variant_id like 'rs7%'").select("variant_id", "cadd", "gene", "flag", "sample_id", "dosage", "valid").collect()))
    dosages = {"rs7_1": (1, 1, 0, 0, 0, 0), "rs7_2": (0, 1, 2, 0, 0, 0)}
    assert got == [(v, 3.0 if v == "rs7_1" else None, None, "true", f"S{i}", d, i not in (3, 4)) for v, ds in dosages.items() for i, d in enumerate(ds)]
    plain = variants.read_vcf(spark, str(tmp_path / "a.vcf")).genotypes
    assert sorted(map(tuple, plain.select("variant_id", "sample_id", "dosage", "valid").collect())) == sorted(map(tuple, df.select("variant_id", "sample_id", "dosage", "valid").collect()))
    for bad in ("samples => ''", "samples => 'S0', info => 'CADD date'", "samples => string(rand())"):
        with pytest.raises(Exception, match="vcf_calls|samples|INFO|constant"):
            run(bad).collect()
    with pytest.raises(Exception, match="column named value"):
        spark.sql("SELECT * FROM vcf_calls(TABLE(SELECT 1 AS other), samples => 'S0')").collect()
