import glob
import random

import pytest

from braidseq.cli import main


def test_commands_end_to_end(spark, tmp_path):
    rng = random.Random(1)
    base = "".join(rng.choice("ACGT") for _ in range(150))
    other = base[:70] + ("A" if base[70] != "A" else "C") + base[71:]
    (tmp_path / "cluster1.msa").write_text(f">*one\n{base}\n>two\n{other}\n>consensus\n{base}\n")
    reads = "".join(f"@r{i}\n{other[i : i + 50]}\n+\n{'I' * 50}\n" for i in range(0, 101, 5))
    (tmp_path / "reads.fastq").write_text(reads)
    out = lambda name: str(tmp_path / name)
    main(["index", "--msa", out("cluster1.msa"), "--out", out("index"), "--kmer", "11", "--slots", "8", "--window", "50"], spark)
    main(["align", "--index", out("index"), "--reads", out("reads.fastq"), "--out", out("aligned"), "--threshold", "0.95", "--min-coverage", "0.01"], spark)
    main(["report", "--index", out("index"), "--aligned", out("aligned"), "--out", out("report")], spark)
    rows = [line.split("\t") for f in glob.glob(out("report/*.csv")) for line in open(f).read().splitlines()]
    assert "two" in {r[0] for r in rows} and all(r[2] == "150" for r in rows)
    files = glob.glob(out("aligned/graphs/graph_id=*/*.txt"))
    text = "\n".join(open(f).read() for f in files)
    assert "\nP\ttwo\t" in text and "graphs: " in text
    with pytest.raises(ValueError):
        main(["align", "--index", out("index"), "--reads", out("reads.txt"), "--out", out("x")], spark)
    main(["haplotype", "--gfa", *files, "--out", out("called"), "--cutoff", "0.0", "--min-iterations", "3"], spark)
    assert ">two" in "".join(open(f).read() for f in glob.glob(out("called/alleles/*.txt")))


def test_guards_streams_and_bam(spark, tmp_path, capsys, monkeypatch):
    import os
    import sys

    rng = random.Random(2)
    base = "".join(rng.choice("ACGT") for _ in range(120))
    (tmp_path / "c.msa").write_text(f">*one\n{base}\n>two\n{base[:60]}{'A' if base[60] != 'A' else 'C'}{base[61:]}\n>consensus\n{base}\n")
    out = lambda name: str(tmp_path / name)
    main(["version"])
    assert capsys.readouterr().out.strip()
    main(["--log", out("log"), "index", "--msa", out("c.msa"), "--out", out("index"), "--kmer", "11", "--slots", "8", "--window", "50"], spark)
    (tmp_path / "r.fasta").write_text(">a x\n" + base[10:40].lower() + "\n" + base[40:60].lower() + "\n>far\n" + "".join(rng.choice("ACGT") for _ in range(50)) + "\n")
    main(["align", "--index", out("index"), "--reads", out("r.fasta"), "--fasta", "--normalize-reads", "--out", out("al"), "--threshold", "0.9", "--min-coverage", "0", "--bam", out("a.bam"), "--sam", out("sam")], spark)
    main(["report", "--bam", out("a.bam"), "--out", out("rep"), "--cutoff", "0.1"], spark)
    rows = [line.split("\t") for f in glob.glob(out("rep/*.csv")) for line in open(f).read().splitlines()]
    assert sorted(r[0] for r in rows) == ["one", "two"] and {r[1] for r in rows} == {"1"}
    sam = "".join(open(f).read() for f in sorted(glob.glob(out("sam/part*"))))
    assert sam.startswith("@SQ\tSN:one\tLN:120") and "a x\t" in sam
    # reads from a pipe; none of them maps
    read, write = os.pipe()
    os.write(write, b"@r\n" + b"G" * 50 + b"\n+\n" + b"I" * 50 + b"\n")
    os.close(write)
    monkeypatch.setattr(sys, "stdin", os.fdopen(read))
    main(["align", "--index", out("index"), "--out", out("none")], spark)
    assert os.path.isdir(out("none/records")) and not os.path.exists(out("none/graphs"))
    (tmp_path / "empty.fq").write_text("")
    (tmp_path / "blank.fq").write_text("\n\n")
    for reads, said in ((["empty.fq"], "empty file"), (["gone.fq"], "no such file"), ([""], "not one of"), (["blank.fq"], "no reads")):
        with pytest.raises(ValueError, match=said):
            main(["align", "--index", out("index"), "--reads", *map(out, reads), "--out", out(f"x{said}")], spark)
    with open(out("empty.fq")) as no_pipe:
        monkeypatch.setattr(sys, "stdin", no_pipe)
        with pytest.raises(ValueError, match="not a pipe"):
            main(["align", "--index", out("index"), "--out", out("y")], spark)
    (tmp_path / "same.msa").write_text(f">one\n{'A' * 300}\n>two\n{'A' * 300}\n")
    with pytest.raises(ValueError, match="one sketch"):
        main(["index", "--msa", out("same.msa"), "--out", out("long"), "--kmer", "11", "--window", "50"], spark)


def test_bam_round_trip(spark, tmp_path):
    import io
    import warnings

    from braidseq.sources import bam

    rows = [("r1", "a", 5, "3H7M1H", 30, 16, "ACGTNAC", "IIIIII#"), ("r2", "b", 0, "2M", 0, 256, "GT", None), ("r3", None, -1, "*", 0, 4, "", None)]
    records = spark.createDataFrame(rows * 40_000, bam.RECORD).repartition(3)
    refs = spark.createDataFrame([("b", 70), ("a", 40)], "ref_name string, ref_len int")
    with open(tmp_path / "x.bam", "wb") as out:
        assert bam.write_bam(records, refs, out) == 120_000
    raw = (tmp_path / "x.bam").read_bytes()
    assert raw.endswith(bam.END)
    import gzip

    assert gzip.decompress(raw)[:4] == b"BAM\1"  # blocks are gzip members
    back, known = bam.read_bam(spark, str(tmp_path / "x.bam"))
    assert sorted(known.collect()) == [("a", 40), ("b", 70)]
    counts = {tuple(r)[:-1]: r["count"] for r in back.groupBy(*back.columns).count().collect()}
    assert counts == dict.fromkeys(rows, 40_000)
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        list(bam.read_stream(io.BytesIO(raw[: -len(bam.END)]))[1])
    assert any("end block" in str(w.message) for w in said)
    with pytest.raises(ValueError):
        bam.read_stream(io.BytesIO(b"not a bam file at all"))
    assert [bam.bin_of(a, b) for a, b in ((0, 1), (0, 1 << 14), (0, (1 << 14) + 1), (1 << 26, (1 << 26) + 1), (0, 1 << 29))] == [4681, 4681, 585, 4681 + (1 << 12), 0]


def test_lines_of_splits_and_chunks(spark, tmp_path):
    from braidseq.sources import formats as IO

    text = [f"line {i} " + "x" * (i % 50) for i in range(5000)]
    (tmp_path / "big.txt").write_text("\n".join(text) + "\n")
    (tmp_path / "none.txt").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = IO.scan_lines(spark, [str(tmp_path / "big.txt"), str(tmp_path / "none.txt")])
        assert lines.rdd.getNumPartitions() > 3
        assert [(r.line_no, r.line) for r in lines.orderBy("line_no").collect()] == list(enumerate(text))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    chunks = spark.createDataFrame([("f", 0, "a\nb"), ("f", 1, "c"), ("f", 2, " d \n\n  \ne"), ("g", 0, "x\n")], "file string, nth long, chunk string")
    got = lambda keep: sorted((r.file, r.line_no, r.line) for r in IO.chunk_lines(chunks, keep).collect())
    assert [(f, x) for f, _, x in got(True)] == [("f", "a"), ("f", "bc d"), ("f", "e"), ("g", "x")]
    assert [(f, x) for f, _, x in got(False)] == [("f", "a"), ("f", "bc d"), ("g", "x")]


def test_records_across_stretches(spark, monkeypatch):
    from braidseq.sources import formats as IO

    monkeypatch.setattr(IO, "STRETCH", 3)
    text = [x for i in range(11) for x in ("", f"@r{i}", f"AC{i}", "+", "II")] + ["@cut", "A"]
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(text)], "file string, line_no long, line string")
    assert [(r.nth, r.read_id, r.seq) for r in IO.parse_fastq(lines).orderBy("nth").collect()] == [(i, f"@r{i}", f"AC{i}") for i in range(11)]
    text = [x for i in range(9) for x in (f">r{i}", "AC", f"G{i}")]
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(text)], "file string, line_no long, line string")
    assert [(r.nth, r.read_id, r.seq) for r in IO.parse_fasta(lines).orderBy("nth").collect()] == [(i, f"@r{i}", f"ACG{i}") for i in range(9)]
