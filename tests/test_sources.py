import pytest

from strandlake import cli
from strandlake.sources import matrices, reads
from strandlake.streaming import counts as streaming


def put(folder, name, text):
    path = folder / name
    path.write_bytes(text.encode())
    return str(path)


def rows(frame, *columns):
    return sorted(tuple(r[c] for c in columns) for r in frame.collect())


def test_fasta(spark, tmp_path):
    path = put(tmp_path, "a.fa", ">one x\nAC GT\nTT\n>two\r\nGG\r\n>\nCC\n>four\nA")
    want = [("", "CC"), ("four", "A"), ("one x", "ACGTTT"), ("two", "GG")]
    assert rows(reads.read_fasta(spark, path), "id1", "seq") == want
    assert rows(reads.read(spark, path), "id1", "seq") == want


def test_fasta_ignores_text_before_the_first_header(spark, tmp_path):
    path = put(tmp_path, "a.fa", "; junk\nACGT\n>one\nAC\n>two\nGT\n")
    assert rows(reads.read_fasta(spark, path), "id1", "seq") == [("one", "AC"), ("two", "GT")]
    assert rows(reads.read_fasta(spark, put(tmp_path, "b.fa", "no header\n")), "id1", "seq") == []


def test_fasta_compat_loses_last_records_and_carries_unnamed_sequences_on(spark, tmp_path):
    a = put(tmp_path, "a.fa", ">one\nAC\r\n>\nGG\n>two\nTT\n>last\nA\n")
    b = put(tmp_path, "b.fa", ">only\nACGT\n")
    assert rows(reads.read_fasta(spark, [a, b], compat=True), "id1", "seq") == [("one", "AC\r"), ("two", "GGTT")]


def test_fastq(spark, tmp_path):
    text = "@r1\nACGT\n+r1\n@III\n@r2\nGG\n+\nII"
    path = put(tmp_path, "a.fq", text)
    both = [("r1", "ACGT", "r1", "@III"), ("r2", "GG", "", "II")]
    assert rows(reads.read_fastq(spark, path), "id1", "seq", "id2", "qual") == both
    assert rows(reads.read_fastq(spark, path, compat=True), "id1", "seq", "id2", "qual") == both[:1]


def test_missing_files_and_formats(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        reads.read_fasta(spark, str(tmp_path / "none.fa"))
    with pytest.raises(ValueError):
        reads.read(spark, put(tmp_path, "a.txt", ">x\nA\n"))
    assert reads.read_fasta(spark, put(tmp_path, "empty.fa", "")).count() == 0


def test_fastq_sink(spark, tmp_path):
    frame = spark.createDataFrame([("r1", "AC", "", "II"), ("r2", "G", "", "@")], ["id1", "seq", "id2", "qual"])
    reads.write_fastq(frame, str(tmp_path / "out"))
    assert rows(reads.read_fastq(spark, str(tmp_path / "out")), "id1", "seq", "id2", "qual") == rows(frame, "id1", "seq", "id2", "qual")


def test_matrix_market_round_trip(spark, tmp_path):
    cells = spark.createDataFrame([(2, 1, 5), (1, 3, 7), (1, 3, 7)], "row bigint, col bigint, val bigint")
    matrices.write_matrix(cells, 3, str(tmp_path / "m"), single=True)
    text = "".join(p.read_text() for p in sorted((tmp_path / "m").glob("part-*")))
    assert text == f"{matrices.BANNER}\n3 3 3\n1 3 7\n1 3 7\n2 1 5\n"
    got, n, m = matrices.read_matrix_market(spark, str(tmp_path / "m"))
    assert (n, m, rows(got, "row", "col", "val")) == (3, 3, [(1, 3, 7), (1, 3, 7), (2, 1, 5)])
    many = spark.range(1, 2001).selectExpr("id as row", "2001 - id as col", "id * 3 as val")
    matrices.write_matrix(many, 2000, str(tmp_path / "parts"))
    assert len(list((tmp_path / "parts").glob("part-*"))) > 1
    got, n, m = matrices.read_matrix_market(spark, str(tmp_path / "parts"))
    assert (n, m, rows(got, "row", "col", "val")) == (2000, 2000, rows(many, "row", "col", "val"))
    with pytest.raises(ValueError):
        matrices.read_matrix_market(spark, put(tmp_path, "bad.mm", "%%MatrixMarket matrix array real general\n1 1\n"))


def test_harwell_boeing_layout(spark, tmp_path):
    cells = spark.createDataFrame([(2, 1, 5), (1, 3, 7)], "row bigint, col bigint, val bigint")
    matrices.write_matrix(cells, 3, str(tmp_path / "h"), "hb")
    lines = "".join(p.read_text() for p in sorted((tmp_path / "h").glob("part-*"))).split("\n")
    assert len(lines[0]) == 80 and lines[0][72:] == "padjmat "
    assert lines[1].split() == ["8", "4", "2", "2", "0"] and lines[2].split() == ["RUA", "3", "3", "2", "0"]
    assert [x.strip() for x in lines[4:-1]] == ["1", "2", "2", "3", "2", "1", "5", "7"]
    assert len(lines[4]) == 11 and len(lines[-2]) == 9


def test_command_line(spark, tmp_path, capsys):
    path = put(tmp_path, "g.fa", ">a\nACGTTGCA\n>b\nTTGCAAC\n>c\nAAAAA\n")
    out = str(tmp_path / "out")
    assert cli.main(["assemble", "-k", "3", out, path]) == 0
    assert cli.main(["components", out]) == 0
    assert cli.main(["curve", "-s", "100", out]) == 0
    assert capsys.readouterr().out.split() == ["0", "10", "1"]
    with pytest.raises(SystemExit):
        cli.main(["--version"])


def test_running_counts(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put(folder, "1.txt", "ACGTT\nAAAA\n")
    query = streaming.running_counts(streaming.read_lines(spark, str(folder)), 3).writeStream.format("memory").queryName("kmers").outputMode("complete").start()
    try:
        query.processAllAvailable()
        put(folder, "2.txt", "AAAA\n")
        query.processAllAvailable()
        got = {r.kmer: r.cnt for r in spark.table("kmers").collect()}
    finally:
        query.stop()
    assert got == {"ACG": 2, "AAC": 1, "AAA": 4}


def test_windowed_counts_close_with_the_watermark(spark, tmp_path):
    import datetime as dt

    folder = str(tmp_path / "events")
    t0 = dt.datetime(2024, 1, 1)
    frame = spark.createDataFrame([(t0, "AAAA"), (t0 + dt.timedelta(minutes=1), "AAA")], "ts timestamp, seq string")
    frame.write.parquet(folder)
    stream = spark.readStream.schema(frame.schema).parquet(folder)
    query = streaming.windowed_counts(stream, 3).writeStream.format("memory").queryName("windows").outputMode("append").start()
    try:
        query.processAllAvailable()
        spark.createDataFrame([(t0 + dt.timedelta(hours=1), "CCC")], frame.schema).write.mode("append").parquet(folder)
        query.processAllAvailable()
        got = [(r.kmer, r.cnt) for r in spark.table("windows").collect()]
    finally:
        query.stop()
    assert got == [("AAA", 3)]


def test_standard_input_is_a_source(spark, tmp_path, monkeypatch):
    import io
    import sys
    from types import SimpleNamespace

    monkeypatch.setattr(sys, "stdin", SimpleNamespace(buffer=io.BytesIO(b">a\nACGTTGCA\n>b\nTTGCAAC\n")))
    assert cli.main(["assemble", "--fasta", "-k", "3", str(tmp_path / "in.mm")]) == 0
    (tmp_path / "same.fa").write_text(">a\nACGTTGCA\n>b\nTTGCAAC\n")
    assert cli.main(["assemble", "-k", "3", str(tmp_path / "file.mm"), str(tmp_path / "same.fa")]) == 0
    got, want = (sorted(r.value for r in spark.read.text(str(tmp_path / x)).collect()) for x in ("in.mm", "file.mm"))
    assert got == want and len(got) > 3


def test_no_folder_of_one_machine_on_a_cluster():
    from types import SimpleNamespace

    from strandlake.operators.components import shared_folder

    with pytest.raises(RuntimeError):
        shared_folder(SimpleNamespace(conf={"spark.master": "spark://host:7077"}))


def test_running_counts_take_any_text(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put(folder, "1.txt", "acgtt\nNAaa\n\n")
    lines = spark.readStream.text(str(folder)).withColumnRenamed("value", "seq")
    query = streaming.running_counts(lines, 3).writeStream.format("memory").queryName("texts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.kmer: r.cnt for r in spark.table("texts").collect()} == {"ACG": 2, "AAC": 1, "AAA": 2}
