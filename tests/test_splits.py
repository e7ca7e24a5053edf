import gzip
import random

import pytest

from strandlake.sources import reads, splits


@pytest.fixture
def split_into(spark):
    """Sets how many bytes a split of a file has at most."""
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def set_(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", n)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)

    yield set_
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def fasta_by_line(text, compat):
    out, name, seq, held = [], None, [], ""
    lines = text.split("\n")
    for line in [*lines, None]:
        if line is None or line.startswith(">"):
            if name is not None and not (line is None and compat):
                if compat and not name:
                    held += "".join(seq)
                else:
                    out.append((name, held + "".join(seq)))
                    held = ""
            name, seq = (line or ">")[1:] if compat else (line or ">")[1:].removesuffix("\r"), []
        elif name is not None:
            seq.append(line.replace(" ", "") if compat else line.replace(" ", "").replace("\r", ""))
    return out


def fastq_by_line(text, compat):
    lines = text.split("\n")
    if lines[-1] == "" or compat:
        lines = lines[:-1]
    if not compat:
        lines = [x.removesuffix("\r") for x in lines]
    return [(lines[i].removeprefix("@"), lines[i + 1], lines[i + 2].removeprefix("+"), lines[i + 3]) for i in range(0, len(lines) - 3, 4)]


def fasta_texts():
    rng = random.Random(3)
    out = ["", "; junk\nAC\n>one\nAC\n>two\nGT\n", "no header\n", ">>x\nA\n>>y\nC\n>\n>z", ">\n>\nA\n>b\nC\n>\nG\n>\nT", ">only\nAC"]
    for end in ("\n", "\r\n"):
        text = "x\n>y \n".replace("\n", end)
        for i in range(40):
            name = rng.choice(["", f"r{i} é", f">r{i}"])
            text += f">{name}{end}" + "".join(rng.choice(["ACGT", "A C", ""]) + end for _ in range(rng.randint(0, 4)))
        out.append(text)
    return out


@pytest.mark.parametrize("size", [150, 1 << 20])
def test_fasta_equals_reading_line_by_line(spark, tmp_path, split_into, size):
    split_into(size)
    texts = fasta_texts()
    for i, text in enumerate(texts):
        (tmp_path / f"f {i}.fa").write_bytes(text.encode())
    for compat in (False, True):
        got = sorted(tuple(r) for r in reads.read_fasta(spark, str(tmp_path), compat).select("id1", "seq").collect())
        assert got == sorted(x for t in texts for x in fasta_by_line(t, compat))


@pytest.mark.parametrize("size", [170, 400, 1 << 20])
def test_fastq_equals_reading_line_by_line(spark, tmp_path, split_into, size):
    split_into(size)
    rng = random.Random(size)
    texts = ["", "@a\nA\n+\nI", "@a\nA\n+\n", "\n\n\n\n@b\n\n+\n@"]
    for end in ("\n", "\r\n"):
        texts.append("".join(f"@r{i}{end}{'ACGT' * rng.randint(0, 5)}{end}+{rng.choice(['', 'é'])}{end}{rng.choice(['@', 'I', '+', '>'])}{end}" for i in range(60)) + rng.choice(["", "@cut\nA"]))
    for i, text in enumerate(texts):
        (tmp_path / f"f {i}.fq").write_bytes(text.encode())
    for compat in (False, True):
        got = sorted(tuple(r) for r in reads.read_fastq(spark, str(tmp_path), compat).collect())
        assert got == sorted(x for t in texts for x in fastq_by_line(t, compat))


def test_compressed_files(spark, tmp_path):
    for name, text in (("a.fa.gz", ">a\nAC\n>b\nG\n"), ("b.fq.gz", "@a\nAC\n+\nII\n")):
        (tmp_path / name).write_bytes(gzip.compress(text.encode()))
    assert sorted(tuple(r)[:2] for r in reads.read(spark, str(tmp_path / "a.fa.gz")).collect()) == [("a", "AC"), ("b", "G")]
    assert [tuple(r) for r in reads.read(spark, str(tmp_path / "b.fq.gz")).collect()] == [("a", "AC", "", "II")]


def test_a_large_file_is_read_by_many_tasks_and_few_lines_are_exchanged(spark, tmp_path, split_into):
    text = "".join(f"@r{i}\n{'ACGT' * 20}\n+\n{'I' * 80}\n" for i in range(20_000))
    (tmp_path / "a.fq").write_text(text)
    split_into(len(text) // 20)
    lines = splits.numbered_lines(spark, [str(tmp_path / "a.fq")])
    assert lines.rdd.getNumPartitions() >= 20
    parts = spark.createDataFrame(lines.select("file", "line", "value").mapInArrow(splits._groups(4), "file string, record long, l0 string, l1 string, l2 string, l3 string, whole boolean").rdd)
    assert parts.filter("NOT whole").count() < 300
    found = reads.read_fastq(spark, str(tmp_path / "a.fq"))
    assert found.count() == 20_000 and found.select("id1").distinct().count() == 20_000


def test_lines_that_only_end_alike_are_no_group():
    import pyarrow as pa

    lines = [0, 5, 6, 3, 4, 5, 6, 7, 8]
    batch = pa.RecordBatch.from_pydict({"file": pa.array(["f"] * 9), "line": pa.array(lines), "value": pa.array([f"v{i}" for i in lines])})
    (got,) = splits._groups(4)([batch])
    whole = [r for r in got.to_pylist() if r["whole"]]
    assert [[r[f"l{j}"] for j in range(4)] for r in whole] == [["v4", "v5", "v6", "v7"]]
    assert got.num_rows == 6
