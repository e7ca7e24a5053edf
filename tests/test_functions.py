import random

import pytest
from pyspark.sql import functions as F

from strandlake.functions import hashing
from strandlake.functions import nucleotide as nt
from strandlake.operators import sampling


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())] if values else [(0,)], list(values) or ["x"])
    return frame.select(column.alias("r")).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [("acgtN-u", "ACGTAAA"), ("é", "AA"), ("中", "AAA"), ("😀", "AAAA"), ("", ""), ("ac\r\ngt", "ACAAGT")],
)
def test_encode_reads_every_byte_as_a_base(spark, text, want):
    assert one(spark, nt.encode(F.col("t")), t=text) == want
    assert len(want) == len(text.encode())


def test_strands(spark):
    assert one(spark, nt.complement(F.col("s")), s="AACG") == "TTGC"
    assert one(spark, nt.reverse_complement(F.col("s")), s="AACG") == "CGTT"
    assert one(spark, nt.canonical(F.col("s")), s="TTTT") == "AAAA"
    assert one(spark, nt.complement_text(F.col("s")), s="aNxT") == "tNxA"


def test_strand_laws_on_random_sequences(spark):
    rng = random.Random(1)
    seqs = ["".join(rng.choices("ACGT", k=rng.randint(1, 32))) for _ in range(200)]
    frame = spark.createDataFrame([(s,) for s in seqs], ["s"])
    rc = nt.reverse_complement
    bad = frame.filter((rc(rc(F.col("s"))) != F.col("s")) | (nt.canonical(nt.canonical(F.col("s"))) != nt.canonical(F.col("s"))) | (nt.canonical(rc(F.col("s"))) != nt.canonical(F.col("s"))))
    assert bad.count() == 0


@pytest.mark.parametrize("k", [1, 4, 25, 31, 32])
def test_pack_round_trip_and_order(spark, k):
    rng = random.Random(k)
    seqs = sorted({"".join(rng.choices("ACGT", k=k)) for _ in range(60)} | {"T" * k, "A" * k})
    frame = spark.createDataFrame([(s,) for s in seqs], ["s"])
    rows = frame.select("s", nt.pack(F.col("s"), k).alias("p")).withColumn("u", nt.unpack(F.col("p"), k)).collect()
    assert all(r.s == r.u for r in rows)
    assert [r.s for r in sorted(rows, key=lambda r: r.p)] == seqs
    assert {r.s: int(r.p) for r in rows}["T" * k] == 4**k - 1


def test_k_is_checked():
    for k in (0, 33):
        with pytest.raises(ValueError):
            nt.check_k(k)


def test_editing(spark):
    s = F.col("s")
    assert one(spark, nt.base_at(s, 2), s="ACGT") == "G"
    assert one(spark, nt.set_base(s, 2, "A"), s="ACGT") == "ACAT"
    assert one(spark, nt.window(s, 1, 2), s="ACGT") == "CG"
    assert one(spark, nt.limbs(s), s="A" * 33) == 2
    assert one(spark, nt.append_kmer(s, F.lit("AAC")), s="G") == "GCAA"
    assert one(spark, nt.out_neighbours(s), s="ACG") == ["CGA", "CGC", "CGG", "CGT"]
    assert one(spark, nt.in_neighbours(s, 3), s="ACG") == ["AAC", "CAC", "GAC", "TAC"]


@pytest.mark.parametrize(("kmer", "want"), [("AAAAAA", True), ("ACACAC", True), ("ACGACG", True), ("ACGTAC", False), ("ACACAG", False)])
def test_low_period(spark, kmer, want):
    assert one(spark, nt.low_period(F.col("s"), 6), s=kmer) is want


def test_mismatches(spark):
    q, s = F.col("q"), F.col("s")
    assert one(spark, nt.mismatches(q, s, F.lit(1)), q="ACG", s="TACC") == 1
    assert one(spark, nt.mismatches(q, s, F.lit(3)), q="ACG", s="TACA") == 2  # beyond the end
    assert one(spark, nt.mismatches(q, s, F.lit(0), 2), q="AAAA", s="CCCC") == 2
    assert one(spark, nt.mismatches(q, s, F.lit(0)), q="", s="CCCC") == 0


@pytest.mark.parametrize(
    ("kmer", "want", "print_", "bucket"),
    [
        ("A", 8633297058295171728, 1820672, 1670081),
        ("ACGT", 12564563040126408309, 12358656, 1485119),
        ("TTTT", 7984788104737148810, 10439680, 2935495),
        ("ACGTACGTACGTACGTACGTACGTA", 16351548945035817808, 4583424, 1804954),
    ],
)
def test_kmer_hashes(spark, kmer, want, print_, bucket):
    frame = spark.createDataFrame([(kmer,)], ["s"]).select(hashing.kmer_hash(nt.pack(F.col("s"), len(kmer))).alias("h"))
    row = frame.select(hashing.unsigned(F.col("h")).alias("u"), hashing.fingerprint(F.col("h")).alias("f"), hashing.buckets(F.col("h"), 3_125_000).alias("b")).first()
    assert (int(row.u), row.f, row.b[0], len(row.b)) == (want, print_, bucket, 4)


def test_checksums(spark):
    assert [hashing.murmur3_bytes(x) for x in (b"", b"ACGT", b"ACGTA")] == [4229146481, 3253271249, 3688469318]
    assert hashing.crc64_bytes(b"123456789") == 0x995DC9BBDF1939FA
    assert hashing.crc64_bytes(b"6789", hashing.crc64_bytes(b"12345")) == 0x995DC9BBDF1939FA
    assert one(spark, hashing.murmur3(F.col("s")), s="ACGT") == 3253271249
    assert one(spark, hashing.crc64(F.col("s")), s="123456789") == 0x995DC9BBDF1939FA - 2**64
    assert hashing.limb_bytes("C" + "A" * 31 + "G") == (1).to_bytes(8, "little") + (2).to_bytes(8, "little")
    assert one(spark, hashing.sequence_crc64(F.col("s")), s="C") is not None


def test_checksums_of_many_texts_at_once():
    rng = random.Random(5)
    for n in (0, 3, 16, 40):
        data = [rng.randbytes(rng.choice((0, 1, 3, 4, 9, 300, 2000))) for _ in range(n)]
        assert hashing.murmur3_many(data).tolist() == [hashing.murmur3_bytes(x) for x in data]
        assert hashing.crc64_many(data).tolist() == [hashing.crc64_bytes(x) for x in data]


def test_hashes_of_nulls_are_null(spark):
    frame = spark.createDataFrame([(5, b"a"), (None, None)], "n bigint, t binary")
    row = frame.filter("n IS NULL").select(hashing.kmer_hash(F.col("n")).alias("h"), hashing.murmur3(F.col("t")).alias("m"), hashing.crc64(F.col("t")).alias("c")).first()
    assert tuple(row) == (None, None, None)


def test_samples_are_seeded_and_nested(spark):
    frame = spark.range(2000).withColumn("other", F.lit(None).cast("string"))
    few, more = ({r.id for r in sampling.sample(frame, share, 3).collect()} for share in (0.1, 0.4))
    assert few < more and 120 < len(few) < 280
    assert few == {r.id for r in sampling.sample(frame.repartition(7), 0.1, 3).collect()}
    assert few != {r.id for r in sampling.sample(frame, 0.1, 4).collect()}
    assert sampling.sample(frame, 0, 3).count() == 0 and sampling.sample(frame, 1, 3).count() == 2000
    with pytest.raises(ValueError):
        sampling.sample(frame, 1.5, 3)
