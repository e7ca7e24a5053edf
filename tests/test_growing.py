import random

from pyspark.sql import functions as F

from strandlake.operators.components import connected_components
from strandlake.streaming.components import GrowingComponents
from strandlake.streaming.ids import GrowingIds


def folder(tmp_path, name):
    return f"file://{tmp_path}/{name}"


def brute(edges):
    least = {}
    for a, b in edges:
        least.setdefault(a, a), least.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    return least


def test_components_equal_those_of_all_edges_after_each_batch(spark, tmp_path):
    draw = random.Random(3)
    grown = GrowingComponents(spark, folder(tmp_path, "c"), few_merges=6)
    assert grown.components().count() == 0 and grown.totals() == (0, 0)
    so_far = []
    for batch in range(4):
        new = [(draw.randrange(90), draw.randrange(90)) for _ in range(14)] + [(200 + batch, 200 + batch)]
        so_far += new
        grown.update(spark.createDataFrame(new + [(None, 4)], "a bigint, b bigint"), batch)
        want = brute(so_far)
        assert dict(tuple(r) for r in grown.components().collect()) == want
        assert grown.totals() == (len(want), len(set(want.values())))
    found = connected_components(spark.createDataFrame(so_far, "a bigint, b bigint"))
    assert found.exceptAll(grown.components()).isEmpty()


def test_a_new_least_vertex_takes_a_component_over_and_chains_of_merges_lead_to_it(spark, tmp_path):
    grown = GrowingComponents(spark, folder(tmp_path, "c"), few_merges=2)
    chain = [[(9, 8), (7, 6)], [(8, 7)], [(6, 5), (5, 4)], [(4, 3)]]
    for batch, edges in enumerate(chain):
        grown.update(spark.createDataFrame(edges, "a bigint, b bigint"), batch)
    assert {r.component for r in grown.components().collect()} == {3} and grown.totals() == (7, 1)


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    batches = [[(1, 2), (3, 4)], [(2, 3), (5, 6)], [(6, 1)]]
    grown = GrowingComponents(spark, folder(tmp_path, "c"), few_merges=1)
    for batch, edges in enumerate(batches):
        frame = spark.createDataFrame(edges, "a bigint, b bigint")
        grown.update(frame, batch)
        grown.ledger.drop("log", batch)  # lost before the batch was finished
        grown = GrowingComponents(spark, folder(tmp_path, "c"), few_merges=1)
        grown.update(frame, batch)
        grown.update(frame, batch)
    assert {r.component for r in grown.components().collect()} == {1} and grown.totals() == (6, 1)


def test_components_of_a_stream(spark, tmp_path):
    path = folder(tmp_path, "edges")
    spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 3).alias("b")).repartition(3).write.parquet(path)
    grown = GrowingComponents(spark, folder(tmp_path, "c"))
    stream = spark.readStream.schema("a bigint, b bigint").option("maxFilesPerTrigger", 1).parquet(path).writeStream.trigger(availableNow=True)
    stream.option("checkpointLocation", folder(tmp_path, "at")).foreachBatch(grown.update).start().awaitTermination()
    assert grown.totals() == (63, 3)
    assert all(r.component == r.vertex % 3 for r in grown.components().collect())


def test_ids_are_dense_and_stay(spark, tmp_path):
    grown = GrowingIds(spark, folder(tmp_path, "i"), "k")
    seen = {}
    for batch, keys in enumerate([["d", "b", "b", None], [], ["a", "d", "c"], ["z", "y", "a", "x"]]):
        frame = spark.createDataFrame([(k,) for k in keys], "k string")
        grown.update(frame, batch)
        grown.ledger.drop("log", batch)
        grown = GrowingIds(spark, folder(tmp_path, "i"), "k")
        grown.update(frame, batch)
        for k in sorted({k for k in keys if k} - set(seen)):
            seen[k] = len(seen) + 1
        assert dict(tuple(r) for r in grown.ids().collect()) == seen


def test_components_of_documents_go_by_numbers_in_the_order_of_their_kmers(spark, tmp_path):
    from strandlake import queries

    rng = random.Random(8)
    rows = [(i, "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 40)))) for i in range(12)]
    spark.createDataFrame([*rows, (50, None), (51, "acgtnacgtnacgtn acg")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries._packed_edges(spark, str(tmp_path)).dtypes == [("u", "bigint"), ("v", "bigint")]
    edges = queries.graph_edges(spark, str(tmp_path)).select("u", "v")
    want = {r.vertex: r.component for r in connected_components(edges, "u", "v").collect()}
    got = {r.kmer: r.component for r in queries.components_growing(spark, str(tmp_path)).collect()}
    assert got == want and len(set(want.values())) > 3
    least = sorted(set(want.values()))
    sizes = {r.component: r.size for r in queries.component_sizes_documents(spark, str(tmp_path)).collect()}
    assert sizes == {i: list(want.values()).count(x) for i, x in enumerate(least)}
