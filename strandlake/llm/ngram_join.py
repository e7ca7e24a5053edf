"""Exact similarity join of documents' word n-gram sets, with its components.

Two documents link when 100 * |A and B| >= percent * |A or B| for their sets of distinct
k-word shingles (A-Z lower-cased; with fewer than k words the whole sequence is the one
shingle).  The join uses relations between sets to skip work:

1. Documents with equal sets form a class, which has a number of its own; one of the
   class's texts goes on, that of its smallest doc_id.
2. Shingles that no other class has can't be in an overlap.  A set with fewer than
   percent of its shingles shared can't link and goes no further.
3. The others are indexed by their prefix in one global order (rare first).  In each
   list the set with the fewest unshared shingles is the hub.  The hub's answers are
   computed: its exact overlap with every set of its lists.
4. For two sets of a list, in different components so far, the overlap is derived from
   those answers: at most min(o1, o2) + min(s1 - o1, s2 - o2), o being the overlap with
   the hub and s the shared shingles.  Lists are kept in blocks by component, length
   and position, and whole pairs of blocks are skipped by the blocks' bounds.
5. What no bound excludes is verified.  Links within a component add nothing to it, so
   a group of n near copies costs about n comparisons instead of n squared.

Defined results: null, empty and blank texts have no shingles (n_shingles 0) and are
their own component.  Rows of one doc_id may have different texts: each keeps its own
n_shingles, and what any of them links with is in the component of them all.  A null
doc_id keeps its count, links with nothing and has a null component.  Shingles are
compared by 64-bit hashes, sets for equality by their size and 128 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm import spread
from strandlake.llm.store import cut
from strandlake.llm.words import mix64, slices, split_words, window_hashes
from strandlake.operators.components import connected_components

WORDS = 4
PERCENT = 85
#: What tells sets apart: how many shingles, a sum and an exclusive or of their hashes.
SET = ("n_shingles", "s1", "s2")


def shingle_sets(col: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    w = split_words(col)
    h = w.hashes(lower=True)
    windows = window_hashes(h, k)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(windows[a : b - k + 1]))
        elif b > a:
            out.append(window_hashes(h[a:b], b - a, seed=b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each set's size and two numbers that only equal sets share."""
    sums = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
    xors = np.array([np.bitwise_xor.reduce(mix64(s)) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
    return np.array([len(s) for s in sets], np.int64), sums, xors


def _digests(k: int):
    def digest(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                found = digests(shingle_sets(part.column("text"), k))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *map(pa.array, found)], names=["doc_id", *SET])

    return digest


def _chosen(left: pa.Table, reps: pa.Table, k: int) -> list[tuple[int, np.ndarray]]:
    """Sets of the chunk's classes by the classes' numbers, each once."""
    wanted = dict(zip(zip(*(reps.column(c).to_pylist() for c in ("doc_id", *SET)), strict=True), reps.column("node").to_pylist(), strict=True))
    out: dict[int, np.ndarray] = {}
    ids = pc.unique(reps.column("doc_id"))
    for part in slices(left.select(["doc_id", "text"]).filter(pc.is_in(left.column("doc_id"), ids)), "text"):
        sets = shingle_sets(part.column("text"), k)
        rows = zip(part.column("doc_id").to_pylist(), *(x.tolist() for x in digests(sets)), strict=True)
        for row, keys in zip(rows, sets, strict=True):
            if (node := wanted.get(row)) is not None:
                out.setdefault(node, keys)
    return sorted(out.items())


def _send_shingles(n: int, k: int):
    def send(left: pa.Table, reps: pa.Table) -> pa.Table:
        sets = _chosen(left, reps, k) if left.num_rows and reps.num_rows else []
        keys, counts = np.unique(np.concatenate([s for _, s in sets]), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        chunk = left.column("chunk")[0].as_py() if left.num_rows else 0
        return spread.packed(chunk, keys, spread.low32(keys), np.minimum(counts, 255).astype(np.uint8), n)

    return send


def _rarity(table: pa.Table) -> pa.Table:
    """0 for a shingle of one set, else 1 and more by the logarithm of how many sets have it."""
    keys, lengths = spread.joined(table.column("keys"), np.uint32)
    counts, _ = spread.joined(table.column("tags"), np.uint8)
    _, at = np.unique(keys, return_inverse=True)
    total = np.bincount(at, weights=counts)
    level = np.where(total > 1, np.minimum(4 * np.log2(np.maximum(total, 1)), 254), 0).astype(np.uint8)
    return spread.answers(table, level[at], lengths, 1)


SHARED = "node long, n int, s int, tokens array<long>"


def _keep_shared(k: int, percent: int):
    def keep(left: pa.Table, right: pa.Table) -> pa.Table:
        nodes, sizes, shared, tokens = [], [], [], []
        if left.num_rows and right.num_rows:
            sets = _chosen(left, right.filter(pc.equal(right.column("round"), 0)), k)
            if sets:
                keys = np.unique(np.concatenate([s for _, s in sets]))
                level = spread.answered(right, 1)
                for node, own in sets:
                    mine = level[np.searchsorted(keys, own)]
                    s = int((mine > 0).sum())
                    if s and 100 * s >= percent * len(own):
                        some = own[mine > 0]
                        order = np.lexsort((some, mine[mine > 0]))
                        nodes.append(node)
                        sizes.append(len(own))
                        shared.append(s)
                        tokens.append(some[order].view(np.int64))
        return pa.table({"node": pa.array(nodes, pa.int64()), "n": pa.array(sizes, pa.int32()), "s": pa.array(shared, pa.int32()), "tokens": pa.array(tokens, pa.list_(pa.int64()))})

    return keep


def _need(n1: str, n2: str, percent: int):
    """The least overlap with which sets of these sizes link."""
    return F.ceil(F.lit(percent) * (F.col(n1) + F.col(n2)) / F.lit(100.0 + percent) - F.lit(1e-9)).cast("int")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """x, y, their exact overlap o, and whether they link."""
    one = sets.select(F.col("node").alias("x"), F.col("n").alias("nx"), F.col("tokens").alias("tx"))
    two = sets.select(F.col("node").alias("y"), F.col("n").alias("ny"), F.col("tokens").alias("ty"))
    o = F.size(F.array_intersect("tx", "ty"))
    both = pairs.select("x", "y").join(one, "x").join(two, "y").select("x", "y", "nx", "ny", o.alias("o"))
    return both.select("x", "y", "o", (100 * F.col("o") >= percent * (F.col("nx") + F.col("ny") - F.col("o"))).alias("linked"))


def shared_sets(docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Of the classes' sets those that can link, with their shared shingles, rare ones first."""
    spark = docs.sparkSession
    n, c, p = spread.buckets(spark), spread.chunks(spark), spread.partitions(spark)
    texts = spread.by_chunk(docs.filter("doc_id IS NOT NULL"), ["doc_id", "text"], c)
    sent = ["doc_id", *SET, "node"]
    reps = classes.select(spread.chunk_of(F.col("rep"), c).alias("chunk"), F.col("rep").alias("doc_id"), *SET, "node").repartition(p, "chunk")
    level = (
        texts.groupBy("chunk").cogroup(reps.groupBy("chunk")).applyInArrow(_send_shingles(n, k), spread.SENT)
        .repartition(p, "bucket").groupBy("bucket").applyInArrow(_rarity, spread.ANSWER_DDL)
    )
    told = level.select("chunk", "round", "bucket", "marks", *[F.lit(None).cast("long").alias(x) for x in sent]).unionAll(
        reps.select("chunk", F.lit(0).alias("round"), F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("marks"), *sent)
    )
    return texts.groupBy("chunk").cogroup(told.repartition(p, "chunk").groupBy("chunk")).applyInArrow(_keep_shared(k, percent), SHARED)


def linked_sets(sets: DataFrame, percent: int) -> DataFrame:
    """(node, component) for the sets that link with another; component is the least node reached."""
    sets = sets.withColumn("u", F.col("n") - F.col("s"))
    prefix = F.col("n") - F.ceil(F.col("n") * F.lit(percent) / 100.0 - F.lit(1e-9)) + 1 - F.col("u")
    posts = sets.select("node", "n", "s", "u", F.posexplode(F.slice("tokens", F.lit(1), prefix.cast("int"))).alias("at", "token"))
    posts = posts.withColumn("pos", F.col("at") + F.col("u")).drop("at")
    lists = posts.groupBy("token").agg(F.min(F.struct("u", "n", "node", "s")).alias("hub"), F.count("*").alias("size")).filter("size > 1")
    posts = cut(
        posts.join(lists.select("token", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.s").alias("hub_s")), "token")
    )
    fits = (F.least("s", "hub_s") >= _need("n", "hub_n", percent)) & (F.col("node") != F.col("hub"))
    hubs = posts.filter(fits).select(F.col("hub").alias("x"), F.col("node").alias("y")).distinct()
    known = cut(_verified(hubs, sets, percent))
    first = known.filter("linked").select("x", "y")
    comps = cut(connected_components(first, "x", "y").select(F.col("vertex").alias("node"), "component"))
    # entries of lists that aren't in one component yet; a set that the hub can't reach has overlap 0..s with it
    entries = (
        posts.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
        .join(known.select(F.col("x").alias("hub"), F.col("y").alias("node"), "o"), ["hub", "node"], "left")
    )
    open_ = entries.groupBy("token").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 <> c1").select("token")
    entries = entries.filter("node <> hub").join(open_, "token", "left_semi")
    ratio = np.log(100.0 / percent)
    measures = ["n", "s", "rest", "in_hub", "off_hub"]
    entries = entries.select(
        "token", "node", "n", "s", "component", (F.col("n") - F.col("pos")).alias("rest"), F.coalesce("o", "s").alias("in_hub"),
        F.when(F.col("o").isNull(), F.col("s")).otherwise(F.col("s") - F.col("o")).alias("off_hub"),
    )

    def side(frame: DataFrame, tag: str, keep: list[str]) -> DataFrame:
        return frame.select(F.col("token").alias(f"token{tag}"), *[F.col(c).alias(f"{c}{tag}") for c in keep])

    def bounds(*extra):
        return [F.max(c).alias(c) for c in ("rest", "s", "in_hub", "off_hub")] + list(extra)

    def able():
        """Whether the bounds of two sides leave room for a link."""
        need = _need("n1", "n2", percent)
        near = F.least("in_hub1", "in_hub2") + F.least("off_hub1", "off_hub2")
        return (F.least("s1", "s2") >= need) & (F.least("rest1", "rest2") >= need) & (near >= need)

    # first, each entry against its list's sets of each size as wholes: most have no partner left
    sizes = entries.groupBy("token", "n").agg(*bounds(F.min("component").alias("c0"), F.max("component").alias("c1")))
    one = side(entries, "1", ["node", "component", *measures])
    two = side(sizes, "2", ["c0", "c1", *measures])
    other = (F.col("c02") != F.col("component1")) | (F.col("c12") != F.col("component1"))
    some = one.join(two, (F.col("token1") == F.col("token2")) & other & able(), "left_semi")
    entries = cut(
        some.select(*[F.col(f"{c}1").alias(c) for c in ("token", "node", "component", *measures)])
        .withColumn("len", F.floor(F.log(F.col("n").cast("double")) / F.lit(ratio)).cast("int"))
        .withColumn("block", F.floor((F.col("n") - F.col("rest")) / 8).cast("int"))
    )
    key = ["component", "len", "block"]
    blocks = entries.groupBy("token", *key).agg(*bounds(F.min("n").alias("n")))
    left, right = (side(blocks, t, [*key, *measures]) for t in "12")
    near = (F.col("component1") < F.col("component2")) & (F.abs(F.col("len1") - F.col("len2")) <= 1) & able()
    pairs = left.join(right, F.col("token1") == F.col("token2")).filter(near).drop(*[f"{c}1" for c in measures])
    left, right = (side(entries, t, [*key, "node", *measures]) for t in "12")
    close = pairs.join(left, ["token1", *[f"{c}1" for c in key]]).filter(able()).drop(*[f"{c}2" for c in measures])
    close = close.join(right, ["token2", *[f"{c}2" for c in key]]).filter(able())
    rest = close.select(F.col("node1").alias("x"), F.col("node2").alias("y")).distinct()
    # what these links join are whole components
    found = cut(_verified(rest, sets, percent).filter("linked").select("x", "y"))
    for end in ("x", "y"):
        own = comps.select(F.col("node").alias(end), F.col("component").alias("c"))
        found = found.join(own, end, "left").withColumn(end, F.coalesce("c", end)).drop("c")
    joined = connected_components(found, "x", "y").select(F.col("vertex").alias("component"), F.col("component").alias("least"))
    every = comps.unionAll(joined.select(F.col("component").alias("node"), "component")).dropDuplicates(["node"])
    return every.join(joined, "component", "left").select("node", F.coalesce("least", "component").alias("component"))


def _of_one_id(sets: DataFrame, classes: DataFrame, comps: DataFrame) -> DataFrame:
    """The components, with those joined that texts of one doc_id are in."""
    own = sets.join(classes.select(*SET, "node"), list(SET)).join(comps, "node", "left")
    own = cut(own.select("doc_id", "node", F.coalesce("component", "node").alias("component")))
    least = own.groupBy("doc_id").agg(F.min("component").alias("least"))
    joined = connected_components(own.join(least, "doc_id"), "component", "least").select(F.col("vertex").alias("component"), F.col("component").alias("least"))
    every = comps.unionAll(own.select("node", "component")).dropDuplicates(["node"])
    return cut(every.join(joined, "component", "left").select("node", F.coalesce("least", "component").alias("component")))


def components(docs: DataFrame, *, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) for each row of ``docs``."""
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = cut(picked.mapInArrow(_digests(k), "doc_id long, n_shingles long, s1 long, s2 long"))
    # numbers are written with their classes, so they stay the same however often they are read
    classes = cut(
        sets.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*SET).agg(F.min("doc_id").alias("rep")).withColumn("node", F.monotonically_increasing_id())
    )
    comps = cut(linked_sets(cut(shared_sets(picked, classes, k, percent)), percent))
    by_id = sets.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct(*SET)).alias("c0"), F.max(F.struct(*SET)).alias("c1"))
    several = cut(by_id.filter("c0 <> c1").select("doc_id"))
    some = sets.join(several, "doc_id", "left_semi")
    unlike = bool(several.head(1))
    if unlike:
        comps = _of_one_id(some, classes, comps)
    inside = comps.join(classes.select("node", "rep"), "node")
    least = inside.groupBy("component").agg(F.min("rep").alias("least"))
    reach = classes.join(comps, "node", "left").join(least, "component", "left").select(*SET, F.coalesce("least", "rep").alias("component_id"))
    found = sets.join(reach, list(SET), "left")
    if unlike:  # a text without shingles, too, is where the others of its doc_id are
        others = some.join(reach, list(SET)).groupBy("doc_id").agg(F.min("component_id").alias("other"))
        found = found.join(others, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "other"))
    return found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def op4_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + {WORDS - 1}], ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {WORDS - 2}, least(len(ws), 1) + 1))) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= {PERCENT} * (a.n + b.n - o)),
g AS (SELECT x AS a, y AS b FROM l UNION SELECT y, x FROM l UNION SELECT doc_id, doc_id FROM w),
t(vertex, least_vertex) USING KEY (vertex) AS (
  SELECT DISTINCT a, a FROM g
  UNION
  (SELECT g.b, min(t.least_vertex) FROM t JOIN g ON g.a = t.vertex JOIN recurring.t AS now ON now.vertex = g.b WHERE t.least_vertex < now.least_vertex GROUP BY g.b))
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, t.least_vertex AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN t ON t.vertex = w.doc_id
"""
