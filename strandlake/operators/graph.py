"""The graph of overlapping k-mers.

Nodes are the present k-mers on both strands; an edge a -> b stands for every pair of
nodes where the last k-1 bases of a are the first of b, with the count of b's canonical
k-mer as its weight.  The (k+1)-mer itself need not occur.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import nucleotide as nt
from strandlake.operators import prefix
from strandlake.operators.components import connected_components, settle, shared_folder

#: Folders that neighbours are kept in by a hash of the k-mer, for each shuffle partition.
FOLDERS = 4
#: Steps of a search from seeds, and the share of all k-mers it may have reached, before components finish it.
FRONTIER_ROUNDS = 32
FRONTIER_SHARE = 1 / 16


def oriented(counts: DataFrame) -> DataFrame:
    """(kmer, cnt) on both strands; a k-mer that is its own reverse complement stands once."""
    strands = F.array_distinct(F.array("kmer", nt.reverse_complement(F.col("kmer"))))
    return counts.select(F.explode(strands).alias("kmer"), "cnt")


def edges(counts: DataFrame, k: int, multigraph: bool = False) -> DataFrame:
    """(u, v, w).  At most four nodes share an end, so no key of the join is hot.

    ``multigraph`` gives edges between the two strands of one k-mer, or a k-mer and itself,
    twice, as a traversal that looks along both strands would; for odd k only.
    """
    if multigraph and k % 2 == 0:
        raise ValueError("how often an edge stands in the multigraph is defined for odd k only")
    nodes = oriented(counts)
    heads = nodes.select(F.col("kmer").alias("u"), F.substring("kmer", 2, k - 1).alias("overlap"))
    tails = nodes.select(F.col("kmer").alias("v"), F.col("cnt").alias("w"), F.substring("kmer", 1, k - 1).alias("overlap"))
    out = heads.join(tails, "overlap").select("u", "v", "w")
    if multigraph:
        times = F.when(same_kmer(), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
        out = out.withColumn("copy", F.explode(times)).drop("copy")
    return out


def same_kmer():
    return nt.canonical(F.col("u")) == nt.canonical(F.col("v"))


def self_edges(edge_frame: DataFrame) -> DataFrame:
    return edge_frame.filter(same_kmer())


def unmirrored(edge_frame: DataFrame) -> DataFrame:
    """Edges whose mirror on the other strand is missing: none in a whole graph."""
    mirror = edge_frame.select(nt.reverse_complement(F.col("v")).alias("u"), nt.reverse_complement(F.col("u")).alias("v"))
    return edge_frame.join(mirror, ["u", "v"], "left_anti")


def degrees(edge_frame: DataFrame) -> DataFrame:
    """(kmer, in_degree, out_degree, in_weight, out_weight) for nodes on an edge."""
    one, none = F.lit(1), F.lit(0)
    ends = edge_frame.select(F.explode(F.array(
        F.struct(F.col("u").alias("kmer"), none.alias("i"), one.alias("o"), F.lit(0).cast("bigint").alias("iw"), F.col("w").alias("ow")),
        F.struct(F.col("v").alias("kmer"), one.alias("i"), none.alias("o"), F.col("w").alias("iw"), F.lit(0).cast("bigint").alias("ow")),
    )).alias("end")).select("end.*")
    return ends.groupBy("kmer").agg(
        F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.sum("iw").alias("in_weight"), F.sum("ow").alias("out_weight")
    )


def isolated(counts: DataFrame, edge_frame: DataFrame) -> DataFrame:
    """Canonical k-mers that no edge touches on either strand."""
    touched = edge_frame.select(F.explode(F.array("u", "v")).alias("kmer")).select(nt.canonical(F.col("kmer")).alias("kmer")).distinct()
    return counts.join(touched, "kmer", "left_anti")


def nodes(edge_frame: DataFrame) -> DataFrame:
    return edge_frame.select(F.explode(F.array("u", "v")).alias("kmer")).distinct()


def dense_ids(frame: DataFrame, key: str, first: int = 1) -> DataFrame:
    """The rows with id = first, first + 1, ... in the order of a distinct key.

    Rows are dealt by ranges of the key and numbered within each; the ranges' sizes are
    summed up in tasks, so nothing passes through the driver.
    """
    n = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = settle(frame.repartitionByRange(n, key).withColumn("_part", F.spark_partition_id()))
    before = prefix.ahead(dealt.groupBy(F.col("_part").alias("block")).agg(F.count(F.lit(1)).alias("total")), n)
    number = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    numbered = dealt.withColumn("_n", number).join(before.withColumnRenamed("block", "_part"), "_part")
    return numbered.withColumn("id", F.col("ahead") + F.col("_n") + (first - 1)).drop("_part", "_n", "ahead")


def node_ids(edge_frame: DataFrame) -> DataFrame:
    """(kmer, id): nodes numbered from 1 in lexicographic order."""
    return dense_ids(nodes(edge_frame), "kmer").select("kmer", "id")


def matrix(edge_frame: DataFrame, ids: DataFrame) -> DataFrame:
    """(row, col, val): the adjacency matrix by node numbers."""
    rows = edge_frame.join(ids.select(F.col("kmer").alias("u"), F.col("id").alias("row")), "u")
    both = rows.join(ids.select(F.col("kmer").alias("v"), F.col("id").alias("col")), "v")
    return both.select("row", "col", F.col("w").alias("val"))


def totals(edge_frame: DataFrame) -> DataFrame:
    """(node_count, edge_count)."""
    found = nodes(edge_frame).agg(F.count("*").alias("node_count"))
    return found.crossJoin(edge_frame.agg(F.count("*").alias("edge_count")))  # one row each


def vertex_components(edge_frame: DataFrame, level: str = "oriented") -> DataFrame:
    """(kmer, component): the least k-mer that edges reach, by node or, at level "canonical", by canonical k-mer."""
    if level not in ("oriented", "canonical"):
        raise ValueError(f"level is oriented or canonical, not {level}")
    ends = [nt.canonical(F.col(c)).alias(c) if level == "canonical" else F.col(c) for c in "uv"]
    found = connected_components(edge_frame.select(*ends), "u", "v")
    return found.select(F.col("vertex").alias("kmer"), "component")


def component_sizes(edge_frame: DataFrame, level: str = "oriented") -> DataFrame:
    """(component, size): components numbered from 0 in the order of their least k-mer."""
    sizes = vertex_components(edge_frame, level).groupBy("component").agg(F.count("*").alias("size"))
    return dense_ids(sizes, "component", first=0).select(F.col("id").alias("component"), "size")


def component_count(edge_frame: DataFrame, n_vertices: DataFrame | None = None, u: str = "u", v: str = "v") -> DataFrame:
    """(components): how many there are; with ``n_vertices``, one row (n), vertices on no edge are one each."""
    found = connected_components(edge_frame, u, v).agg(F.count(F.lit(1)).alias("touched"), F.count_if(F.col("vertex") == F.col("component")).alias("components"))
    if n_vertices is None:
        return found.select("components")
    return found.crossJoin(n_vertices.select("n")).select((F.col("components") + F.col("n") - F.col("touched")).alias("components"))  # one row each


def reachable(edge_frame: DataFrame, seeds: DataFrame, rounds: int = FRONTIER_ROUNDS, share: float = FRONTIER_SHARE) -> DataFrame:
    """Edges of the components that hold a seed; seeds are canonical k-mers and reach along both strands."""
    inside = reached(edge_frame, seeds, rounds, share).select(F.col("kmer").alias("c"))
    return edge_frame.withColumn("c", nt.canonical(F.col("u"))).join(inside, "c", "left_semi").drop("c")


def reached(edge_frame: DataFrame, seeds: DataFrame, rounds: int = FRONTIER_ROUNDS, share: float = FRONTIER_SHARE) -> DataFrame:
    """(kmer): the canonical k-mers on an edge that a path joins with a seed, seeds included.

    A frontier moves out from the seeds.  Neighbours are kept in folders by a hash of the
    k-mer, and a round reads those of its frontier's hashes only, so it costs what it
    reaches.  What a round finds lies one step on, in the frontier or one step back: the
    visited that it leaves out are the last two frontiers.  Frontiers that still move
    after ``rounds``, or have reached more than ``share`` of all k-mers, are past
    what single steps are for: the components of what isn't visited yet finish the search.
    """
    spark, ends = edge_frame.sparkSession, [nt.canonical(F.col(c)) for c in "uv"]
    one_way = edge_frame.select(ends[0].alias("a"), ends[1].alias("b"))
    n = FOLDERS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    near_path = f"{shared_folder(spark)}/rounds/{uuid.uuid4().hex}"
    near = one_way.unionAll(one_way.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().withColumn("p", _folder("a", n))
    near.repartition("p").write.partitionBy("p").parquet(near_path)
    near = spark.read.schema("a string, b string, p int").parquet(near_path)
    total = near.select("a").distinct().count()
    frontier = settle(near.join(seeds.select(F.col("kmer").alias("a")), "a", "left_semi").select(F.col("a").alias("kmer")).distinct())
    before, levels, seen = frontier.limit(0), [frontier], frontier.count()
    for _ in range(rounds):
        if seen > share * total:
            break
        folders = [r.p for r in frontier.select(_folder("kmer", n).alias("p")).distinct().collect()]  # as many as there are folders at most
        if not folders:
            return reduce(DataFrame.unionAll, levels)
        step = near.filter(F.col("p").isin(folders)).join(frontier.withColumnRenamed("kmer", "a"), "a", "left_semi").select(F.col("b").alias("kmer")).distinct()
        before, frontier = frontier, settle(step.join(frontier, "kmer", "left_anti").join(before, "kmer", "left_anti"))
        levels.append(frontier)
        seen += frontier.count()
    done = reduce(DataFrame.unionAll, levels[:-1], levels[-1].limit(0))
    rest = near.select("a", "b").join(done.withColumnRenamed("kmer", "a"), "a", "left_anti").join(done.withColumnRenamed("kmer", "b"), "b", "left_anti")
    found = settle(connected_components(rest.select("a", "b"), "a", "b").select(F.col("vertex").alias("kmer"), "component"))
    held = found.join(frontier, "kmer", "left_semi").select("component").distinct()
    return done.unionAll(frontier).unionAll(found.join(held, "component", "left_semi").select("kmer")).distinct()


def _folder(kmer: str, n: int):
    return F.pmod(F.xxhash64(kmer), F.lit(n)).cast("int")
