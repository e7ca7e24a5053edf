"""Queries over the driver's tables, any text column being a read, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import hashing
from strandlake.functions import nucleotide as nt
from strandlake.operators import curve, graph, kmers, sampling, seedcache
from strandlake.operators.components import settle, shared_folder
from strandlake.plans.assembly import assemble
from strandlake.sources import matrices, reads
from strandlake.streaming import counts as streams
from strandlake.streaming import ids
from strandlake.streaming.components import GrowingComponents

K = 15
SEEDS = 20
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query by its function's name, with the SQL for the same rows if there is one."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


def texts(spark: SparkSession, sf_dir: str, table: str, key: str, text: str = "text", encode: bool = True) -> DataFrame:
    """A table's texts as reads, encoded or as they are; a table that comes in fewer parts than there are cores is dealt out first."""
    frame = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key, text)
    cores = spark.sparkContext.defaultParallelism
    if frame.rdd.getNumPartitions() < cores:
        frame = frame.repartition(cores)
    return reads.from_text(frame, text, key) if encode else frame.select(key, F.col(text).alias("seq"))


def documents(spark: SparkSession, sf_dir: str, encode: bool = True) -> DataFrame:
    return texts(spark, sf_dir, "documents", "doc_id", encode=encode)


def benchmark(spark: SparkSession, sf_dir: str, encode: bool = True) -> DataFrame:
    return texts(spark, sf_dir, "benchmark", "item_id", encode=encode)


def _encode_sql(text: str) -> str:
    for pattern, letters in nt.WIDE:
        text = f"regexp_replace({text}, '{pattern}', '{letters}', 'g')"
    return f"upper(regexp_replace({text}, '[^ACGTacgt]', 'A', 'g'))"


def _rc(x: str) -> str:
    return f"reverse(translate({x}, 'ACGT', 'TGCA'))"


def _seqs(table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    return f"s AS (SELECT {key}, {_encode_sql(text)} AS seq FROM {table} WHERE {text} IS NOT NULL)"


def _counts(k: int, table: str = "documents", key: str = "doc_id") -> str:
    return f"""{_seqs(table, key)},
m AS (SELECT substring(seq, i, {k}) AS m FROM (SELECT seq, unnest(range(1, length(seq) - {k} + 2)) AS i FROM s)),
r AS (SELECT m, count(*) AS c FROM m GROUP BY m),
c AS MATERIALIZED (SELECT least(m, {_rc("m")}) AS kmer, sum(c)::BIGINT AS cnt FROM r GROUP BY 1)"""


def _edges(k: int, table: str = "documents", key: str = "doc_id") -> str:
    return f"""{_counts(k, table, key)},
o AS MATERIALIZED (SELECT DISTINCT kmer, cnt FROM (SELECT kmer, cnt FROM c UNION ALL SELECT {_rc("kmer")}, cnt FROM c)),
e AS MATERIALIZED (SELECT a.kmer AS u, b.kmer AS v, b.cnt AS w FROM o a JOIN o b ON substring(a.kmer, 2) = substring(b.kmer, 1, {k - 1})),
n AS (SELECT u AS kmer FROM e UNION SELECT v FROM e),
d AS (SELECT kmer, row_number() OVER (ORDER BY kmer) AS id FROM n),
x AS (SELECT a.id AS "row", b.id AS col, w AS val FROM e JOIN d a ON e.u = a.kmer JOIN d b ON e.v = b.kmer)"""


def _draw_sql(text: str, at: int = 0) -> str:
    return f"('0x' || substring(md5({text}), {8 * at + 1}, 8))::UBIGINT"


# ---- reads and sequences


@query(f"WITH {_seqs()} SELECT doc_id, seq FROM s WHERE {_draw_sql("'11:' || doc_id")} < {sampling.DRAWS // 4}")
def read_sample(spark, sf_dir):
    return sampling.sample(documents(spark, sf_dir), 0.25, 11, "doc_id")


@query(f"WITH {_seqs()} SELECT doc_id, " + ", ".join(f"(length(seq) - length(replace(seq, '{b}', '')))::BIGINT AS n_{b.lower()}" for b in "ACGT") + " FROM s")
def base_composition(spark, sf_dir):
    return kmers.base_composition(documents(spark, sf_dir), "doc_id")


@query(f"WITH {_seqs('pages', 'page_id', 'html')} SELECT page_id, seq FROM s")
def read_encode_pages(spark, sf_dir):
    return texts(spark, sf_dir, "pages", "page_id", "html")


@query(f"SELECT conv_id, turn, {_encode_sql('text')} AS seq FROM conversations WHERE text IS NOT NULL")
def read_encode_conversations(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/conversations.parquet").filter("text IS NOT NULL")
    return frame.select("conv_id", "turn", nt.encode(F.col("text")).alias("seq"))


@query(f"WITH {_seqs('benchmark', 'item_id')} SELECT item_id, translate(seq, 'ACGT', 'TGCA') AS complement, {_rc('seq')} AS revcomp, reverse(seq) AS reversed FROM s")
def sequence_strands(spark, sf_dir):
    seq = F.col("seq")
    return benchmark(spark, sf_dir).select("item_id", nt.complement(seq).alias("complement"), nt.reverse_complement(seq).alias("revcomp"), F.reverse(seq).alias("reversed"))


@query("SELECT item_id, translate(text, 'acgtACGT', 'tgcaTGCA') AS complement, reverse(translate(text, 'acgtACGT', 'tgcaTGCA')) AS revcomp FROM benchmark")
def text_strands(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return frame.select("item_id", nt.complement_text(F.col("text")).alias("complement"), nt.reverse_complement_text(F.col("text")).alias("revcomp"))


@query(f"""WITH {_seqs("benchmark", "item_id")} SELECT item_id, ceil(length(seq) / 32.0)::BIGINT AS limbs, substring(seq, 6, 1) AS base5,
concat(substring(seq, 1, 5), 'T', substring(seq, 7)) AS with_t5, substring(seq, 4, 11) AS win, reverse(substring(seq, 4, 11)) AS win_reversed,
concat(seq, 'AACGA') AS appended, concat(seq, reverse(substring(seq, 1, 7))) AS appended_kmer FROM s WHERE length(seq) >= 14""")
def sequence_edit(spark, sf_dir):
    seq = F.col("seq")
    return benchmark(spark, sf_dir).filter(F.length(seq) >= 14).select(
        "item_id", nt.limbs(seq).alias("limbs"), nt.base_at(seq, 5).alias("base5"), nt.set_base(seq, 5, "T").alias("with_t5"), nt.window(seq, 3, 11).alias("win"),
        nt.window_reversed(seq, 3, 11).alias("win_reversed"), nt.append(seq, F.lit("nacg-")).alias("appended"), nt.append_kmer(seq, nt.window(seq, 0, 7)).alias("appended_kmer"),
    )


@query(f"WITH {_seqs('benchmark', 'item_id')} SELECT item_id, row_number() OVER (ORDER BY length(seq), seq, item_id) AS place FROM s")
def sequence_order(spark, sf_dir):
    found = benchmark(spark, sf_dir).select("item_id", F.struct(F.length("seq").alias("n"), "seq", "item_id").alias("key"))
    return graph.dense_ids(found, "key").select("item_id", F.col("id").alias("place"))


@query(f"""WITH {_seqs("benchmark", "item_id")}, p AS (SELECT item_id, seq, reverse(translate(substring(seq, 1, 32), 'ACGT', 'TGCA')) AS q, unnest(range(1, 33)) AS i FROM s WHERE length(seq) >= 40)
SELECT item_id, sum((substring(q, i, 1) <> substring(seq, i + 5, 1))::INT)::INT AS miss, least(sum((substring(q, i, 1) <> substring(seq, i + 5, 1))::INT), 10)::INT AS miss10 FROM p GROUP BY item_id""")
def hamming_offset(spark, sf_dir):
    seq = F.col("seq")
    found = benchmark(spark, sf_dir).filter(F.length(seq) >= 40).withColumn("q", nt.reverse_complement(F.substring(seq, 1, 32)))
    miss = nt.mismatches(F.col("q"), seq, F.lit(5))
    return found.select("item_id", miss.cast("int").alias("miss"), nt.mismatches(F.col("q"), seq, F.lit(5), 10).cast("int").alias("miss10"))


@query(f"""WITH {_seqs("benchmark", "item_id")}, p AS (SELECT item_id, seq, reverse(translate(seq, 'ACGT', 'TGCA')) AS q, unnest(range(1, length(seq) + 1)) AS i FROM s)
SELECT item_id, sum((substring(q, i, 1) <> substring(seq, i + 3, 1))::INT)::INT AS miss FROM p GROUP BY item_id""")
def hamming_whole(spark, sf_dir):
    seq = F.col("seq")
    return benchmark(spark, sf_dir).filter(F.length(seq) > 0).select("item_id", nt.mismatches(nt.reverse_complement(seq), seq, F.lit(3)).cast("int").alias("miss"))


# ---- k-mers

_number = "list_reduce(list_transform(string_split(kmer, ''), lambda x: (strpos('ACGT', x) - 1)::BIGINT), lambda a, b: a * 4 + b)"


@query(f"WITH {_counts(11)} SELECT m AS kmer, c::BIGINT AS cnt FROM r")
def kmer_count(spark, sf_dir):
    return kmers.count(documents(spark, sf_dir, encode=False), 11)


@query(f"WITH {_counts(11)} SELECT kmer, cnt FROM c")
def kmer_count_canonical_11(spark, sf_dir):
    return kmers.count_canonical(documents(spark, sf_dir, encode=False), 11)


@query(f"WITH {_counts(25)} SELECT kmer, cnt FROM c")
def kmer_count_canonical_25(spark, sf_dir):
    return kmers.count_canonical(documents(spark, sf_dir, encode=False), 25)


@query(f"WITH {_counts(32, 'benchmark', 'item_id')} SELECT kmer, cnt FROM c")
def kmer_count_canonical_32(spark, sf_dir):
    return kmers.count_canonical(benchmark(spark, sf_dir, encode=False), 32)


@query(f"WITH {_counts(K)} SELECT kmer, least(cnt, 1023)::BIGINT AS cnt FROM c")
def kmer_count_saturated(spark, sf_dir):
    return kmers.count_canonical(documents(spark, sf_dir, encode=False), K, saturate=kmers.SATURATED)


@query(f"WITH {_counts(25)} SELECT cnt, count(*)::BIGINT AS n_kmers FROM c GROUP BY cnt")
def kmer_spectrum(spark, sf_dir):
    return kmers.spectrum(kmers.count_canonical(documents(spark, sf_dir, encode=False), 25))


@query(f"WITH {_seqs()} SELECT doc_id, greatest(length(seq) - 24, 0)::BIGINT AS n_kmers FROM s")
def kmers_per_read(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", kmers.windows_per_read(F.length("seq"), 25).alias("n_kmers"))


@query(f"WITH {_counts(25)} SELECT kmer, cnt FROM c ORDER BY cnt DESC, kmer LIMIT {SEEDS}")
def kmer_seeds(spark, sf_dir):
    return kmers.seeds(kmers.count_canonical(documents(spark, sf_dir, encode=False), 25), SEEDS)


@query(f"WITH {_counts(25)} SELECT kmer, cnt FROM c ORDER BY cnt DESC, kmer LIMIT {SEEDS}")
def kmer_seeds_recounted(spark, sf_dir):
    return seedcache.seeds_recounted(documents(spark, sf_dir, encode=False), 25, SEEDS)


@query()
def kmer_seeds_decaying(spark, sf_dir):
    return seedcache.seeds_decaying(documents(spark, sf_dir, encode=False), 25, SEEDS)


@query()
def kmer_seeds_approximate(spark, sf_dir):
    return kmers.seeds_approximate(documents(spark, sf_dir, encode=False), 25, SEEDS)


@query(f"""WITH {_counts(K)}, q AS (SELECT DISTINCT least(substring(z, i, {K}), {_rc(f"substring(z, i, {K})")}) AS kmer
FROM (SELECT z, unnest(range(1, length(z) - {K} + 2)) AS i FROM (SELECT {_encode_sql("text")} AS z FROM benchmark)))
SELECT q.kmer, coalesce(c.cnt, 0)::BIGINT AS cnt FROM q LEFT JOIN c ON q.kmer = c.kmer""")
def kmer_lookup(spark, sf_dir):
    keys = kmers.count_canonical(benchmark(spark, sf_dir, encode=False), K).select("kmer")
    return kmers.lookup(keys, kmers.count_canonical(documents(spark, sf_dir, encode=False), K))


@query(f"""WITH {_counts(K)}, q AS (SELECT DISTINCT least(substring(z, i, {K}), {_rc(f"substring(z, i, {K})")}) AS kmer
FROM (SELECT z, unnest(range(1, length(z) - {K} + 2)) AS i FROM (SELECT {_encode_sql("text")} AS z FROM benchmark)))
SELECT kmer, cnt FROM c WHERE kmer NOT IN (SELECT kmer FROM q)""")
def kmer_remove(spark, sf_dir):
    keys = kmers.count_canonical(benchmark(spark, sf_dir, encode=False), K)
    return kmers.remove(kmers.count_canonical(documents(spark, sf_dir, encode=False), K), keys)


@query(f"WITH {_counts(K)} SELECT kmer, {_number} AS packed, kmer AS unpacked FROM c")
def kmer_pack(spark, sf_dir):
    packed = kmers.count_canonical(documents(spark, sf_dir, encode=False), K).select("kmer", nt.pack(F.col("kmer"), K).alias("packed"))
    return packed.withColumn("unpacked", nt.unpack(F.col("packed"), K))


@query(f"WITH {_counts(K)} SELECT kmer, ({_number} % {4**7})::BIGINT AS last7 FROM c")
def kmer_masks(spark, sf_dir):
    packed = nt.pack(F.col("kmer"), K)
    return kmers.count_canonical(documents(spark, sf_dir, encode=False), K).select("kmer", packed.bitwiseAND(F.lit(nt.mask(7))).alias("last7"))


@query(f"""WITH {_counts(K)}, w AS (SELECT kmer, cnt, 0 AS way, {_draw_sql("kmer", 0)} % {kmers.SKETCH_WIDTH} AS cell FROM c
{" ".join(f"UNION ALL SELECT kmer, cnt, {i}, {_draw_sql('kmer', i)} % {kmers.SKETCH_WIDTH} FROM c" for i in range(1, kmers.SKETCH_DEPTH))}),
t AS (SELECT way, cell, sum(cnt)::BIGINT AS cnt FROM w GROUP BY way, cell) SELECT kmer, min(t.cnt) AS cnt FROM w JOIN t USING (way, cell) GROUP BY kmer""")
def kmer_sketch_counts(spark, sf_dir):
    found = documents(spark, sf_dir, encode=False)
    return kmers.sketch_lookup(kmers.count_canonical(documents(spark, sf_dir, encode=False), K), kmers.sketch(found, K))


@query(f"WITH {_counts(11)} SELECT kmer, cnt FROM c")
def kmer_count_streamed(spark, sf_dir):
    path = f"{sf_dir}/documents.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/{{documents}}.parquet")  # a pattern: the table may be one file
    out = _scratch(spark, "counts")
    running = streams.running_counts(stream.select(F.col("text").alias("seq")), 11).writeStream.outputMode("complete").trigger(availableNow=True)
    running.option("checkpointLocation", _scratch(spark, "stream")).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start().awaitTermination()
    return spark.read.parquet(out)


@query(f"WITH {_counts(11)} SELECT kmer, cnt FROM c WHERE substring(kmer, 1, 10) = substring(kmer, 2) OR substring(kmer, 1, 9) = substring(kmer, 3) OR substring(kmer, 1, 8) = substring(kmer, 4)")
def kmer_low_period(spark, sf_dir):
    return kmers.count_canonical(documents(spark, sf_dir, encode=False), 11).filter(nt.low_period(F.col("kmer"), 11))


@query(f"""WITH {_counts(11)}, b AS (SELECT unnest(['A', 'C', 'G', 'T']) AS x)
SELECT kmer, 'out' AS side, concat(substring(kmer, 2), x) AS neighbour FROM c, b UNION ALL SELECT kmer, 'in', concat(x, substring(kmer, 1, 10)) FROM c, b""")
def kmer_neighbours(spark, sf_dir):
    found = kmers.count_canonical(documents(spark, sf_dir, encode=False), 11)
    sides = (("out", nt.out_neighbours(F.col("kmer"))), ("in", nt.in_neighbours(F.col("kmer"), 11)))
    out, into = (found.select("kmer", F.lit(name).alias("side"), F.explode(near).alias("neighbour")) for name, near in sides)
    return out.unionAll(into)


# ---- graph


def _graph(spark, sf_dir, k: int = K) -> tuple[DataFrame, DataFrame]:
    counts = settle(kmers.count_canonical(documents(spark, sf_dir, encode=False), k))
    return counts, graph.edges(counts, k)


def _packed_edges(spark, sf_dir) -> DataFrame:
    """(u, v) as numbers in the order of the k-mers: rounds over components compare and exchange these."""
    return _graph(spark, sf_dir)[1].select(*[nt.pack(F.col(c), K).cast("bigint").alias(c) for c in "uv"])


@query(f"WITH {_edges(K)} SELECT u, v, w FROM e")
def graph_edges(spark, sf_dir):
    return _graph(spark, sf_dir)[1]


@query(f"WITH {_edges(K)} SELECT u, v, w FROM e UNION ALL SELECT u, v, w FROM e WHERE least(u, {_rc('u')}) = least(v, {_rc('v')})")
def graph_edges_multi(spark, sf_dir):
    return graph.edges(_graph(spark, sf_dir)[0], K, multigraph=True)


@query(f"WITH {_edges(K)} SELECT u, v, w FROM e WHERE least(u, {_rc('u')}) = least(v, {_rc('v')})")
def graph_self_edges(spark, sf_dir):
    return graph.self_edges(_graph(spark, sf_dir)[1])


@query(f"WITH {_edges(K)} SELECT u, v, w FROM e WHERE NOT EXISTS (SELECT 1 FROM e f WHERE f.u = {_rc('e.v')} AND f.v = {_rc('e.u')})")
def graph_unmirrored(spark, sf_dir):
    return graph.unmirrored(settle(_graph(spark, sf_dir)[1]))


@query(f"""WITH {_edges(K)}, i AS (SELECT v AS kmer, count(*) AS n, sum(w) AS w FROM e GROUP BY v), q AS (SELECT u AS kmer, count(*) AS n, sum(w) AS w FROM e GROUP BY u)
SELECT n.kmer, coalesce(i.n, 0)::BIGINT AS in_degree, coalesce(q.n, 0)::BIGINT AS out_degree, coalesce(i.w, 0)::BIGINT AS in_weight, coalesce(q.w, 0)::BIGINT AS out_weight
FROM n LEFT JOIN i ON n.kmer = i.kmer LEFT JOIN q ON n.kmer = q.kmer""")
def graph_degrees(spark, sf_dir):
    return graph.degrees(_graph(spark, sf_dir)[1])


@query(f"WITH {_edges(K)} SELECT (SELECT count(*) FROM n)::BIGINT AS node_count, (SELECT count(*) FROM e)::BIGINT AS edge_count")
def graph_totals(spark, sf_dir):
    return graph.totals(settle(_graph(spark, sf_dir)[1]))


@query(f"WITH {_edges(K)} SELECT kmer, cnt FROM c WHERE kmer NOT IN (SELECT least(kmer, {_rc('kmer')}) FROM n)")
def graph_isolated(spark, sf_dir):
    counts, edge_frame = _graph(spark, sf_dir)
    return graph.isolated(counts, edge_frame)


@query(f"WITH {_edges(K)} SELECT kmer, id FROM d")
def graph_node_ids(spark, sf_dir):
    return graph.node_ids(settle(_graph(spark, sf_dir)[1]))


@query(f"WITH {_edges(K)} SELECT \"row\", col, val FROM x")
def graph_matrix(spark, sf_dir):
    return assemble(documents(spark, sf_dir, encode=False), K).matrix


@query(f"""WITH {_edges(K)} SELECT '{matrices.BANNER}' AS line UNION ALL SELECT concat((SELECT count(*) FROM n), ' ', (SELECT count(*) FROM n), ' ', (SELECT count(*) FROM e))
UNION ALL SELECT concat("row", ' ', col, ' ', val) FROM x""")
def matrix_market_file(spark, sf_dir):
    found = assemble(documents(spark, sf_dir, encode=False), K)
    return matrices.matrix_market_lines(found.matrix, found.size()).select("line")


@query(f"""WITH {_edges(K)}, p AS (SELECT col, count(*) AS k FROM x GROUP BY col), j AS (SELECT unnest(range(1, (SELECT count(*) FROM n) + 2)) AS col)
SELECT j.col, (1 + coalesce(sum(coalesce(p.k, 0)) OVER (ORDER BY j.col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS ptr FROM j LEFT JOIN p ON p.col = j.col""")
def harwell_boeing_pointers(spark, sf_dir):
    found = assemble(documents(spark, sf_dir, encode=False), K)
    return matrices.column_pointers(found.matrix, found.size())


def _wide(number: str, width: int) -> str:
    return f"lpad(({number})::VARCHAR, {width}, ' ')"


@query(f"""WITH {_edges(K)}, z AS (SELECT (SELECT count(*) FROM n) AS n, (SELECT count(*) FROM e) AS m),
p AS (SELECT col, count(*) AS k FROM x GROUP BY col), j AS (SELECT unnest(range(1, (SELECT n FROM z) + 2)) AS col),
q AS (SELECT j.col, 1 + coalesce(sum(coalesce(p.k, 0)) OVER (ORDER BY j.col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ptr FROM j LEFT JOIN p ON p.col = j.col)
SELECT 0 AS section, 0::BIGINT AS a, 0::BIGINT AS b, '{matrices.TITLE:<72}{matrices.KEY:<8}' AS line
UNION ALL SELECT 0, 1, 0, concat({_wide("n + 2 * m + 1", 14)}, {_wide("n + 1", 14)}, {_wide("m", 14)}, {_wide("m", 14)}, {_wide("0", 14)}) FROM z
UNION ALL SELECT 0, 2, 0, concat('RUA', {_wide("n", 25)}, {_wide("n", 14)}, {_wide("m", 14)}, {_wide("0", 14)}) FROM z
UNION ALL SELECT 0, 3, 0, '{"(1I11)":>16}{"(1I11)":>16}{"(1E9.0)":>20}{"":20}'
UNION ALL SELECT 1, col, 0, {_wide("ptr::BIGINT", 11)} FROM q
UNION ALL SELECT 2, col, "row", {_wide('"row"', 11)} FROM x
UNION ALL SELECT 3, col, "row", {_wide("val", 9)} FROM x""")
def harwell_boeing_file(spark, sf_dir):
    found = assemble(documents(spark, sf_dir, encode=False), K)
    return matrices.harwell_boeing_lines(found.matrix, found.size()).select("section", "a", "b", "line")


_LEAST = """, t(vertex, least_vertex) USING KEY (vertex) AS (
  SELECT DISTINCT a, a FROM g
  UNION
  (SELECT g.b, min(t.least_vertex) FROM t JOIN g ON g.a = t.vertex JOIN recurring.t AS now ON now.vertex = g.b WHERE t.least_vertex < now.least_vertex GROUP BY g.b))"""
_BENCH_GRAPH = _edges(11, "benchmark", "item_id")


@query(f"""WITH RECURSIVE {_BENCH_GRAPH}, g AS (SELECT u AS a, v AS b FROM e UNION SELECT v, u FROM e){_LEAST}
SELECT (row_number() OVER (ORDER BY least_vertex) - 1)::BIGINT AS component, count(*)::BIGINT AS size FROM t GROUP BY least_vertex""")
def component_sizes(spark, sf_dir):
    counts = settle(kmers.count_canonical(benchmark(spark, sf_dir, encode=False), 11))
    return graph.component_sizes(settle(graph.edges(counts, 11)))


@query(f"""WITH RECURSIVE {_BENCH_GRAPH}, h AS (SELECT least(u, {_rc("u")}) AS a, least(v, {_rc("v")}) AS b FROM e),
g AS (SELECT a, b FROM h UNION SELECT b, a FROM h){_LEAST}
SELECT (row_number() OVER (ORDER BY least_vertex) - 1)::BIGINT AS component, count(*)::BIGINT AS size FROM t GROUP BY least_vertex""")
def component_sizes_canonical(spark, sf_dir):
    counts = settle(kmers.count_canonical(benchmark(spark, sf_dir, encode=False), 11))
    return graph.component_sizes(settle(graph.edges(counts, 11)), "canonical")


@query(f"""WITH RECURSIVE {_BENCH_GRAPH}, h AS (SELECT least(u, {_rc("u")}) AS a, least(v, {_rc("v")}) AS b FROM e),
g AS (SELECT a, b FROM h UNION SELECT b, a FROM h){_LEAST},
z AS (SELECT kmer FROM c ORDER BY cnt DESC, kmer LIMIT {SEEDS})
SELECT e.u, e.v, e.w FROM e JOIN t ON t.vertex = least(e.u, {_rc("e.u")}) WHERE t.least_vertex IN (SELECT least_vertex FROM t JOIN z ON z.kmer = t.vertex)""")
def seed_reachable(spark, sf_dir):
    counts = settle(kmers.count_canonical(benchmark(spark, sf_dir, encode=False), 11))
    return graph.reachable(settle(graph.edges(counts, 11)), kmers.seeds(counts, SEEDS))


@query(f"""WITH RECURSIVE {_BENCH_GRAPH}, g AS (SELECT u AS a, v AS b FROM e UNION SELECT v, u FROM e){_LEAST}
SELECT (count(DISTINCT least_vertex) + (SELECT count(*) FROM o) - count(*))::BIGINT AS components FROM t""")
def component_count(spark, sf_dir):
    counts = settle(kmers.count_canonical(benchmark(spark, sf_dir, encode=False), 11))
    strands = F.when(F.col("kmer") == nt.reverse_complement(F.col("kmer")), 1).otherwise(2)
    return graph.component_count(settle(graph.edges(counts, 11)), counts.agg(F.sum(strands).alias("n")))


@query(f"""WITH {_edges(K)} SELECT u, v, row_number() OVER (ORDER BY w DESC, {_draw_sql("concat_ws(':', '7', u, v)")}, u, v) - 1 AS pos FROM e""")
def edge_shuffle(spark, sf_dir):
    return curve.ordered(assemble(documents(spark, sf_dir, encode=False), K).edges, seed=7)


@query(f"""WITH RECURSIVE {_BENCH_GRAPH}, p AS MATERIALIZED (SELECT "row" AS u, col AS v, row_number() OVER (ORDER BY val DESC, "row", col) - 1 AS pos FROM x),
cuts AS MATERIALIZED (SELECT unnest(range(0, (SELECT count(*) FROM p), 100)) AS pos),
g AS MATERIALIZED (SELECT cuts.pos, u AS a, v AS b FROM cuts JOIN p ON p.pos >= cuts.pos UNION SELECT cuts.pos, v, u FROM cuts JOIN p ON p.pos >= cuts.pos),
t(pos, vertex, least_vertex) USING KEY (pos, vertex) AS (
  SELECT cuts.pos, d.id, d.id FROM cuts CROSS JOIN d
  UNION
  (SELECT g.pos, g.b, min(t.least_vertex) FROM t JOIN g ON g.pos = t.pos AND g.a = t.vertex JOIN recurring.t AS now ON now.pos = g.pos AND now.vertex = g.b
   WHERE t.least_vertex < now.least_vertex GROUP BY g.pos, g.b))
SELECT pos, count(DISTINCT least_vertex)::BIGINT AS components FROM t GROUP BY pos""")
def expansion_curve(spark, sf_dir):
    found = assemble(benchmark(spark, sf_dir, encode=False), 11)
    return curve.expansion_curve(found.matrix, 100, u="row", v="col", w="val")


_DOC_GRAPH = _edges(K)


@query(f"""WITH RECURSIVE {_DOC_GRAPH}, g AS (SELECT u AS a, v AS b FROM e UNION SELECT v, u FROM e){_LEAST}
SELECT (row_number() OVER (ORDER BY least_vertex) - 1)::BIGINT AS component, count(*)::BIGINT AS size FROM t GROUP BY least_vertex""")
def component_sizes_documents(spark, sf_dir):
    return graph.component_sizes(settle(_packed_edges(spark, sf_dir)))


@query()  # tests compare curves with a recount for each prefix; in SQL that takes minutes on this graph
def expansion_curve_documents(spark, sf_dir):
    found = assemble(documents(spark, sf_dir, encode=False), K)
    return curve.expansion_curve(found.matrix, 25_000, u="row", v="col", w="val")


# ---- hashes

_ALL = "18446744073709551615::UHUGEINT"


def _after(source: str, *steps: tuple[str, str]) -> str:
    """Rows of source with columns computed one after the other."""
    for name, value in steps:
        source = f"(SELECT * EXCLUDE ({name}), {value} AS {name} FROM {source})"
    return source


def _mix_sql(first: str, now: str) -> list[tuple[str, str]]:
    """Steps that put the mix of two hashes in ``now``."""
    off, by = int(hashing._OFF), int(hashing._MIX)
    mixed = [("y", f"(xor(({first} + {2**64 - off}::UHUGEINT) & {_ALL}, {now}) * {by}::UHUGEINT) & {_ALL}"), ("y", "xor(y, y >> 47)")]
    return mixed + [("y", f"(xor({now}, y) * {by}::UHUGEINT) & {_ALL}"), ("y", "xor(y, y >> 47)"), (now, f"(y * {by}::UHUGEINT) & {_ALL}")]


_WANG = [
    ("h", f"({_ALL} - h + h * {1 << 21}::UHUGEINT) & {_ALL}"), ("h", "xor(h, h >> 24)"), ("h", f"(h * {1 + 8 + 256}::UHUGEINT) & {_ALL}"), ("h", "xor(h, h >> 14)"),
    ("h", f"(h * {1 + 4 + 16}::UHUGEINT) & {_ALL}"), ("h", "xor(h, h >> 28)"), ("h", f"(h * {1 + (1 << 31)}::UHUGEINT) & {_ALL}"), ("z", "h"),
]
_BUCKETS = 3_125_000
_WAYS = [step for i in range(hashing.BUCKET_WAYS) for step in [*_mix_sql("h", "z"), (f"bucket_{i}", f"(z % {_BUCKETS})::BIGINT")]]
_KMER_VALUE = "list_sum(list_transform(range(1, 26), lambda i: (instr('ACGT', kmer[i]) - 1)::HUGEINT * (4::HUGEINT ** (25 - i))::HUGEINT))::UHUGEINT"


@query(f"""WITH {_counts(25, "benchmark", "item_id")},
q AS (SELECT kmer, {_KMER_VALUE} AS h, 0::UHUGEINT AS y, 0::UHUGEINT AS z, {", ".join(f"0::BIGINT AS bucket_{i}" for i in range(hashing.BUCKET_WAYS))} FROM c)
SELECT kmer, (CASE WHEN h >= {2**63}::UHUGEINT THEN h::HUGEINT - {2**64}::HUGEINT ELSE h::HUGEINT END)::BIGINT AS hash, (h & {hashing.FINGERPRINT_MASK}::UHUGEINT)::BIGINT AS fingerprint,
{", ".join(f"bucket_{i}" for i in range(hashing.BUCKET_WAYS))} FROM {_after("q", *_WANG, *_WAYS)}""")
def kmer_hashes(spark, sf_dir):
    packed = kmers.count_canonical(benchmark(spark, sf_dir, encode=False), 25).select("kmer", nt.pack(F.col("kmer"), 25).alias("packed"))
    hashed = packed.withColumn("hash", hashing.kmer_hash(F.col("packed")))
    placed = hashed.withColumn("buckets", hashing.buckets(F.col("hash"), _BUCKETS))
    return placed.select("kmer", "hash", hashing.fingerprint(F.col("hash")).alias("fingerprint"), *[F.col("buckets")[i].alias(f"bucket_{i}") for i in range(hashing.BUCKET_WAYS)])


_ONES = f"{2**64 - 1}::UBIGINT"
_LOW = f"{2**32 - 1}::UBIGINT"
_TEXT_BYTES = "list_transform(range(length(hex) // 2), lambda i: ('0x' || substring(hex, 2 * i + 1, 2))::UBIGINT)"
_SEQ_BYTES = "list_transform(range(length(code) // 4), lambda i: (code[4 * i + 1]::UBIGINT + 4 * code[4 * i + 2]::UBIGINT + 16 * code[4 * i + 3]::UBIGINT + 64 * code[4 * i + 4]::UBIGINT)::UBIGINT)"


def _crc_sql(data: str) -> str:
    done = f"xor(list_reduce({data}, lambda c, b: xor(crc[(1 + (xor(c, b) & 255::UBIGINT))::BIGINT], c >> 8), {_ONES}), {_ONES})::HUGEINT"
    return f"(CASE WHEN {done} >= {2**63} THEN {done} - {2**64}::HUGEINT ELSE {done} END)::BIGINT"


def _scrambled(k: str) -> str:
    first = f"(({k}) * {0xCC9E2D51}::UBIGINT & {_LOW})"
    return f"(((({first} << 15) | ({first} >> 17)) & {_LOW}) * {0x1B873593}::UBIGINT & {_LOW})"


def _murmur_sql(data: str) -> str:
    def word(i: str) -> str:
        return " + ".join(f"coalesce({data}[(4 * {i} + {j + 1})::BIGINT], 0)::UBIGINT * {256**j}::UBIGINT" for j in range(4))

    mixed = "xor(h, k)"
    blocks = f"list_transform(range(len({data}) // 4), lambda i: {_scrambled(word('i'))}::UBIGINT)"
    h = f"list_reduce({blocks}, lambda h, k: (((({mixed} << 13) | ({mixed} >> 19)) & {_LOW}) * 5::UBIGINT + {0xE6546B64}::UBIGINT) & {_LOW}, {hashing.MURMUR_SEED}::UBIGINT)"
    h = f"xor(xor({h}, {_scrambled(word(f'(len({data}) // 4)'))}), len({data})::UBIGINT)"
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = f"list_transform([{h}], lambda g: xor(g, g >> {shift}) * {factor}::UBIGINT & {_LOW})[1]"
    return f"list_transform([{h}], lambda g: xor(g, g >> 16))[1]::BIGINT"


@query(f"""WITH r AS (SELECT list(v ORDER BY n) AS crc FROM (
  SELECT n, list_reduce(range(8)::UBIGINT[], lambda c, i: xor(c >> 1, (c & 1::UBIGINT) * {0xC96C5795D7870F42}::UBIGINT), n::UBIGINT) AS v FROM range(256) AS x(n))),
{_seqs("benchmark", "item_id")}, t AS (SELECT item_id, hex(encode(text)) AS hex FROM benchmark),
l AS (SELECT t.item_id, hex, rpad(translate(seq, 'ACGT', '0123'), ((length(seq) + 31) // 32 * 32)::INT, '0') AS code FROM t JOIN s ON s.item_id = t.item_id),
b AS (SELECT item_id, {_TEXT_BYTES} AS tb, {_SEQ_BYTES} AS sb FROM l)
SELECT item_id, {_murmur_sql("tb")} AS murmur3, {_crc_sql("tb")} AS crc64, {_crc_sql("sb")} AS seq_crc64, {_murmur_sql("sb")} AS seq_murmur3 FROM b, r""")
def text_checksums(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    seq = nt.encode(F.col("text"))
    return frame.select("item_id", hashing.murmur3(F.col("text")).alias("murmur3"), hashing.crc64(F.col("text")).alias("crc64"), hashing.sequence_crc64(seq).alias("seq_crc64"), hashing.sequence_murmur3(seq).alias("seq_murmur3"))


#: Bytes of a text that are hashed at a time.
PART = 1000


@query(f"""WITH r AS (SELECT list(v ORDER BY n) AS crc FROM (
  SELECT n, list_reduce(range(8)::UBIGINT[], lambda c, i: xor(c >> 1, (c & 1::UBIGINT) * {0xC96C5795D7870F42}::UBIGINT), n::UBIGINT) AS v FROM range(256) AS x(n))),
h AS (SELECT doc_id, hex(encode(text)) AS hex, hex(encode(concat(doc_id::VARCHAR, text))) AS joint FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, {_TEXT_BYTES} AS tb, {_TEXT_BYTES.replace("hex", "joint")} AS cb FROM h)
SELECT doc_id, {_crc_sql("tb")} AS crc64, {_crc_sql("cb")} AS chained FROM b, r""")
def checksum_parts(spark, sf_dir):
    """Checksums of documents hashed in parts, and of each one's number with the text after it, from the two's own."""
    found = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").filter("text IS NOT NULL")
    number = F.col("doc_id").cast("string")
    parts = hashing.in_parts(found.withColumn("bytes", F.octet_length("text")), "text", PART)
    summed = hashing.crc64_of_parts(parts, "doc_id", "bytes")
    return summed.select("doc_id", "crc64", hashing.crc64_chained(hashing.crc64(number), F.col("crc64"), F.col("bytes")).alias("chained"))


# ---- as data arrive

#: Batches that a table is dealt into, to arrive one after the other.
ARRIVALS = 4


@query(f"""WITH {_seqs()}, w AS (SELECT doc_id % {ARRIVALS} AS batch, unnest(list_transform(range(1, length(seq) - 9), lambda i: substring(seq, i, 11))) AS z FROM s),
f AS (SELECT least(z, {_rc("z")}) AS kmer, min(batch) AS batch FROM w GROUP BY 1)
SELECT kmer, row_number() OVER (ORDER BY batch, kmer) AS id FROM f""")
def kmer_ids_growing(spark, sf_dir):
    """Ids of the canonical k-mers of all documents, which come in batches; a k-mer keeps the id of its first batch."""
    grown = ids.GrowingIds(spark, _scratch(spark, "ids"), "kmer")
    found = documents(spark, sf_dir, encode=False)
    for batch in range(ARRIVALS):
        grown.update(kmers.count_canonical(found.filter(F.pmod("doc_id", F.lit(ARRIVALS)) == batch), 11), batch)
    return grown.ids().select("kmer", "id")


@query(f"""WITH RECURSIVE {_DOC_GRAPH}, g AS (SELECT u AS a, v AS b FROM e UNION SELECT v, u FROM e){_LEAST}
SELECT vertex AS kmer, least_vertex AS component FROM t""")
def components_growing(spark, sf_dir):
    """The component of each node of the documents' graph, whose edges come as a stream of files."""
    path = _scratch(spark, "edges")
    _packed_edges(spark, sf_dir).repartition(ARRIVALS).write.parquet(path)
    grown = GrowingComponents(spark, _scratch(spark, "components"))
    stream = spark.readStream.schema("u bigint, v bigint").option("maxFilesPerTrigger", 1).parquet(path)
    taken = stream.writeStream.option("checkpointLocation", _scratch(spark, "stream")).trigger(availableNow=True)
    taken.foreachBatch(lambda frame, batch: grown.update(frame, batch, "u", "v")).start().awaitTermination()
    return grown.components().select(nt.unpack(F.col("vertex"), K).alias("kmer"), nt.unpack(F.col("component"), K).alias("component"))


# ---- files


def _scratch(spark, name: str) -> str:
    import uuid

    return f"{shared_folder(spark)}/files/{name}-{uuid.uuid4().hex}"


@query(f"WITH {_seqs()} SELECT doc_id::VARCHAR AS id1, seq, '' AS id2, '' AS qual FROM s")
def fasta_round_trip(spark, sf_dir):
    path = _scratch(spark, "fasta")
    reads.write_fasta(documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id1"), "seq"), path)
    return reads.read_fasta(spark, path)


@query(f"WITH {_seqs()} SELECT doc_id::VARCHAR AS id1, seq, 'x' AS id2, repeat('I', length(seq)) AS qual FROM s")
def fastq_round_trip(spark, sf_dir):
    path = _scratch(spark, "fastq")
    found = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id1"), "seq", F.lit("x").alias("id2"), F.expr("repeat('I', length(seq))").alias("qual"))
    reads.write_fastq(found, path)
    return reads.read_fastq(spark, path)


@query(f"WITH {_edges(K)} SELECT \"row\", col, val FROM x")
def matrix_market_round_trip(spark, sf_dir):
    found = assemble(documents(spark, sf_dir, encode=False), K)
    path = _scratch(spark, "mm")
    matrices.write_matrix(found.matrix, found.size(), path)
    return matrices.read_matrix_market(spark, path)[0]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The adjacency matrix of the documents' graph."""
    return graph_matrix(spark, sf_dir)
