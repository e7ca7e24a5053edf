"""Command line: reads to a matrix, and statistics of a matrix."""

from __future__ import annotations

import argparse
import sys
import uuid

from pyspark.sql import functions as F

from strandlake import __version__
from strandlake.operators import curve, graph
from strandlake.operators.components import shared_folder
from strandlake.plans.assembly import assemble
from strandlake.session import session
from strandlake.sources import matrices, reads
from strandlake.sources.files import spooled


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandlake", description="Overlap graphs of k-mers on Spark.")
    top.add_argument("-V", "--version", action="version", version=__version__)
    sub = top.add_subparsers(dest="command", required=True)
    a = sub.add_parser("assemble", help="reads to a sparse adjacency matrix")
    kind = a.add_mutually_exclusive_group()
    kind.add_argument("--fasta", dest="fmt", action="store_const", const="fasta", help="input is FASTA (default: by extension)")
    kind.add_argument("--fastq", dest="fmt", action="store_const", const="fastq", help="input is FASTQ")
    out = a.add_mutually_exclusive_group()
    out.add_argument("--mm", dest="out_fmt", action="store_const", const="mm", default="mm", help="Matrix Market (default)")
    out.add_argument("--hb", dest="out_fmt", action="store_const", const="hb", help="Harwell-Boeing")
    a.add_argument("-k", type=int, default=25, help="bases in a k-mer (default: 25)")
    a.add_argument("-n", type=int, default=None, help="most frequent k-mers from which components are kept (default: all components)")
    a.add_argument("-t", "--threads", type=int, default=None, help="local threads, where no cluster is set")
    a.add_argument("--saturate", type=int, default=None, help="highest count")
    a.add_argument("--compat", action="store_true", help="lose each file's last record as older tools do")
    a.add_argument("-v", "--verbose", action="store_true")
    a.add_argument("out")
    a.add_argument("files", nargs="*", help="without any, standard input is read; name its format with --fasta or --fastq")
    c = sub.add_parser("components", help="sizes of a matrix's components")
    c.add_argument("file")
    e = sub.add_parser("curve", help="components left as the heaviest edges go")
    e.add_argument("-s", "--step", type=int, default=1)
    e.add_argument("file")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = session(**({"spark.master": f"local[{args.threads}]"} if getattr(args, "threads", None) else {}))
    if args.command == "assemble":
        files = args.files or [spooled(spark, sys.stdin.buffer, f"{shared_folder(spark)}/files/stdin-{uuid.uuid4().hex}")]
        found = assemble(reads.encoded(reads.read(spark, files, args.fmt, args.compat)), args.k, saturate=args.saturate, seeds=args.n)
        matrices.write_matrix(found.matrix, found.size(), args.out, args.out_fmt)
        if args.verbose:
            print(f"{found.size()} nodes, {found.edges.count()} edges", file=sys.stderr)
        return 0
    cells, n, _ = matrices.read_matrix_market(spark, args.file)
    ends = cells.select(F.col("row").alias("u"), F.col("col").alias("v"), F.col("val").alias("w"))
    if args.command == "components":
        loops = spark.range(1, n + 1).select(F.col("id").alias("u"), F.col("id").alias("v"), F.lit(0).cast("bigint").alias("w"))
        for row in graph.component_sizes(ends.unionAll(loops)).orderBy("component").toLocalIterator():
            print(f"{row['component']}\t{row['size']}")
    else:
        for row in curve.expansion_curve(ends, args.step, n).orderBy("pos").toLocalIterator():
            print(row["components"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
