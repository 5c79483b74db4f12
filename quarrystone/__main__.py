"""Command line: list queries, run one, ask in SQL, count or clear tables, export a graph, write a script of corrections or JSON files, extract PDF texts."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarrystone.plans import registry
from quarrystone.plans.ask import COMMON, ask, search
from quarrystone.plans.exports import export
from quarrystone.sources import graph_files, pdf, store
from quarrystone.sources.reports import write_correction_script


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="quarrystone")
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    run = sub.add_parser("run")
    run.add_argument("query")
    run.add_argument("tables")
    run.add_argument("out")
    run.add_argument("--format", default="parquet", choices=["parquet", "json", "csv"])
    asked = sub.add_parser("ask")
    asked.add_argument("tables")
    asked.add_argument("question", help="SQL, or one of: " + ", ".join(COMMON))
    asked.add_argument("--param", action="append", default=[], metavar="NAME=VALUE")
    asked.add_argument("--rows", type=int, default=100)
    sought = sub.add_parser("search")
    sought.add_argument("tables")
    sought.add_argument("words")
    sought.add_argument("--rows", type=int, default=10)
    sub.add_parser("counts").add_argument("folder")
    drop = sub.add_parser("drop")
    drop.add_argument("folder")
    drop.add_argument("names", nargs="+")
    drop.add_argument("--confirm", action="store_true", help="without it, only says what would go")
    graph = sub.add_parser("graph")
    graph.add_argument("tables")
    graph.add_argument("out")
    graph.add_argument("--format", default="graphml", choices=["graphml", "gexf", "edges"])
    script = sub.add_parser("corrections")
    script.add_argument("tables")
    script.add_argument("out", help="the script to write")
    files = sub.add_parser("export")
    files.add_argument("tables")
    files.add_argument("out", help="the folder of JSON files and their manifest")
    texts = sub.add_parser("pdf")
    texts.add_argument("folder")
    texts.add_argument("out")
    texts.add_argument("--force", action="store_true")
    texts.add_argument("--dry-run", action="store_true")
    args = top.parse_args(argv)
    if args.command == "list":
        print("\n".join(sorted(registry.queries())))
        return
    spark = SparkSession.builder.appName("quarrystone").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "run":
        registry.queries()[args.query](spark, args.tables).write.mode("overwrite").format(args.format).save(args.out)
    elif args.command == "ask":
        ask(spark, args.tables, args.question, **dict(p.split("=", 1) for p in args.param)).show(args.rows, truncate=False)
    elif args.command == "search":
        search(spark, args.tables, args.words, args.rows).show(args.rows, truncate=False)
    elif args.command == "counts":
        store.counts(spark, args.folder).show(1000, truncate=False)
    elif args.command == "drop":
        print(store.drop(spark, args.folder, args.names, dry_run=not args.confirm))
    elif args.command == "corrections":
        print(write_correction_script(registry.queries()["s14_autocorrect_map"](spark, args.tables), args.out))
    elif args.command == "export":
        export(spark, args.tables, args.out).groupBy("kind").agg(F.count(F.lit(1)).alias("files"), F.sum("n_rows").alias("n_rows"), F.sum("bytes").alias("bytes")).orderBy("kind").show(1000, truncate=False)
    elif args.command == "pdf":
        pdf.extract_texts(spark, args.folder, args.out, args.force, args.dry_run).select("path", "pages").show(1000, truncate=False)
    else:
        edges, nodes = registry.network(spark, args.tables)
        if args.format == "edges":
            graph_files.write_edge_list(edges, args.out)
        else:
            {"graphml": graph_files.write_graphml, "gexf": graph_files.write_gexf}[args.format](nodes, edges, args.out)


if __name__ == "__main__":
    main()
