"""The command line: python -m loam.cli COMMAND."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import analytics, crawl, vector
from .operators import index as ix
from .operators.pagerank import pagerank
from .service import Service
from .sources import embedders, jsonl, lists, tables, vectorfile
from .sources.files import open_path
from .streaming import incremental
from .streaming.crawler import Crawl


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loam")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, help: str, *options: tuple) -> None:
        c = sub.add_parser(name, help=help)
        for *flags, more in options:
            c.add_argument(*flags, **more)

    root = ("--root", {"default": "crawl", "help": "folder of the crawl's tables"})
    at = ("--index", {"default": "index", "help": "folder of the index"})
    command("crawl", "fetch pages from seeds", root, ("--seeds", {"required": True}), ("--max-pages", {"type": int, "default": 100_000}), ("--batch", {"type": int, "default": 100}), ("--agent", {"default": "loam"}))
    command("parse", "stored pages to JSON lines", root, ("--output", {"default": "pages.jsonl"}), ("--limit", {"type": int}))
    command("rank", "PageRank of the stored links", root, ("--output", {"default": "ranks"}))
    command("index", "JSON lines to an index", at, ("--input", {"default": "pages.jsonl"}), ("--ranks", {}), ("--limit", {"type": int}), ("--shards", {"type": int}), ("--stem", {"action": "store_true"}))
    command("update", "take in the new lines of a file", at, ("--input", {"default": "pages.jsonl"}), ("--state", {"default": "state.json"}), ("--limit", {"type": int}))
    command("embed", "JSON lines to a vector file", ("--input", {"default": "pages.jsonl"}), ("--output", {"default": "vectors"}), ("--limit", {"type": int}), ("--quantize", {"action": "store_true"}), ("--dimension", {"type": int, "default": embedders.DIMENSION}), ("--summary", {}))
    searching = (at, ("--vectors", {}), ("--mode", {"choices": ("fulltext", "vector", "hybrid"), "default": "fulltext"}), ("--log", {}), ("--cache", {"type": int, "default": 0}))
    command("search", "one query, or a prompt", *searching, ("-n", "--results", {"type": int, "default": 10}), ("--domain", {}), ("--after", {"type": int}), ("--before", {"type": int}), ("--expand", {"action": "store_true"}), ("--suggest", {"action": "store_true"}), ("query", {"nargs": "?"}))
    command("serve", "HTTP", *searching, ("--host", {"default": "127.0.0.1"}), ("--port", {"type": int, "default": 3000}))
    command("stats", "reports over crawl and query log", root, ("--log", {}))
    return p


def session() -> SparkSession:
    return SparkSession.builder.appName("loam").config("spark.sql.adaptive.enabled", "true").getOrCreate()


def numbered_pages(spark: SparkSession, path: str, limit: int | None) -> DataFrame:
    """Pages of a JSON-lines file or folder, numbered in order of file and line."""
    pages = jsonl.read(spark, path).select("*", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row")).alias("seq"))
    pages = pages.orderBy("seq").limit(limit) if limit is not None else pages
    return ix.numbered(pages, "seq", name="doc_id").drop("seq")


def service_of(spark: SparkSession, a: argparse.Namespace) -> Service:
    return Service.load(spark, a.index, vectorfile.read(spark, a.vectors) if a.vectors else None, log=a.log, cache_size=a.cache)


def shown(rows: list[dict]) -> Iterable[str]:
    for i, r in enumerate(rows, 1):
        yield f"{i}. [{r['score']:.3f}] {r['title']}"
        yield f"   {r['url']}"
        if r["snippet"]:
            yield f"   {r['snippet']}"
    yield f"{len(rows)} results"


def ask(service: Service, a: argparse.Namespace, query: str) -> Iterable[str]:
    if a.suggest:
        return [f"{s['term']} ({s['frequency']})" for s in service.suggest(query)]
    return shown(service.search(query, a.mode, a.results, a.domain, a.after, a.before, a.expand))


def repl(service: Service, a: argparse.Namespace, lines: Iterable[str], write) -> None:
    """Answer each line; blank ones are passed over, exit or quit ends."""
    for line in lines:
        query = line.strip()
        if query.lower() in ("exit", "quit"):
            return
        if query:
            write("\n".join(ask(service, a, query)) + "\n")


def table_text(rows: DataFrame) -> str:
    """A few rows as a table; values beyond 22 characters are cut to 19 and three dots."""
    short = lambda x: x[:19] + "..." if len(x) > 22 else x
    cells = [rows.columns] + [[short(str(v)) for v in r] for r in rows.collect()]
    width = [max(len(c[i]) for c in cells) for i in range(len(rows.columns))]
    return "\n".join(" | ".join(v.ljust(w) for v, w in zip(c, width)).rstrip() for c in cells)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, write=sys.stdout.write, lines: Iterable[str] | None = None) -> int:
    a = arguments().parse_args(argv)
    spark = spark or session()
    if a.command == "crawl":
        c = Crawl(spark, a.root, agent=a.agent)
        c.seed(lists.read_seeds(spark, a.seeds))
        try:
            c.run(a.max_pages, a.batch)
        except KeyboardInterrupt:
            c.stop()
        write(f"{c.progress.success} pages, {c.progress.errors} errors, {c.progress.rate():.1f} pages a second\n")
    elif a.command == "parse":
        pages = Crawl(spark, a.root).table("pages").select(F.col("id").alias("page_id"), "url", F.col("html_content").alias("html"))
        jsonl.write(crawl.parse_pages(pages, limit=a.limit), a.output)
    elif a.command == "rank":
        tables.save_ranks(pagerank(Crawl(spark, a.root).table("links")), a.output)
    elif a.command == "index":
        built = ix.build(numbered_pages(spark, a.input, a.limit), spark.read.parquet(a.ranks) if a.ranks else None, a.stem)
        if a.shards:
            ix.save_shards(built, a.index, a.shards)
        else:
            built.save_version(a.index)
        write(table_text(built.stats()) + "\n")
    elif a.command == "update":
        write(f"{incremental.run(spark, a.input, a.index, a.state, a.limit)}\n")
    elif a.command == "embed":
        pages = numbered_pages(spark, a.input, a.limit).select("doc_id", T.embedding_text(F.col("title"), F.col("content")).alias("text"))
        vectors = embedders.embed(pages, embedders.HashingEmbedder(a.dimension))
        n = vectorfile.write(vectors, a.output, a.quantize)
        if a.summary:
            from .functions.vectors import hyperplanes

            tables.save_json(vector.summary(vector.signed(vectorfile.read(spark, a.output, a.quantize), hyperplanes(a.dimension)), a.dimension), a.summary)
        write(f"{n} vectors\n")
    elif a.command == "search":
        service = service_of(spark, a)
        if a.query is not None:
            write("\n".join(ask(service, a, a.query)) + "\n")
        else:
            repl(service, a, lines if lines is not None else sys.stdin, write)
    elif a.command == "serve":
        from .server import serve

        serve(service_of(spark, a), a.host, a.port, a.mode).serve_forever()
    elif a.command == "stats":
        c = Crawl(spark, a.root)
        write(table_text(crawl.domain_stats(c.table("crawl_state").select("domain", "error_count", F.col("rate_limit_delay").alias("delay")), c.table("pages"), 10)) + "\n")
        if a.log and open_path(a.log):
            write(table_text(analytics.top_queries(tables.read_log(spark, a.log), 10)) + "\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
