"""Named queries that go through files, streams and services: each writes to a folder that executors share, reads back, and answers from that."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import analytics, vector
from ..operators import index as ix
from ..operators import search as se
from ..operators.common import shared_folder
from ..sources import embedders, files, jsonl, lists, tables, vectorfile
from ..streaming import incremental, rates, suggestions
from ..streaming.crawler import Crawl, Progress

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def room(spark: SparkSession) -> str:
    return f"{shared_folder(spark).removeprefix('file://')}/loam-{uuid.uuid4().hex}"


def parsed(spark: SparkSession, d: str) -> DataFrame:
    """The documents as parsed pages."""
    from .catalogue import pages_of, read

    p = pages_of(read(spark, d, "documents"))
    none = F.array().cast("array<string>")
    return p.select("url", "title", F.lit("").alias("meta_description"), "content", F.octet_length("content").cast("long").alias("content_length"), "headings", none.alias("links"), F.col("word_count").cast("long").alias("word_count"), "doc_id")


def in_one_file(rows: DataFrame, parts: str, path: str) -> str:
    """The documents as one file of JSON lines by doc_id: ranges are sorted and written each by a task, and joined in their order."""
    jsonl.write(rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id"), parts)
    files.write_joined(path, [f for f, _ in files.listed(parts)])
    return path


URL = "'https://' || source || '.example.com/' || lang || '/' || doc_id"


@query(f"SELECT {URL} AS url, split_part(text, chr(10), 1) AS title, sha256(text) AS content, strlen(text)::BIGINT AS content_length FROM documents")
def jsonl_roundtrip(spark, d):
    path = room(spark)
    jsonl.write(parsed(spark, d), path)
    return jsonl.read(spark, path).select("url", "title", F.sha2("content", 256).alias("content"), "content_length")


@query(f"SELECT row_number() OVER (ORDER BY doc_id) - 1 AS n, {URL} AS url FROM documents")
def jsonl_tail(spark, d):
    """One file, taken in from its start and from the offset at which a first part ended."""
    root = room(spark)
    file = in_one_file(parsed(spark, d), f"{root}/parts", f"{root}/pages.jsonl")
    first = jsonl.tail(spark, file).orderBy("seq").limit(10)
    stop = first.agg(F.max("next")).first()[0]
    both = first.unionByName(jsonl.tail(spark, file, stop)).select("seq", "url")
    return ix.numbered(both, "seq", name="n").select("n", "url")


@query("SELECT vec_id AS doc_id, round(list_sum(embedding::DOUBLE[]), 6) AS total, len(embedding) AS dimension FROM embeddings")
def vector_file_roundtrip(spark, d):
    from .catalogue import vectors_of

    path = room(spark)
    vectorfile.write(vectors_of(spark, d), path)
    back = vectorfile.read(spark, path)
    return back.select("doc_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"), F.size("embedding").alias("dimension"))


@query("SELECT vec_id AS doc_id, len(embedding) AS dimension, TRUE AS close FROM embeddings")
def vector_file_half(spark, d):
    from .catalogue import vectors_of

    path, own = room(spark), vectors_of(spark, d)
    vectorfile.write(own, path, half=True)
    back = vectorfile.read(spark, path, half=True).select("doc_id", F.col("embedding").alias("back"))
    far = F.array_max(F.zip_with("embedding", "back", lambda a, b: F.abs(a - b)))
    return own.join(back, "doc_id").select("doc_id", F.size("back").alias("dimension"), (far < 0.001).alias("close"))


@query("SELECT url FROM pages")
def seed_list(spark, d):
    from .catalogue import read

    path = room(spark)
    p = read(spark, d, "pages")
    noise = spark.createDataFrame([("# a comment",), ("",), ("   ",), ("  # another",)], "value string")
    p.select(F.concat(F.lit("  "), "url", F.lit(" ")).alias("value")).union(noise).write.text(path)
    return lists.read_seeds(spark, path)


@query("SELECT page_id, url FROM pages WHERE NOT (lower(regexp_extract(url, '://([^/?#]*)', 1)) LIKE '%.com' AND regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) LIKE '/en/%')")
def robots_sites(spark, d):
    """Sites under .com shut /en/ out; those under .org have a file that couldn't be fetched; the others have none."""
    from .catalogue import read

    p = read(spark, d, "pages")
    site = F.regexp_extract("url", r"^([A-Za-z]+://[^/?#]*)", 1)
    host = F.lower(F.regexp_extract("url", r"://([^/?#]*)", 1))
    robots = p.select(F.concat(site, F.lit("/robots.txt")).alias("robots_url"), F.when(host.endswith(".com"), "User-agent: *\nDisallow: /en/\n").alias("body")).where("body is not null or robots_url like '%.org/%'").distinct()
    return lists.allowed(p.select("page_id", "url"), robots, "loam")


@query("SELECT event_type AS mode, count(*) AS n FROM events GROUP BY 1")
def query_log_roundtrip(spark, d):
    from .catalogue import log_of

    path = room(spark)
    tables.append_log(log_of(spark, d), path)
    tables.log_query(spark, path, "Single", 3, 1.5, "extra", now=7)
    log = tables.read_log(spark, path)
    return analytics.by_mode(log.where("mode <> 'extra' or query <> 'Single' or timestamp <> 7"))


@query(f"SELECT {URL} AS url, 1.0 / (1 + doc_id % 97) / 10 AS score FROM documents")
def rank_table_roundtrip(spark, d):
    from .catalogue import some_ranks

    path = room(spark)
    tables.save_ranks(some_ranks(spark, d).limit(3), path)
    tables.save_ranks(some_ranks(spark, d), path)
    return spark.read.parquet(path)


@query()
def bucket_summary_json(spark, d):
    from .catalogue import _PLANES, vectors_of

    path = f"{room(spark)}.json"
    tables.save_json(vector.summary(vector.signed(vectors_of(spark, d), _PLANES), 64), path)
    return spark.read.option("multiLine", True).json(path).withColumn("avg_bucket_size", F.round("avg_bucket_size", 6))


@query("SELECT name, 0 AS n FROM (VALUES ('pages'), ('links'), ('crawl_queue'), ('crawl_state')) v(name)")
def crawl_tables(spark, d):
    root = room(spark)
    for _ in range(2):  # a second call leaves what is there
        tables.create_all(spark, root)
    out = None
    for name in tables.CRAWL:
        one = tables.open_table(spark, root, name).agg(F.count("*").cast("int").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.union(one)
    return out


@query()
def index_stored(spark, d):
    """The best documents of a query by an index that was written and read."""
    from .catalogue import index_of, ranked

    root = room(spark)
    index_of(spark, d).save_version(root)
    return ranked(ix.Index.load_current(spark, root), "with OR that OR ing")


@query()
def shards_stored(spark, d):
    """Sharded search over shards that were written, appended to and read."""
    from .catalogue import pages_of, read

    root = room(spark)
    docs = pages_of(read(spark, d, "documents"))
    ix.save_shards(ix.build(docs.where("doc_id % 2 = 0"), allow_duplicates=True), root, 4)
    ix.add_to_shards(spark, ix.prepare(docs.where("doc_id % 2 = 1")), root)
    index, shards = ix.load_shards(spark, root)
    return se.search(index, [(0, "with ble")], shards=shards).select("doc_id", F.round("score", 6).alias("score"), "rank")


@query()
def embed_documents(spark, d):
    from .catalogue import read

    return embedders.embed(read(spark, d, "documents").select("doc_id", "text"), embedders.HashingEmbedder(64))


@query("SELECT * FROM (VALUES (1, 10, 10, 0, 0), (2, (SELECT count(*) FROM documents) - 10, (SELECT count(*) FROM documents) - 10, 0, 0), (3, 2, 1, 1, 0), (4, 0, 0, 0, 0)) v(run, processed, new, updated, unchanged)")
def incremental_file(spark, d):
    """A file taken in by a first part, then the rest, then two lines more (one of a known url), then nothing."""
    root = room(spark)
    source = in_one_file(parsed(spark, d), f"{root}/all", f"{root}/pages.jsonl")
    go = lambda limit=None: incremental.run(spark, source, f"{root}/index", f"{root}/state.json", limit)
    runs = [go(10), go()]
    line = '{"url": "%s", "title": "t", "meta_description": "", "content": "fresh", "content_length": 5, "headings": [], "links": [], "word_count": 1}\n'
    known = parsed(spark, d).orderBy("doc_id").first().url
    files.write_joined(source, [source, (line % known + "\n" + line % "https://new.example.com/").encode()])
    runs += [go(), go()]
    return spark.createDataFrame([(i, s.processed_lines, s.new_documents, s.updated_documents, s.unchanged_documents) for i, s in enumerate(runs, 1)], "run int, processed long, new long, updated long, unchanged long")


@query(f"SELECT {URL} AS url, sha256(encode(split_part(text, chr(10), 1)) || '\\x00'::BLOB || encode(text)) AS content_hash FROM documents")
def stream_upsert(spark, d):
    """A folder of JSON lines as a stream, in two runs of one query: half of the files, then all."""
    root = room(spark)
    rows = parsed(spark, d)
    for half in (0, 1):
        jsonl.write(rows.where(F.col("doc_id") % 2 == half), f"{root}/part{half}")
        for i, (f, _) in enumerate(files.listed(f"{root}/part{half}")):
            system, where = files.open_path(f)
            system.create_dir(f"{root}/in")
            system.copy_file(where, f"{root}/in/{half}-{i}.json")
        incremental.stream(spark, f"{root}/in", f"{root}/index", f"{root}/checkpoint").awaitTermination()
    return ix.Index.load_current(spark, f"{root}/index").documents.select("url", "content_hash")


def _rates_oracle() -> str:
    from .catalogue import FOLD

    return FOLD + "SELECT domain, s.e::INT AS error_count, s.d::INT AS delay, last AS last_request_time FROM s"


def stream_rate_limits(spark, d):
    """Rate limits as keyed state over a stream of the requests, a day or more per batch; the last state of each domain."""
    from .catalogue import requests_of

    root = room(spark)
    requests = requests_of(spark, d)
    edge = requests.agg(((F.min("at") + F.max("at")) / 2).cast("long")).first()[0]
    out = None
    for i, part in enumerate((requests.where(F.col("at") < edge), requests.where(F.col("at") >= edge))):
        part.write.mode("append").parquet(f"{root}/in")
        source = spark.readStream.schema(requests.schema).parquet(f"{root}/in")

        def take(batch, _number, i=i):
            batch.withColumn("turn", F.lit(i)).write.mode("append").parquet(f"{root}/out")

        rates.rate_limits(source).writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{root}/out")
    return out.groupBy("domain").agg(F.max_by(F.struct("error_count", "delay", "last_request_time"), "turn").alias("s")).select("domain", "s.*")


def _suggest_oracle() -> str:
    from .catalogue import INDEX_SQL

    return f"WITH {INDEX_SQL} SELECT prefix, term, df AS frequency, n::INT AS n FROM (SELECT prefix, term, df, row_number() OVER (PARTITION BY prefix ORDER BY df DESC, term) AS n FROM dfs JOIN (VALUES ('th'), ('er')) v(prefix) ON starts_with(term, prefix)) WHERE n <= 10"


def stream_suggestions(spark, d):
    from .catalogue import index_of

    root = room(spark)
    spark.createDataFrame([("th",), (" er ",), ("  ",)], "prefix string").coalesce(1).write.parquet(f"{root}/in")
    suggestions.stream(spark.readStream.schema("prefix string").parquet(f"{root}/in"), index_of(spark, d).terms(), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    got = spark.read.schema("prefix string, suggestions array<struct<term:string,frequency:long>>").json(f"{root}/out")
    return got.select("prefix", F.posexplode("suggestions").alias("i", "s")).select("prefix", "s.term", "s.frequency", (F.col("i") + 1).alias("n"))


@query()
def crawl_loop(spark, d):
    """The pages table as a web: a crawl from its first urls, two batches."""
    from .catalogue import read

    p = read(spark, d, "pages")
    root = room(spark)
    some = p.orderBy("page_id").limit(12).collect()
    web = {r.u: r.html for r in p.select(U.normalize_url(F.col("url")).alias("u"), "html").where("u is not null").orderBy("page_id").limit(50).collect()}

    def get(url: str) -> tuple[int, str]:
        return (200, web[url]) if url in web else (404, "")

    c = Crawl(spark, root, get, pause=0)
    c.seed(spark.createDataFrame([(r.url,) for r in some], "url string"))
    c.run(20, 12, now=lambda: 1000)
    return c.table("pages").select("id", "url", "status_code", "crawled_at")


@query("SELECT 200 AS success, 5 AS skipped, 1 AS errors, TRUE AS due, 20.0::DOUBLE AS rate, 40.0::DOUBLE AS eta")
def crawl_progress(spark, d):
    """Counters, rate and remaining time of a crawl, from its own clock."""
    p = Progress(interval=200, started=0.0)
    p.count(success=200, skipped=5, errors=1)
    return spark.createDataFrame([(p.success, p.skipped, p.errors, p.due(), p.rate(10.0), p.eta(1000, 10.0))], "success int, skipped int, errors int, due boolean, rate double, eta double")


for _f in (stream_rate_limits, stream_suggestions):
    QUERIES[_f.__name__] = _f


def late_oracles() -> dict[str, str]:
    """Oracles that share SQL with the catalogue, which imports this module."""
    from .catalogue import ORACLES as OTHERS
    from .catalogue import bm25_sql

    return {"bucket_summary_json": OTHERS["lsh_summary"], "stream_rate_limits": _rates_oracle(), "stream_suggestions": _suggest_oracle(), "index_stored": bm25_sql(["ing"], ["with", "that"])}

