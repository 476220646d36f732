"""Taking new pages into a stored index: a file's tail by batches, or a folder as a stream."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import Index, current_version, upsert
from ..sources import files, jsonl, tables


@dataclass
class Summary:
    processed_lines: int = 0
    new_documents: int = 0
    updated_documents: int = 0
    unchanged_documents: int = 0
    final_offset: int = 0
    total_documents: int = 0


def run(spark: SparkSession, source: str, index_root: str, state_path: str, limit: int | None = None, now: Column | None = None) -> Summary:
    """Take in the lines that a file has beyond the stored offset, and store index, then state.

    A file that has shrunk is read anew into a new index; another file than last time is read from its start into the old one. ``limit``:
    at most so many pages, the first ones; the offset then stops behind the last of them. The index is written before the state: a run
    that is lost between the two takes in the same lines again, which are unchanged then. Where nothing changed, no version is written.
    """
    state = tables.load_state(state_path, source)
    end = files.size(source)
    index = None
    if state.byte_offset > end:
        state.byte_offset = state.processed_lines = 0
    else:
        index = Index.load_current(spark, index_root)
    stored, index = index is not None, index or Index.empty(spark)
    pages = jsonl.tail(spark, source, state.byte_offset)
    if limit is not None:
        pages = pages.orderBy("seq").limit(limit)
        stop = pages.agg(F.max("next"), F.count("*")).first()
        # with fewer pages than the limit all is read, blank lines at the end too
        end = end if stop[1] < limit else stop[0] if stop[0] is not None else state.byte_offset
    merged, tally = upsert(index, pages.drop("next"), now=now)
    got = tally.first()
    if got.new or got.updated or not stored:
        index = Index.load(spark, f"{index_root}/v{merged.save_version(index_root)}")
    state.byte_offset = end
    state.processed_lines += got.processed
    state.total_updates += got.updated
    tables.save_state(state, state_path)
    return Summary(got.processed, got.new, got.updated, got.unchanged, end, index.totals()[0])


def stream(spark: SparkSession, folder: str, index_root: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Take in a folder of JSON-line files as they come; files are in order of their times, then names.

    A batch becomes the index version of its number. A batch that runs again after a failure finds whether its
    version is current, so each is taken in once. Default trigger: all that is there, then stop.
    """
    # a folder of index versions serves one stream: versions are batch numbers
    arrived = spark.readStream.schema(jsonl.PAGE).option("mode", "FAILFAST").json(folder).withColumn("seq", F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start"))

    def take(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        done = current_version(index_root)
        if done is not None and done >= number + 1:
            return
        index = Index.load_current(session, index_root) or Index.empty(session)
        placed = batch.withColumn("seq", F.struct("seq", F.monotonically_increasing_id().alias("row")))
        upsert(index, placed)[0].save_version(index_root, number + 1)

    return arrived.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
