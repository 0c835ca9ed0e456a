"""The mirror as a stream: apply a batch of changes whole, then move on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.feed import check_pages
from tidemark.operators.mirror import apply_changes
from tidemark.sources.tables import snapshot_pages
from tidemark.streaming import versions

KEYS = ["id"]


def rebuild_mirror(
    responses: DataFrame, items_of: Callable[[DataFrame], DataFrame], path: str, *, buckets: int = versions.BUCKETS
) -> str:
    """Replace the complete set once, from the ``SNAPSHOT_PAGE`` responses of one snapshot.

    Page list (see ``check_pages``) and rows (``items_of(responses)``, with an ``id``) come from the same
    documents. An incomplete page set is refused and leaves the mirror as it was. Streams that follow
    start a new change cursor, which belongs to the new generation. Take many more ``buckets`` than a batch
    has changes, and a batch rewrites a small part of the mirror; take few, and its files stay large.
    """
    spark = responses.sparkSession
    pages = snapshot_pages(responses)
    if pages.isEmpty() or not check_pages(pages).filter("NOT complete").isEmpty():
        raise ValueError("the snapshot is incomplete; the mirror is unchanged")
    current = versions.latest(spark, path)
    version = versions.name(1 + (versions.generation_of(current) if current else 0))
    versions.write(items_of(responses), path, version, KEYS, buckets)
    return version


def mirror_stream(changes: DataFrame, path: str) -> StreamingQuery:
    """Apply the backlog of a change stream to the mirror in ``path`` and stop.

    A batch rewrites the buckets its ids fall into and no others. The stream's checkpoint is the cursor. It
    lies with the mirror, one per generation, and moves only after the batch's version is complete; a batch
    repeated after a crash starts from the version before it.
    """
    spark: SparkSession = changes.sparkSession
    base = versions.latest(spark, path)
    if base is None:
        raise FileNotFoundError(f"no mirror in {path}; rebuild it from a snapshot first")
    generation = versions.generation_of(base)

    def apply(batch: DataFrame, batch_id: int) -> None:
        version = versions.name(generation, batch_id)
        versions.update(path, version, batch, KEYS, lambda rows: apply_changes(rows, batch))

    return (
        changes.writeStream.foreachBatch(apply)
        .option("checkpointLocation", f"{path}/cursor/{generation:08d}")
        .trigger(availableNow=True)
        .start()
    )
