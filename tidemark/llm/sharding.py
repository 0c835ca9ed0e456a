"""Sharding by a k-d tree over document metadata, balanced by bytes (law ``bytes``).

A node is cut at the weighted median of its widest dimension (length, language, source or id), weights
being bytes, until every leaf is a shard of the target size. Medians come from distributed histograms that
are refined around the wanted weight; the driver sees at most one row per node and histogram bin.

Equal texts count as one point and stay in one shard as long as together they weigh no more than
``SHARE`` of a shard or the largest document; heavier groups are dealt out document by document, so that
a group with a third of all bytes cannot unbalance the shards.

Defined results: a null text has size 16; null metadata is the lowest coordinate; equal rows are separate
documents. With fewer documents than shards some shards stay empty; an empty table gives an empty result.
Missing metadata columns are skipped, extra columns not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.skew import even_join
from tidemark.llm.numbering import numbered
from tidemark.session import written

OVERHEAD, SHARE, EXACT = 16, 1 / 50, 1 / 500
BINS = 2048
_VALUE_BITS, _TIE_BITS = 23, 39


@dataclass
class Node:
    """Shards ``first`` to ``first + shards - 1``; once cut, rows up to ``cut`` of ``dimension`` go left."""

    first: int
    shards: int
    dimension: str = ""
    cut: int = 0
    left: Node | None = None
    right: Node | None = None

    def leaves(self) -> list[Node]:
        return [self] if self.left is None else [*self.left.leaves(), *self.right.leaves()]

    def place(self) -> Column:
        """The first shard of the leaf a row belongs to."""
        if self.left is None:
            return F.lit(self.first)
        return F.when(F.col(self.dimension) <= F.lit(self.cut), self.left.place()).otherwise(self.right.place())


def _points(docs: DataFrame, shards: int) -> tuple[DataFrame, list[str], float]:
    """Rows with one sortable key per dimension, stored, since every level of the tree reads them."""
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    extra = [c for c in ("n_chars", "lang", "source") if c in docs.columns]
    facts = written(
        docs.select(
            "doc_id", *extra, F.octet_length(body).cast("long").alias("bytes"),
            F.crc32(body).alias("text_crc32"), F.xxhash64(body).alias("text_hash"),
        ).withColumn("size", F.col("bytes") + OVERHEAD),
        "shard-facts",
    )
    bounds = facts.agg(
        F.sum("size").alias("total"), F.max("size").alias("largest"),
        *[f(c).alias(f"{n}_{c}") for c in ("doc_id", "bytes") for n, f in (("min", F.min), ("max", F.max))],
    ).first()
    total = bounds["total"] or 0
    target = total / shards
    heaviest = max(target * SHARE, bounds["largest"] or 0)
    same = ["text_hash", "text_crc32", "bytes"]
    lead = ["doc_id", *extra]
    groups = facts.groupBy(*same).agg(
        F.sum("size").alias("weight"), F.min(F.struct(*[F.col(c) for c in lead])).alias("lead")
    )
    rows = even_join(facts, groups, same, "left").withColumn("whole", F.col("weight") <= heaviest)
    own = lambda c: F.when(F.col("whole"), F.col(f"lead.{c}")).otherwise(F.col(c))

    top, low_bits = (1 << _VALUE_BITS) - 1, (1 << _TIE_BITS) - 1
    tie = F.when(F.col("whole"), F.xxhash64("text_hash")).otherwise(F.xxhash64("text_hash", "doc_id"))
    tie = tie.bitwiseAND(F.lit(low_bits))

    def number(value: Column, least: int | None, most: int | None) -> Column:
        span = max(1, (most or 0) - (least or 0))
        share = (value - F.lit(least or 0)).cast("double") / F.lit(float(span))
        return F.coalesce(F.floor(share * top), F.lit(0)).cast("long")

    def category(name: str) -> Column:
        return F.coalesce(F.pmod(F.xxhash64(own(name)), F.lit(top)), F.lit(0)).cast("long")

    values = {
        "by_length": number(F.col("bytes"), bounds["min_bytes"], bounds["max_bytes"]),
        "by_id": number(own("doc_id"), bounds["min_doc_id"], bounds["max_doc_id"]),
    } | {f"by_{c}": category(c) for c in extra if c != "n_chars"}
    keys = [F.shiftleft(v, _TIE_BITS).bitwiseOR(tie).alias(n) for n, v in values.items()]
    return written(rows.select("doc_id", "size", "text_crc32", *keys), "shard-points"), list(values), target


def build_tree(points: DataFrame, dimensions: list[str], shards: int, target: float) -> Node:
    root = Node(0, shards)
    while open_nodes := [n for n in root.leaves() if n.shards > 1]:
        placed = points.withColumn("node", root.place()).filter(F.col("node").isin([n.first for n in open_nodes]))
        spread = placed.groupBy("node").agg(
            F.sum("size").alias("weight"),
            *[F.struct(F.min(d).alias("low"), F.max(d).alias("high")).alias(d) for d in dimensions],
        )
        facts = {r["node"]: r for r in spread.collect()}
        searches = {}
        for node in open_nodes:
            own, half = facts.get(node.first), node.shards // 2
            if own is None:  # no rows: any cut will do
                node.dimension, node.cut = dimensions[0], 0
            else:
                node.dimension = max(dimensions, key=lambda d: (own[d]["high"] >> _TIE_BITS) - (own[d]["low"] >> _TIE_BITS))
                low, high = own[node.dimension]["low"], own[node.dimension]["high"]
                searches[node.first] = (node.dimension, low, high, 0, own["weight"] * half / node.shards)
        cuts = _medians(placed, searches, target * EXACT)
        for node in open_nodes:
            node.cut = cuts.get(node.first, node.cut)
            half = node.shards // 2
            node.left, node.right = Node(node.first, half), Node(node.first + half, node.shards - half)
    return root


def _medians(placed: DataFrame, searches: dict[int, tuple], exact: float) -> dict[int, int]:
    """For each node the key up to which its rows weigh nearest to the wanted weight.

    A search is ``(dimension, low, high, weight below low, wanted weight)``. Each round splits all open
    intervals into ``BINS`` and goes on in the bin that holds the wanted weight.
    """
    found: dict[int, int] = {}
    while searches:
        key, low, step = (F.lit(None).cast("long") for _ in range(3))
        steps = {}
        for node, (dimension, start, high, _, _) in searches.items():
            steps[node] = max(1, -(-(high - start + 1) // BINS))
            inside = (F.col("node") == node) & F.col(dimension).between(start, high)
            key = F.when(inside, F.col(dimension)).otherwise(key)
            low = F.when(F.col("node") == node, F.lit(start)).otherwise(low)
            step = F.when(F.col("node") == node, F.lit(steps[node])).otherwise(step)
        bins = (
            placed.select("node", "size", key.alias("key"), low.alias("low"), step.alias("step"))
            .filter(F.col("key").isNotNull())
            .groupBy("node", F.expr("(key - low) div step").alias("bin"))
            .agg(F.sum("size").alias("weight"), F.min("key").alias("least"), F.max("key").alias("most"))
        )
        weights: dict[int, list[tuple[int, int, int]]] = {}
        for r in bins.collect():
            weights.setdefault(r["node"], []).append((r["least"], r["most"], r["weight"]))
        following = {}
        for node, (dimension, _, _, below, wanted) in searches.items():
            for least, most, weight in sorted(weights[node]):
                if below + weight >= wanted:
                    break
                below += weight
            if least == most or weight <= exact:
                found[node] = most if below + weight - wanted <= wanted - below else least - 1
            else:
                following[node] = (dimension, least, most, below, wanted)
        searches = following
    return found


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``: shards of nearly equal bytes, slots gapless from 0."""
    points, dimensions, target = _points(docs, shards)
    tree = build_tree(points, dimensions, shards, target)
    placed = points.select("doc_id", "size", "text_crc32", tree.place().cast("int").alias("shard"))
    return numbered(placed, ["shard"], ["doc_id", "text_crc32", "size"], "slot")
