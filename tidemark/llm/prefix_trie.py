"""A z-fast trie over conversations: which prefixes of turns they share, and what sharing saves.

A conversation is a path of prefixes; a prefix is named by 128 bits that do not depend on what follows it. The
trie is compacted: its nodes are the ends of conversations and the places where they part, and each holds the
prefixes of its edge. A node lies in the hash table under its handle, the prefix whose length is the two-fattest
number of its edge (the one divisible by the largest power of two). A fat binary search probes such lengths only
and so finds the exit node of a conversation of m turns by at most ``log2(m) + 1`` equi-joins with the handles.

Conversations are inserted in batches. A batch is located, sorted by path, and every conversation compared with
its neighbour: its end, its exit and the place where it parts from the neighbour are all new nodes there are.
These, the nodes they hang on and the nodes whose edges they cut are sorted once more; what a node shares with
its neighbour is its parent. Nothing else of the trie is touched, so a batch costs what it holds.

Texts are digested first. From then on a conversation is one row with 24 bytes a turn, and so is the edge of a
node; a conversation is thus bounded by what a row may hold (some ten millions of turns).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.ordered import blocks, previous_in_order, rank_in_order
from tidemark.llm.words import WORD, partitions
from tidemark.session import written

KEY = ["len", "pa", "pb"]
PARENT = ["up", "upa", "upb"]
PREFIX = "struct<pa:bigint,pb:bigint,cw:bigint>"
NODE = (
    "len INT, pa LONG, pb LONG, up INT, upa LONG, upb LONG, fat INT, fa LONG, fb LONG, na LONG, nb LONG,"
    f" cw_up LONG, edge ARRAY<{PREFIX}>"
)
#: Turns of one slice where a conversation is put in order, and ids of one piece of a list of ids.
_SLICE = 1000
_PIECE_BITS = 12


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, role, text``: the turns of ``conversations`` in order, from 1.

    Turns stand by ``turn`` (null first), equal ones by role and text; a null role or text is empty. Rows
    without a ``conv_id`` belong to no conversation and are left out; other columns are ignored.
    """
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    ordered = rank_in_order(rows, ["conv_id"], ["turn", "role", "text"], blocks("turn", _SLICE), "pos")
    return ordered.select("conv_id", "pos", "role", "text")


def regrafted(ordered: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """Conversations that begin as the first of their family does: ``conv_id, part, pos, role, text``.

    The first h turns (h: CRC-32 of the decimal id modulo ``most``) are those of conversation
    ``conv_id - conv_id % family``, all if it has fewer, none if it is absent; then come the conversation's own
    turns after its first h. Every conversation also has a row without text in front, the root.
    """
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    rows = ordered.withColumn("h", taken)
    own = rows.filter("pos > h").select("conv_id", F.lit(2).alias("part"), "pos", "role", "text")
    convs = rows.select("conv_id", "h").distinct()
    first = ordered.filter(F.col("pos") < most).withColumnRenamed("conv_id", "__first")
    same = (F.col("conv_id") - F.col("conv_id") % family == F.col("__first")) & (F.col("pos") <= F.col("h"))
    graft = convs.join(first, same).select("conv_id", F.lit(1).alias("part"), "pos", "role", "text")
    root = convs.select("conv_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("pos"), F.lit("").alias("role"), F.lit("").alias("text"))
    return root.union(graft).union(own)


def sequences(rows: DataFrame) -> DataFrame:
    """``conv_id, len, pa, pb, path`` of ``rows(conv_id, part, pos, role, text)``: the prefixes of each conversation.

    ``path[d]`` names the first d turns (two lanes of position-keyed 64-bit hashes) and counts their words.
    """
    digests = rows.select(
        "conv_id", "part", "pos",
        F.xxhash64("role", "text").alias("a"),
        F.xxhash64(F.lit("second lane"), "text", "role").alias("b"),
        F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"),
    )
    along = W.partitionBy("conv_id").orderBy("part", "pos")
    numbered = digests.withColumn("d", F.row_number().over(along) - 1)
    turn = F.col("d") > 0
    lanes = {"pa": F.xxhash64("a", "b", "d"), "pb": F.xxhash64("b", "d", "a")}
    marked = numbered.withColumns({n: F.when(turn, h).otherwise(F.lit(0)) for n, h in lanes.items()})
    sofar = along.rowsBetween(W.unboundedPreceding, W.currentRow)
    prefixes = marked.select(
        "conv_id", "d", F.bit_xor("pa").over(sofar).alias("pa"), F.bit_xor("pb").over(sofar).alias("pb"),
        F.sum(F.when(turn, F.col("words")).otherwise(F.lit(0))).over(sofar).alias("cw"),
    )
    gathered = prefixes.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("d", "pa", "pb", "cw"))).alias("all"))
    path = F.transform("all", lambda p: F.struct(p["pa"].alias("pa"), p["pb"].alias("pb"), p["cw"].alias("cw")))
    last = F.element_at("path", -1)
    return gathered.select("conv_id", path.alias("path")).select(
        "conv_id", (F.size("path") - 1).alias("len"), last["pa"].alias("pa"), last["pb"].alias("pb"), "path"
    )


def _two_fattest(low: Column, high: Column) -> Column:
    """The number in ``(low, high]`` that the largest power of two divides."""
    shift = F.length(F.bin(low.bitwiseXOR(high))) - 1
    return F.call_function("shiftleft", F.call_function("shiftright", high, shift), shift)


def _agreeing(path: Column, other: Column) -> Column:
    """How many leading prefixes two paths have in common (prefixes never agree again once they differ)."""
    return F.coalesce(F.size(F.filter(path, lambda p, i: p == F.get(other, i))), F.lit(0))


def _ordered_with_neighbour(rows: DataFrame, purpose: str) -> DataFrame:
    """``rows`` with ``before``, the path next to each in the order of paths."""
    sliced = rows.repartitionByRange(partitions(rows.sparkSession), "path").withColumn(
        "__part", F.spark_partition_id()
    )
    sliced = written(sliced.withColumn("__all", F.lit(0)), purpose)
    return previous_in_order(sliced, ["__all"], ["path"], F.col("__part"), "path", "before").drop("__part", "__all")


def empty(spark) -> DataFrame:
    """A trie that holds the root alone."""
    root = (0, 0, 0, -1, None, None, None, None, None, None, None, 0, [(0, 0, 0)])
    return spark.createDataFrame([root], NODE)


def located(trie: DataFrame, batch: DataFrame, longest: int) -> DataFrame:
    """``batch(len, path)`` with the place where each path leaves the trie; ``longest`` bounds ``len``.

    ``a`` is the length of the deepest node on the path, ``lcp`` that of what the path shares with the trie;
    ``v_len, v_edge`` is the exit node whose edge the path enters but does not finish, null if there is none.
    """
    handles = trie.filter("len > 0").select(
        F.col("fat").alias("h_fat"), "fa", "fb", F.col("len").alias("h_len"),
        F.col("pa").alias("h_pa"), F.col("pb").alias("h_pb"), F.col("up").alias("h_up"),
    )
    state = batch.withColumns({"a": F.lit(0), "b": F.col("len")})
    a, b = F.col("a"), F.col("b")
    for _ in range(longest.bit_length()):
        probed = state.withColumn("fat", F.when(a < b, _two_fattest(a, b)))
        probed = probed.withColumn("probe", F.get("path", "fat"))
        hit = (F.col("fat") == F.col("h_fat")) & (F.col("probe.pa") == F.col("fa")) & (F.col("probe.pb") == F.col("fb"))
        found = F.col("h_len").isNotNull()
        extent = F.get("path", "h_len")
        passed = F.coalesce((extent["pa"] == F.col("h_pa")) & (extent["pb"] == F.col("h_pb")), F.lit(False))
        state = probed.join(handles, hit, "left").select(
            *batch.columns,
            F.when(found, F.when(passed, F.col("h_len")).otherwise(F.col("h_up"))).otherwise(a).alias("a"),
            F.when(found, F.when(passed, b).otherwise(F.col("h_up")))
            .when(F.col("fat").isNotNull(), F.col("fat") - 1)
            .otherwise(b)
            .alias("b"),
        )
    names = trie.filter("len > 0").select(
        F.col("up").alias("v_up"), "na", "nb", F.col("len").alias("v_len"), F.col("edge").alias("v_edge")
    )
    state = state.withColumn("name", F.get("path", a + 1))
    entered = (a == F.col("v_up")) & (F.col("name.pa") == F.col("na")) & (F.col("name.pb") == F.col("nb"))
    shared = F.when(F.col("v_len").isNull(), 0).otherwise(
        _agreeing(F.slice("path", a + 2, F.greatest(F.coalesce(F.size("v_edge"), F.lit(0)), F.lit(0))), F.col("v_edge"))
    )
    return state.join(names, entered, "left").select(
        *batch.columns, "a", (a + shared).alias("lcp"), "v_len", "v_edge"
    )


def insert(trie: DataFrame, batch: DataFrame, longest: int) -> DataFrame:
    """The trie with the distinct paths of ``batch(len, path)`` in it, as a stored table."""
    gone = written(located(trie, batch, longest), "located")
    pairs = _ordered_with_neighbour(gone, "batch")
    parted = _agreeing(F.col("path"), F.col("before")) - 1
    a, lcp = F.col("a"), F.col("lcp")
    new = F.array(
        F.when(F.col("len") > a, F.col("len")), F.when(lcp > a, lcp), F.when(parted > lcp, parted)
    )
    kinds = F.array_union(
        F.transform(F.array_distinct(F.array_compact(new)), lambda n: F.struct(n.alias("len"), F.lit(0).alias("kind"))),
        F.array(
            F.struct(a.alias("len"), F.lit(1).alias("kind")),
            F.struct(F.col("v_len").alias("len"), F.lit(2).alias("kind")),
        ),
    )
    here = F.when(F.col("kind") == 2, F.concat(F.slice("path", F.lit(1), a + 1), "v_edge")).otherwise(
        F.slice("path", F.lit(1), F.col("at") + 1)
    )
    places = (
        pairs.select("path", "a", "v_edge", F.inline(kinds).alias("at", "kind"))
        .filter("at IS NOT NULL")
        .select(F.col("at").alias("len"), "kind", here.alias("path"))
        .withColumns({"pa": F.element_at("path", -1)["pa"], "pb": F.element_at("path", -1)["pb"]})
    )
    # An exit node of one path can be nothing new or a hanging place of another; the kinds of a place add up.
    merged = places.groupBy(*KEY).agg(
        F.first("path").alias("path"), F.bool_or(F.col("kind") == 2).alias("cut"), F.bool_or(F.col("kind") == 0).alias("new")
    )
    chained = _ordered_with_neighbour(merged, "places").filter("cut OR new")
    chained = chained.withColumn("up", _agreeing(F.col("path"), F.col("before")) - 1)
    chained = chained.withColumn("fat", _two_fattest(F.col("up"), F.col("len")))
    parent, handle, name = (F.get("path", c) for c in (F.col("up"), F.col("fat"), F.col("up") + 1))
    nodes = written(
        chained.select(
            *KEY, "up", parent["pa"].alias("upa"), parent["pb"].alias("upb"),
            "fat", handle["pa"].alias("fa"), handle["pb"].alias("fb"), name["pa"].alias("na"), name["pb"].alias("nb"),
            parent["cw"].alias("cw_up"),
            F.slice("path", F.col("up") + 2, F.col("len") - F.col("up")).alias("edge"), "cut",
        ),
        "nodes",
    )
    kept = trie.join(nodes.filter("cut").select(*KEY), KEY, "left_anti")
    return written(kept.unionByName(nodes.drop("cut")), "trie")


def build(paths: DataFrame, batches: int = 2) -> DataFrame:
    """A trie of the distinct ``paths(len, path)``, inserted in batches by a hash of the path."""
    longest = paths.agg(F.max("len")).first()[0] or 0
    trie = empty(paths.sparkSession)
    last = F.element_at("path", -1)
    for number in range(batches):
        batch = paths.filter(F.pmod(F.xxhash64(last["pa"], last["pb"]), F.lit(batches)) == number)
        # The first batch meets the root alone and needs no search.
        trie = insert(trie, batch.select("len", "path"), longest if number else 0)
    return trie


def _ancestors(trie: DataFrame) -> DataFrame:
    """``node, anc``: every node with all nodes above it; a round doubles the distance."""
    pairs = written(
        trie.filter("len > 0").select(F.struct(*KEY).alias("node"), _parent().alias("anc"), F.lit(1).alias("dist")), "above"
    )
    distance = 1
    while True:
        far = pairs.filter(F.col("dist") == distance).select("node", F.col("anc").alias("mid"))
        onward = pairs.select(F.col("node").alias("mid"), "anc", (F.col("dist") + distance).alias("dist"))
        more = written(far.join(onward, "mid").select("node", "anc", "dist"), "above")
        if more.isEmpty():
            return pairs
        pairs, distance = pairs.unionByName(more), 2 * distance


def _parent() -> Column:
    return F.struct(*[F.col(p).alias(k) for p, k in zip(PARENT, KEY, strict=True)])


def ends_digest(members: DataFrame) -> DataFrame:
    """``len, pa, pb, ends_sha256``: SHA-256 of the ids that end at a node, ascending, joined by commas.

    Ids are joined in pieces of a fixed range first. A digest has to take the pieces of one node in their order,
    so these stream through one task, which holds a piece at a time.
    """
    pieces = members.groupBy(*KEY, F.shiftright("conv_id", _PIECE_BITS).alias("piece")).agg(
        F.sort_array(F.collect_list("conv_id")).alias("ids")
    )
    joined = pieces.withColumn("ids", F.array_join(F.transform("ids", lambda i: i.cast("string")), ","))
    streams = joined.repartition(*KEY).sortWithinPartitions(*KEY, "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha, done = None, None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*KEY, "ids")]
            for *key, ids in zip(*columns, strict=True):
                if key == node:
                    sha.update(b"," + ids.encode())
                else:
                    if node:
                        done.append((*node, sha.hexdigest()))
                    node, sha = key, hashlib.sha256(ids.encode())
            yield _digests(done)
            done = []
        yield _digests([(*node, sha.hexdigest())] if node else [])

    return streams.mapInArrow(run, "len INT, pa LONG, pb LONG, ends_sha256 STRING")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"len": pa.int32(), "pa": pa.int64(), "pb": pa.int64(), "ends_sha256": pa.string()}
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds)
    )


def shared_prefixes(paths: DataFrame, batches: int = 2) -> DataFrame:
    """Every node of the trie of ``paths`` (see ``sequences``), one row per distinct prefix.

    ``conv_id`` is the smallest member, ``depth`` the number of turns; ``parent_conv_id`` that of the node above,
    null for the root. ``n_convs`` counts the members, ``n_children`` the nodes right below, ``n_leaves`` the
    childless nodes of the subtree and ``saved_tokens`` what it saves: for each of its nodes the words of the
    last turn, once for every member but one. ``ends_sha256`` digests the ids of the members that end here.
    A trie without conversations has no node, so an empty table gives no rows.
    """
    paths = written(paths, "paths")
    distinct = written(
        paths.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"), F.first("path").alias("path")),
        "distinct-paths",
    )
    trie = build(distinct, batches)
    ends = distinct.select(*KEY, "conv_id", "n", (F.col("n") * F.element_at("path", -1)["cw"]).alias("ncw"))
    below = trie.filter("len > 0").groupBy(_parent().alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    values = (
        trie.join(ends, KEY, "left")
        .select(
            F.struct(*KEY).alias("node"), "conv_id", F.coalesce("n", F.lit(0)).alias("n"),
            F.coalesce("ncw", F.lit(0)).alias("ncw"), (F.element_at("edge", -1)["cw"] - F.col("cw_up")).alias("w"),
        )
        .join(below, "node", "left")
    )
    values = written(values.withColumn("n_children", F.coalesce("n_children", F.lit(0))), "values")
    above = _ancestors(trie).select("node", "anc").join(values, "node")
    own = values.withColumns({"anc": F.col("node"), "w": F.lit(0).cast("long")})
    rows = own.unionByName(above).groupBy("anc").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.sum("ncw").alias("ncw"), F.sum("w").alias("w"),
        F.sum((F.col("n_children") == 0).cast("long")).alias("n_leaves"),
    )
    whole = written(
        trie.withColumn("node", F.struct(*KEY)).withColumn("parent", _parent())
        .join(rows.withColumnRenamed("anc", "node"), "node")
        .join(values.select("node", "n_children"), "node")
        .filter("n_convs > 0"),
        "node-values",
    )
    names = whole.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    whole = whole.join(names, "parent", "left").join(ends_digest(paths.select("conv_id", *KEY)), KEY, "left")
    return _expanded(whole)


def _expanded(nodes: DataFrame) -> DataFrame:
    """A row per prefix on the edges of ``nodes``."""
    depth, before = F.col("up") + 1 + F.col("i"), F.when(F.col("i") == 0, F.col("cw_up")).otherwise(F.get("edge", F.col("i") - 1)["cw"])
    end = F.element_at("edge", -1)["cw"]
    at_node = depth == F.col("len")
    below = F.col("ncw") - F.col("n_convs") * end - F.col("w")
    return nodes.select("*", F.posexplode(F.transform("edge", lambda p: p["cw"])).alias("i", "cw")).select(
        "conv_id",
        depth.cast("long").alias("depth"),
        F.when(F.col("i") > 0, F.col("conv_id")).otherwise(F.col("parent_conv_id")).alias("parent_conv_id"),
        "n_convs",
        F.when(at_node, F.col("n_children")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        "n_leaves",
        (below + (F.col("n_convs") - 1) * (end - before)).alias("saved_tokens"),
        F.when(at_node & F.col("ends_sha256").isNotNull(), F.col("ends_sha256")).otherwise(F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, batches: int = 2) -> DataFrame:
    """The shared prefixes of regrafted ``conversations(conv_id, turn, role, text)``; see the functions above."""
    return shared_prefixes(sequences(regrafted(turns(conversations))), batches)
