"""A Merkle manifest of a data set: leaf digests, subroots per language, one root, and a proof for every row.

Every row has a rank in its group, and the rank's digits to the base 8 are its way through the tree. The digits
are grouped away one after the other, the last first: each grouping nests the child structs of one node and
adds the node's digest. That happens within blocks of ``FANOUT ** DIGITS`` ranks, so a group of any size gives
nested rows of bounded size only; the blocks' digests are the nodes of the next storey. Proofs run the other
way: a storey's nested rows are transformed into paths and exploded, and the path of each block goes down to the
block by a union and a grouping of exactly two rows. No join emits a proof.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.skew import even_join
from tidemark.llm.words import partitions
from tidemark.session import written

FANOUT = 8
DIGITS = 3
BLOCK = FANOUT**DIGITS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_STEP = "struct<before:string,after:string>"


def digest(fields: list[Column]) -> Column:
    """SHA-256 of the fields: ``-`` for a null, else the number of UTF-8 bytes, a colon and the value."""

    def one(field: Column) -> Column:
        text = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[one(f) for f in fields]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """``doc_id, lang_key, leaf, found``: the leaf as it was, and as it is found after tampering.

    Where 3 divides the CRC-32 of the decimal ``doc_id``, the text was found with A-Z lower-cased. A null
    ``doc_id`` has no decimal and is found as it was. ``lang_key`` sorts a null language before all others.
    """
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    leaf = digest([F.col(f) for f in FIELDS])
    lowered = F.translate("text", UPPER, UPPER.lower())
    forged = digest([lowered if f == "text" else F.col(f) for f in FIELDS])
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("+"), F.col("lang")), F.lit("")).alias("lang_key"),
        leaf.alias("leaf"),
        F.when(F.coalesce(changed, F.lit(False)), forged).otherwise(leaf).alias("found"),
    )


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Add ``n``, the size of each group, and ``rank`` from 0 along ``order`` (nulls first).

    Rows are cut into slices by a range partitioning of the whole order and the slices are stored, so a group
    of any size lies in many; equal rows are told apart by a number of their own and are split like others.
    """
    spark = rows.sparkSession
    marked = written(rows.withColumn("__own", F.monotonically_increasing_id()), "leaves")
    along = [*order, "__own"]
    sliced = marked.repartitionByRange(partitions(spark), group, *along).withColumn("__slice", F.spark_partition_id())
    sliced = written(sliced, "slices")
    whole = W.partitionBy(group)
    offsets = sliced.groupBy(group, "__slice").agg(F.count(F.lit(1)).alias("__size")).select(
        group,
        "__slice",
        F.sum("__size").over(whole).alias("n"),
        (F.sum("__size").over(whole.orderBy("__slice")) - F.col("__size")).alias("__before"),
    )
    inside = W.partitionBy(group, "__slice").orderBy(*along)
    placed = sliced.withColumn("__row", F.row_number().over(inside))
    return even_join(placed, offsets, [group, "__slice"], "inner").select(
        *rows.columns, "n", (F.col("__before") + F.col("__row") - 1).alias("rank")
    )


def _digit(place: int) -> Column:
    return F.shiftright("rank", 3 * place) % FANOUT


def _nested(nodes: DataFrame, storey: int) -> DataFrame:
    """``group, n, block, digest, kids``: a row per block, with the digits of its ranks grouped away.

    A grouping joins digests only while the group still has several nodes on that level; else its one
    node goes up as it is.
    """
    block = F.shiftright("rank", 3 * DIGITS).alias("block")
    digits = [f"d{i}" for i in range(DIGITS)]
    held = [c for c in nodes.columns if c not in ("group", "n", "rank", "digest")]
    rows = nodes.select(
        "group", "n", block, *[_digit(i).alias(d) for i, d in enumerate(digits)], "digest", *held
    ).repartition("group", "block")
    inner = ["digest", *held]
    for place, own in enumerate(digits):
        above = digits[place + 1 :]
        several = F.col("n") > FANOUT ** (DIGITS * storey + place)
        node = F.sha2(F.array_join(F.transform("kids", lambda k: k["digest"]), ""), 256)
        rows = (
            rows.groupBy("group", "n", "block", *above)
            .agg(F.sort_array(F.collect_list(F.struct(own, *inner))).alias("kids"))
            .withColumn("digest", F.when(several, node).otherwise(F.col("kids")[0]["digest"]))
        )
        inner = ["digest", "kids"]
    return rows.select("group", "n", "block", "digest", "kids")


def _siblings(kids: Column, own: Column, place: int, storey: int) -> Column:
    """The step past one node, as an array: the digests left and right of it; none where nothing was joined."""

    def side(left: bool) -> Column:
        near = F.filter(kids, lambda k: k[f"d{place}"] < own if left else k[f"d{place}"] > own)
        return F.array_join(F.transform(near, lambda k: k["digest"]), "")

    step = F.array(F.struct(side(True).alias("before"), side(False).alias("after")))
    joined = F.col("n") > FANOUT ** (DIGITS * storey + place)
    return F.when(joined, step).otherwise(F.array().cast(f"array<{_STEP}>"))


def _emitted(blocks: DataFrame, held: list[str], storey: int) -> DataFrame:
    """The nodes of nested blocks with their whole path: the steps inside the block, then those of the block."""

    def down(kids: Column, place: int, path: Column, number: Column) -> Column:
        def visit(kid: Column) -> Column:
            way = F.concat(_siblings(kids, kid[f"d{place}"], place, storey), path)
            at = number * FANOUT + kid[f"d{place}"]
            if place:
                return down(kid["kids"], place - 1, way, at)
            return F.array(F.struct(at.alias("rank"), *[kid[c].alias(c) for c in held], way.alias("path")))

        return F.flatten(F.transform(kids, visit))

    rows = down(F.col("kids"), DIGITS - 1, F.col("path"), F.col("block"))
    others = [c for c in blocks.columns if c not in ("n", "block", "digest", "kids", "path")]
    return blocks.select(*others, "n", F.inline(rows))


def _attached(blocks: DataFrame, paths: DataFrame, keys: list[str], given: list[str]) -> DataFrame:
    """``blocks`` with the ``given`` columns of the one row of ``paths`` that has the same keys."""
    own = [c for c in blocks.columns if c not in keys]
    both = blocks.unionByName(paths.select(*keys, *given), allowMissingColumns=True)
    return both.groupBy(*keys).agg(*[F.first(c, ignorenulls=True).alias(c) for c in [*own, *given]])


def _storeys(nodes: DataFrame, most: int, purpose: str) -> list[DataFrame]:
    """Nested blocks from the nodes up, until every group has a single block."""
    storeys = [written(_nested(nodes, 0), purpose)]
    while most > BLOCK ** len(storeys):
        up = storeys[-1].select("group", "n", F.col("block").alias("rank"), "digest")
        storeys.append(written(_nested(up, len(storeys)), purpose))
    return storeys


def _paths(storeys: list[DataFrame], top: DataFrame, given: list[str], held: list[str]) -> DataFrame:
    """Every node of the lowest storey with its path to the root; ``top`` has the rest of the path per group."""
    blocks = _attached(storeys[-1], top, ["group"], ["path", *given])
    for storey in range(len(storeys) - 1, 0, -1):
        emitted = _emitted(blocks, [], storey).withColumnRenamed("rank", "block").drop("n")
        blocks = _attached(storeys[storey - 1], emitted, ["group", "block"], ["path", *given])
    return _emitted(blocks, held, 0)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf has if its path is true."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a path, from the leaf to the root and from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def manifest(docs: DataFrame) -> DataFrame:
    """``doc_id, lang_key, leaf, found, subroot, root, path`` of every row: its leaf, and the way to the root.

    ``path`` has a step ``before, after`` for every level on which digests were joined: the joined digests of
    the siblings left and right. Within a language leaves stand by ``doc_id``, nulls first; rows with the same
    ``doc_id`` stand by their leaves, so that repeated rows are leaves of their own and equal ones may be
    exchanged. Null columns count as ``-``, empty texts as ``0:``. A language without rows has no node; no
    rows give no manifest. Other columns are ignored.
    """
    own = ranked(leaves(docs), "lang_key", ["doc_id", "leaf"])
    own = own.select(F.col("lang_key").alias("group"), "n", "rank", F.col("leaf").alias("digest"), "doc_id", "found")
    own = written(own, "ranked")
    storeys = _storeys(own, own.agg(F.max("n")).first()[0] or 0, "languages")
    subroots = storeys[-1].select(F.col("group").alias("lang"), "digest")
    langs = ranked(subroots.withColumn("group", F.lit("")), "group", ["lang"])
    langs = written(langs, "subroots")
    tops = _storeys(langs, langs.agg(F.max("n")).first()[0] or 0, "data-set")
    nothing = F.array().cast(f"array<{_STEP}>")
    root = tops[-1].select("group", F.col("digest").alias("root"), nothing.alias("path"))
    of_lang = _paths(tops, root, ["root"], ["lang", "digest"])
    of_lang = of_lang.select(F.col("lang").alias("group"), "path", "root", F.col("digest").alias("subroot"))
    return _paths(storeys, of_lang, ["root", "subroot"], ["doc_id", "found", "digest"]).select(
        "doc_id", F.col("group").alias("lang_key"), F.col("digest").alias("leaf"), "found", "subroot", "root", "path"
    )


def verify(manifested: DataFrame) -> DataFrame:
    """The manifest's proofs, and whether the leaves that were found still lead to the root."""
    back = manifested.withColumn("folded_root", folded(F.col("found"), F.col("path")))
    return back.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
