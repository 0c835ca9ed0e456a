"""Views over the given tables in the shapes the operators take.

Every view covers all rows of its tables. ``tidemark.plans.views`` holds the same views in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.storage import floor_kb
from tidemark.sources.tables import table

CATEGORY = {"click": "ai-models", "view": "ai-products", "purchase": "industry", "signup": "paper"}
SURFACE = {
    "1-URGENT": "code", "2-HIGH": "runtime", "3-MEDIUM": "docs", "4-NOT SPECIFIED": "rules", "5-LOW": "memory",
}
MODE = {
    "1-URGENT": "rm", "2-HIGH": "trash", "3-MEDIUM": "open", "4-NOT SPECIFIED": "shred", "5-LOW": "rm",
}


#: Tasks over which the costly text queries deal their rows, whatever the size of the table.
SPREAD = 64


def texts(spark: SparkSession, folder: str, spread: bool = False) -> DataFrame:
    """Documents; ``spread`` deals them over tasks first, because a given table is one row group, read by one task."""
    docs = table(spark, folder, "documents")
    return docs.repartition(SPREAD, "doc_id") if spread else docs


def mapped(column: Column, values: dict[str, str], other: str | None = None) -> Column:
    expr = None
    for key, value in values.items():
        expr = F.when(column == key, value) if expr is None else expr.when(column == key, value)
    return expr.otherwise(F.lit(other))


def feed_items(spark: SparkSession, folder: str) -> DataFrame:
    """Events as feed items; the text of the document with the same number is the summary."""
    items = feed_entries(spark, folder).drop("original_title", "summary")
    return items.join(feed_texts(spark, folder), "id", "left")


def feed_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The text fields of feed items, by id."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("original_title"), F.col("text").alias("summary")
    )


def feed_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Feed items without their texts, which most feed queries do not show."""
    lag = F.from_json("props", "k INT").k
    shifted = F.timestamp_add("HOUR", -lag, F.col("ts"))
    none = F.lit(None).cast("string")
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        F.concat("event_type", F.lit(" by user "), F.col("user_id").cast("string")).alias("title"),
        none.alias("original_title"),
        none.alias("summary"),
        F.struct(F.concat(F.lit("src"), lag.cast("string")).alias("name")).alias("source"),
        F.struct(
            F.concat(F.lit("https://site.test/items/"), F.col("event_id").cast("string")).alias("site"),
            F.concat(F.lit("https://origin.test/"), F.col("event_id").cast("string")).alias("original"),
        ).alias("links"),
        F.when(F.col("event_type") != "error", shifted).alias("published_at"),
        F.col("ts").alias("discovered_at"),
        mapped(F.col("event_type"), CATEGORY, "other").alias("category"),
        F.when(F.col("value") <= 100, F.floor("value").cast("int")).alias("score"),
        (F.col("value") >= 50).alias("selected"),
    )


def story_reports(spark: SparkSession, folder: str) -> DataFrame:
    """One story per user and day of the month."""
    return table(spark, folder, "events").select(
        (F.col("user_id") * 100 + F.dayofmonth("ts")).alias("story_id"),
        F.col("event_id").alias("report_id"),
        "ts",
    )


def story_alias(spark: SparkSession, folder: str) -> DataFrame:
    """Every customer outside one segment is merged into the customer with a third of its number."""
    return (
        table(spark, folder, "customer")
        .filter((F.col("c_mktsegment") != "HOUSEHOLD") & (F.col("c_custkey") > 0))
        .select(F.col("c_custkey").alias("old_id"), F.floor(F.col("c_custkey") / 3).alias("new_id"))
    )


def mirror(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value")
    )


def changes(spark: SparkSession, folder: str) -> DataFrame:
    return change_rows(table(spark, folder, "events"))


def change_rows(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", "remove").otherwise("upsert").alias("op"),
        F.col("user_id").alias("id"),
        "value",
    )


def fs_entry(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as files: ``/region/nation/c<customer>/o<order>/l<line>``; some customers' folders are unreadable."""
    nation = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    owner = (
        table(spark, folder, "customer")
        .join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
        .select("c_custkey", F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name").alias("top"))
    )
    order = (
        table(spark, folder, "orders").select("o_orderkey", "o_custkey")
        .join(owner, F.col("o_custkey") == F.col("c_custkey"))
    )
    unreadable = customer_dirs(spark, folder).filter("c_mktsegment = 'AUTOMOBILE' AND c_acctbal < 0").select(
        "path", F.lit(0).cast("long").alias("size_bytes"), F.lit(False).alias("is_symlink"), F.lit(True).alias("denied")
    )
    files = (
        table(spark, folder, "lineitem")
        .join(order, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.concat(
                "top", F.lit("/c"), F.col("c_custkey").cast("string"),
                F.lit("/o"), F.col("o_orderkey").cast("string"),
                F.lit("/l"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey"),
            ).alias("path"),
            (F.col("l_quantity").cast("long") * 1048576).alias("size_bytes"),
            (F.col("l_discount") >= 0.095).alias("is_symlink"),
            (F.col("l_quantity") >= 50).alias("denied"),
        )
    )
    return files.unionByName(unreadable)


def customer_dirs(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with their directory: ``c_custkey, c_mktsegment, c_nationkey, r_name, n_name, path``."""
    nation = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return (
        table(spark, folder, "customer")
        .join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            "c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal", "r_name", "n_name",
            F.concat(
                F.lit("/"), "r_name", F.lit("/"), "n_name", F.lit("/c"), F.col("c_custkey").cast("string")
            ).alias("path"),
        )
    )


def targets(spark: SparkSession, folder: str) -> DataFrame:
    """Scan roots: all nations (two regions as groups with a higher floor) and the customers of one segment."""
    kind = mapped(F.col("r_name"), {"AFRICA": "home", "AMERICA": "applications"})
    nation = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    roots = nation.select(
        F.coalesce(kind, F.lower("n_name")).alias("group"),
        F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name").alias("root"),
    )
    own = customer_dirs(spark, folder).filter(F.col("c_mktsegment") == "AUTOMOBILE").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("group"),
        F.col("path").alias("root"),
    )
    return roots.unionByName(own).withColumn("floor_kb", floor_kb(F.col("group")))


def tier_prefixes(spark: SparkSession, folder: str) -> DataFrame:
    """A tier per region, and a stricter one for the customers of one segment."""
    tier = mapped(F.col("r_name"), {"AFRICA": "green", "AMERICA": "yellow", "ASIA": "red"})
    regions = table(spark, folder, "region").select(
        F.concat(F.lit("/"), "r_name").alias("prefix"), tier.alias("tier"), F.lit(1).alias("priority")
    )
    own = customer_dirs(spark, folder).filter(F.col("c_mktsegment") == "MACHINERY").select(
        F.col("path").alias("prefix"), F.lit("red").alias("tier"), F.lit(1).alias("priority")
    )
    return regions.filter(F.col("tier").isNotNull()).unionByName(own)


def tier_items(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as report items with a size label in mixed units."""
    amount = F.concat(F.lit("约 "), F.floor(F.abs("c_acctbal")).cast("string"))
    suffix = (
        F.when(F.col("c_nationkey") < 8, " GB")
        .when(F.col("c_nationkey") < 16, " MB（估算）")
        .when(F.col("c_nationkey") < 20, " TB")
        .otherwise(" KB")
    )
    tier = (
        F.when(F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING"), "green")
        .when(F.col("c_mktsegment").isin("FURNITURE", "HOUSEHOLD"), "yellow")
        .otherwise("red")
    )
    order = F.concat("path", F.lit("/o"), F.col("c_custkey").cast("string"))
    return customer_dirs(spark, folder).select(
        tier.alias("tier"),
        F.col("c_custkey").alias("name"),
        "path",
        F.concat(amount, suffix).alias("size_text"),
        F.when(tier != "red", F.array(order, F.concat("path", F.lit("/tmp")))).alias("trash_paths"),
        F.when(tier == "red", F.array("path", order)).alias("app_paths"),
    )


def links(spark: SparkSession, folder: str) -> DataFrame:
    """Links ``path, target``: a chain per customer that halves its number, a folder of them per nation, circles.

    ``/links/c<n>`` leads to the customer's folder for odd n and 0, else (as a relative target) to ``c<n / 2>``;
    ``/hop/n<nation>`` leads to ``/links``; some ``/links/r<n>`` and ``/links/s<n>`` lead to each other.
    """
    n = F.col("c_custkey")
    own = customer_dirs(spark, folder).withColumn("half", F.floor(n / 2).cast("string"))
    chain = own.select(
        F.concat(F.lit("/links/c"), n.cast("string")).alias("path"),
        F.when((n % 2 == 1) | (n == 0), F.col("path")).otherwise(F.concat(F.lit("c"), "half")).alias("target"),
    )
    hops = table(spark, folder, "nation").select(
        F.concat(F.lit("/hop/n"), F.col("n_nationkey").cast("string")), F.lit("/links")
    )
    circles = own.filter(n % 40 == 7)
    there = circles.select(F.concat(F.lit("/links/r"), n), F.concat(F.lit("s"), n, F.lit("/x")))
    back = circles.select(F.concat(F.lit("/links/s"), n), F.concat(F.lit("../links/r"), n))
    return chain.union(hops).union(there).union(back)


def linked_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as paths through ``links``: ``o_orderkey, o_custkey, path``; also plain ones and ways into circles."""
    order, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey")
    hop = F.concat(F.lit("/hop/n"), cust % 25, F.lit("/c"), cust, F.lit("/o"), order)
    over = F.concat(F.lit("/links/./c"), cust, F.lit("/../c"), cust, F.lit("/o"), order)
    circle = F.concat(F.lit("/links/r"), cust, F.lit("/o"), order)
    plain = F.concat(F.lit("/plain/o"), order)
    kind = F.col("o_orderkey") % 4
    path = F.when(kind == 0, hop).when(kind == 1, over).when(kind == 2, circle).otherwise(plain)
    return table(spark, folder, "orders").select("o_orderkey", "o_custkey", path.alias("path"))


def action_requests(spark: SparkSession, folder: str) -> DataFrame:
    """One request per order on the directories of its lines' customers, in line order."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    dirs = customer_dirs(spark, folder).select(
        "c_custkey", F.concat("path", F.lit("/tmp/.././o"), F.col("c_custkey").cast("string")).alias("path")
    )
    return (
        table(spark, folder, "lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(dirs, F.col("l_partkey") == F.col("c_custkey"))
        .select(
            F.col("l_orderkey").alias("request_id"),
            mapped(F.col("o_orderpriority"), MODE).alias("mode"),
            (
                F.col("l_linenumber").cast("long") * 1000000000000
                + F.col("l_partkey") * 1000000
                + F.col("l_suppkey")
            ).alias("pos"),
            "path",
        )
    )


def articles(spark: SparkSession, folder: str, spread: bool = False) -> DataFrame:
    """Documents with their noise marks turned into Markdown: bold, headings, bullets, blank lines."""
    text = F.col("text")
    for mark, markup in {"$$$": "**", "***": "\n# ", "%%%": "\n- ", "&&&": "\n\n", "###": "？"}.items():
        text = F.replace(text, F.lit(mark), F.lit(markup))
    return texts(spark, folder, spread).select("doc_id", "lang", "source", text.alias("text"))


def files(spark: SparkSession, folder: str, spread: bool = False) -> DataFrame:
    """Documents as project files that link to the next two documents by number."""
    number = F.col("doc_id").cast("string")
    path = (
        F.when(F.col("lang") == "en", F.concat(F.lit("/corpus/docs/d"), number, F.lit(".md")))
        .when(F.col("lang") == "fr", F.concat(F.lit("/corpus/guides/d"), number, F.lit(".mdx")))
        .when(F.col("lang") == "de", F.concat(F.lit("/corpus/src/d"), number, F.lit("_old.js")))
        .otherwise(F.concat(F.lit("/corpus/vendor/d"), number, F.lit(".md")))
    )
    links = F.concat(
        F.lit("\nSee [next](d"), (F.col("doc_id") + 1).cast("string"),
        F.lit(".md) and `docs/d"), (F.col("doc_id") + 2).cast("string"), F.lit(".md`.\n"),
    )
    return texts(spark, folder, spread).select(
        F.col("source").alias("project"),
        F.lit("/corpus").alias("root"),
        path.alias("path"),
        F.concat("text", links).alias("text"),
    )


def facts(spark: SparkSession, folder: str) -> DataFrame:
    """Order states as facts about their customer, on the surface the priority names."""
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("topic"),
        mapped(F.col("o_orderpriority"), SURFACE).alias("surface"),
        F.col("o_orderstatus").alias("value"),
        F.col("o_orderkey").alias("seq"),
    )


def timeline_events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("subject"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.col("o_orderkey").alias("name"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus")).alias("trigger"),
    )


def phases(spark: SparkSession, folder: str) -> DataFrame:
    """Two phases per customer: up to the end of 1996, and from 1998 on."""
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("subject"))
    spans = F.array(
        F.struct(F.lit("early").alias("phase"), F.to_date(F.lit("1995-01-01")).alias("start"), F.to_date(F.lit("1996-12-31")).alias("end")),
        F.struct(F.lit("late").alias("phase"), F.to_date(F.lit("1998-01-01")).alias("start"), F.to_date(F.lit("2001-12-31")).alias("end")),
    )
    return customers.select("subject", F.inline(spans))


def competitors(spark: SparkSession, folder: str) -> DataFrame:
    """Part types that share brand and size are competitors of that pair."""
    price = F.col("p_retailprice")
    return (
        table(spark, folder, "part")
        .groupBy("p_brand", "p_size", "p_type")
        .agg(F.max("p_retailprice").alias("p_retailprice"))
        .select(
            F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string")).alias("subject"),
            F.col("p_type").alias("competitor"),
            mapped(F.col("p_type"), {"ECONOMY": "direct", "SMALL": "direct", "LARGE": "direct", "PROMO": "indirect"}, "substitute").alias("type"),
            F.when(price < 950, "low").when(price < 1050, "mid").otherwise("high").alias("threat"),
            price.alias("score"),
        )
    )


def claims(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as claims about a part, made by a supplier, with a kind of source."""
    kind = mapped(F.col("l_returnflag"), {"A": "primary", "N": "media"}, "reprint")
    return table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("claim_id"),
        F.col("l_suppkey").alias("origin"),
        kind.alias("source_kind"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey").alias("url"),
    )


def citations(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers of twenty nations repeat the one with half their number, some of them a second one as well."""
    suppliers = table(spark, folder, "supplier").filter(F.col("s_suppkey") > 0)
    cited = lambda n: F.floor(F.col("s_suppkey") / n).alias("cites")
    first = suppliers.filter(F.col("s_nationkey") < 20).select(F.col("s_suppkey").alias("origin"), cited(2))
    second = suppliers.filter(F.col("s_nationkey") < 5).select(F.col("s_suppkey").alias("origin"), cited(3))
    return first.union(second)


def runs(spark: SparkSession, folder: str) -> DataFrame:
    return run_rows(table(spark, folder, "events"))


def run_rows(events: DataFrame) -> DataFrame:
    """Events as check results: a run per user, five checks, errors and views are failures."""
    return events.select(
        F.col("user_id").alias("run"),
        F.concat(F.lit("c"), F.floor(F.from_json("props", "k INT").k / 20).cast("string")).alias("check"),
        F.col("event_id").alias("seq"),
        (~F.col("event_type").isin("error", "view")).alias("ok"),
    )


def trigger_labels(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "labels")
        .join(table(spark, folder, "documents"), "doc_id")
        .select("doc_id", F.col("text").alias("query"), (F.col("quality") == 1).alias("should_trigger"), "lang")
    )
