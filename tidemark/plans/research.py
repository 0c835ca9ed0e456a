"""Registered research queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import research
from tidemark.plans.registry import day_text, query
from tidemark.sources import derived
from tidemark.sources.tables import table

LIFE = """
    SELECT subject, name, strftime(date, '%Y-%m-%d') AS date, coalesce(CAST(date - lag(date) OVER (PARTITION BY subject ORDER BY date, name) AS BIGINT), -1) AS gap_days
    FROM timeline_events"""


@query("research_timeline", "timeline_events", sql=LIFE)
def _(spark, folder):
    line = research.timeline(derived.timeline_events(spark, folder))
    gap = F.coalesce(F.col("gap_days").cast("long"), F.lit(-1))
    return line.select("subject", "name", day_text("date").alias("date"), gap.alias("gap_days"))


@query("research_timeline_gaps", "timeline_events", sql=f"SELECT * FROM ({LIFE}) WHERE gap_days > 365")
def _(spark, folder):
    gaps = research.timeline_gaps(derived.timeline_events(spark, folder), max_gap=365)
    return gaps.select("subject", "name", day_text("date").alias("date"), F.col("gap_days").cast("long").alias("gap_days"))


@query("research_assign_phase", "timeline_events", "phases", sql="""
    SELECT e.subject, name, phase FROM timeline_events e
    LEFT JOIN phases p ON e.subject = p.subject AND date BETWEEN start_date AND end_date""")
def _(spark, folder):
    placed = research.assign_phase(derived.timeline_events(spark, folder), derived.phases(spark, folder))
    return placed.select("subject", "name", "phase")


@query("research_outside_phases", "timeline_events", sql="""
    SELECT subject, name FROM timeline_events WHERE date < (SELECT min(CAST(l_shipdate AS DATE)) FROM lineitem)
       OR date > (SELECT min(CAST(l_shipdate AS DATE)) + 1000 FROM lineitem)""")
def _(spark, folder):
    # One phase for all subjects: the thousand days from the first shipping date on.
    first = table(spark, folder, "lineitem").agg(F.min("l_shipdate").cast("date").alias("start"))
    phase = first.select(F.lit("first").alias("phase"), "start", F.date_add("start", 1000).alias("end"))
    placed = research.assign_phase(derived.timeline_events(spark, folder), phase)
    return research.outside_phases(placed).select("subject", "name")


@query("research_scenario", "competitors", sql="""
    SELECT subject, direct, CASE WHEN direct = 0 THEN 'A' WHEN direct <= 2 THEN 'B' ELSE 'C' END AS scenario
    FROM (SELECT subject, count(DISTINCT competitor) FILTER (type = 'direct') AS direct FROM competitors GROUP BY subject)""")
def _(spark, folder):
    rivals = derived.competitors(spark, folder)
    return research.scenario(rivals.select("subject"), rivals)


@query("research_representatives", sql="""
    WITH rivals AS (SELECT p_brand AS subject, p_partkey AS competitor, p_retailprice AS score,
                           CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'direct' ELSE 'indirect' END AS type FROM part)
    SELECT subject, competitor, CASE WHEN type = 'direct' AND row_number() OVER (PARTITION BY subject, type ORDER BY score DESC, competitor) <= 4
           THEN 'in depth' ELSE 'brief' END AS role FROM rivals""")
def _(spark, folder):
    rivals = table(spark, folder, "part").select(
        F.col("p_brand").alias("subject"), F.col("p_partkey").alias("competitor"), F.col("p_retailprice").alias("score"),
        F.when(F.col("p_type").isin("ECONOMY", "SMALL"), "direct").otherwise("indirect").alias("type"),
    )
    return research.representatives(rivals, k=4).select("subject", "competitor", "role")


@query("research_matrix", sql="""
    SELECT p_brand AS dimension, max(p_retailprice) FILTER (p_type = 'ECONOMY') AS economy,
           max(p_retailprice) FILTER (p_type = 'SMALL') AS small, max(p_retailprice) FILTER (p_type = 'PROMO') AS promo
    FROM part GROUP BY p_brand""")
def _(spark, folder):
    values = table(spark, folder, "part").select(
        F.col("p_brand").alias("dimension"), F.lower("p_type").alias("party"), F.col("p_retailprice").alias("value")
    )
    return research.matrix(values, ["economy", "small", "promo"])


@query("research_threat_summary", "competitors", sql="""
    SELECT CASE WHEN grouping(type) = 1 THEN 'all' ELSE type END AS type,
           CASE WHEN grouping(threat) = 1 THEN 'all' ELSE threat END AS threat, count(*) AS competitors
    FROM competitors GROUP BY CUBE (type, threat)""")
def _(spark, folder):
    return research.threat_summary(derived.competitors(spark, folder))


@query("research_best_source", "claims", sql="""
    SELECT claim_id, source_kind, url FROM claims
    QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY list_position(['primary', 'media', 'reprint'], source_kind), url) = 1""")
def _(spark, folder):
    return research.best_source(derived.claims(spark, folder))


@query("research_single_source", sql="""
    SELECT l_orderkey AS claim_id, min(l_suppkey) AS origin, count(*) AS mentions FROM lineitem
    GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) = 1""")
def _(spark, folder):
    claims = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("claim_id"), F.col("l_suppkey").alias("origin"))
    return research.single_source(claims)


@query("research_independent_sources", "claims", "citations", sql="""
    WITH RECURSIVE reach(origin, other) AS (SELECT DISTINCT origin, origin FROM claims
        UNION SELECT r.origin, e.b FROM reach r
        JOIN (SELECT origin AS a, cites AS b FROM citations UNION ALL SELECT cites, origin FROM citations) e ON r.other = e.a),
    ends AS (SELECT origin, min(other) AS root FROM reach GROUP BY origin)
    SELECT claim_id, count(DISTINCT origin) AS origins, count(DISTINCT root) AS independent
    FROM claims JOIN ends USING (origin) GROUP BY claim_id""")
def _(spark, folder):
    return research.independent_sources(derived.claims(spark, folder), derived.citations(spark, folder))


@query("research_unsourced", sql="""
    SELECT doc_id AS claim_id, contains(text, 'token') AS marked FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def _(spark, folder):
    claims = table(spark, folder, "documents").select(F.col("doc_id").alias("claim_id"), "text")
    sources = table(spark, folder, "labels").select(F.col("doc_id").alias("claim_id"))
    return research.unsourced(claims, sources, marker="token")


@query("research_roots", sql="""
    SELECT c_custkey AS trait, count(o_orderkey) AS events, coalesce(arg_min(o_orderkey, (o_orderdate, o_orderkey)), -1) AS root,
           strftime(min(o_orderdate), '%Y-%m-%d') AS root_date
    FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderdate <= DATE '1997-06-30') ON o_custkey = c_custkey
    GROUP BY c_custkey""")
def _(spark, folder):
    orders = table(spark, folder, "orders")
    links = orders.select(F.col("o_custkey").alias("trait"), F.col("o_orderkey").alias("event"))
    events = orders.select(F.col("o_orderkey").alias("event"), F.col("o_orderdate").cast("date").alias("date"))
    traits = table(spark, folder, "customer").select(F.col("c_custkey").alias("trait"))
    found = research.roots(traits, links, events, cut_date="1997-06-30")
    return found.fillna(-1, ["root"]).select("trait", "events", "root", day_text("root_date").alias("root_date"))


@query("research_as_of", sql="""
    SELECT o_custkey AS party, o_orderpriority AS dimension, strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderstatus AS value
    FROM orders WHERE o_orderdate <= DATE '1999-12-31'
    QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def _(spark, folder):
    states = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("party"), F.col("o_orderpriority").alias("dimension"),
        F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderstatus").alias("value"), F.col("o_orderkey").alias("seq"),
    )
    last = research.as_of(states, cut_date="1999-12-31", keys=["party", "dimension"], value="value", tie=["seq"])
    return last.select("party", "dimension", day_text("date").alias("date"), "value")


@query("research_phases_of_any_length", "timeline_events", sql="""
    WITH phases AS (
        SELECT c_custkey AS subject, 'running' AS phase, DATE '1996-01-01' + CAST(c_custkey % 700 AS INTEGER) AS s, NULL AS e FROM customer
        UNION ALL SELECT c_custkey, 'ages', DATE '0001-01-01', DATE '9999-12-31' FROM customer WHERE c_custkey % 3 = 0
        UNION ALL SELECT c_custkey, 'short', DATE '1995-06-01' + CAST(c_custkey % 300 AS INTEGER),
                         DATE '1995-06-01' + CAST(c_custkey % 300 + c_custkey % 90 AS INTEGER) FROM customer
        UNION ALL SELECT c_custkey, 'before', NULL, DATE '1995-03-31' FROM customer WHERE c_custkey % 2 = 1)
    SELECT e.subject, name, phase FROM timeline_events e
    LEFT JOIN phases p ON e.subject = p.subject AND date >= coalesce(s, DATE '0001-01-01') AND date <= coalesce(e, DATE '9999-12-31')""")
def _(spark, folder):
    n = F.col("c_custkey")

    def day(text, plus=0):
        return F.date_add(F.lit(text).cast("date"), F.lit(plus).cast("int") if isinstance(plus, int) else plus.cast("int"))

    def phase(name, start, end, wanted=None):
        span = F.struct(F.lit(name).alias("phase"), start.cast("date").alias("start"), end.cast("date").alias("end"))
        return span if wanted is None else F.when(wanted, span)

    none = F.lit(None)
    spans = F.array_compact(F.array(
        phase("running", day("1996-01-01", n % 700), none),
        phase("ages", day("0001-01-01"), day("9999-12-31"), n % 3 == 0),
        phase("short", day("1995-06-01", n % 300), day("1995-06-01", n % 300 + n % 90)),
        phase("before", none, day("1995-03-31"), n % 2 == 1),
    ))
    phases = table(spark, folder, "customer").select(n.alias("subject"), F.inline(spans))
    return research.assign_phase(derived.timeline_events(spark, folder), phases).select("subject", "name", "phase")


@query("research_as_of_each", sql="""
    SELECT o.o_custkey AS party, strftime(l_shipdate, '%Y-%m-%d') AS cut_date, l_orderkey, l_partkey,
           (SELECT arg_max(s.o_orderstatus, (s.o_orderdate, s.o_orderkey)) FROM orders s
            WHERE s.o_custkey = o.o_custkey AND s.o_orderdate <= l_shipdate) AS value
    FROM lineitem JOIN orders o ON l_orderkey = o.o_orderkey""")
def _(spark, folder):
    # Every line compares at its own shipping date.
    orders = table(spark, folder, "orders")
    cuts = table(spark, folder, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("party"), F.col("l_shipdate").cast("date").alias("cut_date"), "l_orderkey", "l_partkey"
    )
    states = orders.select(
        F.col("o_custkey").alias("party"), F.col("o_orderdate").cast("date").alias("date"),
        F.col("o_orderstatus").alias("value"), F.col("o_orderkey").alias("seq"),
    )
    found = research.as_of_each(cuts, states, keys=["party"], value="value", tie=["seq"])
    return found.withColumn("cut_date", day_text("cut_date"))


@query("research_roots_each", sql="""
    SELECT c_custkey AS trait, count(o_orderkey) AS events, coalesce(arg_min(o_orderkey, (o_orderdate, o_orderkey)), -1) AS root
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey
         AND CAST(o_orderdate AS DATE) <= DATE '1995-01-01' + CAST(c_custkey % 2000 AS INTEGER)
    GROUP BY c_custkey""")
def _(spark, folder):
    orders = table(spark, folder, "orders")
    links = orders.select(F.col("o_custkey").alias("trait"), F.col("o_orderkey").alias("event"))
    events = orders.select(F.col("o_orderkey").alias("event"), F.col("o_orderdate").cast("date").alias("date"))
    cut = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("c_custkey") % 2000).cast("int"))
    traits = table(spark, folder, "customer").select(F.col("c_custkey").alias("trait"), cut.alias("cut_date"))
    return research.roots(traits, links, events).fillna(-1, ["root"]).select("trait", "events", "root")
