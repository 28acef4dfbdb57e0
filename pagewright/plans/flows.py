"""Reviews and flows of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.operators import chunking, events, review
from pagewright.plans.registry import query
from pagewright.shared import table

@query("""WITH r AS (SELECT o_custkey AS report_id, arg_max(CASE WHEN o_orderstatus = 'F' THEN 'APPROVED' ELSE 'REJECTED' END, o_orderkey) AS decision, arg_max(o_orderkey % 10, o_orderkey) AS reviewer FROM orders GROUP BY 1),
    j AS (SELECT c_custkey AS report_id, CASE WHEN c_acctbal < 0 THEN 'REJECT' ELSE 'MANUAL_REVIEW' END AS verdict, c_custkey % 10 AS owner, decision, reviewer FROM customer LEFT JOIN r ON r.report_id = c_custkey),
    i AS (SELECT *, CASE WHEN verdict = 'REJECT' AND decision = 'APPROVED' THEN 'REJECTED_NOT_APPROVABLE' WHEN reviewer = owner THEN 'SELF_REVIEW' END AS issue FROM j)
    SELECT report_id, verdict, issue, CASE WHEN issue IS NULL THEN decision END AS decision FROM i""")
def review_decisions(spark, sf_dir):
    reports = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("report_id"), F.when(F.col("c_acctbal") < 0, "REJECT").otherwise("MANUAL_REVIEW").alias("verdict"), (F.col("c_custkey") % 10).alias("owner"))
    reviews = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("report_id"), F.when(F.col("o_orderstatus") == "F", "APPROVED").otherwise("REJECTED").alias("decision"), (F.col("o_orderkey") % 10).alias("reviewer"), F.col("o_orderkey").alias("decided_at"))
    return review.decided(reports, reviews).select("report_id", "verdict", "issue", "decision")


@query("""SELECT conv_id, turn, (row_number() OVER w - 1) / count(*) OVER (PARTITION BY conv_id)::DOUBLE AS y1, row_number() OVER w / count(*) OVER (PARTITION BY conv_id)::DOUBLE AS y2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def line_bands(spark, sf_dir):
    return review.line_bands(table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("turn").alias("position")), "conv_id").drop("position")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def metric_totals(spark, sf_dir):
    return review.metric_totals(table(spark, sf_dir, "events"), "event_type")


@query("""WITH b AS (SELECT source, lang, text, count(*) AS n FROM documents GROUP BY ALL) SELECT source, lang, sum(n)::BIGINT AS documents, count(*) AS contents, sum(n - 1)::BIGINT AS copies FROM b GROUP BY source, lang""")
def copies_by_source(spark, sf_dir):
    found = chunking.duplicates(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.sha2("text", 256).alias("text")), ["source", "lang"], order="doc_id")
    return found.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("dedup_status") == "UNIQUE").alias("contents"), F.count_if(F.col("dedup_status") != "UNIQUE").alias("copies"))


@query("""SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM events) WHERE s > 5""")
def resumed_events(spark, sf_dir):
    """What each reader gets who has seen the first five."""
    rows = events.sequenced(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], ["event_id"])
    return rows.filter("sequence > 5").drop("sequence")
