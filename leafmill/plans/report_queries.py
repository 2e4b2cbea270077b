"""Queries of check accounting and reports. Events stand in for findings: a user is a file, an event a finding."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.plans import catalogue as C

ACCESSIBLE = C.expanded(C.ACCESSIBLE)


def findings(spark, sf_dir):
    """An event names a check, or in every fifth case only its clause."""
    names = F.array(*map(F.lit, ACCESSIBLE))
    test = F.element_at(names, (F.col("event_id") % len(ACCESSIBLE) + 1).cast("int"))
    severity = F.when(F.col("event_type") == "error", "Error").when(F.col("event_type") == "click", "Warning").otherwise("Info")
    rule = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("rule:general-"), F.col("event_type"))).otherwise(F.concat(F.lit("ua:"), test))
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(
        F.col("user_id").alias("file"), F.col("event_id").alias("seq"), rule.alias("rule_id"), F.concat(F.lit("ISO, "), C.clause_of_test(test)).alias("clause"), severity.alias("severity"), F.col("event_type").alias("message")
    )


def accounts(spark, d):
    found = findings(spark, d)
    files = found.select("file").distinct().withColumn("profile", F.lit("ua1"))
    return C.accounted(C.checks(spark), files, found)


def check_accounting(spark, d):
    return accounts(spark, d).groupBy("file", "bucket").agg(F.count("*").alias("n"))


def failed_clauses(spark, d):
    return accounts(spark, d).where("bucket = 'failed'").groupBy("clause").agg(F.countDistinct("file").alias("files"), F.count("*").alias("n"))


def coverage_percent(spark, d):
    return C.coverage(C.checks(spark))


def severity_gate(spark, d):
    """Files at or above a threshold, and their exit code."""
    rows = findings(spark, d).withColumn("rank", C.severity_rank(F.col("severity")))
    return rows.groupBy("file").agg(F.count_if(F.col("rank") >= 1).alias("n"), F.max(F.when(F.col("rank") >= 2, 1).otherwise(0)).cast("long").alias("exit_code"))


def sarif_rules(spark, d):
    rows = findings(spark, d)
    return rows.groupBy("file", "rule_id").agg(F.min("seq").alias("first_seq"), F.count("*").alias("n"))


def json_report(spark, d):
    return C.json_reports(accounts(spark, d), findings(spark, d))


def sarif_report(spark, d):
    return C.sarif(findings(spark, d))


QUERIES = {f.__name__: f for f in (check_accounting, failed_clauses, coverage_percent, severity_gate, sarif_rules, json_report, sarif_report)}

VALUES = ", ".join(f"('{i}', '{p}', '{c}', '{s}')" for i, profiles, c, s in C.entries() for p in profiles)
CHECKS = f"checks(test_id, profile, clause, status) AS (VALUES {VALUES})"
FOUND = f"""found AS (SELECT user_id AS file, event_id AS seq, event_type, event_id % 5 = 0 AS loose, ([{", ".join(repr(i) for i in ACCESSIBLE)}])[event_id % {len(ACCESSIBLE)} + 1] AS test FROM events)"""
ACCOUNTS = f"""WITH {CHECKS}, {FOUND}, files AS (SELECT DISTINCT file FROM found),
  blamed AS (SELECT DISTINCT file, test FROM found WHERE event_type = 'error' AND NOT loose),
  mates AS (SELECT DISTINCT file, regexp_extract(test, '^(.*)-[^-]*$', 1) AS clause FROM found WHERE event_type = 'error' AND loose),
  accounts AS (SELECT f.file, c.test_id, c.clause, CASE WHEN b.test IS NOT NULL THEN 'failed' WHEN c.status IN ('Deferred', 'OutOfScope') THEN 'notEvaluated'
    WHEN m.clause IS NOT NULL THEN 'inconclusive' ELSE 'passed' END AS bucket
    FROM files f CROSS JOIN (SELECT * FROM checks WHERE profile = 'ua1') c LEFT JOIN blamed b ON b.file = f.file AND b.test = c.test_id LEFT JOIN mates m ON m.file = f.file AND m.clause = c.clause)"""
SQL = {
    "check_accounting": f"{ACCOUNTS} SELECT file, bucket, count(*) AS n FROM accounts GROUP BY 1, 2",
    "failed_clauses": f"{ACCOUNTS} SELECT clause, count(DISTINCT file) AS files, count(*) AS n FROM accounts WHERE bucket = 'failed' GROUP BY 1",
    "coverage_percent": f"""WITH {CHECKS} SELECT *, CAST(floor((2000.0 * implemented + 1000 * partial + (total - out_of_scope)) / (2 * (total - out_of_scope))) AS BIGINT) AS permille FROM (
      SELECT profile, count(*) AS total, count(*) FILTER (WHERE status = 'Implemented') AS implemented, count(*) FILTER (WHERE status = 'Partial') AS partial,
      count(*) FILTER (WHERE status = 'Deferred') AS deferred, count(*) FILTER (WHERE status = 'OutOfScope') AS out_of_scope FROM checks GROUP BY 1)""",
    "severity_gate": "SELECT user_id AS file, count(*) FILTER (WHERE event_type IN ('error', 'click')) AS n, CAST(max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS exit_code FROM events GROUP BY 1",
    "sarif_rules": f"WITH {FOUND} SELECT file, CASE WHEN loose THEN 'rule:general-' || event_type ELSE 'ua:' || test END AS rule_id, min(seq) AS first_seq, count(*) AS n FROM found GROUP BY 1, 2",
}
