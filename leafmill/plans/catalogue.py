"""The catalogue of conformance checks, and the accounting of each check for a file and a profile."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import rules

# Numbers of the checks of each clause, by the profile that brings them in.
ARCHIVE_BASIC = """
6.1.2 1-2; 6.1.3 1-3; 6.1.4 2; 6.1.6 1-2; 6.1.7.1 1-3; 6.1.7.2 1; 6.1.8 1; 6.1.9 1; 6.1.10 1; 6.1.12 1-2; 6.1.13 1-5,7-11;
6.2.2 1-2; 6.2.3 1-3; 6.2.4.2 1-2; 6.2.4.3 2-4; 6.2.4.4 1-2; 6.2.5 1-6; 6.2.6 1; 6.2.8 1-5; 6.2.8.3 1-5; 6.2.9 1-3; 6.2.10 1-2;
6.2.11.2 1-7; 6.2.11.3.1 1; 6.2.11.3.2 1; 6.2.11.3.3 1-3; 6.2.11.4.1 1-2; 6.2.11.4.2 1-2; 6.2.11.5 1; 6.2.11.6 1-4; 6.2.11.8 1;
6.3.1 1; 6.3.2 1-2; 6.3.3 1-4; 6.4.1 1-3; 6.4.2 1-2; 6.4.3 1-3; 6.5.1 1-2; 6.5.2 1-2; 6.6.2.1 1-5; 6.6.2.3.1 1-2; 6.6.2.3.2 1;
6.6.2.3.3 1-18; 6.6.4 1-7; 6.8 2,5; 6.9 1-4; 6.10 1-2; 6.11 1
"""
ARCHIVE_UNICODE = "6.2.11.7.2 1-2"
ARCHIVE_TAGGED = "6.2.11.7.3 1; 6.7.2.2 1; 6.7.3.3 1; 6.7.3.4 1-3; 6.7.4 1"
ACCESSIBLE = """
5 1-5; 6.1 1; 6.2 1; 7.1 1-12; 7.2 2-34,36-43; 7.3 1; 7.4.2 1; 7.4.4 1-3; 7.5 1-2; 7.7 1; 7.9 1-2; 7.10 1-2; 7.11 1; 7.15 1; 7.16 1;
7.18.1 1-3; 7.18.2 1; 7.18.3 1; 7.18.4 1-2; 7.18.5 1-2; 7.18.6.2 1-2; 7.18.8 1; 7.20 1-2; 7.21.3.1 1; 7.21.3.2 1; 7.21.3.3 1-3;
7.21.4.1 1-2; 7.21.4.2 1-2; 7.21.5 1; 7.21.6 1-4; 7.21.7 1-2; 7.21.8 1
"""
OUT_OF_SCOPE = ("6.8-5", "7.16-1")

PROFILES = ("2b", "2u", "2a", "ua1")


def expanded(text: str) -> list[str]:
    """'6.1.3 1-3,5' stands for 6.1.3-1, 6.1.3-2, 6.1.3-3 and 6.1.3-5."""
    found = []
    for part in filter(None, (p.strip() for p in text.split(";"))):
        clause, numbers = part.split()
        for span in numbers.split(","):
            low, _, high = span.partition("-")
            found += [f"{clause}-{n}" for n in range(int(low), int(high or low) + 1)]
    return found


def entries() -> list[tuple[str, list[str], str, str]]:
    """(test id, profiles, clause, status) of each check; the archive profiles contain one another.

    A check is Implemented if a rule of this engine evaluates it; all others are Deferred, so they never count as passed.
    """
    known = {r.rule_id for r in rules.RULES}
    groups = ((ARCHIVE_BASIC, ["2b", "2u", "2a"]), (ARCHIVE_UNICODE, ["2u", "2a"]), (ARCHIVE_TAGGED, ["2a"]), (ACCESSIBLE, ["ua1"]))
    return [(i, profiles, i.rpartition("-")[0], "OutOfScope" if i in OUT_OF_SCOPE else "Implemented" if i in known else "Deferred") for text, profiles in groups for i in expanded(text)]


def checks(spark: SparkSession) -> DataFrame:
    """test_id, profile, clause, status: a row for each profile a check is in; a small fixed table."""
    rows = [(i, p, c, s) for i, profiles, c, s in entries() for p in profiles]
    return spark.createDataFrame(rows, "test_id string, profile string, clause string, status string")


def file_accounts(tables: dict[str, DataFrame], profiles: tuple[str, ...] = PROFILES) -> DataFrame:
    """file, profile, test_id, clause, status, bucket of every readable file and profile, by the rules over its tables.

    Checks without a rule are notEvaluated. A finding counts in the profiles its rule is for.
    """
    spark = tables["status"].sparkSession
    known = checks(spark)
    found = rules.assertions(tables, profiles).withColumnRenamed("doc_id", "file")
    parts = []
    for profile in profiles:
        files = tables["status"].where("status = 'read'").select(F.col("doc_id").alias("file"), F.lit(profile).alias("profile"))
        parts.append(accounted(known, files, found.where(F.col("profile") == profile)))
    return reduce(DataFrame.unionByName, parts)


def normal_rule(rule_id: Column) -> Column:
    """Without a prefix up to the first colon."""
    return F.regexp_replace(rule_id, "^[^:]*:", "")


def clause_of_text(clause: Column) -> Column:
    """What follows the last comma."""
    return F.trim(F.element_at(F.split(clause, ", "), -1))


def clause_of_test(test_id: Column) -> Column:
    return F.regexp_extract(test_id, r"^(.*)-[^-]*$", 1)


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "Error", 2).when(severity == "Warning", 1).otherwise(0)


def coverage(catalogue: DataFrame) -> DataFrame:
    """profile, counts by status and percent: a partial check counts half, one out of scope not at all."""
    count = lambda s: F.count_if(F.col("status") == s)
    out = catalogue.groupBy("profile").agg(F.count("*").alias("total"), count("Implemented").alias("implemented"), count("Partial").alias("partial"), count("Deferred").alias("deferred"), count("OutOfScope").alias("out_of_scope"))
    base = F.col("total") - F.col("out_of_scope")
    tenths = F.floor((2000 * F.col("implemented") + 1000 * F.col("partial") + base) / (2 * base)).cast("long")
    return out.withColumn("permille", F.when(base == 0, F.lit(0).cast("long")).otherwise(tenths))


def accounted(catalogue: DataFrame, files: DataFrame, findings: DataFrame) -> DataFrame:
    """file, profile, test_id, bucket: every check of a profile in exactly one bucket per file.

    files has file and profile; findings has file, rule_id, clause and severity. A finding whose rule is a check
    blames that check alone; any other sends the checks of its clause to `inconclusive`. First match: failed,
    notEvaluated, inconclusive, passed.
    """
    bad = findings.where(F.col("severity") == "Error").select("file", normal_rule(F.col("rule_id")).alias("rule"), clause_of_text(F.col("clause")).alias("bad_clause"))
    known = F.broadcast(catalogue.select(F.col("test_id").alias("known")).distinct())  # a fixed table of a few hundred rows
    blamed = bad.join(known, bad.rule == known.known, "left_semi").select("file", F.col("rule").alias("test_id"), F.lit(True).alias("blamed")).distinct()
    loose = bad.join(known, bad.rule == known.known, "left_anti").select("file", F.col("bad_clause").alias("clause"), F.lit(True).alias("loose")).distinct()
    out = files.join(F.broadcast(catalogue), "profile").join(blamed, ["file", "test_id"], "left").join(loose, ["file", "clause"], "left")
    bucket = F.when(F.col("blamed"), "failed").when(F.col("status").isin("Deferred", "OutOfScope"), "notEvaluated").when(F.col("loose"), "inconclusive").otherwise("passed")
    return out.select("file", "profile", "test_id", "clause", "status", bucket.alias("bucket"))


def verdicts(findings: DataFrame) -> DataFrame:
    """file, conformant: no finding is an error."""
    return findings.groupBy("file").agg((F.count_if(F.col("severity") == "Error") == 0).alias("conformant"))


def json_reports(accounts: DataFrame, findings: DataFrame) -> DataFrame:
    """file, profile, report: one JSON object with a summary, the failed checks and the findings."""
    summary = accounts.groupBy("file", "profile").agg(
        F.count("*").alias("total"), F.count_if(F.col("bucket") == "passed").alias("passed"), F.count_if(F.col("bucket") == "failed").alias("failed"),
        F.count_if(F.col("bucket") == "inconclusive").alias("inconclusive"), F.count_if(F.col("bucket") == "notEvaluated").alias("notEvaluated"),
        F.array_sort(F.collect_list(F.when(F.col("bucket") == "failed", F.col("test_id")))).alias("failedChecks"),
    )
    said = findings.groupBy("file").agg(F.count_if(F.col("severity") == "Error").alias("error"), F.count_if(F.col("severity") == "Warning").alias("warning"), F.count_if(F.col("severity") == "Info").alias("info"))
    rows = summary.join(said, "file", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    body = F.struct(
        F.lit("leafmill").alias("tool"), "file", "profile", (zero("error") == 0).alias("conformant"),
        F.struct(zero("error").alias("error"), zero("warning").alias("warning"), zero("info").alias("info"), "passed", F.col("failed").alias("failedChecks"), "inconclusive", F.col("notEvaluated").alias("deferred"), "total").alias("summary"),
        "failedChecks",
    )
    return rows.select("file", "profile", F.to_json(body).alias("report"))


def sarif(findings: DataFrame, tool: str = "leafmill") -> DataFrame:
    """file, sarif: a 2.1.0 log per file; each rule once, in the order of its first finding."""
    level = F.when(F.col("severity") == "Error", "error").when(F.col("severity") == "Warning", "warning").otherwise("note")
    rows = findings.select("file", "seq", F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message")).alias("result"))
    logs = rows.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("seq", "result"))).alias("all"))
    results = F.transform("all", lambda x: x["result"])
    rules = F.array_distinct(F.transform("all", lambda x: F.struct(x["result"]["ruleId"].alias("id"))))
    run = F.struct(F.struct(F.struct(F.lit(tool).alias("name"), rules.alias("rules")).alias("driver")).alias("tool"), results.alias("results"))
    return logs.select("file", F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("sarif"))
