"""Queries of the file reader, the rules and the symbols. Small files are made from the rows of `nation`."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import barcodes
from leafmill.operators import rules
from leafmill.sources.pdf import tables, write


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read(spark, d):
    """The tables of a file for each nation; every third has no language."""
    n = F.col("n_nationkey")
    rows = table(spark, d, "nation").select(
        F.concat(F.lit("n"), n.cast("string")).alias("path"), F.col("n_name").alias("title"), F.when(n % 3 != 0, "en").alias("language"),
        F.array(F.col("n_name"), F.concat(F.lit("(region) "), F.col("n_regionkey").cast("string"))).alias("lines"),
    )
    return tables.views(tables.parsed(write.text_files(rows)))


def pdf_text_shows(spark, d):
    ops = read(spark, d)["content_ops"].where("operator = 'Tj'")
    return ops.select("doc_id", F.substring(F.get_json_object("operands", "$[0]"), 2, 1000).alias("text"))


def pdf_object_kinds(spark, d):
    return read(spark, d)["objects"].groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


def pdf_reach(spark, d):
    """Which object each reference leads to."""
    t = read(spark, d)
    return t["refs"].join(t["objects"].select("doc_id", F.col("obj_num").alias("dst_obj"), "kind"), ["doc_id", "dst_obj"]).groupBy("src_obj", "dst_obj", "kind").agg(F.count("*").alias("files"))


def pdf_assertions(spark, d):
    return rules.assertions(read(spark, d)).groupBy("profile", "rule_id").agg(F.countDistinct("doc_id").alias("files"))


def ean13_modules(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("code"))
    return barcodes.encoded(rows, "code", "ean13").select("p_partkey", F.col("symbol")[0].alias("modules"))


def code128_symbol(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_name")
    symbol = F.transform("symbol", lambda x: x.cast("int"))
    return barcodes.encoded(rows, "c_name", "code128").select("c_custkey", F.array_join("symbol", "").alias("runs"), F.aggregate(symbol, F.lit(0), lambda a, x: a + x).cast("long").alias("width"))


def code39_symbol(spark, d):
    rows = table(spark, d, "nation").select("n_nationkey", F.upper("n_name").alias("name"))
    return barcodes.encoded(rows, "name", "code39").select("n_nationkey", F.array_join("symbol", "").alias("runs"), "error")


def itf_symbol(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.lpad(F.col("o_orderkey").cast("string"), 14, "0").alias("code"))
    return barcodes.encoded(rows, "code", "itf").select("o_orderkey", F.array_join("symbol", "").alias("runs"))


def qr_symbol(spark, d):
    rows = table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("https://id.gs1.org/"), "n_name").alias("text"))
    return barcodes.encoded(rows, "text", "qr").select("n_nationkey", "symbol", F.size("symbol").cast("long").alias("modules"))


QUERIES = {f.__name__: f for f in (pdf_text_shows, pdf_object_kinds, pdf_reach, pdf_assertions, ean13_modules, code128_symbol, code39_symbol, itf_symbol, qr_symbol)}

LEFT = "['0001101','0011001','0010011','0111101','0100011','0110001','0101111','0111011','0110111','0001011']"
SQL = {
    "pdf_text_shows": "SELECT 'n' || n_nationkey AS doc_id, unnest([n_name, '(region) ' || n_regionkey]) AS text FROM nation",
    "pdf_object_kinds": "SELECT 'n' || n_nationkey AS doc_id, k AS kind, CAST(c AS BIGINT) AS n FROM nation, (VALUES ('dict', 5), ('stream', 1)) v(k, c)",
    "pdf_reach": """SELECT CAST(s AS BIGINT) AS src_obj, CAST(t AS BIGINT) AS dst_obj, k AS kind, (SELECT count(*) FROM nation) AS files
      FROM (VALUES (1, 2, 'dict'), (2, 3, 'dict'), (3, 2, 'dict'), (3, 4, 'stream'), (3, 5, 'dict')) v(s, t, k)""",
    "pdf_assertions": """SELECT p AS profile, r AS rule_id, count(*) AS files FROM nation, (VALUES
      ('2b', '6.2.11.4.1-1'), ('2u', '6.2.11.4.1-1'), ('2a', '6.2.11.4.1-1'), ('2b', '6.6.2.1-1'), ('2u', '6.6.2.1-1'), ('2a', '6.6.2.1-1'), ('2a', '6.7.2.2-1'),
      ('ua1', '7.1-8'), ('ua1', '7.1-10'), ('ua1', '7.1-11'), ('ua1', '6.2-1'), ('ua1', '7.2-34'), ('ua1', '7.21.4.1-1')) v(p, r)
      WHERE r <> '7.2-34' OR n_nationkey % 3 = 0 GROUP BY 1, 2""",
    # The first digit is 0, so all left digits have the same parity; right digits are their complements.
    "ean13_modules": f"""SELECT p_partkey, '101' || list_aggregate([({LEFT})[CAST(code[i] AS INTEGER) + 1] FOR i IN range(2, 8)], 'string_agg', '') || '01010'
      || list_aggregate([translate(({LEFT})[CAST(code[i] AS INTEGER) + 1], '01', '10') FOR i IN range(8, 14)], 'string_agg', '') || '101' AS modules FROM (
      SELECT p_partkey, c || CAST((10 - list_sum([CAST(c[i] AS INTEGER) * (CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END) FOR i IN range(1, 13)]) % 10) % 10 AS INTEGER) AS code FROM (
      SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 12, '0') AS c FROM part))""",
}
