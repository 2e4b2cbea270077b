"""Queries of the symbol and text kernels over the driver's tables, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import checks, gs1, text


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def padded(column: str, n: int):
    return F.lpad(F.col(column).cast("string"), n, "0")


def gtin13_from_partkey(spark, d):
    code = padded("p_partkey", 12)
    return table(spark, d, "part").select("p_partkey", F.concat(code, checks.gtin_check(code, 12).cast("string")).alias("gtin"))


def itf14_from_orderkey(spark, d):
    code = padded("o_orderkey", 13)
    return table(spark, d, "orders").select("o_orderkey", F.concat(code, checks.gtin_check(code, 13).cast("string")).alias("itf14"))


def ean5_from_price(spark, d):
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    code = F.lpad((cents % 100000).cast("string"), 5, "0")
    check = checks.five_digit_check(code)
    return table(spark, d, "part").select("p_partkey", code.alias("code"), check.cast("long").alias("checksum"), checks.parity(checks.FIVE_DIGIT_PARITY, check).alias("parity"))


def ean2_parity(spark, d):
    code = F.col("p_size") % 100
    return table(spark, d, "part").select("p_partkey", checks.parity(checks.TWO_DIGIT_PARITY, (code % 4).cast("int")).alias("parity"))


def upce_canonical(spark, d):
    six = F.lpad((F.col("p_partkey") * 7 % 1000000).cast("string"), 6, "0")
    return table(spark, d, "part").select("p_partkey", checks.upc_e(six).alias("upce"), checks.upc_a_body(six).alias("upca_body"))


def code39_check(spark, d):
    value = F.upper(F.replace(F.col("p_brand"), F.lit("#"), F.lit("")))
    return table(spark, d, "part").select("p_partkey", checks.mod43(value).cast("long").alias("checksum"))


def code128_mod103(spark, d):
    return table(spark, d, "customer").select("c_custkey", checks.code128_b(F.col("c_name")).cast("long").alias("checksum"))


def element_string():
    return F.concat(F.lit("(01)"), F.lpad(F.col("l_partkey").cast("string"), 14, "0"), F.lit("(17)"), F.date_format("l_shipdate", "yyMMdd"), F.lit("(10)L"), F.col("l_orderkey").cast("string"))


def gs1_build(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", element_string().alias("gs1"))


def gs1_parse(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.posexplode(gs1.parse(element_string())).alias("pos", "e"))
    return rows.select("l_orderkey", "l_linenumber", F.col("pos").cast("long").alias("pos"), F.col("e.ai").alias("ai"), F.col("e.value").alias("value"))


def gs1_payload(spark, d):
    elements = gs1.parse(F.concat(F.lit("(10)L"), F.col("l_orderkey").cast("string"), F.lit("(01)"), F.lpad(F.col("l_partkey").cast("string"), 14, "0"), F.lit("(21)S"), F.col("l_suppkey").cast("string")))
    forms = gs1.bound(elements, lambda e: F.struct(gs1.payload(e).alias("payload"), gs1.readable(e).alias("readable"), gs1.digital_link(e).alias("link")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.inline(F.array(forms)))


def digital_link_path(spark, d):
    return table(spark, d, "documents").select("doc_id", gs1.path_segment(F.col("text")).alias("segment"))


def sa_parity(spark, d):
    return table(spark, d, "customer").select("c_custkey", checks.exclusive_or(F.col("c_name")).cast("long").alias("parity"))


def list_markers(spark, d):
    n = F.col("n_nationkey") + 1
    return table(spark, d, "nation").select("n_nationkey", F.concat(n.cast("string"), F.lit(".")).alias("decimal"), F.concat(text.alphabetic(n), F.lit(".")).alias("alpha"), F.concat(text.roman(n), F.lit(".")).alias("roman"))


def filters_asciihex(spark, d):
    coded = F.concat(F.lower(F.hex("r_name")), F.lit(">"))
    body = F.regexp_replace(F.substring_index(coded, ">", 1), r"[\x00\t\n\f\r ]", "")
    even = F.when(F.length(body) % 2 == 1, F.concat(body, F.lit("0"))).otherwise(body)
    return table(spark, d, "region").select("r_regionkey", coded.alias("coded"), F.unhex(even).cast("string").alias("plain"))


def doc_fingerprint(spark, d):
    return table(spark, d, "documents").select("doc_id", text.fingerprint(F.col("lang"), F.col("source"), F.col("n_chars").cast("string"), F.col("text")).alias("fingerprint"))


def word_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(text.words(F.col("text"))).cast("long").alias("n_words"))


def word_wrap(spark, d):
    lines = text.wrap_text(F.col("p_name"), 12)
    rows = table(spark, d, "part").select("p_partkey", F.posexplode(lines).alias("pos", "line"))
    return rows.select("p_partkey", (F.col("pos") + 1).cast("long").alias("line_no"), "line")


def word_wrap_documents(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(text.wrap_text(F.col("text"), 40)).alias("pos", "line"))
    return rows.select("doc_id", (F.col("pos") + 1).cast("long").alias("line_no"), "line")


QUERIES = {
    f.__name__: f
    for f in (
        gtin13_from_partkey, itf14_from_orderkey, ean5_from_price, ean2_parity, upce_canonical, code39_check, code128_mod103, gs1_build, gs1_parse,
        gs1_payload, digital_link_path, sa_parity, list_markers, filters_asciihex, doc_fingerprint, word_tokens, word_wrap, word_wrap_documents,
    )
}

CHECK = "CAST((10 - list_sum([CAST(substr({code}, i, 1) AS INTEGER) * (CASE WHEN ({n} - i) % 2 = 0 THEN 3 ELSE 1 END) FOR i IN range(1, {n} + 1)]) % 10) % 10 AS INTEGER)"
SEGMENT = "replace(url_encode({0}), '+', '%20')"
SQL = {
    "gtin13_from_partkey": f"SELECT p_partkey, code || {CHECK.format(code='code', n=12)} AS gtin FROM (SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 12, '0') AS code FROM part)",
    "itf14_from_orderkey": f"SELECT o_orderkey, code || {CHECK.format(code='code', n=13)} AS itf14 FROM (SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 13, '0') AS code FROM orders)",
    "ean5_from_price": """SELECT p_partkey, code, CAST(c AS BIGINT) AS checksum,
      (['GGLLL','GLGLL','GLLGL','GLLLG','LGGLL','LLGGL','LLLGG','LGLGL','LGLLG','LLGLG'])[CAST(c + 1 AS INTEGER)] AS parity FROM (
      SELECT p_partkey, code, list_sum([CAST(substr(code, i, 1) AS INTEGER) * (CASE WHEN i % 2 = 1 THEN 3 ELSE 9 END) FOR i IN range(1, 6)]) % 10 AS c FROM (
      SELECT p_partkey, lpad(CAST(CAST(round(p_retailprice * 100) AS BIGINT) % 100000 AS VARCHAR), 5, '0') AS code FROM part))""",
    "ean2_parity": "SELECT p_partkey, (['LL','LG','GL','GG'])[p_size % 100 % 4 + 1] AS parity FROM part",
    "upce_canonical": f"""SELECT p_partkey, '0' || six || {CHECK.format(code='body', n=11)} AS upce, body AS upca_body FROM (
      SELECT p_partkey, six, '0' || CASE WHEN six[6] IN ('0','1','2') THEN six[1:2] || six[6] || '0000' || six[3:5]
        WHEN six[6] = '3' THEN six[1:3] || '00000' || six[4:5] WHEN six[6] = '4' THEN six[1:4] || '00000' || six[5] ELSE six[1:5] || '0000' || six[6] END AS body
      FROM (SELECT p_partkey, lpad(CAST(p_partkey * 7 % 1000000 AS VARCHAR), 6, '0') AS six FROM part))""",
    "code39_check": """SELECT p_partkey, CAST(list_sum([instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ-. $/+%', v[i]) - 1 FOR i IN range(1, len(v) + 1)]) % 43 AS BIGINT) AS checksum
      FROM (SELECT p_partkey, upper(replace(p_brand, '#', '')) AS v FROM part)""",
    "code128_mod103": "SELECT c_custkey, CAST((104 + list_sum([i * (ascii(c_name[i]) - 32) FOR i IN range(1, len(c_name) + 1)])) % 103 AS BIGINT) AS checksum FROM customer",
    "gs1_build": "SELECT l_orderkey, l_linenumber, '(01)' || lpad(CAST(l_partkey AS VARCHAR), 14, '0') || '(17)' || strftime(l_shipdate, '%y%m%d') || '(10)L' || l_orderkey AS gs1 FROM lineitem",
    "gs1_parse": """SELECT l_orderkey, l_linenumber, CAST(i AS BIGINT) AS pos, a[i + 1] AS ai, v[i + 1] AS value FROM (
      SELECT *, unnest(range(len(a))) AS i FROM (SELECT l_orderkey, l_linenumber, regexp_extract_all(g, '\\((\\d{2,4})\\)([^(]*)', 1) AS a, regexp_extract_all(g, '\\((\\d{2,4})\\)([^(]*)', 2) AS v FROM (
      SELECT l_orderkey, l_linenumber, '(01)' || lpad(CAST(l_partkey AS VARCHAR), 14, '0') || '(17)' || strftime(l_shipdate, '%y%m%d') || '(10)L' || l_orderkey AS g FROM lineitem)))""",
    "gs1_payload": """SELECT l_orderkey, l_linenumber, '10L' || l_orderkey || chr(29) || '01' || p || '21S' || l_suppkey AS payload,
      '(10)L' || l_orderkey || '(01)' || p || '(21)S' || l_suppkey AS readable, 'https://id.gs1.org/01/' || p || '/10/L' || l_orderkey || '/21/S' || l_suppkey AS link
      FROM (SELECT *, lpad(CAST(l_partkey AS VARCHAR), 14, '0') AS p FROM lineitem)""",
    "digital_link_path": "SELECT doc_id, url_encode(text) AS segment FROM documents",
    "sa_parity": "SELECT c_custkey, CAST(list_reduce([ascii(c_name[i]) FOR i IN range(1, len(c_name) + 1)], lambda a, b: xor(a, b)) AS BIGINT) AS parity FROM customer",
    "list_markers": """SELECT n_nationkey, n || '.' AS decimal, chr(CAST(96 + n AS INTEGER)) || '.' AS alpha,
      repeat('x', CAST(n // 10 AS INTEGER)) || (['', 'i','ii','iii','iv','v','vi','vii','viii','ix'])[n % 10 + 1] || '.' AS roman FROM (SELECT n_nationkey, n_nationkey + 1 AS n FROM nation)""",
    "filters_asciihex": "SELECT r_regionkey, lower(hex(r_name)) || '>' AS coded, CAST(unhex(hex(r_name)) AS VARCHAR) AS plain FROM region",
    "doc_fingerprint": "SELECT doc_id, md5(concat_ws('|', lang, source, CAST(n_chars AS VARCHAR), text)) AS fingerprint FROM documents",
    "word_tokens": r"SELECT doc_id, CAST(len([w FOR w IN regexp_split_to_array(text, '[\s\x0B\x85\x{2028}\x{2029}\x{3000}]+') IF w <> '']) AS BIGINT) AS n_words FROM documents",
    "word_wrap": """WITH RECURSIVE w AS (SELECT p_partkey, [x FOR x IN string_split(p_name, ' ') IF x <> ''] AS ws FROM part),
      r AS (SELECT p_partkey, ws, 1 AS i, 1 AS line_no, ws[1] AS line FROM w WHERE len(ws) > 0 UNION ALL
        SELECT p_partkey, ws, i + 1, CASE WHEN len(line) + 1 + len(ws[i + 1]) <= 12 THEN line_no ELSE line_no + 1 END,
               CASE WHEN len(line) + 1 + len(ws[i + 1]) <= 12 THEN line || ' ' || ws[i + 1] ELSE ws[i + 1] END FROM r WHERE i < len(ws))
      SELECT p_partkey, CAST(line_no AS BIGINT) AS line_no, max_by(line, i) AS line FROM r GROUP BY p_partkey, line_no""",
}
