"""Queries of the relational operators over the driver's tables, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from leafmill.operators import relational as R


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_tables(spark, sf_dir, sql, *names):
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def revision_merge(spark, d):
    """Events of a user and kind are revisions of one object; `error` is a tombstone for the user."""
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    return R.newest(rows, ["user_id"], [F.desc("ts"), F.desc("event_id")], F.col("event_type") == "error").select("user_id", "event_id", "event_type")


def heading_skip(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", (F.length("text") % 6 + 1).cast("long").alias("level"))
    return R.skipped(rows, ["conv_id"], [F.col("turn")], F.col("level")).select("conv_id", "turn", "level", F.col("previous").cast("long").alias("previous"))


def stack_depth(spark, d):
    change = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    rows = R.depth(table(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], change)
    return rows.groupBy("user_id").agg(F.max("depth").cast("long").alias("deepest"), F.min("depth").cast("long").alias("lowest"))


def carry_forward_state(spark, d):
    value = F.when(F.col("event_type") == "purchase", F.round(F.col("value") * 100).cast("long"))
    return R.carried(table(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], value, "state").select("event_id", "state")


def unresolved_refs(spark, d):
    parts = table(spark, d, "part").where("p_size % 7 <> 0").select("p_partkey")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return R.unresolved(lines, parts, lines.l_partkey == parts.p_partkey)


def used_only(spark, d):
    suppliers = table(spark, d, "supplier").select("s_suppkey", "s_name")
    lines = table(spark, d, "lineitem").where("l_quantity > 45").select("l_suppkey")
    return R.used(suppliers, lines, suppliers.s_suppkey == lines.l_suppkey)


def range_semi(spark, d):
    events = table(spark, d, "events")
    spans = events.where("event_type = 'purchase'").select(F.col("user_id").alias("u"), F.col("ts").alias("b"), (F.col("ts") + F.expr("interval 1 hour")).alias("e"))
    clicks = events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    return R.inside(clicks, spans, F.col("user_id") == F.col("u"), F.col("ts"), F.col("b"), F.col("e")).select("event_id", "user_id")


def dup_texts(spark, d):
    return table(spark, d, "documents").groupBy(F.md5("text").alias("fingerprint")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


def definition_consistency(spark, d):
    return R.inconsistent(table(spark, d, "documents"), "source", F.col("lang")).select("source", F.col("definitions").cast("long").alias("definitions"))


def partition_private_shared(spark, d):
    edges = table(spark, d, "lineitem").where("l_quantity > 48 AND l_shipdate < '1996-01-01'").select(F.col("l_partkey").alias("p_partkey"), "l_suppkey")
    return R.reach_counts(edges, table(spark, d, "part").select("p_partkey"), "p_partkey", "l_suppkey")


LINES_A_PAGE = 40
ORDERS_A_RANGE = 1 << 14


def paginate_rows(spark, d):
    """Lines of all orders in pages of equally many.

    Orders are cut into ranges of keys: a line's number is that of the lines in earlier ranges and its place in its own,
    so no task holds more than a range. The window without a partition is over a row for each range.
    """
    orders, lines = table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    rows = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("span", F.floor(F.col("o_orderkey") / ORDERS_A_RANGE))
    before = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("span").agg(F.count("*").alias("n")).select("span", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    own = F.row_number().over(Window.partitionBy("span").orderBy("o_orderkey", "l_linenumber")) - 1
    placed = rows.withColumn("own", own).join(F.broadcast(sums), "span")
    page = F.floor((F.col("before") + F.col("own")) / LINES_A_PAGE).cast("long") + 1
    pages = F.floor((F.max("total") - 1) / LINES_A_PAGE).cast("long") + 1
    return placed.groupBy(page.alias("page")).agg(F.count("*").alias("line_count"), F.min("o_orderkey").alias("first_order"), pages.alias("pages"))


def table_autowidth(spark, d):
    """The widest value, the longest of all words and the share of the room of each column."""
    part = table(spark, d, "part").select(F.explode(F.array(*(F.struct(F.lit(c).alias("col"), F.col(f"p_{c}").alias("v")) for c in ("name", "brand", "type")))).alias("c")).select("c.col", "c.v")
    word = F.array_max(F.transform(F.split("v", " "), lambda w: F.length(w)))
    sizes = part.groupBy("col").agg(F.max(F.length("v")).cast("long").alias("widest"), F.max(word).cast("long").alias("longest_word"))
    share = F.floor(F.lit(1000) * F.col("widest") / F.sum("widest").over(Window.partitionBy())).cast("long")
    return sizes.select("col", "widest", "longest_word", share.alias("share"))


def outline_visible(spark, d):
    """Each node's descendants.

    Above a customer are a nation and its region and no more, so two steps climb the whole tree. Customers of a nation
    climb as one row; Spark's recursive queries stop with an error at 1,000,000 rows.
    """
    named = lambda letter, key: F.concat(F.lit(letter), F.col(key).cast("string"))
    nations = table(spark, d, "nation").select(named("n", "n_nationkey").alias("node"), named("r", "n_regionkey").alias("up"))
    first = table(spark, d, "customer").groupBy(named("n", "c_nationkey").alias("up")).agg(F.count("*").alias("n"))
    second = first.withColumnRenamed("up", "node").join(nations, "node").select("up", "n")
    climbed = first.union(nations.select("up", F.lit(1).cast("long").alias("n"))).union(second)
    return climbed.groupBy(F.col("up").alias("node")).agg(F.sum("n").alias("descendants"))


def width_mismatch(spark, d):
    """Orders whose total is not that of their lines.

    A sum of doubles depends on the order of its terms, and a half rounds either way with it. Lines are added in the
    order of their file, as the SQL does in one thread, however the file is split.
    """
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "_metadata.file_path", "_metadata.row_index").where("l_orderkey IS NOT NULL")
    in_order = Window.partitionBy("l_orderkey").orderBy("file_path", "row_index")
    sums = lines.select("l_orderkey", F.sum("l_extendedprice").over(in_order.rowsBetween(Window.unboundedPreceding, 0)).alias("s"), F.lead(F.lit(True)).over(in_order).alias("more"))
    difference = F.col("o_totalprice") - F.col("s")
    joined = table(spark, d, "orders").join(sums.where("more IS NULL"), F.col("o_orderkey") == F.col("l_orderkey")).where(F.abs(difference) > 2)
    return joined.select("o_orderkey", F.round(difference).cast("long").alias("difference"))


# The next ones are plain SQL that both engines read alike.
SAME = {
    "pie_slices": (
        ("customer",),
        """SELECT c_mktsegment, n, total, CAST(sum(n) OVER (ORDER BY c_mktsegment ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto,
           CAST(floor(1000 * n / total) AS BIGINT) AS permille FROM (
           SELECT c_mktsegment, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM {customer} GROUP BY c_mktsegment) t""",
    ),
    "hint_bits": (
        ("lineitem",),
        """SELECT l_returnflag, lo, hi, CASE WHEN hi = lo THEN CAST(0 AS BIGINT) ELSE CAST(length(bin(hi - lo)) AS BIGINT) END AS bits FROM (
           SELECT l_returnflag, min(l_orderkey) AS lo, max(l_orderkey) AS hi FROM {lineitem} GROUP BY l_returnflag) t""",
    ),
    "table_autowidth": (
        ("part",),
        """SELECT col, widest, longest_word, CAST(floor(1000.0 * widest / sum(widest) OVER ()) AS BIGINT) AS share FROM (
           SELECT col, CAST(max(length(v)) AS BIGINT) AS widest, CAST(max(list_max([length(w) FOR w IN string_split(v, ' ')])) AS BIGINT) AS longest_word FROM (
           SELECT 'name' AS col, p_name AS v FROM {part} UNION ALL SELECT 'brand', p_brand FROM {part} UNION ALL SELECT 'type', p_type FROM {part}) a GROUP BY col) t""",
    ),
    "paginate_rows": (
        ("orders", "lineitem"),
        """SELECT page, count(*) AS line_count, min(o_orderkey) AS first_order, max(pages) AS pages FROM (
           SELECT *, max(page) OVER () AS pages FROM (
           SELECT o_orderkey, CAST(floor((row_number() OVER (ORDER BY o_orderkey, l_linenumber) - 1) / 40) AS BIGINT) + 1 AS page
           FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey) a) t GROUP BY page""",
    ),
    "outline_siblings": (
        ("nation",),
        """SELECT n_nationkey, n_regionkey, lag(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_name) AS prev,
           lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_name) AS next,
           CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS BIGINT) AS pos FROM {nation}""",
    ),
    "caption_position": (
        ("conversations",),
        """SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS a, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b
           FROM {conversations}) t WHERE role = 'system' AND a > 1 AND b > 1""",
    ),
    "best_candidate": (
        ("part",),
        """SELECT p_brand, p_partkey, p_size FROM (SELECT p_brand, p_partkey, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS r
           FROM {part}) t WHERE r = 1""",
    ),
    "profile_union": (
        ("nation",),
        """SELECT n_nationkey FROM {nation} WHERE n_regionkey <= 1 UNION SELECT n_nationkey FROM {nation} WHERE n_regionkey = 1 OR n_nationkey < 3
           EXCEPT SELECT n_nationkey FROM {nation} WHERE n_nationkey = 2""",
    ),
    "width_mismatch": (
        ("orders", "lineitem"),
        """SELECT o_orderkey, CAST(round(o_totalprice - s) AS BIGINT) AS difference FROM {orders} JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s FROM {lineitem} GROUP BY l_orderkey) l
           ON o_orderkey = l_orderkey WHERE abs(o_totalprice - s) > 2""",
    ),
    "on_several_pages": (
        ("lineitem",),
        "SELECT l_partkey, count(DISTINCT l_orderkey) AS pages FROM {lineitem} GROUP BY l_partkey HAVING count(DISTINCT l_orderkey) >= 2",
    ),
    "reachability": (
        ("region", "nation", "customer"),
        """WITH RECURSIVE edges AS (SELECT 'r' || r_regionkey AS src, 'n' || n_nationkey AS dst FROM {region} JOIN {nation} ON r_regionkey = n_regionkey
             UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM {customer}),
           reach AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS node, 0 AS depth FROM {region}
             UNION ALL SELECT root, dst, depth + 1 FROM reach JOIN edges ON node = src WHERE depth < 8)
           SELECT root, CAST(depth AS BIGINT) AS depth, count(*) AS n FROM reach GROUP BY root, depth""",
    ),
    "outline_visible": (
        ("region", "nation", "customer"),
        """WITH RECURSIVE parent AS (SELECT 'n' || n_nationkey AS node, 'r' || n_regionkey AS up FROM {nation}
             UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM {customer}),
           climb AS (SELECT node, up FROM parent UNION ALL SELECT c.node, p.up FROM climb c JOIN parent p ON c.up = p.node)
           SELECT up AS node, count(*) AS descendants FROM climb GROUP BY up""",
    ),
    "ancestor_lang": (
        ("region", "nation", "customer"),
        """WITH RECURSIVE tree AS (SELECT 'r' || r_regionkey AS node, CAST(NULL AS STRING) AS up, r_name AS lang FROM {region}
             UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, CASE WHEN n_nationkey % 3 = 0 THEN n_name END FROM {nation}
             UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, CAST(NULL AS STRING) FROM {customer}),
           down AS (SELECT node, lang FROM tree WHERE up IS NULL UNION ALL SELECT t.node, coalesce(t.lang, d.lang) FROM down d JOIN tree t ON t.up = d.node)
           SELECT node, lang FROM down""",
    ),
    "role_map_cycle": (
        ("part",),
        """WITH RECURSIVE map AS (SELECT CAST(p_partkey % 40 AS BIGINT) AS src, CAST(min(p_partkey * 7 % 41) AS BIGINT) AS dst FROM {part} GROUP BY p_partkey % 40),
           walk AS (SELECT src AS start, dst, 1 AS steps FROM map UNION ALL SELECT start, m.dst, steps + 1 FROM walk w JOIN map m ON w.dst = m.src WHERE steps < 45)
           SELECT start, CAST(max(steps) AS BIGINT) AS steps, max(CASE WHEN dst = start THEN 1 ELSE 0 END) = 1 AS in_cycle FROM walk GROUP BY start""",
    ),
    "html_lang_title": (
        ("pages",),
        """SELECT page_id, regexp_extract(html, '<html[^>]*lang="([^"]*)"', 1) AS lang, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
           CAST((length(html) - length(replace(html, '<img', ''))) / 4 AS BIGINT) AS images FROM {pages}""",
    ),
    "html_heading_or_list": (
        ("pages",),
        """SELECT page_id, CAST((length(html) - length(replace(html, '<li', ''))) / 3 AS BIGINT) AS items, CAST((length(html) - length(replace(html, '<h1', ''))) / 3 AS BIGINT) AS headings,
           html LIKE '%<ul%' OR html LIKE '%<ol%' OR html NOT LIKE '%<li%' AS contained FROM {pages}""",
    ),
}


def same_query(name):
    tables, sql = SAME[name]

    def query(spark, d):
        return with_tables(spark, d, sql, *tables)

    query.__name__ = name
    return query


QUERIES = {f.__name__: f for f in (revision_merge, heading_skip, stack_depth, carry_forward_state, unresolved_refs, used_only, range_semi, dup_texts, definition_consistency, partition_private_shared)}
QUERIES |= {name: same_query(name) for name in SAME}
QUERIES["paginate_rows"] = paginate_rows
QUERIES["table_autowidth"] = table_autowidth
QUERIES["outline_visible"] = outline_visible
QUERIES["width_mismatch"] = width_mismatch

SQL = {
    "revision_merge": """SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
      WHERE r = 1 AND event_type <> 'error'""",
    "heading_skip": """SELECT * FROM (SELECT conv_id, turn, level, CAST(lag(level, 1, 0) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS previous FROM (
      SELECT conv_id, turn, CAST(length(text) % 6 + 1 AS BIGINT) AS level FROM conversations)) WHERE level > previous + 1""",
    "stack_depth": """SELECT user_id, CAST(max(d) AS BIGINT) AS deepest, CAST(min(d) AS BIGINT) AS lowest FROM (
      SELECT user_id, sum(CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS d FROM events) GROUP BY user_id""",
    "carry_forward_state": """SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN CAST(round(value * 100) AS BIGINT) END IGNORE NULLS)
      OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS state FROM events""",
    "unresolved_refs": "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size % 7 <> 0)",
    "used_only": "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 45)",
    "range_semi": """SELECT event_id, user_id FROM events e WHERE event_type = 'click' AND EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'purchase'
      AND p.user_id = e.user_id AND e.ts >= p.ts AND e.ts < p.ts + INTERVAL 1 HOUR)""",
    "dup_texts": "SELECT md5(text) AS fingerprint, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1",
    "definition_consistency": "SELECT source, count(DISTINCT lang) AS definitions FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1",
    "partition_private_shared": """SELECT p_partkey, CASE coalesce(n, 0) WHEN 0 THEN 'orphan' WHEN 1 THEN 'private' ELSE 'shared' END AS kind FROM part LEFT JOIN (
      SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem WHERE l_quantity > 48 AND l_shipdate < '1996-01-01' GROUP BY 1) ON p_partkey = l_partkey""",
}
SQL |= {name: sql.format(**{t: t for t in tables}).replace("AS STRING", "AS VARCHAR") for name, (tables, sql) in SAME.items()}
