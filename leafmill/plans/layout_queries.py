"""Queries of the layout kernels: orders are documents of lines, conversations tables of cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import text
from leafmill.operators import layout


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paginate_elements(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return layout.paginated(rows, "conv_id", "turn", F.col("n"), 1000)


def justified_lines(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.posexplode(text.wrap(F.col("p_name"), 12)).alias("pos", "line"))
    return rows.select("p_partkey", F.col("pos").cast("long").alias("pos"), layout.justified(F.col("line"), 12).alias("j")).select("p_partkey", "pos", "j.gaps", "j.extra")


def solved_columns(spark, d):
    cells = table(spark, d, "part").select(F.explode(F.array(F.struct(F.lit("name").alias("col"), F.col("p_name").alias("v")), F.struct(F.lit("type").alias("col"), F.col("p_type").alias("v")), F.struct(F.lit("brand").alias("col"), F.col("p_brand").alias("v")))).alias("c"), "p_size")
    return layout.column_widths(cells.select("p_size", "c.col", "c.v"), "p_size", "col", F.col("v"), 30)


QUERIES = {f.__name__: f for f in (paginate_elements, justified_lines, solved_columns)}

SQL = {
    "paginate_elements": """WITH RECURSIVE e AS (SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS h, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
      r AS (SELECT conv_id, turn, h, i, CAST(1 AS BIGINT) AS page, 1 + greatest(CAST(ceil(h / 1000) AS BIGINT) - 1, 0) AS last, h - 1000 * greatest(CAST(ceil(h / 1000) AS BIGINT) - 1, 0) AS used FROM e WHERE i = 1
        UNION ALL SELECT e.conv_id, e.turn, e.h, e.i, CASE WHEN r.used + e.h <= 1000 OR r.used = 0 THEN r.last ELSE r.last + 1 END,
          CASE WHEN r.used + e.h <= 1000 OR r.used = 0 THEN r.last ELSE r.last + 1 END + greatest(CAST(ceil(e.h / 1000) AS BIGINT) - 1, 0),
          CASE WHEN r.used + e.h <= 1000 THEN r.used + e.h ELSE e.h - 1000 * greatest(CAST(ceil(e.h / 1000) AS BIGINT) - 1, 0) END
        FROM r JOIN e ON e.conv_id = r.conv_id AND e.i = r.i + 1)
      SELECT conv_id, turn, h AS height, page, max(last) OVER (PARTITION BY conv_id) AS pages FROM r""",
    "justified_lines": """WITH RECURSIVE w AS (SELECT p_partkey, [x FOR x IN string_split(p_name, ' ') IF x <> ''] AS ws FROM part),
      r AS (SELECT p_partkey, ws, 1 AS i, 1 AS n, ws[1] AS line FROM w WHERE len(ws) > 0 UNION ALL
        SELECT p_partkey, ws, i + 1, CASE WHEN len(line) + 1 + len(ws[i + 1]) <= 12 THEN n ELSE n + 1 END,
               CASE WHEN len(line) + 1 + len(ws[i + 1]) <= 12 THEN line || ' ' || ws[i + 1] ELSE ws[i + 1] END FROM r WHERE i < len(ws)),
      l AS (SELECT p_partkey, CAST(n - 1 AS BIGINT) AS pos, max_by(line, i) AS line FROM r GROUP BY p_partkey, n)
      SELECT p_partkey, pos, CAST(length(line) - length(replace(line, ' ', '')) AS BIGINT) AS gaps,
        CASE WHEN line LIKE '% %' THEN CAST(floor(1000 * (12 - length(line)) / (length(line) - length(replace(line, ' ', '')))) AS BIGINT) ELSE 0 END AS extra FROM l""",
    "solved_columns": """WITH c AS (SELECT p_size, 'name' AS col, p_name AS v FROM part UNION ALL SELECT p_size, 'type', p_type FROM part UNION ALL SELECT p_size, 'brand', p_brand FROM part),
      s AS (SELECT p_size, col, CAST(max(list_max([len(w) FOR w IN string_split(v, ' ')])) AS BIGINT) AS least, CAST(max(len(v)) AS BIGINT) AS most FROM c GROUP BY 1, 2)
      SELECT *, CAST(CASE WHEN sum(most) OVER t <= 30 THEN most WHEN sum(most - least) OVER t = 0 THEN least
        ELSE least + floor(greatest(30 - sum(least) OVER t, 0) * (most - least) / sum(most - least) OVER t) END AS BIGINT) AS width FROM s WINDOW t AS (PARTITION BY p_size)""",
}
