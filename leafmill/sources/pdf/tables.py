"""Files to tables: one pass of the parser over binary files, then views."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "doc_id string, item string, rev int, num long, gen int, kind string, value string, offset long, container long, idx long, raw binary, decoded binary, complete boolean, recovered boolean"
ARROW = pa.schema([
    ("doc_id", pa.string()), ("item", pa.string()), ("rev", pa.int32()), ("num", pa.int64()), ("gen", pa.int32()), ("kind", pa.string()), ("value", pa.string()), ("offset", pa.int64()),
    ("container", pa.int64()), ("idx", pa.int64()), ("raw", pa.binary()), ("decoded", pa.binary()), ("complete", pa.bool_()), ("recovered", pa.bool_()),
])
PORTION = 4096


def files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """path, length and content of the *.pdf files of a folder, a glob or one file."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "length", "content")


def from_bytes(spark: SparkSession, named: dict[str, bytes]) -> DataFrame:
    return spark.createDataFrame([(k, len(v), bytearray(v)) for k, v in named.items()], "path string, length long, content binary")


def parsed(content: DataFrame) -> DataFrame:
    """One row per item of each file; write it once and take the views from what was written."""

    def run(batches):
        from leafmill.sources.pdf.document import rows_of

        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                held = []
                for row in rows_of(path, data.as_py() or b""):
                    held.append({"doc_id": path, **row})
                    if len(held) == PORTION:
                        yield pa.RecordBatch.from_pylist(held, ARROW)
                        held = []
                yield pa.RecordBatch.from_pylist(held, ARROW)

    return content.select("path", "content").mapInArrow(run, SCHEMA)


def views(items: DataFrame) -> dict[str, DataFrame]:
    """The tables by name."""
    of = lambda item: items.where(F.col("item") == item)
    variant = F.try_parse_json("value")
    fonts = of("page").select("doc_id", F.col("idx").alias("page_no"), F.explode(F.from_json(F.get_json_object("value", "$.Resources.Font"), "map<string,string>")).alias("res_name", "font"))
    selected = of("op").where("kind = 'Tf'").select("doc_id", F.col("idx").alias("page_no"), F.substring(F.get_json_object("value", "$[0]"), 2, 200).alias("res_name"), F.lit(True).alias("used")).distinct()
    annotations = of("page").select("doc_id", F.col("idx").alias("page_no"), F.posexplode(F.from_json(F.get_json_object("value", "$.Annots"), "array<string>")).alias("idx", "dict"))
    return {
        "status": of("status").select("doc_id", F.col("kind").alias("status"), F.col("value").alias("detail"), F.col("offset").alias("length")),
        "errors": of("error").select("doc_id", F.col("kind").alias("part"), F.col("num").alias("obj_num"), F.col("value").alias("detail")),
        "trailers": of("trailer").select("doc_id", "value"),
        "catalogs": of("catalog").select("doc_id", "value"),
        "revisions": of("revision").select("doc_id", F.col("num").alias("rev"), F.col("offset").alias("xref_offset")),
        "xref": of("xref").select("doc_id", "rev", F.col("num").alias("obj_num"), "gen", "kind", "offset", F.col("idx").alias("source"), (F.col("kind") == "free").alias("is_free")),
        "objects": of("object").select("doc_id", F.col("num").alias("obj_num"), "gen", "kind", variant.alias("value"), F.col("value").alias("json"), "offset", "container"),
        "streams": of("object").where("kind = 'stream'").select("doc_id", F.col("num").alias("obj_num"), F.col("value").alias("json"), "raw", "decoded", F.col("complete").alias("fully_decoded"), "recovered"),
        "refs": of("ref").select("doc_id", F.col("num").alias("src_obj"), F.col("value").alias("path"), F.col("idx").alias("dst_obj"), F.col("gen").alias("dst_gen")),
        "pages": of("page").select("doc_id", F.col("idx").alias("page_no"), F.col("num").alias("obj_num"), F.col("value").alias("json")),
        "fonts": fonts.join(selected, ["doc_id", "page_no", "res_name"], "left").withColumn("used", F.coalesce("used", F.lit(False))),
        "annotations": annotations,
        "content_ops": of("op").select("doc_id", F.col("idx").alias("page_no"), F.col("num").alias("seq"), F.col("kind").alias("operator"), F.col("value").alias("operands")),
    }
