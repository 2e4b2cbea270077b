"""Layout kernels: pagination, justification, column widths. Input rows are elements of a document in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def paginated(rows: DataFrame, document: str, order: str, height: Column, room: int) -> DataFrame:
    """Adds page (from 1): greedy filling, an element that doesn't fit begins a page; pages is the document's number.

    What is higher than a page has pages of its own, as many as it takes. A document's heights are one array,
    bounded by its number of elements.
    """
    items = rows.groupBy(document).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), height.cast("long").alias("h")))).alias("items"))
    start = F.struct(F.lit(1).cast("long").alias("page"), F.lit(0).cast("long").alias("used"), F.array().cast("array<long>").alias("pages"))

    def place(state, item):
        fits = state["used"] + item["h"] <= room
        begin = F.when(fits | (state["used"] == 0), state["page"]).otherwise(state["page"] + 1)
        more = F.greatest(F.ceil(item["h"] / room) - 1, F.lit(0)).cast("long")
        used = F.when(fits, state["used"] + item["h"]).otherwise(item["h"] - more * room)
        return F.struct((begin + more).alias("page"), used.cast("long").alias("used"), F.concat(state["pages"], F.array(begin)).alias("pages"))

    done = items.withColumn("at", F.aggregate("items", start, place))
    out = done.select(document, F.col("at.page").alias("pages"), F.inline(F.arrays_zip(F.col("items").alias("item"), F.col("at.pages").alias("page"))))
    return out.select(document, F.col("item.o").alias(order), F.col("item.h").alias("height"), "page", "pages")


def justified(line: Column, width: int) -> Column:
    """(gaps, extra) of a line: how many gaps it has and what each gets to fill the width, in thousandths."""
    gaps = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))
    extra = F.when(gaps > 0, F.floor(1000 * (F.lit(width) - F.length(line)) / gaps)).otherwise(F.lit(0)).cast("long")
    return F.struct(gaps.cast("long").alias("gaps"), extra.alias("extra"))


def column_widths(cells: DataFrame, table: str, column: str, text: Column, room: int) -> DataFrame:
    """least, most and width of each column: the widest word, the widest text, and a share of the room between.

    Where all texts fit, columns have their widest; else what is left over the least widths is shared by the
    difference of most and least.
    """
    word = F.array_max(F.transform(F.split(text, " "), lambda w: F.length(w)))
    sizes = cells.groupBy(table, column).agg(F.max(word).cast("long").alias("least"), F.max(F.length(text)).cast("long").alias("most"))
    whole = Window.partitionBy(table)
    spare, wish = F.lit(room) - F.sum("least").over(whole), F.sum(F.col("most") - F.col("least")).over(whole)
    share = F.when(F.sum("most").over(whole) <= room, F.col("most")).when(wish == 0, F.col("least")).otherwise(F.col("least") + F.floor(F.greatest(spare, F.lit(0)) * (F.col("most") - F.col("least")) / wish))
    return sizes.withColumn("width", share.cast("long"))
