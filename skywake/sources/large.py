"""One snapshot document read by many tasks.

A JSON reader takes a document whole. Here it is read as text that ends a record at every ``]``, which Spark splits among tasks
wherever it likes. What a record means depends on what comes before it: whether it begins within a text, and how deep it is nested.
Both follow from sums over the records before, taken within each split first and then over the splits, of which there are few.
A record that ends a vector ends a piece; the pieces of a split are whole vectors with what stands between them, and a vector that
two splits share is put together from theirs. Pieces are parsed by Spark's own JSON functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from skywake.sources.snapshots import vector_texts

SPLIT = ["file", "block"]
ESCAPED, TEXT = r"\\.", r'"(\\.|[^"\\])*("|$)'
HEAD, TIME = r'(?s)^\s*\{.*?"states"\s*:\s*\[', r'"time"\s*:\s*(-?\d+)'
#: Depth behind the end of a vector, and of the list of vectors.
VECTOR, LIST = 2, 1


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def _deeper(text: Column) -> Column:
    """By how many levels a record that ends in ``]`` leads deeper; ``text`` is quoted as a whole where it begins within a text."""
    bare = F.regexp_replace(text, TEXT, F.lit('""'))
    within = (_count(F.regexp_replace(text, ESCAPED, F.lit("")), '"') % 2) == 1  # it ends within a text, where ] is a letter
    return _count(bare, "[") + _count(bare, "{") - _count(bare, "}") - F.when(within, 0).otherwise(1)


def _records(spark: SparkSession, path: str) -> DataFrame:
    """The records of each split, with the number of quotes and how deep they lead, begun outside or within a text."""
    meta = F.col("_metadata")
    rows = spark.read.option("lineSep", "]").text(path).select(
        meta["file_path"].alias("file"), meta["file_modification_time"].alias("landed"), meta["file_block_start"].alias("block"),
        F.monotonically_increasing_id().alias("at"), "value",
    )
    quotes = _count(F.regexp_replace("value", ESCAPED, F.lit("")), '"')
    before = W.partitionBy(*SPLIT).orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    odd = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2
    deep = F.struct(_deeper(F.col("value")).alias("out"), _deeper(F.concat(F.lit('"'), "value")).alias("in"))
    return rows.withColumn("quotes", quotes).withColumn("odd", odd).withColumn("deep", deep)


def _begins(records: DataFrame) -> DataFrame:
    """For each split whether it begins within a text and how deep: a window over one row a split.

    A split leads deeper by one number if it begins outside a text and by another within one; which it is follows from the quotes before.
    """
    other = F.when(F.col("odd") == 0, F.col("deep.in")).otherwise(F.col("deep.out"))
    plain = F.when(F.col("odd") == 0, F.col("deep.out")).otherwise(F.col("deep.in"))
    totals = records.groupBy(*SPLIT).agg(F.sum("quotes").alias("quotes"), F.sum(plain).alias("out"), F.sum(other).alias("in"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    known = totals.withColumn("within", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    return known.withColumn("depth", F.coalesce(F.sum(F.when(F.col("within") == 0, F.col("out")).otherwise(F.col("in"))).over(before), F.lit(0))).select(*SPLIT, "within", "depth")


def _pieces(records: DataFrame, begins: DataFrame) -> DataFrame:
    """file, landed, block, piece (a number), text and ``closed`` (the depth behind it, or null) of what each split holds."""
    upto = W.partitionBy(*SPLIT).orderBy("at")
    known = records.join(begins, SPLIT)
    quoted = ((F.col("odd") + F.col("within")) % 2) == 1
    led = F.when(quoted, F.col("deep.in")).otherwise(F.col("deep.out"))
    ends_quoted = ((F.col("odd") + F.col("within") + F.col("quotes")) % 2) == 1
    deep = known.withColumn("behind", F.col("depth") + F.sum(led).over(upto)).withColumn("closed", F.when(~ends_quoted & F.col("behind").isin(VECTOR, LIST), F.col("behind")))
    numbered = deep.withColumn("piece", F.coalesce(F.sum(F.when(F.col("closed").isNotNull(), 1)).over(upto.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    held = numbered.groupBy(*SPLIT, "piece").agg(
        F.first("landed").alias("landed"), F.array_sort(F.collect_list(F.struct("at", "value"))).alias("held"), F.max("closed").alias("closed")
    )
    return held.select(*SPLIT, "landed", "piece", F.concat(F.array_join("held.value", "]"), F.lit("]")).alias("text"), "closed")


def _whole(pieces: DataFrame) -> DataFrame:
    """``pieces`` with those put together that splits share; a split has two of them at most."""
    span = W.partitionBy(*SPLIT)
    marked = pieces.withColumn("last", F.max("piece").over(span))
    inner = marked.where("piece > 0 AND closed IS NOT NULL").select("file", "landed", "block", "piece", "text", "closed")
    edge = marked.where("piece = 0 OR closed IS NULL")
    # a chain of pieces goes on up to the next that is closed
    order = W.partitionBy("file").orderBy("block", "piece").rowsBetween(W.unboundedPreceding, -1)
    chained = edge.withColumn("chain", F.coalesce(F.sum(F.when(F.col("closed").isNotNull(), 1)).over(order), F.lit(0)))
    joined = chained.groupBy("file", "chain").agg(
        F.first("landed").alias("landed"), F.min(F.struct("block", "piece")).alias("place"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "piece", "text"))), lambda p: p["text"]), "").alias("text"), F.max("closed").alias("closed"),
    )
    return inner.unionByName(joined.select("file", "landed", "place.block", "place.piece", "text", "closed"))


def scan_large_documents(spark: SparkSession, path: str) -> DataFrame:
    """``snapshots.scan_state_snapshots`` of files that hold one document ``{"time": .., "states": [..]}`` each, in any layout, of any size.

    ``position`` orders the elements of a document as their places do, but doesn't number them. A file that is no such
    document gives no rows.
    """
    records = _records(spark, path)
    pieces = _whole(_pieces(records, _begins(records)))
    # what a list holds stands in pieces that end a vector or the list; what is closed later is something else
    first = W.partitionBy("file").orderBy("block", "piece").rowsBetween(W.unboundedPreceding, -1)
    outside = pieces.where((F.col("closed").isNull()) | (F.col("closed") == LIST) | F.col("text").rlike(HEAD))  # a few a document
    listed = outside.withColumn("open", F.coalesce(F.max(F.col("closed") == LIST).over(first), F.lit(False))).where("open").select("file", "block", "piece")
    times = outside.groupBy("file").agg(F.max(F.regexp_extract("text", TIME, 1).try_cast("bigint")).alias("time"))
    inside = pieces.where("closed IS NOT NULL").join(F.broadcast(listed), ["file", "block", "piece"], "left_anti")
    body = F.regexp_replace(F.regexp_replace("text", HEAD, F.lit("")), r"^\s*,", F.lit(""))
    kept = F.when(F.col("closed") == LIST, F.regexp_replace(body, r"\]$", F.lit(""))).otherwise(body)
    elements = F.from_json(F.concat(F.lit("["), kept, F.lit("]")), "array<string>")
    each = inside.join(times, "file").select("file", "landed", "time", "block", "piece", F.posexplode(elements).alias("place", "element"))
    return each.select(
        F.coalesce("time", F.unix_seconds("landed")).alias("time"), "landed", "file", F.struct("block", "piece", "place").alias("position"), vector_texts(F.col("element")).alias("vec")
    )
