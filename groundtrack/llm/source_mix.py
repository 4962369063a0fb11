"""Mixing sources to target weights by a low-discrepancy source schedule.

Size of a document: its words. Sources in code-point order, null last, weigh 3, 1, 2, repeating, and
share 150 % of all words; no target exceeds twice its source's words, and what that leaves over is
shared again by weight (in closed form: sources in the order of cap / weight meet a rising level).

1. Each source's documents, shuffled by a hash of their ids, form one stream of words, cut into
   equal blocks of BLOCK words.
2. Slot i of the schedule has the golden-ratio point i * phi mod 1 (on a lattice of 2**31 points, so
   that it is exact for any i); the cumulative weights of the sources map it to a source. So every
   stretch of the schedule holds the sources in nearly the target proportions.
3. Slots are ranked within their source; rank r takes block r modulo the source's blocks. A source
   gets the slots that its target needs: surplus ranks are left out, the few ranks that the points
   have not reached are added at the end, the last one takes only the words still due. So a
   source's words come to its target, and no document is taken more than twice.
4. Slots and the documents' pieces of blocks are joined on source and block.

Ranks and stream places are prefix sums over chunks of slots and buckets of documents, so a source
that holds most rows is spread over all tasks. Null text or text without words: size 0, taken 0.
Null doc_id counts as one more id. Rows that repeat a doc_id each are mixed and give a row. Columns
other than doc_id, text and source are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groundtrack.llm.common import cut, fresh

#: Words in a block.
BLOCK = 128
WEIGHTS = (3, 1, 2)
#: Slots in a chunk and documents in a bucket, within which rows are ranked.
CHUNK, BUCKET = 1 << 14, 4096
#: phi - 1 on a lattice of 2**31 points, odd.
STEP = 1327217885
CELLS = 1024


def sizes(docs: DataFrame) -> DataFrame:
    words = F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce(words, F.lit(0).cast("long")).alias("size"))


def targets(sized: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row for each source: its place, weight, words, target, and how blocks and slots follow.

    One row a source is all that these unpartitioned windows hold."""
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = by.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(F.col("place") - 1, F.lit(len(WEIGHTS))).cast("int") + 1).cast("double")
    by = by.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("ratio", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy()
    before = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything) * F.lit(share)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    by = by.withColumn("level", level)
    by = by.withColumn("held", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "place", "level"))).over(everything)["level"])
    by = by.withColumn("target", F.when(F.col("held").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("held") * F.col("weight"))))
    words = F.floor("target").cast("long")
    by = by.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size")).cast("long")).otherwise(F.lit(0)))
    by = by.withColumn("due", words - F.col("passes") * F.col("source_size"))
    blocks = F.ceil(F.col("source_size") / F.lit(BLOCK)).cast("long")
    by = by.withColumn("blocks", blocks).withColumn("need", F.col("passes") * blocks + F.ceil(F.col("due") / F.lit(BLOCK)).cast("long"))
    return by.select("source", "place", "source_size", "target", "passes", "due", "blocks", "need")


def schedule(table: DataFrame) -> DataFrame:
    """place (of a source) and rank of each slot that is used."""
    spark = table.sparkSession
    slots = table.agg(F.sum("need")).first()[0] or 0
    upto = F.sum("need").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    lines = table.where("need > 0").select("place", "need", (upto / F.lit(max(1, slots))).alias("hi"))
    lines = lines.withColumn("lo", F.lag("hi", 1, 0.0).over(Window.orderBy("place")))
    cell = F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.lit(CELLS - 1).cast("long"), F.floor(F.col("hi") * CELLS))))
    cells = lines.select("place", "lo", "hi", cell.alias("cell"))
    point = F.pmod(F.pmod(F.col("id"), F.lit(1 << 31)) * F.lit(STEP), F.lit(1 << 31)) / F.lit(float(1 << 31))
    slot = spark.range(slots).select("id", point.alias("point")).withColumn("cell", F.floor(F.col("point") * CELLS))
    slot = slot.join(cells, "cell").where("point >= lo and point < hi").select("id", "place", F.floor(F.col("id") / CHUNK).alias("chunk"))
    per_chunk = cut(slot.groupBy("place", "chunk").agg(F.count("*").alias("n")))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("place").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chunks = per_chunk.select("place", "chunk", before.alias("before"))
    rank = F.row_number().over(Window.partitionBy("place", "chunk").orderBy("id")) - 1
    ranked = slot.select("place", "chunk", rank.alias("rank")).join(chunks, ["place", "chunk"]).select("place", (F.col("rank") + F.col("before")).alias("rank"))
    reached = lines.join(per_chunk.groupBy("place").agg(F.sum("n").alias("n")), "place", "left")
    added = reached.withColumn("n", F.coalesce("n", F.lit(0))).where("n < need").select("place", F.explode(F.sequence(F.col("n"), F.col("need") - 1)).alias("rank"))
    used = ranked.join(lines.select("place", "need"), "place").where("rank < need").select("place", "rank")
    return used.unionByName(added)


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of each document."""
    sized = cut(sizes(docs))
    table = cut(targets(sized))
    slots = schedule(table).join(table.select("place", "passes", "due", "blocks"), "place")
    turn, block = F.floor(F.col("rank") / F.col("blocks")), F.col("rank") % F.col("blocks")
    slots = slots.select("place", block.alias("block"), (turn < F.col("passes")).cast("long").alias("whole"), (F.col("due") - block * BLOCK).alias("part"))
    slots = slots.groupBy("place", "block").agg(F.sum("whole").alias("times"), F.max(F.when(F.col("whole") == 0, F.least("part", F.lit(BLOCK)))).alias("part"))

    buckets = max(1, -(-sized.count() // BUCKET))
    order = F.xxhash64("doc_id", F.lit(20_031))
    known = sized.join(table.select("source", "place", "source_size", "target"), sized["source"].eqNullSafe(table["source"])).drop(table["source"])
    rows = known.withColumn("order", order).withColumn("bucket", F.pmod("order", F.lit(buckets)))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = rows.groupBy("place", "bucket").agg(F.sum("size").alias("words")).select("place", "bucket", before.alias("before"))
    within = Window.partitionBy("place", "bucket").orderBy("order", "doc_id", "size")
    streamed = rows.select("*", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.row_number().over(within).alias("nth"))
    streamed = cut(streamed.join(starts, ["place", "bucket"]).withColumn("at", F.col("upto") - F.col("size") + F.col("before")).drop("order", "upto", "before"))

    first, last = F.floor(F.col("at") / BLOCK), F.floor((F.col("at") + F.col("size") - 1) / BLOCK)
    pieces = streamed.where("size > 0").select("place", "bucket", "nth", "at", "size", F.explode(F.sequence(first, last)).alias("block"))
    a = F.greatest("at", F.col("block") * BLOCK) - F.col("block") * BLOCK
    b = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * BLOCK) - F.col("block") * BLOCK
    pieces = pieces.select("place", "bucket", "nth", "block", a.alias("a"), b.alias("b")).join(slots, ["place", "block"])
    words = F.col("times") * (F.col("b") - F.col("a")) + F.greatest(F.lit(0), F.least(F.col("b"), F.coalesce("part", F.lit(0))) - F.col("a"))
    taken = pieces.groupBy("place", "bucket", "nth").agg(F.sum(words).alias("taken"))
    return streamed.join(taken, ["place", "bucket", "nth"], "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def take(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes, all their columns, with mix_size and mix_taken (words that
    it takes, repeats counted). Rows of one doc_id, null among them, share the most that one takes."""
    key = fresh(docs, "_doc_id")
    taken = mixed(docs).groupBy(F.col("doc_id").alias(key)).agg(F.max("size").alias("mix_size"), F.max("taken").alias("mix_taken")).where("mix_taken > 0")
    docs = docs.drop("mix_size", "mix_taken")
    return docs.join(taken, docs["doc_id"].eqNullSafe(F.col(key))).drop(key)


def query(spark, sf_dir: str) -> DataFrame:
    """op2: words that the mix takes of each document."""
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source")
