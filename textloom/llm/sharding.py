"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard has `virtual` points on a ring of `cells` cells. A document's hash gives its place on the ring, and its home is the next
point clockwise. A shard's load is bounded by ceil or floor of (1 + slack) * n / shards, dealt to its points by their arcs. What
overflows a full point continues clockwise to the next one. With slack 0 (the query) every point ends exactly full, so the shards'
row counts differ by at most one, whatever the data: the law is `rows`. With more slack fewer rows leave their home.

The overflow around the ring needs no loop over rows. Going clockwise the points are a queue: what has arrived up to a point less
what the points so far can hold, never below zero, is carried on. That recursion has a closed form by running sums and minima
(S - min S), evaluated over the cells' counts, a table whose size depends on `cells`, `shards` and `virtual` alone. Rows leave in the
order in which they arrive (their rank around the ring), so a point holds an interval of ranks. A row's rank is its cell's offset
plus its place in the cell; cells are many and even, so no task gets more than its share.

Defined cases. Null text has size 8 and the checksum of the empty text. Rows without an id are placed by their checksum; repeated
rows share a place on the ring and take consecutive ranks. An empty table gives an empty result. The input's other columns are
dropped, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.storage import written

SHARDS, VIRTUAL, CELLS = 24, 64, 1 << 14


def ring_hash(key: Column) -> Column:
    """A place on the ring from 0 to 2^60 - 1."""
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def cell_of(at: Column, cells: int) -> Column:
    return F.floor(at / F.lit((1 << 60) // cells)).cast("long")


def ring(spark: SparkSession, shards: int, virtual: int, cells: int) -> DataFrame:
    """point (its place in clockwise order, from 0), cell, shard, arcs (of the shard's points up to this one) and all_arcs."""
    points = (
        spark.range(shards * virtual)
        .select((F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).cast("int").alias("replica"))
        .withColumn("at", ring_hash(F.concat_ws(":", F.lit("shard"), "shard", "replica")))
    )
    placed = points.select((F.row_number().over(Window.orderBy("at", "shard")) - 1).cast("long").alias("point"), cell_of(F.col("at"), cells).alias("cell"), "shard")
    # cells from the point before; a little for each point, so that no shard is without an arc
    around, own = Window.orderBy("point"), Window.partitionBy("shard")
    last = F.max("cell").over(Window.partitionBy())
    arc = placed.withColumn("arc", 64 * (F.col("cell") - F.coalesce(F.lag("cell").over(around), last - cells)) + 1)
    return arc.select("point", "cell", "shard", F.sum("arc").over(own.orderBy("point")).alias("arcs"), F.sum("arc").over(own).alias("all_arcs"))


def spans(offsets: DataFrame, points: DataFrame, shards: int, slack: float) -> DataFrame:
    """One row a point that holds rows: shard, the place `from` of its first row in the order in which rows leave, slot0 (the slot of its first row) and shift (how far that order is ahead of the rank)."""
    # a cell's home is the first point not before it; cells behind the last point belong to the first one
    marks = offsets.select("cell", "n", F.lit(None).cast("long").alias("point"), F.lit(0).alias("kind")).unionByName(points.select("cell", F.lit(0).cast("long").alias("n"), "point", F.lit(1).alias("kind")))
    ahead = Window.orderBy("cell", "kind", "point").rowsBetween(0, Window.unboundedFollowing)
    homes = marks.select("n", "kind", F.first("point", ignorenulls=True).over(ahead).alias("home")).where("kind = 0")
    arrived = homes.groupBy(F.coalesce("home", F.lit(0)).alias("home")).agg(F.sum("n").alias("arrived"), F.sum(F.when(F.col("home").isNull(), F.col("n"))).alias("behind"))
    # a shard's capacity is dealt to its points by the arc that each has; whole rows, and none is lost
    own = Window.partitionBy("shard").orderBy("point")
    room = F.expr("of_shard * arcs div all_arcs")
    rooms = (
        points.join(arrived, points.point == arrived.home, "left")
        .select("point", "shard", "arcs", "all_arcs", F.coalesce("arrived", F.lit(0)).alias("arrived"), F.coalesce("behind", F.lit(0)).alias("behind"))
        .withColumn("load", F.ceil(F.sum("arrived").over(Window.partitionBy()) * F.lit(1.0 + slack)).cast("long"))
        .withColumn("of_shard", F.floor(F.col("load") / shards) + (F.col("shard") < F.col("load") % shards).cast("long"))
        .withColumn("room", room - F.lag(room, 1, 0).over(own))
    )
    # twice around: on the second lap what the last points carried on has arrived at the first ones
    clockwise = Window.orderBy("lap", "point")
    held = (
        rooms.withColumn("lap", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn("s", F.sum(F.col("arrived") - F.col("room")).over(clockwise))
        .withColumn("carry", F.col("s") - F.least(F.lit(0), F.min("s").over(clockwise)))
        .withColumn("carry_in", F.lag("carry", 1, 0).over(clockwise))
        .where("lap = 1")
        .withColumn("holds", F.col("carry_in") + F.col("arrived") - F.col("carry"))
    )
    so_far = F.sum("holds").over(Window.orderBy("point"))
    of_shard = F.sum("holds").over(Window.partitionBy("shard").orderBy("point"))
    # the first point gets what is carried around to it, then the rows behind the last point, then those before itself
    shift = F.first(F.col("carry_in") + F.col("behind")).over(Window.orderBy("point").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return held.select("shard", "holds", (so_far - F.col("holds")).alias("from"), (of_shard - F.col("holds")).alias("slot0"), shift.alias("shift")).where("holds > 0")


def pieces(offsets: DataFrame, held: DataFrame) -> DataFrame:
    """One row a cell that has rows: first (its rows' first rank), shift, total, and pieces (at, until, shard, slot of the row at `at`): both tables cut at each other's borders, so there are fewer pieces than cells and points together."""
    shift = held.agg(F.max("shift").alias("shift"))
    cells = offsets.where("n > 0").crossJoin(F.broadcast(shift)).withColumn("at", (F.col("first") + F.col("shift")) % F.col("total"))
    # a cell that reaches beyond the last row goes on at 0
    starts = cells.select("at", "cell").unionByName(cells.where("at + n > total").select(F.lit(0).cast("long").alias("at"), "cell"))
    empty = lambda kind: F.lit(None).cast(kind)
    cuts = starts.select("at", "cell", empty("int").alias("shard"), empty("long").alias("from"), empty("long").alias("slot0")).unionByName(held.select(F.col("from").alias("at"), empty("long").alias("cell"), "shard", "from", "slot0"))
    last = lambda c: F.last(c, ignorenulls=True).over(Window.orderBy("at").rangeBetween(Window.unboundedPreceding, 0)).alias(c)
    cut = cuts.select("at", last("cell"), last("shard"), last("from"), last("slot0")).distinct()
    cut = cut.select("at", F.lead("at").over(Window.orderBy("at")).alias("until"), "cell", "shard", (F.col("slot0") + F.col("at") - F.col("from")).alias("slot"))
    by_cell = cut.groupBy("cell").agg(F.collect_list(F.struct("at", "until", "shard", "slot")).alias("pieces"))
    return by_cell.join(cells.select("cell", "first", "shift", "total"), "cell")


def shard(docs: DataFrame, shards: int = SHARDS, virtual: int = VIRTUAL, cells: int = CELLS, slack: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (gapless from 0 in each shard) and grown_shard (null: the law isn't `key`)."""
    spark, text = docs.sparkSession, F.coalesce(F.col(text_col), F.lit(""))
    rows = (
        docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
        .withColumn("at", ring_hash(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("crc:"), F.col("text_crc32").cast("string")))))
        .withColumn("cell", cell_of(F.col("at"), cells))
    )
    # at most `cells` counts; written, as five small windows read them
    counts = written(rows.groupBy("cell").agg(F.count("*").alias("n")), "cells")
    around = Window.orderBy("cell")
    offsets = counts.select("cell", "n", (F.sum("n").over(around) - F.col("n")).alias("first"), F.sum("n").over(Window.partitionBy()).alias("total"))
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("cell").orderBy("at", "doc_id", "text_crc32", "size")) - 1)
    where = written(pieces(offsets, spans(offsets, ring(spark, shards, virtual, cells), shards, slack)), "pieces")
    at = (F.col("first") + F.col("place") + F.col("shift")) % F.col("total")
    piece = F.element_at(F.filter("pieces", lambda p: (p["at"] <= F.col("y")) & (p["until"].isNull() | (F.col("y") < p["until"]))), 1)
    return (
        placed.join(F.broadcast(where), "cell")
        .withColumn("y", at)
        .withColumn("piece", piece)
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("piece.shard").alias("shard"), (F.col("piece.slot") + F.col("y") - F.col("piece.at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
