"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formwork.llm.common import WORD, beside, written

_BITS = 40
_UNIT = ["doc_id", "source", "size", "draw"]


def _in_order(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``place``: from 0, by ``column``, null last.  Sorted by ranges, so no task has all rows."""
    order = F.col(column).asc_nulls_last()
    parts = written(rows.repartitionByRange(order).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return parts.withColumn("own", own).join(F.broadcast(counts), "part").withColumn("place", F.col("own") + F.col("before")).drop("part", "own", "before")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Targets for sources: ``source, source_size, target`` from ``source, source_size``.

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` of all sizes.
    A target stops at ``cap`` times its source's size and the excess is shared again by weight,
    until none is above.  Each round is an aggregate of which the driver sees three sums."""
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("place") % len(weights)).cast("int") + 1)
    rows = written(_in_order(sizes, "source").select("source", "source_size", w.alias("w"), (F.lit(float(cap)) * F.col("source_size")).alias("most")))
    words = rows.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = 0.0, -1
    while True:
        full = F.col("most") <= F.lit(level) * F.col("w") if stopped >= 0 else F.lit(False)
        n, spent, left = rows.agg(F.count_if(full), F.sum(F.when(full, F.col("most")).otherwise(0.0)), F.sum(F.when(~full, F.col("w")).otherwise(0.0))).first()
        if n == stopped or not left:
            break
        stopped, level = n, (float(share) * words - spent) / left
    target = F.least(F.col("most"), F.lit(level) * F.col("w")) if left else F.col("most")
    return rows.select("source", "source_size", target.alias("target"))


def drawn(seed: str, *of: Column) -> Column:
    """48 bits that depend on the seed and the values only."""
    text = F.concat(F.lit(seed), *(x for c in of for x in (F.lit(":"), F.coalesce(c.cast("string"), F.lit("null")))))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def _sized(docs: DataFrame, seed: str) -> tuple[Column, Column]:
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    return size, drawn(seed, F.col("doc_id"), F.coalesce("text", F.lit("")))


def wanted_copies(units: DataFrame, targets: DataFrame, cap: float, evenness: int) -> DataFrame:
    """``source, bits, source_size, target, each``: how often a document of a source whose size has
    so many bits is wanted, in expectation.

    Documents weigh ``evenness + bits``: a longer one enters the mix a little more readily.  Within
    a source ``each`` is the weight times a level at which the expected words meet the target, or
    ``cap`` where that is less; at most 64 rows a source."""
    words = units.groupBy("source", "bits").agg(F.sum(F.col("n") * F.col("size")).alias("words")).withColumn("w", F.col("bits") + evenness)
    rows = beside(words, targets, "source")
    order = Window.partitionBy("source").orderBy(F.desc("w"))
    before = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum(F.col("w") * F.col("words")).over(order.rowsBetween(0, Window.unboundedFollowing))
    level = F.when(after > 0, (F.col("target") - F.lit(float(cap)) * before) / after)
    rows = rows.withColumn("level", level).withColumn("fits", F.col("level") * F.col("w") <= F.lit(float(cap)))
    chosen = F.max(F.when(F.col("fits"), F.struct("w", "level"))).over(Window.partitionBy("source"))["level"]
    each = F.when(F.col("words") == 0, F.lit(0.0)).otherwise(F.least(F.lit(float(cap)), F.coalesce(chosen * F.col("w"), F.lit(float(cap)))))
    return rows.select("source", "bits", "source_size", "target", each.alias("each"))


def units_of_mix(docs: DataFrame, weights: tuple[float, ...], share: float, cap: float, seed: str, evenness: int) -> DataFrame:
    """Distinct documents (``doc_id, source, size, draw``) with ``n``, how many rows each is, and
    ``copies``, how often the mix takes it in all; ``source_size, target`` of its source."""
    size, draw = _sized(docs, seed)
    units = docs.select("doc_id", "source", size.alias("size"), draw.alias("draw")).groupBy(*_UNIT).agg(F.count("*").alias("n"))
    units = written(units.withColumn("bits", F.length(F.bin("size"))))
    targets = written(source_targets(units.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, share, cap))
    rows = beside(units, written(wanted_copies(units, targets, cap, evenness)), "source", "bits")
    rows = rows.withColumn("wanted", F.col("each") * F.col("n"))
    rows = rows.withColumn("certain", F.floor("wanted")).withColumn("p", F.col("wanted") - F.floor("wanted"))
    u = (F.col("draw").cast("double") + F.lit(0.5)) / F.lit(float(2**48))
    odds = F.when((F.col("p") > 0) & (F.col("size") > 0), (u / (F.lit(1.0) - u)) / (F.col("p") / (F.lit(1.0) - F.col("p"))))
    rows = rows.withColumn("rank", odds)
    place = F.floor(F.col("rank") / (F.lit(1.0) + F.col("rank")) * F.lit(float(2**_BITS))).cast("long")
    rows = written(rows.withColumn("coarse", F.shiftright(place, 30).cast("int")).withColumn("fine", (F.shiftright(place, 20) % 1024).cast("int")))
    rests = rows.groupBy("source").agg((F.first("target") - F.sum(F.col("certain") * F.col("size"))).alias("rest"))

    def crossed(some: DataFrame, by: str, needs: DataFrame, need: str, name: str) -> DataFrame:
        """``needs`` with, for each source, the range where the wanted words are reached, and the
        words before it: at most 1,024 ranges a source."""
        sums = some.filter(F.col(by).isNotNull()).groupBy("source", by).agg(F.sum("size").alias("words"))
        sums = beside(sums, needs, "source").withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy(by)))
        hit = F.when(F.col("upto") >= F.col(need), F.struct(F.col(by).alias("b"), (F.col("upto") - F.col("words")).alias("before")))
        return beside(needs, written(sums.groupBy("source").agg(F.min(hit).alias(name))), "source", how="left")

    ranges = written(crossed(rows, "coarse", written(rests), "rest", "c1").withColumn("rest2", F.col("rest") - F.col("c1.before")))
    inside = beside(rows, ranges, "source").filter(F.col("coarse") == F.col("c1.b"))
    ranges = written(crossed(inside.select("source", "fine", "size"), "fine", ranges, "rest2", "c2"))
    rows = beside(rows, ranges, "source")
    edge = F.coalesce((F.col("coarse") == F.col("c1.b")) & (F.col("fine") == F.col("c2.b")), F.lit(False))
    under = F.col("rank").isNotNull() & (F.col("c1").isNull() | (F.col("coarse") < F.col("c1.b")) | ((F.col("coarse") == F.col("c1.b")) & (F.col("c2").isNull() | (F.col("fine") < F.col("c2.b")))))
    plain = rows.filter(~edge).withColumn("chosen", F.coalesce(under, F.lit(False)))
    order = Window.partitionBy("source").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum("size").over(order), F.lit(0))
    last = rows.filter(edge).withColumn("chosen", earlier + F.col("size") / F.lit(2.0) <= F.col("rest2") - F.col("c2.before"))
    copies = F.col("certain") + F.col("chosen").cast("long")
    return plain.unionByName(last).select(*_UNIT, "n", "source_size", "target", copies.alias("copies"))


def _times(rows: DataFrame, n: Column, block: int = 1000) -> DataFrame:
    """Each row ``n`` times (none for 0), numbered from 0 in ``time``, by short arrays at any n."""
    rows = rows.withColumn("of", n).filter("of > 0").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("of") - 1) / block))))
    upto = F.least(F.col("of") - F.col("part") * block, F.lit(block)).cast("int") - 1
    return rows.withColumn("within", F.explode(F.sequence(F.lit(0), upto))).withColumn("time", F.col("part") * block + F.col("within")).drop("of", "part", "within")


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = "mix", evenness: int = 8) -> DataFrame:
    """Choose how often each document enters a mix whose sources meet their targets.

    Takes ``doc_id, text, source``; returns ``doc_id, source, size, source_size, target, copies, taken``
    with one row for each document, ``taken = copies * size``.

    A document is wanted e times (``wanted_copies``; unequal within a source, by size).  It gets
    floor(e) certain copies; for the rest it takes part in a Pareto order sample with inclusion
    probability p = e - floor(e): the documents of a source rank by (u / (1 - u)) / (p / (1 - p))
    for a random u, and the first ones are taken until the words still wanted are reached, the last
    one only if at least half of it fits.  So a source misses its target by half a document at
    most, and no document exceeds ceil(cap) copies.  u depends on seed, id and text, so reruns agree.

    No source is ordered whole: ranks fall into 1,024 ranges, one range into 1,024 again, and only
    the documents of that last range are put in order.

    Equal rows (id, source, text) are one document wanted as often as all of them are, whose copies
    are dealt out evenly; rows that share an id but not the text are documents of their own.  Null
    texts and empty ones have size 0 and are taken 0 words.  Null sources are one source, the last.
    Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    units = units_of_mix(docs.select("doc_id", "text", "source"), weights, share, cap, seed, evenness)
    rows = _times(units, F.col("n"))
    copies = F.floor(F.col("copies") / F.col("n")) + (F.col("time") < F.col("copies") % F.col("n")).cast("long")
    return rows.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = "mix", evenness: int = 8) -> DataFrame:
    """``docs`` with each document as often as ``mix`` takes it; columns keep their names.

    Of equal documents (id, source, text) each row comes as often as all of them can, and one of
    them brings what remains.  Documents without words belong to no mix by words; they go."""
    chosen = units_of_mix(docs.select("doc_id", "text", "source"), weights, share, cap, seed, evenness).filter("copies > 0 and size > 0").select(F.struct(*_UNIT).alias("unit"), "n", "copies")
    size, draw = _sized(docs, seed)
    marked = docs.select(F.struct("*").alias("row"), F.struct("doc_id", "source", size.alias("size"), draw.alias("draw")).alias("own"))
    same = (F.col("own.draw") == F.col("unit.draw")) & (F.col("own.size") == F.col("unit.size"))
    found = marked.join(chosen.hint("merge"), same & F.col("own.doc_id").eqNullSafe(F.col("unit.doc_id")) & F.col("own.source").eqNullSafe(F.col("unit.source")))
    each = _times(found, F.floor(F.col("copies") / F.col("n")))
    rest = _times(found.filter("n > 1 and copies % n > 0").dropDuplicates(["own"]), F.col("copies") % F.col("n"))
    return each.unionByName(rest).select("row.*")
