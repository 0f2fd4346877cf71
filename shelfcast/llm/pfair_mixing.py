"""Operator 10, mixing sources to target weights by Pfair scheduling, in built-in functions only.

Rows of a source form blocks of BLOCK_ROWS, one per slot. In the ideal schedule every source is served at all times in
proportion to its weight among the sources that still have blocks; by virtual time v source i has had min(v w_i, n_i)
blocks and the slots used are their sum. Block k is released at the slot the ideal schedule begins it (floor) and due by
the slot it ends it (ceil), both from the real weights. Of the released blocks the one that is due first gets the slot,
so at every slot each source is within one block of the ideal schedule, however many rows and sources there are.

The slots are laid out span by span in parallel. Which released blocks have not been served yet at the border of two spans
follows from the windows alone (see ``_waits``), so no pass over all slots is needed: the work is that of the blocks and of
one row per source and border, and a span has as many slots as there are sources, SPAN_SLOTS at least.
Every row appears exactly once. Weights default to each source's share of rows to the power of TEMPERATURE; sources
without a positive weight are served when the others have run out.

Row numbers within a source come from range partitions with offsets, so a source with a third of all rows is spread over
all tasks. The sources must fit one array (tens of thousands).

Defined results: a null source is a source of its own. Ties and repeated rows are numbered in the order of doc_id and of
a hash of the other columns; each has a place of its own. Empty tables give empty results. Names starting with ``_mix``
are reserved and raise; other extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.ranking import with_global_row_number
from shelfcast.session import scalar, written_table

BLOCK_ROWS = 32
SPAN_SLOTS = 256  # at least
SPAN_GROUP = 1024
TEMPERATURE = 0.7
_NO_WEIGHT = 1e-9  # of all weights: a share that comes to nothing while others have blocks
_HALVINGS = 20  # the last source runs out in epoch 2 ** 20 at most
_ROUNDING = 1e-6  # of a slot; below it a time is taken as the whole slot it is close to


def source_weights(counts: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(source, n_blocks, weight) of ``counts`` (source, n_rows), shares of 1; weights: (source, weight)."""
    if weights is None:
        named = counts.withColumn("weight", F.pow(F.col("n_rows"), F.lit(TEMPERATURE)))
    else:
        right = weights.select(F.col("source").alias("_of"), F.col("weight").cast("double").alias("weight"))
        named = counts.join(right, F.col("source").eqNullSafe(F.col("_of")), "left").drop("_of")
    real = (F.col("weight") > 0) & (F.col("weight") < float("inf"))
    named = written_table(named.withColumn("weight", F.when(real, F.col("weight")).otherwise(0.0)))
    total = scalar(named, F.greatest(F.sum("weight"), F.lit(1e-300)))
    share = F.greatest(F.col("weight") / total, F.lit(_NO_WEIGHT))
    return named.select("source", F.ceil(F.col("n_rows") / BLOCK_ROWS).alias("n_blocks"), share.alias("weight"))


def _let(value: Column, then) -> Column:
    """``then`` of ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _slots_at(v: Column, epochs: Column) -> Column:
    """Slots that the ideal schedule has used by virtual time ``v``; the epoch is found by halving steps."""
    steps = F.array(*[F.lit(1 << j) for j in reversed(range(_HALVINGS))])

    def nearer(at: Column, step: Column) -> Column:
        return F.when(F.try_element_at(epochs, at + step)["v"] <= v, at + step).otherwise(at)

    # Epoch 1 begins at 0, so it is the last one when no later one has begun.
    epoch = F.element_at(epochs, F.aggregate(steps, F.lit(1), nearer))
    return epoch["base"] + v * epoch["rate"]


def block_windows(weighted: DataFrame) -> DataFrame:
    """(source, number, block, ready, due, width) of every block of ``weighted`` (source, n_blocks, weight).

    Number is the source's place in the order of names and breaks ties; width is the number of slots of a span.
    """
    sources = F.array_sort(F.collect_list(F.struct("source", "n_blocks", "weight"))).alias("sources")
    one = weighted.agg(sources, F.sum("n_blocks").alias("n_slots")).filter("n_slots > 0")
    # Epochs of the ideal schedule, one more each time a source runs out: slots(v) = base + v * rate.
    ends = F.array_sort(F.transform("sources", lambda s: F.struct((s["n_blocks"] / s["weight"]).alias("v"), s["n_blocks"].alias("n"), s["weight"].alias("w"))))
    one = one.withColumn("ends", ends)
    sums = lambda values, zero: F.aggregate(values, F.array(zero), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    bases = sums(F.transform("ends", lambda e: e["n"]), F.lit(0).cast("long"))
    # Added up from the last to run out, so small weights keep their digits.
    rates = F.reverse(sums(F.reverse(F.transform("ends", lambda e: e["w"])), F.lit(0.0)))
    starts = F.concat(F.array(F.lit(0.0)), F.transform("ends", lambda e: e["v"]))
    one = one.withColumn("epochs", F.arrays_zip(starts.alias("v"), bases.alias("base"), rates.alias("rate"))).drop("ends")
    one = one.withColumn("width", F.greatest(F.size("sources"), F.lit(SPAN_SLOTS)).cast("long"))
    # A row of at least as many blocks as there are epochs, so the epochs that go along add a bounded cost to a block.
    each = written_table(one).select("epochs", "width", F.posexplode("sources").alias("number", "of"))
    runs = each.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of.n_blocks") - 1, 4 * F.col("width"))).alias("first"))
    runs = _dealt(runs, "number", "first")

    def window(block: Column) -> Column:
        ready = F.floor(_slots_at(block / F.col("of.weight"), F.col("epochs")) + _ROUNDING)
        due = F.ceil(_slots_at((block + 1) / F.col("of.weight"), F.col("epochs")) - _ROUNDING)
        return F.struct(block.alias("block"), ready.alias("ready"), due.alias("due"))

    blocks = F.sequence(F.col("first"), F.least(F.col("first") + 4 * F.col("width"), F.col("of.n_blocks")) - 1)
    placed = runs.select(F.col("of.source").alias("source"), "number", "width", F.explode(F.transform(blocks, window)).alias("at"))
    return placed.select("source", "number", "at.*", "width")


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """One task per shuffle partition: few bytes but much work a row, which merging by size would put into one task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _backlogs(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(span, ready, own) and (span, low): the fewest blocks that are released but not served at any later time of the span.

    Before slot a, as many blocks wait as were released before a less a, whichever they are. Between releases the
    number falls, so its low points lie at the release times and at the span's end.
    """
    counts = written_table(windows.groupBy("span", "ready", "width").agg(F.count(F.lit(1)).alias("n")))
    # Blocks released before each span: sums within groups of spans, and of the groups.
    spans = counts.groupBy("span", "width").agg(F.sum("n").alias("n")).withColumn("group", F.expr(f"span div {SPAN_GROUP}"))
    groups = spans.groupBy("group").agg(F.sum("n").alias("n"))
    earlier = F.sum("n").over(Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1))  # a row per SPAN_GROUP spans
    groups = groups.select("group", F.coalesce(earlier, F.lit(0)).alias("of_groups"))
    within = F.sum("n").over(Window.partitionBy("group").orderBy("span").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("within", F.coalesce(within, F.lit(0))).join(groups, "group")
    base = F.col("of_groups") + F.col("within")
    spans = spans.select("span", base.alias("base"), (base + F.col("n") - (F.col("span") + 1) * F.col("width")).alias("at_end"))
    by_time = Window.partitionBy("span").orderBy("ready")
    before = F.coalesce(F.sum("n").over(by_time.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    points = counts.withColumn("before", before).join(spans, "span")
    points = points.withColumn("low", F.col("base") + F.col("before") - F.col("ready"))
    later = F.min("low").over(by_time.rowsBetween(1, Window.unboundedFollowing))
    points = written_table(points.select("span", "ready", "low", "at_end", F.least("at_end", later).alias("own")))
    lows = points.groupBy("span").agg(F.least(F.min("low"), F.min("at_end")).alias("low"))
    return points.select("span", "ready", "own"), lows


def _waits(windows: DataFrame) -> DataFrame:
    """(number, block, n_waits): at how many span borders a released block has not been served yet; none if no row.

    Only a block whose window holds the border can wait there, one a source. Of the blocks released before a time, no
    more can still wait at the border than the smallest backlog between the two. Earliest deadline first leaves, within
    these nested limits, the blocks that are due last. So each border is worked out by itself, without a pass over the slots.
    """
    own, lows = _backlogs(windows)
    over = windows.filter("due > (span + 1) * width").join(own, ["span", "ready"])
    borders = F.sequence(F.col("span") + 1, F.expr("(due - 1) div width"))
    met = over.select("number", "block", "ready", "due", "own", (F.col("span") + 1).alias("first"), F.explode(borders).alias("border"))
    # A border further on adds the lows of the whole spans between.
    met = met.join(lows.select((F.col("span") + 1).alias("border"), "low"), "border")
    low = F.when(F.col("border") == F.col("first"), F.col("own")).otherwise(F.col("low"))
    limit = F.min(low).over(Window.partitionBy("number", "block").orderBy("border"))
    met = met.select("border", F.struct("due", "number", "block", "ready", limit.alias("limit")).alias("one"))
    lists = _dealt(met, "border").groupBy("border").agg(F.array_sort(F.collect_list("one")).alias("by_due"))
    by_time = F.array_sort(F.transform("by_due", lambda x, i: F.struct(x["ready"].alias("ready"), (i + 1).alias("rank"), x["limit"].alias("limit"))))

    def keep(waiting: Column, one: Column) -> Column:
        more = F.concat(waiting, F.array(one["rank"]))
        # Limits grow with the release time, so there is one too many at most.
        return F.when(F.size(waiting) < one["limit"], more).otherwise(F.array_remove(more, F.array_min(more)))

    waiting = F.aggregate(by_time, F.array().cast("array<int>"), keep)
    left = lists.select(F.explode(F.transform(waiting, lambda r: F.element_at("by_due", r))).alias("one"))
    return left.groupBy("one.number", "one.block").agg(F.count(F.lit(1)).alias("n_waits"))


def block_slots(weighted: DataFrame) -> DataFrame:
    """(source, block, slot) of every block of ``weighted`` (source, n_blocks, weight); slots count from 0 without gaps."""
    windows = written_table(block_windows(weighted).withColumn("span", F.expr("ready div width")))
    waits = _waits(windows).withColumnsRenamed({"number": "of", "block": "of_block"})
    served = windows.join(waits, F.expr("number = of and block = of_block"), "left")
    served = served.withColumn("span", F.col("span") + F.coalesce("n_waits", F.lit(0)))
    one = F.struct("due", "number", "block", "ready", "source")
    spans = _dealt(served.select("span", "width", one.alias("one")), "span")
    spans = spans.groupBy("span", "width").agg(F.array_sort(F.collect_list("one")).alias("blocks"))
    begin = F.col("span") * F.col("width")

    def take(state: Column, block: Column) -> Column:
        # Blocks in the order of their deadlines, each at the first free slot from its release, are the same schedule
        # as slots in order, each with the released block that is due first.
        released = F.try_element_at(F.filter(state["free"], lambda s: s >= block["ready"]), F.lit(1))
        return _let(
            F.coalesce(released, F.element_at(state["free"], 1)),
            lambda s: F.struct(F.array_remove(state["free"], s).alias("free"), F.concat(state["slots"], F.array(s)).alias("slots")),
        )

    free = F.sequence(begin, begin + F.size("blocks") - 1)
    slots = F.aggregate("blocks", F.struct(free.alias("free"), F.array().cast("array<bigint>").alias("slots")), take)["slots"]
    placed = spans.select(F.explode(F.arrays_zip(F.col("blocks").alias("one"), slots.alias("slot"))).alias("at"))
    return placed.select("at.one.source", "at.one.block", "at.slot")


def mix_order(docs: DataFrame, weights: DataFrame | None = None, source: str = "source") -> DataFrame:
    """(doc_id, key, source, block, slot, place) of every row; key tells different rows of one doc_id apart."""
    others = [F.col(c) for c in docs.columns if c not in ("doc_id", source)]
    key = F.xxhash64(*others) if others else F.lit(0).cast("long")
    rows = docs.select(F.col("doc_id"), key.alias("key"), F.col(source).cast("string").alias("source"))
    # Range partitions of (source, doc_id, key), numbered through; a source's first number is taken off.
    numbered = with_global_row_number(rows, [F.col("source"), F.col("doc_id"), F.col("key")], "number")
    numbered = written_table(numbered)
    counts = numbered.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.min("number").alias("first"))
    counts = written_table(counts)
    weighted = source_weights(counts.select("source", "n_rows"), weights)
    slots = written_table(block_slots(weighted).withColumnsRenamed({"source": "of", "block": "of_block"}))
    firsts = counts.select(F.col("source").alias("_named"), "first")
    ranked = numbered.join(firsts, F.col("source").eqNullSafe(F.col("_named"))).drop("_named")
    ranked = ranked.withColumn("place", F.col("number") - F.col("first")).withColumn("block", F.expr(f"place div {BLOCK_ROWS}"))
    met = ranked.join(slots, F.col("source").eqNullSafe(F.col("of")) & F.expr("block = of_block"))
    return met.select("doc_id", "key", "source", "block", "slot", F.expr(f"place % {BLOCK_ROWS}").alias("place"))


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, source: str = "source") -> DataFrame:
    """The rows of ``docs`` in mixed order: range partitions of the schedule, sorted; written files keep that order.

    Equal rows are one row before the shuffle, and get their own places back from the order. So a row that a third of
    the table repeats is no large group, and its copies keep to their source's turns.
    """
    if taken := [c for c in docs.columns if c.startswith("_mix")]:
        raise ValueError(f"names starting with _mix are reserved: {taken}")
    others = [F.col(c) for c in docs.columns if c not in ("doc_id", source)]
    key = F.xxhash64(*others) if others else F.lit(0).cast("long")
    names = ["_mix_id", "_mix_no_id", "_mix_key", "_mix_source", "_mix_no_source"]

    def keys(content: Column, of: Column) -> list[Column]:
        # Plain keys in the place of null-safe comparisons, so that grouping and join share one shuffle.
        ids = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("doc_id").isNull()]
        return [c.alias(n) for c, n in zip([*ids, content, F.coalesce(of, F.lit("")), of.isNull()], names)]

    different = docs.select(*keys(key, F.col(source).cast("string")), F.struct(*docs.columns).alias("_mix_row"))
    different = different.groupBy(*names).agg(F.first("_mix_row").alias("_mix_row"))
    order = mix_order(docs, weights, source).select(*keys(F.col("key"), F.col("source")), F.struct("slot", "place").alias("_mix_at"))
    placed = different.join(order, names).select("_mix_at", "_mix_row.*")
    return placed.repartitionByRange("_mix_at").sortWithinPartitions("_mix_at").select(*docs.columns)


def op10_pfair_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return mix_order(docs).select("doc_id", "source", "block", "slot", "place")
