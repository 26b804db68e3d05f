"""Sorted chunk index: pages, page look-ups, merge pages, page utility."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(fps: DataFrame) -> DataFrame:
    """(fp, pos): the place of each distinct fp in byte order, from 0, without a window over all rows.

    Fingerprints are evenly distributed, so their first bytes cut the order into ranges; places are those within the
    range plus the sizes of the ranges before (65 536 at most).
    """
    own = fps.select("fp").distinct().withColumn("range", F.substring("fp", 1, 4))
    sizes = own.groupBy("range").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    local = own.withColumn("local", F.row_number().over(Window.partitionBy("range").orderBy("fp")) - 1)
    return local.join(F.broadcast(before), "range").select("fp", (F.col("local") + F.col("before")).cast("bigint").alias("pos"))


def paged(fps: DataFrame, entries: int) -> DataFrame:
    return ranked(fps).withColumn("page", F.floor(F.col("pos") / entries).cast("bigint"))


def page_ends(pages: DataFrame) -> DataFrame:
    return pages.groupBy("page").agg(F.min("fp").alias("first_fp"), F.max("fp").alias("last_fp"), F.count("*").alias("entries"))


def page_lookup(probes: DataFrame, pages: DataFrame) -> DataFrame:
    """Each probe fp with the page that has its lower bound, the last page if it is above all.

    An as-of join by union: index entries and probes are ordered together, and the next entry's page is taken. The
    order is cut by the first bytes of fp; a probe after the last entry of its range takes the first page of the next.
    """
    both = probes.select("fp", F.lit(None).cast("bigint").alias("page")).distinct().unionByName(pages.select("fp", "page")).withColumn("range", F.substring("fp", 1, 4))
    heads = pages.groupBy(F.substring("fp", 1, 4).alias("range")).agg(F.min("page").alias("head"))
    ranges = both.select("range").distinct().join(heads, "range", "left")
    # Windows run downwards: a frame to the end of its partition would be taken anew for each row.
    after = Window.orderBy(F.col("range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("next", F.last("head", True).over(after)).select("range", "next")  # 65 536 rows at most
    last = pages.agg(F.max("page").alias("last"))
    onward = Window.partitionBy("range").orderBy(F.col("fp").desc(), F.col("page").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("here", F.last("page", True).over(onward))
    out = found.where(F.col("page").isNull()).join(F.broadcast(ranges), "range").crossJoin(F.broadcast(last))
    return out.select("fp", F.coalesce("here", "next", "last").alias("page"))


def generation_pages(trace: DataFrame, entries: int) -> DataFrame:
    """(g, fp, page): the index before each generation g, of the distinct fingerprints of earlier ones."""
    first = trace.groupBy("fp").agg(F.min("generation").alias("since"))
    ends = trace.select(F.col("generation").alias("g")).distinct()
    have = first.join(F.broadcast(ends), F.col("since") < F.col("g")).select("g", "fp", F.substring("fp", 1, 4).alias("range"))
    sizes = have.groupBy("g", "range").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("g").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    local = have.withColumn("local", F.row_number().over(Window.partitionBy("g", "range").orderBy("fp")) - 1)
    return local.join(before, ["g", "range"]).select("g", "fp", F.floor((F.col("local") + F.col("before")) / entries).cast("bigint").alias("page"))


def sorted_index_stats(stream: DataFrame, entries: int) -> DataFrame:
    """Statistics of one sorted stream (generation, pos, fp) with a flush at the end of each generation, no false positives."""
    w = Window.partitionBy("stream").orderBy("generation", "pos")
    first = stream.groupBy("fp").agg(F.min(F.struct("generation", "pos")).alias("first"))
    rows = stream.withColumn("consec", F.col("fp") == F.lag("fp", 1, "0" * 24).over(w)).join(first, "fp")
    rows = rows.withColumn("is_new", F.col("first") == F.struct("generation", "pos"))
    pages = generation_pages(stream, entries).withColumnRenamed("g", "generation")
    rows = rows.join(pages, ["generation", "fp"], "left").withColumn("disk", F.when(~F.col("consec"), F.col("page")))
    before = Window.partitionBy("stream").orderBy("generation", "pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("current", F.coalesce(F.last("disk", True).over(before), F.lit(0)))
    count = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0)).cast("bigint")
    return rows.groupBy("generation").agg(
        F.count("*").alias("chunks"),
        count(F.col("is_new") & ~F.col("consec")).alias("unique_chunks"),
        count(~F.col("is_new")).alias("redundant_chunks"),
        count(F.col("consec")).alias("consecutive"),
        count(~F.col("consec") & ~F.col("is_new") & F.col("page").isNull()).alias("mem_hits"),
        count(F.col("disk") == F.col("current")).alias("disk_hits"),
        count(F.col("disk") != F.col("current")).alias("disk_misses"),
    )


def stream_index_stats(trace: DataFrame, entries: int) -> DataFrame:
    """sorted_index_stats of each stream (generation, stream, fp), run in order of fingerprints on an index of its own.

    Equal chunks are neighbours there, so no window over the rows is needed: all but the first of a generation are
    consecutive, and so is the first if the generation before ended with it; as pages ascend, a page is missed once in a
    generation, but not if it is the current one at the start. For the same reason no chunk is found in memory.
    """
    counts = trace.groupBy("stream", "fp", "generation").agg(F.count("*").alias("n"))
    each = counts.groupBy("stream", "fp").agg(F.min("generation").alias("since"), F.map_from_entries(F.collect_list(F.struct("generation", "n"))).alias("counts"))
    ends = trace.select("generation").distinct()
    rows = each.join(F.broadcast(ends), F.col("since") <= F.col("generation")).select("generation", "stream", "fp", F.col("since") == F.col("generation"), F.expr("try_element_at(counts, generation)"), F.substring("fp", 1, 2)).toDF("generation", "stream", "fp", "is_new", "n", "range")
    known = (~F.col("is_new")).cast("int")
    # Ranks within ranges of a stream's index, plus the sizes of the ranges before (256 at most).
    place = Window.partitionBy("generation", "stream", "range").orderBy("fp")
    rows = rows.withColumn("local", F.sum(known).over(place.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1)
    sizes = rows.groupBy("generation", "stream", "range").agg(F.sum(known).alias("size"), F.min(F.when(F.col("n").isNotNull(), F.col("fp"))).alias("first_fp"), F.max(F.when(F.col("n").isNotNull(), F.col("fp"))).alias("last_fp"))
    own = Window.partitionBy("generation", "stream")
    sizes = sizes.select("generation", "stream", "range", F.coalesce(F.sum("size").over(own.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.min("first_fp").over(own).alias("first_fp"), F.max("last_fp").over(own).alias("last_fp"))
    steps = Window.partitionBy("stream").orderBy("generation")
    bounds = sizes.select("generation", "stream", "first_fp", "last_fp").distinct().where("first_fp is not null").withColumn("previous", F.lag("last_fp", 1, "0" * 24).over(steps))
    bounds = bounds.select("generation", "stream", F.when(F.col("first_fp") == F.col("previous"), F.col("first_fp")).alias("again"))

    def beside(left: DataFrame, right: DataFrame, *names: str) -> DataFrame:
        """The join by names, of which stream may be null."""
        right = right.select(*[F.col(c).alias(f"_{c}") if c in names else F.col(c) for c in right.columns])
        return left.join(right, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names]).drop(*[f"_{c}" for c in names])

    rows = beside(rows.where("n is not null"), sizes.drop("first_fp", "last_fp"), "generation", "stream", "range")
    rows = beside(rows, bounds, "generation", "stream").withColumn("consec", F.coalesce(F.col("fp") == F.col("again"), F.lit(False)))
    rows = rows.withColumn("disk", F.when(~F.col("consec") & ~F.col("is_new"), F.floor((F.col("local") + F.col("before")) / entries).cast("bigint")))
    count = lambda c: F.sum(c.cast("bigint"))
    pages = rows.groupBy("generation", "stream", "disk").agg(
        F.sum("n").alias("chunks"), count(F.col("is_new") & ~F.col("consec")).alias("unique_chunks"), F.sum(F.col("n") - F.col("is_new").cast("int")).alias("redundant_chunks"),
        F.sum(F.col("n") - 1 + F.col("consec").cast("int")).alias("consecutive"), F.count("disk").alias("touched"),
    )
    total = pages.groupBy("generation", "stream").agg(
        *[F.sum(c).alias(c) for c in ("chunks", "unique_chunks", "redundant_chunks", "consecutive", "touched")], F.count("disk").alias("pages"), F.min("disk").alias("first_page"), F.max("disk").alias("last_page")
    )
    current = F.coalesce(F.last("last_page", True).over(steps.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = total.withColumn("disk_misses", F.col("pages") - F.coalesce((F.col("first_page") == current).cast("bigint"), F.lit(0)))
    return total.select("generation", "stream", "chunks", "unique_chunks", "redundant_chunks", "consecutive", F.lit(0).cast("bigint").alias("mem_hits"), (F.col("touched") - F.col("disk_misses")).alias("disk_hits"), "disk_misses")


def group_index_stats(trace: DataFrame, entries: int) -> DataFrame:
    """Statistics of trace(generation, stream, fp, index) on indexes that several streams share, with a flush at the end of
    each generation and no false positives.

    A generation's streams run one after the other by name, each in order of fingerprints and from page 0. What a stream
    before it in the generation has added is found in memory; pages ascend, so that each but page 0 is missed once. A
    fingerprint of zeros equals the one a stream starts with: it is consecutive and never added.
    """
    own = trace.groupBy("index", "generation", "stream", "fp").agg(F.count("*").alias("n")).withColumn("zero", F.col("fp") == "0" * 24)
    # One row for each file that has the fingerprint, so the partitions are bounded by the number of trace files.
    rows = own.withColumn("first", F.min(F.struct("generation", "stream")).over(Window.partitionBy("index", "fp")))
    rows = rows.withColumn("is_new", ~F.col("zero") & (F.col("first") == F.struct("generation", "stream")))
    steps = own.select(F.col("index").alias("of"), F.col("generation").alias("g")).distinct()
    added = rows.where("is_new").select("index", "fp", F.col("generation").alias("since"))
    have = added.join(steps, (F.col("index") == F.col("of")) & (F.col("since") < F.col("g"))).select("index", F.col("g").alias("generation"), "fp", F.substring("fp", 1, 4).alias("range"))
    sizes = have.groupBy("index", "generation", "range").agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.partitionBy("index", "generation").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("index", "generation", "range", F.coalesce(before, F.lit(0)).alias("before"))
    local = have.withColumn("local", F.row_number().over(Window.partitionBy("index", "generation", "range").orderBy("fp")) - 1)
    pages = local.join(sizes, ["index", "generation", "range"]).select("index", "generation", "fp", F.floor((F.col("local") + F.col("before")) / entries).cast("bigint").alias("page"))
    found = rows.join(pages, ["index", "generation", "fp"], "left")
    count = lambda c: F.sum(c.cast("bigint"))
    by_page = found.groupBy("index", "generation", "stream", "page").agg(
        F.sum("n").alias("chunks"), count(F.col("is_new")).alias("unique_chunks"), F.sum(F.col("n") - 1 + F.col("zero").cast("bigint")).alias("consecutive"),
        count(~F.col("zero") & ~F.col("is_new") & F.col("page").isNull()).alias("mem_hits"), F.count("page").alias("touched"),
    )
    total = by_page.groupBy("index", "generation", "stream").agg(*[F.sum(c).alias(c) for c in ("chunks", "unique_chunks", "consecutive", "mem_hits", "touched")], F.count_if(F.col("page") > 0).alias("disk_misses"))
    return total.select(
        "index", "generation", "stream", "chunks", "unique_chunks", (F.col("chunks") - F.col("unique_chunks")).alias("redundant_chunks"), "consecutive", "mem_hits",
        (F.col("touched") - F.col("disk_misses")).alias("disk_hits"), "disk_misses",
    )


def merge_pages(trace: DataFrame, entries: int) -> DataFrame:
    """Per generation: the pages that a shared scan of all streams must touch, of the index of earlier generations.

    For one stream this is the number of loads: the distinct pages of lower bounds of fingerprints up to the index's
    last, and one more load for each distinct fingerprint above it.
    """
    pages = generation_pages(trace, entries)
    top = pages.groupBy("g").agg(F.max("fp").alias("top"))
    probes = trace.select(F.col("generation").alias("g"), "fp").distinct().withColumn("range", F.substring("fp", 1, 4))
    both = probes.withColumn("page", F.lit(None).cast("bigint")).unionByName(pages.withColumn("range", F.substring("fp", 1, 4)))
    here = F.last("page", True).over(Window.partitionBy("g", "range").orderBy(F.col("fp").desc(), F.col("page").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    heads = pages.groupBy("g", F.substring("fp", 1, 4).alias("range")).agg(F.min("page").alias("head"))
    ranges = both.select("g", "range").distinct().join(heads, ["g", "range"], "left").withColumn("next", F.last("head", True).over(Window.partitionBy("g").orderBy(F.col("range").desc()).rowsBetween(Window.unboundedPreceding, -1)))
    found = both.withColumn("here", here).where(F.col("page").isNull()).join(ranges.select("g", "range", "next"), ["g", "range"]).join(F.broadcast(top), "g", "left")
    above = F.col("top").isNotNull() & (F.col("fp") > F.col("top"))
    return found.groupBy(F.col("g").alias("generation")).agg(
        (F.count_distinct(F.when(F.col("top").isNotNull() & ~above, F.coalesce("here", "next"))) + F.sum(above.cast("int"))).cast("bigint").alias("pages_touched"), F.count("*").alias("distinct_fps")
    )


def page_utility(heads: DataFrame, entries: int) -> DataFrame:
    """(i, j, utility) for heads(stream, fp): the share of i's among the first `entries` of the union of i and j.

    heads has `limit` rows a stream at most; the pairs are of streams, not of rows.
    """
    streams = heads.select("stream").distinct()
    pairs = streams.select(F.col("stream").alias("i")).crossJoin(streams.select(F.col("stream").alias("j"))).where("i <> j")
    own = pairs.join(heads.withColumnRenamed("stream", "i"), "i").select("i", "j", "fp", F.lit(1).alias("mine"))
    other = pairs.join(heads.withColumnRenamed("stream", "j"), "j").select("i", "j", "fp", F.lit(0).alias("mine"))
    union = own.unionByName(other).groupBy("i", "j", "fp").agg(F.max("mine").alias("mine"))
    page = union.withColumn("rn", F.row_number().over(Window.partitionBy("i", "j").orderBy("fp"))).where(F.col("rn") <= entries)
    return page.groupBy("i", "j").agg((F.sum("mine") / F.count("*")).alias("utility"))


def stream_heads(ordered: DataFrame, limit: int = 1000) -> DataFrame:
    """The first `limit` chunks of each sorted stream that are not repeats of the one before."""
    w = Window.partitionBy("stream").orderBy("pos")
    new = ordered.withColumn("before", F.lag("fp").over(w)).where("before is null or before <> fp")
    return new.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit).select("stream", "fp", "n")


def merged_heads(trace: DataFrame, limit: int) -> DataFrame:
    """(i, j, fp): the merged head of each two streams i < j of trace(stream, fp), the first `limit` distinct fingerprints
    of their heads of `limit`."""
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("fp"))
    heads = trace.select("stream", "fp").distinct().withColumn("n", rank("stream")).where(F.col("n") <= limit).drop("n")
    streams = heads.select("stream").distinct()
    pairs = streams.toDF("i").join(streams.toDF("j"), F.col("i") < F.col("j"))
    both = pairs.join(heads.withColumnRenamed("stream", "i"), "i").select("i", "j", "fp").unionByName(pairs.join(heads.withColumnRenamed("stream", "j"), "j").select("i", "j", "fp"))
    return both.distinct().withColumn("n", rank("i", "j")).where(F.col("n") <= limit).drop("n")
