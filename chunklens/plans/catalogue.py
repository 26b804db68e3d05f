"""All queries over chunk traces, and their SQL for DuckDB. A key begins with the operator's number in the inventory."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chunklens.functions import fingerprint as fx
from chunklens.operators import dedup, segments, sortedindex
from chunklens.plans import similarity, simulate
from chunklens.sources import formats
from chunklens.sources.trace import ORDER, backup_trace, event_trace, late_trace, lineitem_trace, listed, sorted_trace

#: The configuration of the queries, scaled to the trace's mean chunk of 264 bytes.
DIVISOR, FACTOR, ENTRIES, CONTAINER, BLOCK, SEGMENT, MOST, WINDOW, LRU = 16, 4, 10, 16_384, 8_192, 4_224, 2, 3, 20

_TRACE = """t AS (SELECT CAST(g AS INTEGER) AS generation, source AS stream, doc_id AS file_seq, 'doc' || doc_id AS filename, CAST(i AS INTEGER) AS chunk_seq,
  substr(md5(line || '|v' || ((g + strlen(line)) // 4)), 1, 24) AS fp, strlen(line) AS size
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents), range(4) r(g))"""
_SORTED = _TRACE + ", s AS (SELECT *, row_number() OVER (PARTITION BY generation, stream ORDER BY fp, file_seq, chunk_seq) AS pos FROM t)"
_FIRST = "f AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY generation, stream, file_seq, chunk_seq) AS rn FROM t)"


def _hook(fp: str, factor: int = FACTOR) -> str:
    return f"('0x' || substr({fp}, 1, 2))::INT % {1 << factor} = 0"


_LANDMARK = f"('0x' || substr(fp, 7, 2) || substr(fp, 5, 2) || substr(fp, 3, 2) || substr(fp, 1, 2))::BIGINT % {DIVISOR} = 0"
_SEGMENTS = _TRACE + f""", g AS (SELECT *, CAST(coalesce(sum(CASE WHEN {_LANDMARK} THEN 1 ELSE 0 END) OVER (PARTITION BY generation, stream ORDER BY file_seq, chunk_seq
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS seg FROM t)"""
_HOOKS = _SEGMENTS + f""", k AS (SELECT DISTINCT generation, stream, seg, fp FROM g WHERE {_hook('fp')}),
h AS (SELECT *, dense_rank() OVER (ORDER BY generation, stream, seg) AS sid FROM k)"""
_CANDIDATES = _HOOKS + f""", c AS (SELECT sid, fp, candidate FROM (SELECT cur.sid, cur.fp, prev.sid AS candidate,
  row_number() OVER (PARTITION BY cur.sid, cur.fp ORDER BY prev.sid DESC) AS rn FROM h cur JOIN h prev ON cur.fp = prev.fp AND prev.sid < cur.sid) WHERE rn <= {MOST})"""
_PAGES = _TRACE + f""", d AS (SELECT fp, min(generation) AS since FROM t GROUP BY fp),
pg AS (SELECT g, fp, (row_number() OVER (PARTITION BY g ORDER BY fp) - 1) // {ENTRIES} AS page FROM d JOIN (SELECT DISTINCT generation AS g FROM t) ON since < g)"""
_USAGE = _TRACE + ", u AS (SELECT generation, fp, count(DISTINCT stream) AS k, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM t GROUP BY generation, fp)"


def _first(trace):
    return trace.join(dedup.first_occurrences(trace).select(*ORDER), ORDER, "left_semi")


def _segments(spark, d):
    return segments.landmark_segments(backup_trace(spark, d), DIVISOR)


def _candidates(spark, d):
    return segments.recent_segments(segments.numbered(_segments(spark, d), FACTOR), MOST)


def _trace_files(spark, d, kind, folder):
    """A trace file of each file of a generation, encoded and parsed again."""
    chunks = F.array_sort(F.collect_list(F.struct("chunk_seq", F.concat("fp", F.lit("00ff")).alias("digest"), "size")))
    files = backup_trace(spark, d).groupBy("generation", "stream", "filename").agg(chunks.alias("chunks"))
    path = F.concat_ws("/", F.lit(folder), "generation", "stream", "filename")
    parsed = formats.parse(formats.encode(files.select(path.alias("path"), "filename", "chunks"), kind))
    return parsed if kind == "legacy" else formats.assemble(parsed)


def _file_digest(rows, *by):
    own = rows.groupBy("path", "filename", *by).agg(F.count("chunk_seq").alias("chunks"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.array_sort(F.collect_list(F.struct("chunk_seq", "fp"))).alias("x"))
    hashed = F.md5(F.array_join(F.transform("x", lambda x: x["fp"]), "", "")).alias("hash")
    return own.select(F.split("path", "/")[1].cast("int").alias("generation"), F.split("path", "/")[2].alias("stream"), "filename", *by, "chunks", "bytes", hashed)


def s5_s6_s8_trace_files(spark, d):
    """Every file as a partial and a whole message, encoded, parsed and joined again; chunk_count is that of the last part."""
    return _file_digest(_trace_files(spark, d, "pb", "pb"), "chunk_count")


def s7_legacy_trace_files(spark, d):
    """Every file in the legacy format; a chunk of 64 KB or more ends its chunks."""
    return _file_digest(_trace_files(spark, d, "legacy", "imt").withColumn("fp", fx.truncate(F.col("digest"))))


def s1_s9_listing(spark, d):
    """Trace files by their names: of several hosts, and of a data set whose generations run backwards."""
    t = backup_trace(spark, d).select("generation", "stream").distinct()
    several = t.select(F.concat(F.lit("in/gen_"), F.col("generation") * 7 + 3, F.lit("_"), "stream", F.lit("-cdc8")).alias("path"))
    one = t.select(F.concat(F.lit("in/ma1_w"), F.col("generation") + 8, F.lit("_r1-cdc8")).alias("path")).distinct()
    both = [listed(files, dataset).withColumn("dataset", F.lit(dataset)) for files, dataset in ((several.union(one), "multi"), (one.union(several), "jgu4"))]
    return both[0].unionByName(both[1]).select("dataset", "name", "id", F.col("generation").cast("int").alias("generation"), "stream")


def p7_one_index(spark, d):
    """Streams that begin late, on one index that all share, as any utility is enough."""
    return similarity.similarity_index_stats(late_trace(spark, d), ENTRIES, 0.0)


def p7_similarity_index(spark, d):
    """The same streams on the indexes of similar ones; a new index for each group that none suits."""
    return similarity.similarity_index_stats(late_trace(spark, d), ENTRIES, 0.2)


def f2_hook_sample(spark, d):
    return backup_trace(spark, d).where(fx.is_hook(F.col("fp"), FACTOR)).groupBy("generation").agg(F.count("*").alias("hooks"), F.count_distinct("fp").alias("distinct_hooks"))


def f3_landmarks(spark, d):
    return backup_trace(spark, d).where(fx.is_landmark(F.col("fp"), DIVISOR)).groupBy("generation", "stream").agg(F.count("*").alias("landmarks"))


def f4_bloom_positives(spark, d):
    """Chunks of a generation that the simulated filter passes: known ones, and a share of 0.25 of the others."""
    own = backup_trace(spark, d).select("generation", "fp").distinct()
    first = own.groupBy("fp").agg(F.min("generation").alias("since"))
    both = own.join(first, "fp").withColumn("known", F.col("since") < F.col("generation"))
    passed = F.col("known") | (fx.dice(F.col("fp"), 7) < 0.25)
    return both.groupBy("generation").agg(F.sum(F.col("known").cast("int")).cast("bigint").alias("known"), F.sum(passed.cast("int")).cast("bigint").alias("positive"))


def f5_consecutive_dups(spark, d):
    return dedup.consecutive_duplicates(sorted_trace(spark, d)).groupBy("generation", "stream").agg(F.sum(F.col("consec").cast("int")).cast("bigint").alias("consecutive"))


def f6_file_hash(spark, d):
    files = backup_trace(spark, d).groupBy("generation", "filename").agg(F.array_sort(F.collect_list(F.struct("chunk_seq", "fp"))).alias("x"))
    return files.select("generation", "filename", F.md5(F.concat_ws("", F.transform("x", lambda x: x["fp"]))).alias("hash"))


def f9_f17_scalars(spark, d):
    """Page of position, container and block, rounded size, segment size, distance modulo 2 ** 32 and shard of each file."""
    t = backup_trace(spark, d).where("generation = 0")
    return t.select(
        "file_seq", "chunk_seq", fx.page_of_position(F.col("file_seq"), 240).alias("position_page"), fx.page_of_unit(F.col("file_seq"), 4096, CONTAINER, 1024).alias("container_page"),
        fx.round_up(F.col("size"), 4096).alias("rounded"), fx.segment_bytes(F.col("size")).alias("segment_bytes"), fx.block_distance(F.col("chunk_seq").cast("bigint"), F.col("file_seq")).alias("distance"),
        fx.shard(F.col("fp")).alias("shard"), fx.wide_shard(F.col("fp")).alias("wide_shard"), fx.truncate(F.substring("fp", 1, 20)).alias("padded"),
    )


def j2_previous_writer(spark, d):
    """The file that wrote each chunk last before, per stream: how many of its chunks each file takes from it."""
    w = Window.partitionBy("fp").orderBy(*ORDER)
    t = backup_trace(spark, d).withColumn("writer", F.lag("file_seq").over(w))
    return t.where("writer is not null").groupBy("generation", "stream").agg(F.count("*").alias("known"), F.sum((F.col("writer") == F.col("file_seq")).cast("int")).cast("bigint").alias("same_file"))


def a3_fp_frequency(spark, d):
    return backup_trace(spark, d).groupBy("fp").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("fps"))


def a7_blocks_per_chunk(spark, d):
    """Mean, least, most and quartiles (by index) of the blocks that have a chunk."""
    own = segments.blocks(backup_trace(spark, d), BLOCK).groupBy("generation", "fp").agg(F.count("*").alias("n")).groupBy("generation", "n").agg(F.count("*").alias("fps"))
    # A histogram first: its rows, not the fingerprints, are what the quartiles' window orders.
    w = Window.partitionBy("generation").orderBy("n")
    cum = own.withColumn("upto", F.sum("fps").over(w)).withColumn("whole", F.sum("fps").over(Window.partitionBy("generation")))
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(F.col("whole") * q), F.col("n"))).alias(f"p{int(q * 100)}")
    return cum.groupBy("generation").agg((F.sum(F.col("n") * F.col("fps")) / F.sum("fps")).alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"), *(at(q) for q in (0.25, 0.5, 0.75, 0.9)))


def x4_stream_sets(spark, d):
    """Sets of streams of each fp: as sorted arrays, how many fps have each set, with one stream inserted and removed."""
    own = backup_trace(spark, d).where("generation = 0").select("fp", "stream").distinct().groupBy("fp").agg(F.array_sort(F.collect_list("stream")).alias("s"))
    sets = own.select(F.array_join("s", ",").alias("streams"), F.size(F.array_union("s", F.array(F.lit("src0")))).alias("with_src0"), F.size(F.array_except("s", F.array(F.lit("src0")))).alias("without_src0"))
    return sets.groupBy("streams", "with_src0", "without_src0").agg(F.count("*").alias("fps"))


def w6_containers(spark, d):
    packed = segments.containers(_first(backup_trace(spark, d)), CONTAINER)
    return packed.groupBy("stream", "container").agg(F.count("*").alias("chunks"), F.sum("size").cast("bigint").alias("bytes"))


def w7_blocks(spark, d):
    return segments.blocks(backup_trace(spark, d), BLOCK).groupBy("generation", "stream", "block").agg(F.count("*").alias("fps"))


def w5_fixed_segments(spark, d):
    return segments.fixed_segments(backup_trace(spark, d), SEGMENT).groupBy("generation", "stream", "seg").agg(F.count("*").alias("chunks"), F.sum("size").cast("bigint").alias("bytes"))


def w4_segments(spark, d):
    return _segments(spark, d).groupBy("generation", "stream", "seg").agg(F.count("*").alias("chunks"), F.count_distinct("fp").alias("fps"))


def a8_segment_stats(spark, d):
    return segments.segment_stats(_segments(spark, d), FACTOR)


def _rounds(spark, d):
    w = Window.partitionBy("generation", "stream").orderBy("file_seq", "chunk_seq")
    return backup_trace(spark, d).withColumn("r", F.row_number().over(w) - 1)


def _index_sizes(spark, d):
    """(generation, round, index_size): distinct fps in the last WINDOW rounds, from the ends of each fp's live intervals."""
    seen = _rounds(spark, d).select("generation", "r", "fp").distinct()
    after = F.lead("r").over(Window.partitionBy("generation", "fp").orderBy("r"))
    live = seen.withColumn("e", F.least(F.coalesce(after, F.lit(2**31 - 1) - WINDOW), F.col("r") + WINDOW))
    delta = live.select("generation", F.explode(F.array(F.struct(F.col("r").alias("round"), F.lit(1).alias("v")), F.struct(F.col("e").alias("round"), F.lit(-1).alias("v")))).alias("x")).groupBy("generation", "x.round").agg(F.sum("x.v").alias("v"))
    ends = seen.groupBy("generation").agg(F.max("r").alias("last")).select("generation", F.explode(F.sequence(F.lit(0), F.col("last") + 1)).alias("round"))
    all_of = ends.join(delta, ["generation", "round"], "left")
    return all_of.select("generation", F.col("round").cast("bigint").alias("round"), F.sum(F.coalesce("v", F.lit(0))).over(Window.partitionBy("generation").orderBy("round")).cast("bigint").alias("index_size"))


def p12_window_distinct(spark, d):
    return _index_sizes(spark, d)


def a12_index_size(spark, d):
    return _index_sizes(spark, d).groupBy("generation").agg(F.max("index_size").alias("max_index_size"), (F.sum("index_size") / F.count("*")).alias("avg_index_size"))


def w9_finish_rounds(spark, d):
    return backup_trace(spark, d).groupBy("generation", "stream").agg(F.count("*").alias("finish_round"))


def w10_lru_hits(spark, d):
    """Hits of an LRU cache of LRU chunks in each stream: a repeat with fewer than LRU distinct fps since."""
    return simulate.lru_hits(backup_trace(spark, d), LRU)


def o2_sorted_pages(spark, d):
    return sortedindex.paged(backup_trace(spark, d).where("generation = 0"), ENTRIES)


def o3_first_page(spark, d):
    return backup_trace(spark, d).where("generation = 0").select("fp").distinct().orderBy("fp").limit(ENTRIES)


def o4_page_count(spark, d):
    pages = sortedindex.page_ends(o2_sorted_pages(spark, d))
    return pages.agg((F.max("page") + 1).alias("pages"), F.sum("entries").cast("bigint").alias("entries"))


def o5_page_ends(spark, d):
    return sortedindex.page_ends(o2_sorted_pages(spark, d)).select("page", "last_fp")


def o7_chunks_up_to(spark, d):
    """The head of each sorted stream, up to the first fp above the first page's last."""
    top = o3_first_page(spark, d).agg(F.max("fp").alias("top"))
    t = sorted_trace(spark, d).where("generation = 1").crossJoin(F.broadcast(top)).where(F.col("fp") <= F.col("top"))
    return t.groupBy("stream").agg(F.count("*").alias("chunks"), F.count_distinct("fp").alias("fps"))


def o6_stream_heads(spark, d):
    return sortedindex.stream_heads(sorted_trace(spark, d).where("generation = 0"), 50).groupBy("stream").agg(F.count("*").alias("chunks"), F.max("fp").alias("last_fp"))


def o12_client_order(spark, d):
    """Streams in the order of a seeded hash."""
    streams = backup_trace(spark, d).select("stream").distinct()
    return streams.withColumn("rn", F.row_number().over(Window.orderBy(F.md5(F.concat("stream", F.lit("|42"))))).cast("bigint"))


def j8_page_lookup(spark, d):
    t = backup_trace(spark, d)
    return sortedindex.page_lookup(t.where("generation = 1").select("fp"), sortedindex.paged(t.where("generation = 0"), ENTRIES))


def x6_predictions(spark, d):
    """Hit rate and utility of the first page of generation 0 for each stream's head in generation 1."""
    page = o3_first_page(spark, d).withColumn("there", F.lit(1))
    top = page.agg(F.max("fp").alias("top"))
    head = sortedindex.stream_heads(sorted_trace(spark, d).where("generation = 1"), 1000).crossJoin(F.broadcast(top)).where(F.col("fp") <= F.col("top")).join(F.broadcast(page), "fp", "left")
    size = page.agg(F.count("*").alias("entries"))
    hits = F.count("there")
    return head.groupBy("stream").agg(hits.alias("hits"), (hits / F.count("*")).alias("hit_rate")).crossJoin(F.broadcast(size)).select("stream", "hits", "hit_rate", (F.col("hits") / F.col("entries")).alias("utility"))


def p6_sorted_index(spark, d):
    """The sorted index of every stream, each on an index of its own."""
    return sortedindex.stream_index_stats(backup_trace(spark, d), ENTRIES)


def _index_ratios(p, *by):
    hits, misses = F.col("mem_hits") + F.col("disk_hits"), F.col("disk_misses")
    return p.select(*by, fx.ratio(hits, hits + misses).alias("hit_ratio"), fx.ratio(F.col("disk_hits"), F.col("disk_hits") + misses).alias("disk_hit_ratio"), fx.ratio(F.col("disk_hits"), misses * ENTRIES).alias("page_utility"))


def a10_index_ratios(spark, d):
    return _index_ratios(p6_sorted_index(spark, d), "generation", "stream")


def p8_merge_pages(spark, d):
    return sortedindex.merge_pages(backup_trace(spark, d), ENTRIES)


def a11_page_utility(spark, d):
    """Repeats of earlier generations that a loaded page serves, on average."""
    t = backup_trace(spark, d)
    known = t.join(t.groupBy("fp").agg(F.min("generation").alias("since")), "fp").where("since < generation").groupBy("generation").agg(F.count_distinct("fp").alias("known"))
    return sortedindex.merge_pages(t, ENTRIES).join(known, "generation").select("generation", (F.col("known") / ENTRIES / F.col("pages_touched")).alias("page_utility"))


def p9_page_usage(spark, d):
    """Pages touched when the first k clients (1, 5, 10, ...) of a seeded order run generation 2 on the index before it."""
    t = backup_trace(spark, d).where("generation <= 2")
    order = o12_client_order(spark, d)
    steps = order.select(F.col("rn").alias("k")).where("k = 1 or k % 5 = 0")
    pages = sortedindex.generation_pages(t, ENTRIES).where("g = 2").drop("g")
    own = t.where("generation = 2").select("stream", "fp").distinct()
    at = sortedindex.page_lookup(own.select("fp").distinct(), pages)
    need = own.join(F.broadcast(order), "stream").join(at, "fp").groupBy("page").agg(F.min("rn").alias("since"))
    return need.join(F.broadcast(steps), F.col("since") <= F.col("k")).groupBy(F.col("k").alias("clients")).agg(F.count("*").alias("pages"))


def _heads(spark, d):
    return sortedindex.stream_heads(sorted_trace(spark, d).where("generation = 0"), 100).select("stream", "fp").distinct()


def x5_page_utility(spark, d):
    return sortedindex.page_utility(_heads(spark, d), 20)


def j10_head_merge(spark, d):
    """The merged heads of every two streams: the first 100 of their union."""
    return sortedindex.merged_heads(backup_trace(spark, d).where("generation = 0"), 100)


def j5_candidates(spark, d):
    return _candidates(spark, d).groupBy("sid", "candidate").agg(F.count("*").alias("hooks"))


def o9_recent_segments(spark, d):
    return _candidates(spark, d)


def o8_champions_one(spark, d):
    """The first champion of each segment: most common hooks, the larger id on ties."""
    return segments.champions(_candidates(spark, d), 1).select("sid", "champion", "hooks")


def p5_sparse_m1(spark, d):
    own, chosen = _segments(spark, d), segments.champions(_candidates(spark, d), 1)
    return segments.sparse_dedup(own, segments.numbered(own, FACTOR), chosen)


def p5_sparse_full(spark, d):
    own, chosen = _segments(spark, d), segments.champions(_candidates(spark, d), 5)
    return segments.sparse_dedup(own, segments.numbered(own, FACTOR), chosen)


def t8_champion_io(spark, d):
    return simulate.champion_io(segments.champions(_candidates(spark, d), 5), capacity=16)


def event_first_seen(spark, d):
    first = event_trace(spark, d).groupBy("fp").agg(F.min(F.struct("chunk_seq", "generation", "stream")).alias("x"))
    return first.groupBy("x.generation", "x.stream").agg(F.count("*").alias("new"))


def lineitem_fp_frequency(spark, d):
    return lineitem_trace(spark, d).groupBy("fp").agg(F.count("*").alias("n"), F.count_distinct("stream").alias("k")).groupBy("n", "k").agg(F.count("*").alias("fps"))


QUERIES = {
    "w1_exact_dedup_stats": lambda s, d: dedup.dedup_stats(backup_trace(s, d)),
    "a2_total_rollup": lambda s, d: dedup.with_total(dedup.dedup_stats(backup_trace(s, d))),
    "a1_new_per_generation": lambda s, d: dedup.first_occurrences(backup_trace(s, d)).groupBy("generation").agg(F.count("*").alias("new")),
    "f2_hook_sample": f2_hook_sample, "f3_landmarks": f3_landmarks, "f4_bloom_positives": f4_bloom_positives, "f5_consecutive_dups": f5_consecutive_dups, "f6_file_hash": f6_file_hash,
    "f9_f17_scalars": f9_f17_scalars, "j2_previous_writer": j2_previous_writer, "a3_fp_frequency": a3_fp_frequency,
    "a5_usage_histogram": lambda s, d: dedup.usage_histogram(backup_trace(s, d)), "a7_blocks_per_chunk": a7_blocks_per_chunk,
    "p10_full_file": lambda s, d: dedup.full_files(backup_trace(s, d)),
    "x1_x2_similarity": lambda s, d: dedup.stream_similarity(backup_trace(s, d)), "x3_real_uniques": lambda s, d: dedup.real_uniques(backup_trace(s, d)), "x4_stream_sets": x4_stream_sets,
    "p13_stream_share": lambda s, d: dedup.stream_share(backup_trace(s, d)),
    "w4_segments": w4_segments, "w5_fixed_segments": w5_fixed_segments, "w6_containers": w6_containers, "w7_blocks": w7_blocks, "a8_segment_stats": a8_segment_stats,
    "p12_window_distinct": p12_window_distinct, "a12_index_size": a12_index_size, "w9_finish_rounds": w9_finish_rounds, "w10_lru_hits": w10_lru_hits,
    "o2_sorted_pages": o2_sorted_pages, "o3_first_page": o3_first_page, "o4_page_count": o4_page_count, "o5_page_ends": o5_page_ends, "o6_stream_heads": o6_stream_heads,
    "o7_chunks_up_to": o7_chunks_up_to, "o12_client_order": o12_client_order, "j8_page_lookup": j8_page_lookup, "x6_predictions": x6_predictions,
    "p6_sorted_index": p6_sorted_index, "a10_index_ratios": a10_index_ratios, "p8_merge_pages": p8_merge_pages, "a11_page_utility": a11_page_utility, "p9_page_usage": p9_page_usage,
    "x5_page_utility": x5_page_utility, "j10_head_merge": j10_head_merge,
    "j5_candidates": j5_candidates, "o9_recent_segments": o9_recent_segments, "o8_champions_one": o8_champions_one, "p5_sparse_m1": p5_sparse_m1, "p5_sparse_full": p5_sparse_full, "t8_champion_io": t8_champion_io,
    "s5_s6_s8_trace_files": s5_s6_s8_trace_files, "s7_legacy_trace_files": s7_legacy_trace_files, "s1_s9_listing": s1_s9_listing, "p7_one_index": p7_one_index, "p7_similarity_index": p7_similarity_index,
    "event_first_seen": event_first_seen, "lineitem_fp_frequency": lineitem_fp_frequency,
    **simulate.QUERIES,
}


def _pages_sql(tail: str) -> str:
    return f"WITH {_TRACE}, p AS (SELECT fp, pos, pos // {ENTRIES} AS page FROM (SELECT fp, row_number() OVER (ORDER BY fp) - 1 AS pos FROM (SELECT DISTINCT fp FROM t WHERE generation = 0))) {tail}"


def _pack_sql(rows: str, by: str, begin: str, step_n: str, step_free: str, tail: str) -> str:
    """A sequential cut by a recursive query: (n, free) along rows x(<by>, i, size)."""
    joined = " AND ".join(f"x.{c} = r.{c}" for c in by.split(", "))
    return f"""WITH RECURSIVE {_TRACE}, {rows}, r AS (SELECT {by}, i, fp, size, {begin} FROM x WHERE i = 1 UNION ALL
SELECT {', '.join('x.' + c for c in by.split(', '))}, x.i, x.fp, x.size, {step_n}, {step_free} FROM r JOIN x ON {joined} AND x.i = r.i + 1) {tail}"""


_ROLL = "CAST(count(*) AS BIGINT) AS chunks, CAST(sum(size) AS BIGINT) AS bytes, CAST(count(*) FILTER (rn = 1) AS BIGINT) AS unique_chunks, CAST(count(*) FILTER (rn > 1) AS BIGINT) AS redundant_chunks, count(*) FILTER (rn > 1) / count(*) AS redundant_ratio"
_P6 = _SORTED + f""", a AS (SELECT *, lag(fp, 1, repeat('0', 24)) OVER (PARTITION BY stream ORDER BY generation, pos) AS pf, row_number() OVER (PARTITION BY stream, fp ORDER BY generation, pos) AS rn FROM s),
d AS (SELECT stream, fp, min(generation) AS since FROM a GROUP BY ALL),
pg AS (SELECT g, stream, fp, (row_number() OVER (PARTITION BY g, stream ORDER BY fp) - 1) // {ENTRIES} AS page FROM d JOIN (SELECT DISTINCT generation AS g FROM a) ON since < g),
b AS (SELECT a.*, page, a.fp = pf AS consec FROM a LEFT JOIN pg ON pg.g = a.generation AND pg.fp = a.fp AND pg.stream IS NOT DISTINCT FROM a.stream),
y AS (SELECT *, CASE WHEN NOT consec THEN page END AS dp, coalesce(last_value(CASE WHEN NOT consec THEN page END IGNORE NULLS) OVER (PARTITION BY stream ORDER BY generation, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cp FROM b),
z AS (SELECT generation, stream, count(*) AS chunks, count(*) FILTER (rn = 1 AND NOT consec) AS unique_chunks, count(*) FILTER (rn > 1) AS redundant_chunks, count(*) FILTER (consec) AS consecutive,
  count(*) FILTER (NOT consec AND rn > 1 AND page IS NULL) AS mem_hits, count(*) FILTER (dp = cp) AS disk_hits, count(*) FILTER (dp <> cp) AS disk_misses FROM y GROUP BY generation, stream)"""
_MERGE = _PAGES + """, top AS (SELECT g, max(fp) AS top FROM pg GROUP BY g), q AS (SELECT DISTINCT generation AS g, fp FROM t),
l AS (SELECT q.g, q.fp, top, (SELECT min(page) FROM pg WHERE pg.g = q.g AND pg.fp >= q.fp AND q.fp <= top) AS page FROM q LEFT JOIN top ON top.g = q.g),
m AS (SELECT g AS generation, CAST(count(DISTINCT page) + count(*) FILTER (fp > top) AS BIGINT) AS pages_touched, count(*) AS distinct_fps FROM l GROUP BY g)"""
_CHAMPIONS = _CANDIDATES + """, n AS (SELECT sid, candidate, count(*) AS hooks FROM c GROUP BY ALL),
b AS (SELECT sid, candidate AS champion, hooks FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY hooks DESC, candidate DESC) AS rn FROM n) WHERE rn = 1)"""
_SIZES = _TRACE + f""", x AS (SELECT generation, fp, row_number() OVER (PARTITION BY generation, stream ORDER BY file_seq, chunk_seq) - 1 AS r FROM t),
e AS (SELECT generation, unnest(range(max(r) + 2)) AS round FROM x GROUP BY generation),
v AS (SELECT e.generation, e.round, count(DISTINCT fp) AS index_size FROM e LEFT JOIN x ON x.generation = e.generation AND x.r BETWEEN e.round - {WINDOW - 1} AND e.round GROUP BY ALL)"""
_HEADS = _SORTED + ", w AS (SELECT *, lag(fp) OVER (PARTITION BY generation, stream ORDER BY pos) AS before FROM s), hd AS (SELECT *, row_number() OVER (PARTITION BY generation, stream ORDER BY pos) AS n FROM w WHERE before IS NULL OR before <> fp)"
_FIRST_PAGE = f"fpg AS (SELECT DISTINCT fp FROM t WHERE generation = 0 ORDER BY fp LIMIT {ENTRIES})"

_W7 = _pack_sql("x AS (SELECT *, row_number() OVER (PARTITION BY generation, stream ORDER BY file_seq, chunk_seq) AS i FROM t)", "generation, stream", f"CAST(CASE WHEN size >= {BLOCK} THEN 1 ELSE 0 END AS BIGINT) AS n, size AS held", f"CASE WHEN r.held + x.size >= {BLOCK} THEN r.n + 1 ELSE r.n END", f"CASE WHEN r.held + x.size >= {BLOCK} THEN x.size ELSE r.held + x.size END", ", b AS (SELECT generation, stream, n AS block, fp FROM r UNION SELECT generation, stream, n - 1, fp FROM (SELECT *, coalesce(lag(n) OVER (PARTITION BY generation, stream ORDER BY i), 0) AS was FROM r) WHERE n > was)")

ORACLE_SQL = {
    "w1_exact_dedup_stats": f"WITH {_TRACE}, {_FIRST} SELECT generation, stream, {_ROLL} FROM f GROUP BY generation, stream",
    "a2_total_rollup": f"WITH {_TRACE}, {_FIRST} SELECT coalesce(CAST(generation AS VARCHAR), 'all') AS generation, coalesce(stream, 'total') AS stream, {_ROLL} FROM f GROUP BY ROLLUP (generation, stream)",
    "a1_new_per_generation": f"WITH {_TRACE}, {_FIRST} SELECT generation, count(*) AS new FROM f WHERE rn = 1 GROUP BY generation",
    "f2_hook_sample": f"WITH {_TRACE} SELECT generation, count(*) AS hooks, count(DISTINCT fp) AS distinct_hooks FROM t WHERE {_hook('fp')} GROUP BY generation",
    "f3_landmarks": f"WITH {_TRACE} SELECT generation, stream, count(*) AS landmarks FROM t WHERE {_LANDMARK} GROUP BY generation, stream",
    "f4_bloom_positives": f"WITH {_TRACE}, o AS (SELECT DISTINCT generation, fp, min(generation) OVER (PARTITION BY fp) < generation AS known FROM t) SELECT generation, count(*) FILTER (known) AS known, count(*) FILTER (known OR ('0x' || substr(md5(fp || '|7'), 1, 12))::BIGINT / 281474976710656.0 < 0.25) AS positive FROM o GROUP BY generation",
    "f5_consecutive_dups": f"WITH {_SORTED} SELECT generation, stream, count(*) FILTER (c) AS consecutive FROM (SELECT *, fp = lag(fp, 1, repeat('0', 24)) OVER (PARTITION BY stream ORDER BY generation, pos) AS c FROM s) GROUP BY generation, stream",
    "f6_file_hash": f"WITH {_TRACE} SELECT generation, filename, md5(string_agg(fp, '' ORDER BY chunk_seq)) AS hash FROM t GROUP BY generation, filename",
    "f9_f17_scalars": f"WITH {_TRACE} SELECT file_seq, chunk_seq, file_seq // 10 AS position_page, file_seq // (4096 // (({CONTAINER} // 1024) * 24)) AS container_page, CAST(ceil(size / 4096) * 4096 AS BIGINT) AS rounded, 24 + 20 * size AS segment_bytes, CASE WHEN chunk_seq < file_seq THEN chunk_seq - file_seq + 4294967296 ELSE chunk_seq - file_seq END AS distance, CAST(('0x' || substr(fp, 1, 2))::INT AS BIGINT) AS shard, CAST(('0x' || substr(fp, 15, 2) || substr(fp, 13, 2) || substr(fp, 11, 2) || substr(fp, 9, 2) || substr(fp, 7, 2) || substr(fp, 5, 2) || substr(fp, 3, 2) || substr(fp, 1, 2))::UBIGINT % 1024 AS BIGINT) AS wide_shard, substr(fp, 1, 20) || '0000' AS padded FROM t WHERE generation = 0",
    "j2_previous_writer": f"WITH {_TRACE}, p AS (SELECT *, lag(file_seq) OVER (PARTITION BY fp ORDER BY generation, stream, file_seq, chunk_seq) AS writer FROM t) SELECT generation, stream, count(*) AS known, count(*) FILTER (writer = file_seq) AS same_file FROM p WHERE writer IS NOT NULL GROUP BY generation, stream",
    "a3_fp_frequency": f"WITH {_TRACE} SELECT n, count(*) AS fps FROM (SELECT count(*) AS n FROM t GROUP BY fp) GROUP BY n",
    "a5_usage_histogram": f"WITH {_USAGE} SELECT generation, k, count(*) AS fps, count(*) / sum(count(*)) OVER (PARTITION BY generation) AS share FROM u GROUP BY generation, k",
    "p10_full_file": f"WITH {_TRACE}, x AS (SELECT generation, file_seq, filename, md5(string_agg(fp, '' ORDER BY chunk_seq)) AS hash, sum(size) AS bytes, count(*) AS n FROM t GROUP BY ALL), y AS (SELECT *, coalesce(lag(hash) OVER (PARTITION BY filename ORDER BY generation) = hash, false) AS red FROM x) SELECT generation, CAST(sum(n) AS BIGINT) AS chunk_count, count(*) AS file_count, count(*) FILTER (red) AS redundant_files, count(*) FILTER (NOT red) AS unique_files, CAST(sum(bytes) AS BIGINT) AS total_volume, CAST(coalesce(sum(bytes) FILTER (red), 0) AS BIGINT) AS redundant_volume FROM y GROUP BY generation",
    "x1_x2_similarity": f"WITH {_USAGE}, m AS (SELECT generation, count(DISTINCT stream) AS al FROM t GROUP BY generation) SELECT u.generation, count(*) AS all_uniques, CAST(sum(n) AS BIGINT) AS all_occurrences, count(*) FILTER (k = al) AS full_shared, CAST(coalesce(sum(n) FILTER (k = al), 0) AS BIGINT) AS full_shared_occurrences, count(*) FILTER (k > 1) AS any_shared, CAST(coalesce(sum(bytes) FILTER (k > 1), 0) AS BIGINT) AS any_shared_volume FROM u JOIN m ON m.generation = u.generation GROUP BY u.generation",
    "x3_real_uniques": f"WITH {_USAGE}, o AS (SELECT t.generation, t.stream, t.fp, u.k, count(*) AS n FROM t JOIN u ON u.generation = t.generation AND u.fp = t.fp GROUP BY ALL) SELECT generation, stream, count(*) FILTER (k = 1) AS real_uniques, count(*) FILTER (k > 1) AS shared_uniques, CAST(coalesce(sum(n) FILTER (k > 1), 0) AS BIGINT) AS shared_occurrences FROM o GROUP BY generation, stream",
    "x4_stream_sets": f"WITH {_TRACE}, o AS (SELECT fp, list_sort(list(DISTINCT stream)) AS s FROM t WHERE generation = 0 GROUP BY fp) SELECT array_to_string(s, ',') AS streams, CAST(len(s) + (NOT list_contains(s, 'src0'))::INT AS INTEGER) AS with_src0, CAST(len(s) - list_contains(s, 'src0')::INT AS INTEGER) AS without_src0, count(*) AS fps FROM o GROUP BY ALL",
    "p13_stream_share": f"WITH {_TRACE}, e AS (SELECT DISTINCT generation AS g FROM t), c AS (SELECT g, fp, count(DISTINCT stream) AS k FROM t JOIN e ON generation <= g WHERE fp <> repeat('0', 24) GROUP BY ALL), n AS (SELECT g, count(DISTINCT stream) AS total, count(DISTINCT stream) FILTER (generation = g) AS gen FROM t JOIN e ON generation <= g GROUP BY g) SELECT c.g AS generation, k, count(*) AS fps, count(*) / sum(count(*)) OVER (PARTITION BY c.g) AS share, any_value(gen) AS num_streams_gen, any_value(total) AS num_streams_total FROM c JOIN n ON n.g = c.g GROUP BY c.g, k",
    "w4_segments": f"WITH {_SEGMENTS} SELECT generation, stream, seg, count(*) AS chunks, count(DISTINCT fp) AS fps FROM g GROUP BY ALL",
    "a8_segment_stats": f"WITH {_SEGMENTS}, x AS (SELECT generation, stream, seg, count(*) AS chunks, count(DISTINCT fp) FILTER ({_hook('fp')}) AS hooks FROM g GROUP BY ALL) SELECT generation, stream, count(*) AS segments, CAST(sum(chunks) AS BIGINT) AS chunks, CAST(sum(hooks) AS BIGINT) AS hooks, count(*) FILTER (hooks = 0) AS zero_hook_segments, sum(chunks) / count(*) AS mean_chunks, sum(hooks) / count(*) AS mean_hooks FROM x GROUP BY generation, stream",
    "w5_fixed_segments": _pack_sql("x AS (SELECT *, row_number() OVER (PARTITION BY generation, stream ORDER BY file_seq, chunk_seq) AS i FROM t)", "generation, stream", "CAST(0 AS BIGINT) AS n, size AS held", f"CASE WHEN r.held + x.size >= {SEGMENT} THEN r.n + 1 ELSE r.n END", f"CASE WHEN r.held + x.size >= {SEGMENT} THEN x.size ELSE r.held + x.size END", "SELECT generation, stream, n AS seg, count(*) AS chunks, CAST(sum(size) AS BIGINT) AS bytes FROM r GROUP BY ALL"),
    "w6_containers": _pack_sql(f"{_FIRST}, x AS (SELECT stream, fp, size, row_number() OVER (PARTITION BY stream ORDER BY generation, file_seq, chunk_seq) AS i FROM f WHERE rn = 1)", "stream", f"CAST(CASE WHEN size > 0 THEN 1 ELSE 0 END AS BIGINT) AS n, CASE WHEN size > 0 THEN greatest(0, {CONTAINER} - size) ELSE 0 END AS free", "CASE WHEN r.free < x.size THEN r.n + 1 ELSE r.n END", f"CASE WHEN r.free < x.size THEN greatest(0, {CONTAINER} - x.size) ELSE r.free - x.size END", "SELECT stream, n AS container, count(*) AS chunks, CAST(sum(size) AS BIGINT) AS bytes FROM r GROUP BY ALL"),
    "w7_blocks": _W7 + " SELECT generation, stream, block, count(*) AS fps FROM b GROUP BY ALL",
    "a7_blocks_per_chunk": _W7 + ", c AS (SELECT generation, fp, count(*) AS n FROM b GROUP BY ALL), l AS (SELECT generation, list_sort(list(n)) AS x, sum(n) / count(*) AS mean FROM c GROUP BY generation) SELECT generation, mean, x[1] AS least, x[-1] AS most, x[CAST(floor(len(x) * 0.25) AS BIGINT) + 1] AS p25, x[CAST(floor(len(x) * 0.5) AS BIGINT) + 1] AS p50, x[CAST(floor(len(x) * 0.75) AS BIGINT) + 1] AS p75, x[CAST(floor(len(x) * 0.9) AS BIGINT) + 1] AS p90 FROM l",
    "p12_window_distinct": f"WITH {_SIZES} SELECT * FROM v",
    "a12_index_size": f"WITH {_SIZES} SELECT generation, max(index_size) AS max_index_size, sum(index_size) / count(*) AS avg_index_size FROM v GROUP BY generation",
    "w9_finish_rounds": f"WITH {_TRACE} SELECT generation, stream, count(*) AS finish_round FROM t GROUP BY ALL",
    "w10_lru_hits": f"WITH {_TRACE}, p AS (SELECT stream, fp, row_number() OVER (PARTITION BY stream ORDER BY generation, file_seq, chunk_seq) AS pos FROM t), q AS (SELECT *, lag(pos) OVER (PARTITION BY stream, fp ORDER BY pos) AS prev FROM p) SELECT stream, count(*) AS chunks, CAST(coalesce(sum((prev IS NOT NULL AND (SELECT count(DISTINCT o.fp) FROM p o WHERE o.stream = q.stream AND o.pos > q.prev AND o.pos < q.pos) < {LRU})::INT), 0) AS BIGINT) AS hits FROM q GROUP BY stream",
    "o2_sorted_pages": _pages_sql("SELECT * FROM p"),
    "o3_first_page": f"WITH {_TRACE} SELECT DISTINCT fp FROM t WHERE generation = 0 ORDER BY fp LIMIT {ENTRIES}",
    "o4_page_count": _pages_sql("SELECT max(page) + 1 AS pages, count(*) AS entries FROM p"),
    "o5_page_ends": _pages_sql("SELECT page, max(fp) AS last_fp FROM p GROUP BY page"),
    "o6_stream_heads": f"WITH {_HEADS} SELECT stream, count(*) AS chunks, max(fp) AS last_fp FROM hd WHERE generation = 0 AND n <= 50 GROUP BY stream",
    "o7_chunks_up_to": f"WITH {_TRACE}, {_FIRST_PAGE} SELECT stream, count(*) AS chunks, count(DISTINCT fp) AS fps FROM t WHERE generation = 1 AND fp <= (SELECT max(fp) FROM fpg) GROUP BY stream",
    "o12_client_order": f"WITH {_TRACE} SELECT stream, row_number() OVER (ORDER BY md5(stream || '|42')) AS rn FROM (SELECT DISTINCT stream FROM t)",
    "j8_page_lookup": _pages_sql(", e AS (SELECT page, max(fp) AS last_fp FROM p GROUP BY page) SELECT q.fp, coalesce((SELECT min(page) FROM e WHERE last_fp >= q.fp), (SELECT max(page) FROM e)) AS page FROM (SELECT DISTINCT fp FROM t WHERE generation = 1) q"),
    "x6_predictions": f"WITH {_HEADS}, {_FIRST_PAGE} SELECT stream, count(*) FILTER (fp IN (SELECT fp FROM fpg)) AS hits, count(*) FILTER (fp IN (SELECT fp FROM fpg)) / count(*) AS hit_rate, count(*) FILTER (fp IN (SELECT fp FROM fpg)) / (SELECT count(*) FROM fpg) AS utility FROM hd WHERE generation = 1 AND n <= 1000 AND fp <= (SELECT max(fp) FROM fpg) GROUP BY stream",
    "p6_sorted_index": f"WITH {_P6} SELECT * FROM z",
    "a10_index_ratios": f"WITH {_P6} SELECT generation, stream, CASE WHEN mem_hits + disk_hits + disk_misses = 0 THEN 0.0 ELSE (mem_hits + disk_hits) / (mem_hits + disk_hits + disk_misses) END AS hit_ratio, CASE WHEN disk_hits + disk_misses = 0 THEN 0.0 ELSE disk_hits / (disk_hits + disk_misses) END AS disk_hit_ratio, CASE WHEN disk_misses = 0 THEN 0.0 ELSE disk_hits / (disk_misses * {ENTRIES}) END AS page_utility FROM z",
    "j10_head_merge": f"WITH {_HEADS}, y AS (SELECT DISTINCT stream, fp FROM hd WHERE generation = 0 AND n <= 100), v AS (SELECT a.stream AS i, b.stream AS j FROM (SELECT DISTINCT stream FROM y) a JOIN (SELECT DISTINCT stream FROM y) b ON a.stream < b.stream), z AS (SELECT DISTINCT i, j, fp FROM v JOIN y ON y.stream IN (i, j)) SELECT i, j, fp FROM (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY fp) AS rn FROM z) WHERE rn <= 100",
    "p8_merge_pages": f"WITH {_MERGE} SELECT * FROM m",
    "a11_page_utility": f"WITH {_MERGE}, kn AS (SELECT generation, count(DISTINCT t.fp) AS known FROM t JOIN d ON d.fp = t.fp WHERE since < generation GROUP BY generation) SELECT m.generation, known / {ENTRIES} / pages_touched AS page_utility FROM m JOIN kn ON kn.generation = m.generation",
    "p9_page_usage": f"WITH {_PAGES}, o AS (SELECT stream, row_number() OVER (ORDER BY md5(stream || '|42')) AS rn FROM (SELECT DISTINCT stream FROM t)), e AS (SELECT page, max(fp) AS last_fp FROM pg WHERE g = 2 GROUP BY page), q AS (SELECT DISTINCT stream, fp FROM t WHERE generation = 2), l AS (SELECT fp, coalesce((SELECT min(page) FROM e WHERE last_fp >= v.fp), (SELECT max(page) FROM e)) AS page FROM (SELECT DISTINCT fp FROM q) v) SELECT s.rn AS clients, count(DISTINCT page) AS pages FROM o s JOIN o ON o.rn <= s.rn JOIN q ON q.stream = o.stream JOIN l ON l.fp = q.fp WHERE s.rn = 1 OR s.rn % 5 = 0 GROUP BY s.rn",
    "x5_page_utility": f"WITH {_HEADS}, y AS (SELECT DISTINCT stream, fp FROM hd WHERE generation = 0 AND n <= 100), v AS (SELECT a.stream AS i, b.stream AS j FROM (SELECT DISTINCT stream FROM y) a, (SELECT DISTINCT stream FROM y) b WHERE a.stream <> b.stream), z AS (SELECT i, j, fp, max((y.stream = i)::INT) AS mine FROM v JOIN y ON y.stream IN (i, j) GROUP BY ALL) SELECT i, j, sum(mine) / count(*) AS utility FROM (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY fp) AS rn FROM z) WHERE rn <= 20 GROUP BY i, j",
    "j5_candidates": f"WITH {_CANDIDATES} SELECT sid, candidate, count(*) AS hooks FROM c GROUP BY ALL",
    "o9_recent_segments": f"WITH {_CANDIDATES} SELECT * FROM c",
    "o8_champions_one": f"WITH {_CHAMPIONS} SELECT * FROM b",
    "p5_sparse_m1": f"WITH {_CHAMPIONS}, {_FIRST}, i AS (SELECT DISTINCT generation, stream, seg, sid FROM h), x AS (SELECT g.generation, g.stream, g.fp, f.rn, sid FROM g JOIN f ON f.generation = g.generation AND f.stream = g.stream AND f.file_seq = g.file_seq AND f.chunk_seq = g.chunk_seq LEFT JOIN i ON i.generation = g.generation AND i.stream = g.stream AND i.seg = g.seg), v AS (SELECT DISTINCT sid, fp FROM x WHERE sid IS NOT NULL), w AS (SELECT b.sid, v.fp FROM b JOIN v ON v.sid = b.champion), y AS (SELECT x.*, w.fp IS NOT NULL AS hit FROM x LEFT JOIN w ON w.sid = x.sid AND w.fp = x.fp) SELECT generation, stream, count(*) AS chunks, count(*) FILTER (hit) AS detected, count(*) FILTER (NOT hit AND rn = 1) AS unique_chunks, count(*) FILTER (NOT hit AND rn > 1) AS undetected FROM y GROUP BY generation, stream",
    "s5_s6_s8_trace_files": f"WITH {_TRACE} SELECT generation, stream, filename, count(*) - count(*) // 2 AS chunk_count, count(*) AS chunks, CAST(sum(size) AS BIGINT) AS bytes, md5(string_agg(fp, '' ORDER BY chunk_seq)) AS hash FROM t GROUP BY ALL",
    "s7_legacy_trace_files": f"WITH {_TRACE}, e AS (SELECT *, coalesce(min(CASE WHEN size >= 65536 THEN chunk_seq END) OVER (PARTITION BY generation, stream, filename) > chunk_seq, true) AS ok FROM t) SELECT generation, stream, filename, count(*) FILTER (ok) AS chunks, CAST(coalesce(sum(size) FILTER (ok), 0) AS BIGINT) AS bytes, md5(coalesce(string_agg(fp, '' ORDER BY chunk_seq) FILTER (ok), '')) AS hash FROM e GROUP BY ALL",
    "s1_s9_listing": f"WITH {_TRACE}, x AS (SELECT DISTINCT generation, stream FROM t) SELECT 'multi' AS dataset, 'gen_' || (generation * 7 + 3) || '_' || stream || '-cdc8' AS name, generation * 7 + 3 AS id, generation, stream FROM x UNION ALL SELECT DISTINCT 'jgu4', 'ma1_w' || (generation + 8) || '_r1-cdc8', generation + 8, (SELECT max(generation) FROM x) - generation, 'host0' FROM x",
    "p7_one_index": f"""WITH {_TRACE}, l AS (SELECT generation + ('0x' || substr(md5(stream), 1, 2))::INT % 3 AS generation, stream, fp FROM t), o AS (SELECT generation, stream, fp, count(*) AS n FROM l GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY generation, stream) = 1 AS is_new, min(generation) OVER (PARTITION BY fp) AS since FROM o),
pg AS (SELECT g, fp, (row_number() OVER (PARTITION BY g ORDER BY fp) - 1) // {ENTRIES} AS page FROM (SELECT fp, since FROM r WHERE is_new) JOIN (SELECT DISTINCT generation AS g FROM l) ON since < g),
b AS (SELECT r.*, page FROM r LEFT JOIN pg ON g = generation AND pg.fp = r.fp)
SELECT CAST(0 AS BIGINT) AS index, CAST(generation AS INTEGER) AS generation, stream, CAST(sum(n) AS BIGINT) AS chunks, count(*) FILTER (is_new) AS unique_chunks, CAST(sum(n) AS BIGINT) - count(*) FILTER (is_new) AS redundant_chunks, CAST(sum(n - 1) AS BIGINT) AS consecutive,
  count(*) FILTER (NOT is_new AND page IS NULL) AS mem_hits, count(page) - count(DISTINCT page) FILTER (page > 0) AS disk_hits, count(DISTINCT page) FILTER (page > 0) AS disk_misses FROM b GROUP BY ALL""",
    "event_first_seen": "WITH t AS (SELECT CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 7) AS INTEGER) AS generation, event_type AS stream, event_id, substr(md5(user_id || '|' || coalesce(props, '')), 1, 24) AS fp FROM events), x AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY event_id) AS rn FROM t) SELECT generation, stream, count(*) AS new FROM x WHERE rn = 1 GROUP BY ALL",
    "lineitem_fp_frequency": "WITH t AS (SELECT l_returnflag || l_linestatus AS stream, substr(md5(l_partkey || '|' || CAST(l_quantity AS INTEGER)), 1, 24) AS fp FROM lineitem), x AS (SELECT fp, count(*) AS n, count(DISTINCT stream) AS k FROM t GROUP BY fp) SELECT n, k, count(*) AS fps FROM x GROUP BY ALL",
    **{k: f"WITH {_TRACE}, {_FIRST} SELECT generation, stream, count(*) FILTER (rn = 1) AS unique_chunks, count(*) FILTER (rn > 1) AS redundant_chunks FROM f GROUP BY ALL" for k in simulate.STRICT},
}
