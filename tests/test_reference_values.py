import dataclasses
import json
import random

import pytest
from pyspark.sql import functions as F

from chunklens.functions import fingerprint as fx
from chunklens.operators import segments, sortedindex
from chunklens.plans import similarity
from chunklens.plans.simulate import FIELDS, BlockRun, ContainerRun, Lru, merge_rounds, run, trace_groups
from chunklens.sources import formats, sinks
from chunklens.sources.config import read_config
from chunklens.sources.trace import data_set, host, trace_files
from chunklens.streaming.first_seen import GenerationSink, first_seen

TRACE = "generation int, stream string, file_seq bigint, filename string, chunk_seq int, fp string, size bigint"


def fp_first(i):
    return bytes([i, *[0] * 11]).hex()


def trace(spark, rows):
    return spark.createDataFrame([(g, s, 0, "f", i, fp, n) for i, (g, s, fp, n) in enumerate(rows)], TRACE)


def test_hooks_match_bits(spark):
    pick = random.Random(1)
    fps = [pick.randbytes(12).hex() for _ in range(500)] + ["00" * 12, "0020" + "00" * 10, "0400" + "11" * 10, "00fc" + "11" * 10]
    df = spark.createDataFrame([(x,) for x in fps], "fp string")
    for factor in (0, 3, 5, 8, 10):
        whole, bits = divmod(factor, 8)
        want = [x for x in fps if all(b == 0 for b in bytes.fromhex(x)[:whole]) and bytes.fromhex(x)[whole] & ((1 << bits) - 1) == 0]
        assert sorted(r.fp for r in df.where(fx.is_hook(F.col("fp"), factor)).collect()) == sorted(want)
    want = [x for x in fps if int.from_bytes(bytes.fromhex(x)[:4], "little") % 7 == 0]
    assert sorted(r.fp for r in df.where(fx.is_landmark(F.col("fp"), 7)).collect()) == sorted(want)
    assert 0.15 < df.where(fx.dice(F.col("fp")) < 0.25).count() / len(fps) < 0.35


@pytest.mark.parametrize(("page", "count"), [(24, 100), (48, 50), (49, 50), (24_000, 1)])
def test_page_counts(spark, page, count):
    fps = spark.createDataFrame([(fp_first(i),) for i in range(100)], "fp string")
    pages = sortedindex.paged(fps, page // 24)
    rows = {r.fp: r.page for r in pages.collect()}
    assert rows == {fp_first(i): i // (page // 24) for i in range(100)}
    assert sortedindex.page_ends(pages).count() == count


def test_page_lookup_is_the_lower_bound(spark):
    pick = random.Random(2)
    index = sorted({pick.randbytes(12).hex() for _ in range(200)})
    probes = [pick.randbytes(12).hex() for _ in range(100)] + index[:20] + ["0" * 24, "f" * 24]
    pages = sortedindex.paged(spark.createDataFrame([(x,) for x in index], "fp string"), 7)
    found = {r.fp: r.page for r in sortedindex.page_lookup(spark.createDataFrame([(x,) for x in probes], "fp string"), pages).collect()}
    assert found == {p: min(sum(x < p for x in index), len(index) - 1) // 7 for p in probes}


@pytest.mark.parametrize(("a", "b", "entries", "want"), [([42], [17], 100, (0.5, 0.5)), ([42], [17], 1, (0.0, 1.0)), ([42], [42], 100, (1.0, 1.0)), ([42, 68, 70], [17], 100, (0.75, 0.25))])
def test_page_utility(spark, a, b, entries, want):
    heads = spark.createDataFrame([("a", fp_first(i)) for i in a] + [("b", fp_first(i)) for i in b], "stream string, fp string")
    found = {r.i: r.utility for r in sortedindex.page_utility(heads, entries).collect()}
    assert (found["a"], found["b"]) == want


@pytest.mark.parametrize(("threshold", "groups"), [(1.0, 2), (0.0, 1), (0.6, 2), (0.2, 1), (0.5, 1)])
def test_trace_groups(threshold, groups):
    heads = {"a": {42}, "b": {17}, "c": {42}}
    utility = {(i, j): len(heads[i]) / len(heads[i] | heads[j]) for i in heads for j in heads if i != j}
    assert len(trace_groups(utility, list(heads), threshold)) == groups


def test_champions_prefer_the_larger_id(spark):
    rows = [(9, f"h{i}", 5) for i in range(32)] + [(9, f"h{i}", c) for c in (1, 2, 3, 4, 6) for i in range(16)]
    found = segments.champions(spark.createDataFrame(rows, "sid bigint, fp string, candidate bigint"), 5).collect()
    assert [(r.champion, r.hooks) for r in found] == [(5, 32)]
    tie = spark.createDataFrame([(9, "a", 1), (9, "a", 2)], "sid bigint, fp string, candidate bigint")
    assert [r.champion for r in segments.champions(tie, 5).collect()] == [2]


def test_recent_segments_are_the_newest(spark):
    hooks = spark.createDataFrame([(s, "h") for s in range(1, 10)], "sid bigint, fp string")
    found = segments.recent_segments(hooks, 5).where("sid = 9").collect()
    assert sorted(r.candidate for r in found) == [4, 5, 6, 7, 8]


def test_lru():
    cache = Lru(10)
    for i in range(20):
        cache.put(i)
    assert list(cache) == list(range(10, 20)) and cache.touch(10) and not cache.touch(0)
    cache.put(99)
    assert 11 not in cache and 10 in cache


@pytest.mark.parametrize("make", [lambda: BlockRun(262_144, 4, 2048, 1024, False, page=42), lambda: ContainerRun(4_000_000, 8, 1024, True)])
def test_distinct_chunks_are_unique_and_then_redundant(spark, make):
    rows = [(g, "s", fp_first(i % 256)[:2] + f"{i:022x}", 12) for g in (0, 1) for i in range(1000)]
    found = {r.generation: r for r in run(trace(spark, rows), {"x": make}, factor=5).collect()}
    assert (found[0].unique_chunks, found[0].redundant_chunks) == (1000, 0) and (found[1].unique_chunks, found[1].redundant_chunks) == (0, 1000)


def test_sampled_block_runs_remember_chunks_that_are_no_hooks_only_on_misses():
    """A new chunk that the caches find is not in the index: when they have lost it, it counts as new, not as undetected."""
    state, n = BlockRun(40, 4, 1, 0, False, page=1), dict.fromkeys(FIELDS, 0)
    state.chunk("s", 1, 20, False, False, n)
    state.chunk("s", 2, 20, False, False, n)  # fills the block, and is found in it
    assert 1 in state.index and (2 in state.index) == (n["unique_chunks"] == 2)
    found = n["unique_chunks"]
    state.streams["s"]["where"].clear()
    state.streams["s"]["cached"].clear()
    state.streams["s"]["mapping"], state.blocks = set(), {}
    state.chunk("s", 2, 5, False, False, n)
    assert (n["undetected"], n["unique_chunks"]) == ((1, found) if found == 2 else (0, found + 1))


def test_counters_of_container_runs(spark):
    """Each chunk goes one way: a negative filter, one of the caches, or an index look-up."""
    pick = random.Random(9)
    rows = [(g, s, f"{pick.randrange(90):024x}", pick.randrange(1, 50)) for g in range(3) for s in "ab" for _ in range(80)]
    own = run(trace(spark, rows), {"x": lambda: ContainerRun(200, 2, 4, True)}, false_positive=0.3).collect()
    for r in own:
        negative = r.unique_chunks + r.redundant_chunks - r.chain_runs
        assert r.chain_runs == r.current_container_hits + r.chunk_cache_hits + r.open_container_hits + r.cache_hits + r.lookups
        assert negative + r.false_positives == r.unique_chunks == r.index_updates and r.fetches + r.false_positives == r.lookups
    assert sum(r.false_positives for r in own) > 0 and sum(r.open_container_hits for r in own) > 0


def test_equal_chunks_hit_the_open_block(spark):
    found = run(trace(spark, [(0, "s", "ab" * 12, 20)] * 10), {"x": lambda: BlockRun(262_144, 4, 2048, 0, False)}).first()
    assert (found.unique_chunks, found.write_cache_hits) == (1, 9)


def test_container_runs_without_bounds_have_no_misses_but_lookups(spark):
    pick = random.Random(4)
    rows = [(g, s, f"{pick.randrange(60):024x}", pick.randrange(1, 50)) for g in range(3) for s in "ab" for _ in range(80)]
    own = run(trace(spark, rows), {"all": lambda: ContainerRun(200, None, None, True), "none": lambda: ContainerRun(200, 1, 0, True)}).groupBy("run").agg(F.sum("unique_chunks").alias("u"), F.sum("redundant_chunks").alias("r"), F.sum("lookups").alias("l")).collect()
    found = {r.run: r for r in own}
    assert {r.u for r in own} == {len({x[2] for x in rows})} and all(r.u + r.r == len(rows) for r in own) and found["none"].l > found["all"].l


def test_merge_rounds_of_one_stream_are_the_page_set(spark):
    pick = random.Random(5)
    for _ in range(3):
        index = sorted({f"{pick.randrange(400):024x}" for _ in range(60)})
        own = sorted({f"{pick.randrange(500):024x}" for _ in range(80)})
        pages = sortedindex.paged(spark.createDataFrame([(x,) for x in index], "fp string"), 5)
        found = merge_rounds(spark.createDataFrame([("s", i, x) for i, x in enumerate(own)], "stream string, pos int, fp string"), pages).first()
        low = [x for x in own if x <= index[-1]]
        assert found.pages == len({sum(y < x for y in index) // 5 for x in low}) + len(own) - len(low)


def test_every_stream_has_the_index_of_one(spark):
    """Each stream's statistics are those of sorted_index_stats over it alone, whatever its name."""
    pick = random.Random(7)
    rows = [(g, s, f"{pick.randrange(25):024x}", 1) for g in range(4) for s in ("a", "b", "src7") for _ in range(pick.randrange(1, 40)) if (g, s) != (2, "b")]
    rows += [(0, "c", "0" * 24, 1), (1, "c", "f" * 24, 1), (2, "c", "f" * 24, 1), (3, "c", "f" * 24, 1), (0, None, "ab" * 12, 1), (1, None, "ab" * 12, 1)]
    t = trace(spark, rows)
    found = {(r.generation, r.stream): tuple(r[2:]) for r in sortedindex.stream_index_stats(t, 3).collect()}
    names = sorted({r[1] for r in rows} - {None})
    for s in [*names, None]:
        own = spark.createDataFrame([(g, "x", i, fp) for i, (g, fp) in enumerate(sorted((r[0], r[2]) for r in rows if r[1] == s))], "generation int, stream string, pos int, fp string")
        assert {g: x for (g, name), x in found.items() if name == s} == {r.generation: tuple(r[1:]) for r in sortedindex.sorted_index_stats(own, 3).collect()}
    heads = {}
    for r in sortedindex.merged_heads(t, 10).collect():
        heads.setdefault((r.i, r.j), set()).add(r.fp)
    assert heads == {(i, j): set(sorted({r[2] for r in rows if r[1] in (i, j)})[:10]) for i in names for j in names if i < j}


def index_model(rows, entries, threshold):
    """Streams on shared indexes, chunk by chunk: {(index, generation, stream): counters}."""
    out, indexes, made_for, bound = {}, [], [], {}

    def share(own, other):
        page = sorted(own | other)[:entries]
        return sum(x in own for x in page) / len(page)

    for g in sorted({r[0] for r in rows}):
        streams = {s: sorted(r[2] for r in rows if r[:2] == (g, s)) for s in sorted({r[1] for r in rows if r[0] == g})}
        on, fresh = {}, []
        for s, fps in streams.items():
            best = None
            for i, index in enumerate(indexes):
                worth = share(set(sorted(index)[:entries]), set(fps)) * made_for[i] / (1 + made_for[i]) / 2
                if worth >= threshold and (best is None or worth >= best[0]):
                    best = worth, i
            if s in bound:
                on[s] = bound[s]
            elif best:
                on[s] = best[1]
            else:
                fresh.append(s)
        groups = trace_groups({(a, b): share(set(streams[a]), set(streams[b])) for a in fresh for b in fresh if a != b}, fresh, threshold) if fresh else []
        for group in groups:
            for s in group:
                on[s] = bound[s] = len(indexes)
            indexes.append(set())
            made_for.append(len(group))
        disk, memory = [sorted(x) for x in indexes], [set() for _ in indexes]
        for s, fps in streams.items():
            n, current, last = dict.fromkeys(("chunks", "unique", "consecutive", "memory", "hits", "misses"), 0), 0, "0" * 24
            for fp in fps:
                n["chunks"] += 1
                if fp == last:
                    n["consecutive"] += 1
                elif fp in memory[on[s]]:
                    n["memory"] += 1
                elif fp in indexes[on[s]]:
                    page = disk[on[s]].index(fp) // entries
                    n["hits" if page == current else "misses"] += 1
                    current = page
                else:
                    n["unique"] += 1
                    memory[on[s]].add(fp)
                last = fp
            out[on[s], g, s] = (n["chunks"], n["unique"], n["chunks"] - n["unique"], n["consecutive"], n["memory"], n["hits"], n["misses"])
        for index, new in zip(indexes, memory, strict=True):
            index |= new
    return out


@pytest.mark.parametrize("threshold", [0.0, 0.1, 0.25, 1.1])
def test_similar_streams_share_an_index(spark, threshold):
    pick = random.Random(8)
    begin = {"a": 0, "b": 0, "c": 1, "d": 1, "e": 2}
    rows = [(g, s, f"{pick.randrange(40) + 30 * (i % 2):024x}") for i, (s, at) in enumerate(begin.items()) for g in range(at, 4) for _ in range(25)]
    found = similarity.similarity_index_stats(spark.createDataFrame(rows, "generation int, stream string, fp string"), 4, threshold).collect()
    want = index_model(rows, 4, threshold)
    assert {tuple(r[:3]): tuple(r[3:]) for r in found} == want and len(found) == len(want)
    assert len({r[0] for r in found}) == {0.0: 1, 1.1: len({s for s in begin})}.get(threshold, len({k[0] for k in want}))
    empty = spark.createDataFrame([], "generation int, stream string, fp string")
    assert similarity.similarity_index_stats(empty, 4, threshold).isEmpty()


def test_containers_and_blocks(spark):
    t = trace(spark, [(0, "s", f"{i:024x}", n) for i, n in enumerate([60, 50, 40, 200, 10])])
    assert [r.container for r in segments.containers(t, 100).orderBy("chunk_seq").collect()] == [1, 2, 2, 3, 4]
    found = segments.blocks(t, 100).groupBy("block").agg(F.count("*").alias("n")).orderBy("block").collect()
    assert [(r.block, r.n) for r in found] == [(0, 2), (1, 3), (2, 2), (3, 1)]
    assert [r.seg for r in segments.fixed_segments(t, 100).orderBy("chunk_seq").collect()] == [0, 1, 1, 2, 3]


def test_formats_round_trip(spark, tmp_path):
    formats.register(spark)
    chunks = [(b"wusawig" + bytes([i % 256]), i) for i in range(50)]
    data = formats.encode_entry("a", chunks[:20], 7, "t", "l", partial=True) + formats.encode_entry("b", []) + formats.encode_entry("a", chunks[20:], 9)
    (tmp_path / "gen_1_x").write_bytes(data)
    (tmp_path / "gen_0_x").write_bytes(b"")
    rows = spark.read.format("chunk_trace_pb").load(str(tmp_path))
    assert rows.where("chunk_seq is not null").count() == 50 and rows.where("filename = 'b'").count() == 1
    whole = formats.assemble(rows).orderBy("chunk_seq").collect()
    assert [(r.fp, r.size, r.chunk_count) for r in whole] == [(d.hex().ljust(24, "0"), n, 30) for d, n in chunks]
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert formats.parse(files).count() == rows.count()
    listing = tmp_path / "listing"
    listing.mkdir()
    for name in ("gen_10_x", "gen_9_x", "other"):
        (listing / name).write_bytes(data)
    listed = trace_files(spark, str(listing), "multi").orderBy("generation").collect()
    assert [(r.generation, r.id, r.stream) for r in listed] == [(0, 9, "x"), (1, 10, "x")]
    folder = tmp_path / "imt"
    folder.mkdir()
    record = b"\x18" + (100).to_bytes(4, "little") + bytes(range(20))
    (folder / "chunks-upb-3-rabin8").write_bytes(b"f1\t5\ttxt\n" + record * 2 + b"0\nf2\t6\n" + b"\x18" + (1 << 16).to_bytes(4, "little") + bytes(20) + record + b"0\n")
    legacy = spark.read.format("chunk_trace_legacy").load(str(folder)).collect()
    assert [(r.filename, r.chunk_seq, r.size) for r in legacy] == [("f1", 0, 100), ("f1", 1, 100), ("f2", None, None)]
    assert formats.parse(spark.read.format("binaryFile").load(str(folder))).where("size = 100").count() == 2


def test_registry():
    assert data_set("jgu4")[1:] == (True, 8192) and data_set("multi_x")[1:] == (False, 8192) and data_set("jgu20_cdc16r")[2] == 16 * 1024
    assert host("gen_3_hostA-cdc8", "multi") == "hostA" and host("x", "jgu4") == "host0"
    with pytest.raises(ValueError):
        data_set("nothing")


def test_sinks(spark, tmp_path):
    stats = spark.createDataFrame([(0, "a", 3, 0.1), (0, "total", 3, 0.1)], "generation int, stream string, n int, r double")
    sinks.results_json(stats, str(tmp_path / "r.json"))
    sinks.list_json(stats, str(tmp_path / "l.json"))

    assert json.loads((tmp_path / "r.json").read_text()) == {"generation 0": {"a": {"n": 3, "r": 0.1}, "total": {"n": 3, "r": 0.1}}}
    assert len(json.loads((tmp_path / "l.json").read_text())) == 2
    sinks.io_trace(spark.createDataFrame([("fooId", 2)], "stream string, id bigint"), str(tmp_path / "io"))
    assert spark.read.text(str(tmp_path / "io")).first()[0] == "fooId\t2"
    sinks.lines(stats, "n", str(tmp_path / "t"), by="generation")
    assert spark.read.text(str(tmp_path / "t")).count() == 2
    sinks.statistics(stats, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).count() == 2


def test_nested_results(spark, tmp_path):
    read = lambda: json.loads((tmp_path / "r.json").read_text())
    similarity = spark.createDataFrame([(0, 0.5)], "generation int, ratio double")
    streams = spark.createDataFrame([(0, "a", 1), (0, "b", 2), (1, "a", 3)], "generation int, stream string, n int")
    total = spark.createDataFrame([(0, "total", 3), (1, "total", 3)], "generation int, stream string, n int")
    sinks.analysis_json(similarity, streams, total, str(tmp_path / "r.json"))
    assert read() == {"generation 0": {"similarity": {"ratio": 0.5}, "streams": {"a": {"n": 1}, "b": {"n": 2}}, "total": {"n": 3}}, "generation 1": {"similarity": {}, "streams": {"a": {"n": 3}}, "total": {"n": 3}}}
    usage = spark.createDataFrame([(1, "a", 4), (1, "total", 4)], "clients int, stream string, pages int")
    sinks.page_usage_json(usage, str(tmp_path / "r.json"), start=spark.createDataFrame([(9,)], "pages int"))
    assert read() == {"0": {"total": {"pages": 9}}, "1": {"a": {"pages": 4}, "total": {"pages": 4}}}
    sinks.page_usage_json(usage.limit(0), str(tmp_path / "r.json"))
    assert read() == {}


def test_config(spark, tmp_path):
    kind = dataclasses.make_dataclass("Config", [("data_set", str), ("segment_size", int, 7), ("sample", int, 5)])
    write = lambda text: (tmp_path / "c.json").write_text(text) and str(tmp_path / "c.json")
    assert read_config(spark, write('{"DataSet": "x",\n "SegmentSize": 3, "Sample": null, "Other": 1}'), kind) == kind("x", 3, 5)
    for text, error in (("[1]", ValueError), ('{"DataSet": "x", "data_set": "y"}', ValueError), ("{}", TypeError)):
        with pytest.raises(error):
            read_config(spark, write(text), kind)


def test_stream_of_generations(spark, tmp_path):
    pick = random.Random(6)
    rows = [(g, s, f"{pick.randrange(50):024x}", 1) for g in range(3) for s in "ab" for _ in range(30)]
    all_of = trace(spark, rows)
    for g in range(3):
        all_of.where(F.col("generation") == g).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    sink = GenerationSink(str(tmp_path / "out"))
    stream = spark.readStream.schema(all_of.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sink.stats(spark).agg(F.sum("unique_chunks")).first()[0] == len({r[2] for r in rows})
    query = first_seen(stream).writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("firsts").count() == len({r[2] for r in rows})
