"""Near-duplicate documents by SetSketch registers: banding, joint likelihood estimate, exact check.

A document's set is its distinct k-word shingles (hashed to 64 bits). Register i of its sketch is
max(0, min(q + 1, floor(1 - log_b(x)))) of the least exponential variate x that hash function i gives to an element:
sketches merge by the element-wise maximum, and with b near 1 two registers are equal with nearly the probability of
the sets' Jaccard similarity. Equal bands of registers propose pairs; each whose similarity, estimated by maximum
likelihood from the counts of greater, lesser and equal registers and the set sizes, could reach the threshold is
confirmed on the full sets, unless it is linked already.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunklens.llm.components import components, forest
from chunklens.llm.shared import Scratch
from chunklens.llm.textbytes import SPACE_WORDS, blocks, buffers, sequence_hashes, spans, word_hashes

#: Base of the registers; near 1, so that registers are locality-sensitive.
B = 1.001
Q = 65534
_U = np.uint64


def banding(threshold: float, miss: float = 1e-5, registers: int = 160) -> tuple[int, int]:
    """(bands, rows): the longest bands for which a pair at the threshold is missed with probability `miss` at most,
    within so many registers. Where not even bands of one register can do that, bands of one in the number it takes."""
    need = lambda rows: int(np.ceil(np.log(miss) / np.log1p(-(threshold**rows))))
    return next(((need(rows), rows) for rows in range(8, 0, -1) if need(rows) * rows <= registers), (need(1), 1))


def registers(hashes: np.ndarray, firsts: np.ndarray, m: int) -> np.ndarray:
    """SetSketch registers (uint16, one row for each set) of element hashes; set r begins at firsts[r], none is empty."""
    random = np.random.default_rng(20210214)
    times, plus = random.integers(1, 1 << 32, m, dtype=np.uint32) | np.uint32(1), random.integers(0, 1 << 32, m, dtype=np.uint32)
    low = (hashes >> _U(32)).astype(np.uint32)
    out = np.empty((len(firsts), m), np.uint16)
    for i in range(m):
        y = low * times[i]
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        y += plus[i]
        least = np.minimum.reduceat(y, firsts)
        variate = -np.log1p(-(least + 0.5) / 2.0**32)
        out[:, i] = np.clip(np.floor(1 - np.log(variate / 2.0**24) / np.log(B)), 0, Q + 1)
    return out


def merge(*sketches: np.ndarray) -> np.ndarray:
    """The sketch of the union of sets."""
    return np.maximum.reduce(sketches)


def estimate(greater: np.ndarray, less: np.ndarray, equal: np.ndarray, size_u: np.ndarray, size_v: np.ndarray) -> np.ndarray:
    """The similarity j of greatest likelihood of pairs of sketches, given the counts of registers. With shares u and v
    of the sizes and b near 1, registers are greater, less and equal with the chances u - v j, v - u j and j, whose
    likelihood is greatest at the lesser root of a quadratic."""
    u = size_u / (size_u + size_v)
    v = 1 - u
    a, b, c = u * v * (greater + less + equal), greater * v * v + less * u * u + equal * (u * u + v * v), equal * u * v
    return np.minimum((b - np.sqrt(np.maximum(b * b - 4 * a * c, 0))) / (2 * a), np.minimum(u, v) / np.maximum(u, v))


def _sets(texts, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text that has words."""
    for first, _, data, offsets in blocks(texts):
        starts, ends, limits = spans(data, offsets, SPACE_WORDS)
        hashes, row = sequence_hashes(word_hashes(data, starts, ends), limits, k)
        cuts = np.flatnonzero(np.diff(row)) + 1
        for at, own in zip(row[np.concatenate([[0], cuts])] if len(row) else [], np.split(hashes, cuts), strict=False):
            yield first + int(at), np.unique(own)


def _key(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def sketched(docs: DataFrame, k: int, m: int) -> DataFrame:
    """(doc_id, n_shingles, node: digest of the set, regs) of each row; node is null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            for lo in range(0, n, 512):
                part = batch.slice(lo, 512)
                size = part.num_rows
                sizes, nodes, regs = np.zeros(size, np.int64), [None] * size, [None] * size
                pending: list[tuple[int, np.ndarray]] = []

                def flush() -> None:
                    if not pending:
                        return
                    lengths = np.array([len(x) for _, x in pending])
                    made = registers(np.concatenate([x for _, x in pending]), np.concatenate([[0], np.cumsum(lengths)[:-1]]), m)
                    for (at, own), reg in zip(pending, made, strict=True):
                        sizes[at], nodes[at], regs[at] = len(own), _key(own), reg.tobytes()
                    pending.clear()

                held = 0
                for at, own in _sets(part.column(1), k):
                    pending.append((at, own))
                    held += len(own)
                    if held > 400_000:
                        flush()
                        held = 0
                flush()
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(sizes), pa.array(nodes, pa.binary()), pa.array(regs, pa.binary())], ["doc_id", "n_shingles", "node", "regs"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, node binary, regs binary")


def bit_set(bit: DataFrame, bits: int) -> np.ndarray:
    """The set of the numbers below `bits` in column bit, 64 to a word: bits / 8 bytes, whatever the table."""
    words = bit.groupBy(F.expr("cast(bit div 64 as int)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("set")).toArrow()
    out = np.zeros(bits // 64, _U)
    out[words["word"].to_numpy()] = words["set"].to_numpy().view(_U)
    return out


def is_in(sent: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether the low bits of x (unsigned) are in a bit_set()."""
    bit = x & _U(64 * len(sent) - 1)
    return (sent[bit >> _U(6)] >> (bit & _U(63)) & _U(1)).astype(bool)


def filter_bits(rows: DataFrame, least: int = 16, most: int = 26) -> int:
    """A power of two: 16 bits a row, 8 MB at most, so that what is broadcast is bounded. A fuller set lets more rows
    through to the join that follows, and loses none."""
    return 1 << min(most, max(least, (16 * rows.count()).bit_length()))


def _full_sets(docs: DataFrame, some: DataFrame, k: int) -> DataFrame:
    """(node, hashes) of the nodes of `some` (node, min_id), each once. Texts are read where they lie; a bit set of the
    ids says which are wanted, and only the sets of those are exchanged."""
    bits = filter_bits(some)
    mixed = F.expr(f"pmod(xxhash64(min_id), {bits}L)").alias("bit")
    sent = docs.sparkSession.sparkContext.broadcast(bit_set(some.where("min_id is not null").select(mixed), bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_bits = sent.value
        for batch in batches:
            wanted = is_in(own_bits, batch.column(1).to_numpy().view(_U))
            part = batch.column(0).filter(pa.array(wanted))
            for lo in range(0, len(part), 512):
                out = [(_key(own), own.tobytes()) for _, own in _sets(part.slice(lo, 512), k)]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary()) for i in (0, 1)], ["node", "hashes"])

    found = docs.where("doc_id is not null").select("text", F.xxhash64(F.col("doc_id").cast("bigint")).alias("h")).mapInArrow(run, "node binary, hashes binary")
    return found.join(some.select("node"), "node", "left_semi").groupBy("node").agg(F.first("hashes").alias("hashes"))


def _matrix(column, m: int) -> np.ndarray:
    return buffers(column)[0].view(np.uint16).reshape(-1, m)


def _likeness(mine: np.ndarray, theirs: np.ndarray, size: np.ndarray, sizes: np.ndarray, likelihood: bool) -> np.ndarray:
    """The estimated similarity of rows of registers; sizes are those of the sets."""
    equal = (mine == theirs).sum(1)
    if not likelihood:
        return equal / theirs.shape[1]
    less = (theirs > mine).sum(1)
    return estimate(theirs.shape[1] - equal - less, less, equal, size.astype(float), sizes.astype(float))


def _confirmed(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    x, y = (x, y) if len(x) >= len(y) else (y, x)
    if 100 * len(y) < percent * len(x):
        return False
    both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _likely(pairs: DataFrame, m: int, least: float, likelihood: bool) -> DataFrame:
    """(u, v) of the pairs(u, v, regs_u, regs_v, n_u, n_v) whose estimate is `least` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                j = _likeness(_matrix(part.column(2), m), _matrix(part.column(3), m), part.column(4).to_numpy(), part.column(5).to_numpy(), likelihood)
                yield part.select(["u", "v"]).filter(pa.array(j >= least))

    return pairs.select("u", "v", "regs_u", "regs_v", "n_u", "n_v").mapInArrow(run, "u binary, v binary")


def _verified(pairs: DataFrame, percent: int) -> DataFrame:
    """(u, v) of the pairs(u, v, x, y) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [buffers(batch.column(i)) for i in (2, 3)]
            (a, at), (b, to) = [(data.view(_U), offsets // 8) for data, offsets in sides]
            good = [_confirmed(a[at[i] : at[i + 1]], b[to[i] : to[i + 1]], percent) for i in range(batch.num_rows)]
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    return pairs.select("u", "v", "x", "y").mapInArrow(run, "u binary, v binary")


#: Nodes and hashes of a block, and of a part of a band's largest component.
BLOCK, BLOCK_HASHES, PART, PART_HASHES = 512, 1 << 20, 2048, 1 << 21


def _dealt(rest: DataFrame) -> DataFrame:
    """rest(band, node, comp, main, cuts, parts, ...), each row once for each pair of blocks that it is in.

    The nodes of a band that are not of its largest component are cut into blocks by hash; a block meets itself, each
    other one, and all parts of the largest component, whose own pairs are left out.
    """
    rest = rest.withColumn("own", F.expr("cast(pmod(xxhash64(node), if(main, parts, cuts)) as int)"))
    places = F.expr("""if(main, transform(sequence(0, cuts - 1), i -> named_struct('a', i, 'm', true, 'b', own, 'first', false)), concat(
        transform(sequence(0, parts - 1), i -> named_struct('a', own, 'm', true, 'b', i, 'first', true)),
        transform(sequence(0, cuts - 1), i -> named_struct('a', least(own, i), 'm', false, 'b', greatest(own, i), 'first', own <= i))))""")
    return rest.withColumn("place", F.explode(places)).select("band", "place.a", "place.m", "place.b", "place.first", "node", "comp", "regs", "n", *(["hashes"] if "hashes" in rest.columns else []))


def _common(left: list[np.ndarray], right: list[np.ndarray], pairs: np.ndarray, width: int = 4096) -> np.ndarray:
    """The sizes of the intersections of sets of hashes, for the pairs of a matrix of flags: of each pair alone where
    these are few, else as products of incidence matrices over the hashes that several sets have."""
    sizes = np.array([len(x) for x in (*left, *right)])
    out = np.zeros(pairs.shape, np.float32)
    codes, place, count = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    n = int((count > 1).sum())
    if 500 * pairs.sum() * (20 + sizes.mean()) < pairs.size * n:
        for i, j in zip(*np.nonzero(pairs), strict=True):
            x, y = (left[i], right[j]) if len(left[i]) >= len(right[j]) else (right[j], left[i])
            out[i, j] = (x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum()
        return out
    keep = count[place] > 1
    row, at = np.repeat(np.arange(len(sizes)), sizes)[keep], shared[place[keep]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    for lo in range(0, n, width):
        own = slice(*np.searchsorted(at, [lo, lo + width]))
        has = np.zeros((len(sizes), min(width, n - lo)), np.float32)
        has[row[own], at[own] - lo] = 1
        out += has[: len(left)] @ has[len(left) :].T
    return out


def _across(percent: int, m: int, least: float, likelihood: bool):
    """The function for one pair of blocks: with hashes, spanning links (u, v) between components whose nodes' sets are
    similar enough; without, the nodes (u, of band v) that may have one."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        first, nodes = table.column("first").to_numpy(), table.column("node")
        comp = table.column("comp").combine_chunks().dictionary_encode().indices.to_numpy()
        reg, size = _matrix(table.column("regs"), m), table.column("n").to_numpy()
        within = not key[2].as_py() and key[1].as_py() == key[3].as_py()
        left = np.flatnonzero(first)
        right = left if within else np.flatnonzero(~first)
        flat, likely = np.ascontiguousarray(reg[right].T), np.zeros((len(left), len(right)), bool)
        for at, i in enumerate(left):
            mine = reg[i][:, None]
            equal = np.add.reduce((flat == mine).view(np.uint8), axis=0, dtype=np.uint16)
            good = (equal >= m * least) & (comp[right] != comp[i])
            if within:
                good[: at + 1] = False
            if likelihood:
                good &= 100 * np.minimum(size[i], size[right]) >= percent * np.maximum(size[i], size[right])
                js = np.flatnonzero(good)
                less = np.add.reduce((flat[:, js] > mine).view(np.uint8), axis=0, dtype=np.uint16)
                e, n = equal[js].astype(float), size[right[js]].astype(float)
                good[js] = estimate(m - e - less, less, e, np.full(len(js), float(size[i])), n) >= least
            likely[at] = good
        rows, columns = np.flatnonzero(likely.any(1)), np.flatnonzero(likely.any(0))
        if "hashes" not in table.column_names:
            some = nodes.take(pa.array(np.unique(np.concatenate([left[rows], right[columns]]))))
            return pa.table([some, pa.array(np.full(len(some), key[0].as_py()), pa.int64())], ["u", "v"])
        data, offsets = buffers(table.column("hashes"))
        data, offsets = data.view(_U), offsets // 8
        found = np.zeros((0, 2), np.int64)
        if len(rows):
            likely, x, y = likely[np.ix_(rows, columns)], left[rows], right[columns]
            both = _common([data[offsets[i] : offsets[i + 1]] for i in x], [data[offsets[i] : offsets[i + 1]] for i in y], likely)
            i, j = np.nonzero(likely & (100 * both >= percent * (size[x][:, None] + size[y][None, :] - both)))
            found = np.stack([comp[x[i]], comp[y[j]]], 1)
        # A spanning forest of the components, each by its first node here.
        links = forest(found[:, 0], found[:, 1], int(comp.max()) + 1)
        some = np.unique(comp, return_index=True)[1]
        own = np.flatnonzero(links != np.arange(len(links)))
        return pa.table([nodes.take(pa.array(some[own])), nodes.take(pa.array(some[links[own]]))], ["u", "v"])

    return run


def linked(nodes: DataFrame, sets: Callable[[DataFrame], DataFrame], percent: int, rows: int, m: int, scratch: Scratch, likelihood: bool = True) -> DataFrame:
    """(node, root) of the nodes(node, regs, n: size of the set, ...) that are linked with others: 100 * intersection >=
    percent * union. sets gives (node, hashes) for some of the nodes; node is never null, and never repeated.

    Nodes that share a band of `rows` registers are sought in two steps. First every node is held against its band's
    least node alone: estimated, then confirmed on the full sets. What that links makes components. Only in a band whose
    other nodes are of several components the rest is done: pairs of different components, in pairs of blocks (_dealt),
    first on registers alone, then on the full sets of the nodes that have a likely partner. So copies nearer to one
    text than the threshold cost one comparison each, however many they are; no task holds a whole group, and no pairs
    leave a task but links that join components.
    """
    threshold = percent / 100
    least = threshold - 3.5 * (threshold * (1 - threshold) / m) ** 0.5
    bands = F.expr(f"transform(sequence(0, {m // rows - 1}), i -> xxhash64(i, substring(regs, {2 * rows} * i + 1, {2 * rows})))")
    members = nodes.select("node", "n", F.explode(bands).alias("band"))
    hubs = members.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("in_band")).where("in_band > 1")
    near = scratch.keep(members.join(hubs, "band"), "near")
    pairs = near.where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct()
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("regs").alias(f"regs_{x}"), F.col("n").alias(f"n_{x}"))
    likely = scratch.keep(_likely(pairs.join(side("u"), "u").join(side("v"), "v"), m, least, likelihood), "likely")
    wanted = likely.select(F.col("u").alias("node")).union(likely.select("v")).distinct()
    full = scratch.keep(sets(nodes.drop("regs").join(wanted, "node", "left_semi")), "sets")
    of = lambda x, y: full.select(F.col("node").alias(x), F.col("hashes").alias(y))
    direct = scratch.keep(_verified(likely.join(of("u", "x"), "u").join(of("v", "y"), "v"), percent), "direct")
    scratch.drop("likely", "sets")
    found = components(direct, scratch, "direct_links")
    # What else shares a band: not with its hub, and not within a component.
    own = near.where("node <> hub and in_band > 2").select("band", "node", "n").join(found, "node", "left").select("band", "node", "n", F.coalesce("root", "node").alias("comp"))
    counted = own.groupBy("band", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("h"))
    mixed = counted.groupBy("band").agg(F.max(F.struct("c", "comp", "h")).alias("most"), F.sum("c").alias("c"), F.sum("h").alias("h"), F.count("*").alias("comps")).where("comps > 1")
    mixed = mixed.select(
        "band", F.col("most.comp").alias("largest"),
        F.expr(f"cast(greatest(ceil((c - most.c) / {BLOCK}), ceil((h - most.h) / {BLOCK_HASHES})) as int) as cuts"),
        F.expr(f"cast(greatest(ceil(most.c / {PART}), ceil(most.h / {PART_HASHES})) as int) as parts"),
    )
    rest = scratch.keep(own.join(mixed, "band").select("band", "node", "comp", F.expr("comp = largest").alias("main"), "cuts", "parts"), "rest")
    scratch.drop("near")
    if rest.isEmpty():
        return found
    run, keys = _across(percent, m, least, likelihood), ["band", "a", "m", "b"]
    known = rest.join(nodes.select("node", "regs", "n"), "node")
    partners = scratch.keep(_dealt(known).groupBy(*keys).applyInArrow(run, "u binary, v bigint").distinct().select(F.col("u").alias("node"), F.col("v").alias("band")), "partners")
    if partners.isEmpty():
        return found
    full = scratch.keep(sets(nodes.drop("regs").join(partners.select("node").distinct(), "node", "left_semi")), "more_sets")
    known = rest.join(partners, ["band", "node"], "left_semi").join(nodes.select("node", "regs", "n"), "node").join(full, "node")
    more = scratch.keep(_dealt(known).groupBy(*keys).applyInArrow(run, "u binary, v binary"), "more")
    out = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more), scratch)
    scratch.drop("rest", "partners", "more_sets")
    return out


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, miss: float = 1e-5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of docs(doc_id, text, ...).

    Rows are linked if 100 * intersection >= percent * union of their sets of distinct k-word shingles, of words
    between white space with A-Z lower-cased; fewer than k words are one shingle. component_id is the least doc_id
    that can be reached over links, the row's own included; kept says that it is the row's own.

    A text that is null, empty or white space has the empty set and is linked with nothing. Rows with equal sets are
    one node, however many they are; a repeated doc_id is several nodes or one, as its texts differ or not. A null
    doc_id stays null in the result, component_id too, and the row is kept. Other columns of docs are not read; an
    empty table gives an empty result. A pair of sets just at the threshold shares no band with probability `miss` at
    most, and is estimated as more than 3.5 standard errors too low with 0.0003.

    Groups are handled as linked() says.
    """
    spark = docs.sparkSession
    bands, rows = banding(percent / 100, miss)
    m, scratch = bands * rows, Scratch(spark, "near")
    sketches = scratch.keep(sketched(docs, k, m), "sketches")
    nodes = scratch.keep(
        sketches.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("min_id"), F.first("regs").alias("regs"), F.first("n_shingles").alias("n"), F.count("*").alias("copies")), "nodes"
    )
    found = linked(nodes.drop("copies"), lambda some: _full_sets(docs, some, k), percent, rows, m, scratch)
    # Classes of sets that are linked, or that several rows have; the rows of all others are classes of their own.
    named = nodes.where("min_id is not null").select("node", "min_id", "copies").join(found, "node", "left").where("root is not null or copies > 1")
    named = scratch.keep(named.select("node", "min_id", F.coalesce("root", "node").alias("root")), "named")
    least_id = named.groupBy("root").agg(F.min("min_id").alias("component_id"))
    classes = scratch.keep(named.select("node", "root").join(least_id, "root").select("node", "component_id"), "classes")
    scratch.drop("nodes", "named")
    return sketches.select("doc_id", "n_shingles", "node").join(classes, "node", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"),
    )
