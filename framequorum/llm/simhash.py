"""SimHash near-duplicates through a hierarchical index in Gray order."""

from __future__ import annotations

from collections.abc import Callable
from math import cos, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import BROADCAST_ROWS, by_bytes, forget, join_hot, keep, lean, lookup, small_batches, utf8_buffer
from .graph import components, forest, merge

SEED = 42
LEAF = 32
FAN = 8
#: Rows that the index of one chunk takes before it is searched.
CHUNK_ROWS = 50_000
#: Bits of a band where no band is sure to be shared; the same for every number of rows.
BAND_BITS = 13
#: Pairs that are compared at a time.
BLOCK = 1 << 20
#: Close pairs that are handed on at a time; of a block of near copies nearly all are close.
CLOSE = 1 << 18
ONES = np.uint64(0x0101010101010101)
#: Columns that tell cells apart.
CELL = ["band", "key", "ci", "cj"]


def shingle_hashes(text: bytes, words: int) -> list[int]:
    """XXH64 of every run of ``words`` words, repeats included; of the whole sequence if it is shorter."""
    tokens = text.lower().split()
    if not tokens:
        return []
    line = b" ".join(tokens)
    if len(tokens) <= words:
        return [xxhash.xxh64_intdigest(line, SEED)]
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip((ends - sizes)[: len(tokens) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]


def _lane(h: np.ndarray, lane: int) -> np.ndarray:
    """The shingle hashes of a lane; lane 0 has XXH64 itself."""
    if not lane:
        return h
    h = (h ^ np.uint64(lane * 0x9E3779B97F4A7C15 & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def majority_bits(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One 64-bit fingerprint per run of hashes: bits set in over half of them; an empty run gives 0.

    Eight byte-wide counters share a word, so runs are summed in pieces of 255.
    """
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    n = sizes[full]
    pieces = -(-n // 255)
    first = np.cumsum(n) - n
    turn = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    cuts = np.repeat(first, pieces) + 255 * turn
    piece_of = np.cumsum(pieces) - pieces
    for j in range(8):
        counts = np.add.reduceat(hashes >> np.uint64(j) & ONES, cuts).astype("<u8").view(np.uint8).reshape(-1, 8)
        set_bits = 2 * np.add.reduceat(counts.astype(np.int64), piece_of) > n[:, None]
        for k in range(8):
            out[full] |= set_bits[:, k].astype(np.uint64) << np.uint64(8 * k + j)
    return out


def fingerprints(texts: list[bytes], words: int = 3, lanes: int = 1) -> np.ndarray:
    """(texts, lanes) fingerprints."""
    runs = [shingle_hashes(t, words) for t in texts]
    sizes = np.fromiter(map(len, runs), np.int64, len(runs))
    flat = np.fromiter((h for r in runs for h in r), np.uint64, int(sizes.sum()))
    return np.stack([majority_bits(_lane(flat, lane), sizes) for lane in range(lanes)], axis=1) if len(texts) else np.zeros((0, lanes), np.uint64)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of a code word in the reflected Gray order."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ x >> np.uint64(s)
    return x


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int64)


def _apart(x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Differing bits of pairs of rows, a lane at a time: a pair's whole rows are many times its two indexes."""
    out = np.zeros(len(i), np.int64)
    for k in range(x.shape[1]):
        out += np.bitwise_count(x[i, k] ^ x[j, k])
    return out


class GrayIndex:
    """Fingerprints in Gray order under nodes that hold the bits all their members share.

    A node keeps only shared bits that its parent has not, so a search adds up differences on
    the way down and drops a whole group once they exceed the radius.
    """

    def __init__(self, x: np.ndarray):
        self.x = x
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # first row, pattern, own mask
        starts = np.arange(0, len(x), LEAF)
        low, high = np.bitwise_and.reduceat(x, starts), np.bitwise_or.reduceat(x, starts)
        raw = [(starts, low, ~(low ^ high))]
        while len(raw[-1][0]) > FAN:
            starts, pick = raw[-1][0], np.arange(0, len(raw[-1][0]), FAN)
            low, high = np.bitwise_and.reduceat(low, pick), np.bitwise_or.reduceat(high, pick)
            raw.append((starts[pick], low, ~(low ^ high)))
        for depth, (starts, pattern, mask) in enumerate(raw):
            above = raw[depth + 1][2][np.arange(len(starts)) // FAN] if depth + 1 < len(raw) else np.zeros_like(mask)
            self.levels.append((starts, pattern, mask & ~above))
        self.rest = ~np.repeat(raw[0][2], np.diff(np.r_[raw[0][0], len(x)]), axis=0)

    def pairs(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query row, later row) with at most ``radius`` differing bits."""
        top = len(self.levels[-1][0])
        q, node = np.repeat(queries, top), np.tile(np.arange(top), len(queries))
        differ = np.zeros(len(q), np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            starts, pattern, mask = self.levels[depth]
            ends = np.r_[starts[1:], len(self.x)]
            differ = differ + _bits((self.x[q] ^ pattern[node]) & mask[node])
            live = (differ <= radius) & (ends[node] > q + 1)
            q, node, differ = q[live], node[live], differ[live]
            n = (ends - starts if depth == 0 else np.minimum(FAN, len(self.levels[depth - 1][0]) - FAN * np.arange(len(starts))))[node]
            first = starts[node] if depth == 0 else FAN * node
            child = np.repeat(first, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            q, node, differ = np.repeat(q, n), child, np.repeat(differ, n)
        live = node > q
        q, node, differ = q[live], node[live], differ[live]
        near = differ + _bits((self.x[q] ^ self.x[node]) & self.rest[node]) <= radius
        return q[near], node[near]


def close_pairs(x: np.ndarray, radius: int):
    """Blocks of pairs (row, later row) with at most ``radius`` differing bits, every pair compared.

    For radii that no node of the index exceeds; half the words rule out most unlike pairs.
    """
    words = [np.ascontiguousarray(x[:, k]) for k in range(x.shape[1])]
    half = (len(words) + 1) // 2
    step = max(1, BLOCK // max(1, len(x)))
    for at in range(0, len(x) - 1, step):
        differ = np.zeros((min(step, len(x) - at), len(x) - at), np.uint16)
        for w in words[:half]:
            differ += np.bitwise_count(w[at : at + step, None] ^ w[None, at:])
        close = np.flatnonzero(differ <= radius)
        for first in range(0, len(close), CLOSE):
            i, j = np.divmod(close[first : first + CLOSE], len(x) - at)
            i, j = i[j > i] + at, j[j > i] + at
            near = _apart(x, i, j) <= radius
            yield i[near], j[near]


def link_groups(group: np.ndarray, x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, root) of every row that a chain of links within its group ties to an earlier row.

    Groups of one leaf are compared directly; larger ones through their index, or pair by pair
    if the radius is over an eighth of the bits, where the index drops nothing.
    """
    order = np.lexsort((*[gray_rank(x[:, k]) for k in range(x.shape[1] - 1, -1, -1)], group))
    g, x = group[order], x[order]
    begin = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, int)
    size = np.diff(np.r_[begin, len(g)])
    labels = np.arange(len(g))
    rank = np.arange(len(g)) - np.repeat(begin, size)
    own = np.repeat(size, size)
    for d in range(1, min(LEAF, int(size.max(initial=0)))):
        i = np.flatnonzero((own <= LEAF) & (rank + d < own))
        if not len(i):
            break
        i = i[_bits(x[i] ^ x[i + d]) <= radius]
        labels = merge(labels, i, i + d)
    for b, n in zip(begin[size > LEAF].tolist(), size[size > LEAF].tolist(), strict=True):
        if 8 * radius > 64 * x.shape[1]:
            found = close_pairs(x[b : b + n], radius)
        else:
            index = GrayIndex(x[b : b + n])
            # However dense the group, so many queries give no more than BLOCK pairs.
            step = max(1, min(256, BLOCK // n))
            found = (index.pairs(np.arange(at, min(n, at + step)), radius) for at in range(0, n, step))
        local = np.arange(n)
        for i, j in found:
            new = local[i] != local[j]
            if new.any():
                local = merge(local, i[new], j[new])
        labels[b : b + n] = b + local
    tied = np.flatnonzero(labels != np.arange(len(g)))
    return order[tied], order[labels[tied]]


def _closest(n: int, i: np.ndarray, j: np.ndarray, differ: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of a least spanning forest over n rows: sets are joined by their closest pairs."""
    order = np.argsort(differ, kind="stable")
    i, j, differ = i[order], j[order], differ[order]
    labels, cuts = np.arange(n), np.flatnonzero(np.diff(differ, prepend=-1, append=-1))
    used = np.concatenate([np.zeros(0, np.int64), *(a + forest(labels, i[a:b], j[a:b]) for a, b in zip(cuts, cuts[1:], strict=False))])
    return i[used], j[used], differ[used]


def link_trees(group: np.ndarray, x: np.ndarray, radius: int, tiers: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, row) with at most ``radius`` differing bits that tie every linked set of a group together, by its closest pairs.

    As in link_groups, but what comes out are links themselves, fewer than rows, which a
    check can accept or refuse one by one.
    """
    order = np.argsort(group, kind="stable")
    g, x = group[order], x[order]
    begin = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, int)
    size = np.diff(np.r_[begin, len(g)])
    rank, own = np.arange(len(g)) - np.repeat(begin, size), np.repeat(size, size)
    none = np.zeros(0, np.int64)
    small = [(none, none, none)]
    for d in range(1, min(LEAF, int(size.max(initial=0)))):
        i = np.flatnonzero((own <= LEAF) & (rank + d < own))
        differ = _bits(x[i] ^ x[i + d])
        near = differ <= radius
        small.append((i[near], i[near] + d, differ[near]))
    trees = [_closest(len(g), *(np.concatenate(c) for c in zip(*small, strict=True)))[:2]]
    for b, n in zip(begin[size > LEAF].tolist(), size[size > LEAF].tolist(), strict=True):
        part, tree = x[b : b + n], (none, none, none)
        for i, j in close_pairs(part, radius):
            differ = _apart(part, i, j)
            # A pair whose ends pairs of its tier or a closer one have joined already adds nothing.
            tier = tiers * differ // (radius + 1)
            joined = np.tile(np.arange(n), (tiers, 1))
            for t in range(tiers):
                low = tiers * tree[2] // (radius + 1) <= t
                joined[t] = merge(joined[t], tree[0][low], tree[1][low])
            new = joined[tier, i] != joined[tier, j]
            tree = _closest(n, *(np.r_[a, c[new]] for a, c in zip(tree, (i, j, differ), strict=True)))
        trees.append((b + tree[0], b + tree[1]))
    i, j = (np.concatenate(c) for c in zip(*trees, strict=True))
    return order[i], order[j]


def open_pairs(group: np.ndarray, x: np.ndarray, radius: int, component: np.ndarray):
    """Blocks of all pairs (row, row) of a group with at most ``radius`` differing bits whose rows are of different components."""
    order = np.argsort(group, kind="stable")
    g, x, component = group[order], x[order], component[order]
    begin = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, int)
    size = np.diff(np.r_[begin, len(g)])
    rank, own = np.arange(len(g)) - np.repeat(begin, size), np.repeat(size, size)
    for d in range(1, min(LEAF, int(size.max(initial=0)))):
        i = np.flatnonzero((own <= LEAF) & (rank + d < own))
        i = i[component[i] != component[i + d]]
        i = i[_bits(x[i] ^ x[i + d]) <= radius]
        yield order[i], order[i + d]
    for b, n in zip(begin[size > LEAF].tolist(), size[size > LEAF].tolist(), strict=True):
        for i, j in close_pairs(x[b : b + n], radius):
            apart = component[b + i] != component[b + j]
            yield order[b + i[apart]], order[b + j[apart]]


def _words(column: pa.Array, lanes: int) -> np.ndarray:
    raw, _ = utf8_buffer(column)
    return raw.view(">u8").astype(np.uint64).reshape(-1, lanes)


def _band_key(x: np.ndarray, first: int, bits: int) -> np.ndarray:
    """``bits`` bits of each fingerprint from bit ``first`` on."""
    lane, low = divmod(first, 64)
    key = x[:, lane] >> np.uint64(low)
    if low + bits > 64:
        key |= x[:, lane + 1] << np.uint64(64 - low)
    return (key & np.uint64((1 << bits) - 1)).astype(np.int64)


def _bands(lanes: int, bands: list[tuple[int, int]]):
    """Rows (band, key, fp, rep) for each fingerprint; a band is (first bit, bits), bits at most 32."""

    def run(batches):
        for batch in batches:
            x = _words(batch.column(0), lanes)
            for b, (first, bits) in enumerate(bands):
                key = _band_key(x, first, bits)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), b, np.int32)), pa.array(key), batch.column(0), batch.column(1)], names=["band", "key", "fp", "rep"])

    return run


def _linked(lanes: int, radius: int, link: str = "groups", bands: list[tuple[int, int]] = ()):
    """Links within cells: chains (``groups``), trees of the closest, with their cells (``trees``), or all pairs of different components (``open``)."""
    cell = CELL

    def links(table: pa.Table):
        columns = [table.column(c).to_numpy() for c in cell]
        change = np.zeros(table.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        group, x, rep = np.cumsum(change), _words(table.column("fp"), lanes), table.column("rep").to_numpy()
        if link == "open":
            for i, j in open_pairs(group, x, radius, table.column("component").to_numpy()):
                # Every cell that such a pair shares is open; the one of its first band reports it.
                first = np.ones(len(i), bool)
                for b, (at, bits) in enumerate(bands):
                    later = np.flatnonzero(first & (columns[0][i] > b))
                    first[later] = _band_key(x[i[later]], at, bits) != _band_key(x[j[later]], at, bits)
                yield pa.RecordBatch.from_arrays([pa.array(rep[i[first]]), pa.array(rep[j[first]])], names=["a", "b"])
        else:
            row, root = (link_trees if link == "trees" else link_groups)(group, x, radius)
            ends = [pa.array(rep[row]), pa.array(rep[root])]
            yield pa.RecordBatch.from_arrays([*ends, *(pa.array(c[row]) for c in columns)], names=["a", "b", *cell]) if link == "trees" else pa.RecordBatch.from_arrays(ends, names=["a", "b"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < CHUNK_ROWS:
                continue
            table = pa.Table.from_batches(held)
            last = [table.column(c)[rows - 1] for c in cell]
            same = np.ones(rows, bool)
            for c, v in zip(cell, last, strict=True):
                same &= table.column(c).to_numpy() == v.as_py()
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if cut:
                yield from links(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
                rows -= cut
        if rows:
            yield from links(pa.Table.from_batches(held))

    return run


def bands_for(lanes: int, radius: int, exact: bool) -> list[tuple[int, int]]:
    """Bit ranges of which two linked fingerprints share one.

    exact: radius + 1 equal ranges of all bits, so none is missed. Else as many ranges of
    BAND_BITS as fit: narrow enough that few links are missed, however many rows there are.
    """
    total = 64 * lanes
    if exact:
        cut = [total * k // (radius + 1) for k in range(radius + 2)]
        return [(a, min(32, b - a)) for a, b in zip(cut, cut[1:], strict=False)]
    return [(a, BAND_BITS) for a in range(0, total - BAND_BITS + 1, BAND_BITS)]


def near_components(prints: DataFrame, lanes: int = 1, radius: int = 3, exact: bool = True, accept: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(fp, component) of every distinct fingerprint; prints has doc_id and fp (8 bytes a lane).

    Distinct fingerprints, each with its smallest doc_id, are dealt by bands of bits; a band
    key with very many is cut into chunks, each pair of chunks in its own cell, so no task
    holds a whole hot key and no pair is missed. Cells report trees, not pairs.

    With ``accept``, which takes links (a, b) of two ids and returns those that hold, cells
    report trees of their closest links first. Where the links that hold leave a tree in parts,
    its cell is searched once more, and every link between such parts is checked as well: no
    link that holds is left out for closer ones that do not.
    """
    spark = prints.sparkSession
    nodes = keep(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    known = nodes.where("rep is not null")
    rows = known.count()
    bands = bands_for(lanes, radius, exact)
    dealt = known.mapInArrow(lean(_bands(lanes, bands)), "band int, key long, fp binary, rep long")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    limit = max(1000, min(200_000, rows * len(bands) // (8 * partitions)))
    hot = keep(dealt.groupBy("band", "key").count().where(F.col("count") > limit).select(F.struct("band", "key").alias("cell"), F.ceil(F.col("count") / F.lit(float(limit))).cast("int").alias("chunks")))
    if hot.limit(1).count():
        dealt = lookup(dealt.withColumn("cell", F.struct("band", "key")), hot, "cell").drop("cell")
        own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
        dealt = dealt.withColumn("own", F.coalesce(own, F.lit(0))).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("chunks"), F.lit(1)) - 1)))
        dealt = dealt.select("band", "key", F.least("own", "other").alias("ci"), F.greatest("own", "other").alias("cj"), "fp", "rep")
    else:
        dealt = dealt.select("band", "key", F.lit(0).alias("ci"), F.lit(0).alias("cj"), "fp", "rep")
    in_cells = lambda rows: rows.repartition(partitions, *CELL).sortWithinPartitions(*CELL)
    if accept is None:
        tied = components(in_cells(dealt).mapInArrow(lean(_linked(lanes, radius)), "a long, b long"))
    else:
        trees = keep(in_cells(dealt).mapInArrow(lean(_linked(lanes, radius, "trees")), "a long, b long, band int, key long, ci int, cj int"))
        held = keep(accept(trees.select("a", "b")).select("a", "b"))
        tied = components(held)
        of = lambda end: tied.select(F.col("node").alias(f"_{end}"), F.col("component").alias(f"of_{end}"))
        ends = trees.join(of("a"), trees["a"] == F.col("_a"), "left").join(of("b"), trees["b"] == F.col("_b"), "left")
        parted = keep(ends.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select(*CELL).distinct())
        if parted.limit(1).count():
            again = dealt.join(F.broadcast(parted) if parted.count() <= BROADCAST_ROWS else parted, CELL, "left_semi")
            again = again.join(of("a"), again["rep"] == F.col("_a"), "left").select(*CELL, "fp", "rep", F.coalesce("of_a", "rep").alias("component"))
            rest = in_cells(again).mapInArrow(lean(_linked(lanes, radius, "open", bands)), "a long, b long")
            pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
            rest = keep(rest.select(*pair).distinct().join(trees.select(*pair).distinct(), ["a", "b"], "left_anti"))
            tied = components(held.union(accept(rest).select("a", "b")))
            forget(rest)
        forget(trees, held, parted)
    out = keep(nodes.join(tied, nodes["rep"] == tied["node"], "left").select("fp", F.coalesce("component", "rep").alias("component")))
    forget(nodes)
    return out


def text_fingerprints(docs: DataFrame, words: int = 3, lanes: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the SimHash of each whole text's word shingles, 8 big-endian bytes a lane."""

    def run(batches):
        for batch in by_bytes(batches, "text", 1 << 20):
            raw, offsets = utf8_buffer(batch.column(1))
            data = raw.tobytes()
            x = fingerprints([data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], words, lanes)
            flat = x.astype(">u8").tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([flat[i : i + 8 * lanes] for i in range(0, len(flat), 8 * lanes)], pa.binary())], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return small_batches(rows).mapInArrow(lean(run), "doc_id long, fp binary")


def similar_links(links: DataFrame, docs: DataFrame, words: int, least: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Those of the links (a, b) whose texts' sets of word shingles have a Jaccard similarity of ``least`` or more.

    The text of the end with more links is sent once for some 64 links of it, that of the
    other end once a link; a task holds two sets of shingles. Of rows that share an id the
    smallest text is compared; two texts without words are alike.
    """
    links = keep(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    degree = keep(links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n")))
    ends = links
    for end in ("a", "b"):
        ends = join_hot(ends, degree.select(F.col("node").alias(f"_{end}"), F.col("n").alias(f"n{end}")), end, f"_{end}")
    hub, leaf = (F.when(F.col("na") >= F.col("nb"), F.col(x)).otherwise(F.col(y)) for x, y in ("ab", "ba"))
    part = F.pmod(F.xxhash64(leaf), F.ceil(F.greatest("na", "nb") / F.lit(64.0))).cast("int")
    pairs = keep(ends.select(hub.alias("hub"), part.alias("part"), leaf.alias("leaf")))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(degree.select(F.col("node").alias("id")), "id", "left_semi")
    texts = keep(texts.groupBy("id").agg(F.coalesce(F.min("text"), F.lit("")).alias("text")))
    hubs = pairs.select("hub", "part").distinct()
    rows = pairs.join(texts, F.col("leaf") == F.col("id")).select("hub", "part", "leaf", "text")
    rows = rows.unionByName(hubs.join(texts, F.col("hub") == F.col("id")).select("hub", "part", F.lit(None).cast("long").alias("leaf"), "text"))

    def run(batches):
        of, mine = None, set()
        for batch in by_bytes(batches, "text", 1 << 20):
            raw, offsets = utf8_buffer(batch.column(3))
            data, a, b = raw.tobytes(), [], []
            for hub, node, begin, end in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                found = set(shingle_hashes(data[begin:end], words))
                if node is None:
                    of, mine = hub, found
                    continue
                assert of == hub, "a hub's text comes before its links"
                both = len(mine & found)
                if both >= least * (len(mine) + len(found) - both):
                    a.append(hub)
                    b.append(node)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    out = keep(small_batches(rows).repartition("hub", "part").sortWithinPartitions("hub", "part", F.asc_nulls_first("leaf")).mapInArrow(lean(run), "a long, b long"))
    forget(links, degree, pairs, texts)
    return out


def simhash_components(docs: DataFrame, words: int = 3, lanes: int = 1, radius: int = 3, exact: bool = True, id_col: str = "doc_id", text_col: str = "text", least: float | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id): texts linked at ``radius`` or fewer differing bits.

    With ``least`` a link also needs shingle sets of that Jaccard similarity; texts of equal
    fingerprints are linked in any case.

    Defined cases: null, empty and white-space texts have fingerprint zero and are linked like
    any other; fewer words than a shingle make one shingle; rows that share an id are one
    node; a row without an id has the component of its fingerprint and links nothing by
    itself (null if no row with an id is there); an empty table gives no rows.
    """
    prints = keep(text_fingerprints(docs, words, lanes, id_col, text_col))
    accept = None if least is None else lambda links: similar_links(links, docs, words, least, id_col, text_col)
    found = near_components(prints, lanes, radius, exact, accept)
    found = found.withColumnRenamed("fp", "_fp")
    return join_hot(prints, found, "fp", "_fp").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def radius_for(similarity: float, lanes: int) -> int:
    """Differing bits expected of two shingle sets of equal size with that Jaccard similarity."""
    cosine = 2 * similarity / (1 + similarity)
    low, high = 0.0, 0.5
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (mid, high) if cos(pi * mid) > cosine else (low, mid)
    return int(64 * lanes * low)


def drop_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, lanes: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stand for their group of near copies: those with its smallest id.

    512-bit fingerprints tell a similarity of 0.8 (about 78 differing bits) from unlike texts;
    links are sought up to two standard deviations beyond, and each is checked by its shingle
    sets. Documents without an id stay. All columns are kept.
    """
    radius = radius_for(similarity, lanes)
    radius += round(2 * sqrt(radius * (1 - radius / (64 * lanes))))
    found = simhash_components(docs, words, lanes, radius, False, id_col, text_col, similarity)
    gone = keep(found.where("doc_id <> component_id").select("doc_id").distinct())
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return docs.join(gone.withColumnRenamed("doc_id", "_gone"), docs[id_col] == F.col("_gone"), "left_anti")
