"""SimHash near-duplicates with BK-trees.

A fingerprint is the bitwise majority of the hashes of a text's word shingles. Two
fingerprints within ``RADIUS`` bits are linked, and a component is what links reach.

The trees are sharded without loss: 64 bits are cut into six blocks, and of two
fingerprints at most 4 bits apart at least two blocks agree, so each of the 15
pairs of blocks deals the fingerprints into shards, and every link lies inside a
shard. A shard becomes a BK-tree (children keyed by their Hamming distance to the
parent; a search follows only the edges within the radius). Shard trees are built
where their shard lies, not broadcast from the driver: together they hold every
fingerprint of the corpus and have no bound. Oversized shards are cut into
sub-shards that are searched pair by pair. A shard returns a spanning forest of
its links, never all pairs, and needs a search only from fingerprints outside its
largest component once a few trial searches have found that.

Defined results: a null text counts as empty, and a text without words has
fingerprint zero, linked like any other. Equal fingerprints are one node, so copies
are never paired. A null id takes no part in the smallest id; if a component has
no other id, its component_id is null. Repeated rows come back as often as they
came. An empty table gives an empty result. Further columns are not read.

The pipeline stage links, besides, all texts whose sets of five-word shingles have
a Jaccard similarity of ``SIMILAR`` at least. Of two such texts, at least one of the
first n - ceil(SIMILAR n) + 1 shingles of each agree in any order common to all, so
these shingles are shuffled and every candidate lies in one of their buckets. The
order only decides the work: shingles frequent in a sample come last, by counts in a
fixed number of bins. Candidates
whose shingles, counted modulo two in bins, differ too often to be similar are left
out, and all others are compared by whole texts. Buckets stream through their task in
an order that differs by bucket. One of up to ``SMALL`` texts gives all its pairs at
once. Of a larger one each text meets its first, then the next few, then those that
the links so far have not joined with it: in a task that holds the bucket, or by joins
that adaptive execution splits if it has over ``HOT`` rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, give_back, materialise, nested, table, unnested

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Offset and width of the blocks; two of six agree if at most RADIUS bits differ.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
#: Most fingerprints of one (sub-)shard.
SHARD = 40_000
#: Rows taken up at a time by a task that searches shards.
CHUNK = 200_000
#: Trial searches in a large shard, and from which size on.
TRIALS, LARGE = 48, 512
#: Most (query, node) pairs held at once.
FRONTIER = 1_000_000
#: Words of a shingle of the pipeline stage, and its least similarity.
WORDS, SIMILAR = 5, 0.8
#: One text in SAMPLED is asked for frequent shingles, counted in so many bins; counts
#: below LEAST are left out.
SAMPLED, BINS, LEAST = 16, 1 << 20, 4
#: Rows of a bucket, as estimated, from which on it is dealt into several of about so
#: many; most of these. A row's place has its part of a bucket in the bits from PART on.
SPLIT, MOST_PARTS, PART = 512, 30_000, 48
#: Most texts of a bucket that gives all its pairs at once; the first of a larger one
#: that its others meet, and the rounds of that; rows of a bucket that no task holds
#: whole.
SMALL, FIRST, ROUNDS, HOT = 24, 6, ((0,), (1, 2, 3, 4, 5)), 50_000
#: Rows that a dealt bucket has in several parts, over its rows, at most.
REPEATED = 4
#: Bytes of parities of such a bucket, and of those that a task holds at a time.
HOT_BYTES, HELD_BYTES = 64_000_000, 32_000_000
#: Most rows whose numbers are broadcast (as longs: 32 MB) to the table of texts.
FEW = 2_000_000


def words_of(text: bytes) -> list[bytes]:
    """bytes.lower() and bytes.split() know just A-Z and the six ASCII spaces, as the
    contract does."""
    return text.lower().split()


def hashes_of(words: list[bytes], size: int) -> np.ndarray:
    """Hashes of the shingles of these words, repeats included."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    one = xxhash.xxh64_intdigest
    if n < size:
        return np.array([one(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: n - size + 1].tolist()
    return np.array([one(joined[i:j], SEED) for i, j in zip(starts, ends[size - 1 :].tolist())], np.uint64)


def shingle_hashes(text: bytes, size: int = SHINGLE) -> np.ndarray:
    return hashes_of(words_of(text), size)


def majority(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes (as a signed long)."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        part = hashes[k : k + 65536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    return majority(shingle_hashes(text, size))


def each(texts: pa.Array):  # noqa: ANN201
    """Bytes of texts, one at a time; null is empty."""
    for x in texts.cast(pa.binary()):
        yield x.as_py() or b""


@F.arrow_udf(T.LongType())
def fingerprint_udf(texts: pa.Array) -> pa.Array:
    return pa.array([fingerprint(x) for x in each(texts)], pa.int64())


# --- BK-trees ---------------------------------------------------------------


class Forest:
    """BK-trees over runs of distinct fingerprints, one tree a shard, all grown and
    searched together level by level."""

    def __init__(self, codes: np.ndarray, shard: np.ndarray) -> None:
        """codes: uint64; shard: the number of each code's shard, in ascending order."""
        self.codes, n = codes, len(codes)
        first = np.r_[True, shard[1:] != shard[:-1]] if n else np.empty(0, bool)
        self.root = np.flatnonzero(first)[np.cumsum(first) - 1] if n else np.empty(0, np.int64)
        left = np.flatnonzero(~first)
        at = self.root[left]
        keys, children = [], []
        while left.size:
            key = at * 65 + np.bitwise_count(codes[left] ^ codes[at])
            order = np.argsort(key, kind="stable")
            left, key = left[order], key[order]
            new = np.r_[True, key[1:] != key[:-1]]  # the first with this distance becomes the child
            child = left[new]
            keys.append(key[new])
            children.append(child)
            at, left = child[np.cumsum(new) - 1][~new], left[~new]
        edges = np.concatenate(keys) if keys else np.empty(0, np.int64)
        order = np.argsort(edges, kind="stable")
        self.edges = edges[order]
        self.children = (np.concatenate(children) if children else np.empty(0, np.int64))[order]

    def search(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, found) for all codes of a query's own shard within the radius,
        but itself. queries: positions of codes."""
        asked, found = [], []
        stack = [(queries, self.root[queries])]
        while stack:
            q, node = stack.pop()
            if len(q) > FRONTIER:
                half = len(q) // 2
                stack += [(q[:half], node[:half]), (q[half:], node[half:])]
                continue
            d = np.bitwise_count(self.codes[q] ^ self.codes[node]).astype(np.int64)
            hit = (d <= radius) & (q != node)
            asked.append(q[hit])
            found.append(node[hit])
            low = np.searchsorted(self.edges, node * 65 + np.maximum(d - radius, 0))
            high = np.searchsorted(self.edges, node * 65 + np.minimum(d + radius, 64), "right")
            count = high - low
            total = int(count.sum())
            if total:
                begin = np.repeat(low - (np.cumsum(count) - count), count)
                stack.append((np.repeat(q, count), self.children[begin + np.arange(total)]))
        return np.concatenate(asked) if asked else queries[:0], np.concatenate(found) if found else queries[:0]


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each at most its position) after the links a-b have joined them."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label


def shard_links(codes: np.ndarray, shard: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside each shard: (code, its component's
    first code). codes: distinct within a shard; shard: ascending."""
    n = len(codes)
    forest = Forest(codes, shard)
    label = np.arange(n)
    starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if n else np.empty(0, np.int64)
    sizes = np.diff(np.r_[starts, n])
    small = np.repeat(sizes < LARGE, sizes) & np.repeat(sizes > 1, sizes)
    queries = [np.flatnonzero(small)]
    for start, size in zip(starts[sizes >= LARGE].tolist(), sizes[sizes >= LARGE].tolist()):
        for _ in range(TRIALS):
            alone = start + np.flatnonzero(label[start : start + size] == np.arange(start, start + size))
            if len(alone) < 2:
                break
            # the first alone is a component's first code after a merge: step over those
            grown = np.bincount(label[start : start + size] - start, minlength=size)[alone - start]
            lone = alone[grown == 1]
            if not len(lone):
                break
            label = merge(label, *forest.search(lone[[0, len(lone) // 3, 2 * len(lone) // 3]], radius))
        counts = np.bincount(label[start : start + size] - start, minlength=size)
        rest = start + np.flatnonzero(label[start : start + size] != start + counts.argmax())
        queries.append(rest)
    step = max(1, FRONTIER // max(1, int(sizes.max(initial=1))))
    for q in queries:
        for k in range(0, len(q), step):
            label = merge(label, *forest.search(q[k : k + step], radius))
    linked = np.flatnonzero(label != np.arange(n))
    return codes[linked], codes[label[linked]]


def _link_batches(batches):  # noqa: ANN001, ANN202
    """Shards arrive whole and in order; all but the last of those taken up are
    searched as soon as enough rows have come."""
    held: list[np.ndarray] = []

    def flush(rows: np.ndarray):  # noqa: ANN202
        new = np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]
        a, b = shard_links(np.ascontiguousarray(rows[:, 2]).view(np.uint64), np.cumsum(new) - 1)
        # the forest of several shards together: fewer rows, the same components
        names, at = np.unique(np.r_[a, b], return_inverse=True)
        label = merge(np.arange(len(names)), at[: len(a)], at[len(a) :])
        linked = np.flatnonzero(label != np.arange(len(names)))
        return pa.RecordBatch.from_arrays(
            [pa.array(names[linked].view(np.int64)), pa.array(names[label[linked]].view(np.int64))], ["a", "b"]
        )

    for batch in batches:
        if batch.num_rows:
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1))
        if sum(map(len, held)) >= CHUNK:
            rows = np.concatenate(held)
            last = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield flush(rows[:cut])
            held = [rows[cut:]]
    if held:
        rows = np.concatenate(held)
        if len(rows):
            yield flush(rows)


def _block(code: Column, k: int) -> Column:
    offset, width = BLOCKS[k]
    return F.shiftrightunsigned(code, offset).bitwiseAND((1 << width) - 1)


def shard_keys(code: Column) -> Column:
    """The 15 shards of a fingerprint: number of the pair and both blocks' bits."""
    keys = []
    for pair, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2)):
        keys.append(F.shiftleft(F.shiftleft(F.lit(pair).cast("long"), 11).bitwiseOR(_block(code, i)), 11).bitwiseOR(_block(code, j)))
    return F.array(*keys)


def links(codes: DataFrame, shard: int = SHARD) -> DataFrame:
    """Links (a, b) that join exactly the fingerprints within the radius of one
    another into components. codes: one long column ``fp``, distinct."""
    keyed = codes.select("fp", F.explode(shard_keys(F.col("fp"))).alias("key"))
    # sub-shards of the oversized: a code goes to all pairs of sub-shards that hold its own
    large = materialise(keyed.groupBy("key").count().where(F.col("count") > shard).select(F.col("key"), F.ceil(F.col("count") / shard).cast("long").alias("cuts")), "large")
    if large.isEmpty():
        parts = keyed.withColumn("part", F.lit(0).cast("long"))
    else:
        own = F.pmod(F.xxhash64("fp"), F.col("cuts"))
        other = F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)
        pair = F.transform(other, lambda o: F.least(own, o) * F.col("cuts") + F.greatest(own, o))
        cut = keyed.join(large, "key", "left")
        parts = cut.select("fp", "key", F.explode(F.when(F.col("cuts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pair)).alias("part"))
    dealt = parts.repartition("key", "part").sortWithinPartitions("key", "part")
    return dealt.select("key", "part", "fp").mapInArrow(_link_batches, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """Connected components: (node, label), the label being a component's smallest
    node. Labels spread along the links and are then followed to their own labels,
    so that the rounds grow with the logarithm of the longest path. Each round is
    written to the shared folder and replaces the one before."""
    both = materialise(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    held = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        labels = held.select("node", "label")
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("m"))
        spread = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        up = labels.select(F.col("node").alias("at"), F.col("label").alias("up"))
        after = spread.join(up, F.col("label") == F.col("at"), "left").select("node", "old", F.least("label", "up").alias("label"))
        after = materialise(after, "labels")
        discard(held)
        held = after
        if not after.where(F.col("old") != F.col("label")).limit(1).count():
            discard(both)
            return after


def classes(prints: DataFrame, more: Callable[[DataFrame], DataFrame] = lambda edges: edges) -> DataFrame:
    """(fp, component_id) for every fingerprint, written. prints: (doc_id, fp); more:
    adds to the links of fingerprints."""
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    found = components(more(links(nodes.select("fp"))))
    reached = found.select("node", "label").join(nodes, F.col("node") == F.col("fp"))
    least = reached.groupBy("label").agg(F.min("first").alias("least"))
    moved = reached.select("fp", "label").join(least, "label").select("fp", "least")
    # written, so that the join of all rows with it has exchanges of its own on both
    # sides, of which adaptive execution splits a hot fingerprint
    out = materialise(nodes.join(moved, "fp", "left").select("fp", F.when(F.col("least").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id")), "classes")
    discard(nodes, found)
    return out


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    prints = materialise(docs.select("doc_id", fingerprint_udf(F.col("text")).alias("fp")), "fingerprints")
    found = classes(prints)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(found, "fp").select("doc_id", hexed, "component_id")


# --- similar texts of the pipeline stage --------------------------------------


@F.arrow_udf(T.StructType([T.StructField("fp", T.LongType()), T.StructField("node", T.LongType()), T.StructField("odd", T.BinaryType())]))
def marks_udf(texts: pa.Array) -> pa.Array:
    """The fingerprint, a number for equal words, and the parity of the shingles."""
    rows = []
    for x in each(texts):
        words = words_of(x)
        node = xxhash.xxh64_intdigest(b" ".join(words), SEED)
        rows.append((majority(hashes_of(words, SHINGLE)), node - (node >> 63 << 64), parity(np.unique(hashes_of(words, WORDS)).view(np.int64))))
    columns = list(zip(*rows)) or [[]] * 3
    made = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary()))], ["fp", "node", "odd"])
    rows.clear()
    give_back()
    return made


def shingle_set(text: bytes) -> np.ndarray:
    return np.unique(shingle_hashes(text, WORDS)).view(np.int64)


def parity(tokens: np.ndarray) -> bytes:
    """The number of shingles, and of each of as many bins (a power of two) whether
    it holds an odd number of them."""
    bins = 1 << max(6, (max(len(tokens), 1) - 1).bit_length())
    odd = np.bincount(tokens & (bins - 1), minlength=bins) & 1
    return len(tokens).to_bytes(8, "little") + np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def parities_allow(x: bytes, y: bytes) -> bool:
    """False only of texts that are not similar: two sets differ in at least as many
    shingles as bins. More bins are folded onto fewer."""
    n = int.from_bytes(x[:8], "little") + int.from_bytes(y[:8], "little")
    (a, wide), (b, narrow) = sorted(((int.from_bytes(z[8:], "little"), 8 * len(z) - 64) for z in (x, y)), key=lambda z: -z[1])
    while wide > narrow:
        wide //= 2
        a = (a >> wide) ^ (a & ((1 << wide) - 1))
    return (a ^ b).bit_count() <= (1 - SIMILAR) / (1 + SIMILAR) * n + 1e-9


@F.arrow_udf(T.BooleanType())
def parities_udf(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([parities_allow(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.bool_())


def needed(n: int) -> int:
    """Shingles that a set of n must share with any similar one."""
    return math.ceil(SIMILAR * n - 1e-9)


#: A row of a bucket: shingle, text, its number of shingles, the place of this one.
BUCKET = ["token", "node", "n", "at"]


def _starts(counts: np.ndarray | None):  # noqa: ANN202
    """(token, node, n, at, parts) of the first shingles of each text, rare ones first;
    of all without counts. parts: how many the bucket is dealt into, 0 if it is not."""

    def batch(held: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(held) if held else np.empty((0, len(BUCKET) + 1), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], [*BUCKET, "parts"])

    def run(batches):  # noqa: ANN001, ANN202
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0
        for given in batches:
            for node, text in zip(given.column(0).to_pylist(), each(given.column(1))):
                if node in seen:
                    continue
                if len(seen) >= CHUNK:  # what comes twice is dropped in its bucket
                    seen.clear()
                seen.add(node)
                tokens = shingle_set(text)
                n = len(tokens)
                parts = np.zeros(n, np.int64)
                if counts is not None and n:
                    weight = counts[tokens & (BINS - 1)]
                    order = np.argsort(weight, kind="stable")[: n - needed(n) + 1]
                    tokens, weight = tokens[order], weight[order].astype(np.int64) * SAMPLED
                    parts = np.where(weight > SPLIT, np.minimum(-(-weight // SPLIT), MOST_PARTS), 0)
                k = len(tokens)
                held.append(np.stack([tokens, np.full(k, node), np.full(k, n), np.arange(k), parts], axis=1))
                size += k
                if size > CHUNK // 4:
                    yield batch(held)
                    held, size = [], 0
        yield batch(held)
        give_back()

    return run


class Buckets:
    """Takes up rows (token, node, n, at, place) in order of token and place, equal
    for copies alone, and gives, row by row: pairs of small buckets as (null, a, .., b),
    and rows of larger ones with the texts that they are to meet, null where these
    cannot be similar. Each part of a bucket that is dealt counts as a larger one, and
    its first rows are the same in all parts: places below ``FIRST``, which stand
    there for rows that some part has anyway and are not given themselves."""

    names = [*BUCKET, *(f"p{k}" for k in range(FIRST))]

    def __init__(self) -> None:
        self.held = np.empty((0, 5), np.int64)
        #: the bucket that goes on, if it is a large one: its first rows, its last text
        self.pivots: np.ndarray | None = None
        self.last = 0

    def take(self, rows: np.ndarray, last: bool = False):  # noqa: ANN201
        """Batches of all that is known to be complete."""
        rows = np.concatenate([self.held, rows])
        if len(rows):
            same = (rows[1:, 0] == rows[:-1, 0]) & (rows[1:, 1] == rows[:-1, 1])
            rows = rows[np.r_[True, ~same]]  # copies of a text
        if self.pivots is not None:
            more = int(np.searchsorted((rows[:, 0] != self.pivots[0, 0]) | (rows[:, 4] >> PART != self.pivots[0, 4] >> PART), True)) if len(rows) else 0
            fresh = rows[:more][rows[:more, 4] > self.last]
            self.last = int(fresh[-1, 4]) if len(fresh) else self.last
            yield self._large(fresh, np.broadcast_to(self.pivots, (len(fresh), *self.pivots.shape)))
            rows = rows[more:]
            if len(rows) or last:
                self.pivots = None
        if not len(rows):
            self.held = rows
            return
        part = rows[:, 4] >> PART
        starts = np.flatnonzero(np.r_[True, (rows[1:, 0] != rows[:-1, 0]) | (part[1:] != part[:-1])])
        sizes = np.diff(np.r_[starts, len(rows)])
        cut = len(rows) if last else int(starts[-1])
        if not last and sizes[-1] > SMALL:
            cut = len(rows)
            self.pivots, self.last = rows[starts[-1] : starts[-1] + FIRST].copy(), int(rows[-1, 4])
        self.held = rows[cut:].copy()
        whole = starts < cut
        starts, sizes = starts[whole], sizes[whole]
        rows = rows[:cut]
        owner = np.repeat(np.arange(len(starts)), sizes)
        large = (sizes > SMALL)[owner] | (rows[:, 4] >> PART > 0)
        if large.any():
            firsts = rows[np.minimum(starts[:, None] + np.arange(FIRST), len(rows) - 1)]
            yield self._large(rows[large], firsts[owner[large]])
        small = np.flatnonzero(~large & (sizes > 1)[owner])
        ends = (starts + sizes)[owner]
        found = []
        for step in range(1, SMALL):
            small = small[small + step < ends[small]]
            if not len(small):
                break
            x, y = rows[small], rows[small + step]
            ok = enough_left(x, y)
            found.append(np.sort(np.stack([x[ok, 1], y[ok, 1]], axis=1), axis=1))
        if found:
            pairs = np.unique(np.concatenate(found), axis=0)
            none = pa.nulls(len(pairs), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(pairs[:, 0].copy()), none, none, pa.array(pairs[:, 1].copy()), *[none] * (FIRST - 1)], self.names)

    def _large(self, rows: np.ndarray, pivots: np.ndarray) -> pa.RecordBatch:
        """pivots: [row, place, column]."""
        own = (rows[:, 4] >> PART == 0) | (rows[:, 4] & ((1 << PART) - 1) >= FIRST)
        rows, pivots = rows[own], pivots[own]
        meet = []
        for k in range(FIRST):
            y = pivots[:, k] if k < pivots.shape[1] else rows
            bad = (rows[:, 1] == y[:, 1]) | (rows[:, 0] != y[:, 0]) | ~enough_left(rows, y)
            meet.append(pa.array(np.ascontiguousarray(y[:, 1]), mask=bad))
        return pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(c)) for c in rows.T[:4]], *meet], self.names)


def _bucket_batches(batches):  # noqa: ANN001, ANN202
    state, held, size = Buckets(), [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1))
            size += batch.num_rows
        if size >= CHUNK // 2:
            yield from state.take(np.concatenate(held))
            held, size = [], 0
    yield from state.take(np.concatenate(held) if held else np.empty((0, 5), np.int64), last=True)
    give_back()


def enough_left(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For rows (token, node, n, at) of one bucket: enough shingles are left to be
    similar, if this is the first that both share."""
    left = np.minimum(x[:, 2] - x[:, 3], y[:, 2] - y[:, 3])
    return left >= SIMILAR / (1 + SIMILAR) * (x[:, 2] + y[:, 2]) - 1e-9


def may_be_similar(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For rows (token, node, n, at, group): not linked yet either."""
    return (x[:, 4] != y[:, 4]) & enough_left(x, y)


def _pairs(batches):  # noqa: ANN001, ANN202
    """Candidates (a, b), a < b, of buckets (token, node, n, at, group, copy, odd): all
    pairs whose parities allow that they are similar, but of two copies."""

    def out(found: list[np.ndarray], odds: np.ndarray, rows: np.ndarray):  # noqa: ANN202
        at = np.concatenate(found)
        nodes = np.sort(rows[at, 1], axis=1)
        _, once = np.unique(nodes, axis=0, return_index=True)
        good = [k for k in once.tolist() if parities_allow(odds[at[k, 0]], odds[at[k, 1]])]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in nodes[good].T], ["a", "b"])

    def run(rows: np.ndarray, odds: np.ndarray):  # noqa: ANN202
        order = np.lexsort((rows[:, 1], rows[:, 2], rows[:, 0]))
        rows, odds = rows[order], odds[order]
        found, held = [np.empty((0, 2), np.int64)], 0
        at, step = np.arange(len(rows)), 0
        while len(at):
            step += 1
            at = at[at + step < len(rows)]
            x, y = rows[at], rows[at + step]
            # by size: once a text is too large, all further ones are
            on = (x[:, 0] == y[:, 0]) & (x[:, 2] >= SIMILAR * y[:, 2] - 1e-9)
            at, x, y = at[on], x[on], y[on]
            ok = may_be_similar(x, y) & ((x[:, 5] == 0) | (y[:, 5] == 0))
            found.append(np.stack([at[ok], at[ok] + step], axis=1))
            held += int(ok.sum())
            if held > CHUNK:
                yield out(found, odds, rows)
                found, held = [np.empty((0, 2), np.int64)], 0
        yield out(found, odds, rows)

    kept, parities, size = np.empty((0, 6), np.int64), np.empty(0, object), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        kept = np.concatenate([kept, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:6]], axis=1)])
        parities = np.concatenate([parities, np.array([None, *batch.columns[6].to_pylist()], object)[1:]])
        size += batch.columns[6].nbytes
        last = np.flatnonzero(kept[:, 0] != kept[-1, 0]) if len(kept) >= CHUNK // 4 or size >= HELD_BYTES else []
        if len(last):  # whole buckets, which arrive in order
            cut = int(last[-1]) + 1
            yield from run(kept[:cut], parities[:cut])
            kept, parities = kept[cut:], parities[cut:]
            size = sum(map(len, parities))
    if len(kept):
        yield from run(kept, parities)
    give_back()


def left_over() -> Column:
    """As enough_left(), of a bucket's row and another one (node2, n2, at2)."""
    total, left = F.col("n") + F.col("n2"), F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2"))
    return (F.col("node") != F.col("node2")) & (left >= total * (SIMILAR / (1 + SIMILAR)) - 1e-9)


def second(*more: str) -> list[Column]:
    return [F.col(c).alias(f"{c}2") for c in (*BUCKET[1:], *more)]


def star_pairs(buckets: DataFrame, places: tuple[int, ...]) -> DataFrame:
    """(a, b), a < b: members of large buckets with those at some of the first places;
    with the very first, all pairs of small buckets as well."""
    some = buckets if 0 in places else buckets.where("token IS NOT NULL")
    met = some.select("node", F.explode(F.array_compact(F.array(*[f"p{k}" for k in places]))).alias("other"))
    return met.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def length_class(n: str) -> Column:
    """Of two similar sets, the classes differ by one at most, rounding or not."""
    return F.floor(F.log(1.000001 / SIMILAR, F.greatest(F.col(n), F.lit(1)).cast("double"))).cast("int")


def all_pairs(buckets: DataFrame, group: DataFrame, hot: int, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """(a, b), a < b: all candidates of a large bucket that are in different groups.
    group: (node, group, odd)."""
    dealt = materialise(buckets.where("token IS NOT NULL").join(group, "node").select(*BUCKET, "group", "odd"), "dealt")
    counted = dealt.groupBy("token", "group").agg(F.count("*").alias("c"), F.sum(F.length("odd")).alias("size"))
    most = F.struct("c", "group")
    counted = counted.groupBy("token").agg(F.max_by("group", most).alias("major"), F.max("c").alias("c"), F.count("*").alias("groups"), F.sum("c").alias("rows"), F.sum("size").alias("size"))
    # a bucket that is dealt has the rows outside its largest group in all its parts
    parts = F.ceil(F.col("rows") / SPLIT).cast("long")
    held = (F.col("rows") <= hot) & (F.col("size") <= hot_bytes) & ((F.col("rows") - F.col("c")) * (parts - 1) <= F.col("rows") * REPEATED)
    several = materialise(counted.where("groups > 1").select("token", "major", held.alias("held"), parts.alias("parts")), "several")
    own, minor_row = F.pmod(F.xxhash64("node"), F.col("parts")), (F.col("group") != F.col("major")) & (F.col("parts") > 1)
    few = dealt.join(several.where("held").select("token", "major", "parts"), "token")
    few = few.withColumns({"own": own, "part": F.explode(F.when(minor_row, F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array(own)))})
    # two buckets of one key have more candidates than they need, and lose none
    key = F.when(F.col("parts") > 1, F.xxhash64("token", "part")).otherwise(F.col("token"))
    few = few.select(key.alias("token"), *BUCKET[1:], "group", (F.col("part") != F.col("own")).cast("long").alias("copy"), "odd")
    few = few.repartition("token").sortWithinPartitions("token")
    pairs = few.mapInArrow(_pairs, "a long, b long").distinct()
    large = several.where("NOT held")
    minor = None
    if not large.isEmpty():
        # of two groups, one is not the bucket's largest; both sides have the lengths of
        # similar texts
        rest = dealt.join(large, "token").where(F.col("group") != F.col("major"))
        minor = materialise(rest.select("token", *second("group", "odd"), F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: length_class("n") + d)).alias("class")), "minor")
        more = dealt.withColumn("class", length_class("n")).join(minor, ["token", "class"]).where((F.col("group") != F.col("group2")) & left_over())
        more = more.where(parities_udf("odd", "odd2"))
        pairs = pairs.unionByName(more.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b"))).distinct()
    out = materialise(pairs, "pairs")
    discard(dealt, several, minor)
    return out


@F.arrow_udf(T.BooleanType())
def similar_udf(a: pa.Array, b: pa.Array) -> pa.Array:
    sets = lru_cache(64)(shingle_set)
    out = []
    for x, y in zip(each(a), each(b)):
        x, y = sets(x), sets(y)
        both = len(np.intersect1d(x, y, assume_unique=True))
        out.append(both >= SIMILAR * (len(x) + len(y) - both) - 1e-9)
    sets.cache_clear()
    give_back()
    return pa.array(out, pa.bool_())


def frequencies(texts: DataFrame) -> np.ndarray:
    """How often shingles come in a sample of the texts, counted in ``BINS`` bins by their
    hashes, which are as many at any size. They order the shingles of all texts alike:
    a shingle that shares its bin with a frequent one comes later than it need."""
    form = ", ".join(f"{c} long" for c in (*BUCKET, "parts"))
    asked = texts.where(F.pmod(F.xxhash64("node"), F.lit(SAMPLED)) == 0).mapInArrow(_starts(None), form)
    found = asked.groupBy(F.col("token").bitwiseAND(BINS - 1).alias("bin")).agg(F.count("*").alias("c")).where(F.col("c") >= LEAST).toArrow()
    counts = np.zeros(BINS, np.int32)
    counts[found["bin"].to_numpy()] = np.minimum(found["c"].to_numpy(), 1 << 30)
    return counts


def similar_buckets(numbered: DataFrame) -> DataFrame:
    """What Buckets gives for the first shingles that two texts at least share. Buckets
    that are large by their counts are dealt into parts by text; some texts of the
    sample are the first ones of all parts, so that links join the parts as well."""
    texts = numbered.select("node", "text")
    counts = frequencies(texts)
    form = ", ".join(f"{c} long" for c in (*BUCKET, "parts"))
    mixed = F.pmod(F.xxhash64("token", "node"), F.lit((1 << PART) - FIRST)) + FIRST
    part = F.when(F.col("parts") > 0, F.pmod(F.xxhash64("node"), F.col("parts")) + 1).otherwise(F.lit(0).cast("long"))
    at = lambda part, place: F.shiftleft(part, PART).bitwiseOR(place)
    dealt = texts.mapInArrow(_starts(counts), form).select(*BUCKET, part.alias("part"), mixed.alias("place"))
    if (counts.astype(np.int64) * SAMPLED > SPLIT).any():
        asked = texts.where(F.pmod(F.xxhash64("node"), F.lit(SAMPLED)) == 0).mapInArrow(_starts(counts), form).where("parts > 0").distinct()
        first = asked.withColumn("k", F.row_number().over(Window.partitionBy("token").orderBy(mixed, "node"))).where(F.col("k") <= FIRST)
        every = F.explode(F.sequence(F.lit(1).cast("long"), F.col("parts"))).alias("part")
        dealt = dealt.unionByName(first.select(*BUCKET, every, (F.col("k") - 1).cast("long").alias("place")))
    dealt = dealt.repartition("token", "part").select(*BUCKET, at(F.col("part"), F.col("place")).alias("place")).sortWithinPartitions("token", "place")
    return materialise(dealt.mapInArrow(_bucket_batches, ", ".join(f"{c} long" for c in Buckets.names)), "buckets")


def few(rows: DataFrame) -> DataFrame:
    """Written rows, marked for broadcast if they are at most FEW, as counted. Else
    their join with texts has exchanges on both sides."""
    return F.broadcast(rows) if rows.count() <= FEW else rows


def similar_links(numbered: DataFrame, edges: DataFrame, hot: int = HOT) -> DataFrame:
    """Links (a, b) of fingerprints that join what ``edges`` join, and all similar
    texts. numbered: text, fp, node, odd, row."""
    buckets = similar_buckets(numbered)
    nodes = numbered.groupBy("node").agg(F.min("fp").alias("fp"), F.min("row").alias("row"), F.min("odd").alias("odd"))
    used = buckets.select("node").unionByName(buckets.where("token IS NULL").select(F.col("p0").alias("node"))).distinct()
    nodes = materialise(nodes.join(used, "node", "left_semi"), "nodes")
    for places in [*ROUNDS, None]:  # the last one has all that is left
        labels = components(edges)
        known = labels.select(F.col("node").alias("fp"), "label")
        group = materialise(nodes.select("node", "fp", "odd").join(known, "fp", "left").select("node", "odd", F.coalesce("label", "fp").alias("group")), "groups")
        pairs = all_pairs(buckets, group, hot) if places is None else star_pairs(buckets, places)
        one, two = (group.select(F.col("node").alias(x), F.col("group").alias(f"g{x}"), F.col("odd").alias(f"o{x}")) for x in "ab")
        open_ = pairs.join(one, "a").join(two, "b").where(F.col("ga") != F.col("gb"))
        asked = materialise(open_.where(parities_udf("oa", "ob")).select("a", "b", "ga", "gb"), "asked")
        wanted = asked.select(F.col("a").alias("node")).unionByName(asked.select(F.col("b").alias("node"))).distinct()
        rows = materialise(nodes.join(wanted, "node", "left_semi").select("node", "row"), "rows")
        texts = materialise(numbered.select("row", "text").join(few(rows), "row").select("node", "text"), "texts")
        one, two = (texts.select(F.col("node").alias(x), F.col("text").alias(f"t{x}")) for x in "ab")
        new = asked.join(one, "a").join(two, "b").where(similar_udf(F.col("ta"), F.col("tb")))
        # from here on a group is what each of its nodes is linked to, and groups are linked once
        new = new.select(F.least("ga", "gb").alias("a"), F.greatest("ga", "gb").alias("b")).distinct()
        held = labels.where(F.col("node") != F.col("label")).select(F.col("node").alias("a"), F.col("label").alias("b"))
        more = materialise(held.unionByName(new), "edges")
        discard(labels, group, pairs if places is None else None, asked, rows, texts, edges)
        edges = more
    discard(buckets, nodes)
    return edges


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the row with the smallest doc_id stays, of
    repeated rows one; rows without any id in their component keep one as well."""
    # the rows' numbers are written with them: counted anew, they could differ
    t = docs["text"]
    numbered = nested(docs, marks_udf(t).alias("m"), F.monotonically_increasing_id().alias("row"))
    numbered = materialise(numbered.select("d", "m.*", "row"), "numbered")
    texts = numbered.select(F.col("d").getField("text").alias("text"), "fp", "node", "odd", "row")
    marked = numbered.select(F.col("d").getField("doc_id").alias("doc_id"), "fp", "row")
    found = classes(marked.select("doc_id", "fp"), lambda edges: similar_links(texts, materialise(edges, "edges")))
    # the label tells components without an id apart: their smallest fingerprint
    named = marked.join(found, "fp")
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row"))
    chosen = named.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("alone")).agg(F.min(key).alias("k"))
    keep = materialise(chosen.select(F.col("k.row").alias("row")), "kept")
    # those that go are fewer than those that stay
    gone = materialise(marked.select("row").join(keep, "row", "left_anti"), "gone")
    discard(found, keep)
    return unnested(numbered.join(few(gone), "row", "left_anti"), docs.columns)
