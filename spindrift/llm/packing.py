"""Best-fit packing with a grouping genetic algorithm on islands.

Documents become token pieces of at most ``LENGTH``; whole pieces fill a sequence
each and the others are packed. Pieces are dealt into shards of bounded size, and
every shard is evolved on several islands. An individual is a set of bins. A
crossover injects whole well-filled bins of one parent into the other, removes the
bins that hold a piece twice, puts displaced pieces in the place of smaller ones where
that fills a bin better, and best-fits what is left over. After an epoch each island's
best solution migrates to the next island, which evolves on from both. An island
stops as soon as its best solution meets a lower bound. Then each shard keeps its
best solution; bins filled well enough are final, and the pieces of all other bins
meet again, in fewer and, in the last round, larger shards.

Defined results: a null text counts as empty; an empty document is its end token
alone. Rows are told apart by a number of their own, so that repeated rows and
null ids are packed as often as they come. An empty table gives an empty result.
Further columns are not read. Nothing is cut but documents over ``LENGTH`` tokens.
"""

from __future__ import annotations

import bisect
import functools
import json
import random
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import materialise, table

LENGTH = 4096
END_ID = 1
#: Pieces of a shard, islands of a shard, epochs, individuals of an island.
SHARD, ISLANDS, EPOCHS, POPULATION = 3000, 2, 2, 6
#: Pieces that an island's generations touch in an epoch, at least LEAST generations.
WORK, LEAST = 12_000, 3
#: A bin with at most this many free places is final.
SPARE = 8
#: Rounds of packing; in the last one every bin is final, and a shard has up to
#: LAST times as many pieces.
ROUNDS, LAST = 4, 8
#: Stands for the round in the numbers of sequences that one whole piece fills. A
#: number is the round, the shard and the bin (below 2 ** BIN_BITS) side by side.
WHOLE, BIN_BITS = 7, 16
#: Most words a worker remembers; in the pipeline fewer, as its workers hold more.
MEMORY, LESS_MEMORY = 400_000, 200_000

# --- tokens -----------------------------------------------------------------

#: Separators for str.split() that the library's white space does not have, and the
#: mark put for the end of a word: texts with them are encoded by the library.
_ODD = re.compile("[\0\x1c-\x1f\x85]")


class Words(dict):
    """Bytes of the ids (little-endian unsigned 32-bit) of the words met so far. The
    pre-tokenizer never crosses white space and drops it, so that the words of a
    text are encoded one by one. A word's last character merges with the end mark
    first, as the vocabulary's word ends do."""

    def __init__(self, path: str, memory: int = MEMORY) -> None:
        self.memory = memory
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocab, end = data["model"]["vocab"], data["model"]["end_of_word_suffix"]
        letters = byte_letters()
        special = {x["content"] for x in data["added_tokens"]}
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self._special = re.compile("|".join(map(re.escape, special))) if special else None

        def raw(token: str) -> bytes:
            ended = token.endswith(end)
            return bytes(letters[c] for c in (token[: -len(end)] if ended else token)) + b"\0" * ended

        merges = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        singles = [bytes([b]) for b in range(256)]
        ended = [s + b"\0" for s in singles]
        order = list(dict.fromkeys([*ended, *singles, *(raw(a + b) for a, b in merges)]))
        by_raw = {raw(t): i for t, i in vocab.items() if t not in special}
        self._ids = [by_raw.get(t, -1) for t in order]
        pattern = next(p["pattern"]["Regex"] for p in data["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        import regex

        self._pieces = regex.compile(pattern).findall
        self._encode = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks={t: r for r, t in enumerate(order)}, special_tokens={})._core_bpe.encode_single_piece

    def __missing__(self, word: str) -> bytes:
        if word.isascii():
            text = word.lower()
        else:
            text = unicodedata.normalize("NFC", word)
            # the library lower-cases character by character
            text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
        ids: list[int] = []
        for piece in self._pieces(text):
            ids += [self._ids[r] for r in self._encode(piece.encode() + b"\0")]
        out = array("I", ids).tobytes()
        if len(self) >= self.memory:
            self.clear()
        if len(word) <= 64:
            self[word] = out
        return out

    def encode(self, text: str) -> bytes:
        if _ODD.search(text) or (self._special and self._special.search(text)):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join([*map(self.__getitem__, text.split())])


@functools.lru_cache(maxsize=2)
def words(path: str, memory: int = MEMORY) -> Words:
    return Words(path, memory)


PIECES = "doc_id long, piece int, start long, length long"
#: Bytes of ids after which a worker hands on what it has cut.
HANDED = 8_000_000


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, ids: bool = True, memory: int = MEMORY) -> DataFrame:
    """Token pieces of every document: doc_id, piece, start, length, and ids (bytes,
    little-endian unsigned 32-bit) or else their ids_crc32."""
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary() if ids else pa.int64()]
    names = ["doc_id", "piece", "start", "length", "ids" if ids else "ids_crc32"]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = words(path, memory)
        end = array("I", [END_ID]).tobytes()
        for b in batches:
            rows: list[tuple] = []
            held = 0
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                found = coder.encode(text.as_py() or "") + end
                total = len(found) // 4
                for k, s in enumerate(range(0, total, length)):
                    part = found[4 * s : 4 * (s + length)]
                    rows.append((doc, k, s, min(length, total - s), part if ids else zlib.crc32(part)))
                    held += len(part) if ids else 64
                    if held > HANDED:
                        yield batch(rows)
                        rows, held = [], 0
            yield batch(rows)

    last = "ids binary" if ids else "ids_crc32 long"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, f"{PIECES}, {last}")


# --- the genetic algorithm --------------------------------------------------

Bins = list[list[int]]


def best_fit(sizes: list[int], items: list[int], bins: Bins, room: int) -> Bins:
    """``bins`` with ``items``, largest first, each put where the least is left."""
    free = sorted((room - sum(sizes[i] for i in b), k) for k, b in enumerate(bins))
    for i in sorted(items, key=lambda x: -sizes[x]):
        at = bisect.bisect_left(free, (sizes[i], -1))
        if at == len(free):
            bins.append([i])
            bisect.insort(free, (room - sizes[i], len(bins) - 1))
        else:
            left, k = free.pop(at)
            bins[k].append(i)
            bisect.insort(free, (left - sizes[i], k))
    return bins


def fill(sizes: list[int], b: list[int]) -> int:
    return sum(sizes[i] for i in b)


def worth(sizes: list[int], bins: Bins, room: int) -> tuple[int, float]:
    """Fewer bins first; then fuller ones, by their squared fill."""
    return -len(bins), sum((fill(sizes, b) / room) ** 2 for b in bins)


def least_bins(sizes: list[int], room: int) -> int:
    """A lower bound. Of pieces over room - k none share a bin, nor can pieces from k
    on go beside them; pieces over half the room do not share one either. The best
    over all k."""
    ordered = np.sort(np.asarray(sizes, np.int64))[::-1]
    total = np.r_[0, np.cumsum(ordered)]
    best, half = -(-int(total[-1]) // room), int(np.searchsorted(-ordered, -(room // 2), "left"))
    for k in {int(x) for x in ordered[ordered * 2 <= room]} | {0}:
        alone = int(np.searchsorted(-ordered, -(room - k), "left"))
        counted = int(np.searchsorted(-ordered, -k, "right"))
        spare = (half - alone) * room - int(total[half] - total[alone])
        small = int(total[counted] - total[half])
        best = max(best, half + max(0, -(-(small - spare) // room)))
    return best


def replace(sizes: list[int], bins: Bins, displaced: list[int], room: int) -> list[int]:
    """Each displaced piece, the largest first, takes the place of the smaller piece
    that leaves its bin fullest. Returns the pieces displaced now, smaller ones."""
    free = [room - fill(sizes, b) for b in bins]
    out, todo = [], sorted(displaced, key=lambda i: sizes[i])
    while todo:
        i = todo.pop()
        size, most, where = sizes[i], 0, None
        for k, left in enumerate(free):
            if left <= most or left >= size:  # nothing to gain, or it fits as it is
                continue
            for at, j in enumerate(bins[k]):
                gain = size - sizes[j]
                if most < gain <= left:
                    most, where = gain, (k, at)
                    if gain == left:
                        break
        if where is None:
            out.append(i)
            continue
        k, at = where
        j, bins[k][at] = bins[k][at], i
        free[k] -= most
        bisect.insort(todo, j, key=lambda x: sizes[x])
    return out


def crossover(sizes: list[int], a: Bins, b: Bins, room: int, rng: random.Random) -> Bins:
    """Well-filled bins of ``b`` go whole into ``a``; bins of ``a`` that hold one of
    their pieces go, and what else was in these is put back."""
    full = [x for x in b if fill(sizes, x) >= room * 0.995] or sorted(b, key=lambda x: -fill(sizes, x))[: max(1, len(b) // 4)]
    given = [list(x) for x in rng.sample(full, max(1, len(full) // 2))]
    taken = {i for x in given for i in x}
    kept, displaced = [], []
    for x in a:
        if taken.isdisjoint(x):
            kept.append(list(x))
        else:
            displaced += [i for i in x if i not in taken]
    return settle(sizes, displaced, kept + given, room)


def settle(sizes: list[int], displaced: list[int], bins: Bins, room: int) -> Bins:
    return best_fit(sizes, replace(sizes, bins, displaced, room), bins, room)


def mutate(sizes: list[int], bins: Bins, room: int, rng: random.Random) -> Bins:
    """The worst-filled bins and a few others are taken apart and put back."""
    order = sorted(range(len(bins)), key=lambda k: fill(sizes, bins[k]))
    few = max(1, min(len(bins) // 20, 12))
    gone = set(order[:few]) | set(rng.sample(order, few))
    return settle(sizes, [i for k in gone for i in bins[k]], [list(b) for k, b in enumerate(bins) if k not in gone], room)


def evolve(sizes: list[int], start: list[Bins], room: int, seed: int, work: int = WORK, population: int = POPULATION) -> Bins:
    """The best individual after as many generations as ``work`` pays for, from
    ``start`` and best fits; at once if it meets the lower bound."""
    rng = random.Random(seed)
    pool = list(start)
    if not pool:
        pool.append(best_fit(sizes, list(range(len(sizes))), [], room))
    least = least_bins(sizes, room)
    value = lambda x: worth(sizes, x, room)
    pool = sorted(((value(x), x) for x in pool), key=lambda p: p[0], reverse=True)
    while len(pool[0][1]) > least and len(pool) < population:
        child = mutate(sizes, pool[0][1], room, rng)
        pool.append((value(child), child))
    for _ in range(max(LEAST, work // max(1, len(sizes)))):
        pool.sort(key=lambda p: p[0], reverse=True)
        if len(pool[0][1]) <= least:
            break
        # two parents, the first the better of two drawn; the worst two make room
        one, other = sorted(rng.sample(range(len(pool)), 2))
        child = crossover(sizes, pool[one][1], pool[other][1], room, rng)
        grown = mutate(sizes, child, room, rng)
        pool[-1] = (value(grown), grown)
        if len(pool) > 2 and all(value(child) != p[0] for p in pool):
            pool[-2] = (value(child), child)
    return max(pool, key=lambda p: p[0])[1]


# --- islands ----------------------------------------------------------------


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[np.ndarray]]]:
    """Runs of rows that agree in their first ``keys`` columns, one at a time."""
    held: list[list[np.ndarray]] = []
    current = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns]
        new = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in columns[:keys]], axis=0)])
        for s, e in zip(new, np.r_[new[1:], b.num_rows]):
            key = tuple(int(c[s]) for c in columns[:keys])
            if held and key != current:
                yield current, [np.concatenate(c) for c in zip(*held)]
                held = []
            current = key
            held.append([c[s:e] for c in columns])
    if held:
        yield current, [np.concatenate(c) for c in zip(*held)]


def _bins_of(numbers: np.ndarray) -> Bins:
    order = np.argsort(numbers, kind="stable")
    cuts = np.flatnonzero(np.diff(numbers[order])) + 1
    return [x.tolist() for x in np.split(order, cuts)]


def _island(room: int, seed: int, epoch: int):  # noqa: ANN202
    """Rows (shard, island, key, length, own, met), sorted, to (shard, island, key,
    length, bin, bins, squares). own, met: bins of the island's own best solution
    and of the one that has migrated to it, below zero if there is none yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "island", "key", "length", "bin", "worth"]
        for (shard, island), (_, _, keys, lengths, own, met) in _groups(batches, 2):
            sizes = lengths.tolist()
            start = [_bins_of(x) for x in (own, met) if len(x) and x[0] >= 0]
            best = evolve(sizes, start, room, hash((seed, epoch, shard, island)) & 0x7FFFFFFF)
            bins = np.empty(len(keys), np.int64)
            for k, b in enumerate(best):
                bins[b] = k
            count, squares = worth(sizes, best, room)
            mark = np.full(len(keys), round(count * 1_000_000 + squares))
            columns = [np.full(len(keys), shard), np.full(len(keys), island), keys, lengths, bins, mark]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return run


def _close(room: int, spare: int, last: bool):  # noqa: ANN202
    """Rows (shard, bin, key, length) of the best islands, sorted, to final places or
    pieces left over: (key, length, shard, bin, offset), offset below zero if left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (shard, bins, keys, lengths) in _groups(batches, 1):
            new = np.r_[True, bins[1:] != bins[:-1]]
            ends = np.cumsum(lengths)
            at = np.flatnonzero(new)
            base = (ends - lengths)[at]
            group = np.cumsum(new) - 1
            totals = np.r_[base[1:], ends[-1]] - base
            final = last | (room - totals <= spare)
            offset = np.where(final[group], ends - lengths - base[group], -1)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (keys, lengths, shard, bins, offset)], ["key", "length", "shard", "bin", "offset"])

    return run


EVOLVED = "shard long, island long, key long, length long, bin long, worth long"


def pack(items: DataFrame, room: int = LENGTH, seed: int = 7, rounds: int = ROUNDS) -> DataFrame:
    """Places of ``items`` (key: distinct longs; length: 1 to ``room``): key,
    sequence_id, offset. Each epoch and round is written to the shared folder."""
    whole = items.where(F.col("length") == room).select("key", (F.col("key") + (WHOLE << 60)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    done = [whole]
    left = items.where(F.col("length") < room).select("key", "length")
    for n in range(rounds):
        count = left.count()
        if not count:
            break
        last = n == rounds - 1 or count <= SHARD
        shards = max(1, -(-count // (SHARD * LAST if last else SHARD)))
        none = F.lit(-1).cast("long")
        dealt = left.withColumn("shard", F.pmod(F.xxhash64("key", F.lit(n)), F.lit(shards).cast("long")))
        best = None
        for epoch in range(EPOCHS):
            if best is None:
                seeded = dealt.select("shard", F.explode(F.array(*[F.lit(i).cast("long") for i in range(ISLANDS)])).alias("island"), "key", "length", none.alias("own"), none.alias("met"))
            else:  # a ring: each island's best goes to the next one
                own = best.select("shard", "island", "key", "length", F.col("bin").alias("own"))
                met = best.select("shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS).cast("long")).alias("island"), "key", F.col("bin").alias("met"))
                seeded = own.join(met, ["shard", "island", "key"]).select("shard", "island", "key", "length", "own", "met")
            ready = seeded.repartition("shard", "island").sortWithinPartitions("shard", "island", "key")
            best = materialise(ready.mapInArrow(_island(room, seed + n, epoch), EVOLVED), "islands")
        winner = best.groupBy("shard").agg(F.max(F.struct("worth", "island")).alias("w")).select("shard", F.col("w.island").alias("island"))
        kept = best.join(winner, ["shard", "island"], "left_semi").select("shard", "bin", "key", "length")
        closed = kept.repartition("shard").sortWithinPartitions("shard", "bin", "key")
        placed = materialise(closed.mapInArrow(_close(room, SPARE, last), "key long, length long, shard long, bin long, offset long"), "placed")
        number = (F.lit(n << 60) + F.shiftleft("shard", BIN_BITS) + F.col("bin")).alias("sequence_id")
        done.append(placed.where("offset >= 0").select("key", number, "offset"))
        left = placed.where("offset < 0").select("key", "length")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select("key", "sequence_id", "offset")


def pack_documents(cut: DataFrame) -> DataFrame:
    """Pieces, with any further columns, and their places. ``cut`` is written once
    with a key for each row."""
    kept = materialise(cut.withColumn("__key", F.monotonically_increasing_id()), "pieces")
    places = pack(kept.select(F.col("__key").alias("key"), "length"))
    return kept.join(places, F.col("__key") == F.col("key")).drop("__key", "key")


def _packed(docs: DataFrame, memory: int = MEMORY) -> DataFrame:
    return pack_documents(pieces(docs, public_tokenizers.path("word_bpe_49k.json"), ids=False, memory=memory))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the places of all that the stages before have kept."""
    return _packed(docs, LESS_MEMORY).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
