"""Substring dedup by seed and extend: words of passages that an earlier document has.

A window is ``LENGTH`` consecutive words. Each word goes that lies in a window which
also starts in a document with a smaller id.

Seeds: the hash of ``SEED_WORDS`` words that is the smallest (leftmost, if several are)
of those inside a window is an anchor of its text. Equal windows have the same anchor at
the same place, so that every repeat of ``LENGTH`` words has an anchor that both texts
share. Occurrences of an anchor are joined with its first one, by document, which is one
row an anchor: a frequent one makes no pairs.

Extension: around a seed the words of both texts are compared to the left and to the
right, as far as windows with this anchor reach, and stretches of ``LENGTH`` words and
more are repeats; those of neighbouring seeds overlap and make up the maximal one. Words
travel in pieces of ``PIECE`` words with a margin, so that a long text that many share
is never sent whole. A repeat may be with another document than the anchor's first one:
the windows with an anchor that differ from those of the first are grouped by a hash of
128 bits and held against the smallest id of their group. Two such windows are equal only
if neither equals the first one's, so that nothing is missed. A window is looked up for
its own anchor alone, which equal windows share, not for every anchor inside it. Of such
windows of a text those that start within ``LENGTH`` words are a stretch: if its first and
its last one are repeats, all words between go with them, and these two alone are looked
up; those inside are only where one of the two is not.

Defined results: words are runs of anything but the six ASCII spaces, unchanged. A null
text has none. Exact copies of a text are held against each other as wholes. A null id is
neither smaller nor larger than another one: its row loses nothing and takes nothing.
Rows with the same id take nothing from each other. Repeated rows come back as often as
they came. Texts under ``LENGTH`` words stay. An empty table gives an empty result.
Further columns pass through, whatever their names. The words kept are joined by one
space; texts that lose nothing are joined so as well.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialise, nested, quoted, table, unnested

LENGTH = 50
SEED_WORDS = 16
#: Words of a piece, without its margins.
PIECE = 512
#: Most rows, and numbers in their lists, of a table that is broadcast to the texts.
FEW_ROWS, FEW_ENTRIES = 500_000, 2_000_000
#: Rows of numbers that a task gathers before it gives them on.
BATCH = 100_000


def each(texts: pa.Array):  # noqa: ANN201
    """Bytes of texts, one at a time; null is empty."""
    for x in texts.cast(pa.binary()):
        yield x.as_py() or b""


def bounds(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Where the words start and end once they are joined by one space."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    return ends - lengths, ends


def anchors(words: list[bytes], length: int = LENGTH, seed: int = SEED_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hash as a signed long, position) of the anchors of a text."""
    if len(words) < length:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    joined = b" ".join(words)
    starts, ends = bounds(words)
    one = xxhash.xxh64_intdigest
    hashes = np.array([one(joined[i:j]) for i, j in zip(starts[: len(words) - seed + 1].tolist(), ends[seed - 1 :].tolist())], np.uint64)
    inside = np.lib.stride_tricks.sliding_window_view(hashes, length - seed + 1)
    at = np.unique(inside.argmin(axis=1) + np.arange(len(inside)))
    return hashes[at].view(np.int64), at


def own_anchors(words: list[bytes], windows: np.ndarray, length: int = LENGTH, seed: int = SEED_WORDS) -> np.ndarray:
    """Positions of the anchors of windows, given by their first words."""
    inside = windows[:, None] + np.arange(length - seed + 1)
    joined, (starts, ends) = b" ".join(words), bounds(words)
    at = np.unique(inside)
    hashes = np.zeros(len(words), np.uint64)
    hashes[at] = [xxhash.xxh64_intdigest(joined[i:j]) for i, j in zip(starts[at].tolist(), ends[at + seed - 1].tolist())]
    return windows + hashes[inside].argmin(axis=1)


def _anchor_batches(length: int, seed: int):  # noqa: ANN202
    def batch(held: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(held) if held else np.empty((0, 4), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], ["anchor", "id", "h", "pos"])

    def run(batches):  # noqa: ANN001, ANN202
        seen: set[tuple[int, int]] = set()
        held, size = [], 0
        for given in batches:
            for i, h, text in zip(given.column(0).to_pylist(), given.column(1).to_pylist(), each(given.column(2))):
                if (i, h) in seen:
                    continue
                if len(seen) >= BATCH:  # repeated rows that come again do no harm
                    seen.clear()
                seen.add((i, h))
                hashes, at = anchors(text.split(), length, seed)
                held.append(np.stack([hashes, np.full(len(at), i), np.full(len(at), h), at], axis=1))
                size += len(at)
                if size >= BATCH:
                    yield batch(held)
                    held, size = [], 0
        yield batch(held)

    return run


def piece(words: list[bytes], number: int, length: int = LENGTH, seed: int = SEED_WORDS, size: int = PIECE) -> tuple[int, bytes]:
    """The first word's position and the words that windows reach of which an anchor
    is among the words of this number."""
    base = max(0, number * size - (length - seed))
    return base, b" ".join(words[base : (number + 1) * size + length])


def _piece_batches(length: int, seed: int, words_each: int):  # noqa: ANN202
    def run(batches):  # noqa: ANN001, ANN202
        for given in batches:
            rows, size = [], 0
            for i, h, text, numbers in zip(given.column(0).to_pylist(), given.column(1).to_pylist(), each(given.column(2)), given.column(3).to_pylist()):
                words = text.split()
                for k in sorted(set(numbers)):
                    base, part = piece(words, k, length, seed, words_each)
                    rows.append((i, h, k, base, part))
                    size += len(part)
                    if size >= 1 << 24:
                        yield _pieces(rows)
                        rows, size = [], 0
            yield _pieces(rows)

    return run


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"id": pa.int64(), "h": pa.int64(), "c": pa.int64(), "base": pa.int64(), "words": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 5, kinds.values())], list(kinds))


def runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unions of the spans [start, end) that touch or overlap, in order."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, starts[1:] > ends[:-1]]
    return starts[new], ends[np.r_[np.flatnonzero(new)[1:] - 1, len(ends) - 1]]


def extend(mine: list[bytes], other: list[bytes], p: np.ndarray, q: np.ndarray, length: int = LENGTH, seed: int = SEED_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seeds at ``p`` of one list of words and ``q`` of another: starts and ends of the
    repeats around them, and starts of the windows whose anchor is one of these and that
    differ from the other's."""
    reach, names = length - seed, {}
    a, b = (np.array([names.setdefault(w, len(names)) for w in words], np.int64) for words in (mine, other))
    # beyond either end nothing is equal
    a, b = np.r_[np.full(reach, -1), a, np.full(length, -1)], np.r_[np.full(reach, -2), b, np.full(length, -2)]
    same = a[p[:, None] + np.arange(reach + length)] == b[q[:, None] + np.arange(reach + length)]
    whole = same[:, reach : reach + seed].all(axis=1)  # else two sequences have one hash
    ending = np.ones((len(p), 1), bool)
    left = np.argmax(np.c_[~same[:, :reach][:, ::-1], ending], axis=1)
    right = np.argmax(np.c_[~same[:, reach + seed :], ending], axis=1)
    good = whole & (left + seed + right >= length)
    starts, ends = runs((p - left)[good], (p + seed + right)[good])
    windows = p[:, None] - np.arange(reach + 1)
    inside = (windows >= 0) & (windows + length <= len(mine))
    equal = whole[:, None] & (np.arange(reach + 1) <= left[:, None]) & (windows + length <= (p + seed + right)[:, None])
    rest = np.setdiff1d(windows[inside & ~equal], windows[inside & equal])
    if len(rest):
        rest = rest[np.isin(own_anchors(mine, rest, length, seed), p)]
    return starts, ends, rest


def stretches(windows: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Of each window the first and the last one of its stretch, by their first words,
    which are in order. The windows at either end cover together all that lie between."""
    cuts, at = [0], 0
    while at < len(windows):
        at = int(np.searchsorted(windows, windows[at] + length, "right"))
        cuts.append(at)
    sizes = np.diff(cuts)
    return np.repeat(windows[cuts[:-1]], sizes), np.repeat(windows[np.array(cuts[1:], np.int64) - 1], sizes)


def _extend_batches(length: int, seed: int):  # noqa: ANN202
    """Rows (id, h, start, end, a, b, lo, hi): a repeat, if all from a on are null, else
    the hash of a window that is to be looked up, and its stretch."""
    kinds = dict.fromkeys(("id", "h", "start", "end", "a", "b", "lo", "hi"), pa.int64())

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 8, kinds.values())], list(kinds))

    def run(batches):  # noqa: ANN001, ANN202
        out: list[tuple] = []
        for given in batches:
            names = given.schema.names
            column = lambda n: given.column(names.index(n))  # noqa: B023, E731
            numbers = [column(n).to_pylist() for n in ("id", "h", "fid", "base", "fbase", "seeds")]
            for (i, h, fid, base, fbase, seeds), mine, other in zip(zip(*numbers), each(column("words")), each(column("fwords"))):
                words = mine.split()
                at = np.array([(s["pos"], s["fpos"]) for s in seeds], np.int64)
                starts, ends, rest = extend(words, other.split(), at[:, 0] - base, at[:, 1] - fbase, length, seed)
                if fid < i:
                    out += [(i, h, s + base, e + base, None, None, None, None) for s, e in zip(starts.tolist(), ends.tolist())]
                if len(rest):
                    first, last = bounds(words)
                    lo, hi = stretches(rest + base, length)
                    for s, x, y, u, v in zip(rest.tolist(), first[rest].tolist(), last[rest + length - 1].tolist(), lo.tolist(), hi.tolist()):
                        d = xxhash.xxh3_128_digest(mine[x:y])
                        out.append((i, h, s + base, s + base + length, int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True), u, v))
                if len(out) >= BATCH:
                    yield batch(out)
                    out = []
        yield batch(out)

    return run


SPANS = T.StructType([T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("ends", T.ArrayType(T.LongType()))])


@F.arrow_udf(SPANS)
def merged_udf(spans: pa.Array) -> pa.Array:
    """Lists of spans as the starts and ends of their unions."""
    out = []
    for x in spans.to_pylist():
        starts, ends = runs(np.array([s["start"] for s in x], np.int64), np.array([s["end"] for s in x], np.int64))
        out.append({"starts": starts.tolist(), "ends": ends.tolist()})
    return pa.array(out, pa.struct([("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))]))


KEPT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("text", T.StringType())])


def _kept(length: int):  # noqa: ANN202
    @F.arrow_udf(KEPT)
    def kept_udf(texts: pa.Array, copies: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        """What is left of texts; of those marked as copies nothing, if they have a window."""
        rows = []
        for text, copy, i, j in zip(each(texts), copies.to_pylist(), starts.to_pylist(), ends.to_pylist()):
            words = text.split()
            n = len(words)
            if copy and n >= length:
                words = []
            elif i:
                keep, at = [], 0
                for x, y in zip(i, j):
                    keep += words[at:x]
                    at = y
                words = keep + words[at:]
            rows.append((n, n - len(words), b" ".join(words)))
        columns = list(zip(*rows)) or [[]] * 3
        made = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary()).cast(pa.string())]
        return pa.StructArray.from_arrays(made, KEPT.names)

    return kept_udf


def few(rows: DataFrame, entries: Column | None = None) -> DataFrame:
    """Written rows, marked for broadcast if they and the entries of their lists are
    few, as counted. Else their join with texts has exchanges on both sides."""
    n, total = rows.agg(F.count("*"), F.sum(entries if entries is not None else F.lit(1))).first()
    return F.broadcast(rows) if n <= FEW_ROWS and (total or 0) <= FEW_ENTRIES else rows


def _marked(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows as ``d`` with id, text, h and ``first``, the smallest id of a text that
    comes more than once; and the written table of these."""
    i, t = F.col(quoted(id_col)).cast("long"), F.col(quoted(text_col))
    keyed = nested(docs, i.alias("id"), t.alias("text"), F.xxhash64(t).alias("h"), F.unhex(F.md5(t)).alias("key"))
    copies = keyed.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).where(F.col("first") < F.col("last"))
    copies = materialise(copies.select("key", "first"), "copies")
    return keyed.join(few(copies), "key", "left"), copies


def looked_up(windows: DataFrame, least: DataFrame, length: int = LENGTH) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """(id, h, start, end) that cover the words of all ``windows`` that ``least`` has of a
    smaller id, and the written tables that they read. windows: a row each, with its
    stretch (see stretches()); least: (a, b, least)."""
    least, known = few(least), F.col("id") > F.col("least")
    span = ["id", "h", "start", "end"]
    at_end = (F.col("start") == F.col("lo")) | (F.col("start") == F.col("hi"))
    ends = materialise(windows.where(at_end).join(least, ["a", "b"]).where(known).select(*span, "lo", "hi"), "ends")
    whole = ends.groupBy("id", "h", "lo", "hi").agg(F.count("*").alias("n")).where(F.col("n") == F.when(F.col("lo") == F.col("hi"), 1).otherwise(2))
    whole = materialise(whole.select("id", "h", "lo", "hi"), "stretches")
    inside = windows.where(~at_end).join(few(whole).drop("hi"), ["id", "h", "lo"], "left_anti")
    inside = inside.join(least, ["a", "b"]).where(known)
    covered = whole.select("id", "h", F.col("lo").alias("start"), (F.col("hi") + length).alias("end"))
    return covered.unionByName(ends.select(*span)).unionByName(inside.select(*span)), (ends, whole)


def repeats(texts: DataFrame, length: int = LENGTH, seed: int = SEED_WORDS, size: int = PIECE) -> DataFrame:
    """(id, h, starts, ends), written: the words of each text that lie in a window which
    a text with a smaller id has as well. texts: id, h, text; ids not null."""
    if not 0 < seed <= length:
        raise ValueError("a seed has at least one word and at most those of a window")
    held = materialise(texts.select("id", "h", "text").mapInArrow(_anchor_batches(length, seed), "anchor long, id long, h long, pos long"), "anchors")
    one = F.struct("id", "h", "pos")
    firsts = held.groupBy("anchor").agg(F.min(one).alias("f"), F.max("id").alias("last")).where(F.col("f.id") < F.col("last"))
    firsts = materialise(firsts.select("anchor", F.col("f.id").alias("fid"), F.col("f.h").alias("fh"), F.col("f.pos").alias("fpos")), "firsts")
    seeds = held.join(firsts, "anchor").where((F.col("id") != F.col("fid")) | (F.col("h") != F.col("fh")) | (F.col("pos") != F.col("fpos")))
    number = lambda c: F.floor(F.col(c) / size).cast("long")
    where = [F.col("id"), F.col("h"), number("pos").alias("c"), F.col("fid"), F.col("fh"), number("fpos").alias("fc")]
    pairs = materialise(seeds.groupBy(*where).agg(F.collect_set(F.struct("pos", "fpos")).alias("seeds")), "pairs")
    wanted = pairs.select("id", "h", "c").unionByName(pairs.select(F.col("fid").alias("id"), F.col("fh").alias("h"), F.col("fc").alias("c")))
    wanted = materialise(wanted.groupBy("id", "h").agg(F.collect_set("c").alias("numbers")), "wanted")
    cut = texts.join(few(wanted, F.size("numbers")), ["id", "h"]).select("id", "h", "text", "numbers")
    cut = cut.mapInArrow(_piece_batches(length, seed, size), "id long, h long, c long, base long, words binary")
    pieces = materialise(cut.dropDuplicates(["id", "h", "c"]), "pieces")
    theirs = pieces.select(F.col("id").alias("fid"), F.col("h").alias("fh"), F.col("c").alias("fc"), F.col("base").alias("fbase"), F.col("words").alias("fwords"))
    both = pairs.join(pieces, ["id", "h", "c"]).join(theirs, ["fid", "fh", "fc"])
    found = materialise(both.mapInArrow(_extend_batches(length, seed), "id long, h long, start long, end long, a long, b long, lo long, hi long"), "extended")
    open_ = found.where("a IS NOT NULL")
    least = open_.groupBy("a", "b").agg(F.min("id").alias("least"), F.max("id").alias("last")).where(F.col("least") < F.col("last"))
    least = materialise(least.select("a", "b", "least"), "windows")
    more, written = looked_up(open_, least, length)
    spans = found.where("a IS NULL").select("id", "h", "start", "end").unionByName(more)
    grouped = spans.groupBy("id", "h").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    out = materialise(grouped.select("id", "h", merged_udf("spans").alias("m")).select("id", "h", "m.*"), "repeats")
    discard(held, firsts, pairs, wanted, pieces, found, least, *written)
    return out


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, seed: int = SEED_WORDS, size: int = PIECE, into: str = "__kept") -> DataFrame:
    """``docs`` with a struct named ``into``: n_words, n_removed, and text, the words
    that stay joined by one space."""
    marked, _ = _marked(docs, id_col, text_col)
    own = marked.where(F.col("id").isNotNull() & (F.col("first").isNull() | (F.col("first") == F.col("id"))))
    found = repeats(own.select("id", "h", "text"), length, seed, size)
    joined = marked.join(few(found, F.size("starts")), ["id", "h"], "left")
    # a copy's spans are those of its whole text
    copy = F.coalesce(F.col("first") < F.col("id"), F.lit(False))
    done = joined.select(F.col("d").withField(quoted(into), _kept(length)("text", copy, "starts", "ends")).alias("d"))
    return unnested(done, [*[c for c in docs.columns if c != into], into])


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    k = F.col("__kept")
    return out.select("doc_id", k["n_words"].alias("n_words"), k["n_removed"].alias("n_removed"), F.sha2(k["text"], 256).alias("kept_sha256"))


OP13_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS words FROM documents
), windows AS (
  SELECT r, doc_id, s, md5(array_to_string(list_slice(words, s, s + {LENGTH - 1}), ' ')) AS w
  FROM (SELECT r, doc_id, words, unnest(range(1, len(words) - {LENGTH - 2})) AS s FROM docs WHERE len(words) >= {LENGTH} AND doc_id IS NOT NULL)
), least AS (
  SELECT w, min(doc_id) AS first FROM windows GROUP BY w
), gone AS (
  SELECT DISTINCT r, unnest(range(s, s + {LENGTH})) AS pos FROM windows JOIN least USING (w) WHERE first < doc_id
), per AS (
  SELECT r, list(pos) AS pos FROM gone GROUP BY r
), cut AS (
  SELECT d.doc_id, len(d.words) AS n_words, coalesce(len(p.pos), 0) AS n_removed, d.r
  FROM docs d LEFT JOIN per p USING (r)
), kept AS (
  SELECT u.r, string_agg(u.word, ' ' ORDER BY u.pos) AS kept
  FROM (SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM docs) u ANTI JOIN gone g ON u.r = g.r AND u.pos = g.pos GROUP BY u.r
)
SELECT c.doc_id, c.n_words::BIGINT AS n_words, c.n_removed::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM cut c LEFT JOIN kept k USING (r)
"""
