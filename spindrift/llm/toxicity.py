"""Toxicity by weak supervision.

Many voters read a text: lexicons of words and of word beginnings, and patterns of
how a text shouts or addresses. A generative label model estimates how often each
voter fires on toxic and on clean text, and how strongly voters depend on one another
beyond that, which lowers the weight of voters that say the same. It does so by
expectation-maximisation over the counted vote patterns of all documents of the
training folds, with or without a label; a given label is one more voter, whose own
accuracy is estimated as the others' are. Its posteriors on labelled texts train a
linear classifier on terms, and that scores every text.

The lexicons are mined from labelled rows whose crc32(doc_id) mod 5 is not 0, at
most ``LABELLED`` of them, the smallest by a hash of the id: that bound is for
fitting alone. A term is in a lexicon if its tie to the label is significant, tested
against as many terms as there are; no number of terms is given. Near copies count
once: what is counted are distinct smallest five-word shingles. Labels, lang, source
and doc_id are no features. Each text is read whole and once; the terms found in it
are written, and both the label model and the scores come from these.

Defined results: a null text counts as empty and gets the score of a text without
any features. A null id is never held out. Labels that are null, or of ids without
a text, are left out; an id with both labels counts as toxic. Without labelled rows
of both kinds, or without any significant term, every score is the neutral prior.
Repeated rows come back as often as they came; an empty table gives an empty result;
further columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

#: Most labelled rows used for fitting.
LABELLED = 12_000
#: Lexicons of words, and of word beginnings. With the patterns they are the voters,
#: so that vote patterns are at most 2 ** 16, whatever the corpus.
LEXICONS = {"w": 6, "s": 6}
#: Lengths of word beginnings.
STARTS = (4, 5, 6)
#: Least number of toxic texts that a term is in, and the chance that a term which
#: says nothing is taken for one that does, over all terms together.
SUPPORT, ERROR = 3, 0.05
#: Share of toxic text taken for granted where nothing is known.
PRIOR = 0.1
FOLDS = 5

_WORD = re.compile(r"[^\W\d_]+")
_ADDRESS = re.compile(r"(?i)\by(?:ou|our|ou're|ourself)\b")
_MASKED = re.compile(r"(?i)\b[a-z][*@#$]{2,}[a-z]*")


def in_training(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS != 0, F.lit(True))


def names_of(word: str) -> list[str]:
    """Terms of a word: itself and its beginnings."""
    return ["w:" + word, *("s:" + word[:k] for k in STARTS if len(word) > k)]


def patterns(text: str, n_words: int) -> tuple[bool, ...]:
    """Voters that no lexicon gives: exclamations, capitals, address, masked words."""
    letters = sum(map(str.isalpha, text)) or 1
    return (
        text.count("!") * 10 > n_words + 10,
        sum(map(str.isupper, text)) * 2 > letters and n_words > 5,
        len(_ADDRESS.findall(text)) * 30 > n_words + 30,
        bool(_MASKED.search(text)),
    )


N_PATTERNS = 4
VOTERS = sum(LEXICONS.values()) + N_PATTERNS


def family(words: list[str]) -> int:
    """Equal for most near copies: the smallest hash of five words in a row."""
    last = max(1, len(words) - 4)
    return min(xxhash.xxh64_intdigest(" ".join(words[i : i + 5])) for i in range(last)) >> 1


# --- mining -----------------------------------------------------------------


def labelled(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> DataFrame:
    """(text, y): at most ``bound`` texts of labelled ids of the training folds, in
    the order of a hash of the ids; toxic ones are a third at most. Equal texts with
    equal labels are one."""
    y = known(labels)
    order = F.xxhash64("__id")
    chosen = y.where("y = 1").orderBy(order, "__id").limit(bound // 3).unionByName(y.where("y = 0").orderBy(order, "__id").limit(bound - bound // 3))
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
    one = rows.groupBy("__id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    return one.groupBy(F.xxhash64("text").alias("h"), "y").agg(F.min("text").alias("text")).select("text", "y")


def known(labels: DataFrame) -> DataFrame:
    """(__id, y) of the training folds, a row an id."""
    y = labels.select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("y")).where("y in (0, 1) AND __id IS NOT NULL")
    return y.where(in_training(F.col("__id"))).groupBy("__id").agg(F.max("y").alias("y"))


def _terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, y, family, share of the words), a row a term and text."""
    for b in batches:
        for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            words = _WORD.findall(text.lower())
            if not words:
                continue
            counts: Counter = Counter()
            for word, n in Counter(words).items():
                for t in names_of(word):
                    counts[t] += n
            n, k = len(counts), family(words)
            shares = np.fromiter(counts.values(), np.float64, n) / len(words)
            yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(np.full(n, y, np.int32)), pa.array(np.full(n, k, np.int64)), pa.array(shares)], ["term", "y", "family", "share"])


def evidence(a: float, n1: float, b: float, n0: float) -> float:
    """Twice the log likelihood ratio of a term in a of n1 toxic and b of n0 clean
    texts against one rate for both."""
    p, out = (a + b) / (n1 + n0), 0.0
    for k, n in ((a, n1), (b, n0)):
        out += k * math.log(k / n / p) if k else 0.0
        out += (n - k) * math.log((1 - k / n) / (1 - p)) if n - k else 0.0
    return 2 * out


def mine(sample: DataFrame) -> tuple[list[str], list[float]]:
    """Significant terms, the strongest first, and from which share of a text's words
    on each speaks: between its usual shares in clean and in toxic texts."""
    rows = materialise(sample.mapInArrow(_terms_of, "term string, y int, family long, share double"), "terms")
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count_distinct("family").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return [], []
    one = rows.groupBy("term", "y", "family").agg(F.avg("share").alias("share")).groupBy("term").agg(
        *[F.count_if(F.col("y") == k).alias(f"n{k}") for k in (1, 0)], *[F.avg(F.when(F.col("y") == k, F.col("share"))).alias(f"s{k}") for k in (1, 0)]
    )
    some = one.where(F.col("n1") >= SUPPORT)
    held = materialise(some, "mined")
    tested = held.count()
    least = 2 * math.log(max(2, tested) / ERROR)
    likely = held.where(F.col("n1") * n0 > 2 * F.col("n0") * n1)
    # what is collected is bounded by the bounded sample, and is what passes the test
    found = [(evidence(r["n1"], n1, r["n0"], n0), r["term"], r["s1"], r["s0"]) for r in likely.toLocalIterator() if evidence(r["n1"], n1, r["n0"], n0) > least]
    found.sort(key=lambda x: (-x[0], x[1]))
    return [x[1] for x in found], [math.sqrt(x[2] * x[3]) if x[3] and x[2] > x[3] else 0.0 for x in found]


class Lexicon:
    """Numbers the mined terms and deals them to voters: of each kind, the strongest
    term to the first lexicon, the next to the second, and so on around."""

    def __init__(self, names: list[str], speaks: list[float]) -> None:
        self.number, self.speaks = {t: k for k, t in enumerate(names)}, speaks
        self.voter, dealt, base = [], Counter(), {"w": 0, "s": LEXICONS["w"]}
        for t in names:
            self.voter.append(base[t[0]] + dealt[t[0]] % LEXICONS[t[0]])
            dealt[t[0]] += 1
        self._known: dict[str, tuple[int, ...]] = {}

    def read(self, text: str) -> tuple[int, int, list[int], list[int]]:
        """Number of words, votes as bits, numbers of the terms held and their counts."""
        n, counts, known, number = 0, Counter(), self._known, self.number
        for word, k in Counter(_WORD.findall(text.lower())).items():
            n += k
            terms = known.get(word)
            if terms is None:
                terms = tuple(number[t] for t in names_of(word) if t in number)
                if len(known) > 300_000:
                    known.clear()
                known[word] = terms
            for t in terms:
                counts[t] += k
        held = sorted(counts)
        votes = 0
        for t in held:
            if counts[t] >= self.speaks[t] * n:
                votes |= 1 << self.voter[t]
        for k, on in enumerate(patterns(text, n)):
            votes |= on << (VOTERS - N_PATTERNS + k)
        return n, votes, held, [counts[t] for t in held]


READ = "n_words long, votes int, held array<int>, counts array<int>"


def reader(spark: SparkSession, lexicon: Lexicon):  # noqa: ANN201
    """A Column function: what a lexicon reads in a text."""
    shared = spark.sparkContext.broadcast(lexicon)  # the terms of the bounded sample
    kind = pa.struct([("n_words", pa.int64()), ("votes", pa.int32()), ("held", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])

    @F.arrow_udf(READ)
    def read(texts: pa.Array) -> pa.Array:
        rows = [shared.value.read(t or "") for t in texts.to_pylist()]
        return pa.array([dict(zip(("n_words", "votes", "held", "counts"), r)) for r in rows], kind)

    return read


# --- the label model --------------------------------------------------------


class LabelModel:
    """Independent voters that fire or abstain, given a hidden label: ``hit[j]`` and
    ``miss[j]`` are how often voter j fires on toxic and on clean text. ``weight[j]``
    is one over the number of voters that, as their correlation beyond the label
    shows, speak with it. ``label``: how often a given label says toxic of toxic and
    of clean text."""

    def __init__(self, n: int, prior: float) -> None:
        self.prior = prior
        self.hit, self.miss = np.full(n, 0.2), np.full(n, 0.02)
        self.weight = np.ones(n)
        self.label = np.array([0.9, 0.02])

    def posterior(self, votes: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
        """labels: 0, 1 or NaN where none is given."""
        on = np.log(self.hit / self.miss) * self.weight
        off = np.log((1 - self.hit) / (1 - self.miss)) * self.weight
        x = votes @ (on - off) + off.sum() + math.log(self.prior / (1 - self.prior))
        if labels is not None:
            up, down = np.log(self.label[0] / self.label[1]), np.log((1 - self.label[0]) / (1 - self.label[1]))
            x = x + np.where(labels == 1, up, np.where(labels == 0, down, 0.0))
        return 1 / (1 + np.exp(-np.clip(x, -50, 50)))

    def fit(self, votes: np.ndarray, labels: np.ndarray, counts: np.ndarray | None = None, rounds: int = 60, strength: float = 4.0) -> LabelModel:
        """Expectation-maximisation over vote patterns with their counts. Labelled
        texts alone give the start; then all count. Voters are smoothed towards one
        that fires on a fifth of toxic and a fiftieth of clean text, and the label
        towards one that is right nine times in ten."""
        counts = np.ones(len(votes)) if counts is None else counts.astype(np.float64)
        given = ~np.isnan(labels)
        p = np.where(given, np.clip(np.nan_to_num(labels), 0.05, 0.95), 0.0)
        part = counts * given
        for step in range(rounds):
            a, b = (part * p), (part * (1 - p))
            self.hit = np.clip((votes.T @ a + strength * 0.2) / (a.sum() + strength), 1e-3, 0.99)
            self.miss = np.clip((votes.T @ b + strength * 0.02) / (b.sum() + strength), 1e-5, 0.95)
            self.prior = float(np.clip(a.sum() / max(1.0, part.sum()), 0.005, 0.6))
            said = np.nan_to_num(labels) == 1
            for k, (w, usual) in enumerate(((a, 0.9), (b, 0.02))):
                w = w * given
                self.label[k] = np.clip(((w * said).sum() + strength * usual) / (w.sum() + strength), 1e-3, 0.999)
            self._correlate(votes, p, part)
            new = self.posterior(votes, labels)
            moved = np.abs(new - p)[part > 0].max(initial=0)
            p, part = new, counts
            if step and moved < 1e-5:
                break
        return self

    def _correlate(self, votes: np.ndarray, p: np.ndarray, counts: np.ndarray) -> None:
        """Correlations of what the label leaves unexplained, all voters at once."""
        rest = votes - (p[:, None] * self.hit + (1 - p)[:, None] * self.miss)
        n = max(1.0, counts.sum())
        scale = np.sqrt((counts[:, None] * rest**2).sum(axis=0) / n) + 1e-9
        c = (rest.T @ (counts[:, None] * rest)) / n / scale / scale[:, None]
        tied = np.clip(c, 0, 1)
        tied[tied < 0.3] = 0
        np.fill_diagonal(tied, 1)
        self.weight = 1 / tied.sum(axis=1)


def bits(votes: np.ndarray) -> np.ndarray:
    return (votes[:, None] >> np.arange(VOTERS) & 1).astype(np.float64)


# --- the classifier ---------------------------------------------------------


class Model:
    """A linear classifier on the presence of terms and on their share of a text."""

    def __init__(self, presence: np.ndarray, share: np.ndarray, bias: float) -> None:
        self.presence, self.share, self.bias = presence, share, bias

    def score(self, n_words: int, held: list[int], counts: list[int]) -> float:
        """Probability that a text is toxic."""
        x = self.bias
        for t, n in zip(held, counts):
            x += self.presence[t] * (1 + math.log(n)) + self.share[t] * 10 * math.sqrt(n / n_words)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


def train(rows: list[tuple[int, list[int], list[int]]], target: np.ndarray, n_terms: int, ridge: float = 0.3, rounds: int = 25) -> Model:
    """Logistic regression on soft targets by Newton's method, each step solved by
    conjugate gradients; both sides weigh the same. rows: words, terms, counts."""
    size = 2 * n_terms + 1
    owner = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    at = np.array([t for r in rows for t in r[1]], np.int64)
    n = np.array([c for r in rows for c in r[2]], np.float64)
    words = np.array([max(1, r[0]) for r in rows], np.float64)
    i, j, v = np.r_[owner, owner], np.r_[at, at + n_terms], np.r_[1 + np.log(n), 10 * np.sqrt(n / words[owner])] if len(n) else n
    forward = lambda w: np.bincount(i, v * w[j], len(rows)) + w[-1]
    back = lambda e: np.r_[np.bincount(j, v * e[i], size - 1), e.sum()]
    hold = np.r_[np.full(size - 1, ridge), 1e-6]
    share = float(np.clip(target.mean(), 0.01, 0.99))
    weight = target * 0.5 / share + (1 - target) * 0.5 / (1 - share)
    w = np.zeros(size)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(forward(w), -40, 40)))
        slope, curve = back((p - target) * weight) + hold * w, weight * p * (1 - p)
        step, r = np.zeros(size), slope.copy()
        d, rr = r.copy(), float(r @ r)
        for _ in range(200):
            if rr < 1e-10:
                break
            h = back(curve * forward(d)) + hold * d
            a = rr / float(d @ h)
            step, r = step + a * d, r - a * h
            new = float(r @ r)
            d, rr = r + new / rr * d, new
        w -= step
        if np.abs(step).max(initial=0) < 1e-4:
            break
    return Model(w[:n_terms], w[n_terms:-1], float(w[-1]))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    sample = materialise(labelled(docs, labels), "labelled")
    names, speaks = mine(sample)
    held_out = (~in_training(F.col("doc_id"))).alias("held_out")
    if not names:
        scored = docs.select("doc_id", held_out, F.lit(PRIOR).alias("score"))
        return scored.withColumn("predicted", F.lit(0))
    read = reader(spark, Lexicon(names, speaks))
    texts = materialise(docs.select("doc_id", held_out, read(F.col("text")).alias("r")).select("doc_id", "held_out", "r.*"), "read")
    # at most 3 * 2 ** VOTERS rows reach the driver, whatever the corpus
    seen = texts.where(~F.col("held_out")).join(known(labels), F.col("doc_id") == F.col("__id"), "left").groupBy("votes", "y").agg(F.count("*").alias("n")).collect()
    label = np.array([np.nan if r["y"] is None else r["y"] for r in seen], np.float64)
    votes = bits(np.array([r["votes"] for r in seen], np.int64))
    generative = LabelModel(VOTERS, PRIOR).fit(votes, label, np.array([r["n"] for r in seen]))
    rows = sample.select("y", read(F.col("text")).alias("r")).select("y", "r.*").collect()  # at most LABELLED, of the mined terms alone
    rows = sorted((r["y"], r["n_words"], r["votes"], r["held"], r["counts"]) for r in rows)
    target = generative.posterior(bits(np.array([r[2] for r in rows], np.int64)), np.array([r[0] for r in rows], np.float64))
    model = spark.sparkContext.broadcast(train([(r[1], r[3], r[4]) for r in rows], target, len(names)))

    @F.arrow_udf("double")
    def score(n_words: pa.Array, held: pa.Array, counts: pa.Array) -> pa.Array:
        m = model.value
        return pa.array([round(m.score(*x), 9) for x in zip(n_words.to_pylist(), held.to_pylist(), counts.to_pylist())], pa.float64())

    scored = texts.select("doc_id", "held_out", score("n_words", "held", "counts").alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
