"""Quality rules as weak supervision, on DataFrame functions alone.

Each rule votes good (1), bad (-1) or abstains (0). Expectation-maximisation over
the counts of vote patterns (at most 3 ** rules rows, whatever the corpus)
estimates each rule's accuracy on good and on bad text, and a document is kept by
its posterior probability instead of by passing every rule.

Defined results: a null text counts as one without words; such a text, and any
with under 20 words, fails the base test and is not kept. Null ids, repeated rows
and further columns pass through. An empty table gives an empty result and leaves
the starting parameters as they are. Very long texts are measured whole, inside
their row; no row is exploded and no group is collected.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, WORD, let, materialise, nested, table, unnested

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 20


def _drop(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def repeated_words(words: Column) -> Column:
    """Words inside windows of ``WINDOW`` words that the text holds twice or more,
    the first occurrence included, in n log n for the text's n words."""
    n = F.size(words)

    def joined(hashes: Column, step: int) -> Column:
        return F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + step)))

    def windows(hashes: Column) -> Column:
        eight = let(joined(hashes, 1), lambda two: let(joined(two, 2), lambda four: joined(four, 4)))
        return F.slice(eight, 1, n - (WINDOW - 1))

    def covered(starts: Column) -> Column:
        return F.aggregate(
            starts,
            F.struct(F.lit(0).alias("words"), F.lit(-WINDOW).alias("last")),
            lambda a, i: F.struct(
                (a["words"] + F.least(F.lit(WINDOW), i - a["last"])).alias("words"), i.alias("last")
            ),
            lambda a: a["words"],
        )

    def repeats(found: Column) -> Column:
        ordered = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(
            ordered,
            lambda s: covered(
                F.array_sort(
                    F.transform(
                        F.filter(
                            s,
                            lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]),
                        ),
                        lambda x: x["i"],
                    )
                )
            ),
        )

    return F.when(n < WINDOW, F.lit(0)).otherwise(
        let(
            let(F.transform(words, lambda w: F.xxhash64(w)), windows),
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(F.coalesce(repeats(h), F.lit(0))),
        )
    )


def features(text: Column) -> Column:
    """A struct of counts over the whole text."""
    text = F.coalesce(text, F.lit(""))
    length = F.length(text)
    words = F.array_remove(F.split(text, SPACE + "+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))

    def count(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)).cast("long")

    return let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            count(SYMBOLS).alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x)))).cast("long").alias("n_dup_lines"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            F.size(lines).cast("long").alias("n_lines"),
            count("[A-Z]{2,}").alias("n_upper"),
            (length - F.length(_drop(text, "!"))).cast("long").alias("n_bangs"),
            (length - F.length(_drop(text, ".?"))).cast("long").alias("n_stops"),
        ),
    )


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes(q: Column) -> list[Column]:
    """The rules. Each reads the counts and says 1, -1 or 0."""
    n, never = q["n_words"], F.lit(False)
    mean = q["word_chars"] / F.greatest(n, F.lit(1))
    return [
        _vote(n >= 50, never),
        _vote(mean.between(3, 12), (mean < 2.5) | (mean > 18)),
        _vote(never, q["n_symbols"] * 10 > n),
        _vote(never, q["n_dup_lines"] * 10 > q["n_lines"] * 4),
        _vote(never, q["n_repeat_words"] * 4 > n),
        # distinct words grow with the text up to a hundred words, and with its root beyond
        _vote((q["n_distinct"] * 2 >= n) | (q["n_distinct"] >= F.sqrt(n) * 5), (n >= 30) & (q["n_distinct"] * 10 < n * 3) & (q["n_distinct"] < F.sqrt(n) * 3)),
        _vote(never, q["n_bangs"] * 10 > n),
        _vote(never, q["n_upper"] * 10 > n * 4),
        _vote(q["n_stops"] * 60 >= n, (n >= 50) & (q["n_stops"] * 200 < n)),
    ]


def base_failed(q: Column) -> Column:
    return (q["n_words"] < MIN_WORDS) | (q["n_repeat_words"] * 100 > q["n_words"] * 30)


def posterior(columns: list[Column], model: dict) -> Column:
    """Probability that a row with these votes is good text."""
    score = F.lit(_odds(model["prior"]))
    for v, (up, down, none) in zip(columns, _weights(model), strict=True):
        score = score + F.when(v == 1, up).when(v == -1, down).otherwise(none)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


def _odds(p: float) -> float:
    return math.log(p / (1 - p))


def _weights(model: dict) -> list[tuple[float, float, float]]:
    """What a vote of 1, a vote of -1 and an abstention add to the log odds, by rule."""
    out = []
    for r in model["rules"]:
        none = [1 - r[f"up_{c}"] - r[f"down_{c}"] for c in ("good", "bad")]
        out.append((math.log(r["up_good"] / r["up_bad"]), math.log(r["down_good"] / r["down_bad"]), math.log(none[0] / none[1])))
    return out


#: What is believed of a rule before any text is seen, the weight of that belief
#: as a share of all documents, and the most often that a rule may be taken to
#: condemn good text. Without this limit the likelihood alone may call a rule's
#: kind of bad text good, since most bad text breaks one rule and passes the rest.
BELIEF = {"up_good": 0.5, "up_bad": 0.4, "down_good": 0.002, "down_bad": 0.2}
STRENGTH = 0.3
MOST_WRONG = 0.01


def fit(counts: list[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = 50, tolerance: float = 1e-6) -> dict:
    """Expectation-maximisation over (vote pattern, count) pairs. By rule it
    estimates how often it says 1 and -1 on good and on bad text, each held to
    its belief by a Beta prior. The pairs are at most 3 ** n_rules, whatever the
    corpus, and are all that the driver sees of it."""
    model = {"prior": 0.85, "rules": [dict(BELIEF) for _ in range(n_rules)]}
    counts = sorted(counts)
    total = sum(n for _, n in counts)
    held = STRENGTH * total
    for _ in range(rounds if total else 0):
        weights, start = _weights(model), _odds(model["prior"])
        good = 0.0
        sums = [{"up_good": 0.0, "up_bad": 0.0, "down_good": 0.0, "down_bad": 0.0} for _ in range(n_rules)]
        for pattern, n in counts:
            x = start + sum(w[0] if v > 0 else w[1] if v else w[2] for v, w in zip(pattern, weights))
            p = n / (1 + math.exp(-x))
            good += p
            for v, s in zip(pattern, sums):
                if v:
                    side = "up" if v > 0 else "down"
                    s[f"{side}_good"] += p
                    s[f"{side}_bad"] += n - p
        of = {"good": good, "bad": total - good}
        most = {"down_good": MOST_WRONG}
        share = {c: of[c] / total for c in of}  # the belief weighs as much as its class does
        rules = [
            {k: min(most.get(k, 0.97), max(1e-4, (s[k] + held * share[c] * BELIEF[k]) / (of[c] + held * share[c] + 1e-9))) for k in s for c in (k.split("_")[1],)}
            for s in sums
        ]
        for r in rules:
            r["up_good"], r["up_bad"] = min(r["up_good"], 0.985 - r["down_good"]), min(r["up_bad"], 0.985 - r["down_bad"])
        new = {"prior": min(0.99, max(0.01, good / total)), "rules": rules}
        moved = max(abs(a[k] - b[k]) for a, b in zip(model["rules"], rules) for k in a)
        model = new
        if moved < tolerance:
            break
    return model


def _model(voted: DataFrame, rules: list[str]) -> dict:
    counts = voted.where(~F.col("failed")).groupBy(*rules).agg(F.count("*").alias("n")).collect()
    return fit([(tuple(x[r] for r in rules), x["n"]) for x in counts], len(rules))


def judged(counted: DataFrame) -> DataFrame:
    """``counted``, which has a struct ``q`` of counts and has been written, with
    ``base_failed``, ``posterior`` and ``kept``. The driver sees counted vote
    patterns alone."""
    q = F.col("q")
    rules = [f"v{k}" for k in range(len(votes(q)))]
    voted = counted.select(*[v.alias(r) for v, r in zip(votes(q), rules)], base_failed(q).alias("failed"))
    p = posterior(votes(q), _model(voted, rules))
    return counted.select("*", base_failed(q).alias("base_failed"), p.alias("posterior"), (~base_failed(q) & (p >= 0.5)).alias("kept"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # the counts alone are written: the text is not needed again
    counted = materialise(docs.select("doc_id", features(F.col("text")).alias("q")), "quality")
    counts = [F.col("q").getField(c).alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged(counted).select("doc_id", *counts, "base_failed", "kept", F.round("posterior", 6).alias("posterior"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose posterior quality is at least one half. The
    counts are written once, beside the rows, and read for fitting and the verdict."""
    counted = materialise(nested(docs, features(docs["text"]).alias("q")), "quality")
    return unnested(judged(counted).where("kept"), docs.columns)
