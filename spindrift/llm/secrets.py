"""Secret scans with multipart credential linking, on DataFrame functions alone.

Strong patterns stand by themselves. Weak parts (a bare identifier, a bare secret,
an endpoint) are reported only if a complementary part starts within ``SCOPE``
characters of them in the same text. That is an interval join of a text's parts with
themselves, done as a sweep: parts are sorted by their start, and running maxima and
minima give each the nearest part of every kind before and after it, so that the work
follows the number of parts and never the number of their pairs. A scope never leaves
its text; so neither do parts, and nothing is shuffled.

Defined results: a null text counts as empty and has no spans. Null ids, repeated
rows and further columns pass through. An empty table gives an empty result. Texts
are scanned whole, in time near proportional to their length and matches. Spans are
in code points, the end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, nested, running, table, unnested

SCOPE = 200
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Strong patterns; the lengths are those of a whole run, so that a run counts as
#: soon as it is long enough. ``assign`` is matched first and its length tested
#: afterwards, as a short value also uses up its text.
STRONG = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
#: Weak parts: (complement kinds, pattern).
IDENTIFIER = r"(?<![A-Za-z0-9])(?:AKIA|ASIA|AROA|AIDA)[A-Z0-9]{12,}|(?i:access_?key_?id|client_?id|user(?:name)?)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._@-]{4,}"
SECRET = r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}={0,2}(?![A-Za-z0-9+/=])|(?i:pass(?:word|wd)?|pwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[^\s\"']{4,}"
ENDPOINT = r"(?:https?|ftp|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]{4,}"
#: What must be in a text for a pattern to match at all; cheaper than the pattern.
WEAK = {
    "identifier": (IDENTIFIER, r"AKIA|ASIA|AROA|AIDA|[iI][dD]|[uU][sS][eE][rR]"),
    "secret": (SECRET, r"[A-Za-z0-9+/]{40}|[:=]"),
    "endpoint": (ENDPOINT, r"://"),
}
COMPLEMENTS = {"identifier": ("secret", "endpoint"), "secret": ("identifier", "endpoint"), "endpoint": ("identifier", "secret")}
SPAN = "array<struct<start:long,rank:int,end:long>>"


def spans(text: Column, pattern: str, kind: str, least: int = 0, group: int = 0) -> Column:
    """Start and end of every match, in code points: the text between matches and
    the matches themselves, laid end to end. ``least``: shortest accepted length of
    ``group``; a match that fails it is dropped after it has used up its text."""
    p = F.lit(pattern)
    rank = F.lit(KINDS.index(kind))
    whole = F.regexp_extract_all(text, p, F.lit(0))
    tested = F.regexp_extract_all(text, p, F.lit(group)) if group else whole

    def laid(found: Column, parts: Column, between: Column) -> Column:
        sizes = F.transform(found, lambda m, i: (F.length(F.get(between, i)) + F.length(m)).cast("long"))

        def placed(ends: Column) -> Column:
            rows = F.transform(ends, lambda e, i: F.struct((e - F.length(F.get(found, i))).cast("long").alias("start"), rank.alias("rank"), e.alias("end")))
            return F.filter(rows, lambda _, i: F.length(F.get(parts, i)) >= least).cast(SPAN)

        return let(running(sizes, "long", F.lit(0), lambda a, x: a + x), placed)

    none = F.array().cast(SPAN)
    return let(
        whole,
        lambda w: F.when(F.size(w) == 0, none).otherwise(let(tested, lambda t: let(F.split(text, pattern, -1), lambda b: laid(w, t, b)))),
    )


def _guarded(text: Column, test: Column, value: Column) -> Column:
    return F.when(test, value).otherwise(F.array().cast(SPAN))


def scan(text: Column) -> Column:
    """A struct of the whole text: ``base`` spans, and ``found``, these and the weak
    ones that are linked."""
    # each kind of assignment needs one of these letters pairs beside a colon or an equals sign
    def parts(t: Column) -> Column:
        named = t.rlike(r"[:=]") & t.rlike(r"(?i)passw|secret|token|api_?key")
        base = F.concat(
            _guarded(t, named, spans(t, ASSIGN, "assign", 6, 2)),
            _guarded(t, F.contains(t, F.lit("AKIA")), spans(t, STRONG["access"], "access")),
            spans(t, STRONG["hex"], "hex"),
        )
        weak = F.concat(*[_guarded(t, t.rlike(test), spans(t, p, k)) for k, (p, test) in WEAK.items()])
        return F.struct(base.alias("base"), let(weak, linked).alias("linked"))

    made = let(F.coalesce(text, F.lit("")), parts)
    return let(made, lambda s: F.struct(s["base"].alias("base"), F.concat(s["base"], s["linked"]).alias("found")))


def linked(weak: Column) -> Column:
    """Of weak spans, those with a complement whose start is in scope of theirs."""
    far = 1 << 40
    kinds = [KINDS.index(k) for k in COMPLEMENTS]

    def nearest(ordered: Column, sign: int) -> dict[int, Column]:
        """By kind: starts of the nearest span of that kind up to each, in order."""
        signed = lambda k: lambda x: F.when(x["rank"] == k, x["start"] * sign).otherwise(F.lit(-far))
        return {k: running(F.transform(ordered, signed(k)), "long", F.lit(-far), F.greatest) for k in kinds}

    def sweep(up: Column) -> Column:
        n = F.size(up)
        before, after = nearest(up, 1), nearest(F.reverse(up), -1)
        near = F.array(*[F.struct(before[k].alias("before"), after[k].alias("after")) for k in kinds])

        def hit(near: Column, x: Column, i: Column) -> Column:
            def close(k: int) -> Column:
                of = near[kinds.index(k)]
                return (x["start"] - F.get(of["before"], i) <= SCOPE) | (-F.get(of["after"], n - 1 - i) - x["start"] <= SCOPE)

            some = F.lit(False)
            for k, others in COMPLEMENTS.items():
                some = some | ((x["rank"] == KINDS.index(k)) & (close(KINDS.index(others[0])) | close(KINDS.index(others[1]))))
            return some

        return let(near, lambda m: F.filter(up, lambda x, i: hit(m, x, i)))

    several = F.size(F.array_distinct(F.transform(weak, lambda x: x["rank"]))) > 1
    return F.when(several, let(F.array_sort(weak), sweep)).otherwise(F.array().cast(SPAN))


def _digest(found: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(F.array_sort(found), lambda x: F.concat_ws(":", F.get(names, x["rank"]), x["start"].cast("string"), x["end"].cast("string"))), ","
    )


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", scan(F.col("text")).alias("s"))

    def count(kind: str) -> Column:
        rank = KINDS.index(kind)
        return F.size(F.filter("s.base", lambda x: x["rank"] == rank)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, ("assign", "access", "hex")), F.sha2(_digest(F.col("s.base")), 256).alias("base_sha256"), _digest(F.col("s.found")).alias("spans"))


#: Characters of the blocks that a text is cut into, to be cut again within them.
CUT = 1024


def redact(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, overlapping ones as one, replaced by ``mark``."""

    def between(blocks: Column, a: Column, b: Column) -> Column:
        """Characters a to b of the text, read in the blocks that hold them."""
        first, last = F.floor(a / CUT).cast("int"), F.floor((b - 1) / CUT).cast("int")
        head = lambda k, at, n: F.substring(F.get(blocks, k), (at + 1).cast("int"), n.cast("int"))
        one = head(first, F.pmod(a, F.lit(CUT)), b - a)
        middle = F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        several = F.concat(head(first, F.pmod(a, F.lit(CUT)), F.lit(CUT)), middle, head(last, F.lit(0), b - last * CUT))
        return F.when(b <= a, "").when(first == last, one).otherwise(several)

    def cut(s: Column) -> Column:
        length = F.length(text).cast("long")
        ends = F.concat(F.array(F.lit(0).cast("long")), running(F.transform(s, lambda x: x["end"]), "long", F.lit(0), F.greatest))

        def pieces(blocks: Column, e: Column) -> Column:
            one = lambda x, i: let(F.get(e, i), lambda at: F.when(x["start"] >= at, F.concat(between(blocks, at, x["start"]), F.lit(mark))).otherwise(""))
            return F.concat(F.array_join(F.transform(s, one), ""), between(blocks, F.element_at(e, -1), length))

        blocks = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % CUT), F.lit(0))
        return let(blocks, lambda b: let(ends, lambda e: pieces(b, e)))

    return F.when(F.size(found) == 0, text).otherwise(let(F.array_sort(found), cut))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every span, strong or linked, is replaced in the text, and
    ``n_chars`` follows. No document is dropped."""
    t = docs["text"]
    hidden = let(scan(t), lambda s: F.when(F.size(s["found"]) > 0, redact(F.coalesce(t, F.lit("")), s["found"])))
    found = nested(docs, hidden.alias("hidden"))
    n = F.coalesce(F.length("hidden").cast("long"), F.col("d").getField("n_chars")) if "n_chars" in docs.columns else F.lit(0)
    return unnested(found, docs.columns, text=F.coalesce(F.col("hidden"), F.col("d").getField("text")), n_chars=n)
