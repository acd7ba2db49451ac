"""Text functions as Column expressions. All stay in the JVM; none is a UDF."""

from __future__ import annotations

import unicodedata
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"
#: Folded words too common in legal questions to carry content.
CONTENT_STOPWORDS = ("nghi", "dinh", "nd", "cp", "so", "ve", "cua", "theo", "tai", "trong", "quy", "dieu", "khoan")
#: Document identifiers such as 45/2019/QH14 or 100/2015/NĐ-CP, as they
#: are searched for and as answers cite them, and articles such as Điều 12a.
IDENTIFIER = r"(?iU)\b\d{1,4}\s*[/\-]\s*\d{4}\s*[/\-]\s*[A-Za-zÀ-ỹĐđ]+(?:\s*[-/]\s*[A-Za-zÀ-ỹĐđ0-9]+)*\b"
CITED_NUMBER = r"(?iU)\b\d{1,4}\s*/\s*\d{4}\s*/\s*[A-ZÀ-ỸĐ]+(?:[-/][A-ZÀ-ỸĐ0-9]+)*\b"
ARTICLE = r"(?iU)\b(?:điều|dieu|article)\s+(\d+[a-z]?)\b"


def let(value: Column, body) -> Column:  # noqa: ANN001
    """Evaluate ``value`` once for many uses in ``body``: inside a lambda, a plain
    reference would be evaluated again for every element."""
    return F.transform(F.array(value), body)[0]


def falsy_coalesce(*columns: Column) -> Column:
    """The first that is neither null nor an empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def squeeze(c: Column) -> Column:
    """White space collapsed to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text_of(c), r"(?U)\s+", " "))


def normalize_lower(c: Column) -> Column:
    return F.lower(squeeze(c))


def tokens(c: Column) -> Column:
    """Word tokens in lower case; accents, stop words and single letters are kept."""
    return F.regexp_extract_all(F.lower(text_of(c)), F.lit(TOKEN), F.lit(0))


@cache
def _accent_table() -> tuple[str, str]:
    """Latin letters with marks and the plain letters they stand for, by
    canonical decomposition."""
    source, target = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and len(parts[0]) == 1:
            source.append(chr(code))
            target.append(parts[0])
    return "".join(source), "".join(target)


def strip_accents(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, *_accent_table()), r"\p{Mn}+", "")


def casefold(c: Column) -> Column:
    return F.replace(F.lower(text_of(c)), F.lit("ß"), F.lit("ss"))


def fold_search(c: Column) -> Column:
    """The full-text analyzer's folding: case and accents, but đ stays."""
    return strip_accents(casefold(c))


def fold(c: Column) -> Column:
    """Ranking form: case, accents and đ folded, spaces collapsed."""
    return squeeze(F.translate(fold_search(c), "đ", "d"))


def fold_eval(c: Column) -> Column:
    """Evaluation form: ASCII letters and digits in words."""
    return F.trim(F.regexp_replace(F.translate(fold_search(c), "đ", "d"), "[^a-z0-9]+", " "))


def identifier_form(c: Column) -> Column:
    return F.regexp_replace(F.translate(fold_search(c), "đ", "d"), "[^a-z0-9]+", "")


def rank_tokens(c: Column) -> Column:
    return F.filter(F.regexp_extract_all(fold(c), F.lit(TOKEN), F.lit(0)), lambda t: F.length(t) >= 2)


def eval_tokens(c: Column) -> Column:
    return F.filter(F.split(fold_eval(c), " "), lambda t: F.length(t) >= 2)


def search_words(c: Column) -> Column:
    """Words as the full-text analyzer sees them."""
    return F.filter(F.split(fold_search(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def search_tokens(c: Column) -> Column:
    """Distinct words of a full-text query, in order."""
    return F.array_distinct(search_words(c))


def identifiers(c: Column) -> Column:
    found = F.regexp_extract_all(text_of(c), F.lit(IDENTIFIER), F.lit(0))
    return F.array_distinct(F.transform(found, identifier_form))


def article_numbers(c: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text_of(c), F.lit(ARTICLE), F.lit(1)), F.lower))


def article_references(c: Column, own: Column) -> Column:
    """Articles that a text names, less the one it is."""
    return F.filter(article_numbers(c), lambda a: ~a.eqNullSafe(F.lower(own)))


def content_tokens(c: Column) -> Column:
    bare = F.regexp_replace(text_of(c), IDENTIFIER, " ")
    folded = F.transform(tokens(bare), lambda t: F.translate(fold_search(t), "đ", "d"))
    stop = F.array(*map(F.lit, CONTENT_STOPWORDS))
    return F.array_distinct(F.filter(folded, lambda t: (F.length(t) >= 2) & ~t.rlike(r"^\p{N}+$") & ~F.array_contains(stop, t)))


def content_overlap(text: Column, wanted: Column) -> Column:
    """Of ``wanted``, 3 for each in the first line, 2 in the first 700 characters, 1
    elsewhere, over three times their number."""
    folded = lambda c: F.translate(fold_search(c), "đ", "d")
    first = F.regexp_extract(text_of(text), r"^[^\r\n]*", 0)
    forms = F.struct(folded(text).alias("whole"), folded(first).alias("head"), folded(F.substring(text_of(text), 1, 700)).alias("early"))

    def hits(f: Column) -> Column:
        def one(a: Column, t: Column) -> Column:
            return a + F.when(F.contains(f["head"], t), 3.0).when(F.contains(f["early"], t), 2.0).when(F.contains(f["whole"], t), 1.0).otherwise(0.0)

        return F.aggregate(wanted, F.lit(0.0), one)

    return F.when(F.size(wanted) == 0, 0.0).otherwise(let(forms, hits) / (F.size(wanted) * 3.0))


def clip_words(c: Column, n: int) -> Column:
    """At most n characters of the squeezed text, cut before a word that would not fit."""
    flat = squeeze(c)
    head = F.substring(flat, 1, n)
    return F.when(F.length(flat) <= n, flat).otherwise(falsy_coalesce(F.trim(F.regexp_replace(head, r" [^ ]*\z", "")), F.trim(head)))


def clean_lines(c: Column) -> Column:
    """Lines, squeezed, without empty ones."""
    lines = F.split(F.regexp_replace(text_of(c), r"\r\n?", "\n"), "\n", -1)
    return F.array_join(F.filter(F.transform(lines, squeeze), lambda x: x != ""), "\n")


def slugify(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.translate(fold_search(c), "đ", "d"), "[^a-z0-9]+", "-"), F.lit("-"))


def safe_name(c: Column, n: int = 150) -> Column:
    """A file name without separators and control characters."""
    return F.substring(F.btrim(F.regexp_replace(squeeze(c), r'[<>:"/\\|?*\x00-\x1f]+', "_"), F.lit(" ._")), 1, n)


def trim_embedding_input(c: Column, provider: str = "openai", limit: int = 6000) -> Column:
    """(text, trimmed): for the provider that bounds its input, text over ``limit`` is
    cut at the last line end within it, unless that loses half, and stripped."""
    strip = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+\z", "")
    head = F.substring(text_of(c), 1, limit)
    at_line = strip(F.regexp_replace(head, r"\n[^\n]*\z", ""))
    long = (F.length(text_of(c)) > limit) & F.lit(provider == "openai")
    cut = F.when(F.length(at_line) < limit // 2, strip(head)).otherwise(at_line)
    return F.struct(F.when(long, cut).otherwise(text_of(c)).alias("text"), long.alias("trimmed"))


def searchable_text(**fields: Column) -> Column:
    """Labelled fields in order, a line each: titles twice, names clipped to 250
    characters, contexts to 500, lists to their first twenty; empty ones are left out."""
    parts = []
    for name, c in fields.items():
        limit = 500 if name in ("metadata", "context") else 250
        value = text_of(c) if name == "text" else clip_words(c, limit)
        line = F.when(value != "", value if name == "text" else F.concat(F.lit(f"{name}: "), value))
        parts += [line] * (2 if name in ("title", "article_title") else 1)
    return F.concat_ws("\n", *parts)


def join_list(c: Column, n: int = 20) -> Column:
    return F.array_join(F.filter(F.transform(F.slice(c, 1, n), squeeze), lambda x: x != ""), ", ")


def numbers(c: Column) -> Column:
    """Distinct canonical numbers of a text in evaluation form."""
    found = F.regexp_extract_all(fold_eval(c), F.lit(r"\d+"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: falsy_coalesce(F.ltrim(x, F.lit("0")), F.lit("0"))))


def citation_keys(c: Column) -> Column:
    norm = fold_eval(c)
    kinds = (("article", "dieu"), ("clause", "khoan"))

    def keys(kind: str, word: str) -> Column:
        return F.transform(F.regexp_extract_all(norm, F.lit(rf"\b{word}\s+(\d+[a-z]?)\b"), F.lit(1)), lambda x: F.concat(F.lit(f"{kind}:"), x))

    found = [keys(k, w) for k, w in kinds]
    return F.array_distinct(F.concat(*found))


def issued_date(c: Column) -> Column:
    """``ngày d tháng m năm y`` as an ISO date; the calendar is not consulted."""
    pattern = r"(?iu)ngày\s+(\d{1,2})\s+tháng\s+(\d{1,2})\s+năm\s+(\d{4})"
    d, m, y = (F.regexp_extract(text_of(c), pattern, k) for k in (1, 2, 3))
    return F.when(y != "", F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")))


def document_number(c: Column) -> Column:
    """Upper case, no spaces, ``/`` between parts, no punctuation at the ends."""
    bare = F.regexp_replace(F.upper(text_of(c)), r"(?U)\s+", "")
    return F.btrim(F.regexp_replace(F.replace(bare, F.lit("-"), F.lit("/")), "/+", "/"), F.lit("/.,;:"))


def sentences(c: Column, n: int = 3, least: int = 25, most: int = 240) -> Column:
    """The first sentences that are long enough, clipped; dashes at their ends go."""
    parts = F.transform(F.split(squeeze(c), r"(?<=[.!?])\s+"), lambda s: F.btrim(s, F.lit(" -")))
    return F.slice(F.transform(F.filter(parts, lambda s: F.length(s) >= least), lambda s: F.trim(F.substring(s, 1, most))), 1, n)


def json_object(c: Column) -> Column:
    """A JSON object out of a model's text: all of it, else its outermost braces, else {}."""
    whole = F.try_parse_json(c)
    inner = F.try_parse_json(F.regexp_extract(text_of(c), r"(?s)\{.*\}", 0))
    return F.coalesce(F.when(F.schema_of_variant(whole).startswith("OBJECT"), whole), F.when(F.schema_of_variant(inner).startswith("OBJECT"), inner), F.parse_json(F.lit("{}")))


def uploaded_text(c: Column) -> Column:
    """Line ends unified, hyphenated breaks joined, spaces and blank lines collapsed.
    Compose texts first (see ``legal.composed``) where marks may stand apart."""
    steps = (("\r", "\r\n?", "\n"), ("-\n", r"(?U)(?<=\w)-\n(?=\w)", ""), ("", r"[ \t]{2,}|\t", " "), ("\n\n\n", r"\n{3,}", "\n\n"), ("", r"(?U)^\s+|\s+\z", ""))
    # most texts have nothing that a step looks for; to find that out costs less than the step
    return reduce(lambda x, s: let(x, lambda t: F.when(t.contains(s[0]), F.regexp_replace(t, s[1], s[2])).otherwise(t)) if s[0] else F.regexp_replace(x, s[1], s[2]), steps, text_of(c))


def metadata_block(*labelled: tuple[str, Column]) -> Column:
    return F.concat_ws("\n", *[F.concat(F.lit(f"{label}: "), text_of(c.cast("string"))) for label, c in labelled])


def display_title(article_number: Column, article_title: Column, chunk_id: Column, index: Column) -> Column:
    part = F.concat(F.lit(" - phần "), index.cast("string"))
    named = falsy_coalesce(F.concat(F.lit("Điều "), F.nullif(article_number, F.lit(""))), article_title, chunk_id, F.lit("chunk"))
    return F.concat(named, part)


def parent_context(fields: list[Column], article_number: Column) -> Column:
    label = F.concat(F.lit("Điều "), F.trim(text_of(article_number)))
    named = F.trim(text_of(article_number)) != ""

    def joined(parts: Column) -> Column:
        wanted = named & ~F.exists(parts, lambda p: F.lower(p).startswith(F.lower(label)))
        return F.array_join(F.when(wanted, F.concat(parts, F.array(label))).otherwise(parts), "\n")

    return let(F.array_distinct(F.filter(F.array(*[F.trim(text_of(f)) for f in fields]), lambda x: x != "")), joined)
