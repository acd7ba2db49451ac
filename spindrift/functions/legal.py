"""Functions over legal documents as Column expressions: types, numbers, titles,
references, and the texts that are made of metadata."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X

# --- fixed values ------------------------------------------------------------

#: Folders and slug beginnings of document types, in this order.
TYPE_BY_SLUG = {
    "bo_luat": "law", "bo-luat": "law", "luat": "law", "nghi_dinh": "decree", "nghi-dinh": "decree", "thong_tu": "circular",
    "thong-tu": "circular", "nghi_quyet": "resolution", "nghi-quyet": "resolution", "quyet_dinh": "decision", "quyet-dinh": "decision",
}
#: Names of document types.
TYPE_BY_NAME = {"bộ luật": "law", "luật": "law", "nghị định": "decree", "thông tư": "circular", "nghị quyết": "resolution", "quyết định": "decision"}
#: Labels of document types.
TYPE_LABEL = {"law": "Luật", "decree": "Nghị định", "circular": "Thông tư", "resolution": "Nghị quyết", "decision": "Quyết định", "guideline": "Hướng dẫn", "other": "Văn bản"}
#: Who issues a type of document.
TYPE_ISSUER = {"law": "Quốc hội", "decree": "Chính phủ", "circular": "Bộ ngành", "resolution": "Quốc hội", "decision": "Cơ quan nhà nước", "guideline": "Cơ quan nhà nước", "other": "Cơ quan nhà nước"}
#: What tells a file's slug from a title.
SLUG_MARK = r"(?iu)\b(?:N_|N-|-CP|_CP|Ngh_nh|Th_ng|Quy_nh|Ngh Nh|Th Ng|Quy Nh)\b"
UNKNOWN_TITLE = r"(?iu)kh.{1,3}ng\s+r.{1,3}\s+v.{1,3}n\s+b.{1,3}n"
#: Numbers of documents in a slug, in a header line, and in a question.
SLUG_YEAR = r"(?iu)(?:^|_)(\d{1,4})[_-](\d{4})[_-]([A-Za-zĐÐ]+)[_-]*([A-Za-zĐÐ]+)?(?:_|-|$)"
SLUG_OLD = r"(?i)(?:^|_)(\d{1,4})[-_ ]([A-Za-z]{1,8})[-_/ ]([A-Za-z]{2,10})(?:_|-|$)"
NUMBER_IN_SLUG = (
    r"(?iu)(?:^|-)so-(\d{1,4})-(\d{4})-(QH\d+|UBTVQH\d+|NQ|ND|NĐ|CP|TT)(?:-|$)",
    r"(?iu)(?:^|-)(\d{1,4})-(\d{4})-(QH\d+|UBTVQH\d+|NQ|ND|NĐ|CP|TT)(?:-|$)",
)
NUMBER_IN_HEADER = r"(?iu)\b\d{1,4}\s*[/\-]\s*\d{4}\s*[/\-]\s*(?:QH|UBTVQH|NQ|ND|NĐ|CP|TT|BTNMT|BTP|BTC|BYT|BGDĐT|BLĐTBXH|BCA|BQP|VPCP)\d*\b"
HEADER_MARK = r"(?u)(?:luật|bộ luật|nghị quyết|nghị định|thông tư|quyết định)\s+số\b"
LEGAL_NUMBER = r"\b\d{1,4}\s*[/\-]\s*\d{4}\s*[/\-]\s*[A-Za-zĐđ]+[A-Za-z0-9Đđ]*\b"
#: Fixed value: the threshold of confidence below which a scan is warned of.
LOW_CONFIDENCE = 0.7
LOW_CONFIDENCE_NOTE = (
    "Độ tin cậy OCR thấp. Nên tải lại file scan rõ hơn, chụp thẳng góc, đủ sáng, "
    "không bị mờ hoặc mất mép văn bản trước khi đưa vào tìm kiếm."
)
#: Title hints of issues that have none.
HINTS_BY_ISSUE = {"nghia_vu_dan_su": ["Bộ luật Dân sự"], "bao_hiem_y_te": ["Luật Bảo hiểm y tế"], "bao_hiem_xa_hoi": ["Luật Bảo hiểm xã hội"]}
PENAL_ISSUES, PENAL_HINTS, ANY_HINTS = ("chiem_doat", "xam_pham"), ["Bộ luật Hình sự"], ["Bộ luật", "Luật"]


def _map(values: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def _strip(c: Column) -> Column:
    return F.regexp_replace(X.text_of(c), r"(?U)^\s+|\s+$", "")


# --- uploaded text -----------------------------------------------------------


@F.arrow_udf(T.StringType())
def _composed(texts: pa.Array) -> pa.Array:
    import unicodedata

    return pa.array([None if x is None else unicodedata.normalize("NFC", x) for x in texts.to_pylist()], pa.string())


def composed(c: Column) -> Column:
    """Canonical composition. Texts that have signs up to U+02FF, composed Latin letters
    and common punctuation alone, of which none needs it, stay in the JVM."""
    return F.coalesce(_composed(F.when(c.rlike(r"[\x{300}-\x{1DFF}\x{1F00}-\x{200F}\x{2028}-\x{10FFFF}]"), c)), c)


#: White space, and signs that end lines, but spaces and newlines.
RARE_SPACE = r"[\t\x0b-\r\x1c-\x1e\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def prepared_lines(c: Column) -> Column:
    """Lines, stripped, without empty ones; numbered clauses and lettered points that
    follow a sentence's end begin lines of their own."""
    clauses = F.regexp_replace(X.text_of(c), r"(?U)(?<=[.;:])\s+(?=\d+[.)]\s+)", "\n")
    points = X.let(clauses, lambda t: F.when(t.rlike("[;:]"), F.regexp_replace(t, r"(?iU)(?<=[;:])\s+(?=[a-zđ][.)]\s+)", "\n")).otherwise(t))
    every = lambda t: F.transform(F.split(t, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), _strip)
    cut = X.let(points, lambda t: F.when(t.rlike(RARE_SPACE), every(t)).otherwise(F.transform(F.split(t, "\n"), lambda x: F.trim(x))))
    return F.filter(cut, lambda x: x != "")


def title_case(c: Column) -> Column:
    """Each run of letters with a capital first letter, the others small."""

    def one(chars: Column) -> Column:
        letter = lambda x: x.rlike(r"\p{L}")
        return F.array_join(F.transform(chars, lambda x, i: F.when((i > 0) & letter(F.get(chars, i - 1)), F.lower(x)).otherwise(F.upper(x))), "")

    return X.let(F.split(X.text_of(c), ""), one)


def stem(c: Column) -> Column:
    """The last part of a path without its extension."""
    name = F.regexp_extract(X.text_of(c), r"([^/]*)/*$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def detected_title(lines: Column, file_name: Column) -> Column:
    """The first of 20 lines that is all capitals, else the name of the file."""
    loud = F.filter(F.slice(lines, 1, 20), lambda x: (F.length(x) >= 8) & (F.upper(x) == x) & x.rlike(r"\p{L}"))
    named = title_case(F.translate(stem(file_name), "-_", "  "))
    return F.when(F.size(loud) > 0, title_case(F.get(loud, 0))).otherwise(named)


def safe_stem(c: Column) -> Column:
    bare = F.btrim(F.regexp_replace(stem(c), r"[^A-Za-z0-9_.-]+", "-"), F.lit(".-"))
    return F.when(bare == "", "document").otherwise(bare)


def quality_warning(confidence: Column) -> Column:
    return F.when(F.coalesce(confidence, F.lit(0.0)) < LOW_CONFIDENCE, LOW_CONFIDENCE_NOTE)


def average_confidence(values: Column) -> Column:
    """Mean of the values that are not negative, each at most one; 0.0 without any."""
    good = F.transform(F.filter(values, lambda v: v >= 0), lambda v: F.least(F.lit(1.0), v.cast("double")))
    return X.let(good, lambda g: F.when(F.size(g) == 0, 0.0).otherwise(F.aggregate(g, F.lit(0.0), lambda a, x: a + x) / F.size(g)))


# --- types, numbers, titles ---------------------------------------------------


def detected_type(identifier: Column) -> Column:
    """By a part of the path, else by how the slug begins, else ``other``."""
    low = X.casefold(identifier)
    by_part = F.get(F.filter(F.transform(F.split(low, r"[\\/]+"), lambda p: _map(TYPE_BY_SLUG, p)), lambda x: x.isNotNull()), 0)
    slug = F.regexp_replace(F.translate(low, "-", "_"), r"^[0-9]+[_-]*", "")
    start = reduce(lambda w, kv: w.when(slug.startswith(kv[0].replace("-", "_")), kv[1]), TYPE_BY_SLUG.items(), F.when(F.lit(False), ""))
    return F.coalesce(by_part, start, F.lit("other"))


def source_type(value: Column, identifier: Column) -> Column:
    return F.coalesce(_map(TYPE_BY_NAME, X.casefold(_strip(value))), detected_type(identifier))


def looks_like_slug(c: Column) -> Column:
    t = _strip(c)
    return (t == "") | t.rlike(r"[_\\/]") | t.rlike(SLUG_MARK)


def number_from_slug(identifier: Column) -> Column:
    """A document's number out of a file's name; empty if there is none."""
    slug = F.regexp_replace(stem(identifier), r"[\\/]", "_")
    n, year, code, more = (F.regexp_extract(slug, SLUG_YEAR, k) for k in (1, 2, 3, 4))
    code, more = F.upper(code), F.upper(more)
    dated = F.when((code == "N") & (more == "CP"), F.concat(n, F.lit("/"), year, F.lit("/NĐ-CP"))).otherwise(
        F.concat(n, F.lit("/"), year, F.lit("/"), code, F.when(more != "", F.concat(F.lit("-"), more)).otherwise(""))
    )
    old = F.concat(F.regexp_extract(slug, SLUG_OLD, 1), F.lit("-"), F.upper(F.regexp_extract(slug, SLUG_OLD, 2)), F.lit("/"), F.upper(F.regexp_extract(slug, SLUG_OLD, 3)))
    return F.when(n != "", dated).when(slug.rlike(SLUG_OLD), old).otherwise("")


def normal_number(c: Column) -> Column:
    bare = F.regexp_replace(F.upper(_strip(c)), r"(?U)\s+", "")
    return F.btrim(F.regexp_replace(F.translate(bare, "-", "/"), "/+", "/"), F.lit(".,;:()[]{} "))


def number_from_text(c: Column, identifier: Column) -> Column:
    """A document's number out of its slug, else out of a header line among the first
    hundred; empty if there is none."""
    slug = F.translate(X.text_of(identifier), "_", "-")
    found = [F.concat_ws("/", *[F.regexp_extract(slug, p, k) for k in (1, 2, 3)]) for p in NUMBER_IN_SLUG]
    in_slug = F.when(slug.rlike(NUMBER_IN_SLUG[0]), found[0]).when(slug.rlike(NUMBER_IN_SLUG[1]), found[1])
    lines = F.transform(F.slice(F.split(X.text_of(c), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), 1, 100), _strip)

    def header(x: Column) -> Column:
        low = X.casefold(x)
        marked = F.contains(low, F.lit("luật số")) | low.startswith("số") | low.rlike(HEADER_MARK)
        return (x != "") & (F.length(x) <= 160) & ~F.contains(low, F.lit("điều của")) & marked & x.rlike(NUMBER_IN_HEADER)

    line = F.get(F.filter(lines, header), 0)
    return normal_number(F.coalesce(in_slug, F.regexp_extract(line, NUMBER_IN_HEADER, 0)))


def legal_numbers(c: Column) -> Column:
    """Forms of the document numbers that a question names, letters included."""
    return F.array_distinct(F.transform(F.regexp_extract_all(X.text_of(c), F.lit(LEGAL_NUMBER), F.lit(0)), X.identifier_form))


def type_label(kind: Column) -> Column:
    return F.coalesce(_map(TYPE_LABEL, kind), F.lit("Văn bản"))


def issuing_authority(kind: Column) -> Column:
    return F.coalesce(_map(TYPE_ISSUER, kind), F.lit("Cơ quan nhà nước"))


def source_title(title: Column, number: Column, kind: Column, document_id: Column) -> Column:
    """The title, unless it is unknown or a slug; else the type with number or id."""
    t = _strip(title)
    good = (t != "") & ~t.rlike(UNKNOWN_TITLE) & ~looks_like_slug(t)
    return F.when(good, t).otherwise(F.concat_ws(" ", type_label(kind), X.falsy_coalesce(number, _strip(document_id.cast("string")))))


def slug_title(c: Column) -> Column:
    bare = _strip(F.translate(F.regexp_replace(X.text_of(c), r"^[0-9]+_", ""), "-_", "  "))
    return title_case(F.regexp_replace(bare, r"(?U)\s+", " "))


def iso_time(c: Column, fallback: Column) -> Column:
    """An ISO time, or the fallback where there is none or it cannot be read."""
    return F.coalesce(F.try_to_timestamp(F.regexp_replace(F.nullif(c, F.lit("")), "Z$", "+00:00")), fallback)


def iso_text(c: Column) -> Column:
    """A time as ISO text in UTC."""
    return F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


# --- references ----------------------------------------------------------------


def _part(c: Column) -> Column:
    return F.nullif(X.squeeze(c), F.lit(""))


def _prefixed(c: Column, prefix: str) -> Column:
    return F.when(c.rlike(rf"(?iu)^{prefix.lower()}\b"), c).otherwise(F.concat(F.lit(f"{prefix} "), c))


def legal_reference(article: Column, clause: Column, target: Column) -> Column:
    """``Khoản c Điều a (sửa đổi Điều t)`` of what is there; null if nothing is."""
    a, c, t = _part(article), _part(clause), _part(target)
    changed = F.concat(F.lit("(sửa đổi "), _prefixed(t, "Điều"), F.lit(")"))
    return F.nullif(F.concat_ws(" ", _prefixed(c, "Khoản"), _prefixed(a, "Điều"), changed), F.lit(""))


def _technical(c: Column) -> Column:
    return F.coalesce(_strip(c), F.lit("")).rlike(r"^\d*$")


def _slug_shaped(c: Column) -> Column:
    t = _strip(c)
    words = F.split(t, r"(?U)\s+")
    short = F.size(F.filter(words, lambda w: w.rlike(r"(?i)^[bcdfghjklmnpqrstvwxyz]{1,3}$"))) >= 5
    single = F.size(F.filter(words, lambda w: w.rlike(r"(?i)^[A-Z]$"))) >= 4
    broken = t.rlike(r"(?i)\b(?:N Cp|Ngh Nh|Th Ng T|Quy Nh|I U|Ch Nh|Giao Th Ng|Ng B)\b")
    shape = t.rlike(r"[_/\\]") | t.rlike(r"(?i)\b(?:N_|N-|-CP|_CP|Ngh_nh|Th_ng|Quy_nh)\b")
    return (t == "") | t.rlike(r"(?iu)^kh[oô]ng r[oõ] v[aă]n b[aả]n$") | shape | broken | single | short


def shown_number(number: Column, title: Column, document_id: Column) -> Column:
    n = _part(number)
    known = F.when(n.isNotNull() & ~_technical(n) & ~_slug_shaped(n), n)
    # here a slug is what is left of a name without its extension, whatever its slashes
    slug = lambda c: F.nullif(number_from_slug(F.regexp_replace(F.regexp_replace(X.text_of(c), r"(?i)\.[a-z0-9]+$", ""), r"[\\/]+", "_")), F.lit(""))
    return F.coalesce(known, slug(title), slug(number), slug(document_id))


def document_label(title: Column, number: Column, document_id: Column, kind: Column) -> Column:
    t, n, i = _part(title), shown_number(number, title, document_id), _part(document_id)
    return (
        F.when(t.isNotNull() & ~_technical(t) & ~_slug_shaped(t), t)
        .when(n.isNotNull() & ~_technical(n), F.concat_ws(" ", type_label(kind), n))
        .when(i.isNotNull() & ~_slug_shaped(i), F.concat_ws(" ", type_label(kind), i))
        .otherwise(type_label(kind))
    )


def citation(reference: Column, label: Column) -> Column:
    return F.concat_ws(", ", reference, label)


def article_query(article: Column, title: Column) -> Column:
    """The question that a graph's article adds."""
    return F.concat_ws(" ", F.concat(F.lit("Điều "), _part(article)), _part(title))


# --- metadata -------------------------------------------------------------------

#: Labels of a document's properties, in order.
PROPERTIES = (
    ("Số hiệu", "doc_number"), ("Loại văn bản", "doc_type"), ("Ngành", "majors"), ("Ngày ban hành", "issue_date"), ("Lĩnh vực", "fields"),
    ("Ngày có hiệu lực", "effective_from"), ("Tình trạng hiệu lực", "effective_status"), ("Ngày hết hiệu lực", "effective_to"),
    ("Cơ quan ban hành", "agency_name"), ("Chức danh", "signer_title"), ("Người ký", "signer"), ("Nguồn", "source_url"),
)


def property_text(columns: dict[str, Column]) -> Column:
    """A heading and a line a property; what is missing is empty, no end is ``--``."""
    joined = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), " | ")

    def value(name: str) -> Column:
        if name in ("majors", "fields"):
            return joined(columns[name])
        if name == "effective_to":
            return F.coalesce(X.falsy_coalesce(columns[name]), F.lit("--"))
        if name == "agency_name":
            return X.text_of(X.falsy_coalesce(columns[name], columns["organization"]))
        return X.text_of(columns[name])

    return F.concat_ws("\n", F.lit("THUỘC TÍNH VĂN BẢN"), *[F.concat(F.lit(f"{label}: "), value(name)) for label, name in PROPERTIES])


def pair_text(fields: list[Column], limit: int = 1800) -> Column:
    """What a pair-wise reranker reads of a candidate: its fields, a line each, from
    title to text."""
    lines = [F.when(X.text_of(c) != "", _strip(c)) for c in fields]
    return F.substring(F.concat_ws("\n", *lines), 1, max(200, limit))


def rule_text(rule: dict[str, Column], query: Column) -> Column:
    """What is embedded of a rule for one of its semantic queries."""
    name, kind, about = X.falsy_coalesce(_strip(rule["display_name"]), _strip(rule["label"])), X.falsy_coalesce(_strip(rule["issue_type_name"]), _strip(rule["issue_type"])), X.falsy_coalesce(_strip(rule["description"]))
    return F.concat_ws("\n", F.concat(F.lit("Vấn đề pháp lý: "), name, F.lit(".")), F.concat(F.lit("Loại: "), kind, F.lit(".")), F.concat(F.lit("Tình huống: "), query, F.lit(".")), F.concat(F.lit("Mô tả: "), about))


def title_hints(hints: Column, preferred: Column, issue_type: Column) -> Column:
    """A rule's own title hints, else those of its kind of issue."""
    own = F.filter(F.coalesce(hints, F.array().cast("array<string>")), lambda h: F.trim(h) != "")
    lit = lambda xs: F.array(*map(F.lit, xs))
    kind = X.text_of(issue_type)
    p = F.coalesce(preferred, F.array().cast("array<string>"))
    penal = (F.size(p) > 0) & F.forall(p, lambda a: a.rlike(r"^\d+$") & (F.coalesce(a.try_cast("long"), F.lit(1 << 40)) < 300)) & (kind.startswith(PENAL_ISSUES[0]) | kind.startswith(PENAL_ISSUES[1]))
    by_kind = F.when(penal, lit(PENAL_HINTS))
    for name, found in HINTS_BY_ISSUE.items():
        by_kind = by_kind.when(kind == name, lit(found))
    given = F.size(F.coalesce(hints, F.array().cast("array<string>"))) > 0
    return F.when(given, own).otherwise(by_kind.otherwise(lit(ANY_HINTS)))
