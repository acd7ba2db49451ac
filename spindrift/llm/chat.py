"""Chat formatting: a compiler for a sandboxed template language.

A template is parsed into a syntax tree, its constants are folded, and the tree
becomes Python closures that append to an output and note the spans of
``{% generation %}`` blocks, the text under the loss mask. The language has
``{{ expression }}``, ``{% if %} {% elif %} {% else %} {% endif %}``,
``{% for x in y %} {% endfor %}``, ``{% set x = y %}`` and ``{% generation %}
{% endgeneration %}``; expressions have literals, names, ``a['key']``, ``a.key``
(both of mappings and lists alone), ``+ == != < > <= >= and or not in``,
``a if c else b`` and the filters below. It reaches no attribute, calls nothing and
loops over given lists only.

Defined results: a null text or role counts as empty. Turns are ordered by turn,
role and text, null first, so that ties have one order; repeated rows are turns of
their own. A null conv_id is a conversation like any other. An empty table gives
just the added conversation. Further columns are not read.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>")
TEMPLATE = (
    "{{ bos }}"
    "{% for m in messages %}"
    "{{ '<|im_start|>' }}{{ m['role'] | escape_line }}{{ '\\n' }}"
    "{% if m['role'] == 'assistant' %}{% generation %}{{ m['content'] | escape }}{% endgeneration %}"
    "{% else %}{{ m['content'] | escape }}{% endif %}"
    "{{ '<|im_end|>' + '\\n' }}"
    "{% endfor %}"
    "{{ eos }}"
)
NAMES = {"bos": "<s>", "eos": "</s>"}


class TemplateError(ValueError):
    pass


# --- escaping ---------------------------------------------------------------

_STARTS = re.compile("(?=(?:" + "|".join(map(re.escape, CONTROLS)) + "))(.)", re.S)


def escape(text: str) -> str:
    """No control string is left: a backslash follows the first character of each,
    and each backslash of the text itself is doubled."""
    return _STARTS.sub(r"\1\\", text.replace("\\", "\\\\"))


def escape_line(text: str) -> str:
    return escape(text).replace("\n", "\\\n")


def unescape(text: str) -> str:
    return re.sub(r"(?s)\\(.)", r"\1", text)


FILTERS: dict[str, Callable[[Any], Any]] = {
    "escape": lambda x: escape(str(x)),
    "escape_line": lambda x: escape_line(str(x)),
    "trim": lambda x: str(x).strip(),
    "upper": lambda x: str(x).upper(),
    "lower": lambda x: str(x).lower(),
    "length": len,
    "string": str,
}

# --- parsing ----------------------------------------------------------------

#: A tag, whose end is not looked for inside its strings.
_INNER = r"""(?:'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*"|.)*?"""
_TAG = re.compile(rf"(\{{\{{-?{_INNER}-?\}}\}}|\{{%-?{_INNER}-?%\}}|\{{\#.*?\#\}})", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<number>\d+)|(?P<string>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|<=|>=|[-+<>\[\].|(),=]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"'}


def _tokens(source: str) -> list[tuple[str, Any]]:
    out, at = [], 0
    source = source.strip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"unexpected text: {source[at : at + 20]!r}")
        kind = m.lastgroup or ""
        value: Any = m[kind]
        if kind == "number":
            value = int(value)
        elif kind == "string":
            value = re.sub(r"(?s)\\(.)", lambda x: _ESCAPES.get(x[1], x[0]), value[1:-1])
        out.append((kind, value))
        at = m.end()
    return out


class _Parser:
    """Expressions become tuples: ("const", v), ("name", n), ("get", a, b), ("op",
    sign, a, b), ("not", a), ("if", c, a, b), ("filter", name, a)."""

    def __init__(self, source: str) -> None:
        self.tokens, self.at = _tokens(source), 0

    def peek(self) -> tuple[str, Any]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", None)

    def take(self, kind: str | None = None, value: Any = None) -> Any:
        k, v = self.peek()
        if (kind and k != kind) or (value is not None and v != value):
            raise TemplateError(f"expected {value or kind}, found {v!r}")
        self.at += 1
        return v

    def accept(self, kind: str, value: Any) -> bool:
        if self.peek() == (kind, value):
            self.at += 1
            return True
        return False

    def end(self) -> None:
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")

    def expression(self) -> tuple:
        value = self.either()
        if self.accept("name", "if"):
            test = self.either()
            other = self.expression() if self.accept("name", "else") else ("const", "")
            return ("if", test, value, other)
        return value

    def either(self) -> tuple:
        left = self.both()
        while self.accept("name", "or"):
            left = ("op", "or", left, self.both())
        return left

    def both(self) -> tuple:
        left = self.negation()
        while self.accept("name", "and"):
            left = ("op", "and", left, self.negation())
        return left

    def negation(self) -> tuple:
        return ("not", self.negation()) if self.accept("name", "not") else self.comparison()

    def comparison(self) -> tuple:
        left = self.sum()
        kind, value = self.peek()
        if (kind == "sign" and value in ("==", "!=", "<", ">", "<=", ">=")) or (kind, value) == ("name", "in"):
            self.at += 1
            return ("op", value, left, self.sum())
        if (kind, value) == ("name", "not") and self.tokens[self.at + 1 : self.at + 2] == [("name", "in")]:
            self.at += 2
            return ("not", ("op", "in", left, self.sum()))
        return left

    def sum(self) -> tuple:
        left = self.filtered()
        while self.accept("sign", "+"):
            left = ("op", "+", left, self.filtered())
        return left

    def filtered(self) -> tuple:
        value = self.postfix()
        while self.accept("sign", "|"):
            name = self.take("name")
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            value = ("filter", name, value)
        return value

    def postfix(self) -> tuple:
        value = self.atom()
        while True:
            if self.accept("sign", "["):
                value = ("get", value, self.expression())
                self.take("sign", "]")
            elif self.accept("sign", "."):
                value = ("get", value, ("const", self.take("name")))
            else:
                return value

    def atom(self) -> tuple:
        kind, value = self.peek()
        self.at += 1
        if kind in ("string", "number"):
            return ("const", value)
        if (kind, value) == ("sign", "-") and self.peek()[0] == "number":
            return ("const", -self.take("number"))
        if kind == "name":
            fixed = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
            return ("const", fixed[value]) if value in fixed else ("name", value)
        if (kind, value) == ("sign", "("):
            inner = self.expression()
            self.take("sign", ")")
            return inner
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> list[tuple]:
    """The syntax tree: ("text", s), ("out", e), ("if", [(test, body)...]), ("for",
    name, e, body), ("set", name, e), ("generation", body)."""
    pieces = _TAG.split(source)
    for k in range(1, len(pieces), 2):  # - beside a tag strips the white space there
        if pieces[k][2:3] == "-":
            pieces[k - 1] = pieces[k - 1].rstrip()
        if pieces[k][-3:-2] == "-" and len(pieces[k]) > 4:
            pieces[k + 1] = pieces[k + 1].lstrip()
    stream = iter([p for p in pieces if p and not p.startswith("{#")])

    def body(ends: tuple[str, ...]) -> tuple[list[tuple], str, str]:
        out: list[tuple] = []
        for piece in stream:
            if piece.startswith("{{"):
                p = _Parser(piece[2:-2].strip("-"))
                out.append(("out", p.expression()))
                p.end()
            elif piece.startswith("{%"):
                word, _, rest = piece[2:-2].strip("-").strip().partition(" ")
                if word in ends:
                    return out, word, rest
                out.append(statement(word, rest))
            else:
                out.append(("text", piece))
        if "" not in ends:
            raise TemplateError(f"missing {ends[-1]}")
        return out, "", ""

    def whole(source: str) -> tuple:
        p = _Parser(source)
        e = p.expression()
        p.end()
        return e

    def statement(word: str, rest: str) -> tuple:
        if word == "if":
            branches, test = [], whole(rest)
            while True:
                inner, end, more = body(("elif", "else", "endif"))
                branches.append((test, inner))
                if end == "endif":
                    return ("if", branches)
                if end == "else":
                    inner, _, _ = body(("endif",))
                    return ("if", [*branches, (("const", True), inner)])
                test = whole(more)
        if word == "for":
            m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
            if not m:
                raise TemplateError(f"for: {rest!r}")
            return ("for", m[1], whole(m[2]), body(("endfor",))[0])
        if word == "set":
            m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s*=\s*(.+)", rest, re.S)
            if not m:
                raise TemplateError(f"set: {rest!r}")
            return ("set", m[1], whole(m[2]))
        if word == "generation":
            return ("generation", body(("endgeneration",))[0])
        raise TemplateError(f"unknown tag {word!r}")

    return body(("",))[0]


# --- folding ----------------------------------------------------------------

_OPERATIONS: dict[str, Callable[[Any, Any], Any]] = {
    "+": lambda a, b: a + b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
}


def operate(sign: str, a: Any, b: Any) -> Any:
    try:
        return _OPERATIONS[sign](a, b)
    except TypeError as e:
        raise TemplateError(f"{sign}: {e}") from e


def filtered(name: str, value: Any) -> Any:
    """A filter's value; null counts as empty text, as where it is shown."""
    if name != "length":
        return FILTERS[name](_shown(value))
    try:
        return len("" if value is None else value)
    except TypeError as e:
        raise TemplateError(f"length: {e}") from e


def computed(e: tuple, value: Callable[[], Any]) -> tuple:
    """A constant, or the expression as it is if it has no value: then it fails where
    it is rendered, if it is."""
    try:
        return ("const", value())
    except TemplateError:
        return e


def fold(e: tuple, names: dict[str, Any]) -> tuple:
    """An expression with its constant parts computed; ``names`` are fixed values."""
    kind = e[0]
    if kind == "name":
        return ("const", names[e[1]]) if e[1] in names else e
    if kind == "op":
        a, b = fold(e[2], names), fold(e[3], names)
        if e[1] in ("and", "or") and a[0] == "const":
            return b if bool(a[1]) == (e[1] == "and") else a
        if a[0] == b[0] == "const" and e[1] in _OPERATIONS:
            return computed(("op", e[1], a, b), lambda: operate(e[1], a[1], b[1]))
        return ("op", e[1], a, b)
    if kind == "not":
        a = fold(e[1], names)
        return ("const", not a[1]) if a[0] == "const" else ("not", a)
    if kind == "if":
        test = fold(e[1], names)
        if test[0] == "const":
            return fold(e[2] if test[1] else e[3], names)
        return ("if", test, fold(e[2], names), fold(e[3], names))
    if kind == "filter":
        a = fold(e[2], names)
        return computed(("filter", e[1], a), lambda: filtered(e[1], a[1])) if a[0] == "const" else ("filter", e[1], a)
    if kind == "get":
        return ("get", fold(e[1], names), fold(e[2], names))
    return e


def fold_body(body: list[tuple], names: dict[str, Any]) -> list[tuple]:
    """Statements with constants folded, decided branches taken and texts joined."""
    assigned = _assigned(body)
    names = {k: v for k, v in names.items() if k not in assigned}
    out: list[tuple] = []

    def add(s: tuple) -> None:
        if s[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + s[1])
        elif s != ("text", ""):
            out.append(s)

    for s in body:
        if s[0] == "out":
            e = fold(s[1], names)
            add(("text", _shown(e[1])) if e[0] == "const" else ("out", e))
        elif s[0] == "if":
            branches = []
            for test, inner in s[1]:
                test = fold(test, names)
                if test[0] == "const" and not test[1]:
                    continue
                branches.append((test, fold_body(inner, names)))
                if test[0] == "const":
                    break
            if branches and branches[0][0][0] == "const":
                for x in branches[0][1]:
                    add(x)
            elif branches:
                add(("if", branches))
        elif s[0] == "for":
            inner = {k: v for k, v in names.items() if k not in (s[1], "loop")}
            add(("for", s[1], fold(s[2], names), fold_body(s[3], inner)))
        elif s[0] == "set":
            add(("set", s[1], fold(s[2], names)))
        elif s[0] == "generation":
            add(("generation", fold_body(s[1], names)))
        else:
            add(s)
    return out


def _assigned(body: list[tuple]) -> set[str]:
    found: set[str] = set()
    for s in body:
        if s[0] == "set":
            found.add(s[1])
        for inner in [x for _, x in s[1]] if s[0] == "if" else [s[-1]] if s[0] in ("for", "generation") else []:
            found |= _assigned(inner)
    return found


# --- closures ---------------------------------------------------------------


def _shown(x: Any) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x)


def _expression(e: tuple) -> Callable[[dict], Any]:
    kind = e[0]
    if kind == "const":
        value = e[1]
        return lambda env: value
    if kind == "name":
        name = e[1]
        return lambda env: env.get(name)
    if kind == "get":
        a, b = _expression(e[1]), _expression(e[2])

        def get(env: dict) -> Any:
            of, key = a(env), b(env)
            if isinstance(of, dict):
                return of.get(key)
            if isinstance(of, (list, tuple, str)) and isinstance(key, int) and -len(of) <= key < len(of):
                return of[key]
            return None

        return get
    if kind == "not":
        a = _expression(e[1])
        return lambda env: not a(env)
    if kind == "if":
        test, a, b = map(_expression, e[1:])
        return lambda env: a(env) if test(env) else b(env)
    if kind == "filter":
        name, a = e[1], _expression(e[2])
        return lambda env: filtered(name, a(env))
    a, b = _expression(e[2]), _expression(e[3])
    if e[1] == "and":
        return lambda env: a(env) and b(env)
    if e[1] == "or":
        return lambda env: a(env) or b(env)
    sign = e[1]
    return lambda env: operate(sign, a(env), b(env))


class _Out:
    """What has been rendered, its length, and the spans under the loss mask."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.length = 0
        self.spans: list[tuple[int, int]] = []

    def add(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


def _statements(body: list[tuple]) -> Callable[[dict, _Out], None]:
    steps = [_statement(s) for s in body]

    def run(env: dict, out: _Out) -> None:
        for step in steps:
            step(env, out)

    return run


def _statement(s: tuple) -> Callable[[dict, _Out], None]:
    if s[0] == "text":
        text = s[1]
        return lambda env, out: out.add(text)
    if s[0] == "out":
        value = _expression(s[1])
        return lambda env, out: out.add(_shown(value(env)))
    if s[0] == "set":
        name, given = s[1], _expression(s[2])
        return lambda env, out: env.__setitem__(name, given(env))
    if s[0] == "generation":
        inner = _statements(s[1])

        def marked(env: dict, out: _Out) -> None:
            start = out.length
            inner(env, out)
            out.spans.append((start, out.length))

        return marked
    if s[0] == "if":
        branches = [(_expression(t), _statements(b)) for t, b in s[1]]

        def choose(env: dict, out: _Out) -> None:
            for test, then in branches:
                if test(env):
                    return then(env, out)
            return None

        return choose
    name, items, then = s[1], _expression(s[2]), _statements(s[3])

    def loop(env: dict, out: _Out) -> None:
        given = items(env) or []
        if not isinstance(given, (list, tuple)):
            raise TemplateError("for needs a list")
        for k, x in enumerate(given):
            inner = env | {name: x, "loop": {"index": k + 1, "index0": k, "first": k == 0, "last": k == len(given) - 1}}
            then(inner, out)

    return loop


def compile_template(source: str, names: dict[str, Any] | None = None) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function from values to (text, spans under the loss mask in code points)."""
    run = _statements(fold_body(parse(source), names or {}))

    def render(values: dict) -> tuple[str, list[tuple[int, int]]]:
        out = _Out()
        run(dict(values), out)
        return "".join(out.parts), out.spans

    return render


# --- reading back -----------------------------------------------------------

_TURN = re.compile(r"(?s)<\|im_start\|>((?:\\.|[^\\\n])*)\n(.*?)<\|im_end\|>\n")


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of what TEMPLATE has rendered."""
    head, tail = NAMES["bos"], NAMES["eos"]
    if not (formatted.startswith(head) and formatted.endswith(tail)):
        raise ValueError("no formatted conversation")
    at, out, end = len(head), [], len(formatted) - len(tail)
    while at < end:
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def loss_text(formatted: str, spans: list[tuple[int, int]]) -> str:
    return "".join(unescape(formatted[a:b]) for a, b in spans)


# --- tables -----------------------------------------------------------------

@functools.lru_cache(maxsize=8)
def _render(source: str) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    return compile_template(source, NAMES)


FORMATTED = "conv_id long, formatted string, spans array<struct<start:long,end:long>>"


def format_conversations(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """One row a conversation: conv_id, formatted text and spans under the loss mask.
    Turns come sorted, so that a task holds one conversation at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = _render(template)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        current, turns, done = None, [], []

        def close() -> None:
            text, spans = render({"messages": turns})
            done.append((current[0], text, [{"start": a, "end": b} for a, b in spans]))

        def batch() -> pa.RecordBatch:
            ids, texts, spans = zip(*done)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(spans, kind)], ["conv_id", "formatted", "spans"])

        for b in batches:
            for conv, role, text in zip(*(c.to_pylist() for c in b.columns)):
                if current != (conv,):
                    if current:
                        close()
                    current, turns = (conv,), []
                turns.append({"role": role, "content": text})
            if done and len(done) >= 256:
                yield batch()
                done.clear()
        if current:
            close()
        if done:
            yield batch()

    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    role = F.coalesce(F.col("role"), F.lit("")).alias("role")
    slim = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role, text)
    dealt = slim.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, FORMATTED)


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        turns, loss = [], []
        for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            turns.append([{"role": r, "text": t} for r, t in read_back(text)])
            loss.append(loss_text(text, [(s["start"], s["end"]) for s in spans]))
        kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(turns, kind), pa.array(loss, pa.string())], ["conv_id", "formatted", "turns", "loss"])


def read_conversations(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (role, text) and loss, from the output alone."""
    return formatted.select("conv_id", "formatted", "spans").mapInArrow(_read_batches, "conv_id long, formatted string, turns array<struct<role:string,text:string>>, loss string")


ADDED = "</s>[INST] ok [/INST]"


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ADDED).alias("text")
    )
    back = read_conversations(format_conversations(given.unionByName(added)))
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
