"""Configuration scripts: text to an evaluated document, and queries, rules, flattening and canonical text of it.

A file is parsed as a whole first; each expression becomes a function of its scope, and these run
afterwards in file order. Values are None, bool, int (64 bits, wrapping), float, bytes, list and Obj.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .cursor import U64, WireError, signed
from .digests import escape, quote_escape

MAX_DEPTH = 64


class Obj(list):
    """Ordered (name, value) members; names may repeat."""


@dataclass
class Stmt:
    """kind: assignment (path, expr, then value), block (name, label, children) or include (target)."""

    kind: str
    path: list[str] = field(default_factory=list)
    expr: object = None
    value: object = None
    name: str = ""
    label: bytes | None = None
    target: bytes = b""
    children: list[Stmt] = field(default_factory=list)


def type_name(v) -> str:
    for t, n in ((type(None), "null"), (bool, "bool"), (int, "int"), (float, "float"), (bytes, "string"), (Obj, "object"), (list, "array")):
        if isinstance(v, t):
            return n
    raise TypeError(type(v))


# -- tokens ------------------------------------------------------------------------------------

_TOKEN = re.compile(
    rb"""(?P<skip>[ \t\r\n\f\v]+|\#[^\n]*|//[^\n]*|/\*.*?\*/)
    |(?P<open>/\*)
    |(?P<name>[A-Za-z_][A-Za-z0-9_]*)
    |(?P<hex>0[xX][0-9a-fA-F]*)
    |(?P<float>[0-9]+(?:\.[0-9]+(?:[eE][+-]?[0-9]+)?|[eE][+-]?[0-9]+))
    |(?P<int>[0-9]+)
    |(?P<str>")
    |(?P<op>&&|\|\||==|!=|<=|>=|<<|>>|[-+*/%<>!~&|^?:;=,.(){}\[\]])""",
    re.X | re.S,
)
_ESCAPES = {b"n": b"\n", b"t": b"\t", b"r": b"\r", b"0": b"\0", b"\\": b"\\", b'"': b'"'}
_ESCAPE = re.compile(rb'\\(?:([ntr0\\"])|x([0-9a-fA-F]{2})|u\{([0-9a-fA-F]{1,6})\})')


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """(the bytes of the literal whose opening quote is at at, where it ends)."""
    out, i = bytearray(), at + 1
    while True:
        stop = re.compile(rb'["\\\n]').search(data, i)
        if not stop or stop[0] == b"\n":
            raise WireError("BadType", stop.start() if stop else at, "unterminated string")
        out += data[i : stop.start()]
        if stop[0] == b'"':
            return bytes(out), stop.end()
        e = _ESCAPE.match(data, stop.start())
        if not e:
            raise WireError("BadType", stop.start(), "bad escape")
        if e[1]:
            out += _ESCAPES[e[1]]
        elif e[2]:
            out.append(int(e[2], 16))
        else:
            cp = int(e[3], 16)
            if cp > 0x10FFFF or 0xD800 <= cp <= 0xDFFF:
                raise WireError("BadType", stop.start(), "no code point")
            out += chr(cp).encode()
        i = e.end()


def tokens(data: bytes) -> list[tuple[str, object, int]]:
    """(kind, value, offset): name, int, float, str, op or end; operators and the keywords are their own value."""
    out, at = [], 0
    while at < len(data):
        m = _TOKEN.match(data, at)
        kind = m and m.lastgroup
        if kind in (None, "open"):
            raise WireError("BadType", at, "unterminated comment" if kind else f"unexpected byte {data[at]:#x}")
        text, start, at = m[0], at, m.end()
        if kind == "str":
            value, at = _string(data, start)
            out.append(("str", value, start))
        elif kind == "hex":
            if len(text) == 2:
                raise WireError("BadType", start, "hex literal without digits")
            out.append(("int", signed(int(text, 16)), start))
        elif kind == "int":
            if len(text.lstrip(b"0")) > 19 or int(text) > 2**63 - 1:
                raise WireError("BadLength", start, "number out of range")
            out.append(("int", int(text), start))
        elif kind == "float":
            v = float(text)
            if v == float("inf") or (0 < v < 2.2250738585072014e-308) or (v == 0 and re.search(rb"[1-9]", re.split(rb"[eE]", text)[0])):
                raise WireError("BadLength", start, "number out of range")
            out.append(("float", v, start))
        elif kind != "skip":
            out.append((kind, text.decode(), start))
    return [*out, ("end", "", len(data))]


#: What kinds of tokens are called; keywords and operators are called by their text, in single quotes.
TOKEN_NAMES = {"end": "end of input", "name": "identifier", "int": "integer", "float": "float", "str": "string"}
KEYWORDS = ("true", "false", "null", "include")


def token_name(kind: str, value) -> str:
    """What messages call a token."""
    return f"'{value}'" if kind == "op" or (kind == "name" and value in KEYWORDS) else TOKEN_NAMES[kind]


def token_text(value) -> str:
    """A token's value as text; strings in their quoted form."""
    return f'"{quote_escape(value)}"' if isinstance(value, bytes) else str(value)


# -- values ------------------------------------------------------------------------------------


def is_number(v) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def _is_int(v) -> bool:
    return isinstance(v, int) and not isinstance(v, bool)


def order(a, b) -> int:
    """-1, 0 or 1; NaN is equal to every number."""
    if not (_is_int(a) and _is_int(b)) and is_number(a):
        a, b = float(a), float(b)
    return (a > b) - (a < b)


def equal(a, b) -> bool:
    if is_number(a) and is_number(b):
        return order(a, b) == 0
    if type_name(a) != type_name(b):
        return False
    if isinstance(a, Obj):
        return len(a) == len(b) and all(k == n and equal(v, w) for (k, v), (n, w) in zip(a, b, strict=True))
    if isinstance(a, list):
        return len(a) == len(b) and all(map(equal, a, b))
    return a == b


def joined(v) -> bytes:
    """What + puts into a string."""
    if isinstance(v, bytes):
        return v
    return b"" if isinstance(v, list) else render_scalar(v).encode()


def _arith(op: str, a, b, at: int):
    if op == "+" and (isinstance(a, bytes) or isinstance(b, bytes)):
        return joined(a) + joined(b)
    if not (is_number(a) and is_number(b)):
        raise WireError("BadType", at, f"{op} wants numbers")
    whole = _is_int(a) and _is_int(b)
    if op in "+-*":
        if whole:
            return signed(a + b if op == "+" else a - b if op == "-" else a * b)
        x, y = float(a), float(b)
        return x + y if op == "+" else x - y if op == "-" else x * y
    if b == 0:
        raise WireError("StateViolation", at, "division by zero")
    if not whole:
        if op == "%":
            raise WireError("BadType", at, "% wants integers")
        return float(a) / float(b)
    q = abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
    return signed(q) if op == "/" else a - q * b


def _bitwise(op: str, a, b, at: int):
    if not (_is_int(a) and _is_int(b)):
        raise WireError("BadType", at, f"{op} wants integers")
    if op in ("<<", ">>"):
        if not 0 <= b <= 63:
            raise WireError("StateViolation", at, "shift out of range")
        return signed((a & U64) << b) if op == "<<" else a >> b
    return a & b if op == "&" else a | b if op == "|" else a ^ b


def _compare(op: str, a, b, at: int) -> bool:
    if not (is_number(a) and is_number(b) or isinstance(a, bytes) and isinstance(b, bytes)):
        raise WireError("BadType", at, f"{op} wants two numbers or two strings")
    c = order(a, b)
    return {"<": c < 0, "<=": c <= 0, ">": c > 0, ">=": c >= 0}[op]


def _binary(op: str, a, b, at: int):
    if op in ("==", "!="):
        return equal(a, b) == (op == "==")
    if op in ("<", "<=", ">", ">="):
        return _compare(op, a, b, at)
    return _arith(op, a, b, at) if op in "+-*/%" else _bitwise(op, a, b, at)


#: Binary operators from the loosest to the tightest; all associate to the left.
LEVELS = (("||",), ("&&",), ("|",), ("^",), ("&",), ("==", "!="), ("<", "<=", ">", ">="), ("<<", ">>"), ("+", "-"), ("*", "/", "%"))
PRECEDENCE = {op: i for i, ops in enumerate(LEVELS) for op in ops}


class Scope(dict):
    def __init__(self, outer: Scope | None = None):
        super().__init__()
        self.outer = outer

    def find(self, name: str, at: int):
        s = self
        while s is not None:
            if name in s:
                return s[name]
            s = s.outer
        raise WireError("StateViolation", at, f"unknown name {name}")


def _deep(depth: int, at: int) -> None:
    if depth > MAX_DEPTH:
        raise WireError("DepthExceeded", at, "nesting")


def _node(at: int, run):
    """An expression: a function of scope and depth, guarded by the depth limit."""

    def go(scope, depth):
        _deep(depth, at)
        return run(scope, depth + 1)

    return go


# -- grammar -----------------------------------------------------------------------------------


class Parser:
    def __init__(self, data: bytes):
        self.toks, self.i = tokens(data), 0

    @property
    def at(self) -> int:
        return self.toks[self.i][2]

    def next_is(self, kind: str, value: str | None = None) -> bool:
        k, v, _ = self.toks[self.i]
        return k == kind and (value is None or v == value)

    def take(self):
        self.i += 1
        return self.toks[self.i - 1][1]

    def accept(self, op: str) -> bool:
        if self.next_is("op", op):
            self.i += 1
            return True
        return False

    def want(self, kind: str, value: str | None = None):
        if not self.next_is(kind, value) or (kind == "name" and self.toks[self.i][1] in KEYWORDS):
            raise WireError("BadType", self.at, f"expected {value or kind}")
        return self.take()

    def document(self) -> list[Stmt]:
        return self.statements(1, None)

    def statements(self, depth: int, closing: str | None) -> list[Stmt]:
        out = []
        while not (self.next_is("end") if closing is None else self.next_is("op", closing)):
            if self.next_is("end"):
                raise WireError("BadType", self.at, "unterminated block")
            if not self.accept(";"):
                out.append(self.statement(depth))
        return out

    def statement(self, depth: int) -> Stmt:
        _deep(depth, self.at)
        if self.next_is("name", "include"):
            self.take()
            target = self.want("str")
            self.want("op", ";")
            return Stmt("include", target=target)
        name = self.want("name")
        if self.next_is("str") or self.next_is("op", "{"):
            label = self.take() if self.next_is("str") else None
            self.want("op", "{")
            block = Stmt("block", name=name, label=label, children=self.statements(depth + 1, "}"))
            self.want("op", "}")
            return block
        path = [name]
        while self.accept("."):
            path.append(self.want("name"))
        self.want("op", "=")
        expr = self.expression(1)
        self.want("op", ";")
        return Stmt("assignment", path=path, expr=expr)

    def expression(self, depth: int):
        _deep(depth, self.at)
        test, at = self.binary(0, depth), self.at
        if not self.accept("?"):
            return test
        then = self.expression(depth + 1)
        self.want("op", ":")
        other = self.expression(depth + 1)
        return _node(at, lambda s, d: (then if truthy(test(s, d)) else other)(s, d))

    def binary(self, least: int, depth: int):
        _deep(depth, self.at)
        left = self.unary(depth + 1)
        while (kind := self.toks[self.i])[0] == "op" and PRECEDENCE.get(kind[1], -1) >= least:
            op, at = self.take(), kind[2]
            left = self.combined(op, at, left, self.binary(PRECEDENCE[op] + 1, depth + 1))
        return left

    @staticmethod
    def combined(op: str, at: int, a, b):
        if op == "&&":
            return _node(at, lambda s, d: truthy(a(s, d)) and truthy(b(s, d)))
        if op == "||":
            return _node(at, lambda s, d: truthy(a(s, d)) or truthy(b(s, d)))
        return _node(at, lambda s, d: _binary(op, a(s, d), b(s, d), at))

    def unary(self, depth: int):
        _deep(depth, self.at)
        at = self.at
        for op in "-!~":
            if self.accept(op):
                inner = self.unary(depth + 1)

                def run(s, d, op=op):
                    v = inner(s, d)
                    if op == "!":
                        return not truthy(v)
                    if not (_is_int(v) or op == "-" and is_number(v)):
                        raise WireError("BadType", at, f"unary {op}")
                    return ~v if op == "~" else signed(-v) if _is_int(v) else -v

                return _node(at, run)
        return self.primary(depth)

    def primary(self, depth: int):
        _deep(depth, self.at)
        kind, value, at = self.toks[self.i]
        if kind in ("int", "float", "str"):
            self.take()
            return _node(at, lambda s, d: value)
        if kind == "name" and value != "include":
            self.take()
            if value in ("true", "false", "null"):
                return _node(at, lambda s, d: {"true": True, "false": False, "null": None}[value])
            return _node(at, lambda s, d: s.find(value, at))
        if self.accept("("):
            inner = self.expression(depth + 1)
            self.want("op", ")")
            return inner
        if self.accept("["):
            items = []
            while not self.next_is("op", "]"):
                items.append(self.expression(depth + 1))
                if not self.accept(","):
                    break
            self.want("op", "]")
            return _node(at, lambda s, d: [e(s, d) for e in items])
        if self.accept("{"):
            members = []
            while not self.next_is("op", "}"):
                if self.accept(";"):
                    continue
                name = self.want("name")
                self.want("op", "=")
                members.append((name, self.expression(depth + 1)))
                self.want("op", ";")
            self.want("op", "}")
            return _node(at, lambda s, d: Obj((n, e(s, d)) for n, e in members))
        raise WireError("BadType", at, "expected an expression")


def truthy(v) -> bool:
    return bool(v)


def _evaluate(stmts: list[Stmt], scope: Scope) -> None:
    for s in stmts:
        if s.kind == "assignment":
            s.value = scope[s.path[-1]] = s.expr(scope, 1)
        elif s.kind == "block":
            _evaluate(s.children, Scope(scope))


def parse(data: bytes) -> list[Stmt]:
    """The evaluated document. Includes are data; nothing is opened."""
    doc = Parser(data).document()
    _evaluate(doc, Scope())
    return doc


# -- queries and rules -------------------------------------------------------------------------

MISSING = object()


def steps(path: str) -> list[str | int] | None:
    """The steps of a.b[2].c, or None if the path is not well formed."""
    out, i = [], 0
    while i < len(path):
        if path[i] == ".":
            i += 1
            if not out or i >= len(path):
                return None
        if path[i] == "[":
            m = re.compile(r"\[([0-9]+)\]").match(path, i)
            if not out or not m:
                return None
            out.append(int(m[1]))
        else:
            m = re.compile(r"[^.\[]+").match(path, i)
            if not m:
                return None
            out.append(m[0])
        i = m.end()
    return out


def _into(v, rest):
    for s in rest:
        if isinstance(s, int):
            if isinstance(v, Obj) or not isinstance(v, list) or s >= len(v):
                return MISSING
            v = v[s]
        else:
            v = next((w for n, w in v if n == s), MISSING) if isinstance(v, Obj) else MISSING
        if v is MISSING:
            return MISSING
    return v


def _resolve(stmts: list[Stmt], rest):
    if not rest or isinstance(rest[0], int):
        return MISSING
    for s in stmts:
        if s.kind == "block" and s.name == rest[0] and (v := _resolve(s.children, rest[1:])) is not MISSING:
            return v
    first = next((s for s in stmts if s.kind == "assignment" and rest[: len(s.path)] == s.path), None)
    return MISSING if first is None else _into(first.value, rest[len(first.path) :])


def query(doc: list[Stmt], path: str):
    """The value at a path, or MISSING. Blocks of a name are tried in order before assignments; labels do not matter."""
    s = steps(path)
    return _resolve(doc, s) if s else MISSING


def convert(v, kind: str, fallback=None):
    """v as kind; int and float convert to each other, anything else that differs is fallback, as is a float beyond 64 bits."""
    if v is MISSING:
        return fallback
    if kind == "int" and isinstance(v, float):
        return int(v) if -(2.0**63) <= v < 2.0**63 else fallback
    if kind == "float" and _is_int(v):
        return float(v)
    return v if type_name(v) == kind else fallback


@dataclass
class Rule:
    path: str
    type: str
    required: bool = False
    low: float | None = None
    high: float | None = None
    allowed: tuple[bytes, ...] = ()


def check(doc: list[Stmt], rules: list[Rule]) -> list[tuple[str, str]]:
    """(kind, path) of every violation, rule by rule."""
    out = []
    for r in rules:
        v = query(doc, r.path)
        if v is MISSING:
            if r.required:
                out.append(("missing-required", r.path))
            continue
        kind = type_name(v)
        if kind != r.type and (r.type, kind) != ("float", "int"):
            out.append(("type-mismatch", r.path))
            continue
        if is_number(v) and r.low is not None and float(v) < r.low:
            out.append(("below-minimum", r.path))
        if is_number(v) and r.high is not None and float(v) > r.high:
            out.append(("above-maximum", r.path))
        if isinstance(v, bytes) and r.allowed and v not in r.allowed:
            out.append(("not-allowed", r.path))
    return out


# -- text --------------------------------------------------------------------------------------


def render_scalar(v) -> str:
    if isinstance(v, bytes):
        return f'"{quote_escape(v)}"'
    if isinstance(v, float):
        return f"{v:f}"
    if isinstance(v, list):
        return "{}" if isinstance(v, Obj) else "[]"
    return {None: "null", True: "true", False: "false"}[v] if v is None or isinstance(v, bool) else str(v)


def flatten_value(prefix: str, v):
    if isinstance(v, Obj) and v:
        for n, w in v:
            yield from flatten_value(f"{prefix}.{n}" if prefix else n, w)
    elif isinstance(v, list) and not isinstance(v, Obj) and v:
        for k, w in enumerate(v):
            yield from flatten_value(f"{prefix}[{k}]", w)
    else:
        yield prefix, render_scalar(v)


def flatten(doc: list[Stmt], prefix: str = ""):
    """(path, text) of every leaf, in order."""
    under = lambda leaf: f"{prefix}.{leaf}" if prefix else leaf
    for s in doc:
        if s.kind == "assignment":
            yield from flatten_value(under(".".join(s.path)), s.value)
        elif s.kind == "include":
            yield under("include"), s.target.decode("utf-8", "replace")
        else:
            yield from flatten(s.children, under(s.name + (f"[{s.label.decode('utf-8', 'replace')}]" if s.label is not None else "")))


def serialize_value(v, indent: int = 2, inline: int = 4, depth: int = 0) -> str:
    if not isinstance(v, list) or not v:
        return render_scalar(v)
    is_obj = isinstance(v, Obj)
    deeper = depth + (len(v) > inline)
    items = [(f"{n} = " if is_obj else "", serialize_value(w, indent, inline, deeper)) for n, w in (v if is_obj else ((None, w) for w in v))]
    if len(v) <= inline:
        return "{ " + " ".join(f"{n}{t};" for n, t in items) + " }" if is_obj else "[" + ", ".join(t for _, t in items) + "]"
    pad, end = " " * indent * (depth + 1), ";" if is_obj else ","
    body = "".join(f"{pad}{n}{t}{end}\n" for n, t in items)
    return ("{" if is_obj else "[") + "\n" + body + " " * indent * depth + ("}" if is_obj else "]")


def serialize(doc: list[Stmt], indent: int = 2, inline: int = 4, depth: int = 0) -> str:
    """Canonical source, which parses to the same document."""
    pad, out = " " * indent * depth, []
    for s in doc:
        if s.kind == "assignment":
            out.append(f"{pad}{'.'.join(s.path)} = {serialize_value(s.value, indent, inline, depth)};\n")
        elif s.kind == "include":
            out.append(f'{pad}include "{quote_escape(s.target)}";\n')
        else:
            head = s.name + (f' "{quote_escape(s.label)}"' if s.label is not None else "")
            body = serialize(s.children, indent, inline, depth + 1)
            out.append(f"{pad}{head} {{\n{body}{pad}}}\n" if s.children else f"{pad}{head} {{}}\n")
    return "".join(out)


def summarize(doc: list[Stmt]) -> str:
    def value(v):
        if isinstance(v, Obj):
            return "{" + ", ".join(f"{n} = {value(w)}" for n, w in v) + "}"
        if isinstance(v, list):
            return "[" + ", ".join(map(value, v)) + "]"
        return f'"{escape(v)}"' if isinstance(v, bytes) else render_scalar(v)

    def lines(stmts, depth):
        pad = "  " * depth
        for s in stmts:
            if s.kind == "assignment":
                yield f"{pad}{'.'.join(s.path)} = {value(s.value)}\n"
            elif s.kind == "include":
                yield f'{pad}include "{escape(s.target)}"\n'
            else:
                yield pad + s.name + (f' "{escape(s.label)}"' if s.label is not None else "") + " {\n"
                yield from lines(s.children, depth + 1)
                yield pad + "}\n"

    return f"cfgscript document: {len(doc)} top-level node{'' if len(doc) == 1 else 's'}\n" + "".join(lines(doc, 0))
