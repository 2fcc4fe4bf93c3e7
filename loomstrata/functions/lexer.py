"""A lexer for JavaScript and TypeScript, and what the extractors read off its tokens: imports, functions, routes, mounts,
classes with decorators. It knows strings, templates, comments, regular expressions and brackets, not the grammar."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*[\s\S]*?\*/|\#![^\n]*)
      | (?P<tpl>`(?:\\[\s\S]|[^`\\])*`)
      | (?P<str>"(?:\\[\s\S]|[^"\\\n])*"|'(?:\\[\s\S]|[^'\\\n])*')
      | (?P<id>[A-Za-z_$\u0080-\uffff][\w$\u0080-\uffff]*)
      | (?P<num>\d[\w.]*)
      | (?P<p>=>|\.\.\.|\?\.|[-+*%&|^<>!=/]=+|&&|\|\||\?\?|[\s\S])""",
    re.X,
)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_OPEN, _CLOSE = "([{", ")]}"

# Verbs of routes, and decorators of routes with their methods.
VERBS = ["get", "post", "put", "patch", "delete", "options", "head"]
DECORATORS = {"Get": "GET", "Post": "POST", "Put": "PUT", "Patch": "PATCH", "Delete": "DELETE", "Options": "OPTIONS", "Head": "HEAD", "All": "UNKNOWN"}
_MODIFIERS = {"public", "private", "protected", "static", "async", "readonly", "override", "get", "set", "*", "declare", "accessor"}


@dataclass
class Source:
    """Tokens (kind, text) and, for each bracket, its partner's place (-1: none)."""

    tokens: list[tuple[str, str]] = field(default_factory=list)
    partner: list[int] = field(default_factory=list)

    @classmethod
    def of(cls, text: str) -> Source:
        out, at = [], 0
        while at < len(text):
            if text[at] == "/" and (m := _REGEX.match(text, at)) and (not out or out[-1][1] in ("return", "typeof", "case", "in", "of") or (out[-1][0] == "p" and out[-1][1] not in (")", "]", "}"))):
                out.append(("re", m[0]))
                at = m.end()
                continue
            m = _TOKEN.match(text, at)
            if m.lastgroup != "skip":
                out.append((m.lastgroup, m[0]))
            at = m.end()
        partner, stack = [-1] * len(out), []
        for i, (kind, t) in enumerate(out):
            if kind == "p" and t in _OPEN:
                stack.append(i)
            elif kind == "p" and t in _CLOSE:
                while stack and _OPEN.index(out[stack[-1]][1]) != _CLOSE.index(t):
                    stack.pop()
                if stack:
                    partner[i] = stack.pop()
                    partner[partner[i]] = i
        return cls(out, partner)

    def text(self, i: int) -> str:
        return self.tokens[i][1] if 0 <= i < len(self.tokens) else ""

    def kind(self, i: int) -> str:
        return self.tokens[i][0] if 0 <= i < len(self.tokens) else ""

    def arguments(self, i: int) -> list[tuple[int, int]]:
        """Ranges of the comma-separated parts within the bracket at i."""
        end = self.partner[i]
        if end < 0:
            return []
        out, begin, k = [], i + 1, i + 1
        while k < end:
            if self.partner[k] > k:
                k = self.partner[k]
            elif self.text(k) == "," and self.kind(k) == "p":
                out.append((begin, k))
                begin = k + 1
            k += 1
        return [(a, b) for a, b in [*out, (begin, end)] if b > a]

    def string(self, part: tuple[int, int]) -> str | None:
        """The value of a part that is one plain string."""
        a, b = part
        return self.text(a)[1:-1] if b - a == 1 and self.kind(a) == "str" else None

    def name(self, part: tuple[int, int]) -> str | None:
        a, b = part
        return self.text(a) if b - a == 1 and self.kind(a) == "id" else None

    def required(self, part: tuple[int, int]) -> str | None:
        """The path of require('…'), also where its result is called."""
        a, b = part
        if self.text(a) == "require" and self.text(a + 1) == "(" and self.partner[a + 1] > 0:
            end = self.partner[a + 1]
            if end < b and (end == b - 1 or (self.text(end + 1) == "(" and self.partner[end + 1] == b - 1)):
                args = self.arguments(a + 1)
                return self.string(args[0]) if args else None
        return None


def requires(s: Source) -> list[str]:
    out = []
    for i in range(len(s.tokens)):
        if s.text(i) == "require" and s.kind(i) == "id" and s.text(i - 1) != "." and s.text(i + 1) == "(":
            args = s.arguments(i + 1)
            if args and (path := s.string(args[0])):
                out.append(path)
    return out


def imports(s: Source) -> list[str]:
    """Sources of import statements, not of re-exports or dynamic imports."""
    out = []
    for i in range(len(s.tokens)):
        if s.text(i) != "import" or s.kind(i) != "id" or s.text(i - 1) == "." or s.text(i + 1) in ("(", ".", ":"):
            continue
        k = i + 1
        while k < len(s.tokens) and s.kind(k) != "str" and s.text(k) not in (";", "=", "import"):
            k = s.partner[k] + 1 if s.partner[k] > k else k + 1
        if s.kind(k) == "str":
            out.append(s.text(k)[1:-1])
    return out


def functions(s: Source) -> list[str]:
    """Names of function declarations (no expressions, no generators)."""
    out = []
    for i in range(len(s.tokens)):
        if s.text(i) != "function" or s.kind(i) != "id" or s.kind(i + 1) != "id" or s.text(i + 2) not in ("(", "<"):
            continue
        before = i - 1 if s.text(i - 1) != "async" else i - 2
        if before < 0 or s.text(before) in (";", "}", "{", "export", "default", ")") or s.kind(before) in ("str", "num", "tpl"):
            out.append(s.text(i + 1))
    return out


def _root(s: Source, i: int) -> str | None:
    """The identifier that the member chain ending before i hangs off."""
    while True:
        if s.text(i) == ")" and s.partner[i] >= 0:
            i = s.partner[i] - 1
        elif s.kind(i) == "id" and s.text(i - 1) in (".", "?."):
            i -= 2
        else:
            return s.text(i) if s.kind(i) == "id" else None


def routes(s: Source) -> list[dict]:
    """{method, path, handler, annotation}: app.get('/x', h) and app.route('/x').get(h).post(h), for app and router."""
    out = []
    for i in range(len(s.tokens)):
        if s.text(i) in ("app", "router") and s.kind(i) == "id" and s.text(i - 1) not in (".", "?.") and s.text(i + 1) == "." and s.text(i + 2) in VERBS and s.text(i + 3) == "(":
            args = s.arguments(i + 3)
            if len(args) >= 2 and (path := s.string(args[0])):
                out.append((i, {"method": s.text(i + 2).upper(), "path": path, "handler": s.name(args[-1]), "annotation": f"{s.text(i)}.{s.text(i + 2)}"}))
        if s.text(i) == "route" and s.text(i - 1) == "." and s.text(i + 1) == "(" and s.partner[i + 1] > 0:
            args, base = s.arguments(i + 1), _root(s, i - 2)
            path = s.string(args[0]) if args else None
            if not path or base not in ("app", "router"):
                continue
            chain, k = [], s.partner[i + 1] + 1
            while s.text(k) == "." and s.text(k + 2) == "(" and s.partner[k + 2] > 0:
                if s.text(k + 1) in VERBS:
                    args = s.arguments(k + 2)
                    chain.append({"method": s.text(k + 1).upper(), "path": path, "handler": s.name(args[-1]) if args else None, "annotation": f"{base}.{s.text(k + 1)}"})
                k = s.partner[k + 2] + 1
            out += [(i, r) for r in reversed(chain)]  # the outer call of a chain comes first
    return [r for _, r in sorted(out, key=lambda x: x[0])]


def mounts(s: Source) -> list[dict]:
    """{prefix, kind, target} of app.use('/x', …): kind `require` with a path, or `own` for an identifier of this file."""
    bound = {}
    for i in range(len(s.tokens)):
        if s.text(i) in ("const", "let", "var") and s.kind(i + 1) == "id" and s.text(i + 2) == "=":
            end = i + 3
            while end < len(s.tokens) and s.text(end) not in (";", ",") and s.text(end) not in ("const", "let", "var"):
                end = s.partner[end] + 1 if s.partner[end] > end else end + 1
                if (path := s.required((i + 3, end))) is not None:
                    bound[s.text(i + 1)] = path
    out = []
    for i in range(len(s.tokens)):
        if s.text(i) in ("app", "router") and s.text(i - 1) not in (".", "?.") and s.text(i + 1) == "." and s.text(i + 2) == "use" and s.text(i + 3) == "(":
            args = s.arguments(i + 3)
            if len(args) < 2 or (prefix := s.string(args[0])) is None:
                continue
            name = s.name(args[1])
            path = s.required(args[1]) or bound.get(name or "")
            if path is not None:
                out.append({"prefix": prefix, "kind": "require", "target": path})
            elif name:
                out.append({"prefix": prefix, "kind": "own", "target": name})
    return out


def _decorators_before(s: Source, i: int) -> list[tuple[str, int]]:
    """(name, place of its bracket or -1) of the decorators that end right before i, in order."""
    out = []
    while s.text(i - 1) in ("export", "default"):
        i -= 1
    while True:
        k = i - 1
        bracket = -1
        if s.text(k) == ")" and s.partner[k] >= 0:
            bracket = s.partner[k]
            k = bracket - 1
        if s.kind(k) == "id" and s.text(k - 1) == "@":
            out.append((s.text(k), bracket))
            i = k - 1
        else:
            return out[::-1]


def _decorator_path(s: Source, found: list[tuple[str, int]], name: str) -> str | None:
    """The path of a decorator: a string, a path option, the first string of a list; '' if it has none of them; None if
    the decorator isn't there."""
    for n, bracket in found:
        if n != name or bracket < 0:
            continue
        for part in s.arguments(bracket):
            a, b = part
            if (value := s.string(part)) is not None:
                return value
            parts = [part]
            if s.text(a) == "{":
                parts = [(k + 2, e) for k, e in s.arguments(a) if s.text(k).strip("'\"") == "path" and s.text(k + 1) == ":"]
            for x, y in parts:
                if (value := s.string((x, y))) is not None:
                    return value
                if s.text(x) == "[":
                    for element in s.arguments(x):
                        if (value := s.string(element)) is not None:
                            return value
        return ""
    return None


def classes(s: Source) -> list[dict]:
    """{name, implements, prefix, methods: [{name, route_method, route_path, annotation}]} of class declarations."""
    out = []
    for i in range(len(s.tokens)):
        if s.text(i) != "class" or s.kind(i) != "id" or s.kind(i + 1) != "id" or s.text(i - 1) in (".", "abstract", "=", "(", ",", ":", "return", "new"):
            continue
        k, listed, implements = i + 2, False, []
        while k < len(s.tokens) and s.text(k) != "{":
            if s.text(k) == "implements":
                listed = True
            elif listed and s.kind(k) == "id" and s.text(k - 1) in ("implements", ",") and s.text(k + 1) in (",", "{"):
                implements.append(s.text(k))
            elif s.text(k) == "<":  # type arguments
                depth = 0
                while k < len(s.tokens):
                    depth += (s.text(k) == "<") - (s.text(k) == ">")
                    if not depth:
                        break
                    k += 1
            k += 1
        end = s.partner[k] if k < len(s.tokens) else -1
        if end < 0:
            continue
        out.append({
            "name": s.text(i + 1),
            "implements": implements,
            "prefix": _decorator_path(s, _decorators_before(s, i), "Controller"),
            "methods": _methods(s, k + 1, end),
        })
    return out


def _methods(s: Source, k: int, end: int) -> list[dict]:
    out: list[dict] = []
    pending: list[tuple[str, int]] = []
    while k < end:
        if s.text(k) == "@" and s.kind(k + 1) == "id":
            bracket = k + 2 if s.text(k + 2) == "(" else -1
            pending.append((s.text(k + 1), bracket))
            k = (s.partner[bracket] if bracket > 0 and s.partner[bracket] > 0 else k + 1) + 1
            continue
        if s.text(k) in (";", "}"):
            k += 1
            continue
        m = k
        while s.text(m) in _MODIFIERS and s.text(m + 1) not in ("(", "=", ":", ";", "<"):
            m += 1
        bracket = m + 1
        if s.text(bracket) == "<":
            while bracket < end and s.text(bracket) != "(":
                bracket += 1
        close = s.partner[bracket] if s.text(bracket) == "(" and bracket < end else -1
        body = close + 1 if close > 0 else -1
        if body > 0 and s.text(body) == ":":  # a return type, itself perhaps with brackets
            body += 1
            while body < end and s.text(body) not in (";",) and not (s.text(body) == "{" and s.text(body - 1) not in (":", "|", "&", "<", ",")):
                body = s.partner[body] + 1 if s.partner[body] > body else body + 1
        if s.kind(m) in ("id", "str") and body > 0 and s.text(body) == "{" and s.partner[body] > 0:
            if s.text(m) != "constructor":
                route = next((n for n, b in pending if n in DECORATORS and b >= 0), None)
                out.append({
                    "name": s.text(m),
                    "route_method": DECORATORS.get(route),
                    "route_path": (_decorator_path(s, [x for x in pending if x[0] == route], route) or "") if route else None,
                    "annotation": f"@{route}" if route else None,
                })
            pending, k = [], s.partner[body] + 1
            continue
        pending = []
        while k < end and s.text(k) not in (";", "@") and (k == m or s.text(k - 1) not in ("}",) or s.kind(k) == "p"):
            k = s.partner[k] + 1 if s.partner[k] > k else k + 1
    return out
