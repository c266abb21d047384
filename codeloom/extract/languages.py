"""Definitions, calls and imports of the languages with braces."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from .scan import NAME, Source


@dataclass
class Definition:
    name: str
    kind: str
    begin: int
    end: int
    body: int | None = None
    scope: tuple[str, ...] = ()
    role: str = "definition"
    qualified_name: str = ""
    cyclomatic: int | None = None
    cognitive: int | None = None
    max_nesting: int | None = None
    loc: int | None = None


@dataclass
class Language:
    lexer: str
    branches: str
    nesting: str
    #: Words before a parenthesis that are no calls.
    reserved: frozenset = field(default_factory=frozenset)


_COMMON = "if for while switch catch return function typeof await new delete throw case in of do else try instanceof void yield sizeof super"
LANGUAGES = {
    "javascript": Language("script", r"\b(?:if|case|default(?=\s*:)|while|do|for|catch)\b|(?<![?.])\?(?![?.:])(?=[^;{}]*?:)", r"\b(?:if|switch|while|do|for|catch)\b", frozenset(_COMMON.split()) | {"async"}),
    "go": Language("go", r"\b(?:if|for|case|default(?=\s*:)|select)\b", r"\b(?:if|for|switch|select)\b", frozenset("if for switch select func return go defer range make_ interface struct map chan case type var const import".split())),
    "java": Language("brace", r"\b(?:if|while|do|for|case|default(?=\s*(?::|->))|catch)\b|\?(?=[^;{}<>]*?:)", r"\b(?:if|while|do|for|switch|catch)\b", frozenset(_COMMON.split()) | {"synchronized", "this", "assert"}),
    "rust": Language("rust", r"\b(?:if|while|for(?!\s*<)|loop)\b|=>", r"\b(?:if|while|for(?!\s*<)|loop|match)\b", frozenset("if while for loop match fn return let move unsafe impl where in as pub use mod Some_ ref mut".split())),
    "c": Language("brace", r"\b(?:if|while|do|for|case|catch)\b|\?(?=[^;{}]*?:)", r"\b(?:if|while|do|for|switch|catch|try)\b", frozenset(_COMMON.split()) | {"decltype", "alignof", "static_assert", "defined", "operator", "noexcept", "static_cast", "dynamic_cast", "const_cast", "reinterpret_cast", "__attribute__"}),
    "csharp": Language("csharp", r"\b(?:if|while|do|for|foreach|case|default(?=\s*:)|catch)\b|(?<!\?)\?(?![?.\[])(?=[^;{}<>]*?:)", r"\b(?:if|while|do|for|foreach|switch|catch|try)\b", frozenset(_COMMON.split()) | {"foreach", "using", "lock", "nameof", "base", "this", "when", "fixed", "checked"}),
}
LANGUAGES["typescript"], LANGUAGES["cpp"] = LANGUAGES["javascript"], LANGUAGES["c"]
MODIFIERS = r"(?:(?:public|private|protected|internal|static|async|readonly|override|virtual|sealed|partial|extern|unsafe|get|set|abstract|final|synchronized|native|default|strictfp|declare|export|new)\s+)*"


def _body_after(src: Source, at: int) -> int | None:
    """The brace that opens a body after a parameter list that ends at a place; none if a statement ends before."""
    while at < len(src.code):
        c = src.code[at]
        if c == "{":
            return at
        if c in ";=})" or src.code.startswith("=>", at):
            return None
        at = src.close(at) or at + 1 if c in "([" else at + 1
    return None


def _span_to(src: Source, begin: int, brace: int) -> int:
    return src.close(brace) or len(src.code)


def _classes(src: Source, pattern: str, kinds: dict[str, str]) -> Iterator[Definition]:
    for m in re.finditer(pattern, src.code):
        at = m.end()
        while at < len(src.code) and src.code[at] not in "{;(":
            at += 1
        kind = kinds.get(m["kind"], m["kind"])
        if src.code[at : at + 1] == "(":  # record header
            after = src.skip(src.close(at) or at + 1)
            while after < len(src.code) and src.code[after] not in "{;":
                after += 1
            at = after
        if src.code[at : at + 1] == "{":
            yield Definition(m["name"], kind, m.start(), _span_to(src, m.start(), at), at)
        elif src.code[at : at + 1] == ";" and m["kind"] in ("record", "struct"):
            yield Definition(m["name"], kind, m.start(), at + 1)


def _script(src: Source) -> Iterator[Definition]:
    code = src.code
    classes = list(_classes(src, rf"(?:\babstract\s+)?\b(?P<kind>class|interface)\s+(?P<name>{NAME})", {}))
    yield from classes
    for m in re.finditer(rf"\btype\s+({NAME})\s*(?:<[^=;{{]*>)?\s*=(?!=)", code):
        yield Definition(m[1], "type", m.start(), src.statement_end(m.end()))
    for m in re.finditer(rf"(?:\basync\s+)?\bfunction\s*\*?\s*({NAME})\s*(?=[(<])", code):
        open_ = code.find("(", m.end())
        body = _body_after(src, src.close(open_) or m.end()) if open_ >= 0 else None
        if body is not None:
            yield Definition(m[1], "function", m.start(), _span_to(src, m.start(), body), body)
    for m in re.finditer(rf"(?<![\w$.])({NAME})\s*(?::[^=;(){{}}]+)?=\s*(?=(?:async\b\s*)?(?:function\b|\(|{NAME}\s*=>|<))", code):
        before = code[max(0, m.start() - 40) : m.start()]
        if not re.search(r"\b(?:const|let|var)\s+$|,\s*$", before):
            continue
        at = src.skip(m.end())
        word = re.compile(r"async\b\s*").match(code, at)
        at = word.end() if word else at
        if code.startswith("function", at):
            open_ = code.find("(", at)
            body = _body_after(src, src.close(open_) or at) if open_ >= 0 else None
            if body is not None:
                yield Definition(m[1], "function", m.start(), _span_to(src, m.start(), body), body)
            continue
        if code[at : at + 1] == "(":
            after = src.close(at)
            arrow = re.compile(r"\s*(?::[^=;{}]*?)?=>\s*").match(code, after) if after else None
        else:
            arrow = re.compile(rf"(?:<[^>]*>\s*\([^)]*\)[^=]*|{NAME}\s*)=>\s*").match(code, at)
        if arrow:
            body = arrow.end()
            block = code[body : body + 1] == "{"
            yield Definition(m[1], "function", m.start(), _span_to(src, m.start(), body) if block else src.statement_end(body) - 1, body if block else None)
    bodies = {d.body for d in classes}
    for m in re.finditer(rf"(?<![\w$.])((?:(?:public|private|protected|static|async|readonly|override|get|set|abstract)\s+|\*\s*)*)(#?{NAME})\s*(?:<[^<>(){{}}]*>)?\(", code):
        if m[2] in LANGUAGES["javascript"].reserved:
            continue
        open_ = m.end() - 1
        body = _body_after(src, src.close(open_) or open_ + 1)
        if body is None or re.search(r"\b(?:function|new)\s*\*?\s*$", code[max(0, m.start() - 12) : m.start()]):
            continue
        outer = src.encloser(m.start())
        literal = outer is not None and re.search(r"[=(,:\[?]\s*$|\breturn\s*$", code[max(0, outer - 12) : outer]) is not None
        first = re.search(r"[{};,]\s*$|\)\s*$", code[: m.start()][-80:]) is not None
        if outer is not None and (outer in bodies or literal) and first:
            yield Definition(m[2], "constructor" if m[2] == "constructor" and outer in bodies else "method", m.start(), _span_to(src, m.start(), body), body)


def _go(src: Source) -> Iterator[Definition]:
    for m in re.finditer(r"(?m)^func\s+(\([^)]*\)\s*)?(\w+)\s*(?:\[[^\]]*\])?\(", src.code):
        at = src.close(m.end() - 1) or m.end()
        line_end = src.code.find("\n", at)
        brace = src.code.find("{", at)
        while 0 <= brace and re.search(r"(?:interface|struct)\s*$", src.code[at:brace]):
            brace = src.code.find("{", src.close(brace) or brace + 1)
        body = brace if 0 <= brace and (line_end < 0 or brace < line_end) else None
        yield Definition(m[2], "method" if m[1] else "function", m.start(), src.close(body) if body is not None and src.close(body) else (line_end if line_end >= 0 else len(src.code)), body)
    for m in re.finditer(r"(?m)^(?:type[ \t]+|[ \t]+)(\w+)[ \t]+(?:\[[^\]\n]+\]\s*)?(struct|interface|[\w.*\[\]]+|func|map)", src.code):
        grouped = not src.code[m.start() :].startswith("type")
        if grouped:
            outer = max((i for i, j in src.pair.items() if i < m.start(1) < j), default=None)
            if outer is None or not re.search(r"\btype\s*$", src.code[max(0, outer - 8) : outer]):
                continue
        kind = {"struct": "struct", "interface": "interface"}.get(m[2], "type")
        brace = src.skip(m.end())
        end = src.close(brace) if kind != "type" and src.code[brace : brace + 1] == "{" else src.code.find("\n", m.end())
        yield Definition(m[1], kind, m.start() if not grouped else m.start(1), end if end and end > 0 else len(src.code), brace if kind != "type" else None)


def _java(src: Source) -> Iterator[Definition]:
    classes = list(_classes(src, rf"(?:@\w+(?:\([^()]*\))?\s+)*{MODIFIERS}(?<!@)\b(?P<kind>class|interface|enum)\s+(?P<name>{NAME})", {}))
    yield from classes
    names = {d.name for d in classes}
    for m in re.finditer(rf"(?<![\w$.@])((?:@\w+(?:\([^)]*\))?\s+)*{MODIFIERS}(?:<[^<>(){{}};]*>\s*)?)((?:{NAME}(?:\.{NAME})*(?:<[^;(){{}}]*>)?(?:\[\])*\s+)?)({NAME})\s*\(", src.code):
        if m[3] in LANGUAGES["java"].reserved or (m[2] and m[2].split()[0] in ("return", "new", "throw", "else", "case", "assert")):
            continue
        after = src.close(m.end() - 1) or m.end()
        body = _body_after(src, after)
        outer = src.encloser(m.start(3))
        if outer not in {d.body for d in classes}:
            continue
        if not m[2]:
            if m[3] in names and body is not None:
                yield Definition(m[3], "constructor", m.start(), _span_to(src, m.start(), body), body)
        elif body is not None:
            yield Definition(m[3], "method", m.start(), _span_to(src, m.start(), body), body)
        elif src.code[src.skip(after) : src.skip(after) + 1] == ";" or "throws" in src.code[after : after + 60]:
            yield Definition(m[3], "method", m.start(), src.statement_end(after))


def _rust(src: Source) -> Iterator[Definition]:
    for m in re.finditer(r"(?<![\w])(?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|extern(?:\s*\"\s*\")?)\s+)*fn\s+(\w+)", src.code):
        open_ = src.code.find("(", m.end())
        after = src.close(open_) if open_ >= 0 else None
        body = _body_after(src, after) if after else None
        if body is not None:
            yield Definition(m[1], "function", m.start(), _span_to(src, m.start(), body), body)
    for m in re.finditer(r"(?<![\w])(?:pub(?:\([^)]*\))?\s+)?(struct|enum|trait|type)\s+(\w+)", src.code):
        at = m.end()
        while at < len(src.code) and src.code[at] not in "{;":
            at = src.close(at) or at + 1 if src.code[at] == "(" else at + 1
        if m[1] == "type" and src.code[at : at + 1] != ";":
            continue
        kind = {"trait": "interface"}.get(m[1], m[1])
        end = src.close(at) if src.code[at : at + 1] == "{" else at + 1
        yield Definition(m[2], kind, m.start(), end or len(src.code), at if src.code[at : at + 1] == "{" else None)


def rust_scopes(src: Source) -> list[tuple[int, int, str]]:
    """(begin, end, type name) of impl blocks: they name what is inside, without being definitions."""
    out = []
    for m in re.finditer(r"\bimpl\b\s*(?:<[^{;]*?>\s*)?(?:[\w:<>,\s&'+]+?\s+for\s+)?&?(?:\w+::)*(\w+)", src.code):
        brace = src.code.find("{", m.end())
        if brace >= 0 and src.close(brace):
            out.append((m.start(), src.close(brace), m[1]))
    return out


def _family_c(src: Source) -> Iterator[Definition]:
    for m in re.finditer(r"\b(?P<kind>class|struct|union|enum(?:\s+(?:class|struct))?)\s+(?:\w+\s+)??(?P<name>[A-Za-z_]\w*)\s*(?:final\b\s*)?(?=[:{])(?!::)", src.code):
        brace = src.code.find("{", m.end())
        if brace >= 0 and ";" not in src.code[m.end() : brace] and "(" not in src.code[m.end() : brace] and src.close(brace):
            kind = "enum" if m["kind"].startswith("enum") else "struct" if m["kind"] in ("struct", "union") else "class"
            yield Definition(m["name"], kind, m.start(), src.close(brace), brace)
    bodies = {i for i, _ in src.braces if re.search(r"\b(?:class|struct|union)\b[^;{}()]*$", src.code[max(0, i - 200) : i])}
    spaces = {i for i, _ in src.braces if re.search(r"\b(?:namespace\b[^;{}()]*|extern\s*\"\s*\"\s*)$", src.code[max(0, i - 200) : i])}
    for m in re.finditer(r"(?<![\w.>])((?:[A-Za-z_]\w*(?:<[^;(){}]*?>)?::)*)(~?[A-Za-z_]\w*|operator\s*[^\s\w(]{1,3})\s*\(", src.code):
        if m[2] in LANGUAGES["c"].reserved or src.code[max(0, m.start() - 1) : m.start()] in ("#",):
            continue
        outer = src.encloser(m.start())
        if outer is not None and outer not in bodies and outer not in spaces:
            continue
        after = src.close(m.end() - 1)
        if after is None:
            continue
        begin = max(src.code.rfind(c, 0, m.start()) for c in ";{}") + 1
        labels = list(re.finditer(r"(?m)^\s*#.*$|\b(?:public|private|protected)\s*:(?!:)", src.code[begin : m.start()]))
        begin += labels[-1].end() if labels else 0
        head = src.code[begin : m.start()].strip()
        if re.search(r"[=(,]|\breturn\b|\busing\b|\btypedef\b", head) or (not head and not m[1] and outer not in bodies):
            continue
        tail = re.compile(r"\s*(?:(?:const|noexcept|override|final|volatile|&&?)\b\s*|->\s*[\w:<>*&\s]+|:\s*(?=\w)[^;{]*)*").match(src.code, after)
        at = tail.end() if tail else after
        begin = src.skip(begin)
        if src.code[at : at + 1] == "{" and src.close(at):
            scope = tuple(re.sub(r"<.*?>", "", x) for x in m[1].split("::") if x)
            yield Definition(m[2], "function", begin, src.close(at), at, scope)
        elif src.code[at : at + 1] in (";", "=") and head:
            yield Definition(m[2], "method" if outer in bodies else "function", begin, src.statement_end(at), None, (), "declaration")
    for m in re.finditer(r"\busing\s+(\w+)\s*=[^;]*;|\btypedef\b[^;{}]*?(\w+)\s*;", src.code):
        yield Definition(m[1] or m[2], "type", m.start(), m.end())


def _csharp(src: Source) -> Iterator[Definition]:
    kinds = {"record": "class"}
    classes = list(_classes(src, rf"{MODIFIERS}\b(?P<kind>class|interface|struct|enum|record)\s+(?P<name>{NAME})", kinds))
    yield from classes
    names, bodies = {d.name for d in classes}, {d.body for d in classes}
    for m in re.finditer(rf"{MODIFIERS}\bdelegate\s+[\w<>\[\],.?\s]+?\s({NAME})\s*\(", src.code):
        yield Definition(m[1], "type", m.start(), src.statement_end(m.end() - 1))
    for m in re.finditer(rf"(?<![\w$.])({MODIFIERS})((?:[\w.]+(?:<[^;(){{}}]*>)?(?:\[,*\])*\??\s+)?)({NAME})\s*(?:<[\w,\s]+>)?\s*\(", src.code):
        if m[3] in LANGUAGES["csharp"].reserved or (m[2] and m[2].split()[0] in ("return", "new", "throw", "else", "await", "case", "delegate")):
            continue
        outer = src.encloser(m.start(3))
        if outer not in bodies:
            continue
        after = src.close(m.end() - 1) or m.end()
        body = _body_after(src, after)
        arrow = re.compile(r"\s*(?:where[^{;=]*)?=>").match(src.code, after)
        if not m[2]:
            if m[3] in names and (body is not None or arrow):
                yield Definition(m[3], "constructor", m.start(), _span_to(src, m.start(), body) if body is not None else src.statement_end(after), body)
        elif body is not None or arrow or src.code[src.skip(after) : src.skip(after) + 1] == ";":
            yield Definition(m[3], "method", m.start(), _span_to(src, m.start(), body) if body is not None else src.statement_end(after), body)


DEFINITIONS = {"javascript": _script, "typescript": _script, "go": _go, "java": _java, "rust": _rust, "c": _family_c, "cpp": _family_c, "csharp": _csharp}
IMPORTS = {
    "go": r"(?m)^\s*(?:import\s+)?(?:[\w.]+\s+)?(?=\")",
    "java": r"\bimport\s+(?:static\s+)?([\w.]+)(?:\.\*)?\s*;",
    "rust": r"\buse\s+([^;]+);",
    "csharp": r"(?m)^\s*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;",
}


def imports(src: Source, language: str) -> Iterator[str]:
    if language in ("javascript", "typescript"):
        for at, (_, value) in sorted(src.strings.items()):
            before = src.code[max(0, at - 400) : at]
            if re.search(r"(?:\bimport\s*|\bimport\b[^;\"]*?\bfrom\s*|\brequire\s*\(\s*)$", before):
                yield value
    elif language in ("c", "cpp"):
        for m in re.finditer(r"(?m)^\s*#\s*include\s*(?:<([^>\n]+)>|\"([^\"\n]+)\")", src.text):
            yield m[1] or m[2]
    elif language == "go":
        for m in re.finditer(r"\bimport\s*(\()?", src.code):
            end = src.close(m.start(1)) if m[1] else src.code.find("\n", m.end())
            for at, (_, value) in sorted(src.strings.items()):
                if m.end() <= at < (end if end and end > 0 else len(src.code)):
                    yield value
    else:
        for m in re.finditer(IMPORTS[language], src.code):
            yield re.sub(r"\s+", " ", m[1]).strip()


def calls(src: Source, language: str, at_definition: set[int]) -> Iterator[tuple[str, int]]:
    """(name, place) of calls, and of constructions with `new`."""
    known, generic = LANGUAGES[language], r"(?:<[\w\s,.<>\[\]?]*>)?" if language in ("csharp", "java", "typescript") else r"(?:::<[^;(){}]*>)?" if language == "rust" else ""
    for m in re.finditer(rf"(?<![\w$])({NAME})\s*{generic}\(", src.code):
        before = src.code[max(0, m.start() - 24) : m.start()]
        if (m[1] in known.reserved and not before.rstrip().endswith(".")) or m.start() in at_definition or (language == "java" and before.endswith("@")) or re.search(r"\b(?:function|fn|func|def)\s*\*?\s*$", before):
            continue
        if language == "rust" and (m[1] == "new" and before.rstrip().endswith("::") or src.code[m.end(1) : m.end(1) + 1] == "!"):
            continue
        yield m[1], m.start()


def complexity(src: Source, d: Definition, language: str) -> None:
    """Sets the sums over branches within a definition: 1 and one a branch; one and its depth a branch; the deepest."""
    lang = LANGUAGES[language]
    begin, end = d.body if d.body is not None else d.begin, d.end
    spans = []
    for m in re.finditer(lang.nesting, src.code[begin:end]):
        at = begin + m.start()
        if m.group() == "while" and src.code[:at].rstrip().endswith("}") and _tail_of_do(src, at):
            continue
        spans.append((at, src.body_end(begin + m.end(), m.group())))
    d.cyclomatic, d.cognitive, d.max_nesting = 1, 0, 0
    for m in re.finditer(lang.branches, src.code[begin:end]):
        at = begin + m.start()
        if m.group() == "while" and _tail_of_do(src, at):
            continue
        depth = sum(i < at < j for i, j in spans)
        d.cyclomatic += 1
        d.cognitive += 1 + depth
    for i, _ in spans:
        d.max_nesting = max(d.max_nesting, 1 + sum(a < i < b for a, b in spans))


def _tail_of_do(src: Source, at: int) -> bool:
    """Whether a `while` ends a `do` block."""
    end = len(src.code[:at].rstrip()) - 1
    begin = next((i for i, j in src.braces if j == end), None)
    return begin is not None and src.code[:begin].rstrip().endswith("do")


def definitions(src: Source, language: str) -> list[Definition]:
    """Definitions in order of their begins, with qualified names: of the definitions around them, of the scopes written
    out in their names, and with `#n` for the n-th further one of a name in one scope."""
    found = sorted(DEFINITIONS[language](src), key=lambda d: (d.begin, -d.end))
    scopes = [*(rust_scopes(src) if language == "rust" else [])]
    seen: dict[tuple, int] = {}
    stack: list[Definition] = []
    for d in found:
        while stack and stack[-1].end <= d.begin:
            stack.pop()
        local = ".".join((*d.scope, d.name))
        around = [n for i, j, n in scopes if i <= d.begin and d.end <= j]
        path = ([stack[-1].qualified_name] if stack else []) + around[-1:]
        key = (".".join(path), local)
        n = seen.get(key, 0)
        seen[key] = n + 1
        d.qualified_name = ".".join([*path, f"{local}#{n}" if n else local])
        d.loc = sum(1 for line in src.text[d.begin : d.end].split("\n") if line.strip())
        if d.kind in ("function", "method", "constructor") and d.role == "definition":
            complexity(src, d, language)
        stack.append(d)
    return found
