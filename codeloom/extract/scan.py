"""Source text as a scanner sees it: comments and strings blanked, brackets paired, statements delimited."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

NAME = r"[A-Za-z_$][\w$]*"
_LINE, _BLOCK = r"//[^\n]*", r"/\*.*?(?:\*/|\Z)"
_DOUBLE, _BACK = r'"(?:\\.|[^"\\\n])*"?', r"`(?:\\.|[^`\\])*`?"
_CHAR = r"'(?:\\[^\n]{1,8}?|[^'\\\n])'"
#: What is blanked, by language: comments first, then strings. A slash after an operator begins a pattern in scripts.
LEXERS = {
    "script": re.compile(rf"(?P<comment>{_LINE}|{_BLOCK})|(?P<string>{_DOUBLE}|'(?:\\.|[^'\\\n])*'?|{_BACK})|(?P<pattern>(?<=[(,=:\[!&|?{{}};\n])\s*/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*)", re.S),
    "go": re.compile(rf"(?P<comment>{_LINE}|{_BLOCK})|(?P<string>{_DOUBLE}|{_CHAR}|`[^`]*`?)", re.S),
    "rust": re.compile(rf'(?P<comment>{_LINE}|{_BLOCK})|(?P<string>b?r(?P<hash>#*)".*?"(?P=hash)|"(?:\\.|[^"\\])*"?|{_CHAR})', re.S),
    "csharp": re.compile(rf'(?P<comment>{_LINE}|{_BLOCK})|(?P<string>@\$?"(?:""|[^"])*"?|\$?{_DOUBLE}|{_CHAR})', re.S),
    "brace": re.compile(rf"(?P<comment>{_LINE}|{_BLOCK})|(?P<string>{_DOUBLE}|{_CHAR})", re.S),
}
OPEN, CLOSE = "([{", ")]}"


@dataclass
class Source:
    """Text with `code`, of the same length, in which comments and the insides of strings are blanks."""

    text: str
    lexer: str
    code: str = ""
    strings: dict[int, tuple[int, str]] = field(default_factory=dict)  # begin: (end, text between the quotes)
    pair: dict[int, int] = field(default_factory=dict)
    within: list[tuple[int, int]] = field(default_factory=list)
    lines: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        parts, at = [], 0
        for m in LEXERS[self.lexer].finditer(self.text):
            parts.append(self.text[at : m.start()])
            body = m.group()
            if m.lastgroup == "comment" or m["comment"] is not None:
                parts.append(re.sub(r"[^\n]", " ", body))
            else:
                if m["string"] is not None:
                    head = len(body) - len(body.lstrip("b@$r#"))
                    quote = body[head : head + 1]
                    self.strings[m.start()] = (m.end(), body[head + 1 : -1] if len(body) > head + 1 and body[-1] == quote else body[head + 1 :])
                parts.append('"' + re.sub(r"[^\n]", " ", body[1:-1]) + '"' if len(body) > 1 else '"')
            at = m.end()
        parts.append(self.text[at:])
        self.code = "".join(parts)
        stack: list[int] = []
        for m in re.finditer(r"[()\[\]{}]", self.code):
            c = m.group()
            if c in OPEN:
                stack.append(m.start())
            else:
                while stack and self.code[stack[-1]] != OPEN[CLOSE.index(c)]:
                    stack.pop()
                if stack:
                    self.pair[stack[-1]] = m.start()
                    stack.pop()
        self.lines = [0, *(m.end() for m in re.finditer("\n", self.text))]
        self.braces = sorted((i, j) for i, j in self.pair.items() if self.code[i] == "{")

    def line(self, at: int) -> int:
        """The line of a place, from 0."""
        return bisect_right(self.lines, at) - 1

    def skip(self, at: int) -> int:
        """The next place that is no blank."""
        while at < len(self.code) and self.code[at].isspace():
            at += 1
        return at

    def close(self, at: int) -> int | None:
        """Just after the bracket that closes the one at a place."""
        end = self.pair.get(at)
        return None if end is None else end + 1

    def encloser(self, at: int) -> int | None:
        """The innermost open brace around a place."""
        best = None
        for i, j in self.braces:
            if i >= at:
                break
            if j >= at:
                best = i
        return best

    def arguments(self, at: int) -> list[tuple[int, int]]:
        """(begin, end) of the parts between commas inside the bracket at a place."""
        end, out = self.pair.get(at), []
        if end is None:
            return []
        i = begin = at + 1
        while i < end:
            if i in self.pair and self.code[i] in OPEN:
                i = self.pair[i]
            elif self.code[i] == ",":
                out.append((begin, i))
                begin = i + 1
            i += 1
        out.append((begin, end))
        spans = [(self.skip(b), e) for b, e in out]
        return [(b, b + len(self.code[b:e].rstrip())) for b, e in spans if self.code[b:e].strip()]

    def literal(self, span: tuple[int, int]) -> str | None:
        """The text of a span that is one string."""
        begin, end = span
        found = self.strings.get(begin)
        return found[1] if found and found[0] == end else None

    def fields(self, span: tuple[int, int]) -> dict[str, tuple[int, int]]:
        """The values of an object literal by key, those of plain and quoted keys."""
        begin, end = span
        if self.code[begin : begin + 1] != "{" or self.pair.get(begin) != end - 1:
            return {}
        out = {}
        for b, e in self.arguments(begin):
            if b in self.strings:
                after, key = self.strings[b]
            else:
                m = re.compile(NAME).match(self.code, b)
                if not m:
                    continue
                after, key = m.end(), m.group()
            at = self.skip(after)
            if self.code[at : at + 1] == ":":
                out[key] = (self.skip(at + 1), e)
            elif at >= e or self.code[at : at + 1] == "(":
                out[key] = (b, e)
        return out

    def statement_end(self, at: int, depth: int = 0) -> int:
        """Just after the statement that begins at a place, its `else` and `catch` parts included."""
        at = self.skip(at)
        if depth > 200 or at >= len(self.code):
            return at
        if self.code[at] == "{":
            return self.close(at) or len(self.code)
        m = re.compile(r"(else\s+)?(if|for|foreach|while|switch|catch|try|do|loop|match|select|finally|unsafe)\b").match(self.code, at)
        if m:
            end = self.body_end(m.end(), m[2], depth)
            return end
        while at < len(self.code):
            c = self.code[at]
            if c in OPEN and at in self.pair:
                at = self.pair[at] + 1
                continue
            if c == ";":
                return at + 1
            if c in CLOSE:
                return at
            at += 1
        return at

    def body_end(self, at: int, word: str, depth: int = 0) -> int:
        """The end of the statement whose keyword `word` ends at a place."""
        i = self.skip(at)
        if self.code[i : i + 1] == "(" and word not in ("try", "do", "loop"):
            i = self.close(i) or len(self.code)
        else:  # headers without parentheses run up to a brace
            while i < len(self.code) and self.code[i] not in "{}":
                i = self.close(i) or i + 1 if self.code[i] in OPEN else i + 1
        end = self.statement_end(i, depth + 1)
        while True:
            j = self.skip(end)
            more = {"if": r"else\b", "try": r"(?:catch|finally)\b", "do": r"while\b"}.get(word)
            m = re.compile(more).match(self.code, j) if more else None
            if not m:
                return end
            if word == "if":
                return self.statement_end(m.end(), depth + 1)
            if word == "do":
                return self.statement_end(j, depth + 1) if False else self.skip(self.close(self.skip(m.end())) or m.end())
            end = self.body_end(m.end(), m.group(), depth + 1)
