"""A reader of the block-and-attribute configuration language: text to nested dicts.

Blocks become lists of dicts under their type (labels are nested keys), attributes become values.
Literals are values; any other expression is kept as text in ``${...}``, and so are templates. The
entries of ``depends_on`` are bare addresses. A scanner that knows quotes, heredocs, comments and
brackets finds the extent of an expression; only lists, objects and literals are read into values.
"""

from __future__ import annotations

import json
import re
from typing import Any

_SPACE = re.compile(r"(?:[ \t\r\n]|#[^\n]*|//[^\n]*|/\*.*?\*/)*", re.S)
_INLINE = re.compile(r"(?:[ \t]|/\*.*?\*/)*", re.S)
_NAME = re.compile(r"[A-Za-z_][\w-]*")
_NUMBER = re.compile(r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?")
_HEREDOC = re.compile(r"<<(-?)([A-Za-z_]\w*)[ \t]*\r?\n")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\"}
_CLOSE = {"(": ")", "[": "]", "{": "}"}


class ParseError(ValueError):
    """The text is not of the language; the message has the line."""


class Parser:
    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def parse(self) -> dict[str, Any]:
        out = self.body(end="")
        if self.at < len(self.text):
            raise self.error("unexpected text")
        return out

    def error(self, what: str) -> ParseError:
        return ParseError(f"line {self.text.count(chr(10), 0, self.at) + 1}: {what}")

    def skip(self, inline: bool = False) -> None:
        self.at = (_INLINE if inline else _SPACE).match(self.text, self.at).end()

    def peek(self, s: str) -> bool:
        return self.text.startswith(s, self.at)

    def body(self, end: str) -> dict[str, Any]:
        out: dict[str, Any] = {}
        while True:
            self.skip()
            if self.at >= len(self.text) or end and self.peek(end):
                if end and self.at >= len(self.text):
                    raise self.error("a block is not closed")
                return out
            begin = self.at
            name = self.name()
            self.skip(inline=True)
            if self.peek("=") and not self.peek("=="):
                self.at += 1
                value = self.value(stop="\n")
                out[name] = [_bare(v) for v in value] if name == "depends_on" and isinstance(value, list) else value
                continue
            labels = []
            while not self.peek("{"):
                labels.append(self.quoted() if self.peek('"') else self.name())
                self.skip(inline=True)
            self.at += 1
            inner = self.body(end="}")
            self.at += 1
            if not end:
                inner["__lines__"] = [self.text.count("\n", 0, begin) + 1, self.text.count("\n", 0, self.at) + 1]
            for label in reversed(labels):
                inner = {label: inner}
            out.setdefault(name, []).append(inner)

    def name(self) -> str:
        if self.peek('"'):
            return self.quoted()
        m = _NAME.match(self.text, self.at)
        if not m:
            raise self.error("a name is expected")
        self.at = m.end()
        return m[0]

    def quoted(self) -> str:
        """A string; its templates are kept as they stand."""
        out, i, text = [], self.at + 1, self.text
        while True:
            if i >= len(text) or text[i] == "\n":
                raise self.error("a string is not closed")
            c = text[i]
            if c == '"':
                self.at = i + 1
                return "".join(out)
            if c == "\\" and i + 1 < len(text):
                out.append(_ESCAPES.get(text[i + 1], text[i : i + 2]))
                i += 2
            elif text.startswith(("${", "%{"), i) and text[i - 1] != c:
                j = self.template_end(i)
                out.append(text[i:j])
                i = j
            else:
                out.append(c)
                i += 1

    def template_end(self, i: int) -> int:
        keep, self.at = self.at, i + 1
        self.bracket()
        end, self.at = self.at, keep
        return end

    def bracket(self) -> None:
        """Past the bracket that opens here, over all that is nested in it."""
        closing = [_CLOSE[self.text[self.at]]]
        self.at += 1
        while closing:
            self.skip()
            if self.at >= len(self.text):
                raise self.error("a bracket is not closed")
            c = self.text[self.at]
            if c == '"':
                self.quoted()
            elif c in _CLOSE:
                closing.append(_CLOSE[c])
                self.at += 1
            elif c == closing[-1]:
                closing.pop()
                self.at += 1
            elif m := _HEREDOC.match(self.text, self.at):
                self.heredoc(m)
            else:
                self.at += 1

    def heredoc(self, m: re.Match[str]) -> str:
        self.at = m.end()
        lines = []
        while True:
            if self.at >= len(self.text):
                raise self.error("a heredoc is not closed")
            end = self.text.find("\n", self.at)
            line = self.text[self.at : end if end >= 0 else len(self.text)]
            self.at += len(line)
            if line.strip() == m[2]:
                break
            self.at += 1
            lines.append(line)
        if m[1]:
            indent = min((len(x) - len(x.lstrip()) for x in lines if x.strip()), default=0)
            lines = [x[indent:] for x in lines]
        return "\n".join(lines)

    def value(self, stop: str) -> Any:  # noqa: ANN401
        """An expression up to a character of ``stop``, a comma or a closing bracket outside of all nesting."""
        self.skip(inline=True)
        begin = self.at
        value, simple = self.simple()
        if simple:
            self.skip(inline=True)
            if self.ends(stop):
                return value
        self.at = begin
        while not self.ends(stop):
            if self.text[self.at] == '"':
                self.quoted()
            elif self.text[self.at] in _CLOSE:
                self.bracket()
            elif m := _HEREDOC.match(self.text, self.at):
                self.heredoc(m)
            else:
                self.at += 1
                self.skip(inline=True)
        return "${" + self.text[begin : self.at].strip() + "}"

    def ends(self, stop: str) -> bool:
        return self.at >= len(self.text) or self.text[self.at] in stop + ",}])\n" or self.peek("#") or self.peek("//")

    def simple(self) -> tuple[Any, bool]:
        text = self.text
        c = text[self.at : self.at + 1]
        if c == '"':
            return self.quoted(), True
        if c == "[":
            return self.items("]")
        if c == "{":
            return self.pairs()
        if m := _HEREDOC.match(text, self.at):
            return self.heredoc(m), True
        if m := _NUMBER.match(text, self.at):
            self.at = m.end()
            return json.loads(m[0]), True
        if (m := _NAME.match(text, self.at)) and m[0] in ("true", "false", "null"):
            self.at = m.end()
            return {"true": True, "false": False, "null": None}[m[0]], True
        return None, False

    def items(self, end: str) -> tuple[Any, bool]:
        self.at += 1
        out = []
        while True:
            self.skip()
            if self.peek(end):
                self.at += 1
                return out, True
            if (m := _NAME.match(self.text, self.at)) and m[0] == "for":
                return None, False
            if self.at >= len(self.text):
                raise self.error("a list is not closed")
            out.append(self.value(stop=""))
            self.skip()
            if self.peek(","):
                self.at += 1
            elif not self.peek(end):
                return None, False

    def pairs(self) -> tuple[Any, bool]:
        self.at += 1
        out: dict[str, Any] = {}
        while True:
            self.skip()
            if self.peek("}"):
                self.at += 1
                return out, True
            m = _NAME.match(self.text, self.at)
            if m and m[0] == "for" and self.text[m.end() : m.end() + 1].isspace():
                return None, False
            if self.peek("("):
                begin = self.at
                self.bracket()
                key = "${" + self.text[begin : self.at] + "}"
            elif m := _NUMBER.match(self.text, self.at):
                self.at, key = m.end(), m[0]
            else:
                key = self.name()
                while self.peek("."):
                    self.at += 1
                    key += "." + self.name()
            self.skip(inline=True)
            if not (self.peek("=") or self.peek(":")):
                return None, False
            self.at += 1
            out[key] = self.value(stop="\n")
            self.skip()
            if self.peek(","):
                self.at += 1


def _bare(x: Any) -> Any:  # noqa: ANN401
    return x[2:-1].strip() if isinstance(x, str) and x.startswith("${") and x.endswith("}") else x


def loads(text: str) -> dict[str, Any]:
    return Parser(text).parse()
