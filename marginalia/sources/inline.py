"""Inline Markdown: text, code, links and comments of one block, with source offsets.

A fragment is (kind, text, start, stop, pieces). Its pieces are (text, start,
stop): where a piece has as many bytes as its source range, each character
stands for itself; otherwise (an entity, a break) the piece stands for all of it.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"`+|\\[!-/:-@\[-`{-~]|\\\n|&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);|<(?=[A-Za-z/!?])|!\[|\[|\]|[*_~]+| {2,}\n"
    r"|(?<![A-Za-z0-9])(?:[hH][tT][tT][pP][sS]?://|[wW][wW][wW]\.)(?=[^\s<])"
)
_AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9.-]+)>")
_TAG = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<[?!][^>]*>|</?[A-Za-z][A-Za-z0-9-]*(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>", re.S)
_URL = re.compile(r"[^\s<]*")
_BALANCED = r"(?:[^\s()\\<]|\\.)(?:[^\s()\\]|\\.)*"
_TAIL = re.compile(
    rf"\(\s*(?:<((?:[^<>\\\n]|\\.)*)>|((?:{_BALANCED}|\((?:[^\s()\\]|\\.)*\))*))(?:\s+(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?\s*\)", re.S
)
_REFERENCE = re.compile(r"\[((?:[^\[\]\\]|\\.)*)\]", re.S)
_ESCAPE = re.compile(r"\\([!-/:-@\[-`{-~])")
_IDENTIFIER = re.compile(r"(?=.*[^\W_])[\w./:\-$\[\]<>]+")
#: Elements whose content is no markup.
RAW_TEXT = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "plaintext")
_MARKUP = re.compile(r"<!--(.*?)-->|<!\[CDATA\[.*?\]\]>|<([A-Za-z0-9]*)(?:\"[^\"]*\"|'[^']*'|[^'\">])*>", re.S)


def octets(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode())


def label_key(label: str) -> str:
    """Reference labels compare with white space and case folded."""
    return " ".join(label.split()).lower().upper()


def unescaped(text: str) -> str:
    return html.unescape(_ESCAPE.sub(r"\1", text)) if "\\" in text or "&" in text else text


@dataclass
class Fragment:
    kind: str
    pieces: list[tuple[str, int, int]]

    @property
    def text(self) -> str:
        return "".join(p[0] for p in self.pieces)

    @property
    def start(self) -> int:
        return min(p[1] for p in self.pieces)

    @property
    def stop(self) -> int:
        return max(p[2] for p in self.pieces)

    def cut(self, a: int, b: int) -> "Fragment":
        """The characters from a to b."""
        out, at = [], 0
        for text, start, stop in self.pieces:
            lo, hi = max(a - at, 0), min(b - at, len(text))
            at += len(text)
            if lo >= hi:
                continue
            if stop - start == octets(text):
                start, stop = start + octets(text[:lo]), start + octets(text[:hi])
            out.append((text[lo:hi], start, stop))
        return Fragment(self.kind, out)


@dataclass
class Link:
    start: int
    stop: int
    destination: str
    dest_start: int
    dest_stop: int
    image: bool
    reference: bool
    label: str = ""


@dataclass
class Scanner:
    """Comments of HTML nodes in order; an open raw-text element spans nodes."""

    raw: str | None = None
    comments: list[tuple[int, int, str]] = field(default_factory=list)

    def scan(self, text: str, start: int) -> None:
        at = 0
        while at < len(text):
            if self.raw:
                closing = re.compile(rf"</{self.raw}(?=[>\s])", re.I).search(text, at)
                if not closing:
                    return
                at, self.raw = closing.start(), None
            opening = text.find("<", at)
            m = _MARKUP.match(text, opening) if opening >= 0 else None
            if not m:
                return
            if m[1] is not None:
                self.comments.append((start + octets(text[:opening]), start + octets(text[: m.end()]), m[1]))
            elif m[2] and m[2].lower() in RAW_TEXT:
                self.raw = m[2].lower()
            at = m.end()


class Inline:
    """Parses one block's text, given as lines (text, byte offset)."""

    def __init__(self, lines: list[tuple[str, int]], definitions: dict[str, tuple[str, int, int]], scanner: Scanner) -> None:
        self.text = "\n".join(s for s, _ in lines)
        self.definitions, self.scanner = definitions, scanner
        self.lines, self.firsts, at = lines, [], 0
        for s, _ in lines:
            self.firsts.append(at)
            at += len(s) + 1
        self.items: list[list] = []  # [type, kind, text, from, to]
        self.links: list[Link] = []

    def byte(self, i: int, end: bool = False) -> int:
        """Source offset of a character; of the end of the one before, if ``end``."""
        k = bisect_right(self.firsts, i - 1 if end and i else i) - 1
        s, at = self.lines[k]
        inside = i - self.firsts[k]
        if inside > len(s):  # after the line's end
            return self.lines[k + 1][1] if k + 1 < len(self.lines) else at + octets(s)
        return at + octets(s[:inside])

    def run(self) -> list[Fragment]:
        text, at, openers = self.text, 0, []
        while m := _TOKEN.search(text, at):
            token, i, j = m[0], m.start(), m.end()
            self._text(at, i)
            at = j
            first = token[0]
            if first == "`":
                closing = re.compile(rf"(?<!`){token}(?!`)").search(text, j)
                if closing:
                    code = text[j : closing.start()].replace("\n", " ")
                    lead = len(code) > 2 and code[0] == code[-1] == " " and code.strip() != ""
                    self.items.append(["code", "inline_code", code[1:-1] if lead else code, i, closing.end()])
                    at = closing.end()
                else:
                    self._text(i, j)
            elif first == "\\":
                self.items.append(["text", "text", "\n" if token[1] == "\n" else token[1], i if token[1] == "\n" else i + 1, j])
            elif first == " ":
                self.items.append(["text", "text", "\n", i, j])
            elif first == "&":
                value = html.unescape(token)
                self.items.append(["text", "text", value, i, j])
            elif first == "<":
                at = self._angle(i)
            elif token in ("[", "!["):
                self.items.append(["open", token, token, i, j])
                openers.append(len(self.items) - 1)
            elif token == "]":
                at = self._close(i, openers)
            elif first in "*_~":
                self._delimiter(token, i, j)
            else:
                at = self._literal(i)
        self._text(at, len(text))
        self._emphasis()
        return self._fragments()

    def _text(self, i: int, j: int) -> None:
        while i < j:  # one piece per line: offsets run on within a line only
            k = self.text.find("\n", i, j)
            k = j if k < 0 else k
            if k > i:
                self.items.append(["text", "text", self.text[i:k], i, k])
            if k < j:
                self.items.append(["text", "text", "\n", k, k + 1])
            i = k + 1

    def _angle(self, i: int) -> int:
        if m := _AUTOLINK.match(self.text, i):
            target = m[1] if ":" in m[1] else "mailto:" + m[1]
            self.items.append(["text", "link_text", m[1], i + 1, m.end() - 1])
            self._destination(target, i + 1, m.end() - 1)
            self.links.append(Link(self.byte(i), self.byte(m.end(), True), target, self.byte(i + 1), self.byte(m.end() - 1, True), False, False, m[1]))
            return m.end()
        if m := _TAG.match(self.text, i):
            self.scanner.scan(m[0], self.byte(i))
            self.items.append(["html", "html", "", i, m.end()])
            return m.end()
        self._text(i, i + 1)
        return i + 1

    def _literal(self, i: int) -> int:
        """A bare address: trailing punctuation and an unmatched bracket are not part of it."""
        end = _URL.match(self.text, i).end()
        while end > i and (self.text[end - 1] in "?!.,:;*_~'\"" or self.text[end - 1] == ")" and self.text.count(")", i, end) > self.text.count("(", i, end)):
            end -= 1
        shown = self.text[i:end]
        target = shown if "://" in shown else "http://" + shown
        self.items.append(["text", "link_text", shown, i, end])
        self._destination(target, i, end)
        self.links.append(Link(self.byte(i), self.byte(end, True), target, self.byte(i), self.byte(end, True), False, False, shown))
        return end

    def _destination(self, target: str, i: int, j: int) -> None:
        self.items.append(["dest", "link_destination", target, i, j])

    def _close(self, i: int, openers: list[int]) -> int:
        while openers and self.items[openers[-1]][0] != "open":
            openers.pop()
        if not openers:
            self._text(i, i + 1)
            return i + 1
        k = openers.pop()
        opening, start = self.items[k][1], self.items[k][3]
        label = self.text[start + len(opening) : i]
        image, target, end, place, reference = opening == "![", None, i + 1, (i, i), False
        if m := _TAIL.match(self.text, i + 1):
            group = 1 if m[1] is not None else 2
            target, end, place = unescaped(m[group] or ""), m.end(), (m.start(group), m.end(group))
        else:
            m = _REFERENCE.match(self.text, i + 1)
            found = self.definitions.get(label_key(m[1] if m and m[1].strip() else label))
            if found:
                target, reference, end = found[0], True, m.end() if m else i + 1
        if target is None:
            self.items[k] = ["text", "text", opening, start, start + len(opening)]
            self._text(i, i + 1)
            return i + 1
        self.items[k] = ["none", "none", "", start, start]
        if k == len(self.items) - 1:
            self.items.append(["text", "link_text", "", start, start])
        for item in self.items[k:]:
            if item[1] == "text":
                item[1] = "link_text"
        span = found[1:] if reference else (self.byte(place[0]), self.byte(place[1], True))
        self.items.append(["dest", "link_destination", target, place[0], place[1], *span])
        self.links.append(Link(self.byte(start), self.byte(end, True), target, *span, image, reference, unescaped(label)))
        if not image:  # links hold no links
            for o in openers:
                if self.items[o][1] == "[":
                    self.items[o] = ["text", "text", "[", self.items[o][3], self.items[o][3] + 1]
        return end

    def _delimiter(self, token: str, i: int, j: int) -> None:
        before = self.text[i - 1] if i else " "
        after = self.text[j] if j < len(self.text) else " "
        opens, closes = not after.isspace(), not before.isspace()
        if token[0] == "_":  # no emphasis inside words
            opens, closes = opens and not before.isalnum(), closes and not after.isalnum()
        self.items.append(["delim", token, token, i, j, opens, closes])

    def _emphasis(self) -> None:
        """Delimiters that find a partner vanish; others are text."""
        waiting: list[list] = []
        for item in self.items:
            if item[0] != "delim":
                continue
            partner = next((x for x in reversed(waiting) if x[2] == item[2]), None) if item[6] else None
            if partner:
                while waiting.pop() is not partner:
                    pass
                partner[0] = item[0] = "none"
            elif item[5]:
                waiting.append(item)
        for item in self.items:
            if item[0] == "delim":
                item[0], item[1] = "text", "text"

    def _fragments(self) -> list[Fragment]:
        out: list[Fragment] = []
        for item in self.items:
            if item[0] in ("none", "html", "open"):
                if item[0] == "open":
                    item[1] = "text"
                else:
                    continue
            kind = item[1]
            start, stop = item[5:7] if item[0] == "dest" and len(item) > 5 else (self.byte(item[3]), self.byte(item[4], True))
            piece = (item[2], start, max(stop, start))
            if out and out[-1].kind == kind and kind in ("text", "link_text"):
                out[-1].pieces.append(piece)
            else:
                out.append(Fragment(kind, [piece]))
        return out


def is_identifier(code: str) -> bool:
    return _IDENTIFIER.fullmatch(code) is not None
