"""Markdown shredding: one Arrow pass from texts to nested rows.

A documented subset of GitHub-flavoured Markdown: YAML front matter, ATX and
setext headings, paragraphs, fenced and indented code, block quotes with lazy
lines, nested bullet and ordered lists with task marks, pipe tables, thematic
breaks, footnote definitions, HTML blocks and comments; inline code, emphasis,
escapes, entities, links, images, references, autolinks. Tabs count as one
character of content, and footnote references are text. Spans are half-open
UTF-8 byte ranges of the source.

Roles of sections and flags of blocks that the rules need are set in the same
pass, since they look at words of neighbours and ancestors; see ``roles``.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .inline import Fragment, Inline, Scanner, is_identifier, label_key, octets, unescaped

_SPAN = "start:int,stop:int"
_RUNS = "array<struct<text:string,asserted:string,pieces:array<struct<at:int,text:string,start:int,stop:int>>>>"
SCHEMA = f"""language string,
lines array<int>,
front struct<kind:string,lang:string,canonical:boolean,errors:array<string>,{_SPAN}>,
sections array<struct<idx:int,parent:int,depth:int,heading:string,head_start:int,head_stop:int,{_SPAN},own_stop:int,
role:string,signal:string,signal_start:int,signal_stop:int,recovery:boolean,decides:boolean,paragraphs:int>>,
blocks array<struct<idx:int,parent:int,section:int,kind:string,{_SPAN},text:string,prose:string,info:string,ordered:boolean,checked:boolean,
quoted:boolean,listed:boolean,example:boolean,flow:boolean,unclassified:boolean,opaque:boolean,evidence:boolean,rationale:array<string>,rows:array<int>>>,
sentences array<struct<idx:int,block:int,section:int,{_SPAN},text:string,language:string,heading:boolean,quoted:boolean,example:boolean,
runs:{_RUNS},coded:{_RUNS},fragments:array<struct<kind:string,text:string>>>>,
links array<struct<idx:int,block:int,section:int,label:string,destination:string,{_SPAN},dest_start:int,dest_stop:int,image:boolean,reference:boolean>>,
comments array<struct<content:string,{_SPAN},alone:boolean,leading:boolean,next_start:int,next_stop:int,inner_start:int,inner_stop:int>>,
identifiers array<struct<block:int,section:int,text:string,{_SPAN}>>,
anchors array<struct<name:string,{_SPAN}>>,
definitions array<struct<{_SPAN},names:array<string>,heads:array<string>>>"""
TABLES = ("front", "sections", "blocks", "sentences", "links", "comments", "identifiers", "anchors", "definitions")

_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+\Z")
_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*\Z")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})[ \t]*([^`]*)\Z|( {0,3})(~{3,})(.*)\Z")
_ITEM = re.compile(r"( {0,3})([-*+]|(\d{1,9})([.)]))(?=[ \t]|\Z)")
_TASK = re.compile(r"\[([ xX])\][ \t]")
_BREAK = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})\Z")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*\Z")
_RULE = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*\Z")
_QUOTE = re.compile(r" {0,3}> ?")
_DEFINITION = re.compile(r" {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*(?:<([^<>]*)>|(\S+))(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?[ \t]*\Z")
_FOOTNOTE = re.compile(r" {0,3}\[\^([^\]\s]+)\]:[ \t]*")
_HTML_ENDS = (
    (re.compile(r" {0,3}<(?:script|pre|style|textarea)(?=[\s>]|\Z)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r" {0,3}<!--"), re.compile(r"-->")),
    (re.compile(r" {0,3}<\?"), re.compile(r"\?>")),
    (re.compile(r" {0,3}<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(r" {0,3}<![A-Za-z]"), re.compile(r">")),
)
# Elements that begin an HTML block anywhere, by the CommonMark specification.
_BLOCK_TAGS = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search "
    "section summary table tbody td tfoot th thead title tr track ul"
).split()
_HTML_BLOCK = re.compile(rf" {{0,3}}</?(?:{'|'.join(_BLOCK_TAGS)})(?=[\s/>]|\Z)", re.I)
_HTML_ALONE = re.compile(r" {0,3}(?:<[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>)[ \t]*\Z")
_URL = re.compile(r"(?i)(?:[a-z][a-z0-9+.-]*://|www\.)[^\s<>]+")
_QUOTATION = re.compile(r"\"[^\"\n]*\"|“[^”\n]*”|‘[^’\n]*’|「[^」\n]*」|『[^』\n]*』")
_ATTRIBUTES = re.compile(r"\s*\{:?\s*([^{}]*)\}\s*\Z")
_LITERAL_ATTRIBUTES = re.compile(r"(?:^|[^\\])\{:?[^{}]*\}\Z")
_ANCHOR_TAG = re.compile(r"<([A-Za-z][A-Za-z0-9:-]*)\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>", re.S)
_ANCHOR_NAME = re.compile(r"\s(?:id|name)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+))", re.I)

Line = tuple[str, int, int]  # text without its end, its first byte, the byte after its end


def blanked(pattern: re.Pattern, text: str) -> str:
    return pattern.sub(lambda m: " " * len(m[0]), text)


def detect_language(text: str) -> str:
    kana = len(re.findall(r"[぀-ヿｦ-ﾟ]", text))
    han = len(re.findall(r"[㐀-䶿一-鿿\U00020000-\U000323af]", text))
    if kana + han > (len(re.findall(r"[A-Za-z]+", text)) if kana + han else 0):
        return "ja" if kana else "zh"
    return "en"


def slug(heading: str) -> str:
    """Lower case; letters, marks, digits, connectors, blanks and hyphens stay."""
    import unicodedata

    kept = (c for c in heading.lower() if c in " -" or c.isalpha() or unicodedata.category(c) in ("Mn", "Mc", "Me", "Nd", "Nl", "Pc") or "Ⓐ" <= c <= "ⓩ")
    return "".join(kept).replace(" ", "-")


class Shredder:
    def __init__(self, text: str) -> None:
        self.text = text
        self.source = text.encode()
        self.size = len(self.source)
        self.sections: list[dict] = []
        self.blocks: list[dict] = []
        self.sentences: list[dict] = []
        self.links: list[dict] = []
        self.identifiers: list[dict] = []
        self.front: dict | None = None
        self.code_spans: list[tuple[int, int]] = []
        self.scanner = Scanner()
        self.ends: list[Fragment] = []

    def run(self) -> "Shredder":
        from .roles import annotate

        lines, at = [], 0
        for raw in _LINE.findall(self.text):
            size = octets(raw)
            lines.append((raw.rstrip("\r\n"), at, at + size))
            at += size
        self.starts = [x[1] for x in lines] or [0]
        if self.text.endswith(("\r", "\n")):
            self.starts.append(at)
        self.lines = self.starts
        self._section(None, 0, None, 0, 0, self.size)
        self.open, self.floor = [0], 1
        body = self._front_matter(lines)
        self.known = self._definitions(body)
        self._all(body)
        self._finish()
        annotate(self)
        self.comments = [self._bound(c) for c in self.scanner.comments]
        self.anchors = self._anchors()
        self.definitions = self._definition_units()
        return self

    # Blocks ---------------------------------------------------------------

    def _front_matter(self, lines: list[Line]) -> list[Line]:
        if not lines or lines[0][0].lstrip("﻿").rstrip() != "---":
            return lines
        for i, (line, _, stop) in enumerate(lines[1:], 1):
            if line.rstrip() in ("---", "..."):
                self.front = front_matter("\n".join(x[0] for x in lines[1:i]))
                self.front |= {"start": 0, "stop": lines[i][1] + octets(line)}
                return lines[i + 1 :]
        key = next((x[0] for x in lines[1:] if x[0].strip()), "")
        if re.match(r"[A-Za-z0-9_-]+:", key):
            self.front = {"kind": None, "lang": None, "canonical": None, "errors": ["YAML front matter has no closing fence"], "start": 0, "stop": self.size}
        return lines

    def _definitions(self, lines: list[Line]) -> dict[str, tuple[str, int, int]]:
        """Link targets by label, the first of each label; fenced code holds none."""
        found: dict[str, tuple[str, int, int]] = {}
        fence, paragraph = None, False
        for s, at, _ in lines:
            cut = re.match(r"(?: {0,3}> ?)*", s)[0]
            inner = s[len(cut) :]
            if fence:
                if re.match(rf" {{0,3}}{re.escape(fence[0])}{{{len(fence)},}}[ \t]*\Z", inner):
                    fence = None
                continue
            if m := _FENCE.match(inner):
                fence, paragraph = m[1] or m[4], False
            elif (m := _DEFINITION.match(inner)) and not paragraph and not m[1].startswith("^"):
                group = 2 if m[2] is not None else 3
                place = at + octets(cut + inner[: m.start(group)])
                found.setdefault(label_key(m[1]), (unescaped(m[group]), place, place + octets(m[group])))
            else:
                paragraph = bool(inner.strip()) and not _HEADING.match(inner)
        return found

    def _all(self, lines: list[Line]) -> None:
        """Blocks of all containers, without recursion: a container's lines are parsed when it is met."""
        stack = [self._blocks(lines, None)]
        saved: list = []
        while stack:
            inner = next(stack[-1], None)
            if inner is None:
                stack.pop()
                if saved:
                    block, self.open, self.floor, opened = saved.pop()
                    for x in opened:
                        self.sections[x]["stop"] = min(self.sections[x]["stop"], self.blocks[block]["stop"])
                continue
            lines, block, scoped = inner
            saved.append((block, list(self.open), self.floor, []))
            if scoped:
                self.floor = len(self.open)
                saved[-1] = (block, saved[-1][1], saved[-1][2], _Opened(self, len(self.open)))
            stack.append(self._blocks(lines, block))

    def _add(self, kind: str, start: int, stop: int, parent: int | None, info: str | None = None, ordered: bool | None = None, checked: bool | None = None, text: str = "") -> int:
        self.blocks.append({
            "idx": len(self.blocks), "parent": parent, "section": self.open[-1], "kind": kind, "start": start, "stop": stop, "text": text, "prose": "",
            "info": info, "ordered": ordered, "checked": checked, "rationale": [], "rows": [],
        })
        return len(self.blocks) - 1

    def _section(self, parent: int | None, depth: int, heading: str | None, head_start: int, head_stop: int, stop: int) -> None:
        self.sections.append({
            "idx": len(self.sections), "parent": parent, "depth": depth, "heading": heading, "head_start": None if heading is None else head_start,
            "head_stop": None if heading is None else head_stop, "start": head_start, "stop": stop, "own_stop": None,
        })

    def _heading(self, depth: int, lines: list[tuple[str, int]], start: int, stop: int, parent: int | None) -> None:
        while len(self.open) > self.floor and self.sections[self.open[-1]]["depth"] >= depth:
            self.sections[self.open.pop()]["stop"] = start
        self._section(self.open[-1], depth, "", start, stop, self.size)
        self.open.append(len(self.sections) - 1)
        block = self._add("heading", start, stop, parent, str(depth))
        self._prose(lines, block)
        section = self.sections[self.blocks[block]["section"]]
        section["heading"] = "".join(f.text for f in self.ends if f.kind != "link_destination")

    def _blocks(self, lines: list[Line], parent: int | None) -> Iterator[tuple[list[Line], int, bool]]:
        i = 0
        while i < len(lines):
            s, at, _ = lines[i]
            lead = len(s) - len(s.lstrip(" \t"))
            start = at + lead
            if not s.strip():
                i += 1
            elif s.startswith("    ") or s.startswith("\t"):
                j = i
                while j < len(lines) and (lines[j][0].startswith(("    ", "\t")) or not lines[j][0].strip()):
                    j += 1
                while not lines[j - 1][0].strip():
                    j -= 1
                self._add("code", start, _end(lines[j - 1]), parent, None, text="\n".join(x[0][4:] for x in lines[i:j]))
                i = j
            elif m := _FENCE.match(s):
                i = self._fenced(lines, i, m, parent)
            elif m := _HEADING.match(s):
                title = (m[2] or "").strip()
                where = at + octets(s[: m.start(2)]) + octets(m[2][: len(m[2]) - len(m[2].lstrip())]) if m[2] else start
                self._heading(len(m[1]), [(title, where)], start, _end(lines[i]), parent)
                i += 1
            elif _BREAK.match(s):
                self._add("break", start, _end(lines[i]), parent)
                i += 1
            elif _QUOTE.match(s):
                i, inner = self._quote(lines, i)
                block = self._add("quote", start, _end(lines[i - 1]), parent)
                yield inner, block, True
            elif _ITEM.match(s):
                j = i
                block = self._add("list", start, start, parent, None, _ITEM.match(s)[3] is not None)
                kind = _item_kind(s)
                while j < len(lines):
                    k = j
                    while k < len(lines) and not lines[k][0].strip():
                        k += 1
                    if k == len(lines) or _item_kind(lines[k][0]) != kind or _BREAK.match(lines[k][0]):
                        break
                    j, inner, checked = self._item(lines, k)
                    item = self._add("item", lines[k][1] + len(lines[k][0]) - len(lines[k][0].lstrip(" ")), _end(lines[j - 1]), block, None, None, checked)
                    self.blocks[block]["stop"] = _end(lines[j - 1])
                    yield inner, item, True
                i = j
            elif m := _FOOTNOTE.match(s):
                j = i + 1
                while j < len(lines) and (lines[j][0].startswith("    ") or not lines[j][0].strip() and j + 1 < len(lines) and lines[j + 1][0].startswith("    ")):
                    j += 1
                block = self._add("footnote", start, _end(lines[j - 1]), parent, m[1])
                inner = [(s[m.end() :], at + octets(m[0]), lines[i][2]), *[(x[min(4, len(x)) :], y + min(4, len(x)), z) for x, y, z in lines[i + 1 : j]]]
                yield inner, block, True
                i = j
            elif (_DEFINITION.match(s)) and not s.lstrip().startswith("[^"):
                self._add("definition", start, _end(lines[i]), parent)
                i += 1
            elif (j := self._html(lines, i)) > i:
                raw = self.source[start : _end(lines[j - 1])].decode("utf-8", "ignore")
                kind = "comment" if raw.strip().startswith("<!--") else "html"
                self._add(kind, start, _end(lines[j - 1]), parent, text=raw)
                self.scanner.scan(raw, start)
                i = j
            elif "|" in s and i + 1 < len(lines) and _RULE.match(lines[i + 1][0]) and "-" in lines[i + 1][0] and len(_cells(s)) == len(_cells(lines[i + 1][0])):
                i = self._table(lines, i, parent)
            else:
                i = self._paragraph(lines, i, parent)

    def _fenced(self, lines: list[Line], i: int, m: re.Match, parent: int | None) -> int:
        fence, info = m[1] or m[4], (m[2] if m[1] else m[5]) or ""
        s, at, _ = lines[i]
        j = i + 1
        close = re.compile(rf" {{0,3}}{re.escape(fence[0])}{{{len(fence)},}}[ \t]*\Z")
        while j < len(lines) and not close.match(lines[j][0]):
            j += 1
        body = "\n".join(x[0] for x in lines[i + 1 : j])
        stop = _end(lines[min(j, len(lines) - 1)])
        self._add("code", at + len(s) - len(s.lstrip(" ")), stop, parent, info.split()[0] if info.split() else None, text=body)
        return j + 1

    def _quote(self, lines: list[Line], i: int) -> tuple[int, list[Line]]:
        inner, lazy = [], False
        fence = False
        while i < len(lines):
            s, at, end = lines[i]
            if m := _QUOTE.match(s):
                rest = s[m.end() :]
                inner.append((rest, at + octets(m[0]), end))
                fence ^= bool(_FENCE.match(rest))
                lazy = bool(rest.strip()) and not fence and not (_HEADING.match(rest) or _FENCE.match(rest) or _BREAK.match(rest) or rest.startswith("    "))
            elif lazy and s.strip() and not _interrupts(s) and not _ITEM.match(s):
                inner.append((s.lstrip(), at + len(s) - len(s.lstrip()), end))
            else:
                break
            i += 1
        return i, inner

    def _item(self, lines: list[Line], i: int) -> tuple[int, list[Line], bool | None]:
        s, at, end = lines[i]
        m = _ITEM.match(s)
        rest = s[m.end() :]
        gap = len(rest) - len(rest.lstrip(" \t"))
        gap = 1 if not rest.strip() or gap > 4 else gap
        width = m.end() + gap
        body, place = s[width:], at + octets(s[:width])
        checked = None
        if t := _TASK.match(body):
            checked, body, place = t[1] != " ", body[t.end() :], place + t.end()
        inner: list[Line] = [(body, place, end)]
        j, last, lazy = i + 1, i + 1, bool(body.strip())
        fence = bool(_FENCE.match(body))
        while j < len(lines):
            s, at, end = lines[j]
            if not s.strip():
                if not body.strip() and j == i + 1:
                    break
                inner.append(("", at + octets(s), end))
                lazy = False
            elif s.startswith(" " * width) or s.startswith("\t"):
                cut = 1 if s.startswith("\t") and not s.startswith(" " * width) else width
                inner.append((s[cut:], at + cut, end))
                fence ^= bool(_FENCE.match(s[cut:]))
                lazy, last = not fence and not _HEADING.match(s[cut:]), j + 1
            elif lazy and not _interrupts(s) and not _ITEM.match(s):
                inner.append((s.lstrip(), at + len(s) - len(s.lstrip()), end))
                last = j + 1
            else:
                break
            j += 1
        return last, inner[: last - i], checked

    def _html(self, lines: list[Line], i: int) -> int:
        """The line after an HTML block that starts at line i, or i."""
        s = lines[i][0]
        for opening, closing in _HTML_ENDS:
            if opening.match(s):
                j = i
                while j < len(lines) - 1 and not closing.search(lines[j][0], opening.match(s).end() if j == i else 0):
                    j += 1
                return j + 1
        if _HTML_BLOCK.match(s) or _HTML_ALONE.match(s):
            j = i
            while j < len(lines) and lines[j][0].strip():
                j += 1
            return j
        return i

    def _table(self, lines: list[Line], i: int, parent: int | None) -> int:
        j = i + 2
        while j < len(lines) and lines[j][0].strip() and not (_interrupts(lines[j][0])):
            j += 1
        s, at, _ = lines[i]
        table = self._add("table", at + len(s) - len(s.lstrip()), _end(lines[j - 1]), parent)
        columns = len(_cells(s))
        for k in (i, *range(i + 2, j)):
            s, at, _ = lines[k]
            row = self._add("row", at + len(s) - len(s.lstrip()), _end(lines[k]), table, "header" if k == i else None)
            for a, b in _cells(s)[:columns]:
                cell = self._add("cell", at + octets(s[:a]), at + octets(s[:b]), row)
                if a < b:
                    self._prose([(s[a:b].replace("\\|", "\\|"), at + octets(s[:a]))], cell)
        return j

    def _paragraph(self, lines: list[Line], i: int, parent: int | None) -> int:
        j = i + 1
        while j < len(lines) and lines[j][0].strip():
            s = lines[j][0]
            if m := _SETEXT.match(s):
                depth = 1 if m[1][0] == "=" else 2
                start = lines[i][1] + len(lines[i][0]) - len(lines[i][0].lstrip())
                self._heading(depth, _stripped(lines[i:j]), start, _end(lines[j]), parent)
                return j + 1
            if _interrupts(s):
                break
            j += 1
        start = lines[i][1] + len(lines[i][0]) - len(lines[i][0].lstrip())
        block = self._add("paragraph", start, _end(lines[j - 1]), parent)
        self._prose(_stripped(lines[i:j]), block)
        return j

    # Sentences ------------------------------------------------------------

    def _prose(self, lines: list[tuple[str, int]], block: int) -> None:
        b = self.blocks[block]
        inline = Inline(lines, self.known, self.scanner)
        fragments = inline.run()
        self.ends = fragments
        for x in sorted(inline.links, key=lambda x: (x.start, -x.stop)):
            self.links.append({
                "idx": len(self.links), "block": block, "section": b["section"], "label": x.label, "destination": x.destination, "start": x.start,
                "stop": x.stop, "dest_start": x.dest_start, "dest_stop": x.dest_stop, "image": x.image, "reference": x.reference,
            })
        for f in fragments:
            if f.kind == "inline_code":
                self.code_spans.append((f.start, f.stop))
            if f.kind == "inline_code" and is_identifier(f.text):
                self.identifiers.append({"block": block, "section": b["section"], "text": f.text, "start": f.start, "stop": f.stop})
        b["text"] = " ".join(f.text for f in fragments if f.kind != "link_destination")
        self._split(fragments, block)

    def _split(self, fragments: list[Fragment], block: int) -> None:
        """Sentences of a block; a break is never inside code or a destination."""
        places, at, cuts = [], 0, [0]
        prose = "".join("" if f.kind == "link_destination" else f.text for f in fragments)
        declared = self.front.get("lang") if self.front and self.front.get("lang") in ("en", "zh", "ja") else None
        for f in fragments:
            size = 0 if f.kind == "link_destination" else len(f.text)
            places.append((at, at + size))
            if f.kind in ("text", "link_text"):
                for m in re.finditer(r"[。！？]|[.!?](?=\s|\Z)", prose[: at + size + 1][at:] if at + size < len(prose) else prose[at:]):
                    if m.start() < size:
                        cuts.append(at + m.end())
            at += size
        if not prose.strip():
            if any(f.kind == "link_destination" for f in fragments):
                first = next((f for f in fragments if f.kind == "link_text"), fragments[0])
                self._sentence(fragments, block, first.start, first.stop, declared or "en")
            return
        if cuts[-1] != len(prose):
            cuts.append(len(prose))
        for a, z in zip(cuts, cuts[1:], strict=False):
            part = prose[a:z]
            if not part.strip():
                continue
            lo, hi = a + len(part) - len(part.lstrip()), z - len(part) + len(part.rstrip())
            inside: list[Fragment] = []
            for f, (x, y) in zip(fragments, places, strict=True):
                if f.kind == "link_destination":
                    if (x > a or x == 0) and x <= z:
                        inside.append(f)
                elif max(lo, x) < min(hi, y):
                    inside.append(f if lo <= x and y <= hi else f.cut(max(lo, x) - x, min(hi, y) - x))
            told = [f for f in inside if f.kind != "link_destination" and f.pieces]
            if told:
                words = "".join(f.text for f in told if f.kind != "inline_code")
                self._sentence(inside, block, min(f.start for f in told), max(f.stop for f in told), declared or detect_language(words))

    def _sentence(self, fragments: list[Fragment], block: int, start: int, stop: int, language: str) -> None:
        b = self.blocks[block]
        runs = _runs(fragments, False)
        coded = _runs(fragments, True) if any(f.kind == "inline_code" for f in fragments) else runs
        self.sentences.append({
            "idx": len(self.sentences), "block": block, "section": b["section"], "start": start, "stop": stop,
            "text": "".join(f.text for f in fragments if f.kind != "link_destination"), "language": language, "heading": b["kind"] == "heading",
            "runs": runs, "coded": coded, "fragments": [{"kind": f.kind, "text": f.text} for f in fragments],
            "words": " ".join(" ".join(r["asserted"] for r in runs).split()),
        })

    # After the blocks -----------------------------------------------------

    def _finish(self) -> None:
        words = "".join(f["text"] for s in self.sentences for f in s["fragments"] if f["kind"] in ("text", "link_text"))
        declared = self.front.get("lang") if self.front else None
        self.language = declared if declared in ("en", "zh", "ja") else detect_language(words)
        first_child: dict[int, int] = {}
        for s in self.sections[1:]:
            first_child.setdefault(s["parent"], s["start"])
        for s in self.sections:
            s["own_stop"] = first_child.get(s["idx"], s["stop"])

    def row(self, byte: int) -> int:
        return bisect_right(self.starts, byte)

    def _bound(self, comment: tuple[int, int, str]) -> dict:
        """A comment and what it can be about: the file, the next block, or the block it is in."""
        start, stop, content = comment
        row = self.row(start) - 1
        line = self.source[self.starts[row] : start]
        tail = self.source[stop:].split(b"\n", 1)[0]
        out = {"content": content, "start": start, "stop": stop, "alone": not line.strip() and not tail.strip(), "leading": False}
        out |= dict.fromkeys(("next_start", "next_stop", "inner_start", "inner_stop"))
        cursor = self.front["stop"] if self.front else 0
        if start >= cursor:
            for a, z, _ in self.scanner.comments:
                if a >= cursor and z <= start and not self.source[cursor:a].strip():
                    cursor = z
            out["leading"] = not self.source[cursor:start].strip()
        holders = [b for b in self.blocks if b["start"] <= start and stop <= b["stop"]]
        home = min((b for b in holders if b["kind"] == "comment"), key=lambda b: b["stop"] - b["start"], default=None)
        after = [b for b in self.blocks if b["parent"] == (home["parent"] if home else None) and b["start"] >= stop and b["kind"] != "comment"]
        following = min(after, key=lambda b: (b["start"], b["start"] - b["stop"]), default=None)
        if following and following["kind"] in ("paragraph", "list", "table", "code", "heading"):
            out |= {"next_start": following["start"], "next_stop": following["stop"]}
        for kinds in (("cell", "item"), ("paragraph",)):
            inner = min((b for b in holders if b["kind"] in kinds), key=lambda b: b["stop"] - b["start"], default=None)
            if inner:
                out |= {"inner_start": inner["start"], "inner_stop": inner["stop"]}
                break
        return out

    def _anchors(self) -> list[dict]:
        """Heading slugs, numbered where they repeat, attribute lists, and id or name attributes; the first of each name."""
        out: dict[str, tuple[int, int]] = {}
        taken: set[str] = set()
        turns: dict[str, int] = {}
        for b in self.blocks:
            if b["kind"] != "heading":
                continue
            heading, span = self.sections[b["section"]]["heading"] or "", (b["start"], b["stop"])
            base = name = slug(heading)
            n = turns.get(base, 0)
            while name in taken:  # a numbered slug may itself be another heading's
                n += 1
                name = f"{base}-{n}"
            turns[base] = n
            taken.add(name)
            out.setdefault(name, span)
            m = _ATTRIBUTES.search(heading)
            if m and self._literal_attributes(b):
                out.setdefault(slug(heading[: m.start()]), span)
                for token in m[1].split():
                    if len(token) > 1 and token[0] == "#":
                        out.setdefault(token[1:], span)
        if b"<" in self.source:
            self._named(out)
        return [{"name": n, "start": a, "stop": z} for n, (a, z) in out.items()]

    def _literal_attributes(self, b: dict) -> bool:
        lines = [x.rstrip() for x in self.source[b["start"] : b["stop"]].decode().splitlines() if x.strip()]
        if len(lines) > 1 and _SETEXT.match(lines[-1]):
            lines.pop()
        return bool(lines) and _LITERAL_ATTRIBUTES.search(re.sub(r"[ \t]+#+\Z", "", lines[-1])) is not None

    def _named(self, out: dict[str, tuple[int, int]]) -> None:
        import html

        hidden = sorted(
            [(b["start"], b["stop"]) for b in self.blocks if b["kind"] in ("code", "comment")] + [c[:2] for c in self.scanner.comments]
            + ([(self.front["start"], self.front["stop"])] if self.front else []) + self.code_spans + [(x["dest_start"], x["dest_stop"]) for x in self.links]
        )
        markup = [(b["start"], b["stop"]) for b in self.blocks if b["kind"] == "html"]
        until = at = last = 0
        for m in _ANCHOR_TAG.finditer(self.text):
            at, last = at + octets(self.text[last : m.start()]), m.start()
            before = self.text[max(0, last - 64) : last]
            slashes = len(before) - len(before.rstrip("\\"))
            if at < until or any(a <= at < z for a, z in hidden) or slashes % 2 and not any(a <= at < z for a, z in markup):
                continue
            if m[1].lower() in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "plaintext"):
                close = re.compile(rf"</{re.escape(m[1])}", re.I).search(self.text, m.end())
                until = at + octets(self.text[last : close.start()]) if close else self.size
            for name in _ANCHOR_NAME.finditer(m[0]):
                value = html.unescape(next(x for x in name.groups() if x is not None))
                out.setdefault(value, (at, at + octets(m[0])))

    def _definition_units(self) -> list[dict]:
        """Tables and outermost lists that define identifiers: names in them, and heads that are defined."""
        self.identifiers.sort(key=lambda x: x["start"])
        self.name_starts = [x["start"] for x in self.identifiers]
        if not self.identifiers:
            return []
        children: dict[int | None, list[dict]] = {}
        for b in self.blocks:
            children.setdefault(b["parent"], []).append(b)
        out = []
        for b in self.blocks:
            heads: set[str] = set()
            if b["kind"] == "table":
                for row in children.get(b["idx"], [])[1:]:
                    cells = children.get(row["idx"], [])
                    if cells and any(re.search(r"[^\W_]", self._slice(c)) for c in cells[1:]):
                        heads |= {x["text"] for x in self._names(cells[0])}
            elif b["kind"] == "list" and not b["nested"]:
                for item in children.get(b["idx"], []):
                    inner = children.get(item["idx"], [])
                    if inner and inner[0]["kind"] == "paragraph":
                        heads |= self._head(inner[0])
            if heads:
                out.append({"start": b["start"], "stop": b["stop"], "names": sorted({x["text"] for x in self._names(b)}), "heads": sorted(heads)})
        return out

    def _names(self, block: dict) -> list[dict]:
        starts = self.name_starts
        return [x for x in self.identifiers[bisect_left(starts, block["start"]) : bisect_right(starts, block["stop"])] if x["stop"] <= block["stop"]]

    def _slice(self, block: dict) -> str:
        return self.source[block["start"] : block["stop"]].decode("utf-8", "ignore")

    def _head(self, paragraph: dict) -> set[str]:
        """The identifier that a list item's paragraph begins with and describes."""
        first = next(iter(self._names(paragraph)), None)
        if first is None or self.source[paragraph["start"] : first["start"]].decode("utf-8", "ignore").strip(" \t*_"):
            return set()
        after = self.source[first["stop"] : paragraph["stop"]].decode("utf-8", "ignore")
        signed = after.lstrip()[:1] in tuple(":：-—–=") and after.lstrip() != "" and re.search(r"[^\W_]", after)
        code = "".join(re.split(r"`[^`]*`|\]\([^)]*\)", after))
        said = any(w not in ("and", "or", "及", "和", "または") for w in re.findall(r"[^\W_]+", code))
        return {first["text"]} if signed or said else set()


class _Opened:
    """Sections that a container opened, known when it ends."""

    def __init__(self, shredder: Shredder, depth: int) -> None:
        self.shredder, self.first = shredder, len(shredder.sections)

    def __iter__(self) -> Iterator[int]:
        return iter(range(self.first, len(self.shredder.sections)))


def _end(line: Line) -> int:
    return line[1] + octets(line[0])


def _stripped(lines: list[Line]) -> list[tuple[str, int]]:
    out = []
    for k, (s, at, _) in enumerate(lines):
        lead = len(s) - len(s.lstrip())
        kept = s.lstrip()
        out.append((kept.rstrip() if k == len(lines) - 1 or not kept.endswith("  ") else kept, at + octets(s[:lead])))
    return out


def _item_kind(s: str) -> str | None:
    m = _ITEM.match(s)
    return (m[4] or m[2]) if m else None


def _interrupts(s: str) -> bool:
    """Whether a line ends a paragraph."""
    m = _ITEM.match(s)
    item = m and s[m.end() :].strip() and (m[3] is None or int(m[3]) == 1)
    return bool(item or _HEADING.match(s) or _FENCE.match(s) or _BREAK.match(s) or _QUOTE.match(s) or _HTML_BLOCK.match(s) or any(o.match(s) for o, _ in _HTML_ENDS))


def _cells(s: str) -> list[tuple[int, int]]:
    """Character ranges of a table row's cells, trimmed."""
    bars = [m.start() for m in re.finditer(r"(?<!\\)\|", s)]
    lead, tail = len(s) - len(s.lstrip()), len(s.rstrip())
    edges = [lead - 1, *bars, tail] if not bars or bars[0] != lead else [*bars, tail]
    if len(edges) > 1 and edges[-2] == tail - 1:
        edges.pop()
    out = []
    for a, b in zip(edges, edges[1:], strict=False):
        part = s[a + 1 : b]
        x = a + 1 + len(part) - len(part.lstrip())
        out.append((x, max(x, a + 1 + len(part.rstrip()))))
    return out


def _runs(fragments: list[Fragment], coded: bool) -> list[dict]:
    """Texts that belong together: without destinations, broken at code or with code between blanks."""
    out: list[dict] = []
    text, pieces = "", []
    for f in [*fragments, None]:
        if f is not None and f.kind == "link_destination":
            continue
        if f is None or f.kind == "inline_code" and not coded:
            if text:
                told = blanked(_URL, text)
                out.append({"text": told, "asserted": blanked(_QUOTATION, told), "pieces": pieces})
            text, pieces = "", []
            continue
        blank = " " if f.kind == "inline_code" else ""
        text += blank
        for t, start, stop in f.pieces:
            if t:
                pieces.append({"at": len(text), "text": t, "start": start, "stop": stop})
            text += t
        text += blank
    return out


def front_matter(raw: str) -> dict:
    import yaml

    out: dict = {"kind": None, "lang": None, "canonical": None, "errors": []}
    try:
        found = yaml.safe_load(raw)
    except (yaml.YAMLError, ValueError) as e:
        mark = getattr(e, "problem_mark", None)
        where = f" at line {mark.line + 2}" if mark else ""
        out["errors"].append(f"{getattr(e, 'problem', None) or 'invalid YAML'}{where}")
        return out
    if found is None:
        return out
    if not isinstance(found, dict):
        out["errors"].append("YAML front matter must be a mapping")
        return out
    for key, kind, name in (("kind", str, "a string"), ("lang", str, "a string"), ("canonical", bool, "a boolean")):
        if key in found:
            if isinstance(found[key], kind):
                out[key] = found[key]
            else:
                out["errors"].append(f"front matter `{key}` must be {name}")
    return out


def shred(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One nested row per text, named ``doc``; null texts are empty documents. The key keeps its type."""
    from pyspark.sql.pandas.types import to_arrow_type

    chosen = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    schema = f"doc {chosen.schema['doc'].dataType.simpleString()}, {SCHEMA}"
    fields = docs.sparkSession.createDataFrame([], schema).schema.fields
    types = {f.name: to_arrow_type(f.dataType) for f in fields[1:]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                done = [Shredder(x or "").run() for x in part.column(1).to_pylist()]
                columns = [part.column(0), *(pa.array([getattr(s, n) for s in done], t) for n, t in types.items())]
                yield pa.record_batch(columns, ["doc", *types])

    return chosen.mapInArrow(run, schema)


def table(shredded: DataFrame, name: str) -> DataFrame:
    """One of the row tables of the shredded documents, keyed by doc."""
    return shredded.select("doc", F.inline(name))
