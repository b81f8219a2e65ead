"""Roles of sections and flags of blocks, from their words and neighbours.

Blocks get ``quoted`` (in a quote or footnote), ``listed`` (in a list, table or
quote), ``example`` (in a section of examples), ``flow`` (an instruction, an
ordered procedure or code to run), ``unclassified`` (code that may be either),
``opaque`` (HTML that may hide a procedure), ``evidence`` (a link, a
measurement or a footnote), ``rationale`` (the languages in which it argues a
decision) and ``rows`` (occupied lines of paragraphs and tables). Sections get a
``role`` with its signal, ``recovery`` (troubleshooting, or inside it),
``decides`` (a decision heading) and their number of unquoted paragraphs.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

from ..functions import lexicons as L

_ASCII = {i: i + 32 for i in range(65, 91)}
_MEASUREMENT = re.compile(L.MEASUREMENT)


@lru_cache(maxsize=None)
def _pattern(phrases: tuple[str, ...]) -> re.Pattern:
    parts = []
    for p in sorted((p.strip().translate(_ASCII) for p in phrases), key=len):
        left = r"(?<!\w)" if re.match("[a-z0-9]", p) else ""
        right = r"(?!\w)" if re.search("[a-z0-9]$", p) else ""
        parts.append(left + re.escape(p) + right)
    return re.compile("|".join(parts))


#: Patterns of the word lists, which live as long as their module.
_OF_LIST: dict[int, re.Pattern] = {}


def _phrases(phrases: Iterable[str]) -> re.Pattern:
    found = _OF_LIST.get(id(phrases))
    if found is None:
        found = _pattern(tuple(phrases))
        if any(phrases is x for x in vars(L).values()) or any(phrases is x for d in (L.DECISION, L.ROLE_HEADINGS) for x in d.values()):
            _OF_LIST[id(phrases)] = found
    return found


def has(text: str, phrases: Iterable[str]) -> bool:
    """Whether a phrase occurs, ASCII case aside; an ASCII letter or digit at its edge must end a word."""
    return bool(text) and _phrases(phrases).search(text.translate(_ASCII)) is not None


def begins(text: str, phrases: Iterable[str]) -> bool:
    return _phrases(phrases).match(text.lstrip().translate(_ASCII)) is not None


def instruction(text: str) -> bool:
    text = text.lstrip()
    for lead in L.INSTRUCTION_LEAD:
        if text[: len(lead)].translate(_ASCII) == lead.translate(_ASCII):
            text = text[len(lead) :]
            break
    return begins(text, L.INSTRUCTION) or has(text, L.INSTRUCTION_ANYWHERE)


def plain_heading(heading: str) -> str:
    return heading.split("{#")[0].strip().rstrip(":：?？").translate(_ASCII)


def heading_role(heading: str) -> str | None:
    text = plain_heading(heading)
    for role, names in L.ROLE_HEADINGS.items():
        if text in names:
            return role
    if begins(text, L.DECISION_START) or begins(text, L.RATIONALE_START):
        return "rationale"
    if has(text, L.TROUBLE_ANYWHERE):
        return "troubleshooting"
    return "background" if text.endswith(" overview") else None


class _Annotator:
    def __init__(self, s) -> None:
        self.s, self.blocks, self.sections = s, s.blocks, s.sections
        self.words: list[list[str]] = [[] for _ in s.blocks]
        self.said: list[list[dict]] = [[] for _ in s.blocks]
        for x in s.sentences:
            self.words[x["block"]].append(x["words"])
            self.said[x["block"]].append(x)
        for b, w in zip(self.blocks, self.words, strict=True):
            b["prose"] = " ".join(w)
        self.children: list[list[int]] = [[] for _ in s.blocks]
        self.before: list[int | None] = []
        last: dict[tuple, int] = {}
        for b in self.blocks:
            if b["parent"] is not None:
                self.children[b["parent"]].append(b["idx"])
            place = (b["section"], b["parent"])
            self.before.append(last.get(place))
            if b["kind"] not in ("comment", "break"):
                last[place] = b["idx"]

    def run(self) -> None:
        self._inherit()
        for s in self.sections:
            above = self.sections[s["parent"]] if s["parent"] is not None else {}
            name = (s["heading"] or "").translate(_ASCII)
            s["_example"] = above.get("_example", False) or has(s["heading"] or "", L.EXAMPLE_HEADING)
            s["_output"] = above.get("_output", False) or name.endswith(" output") or name in L.OUTPUT_HEADING
        for b in self.blocks:
            b["example"] = self.sections[b["section"]]["_example"]
            b["_out"] = b["kind"] == "code" and self._shows_output(b)
            b["_runs"] = b["kind"] == "code" and self._runnable(b)
            b["flow"] = self._flow(b)
            b["unclassified"] = (
                b["kind"] == "code" and not (b["quoted"] or self.sections[b["section"]]["_output"] or b["_out"] or b["_runs"])
                and b["info"] not in ("text", "plaintext", "console") and b["text"].strip() != ""
            )
            b["opaque"] = b["kind"] == "html" and ("```" in b["text"] or "~~~" in b["text"] or re.search("<[A-Z]", b["text"]) is not None)
            if b["kind"] == "paragraph":
                b["rationale"] = sorted({x["language"] for x in self.said[b["idx"]] if has(x["words"], L.DECISION[x["language"]])})
            if b["kind"] in ("paragraph", "table"):
                first = self.s.row(b["start"])
                told = re.split(r"\r\n|\r|\n", self.s.source[b["start"] : b["stop"]].decode("utf-8", "ignore"))
                b["rows"] = [first + k for k, line in enumerate(told) if line.strip()]
        self._evidence()
        self._roles()
        for x in self.s.sentences:
            x["quoted"], x["example"] = self.blocks[x["block"]]["quoted"], self.blocks[x["block"]]["example"]

    def _inherit(self) -> None:
        for b in self.blocks:
            above = self.blocks[b["parent"]] if b["parent"] is not None else {}
            b["quoted"] = b["kind"] in ("quote", "footnote") or above.get("quoted", False)
            b["listed"] = above.get("listed", False) or above.get("kind") in ("list", "table", "quote")
            b["nested"] = above.get("nested", False) or above.get("kind") == "list"

    def _earlier(self, b: dict) -> str:
        """Words of the paragraph right before a block, if there is one."""
        i = self.before[b["idx"]]
        return self.blocks[i]["prose"] if i is not None and self.blocks[i]["kind"] == "paragraph" else ""

    def _shows_output(self, b: dict) -> bool:
        return has(self._earlier(b), L.OUTPUT_CONTEXT) or begins(self.sections[b["section"]]["heading"] or "", L.OUTPUT_START)

    def _runnable(self, b: dict) -> bool:
        lines = (x.strip() for x in b["text"].split("\n"))
        first = next((x for x in lines if x and not x.startswith("#")), None)
        if b["_out"] or first is None or first.startswith("{{"):
            return False
        language = (b["info"] or "").translate(_ASCII)
        if language in L.SHELLS:
            return True
        if language == "console":
            return first.startswith(("$ ", "> ", "PS> "))
        return instruction(self._earlier(b))

    def _flow(self, b: dict) -> bool:
        if b["quoted"] or self.sections[b["section"]]["_output"]:
            return False
        if b["kind"] == "code":
            return b["_runs"]
        if b["kind"] == "paragraph":
            return instruction(b["prose"])
        if b["kind"] == "list" and b["ordered"]:
            item = next(iter(self.children[b["idx"]]), None)
            inner = next(iter(self.children[item]), None) if item is not None else None
            return inner is not None and self.blocks[inner]["kind"] == "paragraph" and instruction(self.blocks[inner]["prose"])
        return False

    def _evidence(self) -> None:
        linked = {x["block"] for x in self.s.links if not x["image"]}
        for b in reversed(self.blocks):  # children follow their parents
            told = b["idx"] in linked
            if not b["quoted"]:
                for x in self.said[b["idx"]]:
                    text = " ".join(r["text"] for r in x["coded"])
                    told = told or _MEASUREMENT.search(text) is not None or has(text, L.EVIDENCE) or any(f["kind"] == "text" and "[^" in f["text"] for f in x["fragments"])
            b["evidence"] = told or any(self.blocks[c]["evidence"] for c in self.children[b["idx"]])

    def _roles(self) -> None:
        direct: list[list[dict]] = [[] for _ in self.sections]
        for b in self.blocks:
            if not b["quoted"]:
                direct[b["section"]].append(b)
        for s in self.sections:
            own = direct[s["idx"]]
            name = " ".join(b["prose"] for b in own if b["kind"] == "heading")
            content = [b for b in own if b["kind"] != "heading"]
            s["role"], s["signal"], span = "other", None, (None, None)
            if plain_heading(name) not in L.EXERCISE_HEADINGS:
                s["role"], s["signal"], span = self._role(s, name, content)
            s["signal_start"], s["signal_stop"] = span
            s["paragraphs"] = sum(b["kind"] == "paragraph" for b in own)
            head = plain_heading(s["heading"] or "")
            s["decides"] = head in L.DECISION_HEADINGS or begins(head, L.DECISION_START)
            above = self.sections[s["parent"]] if s["parent"] is not None else {}
            s["recovery"] = s["role"] == "troubleshooting" or above.get("recovery", False)

    def _role(self, s: dict, name: str, content: list[dict]) -> tuple[str, str | None, tuple]:
        """The first signal that applies, from headings to prose."""
        role = heading_role(name)
        at = (s["head_start"], s["head_stop"]) if s["heading"] is not None else (s["start"], s["stop"])
        span = lambda b: (b["start"], b["stop"])
        if role in ("troubleshooting", "rationale"):
            return role, "heading", at
        plain = plain_heading(s["heading"] or "")
        if role == "reference" or plain.endswith("()") and " " not in plain:
            return "reference", "reference_heading", at
        if told := next((b for b in content if self._reference(b)), None):
            return "reference", "reference_content", span(told)
        paragraphs = [b for b in content if b["kind"] == "paragraph"]
        navigation = any(b["kind"] == "list" for b in content) and all(self._points(b) for b in paragraphs)
        if role == "background" and not navigation:
            return "background", "heading", at
        if step := next((b for b in content if b["flow"]), None):
            return "steps", "runnable_example" if step["kind"] == "code" else "instruction", span(step)
        if role == "steps":
            return "steps", "heading", at
        if choice := next((b for b in paragraphs if b["rationale"]), None):
            return "rationale", "decision_prose", span(choice)
        if not navigation and len(paragraphs) >= 2 and sum(len(b["prose"]) for b in paragraphs) >= 160:
            return "background", "explanatory_prose", span(paragraphs[0])
        return "other", None, (None, None)

    def _reference(self, b: dict) -> bool:
        if b["kind"] == "table":
            return True
        told = b["kind"] == "paragraph" and (begins(b["prose"], L.REFERENCE_START) or has(b["prose"], L.REFERENCE_ANYWHERE))
        return told and any(f["kind"] == "inline_code" for x in self.said[b["idx"]] for f in x["fragments"])

    def _points(self, b: dict) -> bool:
        """Whether each sentence of a paragraph is a link or leads to one."""
        said = self.said[b["idx"]]
        return bool(said) and all(any(f["kind"] == "link_text" for f in x["fragments"]) or begins(x["words"], L.NAVIGATION_START) for x in said)


def annotate(shredder) -> None:
    _Annotator(shredder).run()
