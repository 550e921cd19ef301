"""MDX and diagram text: rules that need loops or a line grammar, applied in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is taken out of MDX, in this order, and what it is called.
MDX_RULES = (
    ("import", r"^import\s+.*?from\s+['\"][^'\"]*['\"];?\s*$", re.M),
    ("export", r"^export\s+default\s+function[^{]*\{[\s\S]*?\n\}\s*$", re.M),
    ("export", r"^export\s+const\s+[^=]*=\s*\{[\s\S]*?\}\s*;?\s*$", re.M),
    ("export", r"^export\s+(?:default\s+)?(?:const|let|var|function|class)\s+[^;{]*;?\s*$", re.M),
    ("export", r"^export\s+default\s+[^;{]*;?\s*$", re.M),
    ("component", r"<[A-Z][a-zA-Z0-9]*[^>]*/>", 0),
    ("component", r"<[A-Z][a-zA-Z0-9]*[^>]*>.*?</[A-Z][a-zA-Z0-9]*>", re.S),
)
#: Lines of diagrams that are layout or style.
LAYOUT = (
    r"^(graph|flowchart)\s+(TD|TB|BT|RL|LR)", r"^(sequenceDiagram|classDiagram|stateDiagram|erDiagram|journey|gantt)", r"^pie\s+title",
    r"^direction\s+(TD|TB|BT|RL|LR)", r"^subgraph", r"^end$",
)
STYLE = (r"^classDef\s+", r"^class\s+.*\s+\w+$", r"^style\s+", r"^fill:", r"^stroke:", r"^color:", r":::.*$", r"^linkStyle\s+", r"^click\s+")
#: What the marks between two names say, by the word that a diagram begins with (flowcharts: any other).
FLOW_WORDS = {
    "-->": "leads to", "-.->": "optionally leads to", "---": "connects to", "-.-": "optionally connects to", "->": "relates to", "--": "relates to",
}
MARK_WORDS = {
    "sequenceDiagram": dict.fromkeys(("-->>+", "->>+", "-->+", "->+", "-->>", "->>", "-->", "->"), "sends to"),
    "classDiagram": {
        "--|>": "inherits from", "<|--": "is inherited by", "--|": "relates to", "<|--|>": "has bidirectional inheritance with", "*--": "composes",
        "--*": "is composed by", "o--": "aggregates", "--o": "is aggregated by",
    },
    "stateDiagram": {"-->": "transitions to"},
    "erDiagram": {
        "||--o{": "has one-to-many relationship with", "}o--||": "has many-to-one relationship with", "||--||": "has one-to-one relationship with",
        "o{--||": "has many-to-one relationship with",
    },
}

_skip = re.compile("|".join(LAYOUT + STYLE), re.I)
#: A name, and the text in the brackets that give its node's shape.
_operand = re.compile(r"(?P<name>\w+)(?P<shape>\[[^\]]+\]|\{[^}]+\}|\(\([^)]+\)\)|\([^)]+\))?")


def collapse(text: str) -> str:
    return re.sub(r"\n\s*\n\s*\n", "\n\n", text).strip()


def mdx(text: str, placeholder: bool = False) -> str:
    """Without imports, exports and components; with ``placeholder`` a note stands in for each. What a removal brings together is looked at again."""
    for kind, pattern, flags in MDX_RULES:
        found, note = 1, f"[{kind} removed]" * placeholder
        while found:
            text, found = re.subn(pattern, note, text, flags=flags)
    return collapse(text) or "[content removed]" * (not placeholder)


class Line:
    """A line of a diagram, read from left to right: operands, and the marks between them."""

    def __init__(self, line: str) -> None:
        self.line, self.operands = line, list(_operand.finditer(line))

    def labels(self) -> Iterator[tuple[str, str]]:
        return ((m["name"], m["shape"].strip("[](){}").strip()) for m in self.operands if m["shape"])

    def shown(self, start: int, end: int, labels: dict[str, str]) -> str:
        """What a part of the line is called: its first label, or its first name's label elsewhere, or that name."""
        inside = [m for m in self.operands if start <= m.start() and m.end() <= end]
        own = next((label for m in inside for name, label in self.labels() if m["shape"] and m["name"] == name), None)
        return own or next((labels.get(m["name"], m["name"]) for m in inside), self.line[start:end].strip())

    def flow(self, labels: dict[str, str]) -> str | None:
        """The first two operands with a mark between them; what stands between bars, after the mark or at the end, is the edge's label."""
        for left, right in zip(self.operands, self.operands[1:], strict=False):
            gap = self.line[left.end() : right.start()]
            mark = next((m for m in sorted(FLOW_WORDS, key=len, reverse=True) if gap.lstrip().startswith(m)), None)
            if mark is None:
                continue
            start, end, note = left.end() + gap.index(mark) + len(mark), len(self.line), ""
            bars = [k for k in range(start, end) if self.line[k] == "|"]
            if len(bars) == 1:
                return None
            if bars:
                note = f" ({self.line[bars[0] + 1 : bars[1]].strip()})"
                start, end = (bars[1] + 1, end) if not self.line[start : bars[0]].strip() else (start, bars[0])
            return f"{self.shown(left.start(), left.end(), labels)} {FLOW_WORDS[mark]} {self.shown(start, end, labels)}{note}"
        return None

    def relation(self, kind: str) -> str | None:
        """Two plain names with one of the kind's marks between them."""
        words = MARK_WORDS[kind]
        at, _, mark = min(((self.line.index(m), -len(m), m) for m in words if m in self.line), default=(0, 0, ""))
        left, right = re.search(r"\w+$", self.line[:at].rstrip()), re.match(r"\w+", self.line[at + len(mark) :].lstrip())
        if not mark or not left or not right:
            return None
        said = f"{left[0]} {words[mark]} {right[0]}"
        rest = self.line[at + len(mark) :].lstrip()[right.end() :].strip()
        if kind == "sequenceDiagram":
            return f"{said}: {rest[1:].strip()}" if rest.startswith(":") and rest[1:].strip() else None
        alone = left[0] == self.line[:at].strip() and not rest
        return None if kind == "stateDiagram" and not alone else said


def diagram_edges(diagram: str) -> list[str]:
    """The relations that a diagram draws, as sentences."""
    lines = [Line(x) for raw in diagram.split("\n") if (x := raw.strip()) and not x.startswith("%")]
    kind = next((k for k in MARK_WORDS if lines and k in lines[0].line), None)
    labels = {} if kind else dict(pair for x in lines for pair in x.labels())
    said = (x.relation(kind) if kind else x.flow(labels) for x in lines if not _skip.search(x.line))
    return [x for x in said if x]


BLOCK = r"```mermaid([\s\S]*?)```"


def said(diagram: str) -> str:
    return "\n".join(diagram_edges(diagram)) or "[diagram content extracted]"


def diagrams(text: str) -> str:
    """Fenced diagrams replaced by their relations."""
    return re.sub(BLOCK, lambda m: said(m[1]), text, flags=re.I | re.A)


def _column(function: Callable[[str], str]) -> Callable[[Column], Column]:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(function, na_action="ignore")

    return run


def mdx_column(text: Column, placeholder: bool = False) -> Column:
    return _column(lambda t: mdx(t, placeholder))(text)


def diagrams_column(text: Column) -> Column:
    """As ``diagrams``; Python gets the diagrams alone, not the texts around them."""

    @F.pandas_udf("array<string>")
    def run(found: pd.Series) -> pd.Series:
        return found.map(lambda xs: [said(x) for x in xs], na_action="ignore")

    around = F.split(text, rf"(?i){BLOCK}", -1)
    return F.array_join(F.zip_with(around, run(F.regexp_extract_all(text, F.lit(rf"(?i){BLOCK}"), F.lit(1))), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


#: What each mode does with MDX, diagrams and code.
MODES = {"strict": ("strip", "strip", "strip"), "balanced": ("placeholder", "placeholder", "keep"), "rich": ("keep", "extract", "keep")}


def processed(content: Column, kind: Column, mode: str = "balanced", needed: Column | None = None, **overrides: str) -> Column:
    """Content as the mode wants it: MDX first, then diagrams, then fenced code; blank if nothing is left. ``needed``: ``needs_preprocessing`` of both, if it is known."""
    from tesserae.functions import text as rules

    x, d, c = (overrides.get(k, v) for k, v in zip(("mdx", "mermaid", "code"), MODES[mode], strict=True))
    is_mdx = (kind == "mdx") | ((kind == "markdown") & rules.has_jsx(content))
    needed = rules.needs_preprocessing(content, kind) if needed is None else needed
    only = lambda flag, column: F.when(needed & flag, column)  # noqa: E731 - Python gets the texts that it is to work on
    out = content if x == "keep" else F.when(is_mdx, mdx_column(only(is_mdx, content), x == "placeholder")).otherwise(content)
    if d != "keep":
        drawn = rules.has_diagram(content)
        done = diagrams_column(only(drawn, out)) if d == "extract" else rules.strip_diagrams(out, d)
        out = F.when(drawn, done).otherwise(out)
    out = rules.strip_fences(out, c)
    return F.when(needed, out).otherwise(content)


def preprocess(content: Column, kind: Column, mode: str = "balanced", needed: Column | None = None, **overrides: str) -> Column:
    """As ``processed``, but never blank: a note stands for content of which nothing is left."""
    from tesserae.functions import text as rules

    out = processed(content, kind, mode, needed, **overrides)
    return rules.bound(out, lambda o: F.when(rules.blank(o), "[content processed but empty]").otherwise(o))
