"""Text rules as column expressions."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages by file extension.
LANGUAGES = {
    "mdx": "mdx", "md": "markdown", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "py": "python",
    "java": "java", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "c": "c", "cs": "csharp", "php": "php", "rb": "ruby", "go": "go", "rs": "rust",
    "swift": "swift", "kt": "kotlin", "scala": "scala", "sh": "bash", "bash": "bash", "ps1": "powershell", "sql": "sql", "html": "html",
    "css": "css", "json": "json", "xml": "xml", "yaml": "yaml", "yml": "yaml",
}
#: Other names of languages in code fences.
FENCE_ALIASES = {"js": "javascript", "ts": "typescript", "py": "python", "sh": "bash", "shell": "bash", "yml": "yaml"}
#: Patterns that tell JSX and diagram content.
JSX = (
    r"<[A-Z][a-zA-Z0-9]*(?:\s[^>]*)?/?>", r"<[a-z]+\s+className=", r"\{[^}]*\}", r"import\s+.*\s+from\s+['\"][^'\"]*['\"]", r"export\s+(default\s+)?",
)
DIAGRAM = (
    r"```mermaid", r"graph\s+(TD|TB|BT|RL|LR)", r"flowchart\s+(TD|TB|BT|RL|LR)", "sequenceDiagram", "classDiagram", "stateDiagram", "erDiagram",
    "journey", "gantt", r"pie\s+title",
)


#: Words one of which each of these patterns needs (in lower case for diagrams): texts without any aren't searched by pattern.
JSX_WORDS = ("<", "{", "import", "export")
DIAGRAM_WORDS = ("```mermaid", "graph", "flowchart", "diagram", "journey", "gantt", "title")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def any_word(text: Column, words: tuple[str, ...]) -> Column:
    return functools.reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def any_match(text: Column, patterns: tuple[str, ...], ignore_case: bool = False) -> Column:
    return text.rlike(("(?i)" if ignore_case else "") + "|".join(f"(?:{p})" for p in patterns))


def has_jsx(text: Column) -> Column:
    return any_word(text, JSX_WORDS) & any_match(text, JSX)


def has_diagram(text: Column) -> Column:
    return bound(F.lower(text), lambda x: any_word(x, DIAGRAM_WORDS)) & any_match(text, DIAGRAM, True)


def trim(text: Column) -> Column:
    return F.regexp_extract(text, r"(?s)^\s*(\S(?:.*\S)?)", 1)


def blank(text: Column) -> Column:
    return ~text.rlike(r"\S")


def basename(path: Column) -> Column:
    """The last part of a path, without its extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def title(content: Column, path: Column) -> Column:
    """The first level-one heading, or else the file's name."""
    heading = F.regexp_extract(content, r"(?m)^[^\S\n]*# +(\S[^\n]*?)[^\S\n]*$", 1)
    return F.when(heading != "", heading).otherwise(basename(path))


def language(content: Column, path: Column) -> Column:
    """By extension, or else mdx, mermaid or markdown by content."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    known = F.try_element_at(table, F.substring(extension(path), 2, 20))
    return F.coalesce(known, F.when(has_jsx(content), "mdx").when(has_diagram(content), "mermaid").otherwise("markdown"))


def fence_language(name: Column) -> Column:
    plain = F.lower(F.trim(name))
    table = F.create_map(*[F.lit(x) for pair in FENCE_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, plain), plain)


def needs_preprocessing(content: Column, kind: Column) -> Column:
    return kind.isin("mdx", "mermaid") | ((kind == "markdown") & has_jsx(content)) | content.contains("```")


def strip_fences(content: Column, mode: str) -> Column:
    """Fenced code: keep it, strip it, or put '[lang code block removed]' in its place."""
    if mode == "keep":
        return content
    if mode == "strip":
        return F.regexp_replace(content, r"```[\s\S]*?```", "")
    out = F.regexp_replace(content, r"```(\w+)[\s\S]*?```", "[$1 code block removed]")
    for short, long in FENCE_ALIASES.items():
        out = F.regexp_replace(out, rf"(?i)\[{short} code block removed\]", f"[{long} code block removed]")
    return F.regexp_replace(out, r"```[\s\S]*?```", "[code block removed]")


def collapse_blank_lines(content: Column) -> Column:
    return trim(F.regexp_replace(content, r"\n\s*\n\s*\n", "\n\n"))


def strip_diagrams(content: Column, mode: str = "strip") -> Column:
    block = r"(?i)```mermaid[\s\S]*?```"
    if mode == "placeholder":
        return collapse_blank_lines(F.regexp_replace(content, block, "[diagram removed]"))
    return bound(collapse_blank_lines(F.regexp_replace(content, block, "")), lambda out: F.when(out == "", "[content removed]").otherwise(out))


def safe_lines(content: Column) -> Column:
    """What stays of content that can't be processed: the lines without markup, imports and exports."""
    plain = ~(content.contains("<") | content.contains("```") | content.contains("import ") | content.contains("export "))
    keep = lambda x: (F.length(trim(x)) > 0) & ~x.contains("<") & ~x.contains("```") & ~x.startswith("import ") & ~x.startswith("export ")
    lines = F.filter(F.split(content, "\n"), keep)
    return F.when(plain, content).when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise("[content could not be processed safely]")


def stats(before: Column, after: Column) -> dict[str, Column]:
    a, b = F.length(before), F.length(after)
    lines = lambda x: F.size(F.split(x, "\n"))
    return {
        "original_length": a, "processed_length": b, "ratio": F.round(F.when(a > 0, b / a).otherwise(F.lit(1.0)), 6),
        "lines_removed": F.greatest(F.lit(0), lines(before) - lines(after)),
    }


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), trim), lambda x: x != "")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), trim), lambda x: x != "")


def word_tokens(text: Column) -> Column:
    """The default token count: words between white space."""
    return F.size(F.array_remove(F.split(text, r"\s+"), ""))


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def snippet(text: Column, longest: int) -> Column:
    """Cut at ``longest`` characters, at the last space if that is beyond 80 % of them, with '...'."""
    head = F.substring(text, 1, longest)
    space = F.lit(longest) - F.instr(F.reverse(head), " ")  # 0-based place of the last space
    at = F.when((F.instr(head, " ") > 0) & (space > longest * 0.8), space).otherwise(F.lit(longest))
    return F.when(F.length(text) <= longest, text).otherwise(F.concat(F.substring(head, F.lit(1), at.cast("int")), F.lit("...")))


def embedding_id(text: Column) -> Column:
    return F.substring(F.sha2(trim(text), 256), 1, 32)
