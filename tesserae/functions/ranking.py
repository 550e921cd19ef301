"""Reranking scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the lexical score.
DEFINITIONS = ("{} is a", "{} is an", "{} is the", "{} provides", "{} helps")
INTRODUCTIONS = ("introduction", "what is", "overview", "about", "definition", "# introduction")
#: Fixed values of the filename score.
KEYWORD_BOOSTS = {
    "api": 1.2, "architecture": 1.3, "design": 1.2, "implementation": 1.2, "configuration": 1.2, "setup": 1.2, "guide": 1.2, "tutorial": 1.2,
    "example": 1.1, "demo": 1.1, "visual": 1.3, "overview": 1.2, "flow": 1.3, "process": 1.2, "workflow": 1.3,
}
PATTERN_BOOSTS = {"diagram": 1.5, "chart": 1.4, "graph": 1.4, "image": 1.2, "screenshot": 1.3, "figure": 1.3}
#: Fixed values of the content type score.
TYPE_SCORES = {"image": 0.8, "text": 1.0, "pdf": 0.9, "docx": 0.9}
VISUAL_WORDS = ("diagram", "chart", "graph", "image", "visual", "screenshot", "figure", "illustration", "visualization")
DOCUMENT_WORDS = ("documentation", "guide", "tutorial", "explanation", "description", "details")


def _number(flag: Column, value: float) -> Column:
    return F.when(F.coalesce(flag, F.lit(False)), F.lit(value)).otherwise(F.lit(0.0))


def long_words(text: Column, separators: str = r"\s+") -> Column:
    return F.filter(F.split(F.lower(text), separators), lambda w: F.length(w) > 2)


def lexical_bonus(query: Column, text: Column, title: Column, source: Column) -> Column:
    q, t, h = F.lower(query), F.lower(text), F.lower(F.coalesce(title, F.lit("")))
    out = _number(t.contains(q), 0.15) + _number(h.contains(q), 0.10)
    subject = F.regexp_replace(F.trim(F.regexp_replace(q, "^what is", "")), r"\?$", "")
    defined = F.lit(False)
    for form in DEFINITIONS:
        defined = defined | t.contains(F.concat(subject, F.lit(form.format(""))))
    out = out + _number(q.startswith("what is") & defined, 0.3)
    words = long_words(query)
    hits = F.aggregate(words, F.lit(0.0), lambda s, w: s + _number(t.contains(w), 1.0) + _number(h.contains(w), 0.5))
    out = out + F.when(F.size(words) > 0, hits / F.size(words) * F.lit(0.1)).otherwise(F.lit(0.0))
    for word in INTRODUCTIONS:
        out = out + _number(t.contains(word) | h.contains(word), 0.08)
    return out + _number(F.lower(source).contains("intro"), 0.1)


def lexical_score(score: Column, query: Column, text: Column, title: Column, source: Column) -> Column:
    return F.least(F.lit(1.0), score + lexical_bonus(query, text, title, source))


def filename_score(query: Column, name: Column) -> Column:
    q, n = F.lower(query), F.lower(name)
    words, parts = long_words(query), long_words(name, r"[_\-\s\.]+")
    pairs = F.aggregate(
        words, F.lit(0.0), lambda s, w: s + F.size(F.filter(parts, lambda p: p.contains(w) | w.contains(p))) * F.lit(0.3)
    )
    out = _number(n.contains(q), 1.0) + pairs
    for word, boost in (*KEYWORD_BOOSTS.items(), *PATTERN_BOOSTS.items()):
        out = out * F.when(n.contains(word), F.lit(boost)).otherwise(F.lit(1.0))
    return F.least(out, F.lit(2.0))


def type_score(query: Column, kind: Column) -> Column:
    q = F.lower(query)
    base = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TYPE_SCORES.items() for x in kv]), kind), F.lit(0.5))
    says = lambda words: q.rlike("|".join(words))
    visual = F.when((kind == "image") & says(VISUAL_WORDS), F.lit(2.0)).otherwise(F.lit(1.0))
    textual = F.when(kind.isin("text", "pdf", "docx") & says(DOCUMENT_WORDS), F.lit(1.8)).otherwise(F.lit(1.0))
    return base * visual * textual


def metadata_score(query: Column, fields: list[Column], tags: Column, width: Column, height: Column, size: Column) -> Column:
    """``fields``: text columns (title, description, category, type); ``tags``: an array."""
    q = F.lower(query)
    out = F.lit(0.0)
    for f in fields:
        v = F.lower(f)
        hits = F.size(F.filter(long_words(query), lambda w: v.contains(w)))  # noqa: B023
        out = out + F.when(f.isNotNull(), _number(v.contains(q), 0.5) + hits * F.lit(0.2)).otherwise(F.lit(0.0))
    out = out + F.coalesce(F.size(F.filter(tags, lambda t: F.lower(t).contains(q))) * F.lit(0.3), F.lit(0.0))
    out = out + _number(width * height > 500_000, 0.5) - _number((size > 0) & (size < 1000), 0.1)
    return F.greatest(out, F.lit(0.0))


def combined_score(score: Column, filename: Column, kind: Column, metadata: Column) -> Column:
    return F.lit(0.4) * score + F.lit(0.6) * (F.lit(0.4) * filename + F.lit(0.3) * kind + F.lit(0.3) * metadata)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))
