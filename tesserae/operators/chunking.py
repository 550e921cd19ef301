"""Splitting documents into overlapping chunks: paragraphs, sentence groups, then packing; long sentences fall back to words.

The folds carry word counts and indices, so they run in Arrow batches with any token counter; counting words is the default.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from tesserae.operators import embedding

Count = Callable[[str], int]
#: Bytes of texts that are chunked at a time, unless a single one has more.
PART = 1 << 20


def count_words(text: str) -> int:
    return len(text.split())


#: A counter with this attribute adds up: joined parts have the sum of their tokens, less this many for each part but the first.
count_words.overhead = 0


@dataclass(frozen=True)
class ChunkConfig:
    size: int = 250
    overlap: int = 50

    def __post_init__(self) -> None:
        if not 0 <= self.overlap < self.size:
            raise ValueError("overlap must be at least 0 and below the chunk size")


def split_paragraphs(text: str) -> list[str]:
    return [p for x in re.split(r"\n\s*\n", text) if (p := x.strip())]


def split_sentences(text: str) -> list[str]:
    return [s for x in re.split(r"(?<=[.!?])\s+", text) if (s := x.strip())]


class Remembered:
    """A counter that is asked about each string of a document once."""

    def __init__(self, count: Count) -> None:
        self.count, self.known, self.overhead = count, {}, getattr(count, "overhead", None)

    def __call__(self, text: str) -> int:
        if text not in self.known:
            self.known[text] = self.count(text)
        return self.known[text]

    def told(self, joined: Joined) -> str:
        """The text of joined parts, whose tokens are known if they add up."""
        text = joined.text()
        if self.overhead is not None:
            self.known[text] = joined.tokens
        return text


class Joined:
    """Parts joined by one string, and their tokens. A counter that adds up (``overhead``) is asked about each part, any other about the whole."""

    def __init__(self, glue: str, count: Count) -> None:
        self.glue, self.count, self.parts, self.tokens = glue, count, [], 0
        self.overhead: int | None = getattr(count, "overhead", None)

    def with_(self, part: str, size: int) -> int:
        """The tokens of all parts with one more, which has ``size`` itself."""
        if self.overhead is None:
            return self.count(self.glue.join([*self.parts, part]))
        return self.tokens + size - self.overhead if self.parts else size

    def add(self, part: str, tokens: int) -> None:
        self.parts.append(part)
        self.tokens = tokens

    def text(self) -> str:
        return self.glue.join(self.parts)

    def tail(self, most: int, together: bool) -> Joined:
        """The longest run of last parts within ``most`` tokens, counted together or each for itself."""
        out, n, total = Joined(self.glue, self.count), len(self.parts), 0
        while n:
            part = self.parts[n - 1]
            if together and self.overhead is None:
                total = self.count(self.glue.join(self.parts[n - 1 :]))
            else:
                total += self.count(part) - (self.overhead if together and n < len(self.parts) else 0)
            if total > most:
                break
            n, out.tokens = n - 1, total
        out.parts = self.parts[n:]
        return out


def split_words(text: str, size: int, overlap: int, count: Count = count_words) -> list[str]:
    """Runs of words of up to ``size`` tokens; each begins with the last words of the one before, up to ``overlap`` tokens. A single longer word is a chunk.

    Where the overlap and the next word would not fit together, the overlap is dropped, so the split always moves on.
    """
    told = getattr(count, "told", Joined.text)
    words, out, now, carried = text.split(), [], Joined(" ", count), 0
    i = 0
    while i < len(words):
        tokens = now.with_(words[i], 0 if now.overhead is None else count(words[i]))
        if tokens <= size:
            now.add(words[i], tokens)
            i += 1
        elif len(now.parts) > carried:
            out.append(told(now))
            now = now.tail(overlap, True) if overlap else Joined(" ", count)
            carried = len(now.parts)
        elif now.parts:
            now, carried = Joined(" ", count), 0
        else:
            out.append(words[i])
            i += 1
    return [*out, told(now)] if now.parts else out


def segments(text: str, size: int, count: Count = count_words) -> list[str]:
    """Paragraphs that fit, and groups of sentences of those that don't; a sentence that doesn't fit stands alone."""
    told = getattr(count, "told", Joined.text)
    out: list[str] = []
    for paragraph in split_paragraphs(text):
        if count(paragraph) <= size:
            out.append(paragraph)
            continue
        group = Joined(" ", count)
        for sentence in split_sentences(paragraph):
            own = count(sentence)
            if own > size or (group.parts and group.with_(sentence, own) > size):
                out += [told(group)] * bool(group.parts)
                group = Joined(" ", count)
            if own > size:
                out.append(sentence)
            else:
                group.add(sentence, group.with_(sentence, own))
        out += [told(group)] * bool(group.parts)
    return out


def pack(parts: list[str], config: ChunkConfig, count: Count = count_words) -> list[str]:
    """Segments joined by blank lines up to the size. The next chunk begins with the last sentences of the one before, which may push it over the size."""
    told = getattr(count, "told", Joined.text)
    out: list[str] = []
    now = Joined("\n\n", count)
    for part in parts:
        own = count(part)
        if own > config.size:
            out += [told(now)] * bool(now.parts)
            out += split_words(part, config.size, config.overlap, count)
            now = Joined("\n\n", count)
            continue
        if now.parts and now.with_(part, own) > config.size:
            out.append(told(now))
            said = Joined(" ", count)
            said.parts = split_sentences(out[-1]) if config.overlap else []
            kept = said.tail(config.overlap, False)
            now = Joined("\n\n", count)
            if kept.parts:
                now.add(kept.text(), count(kept.text()))
        now.add(part, now.with_(part, own))
    return out + [told(now)] * bool(now.parts)


def chunk_text(text: str | None, config: ChunkConfig, count: Count = count_words) -> list[str]:
    return [c for c, _ in counted_chunks(text, config, count)]


def counted_chunks(text: str | None, config: ChunkConfig, count: Count = count_words) -> list[tuple[str, int]]:
    """Chunks and their tokens."""
    count = Remembered(count)
    return [(c, count(c)) for c in pack(segments(text or "", config.size, count), config, count)]


def chunk(docs: DataFrame, key: str, text: str = "text", config: ChunkConfig | None = None, kind: str | None = None, count: Count = count_words, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, chunk_index, content, token_count, columns to ``keep``), a row per chunk. Rows whose content type (column ``kind``) is image are one chunk each.

    A counter with a method ``prepare`` is told the texts to come, some at a time.
    """
    config = config or ChunkConfig()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in embedding.portions(whole, text, 10_000, PART):
                keys, texts = batch.column(0), batch.column(1).to_pylist()
                kinds = batch.column(2).to_pylist() if kind else ["text"] * len(texts)
                getattr(count, "prepare", len)(texts)
                each = [[(t, count(t))] * bool(t) if k == "image" else counted_chunks(t, config, count) for t, k in zip(texts, kinds, strict=True)]
                flat = [c for cs in each for c in cs]
                rows = pa.array([i for i, cs in enumerate(each) for _ in cs], pa.int64())
                index = [i for cs in each for i in range(len(cs))]
                columns = [keys.take(rows), pa.array(index, pa.int32()), pa.array([c for c, _ in flat], pa.string()), pa.array([n for _, n in flat], pa.int32())]
                columns += [batch.column(len(batch.columns) - len(keep) + i).take(rows) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "chunk_index", "content", "token_count", *keep])

    kinds_ = dict(docs.dtypes)
    columns = [key, text, *([kind] if kind else []), *keep]
    return docs.select(*columns).mapInArrow(run, ", ".join([f"`{key}` {kinds_[key]}, chunk_index int, content string, token_count int", *[f"`{k}` {kinds_[k]}" for k in keep]]))
