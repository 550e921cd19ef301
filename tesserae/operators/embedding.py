"""Embedding functions. The default hashes words: it needs no model, isn't semantic, and gives the same vectors everywhere."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

Embed = Callable[[list[str]], np.ndarray]


_word, _between = re.compile(r"[a-z0-9]+"), re.compile(r"[^a-z0-9]")
#: Characters whose words are counted at a time, in a long text or in several texts.
PART = 1 << 18


def _places(words: Iterable[str], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each word counts, and with which sign. Nothing is kept: a corpus has more rare words than a cache holds."""
    digests = np.frombuffer(b"".join(hashlib.md5(w.encode()).digest() for w in words), np.uint8).reshape(-1, 16)
    return digests[:, :4].copy().view(">u4").ravel().astype(np.int64) % dim, np.where(digests[:, 4] >> 4 & 1, -1.0, 1.0)


def _words(text: str) -> Counter[str]:
    """How often each word occurs; a long text's words are never in memory all at once."""
    text, out, at = text.lower(), Counter(), 0
    while at < len(text):
        end = _between.search(text, at + PART) if len(text) - at > PART else None
        to = end.start() if end else len(text)
        out.update(_word.findall(text, at, to))
        at = to
    return out


def _blocks(texts: list[str]) -> Iterator[slice]:
    """Consecutive texts of about ``PART`` characters together, a text at least."""
    at = size = 0
    for k, text in enumerate(texts, 1):
        size += len(text or "")
        if size >= PART or k == len(texts):
            yield slice(at, k)
            at, size = k, 0


def hash_embed(texts: list[str], dim: int = 64) -> np.ndarray:
    """Signed counts of hashed words, divided by their length. A text without words is the zero vector."""
    out = np.zeros((len(texts), dim))
    for block in _blocks(texts):
        said = [_words(text or "") for text in texts[block]]
        known = {word: k for k, word in enumerate(dict.fromkeys(word for words in said for word in words))}
        if known:
            at, sign = _places(known, dim)
            word = np.fromiter((known[w] for words in said for w in words), np.int64)
            times = np.fromiter((n for words in said for n in words.values()), np.float64)
            np.add.at(out[block], (np.repeat(np.arange(len(said)), [len(words) for words in said]), at[word]), sign[word] * times)
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, norm, out=out, where=norm > 0)


#: How many texts and how many images a function gets at a time.
BATCHES = {"text": 256, "image": 4}


#: Bytes that a function gets at a time, unless a single text or image has more.
MOST_BYTES = 4 << 20


def portions(rows: pa.RecordBatch, column: str, most: int, most_bytes: int = MOST_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows, up to ``most`` and ``most_bytes`` bytes of a column at a time, a row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(rows.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < rows.num_rows:
        full = int(np.searchsorted(size, (size[at - 1] if at else 0) + most_bytes, "right"))
        to = min(max(full, at + 1), at + most)
        yield rows.slice(at, to - at)
        at = to


def embed(rows: DataFrame, text: str, function: Embed = hash_embed, column: str = "embedding", batch: int = BATCHES["text"], keep: bool = True) -> DataFrame:
    """The input with a vector per row; ``function`` gets lists of up to ``batch`` texts of ``MOST_BYTES`` together, or bytes if the column holds these. A batch that fails is
    tried text by text; a text that fails has a null vector and the error's text in ``embedding_error``. ``keep``: whether the text's column stays."""

    kinds = dict(rows.dtypes)
    nothing = b"" if kinds[text] == "binary" else ""
    stay = [n for n in rows.columns if keep or n != text]

    def one(text: str) -> tuple[np.ndarray | None, str | None]:
        try:
            return function([text])[0], None
        except Exception as e:  # any model's error is the row's, not the job's
            return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in portions(b, text, batch):
                texts = [t or nothing for t in part.column(text).to_pylist()]
                try:
                    made = [(v, None) for v in function(texts)]
                except Exception:
                    made = [one(t) for t in texts]
                vectors = pa.array([None if v is None else np.asarray(v, np.float64) for v, _ in made], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*map(part.column, stay), vectors, pa.array([e for _, e in made], pa.string())], names=[*stay, column, f"{column}_error"])

    schema = ", ".join(f"`{n}` {kinds[n]}" for n in stay) + f", `{column}` array<double>, `{column}_error` string"
    return rows.mapInArrow(run, schema)
