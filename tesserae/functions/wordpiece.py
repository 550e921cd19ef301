"""WordPiece token counts for a given vocabulary, as encoders of sentences count them: lower case, without accents, special tokens included.

A word becomes its longest prefix in the vocabulary, then the longest ``##`` piece of what is left, and so on; a word that can't be cut up so
is one unknown token. Texts are split at blanks; counts of the strings between them are remembered. All new distinct words of a text go down a trie at once, a character a step, in numpy; a trie's edge is found by
bisection among (node, character) keys.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.operators import embedding

#: Longer words are unknown; a text begins and ends with a special token; blocks of ideographs, each of which is a word.
MOST_CHARS, SPECIALS = 100, 2
IDEOGRAPHS = (
    (0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B920, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F),
)
#: Distinct words whose counts a task remembers, characters that are cut up at a time, and entries that a vocabulary may have.
REMEMBERED, PART, MOST_ENTRIES = 200_000, 1 << 20, 1 << 22
#: What ``str.split`` takes for blanks, but is nothing here.
NO_BLANKS = "\x0b\x0c\x1c\x1d\x1e\x1f\x85"
_NOTHING = dict.fromkeys(map(ord, NO_BLANKS))
_NODE = 0x110000


class _Cleaned(dict):
    """What a character becomes before accents are split off: nothing, a blank, a word of its own or itself."""

    def __missing__(self, point: int) -> str | int | None:
        c = chr(point)
        if c not in "\t\n\r" and (point == 0xFFFD or unicodedata.category(c)[0] == "C"):
            out = None
        elif c.isspace():
            out = " "
        else:
            out = f" {c} " if any(a <= point <= b for a, b in IDEOGRAPHS) else point
        self[point] = out
        return out


class _Folded(dict):
    """What it becomes then: nothing (an accent), a word of its own (punctuation) or lower case."""

    def __missing__(self, point: int) -> str | None:
        c = chr(point)
        kind = unicodedata.category(c)
        mark = kind[0] == "P" or c.isascii() and c.isprintable() and not c.isalnum() and c != " "
        out = None if kind == "Mn" else f" {c} " if mark else c.lower()
        self[point] = out
        return out


_CLEANED, _FOLDED = _Cleaned(), _Folded()


def words(text: str) -> list[str]:
    """The words of a text: lower case, no accents or control characters, each mark and ideograph for itself."""
    clean = text.translate(_CLEANED)
    return (clean if clean.isascii() else unicodedata.normalize("NFD", clean)).translate(_FOLDED).split()


def parts(text: str, size: int = PART) -> Iterator[str]:
    """The text in parts of about ``size`` characters that end before a blank, so that a long text's words are never in memory all at once."""
    at = 0
    while len(text) - at > size:
        to = max(text.rfind(c, at + 1, at + size) for c in " \n\t")
        if to < 0:
            ends = [x for c in " \n\t" if (x := text.find(c, at + size)) >= 0]
            to = min(ends, default=len(text))
        yield text[at:to]
        at = to
    yield text[at:]


class WordPiece:
    """A counter for texts; also one for the chunker, as counts of parts add up but for the special tokens (``overhead``)."""

    overhead = SPECIALS

    def __init__(self, vocabulary: Iterable[str]) -> None:
        """``vocabulary``: pieces, those inside words beginning with ``##``. Special tokens in it do no harm, as their marks are words of their own."""
        edges: dict[int, int] = {}
        final, entries = [False, False], 0
        for piece in vocabulary:
            entries += 1
            if entries > MOST_ENTRIES:
                raise ValueError(f"a vocabulary of over {MOST_ENTRIES} entries is not sent to the tasks")
            inside = piece.startswith("##") and len(piece) > 2
            node = 1 if inside else 0
            for c in piece[2:] if inside else piece:
                key = node * _NODE + ord(c)
                node = edges.setdefault(key, len(final))
                if node == len(final):
                    final.append(False)
            final[node] = node > 1
        self.keys = np.array(sorted(edges) or [-1], np.int64)
        self.targets = np.array([edges.get(k, 0) for k in self.keys.tolist()], np.int64)
        self.final = np.array(final)
        self.known: dict[str, int] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def pieces(self, said: list[str]) -> np.ndarray:
        """The number of pieces of each word."""
        length = np.fromiter(map(len, said), np.int64, len(said))
        count = np.where(length > MOST_CHARS, 1, 0)
        flat = np.frombuffer("".join(said).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        end = np.cumsum(length)
        begin = end - length
        at, last, node = begin.copy(), begin.copy(), np.zeros(len(said), np.int64)
        left = np.flatnonzero((length > 0) & (length <= MOST_CHARS))
        while left.size:
            key = node[left] * _NODE + flat[np.minimum(at[left], flat.size - 1)]
            edge = np.minimum(np.searchsorted(self.keys, key), self.keys.size - 1)
            found = (at[left] < end[left]) & (self.keys[edge] == key)
            on = left[found]
            node[on] = self.targets[edge[found]]
            at[on] += 1
            whole = on[self.final[node[on]]]
            last[whole] = at[whole]
            stuck = left[~found]
            cut = last[stuck] > begin[stuck]
            count[stuck[~cut]] = 1
            again = stuck[cut]
            count[again] += 1
            begin[again] = at[again] = last[again]
            node[again] = 1
            left = np.concatenate([on, again[begin[again] < end[again]]])
        return count

    def _of(self, said: list[str]) -> list[int]:
        """The number of pieces of what stands between blanks, a few words each."""
        split = [[w.lower()] if w.isascii() and w.isalnum() else words(w) for w in said]
        each = list(dict.fromkeys(w for ws in split for w in ws))
        number = dict(zip(each, self.pieces(each).tolist(), strict=True))
        return [sum(map(number.__getitem__, ws)) for ws in split]

    def _remember(self, said: set[str]) -> None:
        new = list(said.difference(self.known))
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = {}, list(said)
        self.known.update(zip(new, self._of(new), strict=True))

    def prepare(self, texts: list[str | None]) -> None:
        """Cuts up the words of several texts at once, which takes far less time than text by text. Texts of ``PART`` characters together are looked at."""
        said, left = set(), PART
        for text in texts:
            if text and len(text) <= left:
                left -= len(text)
                said.update(w for w in text.translate(_NOTHING).split() if len(w) <= MOST_CHARS)
        self._remember(said)

    def _counted(self, said: list[str]) -> int:
        """The pieces of what stands between blanks; those of short strings are remembered."""
        try:
            return sum(map(self.known.__getitem__, said))
        except KeyError:
            short = [w for w in said if len(w) <= MOST_CHARS]
        self._remember(set(short))
        return sum(map(self.known.__getitem__, short)) + sum(self._of([w for w in said if len(w) > MOST_CHARS]))

    def __call__(self, text: str | None) -> int:
        """Tokens of a text, special ones included; 0 for null and the empty text."""
        if not text:
            return 0
        if any(c in text for c in NO_BLANKS):
            text = text.translate(_NOTHING)
        if len(text) <= PART:
            return self.overhead + self._counted(text.split())
        return self.overhead + sum(self._counted(p.split()) for p in parts(text))


def from_lines(path: str) -> WordPiece:
    """The counter of a vocabulary file, a piece a line, read by the driver."""
    with open(path, encoding="utf-8") as file:
        return WordPiece(line.rstrip("\n") for line in file)


def from_sentencepiece(path: str) -> WordPiece:
    """The counter of a sentencepiece model's pieces: those that begin a word there begin one here, all others are pieces inside words."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    said = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return WordPiece(p[1:] if p.startswith("▁") else f"##{p}" for p in said if p != "▁")


def count(text: Column, counter: WordPiece) -> Column:
    """Tokens of each text, as an int; 0 for null."""

    @F.pandas_udf("int")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for part in embedding.portions(pa.record_batch([pa.array(texts, pa.string())], ["t"]), "t", 10_000, PART):
            said = part.column(0).to_pylist()
            counter.prepare(said)
            out += map(counter, said)
        return pd.Series(out, dtype="int32")

    return run(text)
