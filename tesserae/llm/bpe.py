"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Texts are arrays of code points. Each code point has a class (letter, number, white space, apostrophe ..., with
what follows it taken in), and each class is a transition function of a small automaton that knows which kind of
pre-token the last character belongs to. Functions compose associatively, so prefix compositions are found for
all characters at once by doubling; the scan ends when all of them are constant, after two or three rounds,
because only contractions look further back than one character. State before and class of a character tell
whether a pre-token begins there; no regular expression runs. The slices are looked up in a bounded cache of
merged pieces; what it lacks is merged pair by pair, lowest rank first. Offsets of pre-tokens and tokens are kept, so
that ids are decoded text by text.

Nulls and edge cases: a null text is encoded as empty (0 tokens); texts of any length are encoded whole; repeated
rows give a row each; an empty table gives an empty result; columns of the input other than the key aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tesserae.llm.cache import Generations
from tesserae.llm.common import pieces

# classes of characters
LETTER, NUMBER, OTHER, INNER, LAST_SPACE, LAST_WHITE, SHORT, LONG, BREAK = range(9)
# states: after white space that stands alone, after a space that the next run takes in, inside white space,
# in letters, numbers or others, one or two characters before a contraction's end, after a contraction
ALONE, TAKEN, WHITE, LETTERS, NUMBERS, OTHERS, ONE_LEFT, TWO_LEFT, ENDED = range(9)
#: The white space code points of Unicode; below, the endings that follow an apostrophe.
WHITE_SPACE = (0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Letters and numbers that Unicode 16 has and Python's 15.1 lacks.
MORE_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
MORE_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")


@lru_cache(1)
def _kinds() -> np.ndarray:
    kinds = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        first = unicodedata.category(chr(c))[0]
        if first in "LN":
            kinds[c] = LETTER if first == "L" else NUMBER
    for ranges, kind in ((MORE_LETTERS, LETTER), (MORE_NUMBERS, NUMBER)):
        for a, b in ranges:
            kinds[a : b + 1] = kind
    kinds[list(WHITE_SPACE)] = INNER
    return kinds


def _step(state: int, kind: int) -> tuple[int, bool]:
    """The next state, and whether a pre-token begins with this character."""
    if kind == LETTER:
        if state in (ONE_LEFT, TWO_LEFT):
            return (ENDED if state == ONE_LEFT else ONE_LEFT), False
        return LETTERS, state not in (TAKEN, LETTERS)
    if kind == NUMBER:
        return NUMBERS, state not in (TAKEN, NUMBERS)
    if kind == OTHER or kind in (SHORT, LONG) and state in (TAKEN, OTHERS):
        return OTHERS, state not in (TAKEN, OTHERS)
    if kind in (SHORT, LONG):
        return (ONE_LEFT if kind == SHORT else TWO_LEFT), True
    if kind == INNER:
        return WHITE, state != WHITE
    return (TAKEN if kind == LAST_SPACE else ALONE), True


@lru_cache(1)
def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Function of each class; composition table (later, earlier); whether a function is constant; its value at ALONE; begins[state, class]."""
    step = [tuple(_step(s, k)[0] for s in range(9)) for k in range(9)]
    known = list(dict.fromkeys(step))
    number = {f: i for i, f in enumerate(known)}
    table: dict[tuple[int, int], int] = {}
    done = 0
    while done < len(known):  # closure under composition
        done = len(known)
        for i in range(done):
            for j in range(done):
                if (i, j) not in table:
                    f = tuple(known[i][known[j][s]] for s in range(9))
                    if f not in number:
                        number[f] = len(known)
                        known.append(f)
                    table[i, j] = number[f]
    compose = np.zeros((len(known), len(known)), np.uint8)
    for (i, j), k in table.items():
        compose[i, j] = k
    constant = np.array([len(set(f)) == 1 for f in known])
    begins = np.array([[_step(s, k)[1] for k in range(9)] for s in range(9)])
    return np.array([number[f] for f in step], np.uint8), compose, constant, np.array([f[ALONE] for f in known], np.uint8), begins


def boundaries(points: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin. ``points``: code points of texts, each followed by one break (whose places are ``breaks``)."""
    kinds = _kinds()[points]
    kinds[breaks] = BREAK
    white = kinds == INNER
    after = np.append(kinds[1:], BREAK)
    last = white & (after != INNER) & (after != BREAK)
    kinds[last] = np.where(points[last] == 32, LAST_SPACE, LAST_WHITE)
    i = np.flatnonzero(points == 39)
    one, two = points[np.minimum(i + 1, len(points) - 1)], points[np.minimum(i + 2, len(points) - 1)]
    for ending in ENDINGS:
        fits = (one == ord(ending[0])) & (two == ord(ending[-1]) if len(ending) == 2 else True)
        kinds[i[fits]] = SHORT if len(ending) == 1 else LONG
    function, compose, constant, value, begins = _automaton()
    f, reach = function[kinds], 1
    while reach < len(f) and not constant[f[reach:]].all():
        f = np.concatenate([f[:reach], compose[f[reach:], f[:-reach]]])
        reach *= 2
    before = np.concatenate([[np.uint8(ALONE)], value[f[:-1]]])
    return np.flatnonzero(begins[before, kinds] & (kinds != BREAK))


def pre_tokens(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The pre-tokens of all texts, and the n + 1 offsets of each text's among them."""
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    breaks = np.cumsum(lengths + 1) - 1
    begin = boundaries(points, breaks)
    at = np.concatenate([[0], np.searchsorted(begin, breaks)])
    end = np.append(begin[1:], len(joined))
    filled = np.flatnonzero(np.diff(at))
    end[at[1:][filled] - 1] = breaks[filled]
    return [joined[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)], at


class Codec:
    """Encodes and decodes with a file of ranks (base64 of a token's bytes, and its rank, on each line)."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.names = list(map(str, range(len(self.tokens))))
        self.cache = Generations(lambda new: [self.merge(x.encode("utf-8", "replace")) for x in new])

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        return self._merge_long(piece) if len(piece) > 100 else self._merge_short(piece)

    def _merge_short(self, piece: bytes) -> tuple[int, ...]:
        get, never = self.ranks.get, len(self.tokens)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [get(piece[i : i + 2], never) for i in range(len(piece) - 1)]
        while pairs:
            least = min(pairs)
            if least == never:
                break
            i = pairs.index(least)
            parts[i] += parts.pop(i + 1)
            pairs.pop(i)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], never)
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], never)
        return tuple(map(self.ranks.__getitem__, parts))

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same with a heap of pairs and linked parts: n log n."""
        get, n = self.ranks.get, len(piece)
        end, left, right = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\1") * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = right[i]
            if not alive[i] or j >= n or end[j] != stop:
                continue
            alive[j], end[i], right[i] = 0, stop, right[j]
            if right[i] < n:
                left[right[i]] = i
                if (r := get(piece[i : end[right[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[right[i]]))
            if left[i] >= 0 and (r := get(piece[left[i] : stop])) is not None:
                heapq.heappush(heap, (r, left[i], stop))
        return tuple(self.ranks[piece[i : end[i]]] for i in range(n) if alive[i])

    def encode(self, texts: list[str]) -> tuple[list[int], np.ndarray]:
        """The ids of all texts, and the n + 1 offsets of each text's among them."""
        slices, at = pre_tokens(texts)
        ids = self.cache.get(slices)
        sizes = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))])
        return list(chain.from_iterable(ids)), sizes[at]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, path: str, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256), and with ``with_ids`` the ids and the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                ids, at = bpe.encode([x or "" for x in part.column("text").to_pylist()])
                each = [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                names = [hashlib.sha256(" ".join(map(bpe.names.__getitem__, x)).encode()).hexdigest() for x in each]
                back = [bpe.decode(x) for x in each]
                columns = [part.column(key), pa.array(np.diff(at)), pa.array(names, pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string())]
                if with_ids:
                    columns += [pa.array(each, pa.list_(pa.int32())), pa.array([x.decode("utf-8", "replace") for x in back], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(columns)])

    kind = dict(docs.dtypes)[key]
    schema = f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return docs.select(key, "text").mapInArrow(run, schema)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op6(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path())
