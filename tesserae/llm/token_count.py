"""Token counts by rank-synchronous array merging.

Texts are split into pre-tokens that no merge can cross: before each run of the space mark, and around characters
that no longer piece contains. Pre-tokens that a bounded cache doesn't know are held together as ragged arrays:
one array of symbols, with the place where each sequence begins. In each round every sequence that still has a
pair merges its pair of lowest rank (leftmost among equals), all sequences at once; sequences without a pair leave
the arrays. What counts is how many symbols survive; a character without a piece counts as many bytes.

Very long sequences would take a round per merge; they are merged one by one with a heap of pairs instead, by the
same order of ranks and places, in n log n steps.

Nulls and edge cases: null and empty texts have 0 bytes and 0 tokens; texts are counted whole, whatever their
length; repeated rows give a row each; an empty table gives an empty result; other columns of the input aren't read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tesserae.llm.cache import Generations
from tesserae.llm.common import pieces, text_bytes

MARK = "▁"
LIMIT, LONG_SEQUENCE = 4096, 128
_NEVER = np.int64(1) << np.int64(62)


class Counter:
    """Counts tokens of a sentencepiece BPE model with byte fallback."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        usual = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        names = [model.id_to_piece(i) for i in usual]
        scores = [model.get_score(i) for i in usual]
        order = {s: r for r, s in enumerate(sorted(set(scores), reverse=True))}
        rank = {p: order[s] for p, s in zip(names, scores, strict=True)}
        #: Symbols: pieces, and single characters that only longer pieces contain.
        symbols = list(dict.fromkeys([*names, *(c for p in names for c in p)]))
        number = {p: i for i, p in enumerate(symbols)}
        assert not any(a != MARK and b == MARK for p in names for a, b in zip(p, p[1:], strict=False)), "a piece has the space mark inside"
        self.weight = np.array([1 if p in rank else len(p.encode()) for p in symbols], np.int64)
        merges = sorted(
            (number[p[:k]] << 32 | number[p[k:]], rank[p], number[p])
            for p in names if len(p) > 1 for k in range(1, len(p)) if p[:k] in number and p[k:] in number
        )
        self.keys = np.array([m[0] for m in merges], np.int64)
        self.ranks = np.array([m[1] for m in merges], np.int64)
        self.made = np.array([m[2] for m in merges], np.int64)
        # of code points: the symbol, and 0 for marks, 1 for what can merge, 2 for what stands alone
        self.symbol = np.full(0x110000, -1, np.int32)
        self.kind = np.full(0x110000, 2, np.uint8)
        points = np.arange(0x110000)
        self.alone = (1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)).astype(np.int64)
        for p, i in number.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
                self.alone[ord(p)] = self.weight[i]
        for p in names:
            if len(p) > 1:
                self.kind[[ord(c) for c in p]] = 1
        self.kind[[ord(MARK), 32]] = 0
        self.symbol[32], self.alone[32] = self.symbol[ord(MARK)], self.alone[ord(MARK)]
        self.cache = Generations(self._count, 300_000)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (never, if they don't merge) and result of each pair."""
        key = left << np.int64(32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NEVER), self.made[at]

    def _count(self, sequences: list[str]) -> list[int]:
        out = np.zeros(len(sequences), np.int64)
        lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
        for i in np.flatnonzero(lengths > LONG_SEQUENCE):
            out[i] = self._count_long(sequences[i])
        short = np.flatnonzero((lengths > 0) & (lengths <= LONG_SEQUENCE))
        for some in np.array_split(short, max(1, len(short) // 50_000)):
            if len(some):
                out[some] = self._count_ragged([sequences[i] for i in some])
        return out.tolist()

    def _count_ragged(self, sequences: list[str]) -> np.ndarray:
        counts = np.zeros(len(sequences), np.int64)
        size = np.fromiter(map(len, sequences), np.int64, len(sequences))
        symbols = self.symbol[np.frombuffer("".join(sequences).encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
        owner = np.arange(len(sequences))
        first = np.cumsum(size) - size
        rank, made = self._ranks(symbols, first)
        while len(owner):
            # a rank and a place in one number: the least is the leftmost pair of lowest rank
            low = np.minimum.reduceat(np.where(rank == _NEVER, _NEVER, rank << np.int64(32) | np.arange(len(rank))), first)
            going = low < _NEVER
            if not going.all():
                total = np.add.reduceat(self.weight[symbols], first)
                counts[owner[~going]] = total[~going]
                stay = np.repeat(going, size)
                symbols, rank, made = symbols[stay], rank[stay], made[stay]
                shift = np.cumsum(~stay)
                at = (low[going] & np.int64(0xFFFFFFFF))
                at = at - shift[at]
                owner, size = owner[going], size[going]
                first = np.cumsum(size) - size
            else:
                at = low & np.int64(0xFFFFFFFF)
            if not len(owner):
                break
            symbols[at] = made[at]
            rank[at] = rank[at + 1]  # stays "never" where the pair was the sequence's last
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))  # one symbol fewer in each sequence before
            symbols, rank, made = symbols[keep], rank[keep], made[keep]
            size = size - 1
            first = np.cumsum(size) - size
            last = first + size - 1
            for pair in (at[at < last], at[at > first] - 1):
                rank[pair], made[pair] = self._pairs(symbols[pair], symbols[pair + 1])
            rank[last] = _NEVER
        return counts

    def _ranks(self, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, made = np.full(len(symbols), _NEVER), np.zeros(len(symbols), np.int64)
        if len(symbols) > 1:
            rank[:-1], made[:-1] = self._pairs(symbols[:-1], symbols[1:])
            rank[first[1:] - 1] = _NEVER
        return rank, made

    def _count_long(self, sequence: str) -> int:
        symbols = self.symbol[np.frombuffer(sequence.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
        rank, made = self._ranks(symbols, np.zeros(1, np.int64))
        n = len(symbols)
        heap = [(r, i, i + 1, m, 0, 0) for i, (r, m) in enumerate(zip(rank.tolist(), made.tolist(), strict=True)) if r < _NEVER]
        heapq.heapify(heap)
        is_now, left, right, version = symbols.tolist(), list(range(-1, n - 1)), list(range(1, n + 1)), [0] * n
        alive = bytearray(b"\1") * n

        def push(i: int, j: int) -> None:
            r, m = (x[0] for x in self._pairs(np.array([is_now[i]]), np.array([is_now[j]])))
            if r < _NEVER:
                heapq.heappush(heap, (int(r), i, j, int(m), version[i], version[j]))

        while heap:
            _, i, j, m, vi, vj = heapq.heappop(heap)
            if not (alive[i] and alive[j] and right[i] == j and version[i] == vi and version[j] == vj):  # its pair is no more
                continue
            is_now[i], alive[j] = m, 0
            version[i] += 1
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
                push(i, right[i])
            if left[i] >= 0:
                push(left[i], i)
        return int(self.weight[[s for s, a in zip(is_now, alive, strict=True) if a]].sum())

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text, without begin and end."""
        filled = np.fromiter((bool(t) for t in texts), bool, len(texts))
        out = np.zeros(len(texts), np.int64)
        marked = [" " + t for t in texts if t]  # the model's own first mark
        if not marked:
            return out
        joined = "".join(marked)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.kind[points]
        at = np.cumsum(np.fromiter(map(len, marked), np.int64, len(marked)))
        begin = np.ones(len(points), bool)
        begin[1:] = (kind[1:] == 2) | (kind[:-1] == 2) | (kind[1:] == 0) & (kind[:-1] != 0)
        begin[at[:-1]] = True
        start = np.flatnonzero(begin)
        end = np.append(start[1:], len(points))
        mergeable = kind[start] != 2
        n = np.zeros(len(start), np.int64)
        n[~mergeable] = self.alone[points[start[~mergeable]]]
        spaced = joined.replace(" ", MARK)
        slices = [spaced[a:b] for a, b in zip(start[mergeable].tolist(), end[mergeable].tolist(), strict=True)]
        n[mergeable] = self.cache.get(slices)
        total = np.concatenate([[0], np.cumsum(n)])
        edges = np.searchsorted(start, np.concatenate([[0], at]))
        out[filled] = np.diff(total[edges])
        return out


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", limit: int = LIMIT) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = counter(path)
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                n = model.counts([x or "" for x in part.column("text").to_pylist()])
                size = np.diff(text_bytes(part.column("text"))[1])
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(size), pa.array(n), pa.array(n > limit)], names=[key, "n_bytes", "n_tokens", "over_limit"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, "text").mapInArrow(run, f"`{key}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op10(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path())
