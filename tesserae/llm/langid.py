"""Language identification by averaged hashed subword embeddings with a linear softmax.

A text's subwords are its UTF-8 n-grams (2 to 4 bytes, A-Z in lower case, white space as one space each), hashed to
``BUCKETS`` embeddings. The embeddings of a whole text are averaged and a linear layer with a softmax gives a
probability per language. Both are trained by stochastic gradient descent in numpy on the driver, on a bounded
sample of labelled documents: at most ``SAMPLE_ROWS`` rows, or ``LANGUAGE_ROWS`` for each language if that is more, and
``SAMPLE_BYTES`` of text, chosen by a hash of their ids, as evenly over languages as they allow: both bounds are dealt out
by language, and documents too long for their language's bytes are trained on by a slice from a hashed place. Every
language with a labelled row is learned, however many there are. Steps alternate between whole texts and short slices,
so that short texts are met in training too.

A fifth of the sample is held back for calibration: the softmax's temperature is the one with the least log loss on
it, and the rejection threshold is the least score above which ``PRECISION`` of its predictions are right. Predictions
below it are marked ``rejected``; the language is given all the same.

Prediction averages a table of BUCKETS rows over a text's subwords: the embeddings themselves, followed by the linear layer,
or, with fewer languages than ``WIDTH``, the embeddings with the linear layer folded into them. Either has at most BUCKETS x
WIDTH numbers (2 MB), which are sent with the tasks. It uses nothing but the text.

Nulls and edge cases: null texts and texts without letters are ``und`` with score 0 and rejected; rows without
language aren't trained on; a null doc_id is not held out and not trained on; without any labelled row every text is
``und``; repeated rows get equal predictions; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import mix64, pieces, text_bytes, unit_draw

BUCKETS, WIDTH, LENGTHS = 1 << 15, 16, (2, 3, 4)
SAMPLE_ROWS, LANGUAGE_ROWS, SAMPLE_BYTES = 4000, 20, 16 << 20
EPOCHS, RATE, PRECISION = 4, 2.0, 0.99
UNKNOWN = "und"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[9:14] = 32


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def subwords(data: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram that begins at each byte but the last n - 1."""
    x = _FOLD[data].astype(np.uint64)
    gram = np.full(max(len(x) - n + 1, 0), n, np.uint64)
    for i in range(n):
        gram = gram << np.uint64(8) | x[i : len(x) - n + 1 + i]
    return (mix64(gram) & np.uint64(BUCKETS - 1)).astype(np.int32)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x width: each bucket's embedding, or its part in the logits
    weight: np.ndarray | None  # width x languages: the linear layer, unless it is folded into the table
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A row per text; texts without subwords have the bias alone."""
        total = np.zeros((len(offsets) - 1, self.table.shape[1]))
        count = np.zeros(len(offsets) - 1)
        for n in LENGTHS:
            size = np.maximum(np.diff(offsets) - n + 1, 0)
            full = np.flatnonzero(size)
            if not len(full):
                continue
            buckets = subwords(data, n)
            edges = np.stack([offsets[:-1][full], offsets[:-1][full] + size[full]], 1).ravel()
            edges = edges[:-1] if edges[-1] == len(buckets) else edges
            for k in range(self.table.shape[1]):  # sums between a text's edges; those between texts are skipped
                total[full, k] += np.add.reduceat(self.table[:, k][buckets], edges, dtype=np.float64)[::2]
            count += size
        mean = total / np.maximum(count, 1)[:, None]
        return (mean if self.weight is None else mean @ self.weight) + self.bias

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best language's number, and its calibrated probability."""
        p = _softmax(self.logits(data, offsets) / self.temperature)
        return p.argmax(1), p.max(1)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(texts: list[bytes], labels: list[str], seed: int = 7) -> Model:
    """Stochastic gradient descent over single texts; the same input in the same order gives the same model."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    target = np.array([languages.index(x) for x in labels])
    grams = []
    for t in texts:
        data = np.frombuffer(t, np.uint8)
        grams.append([subwords(data, n) for n in LENGTHS])
    part = rng.permutation(len(texts))
    held, used = part[: len(texts) // 5], part[len(texts) // 5 :]
    embed = rng.normal(0, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    weight, bias = np.zeros((WIDTH, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    weight += rng.normal(0, 0.1, weight.shape).astype(np.float32)
    steps, step = EPOCHS * len(used), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(used):
            rate = RATE * (1 - step / steps)
            step += 1
            mine, n = grams[i], len(texts[i])
            if step % 2 and n > 60:
                a = int(rng.integers(0, n - 30))
                b = a + int(rng.integers(20, 400))
                mine = [g[a:b] for g in mine]
            ids = np.concatenate(mine)
            if not len(ids):
                continue
            ids, times = np.unique(ids, return_counts=True)
            share = (times / times.sum()).astype(np.float32)
            rows = embed[ids]
            v = share @ rows
            g = _softmax(v @ weight + bias).astype(np.float32)
            g[target[i]] -= 1
            back = weight @ g
            weight -= rate * 0.1 * np.outer(v, g)
            bias -= rate * 0.01 * g
            embed[ids] = rows - rate * np.outer(share * len(share) ** 0.5, back)
    folded = len(languages) < WIDTH
    model = Model(languages, np.ascontiguousarray(embed @ weight) if folded else embed, None if folded else weight.astype(np.float64), bias.astype(np.float64))
    if len(held):
        _calibrate(model, [texts[i] for i in held], target[held], rng)
    return model


def _calibrate(model: Model, texts: list[bytes], target: np.ndarray, rng: np.random.Generator) -> None:
    cut = [t[a : a + int(rng.integers(20, 400))] if k % 2 and len(t) > 60 and (a := int(rng.integers(0, len(t) - 30))) else t for k, t in enumerate(texts)]
    z = model.logits(np.frombuffer(b"".join(cut), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in cut])]))
    loss = lambda t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(z)), target], 1e-12)).mean()
    model.temperature = float(min(np.geomspace(0.1, 10, 81), key=loss))
    p = _softmax(z / model.temperature)
    order = np.argsort(-p.max(1), kind="stable")
    right = (p.argmax(1) == target)[order]
    precise = np.flatnonzero(np.cumsum(right) / np.arange(1, len(right) + 1) >= PRECISION)
    model.threshold = float(p.max(1)[order][precise[-1]]) if len(precise) else 1.0


def level(sizes: list[int], most: int) -> int:
    """The greatest whole number that ``sizes`` can be lowered to, where they exceed it, for a sum of ``most`` or less."""
    left = most
    for k, size in enumerate(sorted(sizes)):
        if size * (len(sizes) - k) > left:
            return left // (len(sizes) - k)
        left -= size
    return max(sizes, default=0)


def sample(docs: DataFrame, key: str = "doc_id") -> tuple[list[bytes], list[str]]:
    """The training sample, in order of its hashes. The first pass chooses ids, the second fetches their texts.

    Each language has its own order and its own part of the rows and bytes; what it doesn't use goes to the others.
    An id that repeats within a language counts as one document.
    """
    fit = docs.where(~held_out(key) & F.col(key).isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("lang") != UNKNOWN))
    fit = fit.select(key, "lang", "text")
    n = {r["lang"]: r["ids"] for r in fit.groupBy("lang").agg(F.approx_count_distinct(key).alias("ids")).collect()}
    if not n:
        return [], []
    spark, rows_bound = docs.sparkSession, max(SAMPLE_ROWS, LANGUAGE_ROWS * len(n))
    draw = unit_draw(F.lit("langid-1"), F.col(key).cast("string"))
    most = level(list(n.values()), rows_bound)
    # about twice what the language can have, so that it doesn't run short by chance
    shares = F.broadcast(spark.createDataFrame([(lang, (2.0 * most + 10) / max(ids, 1)) for lang, ids in n.items()], "_lang string, share double"))
    near = fit.select(key, "lang", draw.alias("u"), F.octet_length("text").alias("n")).join(shares, F.col("lang") == F.col("_lang")).where("u < share")
    near = near.groupBy(key, "lang").agg(F.first("u").alias("u"), F.first("share").alias("share"), F.max("n").alias("n"))
    by_lang: dict[str, list] = {}
    for r in near.orderBy(F.col("u") / F.col("share"), key, "lang").limit(4 * rows_bound).collect():
        by_lang.setdefault(r["lang"], []).append(r)
    most = level([len(rows) for rows in by_lang.values()], rows_bound)
    by_lang = {lang: rows[:most] for lang, rows in by_lang.items()}
    most_bytes = level([sum(r["n"] for r in rows) for rows in by_lang.values()], SAMPLE_BYTES)
    # documents longer than the bytes allow are trained on by a slice, so that none is left out or takes the others' room
    piece = {lang: level([r["n"] for r in rows], min(most_bytes, sum(r["n"] for r in rows))) for lang, rows in by_lang.items()}
    kept = [(r[key], lang, piece[lang]) for lang, rows in by_lang.items() for r in rows]
    if not kept:
        return [], []
    wanted = F.broadcast(spark.createDataFrame(kept, f"_key {dict(docs.dtypes)[key]}, _lang string, size int"))
    size = F.col("size")
    room = F.greatest(F.octet_length("text") - size, F.lit(0))
    start = F.floor(unit_draw(F.lit("langid-slice"), F.col(key).cast("string")) * (room + 1)).cast("int")
    data = F.substring(F.col("text").cast("binary"), start + 1, size)
    rows = fit.join(wanted, (F.col(key) == F.col("_key")) & (F.col("lang") == F.col("_lang")))
    rows = rows.groupBy(key, "lang").agg(F.min(data).alias("data"), F.first(draw).alias("u")).collect()
    rows = sorted(rows, key=lambda r: (r["u"], r[key], r["lang"]))
    return [bytes(r["data"]) for r in rows], [r["lang"] for r in rows]


def predict(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """(key, held_out, lang_pred, score, rejected)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 1 << 19):
                lettered = np.fromiter((any(map(str.isalpha, t or "")) for t in part.column("text").to_pylist()), bool, part.num_rows)
                if model.languages:
                    best, score = model.predict(*text_bytes(part.column("text")))
                else:
                    lettered[:] = False
                    best, score = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows)
                score = np.where(lettered, np.clip(score, 0, 1), 0.0)
                names = [model.languages[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
                columns = [part.column(key), part.column("held_out"), pa.array(names, pa.string()), pa.array(score), pa.array(~lettered | (score < model.threshold))]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "held_out", "lang_pred", "score", "rejected"])

    kind = dict(docs.dtypes)[key]
    rows = docs.select(key, held_out(key).alias("held_out"), "text")
    return rows.mapInArrow(run, f"`{key}` {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Trains on the labelled rows that aren't held out, and predicts all rows."""
    texts, labels = sample(docs, key)
    model = train(texts, labels) if texts else Model([], np.zeros((BUCKETS, 0), np.float32), None, np.zeros(0))
    return predict(docs, model, key)


def op3(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
