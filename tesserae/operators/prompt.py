"""Contexts and prompts from ranked results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Characters per token, the separator, and what cut content ends with.
CHARS_PER_TOKEN, SEPARATOR, CUT = 4, "\n---\n", "\n[Content truncated...]"
OVERHEAD = {"instruct": 150, "causal-lm": 50}
DEFAULT_SYSTEM = "You answer from the given context only. Say so if it does not hold the answer."
#: The same for answers that name their documents.
ATTRIBUTING_SYSTEM = f"{DEFAULT_SYSTEM} Name the documents that your answer rests on."
#: Where an answer of each kind of model ends.
STOPS = {
    "instruct": ["<|im_end|>", "<|endoftext|>", "<|im_start|>", "\n\nQuestion:", "\n\nContext:"],
    "causal-lm": ["\n\nQuestion:", "\n\nDocuments:", "\n\n---", "<|endoftext|>"],
}
#: What prompts say before, between and after system text, context and question.
PROMPTS = {
    "instruct": (
        "<|im_start|>system\n", "<|im_end|>\n<|im_start|>user\nContext:\n", "\n\nQuestion: ",
        "\n\nAnswer based only on the context above:<|im_end|>\n<|im_start|>assistant\n",
    ),
    "causal-lm": (
        "The following documents contain information to answer the question.\n\nDocuments:\n", "\n\nBased on the documents above, answer this question: ",
        "\n\nAnswer:",
    ),
}
Answer = Callable[[list[str]], list[str]]


def context_budget(longest: Column, reserved: Column, overhead: int = 100) -> Column:
    return F.greatest(F.lit(0), longest - reserved - overhead)


def contexts(results: DataFrame, budget: Column | str, by: str = "query_id") -> DataFrame:
    """(by, context, estimated_tokens, included, total, truncated) from (by, rank, title, content) rows.

    Whole chunks in rank order until one exceeds the budget (in tokens, a column of the rows); if that is the first one and there is room
    for 100 characters, it is cut. Results of one query are few: they are ordered in one task per query.
    """
    label = F.concat(F.lit("[Document "), F.col("rank").cast("string"), F.lit(": "), F.coalesce("title", F.lit("")), F.lit("]\n"), F.coalesce("content", F.lit("")))
    rows = results.withColumn("_t", label).withColumn("_most", F.greatest(F.lit(0), F.col(budget) if isinstance(budget, str) else budget) * CHARS_PER_TOKEN)
    rows = rows.withColumn("_n", F.length("_t") + F.when(F.col("rank") > 1, len(SEPARATOR)).otherwise(0))
    run = W.partitionBy(by).orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_sum", F.sum("_n").over(run))
    fits = F.col("_sum") <= F.col("_most")
    first = (F.col("rank") == 1) & ~fits & (F.col("_most") > 100)
    cut = F.concat(F.substring("_t", F.lit(1), (F.col("_most") - 20).cast("int")), F.lit(CUT))
    rows = rows.withColumn("_text", F.when(fits, F.col("_t")).when(first, cut))
    out = rows.groupBy(by).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("_text").isNotNull(), F.struct("rank", "_text")))), lambda x: x["_text"]), SEPARATOR).alias("context"),
        F.count("_text").alias("included"), F.count("*").alias("total"), F.max(~fits).alias("truncated"),
    )
    return out.withColumn("estimated_tokens", F.ceil(F.length("context") / CHARS_PER_TOKEN))


def available(query: Column, kind: str, longest: int, reserved: int) -> Column:
    return F.lit(longest - reserved - OVERHEAD[kind]) - F.ceil(F.length(query) / CHARS_PER_TOKEN)


def prompt(query: Column, context: Column, kind: str, system: str | None = None, attribute: bool = False) -> Column:
    parts = [F.lit(x) for x in PROMPTS[kind]]
    if kind == "causal-lm":
        return F.concat(parts[0], context, parts[1], query, parts[2])
    default = ATTRIBUTING_SYSTEM if attribute else DEFAULT_SYSTEM
    return F.concat(parts[0], F.lit(system or default), parts[1], context, parts[2], query, parts[3])


def generate(
    results: DataFrame, answer: Answer, kind: str = "instruct", longest: int = 2048, reserved: int = 512, chunks: int = 3, system: str | None = None,
    attribute: bool = False, batch: int = 8,
) -> DataFrame:
    """(query_id, prompt, response, included, truncated, tokens_used, error): an answer per query, from its ``chunks`` best results.

    ``answer`` gets lists of up to ``batch`` prompts, inside tasks. A batch that fails is tried prompt by prompt; a prompt that fails has a
    null response and its error. Queries without results have no row.
    """
    best = results.where(F.col("rank") <= chunks)
    asked = best.groupBy("query_id").agg(F.first("query").alias("query"))
    rows = best.withColumn("_budget", available(F.col("query"), kind, longest, reserved))
    told = contexts(rows, "_budget").join(asked, "query_id")
    told = told.select("query_id", prompt(F.col("query"), F.col("context"), kind, system, attribute).alias("prompt"), "included", "truncated")

    def tried(prompts: list[str]) -> list[tuple[str | None, str | None]]:
        try:
            return [(x, None) for x in answer(prompts)]
        except Exception as e:  # any model's error is the row's, not the job's
            return [(None, f"{type(e).__name__}: {e}")] if len(prompts) == 1 else [tried([p])[0] for p in prompts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                made = tried(part.column("prompt").to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array([m[k] for m in made], pa.string()) for k in (0, 1))], names=[*part.schema.names, "raw", "error"])

    made = told.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in told.dtypes) + ", raw string, error string")
    out = made.withColumn("response", clean_answer(F.col("raw"), STOPS[kind]))
    used = F.ceil(F.length("prompt") / CHARS_PER_TOKEN) + F.ceil(F.length("response") / CHARS_PER_TOKEN)
    return out.select("query_id", "prompt", "response", "included", "truncated", used.alias("tokens_used"), "error")


def clean_answer(answer: Column, stops: list[str]) -> Column:
    """Cut at the first stop sequence; back to the last sentence's end if that is past the middle."""
    out = answer
    for stop in stops:
        out = F.substring_index(out, stop, 1)
    out = F.trim(out)
    whole = F.regexp_extract(out, r"(?s)^(.*[.!?])", 1)
    return F.when(F.length(whole) > F.length(out) / 2, whole).otherwise(out)
