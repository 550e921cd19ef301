"""What is known of models, and the checks of names, modes and settings. Small tables, so plain Python and a DataFrame view of them."""

from __future__ import annotations

import enum
import hashlib
import json
import posixpath
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators.rerank import STRATEGIES


class Category(enum.Enum):
    """The categories of errors, by the names they are shown with."""

    CONFIGURATION = "Configuration"
    DATABASE = "Database"
    MODEL = "Model"
    INDEX = "Index"
    FILE_SYSTEM = "File System"
    EMBEDDING = "Embedding"
    NETWORK = "Network"
    VALIDATION = "Validation"
    GENERAL = "General"


#: Severities, and exit codes by name.
SEVERITIES = ("FATAL", "ERROR", "WARNING", "INFO")
EXIT_CODES = {
    "success": 0, "general": 1, "arguments": 2, "configuration": 3, "file not found": 4, "database": 5, "model": 6, "index": 7, "permission": 8,
}


class EngineError(Exception):
    """An error with its category and severity."""

    def __init__(self, message: str, category: Category = Category.GENERAL, severity: str = "ERROR") -> None:
        super().__init__(message)
        self.category, self.severity = category, severity


@dataclass(frozen=True)
class Model:
    name: str
    kind: str
    dim: int
    content_types: tuple[str, ...]
    batch: int
    longest: int
    memory_mb: int
    chunk_size: int = 250
    chunk_overlap: int = 50


@dataclass(frozen=True)
class Generator:
    name: str
    kind: str
    context: int
    output: int
    temperature: float
    chunks: int
    memory_mb: int


#: Known embedding models and generators.
MODELS = {
    m.name: m
    for m in (
        Model("sentence-transformers/all-MiniLM-L6-v2", "sentence-transformer", 384, ("text",), 32, 512, 256),
        Model("Xenova/all-mpnet-base-v2", "sentence-transformer", 768, ("text",), 16, 512, 512, 400, 80),
        Model("Xenova/clip-vit-base-patch32", "clip", 512, ("text", "image"), 8, 77, 1024),
        Model("Xenova/clip-vit-base-patch16", "clip", 512, ("text", "image"), 4, 77, 1536),
    )
}
GENERATORS = {
    g.name: g
    for g in (
        Generator("HuggingFaceTB/SmolLM2-135M-Instruct", "instruct", 2048, 512, 0.1, 3, 768),
        Generator("HuggingFaceTB/SmolLM2-360M-Instruct", "instruct", 2048, 512, 0.1, 5, 1024),
    )
}
_KEYWORDS = ("clip", "mpnet", "minilm", "sentence", "transformer")


def models(spark: SparkSession) -> DataFrame:
    rows = [(m.name, m.kind, m.dim, list(m.content_types), m.batch, m.longest, m.memory_mb) for m in MODELS.values()]
    return spark.createDataFrame(rows, "name string, kind string, dim int, content_types array<string>, batch int, longest int, memory_mb int")


def model(name: str) -> Model:
    if name not in MODELS:
        near = similar(name)
        raise EngineError(f"unknown model {name!r}" + f"; similar: {', '.join(near)}" * bool(near), Category.MODEL)
    return MODELS[name]


def similar(name: str) -> list[str]:
    mine = [k for k in _KEYWORDS if k in name.lower()]
    return [m for m in MODELS if any(k in m.lower() for k in mine)][:3]


def default_model(kind: str) -> str:
    return next(m.name for m in MODELS.values() if m.kind == kind)


def models_for(content_type: str) -> list[str]:
    return [m.name for m in MODELS.values() if content_type in m.content_types]


def model_version(name: str, config: dict) -> str:
    """The name, and a digest of what else shapes the vectors."""
    return f"{name}_{hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:16]}"


def generator(prefer_quality: bool = False) -> Generator:
    return list(GENERATORS.values())[int(prefer_quality)]


def check_mode(mode: str, name: str) -> list[str]:
    """Warnings of a mode with a model; an error if they don't go together."""
    m = model(name)
    if mode not in ("text", "multimodal"):
        raise EngineError(f"unknown mode {mode!r}", Category.CONFIGURATION)
    if mode == "multimodal" and m.kind == "sentence-transformer":
        raise EngineError(f"{name} has no images: multimodal mode needs one of {', '.join(models_for('image'))}", Category.CONFIGURATION)
    return [f"{name} is made for images too: text models do better in text mode"] if mode == "text" and m.kind == "clip" else []


@dataclass(frozen=True)
class Reranking:
    """Settings of reranking. Disabled is never enabled; weights are between 0 and 1."""

    strategy: str
    enabled: bool = True
    model: str | None = None
    semantic: float | None = None
    metadata: float | None = None
    visual: float | None = None
    fallback: str = "disabled"

    def __post_init__(self) -> None:
        for name in (self.strategy, self.fallback):
            if name not in STRATEGIES:
                raise EngineError(f"invalid reranking strategy {name!r}; valid are {', '.join(STRATEGIES)}", Category.CONFIGURATION)
        for name in ("semantic", "metadata", "visual"):
            if (w := getattr(self, name)) is not None and not 0 <= w <= 1:
                raise EngineError(f"{name} weight must be between 0 and 1", Category.CONFIGURATION)
        if self.strategy == "disabled":
            object.__setattr__(self, "enabled", False)


def strategies(mode: str) -> list[str]:
    return [s for s in STRATEGIES if s != ("text-derived" if mode == "text" else "cross-encoder")]


def default_strategy(mode: str) -> str:
    return "lexical" if mode == "text" else "text-derived"


def check_query(query: str, top_k: int = 10, longest: int = 500, most: int = 100) -> None:
    if not query.strip() or len(query) > longest:
        raise EngineError(f"a query has 1 to {longest} characters", Category.VALIDATION)
    if isinstance(top_k, bool) or not isinstance(top_k, int) or not 1 <= top_k <= most:
        raise EngineError(f"top_k must be an integer from 1 to {most}", Category.VALIDATION)


def storage_path(path: Column, base: str, strategy: str = "relative") -> Column:
    """A path as it is stored: relative to the base folder where it is below it, or as it is."""
    if strategy not in ("relative", "absolute"):
        raise EngineError("the path strategy is relative or absolute", Category.CONFIGURATION)
    if strategy == "absolute":
        return path
    top = base.rstrip("/") + "/"
    return F.when(path.startswith(top), F.substring(path, F.lit(len(top) + 1), F.length(path))).otherwise(path)


def absolute_path(path: str, base: str) -> str:
    return path if posixpath.isabs(path) else posixpath.normpath(posixpath.join(base, path))


def duration(ms: Column) -> Column:
    return F.when(ms < 1000, F.concat(F.round(ms).cast("long").cast("string"), F.lit("ms"))).otherwise(F.concat(F.format_number(ms / 1000, 1), F.lit("s")))


def speed(size: Column, ms: Column) -> Column:
    """Megabytes a second; 0 in no time."""
    return F.when(ms == 0, F.lit(0.0)).otherwise(size / ms * 1000 / (1024.0 * 1024.0))


def operation_metrics(rows: DataFrame) -> DataFrame:
    """A row of totals from (operation, duration_ms, bytes, cache_hit) rows."""
    n, ms, size = F.count("*"), F.coalesce(F.sum("duration_ms"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))
    share = lambda flag: F.round(F.coalesce(100.0 * F.count_if(flag) / F.nullif(n, F.lit(0)), F.lit(0.0)), 2)
    return rows.agg(
        n.alias("operations"), F.round(F.coalesce(F.avg("duration_ms"), F.lit(0.0)), 2).alias("average_ms"), size.alias("bytes"), F.round(speed(size, ms), 4).alias("mb_per_s"),
        share(F.col("cache_hit")).alias("cache_hit_percent"), share(F.col("operation").contains("error")).alias("error_percent"),
    )
