"""Quality rules: base limits, then robust multivariate outliers per language and source.

A document's statistics are turned into four features: log mean word length, log share of markup symbols, and
square roots of the shares of duplicate lines and of words in repeated windows. For each (language, source) group
the minimum covariance determinant estimate of their mean and covariance is found by concentration steps from several
starts: the documents nearest to the current estimate (``CORE`` of the group) give the next one, as long as its covariance
has a smaller determinant, and of all starts' ends the one with the smallest determinant is the estimate. Documents
that are farther from it than ``CUTOFF`` in squared Mahalanobis distance, on the bad side, are rejected.

Starts are the medians and median absolute deviations, the mean and covariance of all, and two of five documents each that
are drawn by a digest of their statistics. All starts of all groups take a step in the same aggregation: sums by cell of a
histogram of distances, made before they are shuffled, give the nearest part's mean and covariance. Rows meet their estimates
where they are (more than ``MOST_SENT`` estimates: in one of ``SALTS`` parts of their group), so no group is ever gathered, sorted or sampled. Estimates that a step didn't improve rest; steps end when all do (``STEPS`` at most).

* Only what exceeds the group's mean in symbols, duplicate lines or repetition counts against a document; a
  word length may be off in either direction.
* Variances have floors (``FLOORS``), so a group of near-identical documents doesn't reject ordinary ones; they are part of
  the covariance whose determinant is compared.
* A group of fewer than ``LEAST`` documents that pass the base rules is judged by the estimate of its language, one whose
  language has fewer by the estimate of the whole table, however few documents that has.

Nulls and edge cases: null text has no words, so it fails the base rules; null language or source form groups of
their own; repeated rows each get the same verdict; an empty table gives an empty result; other columns pass
through ``judge`` unless they bear the names of ``ADDED``, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tesserae.llm.common import cut, free, words

GROUP = ("lang", "source")
#: Part of a group that an estimate rests on, the most concentration steps, and documents that a group needs for an estimate of its own.
CORE, STEPS, LEAST = 0.75, 15, 20
#: Starts from drawn documents, the documents of each (one more than features), and by how much a log determinant must fall.
DRAWN, EACH, FALL = 2, 5, 1e-9
#: The 0.9999 quantile of chi-square with 4 degrees of freedom, and its median.
CUTOFF, MEDIAN = 23.513, 3.3567
#: Standard deviations that are added (in quadrature) to the estimates.
FLOORS = (0.12, 0.7, 0.12, 0.12)
FEATURES = ("f1", "f2", "f3", "f4")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
ADDED = (*BASE, "base_failed", "distance2", "kept")
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Estimates that are sent to every task at most (some 200 bytes each), and the parts that a group's rows are dealt to where there are more.
MOST_SENT, SALTS = 50_000, 64
#: Histogram cells per unit of a feature, and of log(1 + squared distance).
CELLS, DISTANCE_CELLS = 256, 64

# The words of 3-word windows that occur twice or more. Windows are compared by a 64-bit hash within one text;
# equal ones stand side by side once sorted, and their places, sorted again, give the words they cover.
_REPEATED = """
transform(array(transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2]))), h ->
  if(size(array_distinct(h)) = size(h), 0,
    transform(array(array_sort(transform(h, (x, i) -> struct(x AS x, i AS i)))), s ->
      aggregate(
        array_sort(transform(filter(s, (e, k) -> (k > 0 AND s[k - 1].x = e.x) OR (k < size(s) - 1 AND s[k + 1].x = e.x)), e -> e.i)),
        struct(0 AS n, 0 AS done),
        (a, p) -> struct(a.n + p + 3 - greatest(p, a.done) AS n, p + 3 AS done),
        a -> a.n))[0]))[0]
"""
# One expression over a variable that holds the words: wherever the optimizer moves or repeats it, words are split once.
_WORDS = f"transform(array(_w), w -> struct(size(w) AS n, if(size(w) < 3, 0, {_REPEATED}) AS repeated))[0]"


def statistics(docs: DataFrame) -> DataFrame:
    """The input with the columns of ``BASE`` (all long) and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    out = docs.drop(*ADDED, "_w", "_l").withColumn("_w", words(F.col("text"))).withColumn("_w", F.expr(_WORDS))
    out = out.withColumn("_l", F.transform(F.array(lines), lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("distinct")))[0])
    out = out.withColumn("n_words", F.col("_w.n").cast("long"))
    out = out.withColumn("word_chars", (F.length(F.translate(text, " \t\n\x0b\x0c\r", ""))).cast("long"))
    out = out.withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"))
    out = out.withColumn("n_dup_lines", (F.col("_l.n") - F.col("_l.distinct")).cast("long"))
    out = out.withColumn("n_repeat_words", F.col("_w.repeated").cast("long"))
    out = out.withColumn("_lines", F.col("_l.n")).drop("_w", "_l")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def features(stats: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return stats.withColumns({
        "f1": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        "f2": F.log(F.lit(1.0) + F.lit(1000.0) * F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        "f3": F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("_lines"), F.lit(1))),
        "f4": F.sqrt(F.col("n_repeat_words") / n),
        "_digest": F.md5(F.concat_ws("/", *BASE, "_lines").cast("binary")),
    }).drop("_lines")


def _same(group: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for g in group:
        out = out & F.col(g).eqNullSafe(F.col(f"_{g}"))
    return out


def _with(rows: DataFrame, params: DataFrame, group: tuple[str, ...], how: str = "left") -> DataFrame:
    """A join by group; ``params`` was written before, so the planner knows its size and sends it to the tasks only if it is small."""
    for g in group:
        params = params.withColumnRenamed(g, f"_{g}")
    return rows.join(params, _same(group), how).drop(*[f"_{g}" for g in group])


def _beside(rows: DataFrame, params: DataFrame, sent: bool) -> DataFrame:
    """Rows with each estimate of their g. Never dealt by g alone: one group may hold most of the rows."""
    if sent:
        return rows.join(F.broadcast(params), "g")
    return rows.join(params.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["g", "_salt"])


def _rank_cell(cells: DataFrame, by: list[str], part: float, name: str) -> DataFrame:
    """The first cell of each histogram (columns ``by``, cell, n) below or in which ``part`` of its rows are."""
    up_to = W.partitionBy(*by).orderBy("cell").rowsBetween(W.unboundedPreceding, 0)
    every = W.partitionBy(*by)
    found = cells.withColumn("_c", F.sum("n").over(up_to)).withColumn("_n", F.sum("n").over(every))
    return found.where(F.col("_c") >= F.col("_n") * part).groupBy(*by).agg(F.min("cell").alias(name))


P = range(len(FEATURES))
_MEANS = [f"m{i}" for i in P]
_FACTORS = [f"l{i}{j}" for i in P for j in range(i + 1)]


def _medians(rows: DataFrame) -> DataFrame:
    """Medians and median absolute deviations by g, as an estimate with a diagonal covariance."""
    long = rows.select("g", F.posexplode(F.array(*FEATURES)).alias("k", "x"))
    cells = cut(long.groupBy("g", "k", F.round(F.col("x") * CELLS).cast("long").alias("cell")).agg(F.count("*").alias("n")), "quality-cells")
    middle = cut(_rank_cell(cells, ["g", "k"], 0.5, "middle"), "quality-medians")
    away = cells.join(middle, ["g", "k"]).select("g", "k", F.abs(F.col("cell") - F.col("middle")).alias("cell"), "n").groupBy("g", "k", "cell").agg(F.sum("n").alias("n"))
    both = middle.join(_rank_cell(away, ["g", "k"], 0.5, "away"), ["g", "k"])
    pick = lambda c, k: F.max(F.when(F.col("k") == k, c))
    wide = both.groupBy("g").agg(
        *[pick(F.col("middle") / CELLS, i).alias(f"m{i}") for i in P], *[pick(1.4826 * F.col("away") / CELLS, i).alias(f"s{i}") for i in P]
    )
    zero = {f"c{i}{j}": F.lit(0.0) for i in P for j in range(i)}
    return wide.withColumns(zero | {f"c{i}{i}": F.col(f"s{i}") * F.col(f"s{i}") for i in P}).drop(*[f"s{i}" for i in P])


def _moments(rows: DataFrame, *by: str) -> DataFrame:
    """Mean and covariance by columns ``by``."""
    x = [F.col(f) for f in FEATURES]
    sums = rows.groupBy(*by).agg(*[F.avg(x[i]).alias(f"m{i}") for i in P], *[F.avg(x[i] * x[j]).alias(f"e{i}{j}") for i in P for j in range(i + 1)])
    cov = {f"c{i}{j}": F.col(f"e{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}") for i in P for j in range(i + 1)}
    return sums.withColumns(cov).drop(*[f"e{i}{j}" for i in P for j in range(i + 1)])


def _core_moments(placed: DataFrame) -> DataFrame:
    """Mean and covariance, by g and s, of the ``CORE`` of documents that are nearest to the estimate beside them.

    One aggregation: sums by cell of a histogram of distances, of which the cells up to the core's edge are added up.
    """
    x = [F.col(f) for f in FEATURES]
    pairs = [(i, j) for i in P for j in range(i + 1)]
    cells = _measured(placed).withColumn("cell", _cell(F.col("d2"))).groupBy("g", "s", "cell").agg(
        F.count("*").alias("n"), *[F.sum(x[i]).alias(f"m{i}") for i in P], *[F.sum(x[i] * x[j]).alias(f"e{i}{j}") for i, j in pairs]
    )
    every = W.partitionBy("g", "s")
    before = F.coalesce(F.sum("n").over(every.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = cells.withColumn("_before", before).withColumn("_all", F.sum("n").over(every)).where(F.col("_before") < F.col("_all") * CORE)
    sums = inside.groupBy("g", "s").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in (*_MEANS, *[f"e{i}{j}" for i, j in pairs])])
    means = sums.withColumns({c: F.col(c) / F.col("n") for c in _MEANS})
    return means.withColumns({f"c{i}{j}": F.col(f"e{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}") for i, j in pairs}).drop("n", *[f"e{i}{j}" for i, j in pairs])


def _drawn(rows: DataFrame) -> DataFrame:
    """Mean and covariance of the documents whose digests are least when read from one of several places, by g and start (from 2)."""
    turned = lambda k: F.substring(F.concat("_digest", "_digest"), 1 + 3 * k, 32)
    picked = rows.groupBy("g").agg(*[F.min_by(F.struct(*FEATURES), turned(k)).alias(f"d{k}") for k in range(DRAWN * EACH)])
    named = F.array(*[F.struct(F.lit(2 + k // EACH).alias("s"), F.col(f"d{k}").alias("x")) for k in range(DRAWN * EACH)])
    return _moments(picked.select("g", F.explode(named).alias("d")).select("g", "d.s", "d.x.*"), "g", "s")


def _factor(params: DataFrame) -> DataFrame:
    """Replaces covariance entries c by those of the Cholesky factor l of the covariance with its floors, whose pivots are at least the
    floors, and adds the log of its determinant."""
    for i in P:
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}") + (FLOORS[i] ** 2 if i == j else 0.0)
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            params = params.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(FLOORS[i] ** 2))) if i == j else rest / F.col(f"l{j}{j}"))
    log_det = 2.0 * sum((F.log(f"l{i}{i}") for i in P), F.lit(0.0))
    return params.withColumn("log_det", log_det).drop(*[f"c{i}{j}" for i in P for j in range(i + 1)])


def _measured(rows: DataFrame, one_sided: bool = False) -> DataFrame:
    """Adds ``d2``, the squared Mahalanobis distance to the estimate in columns m and l. One-sided: features 2 to 4 below the mean count as the mean.

    Each coordinate is a column of its own, so that the plan stays small.
    """
    for i, f in enumerate(FEATURES):
        d = F.col(f) - F.col(f"m{i}")
        d = F.greatest(d, F.lit(0.0)) if one_sided and i else d
        for k in range(i):
            d = d - F.col(f"l{i}{k}") * F.col(f"_z{k}")
        rows = rows.withColumn(f"_z{i}", d / F.col(f"l{i}{i}"))
    d2 = sum((F.col(f"_z{i}") * F.col(f"_z{i}") for i in P), F.lit(0.0))
    return rows.withColumn("d2", d2).drop(*[f"_z{i}" for i in P])


def _cell(d2: Column) -> Column:
    return F.floor(F.log1p(d2) * DISTANCE_CELLS).cast("long")


def levels(sizes: DataFrame, group: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(group, g) twice: the estimate g that judges each group, and the estimates that each group's documents go into.

    A group is judged by the first of its levels (itself, without its last column, ..., the whole table) that has ``LEAST`` documents.
    """
    level = F.lit(len(group))
    for k in reversed(range(len(group))):
        of_level = F.sum("n").over(W.partitionBy(*group[: len(group) - k])) if k else F.col("n")
        level = F.when(of_level >= LEAST, F.lit(k)).otherwise(level)
    judged = cut(sizes.withColumn("level", level), "quality-levels")
    fits = judged.select("level", *[F.when(F.col("level") < len(group) - i, F.col(c)).alias(f"_{c}") for i, c in enumerate(group)]).distinct()
    fits = cut(fits.withColumn("g", F.monotonically_increasing_id()), "quality-groups")
    judge = judged.join(fits.withColumnRenamed("level", "_level"), _same_level(group, F.col("level"))).select(*group, "g")
    feeds = None
    for k in range(len(group) + 1):
        on = _same(group[: len(group) - k])
        part = judged.drop("level").join(fits.where(F.col("level") == k), on).select(*group, "g")
        feeds = part if feeds is None else feeds.unionByName(part)
    return cut(judge, "quality-judges"), cut(feeds, "quality-feeds")


def _same_level(group: tuple[str, ...], level: Column) -> Column:
    out = level == F.col("_level")
    for i, c in enumerate(group):
        out = out & F.when(level < len(group) - i, F.col(c)).eqNullSafe(F.col(f"_{c}"))
    return out


def fit(stats: DataFrame, group: tuple[str, ...] = GROUP) -> DataFrame:
    """The estimate that judges each group, from rows with ``FEATURES``, ``_digest`` and ``base_failed``: its mean m, Cholesky factor l, and scale."""
    good = stats.where(~F.col("base_failed")).select(*group, *FEATURES, "_digest")
    judges, feeds = levels(good.groupBy(*group).agg(F.count("*").alias("n")), group)
    most = feeds.count() * (2 + DRAWN)  # estimates and starts at most: each estimate is fed by a group or more
    few, sent = max(1, most // 50_000), most <= MOST_SENT  # files of the state, a row per estimate and start
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("_salt")
    rows = cut(_with(good, feeds, group, "inner").select("g", *FEATURES, "_digest", salt), "quality-rows")
    starts = _medians(rows).withColumn("s", F.lit(0)).unionByName(_moments(rows, "g").withColumn("s", F.lit(1))).unionByName(_drawn(rows))
    state = cut(_factor(starts).withColumn("log_det", F.lit(float("inf"))).withColumn("moves", F.lit(True)).repartition(few), "quality-start")
    names = [*_MEANS, *_FACTORS, "log_det"]
    for _ in range(STEPS):
        moving = state.where("moves").select("g", "s", *_MEANS, *_FACTORS)
        if moving.isEmpty():
            break
        found = _factor(_core_moments(_beside(rows, moving, sent))).select(F.col("g").alias("_g"), F.col("s").alias("_s"), F.struct(*names).alias("new"))
        falls = F.coalesce(F.col("new.log_det") < F.col("log_det") - FALL, F.lit(False))
        old, after = state, state.join(found, (F.col("g") == F.col("_g")) & (F.col("s") == F.col("_s")), "left")
        after = after.select("g", "s", *[F.when(falls, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in names], falls.alias("moves"))
        state = cut(after.coalesce(few), "quality-step")
        free(old)
    best = state.groupBy("g").agg(F.min(F.struct("log_det", "s", *_MEANS, *_FACTORS)).alias("b")).select("g", *[f"b.{c}" for c in (*_MEANS, *_FACTORS)])
    best = cut(best.repartition(few), "quality-best")
    cells = cut(_measured(_beside(rows, best, sent)).groupBy("g", _cell(F.col("d2")).alias("cell")).agg(F.count("*").alias("n")), "quality-spread")
    middle = _rank_cell(cells, ["g"], 0.5, "middle").withColumn("scale", F.greatest(F.lit(1.0), F.expm1(F.col("middle") / DISTANCE_CELLS) / MEDIAN))
    out = cut(judges.join(best, "g").join(middle.drop("middle"), "g").drop("g"), "quality-fit")
    free(rows, state, best)
    return out


def judge(docs: DataFrame, group: tuple[str, ...] = GROUP) -> DataFrame:
    """The input with the columns of ``ADDED``. Statistics are taken once, and written beside the rows."""
    row = F.struct(*[c for c in docs.columns if c not in ADDED]).alias("row")
    stats = cut(features(statistics(docs.select(row, *group, "text"))).drop("text"), "quality-documents")
    return verdict(stats, fit(stats, group), group).select("row.*", *ADDED)


def verdict(stats: DataFrame, params: DataFrame, group: tuple[str, ...] = GROUP) -> DataFrame:
    out = _measured(_with(stats, params, group), one_sided=True).withColumn("distance2", F.col("d2") / F.col("scale"))
    # one sum, not a conjunction: parts of a conjunction would be pushed below the join and take the statistics once more
    badness = F.coalesce(F.col("distance2"), F.lit(0.0)) + F.when(F.col("base_failed"), F.lit(1e9)).otherwise(F.lit(0.0))
    out = out.withColumn("kept", badness <= CUTOFF)
    return out.drop(*[c for c in params.columns if c not in group], *FEATURES, "_digest", "d2")


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", *GROUP)
    stats = cut(features(statistics(docs)).drop("text"), "quality-documents")
    return verdict(stats, fit(stats)).select("doc_id", *BASE, "base_failed", "kept")


def sql() -> str:
    """The same rules in DuckDB's SQL: base statistics, levels, starts, concentration steps, the choice among them, and the verdict."""
    same = "{0}.lang IS NOT DISTINCT FROM {1}.lang AND {0}.source IS NOT DISTINCT FROM {1}.source"
    factor = ", ".join(
        (f"sqrt(greatest({{rest}}, {FLOORS[i] ** 2!r}::DOUBLE))" if i == j else f"({{rest}}) / l{j}{j}").format(
            rest=f"c{i}{j}" + (f" + {FLOORS[i] ** 2!r}::DOUBLE" if i == j else "") + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
        ) + f" AS l{i}{j}" for i in P for j in range(i + 1)
    )
    factor += f", 2.0::DOUBLE * ({' + '.join(f'ln(l{i}{i})' for i in P)}) AS log_det"
    names = [*_MEANS, *_FACTORS, "log_det"]

    def distances(rows: str, params: str, one_sided: bool = False) -> str:
        """Rows r and estimates q that belong together, with squared distances d2."""
        z = []
        for i, f in enumerate(FEATURES):
            d = f"({f} - m{i})"
            d = f"greatest({d}, 0)" if one_sided and i else d
            z.append(f"({d}{''.join(f' - l{i}{k} * z{k}' for k in range(i))}) / l{i}{i} AS z{i}")
        return f"SELECT r.*, q.* EXCLUDE (g), {', '.join(z)}, {' + '.join(f'z{i} * z{i}' for i in P)} AS d2 FROM {rows} r LEFT JOIN {params} q ON r.g = q.g"

    first = ", ".join([f"max(m) FILTER (k = {i + 1}) / {CELLS}.0::DOUBLE AS m{i}" for i in P] + [f"power(1.4826::DOUBLE * max(s) FILTER (k = {i + 1}) / {CELLS}, 2) AS c{i}{i}" for i in P] + [f"0.0::DOUBLE AS c{i}{j}" for i in P for j in range(i)])
    means = ", ".join([f"avg({FEATURES[i]}) AS m{i}" for i in P])
    spreads = ", ".join([f"avg({FEATURES[i]} * {FEATURES[j]}) - avg({FEATURES[i]}) * avg({FEATURES[j]}) AS c{i}{j}" for i in P for j in range(i + 1)])
    picks = ", ".join(f"arg_min({{{', '.join(f'{f!r}: {f}' for f in FEATURES)}}}, substr(digest || digest, {1 + 3 * k}, 32))" for k in range(DRAWN * EACH))
    out = rf"""WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
each AS (SELECT doc_id, generate_subscripts(w, 1) AS k, unnest(w) AS x FROM w),
win AS (SELECT *, string_agg(x, ' ') OVER ahead AS s, count(*) OVER ahead = 3 AS whole FROM each WINDOW ahead AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
often AS (SELECT doc_id, k, whole AND count(*) OVER (PARTITION BY doc_id, whole, s) > 1 AS often FROM win),
covered AS (SELECT doc_id, max(often::INT) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c FROM often),
repeated AS (SELECT doc_id, sum(c)::BIGINT AS n_repeat_words FROM covered GROUP BY doc_id),
stats AS (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(l) AS n_lines
  FROM w LEFT JOIN repeated USING (doc_id)),
f AS MATERIALIZED (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed, ln(greatest(word_chars, 1) / greatest(n_words, 1)::DOUBLE) AS f1,
  ln(1.0::DOUBLE + 1000.0::DOUBLE * n_symbols / greatest(word_chars, 1)) AS f2, sqrt(n_dup_lines / greatest(n_lines, 1)::DOUBLE) AS f3, sqrt(n_repeat_words / greatest(n_words, 1)::DOUBLE) AS f4 FROM stats),
good AS MATERIALIZED (SELECT lang, source, {', '.join(FEATURES)}, md5(concat_ws('/', {', '.join(BASE)}, n_lines)) AS digest FROM f WHERE NOT base_failed),
sizes AS (SELECT lang, source, count(*) AS n FROM good GROUP BY ALL),
levels AS (SELECT lang, source, CASE WHEN n >= {LEAST} THEN 0 WHEN sum(n) OVER (PARTITION BY lang) >= {LEAST} THEN 1 ELSE 2 END AS level FROM sizes),
fits AS MATERIALIZED (SELECT *, row_number() OVER () AS g FROM (SELECT DISTINCT level, CASE WHEN level < 2 THEN lang END AS lang, CASE WHEN level < 1 THEN source END AS source FROM levels)),
judges AS MATERIALIZED (SELECT v.lang, v.source, g FROM levels v JOIN fits q ON v.level = q.level AND (v.level > 1 OR v.lang IS NOT DISTINCT FROM q.lang) AND (v.level > 0 OR v.source IS NOT DISTINCT FROM q.source)),
rows AS MATERIALIZED (SELECT g, r.* EXCLUDE (lang, source) FROM good r JOIN fits q ON (level > 1 OR r.lang IS NOT DISTINCT FROM q.lang) AND (level > 0 OR r.source IS NOT DISTINCT FROM q.source)),
cells AS (SELECT g, unnest([1, 2, 3, 4]) AS k, round(unnest([{', '.join(FEATURES)}]) * {CELLS})::BIGINT AS cell FROM rows),
middle AS (SELECT g, k, quantile_disc(cell, 0.5) AS m FROM cells GROUP BY ALL),
away AS (SELECT c.g, c.k, any_value(m) AS m, quantile_disc(abs(cell - m), 0.5) AS s FROM cells c JOIN middle q ON c.k = q.k AND c.g = q.g GROUP BY ALL),
picked AS (SELECT g, unnest(range({DRAWN * EACH})) // {EACH} + 2 AS s, unnest([{picks}]) AS x FROM rows GROUP BY g),
starts AS (
  SELECT g, 0 AS s, {first} FROM away GROUP BY g
  UNION ALL BY NAME SELECT g, 1 AS s, {means}, {spreads} FROM rows GROUP BY g
  UNION ALL BY NAME SELECT g, s, {means}, {spreads} FROM (SELECT g, s, unnest(x) FROM picked) GROUP BY g, s),
p0 AS MATERIALIZED (SELECT * REPLACE ('inf'::DOUBLE AS log_det) FROM (SELECT *, {factor} FROM starts)),
"""
    for t in range(STEPS):
        out += f"""t{t} AS MATERIALIZED (SELECT g, s, {', '.join(FEATURES)}, floor(ln(1 + d2) * {DISTANCE_CELLS})::BIGINT AS cell FROM ({distances('rows', f'p{t}')})),
e{t} AS (SELECT g, s, quantile_disc(cell, {CORE}) AS edge FROM t{t} GROUP BY ALL),
n{t} AS MATERIALIZED (SELECT *, {factor} FROM (SELECT g, s, {means}, {spreads} FROM t{t} r JOIN e{t} q USING (g, s) WHERE cell <= edge GROUP BY g, s)),
p{t + 1} AS MATERIALIZED (SELECT o.g, o.s, {', '.join(f'CASE WHEN n.log_det < o.log_det - {FALL!r}::DOUBLE THEN n.{c} ELSE o.{c} END AS {c}' for c in names)} FROM p{t} o JOIN n{t} n USING (g, s)),
"""
    return out + f"""best AS MATERIALIZED (SELECT g, {', '.join(f'arg_min({c}, [log_det, s]) AS {c}' for c in (*_MEANS, *_FACTORS))} FROM p{STEPS} GROUP BY g),
spread AS (SELECT g, greatest(1.0::DOUBLE, (exp(quantile_disc(floor(ln(1 + d2) * {DISTANCE_CELLS})::BIGINT, 0.5) / {DISTANCE_CELLS}.0::DOUBLE) - 1) / {MEDIAN}::DOUBLE) AS scale FROM ({distances('rows', 'best')}) GROUP BY g),
named AS (SELECT f.*, g FROM f LEFT JOIN judges j ON {same.format('f', 'j')}),
judged AS (SELECT v.*, scale FROM ({distances('named', 'best', True)}) v LEFT JOIN spread s USING (g))
SELECT doc_id, {', '.join(BASE)}, base_failed, NOT base_failed AND NOT coalesce(d2 / scale > {CUTOFF}::DOUBLE, FALSE) AS kept FROM judged"""
