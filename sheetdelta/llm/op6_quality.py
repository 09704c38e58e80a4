"""Quality rules with robust multivariate outliers, in DataFrame and SQL functions only.

Every text gets counts (words, symbols, repeated lines, words in repeated 5-word windows); two plain rules reject on them.
The rest are judged by group (language and source; groups under 50 rows pool by language, then all together): four
transformed statistics, damped for short texts and rounded to a grid, are compared with a minimum-covariance-determinant
estimate of their centre and spread:

1. Five deterministic starts: medians with quartile spreads; means with covariances; medians with the correlations of squashed
   scores; lower and upper quartiles with quartile spreads.
2. Concentration steps from each: the 75 percent of rows that lie nearest give the next centre and covariance.  A start goes on
   as long as the determinant falls; a step that does not lower it is not taken.  Steps have no limit: each lowers the logarithm of
   the determinant by SETTLED at least, and the floors bound it from below.
3. The start with the least determinant is the estimate, followed by one reweighted step.

Spreads have a floor, since most texts have no symbols or repeats at all; determinants are of the covariance with floors.  A row is
rejected if its squared Mahalanobis distance is over the 1 - 1e-6 quantile of chi-squared with 4 degrees.

Rows with equal rounded statistics are one weighted cell, so every step reads cells, whose number is bounded by the grid and not
by the rows.  The edge of the nearest 75 percent comes from counts of distance classes, and the class on the edge counts in part,
so no task ever holds a group.  Every row of the table counts in every estimate.

Defined results: a null text has no words and fails the base rule; null lang or source is a group of its own; rows of equal
statistics have one verdict; repeated rows each get a row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, small_side, table

#: Least group, share of a concentration step, quantiles of chi-squared with 4 degrees of freedom, and
#: the factors that make the spread of a trimmed sample consistent for normal data.
MIN_GROUP, SHARE = 50, 0.75
CUTOFF, REWEIGHT = 33.38, 11.14
FACTOR_SHARE, FACTOR_REWEIGHT = 1.485, 1.064
FLOORS = [0.06, 0.3, 0.3, 0.3]
GRID = [0.01, 0.02, 0.02, 0.02]
#: Distance classes to a factor of e, and the fall of the logarithm of the determinant below which a start has settled.
CLASSES, SETTLED = 200, 1e-9
BROADCAST = 100_000
SPACE = r"[\x20\x09-\x0D]+"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
X = [f"_x{i}" for i in range(4)]
PAIRS = list(combinations_with_replacement(range(4), 2))
STATE = [f"_m{i}" for i in range(4)] + [f"_t{i}{j}" for i in range(4) for j in range(i + 1)]


def _held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add an array column that later lambdas may read again and again: a generator keeps Spark from working it out each time."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and the counts of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(*keep, text.alias("_text"))
    inner = F.btrim("_text", F.lit(" \t\n\x0b\x0c\r"))
    df = _held(df, "_words", F.when(inner != "", F.split(inner, SPACE)).otherwise(F.expr("cast(array() as array<string>)")))
    n = F.size("_words")
    window = F.transform(F.slice("_words", F.lit(1), F.greatest(n - 4, F.lit(0))), lambda w, i: F.xxhash64(w, *[F.get("_words", i + k) for k in range(1, 5)]))
    df = _held(df, "_windows", F.when(n >= 5, window).otherwise(F.expr("cast(array() as array<bigint>)")))
    again = F.size(F.array_distinct("_windows")) < F.size("_windows")
    pairs = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = _held(df, "_sorted", F.when(again, pairs))
    near = F.transform(
        "_sorted",
        lambda x, i: F.when(
            (i > 0) & F.get("_sorted", i - 1)["h"].eqNullSafe(x["h"]) | F.get("_sorted", i + 1)["h"].eqNullSafe(x["h"]), x["i"]
        ),
    )
    df = _held(df, "_places", F.sort_array(F.filter(near, lambda p: p.isNotNull())))
    covered = F.aggregate(
        "_places",
        F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(5), p - acc["last"])).alias("n"), p.alias("last")),
        lambda acc: acc["n"],
    )
    df = _held(df, "_lines", F.filter(F.split("_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    return df.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.char_length("_text") - F.char_length(F.regexp_replace("_text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("_n_lines"),
    )


def _statistics(df: DataFrame) -> DataFrame:
    n = F.col("n_words")
    values = [
        F.log((F.col("word_chars") + 250) / (n + 50)),
        F.log1p(50 * F.col("n_symbols") / (n + 20)),
        F.log1p(10 * F.col("n_dup_lines") / (F.col("_n_lines") + 5)),
        F.log1p(10 * F.col("n_repeat_words") / (n + 20)),
    ]
    failed = (n < 10) | (100 * F.col("n_repeat_words") > 20 * n)
    return df.select("*", failed.alias("base_failed"), *[(F.round(v / g) * g).alias(x) for v, x, g in zip(values, X, GRID)])


def _named_groups(df: DataFrame) -> DataFrame:
    lang = F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-"))
    source = F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))
    return df.withColumns({"_l": lang, "_s": source})


def _groups(df: DataFrame) -> DataFrame:
    """(_l, _s, _g): the group in which the rows of a language and source are judged."""
    each = _named_groups(df).where(~F.col("base_failed")).groupBy("_l", "_s").agg(F.count("*").alias("n"))
    each = materialise(each, "group-sizes")
    pooled = each.where(F.col("n") < MIN_GROUP).groupBy("_l").agg(F.sum("n").alias("pool"))
    named = each.join(pooled, "_l", "left").select(
        "_l",
        "_s",
        F.when(F.col("n") >= MIN_GROUP, F.concat_ws("\u001f", "_l", "_s"))
        .when(F.col("pool") >= MIN_GROUP, F.concat("_l", F.lit("\u001f*")))
        .otherwise("*")
        .alias("_g"),
    )
    return small_side(materialise(named, "groups"), BROADCAST)


def _grouped(df: DataFrame, groups: DataFrame) -> DataFrame:
    return _named_groups(df).join(groups, ["_l", "_s"], "left").withColumn("_g", F.coalesce("_g", F.lit("*"))).drop("_l", "_s")


def _factor(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, centre, Cholesky factor, logarithm of the determinant) from centre (_m0, ...) and covariance (_c00, _c01, ...) columns,
    floors added to the variances."""
    t = []
    for j in range(4):
        for i in range(j, 4):
            dot = " + ".join([f"_t{i}{k} * _t{j}{k}" for k in range(j)] or ["0"])
            if i == j:
                # What the earlier statistics leave unexplained is at least the floor, apart from rounding.
                t.append(f"sqrt(greatest(_c{j}{j} + {FLOORS[j] ** 2!r}D - ({dot}), {FLOORS[j] ** 2 / 2!r}D)) AS _t{j}{j}")
            else:
                t.append(f"(_c{j}{i} - ({dot})) / _t{j}{j} AS _t{i}{j}")
    return df.selectExpr(*keys, *STATE[:4], *t).selectExpr(*keys, *STATE, "2 * (ln(_t00) + ln(_t11) + ln(_t22) + ln(_t33)) AS _logdet")


def _distance(df: DataFrame) -> DataFrame:
    """Adds ``_d``, the squared Mahalanobis distance of a row to the estimate beside it, by forward substitution."""
    z = [f"({X[i]} - _m{i} - ({' + '.join([f'_t{i}{k} * _z{k}' for k in range(i)] or ['0'])})) / _t{i}{i} AS _z{i}" for i in range(4)]
    return df.selectExpr("*", *z, "_z0 * _z0 + _z1 * _z1 + _z2 * _z2 + _z3 * _z3 AS _d")


def _sums(x: list[str]) -> list[Column]:
    """Sums of the weights, of the values and of their products."""
    terms = {"n": "_w", **{f"s{i}": f"_w * {x[i]}" for i in range(4)}, **{f"q{i}{j}": f"_w * {x[i]} * {x[j]}" for i, j in PAIRS}}
    return [F.expr(f"sum({term}) AS {name}") for name, term in terms.items()]


def _from_sums(factor: float) -> tuple[list[str], dict[tuple[int, int], str]]:
    """Centre and covariance from the columns of ``_sums``."""
    cov = {(i, j): f"(q{i}{j} / n - s{i} / n * s{j} / n) * {factor!r}D" for i, j in PAIRS}
    return [f"s{i} / n" for i in range(4)], cov | {(i, i): f"greatest({cov[i, i]}, 0D)" for i in range(4)}


def _named(mean: list[str], cov: dict[tuple[int, int], str]) -> dict[str, str]:
    return {f"_m{i}": m for i, m in enumerate(mean)} | {f"_c{i}{j}": c for (i, j), c in cov.items()}


def _moments(sums: DataFrame, factor: float, keys: list[str]) -> DataFrame:
    return _factor(sums.selectExpr(*keys, *[f"{e} AS {c}" for c, e in _named(*_from_sums(factor)).items()]), keys)


def _starts(cells: DataFrame) -> DataFrame:
    """The deterministic starts of every group: _g, _start, centre, factor, _logdet (infinite: any step is taken)."""
    quartiles = [F.expr(f"percentile({c}, array(0.25, 0.5, 0.75), cast(_w AS bigint)) AS p{i}") for i, c in enumerate(X)]
    # Spreads of the middle half, never under the floor.
    width = [f"sqrt(power((p{i}[2] - p{i}[0]) / 1.349D, 2) + {FLOORS[i] ** 2!r}D) AS w{i}" for i in range(4)]
    q = materialise(cells.groupBy("_g").agg(*quartiles, *_sums(X)).selectExpr("*", *width), "quartiles")
    beside = q.select("_g", *[f"{c}{i}" for c in "pw" for i in range(4)])
    score = cells.join(small_side(beside, BROADCAST), "_g").selectExpr("_g", "_w", *[f"tanh(({c} - p{i}[1]) / w{i}) AS _y{i}" for i, c in enumerate(X)])
    _, cov = _from_sums(1.0)
    tied = [f"({cov[i, j]}) / sqrt(({cov[i, i]} + 1e-4D) * ({cov[j, j]} + 1e-4D)) AS r{i}{j}" for i, j in PAIRS]
    q = q.join(score.groupBy("_g").agg(*_sums([f"_y{i}" for i in range(4)])).selectExpr("_g", *tied), "_g")
    alone = {(i, j): f"w{i} * w{i}" if i == j else "0D" for i, j in PAIRS}
    linked = {(i, j): f"w{i} * w{i}" if i == j else f"r{i}{j} * w{i} * w{j}" for i, j in PAIRS}
    quarter = [[f"p{i}[{k}]" for i in range(4)] for k in range(3)]
    ways = [(quarter[1], alone), _from_sums(1.0), (quarter[1], linked), (quarter[0], alone), (quarter[2], alone)]
    rows = [f"named_struct('_start', {k}, {', '.join(f"'{c}', {e}" for c, e in _named(*way).items())})" for k, way in enumerate(ways)]
    return _factor(q.selectExpr("_g", f"inline(array({', '.join(rows)}))"), ["_g", "_start"]).withColumn("_logdet", F.lit(float("inf")))


def _concentrate(cells: DataFrame, state: DataFrame) -> DataFrame:
    """One concentration step of every (group, start) of ``state``."""
    keys = ["_g", "_start"]
    placed = _distance(cells.join(state, "_g")).withColumn("_b", F.floor(F.log1p("_d") * CLASSES).cast("int"))
    # One row per group, start and distance class: a few thousand classes at most, whatever the number of rows.
    classes = placed.groupBy(*keys, "_b").agg(*_sums(X))
    # The class on the edge counts in part, so that exactly the nearest 75 percent do.
    by = "OVER (PARTITION BY _g, _start"
    part = f"least(1D, (ceil({SHARE} * sum(n) {by}) - 1e-9D) - (sum(n) {by} ORDER BY _b) - n)) / n) AS _part"
    names = ["n", *[f"s{i}" for i in range(4)], *[f"q{i}{j}" for i, j in PAIRS]]
    parts = classes.selectExpr("*", part).where("_part > 0").groupBy(*keys).agg(*[F.expr(f"sum(_part * {c}) AS {c}") for c in names])
    return _moments(parts, FACTOR_SHARE, keys)


def covariance_determinant(cells: DataFrame) -> DataFrame:
    """The estimate of least determinant of every group of ``cells`` (_g, the statistics, weight _w): _g, centre, factor, _logdet."""
    state = materialise(_starts(cells).withColumn("_open", F.lit(True)), "starts")
    while True:
        still = state.where("_open").select("_g", "_start", *STATE)
        n = still.count()
        if not n:
            break
        step = _concentrate(cells, F.broadcast(still) if n <= BROADCAST else still)
        columns = [*STATE, "_logdet"]
        both = state.join(step.selectExpr("_g", "_start", *[f"{c} AS {c}_new" for c in columns]), ["_g", "_start"], "left")
        both = both.selectExpr("_g", "_start", *columns, *[f"{c}_new" for c in columns], f"coalesce(_logdet_new < _logdet - {SETTLED!r}D, false) AS _falls")
        state = materialise(both.selectExpr("_g", "_start", *[f"if(_falls, {c}_new, {c}) AS {c}" for c in columns], "_falls AS _open"), "steps")
    columns = [*STATE, "_logdet"]
    best = state.groupBy("_g").agg(F.expr(f"min_by(struct({', '.join(columns)}), struct(_logdet, _start)) AS best"))
    return materialise(best.select("_g", "best.*"), "least")


def cells_of(rows: DataFrame) -> DataFrame:
    """Weighted cells of ``rows`` (_g and the statistics)."""
    return materialise(rows.groupBy("_g", *X).agg(F.count("*").cast("double").alias("_w")), "cells")


def estimate(cells: DataFrame) -> DataFrame:
    """Centre and spread of every group of ``cells``: least determinant, then one reweighted step."""
    near = _distance(cells.join(small_side(covariance_determinant(cells), BROADCAST), "_g")).where(F.col("_d") <= REWEIGHT)
    return materialise(_moments(near.groupBy("_g").agg(*_sums(X)), FACTOR_REWEIGHT, ["_g"]), "spread")


def judge(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` as a struct ``doc``, the counts, base_failed, kept and distance2 of every row.

    Statistics are worked out once and written for all steps, with ``keep`` beside them, so ``keep`` should be narrow."""
    doc = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_doc")
    rows = _statistics(counts(docs.select(doc, F.col("text").cast("string").alias("text"), "lang", "source"), ["_doc", "lang", "source"]))
    rows = materialise(rows.select("_doc", "lang", "source", *COUNTS, "base_failed", *X), "statistics")
    rows = _grouped(rows, _groups(rows))
    spread = small_side(estimate(cells_of(rows.where(~F.col("base_failed")).select("_g", *X))), BROADCAST)
    kept = ~F.col("base_failed") & (F.coalesce(F.col("_d"), F.lit(0.0)) <= CUTOFF)
    placed = _distance(rows.join(spread, "_g", "left"))
    return placed.select(F.col("_doc").alias("doc"), *COUNTS, "base_failed", kept.alias("kept"), F.col("_d").alias("distance2"))


def _content(*names: str) -> Column:
    """A digest of columns; each with its length, so that no two rows of different values share the digested text."""
    parts = []
    for name in names:
        c = F.col(name).cast("string")
        parts += [F.coalesce(F.length(c), F.lit(-1)).cast("string"), F.coalesce(c, F.lit(""))]
    return F.unhex(F.sha2(F.concat_ws("\u001f", *parts), 256))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the rules keep.

    A verdict follows from language, source and text alone, so rows carry a digest of these through the judgement, and those of
    rejected digests leave by one join.  Texts are worked through once and shuffled once, at every size."""
    key = "_row"
    while key in {c.lower() for c in docs.columns}:
        key += "_"
    keyed = docs.withColumn(key, _content("lang", "source", "text"))
    judged = judge(keyed.select(key, "text", "lang", "source"), [key])
    rejected = judged.where(~F.coalesce("kept", F.lit(False))).select(F.col("doc")[key].alias(key)).distinct()
    kept = keyed.join(materialise(rejected, "rejected").hint("merge"), key, "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc.doc_id", *COUNTS, "base_failed", "kept")
