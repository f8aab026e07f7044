"""Quality rules: fixed base rules, and robust multivariate outliers (DataFrame functions only).

`statistics` reads each text once and gives counts. Documents that pass the base rules are then
judged by their transformed statistics: minimum-covariance-determinant estimates of centre and
scatter for each language and source, and the Mahalanobis distance to them. There are three
deterministic starts, from medians and interquartile ranges: their diagonal, the covariance of spatial
signs, and that of bounded (tanh) scores. From each start, concentration steps take mean and covariance
of the `H` part of a group's rows that lie nearest; for each group the start whose core has the least
determinant wins. A last step reweights: mean and covariance of all rows within the 0.975 chi-squared
quantile of that estimate. Covariances are scaled to what they are for a normal law.
Quantiles come from counts in fixed classes, and sums are pre-aggregated, so a hot source is never
gathered in a task; the table of estimates, a row for each language, source and start, is joined
by key and salt, with as many salts as the largest group needs. Variances have a floor, the tolerance
of each statistic, so that a group without spread does not reject all that differs a little.

n_dup_lines is counted but not judged: lines repeat in many good documents.

Defined cases: null text has no words, so it fails the base rules; null language or source is a
group of its own; groups of fewer than `MIN_GROUP` rows past the base rules are estimated together, as
one pool, however small; repeated rows are judged each on its own, null ids too; an empty table gives
an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS_CLASS, Scratch, let, unused

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: Part of a group that a core is made of, and what scales its covariance to that of a normal law of four dimensions.
H, CONSISTENCY = 0.75, 1.49
STEPS = 3
#: Squared distance within which rows make the last estimate, the 0.975 chi-squared quantile of four dimensions, and its scale.
NEAR, NEAR_CONSISTENCY = 11.143, 1.0645
#: Smaller groups are estimated together.
MIN_GROUP = 30
#: Squared distance beyond which a document is rejected: the 0.9999 quantile of the chi-squared law of four dimensions.
CUTOFF = 23.51
#: Transformed statistics and their least standard deviation.
FEATURES = {"x_words": 0.5, "x_length": 0.1, "x_symbols": 0.12, "x_repeat": 0.15}
#: Width, in asinh of the value, of the classes that quantiles are counted in: 0.002 near zero, 0.2 % of
#: large values, so that the number of classes grows with the logarithm of the largest value alone.
CLASS_WIDTH = 0.002
#: Rows of one group that meet its estimates in one task, about.
SALT_ROWS = 50_000


def _repeated(words: Column) -> Column:
    """Words that lie in 8-word windows found twice or more, from hashes of windows."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def paired(gap: int):
        return lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + gap)))

    for gap in (1, 2, 4):
        hashes = let(hashes, paired(gap))

    def covered(windows: Column) -> Column:
        by_hash = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def at(s: Column) -> Column:
            twice = lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(F.transform(s, lambda x, i: F.struct(x["i"].alias("i"), twice(x, i).alias("t"))), lambda x: x["t"]), lambda x: x["i"]))

        def total(p: Column) -> Column:
            spans = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
            return F.aggregate(spans, F.lit(0).cast("bigint"), lambda a, x: a + x)

        none = F.lit(0).cast("bigint")
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), none).otherwise(let(let(by_hash, at), total))

    return F.when(F.size(words) > WINDOW, let(F.slice(hashes, 1, F.size(words) - (WINDOW - 1)), covered)).otherwise(F.lit(0).cast("bigint"))


def statistics(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def of(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            F.char_length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
            _repeated(words).alias("n_repeat_words"),
        )

    lines = F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(f"[^{WS_CLASS}]")))
    keys = docs.columns
    out = docs.withColumns({
        unused(docs, "stats"): let(F.array_remove(F.split(text, f"[{WS_CLASS}]+", -1), ""), of),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("bigint"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"),
    })
    out = out.select(*keys, "n_symbols", "n_dup_lines", f"{unused(docs, 'stats')}.*")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def features(stats: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return stats.withColumns({
        "x_words": F.ln(n),
        "x_length": F.ln(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        "x_symbols": F.sqrt(F.col("n_symbols") / n),
        "x_repeat": F.sqrt(F.col("n_repeat_words") / n),
    })


def _quantiles(df: DataFrame, keys: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """Columns named by `at`: quantiles of `value` by key, to a class width, from counts by class, a few thousand a key."""
    counts = df.groupBy(*keys, F.floor(F.asinh(F.col(value)) / CLASS_WIDTH).alias("klass")).agg(F.count("*").alias("c"))
    ordered = Window.partitionBy(*keys).orderBy("klass")
    summed = counts.select(*keys, "klass", F.sum("c").over(ordered).alias("upto"), F.sum("c").over(Window.partitionBy(*keys)).alias("all"))
    least = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.sinh((F.col("klass") + 1) * CLASS_WIDTH)))
    return summed.groupBy(*keys).agg(*(least(q).alias(name) for name, q in at.items()))


def _distance(rows: DataFrame) -> DataFrame:
    """Adds d2 = |L^-1 (x - m)|^2 from columns m_i and l_i_j."""
    names = list(FEATURES)
    for i, x in enumerate(names):
        left = F.col(x) - F.col(f"m_{i}")
        for j in range(i):
            left = left - F.col(f"l_{i}_{j}") * F.col(f"y_{j}")
        rows = rows.withColumn(f"y_{i}", left / F.col(f"l_{i}_{i}"))
    total = sum((F.col(f"y_{i}") * F.col(f"y_{i}") for i in range(1, len(names))), F.col("y_0") * F.col("y_0"))
    return rows.withColumn("d2", total).drop(*(f"y_{i}" for i in range(len(names))))


def _cholesky(groups: DataFrame) -> DataFrame:
    """c_i_j (i >= j) to l_i_j."""
    k = len(FEATURES)
    for i in range(k):
        for j in range(i + 1):
            rest = F.col(f"c_{i}_{j}")
            for m in range(j):
                rest = rest - F.col(f"l_{i}_{m}") * F.col(f"l_{j}_{m}")
            groups = groups.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l_{j}_{j}"))
    return groups.drop(*(f"c_{i}_{j}" for i in range(k) for j in range(i + 1)))


def _joined(rows: DataFrame, groups: DataFrame, keys: list[str], salts: int, how: str = "inner") -> DataFrame:
    """By group and salt: a hot group's rows meet `salts` copies of its one row in `groups`, in as many tasks."""
    copies = groups.withColumn("salt", F.explode(F.expr(f"sequence(0L, {salts - 1}L)")))
    return rows.withColumn("salt", F.pmod("h", F.lit(salts))).join(copies, [*keys, "salt"], how).drop("salt")


def _diagonal(scales: list[Column]) -> dict[str, Column]:
    return {f"l_{i}_{j}": scales[i] if i == j else F.lit(0.0) for i in range(len(scales)) for j in range(i + 1)}


def _starts(rows: DataFrame, salts: int, scratch: Scratch) -> DataFrame:
    """g, start, centre and Cholesky factor of each group's starts."""
    names, k = list(FEATURES), len(FEATURES)
    long = rows.select("g", F.explode(F.array(*(F.struct(F.lit(i).alias("f"), F.col(x).alias("x")) for i, x in enumerate(names)))).alias("v")).select("g", "v.f", "v.x")
    spread = _quantiles(long, ["g", "f"], "x", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    first = spread.groupBy("g").agg(*(F.max(F.when(F.col("f") == i, F.col(q))).alias(f"{q}_{i}") for i in range(k) for q in ("q1", "q2", "q3")))
    scale = [F.greatest((F.col(f"q3_{i}") - F.col(f"q1_{i}")) / 1.349, F.lit(floor)) for i, floor in enumerate(FEATURES.values())]
    robust = scratch.keep(first.select("g", *(F.col(f"q2_{i}").alias(f"m_{i}") for i in range(k)), *(c.alias(f"w_{i}") for i, c in enumerate(scale))), "robust")
    z = _joined(rows, robust, ["g"], salts).select("g", *((F.col(x) - F.col(f"m_{i}")).alias(f"d_{i}") for i, x in enumerate(names)), *(f"w_{i}" for i in range(k)))
    z = z.select("g", *((F.col(f"d_{i}") / F.col(f"w_{i}")).alias(f"z_{i}") for i in range(k)))
    norm = sum((F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(1, k)), F.col("z_0") * F.col("z_0"))
    sign = lambda i: F.col(f"z_{i}") / F.sqrt(F.greatest(norm, F.lit(1e-12)))
    scores = {1: sign, 2: lambda i: F.tanh(f"z_{i}")}
    sums = z.groupBy("g").agg(*(F.avg(of(i) * of(j)).alias(f"r{s}_{i}_{j}") for s, of in scores.items() for i in range(k) for j in range(i + 1)))
    both = robust.join(sums, "g")
    plain = both.select("g", F.lit(0).alias("start"), *(f"m_{i}" for i in range(k)), *(c.alias(n) for n, c in _diagonal([F.col(f"w_{i}") for i in range(k)]).items()))
    out = plain
    for s in scores:
        # their correlations, with the robust scales
        scaled = {f"c_{i}_{j}": F.col(f"w_{i}") * F.col(f"w_{j}") * ((F.lit(1.0) + 1e-3) if i == j else F.col(f"r{s}_{i}_{j}") / F.sqrt(F.greatest(F.col(f"r{s}_{i}_{i}") * F.col(f"r{s}_{j}_{j}"), F.lit(1e-12)))) for i in range(k) for j in range(i + 1)}
        out = out.unionByName(_cholesky(both.select("g", F.lit(s).alias("start"), *(f"m_{i}" for i in range(k)), *(c.alias(n) for n, c in scaled.items()))))
    return out


def _estimated(core: DataFrame, keys: list[str], consistency: float) -> DataFrame:
    """Centre and Cholesky factor of the rows of `core`, about their last centre, so that no large squares cancel."""
    names, k, floor = list(FEATURES), len(FEATURES), list(FEATURES.values())
    about = [F.col(x) - F.col(f"m_{i}") for i, x in enumerate(names)]
    products = [F.avg(about[i] * about[j]).alias(f"p_{i}_{j}") for i in range(k) for j in range(i + 1)]
    sums = core.groupBy(*keys).agg(*(F.avg(x).alias(f"m_{i}") for i, x in enumerate(names)), *products, *(F.avg(a).alias(f"s_{i}") for i, a in enumerate(about)))
    scatter = {f"c_{i}_{j}": consistency * (F.col(f"p_{i}_{j}") - F.col(f"s_{i}") * F.col(f"s_{j}")) + (floor[i] ** 2 if i == j else 0.0) for i in range(k) for j in range(i + 1)}
    return _cholesky(sums.select(*keys, *(f"m_{i}" for i in range(k)), *(c.alias(n) for n, c in scatter.items())))


def estimates(rows: DataFrame, salts: int, scratch: Scratch) -> DataFrame:
    """MCD centre and Cholesky factor of each group g, reweighted. `rows`: g, h (what salts are made from) and the features."""
    keys, k = ["g", "start"], len(FEATURES)
    groups = scratch.keep(_starts(rows, salts, scratch), "mcd")
    trials = rows.withColumn("start", F.explode(F.array(*map(F.lit, range(3)))))
    for _ in range(STEPS):
        near = _distance(_joined(trials, groups, keys, salts))
        limit = _quantiles(near, keys, "d2", {"limit": H})
        core = _joined(near, limit, keys, salts).filter(F.col("d2") <= F.col("limit"))
        groups = scratch.keep(_estimated(core, keys, CONSISTENCY), "mcd")
    root = F.col("l_0_0")
    for i in range(1, k):
        root = root * F.col(f"l_{i}_{i}")  # of the determinant
    values = [c for c in groups.columns if c not in keys]
    best = groups.groupBy("g").agg(F.min_by(F.struct(*values), F.struct(root.alias("root"), "start")).alias("best")).select("g", "best.*")
    within = _distance(_joined(rows, scratch.keep(best, "mcd"), ["g"], salts)).filter(F.col("d2") <= NEAR)
    return scratch.keep(_estimated(within, ["g"], NEAR_CONSISTENCY), "mcd")


def judge(docs: DataFrame, cutoff: float = CUTOFF, salt_rows: int = SALT_ROWS) -> DataFrame:
    """(doc_id, text, lang, source) to doc_id, the statistics, base_failed and kept."""
    scratch = Scratch()
    group = F.struct(F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    wanted = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64(F.to_json(group)).alias("g"))
    stats = scratch.keep(features(statistics(wanted)).drop("text").withColumn("h", F.xxhash64("doc_id", "word_chars", "n_words")), "stats")
    sizes = scratch.keep(stats.filter(~F.col("base_failed")).groupBy("g").count(), "sizes")
    largest = sizes.agg(F.max("count")).first()[0] or 0
    salts = max(1, math.ceil(largest / salt_rows))
    pooled = sizes.select("g", F.when(F.col("count") >= MIN_GROUP, F.col("g")).otherwise(F.lit(0)).alias("of"))
    placed = _joined(stats, pooled, ["g"], salts, "left").drop("g").withColumnRenamed("of", "g")
    groups = estimates(placed.filter(~F.col("base_failed")).select("g", "h", *FEATURES), salts, scratch)
    out = _distance(_joined(placed, groups, ["g"], salts, "left"))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= cutoff)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "d2")
