"""Quality rules: fixed limits on text statistics, then robust multivariate outliers.

Each (language, source) gets a minimum-covariance-determinant estimate of the
centre and scatter of transformed statistics: from two fixed starts,
concentration steps refit mean and covariance to the 75 % of rows nearest by
Mahalanobis distance, and the start with the smaller determinant wins.  Rows
beyond a chi-square cutoff are rejected.

Every step is one map-side combined aggregate over a staged, narrow table;
the nearest 75 % are found from counts of distance bins, so no group is ever
gathered or sorted in one task.  Only DataFrame functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.common import WORD_GAP, join_small, let, staged, words_of

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
SHARE = 0.75            # of a group's rows that an estimate rests on
BINS = 64               # bins in one unit of a logarithm or of a standardised value
STEPS = 3
DIMENSIONS = 4
# Added to the scatter's diagonal: most texts have no symbols and no repeats at all, so the inner rows alone
# have no scatter there and without these any symbol would be outlying.
FLOORS = (0.10, 0.06, 0.08, 0.08)


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of five words found twice or more in the text."""
    def from_windows(windows: Column) -> Column:
        def covered(order: Column) -> Column:
            def same(x: Column, j: Column, step: int) -> Column:
                return F.coalesce(F.get(order, j + F.lit(step))["k"] == x["k"], F.lit(False))
            twice = F.filter(order, lambda x, j: same(x, j, -1) | same(x, j, 1))
            return let(F.sort_array(F.transform(twice, lambda x: x["i"])), lambda starts: F.aggregate(
                F.transform(starts, lambda s, j: F.least(F.lit(WINDOW), F.coalesce(
                    F.get(starts, j + F.lit(1)) - s, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b))

        order = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("k"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(order, covered))

    def of_hashes(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - F.lit(WINDOW))
        return let(F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + F.lit(k)) for k in range(WINDOW)])),
                   from_windows)

    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(
        let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
               source_col: str = "source") -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = F.coalesce(docs[text_col], F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    found = docs.select(
        docs[id_col].cast("long").alias("doc_id"), docs[lang_col].alias("lang"), docs[source_col].alias("source"),
        let(words_of(text), lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w).cast("long").alias("n_repeat_words"))).alias("of_words"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    flat = found.select("doc_id", "lang", "source", "of_words.n_words", "of_words.word_chars", "n_symbols",
                        "n_dup_lines", "of_words.n_repeat_words")
    return flat.withColumn("base_failed", (F.col("n_words") < 10)
                           | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _vector() -> list[Column]:
    """Transformed statistics: log word length and square-root shares of symbols, repeated lines, repeated words."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    return [F.ln(chars / words), F.sqrt(F.col("n_symbols") / chars), F.sqrt(F.col("n_dup_lines") / words),
            F.sqrt(F.col("n_repeat_words") / words)]


def chi_square_cdf(x: float, k: int) -> float:
    """Chi-square distribution function by the series of the lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, z = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= z / n
        total += term
    return min(1.0, total * math.exp(a * math.log(z) - z - math.lgamma(a)))


def chi_square_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, k) < p else (low, mid)
    return high


def _with_scatter(df: DataFrame, carry: list[str]) -> DataFrame:
    """Mean, Cholesky factor and log-determinant from ``n``, ``s{i}`` and ``s{i}_{j}`` sums."""
    d = range(DIMENSIONS)
    df = df.select(*carry, *[(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in d], "n",
                   *[F.col(f"s{i}_{j}") for i in d for j in range(i + 1)])
    df = df.select(*carry, *[f"m{i}" for i in d], *[
        (F.col(f"s{i}_{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}") + F.lit(FLOORS[i] ** 2 if i == j else 0.0))
        .alias(f"c{i}_{j}") for i in d for j in range(i + 1)])
    for j in d:  # one column of the factor after another
        pivot = F.col(f"c{j}_{j}")
        for k in range(j):
            pivot = pivot - F.col(f"l{j}_{k}") * F.col(f"l{j}_{k}")
        df = df.withColumn(f"l{j}_{j}", F.sqrt(F.greatest(pivot, F.lit(1e-12))))
        for i in range(j + 1, DIMENSIONS):
            value = F.col(f"c{i}_{j}")
            for k in range(j):
                value = value - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
            df = df.withColumn(f"l{i}_{j}", value / F.col(f"l{j}_{j}"))
    logdet = sum((2 * F.ln(F.col(f"l{j}_{j}")) for j in d), F.lit(0.0))
    return df.select(*carry, *[f"m{i}" for i in d], *[f"l{i}_{j}" for i in d for j in range(i + 1)],
                     logdet.alias("logdet"))


def _distance(df: DataFrame, out: str) -> DataFrame:
    """Squared Mahalanobis distance of x0.. from m0.. by forward substitution."""
    for i in range(DIMENSIONS):
        value = F.col(f"x{i}") - F.col(f"m{i}")
        for k in range(i):
            value = value - F.col(f"l{i}_{k}") * F.col(f"_y{k}")
        df = df.withColumn(f"_y{i}", value / F.col(f"l{i}_{i}"))
    total = sum((F.col(f"_y{i}") * F.col(f"_y{i}") for i in range(DIMENSIONS)), F.lit(0.0))
    return df.withColumn(out, total).drop(*[f"_y{i}" for i in range(DIMENSIONS)])


def _sums() -> list[Column]:
    d = range(DIMENSIONS)
    return [F.count(F.lit(1)).alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in d],
            *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i in d for j in range(i + 1)]]


def _quantile_bins(df: DataFrame, keys: list[str], share: float) -> DataFrame:
    """(keys, cut): the smallest ``bin`` up to which at least ``share`` of a key's rows lie."""
    counts = df.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("c"))
    run = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.select(*keys, "bin", F.sum("c").over(run).alias("upto"),
                         F.sum("c").over(Window.partitionBy(*keys)).alias("all"))
    return upto.filter(F.col("upto") >= F.col("all") * share).groupBy(*keys).agg(F.min("bin").alias("cut"))


def _medians(df: DataFrame, values: list[Column]) -> DataFrame:
    """(grp, v0, v1, ...): medians, to a bin, of ``values`` in each group."""
    long = df.select("grp", F.posexplode(F.array(*[F.floor(v * BINS * 4) for v in values])).alias("dim", "bin"))
    cuts = _quantile_bins(long, ["grp", "dim"], 0.5)
    return cuts.groupBy("grp").agg(*[F.max(F.when(F.col("dim") == i, (F.col("cut") + 0.5) / (4 * BINS))).alias(f"v{i}")
                                     for i in range(len(values))])


def _attach(rows: DataFrame, by_group: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    return join_small(rows, by_group, keys, 400, F.col("at"), how=how)


def mcd_estimates(rows: DataFrame) -> DataFrame:
    """(grp, m0.., l0_0..): centre and scaled Cholesky factor of each group of ``rows`` (grp, at, x0..)."""
    d = range(DIMENSIONS)
    centre = staged(_medians(rows, [F.col(f"x{i}") for i in d]), "mcd-median")
    off = _attach(rows, centre, ["grp"])
    spread = _medians(off, [F.abs(F.col(f"x{i}") - F.col(f"v{i}")) for i in d])
    robust = (centre.join(spread.select("grp", *[F.col(f"v{i}").alias(f"w{i}") for i in d]), "grp").select(
        "grp", F.lit(0).alias("start"), *[F.col(f"v{i}").alias(f"m{i}") for i in d],
        *[(F.sqrt((1.4826 * F.col(f"w{i}")) ** 2 + FLOORS[i] ** 2) if i == j else F.lit(0.0)).alias(f"l{i}_{j}")
          for i in d for j in range(i + 1)], F.lit(0.0).alias("logdet")))
    classic = _with_scatter(rows.groupBy("grp").agg(*_sums()).withColumn("start", F.lit(1)), ["grp", "start"])
    fit = staged(robust.unionByName(classic), "mcd-start")
    twice = rows.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    keys = ["grp", "start"]
    for _ in range(STEPS):
        measured = _distance(_attach(twice, fit, keys), "d2").withColumn(
            "bin", F.floor(F.ln(F.col("d2") + 1e-9) * BINS)).select(*keys, "at", "bin", *[f"x{i}" for i in d])
        cuts = staged(_quantile_bins(measured, keys, SHARE), "mcd-cut")
        near = _attach(measured, cuts, keys).filter(F.col("bin") <= F.col("cut"))
        fit = staged(_with_scatter(near.groupBy(*keys).agg(*_sums()), keys), "mcd-fit")
    names = [c for c in fit.columns if c not in ("grp", "start", "logdet")]
    best = fit.groupBy("grp").agg(F.min_by(F.struct(*names), F.struct("logdet", "start")).alias("b")).select("grp", "b.*")
    # Scatter of the inner share of a normal sample is too small by this known factor.
    inner = chi_square_quantile(SHARE, DIMENSIONS)
    scale = math.sqrt(SHARE / chi_square_cdf(inner, DIMENSIONS + 2))
    return best.select("grp", *[f"m{i}" for i in d],
                       *[(F.col(f"l{i}_{j}") * scale).alias(f"l{i}_{j}") for i in d for j in range(i + 1)])


def quality_rules(docs: DataFrame, tail: float = 0.01, min_group: int = 50, id_col: str = "doc_id",
                  text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc_id, n_words, ..., base_failed, distance2, kept) of every row of ``docs``.

    A row is kept if it passes the base limits and its squared distance from
    its group's estimate has a chi-square tail probability above ``tail``.
    Estimates use all rows that pass the base limits.  Sources with fewer than
    ``min_group`` such rows share one group per language; a group that is
    still smaller has no estimate and keeps its rows.  Null languages and
    sources are groups of their own.  A null text has no words and fails the
    base limits; repeated rows count each; an empty table gives an empty result.
    """
    named = statistics(docs, id_col, text_col, lang_col, source_col).withColumn("at", F.monotonically_increasing_id())
    rows = staged(named.select("*", *[x.alias(f"x{i}") for i, x in enumerate(_vector())]), "quality-stats")
    usable = rows.filter(~F.col("base_failed"))
    own = F.to_json(F.struct("lang", "source", F.lit(False).alias("pooled")))
    pooled = F.to_json(F.struct("lang", F.lit(True).alias("pooled")))
    sizes = usable.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    groups = sizes.withColumn("grp", F.when(F.col("n") >= min_group, own).otherwise(pooled))
    totals = groups.groupBy("grp").agg(F.sum("n").alias("total")).filter(F.col("total") >= min_group)
    named_groups = staged(groups.join(totals, "grp").select("lang", "source", "grp"), "groups")
    of_group = join_small(rows, named_groups, ["lang", "source"], 200, F.col("at"))
    columns = ["grp", "at", *[f"x{i}" for i in range(DIMENSIONS)]]
    fitted = of_group.filter(F.col("grp").isNotNull() & ~F.col("base_failed")).select(*columns)
    estimates = staged(mcd_estimates(fitted), "mcd")
    judged = _distance(_attach(of_group, estimates, ["grp"], "left"), "distance2")
    inside = F.coalesce(F.col("distance2") <= chi_square_quantile(1 - tail, DIMENSIONS), F.lit(True))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "distance2", (~F.col("base_failed") & inside).alias("kept"))
