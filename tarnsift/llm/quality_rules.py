"""Quality rules: fixed base rules, then robust multivariate outliers.

Each document gets a vector of transformed statistics. Per language and source a minimum covariance
determinant estimate of centre and scatter is found by concentration steps: the three quarters of the
group's documents that lie closest to the estimate give the next one. Groups under MIN_GROUP documents take the
estimate of their language, or that of all documents if the language has too few as well. Documents far from it by
Mahalanobis distance are rejected. All of it is DataFrame work: a step is one aggregation by group.

Defined cases: null text counts as empty; a document without words fails the base rule; null language
or source is a group of its own; tables of under MIN_GROUP documents that pass the base rules keep all of those; equal rows get equal verdicts; columns besides doc_id, text, lang and source are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize, releasing, row_key, small_side, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = r"[#*$%&|<>]"
#: Share of a group that an estimate is taken from, concentration steps, least group, rejection cutoff on
#: the squared distance (scaled so that its group median is that of a chi-square with as many degrees).
CORE_SHARE, STEPS, MIN_GROUP, CUTOFF = 0.75, 3, 25, 48.0
#: Median of the chi-square distribution with five degrees of freedom.
CHI2_MEDIAN = 4.3515
#: Statistics are square roots of shares or logarithms; a spread below its floor says nothing about quality.
FEATURES = {"symbols": 0.04, "repeats": 0.15, "length": 0.05, "dup_lines": 0.25, "capitals": 0.04}


def _repeated(hashes: Column) -> Column:
    """Words covered by windows of WINDOW words that occur at least twice; hashes: of the words."""
    windows = F.transform(
        F.sequence(F.lit(0), F.size(hashes) - WINDOW),
        lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]),
    )

    def covered(w: Column) -> Column:
        placed = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(
            placed,
            lambda s: F.sort_array(
                F.transform(
                    F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])),
                    lambda x: x["i"],
                )
            ),
        )
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"))
        return F.aggregate(twice, start, step, lambda a: a["n"])

    return F.when(F.size(hashes) < WINDOW, 0).otherwise(
        let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(covered(w)))
    )


def text_statistics(docs: DataFrame) -> DataFrame:
    """One narrow row per document: key columns, doc_id, lang, source and the counts of its whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        *row_key(F.col("doc_id"), F.col("text"), F.col("lang"), F.col("source")),
        "doc_id", F.coalesce("lang", F.lit("\0")).alias("lang"), F.coalesce("source", F.lit("\0")).alias("source"),
        text.alias("text"), words(F.col("text")).alias("w"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    return base.select(
        "_id", "_sum", "doc_id", "lang", "source",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").alias("n_lines"),
        F.regexp_count("text", F.lit("[A-Z]")).alias("n_capitals"),
        _repeated_of_words("w").cast("long").alias("n_repeat_words"),
    )


def _repeated_of_words(name: str) -> Column:
    return let(F.transform(F.col(name), lambda x: F.xxhash64(x)), _repeated)


def _vector(stats: DataFrame) -> DataFrame:
    """The transformed statistics x0.. of rows that pass the base rules."""
    share = lambda a, b: F.sqrt(F.least(F.lit(1.0), F.col(a) / F.greatest(F.col(b), F.lit(1))))
    made = {
        "symbols": share("n_symbols", "word_chars"), "repeats": share("n_repeat_words", "n_words"),
        "length": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
        "dup_lines": share("n_dup_lines", "n_lines"), "capitals": share("n_capitals", "word_chars"),
    }
    return stats.withColumns({f"x{k}": F.round(made[f], 6) for k, f in enumerate(FEATURES)})


def _factored(groups: DataFrame) -> DataFrame:
    """Replace a group's covariances c*_* by the entries l*_* of their Cholesky factor."""
    k = len(FEATURES)
    for i in range(k):
        for j in range(i + 1):
            rest = reduce(lambda a, b: a - b, [F.col(f"l{i}_{t}") * F.col(f"l{j}_{t}") for t in range(j)], F.col(f"c{j}_{i}"))
            groups = groups.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}_{j}"))
    return groups.drop(*[f"c{i}_{j}" for i in range(k) for j in range(i, k)])


def _distance() -> Column:
    """Squared Mahalanobis distance from the group's mean m*, by forward substitution with its factor l*_*."""
    z: list[Column] = []
    for i in range(len(FEATURES)):
        rest = reduce(lambda a, b: a - b, [F.col(f"l{i}_{t}") * z[t] for t in range(i)], F.col(f"x{i}") - F.col(f"m{i}"))
        z.append(rest / F.col(f"l{i}_{i}"))
    return reduce(lambda a, b: a + b, [v * v for v in z])


def _level(distance: Column) -> Column:
    return F.round(F.log(distance + 1e-6) * 64)


def _cut() -> list[Column]:
    """Quantiles of column d by group. Distances are taken in steps, so the exact quantile needs bounded memory."""
    q = F.percentile(_level(F.col("d")), F.array(F.lit(0.5), F.lit(CORE_SHARE)))
    return [q[0].alias("mid"), q[1].alias("core"), F.count("*").alias("n_group")]


def estimates(vectors: DataFrame, by: list[str]) -> DataFrame:
    """Per group: mean, covariance, and the median level of the squared distance."""
    k = len(FEATURES)
    floors = list(FEATURES.values())
    quartiles = [F.percentile(F.round(F.col(f"x{i}") * 1024) / 1024, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q{i}") for i in range(k)]
    start = vectors.groupBy(by).agg(*quartiles)
    start = start.select(*by, *[F.get(f"q{i}", 1).alias(f"m{i}") for i in range(k)], *[
        (F.pow((F.get(f"q{i}", 2) - F.get(f"q{i}", 0)) / 1.349, 2) + floors[i] ** 2 if i == j else F.lit(0.0)).alias(f"c{i}_{j}")
        for i in range(k) for j in range(i, k)
    ])
    now = materialize(_factored(start), "mcd")
    for step in range(STEPS + 1):
        far = vectors.join(now, by).withColumn("d", _distance())
        cut = far.groupBy(by).agg(*_cut())
        held = materialize(now.join(cut, by), "mcd")
        if step == STEPS:
            return held
        core = vectors.join(held, by).filter(_level(_distance()) <= F.col("core"))
        means = [F.avg(f"x{i}").alias(f"m{i}") for i in range(k)]
        covs = [(F.covar_pop(f"x{i}", f"x{j}") + (floors[i] ** 2 if i == j else 0.0)).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]
        now = materialize(_factored(core.groupBy(by).agg(*means, *covs)), "mcd")


def models(vectors: DataFrame) -> DataFrame:
    """Per language and source the estimate of the group; of its language or of all documents if it is small."""
    own = estimates(vectors, ["lang", "source"])
    small = own.filter(F.col("n_group") < MIN_GROUP).select("lang", "source")
    if small.isEmpty():
        return own
    langs = materialize(own.groupBy("lang").agg(F.sum("n_group").alias("n"), F.min("n_group").alias("least")).filter(F.col("least") < MIN_GROUP), "quality-languages")
    enough = langs.filter(F.col("n") >= MIN_GROUP).select("lang")
    found = [own.filter(F.col("n_group") >= MIN_GROUP)]
    if not enough.isEmpty():
        found.append(small.join(estimates(vectors.join(small_side(enough), "lang", "left_semi"), ["lang"]), "lang"))
    rare = small.join(langs.filter(F.col("n") < MIN_GROUP).select("lang"), "lang")
    if not rare.isEmpty():
        whole = estimates(vectors.drop("lang", "source").withColumn("all", F.lit(0)), ["all"])
        found.append(rare.crossJoin(F.broadcast(whole.drop("all"))))
    return reduce(lambda a, b: a.unionByName(b), found)


def verdicts(docs: DataFrame) -> DataFrame:
    """The statistics of every document, base_failed, distance and kept."""
    stats = materialize(text_statistics(docs), "quality-statistics")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    vectors = _vector(stats.withColumn("base_failed", failed))
    model = models(vectors.filter(~F.col("base_failed")))
    scaled = F.col("d") / (F.exp(F.col("mid") / 64) / CHI2_MEDIAN)
    out = vectors.join(model, ["lang", "source"], "left").withColumn("d", _distance())
    # a group whose core is tight is not stretched: the scale never falls under that of the floors
    scaled = F.least(scaled, F.col("d"))
    far = F.coalesce((F.col("n_group") >= MIN_GROUP) & (scaled > CUTOFF), F.lit(False))
    return out.select(
        "_id", "_sum", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~far).alias("kept"), F.when(~F.col("base_failed"), scaled).alias("distance"),
    )


def quality_rules(docs: DataFrame) -> DataFrame:
    """Per document: the base counts, base_failed and the verdict kept."""
    return verdicts(docs).drop("_id", "_sum", "distance")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns untouched, that the rules keep."""
    with releasing(docs.sparkSession):
        gone = materialize(verdicts(docs).filter(~F.col("kept")).select("_id", "_sum").distinct(), "quality-rejected", keep=True)
    id_, sum_ = row_key(docs["doc_id"], docs["text"], docs["lang"], docs["source"])
    gone = small_side(gone)
    return docs.join(gone, (id_ == gone["_id"]) & (sum_ == gone["_sum"]), "left_anti")
