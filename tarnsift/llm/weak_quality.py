"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good (1), bad (-1) or nothing (0) on every document. How often each
pattern of votes occurs is counted over the corpus: at most 3 to the number of labellers rows, whatever its
size. Expectation-maximisation over the patterns estimates, without any true label, how often each labeller votes
which way on good documents and on bad ones. Bad documents are of as many kinds as there are labellers, each a kind that one
labeller is made for and the others may take for good; so six votes for good don't outweigh the one that knows. What
a pattern leaves to the good class is its posterior. A hashed linear scorer then learns the posteriors from byte trigrams of a
bounded sample of documents (TRAIN_ROWS, chosen by the hash of their id) and scores every whole text. A text is kept for its
score, or where the labellers leave little doubt: a short text has few trigrams to judge by.

Defined cases: null text is empty and scores by the scorer's bias; equal rows score alike; an empty table
gives an empty result; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, sampled, words

#: Rows that the scorer is fitted on, hashed trigram buckets, steps of each fit, score and posterior from which a text is kept.
TRAIN_ROWS, BUCKETS, EM_STEPS, FIT_STEPS, KEEP_FROM, SURE = 4000, 2048, 60, 300, 0.4, 0.9
#: Where the model starts: share of good documents; rates of votes for bad, nothing and good on good documents, on those bad in the way that a
#: labeller is made for, and on other bad ones; how many documents that counts for.
PRIOR_GOOD, ON_GOOD, ON_OWN, ON_OTHER, PRIOR_VOTES = 0.8, (0.005, 0.195, 0.8), (0.8, 0.1, 0.1), (0.1, 0.3, 0.6), 20
#: Labellers are made so that they call at most so many good documents bad; without that, a frequent kind of bad could pass for good.
MOST_WRONG = 0.005
LABELLERS = ("symbols", "capitals", "marks", "variety", "word_length", "prose", "sentences")


def votes(docs: DataFrame) -> DataFrame:
    """docs with a column votes: one digit per labeller, 0 bad, 1 nothing, 2 good."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "text", text.alias("t"), words(F.col("text")).alias("w"))
    rows = rows.select(
        "doc_id", "text", F.size("w").alias("n"), F.length(F.array_join("w", "")).alias("chars"), F.size(F.array_distinct("w")).alias("distinct"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).alias("symbols"), F.regexp_count("t", F.lit("[A-Z]")).alias("capitals"), F.regexp_count("t", F.lit("!")).alias("marks"),
        F.regexp_count("t", F.lit("[.,]")).alias("stops"), F.size(F.filter("w", lambda x: x.rlike(r"^\p{L}\p{Ll}*[.,]?$"))).alias("plain"),
    )
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    per_word = share("chars", "n")

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, "0").when(good, "2").otherwise("1")

    variety = F.col("distinct") / F.sqrt(F.greatest(F.col("n"), F.lit(1)) * 20)
    made = [
        vote(share("symbols", "chars") > 0.05, share("symbols", "chars") < 0.002),
        vote(share("capitals", "chars") > 0.3, share("capitals", "chars") < 0.08),
        vote(share("marks", "n") > 0.1, share("marks", "n") < 0.01),
        vote((F.col("n") >= 30) & (variety < 0.45), (F.col("n") >= 30) & (variety >= 0.8)),
        vote((per_word > 14) | (per_word < 2.0), per_word.between(3.5, 8.0)),
        vote(share("plain", "n") < 0.6, share("plain", "n") >= 0.85),
        vote(share("stops", "n") < 0.02, share("stops", "n").between(0.05, 0.5)),
    ]
    made = [F.when(F.col("n") > 0, m).otherwise("1") for m in made[:4]] + [F.when(F.col("n") > 0, m).otherwise("0") for m in made[4:]]
    return rows.select("doc_id", "text", F.concat(*made).alias("votes"))


def label_model(counts: dict[str, int]) -> tuple[np.ndarray, dict[str, float]]:
    """Rates of votes (good or bad documents x labeller x vote) and the posterior of good per pattern. Classes are good and
    one kind of bad for each labeller; shares and rates are estimated together, and what is known before counts for PRIOR_VOTES documents."""
    patterns = sorted(counts)
    cast = (np.array([[int(c) for c in p] for p in patterns])[:, :, None] == np.arange(3)).astype(float)  # pattern x labeller x vote
    weight = np.array([counts[p] for p in patterns], float)
    labellers = cast.shape[1]
    before = np.tile(np.array(ON_OTHER), (labellers + 1, labellers, 1))
    before[0] = ON_GOOD
    before[np.arange(labellers) + 1, np.arange(labellers)] = ON_OWN
    known = np.array([PRIOR_GOOD] + [(1 - PRIOR_GOOD) / labellers] * labellers)
    rates, shares = before, known
    for _ in range(EM_STEPS):
        log = np.einsum("plv,clv->pc", cast, np.log(rates)) + np.log(shares)
        belongs = np.exp(log - log.max(1, keepdims=True))
        belongs /= belongs.sum(1, keepdims=True)
        rows = weight[:, None] * belongs
        votes_ = np.einsum("pc,plv->clv", rows, cast)
        rates = (votes_ + before * PRIOR_VOTES) / (votes_ + before * PRIOR_VOTES).sum(2, keepdims=True)
        rates[0, :, 0] = np.minimum(rates[0, :, 0], MOST_WRONG)
        rates[0] /= rates[0].sum(1, keepdims=True)
        shares = (rows.sum(0) + known * PRIOR_VOTES) / (weight.sum() + PRIOR_VOTES)
    bad = (rates[1:] * shares[1:, None, None]).sum(0) / shares[1:].sum()
    return np.stack([rates[0], bad]), dict(zip(patterns, belongs[:, 0].tolist()))


def features(text: str | None) -> np.ndarray:
    """Square roots of the shares of hashed byte trigrams, with unit length."""
    data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.zeros(BUCKETS, np.float32)
    key = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    bucket = ((key * np.uint32(2654435761)) >> np.uint32(16)) % BUCKETS
    return np.sqrt(np.bincount(bucket, minlength=BUCKETS) / len(bucket)).astype(np.float32)


def fit(x: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets, classes weighted alike, by accelerated gradient steps."""
    share = np.clip(target.mean(), 0.02, 0.98)
    weight = (target / share + (1 - target) / (1 - share)) / 2
    w, bias = np.zeros(x.shape[1]), 0.0
    ahead, ahead_bias = w.copy(), bias
    for step in range(FIT_STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead.astype(np.float32) + ahead_bias, -30, 30)))
        error = (p - target) * weight / len(target)
        new, new_bias = ahead - 4 * (x.T @ error + 1e-4 * ahead), ahead_bias - 4 * error.sum()
        momentum = step / (step + 3)
        ahead, ahead_bias = new + momentum * (new - w), new_bias + momentum * (new_bias - bias)
        w, bias = new, new_bias
    return w.astype(np.float32), float(bias)


def classify(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, label (posterior of its votes), score of the hashed linear scorer, kept."""
    spark = docs.sparkSession
    voted = materialize(votes(docs).select("doc_id", "votes"), "votes")
    counts = {r["votes"]: r["n"] for r in voted.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    posterior = label_model(counts)[1] if counts else {}
    table = F.create_map(*[F.lit(v) for kv in posterior.items() for v in kv]) if posterior else F.create_map().cast("map<string,double>")

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"pattern": batch["votes"], "x": [features(t).tobytes() for t in batch["text"]]})

    bound = sampled(voted, 3 * TRAIN_ROWS // 2).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS).select("doc_id").distinct()
    sample = docs.select("doc_id", "text").join(F.broadcast(bound), "doc_id", "left_semi")
    rows = votes(sample).mapInPandas(vectors, "pattern string, x binary").limit(2 * TRAIN_ROWS).collect()
    if rows:
        x = np.frombuffer(b"".join(r["x"] for r in rows), np.float32).reshape(len(rows), BUCKETS)
        w, bias = fit(x, np.array([posterior[r["pattern"]] for r in rows]))
    else:
        w, bias = np.zeros(BUCKETS, np.float32), 0.0
    shared = spark.sparkContext.broadcast(w)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([1 / (1 + np.exp(-float(np.clip(features(t) @ shared.value + bias, -30, 30)))) for t in batch], dtype="float64")

    out = votes(docs).select("doc_id", F.try_element_at(table, "votes").alias("label"), F.round(score("text"), 6).alias("score"))
    return out.select("doc_id", "label", "score", ((F.col("score") >= KEEP_FROM) | F.coalesce(F.col("label") >= SURE, F.lit(False))).alias("kept"))
