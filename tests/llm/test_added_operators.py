"""Clustering, filter audit and mixing against brute force, on small tables with odd rows."""

import hashlib
import math
import random
import re
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnsift.llm import centroid_clusters, chat_format, filter_audit, mixture

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, x string, cluster string"


def brute_clusters(rows, k, rounds, dims):
    """{vec_id: (cluster, distance)}, centroids of (vec_id, embedding) rows, plainly."""
    kept = [(i, [math.floor(256 * float(np.float32(e))) for e in v]) for i, v in rows if v is not None and len(v) == dims and all(e is not None and math.isfinite(e) for e in v)]
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in first[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        went = {}
        for _, v in kept:
            went.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(c) // len(went[j]) for c in zip(*went[j])] if j in went else old for j, old in enumerate(centroids)]
    return [(i, *near(v)[::-1]) for i, v in kept], centroids


def test_clusters_equal_brute_force(spark):
    rng = random.Random(4)
    vector = lambda: [rng.choice((rng.gauss(0, 0.2), 0.125, -0.125)) for _ in range(16)]
    rows = [(k, vector()) for k in range(150)] + [(200 + k, [0.125] * 16) for k in range(40)]
    rows += [(5, vector()), (6, rows[6][1]), (None, vector()), (300, None), (301, [0.1] * 15), (302, [0.1] * 15 + [None]), (303, [0.1] * 15 + [float("nan")]), (304, [0.1] * 15 + [float("inf")])]
    frame = spark.createDataFrame([(i, v, None, "x", "y") for i, v in rows], VECTORS).repartition(5)
    got = centroid_clusters.clusters(frame, k=12, dims=16).collect()
    want, centroids = brute_clusters(rows, 12, centroid_clusters.ROUNDS, 16)
    assert sorted((str(r["vec_id"]), r["cluster"], r["distance"]) for r in got) == sorted((str(i), j, d) for i, j, d in want)
    for r in got:
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()
        assert r["cluster_inertia"] == sum(d for _, j, d in want if j == r["cluster"]) and r["inertia"] == sum(d for *_, d in want)


def test_clusters_of_few_and_of_huge_vectors(spark):
    few = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [-1.0, 0.5])], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["cluster"] for r in centroid_clusters.clusters(few, k=5, dims=2).collect()}
    assert got[1] == got[2] != got[3]
    huge = spark.createDataFrame([(k, [1e300 * (-1) ** k, 0.0]) for k in range(4)], "vec_id long, embedding array<double>")
    assert {r["distance"] for r in centroid_clusters.clusters(huge, k=2, dims=2).collect()} <= {0, 4 * centroid_clusters.LIMIT**2}
    assert centroid_clusters.clusters(few.limit(0), dims=2).collect() == []
    assert centroid_clusters.clusters(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).collect() == []


def test_bounds_hold_and_screen():
    rng = np.random.default_rng(1)
    centroids = rng.integers(-400, 400, (40, 64))
    x = centroids[rng.integers(0, 40, 3000)] + rng.integers(-60, 60, (3000, 64))
    near, distance, taken = centroid_clusters.nearest(x, centroid_clusters.sketches(x), centroids)
    exact = ((x[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert (near == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    assert taken < 3 * len(x)  # of 40 centroids
    same = np.repeat(x[:1], 3, axis=0)
    assert centroid_clusters.nearest(x[:9], centroid_clusters.sketches(x[:9]), same)[0].tolist() == [0] * 9


def brute_audit(rows, labels):
    """{(part, order, step): counts} of (doc_id, text, lang) rows, by applying the filters one after another."""
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    first = {}
    for doc, text, _ in rows:
        if doc is not None:
            first[text or ""] = min(doc, first.get(text or "", doc))
    fails = {
        "A": lambda d, t: len(words(t)) < 200, "B": lambda d, t: 100 * len(set(words(t))) < 50 * len(words(t)),
        "C": lambda d, t: 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": lambda d, t: bool(re.search(r"[#$%&*|]", t)),
        "E": lambda d, t: d is not None and first[t] < d,
    }
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    out, total = {}, {}
    for part in {r[2] or "" for r in rows}:
        docs = [(d, t or "", {f for f in "ABCDE" if fails[f](d, t or "")}) for d, t, p in rows if (p or "") == part]
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[2]]
                left = [x for x in left if f not in x[2]]
                out[part, order, step] = [len(left), len(gone), sum(f in x[2] for x in docs) - len(gone), sum(x[2] == {f} for x in docs), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone)]
                total[part, f] = total.get((part, f), 0) + len(gone)
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_equals_filters_applied_in_turn(spark):
    rng = random.Random(9)
    texts = ["", None, " \n", "Word " * 250, "# a b", "x" * 4000, " ".join(f"w{k}" for k in range(300)), "ABC " * 10 + " ".join(f"v{k}" for k in range(220))]
    rows = [(rng.choice((None, *range(40))), rng.choice(texts), rng.choice(("en", "de", "", None))) for _ in range(120)]
    labels = [(k, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for k in range(30)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, "m", "n", "h") for r in rows], "doc_id long, text string, lang string, mask string, n string, hash string").repartition(3)
    marks = spark.createDataFrame([(*x, "e") for x in labels], "doc_id long, quality int, toxic int, first string")
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in filter_audit.COUNTS) for r in filter_audit.audit(docs, marks).collect()}
    assert got == brute_audit(rows, [x for x in labels if x[0] is not None])
    assert filter_audit.audit(docs.limit(0), marks).collect() == []
    assert {r["good_lost"] for r in filter_audit.audit(docs, marks.limit(0)).collect()} == {0}


def test_removal_polynomial():
    counts = {0: 7, 1: 3, 3: 5, 6: 2, 7: 1}
    removal = filter_audit.Removal(counts, 3)
    for filters in range(8):
        assert removal.corner(filters) == sum(c for m, c in counts.items() if m & filters)
    for i in range(3):
        assert removal.shapley(i) == sum(Fraction(c, m.bit_count()) for m, c in counts.items() if m >> i & 1)


def brute_targets(sizes):
    """{source: target}: shares by weight, capped at twice the size, the excess shared again until none is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    goal, open_, out = Fraction(3 * sum(sizes.values()), 2), set(order), {}
    while open_:
        left = goal - sum(out.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not above:
            return out | share
        out |= {s: Fraction(2 * sizes[s]) for s in above}
        open_ -= above
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_mixture_meets_its_targets(spark, seed):
    rng = random.Random(seed)
    names = ["b", "a", "Z", "é", "\U0001f600", "￮", "", None, "big", "blank"]
    rows = [(k, None if k % 50 == 7 else " ".join(["w"] * (0 if s == "blank" else rng.choice((0, 1, 30, 400, 2000)))), s) for k in range(600) for s in [rng.choice(names) if k % 3 else "big"]]
    rows += [(7001, "same row", "a")] * 5 + [(None, "no id", "b"), (None, "none either", "b"), (7008, None, "b")]
    docs = spark.createDataFrame([(*r, "k", "t") for r in rows], "doc_id long, text string, source string, key string, target string").repartition(4)
    got = mixture.mix(docs).collect()
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    aims = brute_targets(sizes)
    source_of = {r[0]: r[2] for r in rows if r[0] is not None}
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        if r["doc_id"] in source_of:
            source = source_of[r["doc_id"]]
            assert r["source_size"] == sizes[source] and abs(r["target"] - float(aims[source])) < 1e-6 * max(1, r["target"])
            taken[source] += r["taken"]
    for source in ("Z", "é", "big", None, "blank"):
        assert abs(taken[source] - float(aims[source])) < 1.5
    again = mixture.mix(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixture.mix(docs.limit(0)).collect() == []


def test_mixture_takes_good_documents_first(spark):
    clean = " ".join(f"w{k}" for k in range(100))
    docs = spark.createDataFrame([(k, f"{clean} {k}" if k % 2 else f"{clean} {k} {'#&' * 20}", "a") for k in range(2000)] + [(9999, "tiny", "b")], "doc_id long, text string, source string")
    got = mixture.mix(docs, weights=(1, 4), budget=0.5).collect()
    took = [sum(r["taken"] for r in got if r["doc_id"] % 2 == odd and r["doc_id"] < 9999) for odd in (0, 1)]
    assert took[1] > 1.3 * took[0] > 0
    once = mixture.mix(docs, weight=F.lit(1.0), budget=0.5, weights=(1,)).collect()
    assert {r["taken"] // r["size"] for r in once if r["taken"] in (0, r["size"])} == {0, 1}


def test_turns_of_one_number_go_by_role_then_text(spark):
    said = [(1, 0, role, text) for role in ("user", "us", "a:b", "a\nb") for text in ("#x", "$", "x", "x y", "", "\\", "</turn>")]
    blocks = chat_format.formatted(spark.createDataFrame(said, "conv_id long, seq long, role string, text string").repartition(4))
    row = chat_format.digests(blocks).first()
    want = "".join(f"{role}\n{text}\n" for _, _, role, text in sorted(said, key=lambda x: (x[2].encode(), x[3].encode())))
    assert row["turns_sha256"] == hashlib.sha256(want.encode()).hexdigest()
