"""The training-data operators against brute force, exact round trips and held-out accuracy, on small tables."""

import base64
import hashlib
import json
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tarnsift.llm import byte_bpe, chat_format, decontaminate, huffman_ids, jaccard_join, line_dedup, pii, quality_rules, queries, token_counts, weak_quality

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_words string, _id string"
ODD = [(1, None, None, None, "x", "y"), (2, "", "en", "s", "x", "y"), (3, "  \n\t ", "en", "s", "x", "y"), (4, "one two", "en", "s", "x", "y"),
       (4, "one two", "en", "s", "x", "y"), (None, "no id here at all 12", "en", "s", "x", "y"), (5, "é😀 " * 30, "fr", None, None, None), (6, "word " * 3000, "en", "s", "x", "y"),
       (7, "a" * 4000, "en", "s", "x", "y")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute_classes(texts):
    sets, up = {d: shingles(t) for d, t in texts.items()}, {d: d for d in texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}


def test_jaccard_join_with_a_large_near_group(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    texts = {}
    for k in range(90):  # lists of this group are long, so leaders and left-over pairs are used
        words = list(base)
        for _ in range(rng.choice((0, 1, 2, 3, 5))):
            words[rng.randrange(120)] = rng.choice(vocabulary)
        texts[k] = " ".join(words)
    for k in range(90, 150):
        texts[k] = " ".join(base[:50] + [rng.choice(vocabulary) for _ in range(rng.randrange(3, 60))])
    texts |= {150: "", 151: "A b C", 152: "a B c", 153: "a b c d e"}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.classes(frame).collect()}
    assert got == brute_classes(texts)


def test_sketches_are_added_up_in_tasks(spark, none):
    """The driver gets one packed array, not partial sums of eight MB each; the levels are those of plain counting."""
    sc = spark.sparkContext
    rng = np.random.default_rng(7)
    sketches = [rng.integers(0, 50, 1 << jaccard_join.SKETCH_BITS).astype(np.uint32) for _ in range(9)]
    frame = spark.createDataFrame([(-1, bytearray(zlib.compress(s.tobytes(), 1))) for s in sketches] + [(5, None)], "n long, sketch binary").repartition(5)
    store = sc._jsc.sc().statusStore()
    stages = lambda: store.stageList(sc._jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    sizes = lambda: {s.stageId(): s.resultSize() for s in (x for seq in [stages()] for x in (seq.apply(i) for i in range(seq.size())))}
    before = set(sizes())
    got = jaccard_join._levels(frame)
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    assert sum(v for k, v in sizes().items() if k not in before) < 2_000_000
    counts = np.sum(sketches, 0, dtype=np.uint64)
    assert got.dtype == np.uint8 and np.array_equal(got, np.minimum(255, np.log2(counts + 1.0) * 4).astype(np.uint8))
    assert not jaccard_join._levels(spark.createDataFrame([], "n long, sketch binary")).any()


def test_jaccard_join_on_real_and_odd_rows(spark, real, odd, none):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.classes(real).collect()}
    assert got == brute_classes({r["doc_id"]: r["text"] for r in real.collect()})
    rows = jaccard_join.classes(odd).collect()
    assert len(rows) == len(ODD) and {r["doc_id"]: r["component_id"] for r in rows} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, None: None}
    assert jaccard_join.classes(none).collect() == []
    assert jaccard_join.keep_one(odd).columns == odd.columns
    a, b = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    several = spark.createDataFrame([(1, a), (5, a), (5, b), (7, b + " more"), (9, b)], "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.classes(several).collect())) == [(1, 56, 1), (5, 56, 5), (5, 56, 5), (7, 57, 5), (9, 56, 5)]


def test_copies_far_from_their_leader(spark):
    rng = random.Random(11)
    base = [f"base{k}" for k in range(150)]
    texts = {}
    for k in range(120):  # copies with edits of their own: about as far from one another as a link allows, or farther
        words = list(base)
        for at in rng.sample(range(0, 150, 5), rng.choice((0, 1, 3, 3, 4, 4))):
            words[at] = f"own{k}word{at}"
        texts[k] = " ".join(words[: rng.choice((150, 150, 140, 120))])
    texts[0] = " ".join(f"own0word{k}" if k % 30 == 3 else w for k, w in enumerate(base))  # no copy at all is the first leader
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.classes(frame).collect()}
    assert got == brute_classes(texts)


def test_byte_bpe_equals_the_library(spark, odd, none, monkeypatch):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng, pairs = random.Random(2), byte_bpe.BytePairs(path)
    letters = ["a", "'", "'s", "'ll", "'re", " ", "  ", "\n", "1", "!", "é", "中", " ", "😀", "\x1c", "½"]
    texts = ["".join(rng.choices(letters, k=rng.randrange(14))) for _ in range(4000)] + ["x" * 3000, "ab" * 900, " " * 700]
    for text, ids in zip(texts, pairs.encode(texts)):
        assert ids.tolist() == library.encode_ordinary(text)
        assert pairs.decode(ids.astype("<u4").tobytes()) == text.encode()
    want = sorted((str(r[0]), len(library.encode_ordinary(r[1] or "")), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in ODD)
    for size in (byte_bpe.BLOCK_CHARS, 7):  # with 7, texts and batches cross block edges everywhere
        monkeypatch.setattr(byte_bpe, "BLOCK_CHARS", size)
        assert all(ids.tolist() == library.encode_ordinary(text) for text, ids in zip(texts, pairs.encode(texts)))
    monkeypatch.undo()
    monkeypatch.setattr(byte_bpe, "CACHE_BYTES", 1000)
    assert all(ids.tolist() == library.encode_ordinary(text) for text, ids in zip(texts[:500], pairs.encode(texts[:500])))
    monkeypatch.undo()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["decoded_sha256"]) for r in byte_bpe.round_trip(odd, path).collect()) == want
    long = "one two  three'll \n four " * 60_000
    assert next(pairs.encode([long])).tolist() == library.encode_ordinary(long)
    assert [r["n"] for r in byte_bpe.encode_documents(odd, path).selectExpr("doc_id", "length(ids) / 4 AS n").collect()] == [len(library.encode_ordinary(r[1] or "")) for r in ODD]
    assert byte_bpe.round_trip(none, path).collect() == []


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for w in words for c in w), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_verdicts(spark, real, odd, none):
    for frame in (real, odd):
        texts = {r["doc_id"]: r["text"] for r in frame.collect()}
        for r in quality_rules.quality_rules(frame).collect():
            want = brute_counts(texts[r["doc_id"]])
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
            assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r["base_failed"] and r["kept"])
    assert quality_rules.quality_rules(none).collect() == []
    assert quality_rules.keep_good(odd).columns == odd.columns


def test_robust_outliers_are_found(spark):
    rng = random.Random(1)
    plain = [(k, " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(3, 8))) for _ in range(80)), "en", "s") for k in range(200)]
    soup = [(1000 + k, " ".join("".join(rng.choices("abcdefgh", k=4)) + "###" for _ in range(80)), "en", "s") for k in range(20)]
    out = quality_rules.quality_rules(spark.createDataFrame(plain + soup, "doc_id long, text string, lang string, source string")).collect()
    assert {r["doc_id"] for r in out if r["kept"]} == {r[0] for r in plain}


def test_decontamination(spark, real, odd, none):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    inside = {(d["doc_id"], i["item_id"]) for d in real.collect() for i in items.collect() if " ".join(i["text"].split()[:-1]) in " ".join(d["text"].split())}
    assert inside and inside <= {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(real, items).collect()}
    words = [f"tok{k}" for k in range(40)]
    changed = [("x" if k % 9 == 4 else w) for k, w in enumerate(words)]
    docs = spark.createDataFrame([(1, "lead in " + " ".join(changed) + " end"), (2, " ".join(reversed(words))), (3, None)], "doc_id long, text string")
    test = spark.createDataFrame([(9, " ".join(words)), (10, None), (11, "too short")], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, test).collect()] == [(1, 9)]
    assert sorted(r["doc_id"] for r in decontaminate.decontaminate(docs, test).collect()) == [2, 3]
    assert decontaminate.decontaminate(odd, test).count() == len(ODD) and decontaminate.contaminated(none, test).count() == 0


def brute_line_dedup(rows):
    """(text, dropped) by doc_id of distinct documents, by the rules of line_dedup."""
    d, m = line_dedup.DEPTH, line_dedup.SEGMENTS
    lines = []
    for doc, text in rows:
        for place, line in enumerate(text.split("\n") if text is not None else []):
            w = [("<*>" if re.search("[0-9]", x) else x) for x in re.findall(r"[^\x20\x09-\x0D]+", line)]
            masked = re.sub(line_dedup.FIELD, "<*>", line.strip(" \t\n\x0b\x0c\r"))
            if set(w) - {"<*>"}:
                need = 2 if len(w) >= 50 or len(masked) >= 300 else 3 if len(w) >= 4 or len(masked) >= 24 else 6
                lines.append((doc, place, masked, w, need))
    paths = lambda w: [(k, len(w), *[None if j == d - k else w[j] for j in range(d)]) for k in range(d + 1)] if len(w) >= line_dedup.GENERAL_WORDS else []
    shared = Counter(p for x in lines for p in paths(x[3]))

    def cells(w):
        node = next((p for p in paths(w) if shared[p] >= 3), None)
        step = -(-(len(w) - d) // m)
        return [(node, k, tuple(w[d + k * step : d + (k + 1) * step])) for k in range(-(-(len(w) - d) // step))] if node else []

    fixed = Counter(c for x in lines for c in cells(x[3]))
    groups = {}
    for doc, place, masked, w, need in lines:
        groups.setdefault(masked, []).append((doc, place, need))
        kept = [c for c in cells(w) if fixed[c] >= 3]
        if kept and sum(len(c[2]) for c in kept) + d - (kept[0][0][0] > 0) >= 0.75 * len(w):
            groups.setdefault(tuple(kept), []).append((doc, place, need))
    gone = {(doc, place) for g in groups.values() if len({x[0] for x in g}) >= min(x[2] for x in g) for doc, place, _ in g if doc != min(x[0] for x in g)}
    out = {}
    for doc, text in rows:
        left = [x for k, x in enumerate(text.split("\n")) if (doc, k) not in gone] if text is not None else None
        out[doc] = (None if left is None else "\n".join(left), sum(x == doc for x, _ in gone))
    return out


def test_line_dedup(spark, real, odd, none):
    names, rng = ["anna", "bert", "carl", "dora", "emil", "fred"], random.Random(3)
    passage = " ".join(f"passage{'abcdefghij'[k % 10]}{'klmnop'[k // 10]}" for k in range(60))
    rows = [(k, f"own text of letter {'abcdef'[k]}\nJob {k} took {k * 7} seconds in all\nuser {names[k]} logged in from the office today\nhome page") for k in range(6)]
    rows += [(9, None), (10, ""), (11, f"first\n{passage}"), (12, f"second\n{passage} \n7 8 9 10"), (13, "7 8 9 10\n\n"), (14, "7 8 9 10")]
    rows += [(20 + k, "\n".join(" ".join(rng.choices("red blue green one two".split(), k=rng.choice((3, 8, 9, 13, 30)))) for _ in range(30))) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in line_dedup.dedup_lines(docs, counts=True).collect()}
    assert out == brute_line_dedup(rows)
    assert out[0] == (rows[0][1], 0) and out[9] == (None, 0) and out[12] == ("second\n7 8 9 10", 1) and out[13][1] == 0
    assert all(out[k] == (f"own text of letter {'abcdef'[k]}", 3) for k in range(1, 6))
    plain = [(r["doc_id"], r["text"]) for r in real.collect()]
    assert {r["doc_id"]: (r["text"], r["n_dropped"]) for r in line_dedup.dedup_lines(real, counts=True).collect()} == brute_line_dedup(plain)
    clash = odd.withColumnsRenamed({"lang": "places", "source": "lines", "n_words": "_sum"}).withColumn("row", F.lit(1))
    assert line_dedup.dedup_lines(clash).columns == clash.columns and line_dedup.dedup_lines(clash).count() == len(ODD)
    assert line_dedup.dedup_lines(none).count() == 0


def test_personal_data(spark, odd, none):
    def naive(t):
        out = [(m.start(), m.end(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [(m.start(), m.end(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
        out += [(m.start(), m.end(), 2) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= sum(map(str.isdigit, m[0])) <= 19 and pii.luhn(re.sub("[^0-9]", "", m[0]))]
        return sorted(out + [(m.start(), m.end(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(map(str.isdigit, m[0])) <= 15])

    rng = random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choices("ab@.-+ ()0123456789", k=rng.randrange(40)))
        assert pii.base_spans(text) == naive(text)
    assert pii.base_spans(f"1.2.{'0' * 5000}7.4 9.9.9.{'1' * 5000}") == [(0, 5007, 1)]
    tagger = pii.Tagger()
    for k in tagger.p:
        tagger.p[k] = tagger.p[k].astype(np.float64)
    x, y = np.random.default_rng(0).integers(0, pii.N_CLASS, (3, 7)), np.random.default_rng(1).integers(0, 5, (3, 7))
    grad = tagger.loss(x, y)[1]
    for name, at in (("trans", (1, 2)), ("f_h", (3, 5)), ("b_x", (2, 9))):
        was = tagger.p[name][at]
        sides = []
        for step in (1e-4, -1e-4):
            tagger.p[name][at] = was + step
            sides.append(tagger.loss(x, y)[0])
        tagger.p[name][at] = was
        assert abs((sides[0] - sides[1]) / 2e-4 - grad[name][at]) < 1e-3
    docs = spark.createDataFrame([(k, f"call +1 (555) 010-{1000 + k} or mail user.{k}@mail{k}.example.com from 10.0.{k}.7 now") for k in range(60)], "doc_id long, text string")
    out = pii.find(docs).collect()
    assert all((r["n_email"], r["n_ip"], r["n_phone"]) == (1, 1, 1) for r in out)
    assert len(pii.find(odd).collect()) == len(ODD) and pii.find(none).collect() == []


def test_rates_of_labellers_are_recovered():
    """Documents that are bad in one way each: the labeller made for it sees it mostly, the others seldom; both rates come back."""
    rng = np.random.default_rng(3)
    kind = np.where(rng.random(200_000) < 0.85, 0, rng.integers(1, 6, 200_000))  # 0: good
    sees, misses, wrong = np.array([0.95, 0.9, 0.8, 0.7, 0.9]), 0.05, 0.003
    bad = rng.random((len(kind), 5)) < np.where(kind[:, None] == 0, wrong, np.where(kind[:, None] - 1 == np.arange(5), sees, misses))
    cast = np.where(bad, 0, np.where(rng.random(bad.shape) < 0.8, 2, 1))
    rates, posterior = weak_quality.label_model(Counter("".join(map(str, row)) for row in cast.tolist()))
    assert rates.shape == (2, 5, 3) and np.allclose(rates.sum(2), 1)
    assert np.abs(rates[0, :, 0] - wrong).max() < 0.003 and np.abs(rates[1, :, 0] - (sees + 4 * misses) / 5).max() < 0.03
    guess = np.array([posterior["".join(map(str, row))] for row in cast[:20000].tolist()]) > 0.5
    good = kind[:20000] == 0
    assert guess[good].mean() > 0.97 and guess[~good].mean() < 0.2


def test_weak_labels_on_held_out_labels(spark, odd, none):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = weak_quality.classify(docs).join(labels, "doc_id").collect()
    good, bad = [r["kept"] for r in rows if r["quality"] == 1], [r["kept"] for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.15
    assert len(weak_quality.classify(odd).collect()) == len(ODD) and weak_quality.classify(none).collect() == []


def test_token_counts(spark, odd, none):
    rng, pieces = random.Random(4), {(97,), (97, 98), (98, 99, 100), (97, 98, 99, 101), (256,), (98,)}
    automaton = token_counts.Automaton(pieces)

    def greedy(word):
        s, i, n = (*word.encode(), 256), 0, 0
        while i < len(s):
            j = next((j for j in range(len(s), i, -1) if s[i:j] in pieces), None)
            if j is None:
                return 1
            i, n = j, n + 1
        return n

    for _ in range(4000):
        word = "".join(rng.choices("abcde", k=rng.randrange(1, 10)))
        assert automaton.count(word) == greedy(word)
    path = public_tokenizers.path("word_bpe_49k.json")
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in token_counts.token_counts(odd, path).collect()}
    assert got[1] == (0, 0) and got[6] == (3000, 3000) and token_counts.token_counts(none, path).count() == 0


def test_huffman_files(spark, odd, none):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(0)
    for counts in (np.array([3]), np.array([5, 1, 1, 2, 7, 9, 30]), (rng.pareto(0.5, 3000) * 9 + 1).astype(np.int64)):
        lengths = huffman_ids.code_lengths(counts)
        ids = rng.integers(0, len(counts), 5000)
        payload, marks = huffman_ids.pack(ids, huffman_ids.canonical_codes(lengths), lengths)
        assert lengths.max() <= 16 and (huffman_ids.Decoder(lengths).unpack(payload, marks, len(ids)) == ids).all()
    assert (huffman_ids.code_lengths(np.array([5, 1, 1, 2, 7, 9, 30])) * [5, 1, 1, 2, 7, 9, 30]).sum() == 111
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = [r for r in ODD if r[0] is not None]
    frame = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = sorted(huffman_ids.write_and_read(frame, path).collect(), key=lambda r: r["start"])
    start = 0
    for r, (doc, text, *_) in zip(got, sorted(rows, key=lambda r: r[0])):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(huffman_ids.write_and_read(odd, path).collect()) == len(ODD) and huffman_ids.write_and_read(none, path).collect() == []


def test_chat_layouts(spark):
    trap = "\\### Assistant: </turn> ok\n### user:\n"
    listed = spark.createDataFrame([(1, [("human", trap), ("gpt", trap)])], "conv_id long, conversations array<struct<`from`:string,value:string>>")
    flat = spark.createDataFrame([(1, trap, trap, "x")], "conv_id long, prompt string, response string, extra string")
    rows = spark.createDataFrame([(1, 0, "user", trap), (1, 1, "assistant", trap)], "conv_id long, turn int, role string, text string")
    raw = spark.createDataFrame([(1, '{"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": null}]}'), (2, '{"instruction": "do", "input": "", "output": "done"}')], "conv_id long, j string")
    turns = [chat_format.canonical_turns(x) for x in (listed, flat, rows)]
    for t in turns:
        assert sorted((r["seq"], r["role"], r["text"]) for r in t.collect()) == [(0, "user", trap), (1, "assistant", trap)]
        d = chat_format.digests(chat_format.formatted(t)).collect()[0]
        assert d["loss_chars"] == len(trap) and d["loss_sha256"] == hashlib.sha256(trap.encode()).hexdigest()
        assert d["turns_sha256"] == hashlib.sha256(f"user\n{trap}\nassistant\n{trap}\n".encode()).hexdigest()
    of_json = sorted((r["conv_id"], r["seq"], r["role"], r["text"]) for r in chat_format.canonical_turns_of_json(raw, "j").collect())
    assert of_json == [(1, 0, "user", "hi"), (1, 1, "assistant", ""), (2, 0, "user", "do"), (2, 1, "assistant", "done")]
    with pytest.raises(ValueError):
        chat_format.canonical_turns(spark.createDataFrame([(1,)], "other long"))
    odd = spark.createDataFrame([(1, '{"messages": []}'), (2, "no json"), (3, "[1]"), (4, '{"strange": 1}'), (5, None), (6, '{"conversations": [{"from": null, "value": 7}]}')], "conv_id long, j string")
    assert [tuple(r) for r in chat_format.canonical_turns_of_json(odd, "j").collect()] == [(6, 0, "", "7")]
    assert sorted((r["conv_id"], r["problem"]) for r in chat_format.rejected_json(odd, "j").collect()) == [(2, "not JSON"), (3, "not an object"), (4, "unknown layout")]
    said = [(1, 0, "user", trap), (1, 1, "assistant", None), (None, 0, None, "x"), (2, 0, "gpt", "y"), (2, 0, "gpt", "y"), (3, 5, "human", ""), *[(9, k, "assistant", f"t{k}") for k in range(30)]]
    table = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    mixed = chat_format.canonical_turns_of_json(queries.mixed_layouts(table), "record", "turn")
    assert sorted(map(str, mixed.collect())) == sorted(map(str, chat_format.canonical_turns(table).collect()))
    assert len({tuple(sorted(json.loads(r["record"]))) for r in queries.mixed_layouts(table).collect()}) == 3
    assert chat_format.digests(chat_format.formatted(turns[0].limit(0))).collect() == []


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = corpus_pipeline.materialize(stage(spark, rows, SF), f"test-{name}")
        assert rows.columns == docs.columns and 0 < rows.count() <= docs.count()
    assert corpus_pipeline.run(spark, SF).count() == rows.count()


def test_pieces_encode_as_whole_texts_do():
    tokenizer = huffman_ids._tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    signs = [" ", "\n", "\t", "\x1c", "\x85", "\u180e", "\u200b", "\u3000", "a", "b", "1", ".", "'s", "é", "字", "<|endoftext|>"]
    rng = np.random.default_rng(5)
    texts = ["", " ", "\n", "a  b", "a \n b", " a\nb ", "a\n\nb"] + ["".join(rng.choice(signs, rng.integers(0, 25))) for _ in range(2000)]
    pieces = huffman_ids.Pieces(tokenizer)
    for _ in range(2):
        got = pieces.ids(texts)
        assert all(tokenizer.encode(t, add_special_tokens=False).ids + [0] == g.tolist() for t, g in zip(texts, got))


def test_decontamination_counts_each_word_once(spark):
    words = [f"tok{k}" for k in range(50)]
    again = " ".join(f"{' '.join(words[:10])} other{k} words{k}" for k in range(5))
    split = " ".join(words[:20] + ["put", "in"] + words[20:40])
    docs = spark.createDataFrame([(1, again), (2, "run " * 60), (3, split)], "doc_id long, text string")
    items = spark.createDataFrame([(8, " ".join(words)), (9, " ".join(["run"] * 9 + [f"far{k}" for k in range(31)]))], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["n_matched"] for r in decontaminate.contaminated(docs, items).collect()}
    assert found == {(3, 8): 40}


def test_decontamination_masks_find_what_the_share_accepts(spark):
    def free(n):
        """The most words of n that can be equal without a seed, over all patterns, by their last four words."""
        best = {(): 0}
        for _ in range(n):
            after = {}
            for tail, equal in best.items():
                for bit in (0, 1):
                    window = (*tail, bit)
                    if not any(len(m) <= len(window) and all(b == "0" or w for b, w in zip(m, window[-len(m) :])) for m in masks):
                        after[window[-4:]] = max(after.get(window[-4:], 0), equal + bit)
            best = after
        return max(best.values())

    for n in range(1, 200):
        masks = [decontaminate.MASKS[k] for k in decontaminate.masks_of(n)]
        assert free(n) < decontaminate.MIN_SHARE * n
    rows, items = [], []
    for n, gone in ((1, ()), (2, ()), (3, (1,)), (5, (1, 3)), (6, (1, 4)), (9, (4,)), (10, (0, 3, 6, 9)), (15, (3, 7, 11)), (40, range(2, 40, 5))):
        words = [f"item{n}word{k}" for k in range(n)]
        items.append((n, " ".join(words)))
        rows.append((n, "lead in " + " ".join("x" if k in gone else w for k, w in enumerate(words)) + " end"))
    frames = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(*frames).collect()) == [(n, n) for n, _ in items]


def test_huffman_ids_are_those_of_the_file(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, pieces = Tokenizer.from_file(path), huffman_ids.Pieces(huffman_ids._tokenizer(path))
    rng, mark = np.random.default_rng(6), "<|endoftext|>"
    texts = [f"a{mark}b", mark, f" {mark} ", f"x\n{mark}\ny {mark}{mark} 's"]
    texts += ["".join(rng.choice([" ", "\n", "\t", "a", "1", ".", "'s", "é", mark], rng.integers(0, 25))) for _ in range(2000)]
    want = [tokenizer.encode(t, add_special_tokens=False).ids + [0] for t in texts]
    assert want[0] == [64, 50256, 65, 0]
    assert [g.tolist() for g in pieces.ids(texts)] == want
    got = huffman_ids.write_and_read(spark.createDataFrame([(k, t) for k, t in enumerate(texts[:4])], "doc_id long, text string"), path).collect()
    assert sorted((r["doc_id"], r["ids_crc32"]) for r in got) == [(k, zlib.crc32(np.array(ids, "<u4").tobytes())) for k, ids in enumerate(want[:4])]


@pytest.fixture(scope="module")
def tagger(real):
    return pii.train(real)


def test_tags_are_those_of_one_pass_over_the_whole_text(tagger, monkeypatch):
    rng = random.Random(8)
    texts = ["", "a", "no data here " * 50, "7 " * 400]
    texts += ["\n".join(f"row {k} {rng.randrange(10**9)} from 10 . {k % 250} . 7 . {k % 99} or 00{rng.randrange(10**9)} (555)  {rng.randrange(1000)} {pii.made_span(rng, k % 4)}" for k in range(n)) for n in (3, 40, 1500)]
    assert len(texts[-1]) > 100_000

    def one_pass(text):
        (_, emit, real), *more = tagger._blocks([text])
        assert not more
        emit[~real, 1:] -= 1000
        trans, score, back = tagger.p["trans"], None, []
        for e in emit:
            ways = score[:, None] + trans if score is not None else np.full((5, 5), -1e9) + np.eye(1, 5) * 1e9
            back.append(ways.argmax(0))
            score = ways.max(0) + e
        tags = [int(score.argmax())]
        for b in back[:0:-1]:
            tags.append(int(b[tags[-1]]))
        tags = np.array(tags[::-1])[pii.STEP :]
        cut = np.flatnonzero(np.diff(np.concatenate(([0], tags, [0]))))
        return [(int(a), int(b), int(tags[a]) - 1) for a, b in zip(cut[:-1], cut[1:]) if tags[a]]

    monkeypatch.setattr(pii, "BLOCK", 1 << 20)
    want = [one_pass(t) if t else [] for t in texts]
    assert tagger.spans(texts) == want and [tagger.spans([t])[0] for t in texts] == want
    monkeypatch.setattr(pii, "BLOCK", 3)
    assert tagger.spans(texts[:-1]) == want[:-1]
    for base, every in pii.all_spans(texts, tagger):
        added = [s for s in every if s not in base]
        assert len(set(every)) == len(every) and all(a[1] <= b[0] for a, b in zip(added, added[1:]))


def test_added_spans_on_held_out_spellings(real, tagger):
    texts = [r["text"] for r in real.collect() if r["text"]]
    rng, found, made, wrong = random.Random(99), Counter(), Counter(), 0
    for n in range(1200):
        kind, prose = n % 4, re.sub(r"\S*[0-9@]\S*", "", rng.choice(texts)[:400])
        span, at = pii.made_span(rng, kind), prose.rfind(" ", 0, rng.randrange(1, 400)) + 1
        base, every = next(pii.all_spans([f"{prose[:at]}{span} {prose[at:]}"], tagger))
        if (at, at + len(span), kind) not in base:
            made[kind] += 1
            found[kind] += (at, at + len(span), kind) in every
            wrong += sum(s[1] <= at or s[0] >= at + len(span) for s in every)
    assert all(made[k] > 60 and found[k] >= 0.85 * made[k] for k in range(4)) and wrong <= 0.01 * sum(made.values())
    text = "write to user at mail dot com or user @ mail.example.com, call +1 (826) 555-4081 190.137.223.2 or 4111  1111  1111  1111 now"
    base, every = next(pii.all_spans([text], tagger))
    assert [text[a:b] for a, b, _ in every if (a, b, _) not in base] == ["user at mail dot com", "user @ mail.example.com", "+1 (826) 555-4081", "4111  1111  1111  1111"]
    plain = [re.sub(r"\S*[0-9@]\S*", "", t) for t in texts]
    assert not any(every for _, every in pii.all_spans(plain, tagger))


def test_numbers_without_personal_data_are_passed_over_in_one_pass(tagger):
    rng, n = random.Random(9), 100_000
    line = {
        "fours": lambda: " ".join(f"{rng.randrange(10**4):04d}" for _ in range(12)), "numbers": lambda: " ".join(str(rng.randrange(10 ** rng.randint(1, 9))) for _ in range(12)),
        "csv": lambda: ",".join(f"{rng.uniform(-1000, 1000):.2f}" for _ in range(10)), "signed": lambda: " ".join(f"{rng.uniform(-9, 9):+.3f}" for _ in range(9)),
        "log": lambda: f"2024-03-{rng.randint(1, 28):02d} 12:{rng.randint(0, 59):02d}:07,123 INFO req {rng.randrange(10**6)} took {rng.randrange(5000)}ms ({rng.randrange(100)}/{rng.randrange(100)})",
        "one line": lambda: " ".join(str(rng.randrange(1000)) for _ in range(30_000)), "digits": lambda: "".join(rng.choices("0123456789", k=n)), "bytes": lambda: " ".join(str(rng.randrange(256)) for _ in range(12)),
        "lists": lambda: " . ".join(str(rng.randrange(99)) for _ in range(9)), "signs": lambda: "a@" * n, "blanks": lambda: " " * n + "at", "brackets": lambda: "(" * n,
    }
    for name, make in line.items():
        text = make()
        while len(text) < n:
            text += "\n" + make()
        began = time.process_time()
        base, every = next(pii.all_spans([text], tagger))
        assert time.process_time() - began < 20, name  # a pass; the cubic check took hours
        assert len(every) - len(base) <= len(text) // 10_000, name  # at most ten in 100,000 characters
        for check in pii._HELD:
            began = time.process_time()
            list(check(text))
            assert time.process_time() - began < 2, name


def test_checks_of_forms_are_those_of_their_rules():
    held = lambda kind, text: [text[a:b] for a, b in pii._HELD[kind](text)]
    assert held(0, "x me (at) home [dot] de, y@z, a@b.c1 d @ e . org") == ["me (at) home [dot] de", "d @ e . org"]
    assert held(1, "1 . 2 . 3 . 4 or 1. 2. 3. 4. 5. or 7[.]7[.]7[.]256 or 10 dot 0 dot 0 dot 1") == ["1 . 2 . 3 . 4", "10 dot 0 dot 0 dot 1"]
    assert held(2, "4111 1111 1111 1111 2024 and 4111 1111 1111 1112 and 4111--1111--1111--1111") == ["4111 1111 1111 1111", "4111--1111--1111--1111"]
    assert held(2, "4111 1111 1111 1111 4111 1111 1111 1111") == [] and held(2, "4111111111111111 12 7") == ["4111111111111111"]
    assert held(3, "call (555) 123-4567 or 0049 30 1234567 or + 49 30 1234567, not 555 123 4567") == ["(555) 123-4567", "0049 30 1234567", "+ 49 30 1234567"]


def test_outliers_of_small_groups_are_found(spark):
    rng = random.Random(1)
    plain = lambda: " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(3, 8))) for _ in range(80))
    soup = lambda: " ".join("".join(rng.choices("abcdefgh", k=4)) + "###" for _ in range(80))
    rows = [(k, plain(), "en", f"host{k % 30}") for k in range(240)] + [(1000 + k, soup(), "en", f"host{k}") for k in range(6)]
    rows += [(k, plain(), "is", f"host{k % 3}") for k in range(2000, 2009)] + [(3000, soup(), "is", "host1")]
    rows += [(k, plain(), "en", "large") for k in range(4000, 4060)] + [(5000, soup(), "en", "large")]
    out = quality_rules.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert len(out) == len(rows) and all(r["distance"] is not None for r in out)
    assert {r["doc_id"] for r in out if not r["kept"]} == {*range(1000, 1006), 3000, 5000}


def brute_overlaps(docs, items):
    cut = lambda t: [w.rstrip(".,;:!?") for w in re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())]
    out = {}
    for item_id, item in items:
        t = cut(item)
        for doc_id, text in docs:
            d, near, hits = cut(text), {}, set()
            for mask in (decontaminate.MASKS[k] for k in decontaminate.masks_of(len(t))):
                picked = [k for k, bit in enumerate(mask) if bit == "1"]
                seeds = {}
                for i in range(len(t) - len(mask) + 1):
                    seeds.setdefault(tuple(t[i + k] for k in picked), []).append(i)
                for j in range(len(d) - len(mask) + 1):
                    hits |= {j - i for i in seeds.get(tuple(d[j + k] for k in picked), ())}
            for shift in hits:
                for i in range(max(0, -shift), min(len(t), len(d) - shift)):
                    if t[i] == d[i + shift]:
                        for cell in (shift // len(t) - 1, shift // len(t)):
                            of_item, of_doc = near.setdefault(cell, (set(), set()))
                            of_item.add(i)
                            of_doc.add(i + shift)
            n = max((min(len(a), len(b)) for a, b in near.values()), default=0)
            if t and (n >= decontaminate.MIN_SHARE * len(t) or n >= decontaminate.MIN_MATCHED):
                out[doc_id, item_id] = n
    return out


def test_decontamination_equals_brute_force(spark, real):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [(r["doc_id"], r["text"]) for r in real.collect()]
    rng = random.Random(2)
    for k in range(120):  # passages with words replaced, cut, moved and repeated, beside many words in common
        words = rng.choice(items)[1].split()
        part = words[: rng.randrange(1, len(words) + 1)]
        part = [("changed" if rng.random() < rng.choice((0, 0.2, 0.4)) else w) for w in part] * rng.choice((1, 1, 3))
        docs.append((10_000 + k, " ".join(rng.choices(words, k=20) + part + rng.choices(words, k=rng.randrange(30)))))
    items += [(900, "one"), (901, "one two"), (902, "one two three"), (903, "a a a a a a a a"), (904, None), (905, "one two")]
    docs += [(20_000, "one two three, ONE! two"), (20_001, "a " * 30), (20_002, None), (20_003, "one")]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["n_matched"] for r in decontaminate.contaminated(*frames).collect()}
    assert found == brute_overlaps(docs, items) and len(found) > 40


def test_token_counts_of_the_whole_vocabulary(real):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = token_counts.load_pieces(path)
    automaton, longest = token_counts.Automaton(pieces), max(map(len, pieces))
    assert len(pieces) > 40_000 and Tokenizer.from_file(path).get_vocab_size() >= len(pieces)
    words = {w for r in real.collect() for w in (r["text"] or "").lower().split()}
    for word in sorted(words)[:6000]:
        s, i, n = (*word.encode(), token_counts.END), 0, 0
        while i < len(s):
            j = next((j for j in range(min(len(s), i + longest), i, -1) if s[i:j] in pieces), None)
            if j is None:
                n = 1
                break
            i, n = j, n + 1
        assert automaton.count(word) == n


def test_pipeline_equals_brute_force(spark, real):
    import corpus_pipeline
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    good = {r["doc_id"] for r in quality_rules.quality_rules(real).collect() if r["kept"]}
    texts = {d: t for d, (t, _) in brute_line_dedup([(r["doc_id"], r["text"]) for r in real.collect() if r["doc_id"] in good]).items()}
    classes = brute_classes(texts)
    texts = {d: t for d, t in texts.items() if classes[d][1] == d}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {d for d, _ in brute_overlaps(list(texts.items()), items)}
    assert len(good) < real.count() and len(texts) < len(good) and leaked
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for d, t in texts.items():
        if d not in leaked:
            ids = library.encode_ordinary(t)
            want.append((d, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.encode())))
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == sorted(want)
