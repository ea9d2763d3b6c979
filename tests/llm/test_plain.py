"""Operators against plain versions written from their definitions, and rows that repeat without end."""

import hashlib
import math
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from statweave.llm import common, language_id, mixing, quality_model, quality_rules, toxicity


def plain_targets(totals, weights=(5, 2, 1)):
    """Targets by stopping one round of sources after another."""
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    stopped, whole = set(), 3 * sum(totals.values()) / 2
    while True:
        rest = whole - sum(2 * totals[s] for s in stopped)
        free = sum(w[s] for s in names if s not in stopped)
        new = {s for s in names if s not in stopped and rest * w[s] / free >= 2 * totals[s]}
        if not new:
            return {s: 2.0 * totals[s] if s in stopped else rest * w[s] / free for s in names}
        stopped |= new


def test_mixing_of_rows_that_repeat_equals_a_plain_version(spark):
    """A third of the rows wholly equal, a third without an id, many sources: the same as one sorted pass."""
    random.seed(4)
    rows = [(7, "one text of six words here", None, "hot", 0)] * 120 + [(None, " ".join(["w"] * random.randint(0, 9)), None, "hot", 0) for _ in range(120)]
    rows += [(i, " ".join(["v"] * random.randint(1, 40)), None, random.choice(["", None, *"abcdefgh"]), 0) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(6)
    size = lambda t: len(t.split())
    totals = Counter()
    for _, t, _, s, _ in rows:
        totals[s] += size(t)
    targets, want = plain_targets(totals), Counter()
    for s in totals:
        epochs, ahead = int(targets[s]) // totals[s], 0
        key = lambda r: hashlib.md5(f"{'' if r[0] is None else r[0]}:mix:{hashlib.md5(r[1].encode()).hexdigest()}".encode()).hexdigest()
        for r in sorted((r for r in rows if r[3] == s), key=key):
            n = size(r[1])
            want[r[0], s, n, round(targets[s], 6), epochs * n + max(0, min(n, int(targets[s]) - epochs * totals[s] - ahead))] += 1
            ahead += n
    got = mixing.mix(mixing.sized(df)).collect()
    assert Counter((r["doc_id"], r["row"]["source"], r["size"], round(r["target"], 6), r["taken"]) for r in got) == want


def test_prefix_sums(spark):
    rows = [(i, i * i) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, v long").repartition(5)
    got = {r["i"]: r["ahead"] for r in mixing.prefix_sums(df, [F.col("i").desc()], ahead="v").collect()}
    assert got == {i: sum(j * j for j in range(i + 1, 300)) for i in range(300)}


def test_stop_words_are_a_share_in_any_case_and_language(spark):
    rows = [
        (0, "The cat AND dog " * 20),  # capitals count
        (1, "kissa " * 40 + "ja koira on ei se " * 6),
        (2, "zebra lion monkey tiger " * 20),  # no stop word
        (3, "кошка собака и дом " * 20),  # no basic Latin letters: the rule says nothing
        (4, "zebra lion monkey tiger " * 50 + "the of"),  # two words of 202
        (5, "zebra lion monkey tiger " * 14),  # below 60 words
    ]
    got = {r["doc_id"]: "stop_words" in r["broken"] for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: False, 1: False, 2: True, 3: False, 4: True, 5: False}


TEXTS = ["The cat sat on the mat.", "a rat, the cat; THE hat", "no word", "x", "Ünder über", "the the the", "12 ... ", ""]


def letters(text):
    """Letters in lower case, runs of all else one blank, none at the front."""
    out = "".join(c.lower() if c.isalpha() else " " for c in text)
    out = re.sub(" +", " ", out).lstrip()
    return out if out.strip() else ""


def plain_kneser_ney(texts, alphabet):
    """p(character | up to three before) from counts and distinct characters before, in dictionaries."""
    top = Counter()
    for t in texts:
        padded = "   " + letters(t)
        top.update(padded[i - 3 : i + 1] for i in range(3, len(padded)))
    tables = {4: top}
    for n in (3, 2, 1):
        tables[n] = Counter(g[1:] for g in tables[n + 1])

    def p(gram):
        if not gram:
            return 1 / alphabet
        table, context = tables[len(gram)], gram[:-1]
        seen = {g: c for g, c in table.items() if g[:-1] == context}
        if not seen:
            return p(gram[1:])
        total = sum(seen.values())
        return (max(table[gram] - language_id.DISCOUNT, 0) + language_id.DISCOUNT * len(seen) * p(gram[1:])) / total

    return p


def test_entropies_equal_kneser_ney_by_dictionaries():
    learned, alphabet = TEXTS[:5], 30
    (_, data, offsets), = common.text_chunks(pa.array(learned))
    keys = language_id.grams(data, offsets)[0]
    models = language_id.Models(["x"], [language_id.kneser_ney(*np.unique(keys, return_counts=True))], alphabet, 1.0, np.array([np.inf]))
    p = plain_kneser_ney(learned, alphabet)
    (_, data, offsets), = common.text_chunks(pa.array(TEXTS))
    bits, length = language_id.entropies(models, data, offsets)
    for t, got, n in zip(TEXTS, bits[:, 0], length, strict=True):
        padded = "   " + letters(t)
        grams = [padded[i - 3 : i + 1] for i in range(3, len(padded))]
        assert n == len(grams)
        if grams:
            assert abs(got + sum(math.log2(p(g)) for g in grams) / len(grams)) < 1e-9


def test_learner_equals_ftrl_by_its_definition():
    """Every weight is solved anew from all gradients and rates so far; no running state is shared with the learner."""
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 40, 12)).astype(np.int32) for _ in range(60)]
    labels = np.array([int(3 in r or 7 in r) for r in rows])
    got = toxicity.learn(rows, labels)
    size, order = 1 << toxicity.BITS, np.random.default_rng(11)
    gradients, shift = defaultdict(list), defaultdict(float)

    def weight(i):
        rate = (toxicity.BETA + math.sqrt(sum(g * g for g in gradients[i]))) / toxicity.ALPHA
        z, l1 = sum(gradients[i]) - shift[i], 0.0 if i == size else toxicity.L1
        return 0.0 if abs(z) <= l1 else -(z - math.copysign(l1, z)) / (rate + (0.0 if i == size else toxicity.L2))

    for _ in range(toxicity.EPOCHS):
        for k in order.permutation(len(rows)):
            at = [*rows[k].tolist(), size]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-sum(w.values()))) - labels[k]
            for i in at:
                before = math.sqrt(sum(x * x for x in gradients[i]))
                gradients[i].append(g)
                shift[i] += (math.sqrt(sum(x * x for x in gradients[i])) - before) / toxicity.ALPHA * w[i]
    want = {i: weight(i) for i in range(40)}
    assert abs(got.intercept - weight(size)) < 1e-6
    found = dict(zip(got.features.tolist(), got.weights.tolist(), strict=True))
    assert set(found) == {i for i, w in want.items() if w} and all(abs(found[i] - want[i]) < 1e-6 for i in found)


def test_features_are_words_pairs_and_skips():
    """Two texts share as many features as they share words, pairs and pairs around a word."""

    def plain(t):
        w = re.sub("[^a-z\x80-\U0010ffff]", " ", re.sub("[A-Z]", lambda m: m[0].lower(), t)).split()
        return {(w[i],) for i in range(len(w))} | {(gap, w[i], w[i + gap]) for gap in (1, 2) for i in range(len(w) - gap)}

    (_, data, offsets), = common.text_chunks(pa.array(TEXTS))
    found, owner, n = toxicity.features(data, offsets)
    sets, want = [set(found[owner == d].tolist()) for d in range(n)], [plain(t) for t in TEXTS]
    assert [[len(a & b) for b in sets] for a in sets] == [[len(a & b) for b in want] for a in want]


def test_context_vectors_and_scores_equal_plain_loops(spark):
    random.seed(9)
    texts = [" ".join(random.choice(["Alpha", "beta", "42", "x,y", "the"]) for _ in range(random.randint(0, 30))) for _ in range(25)] + ["", " "]
    (_, data, offsets), = common.text_chunks(pa.array(texts))
    kinds, bounds = quality_model.units(data, offsets)
    index, sums = quality_model._index_vectors(), np.zeros((quality_model.KINDS, 1 << quality_model.BUCKETS_BITS, quality_model.DIMENSIONS))
    for k, at in enumerate(kinds):
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            for i in range(a, b):
                for j in range(max(a, i - quality_model.WINDOW), min(b, i + quality_model.WINDOW + 1)):
                    sums[k, at[i]] += index[at[j]]
    norms = np.linalg.norm(sums, axis=2, keepdims=True)
    want = np.divide(sums, norms, out=np.zeros_like(sums), where=norms > 0)
    assert np.abs(quality_model.context_vectors([(kinds, bounds)]) - want).max() < 1e-5
    rng = np.random.default_rng(1)
    d, hidden = quality_model.DIMENSIONS, quality_model.HIDDEN
    w1, b1, w2 = rng.normal(size=(3 * d, hidden)), rng.normal(size=hidden), rng.normal(size=hidden)
    model = quality_model.Model(np.stack([want[k] @ w1[k * d : (k + 1) * d] for k in range(3)]).astype(np.float32), b1, w2, 0.3, 1.7)
    rows = quality_model.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r in rows:
        a, b = bounds[r["doc_id"]], bounds[r["doc_id"] + 1]
        pooled = np.concatenate([want[k][kinds[k][a:b]].mean(0) if b > a else np.zeros(d) for k in range(3)])
        logit = (np.tanh(pooled @ w1 + b1) @ w2 + 0.3) / 1.7
        assert abs(r["score"] - 1 / (1 + math.exp(-logit))) < 1e-4


def test_samples_take_one_text_of_a_repeated_id(spark):
    rows = [(1, f"the cat sat number {i % 7}", "en") for i in range(200)] + [(2, "der Hund und die Katze", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    every = F.lit(True)
    one = df.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    a, b = language_id.fit(df, every), language_id.fit(one, every)
    assert a.languages == b.languages and all(np.array_equal(x.keys, y.keys) and np.allclose(x.shares, y.shares) for p, q in zip(a.levels, b.levels, strict=True) for x, y in zip(p, q, strict=True))
    m, n = quality_model.fit(df, labels, every), quality_model.fit(one, labels, every)
    assert np.array_equal(m.first, n.first)
    assert toxicity.fit(df, labels, every) is not None


def test_learning_stays_out_of_the_driver(spark, monkeypatch):
    words = ["alpha", "beta", "gamma", "delta", "vile", "rotten"]
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(words[: 4 + 2 * (i % 2)], 12)) for i in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    rows = []
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        rows.append(np.unique(toxicity.features(data, np.array([0, len(data)]))[0]))
    want = toxicity.learn(rows, np.arange(200) % 2)
    assert len(want.features)

    driver, learn = os.getpid(), toxicity.learn

    def outside(*args):
        assert os.getpid() != driver, "the driver must not learn"
        return learn(*args)

    def refuse(*args):
        raise AssertionError("the driver must not hold the sample")

    monkeypatch.setattr(toxicity, "learn", outside)
    for name in ("toArrow", "toPandas"):
        monkeypatch.setattr(type(docs), name, refuse)
    got = toxicity.fit(docs, labels, F.lit(True))
    assert got.intercept == want.intercept and got.features.tolist() == want.features.tolist() and got.weights.tolist() == want.weights.tolist()
    assert toxicity.fit(docs, labels.where("toxic = 1"), F.lit(True)) is None and toxicity.fit(docs.limit(0), labels, F.lit(True)) is None


def test_join_lets_the_driver_drop_what_it_has_cut(spark, monkeypatch):
    from statweave.llm import ngram_join

    seen = []
    monkeypatch.setattr(ngram_join, "settle", lambda session: seen.append(session), raising=False)
    docs = spark.createDataFrame([(i, f"one two three four five six {i // 2}") for i in range(8)], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(docs, k=5, num=4, den=5).collect()} == {i: i // 2 * 2 for i in range(8)}
    assert len(seen) > 5
