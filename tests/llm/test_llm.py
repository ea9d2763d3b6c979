"""The training-data operators against plain versions, on small fixtures with nulls, ties, copies and odd names."""

import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from statweave.llm import common, embedding_dedup, language_id, mixing, ngram_join, packing, quality_model, quality_rules, secret_scan, token_counts, toxicity, word_bpe
from statweave.llm.queries import ORACLES, QUERIES

P = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and long texts, ties and repeated rows, an extra column that clashes."""
    long = " ".join(f"word{i % 997} the of" for i in range(4000))
    rows = [(1, None, "en", "a", 0, 1.0), (2, "", None, None, 0, 2.0), (3, " \n\t ", "en", "", 4, None), (4, "The same text of some words here", "en", "a", 3, 0.0), (4, "The same text of some words here", "en", "a", 3, 0.0), (None, "No id but a text", "en", "b", None, 0.0), (5, long, "en", "b", 1, 0.0), (6, "Ünïcode ﬁ 日本 😀 it's <|endoftext|> 1,234", "de", "c", 1, 0.0), (7, "THE SAME text of some words here", "en", None, 3, 0.0)]
    return spark.createDataFrame(rows, SCHEMA + ", score double").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def brute_components(rows, k, num, den):
    sets = {}
    for i, text in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            both = len(a & b)
            if a and b and den * both >= num * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(seed=5, n=60):
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    base = [random.choice(vocabulary) for _ in range(80)]
    for _ in range(n):
        text = list(base) if random.random() < 0.6 else [random.choice(vocabulary) for _ in range(random.randint(1, 90))]
        for _ in range(random.randint(0, 4)):
            text[random.randrange(len(text))] = random.choice(vocabulary)
        rows.append((i, " ".join(text)))
        i += 1
    return rows


@pytest.mark.parametrize(("k", "num", "den"), [(3, 9, 10), (5, 4, 5)])
def test_jaccard_join_equals_all_pairs(spark, monkeypatch, k, num, den):
    monkeypatch.setattr(ngram_join, "GROUP_TOKENS", 600)
    monkeypatch.setattr(ngram_join, "GROUP_QUERIES", 3)
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(df, k, num, den).collect()}
    assert got == brute_components(rows, k, num, den)


def test_jaccard_join_of_a_large_group_grows_with_its_members(spark, monkeypatch):
    """One group of near copies around a text that is there too, cut to many groups of tokens: exact, and few rows asked."""
    monkeypatch.setattr(ngram_join, "GROUP_TOKENS", 2000)
    random.seed(2)
    base = [f"b{i}" for i in range(90)]
    asked = {}
    for size in (60, 240):
        rows = [(0, " ".join(base))]
        for i in range(1, size):
            text = list(base)
            for _ in range(random.choice([1, 1, 1, 2])):  # one change is similar enough, two aren't
                text[random.randrange(len(text))] = f"v{random.randrange(10**6)}"
            rows.append((i, " ".join(text)))
        seen = []
        monkeypatch.setattr(ngram_join, "_asked", lambda *a, f=ngram_join._asked, out=seen: out.append(f(*a)) or out[-1])
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(df, 5, 4, 5).collect()}
        monkeypatch.undo()
        monkeypatch.setattr(ngram_join, "GROUP_TOKENS", 2000)
        assert got == brute_components(rows, 5, 4, 5)
        asked[size] = seen[0][0].select("q").distinct().count()
    linked = [c for c in got.values() if c[1] == 0]
    assert len(linked) > 100 and asked[240] <= 240 - len(linked) + 5


def test_jaccard_join_edges(odd, empty):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(odd, 3, 9, 10).collect()), key=repr)
    assert len(got) == 9 and (1, 0, 1) in got and (3, 0, 3) in got and (7, 5, 4) in got and got.count((4, 5, 4)) == 2
    assert ngram_join.jaccard_components(empty).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 102), (101, 102), (7, 7)]
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def library_pieces(df, window):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    return [(r["doc_id"], np.array(tk.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4")) for r in df.collect()]


@pytest.mark.parametrize("weights", [None, {"a": 5, "b": 1}])
def test_packing_is_an_exact_round_trip(odd, weights):
    pieces = packing.pack(odd, P.path("word_bpe_49k.json"), window=64, weights=weights).collect()
    want = Counter()
    for i, ids in library_pieces(odd, 64):
        want[i] += len(ids)
    got = Counter()
    by_sequence = {}
    texts = {i: ids for i, ids in library_pieces(odd, 64)}
    for p in pieces:
        got[p["doc_id"]] += p["length"]
        assert bytes(p["ids"]) == texts[p["doc_id"]][p["start"] : p["start"] + p["length"]].tobytes()
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert got == want
    for spans in by_sequence.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at == 64 or at & (at - 1) == 0


def test_packing_plan_keeps_shares():
    plan = packing.Plan([6000, 3000, 1000], [6000.0, 3000.0, 1000.0], 100)
    taken = Counter()
    for q, n in enumerate([6000, 3000, 1000]):
        for _, take, k, _ in plan.pieces(q, 0, n):
            taken[k, q] += take
    assert all(abs(taken[k, q] - share) <= 2 for k in range(100) for q, share in enumerate((60, 30, 10)))


@pytest.mark.parametrize("weights", [None, {"s7": 3.0, "big": 1.0}])
def test_packing_gives_small_sources_their_share(spark, monkeypatch, weights):
    monkeypatch.setattr(packing, "SMALLEST_SHARE", 4)
    monkeypatch.setattr(packing, "BUCKETS", 5)
    rows = [(i, f"s{i % 20}", "one two three four five six seven eight nine") for i in range(400)] + [(1000 + i, "big", "ten words") for i in range(1000)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3), P.path("word_bpe_49k.json"), window=256, weights=weights).collect()
    size, taken, spans = Counter(), Counter(), {}
    for p in pieces:
        size[p["source"]] += p["length"]
        taken[p["source"], p["sequence_id"]] += p["length"]
        spans.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    total = sum(size.values())
    for k, got in spans.items():
        ends = [0, *(o + n for o, n in sorted(got))]
        assert [o for o, _ in sorted(got)] == ends[:-1]
        assert ends[-1] == 256 or k >= total // 256
    if weights:
        assert abs(taken["s7", 0] - 192) <= 8 and abs(taken["big", 0] - 64) <= 8
    else:
        assert all(abs(taken[s, k] - 256 * size[s] / total) <= 8 for s in size for k in range(total // 256))


def test_packing_empty(empty):
    assert packing.pack(empty, P.path("word_bpe_49k.json")).count() == 0


def test_word_bpe_equals_the_library():
    random.seed(3)
    alphabet = "aeinst'’ABC \n\t.,!-#0123éÉßñ÷中<|"
    texts = [None, "", "it's we'll ''s don't", "x" * 200] + ["".join(random.choice(alphabet) for _ in range(random.randint(0, 50))) for _ in range(1500)]
    bpe = word_bpe.load(P.path("word_bpe_49k.json"))
    for t, ids in zip(texts, bpe.encode_column(pa.array(texts)), strict=True):
        assert ids.tolist() == bpe.library.encode(t or "", add_special_tokens=False).ids, t


def test_token_counts_equal_the_library(odd, empty, monkeypatch):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    machine = token_counts.load(P.path("piece_bpe_32k.model"))
    random.seed(4)
    alphabet = "abcdethin   \n.,'▁é中😀<s>/0123"
    texts = ["", " ", "  a  b", "<s> x</s>"] + ["".join(random.choice(alphabet) for _ in range(random.randint(1, 60))) for _ in range(1500)]
    pieces = [library.id_to_piece(random.randrange(3, 32000)).replace("▁", " ") for _ in range(4000)]
    texts += ["".join(pieces[i : i + 8]) for i in range(0, 4000, 8)]
    for chunk in (1 << 18, 7):
        monkeypatch.setattr(token_counts, "CHUNK", chunk)
        assert [machine.count(t) for t in texts] == [len(library.encode(t)) for t in texts]
    monkeypatch.undo()
    rows = token_counts.token_counts(odd, P.path("piece_bpe_32k.model"), 100).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    assert len(rows) == 9
    for r in rows:
        t = texts[r["doc_id"]]
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), len(library.encode(t)), len(library.encode(t)) > 100)
    assert token_counts.token_counts(empty, P.path("piece_bpe_32k.model")).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    got, want = QUERIES[name](spark, small).toPandas(), con.sql(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda df: sorted(tuple(map(str, (round(v, 6) if isinstance(v, float) else v for v in r))) for r in df[columns].itertuples(index=False))
    assert key(got) == key(want)


def test_mixing_meets_targets(spark, odd, empty):
    rows = mixing.mix(mixing.sized(odd)).collect()
    sizes = Counter()
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        sizes[r["row"]["source"]] += r["taken"]
    targets = {r["row"]["source"]: r["target"] for r in rows}
    assert all(abs(sizes[s] - targets[s]) < 1 for s in targets)
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns
    words = Counter()
    for r in mixed.collect():
        words[r["source"]] += len(WORD.findall(r["text"] or ""))
    assert words == Counter({s: n for s, n in sizes.items() if n})
    assert mixing.mix(mixing.sized(empty)).count() == 0


def test_secret_spans(spark, odd, empty):
    text = 'user = bob\npassword: "hunter22" and AKIA' + "A1" * 9 + " é https://api.example.com:80/x token=abc key 24be64439e3e49cf46b2d7c9"
    far = "https://other.example.org " + "x " * 300 + "login: alice"
    df = spark.createDataFrame([(1, text), (2, far), (3, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in secret_scan.scan(df).collect()}
    assert [s["kind"] for s in rows[1]["strong"]] == ["assign", "access", "hex"]
    assert [s["kind"] for s in rows[1]["spans"]] == ["login", "assign", "access", "endpoint", "hex"]
    assert all(text[s["start"] : s["end"]].startswith({"assign": "password", "access": "AKIA", "hex": "24be", "login": "user", "endpoint": "https"}[s["kind"]]) for s in rows[1]["spans"])
    assert rows[2]["spans"] == [] and rows[3]["spans"] == []
    clean = secret_scan.masked_documents(df).orderBy("doc_id").collect()
    assert "hunter22" not in clean[0]["text"] and clean[0]["text"].count("[secret]") == 5 and clean[1]["text"] == far and clean[2]["text"] is None
    assert secret_scan.masked_documents(odd).columns == odd.columns and secret_scan.scan(empty).count() == 0


def plain_spans(text):
    """Spans by the definition: all pairs of spans are looked at."""
    out = []
    for rank, kind in enumerate(secret_scan.KINDS):
        for m in re.finditer(kind.pattern, text):
            if len(m.group(kind.value)) >= kind.least:
                out.append((m.start(), rank, m.end(), kind))
    strong = [s for s in out if s[1] < len(secret_scan.STRONG)]
    weak = [s for s in out if s not in strong and not any(t[0] < s[2] and s[0] < t[2] for t in strong)]

    def roles(s, spans):
        return {t[3].role for t in spans if s[0] <= t[2] + secret_scan.SCOPE and t[0] <= s[2] + secret_scan.SCOPE} - {s[3].role}

    kept = strong + [s for s in weak if roles(s, strong) or len(roles(s, weak)) == 2]
    return [(s[3].name, s[0], s[2]) for s in sorted(kept, key=lambda s: s[:3])]


def test_secret_spans_equal_all_pairs(spark):
    random.seed(3)
    bits = ["user=bob12", "https://a.b.example.com:80", "token=abcdefg12", "AKIA" + "A1" * 9, "a1b2c3d4e5f6a7b8c9d0e1f2", "Q" * 40, "é😀", "x " * 60, "login: me_1", "aws/" + "Z9" * 20, "password=" + "a1" * 14, "\n"]
    texts = [random.choice(["", " "]).join(random.choice(bits) for _ in range(random.randint(0, 40))) for _ in range(300)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secret_scan.scan(df).collect():
        assert [(s["kind"], s["start"], s["end"]) for s in r["spans"]] == plain_spans(texts[r["doc_id"]] or "")
    for r in secret_scan.masked_documents(df).collect():
        want, at = "", 0
        for _, start, end in plain_spans(texts[r["doc_id"]] or ""):
            want, at = (want + texts[r["doc_id"]][at:start] + "[secret]" if start >= at else want), max(at, end)
        assert r["text"] == (texts[r["doc_id"]] and want + texts[r["doc_id"]][at:])


def test_secrets_of_a_text_with_very_many_matches(spark):
    text = " ".join(f"user=bob{i} https://e{i}.example.com/ token=abcdefg{i} é" for i in range(10000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    begun = time.monotonic()
    assert len(secret_scan.scan(df).first()["spans"]) == 30000
    want = re.sub(r"user=bob\d+|https://e\d+\.example\.com|token=abcdefg\d+", "[secret]", text)
    assert secret_scan.masked_documents(df).first()["text"] == want
    assert time.monotonic() - begun < 60


def test_quality_rules_equal_a_plain_version(odd, docs, empty):
    for df in (odd, docs.limit(60)):
        texts = Counter()
        for r in df.collect():
            t = r["text"] or ""
            w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
            grams = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
            covered = {p for j in range(len(w) - 4) if grams[tuple(w[j : j + 5])] > 1 for p in range(j, j + 5)}
            texts[r["doc_id"], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)] += 1
        got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality_rules.judge(df).collect())
        assert got == texts
    assert quality_rules.judge(empty).count() == 0


def held_out(rows, labels, field, test):
    good = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    return np.mean([test(r) == labels[r["doc_id"]][field] for r in good])


def test_classifiers_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    toxic = QUERIES["op7_toxicity"](spark, sf).collect()
    assert held_out(toxic, labels, "toxic", lambda r: r["predicted"]) > 0.88
    clean = [r for r in toxic if r["doc_id"] in labels and labels[r["doc_id"]]["toxic"] == 0]
    assert np.mean([r["predicted"] for r in clean]) < 0.01
    quality = QUERIES["op9_quality_classifier"](spark, sf).collect()
    assert held_out(quality, labels, "quality", lambda r: r["predicted"]) > 0.95
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    lang = QUERIES["op4_language_id"](spark, sf).collect()
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]] for r in lang if r["held_out"]]) > 0.98
    for r in (*toxic[:50], *quality[:50], *lang[:50]):
        assert 0 <= r["score"] <= 1
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % (3 if r in toxic else 4) == (1 if r in toxic else 2))


def test_classifiers_take_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1, 1), (5, 0, 0), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    every = F.col("doc_id").isNotNull()
    for module in (toxicity, quality_model):
        for model in (module.fit(odd, labels, every), module.fit(empty, labels, every)):
            rows = module.score(odd, model).collect()
            assert len(rows) == 9 and all(0 <= r["score"] <= 1 for r in rows)
        assert module.score(empty, None).count() == 0
    assert toxicity.below(odd, None, 0.7).columns == odd.columns
    models = language_id.fit(odd, every)
    rows = {r["doc_id"]: r for r in language_id.identify(odd, models).collect()}
    assert len(rows) == 8 and rows[1]["lang_pred"] == rows[3]["lang_pred"] == "und" and rows[5]["lang_pred"] in ("en", "de")
    assert language_id.fit(empty, every) is None and language_id.identify(odd, None).where("lang_pred != 'und'").count() == 0


def test_letters_above_the_basic_plane_count():
    texts = ["\U0002a700\U0002a701", "\U00010900", "\U00010330", "\U00020020", "\U0001d100", "\U0001f600 12", "a"]
    blobs = [t.encode() for t in texts]
    _, bounds = language_id.grams(np.frombuffer(b"".join(blobs), np.uint8), np.cumsum([0, *map(len, blobs)]))
    assert [n > 0 for n in np.diff(bounds)] == [True, True, True, True, False, False, True]


def test_kneser_ney_sums_to_one():
    data = np.frombuffer(b"the cat sat on the mat and the rat", np.uint8)
    keys, _ = language_id.grams(data, np.array([0, len(data)]))
    levels = language_id.kneser_ney(*np.unique(keys, return_counts=True))
    letters = np.array(sorted({int(k) & 0xFFFF for k in keys}), np.uint64)
    context = keys[5] & ~np.uint64(0xFFFF)
    p = 2 ** language_id.log_probabilities(levels, context | letters, len(letters))
    assert abs(p.sum() - 1) < 1e-9


def brute_links(rows, cos):
    sound = {}
    for i, v, label in rows:
        ok = i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
        sound[i] = (np.array(v, float) / max(map(abs, v)), label) if ok else None
    links, parent = Counter(), {i: i for i, _, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(i for i in sound if sound[i] is not None)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            (a, x), (b, y) = sound[i], sound[j]
            if x == y and len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= cos:
                links[i] += 1
                links[j] += 1
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return {i: (links[i], find(i)) for i, _, _ in rows}


def test_embedding_links_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 40)
    monkeypatch.setattr(embedding_dedup, "CENTRES", 6)
    monkeypatch.setattr(embedding_dedup, "LEAF", 4)
    rng = np.random.default_rng(8)
    rows, centre = [], rng.normal(size=(4, 12))
    for i in range(360):
        v = centre[i % 4] + rng.normal(size=12) * (0.05 if i % 3 else 1.0)
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 5 == 0)))
    rows += [(360, rows[1][1], rows[1][2]), (361, [2 * x for x in rows[1][1]], rows[1][2]), (362, None, 0), (363, [0.0] * 12, 0), (364, [float("nan")] + [1.0] * 11, 0), (365, rows[1][1], None), (366, [None] + [1.0] * 11, 0), (367, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == brute_links(rows, 0.98)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embedding_links_of_extreme_components(spark):
    rows = [(1, [1e-200] * 4, 0), (2, [2e-200] * 4, 0), (3, [1e200, 1e200, 1e200, 1.01e200], 0), (4, [5e-324, 0.0, 0.0, 0.0], 0), (5, [1e308, 0.0, 0.0, 1e100], 0), (6, [1.0, 1.0, 1.0, -1.0], 0), (7, [float("inf")] * 4, 0), (8, [1e-200] * 4, 1)]
    rows += [(100 + i, [1e-200 * (1 + i % 3), 1e-200, 1e-200 * (1 + i % 2), 0.0], 0) for i in range(40)]
    rows += [(8, [1e-200, 1e-200, 1e-200, 1e-200], 1), (9, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("copies", F.lit("clash")).withColumn("cell", F.lit(None).cast("int"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(df).collect()}
    want = brute_links([r for r in rows if r[0] < 8 or r[0] > 9], 0.98)
    assert {i: x for i, x in got.items() if i not in (8, 9)} == want and got[8] == (1, 8) and got[9] == (0, 9)


def test_embedding_links_of_a_label_that_does_not_divide(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 60)
    monkeypatch.setattr(embedding_dedup, "UNDIVIDED", 0.05)  # every division is given up: blocks are compared
    rng = np.random.default_rng(4)
    rows = [(i, [1.0, float(x), float(y)], "a") for i, (x, y) in enumerate(rng.normal(size=(150, 2)) * 1e-6)] + [(200 + i, [float(x) for x in rng.normal(size=3)], "a") for i in range(60)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert got == brute_links(rows, 0.98)


def test_pipeline_stages(spark, tmp_path, docs, small):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_copies", "secrets", "mixing", "packing"]
    current = docs
    for name, stage in cp.STAGES:
        out = str(tmp_path / name)
        stage(spark, current, small).write.parquet(out)
        after = spark.read.parquet(out)
        if name != "packing":
            assert after.columns == docs.columns
        before, rows = current.collect(), after.collect()
        if name == "near_copies":
            want = brute_components([(r["doc_id"], r["text"]) for r in before], 5, 4, 5)
            assert {r["doc_id"] for r in rows} == {c for _, c in want.values()} and len(rows) == len({r["doc_id"] for r in rows})
        if name == "secrets":
            texts = {r["doc_id"]: r["text"] for r in before}
            spans = {r["doc_id"]: r["spans"] for r in secret_scan.scan(current).collect()}
            assert all((r["text"] == texts[r["doc_id"]]) == (not spans[r["doc_id"]]) and r["n_chars"] == len(r["text"]) for r in rows)
        if name == "mixing":
            total = sum(len(WORD.findall(r["text"] or "")) for r in before)
            assert abs(sum(len(WORD.findall(r["text"] or "")) for r in rows) - 1.5 * total) < 25
        if name == "packing":
            assert sum(r["length"] for r in rows) == sum(len(ids) for _, ids in library_pieces(current, 4096))
        current = after


def test_pipeline_stages_take_odd_rows(spark, small, empty):
    import corpus_pipeline as cp

    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, "en", "a", 48, "x"), (1, text, "en", "a", 48, "x"), (1, "another text of its own under a repeated id", None, None, None, None), (None, text, None, "", 0, "y"), (None, "no id and a text of its own that nobody has", "en", "b", 1, None), (2, None, None, None, None, None), (3, "", "en", "a", 0, "z"), (4, " \n ", "en", "a", 3, "z")]
    odd = spark.createDataFrame(rows, SCHEMA + ", `row.text` string").repartition(3)
    assert cp.drop_toxic(spark, odd, small).columns == odd.columns and cp.drop_toxic(spark, odd, small).count() == 8
    kept = cp.drop_near_copies(spark, odd, small)
    texts = Counter(r["text"] for r in kept.collect())
    assert kept.columns == odd.columns and texts == Counter({text: 1, rows[2][1]: 1, rows[4][1]: 1, None: 1, "": 1, " \n ": 1})
    assert sorted(map(repr, cp.mask_secrets(spark, odd, small).collect())) == sorted(map(repr, odd.collect()))
    mixed = cp.mix_sources(spark, odd, small)
    assert mixed.columns == odd.columns and all(WORD.search(r["text"]) for r in mixed.collect())
    assert sum(r["offset"] == 0 for r in cp.pack_windows(spark, odd, small).collect()) > 0
    for _, stage in cp.STAGES:
        assert stage(spark, empty, small).count() == 0
