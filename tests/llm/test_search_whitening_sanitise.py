import math
import random
import re
from collections import Counter
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from casewarden.llm import ranked_search, sanitise, whitening

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, k=10):
    words = [terms(t) for _, t in docs]
    n, length = sum(map(bool, words)), sum(map(len, words))
    df = Counter(t for w in words for t in set(w))
    out = []
    for item, text in items:
        scores = []
        for (doc, _), w in zip(docs, words):
            tf, score = Counter(w), 0
            for t in set(terms(text)) & set(w):
                m = 100 - 90 + (90 * len(w) * n) // length
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m))
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if null else doc, -score) for rank, (score, null, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(map(repr, out))


@pytest.mark.parametrize(("block", "shard"), [(1 << 19, 1 << 20), (7, 40)])
def test_search_equals_brute_force(spark, block, shard):
    rng = random.Random(5)
    common = [f"w{int(rng.paretovariate(0.6)) % 60}" for _ in range(4000)]
    docs = [(i, " ".join(rng.choices(common, k=rng.randint(1, 40)))) for i in range(300)]
    docs += [(i, docs[3][1]) for i in range(500, 540)] + [(7, docs[9][1]), (None, docs[3][1]), (None, None), (600, ""), (601, "--- !"), (602, "W1 W2 Étude étude É"), (603, "w1 " * 50_000)]
    items = [(i, " ".join(rng.choices(common, k=rng.randint(1, 12)))) for i in range(25)] + [(30, docs[3][1]), (31, None), (32, "absent words"), (33, "étude w1"), (None, "W1, w2"), (1, "w1")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("q", F.lit(0)).repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(9))
    got = ranked_search.search(d, i, 10, block, shard).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(repr(tuple(r)) for r in got) == brute_search(docs, items)


def test_search_without_rows(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.limit(0), items.limit(0)), (docs.withColumn("text", F.lit("")), items)):
        found = ranked_search.search(d, i)
        assert set(found.columns) == {"item_id", "rank", "doc_id", "score"} and found.count() == 0


def test_lists_are_not_read_to_the_end():
    """A document far ahead of all others ends the search early, and ties with the k-th do not."""
    n = 5000
    cut, term, tf = np.arange(n + 1), np.zeros(n, np.int64), np.r_[np.full(20, 50), np.ones(n - 20, np.int64)]
    shard = ranked_search.Shard(np.full(n, 100), cut, term, tf, np.array([3000]), n, 100 * n)
    docs, scores = shard.best(np.array([0]), np.full(1, -1), 10, np.zeros(0, np.int64))
    assert len(docs) < 100 and sorted(docs)[:20] == list(range(20)) and len(set(scores[:16])) == 1


def test_term_of_equal_hash_is_compared():
    t = ranked_search.Terms(["abc", "é"])
    t.hash[:] = np.sort(np.array([5, 9], np.uint64))
    t.id[:] = [0, 1]
    data = np.frombuffer(b"ABC abd \xc3\xa9 ab", np.uint8)
    start, end = np.array([0, 4, 8, 11]), np.array([3, 7, 10, 13])
    word, term = t.find(data, start, end, np.array([5, 5, 9, 5], np.uint64))
    assert word.tolist() == [0, 2] and term.tolist() == [0, 1]


def brute_whiten(vectors, k):
    x = np.floor(64 * vectors.astype(float)) + 1_000_000
    n, mean = len(x), x.mean(0)
    v = (x - mean).T @ (x - mean) / n
    e, u = np.linalg.eigh(v)
    return (x - mean) @ u[:, ::-1][:, :k] / np.sqrt(e[::-1][:k]), e[::-1][:k] / np.trace(v), [sum((n * int(a) - int(s)) ** 2 for a, s in zip(r, x.sum(0))) for r in x]


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(0, 0.2, (120, 6)).astype(np.float32) @ rng.normal(0, 1, (6, 6)).astype(np.float32)
    vectors = np.concatenate([base, np.repeat(base[:1], 500, 0), base[3:5], base[3:4]])
    bad = [None, [], [0.1, None, 0.2, 0.3, 0.4, 0.5], [float("nan")] + [0.0] * 5, [float("inf")] + [0.0] * 5, [1.0, 2.0], [0.5] * 7]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(10**6 + i, v) for i, v in enumerate(bad)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("x", F.lit("clash")).withColumn("weight", F.lit(2)).repartition(4)
    got = {r["vec_id"]: r for r in whitening.whiten(df, 4).collect()}
    want, explained, deviation = brute_whiten(vectors, 4)
    assert sorted(got) == list(range(len(vectors)))
    have = np.array([got[i]["whitened"] for i in range(len(vectors))])
    assert np.abs(have * np.sign((have * want).sum(0)) - want).max() < 1e-9
    assert np.allclose(got[0]["explained"], explained, rtol=1e-9) and got[0]["identity_error"] < 1e-9
    assert [int(got[i]["deviation"]) for i in range(len(vectors))] == deviation and got[0]["n"] == len(vectors)
    assert len({tuple(got[i]["whitened"]) for i in range(120, 620)}) == 1


def test_unweighted_fit_counts_distinct_vectors(spark):
    rows = [(i, [0.1 * (i % 3), 0.3 * (i % 2)]) for i in range(12)] + [(20 + i, [0.0, 0.0]) for i in range(40)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), weighted=False).collect()
    assert len(got) == 52 and got[0]["n"] == 6 and got[0]["identity_error"] < 1e-9


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [float("nan")])]])
def test_whitening_without_rows(spark, rows):
    assert whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect() == []


def test_whitening_of_flat_and_far_vectors(spark):
    flat = whitening.whiten(spark.createDataFrame([(None, [1.0, 2.0])] * 3, "vec_id long, embedding array<float>")).collect()
    assert [(r["vec_id"], r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in flat] == [(None, [0.0, 0.0], [0.0, 0.0], 0.0, Decimal(0))] * 3
    rows = [(1, [1e15, 0.5]), (2, [-1e15, 0.25]), (3, [3.0, 0.75]), (4, [3e38, 1.0])]
    far = {r["vec_id"]: r for r in whitening.whiten(spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")).collect()}
    grid = [(math.floor(64 * a) + 1_000_000, math.floor(64 * b) + 1_000_000) for _, (a, b) in rows[:3]]
    s = [sum(c) for c in zip(*grid)]
    assert {i: int(r["deviation"]) for i, r in far.items()} == {i + 1: sum((3 * a - b) ** 2 for a, b in zip(g, s)) for i, g in enumerate(grid)}
    assert whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("deviation IS NULL").count() > 0


def test_op12_columns(spark, sf):
    from casewarden.llm.queries import QUERIES

    rows = QUERIES["op12_whitening"](spark, sf)
    assert [t for _, t in rows.dtypes] == ["bigint", "int", "bigint", "bigint", "double", "double", "double"]
    n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert rows.count() == 32 * n and rows.where("identity_error > 1e-4 OR deviation IS NULL").count() == 0


PATTERNS = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def brute_luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def brute_base(text):
    def digits(m):
        return re.sub("[^0-9]", "", m[0])

    good = [lambda m: True, lambda m: all(int(p) < 256 for p in m[0].split(".")), lambda m: 12 <= len(digits(m)) <= 19 and brute_luhn(digits(m)), lambda m: 9 <= len(digits(m)) <= 15]
    return [(k, *m.span()) for k, p in enumerate(PATTERNS) for m in p.finditer(text) if good[k](m)]


def test_base_spans_equal_plain_patterns():
    rng = random.Random(11)
    parts = ["@", ".", "a", "b.c", "1", "12", "255", "256", "007", " ", "-", "+", "(", ")", "4111 1111 1111 1111", "x@y.zz", "1.2.3.4", "+49 (30) 123-4567", "é", "\n", "5500-0000-0000-0004", "٣", "0" * 9]
    for _ in range(6000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert [f[:3] for f in sanitise.find_base(text)] == brute_base(text), text


@pytest.mark.parametrize("text", ["a" * 400_000, "1" * 400_000, "@" * 400_000, "a@" * 200_000, "1." * 200_000, "+1" * 200_000, "+1" + "(" * 400_000, "1 2-3 " * 70_000, "a@b." * 100_000])
def test_long_texts_take_linear_time(text):
    sanitise.find_base(text)


def planted(copies=False):
    """An entity whose neighbour 'zulkor' stands nowhere else; 'often' is everywhere."""
    rng = random.Random(2)
    words = [f"v{i}" for i in range(400)]
    talk = lambda n: " ".join(rng.choices(words, k=n))
    rows = [(i, f"{talk(30)} often {talk(10)}") for i in range(300)]
    if copies:
        same = f"{talk(20)} zulkor often a.b@mail.example.com {talk(20)}"
        return rows + [(1000 + i, same.replace("v1 ", f"n{i} ", 1)) for i in range(50)]
    return rows + [(1000 + i, f"{talk(20)} often Zulkor a.B@mail.example.com {talk(20)}") for i in range(12)] + [(2000, "Étude: zulkor was here, ZULKOR 1.2.3.4"), (None, None), (2001, "")]


def test_disclosing_terms_are_found(spark):
    rows = planted()
    docs = spark.createDataFrame(rows + rows[-3:], "doc_id long, text string").withColumn("kind", F.lit("clash")).withColumn("term", F.lit("x"))
    found = sanitise.scan(docs)
    spans = {r["doc_id"]: (r["copies"], [tuple(s) for s in r["spans"]]) for r in found.collect()}
    assert len(spans) == len(rows) and spans[2000][0] == spans[None][0] == spans[2001][0] == 2
    assert all(not s for i, (_, s) in spans.items() if i is not None and i < 1000)
    for i, text in rows:
        if i is not None and 1000 <= i < 2000:
            at = text.index("Zulkor")
            assert spans[i][1] == [(at, 4, at + 6), (at + 7, 0, at + 27)] or spans[i][1] == [(at, 5, at + 6), (at + 7, 0, at + 27)]
    text = rows[-3][1]
    assert [(s, e) for s, _, e in spans[2000][1]] == [m.span() for m in re.finditer("zulkor|ZULKOR|1.2.3.4", text)]
    clean = {r["doc_id"]: r["text"] for r in sanitise.sanitised(docs, found).collect()}
    assert clean[None] is None and clean[2001] == "" and clean[0] == rows[0][1]
    assert "ulkor" not in clean[1000] and "[EMAIL]" in clean[1000] and clean[2000].endswith("[IP]") and "ulkor" not in clean[2000].lower()


def test_copies_prove_nothing(spark):
    docs = spark.createDataFrame(planted(copies=True), "doc_id long, text string")
    assert {s["kind"] for r in sanitise.scan(docs).collect() for s in r["spans"]} == {0}


def test_sanitise_without_rows(spark):
    assert sanitise.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_op13_equals_brute_force(spark, sf):
    from casewarden.llm.queries import QUERIES
    import hashlib

    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    rows = QUERIES["op13_sanitise"](spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        base = brute_base(texts[r["doc_id"]] or "")
        line = ",".join(f"{sanitise.KINDS[k]}:{s}:{e}" for k, s, e in sorted(base, key=lambda b: (b[1], b[0])))
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(b[0] == k for b in base) for k in range(4)]
        assert set(filter(None, line.split(","))) <= set(r["spans"].split(","))
