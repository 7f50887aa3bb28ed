import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from casewarden.llm import chat, decontaminate, exact_dedup, kd_shards, minhash, mixing, quality
from casewarden.llm.queries import QUERIES, SQL

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def odd_docs(spark):
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \t\r\n\x0b\x0c", "en", "a"), (4, "one two", "en", "a"), (5, "one\ntwo ", None, "b"), (5, "one\ntwo ", None, "b"), (6, "onetwo", "fr", "b")]
    rows += [(None, "free text", "de", None), (7, "word " * 30_000, "de", "c"), (8, "É é Straße ŉ İ Σ ΣΑΣ K", "de", "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("size", F.lit("clash")).withColumn("kept", F.lit(1))


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf, name):
    c = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    q = c.execute(SQL[name])
    columns = [d[0] for d in q.description]
    want = sorted(map(repr, q.fetchall()))
    assert sorted(repr(tuple(r)) for r in QUERIES[name](spark, sf).select(*columns).collect()) == want and want


def test_chat_round_trip(spark):
    texts = ["", None, "\\", "\\\\<|", "<|im_end|>\n<|im_start|>user\n", "<<SYS>>x<</SYS>> [INST][/INST]</s><s>", "<", "[", "a<|", "é🙂" * 50]
    rows = [(1, i, ("user", "assistant", "sys tem\n<|", None)[i % 4], t) for i, t in enumerate(texts)] + [(None, None, "user", "x")] * 2
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n_turns", F.lit(0))
    back = {r.conv_id: r for r in chat.read_back(chat.render(chat.fold_events(chat.turn_events(c)), chunk_turns=3)).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [(r or "", t or "") for _, _, r, t in rows[:-2]]
    assert back[1].loss_text == "".join(t or "" for _, _, r, t in rows if r == "assistant")
    assert back[None].n_turns == 2
    assert sum(x.skip + x.learn + x.rest for x in back[1].loss_mask) == len(back[1].formatted)


def test_chat_folds_events(spark):
    e = [
        (1, "m1", 1, "message", "user", "hi"), (1, "m2", 2, "message", "assistant", "he"), (1, "m2", 3, "delta", None, "l"), (1, "m2", 4, "delta", None, "lo"),
        (1, "m1", 5, "edit", None, "hey"), (1, "m2", 6, "regenerate", None, None), (1, "m2", 7, "delta", None, "new"), (1, "m3", 8, "message", "user", "x"), (1, "m3", 9, "delete", None, None),
    ]
    events = spark.createDataFrame(e[::-1], "conv_id long, message_id string, seq long, kind string, role string, text string")
    got = [(r.role, r.text) for r in chat.fold_events(events).orderBy("first_seq").collect()]
    assert got == [("user", "hey"), ("assistant", "new")]
    assert chat.render(chat.fold_events(events.limit(0))).count() == 0


def test_exact_dedup_odd(spark, odd_docs):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in exact_dedup.content_sort_groups(odd_docs).collect())
    assert [x[1:] for x in got if x[1] in (1, 2, 3)] == [(1, 3, 3, False), (2, 3, 3, False), (3, 3, 3, True)]
    assert [x[1:] for x in got if x[1] in (4, 5, 6)] == [(4, 5, 4, False), (5, 5, 4, False), (5, 5, 4, True), (6, 5, 4, False)]
    assert (True, 0, None, 1, True) in got
    assert exact_dedup.content_sort_groups(odd_docs.limit(0)).count() == 0


@pytest.mark.parametrize("most", [decontaminate.MAX_BROADCAST_BYTES, 0])
def test_decontaminate_odd(spark, odd_docs, most):
    items = [(1, "ONE two"), (2, None), (3, "..."), (4, "word " * 12), (10, "straße"), (11, "é"), (12, "k")]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def brute(text):
        w, hit, found = WORD.findall(ascii_lower(text or "")), set(), set()
        for item, t in items:
            b = WORD.findall(ascii_lower(t or ""))
            n = min(len(b), 10)
            grams = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
            for i in range(len(w) - n + 1) if n else ():
                if tuple(w[i : i + n]) in grams:
                    hit.update(range(i, i + n))
                    found.add(str(item))
        return len(w), len(hit), sorted(found)

    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.items) for r in decontaminate.scan(odd_docs, bench, most=most).collect())
    assert got == sorted((str(r.doc_id), *brute(r.text)) for r in odd_docs.collect())
    kept = decontaminate.clean(odd_docs, bench)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "6", "None"]
    assert decontaminate.scan(odd_docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.scan(odd_docs.limit(0), bench).count() == 0


def test_large_benchmark_is_a_broadcast_set(spark):
    """A benchmark of a million windows: the same job, and only windows that hit are made as text."""
    bench = spark.range(1000).select(F.col("id").alias("item_id"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(1008)), lambda i: F.concat(F.lit("w"), (F.col("id") * 1009 + i).cast("string"))), " ").alias("text"))
    docs = spark.createDataFrame([(1, "a b c " + " ".join(f"w{i}" for i in range(1009 * 7 + 5, 1009 * 7 + 20))), (2, "w1 w3 w5 " * 50)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.scan(docs, bench).collect()}
    assert got == {1: (18, 15, ["7"]), 2: (150, 0, [])}


def test_mixing_targets_and_quotas(spark, sf, odd_docs):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += len([x for x in re.split(r"[\x20\x09-\x0D]+", r.text or "") if x])
    names = sorted(sizes)
    weight = {n: i % 3 + 1 for i, n in enumerate(names)}
    free, left, target = set(names), float(sum(sizes.values())), {}
    while True:  # capped sources leave, the rest share what is left
        level = left / sum(weight[n] for n in free)
        full = {n for n in free if weight[n] * level > 3 * sizes[n]}
        if not full:
            break
        for n in full:
            target[n], left = 3.0 * sizes[n], left - 3.0 * sizes[n]
        free -= full
    target |= {n: weight[n] * level for n in free}
    taken = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for n in names:
        assert taken[n] == pytest.approx(target[n], rel=0.02, abs=5)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs).collect()))
    odd = mixing.mix(odd_docs).collect()
    assert len(odd) == odd_docs.count() and all(r.taken <= 3 * r.size for r in odd)
    assert mixing.mix(odd_docs.limit(0)).count() == 0 and mixing.repeat_documents(odd_docs).columns == odd_docs.columns


def test_sainte_lague(spark):
    import random

    rng = random.Random(3)
    for seats, votes in ((20, [41, 35, 17, 5, 2]), (7, [1, 1, 1, 1]), (500, [rng.randint(0, 900) for _ in range(60)]), (3, [0, 10]), (0, [4, 5])):
        p = spark.createDataFrame([(0, i, v, seats) for i, v in enumerate(votes)], "g int, i int, v long, n long")
        got = {r.i: r.quota for r in mixing.sainte_lague(p, ["g"], ["i"], "v", "n").collect()}
        quota = [0] * len(votes)
        for _ in range(seats):
            best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * quota[i] + 1), -i))
            quota[best] += 1
        assert [got[i] for i in range(len(votes))] == quota


def test_kd_shards(spark, sf, odd_docs):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("shard", F.lit("clash"))
    got = kd_shards.kd_shards(docs, shards=7).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    total, slots = Counter(), defaultdict(list)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
        total[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert sorted(total) == list(range(7)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(total.values()) - min(total.values()) <= 2 * max(r.size for r in got)
    assert sorted(got) == sorted(kd_shards.kd_shards(docs, shards=7).collect())
    assert kd_shards.kd_shards(odd_docs).count() == odd_docs.count() and kd_shards.kd_shards(odd_docs.limit(0)).count() == 0


def shingles(text):
    w = WORD.findall(ascii_lower(text or ""))
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def test_near_duplicates_equal_brute_force(spark, sf, odd_docs):
    base = " ".join(f"w{i}" for i in range(200))
    edits = [base.replace(f"w{k} ", f"x{k} ") for k in range(0, 60, 3)] + [base + " w7" * 3, base.replace("w1 ", "z ").replace("w90 ", "y ").replace("w150 ", "q ")]
    more = spark.createDataFrame([(5000 + i, t) for i, t in enumerate([base, *edits, base.upper()])], "doc_id long, text string")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(more)
    rows = [(r.doc_id, shingles(r.text)) for r in docs.collect()]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, a) in enumerate(rows):
        for j, b in rows[:n]:
            if a and b and sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    assert {i: r.group_id for i, r in got.items()} == {i: find(i) for i in root}
    assert all(r.kept == (i == find(i)) for i, r in got.items())
    odd = minhash.keep_one_each(odd_docs)
    assert odd.columns == odd_docs.columns and sorted(str(r.doc_id) for r in odd.collect()) == sorted(["1", "2", "3", "4", "6", "7", "8", "None"])
    assert minhash.near_duplicates(odd_docs.limit(0)).count() == 0


def test_near_dedup_in_small_plans(spark, monkeypatch):
    """The stages of a plan start together, and each takes the driver's memory: no table it writes needs many exchanges."""
    from casewarden.llm import components as cc

    exchanges, roots = [], {}

    def written(df, name, write=cc.written):
        plan = df._jdf.queryExecution().executedPlan().toString()
        exchanges.append((plan.count("Exchange hashpartitioning"), name))
        return write(df, name)

    monkeypatch.setattr(cc, "written", written)
    monkeypatch.setattr(minhash, "written", written)
    rng = random.Random(7)
    links = [(0, k) for k in range(1, 30)] + [(k, k + 1) for k in range(40, 60)] + [tuple(rng.sample(range(100, 160), 2)) for _ in range(40)] + [(70, 70)]
    for a, b in links:  # plain union of labels
        x, y = roots.setdefault(a, a), roots.setdefault(b, b)
        roots = {k: min(x, y) if v in (x, y) else v for k, v in roots.items()}
    rows = [(k, " ".join(f"w{rng.randrange(6)}" for _ in range(40 + k % 3)) if k % 4 else f"same {'text ' * 9}") for k in range(40)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = cc.components(spark.createDataFrame(links, "a long, b long")).collect()
        assert minhash.keep_one_each(spark.createDataFrame(rows, "doc_id long, text string")).where("text LIKE 'same%'").count() == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r["node"]: r["root"] for r in got} == {k: v for k, v in roots.items() if k != v}
    assert max(exchanges)[0] <= 8, sorted(exchanges)[-5:]


def test_rows_with_null_or_repeated_ids_are_told_apart(spark):
    text = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcd"]
    near = text[2].replace("c7 ", "x ")
    rows = [(1, text[0]), (1, text[1]), (2, text[1] + " end"), (None, text[2]), (None, near), (None, text[3]), (9, text[3].upper()), (None, "..."), (None, "..."), (3, text[0]), (3, text[0])]
    got = minhash.keep_one_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    left = sorted((str(r.doc_id), r.text[:2].lower()) for r in got)
    assert left == [("1", "a0"), ("1", "b0"), ("9", "d0"), ("None", ".."), ("None", ".."), ("None", "c0")]


def test_signatures_estimate_weighted_jaccard():
    import numpy as np

    shingle = np.concatenate([np.arange(40), np.arange(40)]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a, b = np.array([1, 5, 9, 2] * 10), np.array([2, 5, 3, 2] * 10)
    best = minhash.bag_minhash(np.repeat([0, 1], 40), shingle, np.concatenate([a, b]), 2, 4096)
    assert (best[0] == best[1]).mean() == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.04)


def test_signatures_do_not_depend_on_the_piece():
    import numpy as np
    import pyarrow as pa

    from casewarden.llm import textvec

    def signatures(texts):
        column = pa.array(texts, pa.string())
        assert list(textvec.pieces(column)) == [(0, len(texts))]
        h, words = textvec.word_hashes(*textvec.string_buffers(column))
        return minhash.bag_minhash(*textvec.shingle_units(h, words, 5), len(texts), 315)

    rng = np.random.default_rng(2)
    texts = [" ".join(map(str, rng.integers(0, 300, n))) for n in (1, 8, 24, 60, 200, 2000)] + ["again and " * 400]
    others = [" ".join(map(str, rng.integers(0, 10**6, 100))) for _ in range(1400)]
    piece = signatures(texts + others)
    assert sum(map(len, texts + others)) > 900_000
    few, long = signatures(texts + others[:30]), signatures([" ".join(map(str, rng.integers(0, 10**6, 120_000))), *texts])[1:]
    for i, t in enumerate(texts):
        alone = signatures([t])[0].tobytes()
        assert alone == few[i].tobytes() == piece[i].tobytes() == long[i].tobytes()


def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels.where("doc_id % 3 > 0"))
    got = quality.score(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id").toPandas()
    low, toxic = got["quality"] == 0, got["toxic"] == 1
    assert ((got["p_low"] > 0.5) == low).mean() > 0.93 and ((got["p_toxic"] > 0.5) == toxic).mean() > 0.95
    clean = got[~low & ~toxic]
    assert clean["kept"].mean() > 0.97
    assert got[low | toxic]["kept"].mean() < 0.2


def test_quality_of_a_rare_class(spark):
    import random

    rng = random.Random(5)
    rows = []
    for i in range(12_000):
        words = [f"w{rng.randrange(400)}" for _ in range(40)]
        toxic, low = i % 500 == 7, i % 9 == 0
        if toxic or low:
            words[::4] = [("vile" if toxic else "spam") + str(rng.randrange(6)) for _ in range(10)]
        rows.append((i, " ".join(words), "en", "a", 1 - low, int(toxic)))
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, quality int, toxic int")
    model = quality.train(table, table.select("doc_id", "quality", "toxic").where("doc_id < 10000"), labelled=1200)
    got = quality.score(table, model).toPandas().set_index("doc_id")
    toxic = got.index % 500 == 7
    assert (got["p_toxic"] > 0.5)[toxic].mean() > 0.9 and (got["p_toxic"] > 0.5)[~toxic].mean() < 0.002
    low = got.index % 9 == 0
    assert ((got["p_low"] > 0.5) == low)[~toxic].mean() > 0.99
    labels = table.select("doc_id", "quality", F.expr("int(doc_id < 5)").alias("toxic"))
    with pytest.warns(UserWarning, match="toxic"):
        assert quality.train(table, labels, labelled=1200).parts["toxic"] is None


def test_quality_odd(spark, odd_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.train(odd_docs, none)
    assert quality.score(odd_docs, model).where("kept").count() == odd_docs.count()
    assert quality.keep_good(odd_docs, none).columns == odd_docs.columns
    assert quality.keep_good(odd_docs.limit(0), none).count() == 0


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        if name != "mix_sources":
            assert out.join(docs, docs.columns, "left_anti").count() == 0 and out.count() <= docs.count()
        docs = out
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and sum(r.n_tokens for r in rows) == max(r.start + r.n_tokens for r in rows)


