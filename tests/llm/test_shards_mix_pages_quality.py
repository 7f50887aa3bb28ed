import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from casewarden.llm import html_text, kd_shards, mixing, quality

DOC = "doc_id long, text string, lang string, source string"


def docs(spark, rows):
    return spark.createDataFrame(rows, DOC).withColumn("row", F.lit("clash")).withColumn("number", F.lit(0)).repartition(3)


def shard_bytes(out):
    return {r["shard"]: r["b"] for r in out.groupBy("shard").agg(F.sum("size").alias("b")).collect()}


@pytest.mark.parametrize("k", [2, 3, 7])
def test_kd_shards_equal_a_plain_tree(spark, k):
    """Sources that share a long prefix; the cuts of a tree over their places, ids and languages."""
    rng = random.Random(k)
    rows = [(rng.choice((None, *range(900))), "x" * rng.randint(0, 60), rng.choice(("en", "de", None)), f"https://{rng.choice('abcdefgh')}.example") for _ in range(300)]
    rows = list({r[0]: r for r in rows}.values())
    out = {r["doc_id"]: r["shard"] for r in kd_shards.kd_shards(docs(spark, rows), k).collect()}
    rank = [{v: i for i, v in enumerate(sorted({r[c] for r in rows}, key=lambda v: (v is not None, v)))} for c in range(4)]
    ids = [r[0] for r in rows if r[0] is not None]
    low = min(ids)
    point = {r[0]: (0 if r[0] is None else r[0] - low + 1, rank[2][r[2]] + 1, rank[3][r[3]] + 1) for r in rows}
    size = {r[0]: len(r[1]) + kd_shards.ROW_BYTES for r in rows}
    span = [max(ids) - low + 1] + [len(rank[c]) for c in (2, 3)]

    def check(members, first, n):
        """Every cut is at the node's widest dimension, and as near its goal as rows allow."""
        assert {out[i] for i in members} <= set(range(first, first + n))
        if n == 1 or not members:
            return
        wide = max(range(3), key=lambda d: ((max(point[i][d] for i in members) - min(point[i][d] for i in members)) / span[d], -d))
        left = [i for i in members if out[i] < first + n // 2]
        right = [i for i in members if out[i] >= first + n // 2]
        assert max((point[i][wide] for i in left), default=0) <= min((point[i][wide] for i in right), default=1 << 60)
        goal = sum(size[i] for i in members) * (n // 2) / n
        assert abs(sum(size[i] for i in left) - goal) <= max(size.values())
        check(left, first, n // 2)
        check(right, first + n // 2, n - n // 2)

    check([r[0] for r in rows], 0, k)


def test_equal_rows_and_long_prefixes_are_split(spark):
    rows = [(5, "same text", "en", "https://a.example")] * 600 + [(i, "other text", "en", f"https://{'abc'[i % 3]}.example") for i in range(1000, 1400)]
    for _ in range(2):
        out = kd_shards.kd_shards(docs(spark, rows), 8)
        sizes = shard_bytes(out)
        assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 60
    slots = out.groupBy("shard").agg(F.count_distinct("slot").alias("n"), F.max("slot").alias("m"), F.count(F.lit(1)).alias("c")).collect()
    assert all(r["n"] == r["c"] == r["m"] + 1 for r in slots)
    assert kd_shards.kd_shards(docs(spark, rows).limit(0)).count() == 0


def test_large_group_of_null_ids(spark):
    out = kd_shards.kd_shards(docs(spark, [(None, f"t{i % 7}", None, None) for i in range(900)] + [(i, "y", "en", "s") for i in range(300)]), 4)
    sizes = shard_bytes(out)
    assert out.count() == 1200 and max(sizes.values()) - min(sizes.values()) <= 60


def brute_taken(rows, block):
    """Words of one shard that are taken once more: listed one by one. rows: (start, end), blocks, extra, shift."""
    (places, blocks, extra, shift) = rows
    drawn = {b for b in range(blocks) if (b + shift + 1) * extra // blocks > (b + shift) * extra // blocks}
    assert len(drawn) == extra
    return [sum(w // block in drawn for w in range(s, e)) for s, e in places]


def test_words_drawn_equal_a_list_of_blocks(spark):
    rng = random.Random(4)
    for block in (1, 3, 8):
        cells, rows = {}, []
        for cell in range(12):
            sizes = [rng.randint(0, 15) for _ in range(20)]
            ends = np.cumsum(sizes).tolist()
            total = ends[-1]
            blocks = -(-total // block)
            cells[cell] = ([(e - s, e) for s, e in zip(sizes, ends)], blocks, rng.randint(0, blocks), rng.randrange(blocks))
            rows += [(cell, i, e - s, e, *cells[cell][1:]) for i, (s, e) in enumerate(zip(sizes, ends))]
        df = spark.createDataFrame(rows, "cell long, i int, start long, end long, blocks long, extra long, shift long")
        got = defaultdict(dict)
        for r in df.select("cell", "i", (mixing.words_drawn("end", block) - mixing.words_drawn("start", block)).alias("n")).collect():
            got[r["cell"]][r["i"]] = r["n"]
        for cell, x in cells.items():
            assert [got[cell][i] for i in range(20)] == brute_taken(x, block)


def test_mix_takes_what_targets_ask(spark):
    rng = random.Random(9)
    rows = [(i, "w " * rng.randint(0, 400), "en", rng.choice("aaaab") if i % 10 else None) for i in range(3000)] + [(7, "w " * 50_000, "en", "b"), (8, None, "en", "a"), (8, "", "en", "a")]
    d = docs(spark, rows)
    first, again = (sorted(map(tuple, mixing.mix(d.repartition(n), shard_rows=400).drop("text_hash").collect()), key=repr) for n in (2, 5))
    assert first == again and len(first) == len(rows)
    target, taken = {}, Counter()
    for _, source, size, _, goal, n in first:
        assert 0 <= n <= 3 * size
        target[source], taken[source] = goal, taken[source] + n
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] for s in target)


STORY = "<p>First sentence of the story, quite long, with commas, and more. It goes on, and on.</p><p>Second paragraph, also long, with words, words, and words. It ends here.</p>"
TOLD = "First sentence of the story, quite long, with commas, and more. It goes on, and on.\nSecond paragraph, also long, with words, words, and words. It ends here."


@pytest.mark.parametrize(("page", "text"), [
    (f"<body><article>{STORY}</article><article class='comment'><p>I disagree, strongly, with all of this.</p></article></body>", TOLD),
    (f"<main>{STORY}<article class='comment-body'><p>Me too, entirely, and with commas.</p></article></main>", TOLD),
    (f"<body><div id=c><h1>T</h1>{STORY}</div><div><a href=x><h3>Other story</h3><p>Teaser, with commas, and more of it.</p></a></div></body>", f"T\n{TOLD}"),
    (f"<body><header>Site</header><div id=c><header><h1>Title</h1></header><div class=body>{STORY}</div></div><footer>f</footer></body>", f"Title\n{TOLD}"),
    (f"<body><div id=page><header><h1>Site</h1></header><nav>menu</nav><div id=c>{STORY}</div><footer>f</footer></div></body>", TOLD),
    (f"<body><div id=c><header><h1>Site</h1><div><nav>menu</nav></div></header>{STORY}</div></body>", TOLD),
    (f"<article>{STORY}<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be given.</p></article>", f"{TOLD}\nLet x=2 be given."),
    (f"<article><p>Text with <a href=x>an open link, and text after it, long.</p>{STORY}</article>", f"Text with an open link, and text after it, long.\n{TOLD}"),
])
def test_article_without_what_is_around_it(page, text):
    assert html_text.main_text(page) == text


def test_pages_without_article_equal_their_blocks():
    """Pages made of known blocks, in containers without article or main."""
    rng = random.Random(8)
    for _ in range(40):
        words = lambda n: " ".join(rng.choice(("stone", "river", "cloud", "garden", "winter")) for _ in range(n)).capitalize()
        told = [words(3)] + [f"{words(12)}, {words(9)}. {words(10)}, and so on." for _ in range(rng.randint(3, 7))]
        body = f"<h1>{told[0]}</h1>" + "".join(f"<p>{t}</p>" for t in told[1:])
        cards = "".join(f"<li><a href=x>{words(4)}</a></li>" for _ in range(4))
        page = f"<html><body><header><a href=/>Home</a></header><div class=wrap><div id=c>{body}</div><div class=related><ul>{cards}</ul></div></div><form>{words(9)}</form><footer>{words(8)}.</footer></body></html>"
        assert html_text.main_text(page) == "\n".join(told)


def test_pages_without_rows(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract(empty).collect() == []


CLASH = ["_near_key", "_near_nth", "_mix_id", "_mix_hash", "_mix_n", "_mix_copy", "_bad_id", "_bad_hash", "id", "label"]


def test_pipeline_stages_on_odd_tables(spark, sf):
    """Nulls, empty and repeated rows, columns that clash with the stages' own, and no rows at all."""
    import corpus_pipeline

    told = "stone river cloud garden winter summer " * 3
    rows = [(None, None, None, None), (1, "", "en", "a"), (2, f"{told} one", "en", "a"), (3, f"{told} one", "en", None), (3, f"{told} one", "en", None), (4, "short text", None, "b"), (None, f"{told} two", "de", "b"), (5, "w " * 30_000, "en", "a")]
    table = spark.createDataFrame(rows, DOC)
    for i, name in enumerate(CLASH):
        table = table.withColumn(name, F.concat(F.lit(f"{i}:"), F.coalesce("text", F.lit("null"))))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, sf)
        if name != "token_shards":
            assert out.columns == table.columns, name
            assert out.where(" OR ".join(f"`{c}` <> concat('{i}:', coalesce(text, 'null'))" for i, c in enumerate(CLASH))).count() == 0, name
            ids = {r["doc_id"] for r in out.collect()}
            assert ids <= {None, 1, 2, 3, 4, 5}
        else:
            assert out.count() == len(rows)
        assert stage(spark, table.limit(0), sf).count() == 0, name


def labelled(spark, n=1500, copies=0):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        bad, foul = i % 5 == 0, i % 7 == 0
        words = [rng.choice(("tree", "house", "road", "light", "water")) for _ in range(30)] + ["vile", "brute"] * (3 * foul)
        rng.shuffle(words)
        rows.append((i, "".join(w + ("!!! $$$ " if bad else " ") for w in words), "en", "spam" if bad else "news", 1 - bad, int(foul)))
    rows += [rows[3]] * copies
    return spark.createDataFrame([(i, t, a, b, int(q), f) for i, t, a, b, q, f in rows], f"{DOC}, quality int, toxic int")


def test_one_id_many_times_is_learned_from_once(spark):
    table = labelled(spark, 400, 5000)
    model = quality.train(table.select("doc_id", "text", "lang", "source"), table.select("doc_id", "quality", "toxic"), labelled=300)
    got = quality.score(table, model)
    assert got.count() == 5400 and got.where("doc_id = 3").select("score").distinct().count() == 1


def test_exchange_adds_up_over_all_documents(spark):
    """The distributed sums equal those over all rows at once, and a fit on them moves towards the pseudo-labels."""
    table = labelled(spark)
    d, marks = table.select("doc_id", "text", "lang", "source"), table.select("doc_id", "quality", "toxic")
    model = quality.train(d, marks, labelled=200, rounds=1)
    asked = quality.exchange(d.repartition(5), model, [1, 2, 3])
    plain = d.where("doc_id NOT IN (1, 2, 3)").toPandas()
    batch = pa.RecordBatch.from_pandas(plain, preserve_index=False)
    sums = {}
    for first, last, words, meta in quality.features(batch):
        for view, label, n, g, c in model.parts["toxic"].pseudo(model.sparse(last - first, words), meta):
            old = sums.setdefault(view, {}).get(label, (0, 0.0, 0.0))
            sums[view][label] = (old[0] + n, old[1] + g, old[2] + c)
    for view, by_label in sums.items():
        want = quality.Asked(model.parts["toxic"].models[view][0], by_label)
        assert np.allclose(asked["toxic"][view].slope, want.slope, atol=1e-9) and np.allclose(asked["toxic"][view].curve, want.curve, atol=1e-9)
    assert sum(n for n, _, _ in sums[1].values()) > 1000  # far more than the sample: all confident documents
    full = quality.score(d, quality.train(d, marks, labelled=200)).join(marks, "doc_id")
    assert full.where("(p_toxic > 0.5) <> (toxic = 1)").count() <= 0.02 * 1500 and full.where("(p_low > 0.5) <> (quality = 0)").count() <= 0.02 * 1500


def test_curvature_bounds_the_loss():
    """The quadratic that a view is fitted on never lies below the loss of its pseudo-labels."""
    rng = np.random.default_rng(2)
    x = np.abs(rng.normal(0, 0.4, (200, 6)))
    y = (x[:, 0] > 0.3).astype(float)
    model = quality.Logistic(1e-3).fit(x, y, np.ones(200))
    p = 1 / (1 + np.exp(-model(x)))
    length = x.sum(1) + np.abs(model.mean).sum() + 1.0
    h = np.full(200, 0.25)
    c = np.append((h * length) @ x, (h * length).sum())
    asked = quality.Asked(model, {1: (200, np.append((p - y) @ x, (p - y).sum()), c)})
    loss = lambda w: np.mean(np.logaddexp(0, (x - model.mean) @ w[:-1] + w[-1]) - y * ((x - model.mean) @ w[:-1] + w[-1]))
    for _ in range(200):
        w = asked.at + rng.normal(0, 1, 7)
        bound = asked.slope @ (w - asked.at) + 0.5 * asked.curve @ (w - asked.at) ** 2
        assert quality.PSEUDO * (loss(w) - loss(asked.at)) <= bound + 1e-9


def test_kd_levels_read_written_points(spark, sf, monkeypatch):
    plans, cut = [], kd_shards._cut_level

    def note(*args):
        points = next(a for a in args if hasattr(a, "_jdf"))
        plans.append(points._jdf.queryExecution().optimizedPlan().toString())
        return cut(*args)

    monkeypatch.setattr(kd_shards, "_cut_level", note)
    out = kd_shards.kd_shards(spark.read.parquet(f"{sf}/documents.parquet"), 40)
    assert len(plans) == 6 and not any("Join" in p or p.count("Relation") != 1 for p in plans)
    assert out.select("shard").distinct().count() == 40
