"""Ranked lexical search with the Best Position Algorithm.

Documents are scored by integer impacts, one per document and item term, added up. The corpus is
cut into shards of at most ``SHARD`` postings, each of whole documents, so that a term of every
document is never one task's list. In a shard every term has an impact list, highest first. An
item's lists are read in step (sorted access); each document met gets its full score by reading
its other postings (direct access), which marks its positions in all lists as seen. The best
position of a list is the last one before its first unseen position: what no list has shown
scores at most the sum of the impacts there. Reading stops when that sum is strictly below the
k-th score, so that ties by doc_id come out right. The k best of a task's earlier shards stay, and
let its later shards stop sooner; the candidates of all tasks are ranked in two steps.

Items are taken in blocks of about ``BLOCK`` distinct terms; a block's terms are sent to the tasks,
and the corpus is read once per block. Terms are found by a 64-bit hash and compared in full.

Defined results: null and empty texts have no terms, are counted nowhere and never found; an item
without terms, or whose terms no document holds, has no rows; documents that are repeated rows, or
repeat a doc_id, are documents of their own; a null doc_id is last among equal scores; every row of
``benchmark`` is an item, also where its item_id is repeated or null; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewarden.llm.textvec import pieces, string_buffers, word_spans
from casewarden.storage import written

TOP = 10
BLOCK, SHARD = 1 << 19, 1 << 20
#: Entries that are read from each list at first; the number doubles.
STEP = 16
#: Fixed by the contract: what separates terms once A-Z are lower-cased.
NOT_TERM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


class Terms:
    """A block's terms, found by hash and compared byte by byte."""

    def __init__(self, terms: list[str]):
        column = pa.array(terms, pa.string())
        data, offsets = string_buffers(column)
        h = word_spans(data, offsets)[2]
        order = np.argsort(h)
        self.hash, self.id = h[order], order.astype(np.int32)
        if len(h) != len(terms) or (self.hash[1:] == self.hash[:-1]).any():
            raise ValueError("two terms of one block share a hash; choose another block size")
        self.data, self.start = data, offsets[:-1]
        self.length = np.diff(offsets)

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words are terms, and which terms they are."""
        if not len(self.hash):
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        word = np.flatnonzero(self.hash[at] == h)
        term = self.id[at[word]]
        same = (end - start)[word] == self.length[term]
        word, term = word[same], term[same]
        if not len(word):
            return word, term
        n = self.length[term]
        first = np.cumsum(n) - n
        step = np.arange(int(n.sum()))
        differ = FOLD[data[step + np.repeat(start[word] - first, n)]] != self.data[step + np.repeat(self.start[term] - first, n)]
        same = ~np.logical_or.reduceat(differ, first)
        return word[same], term[same]


def postings(docs: DataFrame, terms: Terms) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n (terms with repeats), terms (places in the block), tfs: one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in pieces(batch.column(1)):
                data, offsets = string_buffers(batch.column(1).slice(first, last - first))
                start, end, h, words = word_spans(data, offsets)
                word, term = terms.find(data, start, end, h)
                doc = np.searchsorted(words, word, "right") - 1
                both, tf = np.unique(doc << 32 | term, return_counts=True)
                cut = pa.array(np.searchsorted(both, np.arange(last - first + 1) << 32), pa.int32())
                lists = [pa.ListArray.from_arrays(cut, pa.array(v, pa.int32())) for v in (both & 0xFFFFFFFF, tf)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(np.diff(words), pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


class Shard:
    """Impact lists of a number of documents, and each document's postings with their places in the lists."""

    def __init__(self, n: np.ndarray, cut: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray, documents: int, length: int):
        m = 100 - 90 + (90 * n * documents) // length
        self.cut, self.term = cut, term
        doc = np.repeat(np.arange(len(n)), np.diff(cut))
        self.impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        order = np.lexsort((-self.impact, term))
        self.list_doc, self.list_impact = doc[order], self.impact[order]
        self.list_cut = np.searchsorted(term[order], np.arange(len(weight) + 1))
        self.place = np.empty(len(term), np.int64)
        self.place[order] = np.arange(len(term))

    def best(self, terms: np.ndarray, of: np.ndarray, k: int, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The documents of this shard that may be among the k best for the item, with scores.

        ``of`` is scratch that holds -1 for each term of the block; ``kept`` are the k best scores so far.
        """
        lists = terms[self.list_cut[terms + 1] > self.list_cut[terms]]
        low, high = self.list_cut[lists], self.list_cut[lists + 1]
        if not len(lists):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        of[lists] = np.arange(len(lists))
        base = np.cumsum(high - low) - (high - low)
        seen = np.zeros(int((high - low).sum()) + 1, bool)
        position = np.zeros(len(lists), np.int64)
        known = np.zeros(len(self.cut) - 1, bool)
        docs, scores, top = [], [], kept
        read, step = 0, STEP
        while True:
            new = np.concatenate([self.list_doc[a + read : min(a + read + step, b)] for a, b in zip(low, high)])
            new = np.unique(new[~known[new]])
            if len(new):
                known[new] = True
                n = self.cut[new + 1] - self.cut[new]
                first = np.cumsum(n) - n
                at = np.arange(int(n.sum())) + np.repeat(self.cut[new] - first, n)
                mine = of[self.term[at]]
                impact = np.where(mine >= 0, self.impact[at], 0)
                score = np.add.reduceat(impact, first)
                hit = mine >= 0
                seen[base[mine[hit]] + self.place[at[hit]] - low[mine[hit]]] = True
                docs.append(new)
                scores.append(score)
                top = np.sort(np.concatenate([top, score]))[::-1][:k]
            read += step
            step *= 2
            bound = 0
            for i, (a, b) in enumerate(zip(low, high)):
                rest = seen[base[i] + position[i] : base[i] + b - a]
                gap = int(rest.argmin()) if len(rest) else 0
                position[i] += gap if len(rest) and not rest[gap] else len(rest)
                if position[i] < b - a:
                    bound += self.list_impact[a + position[i] - 1] if position[i] else self.list_impact[a]
            if bound == 0 or (len(top) >= k and bound < top[k - 1]):
                break
        of[lists] = -1
        return np.concatenate(docs), np.concatenate(scores)


def candidates(found: DataFrame, items: dict[int, np.ndarray], weight: np.ndarray, documents: int, length: int, k: int, most: int = SHARD) -> DataFrame:
    """postings -> q, doc_id, score: the k best of each task's documents for each item, and none of score 0."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False))
            first = 0
            while first < batch.num_rows:
                last = int(np.searchsorted(size, (size[first - 1] if first else 0) + most, "right"))
                yield batch.slice(first, max(last, first + 1) - first)
                first = max(last, first + 1)

    def merged(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, size = [], 0
        for part in parts:
            n = len(part.column(2).flatten())
            if held and size + n > most:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
            held.append(part)
            size += n
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = np.zeros(0, np.int64)
        best = {q: (nothing, np.zeros(0, bool), nothing) for q in items}
        of = np.full(len(weight), -1)
        for table in merged(shards(batches)):
            ids, n, terms, tfs = (c.chunk(0) for c in table.columns)
            cut = np.concatenate([[0], np.cumsum(pc.list_value_length(terms).to_numpy(zero_copy_only=False))])
            flat = [c.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (terms, tfs)]
            shard = Shard(n.to_numpy(zero_copy_only=False), cut, *flat, weight, documents, length)
            null, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
            for q, mine in items.items():
                docs, score = shard.best(mine, of, k, best[q][0])
                s, a, b = (np.concatenate(x) for x in zip(best[q], (score, null[docs], ids[docs])))
                order = np.lexsort((b, a, -s))[:k]
                order = order[s[order] > 0]
                best[q] = s[order], a[order], b[order]
        for q, (s, null, ids) in best.items():
            if len(s):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), q), pa.int64()), pa.array(ids, pa.int64(), mask=null), pa.array(s, pa.int64())], names=["q", "doc_id", "score"])

    return found.mapInArrow(run, "q long, doc_id long, score long")


def ranked(rows: DataFrame, k: int) -> DataFrame:
    """The k best rows of each q with their rank; first within 64 parts of each, then over what they left."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    part = Window.partitionBy("q", "part").orderBy(*order)
    few = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(64))).withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= k)
    return few.drop("part").withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = TOP, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """docs (doc_id, text), items (item_id, text) -> item_id, rank, doc_id, score."""
    words = F.array_distinct(F.array_remove(F.split(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), NOT_TERM), ""))
    asked = written(items.select("item_id", words.alias("terms")).select(F.monotonically_increasing_id().alias("q"), "*"), "items")
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = -(-total // block)
    found = []
    for i in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i).where(F.size("terms") > 0).select("q", "terms").collect()
        names = sorted({t for r in rows for t in r["terms"]})
        place = {t: i for i, t in enumerate(names)}
        post = written(postings(docs, Terms(names)), "postings")
        documents, length = post.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        df = np.zeros(len(names))
        for r in post.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect():
            df[r["t"]] = r["df"]
        weight = np.floor(1000 * np.log((2 * (documents or 0) + 2) / (2 * df + 1))).astype(np.int64)
        weight[df == 0] = 0
        mine = {r["q"]: np.array([place[t] for t in r["terms"]], np.int64) for r in rows}
        if length:
            found.append(written(candidates(post, mine, weight, documents, length, k, shard), "candidates"))
    if not found:
        return asked.where("false").select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    best = ranked(reduce(DataFrame.union, found), k)
    return asked.select("q", "item_id").join(best, "q").select("item_id", "rank", "doc_id", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


OP11_SQL = r"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark
), corpus AS (SELECT count(*) AS nd, CAST(sum(len(w)) AS BIGINT) AS total FROM dw WHERE len(w) > 0),
post AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM dw) GROUP BY r, t),
weight AS (
  SELECT t, CAST(floor(1000 * ln((2 * any_value(nd) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM post, corpus GROUP BY t
), m AS (SELECT r, doc_id, 100 - 90 + ((90 * len(w) * nd) // total) AS m FROM dw, corpus WHERE len(w) > 0),
asked AS (SELECT DISTINCT q, item_id, t FROM (SELECT q, item_id, unnest(w) AS t FROM iw)),
score AS (
  SELECT q, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM asked JOIN post USING (t) JOIN weight USING (t) JOIN m USING (r) GROUP BY q, item_id, r, doc_id
), place AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
  FROM score WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM place WHERE rank <= 10
"""
