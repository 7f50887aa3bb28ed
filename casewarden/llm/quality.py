"""Quality classifier by co-training of two views.

The text view sees which words a document uses (hashed, with the square root of their share).
The metadata view sees language, source and length, and the page's make-up: shares of symbols,
digits, capitals, white space and line ends, word length, repetition. Two targets are learned, low
quality and toxic. Each view is fitted on labelled rows. Then, in every round, one pass over all
documents lets each view name those it is confident of, and adds up what these pseudo-labels ask of
the other view: per class, the mean gradient of its loss and a bound of its curvature. Each view is
fitted again on the labelled rows and that quadratic bound, so all documents take part in every
exchange and only sums (two numbers a feature) leave the tasks. Both views are then calibrated and
combined on labelled rows that no fit has seen.

Labelled rows are a bounded sample, ``LABELLED`` by a hash of the id, shared out evenly over the
combinations of labels, a rare one taken whole; calibration weighs each row with the rows of the table
it stands for. Documents outside it, labelled or not, are pseudo-labelled. All documents are scored.

Defined results: null text is empty, null language or source is its own value; very long texts are read
whole; documents are scored row by row, so repeated rows get equal scores; of rows that share a labelled
id one is learned from, by the hash of its text; a target with fewer than ``LEAST`` labelled documents of
either class is never predicted (probability 0), with a warning; without labels nothing is; an empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import copy
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewarden.llm.textvec import give_back, pieces, string_buffers, word_hashes

LABELLED = 6000
#: Labelled documents of each class that a target needs.
LEAST = 8
ROUNDS, CONFIDENT = 3, 0.97
#: Weight of all pseudo-labels together, relative to all labels.
PSEUDO = 0.3
WORD_BITS, VOCABULARY = 20, 1500
META_HASHED = 32
LIMIT = 0.5
#: Texts that are scored together.
PIECE_ROWS = 512
_SHAPES = 10


def _shape_tables() -> np.ndarray:
    b = np.arange(256)
    is_alpha = ((b >= 65) & (b <= 90)) | ((b >= 97) & (b <= 122)) | (b >= 128)
    return np.array(
        [(b < 128) & ~is_alpha & ~((b >= 48) & (b <= 57)) & (b > 32), (b >= 48) & (b <= 57), (b >= 65) & (b <= 90), b == 32, b == 10, np.isin(b, [33, 35, 36, 37, 38, 42, 64, 94, 126])],
        dtype=np.int64,
    )


SHAPES = _shape_tables()


def features(batch: pa.RecordBatch) -> Iterator[tuple[int, int, tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]]:
    """For pieces of a batch (doc_id, text, lang, source): rows, words as (row, bucket, value), metadata."""
    for first, last in pieces(batch.column(1), rows=PIECE_ROWS):
        n = last - first
        data, offsets = string_buffers(batch.column(1).slice(first, n))
        h, words = word_hashes(data, offsets)
        n_words = np.diff(words)
        row = np.repeat(np.arange(n), n_words)
        key = row.astype(np.int64) << WORD_BITS | (h >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        key, count = np.unique(key, return_counts=True)
        row = key >> WORD_BITS
        words_view = (row, key & ((1 << WORD_BITS) - 1), np.sqrt(count / np.maximum(n_words[row], 1)))
        size = np.maximum(np.diff(offsets), 1)
        meta = np.zeros((n, 2 * META_HASHED + _SHAPES))
        for j, column in enumerate((batch.column(2), batch.column(3))):
            for i, value in enumerate(column.slice(first, n).to_pylist()):
                meta[i, j * META_HASHED + xxhash.xxh32_intdigest(repr(value)) % META_HASHED] = 1.0
        at = 2 * META_HASHED
        for j, table in enumerate(SHAPES):
            total = np.concatenate([[0], np.cumsum(table[data])])
            meta[:, at + j] = np.sqrt((total[offsets[1:]] - total[offsets[:-1]]) / size)
        at += len(SHAPES)
        meta[:, at] = np.log1p(np.diff(offsets)) / 10
        meta[:, at + 1] = np.log1p(size / np.maximum(n_words, 1)) / 3
        meta[:, at + 2] = np.bincount(row, minlength=n) / np.maximum(n_words, 1)
        meta[:, at + 3] = n_words == 0
        yield first, last, words_view, meta


class Sparse:
    """Rows of few words each, for ``@`` with a vector; as exact as a dense matrix in single precision."""

    def __init__(self, n: int, width: int, row: np.ndarray, column: np.ndarray, value: np.ndarray):
        self.n, self.width, self.row, self.column, self.value = n, width, row, column, value.astype(np.float32)

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], self.n)

    def sums(self, weight: np.ndarray) -> np.ndarray:
        """Weighted sum of the rows."""
        return np.bincount(self.column, self.value * weight[self.row], self.width)

    def lengths(self) -> np.ndarray:
        return np.bincount(self.row, self.value, self.n)


class Asked:
    """A quadratic bound of the pseudo-labels' loss around a fitted model, for features less the model's means.

    Its curvature is a diagonal; the last place is the bias.
    """

    def __init__(self, model: Logistic, sums: dict[int, tuple[int, np.ndarray, np.ndarray]]):
        """sums: class -> documents, summed gradient, summed curvature, of features as they are."""
        self.at = np.append(model.w, model.b + float(model.w @ model.mean))
        slope, curve = (PSEUDO * np.mean(x, axis=0) for x in zip(*((g / n, c / n) for n, g, c in sums.values() if n)))
        slope[:-1] -= model.mean * slope[-1]
        curve[:-1] += np.abs(model.mean) * curve[-1]
        self.slope, self.curve = slope, curve

    def gradient(self, w: np.ndarray) -> np.ndarray:
        return self.slope + self.curve * (w - self.at)


class Logistic:
    """Ridge logistic regression on standardised dense columns, held once and in single precision."""

    def __init__(self, ridge: float):
        self.ridge = ridge

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, asked: Asked | None = None) -> Logistic:
        """``asked``: what pseudo-labels ask of the weights, added to the loss."""
        f = np.float32
        self.mean = (weight.astype(f) @ x).astype(float) / weight.sum()
        z = np.subtract(x, self.mean.astype(f), dtype=f)
        spread = np.einsum("ij,ij->j", z, z).astype(float) / len(z) - z.mean(axis=0, dtype=float) ** 2
        self.scale = np.sqrt(np.maximum(spread, 0)) + 1e-3
        z /= self.scale.astype(f)
        w, b = np.zeros(x.shape[1]), 0.0
        move_w, move_b, total = np.zeros_like(w), 0.0, weight.sum()
        step = 4.0 / (1.0 + float(np.einsum("ij,ij->i", z, z).mean(dtype=float)) ** 0.5)
        rate = np.full(len(w) + 1, 0.1 * step)
        if asked:  # shorter steps where the bound is steep
            rate /= 1.0 + 10 * rate * asked.curve / np.append(self.scale, 1.0) ** 2
        for _ in range(250):
            error = weight * (_sigmoid(z @ w.astype(f) + b) - y) / total
            pull_w, pull_b = error.astype(f) @ z + self.ridge * w, error.sum()
            if asked:
                more = asked.gradient(np.append(w / self.scale, b))
                pull_w, pull_b = pull_w + more[:-1] / self.scale, pull_b + more[-1]
            move_w = 0.9 * move_w - rate[:-1] * pull_w
            move_b = 0.9 * move_b - rate[-1] * pull_b
            w, b = w + move_w, b + move_b
        self.w, self.b = w / self.scale, b - float((w / self.scale) @ self.mean)
        return self

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w + self.b


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _platt(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift that turn scores into probabilities, by Newton steps; weights have a mean of one."""
    spread = score.std() + 1e-9
    x, a, b = score / spread, 1.0, 0.0
    ridge = 1e-2 * min((weight * y).mean(), (weight * (1 - y)).mean())  # a rare class is not shrunk away
    for _ in range(30):
        p = _sigmoid(a * x + b)
        v, e = (p * (1 - p) + 1e-6) * weight, (p - y) * weight
        g = np.array([(e * x).mean() + ridge * a, e.mean()])
        h = np.array([[(v * x * x).mean() + ridge, (v * x).mean()], [(v * x).mean(), v.mean() + 1e-6]])
        move = np.linalg.solve(h, g)
        a, b = a - float(np.clip(move[0], -2, 2)), b - float(np.clip(move[1], -2, 2))
    return a / spread, b


class CoTrained:
    """One target: text and metadata views, calibrated and combined."""

    def __init__(self, words: np.ndarray, meta: np.ndarray, y: np.ndarray, stands_for: np.ndarray | None = None):
        """y: 0, 1, or -1 for rows without this label; stands_for: rows of the table for each row."""
        self.views, self.y = (words, meta), y
        classes = [np.flatnonzero(y == c) for c in (0, 1)]
        self.known = min(map(len, classes)) >= LEAST
        if not self.known:
            return
        worth = np.ones(len(y)) if stands_for is None else stands_for
        # Fits weigh the classes evenly, rows within a class as they are in the table.
        self.inside = np.ones(len(y))
        for rows in classes:
            self.inside[rows] = worth[rows] / worth[rows].mean()
        self.held = np.sort(np.concatenate([rows[::4] for rows in classes]))
        self.weight_held = worth[self.held] / worth[self.held].mean()
        self.use = np.setdiff1d(np.concatenate(classes), self.held)
        self.models: list[tuple[Logistic, float, float]] = []

    def fit(self, asked: dict[int, Asked] | None = None) -> CoTrained:
        """Fit both views, with what the other view's pseudo-labels ask of each, and calibrate them."""
        target, held = self.y[self.use].astype(float), self.y[self.held].astype(float)
        positive = target.mean()
        weight = np.where(target > 0, 0.5 / positive, 0.5 / (1 - positive)) * self.inside[self.use]
        models = []
        for view, x in enumerate(self.views):
            model = Logistic((3e-3, 1e-3)[view]).fit(x[self.use], target, weight, (asked or {}).get(view))
            models.append((model, *_platt(model(x[self.held]), held, self.weight_held)))
        self.models = models
        return self

    def combine(self) -> CoTrained:
        """Fit the combination of both views, and let the sample go."""
        y = self.y[self.held]
        both = np.column_stack(self._logits(*(x[self.held] for x in self.views)))
        even = self.inside[self.held] * np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
        self.top = Logistic(1e-3).fit(both, y.astype(float), even)
        a, b = _platt(self.top(both), y.astype(float), self.weight_held)
        self.top.w, self.top.b = self.top.w * a, self.top.b * a + b
        del self.views, self.y, self.inside, self.held, self.weight_held, self.use
        return self

    def pseudo(self, words: Sparse, meta: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
        """What confident labels ask of the other view: view, class, documents, gradient, curvature."""
        raw = [m(x) for (m, _, _), x in zip(self.models, (words, meta), strict=True)]
        sure = [_sigmoid(a * r + b) for (_, a, b), r in zip(self.models, raw, strict=True)]
        for view, x in enumerate((words, meta)):
            p = _sigmoid(raw[view])
            for label, chosen in ((0, sure[1 - view] <= 1 - CONFIDENT), (1, sure[1 - view] >= CONFIDENT)):
                slope, bend = np.where(chosen, p - label, 0.0), np.where(chosen, p * (1 - p), 0.0)
                # A diagonal that bounds the curvature: each feature's share of the row's whole length.
                length = (x.lengths() if view == 0 else np.abs(x).sum(axis=1)) + np.abs(self.models[view][0].mean).sum() + 1.0
                gradient = x.sums(slope) if view == 0 else slope @ x
                curvature = x.sums(bend * length) if view == 0 else (bend * length) @ np.abs(x)
                yield view, label, int(chosen.sum()), np.append(gradient, slope.sum()), np.append(curvature, (bend * length).sum())

    def _logits(self, words: np.ndarray, meta: np.ndarray) -> list[np.ndarray]:
        return [np.clip(a * m(x) + b, -12, 12) for (m, a, b), x in zip(self.models, (words, meta), strict=True)]

    def probability(self, words: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Columns: text view, metadata view, combined."""
        logits = self._logits(words, meta)
        return np.column_stack([*map(_sigmoid, logits), _sigmoid(self.top(np.column_stack(logits)))])


class Model:
    targets = ("low", "toxic")

    def __init__(self, vocabulary: np.ndarray, parts: dict[str, CoTrained | None]):
        self.parts = parts
        self.place = np.full(1 << WORD_BITS, -1, np.int32)
        self.place[vocabulary] = np.arange(len(vocabulary))
        self.size = len(vocabulary)

    def light(self) -> Model:
        """The same model without the sample it is fitted on, to be sent to tasks."""
        parts: dict[str, CoTrained | None] = {}
        for target, part in self.parts.items():
            parts[target] = copy.copy(part)
            if part:
                vars(parts[target]).clear()
                parts[target].models = part.models
        out = copy.copy(self)
        out.parts = parts
        return out

    def dense(self, n: int, view: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        row, bucket, value = view
        column = self.place[bucket]
        keep = column >= 0
        x = np.zeros((n, self.size), np.float32)
        x[row[keep], column[keep]] = value[keep]
        return x

    def sparse(self, n: int, view: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Sparse:
        row, bucket, value = view
        column = self.place[bucket]
        keep = column >= 0
        return Sparse(n, self.size, row[keep], column[keep], value[keep])

    def score(self, n: int, view: tuple, meta: np.ndarray) -> dict[str, np.ndarray]:
        x = self.sparse(n, view)
        return {t: p.probability(x, meta) if (p := self.parts[t]) else np.zeros((n, 3)) for t in self.targets}


def _vocabulary(row: np.ndarray, bucket: np.ndarray, n: int, low: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Buckets that part the classes most, half for each target, by presence in documents."""
    chosen = []
    for y in (low, toxic):
        bad = y == 1
        good = y == 0
        if not bad.any() or not good.any():
            continue
        in_bad = np.bincount(bucket[bad[row]], minlength=1 << WORD_BITS)
        in_good = np.bincount(bucket[good[row]], minlength=1 << WORD_BITS)
        p, q = (in_bad + 0.5) / (bad.sum() + 1), (in_good + 0.5) / (good.sum() + 1)
        pooled = (in_bad + in_good + 1) / (bad.sum() + good.sum() + 2)
        z = np.abs(p - q) / np.sqrt(pooled * (1 - pooled) * (1 / bad.sum() + 1 / good.sum()))
        z[in_bad + in_good < 5] = 0
        chosen.append(np.argsort(-z, kind="stable")[: VOCABULARY // 2])
    return np.unique(np.concatenate(chosen)) if chosen else np.zeros(0, np.int64)


def _shares(sizes: list[int], total: int) -> list[int]:
    """Rows to take of classes of these sizes: all of the small, an even share of the others."""
    shares, left = [0] * len(sizes), total
    for at, i in enumerate(sorted(range(len(sizes)), key=sizes.__getitem__)):
        shares[i] = min(sizes[i], left // (len(sizes) - at))
        left -= shares[i]
    return shares


def _draw(known: DataFrame, total: int) -> tuple[DataFrame, dict[tuple, int]]:
    """At most total rows of known (id, low, toxic), by a hash of the id, and the sizes of its label combinations.

    Rows are taken by their hash as a fraction, divided by the part of their combination that is
    wanted; those of a combination that is wanted whole come first.
    """
    sizes = {(r["low"], r["toxic"]): r["n"] for r in known.groupBy("low", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn = F.shiftrightunsigned(F.xxhash64(F.lit(5), "id"), 11) / float(1 << 53)
    place = F.lit(-1.0)
    for (low, toxic), take in zip(sizes, _shares(list(sizes.values()), total), strict=True):
        part = take / sizes[low, toxic]
        if part < 1:
            same = F.col("low").eqNullSafe(F.lit(low)) & F.col("toxic").eqNullSafe(F.lit(toxic))
            place = F.when(same, drawn / max(part, 1e-12)).otherwise(place)
    return known.orderBy(place, "id").limit(total), sizes


def exchange(docs: DataFrame, model: Model, sample: list[int]) -> dict[str, dict[int, Asked]]:
    """One pass over all documents but the sample: what each target's views ask of each other."""
    known = np.array(sorted(sample), np.int64)
    views = {t: p.models for t, p in model.parts.items() if p}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, int, int], list] = {}
        for batch in batches:
            ids = batch.column(0)
            fresh = ids.is_null().to_numpy(zero_copy_only=False) | ~np.isin(ids.fill_null(0).to_numpy(zero_copy_only=False), known)
            batch = batch.filter(pa.array(fresh))
            for first, last, words, meta in features(batch):
                x = model.sparse(last - first, words)
                for t in views:
                    for view, label, n, g, c in model.parts[t].pseudo(x, meta):
                        old = total.setdefault((t, view, label), [0, 0.0, 0.0])
                        total[t, view, label] = [old[0] + n, old[1] + g, old[2] + c]
        for (t, view, label), (n, g, c) in total.items():
            lists = [pa.array([v.tolist()], pa.list_(pa.float64())) for v in (g, c)]
            yield pa.RecordBatch.from_arrays([pa.array([t]), pa.array([view], pa.int32()), pa.array([label], pa.int32()), pa.array([n], pa.int64()), *lists], names=["target", "view", "label", "n", "g", "c"])
        give_back()

    rows = docs.select(F.col("doc_id").cast("long"), "text", "lang", "source")
    rows = rows.mapInArrow(run, "target string, view int, label int, n long, g array<double>, c array<double>")
    cells = rows.select("target", "view", "label", "n", F.posexplode(F.arrays_zip("g", "c")).alias("i", "v"))
    cells = cells.groupBy("target", "view", "label", "i").agg(F.sum("n").alias("n"), F.sum("v.g").alias("g"), F.sum("v.c").alias("c"))
    sums: dict[tuple[str, int], dict[int, tuple]] = {}
    for r in cells.orderBy("target", "view", "label", "i").collect():  # four numbers a feature and target
        n, g, c = sums.setdefault((r["target"], r["view"]), {}).setdefault(r["label"], (r["n"], [], []))
        g.append(r["g"])
        c.append(r["c"])
    asked: dict[str, dict[int, Asked]] = {}
    for (t, view), by_label in sums.items():
        if any(n for n, _, _ in by_label.values()):
            arrays = {k: (n, np.array(g), np.array(c)) for k, (n, g, c) in by_label.items()}
            asked.setdefault(t, {})[view] = Asked(views[t][view][0], arrays)
    return asked


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> Model:
    """Fit on the bounded sample of labelled rows and on exchanges over all documents; of texts only the sample's features reach the driver."""
    known = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max(1 - F.col("quality")).alias("low"), F.max("toxic").alias("toxic"))
    known = known.where("id IS NOT NULL").select("id", F.col("low").cast("int"), F.col("toxic").cast("int"))
    chosen, in_table = _draw(known, labelled)
    rows = docs.select("doc_id", "text", "lang", "source").join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    rows = rows.groupBy("id", "low", "toxic").agg(F.min_by(F.struct("text", "lang", "source"), F.xxhash64(F.lit(7), "text", "lang", "source")).alias("d"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, (row, bucket, value), meta in features(batch):
                ends = np.searchsorted(row, np.arange(last - first + 1))
                b, v = bucket.astype(np.int32), value.astype(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(k).slice(first, last - first) for k in (0, 4, 5)),
                        pa.array([b[ends[i] : ends[i + 1]].tobytes() for i in range(last - first)], pa.binary()),
                        pa.array([v[ends[i] : ends[i + 1]].tobytes() for i in range(last - first)], pa.binary()),
                        pa.array([m.astype(np.float32).tobytes() for m in meta], pa.binary()),
                    ],
                    names=["doc_id", "low", "toxic", "bucket", "value", "meta"],
                )

    rows = rows.select(F.col("id").cast("long").alias("doc_id"), "d.text", "d.lang", "d.source", "low", "toxic")
    sample = rows.mapInArrow(run, "doc_id long, low int, toxic int, bucket binary, value binary, meta binary").toPandas()
    sample = sample.assign(draw=[xxhash.xxh64_intdigest(str(i)) for i in sample["doc_id"]]).sort_values(["draw", "doc_id"]).reset_index(drop=True)
    n, ids = len(sample), sample["doc_id"].tolist()
    low, toxic = (sample[t].fillna(-1).to_numpy().astype(np.int64) for t in ("low", "toxic"))
    if not n:
        return Model(np.zeros(0, np.int64), dict.fromkeys(Model.targets))
    sizes = [len(x) // 4 for x in sample["bucket"]]
    row = np.repeat(np.arange(n), sizes)
    bucket = np.frombuffer(b"".join(map(bytes, sample["bucket"])), np.int32)
    value = np.frombuffer(b"".join(map(bytes, sample["value"])), np.float32)
    meta = np.frombuffer(b"".join(map(bytes, sample["meta"])), np.float32).reshape(n, -1).astype(float)
    model = Model(_vocabulary(row, bucket, n, low, toxic), {})
    combination = (low + 1) * 3 + toxic + 1
    rows_of = {(-1 if a is None else a) * 3 + 3 + (-1 if b is None else b) + 1: size for (a, b), size in in_table.items()}
    stands_for = np.array([rows_of.get(c, 1) for c in range(9)], float)[combination] / np.bincount(combination, minlength=9)[combination]
    x = model.dense(n, (row, bucket, value))
    del sample, row, bucket, value  # the driver holds one matrix from here on
    for target, y in zip(Model.targets, (low, toxic), strict=True):
        part = CoTrained(x, meta, y, stands_for)
        if not part.known:
            warnings.warn(f"target {target}: fewer than {LEAST} labelled documents of a class, never predicted", stacklevel=2)
        model.parts[target] = part.fit() if part.known else None
    if any(model.parts.values()):
        for _ in range(rounds - 1):
            asked = exchange(docs, model.light(), ids)
            for target, part in model.parts.items():
                if part:
                    part.fit(asked.get(target))
    for part in model.parts.values():
        if part:
            part.combine()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text, lang, source) -> doc_id, p_low, p_toxic, each view's, score, kept; per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, words, meta in features(batch):
                p = model.score(last - first, words, meta)
                low, toxic = p["low"], p["toxic"]
                ok = np.maximum(low[:, 2], toxic[:, 2])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        *(pa.array(x[:, k]) for k in (2, 0, 1) for x in (low, toxic)),
                        pa.array((1 - low[:, 2]) * (1 - toxic[:, 2])), pa.array(ok < LIMIT), batch.column(4).slice(first, last - first),
                    ],
                    names=["doc_id", "p_low", "p_toxic", "text_low", "text_toxic", "meta_low", "meta_toxic", "score", "kept", "text_hash"],
                )
        give_back()

    schema = "doc_id long, p_low double, p_toxic double, text_low double, text_toxic double, meta_low double, meta_toxic double, score double, kept boolean, text_hash long"
    rows = docs.select(F.col("doc_id").cast("long"), "text", "lang", "source", F.xxhash64("text", "lang", "source").alias("text_hash"))
    return rows.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the documents that the classifier rejects; all columns."""
    bad = score(docs, train(docs, labels)).where("NOT kept")
    bad = bad.select(F.col("doc_id").alias("_bad_id"), F.col("text_hash").alias("_bad_hash")).distinct()
    same = docs["doc_id"].eqNullSafe(bad["_bad_id"]) & (F.xxhash64(docs["text"], docs["lang"], docs["source"]) == bad["_bad_hash"])
    return docs.join(bad, same, "left_anti")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return score(docs, train(docs, labels)).drop("text_hash")
