"""Token-ID output: one wavelet matrix per shard.

Texts are range-partitioned and sorted by document id, encoded, cut into shards of about
``SHARD_TOKENS`` ids at document ends (a longer document is a shard of its own) and written as wavelet matrix images. Spark's
own writer stores the images, one row each, under the shared folder, so a task that is lost or
run twice leaves nothing behind and any store that Spark can write to will do.

Encoding cuts texts where the tokenizer itself always cuts: before white space, after white space
that is no space, before the last of a run, and where letters, digits and marks meet (not behind an
apostrophe, nor beside a character above U+FFFF). What a character is says the tokenizer's own engine
of expressions. A worker encodes a distinct piece once and remembers it from task to task as long as
pieces are seen again; texts keep all their ids.

Defined results: null text is empty and has the end id only; null ids sort first; repeated rows
stay, ordered by id, then text; an empty table has no shards. Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewarden.llm.textvec import give_back, pieces, string_buffers
from casewarden.llm.wavelet import NULL_ID, WaveletMatrix
from casewarden.storage import written

END_ID = 2
SHARD_TOKENS = 1 << 20
#: Distinct pieces a worker remembers (about 150 bytes each) before it drops those not seen again.
MEMORY_PIECES = 400_000
#: Bytes of text that are split and looked up together.
BATCH_BYTES = 1 << 22
#: Classes of characters; what is unknown is never cut from its neighbours but for white space.
UNKNOWN, LETTER, DIGIT, MARK, APOSTROPHE, SPACE, WHITE = range(7)
CUT, RUN = 1, 2


def _rules() -> np.ndarray:
    """For class * 8 + class of the next character: is there a cut between, or do both lie in one run of white space."""
    rules = np.zeros((8, 8), np.uint8)
    rules[:SPACE, SPACE:] = CUT
    rules[WHITE, :SPACE] = CUT
    known = [LETTER, DIGIT, MARK]
    rules[np.ix_(known, known)] = CUT
    rules[known, known] = 0
    rules[[LETTER, DIGIT], APOSTROPHE] = CUT
    rules[SPACE:, SPACE:] = RUN
    return rules.ravel()


def _byte_chars() -> np.ndarray:
    """The character that stands for each byte in the vocabulary; 0xFF, which no text has, is a space."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = np.zeros(256, "<u2")
    chars[own] = own
    chars[chars == 0] = 256 + np.arange(256 - len(own))
    chars[0xFF] = ord(" ")
    return chars


_RULES, _BYTE_CHARS = _rules(), _byte_chars()


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceEncoder:
    """Encodes batches of texts; equal to encoding each whole text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        how = parts["pre_tokenizer"] or {}
        if how.get("type") != "ByteLevel" or how.get("add_prefix_space") or not how.get("use_regex", True) or parts["normalizer"] or parts["post_processor"]:
            raise ValueError(f"{path}: only byte-level splitting by the usual expression is known")
        self.added = [x["content"].encode() for x in parts["added_tokens"]]
        # Pieces that the tokenizer does not split go to its model at once, without the expression.
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = parts["model"]["vocab"]
        if not all(chr(c) in vocabulary for c in _BYTE_CHARS[:0xFF]):
            raise ValueError(f"{path}: a byte has no id")
        self.id_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.id_bytes[list(vocabulary.values())] = [len(x) for x in vocabulary]
        chars = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x10000))))
        point = np.array([*range(0xD800), *range(0xE000, 0x10000)])
        self.classes = np.full(1 << 16, MARK, np.uint8)
        for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", DIGIT), (r"\s+", WHITE)):
            for _, (first, last) in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(chars):
                self.classes[point[first:last]] = kind
        self.classes[ord("'")], self.classes[ord(" ")] = APOSTROPHE, SPACE
        self.byte_classes = np.where(np.arange(256) < 128, self.classes[:256], UNKNOWN).astype(np.uint8)
        self.known: dict[bytes, int] = {}
        self.pool, self.ends, self.seen = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _forget(self) -> None:
        """Keep the pieces that several batches had, at most half of the memory."""
        keep = np.flatnonzero(self.seen > 1)
        keep = np.sort(keep[np.argsort(-self.seen[keep].astype(np.int64), kind="stable")[: MEMORY_PIECES // 2]])
        words = list(self.known)
        self.known = {words[i]: k for k, i in enumerate(keep.tolist())}
        each = pa.LargeListArray.from_arrays(pa.array(self.ends), pa.array(self.pool)).take(pa.array(keep))
        self.pool, self.ends, self.seen = each.flatten().to_numpy(), np.asarray(each.offsets).astype(np.int64), self.seen[keep] // 2

    def _learn(self, plain: list[bytes], other: list[bytes]) -> None:
        """Encode distinct pieces that are not known yet; their ids join the pool. Plain ones are never split."""
        ids, sizes = [self.pool], []
        groups = [plain[at : at + 200] for at in range(0, len(plain), 200)]
        lines = [_BYTE_CHARS[np.frombuffer(b"\xff".join(g), np.uint8)].tobytes().decode("utf-16-le") for g in groups]
        if plain:
            coded = self.words.encode_batch_fast(lines, add_special_tokens=False)
            own = np.concatenate([np.array(line.ids, np.uint32) for line in coded])
            # Ids stand for bytes: those of a piece end where its bytes do.
            ends = np.searchsorted(np.cumsum(self.id_bytes[own]), np.cumsum(np.fromiter(map(len, plain), np.int64, len(plain)))) + 1
            ids.append(own)
            sizes.append(np.diff(ends, prepend=0))
        if other:
            each = [e.ids for e in self.tokenizer.encode_batch_fast([x.decode() for x in other], add_special_tokens=False)]
            ids.append(np.fromiter(chain.from_iterable(each), np.uint32))
            sizes.append(np.fromiter(map(len, each), np.int64, len(each)))
        first = len(self.ends) - 1
        self.known.update(zip(chain(plain, other), range(first, first + len(plain) + len(other))))
        self.pool = np.concatenate(ids)
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate(sizes))])
        self.seen = np.concatenate([self.seen, np.zeros(len(plain) + len(other), np.uint32)])

    def _places(self, keys: list[bytes], whole: np.ndarray) -> np.ndarray:
        """The numbers of distinct pieces, which are learned if need be; ``whole`` ones by the whole tokenizer."""
        if len(self.known) > MEMORY_PIECES:
            self._forget()
        at = np.fromiter(map(self.known.get, keys, repeat(-1)), np.int64, len(keys))
        new = at < 0
        plain, other = np.flatnonzero(new & ~whole), np.flatnonzero(new & whole)
        if len(plain) or len(other):
            first = len(self.ends) - 1
            self._learn([keys[i] for i in plain.tolist()], [keys[i] for i in other.tolist()])
            at[plain] = first + np.arange(len(plain))
            at[other] = first + len(plain) + np.arange(len(other))
        return at

    def _classes(self, data: np.ndarray) -> np.ndarray:
        """The class of each byte's character."""
        kinds = self.byte_classes[data]
        lead = np.flatnonzero(data >= 0xC2)
        size = data[lead]
        two, three = lead[size < 0xE0], lead[(size >= 0xE0) & (size < 0xF0)]
        low = [(data[three + i] & 0x3F).astype(np.int32) for i in (1, 2)]
        kinds[two] = kinds[two + 1] = self.classes[(data[two] & 0x1F).astype(np.int32) << 6 | data[two + 1] & 0x3F]
        kinds[three] = kinds[three + 1] = kinds[three + 2] = self.classes[(data[three] & 0xF).astype(np.int32) << 12 | low[0] << 6 | low[1]]
        for token in self.added:  # it is found before any split, and so ends the white space before it
            raw = data.tobytes()
            at = raw.find(token)
            while at >= 0:
                first = at
                while first and kinds[first - 1] >= SPACE:
                    first -= 1
                kinds[first : at + len(token)] = UNKNOWN
                at = raw.find(token, at + 1)
        return kinds

    @staticmethod
    def _pieces(data: np.ndarray, kinds: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Where pieces begin; ``edges`` are the n + 1 offsets of the texts."""
        n = len(data)
        cut = np.zeros(n + 1, bool)
        rule = _RULES[kinds[:-1] << 3 | kinds[1:]]
        cut[1:n] = rule == CUT
        # The last character of a run of white space before others in the same text begins a piece.
        starts = np.zeros(n + 1, bool)
        starts[edges] = True
        last = np.flatnonzero(rule == RUN) + 1
        last = last[~starts[last + 1]]
        last = last[kinds[last + 1] < SPACE]
        for _ in range(2):
            last = last - ((data[last] & 0xC0) == 0x80)
        cut[last] = True
        return np.flatnonzero((cut | starts)[:n])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the n + 1 offsets of the texts' ids."""
        data, edges = string_buffers(texts)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(edges), np.int64)
        kinds = self._classes(data)
        first = self._pieces(data, kinds, edges)
        offsets = np.append(first, len(data))
        cut = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        coded = cut.dictionary_encode()
        code = np.asarray(coded.indices)
        whole = np.zeros(len(coded.dictionary), bool)
        odd = np.flatnonzero((kinds == UNKNOWN) | (kinds == APOSTROPHE))
        whole[code[np.searchsorted(first, odd, "right") - 1]] = True
        at = self._places(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), whole)
        self.seen[at] += 1
        each = pa.LargeListArray.from_arrays(pa.array(self.ends), pa.array(self.pool)).take(pa.array(at)).take(coded.indices)
        ids, ends = each.flatten().to_numpy(), np.asarray(each.offsets)
        return ids, (ends - ends[0])[np.searchsorted(first, edges)]


_ENCODERS: dict[str, PieceEncoder] = {}


def _encoder(path: str) -> PieceEncoder:
    """One for each worker process; what it remembers serves its next tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def write_shards(docs: DataFrame, path: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """docs (doc_id, text) -> the written shard table: part, seq, n_docs, n_tokens, image.

    Shards are in ascending order of documents by part, then seq.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = _encoder(path), TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, list[int], list[int]]] = []
        n_held = 0

        def image() -> pa.RecordBatch:
            ids = np.concatenate([x[0] for x in held])
            doc_ids, sizes = [i for x in held for i in x[1]], [n for x in held for n in x[2]]
            matrix = WaveletMatrix.build(ids, np.array(doc_ids, np.int64), np.concatenate([[0], np.cumsum(sizes)]))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(doc_ids)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([matrix.to_bytes()], pa.binary())],
                names=["part", "seq", "n_docs", "n_tokens", "image"],
            )

        for batch in batches:
            for first, last in pieces(batch.column(1), BATCH_BYTES):
                ids, ends = encoder.encode(batch.column(1).slice(first, last - first))
                ids = np.insert(ids, ends[1:], np.uint32(end_id))
                sizes = np.diff(ends) + 1
                doc_ids = batch.column(0).slice(first, last - first).fill_null(NULL_ID).to_pylist()
                at = 0
                edges = np.concatenate([[0], np.cumsum(sizes)])
                while at < len(sizes):
                    to = int(np.searchsorted(edges, edges[at] + shard_tokens - n_held, "right")) - 1
                    if to <= at and n_held == 0:
                        to = at + 1
                    to = max(to, at)
                    if to > at:
                        held.append((ids[edges[at] : edges[to]], doc_ids[at:to], sizes[at:to].tolist()))
                        n_held += int(edges[to] - edges[at])
                    if to < len(sizes) or n_held >= shard_tokens:
                        yield image()
                        held, n_held, seq = [], 0, seq + 1
                    at = to
        if held:
            yield image()
        held.clear()
        give_back()

    d = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(F.col("doc_id").asc_nulls_first())
    d = d.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return written(d.mapInArrow(run, "part int, seq int, n_docs long, n_tokens long, image binary"), "token_shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """Shard table -> per document, from the images: part, seq, doc_id, local_start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                m = WaveletMatrix.from_bytes(batch.column(2)[row].as_py())
                ids, ends, n = m.decode().astype("<u4"), m.offsets.astype(np.int64), len(m.doc_ids)
                crc = [zlib.crc32(ids[ends[i] : ends[i + 1]]) for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column(0)[row].as_py()] * n, pa.int32()), pa.array([batch.column(1)[row].as_py()] * n, pa.int32()),
                        pa.array(m.doc_ids, pa.int64(), mask=m.doc_ids == NULL_ID), pa.array(ends[:-1]), pa.array(np.diff(ends)), pa.array(crc, pa.int64()),
                    ],
                    names=["part", "seq", "doc_id", "local_start", "n_tokens", "ids_crc32"],
                )
        give_back()

    schema = "part int, seq int, doc_id long, local_start long, n_tokens long, ids_crc32 long"
    return shards.select("part", "seq", "image").mapInArrow(run, schema)


def shard_starts(shards: DataFrame) -> DataFrame:
    """part, seq, shard_start: ids in all shards before. Parts are summed before they are lined up."""
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    s = shards.select("part", "seq", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("in_part"))
    return s.join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("in_part")).alias("shard_start"))


def token_table(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write docs as shards, read them back: doc_id, start, n_tokens, ids_crc32 and the shard."""
    shards = write_shards(docs, path or tokenizer_path())
    rows = read_shards(shards).join(shard_starts(shards), ["part", "seq"])
    return rows.select("doc_id", (F.col("shard_start") + F.col("local_start")).cast("long").alias("start"), "n_tokens", "ids_crc32", "part", "seq")


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
