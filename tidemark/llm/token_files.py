"""Token ids of whole texts in binary shards, one wavelet matrix per shard file."""

from __future__ import annotations

import itertools
import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, map_arrow, small_batches, text_bytes
from .wavelet import WaveletMatrix

END_ID = 1
#: Ids in a shard, unless one document alone has more.
SHARD_IDS = 4_000_000
#: Words that a worker keeps encoded; beyond them it starts anew.
KEPT_WORDS = 1_000_000
#: Pieces of words that a worker keeps encoded; most serve one word only.
KEPT_PIECES = 150_000

#: The tokenizer's own rule for the pieces of a word, after lower-casing.
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Pieces asked for in one text.
_TOGETHER = 1000
#: The letters that the tokenizer's byte level writes for each byte.
_BYTE = [chr(b) for b in range(256)]
for _nth, _b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)):
    _BYTE[_b] = chr(256 + _nth)
_LETTERS = dict(enumerate(_BYTE))


def _plain(piece: str | tuple) -> bool:
    """Whether the tokenizer's normalizer and rule leave the piece as it is: Latin letters, lower-cased (words are checked for marks before)."""
    return isinstance(piece, str) and piece.isalpha() and max(piece) < "\u0250" and piece == piece.lower()


class Numbers(dict):
    """Keys numbered in the order of their first use; `new` holds those not yet learnt."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list = []

    def __missing__(self, key) -> int:
        at = self[key] = len(self)
        self.new.append(key)
        return at


class Ragged:
    """Rows of different lengths, one after another in one array that grows."""

    def __init__(self) -> None:
        self.flat, self.first, self.rows = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), 0

    def extend(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        used, rows = int(self.first[self.rows]), self.rows + len(sizes)
        if used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat[:used], np.zeros(used + len(flat), np.uint32)])
        if rows >= len(self.first):
            self.first = np.concatenate([self.first[: self.rows + 1], np.zeros(rows + 1, np.int64)])
        self.flat[used : used + len(flat)] = flat
        self.first[self.rows + 1 : rows + 1] = used + np.cumsum(sizes)
        self.rows = rows

    def take(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the rows one after another, their lengths)."""
        start = self.first[index]
        size = self.first[index + 1] - start
        upto = np.cumsum(size)
        total = int(upto[-1]) if len(upto) else 0
        return self.flat[np.repeat(start - upto + size, size) + np.arange(total)], size


class WordEncoder(Numbers):
    """Ids of whole texts by way of their words.

    The tokenizer drops white space and no rule of it spans any, so a text's
    ids are those of its words one after another, and a word's those of its
    pieces by the tokenizer's rule. Words and pieces are encoded once per
    worker; pieces repeat far more than words, and many go in one text, cut
    again where a token ends a piece.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new = []
        self.pieces, self.piece_ids, self.word_ids = Numbers(), Ragged(), Ragged()

    def _learn(self, end: int | None) -> None:
        if len(self.pieces) > KEPT_PIECES:
            self.pieces, self.piece_ids = Numbers(), Ragged()
        order: list[int] = []
        count: list[int] = []
        get = self.pieces.__getitem__
        for w in self.new:
            if w.isalpha() and w.islower():  # a-z alone: one piece
                order.append(get(w.decode()))
                count.append(1)
                continue
            word = (w if b"<|" in w else w.lower()).decode()
            # Marks that compose, a dotted capital I and special tokens can change a word across its pieces.
            plain = w.isascii() or ("\u0130" not in word and unicodedata.is_normalized("NFC", word))
            found = _PIECE.findall(word) if plain and "<|" not in word else [(word,)]
            order += map(get, found or [(word,)])
            count.append(max(1, len(found)))
        self._learn_pieces(end)
        ids, sizes = self.piece_ids.take(np.array(order, np.int64))
        count_of = np.array(count, np.int64)
        self.word_ids.extend(ids, np.add.reduceat(sizes, np.cumsum(count_of) - count_of))
        self.new = []

    def _learn_pieces(self, end: int | None) -> None:
        """Ids of new pieces: plain ones from the tokenizer's model alone, the others from the whole tokenizer."""
        new, model, found = self.pieces.new, self.tokenizer.model, Ragged()
        plain = [_plain(p) for p in new]
        got = [[t.id for t in model.tokenize(p if p.isascii() else p.encode().decode("latin-1").translate(_LETTERS))] for p in itertools.compress(new, plain)]
        found.extend(np.fromiter(itertools.chain.from_iterable(got), np.uint32), np.array([len(x) for x in got], np.int64))
        self._learn_together([p for p, alone in zip(new, plain) if not alone], end, found)
        order = np.argsort(~np.array(plain, bool), kind="stable")  # of the pieces in `found`
        self.piece_ids.extend(*found.take(np.argsort(order)))
        self.pieces.new = []

    def _learn_together(self, pieces: list, end: int | None, into: Ragged) -> None:
        for lo in range(0, len(pieces), _TOGETHER):
            new = pieces[lo : lo + _TOGETHER]
            some = [p for p in new if isinstance(p, str)]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.closes[ids]) + 1 if len(ids) else np.zeros(0, np.int64)
            if len(ends) == len(some) == len(new):  # the usual case
                into.extend(ids, np.diff(ends, prepend=0))
                continue
            got = dict(zip(some, np.split(ids, ends[:-1]))) if some and len(ends) == len(some) else {}
            alone = [p for p in new if p not in got]
            texts = [p if isinstance(p, str) else p[0] for p in alone]
            for p, t, x in zip(alone, texts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                got[p] = np.array([end] if t == "\n" else x.ids, np.uint32)
            rows = [got[p] for p in new]
            into.extend(np.concatenate(rows), np.array([len(r) for r in rows]))

    def encode(self, texts: list[bytes], end: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has), `end` after every text."""
        # A-Z count as a-z but in special tokens.
        return self.encode_words([t.split() if b"<|" in t else t.lower().split() for t in texts], end)[:2]

    def encode_words(self, texts: list[list[bytes]], end: int | None = END_ID) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """encode() of texts cut into words; and the number of each word, `end` included, in self."""
        if len(self) > KEPT_WORDS:
            self.forget()
        get, close = self.__getitem__, b"\n"  # no word holds a blank, so a line feed stands for the end
        at: list[int] = []
        count = []
        for words in texts:
            at += map(get, words)
            if end is not None:
                at.append(get(close))
            count.append(len(words) + (end is not None))
        if self.new:
            self._learn(end)
        return self._ids(np.array(at, dtype=np.int64), count)

    def encode_numbered(self, words: list[bytes], numbers: np.ndarray, count: np.ndarray, end: int = END_ID) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """encode_words() of texts given as numbers in a list of distinct words, where a line feed stands for the end."""
        if len(self) > KEPT_WORDS:
            self.forget()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            self._learn(end)
        return self._ids(at.take(numbers), count)

    def _ids(self, index: np.ndarray, count: list[int] | np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, size = self.word_ids.take(index)
        upto = np.concatenate([[0], np.cumsum(size)])
        cuts = upto[np.concatenate([[0], np.cumsum(count, dtype=np.int64)])]
        return ids, np.diff(cuts), index


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write_token_files(docs: DataFrame, vocabulary: str, folder: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> None:
    """Write ids of all texts in ascending doc_id order, nulls first, as shards under `folder`.

    A shard is a row (part, nth, doc_ids, counts, n, matrix); `matrix` is its
    wavelet matrix. Spark's writer commits the files, so a lost task is simply
    run again. Texts are range-partitioned by doc_id and sorted, ties by text;
    null texts have the end id alone, rows that repeat a doc_id each count.
    An empty table writes no shard.
    """
    small_batches(docs.sparkSession)
    shuffles = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).repartitionByRange(shuffles, "doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, nth = encoder(vocabulary), TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        who: list[int | None] = []
        counts: list[np.ndarray] = []

        def shard() -> pa.RecordBatch:
            every = np.concatenate(ids)
            matrix = WaveletMatrix.build(every).dumps()
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([nth], pa.int32()), pa.array([who], pa.list_(pa.int64())), pa.array([np.concatenate(counts)], pa.list_(pa.int64())), pa.array([len(every)], pa.int64()), pa.array([matrix], pa.binary())], names=["part", "nth", "doc_ids", "counts", "n", "matrix"])

        for b in batches:
            got, n = enc.encode(text_bytes(b.column(1)), end_id)
            held = sum(map(len, ids))
            if ids and held + len(got) > shard_ids:
                yield shard()
                nth, ids, who, counts = nth + 1, [], [], []
            ids.append(got)
            who += b.column(0).to_pylist()
            counts.append(n)
        if ids:
            yield shard()

    map_arrow(sent, run, "part int, nth int, doc_ids array<long>, counts array<long>, n long, matrix binary").write.parquet(folder)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    shards = spark.read.schema("part int, nth int, doc_ids array<long>, counts array<long>, n long, matrix binary").parquet(folder)
    # One short row per shard of about SHARD_IDS ids.
    offsets = shards.select("part", "nth", "n").withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("part", "nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "nth", "base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids = WaveletMatrix.loads(b.column(4)[i].as_py()).decode().astype("<u4")
                counts = np.asarray(b.column(3)[i].values, dtype=np.int64)
                ends = np.cumsum(counts)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist())]
                same = lambda c, kind: pa.array(np.full(len(ends), b.column(c)[i].as_py()), kind)
                yield pa.RecordBatch.from_arrays([same(0, pa.int32()), same(1, pa.int32()), b.column(2)[i].values, pa.array(ends - counts), pa.array(counts), pa.array(crc, pa.int64())], names=["part", "nth", "doc_id", "within", "n_tokens", "ids_crc32"])

    read = map_arrow(shards.select("part", "nth", "doc_ids", "counts", "matrix"), run, "part int, nth int, doc_id long, within long, n_tokens long, ids_crc32 long")
    return read.join(offsets, ["part", "nth"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def count_token(spark: SparkSession, folder: str, token: int) -> DataFrame:
    """(part, nth, occurrences) of a token in each shard, by rank on the planes; no shard is decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [WaveletMatrix.loads(x).count(token) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["part", "nth", "occurrences"])

    return map_arrow(spark.read.parquet(folder).select("part", "nth", "matrix"), run, "part int, nth int, occurrences long")


def locate_token(spark: SparkSession, folder: str, token: int) -> DataFrame:
    """(part, nth, position) of every occurrence of a token, by select on the planes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, nth, x in zip(*(c.to_pylist() for c in b.columns)):
                m = WaveletMatrix.loads(x)
                at = [m.select(token, i) for i in range(m.count(token))]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(at), pa.int32()), pa.array([nth] * len(at), pa.int32()), pa.array(at, pa.int64())], names=["part", "nth", "position"])

    return map_arrow(spark.read.parquet(folder).select("part", "nth", "matrix"), run, "part int, nth int, position long")


def new_folder(spark: SparkSession) -> str:
    return fresh_path(spark, "token-files")
