"""Language by compression: a text belongs to the language whose dictionary makes it shortest."""

from __future__ import annotations

import heapq
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, small_batches, with_batches

#: Bytes of a language's dictionary and of the pieces of training texts that it is made of: the documented sample.
DICTIONARY_BYTES, PIECE_BYTES = 1 << 15, 1 << 10
#: Bytes of a text that are encoded at a time, each with a fresh start, so that all of a long text speaks.
BLOCK_BYTES = 1 << 12
#: Bits of code length that change the odds of two languages by two, and the margin in bits below which an answer is rejected.
BITS_PER_DOUBLING, LEAST_MARGIN = 32.0, 24.0
NOT_LETTERS = re.compile(r"[\W\d_]+")
UNKNOWN = "und"


def plain_bytes(text: str | None) -> bytes | None:
    """What is encoded: the letters in lower case, each other stretch one blank; None for a text without a letter."""
    if not text or not any(map(str.isalpha, text)):
        return None
    return (" " + NOT_LETTERS.sub(" ", text.lower()).strip() + " ").encode("utf-8", "replace")


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    """A compressor that may refer to `content` as if it stood before what is compressed; the frame holds nothing else."""
    level = zstandard.ZstdCompressionParameters.from_level(6, source_size=BLOCK_BYTES, dict_size=DICTIONARY_BYTES, min_match=3)
    names = ("window_log", "hash_log", "chain_log", "search_log", "min_match", "target_length", "strategy")
    params = zstandard.ZstdCompressionParameters(**{n: getattr(level, n) for n in names}, write_content_size=False, write_checksum=False, write_dict_id=False)
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(compression_params=params, dict_data=dictionary)


def fit(docs: DataFrame, label: str = "lang", text: str = "text") -> dict[str, tuple[int, bytes]]:
    """For each value of `label`: its number of texts, and its dictionary.

    A dictionary is made of the DICTIONARY_BYTES / PIECE_BYTES pieces with the
    smallest hashes among all distinct pieces of all texts with that label, so
    copies count once and neither order nor partitioning matters. Each task
    keeps that many pieces of a label and Spark merges them; the driver gets
    32 KB for each label. Rows with a null label or a text without a letter
    teach nothing.
    """
    small_batches(docs.sparkSession)
    most = DICTIONARY_BYTES // PIECE_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[str, list[tuple[int, bytes]]] = defaultdict(list)
        inside: dict[str, set[int]] = defaultdict(set)
        counts: dict[str, int] = defaultdict(int)
        for b in batches:
            for name, whole in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = plain_bytes(whole)
                if name is None or data is None:
                    continue
                counts[name] += 1
                heap, held = heaps[name], inside[name]
                for i in range(0, len(data), PIECE_BYTES):
                    piece = data[i : i + PIECE_BYTES]
                    key = xxhash.xxh64_intdigest(piece) >> 1
                    if key not in held and (len(heap) < most or key < -heap[0][0]):
                        held.add(key)
                        gone = heapq.heappushpop(heap, (-key, piece)) if len(heap) == most else heapq.heappush(heap, (-key, piece))
                        if gone:
                            held.discard(-gone[0])
        rows = [(name, -key, piece, counts[name] if i == 0 else 0) for name, heap in heaps.items() for i, (key, piece) in enumerate(heap)]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.binary(), pa.int64()), strict=True)], names=["label", "key", "piece", "texts"])

    found = map_arrow(docs.select(F.col(f"`{label}`").cast("string").alias("label"), F.col(f"`{text}`").alias("text")), run, "label string, key long, piece binary, texts long")
    merged = found.groupBy("label", "key").agg(F.min("piece").alias("piece"), F.sum("texts").alias("texts"))
    # The texts of a label are counted on rows that may lose their place, so the sum is taken beside the ranks.
    texts = F.sum("texts").over(Window.partitionBy("label"))
    place = F.row_number().over(Window.partitionBy("label").orderBy("key"))
    best = merged.select("label", "key", "piece", texts.alias("texts"), place.alias("place")).where(F.col("place") <= most)
    out: dict[str, tuple[int, bytes]] = {}
    for r in best.orderBy("label", "key").toLocalIterator():
        out[r.label] = (r.texts, out.get(r.label, (0, b""))[1] + bytes(r.piece))
    return out


def predict_language(docs: DataFrame, model: dict[str, tuple[int, bytes]], text: str = "text", least_margin: float = LEAST_MARGIN) -> DataFrame:
    """docs with `lang_pred`, `score`, `margin_bits` and `rejected`.

    A text's length in a language is the bits of its blocks, each compressed
    with that language's raw-content dictionary, plus the bits that naming the
    language takes (-log2 of its share of the training texts). The language
    with the shortest is predicted, ties by name. margin_bits is how much
    longer the second is (null with fewer than two languages); below
    `least_margin` the answer is `rejected`, the prediction stays as the best
    guess. score is the best one's share of the odds 2 ** (-bits / 32).

    A null text and one without a letter (an empty one among them) are `und`
    with score 0, rejected; so are all texts if nothing was learned. Rows that
    repeat are judged each; texts are whole, however long; an empty table
    gives an empty one. Added columns replace ones of the same name (in any
    case); all others pass through. Only the text is read; no shuffle.
    """
    total = sum(n for n, _ in model.values())
    names = sorted(model)
    spare = {name: -math.log2(model[name][0] / total) for name in names}
    contents = {name: model[name][1] for name in names}
    added = [("lang_pred", "string"), ("score", "double"), ("margin_bits", "double"), ("rejected", "boolean")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        coders = {name: compressor(content) for name, content in contents.items()}

        def judge(whole: str | None) -> tuple[str, float, float | None, bool]:
            data = plain_bytes(whole)
            if data is None or not coders:
                return UNKNOWN, 0.0, None, True
            blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
            bits = sorted((spare[name] + 8 * sum(len(c.compress(x)) for x in blocks), name) for name, c in coders.items())
            score = 1 / sum(2.0 ** ((bits[0][0] - x) / BITS_PER_DOUBLING) for x, _ in bits)
            margin = bits[1][0] - bits[0][0] if len(bits) > 1 else None
            return bits[0][1], score, margin, margin is not None and margin < least_margin

        for b in batches:
            rows = [judge(x) for x in b.column(0).to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield [pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.float64(), pa.float64(), pa.bool_()), strict=True)]

    return with_batches(docs, run, added, [text])
