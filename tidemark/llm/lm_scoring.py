"""LM scoring: unigram base counts over all training texts, and a causal self-attention model of subword ids."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import attention
from .common import cut, forget, map_arrow, small_batches
from .token_files import END_ID, Numbers, WordEncoder

HOLD = 10
#: Most words, the most frequent, whose counts every worker keeps, by hash (a documented bound); the others meet their counts in a join.
HEAD_WORDS = 1_000_000
#: Words that a worker keeps encoded or counted; beyond them it starts anew.
KEPT_WORDS = 600_000
#: Frequent subword ids with vectors of their own; the others share one and its unigram.
MODEL_IDS = 4096
#: Subword ids, about, of the texts on which one task trains the start; all texts follow.
START_IDS = 4_800_000
RATE, BATCH = 0.04, 1024

_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def held_out() -> F.Column:
    """True where crc32 of doc_id as text has remainder 0; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % HOLD == 0, F.lit(False))


def cut_words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct words of a batch, each text's words and its end as numbers in them, how many each text has); a line feed stands for the end.

    Arrow lowers, cuts and numbers the words, so that Python meets each only once a batch.
    """
    low = pc.ascii_trim_whitespace(pc.ascii_lower(texts.cast(pa.string()).fill_null("")))
    # A blank behind a text leaves one empty word there, its end; an empty text is one empty word.
    words = pc.ascii_split_whitespace(pc.if_else(pc.equal(low, ""), "", pc.binary_join_element_wise(low, "", " ")))
    numbered = words.flatten().dictionary_encode()
    distinct = numbered.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
    return [w or b"\n" for w in distinct], numbered.indices.to_numpy().astype(np.int64), pc.list_value_length(words).to_numpy().astype(np.int64)


def encoded_texts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """docs (doc_id, held_out, text) with `ids` of the whole texts, END_ID behind each; and rows of (words, counts) of the training texts alone.

    Every text is encoded once. Words are counted on the way: a task adds
    them up by the encoder's numbers and writes its sums whenever the encoder
    starts anew, and at its end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, names = _encoder(vocabulary), ["doc_id", "held_out", "text", "ids", "words", "counts"]
        tally = np.zeros(len(enc), np.int64)
        kinds = None

        def sums() -> pa.RecordBatch:
            tally[enc[b"\n"]] = 0  # the end is no word
            n = np.flatnonzero(tally)
            ends = pa.array([0, len(n)], pa.int32())
            words = pa.ListArray.from_arrays(ends, pa.array(list(enc), pa.binary()).take(pa.array(n)).cast(pa.string()))
            counts = pa.ListArray.from_arrays(ends, pa.array(tally[n]))
            return pa.RecordBatch.from_arrays([pa.nulls(1, kinds[0]), pa.nulls(1, pa.bool_()), pa.nulls(1, pa.string()), pa.nulls(1, pa.binary()), words, counts], names=names)

        for b in batches:
            kinds = kinds or [b.column(0).type]
            if len(enc) > KEPT_WORDS:
                yield sums()
                enc.forget()
                tally = np.zeros(0, np.int64)
            words, numbers, size = cut_words(b.column(2))
            ids, n_ids, index = enc.encode_numbered(words, numbers, size)
            learnt = np.repeat(~np.asarray(b.column(1)), size)
            now = np.bincount(index[learnt], minlength=len(enc))
            now[: len(tally)] += tally
            tally = now
            ends = pa.array(np.concatenate([[0], np.cumsum(n_ids * 4)]).astype(np.int32))
            flat = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, ends.buffers()[1], pa.py_buffer(ids.astype("<u4").tobytes())])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2).cast(pa.string()), flat, pa.nulls(len(size), pa.list_(pa.string())), pa.nulls(len(size), pa.list_(pa.int64()))], names=names)
        if kinds and tally.any():
            yield sums()
        pa.default_memory_pool().release_unused()

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "held_out", "text"), run, f"doc_id {kind}, held_out boolean, text string, ids binary, words array<string>, counts array<long>")


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all rows of a binary column, how many each has)."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), "<u4"), np.array([len(x) // 4 for x in raw], np.int64)


def id_counts(rows: DataFrame) -> np.ndarray:
    """Counts of subword ids in all rows; at most one row per id reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _encoders.clear()  # all texts are encoded: a worker's memory goes to what follows
        total = np.zeros(1, np.int64)
        for b in batches:
            n = np.bincount(_ids(b.column(0))[0])
            total = np.pad(total, (0, max(0, len(n) - len(total))))
            total[: len(n)] += n
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["id", "n"])

    got = map_arrow(rows.select("ids"), run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    at = got["id"].to_numpy()
    out = np.zeros(int(at.max()) + 1 if len(at) else END_ID + 1, np.int64)
    out[at] = got["n"].to_numpy()
    return out


def pair_counts(rows: DataFrame, to: np.ndarray, kinds: int) -> np.ndarray:
    """Counts of each model id (row; those beyond PAIR_ROWS in the row of RARE) and the next one, in all rows.

    A task adds into one table of bounded size; filled cells are summed in a
    shuffle, and no more than PAIR_ROWS x MODEL_IDS of them reach the driver.
    """
    n_rows = min(kinds, attention.PAIR_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_rows * kinds, np.int64)
        for b in batches:
            ids, size = _ids(b.column(0))
            y = to[ids].astype(np.int64)
            x = np.empty_like(y)
            x[1:] = y[:-1]
            x[(np.cumsum(size) - size)[size > 0]] = attention.START
            x[x >= n_rows] = attention.RARE
            total += np.bincount(x * kinds + y, minlength=len(total))
        some = np.flatnonzero(total)
        for lo in range(0, len(some), 1 << 16):
            part = some[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], names=["cell", "n"])

    got = map_arrow(rows.select("ids"), run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n_rows * kinds, np.float32)
    out[got["cell"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(n_rows, kinds)


def model_ids(counts: np.ndarray, size: int, most: int = MODEL_IDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(model id of each of the vocabulary's `size` ids, log10 share of each rare id among the rare, counts of the model's ids)."""
    full = np.zeros(max(size, len(counts)), np.int64)
    full[: len(counts)] = counts
    end, full[END_ID] = full[END_ID], 0
    top = np.argsort(-full, kind="stable")[: most - attention.FIRST]
    top = top[full[top] > 1]
    to = np.full(len(full), attention.RARE, np.int32)
    to[top] = np.arange(len(top)) + attention.FIRST
    to[END_ID] = attention.END
    rare = to == attention.RARE
    share = np.where(rare, np.log10((full + 0.1) / (full[rare] + 0.1).sum()), 0.0)
    mine = np.bincount(to, weights=full, minlength=len(top) + attention.FIRST)
    mine[attention.END] = end
    return to, share, mine


def fit(rows: DataFrame, size: int) -> dict:
    """The model of the training texts' `ids`, for a vocabulary of `size` ids.

    All ids and pairs of ids of all texts are counted. A start is trained on
    texts of about START_IDS ids, drawn by hash; then every window of every
    text is learnt from where it lies: each task takes its rows in a stream
    from the common start, sums the masses of its windows and moves the
    vectors by the gradient of all of them, a block a step. Masses are added and vectors
    averaged by windows in a tree of 16 at a time, so that no task and not the
    driver holds more than 16 models; a model has a bounded size (MODEL_IDS).
    """
    counts = id_counts(rows)
    to, share, mine = model_ids(counts, size)
    total = int(counts.sum())
    if not total:
        return {"model": attention.start_model(mine), "to": to, "share": share}
    model = attention.start_model(mine, pair_counts(rows, to, len(mine)))
    spark = rows.sparkSession
    fixed = {k: v for k, v in model.items() if k not in (*attention.LEARNT, "mass")}
    sent = spark.sparkContext.broadcast((fixed, to))
    schema = "part int, weight double, model binary"

    def packed(part: int, weight: float, learnt: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([weight]), pa.array([pickle.dumps(learnt)], pa.binary())], names=["part", "weight", "model"])

    def begin(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        known, ids_to = sent.value
        first = known | {k: model_of[k] for k in model_of}
        ids, size_of = _ids(group["ids"].take(pa.array(np.argsort(np.asarray(group["h"]), kind="stable"))).combine_chunks())
        w, y, _ = attention.to_blocks(ids_to[ids], size_of)
        got = attention.train(first, w, y, RATE, 1, batch=BATCH)
        return pa.Table.from_batches([packed(0, float(len(w)), {k: got[k] for k in (*attention.LEARNT, "mass")})])

    model_of = {k: model[k] for k in (*attention.LEARNT, "mass")}
    every = max(1, total // START_IDS)
    h = F.xxhash64("ids")
    some = rows.select("ids", h.alias("h")).where(F.pmod("h", F.lit(every)) == 0)
    start = some.groupBy(F.lit(0).alias("part")).applyInArrow(begin, schema).select("model").first()
    if start:
        model |= pickle.loads(start[0])
    started = spark.sparkContext.broadcast({k: model[k] for k in model_of})

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ids_to = sent.value
        learner = attention.Learner(known | started.value, RATE / 4)
        for b in batches:
            ids, size_of = _ids(b.column(0))
            learner.learn(*attention.to_blocks(ids_to[ids], size_of)[:2])
        if learner.windows:
            yield packed(TaskContext.get().partitionId(), float(learner.windows), {k: learner.model[k] for k in attention.LEARNT} | {"mass": learner.mass})

    def join(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        weight, out = np.asarray(group["weight"]), {}
        for i in np.argsort(np.asarray(group["part"]), kind="stable").tolist():
            for k, v in pickle.loads(group["model"][i].as_py()).items():
                out[k] = out.get(k, 0.0) + v.astype(np.float64) * (1.0 if k == "mass" else weight[i] / weight.sum())
        return pa.Table.from_batches([packed(key[0].as_py(), float(weight.sum()), {k: v if k == "mass" else v.astype(np.float32) for k, v in out.items()})])

    models = cut(map_arrow(rows.select("ids"), learn, schema), "lm-models")
    n = models.agg(F.max("part")).first()[0]
    tree = models
    while n is not None and n >= 1:
        tree, n = tree.withColumn("part", F.floor(F.col("part") / 16).cast("int")).groupBy("part").applyInArrow(join, schema), n // 16
    got = tree.select("model").first()
    if got:
        model |= {k: v.astype(np.float32) for k, v in pickle.loads(got[0]).items()}
    forget(models)
    return {"model": model, "to": to, "share": share}


def score_texts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text of docs.

    Tokens are words and an end, A-Z lower-cased; the base is the smoothed
    unigram of the training texts, those not held out. The score is the log10
    probability of the text's subword ids and end under the attention model.
    Null texts count as empty (one token, the end); rows that repeat a doc_id
    are scored and counted each; a null doc_id belongs to the training texts.
    An empty table gives an empty one.

    Every text is encoded once; ids and counts stay in tables. Hashes and
    counts of the HEAD_WORDS most frequent words travel to the workers; each
    text's other words are written beside its score and meet their counts in
    a join, after which they are summed by row. Very long texts are whole:
    only windows are cut from them.
    """
    spark = docs.sparkSession
    encoded = cut(encoded_texts(docs.select("doc_id", held_out().alias("held_out"), "text"), vocabulary), "lm-encoded")
    rows = encoded.where("held_out IS NOT NULL")
    train = rows.where("NOT held_out")
    partial = encoded.where("held_out IS NULL").select(F.explode(F.arrays_zip("words", "counts")).alias("z"))
    counts = cut(partial.groupBy(F.col("z.words").alias("word")).agg(F.sum("z.counts").alias("c")), "lm-counts")
    totals = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n_train = train.count()
    big_n, v = (totals["n"] or 0) + n_train, totals["v"] + (n_train > 0)
    # Steps of frequency, 32 to each doubling: the highest that hold HEAD_WORDS words or fewer are the head.
    step = F.floor(F.log2("c") * 32).cast("int")
    steps = sorted(((r[0], r[1]) for r in counts.groupBy(step.alias("s")).agg(F.count("*")).collect()), reverse=True)
    cutoff, held = (steps[0][0] + 1 if steps else 0), 0
    for at, n in steps:
        held += n
        if held > HEAD_WORDS:
            break
        cutoff = at
    head = counts.where(step >= cutoff).select(F.xxhash64("word").alias("h"), "c").toArrow()
    order = np.argsort(head["h"].to_numpy(), kind="stable")
    head_hash, head_count = head["h"].to_numpy()[order], head["c"].to_numpy()[order]
    whole = len(head) == totals["v"]  # then the other words have no count at all
    fitted = fit(train, len(_encoder(vocabulary).closes))
    sent = spark.sparkContext.broadcast((head_hash, head_count, fitted))
    under = float(np.log10(big_n + 0.1 * (v + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, in_head, fit_ = sent.value
        model, to, share = fit_["model"], fit_["to"], fit_["share"]
        dist, table = attention.distributions(model), attention.following(model)
        row = TaskContext.get().partitionId() << 33
        numbers, count_of = Numbers(), np.zeros(0, np.int64)
        for b in batches:
            words, index, size = cut_words(b.column(2))
            if len(numbers) > KEPT_WORDS:
                numbers, count_of = Numbers(), np.zeros(0, np.int64)
            mine = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
            # Spark's xxhash64 of a string has this seed; -1 stands for a word that is not in the head.
            h = np.array([xxhash.xxh64_intdigest(w, 42) for w in numbers.new], np.uint64).view(np.int64)
            at = np.minimum(np.searchsorted(hashes, h), max(len(hashes) - 1, 0))
            met = (hashes[at] == h) if len(hashes) else np.zeros(len(h), bool)
            count_of = np.concatenate([count_of, np.where(met, in_head[at] if len(hashes) else 0, 0 if whole else -1)])
            numbers.new = []
            count_of[numbers[b"\n"]] = n_train
            count = count_of.take(mine)
            logs_of = np.where(count < 0, 0.0, np.log10(np.maximum(count, 0) + 0.1))
            start = np.cumsum(size) - size
            c, base = count.take(index), logs_of.take(index)
            rare = c < 0
            sums = np.add.reduceat(base, start) if len(start) else base[:0]
            known = np.add.reduceat((c > 0).astype(np.int64), start) if len(start) else start
            tails = np.flatnonzero(rare)
            tail_ends = np.searchsorted(tails, np.concatenate([start, [len(c)]]))
            names = [words[i] for i in index[tails].tolist()]
            tail = pa.ListArray.from_arrays(pa.array(tail_ends.astype(np.int32)), pa.array(names, pa.binary()).cast(pa.string()))
            ids, n_ids = _ids(b.column(3))
            windows, targets, blocks = attention.to_blocks(to[ids], n_ids)
            logs = attention.log10_probabilities(model, dist, windows, targets, table=table)
            block_start, id_start = np.cumsum(blocks) - blocks, np.cumsum(n_ids) - n_ids
            score = np.add.reduceat(logs, block_start) + np.add.reduceat(share[ids], id_start) if len(size) else logs
            yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(len(size))), b.column(0), b.column(1), pa.array(size), pa.array(known), pa.array(sums), pa.array(score), tail], names=["row", "doc_id", "held_out", "n_tokens", "known", "sums", "score", "tail"])
            row += len(size)

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = cut(map_arrow(rows.select("doc_id", "held_out", "text", "ids"), run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, sums double, score double, tail array<string>"), "lm-scored")
    words = scored.select("row", F.explode("tail").alias("word"))
    rest = counts.where(step < cutoff)
    met = words.join(rest, "word", "left").groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1))).alias("tail_sum"), F.count("c").alias("tail_known"))
    forget(encoded)
    out = scored.drop("tail").join(met, "row", "left")
    base = F.col("sums") + F.coalesce("tail_sum", F.lit(0.0)) - F.col("n_tokens") * F.lit(under)
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(big_n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
