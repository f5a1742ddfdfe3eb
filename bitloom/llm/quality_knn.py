"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text's features are hashed 1- and 3-grams of its shape (letter, capital,
digit, space, line end, or the sign itself), its hashed words, and how often a
word stands among the four before it. Sums are damped by a logarithm, weighted
by rarity, and each part has a fixed share of the length. A truncated singular
value decomposition of the labelled sample gives the latent space.

The labelled sample is bounded by ``LABELLED`` rows, chosen by a hash of the
id, so the vectors that are broadcast are at most LABELLED times DIMENSIONS
numbers and the driver holds that sample's features only. Every document is
compared with all labelled vectors, exactly, in blocks of ``BLOCK`` documents;
its score is the mean label of its K nearest, and of all as near as the Kth,
weighted by similarity. Documents
are scored where they are read: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.llm import _ngrams as ng
from bitloom.llm._scratch import schema

#: Bound of the labelled sample, and so of all that is fitted or broadcast.
LABELLED = 4096
DIMENSIONS = 64
K = 15
#: Votes weigh as the similarity to this power.
SHARPNESS = 8
ACCEPT = 0.7
BLOCK = 256
FOLDS, FOLD = 4, 2

SHAPE_BITS, WORD_BITS = 10, 10
#: Centres of the bands of the share of repeated words.
REPEATS = np.array([0.0, 0.08, 0.16, 0.25, 0.4, 0.6, 0.8, 1.0])
SHARES = {"shape": 1.0, "words": 0.25, "repeats": 0.8}
N_SHAPE, N_WORD = 2 << SHAPE_BITS, 1 << WORD_BITS
WIDTH = N_SHAPE + N_WORD + len(REPEATS)

_POWER = (np.arange(1, 65, dtype=np.uint32) * np.uint32(0x9E3779B1)) | np.uint32(1)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 by 4; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == FOLD, F.lit(True))


def features(text: str) -> np.ndarray | None:
    """Sums of the hashed features of a text; None if it has no word.

    A long text is read in pieces; what n-grams, words and repeats need of the
    piece before is carried over, so the sums do not depend on the cuts.
    """
    out = np.zeros(WIDTH, dtype=np.float32)
    n_words = repeated = 0
    shapes = recent = np.empty(0, dtype=np.uint32)
    part, length = np.uint32(0), 0  # of the word that the last cut went through, if any
    for at in range(0, len(text), ng.PIECE):
        c = ng.codes(text[at : at + ng.PIECE])
        space = ng.spaces()[c]
        letter = ng.letters()[c]
        shape = np.where(letter, np.where(ng.uppers()[c], 2, 1), np.where(space, np.where(c == 10, 4, 3), np.where(ng.digits()[c], 5, c + np.uint32(16)))).astype(np.uint32)
        out[: 1 << SHAPE_BITS] += np.bincount(ng.hashed(shape, 1, SHAPE_BITS), minlength=1 << SHAPE_BITS)
        shape = np.r_[shapes, shape]
        out[1 << SHAPE_BITS : N_SHAPE] += np.bincount(ng.hashed(shape, 3, SHAPE_BITS), minlength=1 << SHAPE_BITS)
        shapes = shape[-2:]
        # A word's hash is a sum of its characters, each weighted by its place.
        start = np.flatnonzero(~space & np.r_[not length, space[:-1]])
        first = np.full(len(c), -length)
        first[start] = start
        first = np.maximum.accumulate(first)
        bounds = np.r_[0, start] if length else start
        if not len(bounds):
            continue
        place = (np.arange(len(c)) - first) & 63
        word = np.add.reduceat(np.where(space, np.uint32(0), c * _POWER[place]).astype(np.uint32), bounds, dtype=np.uint32)
        word[:1] += part
        part, length = np.uint32(0), 0
        if not space[-1] and at + ng.PIECE < len(text):
            part, length = word[-1], len(c) - int(first[-1])
            word = word[:-1]
        out[N_SHAPE : N_SHAPE + N_WORD] += np.bincount(ng.hashed(word, 1, WORD_BITS), minlength=N_WORD)
        n_words += len(word)
        word = np.r_[recent, word]
        again = np.zeros(len(word), dtype=bool)
        for lag in (1, 2, 3, 4):
            again[lag:] |= word[lag:] == word[:-lag]
        repeated += int(again[len(recent) :].sum())
        recent = word[-4:]
    if not n_words:
        return None
    out[N_SHAPE + N_WORD :] = np.exp(-(((REPEATS - repeated / n_words) / 0.08) ** 2))
    return out


def _scaled(rows: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Each part damped, weighted and brought to its share of the length, in place."""
    np.log1p(rows, out=rows)
    rows *= rarity
    for part, share in ((slice(0, N_SHAPE), "shape"), (slice(N_SHAPE, N_SHAPE + N_WORD), "words"), (slice(N_SHAPE + N_WORD, WIDTH), "repeats")):
        length = np.linalg.norm(rows[:, part], axis=1, keepdims=True)
        rows[:, part] *= SHARES[share] / np.maximum(length, 1e-9)
    return rows


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, label -> the places and sums of the features that are not zero, and the label; no places for a text without words."""
    for batch in batches:
        at, sums = [], []
        for text in batch.column(0):
            row = features(text.as_py() or "")
            there = np.empty(0, dtype=np.int64) if row is None else np.flatnonzero(row)
            at.append(there.astype(np.uint16).tobytes())
            sums.append(b"" if row is None else row[there].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.binary()), pa.array(sums, pa.binary()), batch.column(1)], names=["at", "sums", "label"])


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, dimensions: int = DIMENSIONS) -> dict:
    """The model from at most ``labelled`` labelled rows that are not held out.

    A doc_id with several labels has their mean, one with several texts the
    least of them. Rows with a null id or label are not used; labels without a
    document and labelled texts without words teach nothing about the space.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.avg("quality").alias("_bitloom_label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("_bitloom_text")).join(F.broadcast(known), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min("_bitloom_text").alias("_bitloom_text"), F.first("_bitloom_label").alias("_bitloom_label"))
    got = texts.select("_bitloom_text", "_bitloom_label").mapInArrow(_sample_features, "at binary, sums binary, label double").toArrow()
    got = sorted(zip(got["label"].to_pylist(), got["at"].to_pylist(), got["sums"].to_pylist()))  # whatever the order of the tasks
    wordless = [label for label, at, _ in got if not at]
    none = sum(wordless) / len(wordless) if wordless else 0.5
    got = [g for g in got if g[1]]
    if not got:
        return {"wordless": none, "vectors": None}
    label = np.array([g[0] for g in got], dtype=np.float32)
    rows = np.zeros((len(got), WIDTH), dtype=np.float32)
    for row, (_, at, sums) in zip(rows, got):
        row[np.frombuffer(at, dtype=np.uint16)] = np.frombuffer(sums, dtype=np.float32)
    del got
    rarity = np.log((1 + len(rows)) / (1 + np.count_nonzero(rows, axis=0))).astype(np.float32) + 1
    rarity[N_SHAPE + N_WORD :] = 1
    scaled = _scaled(rows, rarity)
    # Truncated decomposition by subspace iteration from a fixed start.
    basis = np.random.default_rng(0).standard_normal((WIDTH, min(dimensions, len(rows)) + 8)).astype(np.float32)
    for _ in range(6):
        basis, _ = np.linalg.qr(scaled.T @ (scaled @ basis))
    _, _, right = np.linalg.svd(scaled @ basis, full_matrices=False)
    latent = (basis @ right.T)[:, :dimensions].astype(np.float32)
    return {"wordless": none, "rarity": rarity, "latent": latent, "vectors": _unit(scaled @ latent), "labels": label}


def _vote(model: dict, rows: np.ndarray, k: int) -> np.ndarray:
    """Mean labels of the k nearest, and of all that are as near as the kth, weighted by similarity. Cosines count to six decimals."""
    vectors, label = model["vectors"], model["labels"]
    near = np.round(_unit(_scaled(rows, model["rarity"]) @ model["latent"]) @ vectors.T, 6)
    k = min(k, len(label))
    least = np.partition(near, len(label) - k, axis=1)[:, len(label) - k, None]
    row, at = np.nonzero(near >= least)
    weight = np.maximum(near[row, at].astype(np.float64), 1e-6) ** SHARPNESS
    return np.bincount(row, weight * label[at], len(rows)) / np.bincount(row, weight, len(rows))


def _score(model_of, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of.value
        for batch in batches:
            scores = np.full(batch.num_rows, model["wordless"])
            if model["vectors"] is not None:
                texts = batch.column(0)
                for at in range(0, batch.num_rows, BLOCK):
                    rows = [features(t.as_py() or "") for t in texts[at : at + BLOCK]]
                    there = [i for i, r in enumerate(rows) if r is not None]
                    if there:
                        scores[at + np.array(there)] = _vote(model, np.stack([rows[i] for i in there]), k)
            columns = dict(zip(batch.schema.names[1:], batch.columns[1:])) | {"_bitloom_score": pa.array(np.clip(scores, 0, 1))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def scored(docs: DataFrame, labels: DataFrame, k: int = K, labelled: int = LABELLED) -> DataFrame:
    """``docs`` with the column _bitloom_score, 0 to 1.

    Null texts and texts without words have the mean label of the sample's
    texts without words, 0.5 if there is none; so have all texts if nothing is
    labelled. Ids, langs and sources do not enter a score.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, labelled))
    kind = schema(docs.schema.fields, "_bitloom_score double")
    return docs.select(F.col("text").cast("string").alias("_bitloom_text"), *docs.columns).mapInArrow(_score(model, k), kind)


def score_quality(docs: DataFrame, labels: DataFrame, k: int = K, labelled: int = LABELLED, accept: float = ACCEPT) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from ``accept`` on) for every row of ``docs``.

    Repeated rows come back repeated, with one score for equal texts; a null id
    is held out; other columns are ignored. See ``scored`` for texts without words.
    """
    out = scored(docs.select("doc_id", "text"), labels, k, labelled)
    score = F.col("_bitloom_score")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= accept).cast("int").alias("predicted"))


def keep_accepted(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """The rows of ``docs`` with a score of ``accept`` or more."""
    return scored(docs, labels).where(F.col("_bitloom_score") >= accept).select(*docs.columns)
