"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased and everything but letters becomes one space; its 1- to
3-grams are hashed to ``2 ** BITS`` features. Training adds up the features of
all labelled documents, in each task first, so that a row for each language and
feature leaves a task. The log-probability matrix has languages times features
numbers, whatever the corpus, and is broadcast, ``LANGS`` languages (64 MB) at
a time: with more the documents go through one block of languages after the
other and carry the best so far. Scoring takes the matrix rows of all n-grams
of a slice of documents at once and sums them by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.llm import _ngrams as ng
from bitloom.llm._scratch import Scratch, schema

BITS = 15
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
FOLDS = 5
UNKNOWN = "und"
#: Languages of one broadcast matrix.
LANGS = 512
#: Characters of documents scored together.
SLICE = 500_000


def in_fold(doc_id: Column, folds: int = FOLDS, fold: int = 0) -> Column:
    """Whether crc32 of the id as text leaves ``fold``; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(True))


def _normal(text: str) -> Iterator[np.ndarray]:
    """Codes of the letters in lower case, with a single space for anything between, before and after, piece by piece."""
    text, inside = f" {text.lower()} ", True
    for at in range(0, len(text), ng.PIECE):
        c = ng.codes(text[at : at + ng.PIECE])
        letter = ng.letters()[c]
        keep = letter | np.r_[inside, letter[:-1]]
        inside = letter[-1]
        yield np.where(letter, c, np.uint32(32))[keep]


def _slices(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features, their documents' positions), some documents or a part of a long one at a time.

    A part begins with the last codes of the one before, so that no n-gram is lost.
    """
    held, owner, size, carried = [], [], 0, 0

    def flush():
        values, doc = np.concatenate(held), np.repeat(owner, [len(h) for h in held])
        features, docs = [], []
        for n in ORDERS:
            h = ng.hashed(values, n, BITS)
            own = (doc[: len(h)] == doc[n - 1 :]) & ((values[: len(h)] != 32) if n == 1 else True)
            own[: max(0, carried - n + 1)] = False  # counted with the part before
            features.append(h[own])
            docs.append(doc[: len(h)][own])
        return np.concatenate(features), np.concatenate(docs)

    for i, text in enumerate(texts):
        for values in _normal(text):
            held.append(values)
            owner.append(i)
            size += len(values)
            if size >= SLICE:
                yield flush()
                tail = np.concatenate([h for h, o in zip(held, owner) if o == i])[1 - max(ORDERS) :]
                held, owner, size, carried = [tail], [i], 0, len(tail)
    if held:
        yield flush()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, lang -> the task's sums (lang, feature, n); feature -1 counts documents."""
    sums: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in batches:
        texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        names, which = np.unique(np.array(langs, dtype=object), return_inverse=True)
        for name, n in zip(names, np.bincount(which, minlength=len(names))):
            sums.setdefault(name, np.zeros(1 << BITS, dtype=np.int64))
            docs[name] = docs.get(name, 0) + int(n)
        for features, owner in _slices(texts):
            by = np.bincount(which[owner] * (1 << BITS) + features, minlength=len(names) << BITS).reshape(len(names), -1)
            for name, row in zip(names, by):
                sums[name] += row
    for name, row in sums.items():
        at = np.flatnonzero(row)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * (len(at) + 1), pa.string()), pa.array(np.r_[-1, at], pa.int32()), pa.array(np.r_[docs[name], row[at]], pa.int64())], names=["lang", "feature", "n"]
        )


def train(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(lang, feature, n) from the text and lang of all rows of ``docs`` with a lang; feature -1 counts documents. Null texts count as empty."""
    rows = docs.where(F.col("lang").isNotNull()).select(F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("lang").cast("string"))
    return scratch.keep(rows.mapInArrow(_count, "lang string, feature int, n bigint").groupBy("lang", "feature").agg(F.sum("n").alias("n")), "sums")


def matrix(sums: DataFrame, langs: list[str], n_docs: dict[str, int]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log prior, log probability of each feature and language) of some of the languages."""
    got = sums.where(F.col("lang").isin(langs) & (F.col("feature") >= 0)).toArrow()
    at = {x: i for i, x in enumerate(langs)}
    counts = np.zeros((1 << BITS, len(langs)))
    counts[got["feature"].to_numpy(), np.fromiter((at[x] for x in got["lang"].to_pylist()), dtype=np.int64, count=len(got))] = got["n"].to_numpy()
    log_prob = np.log(counts + SMOOTHING) - np.log(counts.sum(axis=0) + SMOOTHING * (1 << BITS))
    prior = np.array([n_docs[x] for x in langs], dtype=np.float64)
    return langs, np.log(prior / max(1, sum(n_docs.values()))), log_prob.astype(np.float32)


def _predict(model, carried: bool, last: bool):
    """doc_id, held_out, text and, if carried, lang_pred, top (its log probability) and mass (the sum of all over it) so far -> the same after this block, without text after the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, prior, log_prob = model.value
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            total, seen = np.zeros((len(texts), len(langs))), np.zeros(len(texts), dtype=bool)
            for features, owner in _slices(texts):
                if not len(owner):
                    continue
                # n-grams come by order, each time by document, so a document is a run of equal owners.
                starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                np.add.at(total, owner[starts], np.add.reduceat(log_prob[features], starts, axis=0, dtype=np.float64))
                seen[owner[starts]] = True
            total += prior
            top = total.max(axis=1)
            mass = np.exp(total - top[:, None]).sum(axis=1)
            names = [langs[b] if k else UNKNOWN for b, k in zip(total.argmax(axis=1), seen)]
            if carried:
                old, before, sums = batch.column(3).to_pylist(), batch.column(4).to_numpy(), batch.column(5).to_numpy()
                best = np.maximum(top, before)
                mass = mass * np.exp(top - best) + sums * np.exp(before - best)
                names = [o if b >= t else n for o, n, b, t in zip(old, names, before, top)]
                top = best
            out = {"doc_id": batch.column(0), "held_out": batch.column(1), "text": batch.column(2), "lang_pred": pa.array(names, pa.string()), "top": pa.array(top), "mass": pa.array(mass)}
            if last:
                del out["text"]
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return run


def identify(docs: DataFrame, folds: int = FOLDS, block: int = LANGS) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the posterior) for every row of ``docs``, learnt from those not held out.

    Held out are the ids whose crc32 as text is divisible by ``folds``, and null
    ids. lang_pred is ``und`` with score 0 for texts that are null or have no
    letter, and for all if no row is labelled; of languages that are equally
    probable it is the first by name. Repeated rows count as often as they
    stand, in training too; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "languages")
    sums = train(docs.where(~in_fold(F.col("doc_id"), folds)), scratch)
    n_docs = {r["lang"]: r["n"] for r in sums.where("feature = -1").collect()}
    langs = sorted(n_docs)
    rows = docs.select("doc_id", in_fold(F.col("doc_id"), folds).alias("held_out"), F.col("text").cast("string").alias("text"))
    if not langs:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    for at in range(0, len(langs), block):
        last = at + block >= len(langs)
        model = docs.sparkSession.sparkContext.broadcast(matrix(sums, langs[at : at + block], n_docs))
        kind = schema([docs.schema["doc_id"]], f"held_out boolean, {'' if last else 'text string, '}lang_pred string, top double, mass double")
        rows = rows.mapInArrow(_predict(model, at > 0, last), kind)
        if not last:
            rows = scratch.keep(rows, f"block-{at}")
            scratch.drop(f"block-{at - block}")
    scratch.drop("sums")
    return rows.select("doc_id", "held_out", "lang_pred", F.when(F.col("lang_pred") == UNKNOWN, 0.0).otherwise(1 / F.col("mass")).alias("score"))
