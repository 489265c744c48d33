"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of 1 to 3 folded characters, weighted by relative frequency and inverse document frequency.
Document frequencies are counted over all labelled rows. The model is trained by follow-the-regularised-leader with
elastic-net penalties on a bounded sample of them in one task: of each language about ``SAMPLE`` rows, and rows of about
``SAMPLE_BYTES`` of text. A temperature, fitted on a fifth of the sample that training leaves out, calibrates its
probabilities. Every label value is learned; the model holds ``FEATURES`` weights of each. Prediction is one pass over
every whole text, without a shuffle: a text's score is the sum of its n-grams' weights over their number. A long text is
read in pieces whose features are added up.

Defined cases: a null text, or one without a letter (marks are none), is ``und`` with score 0; without a labelled row every text is; rows
with null ids are predicted as any other and are held in; repeated rows are predicted alike; an empty table gives an
empty result; further columns of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qanat.llm import sums
from qanat.llm.chars import Chars, folded
from qanat.llm.ftrl import Ftrl, bounded_sample, packed
from qanat.llm.words import is_long, row_slices, text_pieces
from qanat.session import text_batches

LENGTHS, FEATURES, SAMPLE, SAMPLE_BYTES, EPOCHS = (1, 2, 3), 1 << 16, 1500, 64 << 20, 3
ALPHA, BETA, L1, L2, SCALE = 0.5, 1.0, 0.05, 0.05, 10.0
NONE = "und"
#: Rows whose features are marked together: AT_ONCE * FEATURES bytes.
AT_ONCE = 256

Model = tuple[list[str], np.ndarray, np.ndarray, float]  # languages, weights by feature and language, biases, temperature


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, Chars]:
    """(feature, row) of each n-gram of each text."""
    chars = Chars(texts)
    found = [chars.ngrams(n) for n in LENGTHS]
    return (np.concatenate([h for h, _ in found]) & np.uint64(FEATURES - 1)).astype(np.int64), np.concatenate([r for _, r in found]), chars


def long_counts(texts: pa.Array) -> tuple[np.ndarray, bool]:
    """How often each feature occurs in one long text, read in pieces, and whether it has a letter.

    A piece begins in white space, which ends the one before. With the last letter before it, it holds all n-grams that
    reach over the cut; those of that letter alone are counted twice, and taken off.
    """
    total, letter, last = np.zeros(FEATURES, np.int64), False, ""
    for piece in text_pieces(texts):
        body = piece[0].as_py()
        at, _, chars = features(pa.array([last + body]))
        total += np.bincount(at, minlength=FEATURES)
        if last:
            total -= np.bincount(features(pa.array([last]))[0], minlength=FEATURES)
        letter |= bool(chars.has_letter()[0])
        full = np.flatnonzero(chars.points != 32)
        last = chr(chars.raw[full[-1]]) if len(full) else last
    return total, letter


def vectors(rows: DataFrame) -> DataFrame:
    """(doc_id, text, lang) -> (lang, held, at, share): a row's distinct features and their relative frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches):
            if is_long(batch.column("text")):
                counts, _ = long_counts(batch.column("text"))
                pairs = np.flatnonzero(counts)
                counts = counts[pairs]
            else:
                at, row, _ = features(batch.column("text"))
                pairs, counts = np.unique(row * FEATURES + at, return_counts=True)
            row = pairs // FEATURES
            share = (counts / np.bincount(row, counts, batch.num_rows)[row]).astype(np.float32)
            edges = np.searchsorted(row, np.arange(batch.num_rows + 1))
            spans = list(zip(edges[:-1], edges[1:], strict=True))
            at = (pairs % FEATURES).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"), pa.array([at[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([share[a:b].tobytes() for a, b in spans], pa.binary())],
                ["doc_id", "lang", "at", "share"],
            )

    return rows.select("doc_id", "text", "lang").mapInArrow(run, "doc_id long, lang string, at binary, share binary")


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def frequencies(rows: DataFrame) -> np.ndarray:
    """In how many rows each feature occurs; the number of rows stands last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(FEATURES + 1, np.int64), np.zeros(AT_ONCE * FEATURES, bool)
        for batch in row_slices(batches):
            counts[-1] += batch.num_rows
            if is_long(batch.column("text")):
                counts[:-1] += long_counts(batch.column("text"))[0] > 0
                continue
            chars = Chars(batch.column("text"))
            found = [chars.ngrams(n) for n in LENGTHS]  # each by row
            for first in range(0, batch.num_rows, AT_ONCE):
                for h, row in found:
                    a, b = np.searchsorted(row, (first, first + AT_ONCE))
                    seen[(row[a:b] - first) * FEATURES + (h[a:b] & np.uint64(FEATURES - 1)).astype(np.int64)] = True
                counts[:-1] += seen.reshape(AT_ONCE, FEATURES).sum(0, dtype=np.int64)
                seen[:] = False
        yield from sums.pieces(counts)

    return sums.summed(rows.select("text").mapInArrow(run, sums.SCHEMA), FEATURES + 1)


def fit(rows: pa.Table, idf: np.ndarray) -> Model:
    """The model of a sample's rows, the same for the same rows in any order."""
    order = np.lexsort((pc.fill_null(rows.column("doc_id"), 0).to_numpy(), rows.column("u").to_numpy()))
    langs = sorted(set(rows.column("lang").to_pylist()))
    y = np.array([langs.index(v) for v in rows.column("lang").to_pylist()])
    at, share = packed(rows.column("at"), np.int32), packed(rows.column("share"), np.float32)
    held = np.zeros(len(y), bool)
    held[order[::5]] = len(y) >= 5 * len(langs)
    x = [(s * idf[a] * SCALE).astype(np.float32) for a, s in zip(at, share, strict=True)]
    model, bias = Ftrl((FEATURES, len(langs)), ALPHA, BETA, L1 / SCALE, L2), Ftrl((1, len(langs)), ALPHA, BETA, 0.0, 0.0)
    one = np.zeros(1, np.int64)
    for _ in range(EPOCHS):
        for i in order:
            if not held[i]:
                w, b = model.at(at[i]), bias.at(one)
                gap = softmax(x[i] @ w + b[0])
                gap[y[i]] -= 1
                model.update(at[i], w, x[i][:, None] * gap)
                bias.update(one, b, gap[None])
    w, b = model.at(slice(None)), bias.at(one)[0]
    logits = np.array([x[i] @ w[at[i]] + b for i in np.flatnonzero(held)])
    truth = y[held]
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in grid] if held.any() else [0.0]
    return langs, (w * idf[:, None] * SCALE).astype(np.float32), b, float(grid[int(np.argmin(loss))]) if held.any() else 1.0


def train(labelled: DataFrame) -> Model | None:
    """From a bounded sample of (doc_id, text, lang); None without rows. The sample's features reach one task only."""
    counts = frequencies(labelled)
    if not counts[-1]:
        return None
    idf = np.log((1 + counts[-1]) / (1 + counts[:-1])) + 1
    sample = vectors(bounded_sample(labelled, F.col("doc_id"), F.col("lang"), SAMPLE, F.octet_length("text"), SAMPLE_BYTES)).withColumn("u", F.xxhash64("doc_id", F.lit(6)))
    shared = labelled.sparkSession.sparkContext.broadcast(idf)

    def run(rows: pa.Table) -> pa.Table:
        langs, w, b, temperature = fit(rows, shared.value)
        return pa.table({"langs": pa.array([langs], pa.list_(pa.string())), "w": pa.array([w.tobytes()], pa.binary()), "b": pa.array([b.tobytes()], pa.binary()), "t": pa.array([temperature], pa.float64())})

    found = sample.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(run, "langs array<string>, w binary, b binary, t double").head()
    if found is None:
        return None
    return found["langs"], np.frombuffer(found["w"], np.float32).reshape(FEATURES, -1), np.frombuffer(found["b"], np.float64), found["t"]


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score) of each row of (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches):
            n = batch.num_rows
            names, score = np.full(n, NONE, object), np.zeros(n)
            if shared.value is not None:
                langs, w, b, temperature = shared.value
                if is_long(batch.column("text")):
                    counts, letter = long_counts(batch.column("text"))
                    total, found, fine = np.maximum(counts.sum(keepdims=True), 1), (counts @ w)[None], np.array([letter])
                else:
                    at, row, chars = features(batch.column("text"))
                    total = np.maximum(np.bincount(row, minlength=n), 1)
                    found = np.stack([np.bincount(row, own[at], n) for own in w.T.copy()], 1)
                    fine = chars.has_letter()
                p = softmax((found / total[:, None] + b) / temperature)
                best = p.argmax(1)
                names[fine], score[fine] = np.array(langs, object)[best[fine]], p.max(1)[fine]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names.tolist(), pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score); the model sees no held-out row."""
    labelled = text_batches(docs).filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    found = predict(docs, train(labelled))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
