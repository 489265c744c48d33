"""Toxicity by cumulative-link ordinal regression on sparse text features.

Severity has four grades: 0 for clean rows and 1 to 3 for toxic ones. Labels only say whether a row is toxic, so toxic
rows of the sample are graded by how many of their words are typical of toxic rows (log odds above ``TYPICAL``), cut at
thirds. One weight vector over hashed words and word beginnings is shared by the ordered thresholds between grades:
P(grade > k) = sigmoid(w x - threshold k). It is trained by follow-the-regularised-leader with elastic-net penalties on
a bounded sample of labelled rows: about ``SAMPLE`` of each label, and rows of about ``SAMPLE_BYTES`` of text.

A row's severity is its expected grade; it is toxic if its score w x reaches a cut. The cut is set over all labelled
rows, from histograms of their scores, each row scored by one of ``FOLDS`` further models that saw no row of its fold.
Rows of a fold without which a label is lacking take no part in that; if all are, the cut is the lowest threshold. The
models are trained beside each other, a task each. Texts are never shuffled: a pass gives each row its scores, which
meet the labels alone.

Defined cases: a text without a word (null and empty ones too) is clean with severity and grade 0, at any cut; without
labels of both kinds every row is clean with severity 0; a document with several labels is toxic if one says so; rows
with null ids are scored as any other; repeated rows are scored alike; a long text is read in pieces; an empty table gives an empty result; further
columns are kept apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qanat.llm.chars import Chars
from qanat.llm.ftrl import Ftrl, bounded_sample, packed
from qanat.llm.words import is_long, row_slices, text_pieces
from qanat.session import checkpointed, small_side, text_batches

PREFIXES, FEATURES, SAMPLE, SAMPLE_BYTES, EPOCHS = (4, 5), 1 << 18, 6000, 64 << 20, 4
ALPHA, BETA, L1, L2 = 0.05, 1.0, 6.0, 0.1
GRADES, TYPICAL, RATE = 4, 3.0, 0.2
#: What a clean row taken for toxic costs, against a toxic one taken for clean, both as shares of their kind.
FALSE_ALARM, FOLDS = 4.0, 3
#: Labelled documents of the sample that are broadcast; more are joined by a shuffle.
CHOSEN = 1_000_000
#: Scores are binned for the cut, from -LIMIT to LIMIT, BINS to one.
LIMIT, BINS = 1024, 64

Model = tuple[np.ndarray, np.ndarray, float]  # weights, thresholds, cut
Models = list[tuple[np.ndarray, np.ndarray] | None]  # weights and thresholds: one without each fold, if the rest has both labels, then that of all rows


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (feature, row), by row, and how often each occurs; a long text is read in pieces that end with its words."""

    def counted(part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        h, row = Chars(part).words(PREFIXES)
        return np.unique(row * FEATURES + (h & np.uint64(FEATURES - 1)).astype(np.int64), return_counts=True)

    if is_long(texts):
        parts = [counted(p) for p in text_pieces(texts)]
        pairs, where = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
        counts = np.bincount(where, np.concatenate([n for _, n in parts]), len(pairs)).astype(np.int64)
    else:
        pairs, counts = counted(texts)
    return pairs % FEATURES, pairs // FEATURES, counts


def vectors(rows: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) -> (doc_id, toxic, at, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches):
            at, row, counts = features(batch.column("text"))
            edges = np.searchsorted(row, np.arange(batch.num_rows + 1))
            pack = lambda v: pa.array([v[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pack(at.astype(np.int32)), pack(counts.astype(np.int32))], ["doc_id", "toxic", "at", "counts"])

    return rows.select("doc_id", "text", "toxic").mapInArrow(run, "doc_id long, toxic int, at binary, counts binary")


def grades(at: list[np.ndarray], counts: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """0 for clean rows; toxic ones by thirds of their number of typical words."""
    seen = [np.bincount(np.concatenate([a for a, t in zip(at, toxic, strict=True) if t == v]), minlength=FEATURES) for v in (0, 1)]
    odds = np.log((seen[1] + 0.5) / (toxic == 1).sum()) - np.log((seen[0] + 0.5) / (toxic == 0).sum())
    typical = (odds > TYPICAL) & (seen[1] >= 3)
    hits = np.array([c[typical[a]].sum(dtype=np.int64) for a, c in zip(at, counts, strict=True)])
    cuts = np.quantile(hits[toxic == 1], [1 / 3, 2 / 3])
    return np.where(toxic == 1, 1 + (hits[:, None] > cuts).sum(1), 0)


def learn(at: list[np.ndarray], y: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds from the rows of order."""
    model = Ftrl((FEATURES,), ALPHA, BETA, L1, L2)
    cuts, squares = np.linspace(0.5, 2.5, GRADES - 1), np.ones(GRADES - 1)
    for _ in range(EPOCHS):
        for i in order:
            w = model.at(at[i])
            above = np.concatenate(([1.0], sigmoid(w.sum() - cuts), [0.0]))  # P(grade >= k)
            slope = above * (1 - above)
            p = max(above[y[i]] - above[y[i] + 1], 1e-9)
            model.update(at[i], w, np.full(len(w), (slope[y[i] + 1] - slope[y[i]]) / p))
            by_cut = np.zeros(GRADES + 1)
            by_cut[y[i]], by_cut[y[i] + 1] = slope[y[i]] / p, -slope[y[i] + 1] / p
            by_cut = np.clip(by_cut[1:-1], -1, 1)
            squares += by_cut**2
            cuts = np.maximum.accumulate(cuts - RATE * by_cut / np.sqrt(squares))
    return model.at(slice(None)), cuts


def fit(rows: pa.Table) -> tuple[np.ndarray, np.ndarray] | None:
    """Weights and thresholds from a sample's rows, the same in any order; None without both labels."""
    order = np.argsort(rows.column("u").to_numpy(), kind="stable")
    toxic = rows.column("toxic").to_numpy()
    if len(set(toxic.tolist())) < 2:
        return None
    at, counts = packed(rows.column("at"), np.int32), packed(rows.column("counts"), np.int32)
    w, cuts = learn(at, grades(at, counts, toxic), order)
    return w.astype(np.float32), cuts


def fold() -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(FOLDS)).cast("int")


def named(labels: DataFrame) -> DataFrame:
    return labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))


def fitted(docs: DataFrame, labels: DataFrame) -> Models | None:
    """All models from a bounded sample of the labelled documents; None without labels of both kinds."""
    sizes = docs.filter("text is not null").select("doc_id", F.octet_length("text").alias("size"))
    chosen = checkpointed(bounded_sample(sizes.join(named(labels), "doc_id"), F.col("doc_id"), F.col("toxic"), SAMPLE, F.col("size"), SAMPLE_BYTES).select("doc_id", "toxic").distinct())
    sample = vectors(docs.select("doc_id", "text").filter("text is not null").join(small_side(chosen, CHOSEN), "doc_id"))
    parts = F.filter(F.sequence(F.lit(0), F.lit(FOLDS)), lambda p: p != fold())
    dealt = sample.withColumn("u", F.xxhash64("doc_id", F.lit(6))).withColumn("part", F.explode(parts)).repartition(16, "part")  # the parts meet in tasks of their own

    def run(rows: pa.Table) -> pa.Table:
        found = fit(rows)
        own = [] if found is None else [(rows.column("part")[0].as_py(), found[0].tobytes(), found[1].tolist())]
        return pa.table({"part": pa.array([o[0] for o in own], pa.int32()), "w": pa.array([o[1] for o in own], pa.binary()), "cuts": pa.array([o[2] for o in own], pa.list_(pa.float64()))})

    found = {r["part"]: (np.frombuffer(r["w"], np.float32), np.array(r["cuts"])) for r in dealt.groupBy("part").applyInArrow(run, "part int, w binary, cuts array<double>").collect()}  # FOLDS + 1 models
    return [found.get(p) for p in range(FOLDS + 1)] if FOLDS in found else None


def scores(texts: pa.Array, weights: list[np.ndarray], used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether a text has words, scores by text and model); ``used`` marks the features with a weight in any model."""
    n = len(texts)

    def weighty(part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs of row and used feature, and whether each row has words."""
        h, row = Chars(part).words(PREFIXES)
        at = (h & np.uint64(FEATURES - 1)).astype(np.int64)
        heavy = used[at]
        return np.unique(row[heavy] * FEATURES + at[heavy]), np.bincount(row, minlength=n) > 0

    if is_long(texts):
        parts = [weighty(p) for p in text_pieces(texts)]
        pairs, words = np.unique(np.concatenate([p for p, _ in parts])), np.any([w for _, w in parts], axis=0)
    else:
        pairs, words = weighty(texts)
    return words, np.stack([np.bincount(pairs // FEATURES, w[pairs % FEATURES], n) for w in weights], 1)


def out_of_fold(docs: DataFrame, models: Models) -> DataFrame:
    """(doc_id, score) of each row with words, by the model that saw no row of its fold; rows of a fold without one are left out."""
    there = [p for p in range(FOLDS) if models[p] is not None]
    shared = docs.sparkSession.sparkContext.broadcast([models[p][0] for p in there])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = np.any(shared.value, axis=0)
        for batch in row_slices(batches):
            words, found = scores(batch.column("text"), shared.value, used)
            at = np.flatnonzero(words)
            own = found[at, np.searchsorted(there, batch.column("fold").to_numpy()[at])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at)), pa.array(own, pa.float64())], ["doc_id", "score"])

    return docs.filter(F.col("doc_id").isNotNull() & fold().isin(there)).select("doc_id", "text", fold().alias("fold")).mapInArrow(run, "doc_id long, score double")


def set_cut(bins: np.ndarray, toxic: np.ndarray, counts: np.ndarray) -> float:
    """The cut of least cost, the middle of the best range, from counts of rows by the bin of their score and their label."""
    order = np.argsort(bins, kind="stable")
    bins, toxic, counts = bins[order], toxic[order], counts[order]
    values, first = np.unique(bins, return_index=True)
    totals = [np.concatenate(([0], np.cumsum(np.add.reduceat(np.where(toxic == v, counts, 0), first)))) for v in (0, 1)]
    cost = FALSE_ALARM * (1 - totals[0] / max(1, totals[0][-1])) + totals[1] / max(1, totals[1][-1])  # of a cut below the bin, and of one above all
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    edges = np.concatenate((values[:1] - 1.0, (values[1:] + values[:-1] + 1) / 2, values[-1:] + 2.0)) / BINS
    return float((edges[best[0]] + edges[best[-1]]) / 2)


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fitted on a bounded sample, its cut set over all labelled documents; None without labels of both kinds."""
    models = fitted(text_batches(docs), labels)
    if models is None:
        return None
    if not any(models[:FOLDS]):
        return *models[FOLDS], float(models[FOLDS][1][0])
    bin_ = F.floor(F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.col("score"))) * BINS).alias("bin")
    cells = out_of_fold(docs, models).join(named(labels), "doc_id").groupBy(bin_, "toxic").agg(F.count("*").alias("n")).toArrow()  # 4 * LIMIT * BINS rows at most
    return *models[FOLDS], set_cut(*(cells.column(c).to_numpy() for c in ("bin", "toxic", "n"))) if cells.num_rows else float(models[FOLDS][1][0])


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with severity (0 to 3), grade and toxic; all their columns are kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["_severity", "_grade", "_toxic"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches):
            n = batch.num_rows
            severity, grade, toxic = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, bool)
            if shared.value is not None:
                w, cuts, cut = shared.value
                words, found = scores(batch.column("text"), [w], w != 0)
                above = sigmoid(found - cuts)
                p = np.concatenate((np.ones((n, 1)), above), 1) - np.concatenate((above, np.zeros((n, 1))), 1)
                severity, grade, toxic = np.where(words, above.sum(1), 0.0), np.where(words, p.argmax(1), 0), words & (found[:, 0] >= cut)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(severity, pa.float64()), pa.array(grade, pa.int32()), pa.array(toxic, pa.bool_())], [*batch.schema.names, *names])

    added = [T.StructField(n, t) for n, t in zip(names, (T.DoubleType(), T.IntegerType(), T.BooleanType()), strict=True)]
    schema = T.StructType([*docs.schema.fields, *added])
    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, severity, grade, toxic) of each row."""
    found = score(docs.select("doc_id", "text"), train(docs, labels))
    return found.select("doc_id", F.col("_severity").alias("severity"), F.col("_grade").alias("grade"), F.col("_toxic").alias("toxic"))


def clean_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that are not toxic, with their columns."""
    return score(docs, train(docs, labels)).filter("not _toxic").select([f"`{c}`" for c in docs.columns])
