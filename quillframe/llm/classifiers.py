"""Text classifiers on hashed features: quality (FTRL logistic regression) and toxicity (ordinal regression).

Both are fitted in one task on at most ``max_rows`` labelled rows (a documented bound, the rows with the
smallest hash of their id) and scored as sparse dot products with one weight array of
fixed size, over every row of the table: a narrow operation on whole texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm.textblocks import LETTERS, VISIBLE, blocks, ngram_hashes, word_hashes

MAX_ROWS = 12_000
BITS = 18


def quality_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashed unigrams and bigrams of each document, words as white space separates them, case and punctuation kept.

    All bigrams of one word twice share a feature, whatever the word.
    """
    words, bounds = word_hashes(data, offsets, VISIBLE)
    two, two_bounds = ngram_hashes(words, bounds, 2)
    if len(two):
        at = np.arange(len(two)) + np.repeat(bounds[:-1] - two_bounds[:-1], np.diff(two_bounds))
        two[words[at] == words[at + 1]] = np.uint64(1) << np.uint64(63)
    doc = np.concatenate([np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), np.repeat(np.arange(len(bounds) - 1), np.diff(two_bounds))])
    slot = (np.concatenate([words, two]) >> np.uint64(64 - BITS)).astype(np.int64)
    return _distinct(slot, doc, len(bounds) - 1)


def toxicity_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashed words of each document, letters only, in lower case."""
    words, bounds = word_hashes(data, offsets, LETTERS)
    return _distinct((words >> np.uint64(64 - BITS)).astype(np.int64), np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), len(bounds) - 1)


def _distinct(slot: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, count = np.unique((doc << BITS) | slot, return_counts=True)
    return key & ((1 << BITS) - 1), np.searchsorted(key >> BITS, np.arange(n + 1)), count


#: (slots, bounds of the documents in them, how often each occurs) of a block.
Features = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _rows(batches: Iterator[pa.RecordBatch]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    slots: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    labels: list[int] = []
    for batch in batches:
        slots += [np.frombuffer(x, np.int32) for x in batch.column(1).to_pylist()]
        counts += [np.frombuffer(x, np.int32) for x in batch.column(2).to_pylist()]
        labels += batch.column(0).to_pylist()
    return slots, counts, np.array(labels, np.int64)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, features: Features, lower: bool, max_rows: int, id_col: str, text_col: str) -> DataFrame:
    """(label, slots, counts): the labelled rows with the smallest hash of their id, ties by id; null ids, labels and texts are left out.

    Where an id has several labels the largest counts; where several rows have one id, each is a row.
    """
    chosen = labels.select(F.col(id_col).cast("long").alias("i"), F.col(label).cast("int").alias("label")).where("i is not null and label is not null")
    chosen = chosen.groupBy("i").agg(F.max("label").alias("label")).orderBy(F.xxhash64("i"), "i").limit(max_rows)  # at most max_rows ids: small enough to broadcast
    texts = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("text")).where("i is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in blocks(batch.column(2), lower):
                slots, bounds, counts = features(data, offsets)
                binary = [pa.array([x[a:b].astype(np.int32).tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary()) for x in (slots, counts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first), *binary], names=["i", "label", "slots", "counts"])

    joined = texts.join(F.broadcast(chosen), "i").select("i", "label", "text").mapInArrow(run, "i long, label int, slots binary, counts binary")
    return joined.repartition(1).sortWithinPartitions(F.xxhash64("i"), "i", "slots").select("label", "slots", "counts")


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    bias: float

    def score(self, slots: np.ndarray, bounds: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Probability of good quality: the dot product with each document's unit vector of 1 + log(count), and the bias."""
        x = 1 + np.log(counts)
        sums = np.concatenate([[0.0], np.cumsum(self.weights[slots] * x)])
        norms = np.concatenate([[0.0], np.cumsum(x * x)])
        z = (sums[bounds[1:]] - sums[bounds[:-1]]) / np.sqrt(np.maximum(norms[bounds[1:]] - norms[bounds[:-1]], 1)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def ftrl(slots: list[np.ndarray], counts: list[np.ndarray], y: np.ndarray, epochs: int = 5, alpha: float = 3.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01) -> QualityModel:
    """Follow the regularised leader (proximal), one example after the other, in the given order."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def solve(k: np.ndarray) -> np.ndarray:
        zk = z[k]
        return np.where(np.abs(zk) <= l1, 0.0, -(zk - np.sign(zk) * l1) / ((beta + np.sqrt(n[k])) / alpha + l2))

    for _ in range(epochs):
        for s, c, target in zip(slots, counts, y.tolist()):
            k, x = np.append(s, size), 1 + np.log(c)
            x = np.append(x / np.sqrt(max(x @ x, 1)), 1.0)
            w = solve(k)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - target) * x
            sigma = (np.sqrt(n[k] + g * g) - np.sqrt(n[k])) / alpha
            z[k] += g - sigma * w
            n[k] += g * g
    w = solve(np.arange(size + 1))
    return QualityModel(w[:-1].astype(np.float32), float(w[-1]))


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Fit on labels.quality (1 good, 0 bad). Without labelled rows of both classes every text scores as that class, or 1 without any."""
    rows = training_rows(docs, labels, "quality", quality_features, False, max_rows, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, counts, y = _rows(batches)
        if len(np.unique(y > 0)) == 2:
            m = ftrl(slots, counts, (y > 0).astype(np.int64))
        else:
            m = QualityModel(np.zeros(1 << BITS, np.float32), 35.0 if not len(y) or y[0] > 0 else -35.0)
        yield pa.RecordBatch.from_arrays([pa.array([m.weights.tobytes()], pa.binary()), pa.array([m.bias])], names=["w", "b"])

    found = rows.mapInArrow(run, "w binary, b double").collect()
    if not found:  # an empty table may have no task at all
        return QualityModel(np.zeros(1 << BITS, np.float32), 35.0)
    return QualityModel(np.frombuffer(bytes(found[0]["w"]), np.float32), found[0]["b"])


@dataclass(frozen=True)
class SeverityModel:
    """P(grade >= k) = sigmoid(w x - thresholds[k - 1]): one weight array for all the ordered thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def at_least(self, slots: np.ndarray, bounds: np.ndarray, _counts: np.ndarray | None = None) -> np.ndarray:
        """documents x thresholds; features count once, however often they occur."""
        sums = np.concatenate([[0.0], np.cumsum(self.weights[slots].astype(np.float64))])
        z = (sums[bounds[1:]] - sums[bounds[:-1]])[:, None] - self.thresholds[None, :]
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


GRADES = 3
MARKER_LOG_ODDS, MARKER_DOCS = 3.0, 3


def log_odds(slots: list[np.ndarray], bad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed log odds of each feature in the bad rows against the others, and its number of bad rows."""
    size = 1 << BITS
    pos = np.bincount(np.concatenate([np.zeros(0, np.int64), *(s for s, b in zip(slots, bad) if b)]), minlength=size)
    neg = np.bincount(np.concatenate([np.zeros(0, np.int64), *(s for s, b in zip(slots, bad) if not b)]), minlength=size)
    return np.log((pos + 0.5) / (bad.sum() - pos + 0.5)) - np.log((neg + 0.5) / ((~bad).sum() - neg + 0.5)), pos


def severity_grades(slots: list[np.ndarray], toxic: np.ndarray, grades: int = GRADES, graded: bool | None = None) -> np.ndarray:
    """Grades 0..grades. Labels that are ``graded`` (by default, if any is over 1) are used as they are, negative ones as 0.

    Where labels only say toxic or not, the toxic rows are graded by how many distinct markers they hold,
    cut at the quantiles of that number; equal numbers have equal grades. A marker is a feature of at least
    MARKER_DOCS toxic rows whose smoothed log odds against the other rows reach MARKER_LOG_ODDS.
    """
    if (toxic > 1).any() if graded is None else graded:
        return np.clip(toxic, 0, None)
    bad = toxic > 0
    if not bad.any() or bad.all():
        return bad.astype(np.int64)
    odds, pos = log_odds(slots, bad)
    marker = (odds >= MARKER_LOG_ODDS) & (pos >= MARKER_DOCS)
    count = np.array([marker[s].sum() for s in slots])
    cuts = np.quantile(count[bad], np.arange(1, grades) / grades)
    return np.where(bad, 1 + (count[:, None] > cuts[None, :]).sum(axis=1), 0)


def fit_ordinal(slots: list[np.ndarray], grade: np.ndarray, steps: int = 100_000, alpha: float = 0.5, beta: float = 1.0, l1: float = 2.0, l2: float = 0.0, least_odds: float = 1.5) -> SeverityModel:
    """Cumulative logits by proximal adaptive gradient steps.

    Features whose log odds between grade 0 and the others stay under ``least_odds`` either way, as those
    of the common words of a language do, and those that L1 outweighs have zero weight: a long text
    doesn't gather a score from words of no account. The rows are gone through as often as it takes for
    ``steps`` steps.
    """
    levels = int(grade.max()) if len(grade) else 0
    if levels == 0:
        return SeverityModel(np.zeros(1 << BITS, np.float32), np.full(1, 35.0))
    size = 1 << BITS
    odds, pos = log_odds(slots, grade > 0)
    told = np.abs(odds) >= least_odds
    slots = [s[told[s]] for s in slots]
    z, n = np.zeros(size), np.zeros(size)
    share = np.array([(grade >= k).mean() for k in range(1, levels + 1)])
    theta = np.maximum.accumulate(-np.log(np.clip(share, 1e-3, 0.999) / (1 - np.clip(share, 1e-3, 0.999))) + 1e-3 * np.arange(levels))
    step = np.ones(levels)
    for _ in range(-(-steps // len(slots))):
        for s, y in zip(slots, grade.tolist()):
            zs = z[s]
            w = np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(n[s])) / alpha + l2))
            # log(P(grade >= y) - P(grade >= y + 1)): each neighbouring threshold pulls by what it is off
            p = 1 / (1 + np.exp(-np.clip(w.sum() - theta, -35, 35)))
            pull = np.zeros(levels)
            if y:
                pull[y - 1] = p[y - 1] - 1
            if y < levels:
                pull[y] = p[y]
            g = pull.sum()
            sigma = (np.sqrt(n[s] + g * g) - np.sqrt(n[s])) / alpha
            z[s] += g - sigma * w
            n[s] += g * g
            step += pull * pull
            theta = np.maximum.accumulate(theta + 0.3 * pull / np.sqrt(step))
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    return SeverityModel(w.astype(np.float32), theta)


def fit_severity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> SeverityModel:
    """Fit on labels.toxic (0 for clean, 1 or grades above). Without labelled rows, or toxic ones, every text is clean.

    Labels are grades if any label of the whole table is over 1, whichever rows are fitted on.
    """
    graded = (labels.agg(F.max(F.col("toxic").cast("int"))).collect()[0][0] or 0) > 1
    rows = training_rows(docs, labels, "toxic", toxicity_features, True, max_rows, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, _, toxic = _rows(batches)
        m = fit_ordinal(slots, severity_grades(slots, toxic, graded=graded))
        yield pa.RecordBatch.from_arrays([pa.array([m.weights.tobytes()], pa.binary()), pa.array([m.thresholds.tolist()], pa.list_(pa.float64()))], names=["w", "t"])

    found = rows.mapInArrow(run, "w binary, t array<double>").collect()
    if not found:
        return SeverityModel(np.zeros(1 << BITS, np.float32), np.full(1, 35.0))
    return SeverityModel(np.frombuffer(bytes(found[0]["w"]), np.float32), np.array(found[0]["t"]))


def quality_column(docs: DataFrame, model: QualityModel, text_col: str = "text") -> Column:
    """The score of each row, null for a null text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        column = pa.array(text, pa.string(), from_pandas=True)
        parts = [sent.value.score(*quality_features(data, offsets)) for _, _, data, offsets in blocks(column, False)]
        return pd.Series(np.concatenate([np.zeros(0), *parts]), index=text.index).where(text.notna())

    return score(F.col(text_col).cast("string"))


def severity_column(docs: DataFrame, model: SeverityModel, text_col: str = "text") -> Column:
    """P(grade >= k) for each k, an array; null for a null text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def score(text: pd.Series) -> pd.Series:
        column = pa.array(text, pa.string(), from_pandas=True)
        parts = [sent.value.at_least(*toxicity_features(data, offsets)) for _, _, data, offsets in blocks(column, True)]
        return pd.Series([p if ok else None for p, ok in zip([r for part in parts for r in part], text.notna())], index=text.index, dtype=object)

    return score(F.col(text_col).cast("string"))


#: Chosen on held-out labels: a clean document is rarely lost.
KEEP_QUALITY, REJECT_TOXIC = 0.4, 0.2


def quality_scores(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, keep: float = KEEP_QUALITY) -> DataFrame:
    """``doc_id, score, kept``, one row for each row of docs: kept where the score is at least ``keep``.

    An empty text has the bias alone as its score. A null text has a null score and isn't kept. Null and
    repeated ids are scored row for row; other columns are ignored.
    """
    model = fit_quality(docs, labels, max_rows)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), quality_column(docs, model).alias("score"))
    return out.withColumn("kept", F.coalesce(F.col("score") >= keep, F.lit(False)))


def toxicity_grades(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, reject: float = REJECT_TOXIC) -> DataFrame:
    """``doc_id, p_toxic, severity, grade, rejected``, one row for each row of docs.

    p_toxic is P(grade >= 1), severity the expected grade (the sum of P(grade >= k)); rejected where p_toxic is
    at least ``reject``. grade agrees with that: 0 where a row isn't rejected, else the most likely of the
    grades from 1 on (the lowest of equal ones). An empty text has the thresholds alone. A null text has nulls
    and isn't rejected. Null and repeated ids: row for row.
    """
    model = fit_severity(docs, labels, max_rows)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), severity_column(docs, model).alias("p"))
    k = len(model.thresholds)
    at_least = [*(F.col("p")[i] for i in range(k)), F.lit(0.0)]
    exactly = F.array(*(a - b for a, b in zip(at_least, at_least[1:])))
    rejected = F.coalesce(F.col("p")[0] >= reject, F.lit(False))
    return out.select(
        "doc_id",
        F.col("p")[0].alias("p_toxic"),
        F.aggregate("p", F.lit(0.0), lambda s, x: s + x).alias("severity"),
        F.when(rejected, F.array_position(exactly, F.array_max(exactly)).cast("int")).when(F.col("p").isNotNull(), 0).alias("grade"),
        rejected.alias("rejected"),
    )


def keep_clean(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, reject: float = REJECT_TOXIC) -> DataFrame:
    """The rows of docs that aren't rejected as toxic, all columns as they are.

    Rows with a null text stay; empty texts by the thresholds alone, which clean labels keep; repeated rows and ids
    each by its own text; ties with ``reject`` go. An empty table stays empty.
    """
    p = severity_column(docs, fit_severity(docs, labels, max_rows))[0]
    return docs.where(F.coalesce(p < reject, F.lit(True)))


def keep_good(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, keep: float = KEEP_QUALITY) -> DataFrame:
    """The rows of docs with a score of at least ``keep``, all columns as they are.

    Rows with a null text go; empty texts by the bias alone; repeated rows and ids each by its own text; ties with
    ``keep`` stay. An empty table stays empty.
    """
    return docs.where(F.coalesce(quality_column(docs, fit_quality(docs, labels, max_rows)) >= keep, F.lit(False)))
