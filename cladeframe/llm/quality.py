"""Quality classifier: regularised quadratic discriminant analysis.

Every text becomes a vector of transformed statistics.  Each class is a Gaussian
whose covariance is shrunk towards the pooled one and towards its own mean
variance; the score is the logistic of the difference of log densities, whose
Mahalanobis terms use Cholesky factors computed once at the fit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from cladeframe.llm.common import chunks, give_back, map_texts
from cladeframe.llm.labelled import MAX_TRAINING_ROWS, training_rows

STATISTICS = ("log_words", "log_word_length", "upper", "digits", "symbols", "bars", "stops", "distinct", "repeats",
              "distinct_pairs", "short_words", "marked_words", "sentence_length", "line_length", "repeated_lines",
              "longest_word", "top_word", "marks", "alphabet")

# byte classes: lower, upper, digit, white space, sentence stops and commas, word marks, bars and bullets, others, beyond ASCII
_CLASS = np.full(256, 7, dtype=np.uint8)
for _chars, _value in (("abcdefghijklmnopqrstuvwxyz", 0), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), ("0123456789", 2),
                       (" \t\n\r\x0b\x0c", 3), (".,;:?", 4), ("'\"()-", 5), ("|*#", 6)):
    _CLASS[[ord(c) for c in _chars]] = _value
_CLASS[128:] = 8


def _share(part: float, whole: float) -> float:
    """Square root of a share: spreads out the small ones."""
    return (part / whole) ** 0.5 if whole else 0.0


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text (null: empty)."""
    raw = (text or "").encode()
    low, up, dig, _, stop, mark, bar, sym, wide = np.bincount(
        _CLASS[np.frombuffer(raw, dtype=np.uint8)], minlength=9).tolist()
    words = (text or "").split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    lengths = list(map(len, words))
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:]))) if n > 1 else 1
    again = sum(map(str.__eq__, words, words[1:]))
    lines = text.split("\n")
    letters, size = low + up + wide / 2, len(raw)
    ends = text.count(". ") + text.count(".\n") + text.endswith(".")
    plain = sum(map(str.isalpha, words))
    return [
        np.log1p(n), np.log1p(sum(lengths) / n), _share(up, letters), _share(dig, size), _share(sym, size),
        _share(bar, size), _share(stop, size), _share(len(seen), n), _share(again, n), _share(pairs, max(n - 1, 1)),
        sum(x <= 3 for x in lengths) / n, _share(n - plain, n), np.log1p(n / (ends + 1)), np.log1p(n / len(lines)),
        _share(len(lines) - len(set(lines)), len(lines)), np.log1p(max(lengths)), _share(max(seen.values()), n),
        _share(mark, size), np.log1p(len(seen))]


@dataclass
class Quadratic:
    """Two shrunk Gaussians: means, inverse Cholesky factors and log terms."""

    mean: np.ndarray  # 2 x d
    whiten: np.ndarray  # 2 x d x d, so that |whiten (x - mean)|^2 is the Mahalanobis distance
    constant: np.ndarray  # log prior - half the log determinant
    scale: float  # of the log-density difference, from the training rows

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, to_pooled: float = 0.1, to_round: float = 0.02) -> Quadratic:
        """Class covariances: (1 - a - b) own + a pooled + b (mean variance) identity.

        A class without rows gets the other's mean and the pooled covariance; without
        any rows all texts score one half.
        """
        d = x.shape[1]
        n = np.array([(y == k).sum() for k in (0, 1)], dtype=float)
        center = x.mean(axis=0) if len(x) else np.zeros(d)
        mean = np.stack([x[y == k].mean(axis=0) if n[k] else center for k in (0, 1)])
        scatter = [(x[y == k] - mean[k]).T @ (x[y == k] - mean[k]) for k in (0, 1)]
        pooled = sum(scatter) / max(n.sum(), 1)
        whiten, constant = [], []
        for k in (0, 1):
            own = scatter[k] / n[k] if n[k] > d else pooled
            cov = (1 - to_pooled - to_round) * own + to_pooled * pooled
            # the identity in units of each statistic's pooled variance
            cov = cov + to_round * np.diag(np.diag(pooled)) + 1e-6 * np.eye(d)
            factor = np.linalg.cholesky(cov)
            whiten.append(np.linalg.inv(factor))
            constant.append(np.log((n[k] + 1) / (n.sum() + 2)) - np.log(np.diag(factor)).sum())
        model = cls(mean, np.stack(whiten), np.array(constant), 1.0)
        if n.min() > 0:
            model.scale = _temperature(model.difference(x), y)
        return model

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 minus that of class 0."""
        log = [c - 0.5 * (((x - m) @ w.T) ** 2).sum(axis=1)
               for m, w, c in zip(self.mean, self.whiten, self.constant)]
        return log[1] - log[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.difference(x), -500, 500)))


def _temperature(z: np.ndarray, y: np.ndarray) -> float:
    """Scale of the log odds with the least log loss (a grid; the sign never turns)."""
    grid = 2.0 ** np.arange(-6, 1.01, 0.25)
    sign = np.where(y == 1, 1.0, -1.0)
    return float(min(grid, key=lambda s: np.logaddexp(0, -s * z * sign).mean()))


def fit_quality(docs: DataFrame, labels: DataFrame, fold: Column | None = None, bound: int = MAX_TRAINING_ROWS,
                id_col: str = "doc_id", text_col: str = "text") -> Quadratic:
    """Fit on at most ``bound`` labelled documents (see :func:`training_rows`)."""

    def stats(batch):
        x = [statistics(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["label", "x"])

    rows = map_texts(training_rows(docs, labels, "quality", fold, bound, id_col, text_col), stats,
                     "label int, x array<double>").toArrow()
    x = np.array(rows["x"].to_pylist(), dtype=float).reshape(-1, len(STATISTICS))
    return Quadratic.fit(x, np.asarray(rows["label"], dtype=int))


def score_quality(docs: DataFrame, model: Quadratic, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """All columns of ``docs`` and ``quality_score`` (0 to 1) and ``quality_predicted`` (0 or 1).

    Null and empty texts score as texts without words; nothing but the text is used.  One
    row per input row, so repeated rows score alike and an empty table gives none.
    Columns of ``docs`` with these two names, in any case, are replaced; ``keep_rows`` goes
    around that.
    """
    docs = docs.drop("quality_score", "quality_predicted")
    fields = [*docs.schema.fields]

    def run(batches):
        for batch in batches:
            for part in chunks(batch, text_col):
                x = np.array([statistics(t) for t in part.column(text_col).to_pylist()]).reshape(-1, len(STATISTICS))
                s = model.score(x)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(s), pa.array((s >= threshold).astype("int32"))],
                    [*part.schema.names, "quality_score", "quality_predicted"])
        give_back()

    schema = StructType([*fields, StructField("quality_score", DoubleType()), StructField("quality_predicted", IntegerType())])
    return docs.mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, fold: Column | None = None,
                   bound: int = MAX_TRAINING_ROWS) -> DataFrame:
    """``doc_id, score, predicted`` of every document, one row per input row."""
    model = fit_quality(docs, labels, fold, bound)
    return score_quality(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model).select(
        "doc_id", F.col("quality_score").alias("score"), F.col("quality_predicted").alias("predicted"))
