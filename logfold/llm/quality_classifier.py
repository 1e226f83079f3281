"""Quality of texts by regularised quadratic discriminant analysis.

Every text becomes a vector of transformed statistics. Each class has the mean and covariance of its
labelled vectors; covariances are shrunk towards their diagonal. A score is the posterior
probability of class 1, from the difference of the log-densities: Mahalanobis distances by Cholesky
factors that are computed once. Moments are sums over all labelled rows that Spark builds; only
two means and two small matrices reach the driver.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logfold.llm.arrow import pieces
from logfold.llm.common import small_batches, stored, text_of

FEATURES = [
    "log_words", "word_length", "upper", "symbols", "shouts", "digits", "bars", "ends", "distinct", "repeats", "lines", "commas", "other",
]
SHRINKAGE = 0.1
FLOOR = 1e-3
THRESHOLD = 0.3
_CLASS = np.zeros(256, np.int64)
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#*$%&<>{}\\^~=_", b"!", b"0123456789", b"|", b",", b".?;:", b"\n", b" \t\r\x0b\x0c", b"abcdefghijklmnopqrstuvwxyz"), 1):
    _CLASS[list(_chars)] = _i


def statistics(text: str) -> list[float]:
    """The vector of one text; shares are taken to their square roots, counts to logarithms."""
    data = text.encode("utf-8", "replace")
    n = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=11)
    words = data.split()
    count = max(len(words), 1)
    lines = [x for x in data.split(b"\n") if x.strip()]
    letters = max(int(n[1] + n[10]), 1)
    root = lambda part, whole: float(np.sqrt(min(part / max(whole, 1), 4.0)))
    closed = sum(x.rstrip()[-1:] in b".!?:;\"'" for x in lines)
    return [
        float(np.log1p(len(words))), float(np.log1p(sum(map(len, words)) / count)), root(n[1], letters), root(n[2], count),
        root(n[3], count), root(n[4], count), root(n[5], count), root(closed, len(lines)),
        root(len(set(words)), count), root(len(lines) - len(set(lines)), len(lines)),
        float(np.log1p(count / max(len(lines), 1))), root(n[6] + n[7], count), root(n[0], len(data)),
    ]


def features(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, FEATURES) of every row, whole texts; null counts as empty."""

    def run(batches):
        for batch in pieces(batches, "_text"):
            rows = np.array([statistics(t) for t in batch.column("_text").to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *map(pa.array, np.ascontiguousarray(rows.T))], ["_id", *FEATURES])

    small_batches(docs.sparkSession)
    source = docs.select(F.col(id).cast("bigint").alias("_id"), text_of(text).alias("_text"))
    return source.mapInArrow(run, "_id bigint, " + ", ".join(f"{f} double" for f in FEATURES))


class Model:
    """Means, Cholesky factors and log-weights of both classes; a class that was never seen has none."""

    def __init__(self, moments: dict[int, tuple[int, np.ndarray, np.ndarray]], shrinkage: float = SHRINKAGE):
        total = sum(n for n, _, _ in moments.values())
        self.classes = {}
        for label, (n, sums, squares) in moments.items():
            mean = sums / n
            spread = squares / n - np.outer(mean, mean)
            diagonal = np.diag(np.maximum(np.diag(spread), 0))
            shrunk = (1 - shrinkage) * spread + shrinkage * diagonal + FLOOR * np.eye(len(mean))
            factor = np.linalg.cholesky(shrunk)
            self.classes[label] = mean, np.linalg.inv(factor), np.log(n / total) - np.log(np.diag(factor)).sum()

    def scores(self, x: np.ndarray) -> np.ndarray:
        logs = {}
        for label, (mean, inverse, weight) in self.classes.items():
            logs[label] = weight - 0.5 * (((x - mean) @ inverse.T) ** 2).sum(axis=1)
        if len(logs) < 2:
            return np.full(len(x), float(1 in logs) if logs else 0.5)
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def fit(vectors: DataFrame, labels: DataFrame, id: str = "doc_id", label: str = "quality") -> Model:
    """Learn from all vectors with a label of 0 or 1; an id with several labels counts with each."""
    marked = labels.filter(F.col(label).isin(0, 1)).select(F.col(id).cast("bigint").alias("_id"), F.col(label).cast("int").alias("_label"))
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = [F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)]
    squares = [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"q{i}_{j}") for i, j in pairs]
    moments = {}
    for row in vectors.join(marked, "_id").groupBy("_label").agg(F.count(F.lit(1)).alias("n"), *sums, *squares).collect():
        matrix = np.zeros((d, d))
        for i, j in pairs:
            matrix[i, j] = matrix[j, i] = row[f"q{i}_{j}"]
        moments[row["_label"]] = row["n"], np.array([row[f"s{i}"] for i in range(d)]), matrix
    return Model(moments)


def held_out(id: Column) -> Column:
    """Rows whose labels are kept from learning."""
    return F.coalesce(F.crc32(id.cast("string")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality",
             threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    Labels of held-out rows are not used. Empty texts are scored like others. Without any label the score is
    0.5, with labels of one class only it is that class. Repeated rows are scored alike; a null id is scored
    and not held out. Only id and text are read. An empty table gives no rows.
    """
    vectors = stored(features(docs, id, text), "features")
    model = fit(vectors, labels.filter(~held_out(F.col(id))), id, label)

    def run(batches):
        for batch in batches:
            x = np.column_stack([np.asarray(batch.column(f)) for f in FEATURES])
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(model.scores(x))], ["_id", "score"])

    scored = vectors.mapInArrow(run, "_id bigint, score double")
    return scored.select(
        F.col("_id").alias(id), held_out(F.col("_id")).alias("held_out"), "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
