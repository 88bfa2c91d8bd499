"""Quality classifier: random Fourier features over document statistics, ridge, isotonic calibration.

Each whole text gives a fixed vector of statistics (``STATS``). Standardised, it is mapped by
random cosine features whose inner products approximate a Gaussian kernel. Tasks sum the normal
equations of the labelled rows, one set per fold; the driver adds the sums and solves them. Scores
of each fold by a model that has not seen it are counted in a fixed number of bins, and isotonic
regression over the bins calibrates the final score.

Only texts and the labels of learning rows enter the model; a row learns if the crc32 of its id as
text, modulo 5, is not 0. All labelled learning rows are used.

Edge cases: a null text is an empty one and gets a score like any other; very long texts are read
whole; several labels of an id count as their mean, and a repeated id learns with each of its rows;
null labels and labels of unknown documents are ignored; texts with the same statistics tie in
score; without labels every score is 0.5; repeated rows each get a row; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import Workspace, fold_of, text_of

STATS = (
    "log_chars", "log_words", "word_mean", "word_sd", "unique_words", "log_line_mean", "unique_lines", "non_ascii",
    "upper", "digits", "space", "stops", "commas", "bangs", "pipes", "symbols", "odd_ends", "long_words", "entropy",
)
FEATURES = 192
RIDGE = 1e-3
SEED = 20_240_601
FOLDS = (1, 2, 3, 4)
BINS = 2_048
SUM_TASKS, SPLITS_PER_TASK = 32, 16  # at most so many tasks sum equations while there are few splits
LIMIT = 6.0  # standardised statistics are held within this range
KEEP_SCORE = 0.3
_SYMBOLS = np.frombuffer(b"#$%&*~^<>{}[]\\@_=+`", dtype=np.uint8)
_ODD = frozenset("#$%&*|~^!?=+@")


def statistics_of(text: str) -> list[float]:
    """The values of ``STATS`` for one text; zeros for an empty one."""
    if not text:
        return [0.0] * len(STATS)
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    seen = np.bincount(raw, minlength=256)
    size = len(raw)
    words = text.split()
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1, dtype=np.int64)
    lines = [x for x in text.split("\n") if x.strip()]
    letters = max(1, int(seen[65:91].sum() + seen[97:123].sum()))
    p = seen[seen > 0] / size
    share = lambda k: float(k) / size
    return [
        math.log1p(size), math.log1p(len(words)), float(lengths.mean()), float(lengths.std()), len(set(words)) / n,
        math.log1p(size / max(1, len(lines))), len(set(lines)) / max(1, len(lines)), share(seen[128:].sum()),
        float(seen[65:91].sum()) / letters, share(seen[48:58].sum()), share(seen[32] + seen[9:14].sum()), float(seen[46]) / n,
        float(seen[44]) / n, float(seen[33] + seen[63]) / n, float(seen[124]) / n, float(seen[_SYMBOLS].sum()) / n,
        sum(w[-1] in _ODD for w in words) / n, float((lengths > 14).sum()) / n, float(-(p * np.log2(p)).sum()),
    ]


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each row's whole text as ``s``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics_of(v.as_py()) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "s"])

    rows = docs.select("doc_id", text_of().alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, s array<double>")


class Model:
    """Standardisation, cosine features, weights and the calibration; small and of fixed size."""

    def __init__(self, mean, sd):
        rng = np.random.default_rng(SEED)
        k = len(STATS)
        self.mean, self.sd = np.array(mean), np.array(sd)
        self.w = rng.standard_normal((k, FEATURES)) / math.sqrt(k)  # kernel width: the root of the number of statistics
        self.b = rng.uniform(0, 2 * math.pi, FEATURES)
        self.weights = None
        self.knots = None

    def features(self, s: np.ndarray) -> np.ndarray:
        z = np.clip((s - self.mean) / self.sd, -LIMIT, LIMIT)
        return np.hstack([np.ones((len(z), 1)), math.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.b)])

    def raw(self, s: np.ndarray) -> np.ndarray:
        return np.clip(self.features(s) @ self.weights, 0, 1)

    def scores(self, s: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(s), 0.5)
        raw = self.raw(s)
        calm = np.interp(raw, *self.knots) if self.knots is not None else raw
        return 0.99 * calm + 0.01 * raw  # keeps an order within the steps


def stacked(column: pa.ListArray) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1) if len(column) else np.zeros((0, len(STATS)))


def solve(a: np.ndarray, y: np.ndarray, n: float) -> np.ndarray:
    ridge = RIDGE * max(n, 1.0) / FEATURES * np.eye(len(a))
    ridge[0, 0] = 1e-9
    return np.linalg.solve(a + ridge, y)


def isotonic(centres: np.ndarray, mean: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the weighted isotonic fit by pooling adjacent violators."""
    blocks: list[list[float]] = []  # weight, sum, weighted centre
    for c, m, w in zip(centres, mean, weight, strict=True):
        blocks.append([w, w * m, w * c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[2] / b[0] for b in blocks]), np.array([b[1] / b[0] for b in blocks])


def fit(learning: DataFrame) -> Model | None:
    """``learning``: rows (fold, y, s). None without rows. Every row is used.

    Each task returns one matrix per fold, whatever the number of its rows, and takes several splits.
    Matrices are added up by row in a shuffle; the driver gets one per fold.
    """
    k = len(STATS)
    moments = learning.agg(F.count("*").alias("n"), *[f(F.col("s")[i]).alias(f"{f.__name__}{i}") for i in range(k) for f in (F.avg, F.stddev_pop)]).first()
    if not moments["n"]:
        return None
    sd = [moments[f"stddev_pop{i}"] for i in range(k)]
    model = Model([moments[f"avg{i}"] for i in range(k)], [x if x > 1e-9 else 1.0 for x in sd])
    width = FEATURES + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = {f: np.zeros((width, width + 2)) for f in FOLDS}
        for batch in batches:
            fold, y, s = np.asarray(batch.column(0)), np.asarray(batch.column(1)), stacked(batch.column(2))
            for f in FOLDS:
                if (at := fold == f).any():
                    z = model.features(s[at])
                    a[f][:, :width] += z.T @ z
                    a[f][:, width] += z.T @ y[at]
                    a[f][0, width + 1] += at.sum()
        made = [(f, i, m[i].tobytes()) for f, m in a.items() if m[0, width + 1] for i in range(width)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in made], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["fold", "i", "sums"])

    def added(group: pa.Table) -> pa.Table:
        rows = np.stack([np.frombuffer(x.as_buffer()) for x in group.column("sums")])
        return pa.table({"fold": group.column("fold")[:1], "i": group.column("i")[:1], "sums": pa.array([rows.sum(0).tobytes()], pa.binary())})

    schema = "fold int, i int, sums binary"
    tasks = max(SUM_TASKS, learning.rdd.getNumPartitions() // SPLITS_PER_TASK)
    total = {f: np.zeros((width, width + 2)) for f in FOLDS}
    for row in learning.coalesce(tasks).mapInArrow(sums, schema).groupBy("fold", "i").applyInArrow(added, schema).collect():  # a row per fold and equation
        total[row["fold"]][row["i"]] = np.frombuffer(row["sums"])
    every = sum(total.values())
    without = {}
    for f in FOLDS:
        rest = every - total[f] if every[0, width + 1] > total[f][0, width + 1] else every
        without[f] = solve(rest[:, :width], rest[:, width], rest[0, width + 1])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold, s, score = np.asarray(batch.column(0)), stacked(batch.column(2)), np.zeros(batch.num_rows)
            for f in FOLDS:
                if (at := fold == f).any():
                    score[at] = np.clip(model.features(s[at]) @ without[f], 0, 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(score * BINS, BINS - 1).astype(np.int32)), batch.column(1)], ["bin", "y"])

    bins = learning.mapInArrow(binned, "bin int, y double").groupBy("bin").agg(F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    model.weights = solve(every[:, :width], every[:, width], every[0, width + 1])
    model.knots = isotonic(np.array([(r["bin"] + 0.5) / BINS for r in bins]), np.array([r["y"] for r in bins]), np.array([float(r["n"]) for r in bins]))
    return model


def learn(stats: DataFrame, labels: DataFrame, space: Workspace) -> Model | None:
    """The model from ``statistics`` of all documents and the labels of learning rows."""
    marked = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("y"))
    learning = stats.where(fold_of() != 0).join(marked, "doc_id").select(fold_of().cast("int").alias("fold"), "y", "s")
    return fit(space.save(learning, "learning"))


def scores_of(model: Model | None, s: np.ndarray) -> np.ndarray:
    return model.scores(s) if model else np.full(len(s), 0.5)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    space = Workspace(docs.sparkSession, "quality")
    stats = space.save(statistics(docs), "stats")
    model = learn(stats, labels, space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores_of(model, stacked(batch.column(1))))], ["doc_id", "score"])

    scored = stats.mapInArrow(run, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", (fold_of() == 0).alias("held_out"), "score", (F.col("score") >= KEEP_SCORE).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, columns unchanged.

    The texts are read twice, to learn and to filter where they stand; they are never shuffled.
    """
    space = Workspace(docs.sparkSession, "quality")
    model = learn(space.save(statistics(docs), "stats"), labels, space)
    space.drop("stats", "learning")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.array([statistics_of(v.as_py() or "") for v in batch.column(at)]).reshape(batch.num_rows, len(STATS))
            yield batch.filter(pa.array(scores_of(model, s) >= KEEP_SCORE, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
