"""Quality classifier over statistics of whole documents.

Statistics of a text (never its label, language, source or id) are standardised and mapped by random
Fourier features, whose inner products approximate a Gaussian kernel. Tasks sum their share of the
normal equations, the driver adds the few sums and solves the ridge system once, and isotonic
regression on rows kept out of the fit turns raw scores into probabilities.

Learning reads at most about `max_labelled` labelled rows, chosen by a hash of the id; statistics and
scores cover every row. Defined results: null text counts as empty; rows with a null label or a null id
are not learnt from; without labels of both kinds every score is the share of label 1 (0.5 without
any); repeated rows get equal scores; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duelframe.llm.common import remainder, saved, slices

MAX_LABELLED = 200_000
N_FEATURES = 256
RIDGE = 1e-3
THRESHOLD = 0.3
HELD_OUT_REMAINDER, CALIBRATION_REMAINDER = 0, 1
_BINS = 1000
_SUM_TASKS = 8
_SLICE_BYTES = 4 << 20
_MARKS = b"*#&$%!?|,.:;-_/\\<>{}[]()=+@\"'"
STATISTICS = (
    "log_bytes", "log_words", "upper", "lower", "digit", "space", "line_end", "beyond_ascii", "control",
    "mark_share", "hash_like", "bang", "bar", "stop_mark", "mean_word", "sd_word", "distinct_words", "distinct_pairs",
    "repeat_next", "top_word", "marked_words", "shouted_words", "distinct_lines", "mean_line", "worst_mark_block", "worst_upper_block",
    "worst_repeat_block", "bar_words",
)


def text_statistics(text: str) -> np.ndarray:
    """The numbers named in `STATISTICS` for one text."""
    raw = text.encode("utf-8", "surrogatepass")
    out = np.zeros(len(STATISTICS))
    words = raw.split()
    if not words:
        return out
    codes = np.frombuffer(raw, dtype=np.uint8)
    n, m = len(codes), len(words)
    tally = np.bincount(codes, minlength=256)
    upper, lower = tally[65:91].sum(), tally[97:123].sum()
    letters = max(1, upper + lower)
    marks = sum(int(tally[c]) for c in _MARKS)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=m)
    counts: dict[bytes, int] = {}
    number = np.fromiter((counts.setdefault(w, len(counts)) for w in words), dtype=np.int64, count=m)
    seen = np.bincount(number)
    again = number[1:] == number[:-1]
    pairs = len(np.unique((number[:-1] << 32) | number[1:])) if m > 1 else 1
    ends = np.array([w[-1] for w in words], dtype=np.uint8)
    starts = np.array([w[0] for w in words], dtype=np.uint8)
    odd_end = np.isin(ends, np.frombuffer(b"*#&$%!|@", dtype=np.uint8))
    shouted = np.fromiter(map(bytes.isupper, words), dtype=bool, count=m)
    lone_bar = (lengths == 1) & (starts == 124)
    lines = raw.split(b"\n")
    size = max(8, -(-m // 16))  # sixteen stretches of words, or stretches of eight
    blocks = np.arange(0, m, size)
    per_block = np.diff(np.append(blocks, m))
    fresh = np.zeros(m, dtype=bool)
    fresh[np.unique(number, return_index=True)[1]] = True
    out[:] = (
        np.log1p(n), np.log1p(m), upper / letters, lower / n, tally[48:58].sum() / n, tally[32] / n, tally[10] / n, tally[128:].sum() / n,
        (tally[:32].sum() - tally[9:14].sum()) / n, marks / n, sum(int(tally[c]) for c in b"*#&$%") / n, tally[33] / n, tally[124] / n,
        (tally[46] + tally[44]) / n, lengths.mean(), lengths.std(), len(seen) / m, pairs / max(1, m - 1), again.mean() if m > 1 else 0.0,
        seen.max() / m, odd_end.mean(), shouted.mean(), len(set(lines)) / len(lines), np.log1p(n / len(lines)),
        (np.add.reduceat(odd_end.astype(float), blocks) / per_block).max(), (np.add.reduceat(shouted.astype(float), blocks) / per_block).max(),
        1.0 - (np.add.reduceat(fresh.astype(float), blocks) / per_block).min() if m >= 16 else 0.0, lone_bar.mean(),
    )
    return out


def document_statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its statistics, one pass, row by row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches):
        for batch in slices(batches, "text", _SLICE_BYTES):
            found = np.stack([text_statistics(t) for t in batch.column("text").to_pylist()]).astype(np.float32)
            ends = pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32())
            stats = pa.ListArray.from_arrays(ends, pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), stats], names=["doc_id", "stats"])

    return rows.mapInArrow(run, f"doc_id {kind}, stats array<float>")


@dataclass(frozen=True)
class QualityModel:
    """What scoring needs: scaling, frequencies, weights, and the steps of the calibration."""

    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps: np.ndarray
    values: np.ndarray

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return _expand(stats, self.mean, self.scale, self.frequencies, self.phases) @ self.weights

    def scores(self, stats: np.ndarray) -> np.ndarray:
        if len(self.steps) == 1:
            return np.full(len(stats), self.values[0])
        return np.clip(np.interp(self.raw(stats), self.steps, self.values), 0.0, 1.0)


def _expand(stats, mean, scale, frequencies, phases) -> np.ndarray:
    """Constant, standardised statistics and random Fourier features."""
    x = np.clip((stats - mean) / scale, -8, 8)
    waves = np.cos(x @ frequencies + phases) * np.sqrt(2.0 / len(phases))
    return np.hstack([np.ones((len(x), 1)), x, waves])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("stats").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)


def _sums(rows: DataFrame, of_batch, shape: tuple[int, ...]) -> np.ndarray:
    """Sum of arrays over all rows; at most `_SUM_TASKS` arrays reach the driver."""

    def run(batches):
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += of_batch(batch)
        yield pa.RecordBatch.from_pydict({"total": [total.tobytes()]})

    parts = rows.repartition(_SUM_TASKS).mapInArrow(run, "total binary").collect()
    return sum((np.frombuffer(bytes(r["total"])).reshape(shape) for r in parts), np.zeros(shape))


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing fit by pooling adjacent violators: the knots and their values."""
    blocks: list[list[float]] = []  # mean, weight, first x, last x
    for xi, yi, wi in zip(x, y, w):
        blocks.append([yi, wi, xi, xi])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            weight = a[1] + b[1]
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / weight, weight, a[2], b[3]])
    knots = [(b[2], b[0]) for b in blocks] + [(b[3], b[0]) for b in blocks]
    knots.sort()
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])


def fit_quality(
    stats: DataFrame,
    labels: DataFrame,
    *,
    label_col: str = "quality",
    max_labelled: int = MAX_LABELLED,
    n_features: int = N_FEATURES,
    ridge: float = RIDGE,
    seed: int = 7,
) -> QualityModel:
    """Fit on labelled rows that are neither held out nor kept for calibration."""
    kept = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull() & (remainder(F.col("doc_id"), 5) != HELD_OUT_REMAINDER))
    n = kept.count()
    if n > max_labelled:
        kept = kept.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_labelled / n))
    marked = kept.groupBy("doc_id").agg(F.max(F.col(label_col).cast("double")).alias("y"))
    rows = saved(
        stats.join(marked, "doc_id").withColumn("calibrate", remainder(F.col("doc_id"), 5) == CALIBRATION_REMAINDER), "quality-labelled"
    )
    d = len(STATISTICS)
    fit_rows, check_rows = rows.where("not calibrate"), rows.where("calibrate")

    def moments(batch):
        x = _matrix(batch)
        return np.stack([np.full(d, float(len(x))), x.sum(axis=0), (x * x).sum(axis=0)])

    count, first, second = _sums(fit_rows, moments, (3, d))
    total = max(1.0, count[0])
    mean = first / total
    scale = np.sqrt(np.maximum(second / total - mean**2, 0.0))
    scale[scale < 1e-9] = 1.0
    random = np.random.default_rng(seed)
    frequencies = random.normal(scale=1.0 / np.sqrt(d), size=(d, n_features))
    phases = random.uniform(0, 2 * np.pi, n_features)
    size = 1 + d + n_features

    def normal(batch):
        z = _expand(_matrix(batch), mean, scale, frequencies, phases)
        y = batch.column("y").to_numpy(zero_copy_only=False)
        return np.vstack([z.T @ z, z.T @ y])

    both = _sums(fit_rows, normal, (size + 1, size))
    penalty = ridge * total * np.eye(size)
    penalty[0, 0] = 1e-9
    weights = np.linalg.solve(both[:size] + penalty + 1e-9 * np.eye(size), both[size])
    share = float(both[size][0] / total) if count[0] else 0.5
    model = QualityModel(mean, scale, frequencies, phases, weights, np.zeros(1), np.array([share]))
    if not 0.0 < share < 1.0:
        return model
    # calibration: counts for each of `_BINS` narrow ranges of the raw score
    raw = check_rows.mapInArrow(_with_raw(model), "raw double, y double")
    bins = (
        raw.groupBy(F.least(F.greatest(F.floor(F.col("raw") * _BINS), F.lit(-_BINS)), F.lit(2 * _BINS)).alias("bin"))
        .agg(F.avg("raw").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("w"))
        .orderBy("bin")
        .collect()
    )
    if not bins:
        return model
    steps, values = isotonic(*(np.array([r[c] for r in bins], dtype=float) for c in ("x", "y", "w")))
    # half a row of each label keeps the ends off 0 and 1
    weight = sum(r["w"] for r in bins)
    values = (values * weight + 0.5) / (weight + 1.0)
    return QualityModel(mean, scale, frequencies, phases, weights, steps, values)


def _with_raw(model: QualityModel):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(model.raw(_matrix(batch))), batch.column("y")], names=["raw", "y"])

    return run


def score_quality(stats: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id and score of every row of statistics."""
    kind = dict(stats.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(_matrix(batch)))], names=["doc_id", "score"])

    return stats.mapInArrow(run, f"doc_id {kind}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    stats = saved(document_statistics(docs, id_col=id_col, text_col=text_col), "quality-statistics")
    model = fit_quality(stats, labels.select("doc_id", label_col), label_col=label_col)
    scored = score_quality(stats, model)
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def is_held_out(id_column: Column) -> Column:
    return remainder(id_column, 5) == HELD_OUT_REMAINDER


def with_quality(docs: DataFrame, model: QualityModel, *, text_col: str = "text", score_col: str = "quality_score") -> DataFrame:
    """Every row with its score. Row-local: texts are not shuffled."""
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])

    def run(batches):
        for batch in slices(batches, text_col, _SLICE_BYTES):
            stats = np.stack([text_statistics(t or "") for t in batch.column(text_col).to_pylist()]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(stats.astype(np.float64)))], names=[f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)


def learn_quality(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", text_col: str = "text") -> QualityModel:
    """Model from the documents that have a label; only those that can be learnt from are read closely."""
    stats = saved(document_statistics(docs, text_col=text_col), "quality-statistics")
    return fit_quality(stats, labels.select("doc_id", label_col), label_col=label_col)
