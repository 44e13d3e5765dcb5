"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Texts are turned into bounded dense features from their bytes and words (Arrow batches, numpy). The model is fitted on
the driver on a bounded sample of trusted positives and of unlabelled web text; scoring is one narrow pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_slices, worker_state

CLASSES = ("upper", "lower", "digit", "space", "line", "bang", "bar", "mark", "stop", "other", "high", "control")
N_FEATURES = 26


def _table() -> np.ndarray:
    kind = np.full(256, CLASSES.index("other"), np.uint8)
    for name, codes in (
        ("control", range(32)), ("upper", range(65, 91)), ("lower", range(97, 123)), ("digit", range(48, 58)), ("space", b" \t"),
        ("line", b"\n\r"), ("bang", b"!?"), ("bar", b"|"), ("mark", b"$%&*#@~^_=+<>{}[]\\/"), ("stop", b".,;:"), ("high", range(128, 256)),
    ):
        kind[list(codes)] = CLASSES.index(name)
    return kind


KIND = _table()


def features(texts: pa.Array) -> np.ndarray:
    """One row of ``N_FEATURES`` numbers in about 0..1 per text; nulls count as empty texts."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    size = np.diff(ends)
    out = np.zeros((len(texts), N_FEATURES))
    k = KIND[data]
    row = np.repeat(np.arange(len(texts)), size)
    n = np.maximum(size, 1)
    counts = np.bincount(row * len(CLASSES) + k, minlength=len(texts) * len(CLASSES)).reshape(len(texts), -1)
    out[:, :12] = counts / n[:, None]
    if len(data) > 1:
        same = row[1:] == row[:-1]
        pairs = ((k[1:] == CLASSES.index("upper")) & (k[:-1] == CLASSES.index("upper")), data[1:] == data[:-1], (k[1:] >= 5) & (k[1:] <= 7) & (k[:-1] >= 5) & (k[:-1] <= 7), (k[1:] == 3) & (k[:-1] == 3))
        for j, hit in enumerate(pairs):
            out[:, 12 + j] = np.bincount(row[1:][hit & same], minlength=len(texts)) / n
    words = [t.split() for t in texts.to_pylist()]
    w = np.array([len(x) for x in words])
    m = np.maximum(w, 1)
    out[:, 16] = np.minimum(1, size / m / 30)
    out[:, 17] = [len(set(x)) for x in words] / m
    out[:, 18] = np.minimum(1, np.log1p(w) / 12)
    lines = [t.count(b"\n") + 1 for t in texts.to_pylist()]
    out[:, 19] = np.minimum(1, np.log1p(lines) / 8)
    out[:, 20] = [len(set(t.split(b"\n"))) for t in texts.to_pylist()] / np.maximum(lines, 1)
    out[:, 21] = np.minimum(1, m / lines / 60)
    out[:, 22] = w == 0
    out[:, 23] = w < 5
    pairs2 = [len(set(zip(x[::2], x[1::2]))) / max(1, len(x) // 2) for x in words]
    out[:, 24] = pairs2
    out[:, 25] = np.minimum(1, out[:, 8] * size / m)
    return out


@dataclass(frozen=True)
class Model:
    """A small network on centred features: ``sigmoid(tanh(x A + a) b + c + x d)``; empty weights score ``prior``."""

    mean: np.ndarray
    scale: np.ndarray
    a: np.ndarray
    a0: np.ndarray
    b: np.ndarray
    d: np.ndarray
    c: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.b):
            return np.full(len(x), self.prior)
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        g = np.tanh(z @ self.a + self.a0) @ self.b + z @ self.d + self.c
        return 1 / (1 + np.exp(-np.clip(g, -40, 40)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, least_share: float = 0.02) -> float:
    """Class prior from scores: the least ratio of the upper tails of unlabelled and positive texts, with a
    one-sided allowance for sampling error (the best bin holds positives only, so the ratio there is the prior)."""
    cuts = np.quantile(positive, np.linspace(0, 1 - least_share, 200))
    p = 1 - np.searchsorted(np.sort(positive), cuts, "left") / len(positive)
    u = 1 - np.searchsorted(np.sort(unlabelled), cuts, "left") / len(unlabelled)
    slack = np.sqrt(1 / len(positive)) + np.sqrt(1 / len(unlabelled))
    return float(np.clip(u[np.argmin((u + slack) / np.maximum(p, 1e-9))] / p[np.argmin((u + slack) / np.maximum(p, 1e-9))], 0.05, 0.95))


def _train(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, hidden: int, steps: int, seed: int) -> Model:
    """Adam on the non-negative risk (``prior`` given), or on plain positives against unlabelled (None)."""
    rng = np.random.default_rng(seed)
    both = np.vstack([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-3
    zp, zu = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    f = both.shape[1]
    w = {"a": rng.normal(0, 0.3, (f, hidden)), "a0": np.zeros(hidden), "b": rng.normal(0, 0.1, hidden), "d": np.zeros(f), "c": np.zeros(1)}
    m1, m2 = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))

    def forward(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(z @ w["a"] + w["a0"])
        return h, np.clip(h @ w["b"] + z @ w["d"] + w["c"], -30, 30)

    def backward(z: np.ndarray, h: np.ndarray, g: np.ndarray) -> dict[str, np.ndarray]:
        dh = g[:, None] * w["b"] * (1 - h * h)
        return {"a": z.T @ dh, "a0": dh.sum(0), "b": h.T @ g, "d": z.T @ g, "c": g.sum(keepdims=True)}

    for t in range(1, steps + 1):
        bp, bu = zp[rng.integers(0, len(zp), min(1024, len(zp)))], zu[rng.integers(0, len(zu), min(1024, len(zu)))]
        hp, gp = forward(bp)
        hu, gu = forward(bu)
        sp, su = 1 / (1 + np.exp(-gp)), 1 / (1 + np.exp(-gu))
        if prior is None:
            dp, du = (sp - 1) / len(bp), su / len(bu)
        else:
            # logistic loss: l(g, +1) = log(1 + e^-g), l(g, -1) = log(1 + e^g)
            negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
            if negative >= 0:
                dp, du = prior * (sp - 1) / len(bp) - prior * sp / len(bp), su / len(bu)
            else:  # the unlabelled part has been overfitted: step back along the negative risk alone
                dp, du = prior * sp / len(bp), -su / len(bu)
        grads = backward(bp, hp, dp)
        for k, v in backward(bu, hu, du).items():
            g = grads[k] + v + 1e-4 * w[k]
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.999 * m2[k] + 0.001 * g * g
            w[k] -= 0.01 * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, w["a"], w["a0"], w["b"], w["d"], float(w["c"][0]), prior or 0.5)


def held_out(id_col: str):
    """Whether crc32 of the id as text leaves no remainder by 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _drawn(wanted: float, total: int, seed: int):
    """Rows of about ``wanted`` of ``total`` ids, by a threshold on 62 bits of the id's hash, so that no table is too large for it."""
    span = 1 << 62
    return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(span)) < F.lit(max(1, int(span * min(1.0, wanted / max(total, 1)))))


def _sample(df: DataFrame, most: int, seed: int) -> np.ndarray:
    """Features of at most ``most`` rows, those with the least hash of id and text (the same rows under any partitioning).

    Features are computed where the texts are; the driver gets ``most`` x ``N_FEATURES`` numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("quality", dict)
        for whole in batches:
            for b in text_slices(whole):
                x = pa.FixedSizeListArray.from_arrays(pa.array(features(b.column(1)).ravel()), N_FEATURES).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([b.column(0), x], names=["h", "x"])

    made = df.select(F.xxhash64("id", "text", F.lit(seed)).alias("h"), "text").mapInArrow(run, "h bigint, x array<double>")
    rows = made.orderBy("h", "x").limit(most).select("x").collect()
    return np.array([r[0] for r in rows]).reshape(-1, N_FEATURES)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_positive: int = 4000,
    max_unlabelled: int = 8000,
    hidden: int = 16,
    steps: int = 3000,
    seed: int = 7,
) -> Model:
    """Fit on trusted positives (label 1, not held out) and unlabelled web text (a sample of all rows that aren't held out).

    ``max_positive`` and ``max_unlabelled`` bound what the driver gets. The prior is estimated from the data, negative
    labels are not used. Texts that are copies of each other count once each in the sample of rows. With fewer than two
    positives or two texts in the whole tables, the model scores 0.5 everywhere. Null texts are learnt as empty ones, a null
    id is never held out, null and other labels than 1 are ignored, other columns are not read.
    """
    small_batches(docs.sparkSession)
    pool = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(~held_out("id"))
    trusted = labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("id")).where(~held_out("id")).distinct()
    n, total = trusted.count(), docs.count()
    positive = _sample(pool.join(trusted.where(_drawn(1.3 * max_positive, n, seed)), "id", "left_semi"), max_positive, seed) if n else np.zeros((0, N_FEATURES))
    unlabelled = _sample(pool.where(_drawn(2.0 * max_unlabelled, total, seed)), max_unlabelled, seed)
    if total > 100 * max_unlabelled and not len(unlabelled):
        raise RuntimeError("no unlabelled text was drawn from a table that is not empty")
    if len(positive) < 2 or len(unlabelled) < 2:
        none = np.zeros(0)
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros((N_FEATURES, 0)), none, none, none, 0.0, 0.5)
    half = len(positive) // 2, len(unlabelled) // 2
    first = _train(positive[: half[0]], unlabelled[: half[1]], None, hidden, steps // 2, seed)
    prior = estimate_prior(first.score(positive[half[0] :]), first.score(unlabelled[half[1] :]))
    return _train(positive, unlabelled, prior, hidden, steps, seed)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, keep: bool = False) -> DataFrame:
    """One row per document: id, held_out, score, predicted. ``keep`` returns the input's own columns of rows predicted 1 instead.

    Null text: scored as empty. Repeated rows are scored alike. Columns of other names are ignored, or kept with ``keep``.
    """
    small_batches(docs.sparkSession)
    wanted = docs if keep else docs.select(F.col(id_col), F.col(text_col))
    schema = wanted.schema
    text_at = schema.names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("quality", dict)
        for whole in batches:
            for b in text_slices(whole, text_col):
                s = model.score(features(b.column(text_at)))
                if keep:
                    yield b.filter(pa.array(s >= threshold))
                else:
                    arrays = [b.column(schema.names.index(id_col)), pa.array(s), pa.array((s >= threshold).astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "score", "predicted"])

    if keep:
        return wanted.mapInArrow(run, schema)
    out = wanted.mapInArrow(run, f"`{id_col}` {wanted.schema[id_col].dataType.simpleString()}, score double, predicted int")
    return out.select(F.col(id_col), held_out(id_col).alias("held_out"), "score", "predicted")
