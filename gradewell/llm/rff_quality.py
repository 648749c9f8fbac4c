"""Quality scores: ridge regression on random Fourier features of document statistics, calibrated
by isotonic regression."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.llm.common import store

#: Fourier features, the kernel's width as a multiple of the statistics' spread, the ridge, the seed.
FEATURES, WIDTH, RIDGE, SEED = 256, 3.0, 1e-3, 11
#: At most about so many labelled rows are used for fitting, chosen by a hash of the id.
MAX_LABELLED = 400_000
#: Tasks that sum normal equations, and bins of scores for the calibration.
SUM_TASKS, BINS = 32, 500

_LETTER = np.zeros(256, dtype=np.int64)
_CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": [32, 9, 11, 12, 13], "line": [10], "stop": [33, 46, 63], "comma": [44, 58, 59], "high": range(128, 256)}
for _k, _codes in enumerate(_CLASSES.values(), 1):
    _LETTER[list(_codes)] = _k
STATISTICS = 20


def statistics(text: bytes) -> list[float]:
    """Numbers about the whole text, none of them unbounded in its length but by logarithm. An
    empty text has all zeros."""
    words = text.split()
    if not words:
        return [0.0] * STATISTICS
    codes = np.bincount(_LETTER[np.frombuffer(text, dtype=np.uint8)], minlength=len(_CLASSES) + 1)
    other, upper, lower, digit, space, line, stop, comma, high = (codes / len(text)).tolist()
    n = len(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    same = sum(map(bytes.__eq__, words, words[1:])) / n
    lowered = [*map(bytes.lower, words)]
    kinds = len({*lowered})
    lines = [x for x in text.split(b"\n") if x]
    pairs = len({*zip(lowered, lowered[1:], strict=False)})
    ended = sum(1 for x in lines if x.rstrip()[-1:] in b".!?") / len(lines) if lines else 0.0
    loud = sum(map(bytes.isupper, words)) / n
    alpha = sum(map(bytes.isalnum, words)) / n
    return [
        math.log1p(len(text)), math.log1p(n), math.log1p(len(lines)), float(lengths.mean()), float(lengths.std()),
        kinds / n, kinds / math.sqrt(n), pairs / max(1, n - 1), same, len({*lines}) / max(1, len(lines)),
        ended, loud, alpha, other, upper, digit, stop, comma, high + lower, line + space,
    ]


def document_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, stats): reads each text once; what follows uses only these numbers."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            stats = [statistics(x.encode("utf-8", "replace") if x else b"") for x in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"].array, "stats": stats})

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return plain.mapInPandas(run, "doc_id long, stats array<double>")


@dataclass
class Model:
    """What scoring needs; its size depends on the parameters only."""

    mean: np.ndarray
    spread: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps: np.ndarray  # raw scores, ascending
    values: np.ndarray  # calibrated scores at the steps, not falling

    def fourier(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.spread, -8, 8)
        waves = np.cos(z @ self.directions + self.phases) * math.sqrt(2 / len(self.phases))
        return np.hstack([waves, z, np.ones((len(z), 1))])

    def score(self, stats: np.ndarray) -> np.ndarray:
        raw = self.fourier(stats) @ self.weights
        return np.clip(np.interp(raw, self.steps, self.values), 0.0, 1.0)


def pool_adjacent(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-falling sequence nearest to ``values`` by weighted squares."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks])


def fit(labelled: DataFrame, seed: int = SEED) -> Model | None:
    """The model for (doc_id, stats, label 0/1). Three quarters of the rows fit the ridge, one
    quarter calibrates it, by a hash of the id, however many there are; where none is in that
    quarter, all scores are the mean label. None where there are no rows.

    Each of SUM_TASKS tasks sums the normal equations of its rows; their sum is solved here.
    The calibration reduces scores to at most BINS bins before they are pooled."""
    facts = labelled.agg(
        F.count("*").alias("n"),
        F.avg("label").alias("share"),
        F.array(*(F.avg(F.get("stats", F.lit(k))) for k in range(STATISTICS))).alias("mean"),
        F.array(*(F.stddev_pop(F.get("stats", F.lit(k))) for k in range(STATISTICS))).alias("spread"),
    ).first()
    if not facts["n"]:
        return None
    rng = np.random.default_rng(seed)
    spread = np.array(facts["spread"], dtype=float)
    model = Model(
        mean=np.array(facts["mean"], dtype=float),
        spread=np.where(spread > 1e-9, spread, 1.0),
        directions=rng.normal(size=(STATISTICS, FEATURES)) / WIDTH,
        phases=rng.uniform(0, 2 * math.pi, FEATURES),
        weights=np.zeros(FEATURES + STATISTICS + 1),
        steps=np.zeros(1),
        values=np.zeros(1),
    )
    share = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(4))

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = len(model.weights)
        left, right = np.zeros((size, size)), np.zeros(size)
        for frame in frames:
            if len(frame):
                z = model.fourier(np.stack(frame["stats"].to_numpy()))
                left += z.T @ z
                right += z.T @ frame["label"].to_numpy(dtype=float)
        yield pd.DataFrame({"left": [left.tobytes()], "right": [right.tobytes()]})

    parts = labelled.filter(share != 0).coalesce(SUM_TASKS).mapInPandas(sums, "left binary, right binary").collect()
    size = len(model.weights)
    left = sum((np.frombuffer(p["left"]).reshape(size, size) for p in parts), np.zeros((size, size)))
    right = sum((np.frombuffer(p["right"]) for p in parts), np.zeros(size))
    model.weights = np.linalg.solve(left + RIDGE * max(1.0, left[-1, -1]) * np.eye(size) * 1e-2, right)

    def raw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            scores = model.fourier(np.stack(frame["stats"].to_numpy())) @ model.weights if len(frame) else np.zeros(0)
            yield pd.DataFrame({"raw": scores, "label": frame["label"].astype(float)})

    scored = store(labelled.filter(share == 0).mapInPandas(raw, "raw double, label double"), "calibration")
    cuts = scored.agg(F.percentile_approx("raw", F.array(*(F.lit(k / BINS) for k in range(1, BINS))), 10_000)).first()[0]
    edges = [-math.inf, *sorted({*(cuts or [])}), math.inf]
    binned = scored.withColumn("bin", _bin(F.col("raw"), edges)).groupBy("bin")
    bins = binned.agg(F.avg("raw").alias("at"), F.avg("label").alias("value"), F.count("*").alias("n")).orderBy("bin").toPandas()
    if not len(bins):
        model.values = np.array([facts["share"]], dtype=float)
        return model
    model.steps = bins["at"].to_numpy()
    model.values = pool_adjacent(bins["value"].to_numpy(), bins["n"].to_numpy(dtype=float))
    return model


def _bin(raw: Column, edges: list[float]) -> Column:
    inner = F.array(*(F.lit(float(x)) for x in edges[1:-1])) if len(edges) > 2 else F.array().cast("array<double>")
    return F.size(F.filter(inner, lambda x: x < raw))


def _chosen(labels: DataFrame, id_col: str, label_col: str, learn: Column | None, max_labelled: int) -> DataFrame:
    """(doc_id, label) of the labels to learn from."""
    known = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id"))
    known = known.agg(F.max(label_col).cast("double").alias("label"))
    chosen = known if learn is None else known.filter(learn)
    total = chosen.count()
    if total > max_labelled:
        rank = F.shiftrightunsigned(F.xxhash64(F.lit(SEED + 1), "doc_id"), 11).cast("double") / float(1 << 53)
        chosen = chosen.filter(rank < max_labelled / total)
    return chosen


def _scores(model: Model | None, stats: pd.Series) -> np.ndarray:
    return model.score(np.stack(stats.to_numpy())) if model is not None and len(stats) else np.full(len(stats), 0.5)


def good_rows(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED
) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with all their columns.

    As ``quality_scores``, but each row is judged where it is, by its text alone: nothing is joined
    by id, so rows with a null or a repeated id are rows like all others.
    """
    chosen = _chosen(labels, id_col, label_col, None, max_labelled)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # about max_labelled ids at most, so texts are not shuffled to meet them
    known = document_statistics(own.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi"), "doc_id", "text")
    model = fit(store(store(known, "statistics").join(chosen, "doc_id"), "labelled"))
    spread = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        stats = pd.Series([np.array(statistics(x.encode("utf-8", "replace") if x else b"")) for x in texts], dtype=object)
        return pd.Series(_scores(spread.value, stats) >= 0.5)

    return docs.filter(good(F.col(text_col)))


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    learn: Column | None = None,
    max_labelled: int = MAX_LABELLED,
) -> DataFrame:
    """One row per document: id_col, score (0 to 1, higher: label 1 likelier), predicted.

    The model is fitted on the labelled documents for which ``learn`` holds, at most about
    ``max_labelled`` of them, taken by a hash of the id; the mean label where none are labelled
    is 0.5. Only statistics of the text are inputs of a score. Labels that are null, or about no
    document, are left out; of several labels of one document the largest counts. Null and empty
    texts have the statistics zero and get a score like all others. A row with a null id is
    scored. Equal texts get equal scores. An empty table gives an empty table.
    """
    stats = store(document_statistics(docs, id_col, text_col), "statistics")
    chosen = _chosen(labels, id_col, label_col, learn, max_labelled)
    model = fit(store(stats.join(chosen, "doc_id"), "labelled"))
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            score = _scores(spread.value, frame["stats"])
            yield pd.DataFrame({"doc_id": frame["doc_id"].array, "score": score, "predicted": (score >= 0.5).astype(int)})

    scored = stats.mapInPandas(run, "doc_id long, score double, predicted int")
    return scored.withColumnRenamed("doc_id", id_col)
