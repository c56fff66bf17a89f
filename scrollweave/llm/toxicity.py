"""Toxicity by cumulative-link ordinal regression over sparse text features.

One weight vector serves all thresholds: ``P(grade <= k) = sigmoid(theta_k - w x)`` with ascending ``theta``. Features
are hashed words and word beginnings, present or not; few of them, chosen by their association with the label, have a
weight. The model is fitted on a bounded sample of labelled rows and scores whole texts in one Arrow pass.

Grades are 0 (clean), 1 (toxic) and 2 (severely toxic).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrollweave.llm import _textvec as tv
from scrollweave.llm._scratch import discard, park

#: Labelled texts that a fit takes at most.
SAMPLE_ROWS = 20_000
#: Bytes of word beginnings that are features beside whole words; the low bits of a feature's hash say which it is.
BEGINNINGS, KIND_BITS = (4, 5, 6, 7), 3


@dataclass
class Model:
    features: np.ndarray  # sorted hashes of words and beginnings
    weights: np.ndarray
    cuts: np.ndarray  # ascending, one less than grades

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        below = 1 / (1 + np.exp(np.clip(score[:, None] - self.cuts, -500, 500)))
        return np.diff(np.concatenate([np.zeros((len(score), 1)), below, np.ones((len(score), 1))], 1))

    def scores(self, bounds: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """``w x`` for each text, a feature counting once a text."""
        owner, feature = _present(bounds, hashes, self.features)
        return np.bincount(owner, self.weights[feature], len(bounds) - 1) if len(owner) else np.zeros(len(bounds) - 1)


def _present(bounds: np.ndarray, hashes: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``(text, place in features)`` pairs; features are sorted hashes."""
    if not len(features):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    near = np.zeros(1 << 16, bool)
    near[(features >> np.uint64(48)).astype(np.int64)] = True
    at = np.flatnonzero(near[(hashes >> np.uint64(48)).astype(np.int64)])
    place = np.minimum(np.searchsorted(features, hashes[at]), len(features) - 1)
    exact = features[place] == hashes[at]
    at, place = at[exact], place[exact]
    pairs = np.unique((np.searchsorted(bounds, at, "right") - 1) * len(features) + place)
    return pairs // len(features), pairs % len(features)


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words and beginnings of longer words, of text ``i`` in ``hashes[bounds[i]:bounds[i + 1]]``."""
    bounds, kinds = tv.beginnings(column, BEGINNINGS, tv.PUNCTUATION)
    mask = np.uint64((1 << KIND_BITS) - 1)
    owner = np.concatenate([np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[at] for at, _ in kinds])
    hashes = np.concatenate([(h & ~mask) | np.uint64(k) for k, (_, h) in enumerate(kinds)])
    order = np.argsort(owner, kind="stable")
    return np.searchsorted(owner[order], np.arange(len(bounds))), hashes[order]


def choose(sample: DataFrame, n: int, toxic: int, most: int = 2048, least_texts: int = 5, least_share: float = 0.005, chi2: float = 30.0) -> np.ndarray:
    """Features that toxic texts have more often, by the chi-square statistic, ``most`` at most, of ``sample (__toxic,
    __words)`` with ``n`` distinct texts and ``toxic`` toxic ones. They are counted in Spark; only features reach the driver.

    A feature is in ``least_texts`` distinct texts and ``least_share`` of the toxic ones at least: a few near copies of one
    toxic text would else make features of its rare words.
    """
    if not 0 < toxic < n:
        return np.zeros(0, np.uint64)
    each = sample.select(F.explode("__words").alias("word"), "__toxic")
    counts = each.groupBy("word").agg(F.count("*").cast("double").alias("df"), F.sum("__toxic").cast("double").alias("a"))
    all_, bad = F.lit(float(n)), F.lit(float(toxic))
    a, b = F.col("a"), F.col("df") - F.col("a")
    c, d = bad - a, all_ - bad - b
    cross = a * d - b * c
    stat = F.try_divide(all_ * cross * cross, (a + b) * (c + d) * (a + c) * (b + d))
    used = counts.filter((F.col("df") >= least_texts) & (a >= least_share * toxic) & (a * (all_ - bad) > b * bad))
    # The hashes are unsigned.
    best = used.select("word", stat.alias("stat")).filter(F.col("stat") >= chi2).orderBy(F.desc("stat"), F.col("word").bitwiseXOR(F.lit(-(1 << 63)))).limit(most)
    return np.sort(np.array([r.word for r in best.collect()], np.int64).view(np.uint64))


def fit(features: np.ndarray, owner: np.ndarray, feature: np.ndarray, toxic: np.ndarray, rounds: int = 2000, rate: float = 0.5, l2: float = 1e-5) -> Model:
    """Fit on labelled texts, by the distinct pairs ``(owner, feature)`` of texts and places in ``features``.

    Labels are 0 or 1. A toxic text with at least the median number of chosen features among toxic texts that have more
    than one is graded 2, another toxic text 1. Gradient ascent on the penalised likelihood of all grades at once;
    thresholds are a first one and positive steps.
    """
    toxic = toxic.astype(np.float64)
    hits = np.bincount(owner, minlength=len(toxic))
    many = hits[(toxic > 0) & (hits > 1)]
    grade = np.where(toxic > 0, np.where(hits >= max(2, np.median(many)), 2, 1) if len(many) else 1, 0)
    w, first, step = np.zeros(len(features)), 0.0, 0.0
    n = max(1, len(toxic))
    moment = [np.zeros(len(features) + 2), np.zeros(len(features) + 2)]
    for t in range(1, rounds + 1 if len(features) else 1):
        cuts = np.array([first, first + np.exp(step)])
        score = np.bincount(owner, w[feature], len(toxic))
        upper = np.where(grade < 2, 1 / (1 + np.exp(score - cuts[np.minimum(grade, 1)])), 1.0)
        lower = np.where(grade > 0, 1 / (1 + np.exp(score - cuts[np.maximum(grade - 1, 0)])), 0.0)
        p = np.maximum(upper - lower, 1e-12)
        up, down = upper * (1 - upper) / p, lower * (1 - lower) / p
        by_score = (down - up) / n
        d_cut = [((grade == k) * up - (grade == k + 1) * down).sum() / n for k in range(2)]
        gradient = np.concatenate([np.bincount(feature, by_score[owner], len(features)) - l2 * w, [d_cut[0] + d_cut[1], d_cut[1] * np.exp(step)]])
        moment = [0.9 * moment[0] + 0.1 * gradient, 0.99 * moment[1] + 0.01 * gradient**2]
        change = rate / np.sqrt(t) * (moment[0] / (1 - 0.9**t)) / (np.sqrt(moment[1] / (1 - 0.99**t)) + 1e-8)
        w, first, step = w + change[:-2], first + change[-2], min(step + change[-1], 5.0)
    if not len(features):
        share = toxic.mean() if len(toxic) else 0.0
        first = np.log((1 - share + 1e-6) / (share + 1e-6))
    return Model(features, w, np.array([first, first + np.exp(step)]))


def _told_apart(features: np.ndarray, owner: np.ndarray, feature: np.ndarray) -> np.ndarray:
    """Places of all whole words, and of the beginnings that don't stand in the same texts as a word or a shorter one."""
    order = np.lexsort((owner, feature))
    owner, ends = owner[order], np.searchsorted(feature[order], np.arange(len(features) + 1))
    first: dict[bytes, int] = {}
    kind = features & np.uint64((1 << KIND_BITS) - 1)
    for k in np.argsort(kind, kind="stable").tolist():
        first.setdefault(owner[ends[k] : ends[k + 1]].tobytes(), k)
    return np.union1d(np.flatnonzero(kind == 0), np.array(sorted(first.values()), np.int64))


def _word_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(__id, __hash, __toxic, __words)``: each text as the sorted distinct hashes of its words."""
    for whole in batches:
        for batch in tv.slices(whole, ("__text",)):
            bounds, hashes = _words(batch.column("__text"))
            sets = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            offsets = np.cumsum([0, *map(len, sets)])
            words = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("__id", "__hash", "__toxic")), words], ["__id", "__hash", "__toxic", "__words"])


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """``(bounds, values)`` of a column of lists."""
    bounds = column.offsets.to_numpy().astype(np.int64)
    return bounds - bounds[0], column.flatten().to_numpy()


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on labelled documents, ``sample_rows`` at most, chosen by a hash of their ids; the bound is for the fit alone.

    Chosen texts count whole, however long, and move as the hashes of their distinct words. Words are counted in Spark,
    so the driver gets the features and their places in each text, not the texts. Labels are read first, so only
    chosen texts move. Equal texts count once, as toxic if one is labelled so; further texts of one id come after the first
    texts of all ids. Rows without id, label or text take no part; without labels of both kinds nothing is toxic or, where
    all labels say so, everything by its share. Other columns don't matter.
    """
    clean = labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("int").alias("__toxic")).filter("__id IS NOT NULL AND __toxic IS NOT NULL")
    chosen = clean.groupBy("__id").agg((F.max("__toxic") > 0).cast("int").alias("__toxic")).orderBy(F.xxhash64("__id"), "__id").limit(sample_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text")).filter("__text IS NOT NULL")
    found = rows.join(F.broadcast(chosen), "__id").select("__id", F.xxhash64("__text").alias("__hash"), "__toxic", "__text")
    held = park(found.mapInArrow(_word_sets, "__id long, __hash long, __toxic int, __words array<long>").dropDuplicates(["__id", "__hash"]), "words")
    rank = F.row_number().over(Window.partitionBy("__id").orderBy("__hash"))
    ranked = held.select("__id", "__hash", "__toxic", F.struct(rank.alias("rank"), F.xxhash64("__id").alias("deal"), "__id").alias("__order"))
    picked = ranked.groupBy("__hash").agg(F.max("__toxic").alias("__toxic"), F.min("__order").alias("__order")).orderBy("__order").limit(sample_rows)
    picked = park(picked.select("__hash", "__toxic"), "picked")
    sample = held.select("__hash", "__words").dropDuplicates(["__hash"]).join(F.broadcast(picked), "__hash")
    features = choose(sample, *sample.agg(F.count("*"), F.coalesce(F.sum("__toxic"), F.lit(0))).first())

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds, hashes = _lists(batch.column("__words"))
            owner, feature = _present(bounds, hashes.view(np.uint64), features)
            offsets = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            at = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(feature, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("__hash"), batch.column("__toxic"), at], ["__hash", "__toxic", "__at"])

    placed = sample.select("__hash", "__toxic", "__words").mapInArrow(places, "__hash long, __toxic int, __at array<int>")
    kept = placed.orderBy("__hash").select("__toxic", "__at").toArrow()
    discard(held)
    discard(picked)
    if not kept.num_rows:
        return fit(features, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
    bounds, feature = _lists(kept.column("__at").combine_chunks())
    owner, toxic = np.repeat(np.arange(kept.num_rows), np.diff(bounds)), kept.column("__toxic").to_numpy() > 0
    apart = _told_apart(features, owner, feature)
    place = np.full(len(features), -1)
    place[apart] = np.arange(len(apart))
    held_ = np.flatnonzero(place[feature] >= 0)
    return fit(features[apart], owner[held_], place[feature[held_]], toxic)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, severity, grade, toxic`` for every row: the expected grade, the likeliest grade, and whether some
    toxic grade is likelier than grade 0.

    Null and empty texts have no feature and the severity of such. Null ids and repeated rows are rows like others;
    other columns don't matter.
    """

    def run(batches):
        for whole in batches:
            for batch in tv.slices(whole, ("text",)):
                p = model.probabilities(model.scores(*_words(batch.column("text"))))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(p @ np.arange(p.shape[1])), pa.array(p.argmax(1), pa.int64()), pa.array(p[:, 0] < 0.5)],
                    ["doc_id", "severity", "grade", "toxic"],
                )

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, severity double, grade long, toxic boolean")
