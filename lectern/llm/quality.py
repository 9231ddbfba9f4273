"""Quality classifier by co-training of two views.

Text content: counts of byte trigrams, hashed to CONTENT numbers. Page metadata: source, language, length and layout
(lines, repeated lines, shares of capitals, digits, signs and spaces). Each view has a logistic regression of its own.
In every round each classifier labels all unlabelled documents; those it is surest of, in the labels' proportion, join
the other view's training set. Both are then calibrated on labels held out for it (Platt), their log-odds are put
together and calibrated once more, and all documents are scored.

Only labelled rows are sampled, at most `labelled` by the order of a hash of the ids (see `fit`). The features, not the
texts, of these and of the documents that join come to the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import cut, map_chunks, pieces, table, without

CONTENT, SOURCES, LANGS = 2048, 64, 16
LAYOUT = 10
METADATA = LAYOUT + SOURCES + LANGS
_MIX = np.uint32(0x9E3779B1)


def content(text: bytes) -> np.ndarray:
    """Hashed trigram counts, damped and of length one."""
    b = np.frombuffer(text, dtype=np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(CONTENT, dtype=np.float32)
    code = ((b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]) * _MIX
    x = np.log1p(np.bincount(code >> np.uint32(21), minlength=CONTENT)).astype(np.float32)
    return x / np.sqrt((x * x).sum())


def metadata(text: bytes, source: str | None, lang: str | None) -> np.ndarray:
    """Layout numbers, then one of SOURCES and one of LANGS hashed names."""
    x = np.zeros(METADATA, dtype=np.float32)
    n = len(text)
    if n:
        b = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
        lines = text.split(b"\n")
        words = max(1, int(b[32] + b[10]))
        letters = max(1, int(b[65:91].sum() + b[97:123].sum()))
        signs = int(b[33:48].sum() + b[58:65].sum() + b[91:97].sum() + b[123:127].sum())
        x[:LAYOUT] = (
            np.log1p(n) / 10, np.log1p(len(lines)) / 5, 1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)) / 5, b[65:91].sum() / letters,
            b[48:58].sum() / n, signs / n, words / n, np.log1p(n / words) / 3, 1.0,
        )
    if source is not None:
        x[LAYOUT + zlib.crc32(str(source).encode()) % SOURCES] = 1
    if lang is not None:
        x[LAYOUT + SOURCES + zlib.crc32(str(lang).encode()) % LANGS] = 1
    return x


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    texts = [(t or "").encode("utf-8", "replace") for t in batch.column("text").to_pylist()]
    column = lambda c: batch.column(c).to_pylist() if c in batch.schema.names else [None] * len(texts)
    own = [metadata(t, s, g) for t, s, g in zip(texts, column("source"), column("lang"), strict=True)]
    return np.array([content(t) for t in texts]).reshape(-1, CONTENT), np.array(own).reshape(-1, METADATA)


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, steps: int = 300, rate: float = 0.5) -> np.ndarray:
    """Weights and, last, the intercept, by Adam on the whole set with classes weighted alike."""
    n, k = x.shape
    w = np.zeros(k + 1, dtype=np.float64)
    share = y.mean()
    weight = np.where(y > 0, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9)) / n
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w[:k].astype(x.dtype) + w[k], -30, 30)))
        e = ((p - y) * weight).astype(x.dtype)
        g = np.append(x.T @ e, e.sum()).astype(np.float64)
        g[:k] += penalty * w[:k]
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        w -= rate / np.sqrt(t) ** 0.5 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def _odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1].astype(np.float32) + w[-1]


def platt(odds: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) of the probability 1 / (1 + exp(-(a * odds + b))), by Newton's method on smoothed targets."""
    good, bad = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 0.1, float(np.log((good + 1) / (bad + 1)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * odds + b, -30, 30)))
        e, s = p - target, np.maximum(p * (1 - p), 1e-9)
        grad = np.array([(e * odds).sum() + 1e-3 * a, e.sum()])
        hess = np.array([[(s * odds * odds).sum() + 1e-3, (s * odds).sum()], [(s * odds).sum(), s.sum() + 1e-9]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(float(a), 0.0), float(b)


@dataclass
class Model:
    """Weights of both views and the three calibrations; prior alone where labels of one kind are all there is."""

    prior: float
    text: np.ndarray | None = None
    page: np.ndarray | None = None
    platt: tuple = ()
    held_out: float | None = None
    n_pseudo: int = 0

    def odds(self, views: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(views[0])
        if self.text is None:
            flat = np.full(n, np.log(self.prior / (1 - self.prior)))
            return flat, flat, flat
        (a, b), (c, d), (e, f) = self.platt
        t, m = a * _odds(views[0], self.text) + b, c * _odds(views[1], self.page) + d
        return t, m, e * (t + m) + f


def co_train(x: tuple, y: np.ndarray, draw: Callable[[list, float], list], rounds: int = 4) -> Model:
    """x: (content, metadata) of labelled rows; y: 0 or 1. Of ten labelled rows one is held out for calibration and one,
    which nothing is fitted to, for the accuracy in held_out.
    draw, given each view's (weights, a, b) and the share of good labels, has the rows and labels that join each view."""
    prior = float((y.sum() + 1) / (len(y) + 2)) if len(y) else 0.5
    held, unseen = np.arange(len(y)) % 10 == 4, np.arange(len(y)) % 10 == 9
    fit = ~(held | unseen)
    if min((y[fit] == 1).sum(), (y[fit] == 0).sum()) < 3 or min((y[held] == 1).sum(), (y[held] == 0).sum()) < 1:
        return Model(prior)
    taken = [np.zeros((0, x[v].shape[1]), dtype=x[v].dtype) for v in (0, 1)]
    given = [np.zeros(0), np.zeros(0)]
    for k in range(rounds + 1):
        w = [logistic(np.concatenate((x[v][fit], taken[v])), np.concatenate((y[fit], given[v]))) for v in (0, 1)]
        if k == rounds:
            break
        found = draw([(w[v], *platt(_odds(x[v][held], w[v]), y[held])) for v in (0, 1)], prior)
        if not any(len(labels) for _, labels in found):
            break
        for v, (rows, labels) in enumerate(found):
            taken[v], given[v] = np.concatenate((taken[v], rows)), np.append(given[v], labels)
    views = (x[0][held], x[1][held])
    one, two = platt(_odds(views[0], w[0]), y[held]), platt(_odds(views[1], w[1]), y[held])
    both = one[0] * _odds(views[0], w[0]) + one[1] + two[0] * _odds(views[1], w[1]) + two[1]
    model = Model(prior, w[0], w[1], (one, two, platt(both, y[held])), None, sum(map(len, taken)))
    odds = model.odds((x[0][unseen], x[1][unseen]))[2]
    model.held_out = float(((odds > 0) == (y[unseen] > 0)).mean()) if len(odds) else None
    return model


def _marks(batch: pa.RecordBatch) -> np.ndarray:
    texts = batch.column("text").to_pylist()
    return np.array([xxhash.xxh3_64_intdigest((t or "").encode("utf-8", "replace")) >> 1 for t in texts], dtype=np.int64)


def _features(sample: DataFrame, names: list[str]) -> DataFrame:
    """k (hash of doc_id), mark (of the text), y, and x, both views' features in half precision, of sample's rows."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        text, page = _views(batch)
        raw = [np.concatenate((t, p)).astype("<f2").tobytes() for t, p in zip(text, page, strict=True)]
        key = [zlib.crc32(repr(i).encode()) for i in batch.column("doc_id").to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(_marks(batch)), batch.column("y"), pa.array(raw, pa.binary())], ["k", "mark", "y", "x"])

    return map_chunks(sample.select(*names, "y"), run, "k long, mark long, y int, x binary")


def surest(docs: DataFrame, marked: DataFrame, names: list[str], lines: list, taken: list, most: dict, sure: float) -> list:
    """view, label, mark and doc_id of the documents that join a view: of all documents without a row in `marked` those
    that the other view is surest of, `most[label]` at most. Copies of a text count once; `taken` are each view's marks
    that have joined. Tasks send what a view holds `sure` or more, without texts or features."""
    shared = docs.sparkSession.sparkContext.broadcast((lines, [np.array(sorted(t), dtype=np.int64) for t in taken]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        views, marks = _views(batch), _marks(batch)
        at, cols = [], [[], [], [], []]
        for v in (0, 1):  # view v teaches the other
            w, a, b = shared.value[0][v]
            p = 1 / (1 + np.exp(-np.clip(a * _odds(views[v], w) + b, -30, 30)))
            free = ~np.isin(marks, shared.value[1][1 - v])
            for label, own in ((1, p), (0, 1 - p)):
                best = np.flatnonzero(free & (own >= sure))
                at.append(best)
                for col, values in zip(cols, (np.full(len(best), 1 - v), np.full(len(best), label), marks[best], own[best].astype(np.float64)), strict=True):
                    col.append(values)
        ids = batch.column("doc_id").take(pa.array(np.concatenate(at)))
        return pa.RecordBatch.from_arrays([ids, *[pa.array(np.concatenate(c)) for c in cols]], ["doc_id", "view", "label", "mark", "own"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = map_chunks(docs.where("doc_id IS NOT NULL").select(*names), run, f"doc_id {kind}, view long, label long, mark long, own double")
    found = found.join(marked.select("doc_id"), "doc_id", "left_anti")
    found = found.groupBy("view", "mark").agg(F.max(F.struct("own", "label", "doc_id")).alias("best"))
    found = cut(found.select("view", "mark", "best.*"), "surest")
    out = []
    for view in (0, 1):
        for label, n in most.items():
            out += found.where((F.col("view") == view) & (F.col("label") == label)).orderBy(F.desc("own"), "mark").limit(n).collect()  # bounded
    return out


def fit(docs: DataFrame, labels: DataFrame, *, labelled: int = 6000, pool: int = 6000, label: str = "quality", share: float = 0.1, sure: float = 0.9, **how) -> Model:
    """Co-trains on at most `labelled` rows with labels 0 or 1, the first by a hash of doc_id, and on documents without
    labels. In each round the other view's surest of all of these join a view, and only what it holds `sure` or more:
    at most `share` of their number, or of `pool` if they are more.

    Repeated labels of an id count once if they agree and are left out if not, as null ids and labels are. An id that
    several documents have takes the label for each, up to the bound again."""
    spark = docs.sparkSession
    marks = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id")
    marks = marks.agg(F.min(label).alias("y"), F.max(label).alias("z")).where("y = z").select("doc_id", F.col("y").cast("int"))
    order = F.xxhash64("doc_id", F.lit("quality"))
    rows = marks.withColumn("o", order).orderBy("o", "doc_id").limit(labelled).drop("o").collect()  # bounded
    if not rows:
        return Model(0.5)
    id_type = docs.schema["doc_id"].dataType
    names = ["doc_id", "text", *[c for c in ("source", "lang") if c in docs.columns]]

    def chosen(ids: list[tuple]) -> DataFrame:
        kind = T.StructType([T.StructField("own", id_type), T.StructField("y", T.IntegerType())])
        sample = docs.select(*names).join(F.broadcast(spark.createDataFrame(ids, kind)), F.col("doc_id") == F.col("own"))
        return _features(sample, names)

    x, y = np.zeros((labelled, CONTENT + METADATA), dtype=np.float32), []
    got = chosen([(r.doc_id, r.y) for r in rows]).orderBy("k", "x").limit(labelled)  # an id may come often: the bound holds for rows too
    for r in got.toLocalIterator():
        x[len(y)] = np.frombuffer(r.x, dtype="<f2")
        y.append(r.y)
    x = x[: len(y)]
    split = lambda a: (a[:, :CONTENT], a[:, CONTENT:])
    others = docs.select("doc_id").where("doc_id IS NOT NULL").join(labels.select("doc_id"), "doc_id", "left_anti").distinct()
    quota = int(others.limit(pool).count() * share)
    taken: list[set[int]] = [set(), set()]

    def draw(lines: list, prior: float) -> list:
        most = {1: int(quota * prior), 0: int(quota * (1 - prior))}
        found = surest(docs, labels, names, lines, taken, most, sure) if quota else []
        ids = sorted({r.doc_id for r in found})
        own: dict[int, np.ndarray] = {}
        wanted = {r.mark for r in found}
        for r in chosen([(i, -1) for i in ids]).toLocalIterator() if ids else ():
            if r.mark in wanted:
                # of rows with one text the same counts, whatever their order
                own[r.mark] = min(own.get(r.mark, r.x), r.x)
        out = []
        for view in (0, 1):
            mine = [r for r in found if r.view == view]
            taken[view].update(r.mark for r in mine)
            raw = np.array([np.frombuffer(own[r.mark], dtype="<f2") for r in mine], dtype=np.float32).reshape(-1, CONTENT + METADATA)
            out.append((split(raw)[view], np.array([float(r.label) for r in mine])))
        return out

    return co_train(split(x), np.array(y, dtype=float), draw, **how)


_SCORES = ("p_text", "p_page", "score")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with p_text, p_page and score, the probabilities of good quality by content, by metadata and by both.

    Columns of these names are replaced, all others stay. Null and empty texts have no content, null sources and
    languages no mark of their own; equal rows have equal scores; whole texts count, however long. Without labels of
    both kinds every score is the labels' smoothed share.
    """
    docs = without(docs, list(_SCORES))
    kept = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [shared.value.odds(_views(p)) for p in pieces(batch, 1 << 20)]
        cols = [1 / (1 + np.exp(-np.clip(np.concatenate(c), -30, 30).astype(np.float64))) for c in zip(*parts, strict=True)]
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *[pa.array(c) for c in cols]], [*kept, *_SCORES])

    return map_chunks(docs, run, T.StructType([*docs.schema.fields, *[T.StructField(c, T.DoubleType()) for c in _SCORES]]))


#: A document stays if its score is this or more.
KEEP = 0.5


def keep(docs: DataFrame, model: Model, least: float = KEEP) -> DataFrame:
    """The rows of docs whose score is `least` or more, as they are: columns named like scores keep their own values.
    Odd rows are scored as `score` says; repeated rows stay or go together; an empty table gives none."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        odds = np.concatenate([shared.value.odds(_views(p))[2] for p in pieces(batch, 1 << 20)])
        score = 1 / (1 + np.exp(-np.clip(odds, -30, 30).astype(np.float64)))
        return batch.filter(pa.array(score >= least))

    return map_chunks(docs, run, docs.schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, p_text, p_page, score, keep."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", *_SCORES, (F.col("score") >= KEEP).alias("keep"))
