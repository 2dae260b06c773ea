"""Quality by co-training a text-content and a page-metadata classifier.

The content view sees which telling words a text has and its shape (symbols,
capitals, repeats); the metadata view sees language, source and stated
length.  Each round both are fitted and calibrated, score every unlabelled row,
label those that they are most sure of, and hand these labels to the other view.
At the end their calibrated log-odds are added (less the prior, counted once) and
every document is scored where it lies.

The labelled rows of a fit are a bounded sample chosen by a hash.  Unlabelled
rows all take part: their features are stored once, every round scores them on
Spark, and only the surest ``handed`` rows of each class and view reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docweave.llm.common import bounded_sample, filter_batches, map_batches, map_partitions, sized, staged

_FOLD = bytes(ord(chr(c).lower()) if c < 128 and chr(c).isalnum() else (c if c >= 128 else 32) for c in range(256))
_LOWER = bytes(range(97, 123))
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_ODD = b"#*$%&|<>!@^~={}[]\\"
SOURCE_BUCKETS = 64
LANGUAGE_BUCKETS = 16


@dataclass(frozen=True)
class CoTraining:
    """Bounds and settings of the fit."""
    labelled: int = 2_500       # labelled rows of each class that the fit uses at most
    words: int = 300            # telling words of the content view
    least_documents: int = 3    # labelled documents that a telling word stands in
    rounds: int = 3
    sure: float = 0.97          # calibrated probability that a pseudo-label needs
    handed: int = 300           # pseudo-labels of each class that a view hands over in a round
    ridge: float = 0.5


def _share(part: int, whole: int) -> float:
    return math.sqrt(part / whole) if whole else 0.0


def content_terms(data: bytes) -> set[bytes]:
    return set(data.translate(_FOLD).split())


def shape(data: bytes, terms: set[bytes]) -> list[float]:
    """Shape of a text: length, word length, shares of symbols, capitals, digits, repeats."""
    n, words = len(data), data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    upper, lower = n - len(data.translate(None, _UPPER)), n - len(data.translate(None, _LOWER))
    return [math.log1p(len(words)) / 10, (sum(map(len, words)) / len(words) / 10) if words else 0.0,
            _share(n - len(data.translate(None, _ODD)), n), _share(upper, upper + lower),
            _share(n - len(data.translate(None, _DIGITS)), n),
            math.log1p(len(terms)) / math.log1p(len(words)) if words else 1.0,
            _share(len(lines) - len(set(lines)), len(lines)), _share(data.count(b"|"), len(words))]


SHAPES = 8


def content_features(data: bytes, vocabulary: dict[bytes, int]) -> tuple[bytes, bytes]:
    """(shape as FLOATs, sorted numbers of the telling words it has as 16-bit numbers) of a text."""
    terms = content_terms(data)
    found = sorted(vocabulary[t] for t in terms & vocabulary.keys())
    return np.array(shape(data, terms), np.float32).tobytes(), np.array(found, np.uint16).tobytes()


def metadata_features(lang: str | None, source: str | None, n_chars: int | None) -> tuple[float, bool, int, int]:
    """(size, whether it is missing, bucket of the language, bucket of the source)."""
    return (math.log1p(max(0, n_chars or 0)) / 10, n_chars is None, crc32((lang or "").encode()) % LANGUAGE_BUCKETS,
            crc32((source or "").encode()) % SOURCE_BUCKETS)


def content_rows(shapes: list[bytes], words: list[bytes], vocabulary: int) -> np.ndarray:
    """Dense rows of the content view: intercept, shape, its squares, telling words."""
    rows = np.zeros((len(shapes), 1 + 2 * SHAPES + vocabulary))
    form = np.frombuffer(b"".join(shapes), np.float32).reshape(-1, SHAPES)
    rows[:, 0] = 1.0
    rows[:, 1:1 + SHAPES] = form
    rows[:, 1 + SHAPES:1 + 2 * SHAPES] = form.astype(np.float64) ** 2
    for row, found in zip(rows, words):
        row[1 + 2 * SHAPES + np.frombuffer(found, np.uint16).astype(np.int64)] = 1.0
    return rows


def metadata_rows(size, missing, lang, source) -> np.ndarray:
    """Dense rows of the metadata view: intercept, size, its square, missing, language and source buckets."""
    size = np.asarray(size, np.float64)
    rows = np.zeros((len(size), 4 + LANGUAGE_BUCKETS + SOURCE_BUCKETS))
    rows[:, 0], rows[:, 1], rows[:, 2], rows[:, 3] = 1.0, size, size * size, np.asarray(missing, np.float64)
    at = np.arange(len(size))
    rows[at, 4 + np.asarray(lang, np.int64)] = 1.0
    rows[at, 4 + LANGUAGE_BUCKETS + np.asarray(source, np.int64)] = 1.0
    return rows


def logistic(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 12) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the first column is the intercept."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty * w
        hess = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 5.0 / max(1e-12, float(np.abs(x @ step).max())) if len(x) else 1.0)
    return w


@dataclass
class View:
    """A linear view and its calibration: log-odds = scale * (row @ weights) + shift."""
    weights: np.ndarray
    scale: float
    shift: float

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        return np.clip(self.scale * (rows @ self.weights) + self.shift, -30, 30)


def fit_view(rows: np.ndarray, bad: np.ndarray, own: np.ndarray, ridge: float) -> View:
    """Fits on all rows; calibrates on out-of-fold scores of the truly labelled ones (``own``)."""
    fold = np.arange(len(rows)) % 3
    held = np.zeros(len(rows))
    for k in range(3):
        held[fold == k] = rows[fold == k] @ logistic(rows[fold != k], bad[fold != k], ridge)
    held = held[own]
    scale, shift = 1.0, 0.0
    if len(held) and 0 < bad[own].sum() < own.sum():
        shift, scale = logistic(np.stack([np.ones(len(held)), held], axis=1), bad[own], 1.0)
    return View(logistic(rows, bad, ridge), max(0.0, float(scale)), float(shift))


@dataclass
class QualityModel:
    vocabulary: dict[bytes, int]
    content: View
    metadata: View
    prior: float   # log-odds of a bad document among the labelled rows

    def bad_log_odds(self, content: np.ndarray, metadata: np.ndarray) -> np.ndarray:
        return self.content.log_odds(content) + self.metadata.log_odds(metadata) - self.prior


# Rows handed over: (numbers that tell rows apart, their rows in the view that learns from them).
Handed = tuple[np.ndarray, np.ndarray]


def co_train(content: np.ndarray, metadata: np.ndarray, label: np.ndarray, s: CoTraining,
             surest: Callable[[list[View], list[set]], list[list[Handed]]]) -> tuple[View, View, float]:
    """Fitted views and prior from labelled rows (1 bad, 0 good) and the rows that ``surest`` hands over each round.

    ``surest(views, taken)`` gives for each view the surest bad and the surest
    good of all unlabelled rows, as rows of the other view, without those that
    the other view has been given (``taken``).
    """
    share = min(max(float(label.mean()), 1e-3), 1 - 1e-3)
    prior = math.log(share / (1 - share))
    rows, bad = [content, metadata], [label.astype(float), label.astype(float)]
    taken: list[set] = [set(), set()]
    for k in range(s.rounds + 1):
        fitted = [fit_view(x, y, np.arange(len(x)) < len(label), s.ridge) for x, y in zip(rows, bad)]
        if k == s.rounds:
            break
        for i, classes in enumerate(surest(fitted, taken)):
            other = 1 - i
            for value, (keys, found) in zip((1.0, 0.0), classes):
                if len(keys):
                    taken[other].update(keys.tolist())
                    rows[other] = np.concatenate([rows[other], found])
                    bad[other] = np.concatenate([bad[other], np.full(len(keys), value)])
    return fitted[0], fitted[1], prior


def surest_rows(odds: np.ndarray, keys: np.ndarray, taken: set, s: CoTraining) -> np.ndarray:
    """Places of the at most ``handed`` rows with the largest odds, sure enough and not taken; equal keys count once.

    Odds count to 9 decimals and the smaller key comes first in a tie.
    """
    odds = np.round(odds, 9)
    free = np.flatnonzero(odds >= math.log(s.sure / (1 - s.sure)))
    free = free[~np.isin(keys[free], np.fromiter(taken, np.int64, len(taken)))]
    order = free[np.lexsort((keys[free], -odds[free]))]
    _, first = np.unique(keys[order], return_index=True)
    return order[np.sort(first)][:s.handed]


_FEATURES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("key", T.LongType()), T.StructField("shape", T.BinaryType()),
    T.StructField("words", T.BinaryType()), T.StructField("size", T.DoubleType()), T.StructField("missing", T.BooleanType()),
    T.StructField("lang", T.IntegerType()), T.StructField("source", T.IntegerType())])
# A row that a view is sure of: view (0 content, 1 metadata), class (1 bad, 0 good), odds of that class.
_SURE = T.StructType([T.StructField("view", T.IntegerType()), T.StructField("bad", T.IntegerType()),
                      T.StructField("odds", T.DoubleType()), *_FEATURES.fields[1:]])
_WORDS = T.StructType([T.StructField("word", T.BinaryType()), T.StructField("good", T.LongType()),
                       T.StructField("bad", T.LongType())])
_SCORED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType()),
                        T.StructField("kept", T.BooleanType())])


def _telling_words(sample: DataFrame, s: CoTraining) -> dict[bytes, int]:
    """The words whose presence departs most from independence of the label (likelihood ratio)."""
    def count(batch: pa.RecordBatch) -> dict:
        found: dict = {}
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            for t in content_terms(text or b""):
                if len(t) <= 64:
                    found.setdefault(t, [0, 0])[label] += 1
        return {"word": list(found), "good": [v[0] for v in found.values()], "bad": [v[1] for v in found.values()]}

    counts = (map_batches(sample.select("text", "label"), count, _WORDS).groupBy("word")
              .agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
              .filter(F.col("good") + F.col("bad") >= s.least_documents))
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n, bad = sum(sizes.values()), sizes.get(1, 0)
    if not 0 < bad < n:
        return {}
    seen = F.col("good") + F.col("bad")

    def term(observed, expected):
        return F.when(observed > 0, observed * F.ln(observed / expected)).otherwise(0.0)

    ratio = (term(F.col("bad"), seen * bad / n) + term(F.col("good"), seen * (n - bad) / n)
             + term(F.lit(bad) - F.col("bad"), (F.lit(n) - seen) * bad / n)
             + term(F.lit(n - bad) - F.col("good"), (F.lit(n) - seen) * (n - bad) / n))
    top = counts.withColumn("g", F.round(ratio, 9)).filter("g >= 4").orderBy(F.desc("g"), "word").limit(s.words)
    return {bytes(r["word"]): k for k, r in enumerate(top.collect())}


def _features(rows: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``_FEATURES`` of rows (doc_id, key, text, lang, source, n_chars)."""
    def features(batch: pa.RecordBatch) -> dict:
        content = [content_features(t.as_py() or b"", vocabulary) for t in batch.column("text")]
        about = [metadata_features(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")))]
        columns = [list(c) for c in zip(*content)] or [[], []], [list(c) for c in zip(*about)] or [[], [], [], []]
        return {"doc_id": batch.column("doc_id"), "key": batch.column("key"),
                **dict(zip(("shape", "words"), columns[0])),
                **dict(zip(("size", "missing", "lang", "source"), columns[1]))}

    return map_batches(rows, features, _FEATURES)


def _dense(table: pa.Table | pa.RecordBatch, vocabulary: int) -> list[np.ndarray]:
    """The rows of both views of a table or batch of features."""
    columns = {c: table.column(c).to_pylist() for c in ("shape", "words", "size", "missing", "lang", "source")}
    return [content_rows(columns["shape"], columns["words"], vocabulary),
            metadata_rows(columns["size"], columns["missing"], columns["lang"], columns["source"])]


def _surest_on_spark(unlabelled: DataFrame, vocabulary: int, s: CoTraining) -> Callable:
    """``surest`` of ``co_train`` over a stored table of features.

    A task keeps the surest rows of each view and class of its partition; the
    best of these reach the driver: views times classes times ``handed`` rows.
    """
    spark = unlabelled.sparkSession

    def surest(views: list[View], taken: list[set]) -> list[list[Handed]]:
        shared = spark.sparkContext.broadcast((views, taken))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            views, taken = shared.value
            kept: dict[tuple[int, int], pa.Table] = {}
            for whole in batches:
                for start in range(0, whole.num_rows, 2000):
                    batch = whole.slice(start, 2000)
                    keys = np.asarray(batch.column("key"))
                    for i, (view, rows) in enumerate(zip(views, _dense(batch, vocabulary))):
                        odds = view.log_odds(rows)
                        for bad, signed in ((1, odds), (0, -odds)):
                            at = surest_rows(signed, keys, taken[1 - i], s)
                            if not len(at):
                                continue
                            part = pa.table({**{c: batch.column(c).take(pa.array(at)) for c in _SURE.names[3:]},
                                             "odds": np.round(signed[at], 9)})
                            if (i, bad) in kept:
                                part = pa.concat_tables([kept[i, bad], part])
                                best = surest_rows(np.asarray(part["odds"]), np.asarray(part["key"]), set(), s)
                                part = part.take(pa.array(best))
                            kept[i, bad] = part
            for (i, bad), part in kept.items():
                n = len(part)
                part = part.append_column("view", pa.array([i] * n, pa.int32())).append_column(
                    "bad", pa.array([bad] * n, pa.int32()))
                yield from part.select(_SURE.names).cast(to_arrow_schema(_SURE)).to_batches()

        sure = staged(map_partitions(unlabelled, run, _SURE), "sure-rows")
        out = []
        for i in (0, 1):
            classes = []
            for bad in (1, 0):
                mine = sure.filter((F.col("view") == i) & (F.col("bad") == bad)).dropDuplicates(["key"])
                best = mine.orderBy(F.desc("odds"), "key").limit(s.handed).toArrow()
                classes.append((np.asarray(best["key"]), _dense(best, vocabulary)[1 - i]))
            out.append(classes)
        shared.unpersist()
        return out

    return surest


def fit_quality(docs: DataFrame, labels: DataFrame, settings: CoTraining = CoTraining(), id_col: str = "doc_id",
                text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                chars_col: str = "n_chars") -> QualityModel | None:
    """Co-trained model of bad documents (quality 0 or toxic 1), or None without labels of both kinds.

    Labels with a null are ignored; an id labelled more than once is bad if any
    of its labels is.  At most ``settings.labelled`` rows of each class enter the
    fit, chosen by a hash of the id; of rows that repeat a labelled id the least
    in the order of text, language, source and length.  Every row without label,
    those with a null id too, can be handed over; rows alike in all columns
    count once.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("binary").alias("text"),
                       docs[lang_col].alias("lang"), docs[source_col].alias("source"),
                       docs[chars_col].cast("long").alias("n_chars"))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text", "lang", "source", "n_chars"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").dropna()
    known = staged(known.groupBy("doc_id").agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("long"))
                                               .alias("label")), "quality-labels")
    # Ids are chosen before any text is read.
    ids = rows.select("doc_id").join(sized(known, 16), "doc_id")
    chosen = staged(bounded_sample(ids, "label", F.xxhash64("doc_id"), settings.labelled), "quality-ids")
    whole = F.min(F.struct("text", "lang", "source", "n_chars", "key")).alias("r")
    sample = staged(rows.join(sized(chosen, 16), "doc_id").groupBy("doc_id").agg(whole, F.max("label").alias("label"))
                    .select("doc_id", "r.*", "label"), "quality-sample")
    counts = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if set(counts) != {0, 1}:
        return None
    vocabulary = _telling_words(sample, settings)
    labelled = _features(sample, vocabulary).join(chosen, "doc_id").orderBy("doc_id").toArrow()
    views = _dense(labelled, len(vocabulary))
    # Features are small: they are stored for all rows, and those with a label are left out afterwards.
    features = staged(_features(rows, vocabulary), "quality-features")
    unlabelled = staged(features.join(sized(known.select("doc_id"), 16), "doc_id", "left_anti"), "quality-unlabelled")
    return QualityModel(vocabulary, *co_train(*views, labelled["label"].to_numpy(), settings,
                                              _surest_on_spark(unlabelled, len(vocabulary), settings)))


def _good_probability(model: QualityModel | None, texts: list, lang: list, source: list, n_chars: list) -> np.ndarray:
    if model is None:
        return np.full(len(texts), 0.5)
    if not texts:
        return np.empty(0)
    shapes, words = zip(*(content_features((t or "").encode(), model.vocabulary) for t in texts))
    about = zip(*(metadata_features(*x) for x in zip(lang, source, n_chars)))
    odds = model.bad_log_odds(content_rows(shapes, words, len(model.vocabulary)), metadata_rows(*about))
    return 1 / (1 + np.exp(np.clip(odds, -30, 30)))


def score_quality(docs: DataFrame, model: QualityModel | None, least: float = 0.5, id_col: str = "doc_id",
                  text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                  chars_col: str = "n_chars") -> DataFrame:
    """(doc_id, score, kept) of every row of ``docs``: probability of a good document.

    ``kept`` says score >= ``least``.  Without a model the score is 0.5 and
    every row is kept.  Whole texts are scored; a null text counts as empty, null
    metadata as values of their own; repeated rows give repeated rows; an
    empty table gives an empty result.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col], docs[lang_col], docs[source_col],
                       docs[chars_col].cast("long"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batch: pa.RecordBatch) -> dict:
        values = _good_probability(shared.value, *(batch.column(k).to_pylist() for k in range(1, 5)))
        kept = np.ones(len(values), bool) if shared.value is None else values >= least
        return {"doc_id": batch.column(0), "score": values, "kept": kept}

    return map_batches(rows, score, _SCORED, rows=256)


def good_documents(docs: DataFrame, model: QualityModel | None, least: float = 0.5, text_col: str = "text",
                   lang_col: str = "lang", source_col: str = "source", chars_col: str = "n_chars") -> DataFrame:
    """The rows of ``docs``, all columns, that ``score_quality`` keeps."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batch: pa.RecordBatch) -> list:
        if shared.value is None:
            return [True] * batch.num_rows
        good: list = []
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            columns = (part.column(c).to_pylist() for c in (text_col, lang_col, source_col, chars_col))
            good.extend((_good_probability(shared.value, *columns) >= least).tolist())
        return good

    return filter_batches(docs, keep)
