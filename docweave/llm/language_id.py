"""Language spans of mixed text: script ranges, then Viterbi over per-word scores.

Words are letter runs of one script.  The script (by code point ranges) narrows the languages to those that
were seen with that script.  Each candidate scores the word by the log
probabilities of its padded character trigrams; a Viterbi path with a penalty
for each switch labels every word, and runs of one label are the spans.

The model is fitted on a bounded sample of labelled texts.  Texts are labelled
where they lie: all texts of a batch advance together, one word per step.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm.common import bounded_sample, map_batches

# First code points of script blocks, fixed values of the Unicode standard.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Thaana"), (0x07C0, "Other"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"),
    (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"),
    (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"),
    (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"),
    (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3400, "Han"),
    (0xA000, "Other"), (0xA640, "Cyrillic"), (0xA6A0, "Other"), (0xA720, "Latin"), (0xA800, "Other"),
    (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"),
    (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFE70, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"),
    (0xFFA0, "Other"), (0x20000, "Han"),
]
_STARTS = [start for start, _ in SCRIPTS]
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})
LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
CHUNK_CHARS = 8_000_000    # texts labelled together hold about this many characters
LONGEST_KEPT = 64          # longer words, as of scripts without blanks, are scored whole but not remembered


def script_of(word: str) -> str:
    return SCRIPTS[bisect_right(_STARTS, ord(word[0])) - 1][1]


def words_of_text(text: str) -> list[str]:
    """Lower-cased runs of letters of one script, in order."""
    words = []
    for run in LETTERS.findall(text.lower()):
        if run.isascii():
            words.append(run)
            continue
        begin, script = 0, script_of(run)
        for i, letter in enumerate(run):
            other = SCRIPTS[bisect_right(_STARTS, ord(letter)) - 1][1]
            if other != script:
                words.append(run[begin:i])
                begin, script = i, other
        words.append(run[begin:])
    return words


def trigrams(word: str) -> list[str]:
    padded = f" {word} "
    return [padded[i:i + 3] for i in range(len(padded) - 2)]


@dataclass
class LanguageModel:
    languages: list[str]
    grams: dict[str, int]      # trigram -> row of ``weights``; row 0 is an unseen trigram
    weights: np.ndarray        # (grams + 1, languages) log probabilities
    barred: dict[str, np.ndarray]  # script -> penalty of each language that does not use it
    penalty: float


_COUNTS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.StringType()),
                        T.StructField("n", T.LongType())])


def fit_languages(training: DataFrame, lang_col: str = "lang", text_col: str = "text", sample_texts: int = 500,
                  max_grams: int = 30_000, penalty: float = 8.0) -> LanguageModel:
    """A model from a bounded sample: ``sample_texts`` texts of each non-null language.

    The sample is chosen by a hash of the text, the same at every size; the
    most frequent ``max_grams`` trigrams of each language are kept, so what
    reaches the driver is bounded.
    """
    labelled = training.select(training[lang_col].alias("lang"), training[text_col].alias("text")).dropna()
    sample = bounded_sample(labelled, "lang", F.xxhash64("text"), sample_texts)

    def count(batch: pa.RecordBatch) -> dict:
        found: dict = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            for word in words_of_text(text):
                for gram in (*trigrams(word), "\n" + script_of(word)):
                    found[lang, gram] = found.get((lang, gram), 0) + 1
        return {"lang": [k[0] for k in found], "gram": [k[1] for k in found], "n": list(found.values())}

    counts = map_batches(sample.select("lang", "text"), count, _COUNTS).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = counts.withColumn("r", F.row_number().over(top)).filter(F.col("r") <= max_grams).collect()
    languages = sorted({r["lang"] for r in rows})
    grams: dict[str, int] = {}
    for r in rows:
        if r["gram"][0] != "\n":
            grams.setdefault(r["gram"], len(grams) + 1)
    table = np.full((len(grams) + 1, len(languages)), 0.5)
    scripts = {s: np.zeros(len(languages)) for s in SCRIPT_NAMES}
    for r in rows:
        k = languages.index(r["lang"])
        if r["gram"][0] == "\n":
            scripts[r["gram"][1:]][k] = r["n"]
        else:
            table[grams[r["gram"]], k] += r["n"]
    weights = np.log(table) - np.log(table.sum(axis=0, keepdims=True))
    share = {s: n / np.maximum(1, sum(scripts.values())) for s, n in scripts.items()}
    barred = {s: np.where(x >= 0.005, 0.0, -40.0) if (x >= 0.005).any() else np.zeros(len(languages))
              for s, x in share.items()}
    return LanguageModel(languages, grams, weights, barred, penalty)


class Labeller:
    """Scores words (memoised, bounded) and finds the best paths of many texts at once."""

    def __init__(self, model: LanguageModel, remember: int = 400_000):
        self.model, self.remember = model, remember
        self.ids: dict[str, int] = {}
        self.scores = np.empty((0, len(model.languages)))

    def _score(self, words: list[str]) -> np.ndarray:
        """Log score of every language for each word, relative to the best."""
        row = self.model.grams.get
        sums = np.empty((len(words), len(self.model.languages)))
        for begin in range(0, len(words), 20_000):
            found = [[row(g, 0) for g in trigrams(w)] for w in words[begin:begin + 20_000]]
            starts = np.cumsum([0, *map(len, found[:-1])])
            flat = np.fromiter((g for f in found for g in f), np.int64)
            sums[begin:begin + len(found)] = np.add.reduceat(self.model.weights[flat], starts, axis=0)
        sums += np.stack([self.model.barred[script_of(w)] for w in words])
        return sums - sums.max(axis=1, keepdims=True)

    def _learn(self, words: list[str]) -> tuple[dict[str, int], np.ndarray]:
        """Ids of the words and the scores by id; those of long words hold for this call only."""
        distinct = dict.fromkeys(words)
        short = [w for w in distinct if len(w) <= LONGEST_KEPT]
        fresh = [w for w in short if w not in self.ids]
        if fresh:
            if len(self.ids) + len(fresh) > self.remember:
                fresh, self.ids, self.scores = short, {}, self.scores[:0]
            scores = self._score(fresh)
            for w in fresh:
                self.ids[w] = len(self.ids)
            self.scores = np.concatenate([self.scores, scores])
        long = [w for w in distinct if len(w) > LONGEST_KEPT]
        if not long:
            return self.ids, self.scores
        ids = self.ids | {w: len(self.ids) + k for k, w in enumerate(long)}
        return ids, np.concatenate([self.scores, self._score(long)])

    def paths(self, per_text: list[list[str]]) -> list[np.ndarray]:
        """For each text, a list of words, the language (its index) of every word."""
        words = [w for ws in per_text for w in ws]
        lengths = np.array([len(ws) for ws in per_text], np.int64)
        if not words or not self.model.languages:
            return [np.empty(0, np.int16) for _ in per_text]
        ids, scores = self._learn(words)
        flat = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
        del words, ids
        order = np.argsort(-lengths, kind="stable")
        starts = (np.cumsum(lengths) - lengths)[order]
        sizes = lengths[order]
        longest = int(sizes[0])
        active = np.searchsorted(-sizes, -np.arange(longest), side="left")  # texts longer than t
        value = scores[flat[starts[:active[0]]]]
        back, label = [], np.empty(len(flat), np.int16)
        last = np.zeros(len(sizes), np.int16)
        for t in range(1, longest):
            n = active[t]
            if n < len(value):
                last[n:len(value)] = value[n:].argmax(axis=1)
                value = value[:n]
            best = value.argmax(axis=1)
            switched = (value[np.arange(n), best] - self.model.penalty)[:, None]
            stay = value >= switched
            back.append((stay, best.astype(np.int16)))
            value = np.where(stay, value, switched) + scores[flat[starts[:n] + t]]
        last[:len(value)] = value.argmax(axis=1)
        for t in range(longest - 1, -1, -1):
            n = active[t]
            label[starts[:n] + t] = last[:n]
            if t:
                stay, best = back[t - 1]
                last[:n] = np.where(stay[np.arange(n), last[:n]], last[:n], best)
        begin = np.cumsum(lengths) - lengths
        return [label[b:b + n] for b, n in zip(begin, lengths)]


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                                  T.StructField("lang", T.StringType())]))
_LABELLED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang_pred", T.StringType()),
                          T.StructField("score", T.DoubleType()), T.StructField("spans", SPANS)])


def label_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, spans) of every row of ``docs``.

    ``spans`` are runs of words (letter runs of one script, counted from 0, end
    excluded) with one language.  ``lang_pred`` is the language of most letters,
    the first by name in a tie; ``score`` is its share of the letters: words
    would not do for scripts without blanks.  A null text
    or one without a letter gets ``und``, score 0 and no spans, and so does every text
    under a model without languages.  Repeated rows give repeated rows; an
    empty table gives an empty result; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    holder: list[Labeller] = []

    def label(batch: pa.RecordBatch) -> dict:
        if not holder:
            holder.append(Labeller(shared.value))
        languages = shared.value.languages
        found, letters, chunk, size = [], [], [], 0
        for value in batch.column(1):
            text = value.as_py() or ""
            chunk.append(words_of_text(text))
            letters.append(np.fromiter(map(len, chunk[-1]), np.int64, len(chunk[-1])))
            size += len(text)
            if size >= CHUNK_CHARS:
                found.extend(holder[0].paths(chunk))
                chunk, size = [], 0
        found.extend(holder[0].paths(chunk))
        pred, score, spans = [], [], []
        for path, sizes in zip(found, letters):
            if not len(path):
                pred.append(UNKNOWN), score.append(0.0), spans.append([])
                continue
            counts = np.bincount(path, weights=sizes, minlength=len(languages))
            k = int(counts.argmax())
            cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
            pred.append(languages[k])
            score.append(float(counts[k] / sizes.sum()))
            spans.append([{"start": a, "end": b, "lang": languages[path[a]]} for a, b in zip(cuts, cuts[1:])])
        return {"doc_id": batch.column(0), "lang_pred": pred, "score": score, "spans": spans}

    return map_batches(docs.select(docs[id_col].cast("long"), docs[text_col]), label, _LABELLED)
