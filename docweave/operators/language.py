"""Language profiles and detection (F13, F14) and summary routing.

Detection is a character-trigram naive Bayes classifier trained and applied
as Spark jobs.  Trigrams are taken inside words padded with one space on each
side (Cavnar and Trenkle, 1994).  Words are counted first (partial
aggregation), so each distinct word of a text is expanded into trigrams once,
then counts are summed per trigram.  A text is scored on its own row where the
profile is small enough to be everywhere, else through a join on the trigram.
Whole texts are used.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.constants import RANK_DECIMALS
from docweave.functions.arrow import by_pieces
from docweave.functions.vectors import exploded
from docweave.plans.sizing import fits, materialize


LETTER_RUN = r"\p{L}+"

# Every overlapping run of three characters: a zero-width lookahead match at
# each position captures the next three.  One linear regex pass per string
# (indexing a UTF-8 string by character position would be quadratic).
TRIGRAM = r"(?=(.{3}))"


def letter_words(text: Column) -> Column:
    """Lower-cased runs of letters."""
    return F.regexp_extract_all(F.lower(text), F.lit(LETTER_RUN), 0)


def spaced_letter_words(text: Column) -> Column:
    """``letter_words`` in one string, apart by spaces."""
    return F.regexp_replace(F.lower(text), r"\P{L}+", " ")


def word_trigrams(word: Column) -> Column:
    """Trigrams of " word " (the word padded with one space on each side)."""
    return F.regexp_extract_all(F.concat(F.lit(" "), word, F.lit(" ")), F.lit(TRIGRAM), 1)


def letter_count(text: Column) -> Column:
    """Trigrams in a text = letters in its lower-cased letter runs (" word " has len(word))."""
    return F.length(F.regexp_replace(F.lower(text), r"\P{L}+", "")).cast("bigint")


def gram_counts(df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys..., gram, tf): trigram counts of each text."""
    word_counts = (exploded(df, letter_words(F.col(text_col)), "_i", "word", *keys)
                   .groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("_n")))
    return (exploded(word_counts, word_trigrams(F.col("word")), "_i", "gram", *keys, "_n")
            .groupBy(*keys, "gram").agg(F.sum("_n").cast("bigint").alias("tf")))


def language_profiles(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """F14. (lang, gram, logp, unseen, prior): add-one smoothed trigram log-probabilities.

    ``unseen`` is the log-probability given to a trigram the language never
    showed; ``prior`` is the log share of training texts in the language.
    """
    # Training is a fit step: the counts are stored once in the shared
    # checkpoint folder, then read for the vocabulary size and the profile.
    counts = materialize(gram_counts(labelled.withColumnRenamed(lang_col, "lang"), ["lang"], text_col),
                         "trigram-counts")
    vocab = counts.select("gram").distinct().agg(F.count(F.lit(1))).scalar()
    all_docs = labelled.agg(F.count(F.lit(1))).scalar()
    # Trigram totals per language from the stored counts; the texts are not read again.
    # A trigram that the lookahead starts inside a surrogate pair begins with "?" and stands for no letter.
    totals = counts.filter(~F.col("gram").startswith("?")).groupBy("lang").agg(F.sum("tf").alias("_total"))
    per_lang = labelled.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("_docs")).join(totals, "lang")
    # One row per language; the two totals are scalar subqueries.
    stats = per_lang.select("lang", (F.col("_total") + vocab).alias("_den"),
                            F.log(F.col("_docs") / all_docs).alias("prior"))
    # One row per language: AQE broadcasts it from its runtime size.
    return (counts.join(stats, "lang")
            .select("lang", "gram",
                    F.log((F.col("tf") + 1.0) / F.col("_den")).alias("logp"),
                    F.log(F.lit(1.0) / F.col("_den")).alias("unseen"), "prior"))


# Bytes of a trigram's entry in the lookup table, besides a gain for each language.
GRAM_BYTES = 256
# Words whose gains a task remembers.
KNOWN_WORDS = 1 << 18
# Texts that are scored at once.
SCORED_TEXTS = 1024


def gram_lookup(profiles: DataFrame) -> tuple[list[tuple[str, float, float]], dict[str, tuple[float, ...]]]:
    """(languages, gains) of a profile; callers check its size first.

    ``languages`` are (lang, unseen, prior) by name; ``gains`` has for each trigram
    a number for each language.
    """
    rows = profiles.select("lang", "gram", (F.col("logp") - F.col("unseen")).alias("gain"), "unseen", "prior").collect()
    langs = sorted({(r["lang"], r["unseen"], r["prior"]) for r in rows})
    place = {lang: i for i, (lang, _, _) in enumerate(langs)}
    gains: dict[str, list[float]] = {}
    for r in rows:
        gains.setdefault(r["gram"], [0.0] * len(langs))[place[r["lang"]]] = r["gain"]
    return langs, {gram: tuple(own) for gram, own in gains.items()}


def _best_languages(langs: list[tuple[str, float, float]], gains: dict[str, tuple[float, ...]]):
    """A function of ``spaced_letter_words`` of texts: (language, score) columns; the first by name in a tie.

    A text's score is summed over its words, and a word's gains over its trigrams
    are worked out once for as long as the task remembers it.
    """
    names = np.array([lang[:2] for lang, _, _ in langs], dtype=object)
    unseen, prior = (np.array([x[k] for x in langs], dtype=np.float64) for k in (1, 2))
    nothing = (0.0,) * len(langs)
    new: list[tuple[float, ...]] = []
    met: list[str] = []

    class Words(dict):
        """Row of each known word in ``table``, which ``new`` (of the words ``met``) is added to after a piece."""

        def __missing__(self, word: str) -> int:
            padded = f" {word} "
            grams = [padded[i:i + 3] for i in range(len(word))]
            if max(word) > "\uffff":  # as ``word_trigrams`` has them: once more from the middle of a surrogate pair
                grams += ["?" + padded[i + 2:i + 4] for i, c in enumerate(word) if c > "\uffff" and i + 4 <= len(padded)]
            found = [gains[g] for g in grams if g in gains]
            new.append((*(map(sum, zip(*found)) if found else nothing), float(len(word))))
            met.append(word)
            self[word] = row = len(self)
            return row

    known, table = Words(), np.zeros((len(langs) + 1, 0))  # a gain for each language, and the letters

    def best(words: pa.Array) -> list[pa.Array]:
        nonlocal table
        texts = len(words)
        if not langs:
            return [pa.nulls(texts, pa.string()), pa.nulls(texts, pa.float64())]
        spoken = [text.split() if text else [] for text in words.to_pylist()]
        sizes = np.fromiter(map(len, spoken), np.int64, texts)
        at = np.fromiter(map(known.__getitem__, chain.from_iterable(spoken)), np.int64, int(sizes.sum()))
        if new:
            table = np.concatenate([table, np.array(new, dtype=np.float64).T], axis=1)
        row, own = np.repeat(np.arange(texts), sizes), table
        if len(known) > KNOWN_WORDS:  # the words met first stay: the frequent ones are among them
            for word in met[KNOWN_WORDS - len(known):]:
                del known[word]
            table = table[:, :KNOWN_WORDS]
        new.clear()
        met.clear()

        def summed(k: int) -> np.ndarray:
            return np.bincount(row, own[k][at], minlength=texts)

        count = summed(len(langs))
        scores = np.stack([prior[k] + count * unseen[k] + summed(k) for k in range(len(langs))], axis=1)
        scores = np.round(scores, RANK_DECIMALS)
        at = scores.argmax(axis=1)
        return [pa.array(names[at], pa.string()), pa.array(scores[np.arange(texts), at])]

    return best


def with_language(texts: DataFrame, profiles: DataFrame, profile_rows: int, text_col: str = "text",
                  lang_col: str = "lang", score_col: str | None = None) -> DataFrame | None:
    """F13 on the row: ``texts`` with the most probable language (and its score); None if the profile is too large.

    No trigram becomes a row and nothing is shuffled: the JVM finds the letter words
    of texts, and numpy adds up their gains from ``gram_lookup``, which every
    task gets.
    """
    per_gram = GRAM_BYTES + 32 * profiles.select("lang").distinct().count()
    if not fits(profile_rows, per_gram):
        return None
    best = _best_languages(*gram_lookup(profiles))
    names = {lang_col: T.StringType()} | ({score_col: T.DoubleType()} if score_col else {})
    kept = texts.select(*[c for c in texts.columns if c not in names])
    columns = kept.columns
    schema = T.StructType([*kept.schema.fields, *[T.StructField(c, kind) for c, kind in names.items()]])
    words = texts.select(*[F.col(c) for c in columns], spaced_letter_words(F.col(text_col)).alias("_words"))
    return by_pieces(words, lambda part: [*[part.column(c) for c in columns], *best(part.column("_words"))[:len(names)]],
                     schema, SCORED_TEXTS)


def detect_language(texts: DataFrame, profiles: DataFrame, keys: list[str],
                    text_col: str = "text", profile_rows: int | None = None) -> DataFrame:
    """F13. Most probable language of every text: (keys..., lang, score).

    score(lang) = prior + sum over trigrams of tf * logp, with ``unseen`` for
    trigrams the language lacks.  Every language competes for every text; a
    text without letters (or NULL) gets the language with the best prior.
    ``lang`` is cut to two letters; ties go to the first by name.

    With a profile of ``profile_rows`` rows that every task can hold, texts are
    scored where they are (``with_language``); a larger one, or one of unknown
    size, is joined by trigram.
    """
    if profile_rows:
        found = with_language(texts.select(*keys, text_col), profiles, profile_rows, text_col, "lang", "score")
        if found is not None:  # stored: small rows, which nobody has to score again
            return materialize(found.select(*keys, "lang", "score"), "languages")
    prof = profiles.select("lang", "gram", (F.col("logp") - F.col("unseen")).alias("_gain"))
    grams = exploded(texts, F.flatten(F.transform(letter_words(F.col(text_col)), word_trigrams)), "_i", "gram", *keys)
    gains = grams.join(prof, "gram").select(*keys, "lang", "_gain", F.lit(0).cast("bigint").alias("_letters"))
    # One row per language, as a scalar subquery: every text starts with a row for each.
    per_lang = profiles.groupBy("lang").agg(F.max("unseen").alias("unseen"), F.max("prior").alias("prior"))
    langs = per_lang.agg(F.collect_list(F.struct("lang", "unseen", "prior"))).scalar()
    letters = F.coalesce(letter_count(F.col(text_col)), F.lit(0)).cast("bigint")
    starts = texts.select(*keys, F.explode(langs).alias("s"), letters.alias("_letters")).select(
        *keys, "s.lang", (F.col("s.prior") + F.col("_letters") * F.col("s.unseen")).alias("_gain"), "_letters")
    scored = gains.unionByName(starts).groupBy(*keys, "lang").agg(F.round(F.sum("_gain"), RANK_DECIMALS).alias("score"))
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("lang"))
    return (scored.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1)
            .select(*keys, F.left(F.col("lang"), F.lit(2)).alias("lang"), "score"))
