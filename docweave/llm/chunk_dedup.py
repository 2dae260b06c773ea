"""Repeated passages by content-defined chunking with a gear rolling hash.

A chunk ends where the rolling hash of the last 16 bytes has its five mask
bits zero, so an insertion changes the chunks around it and no others.
Chunks are compared by digest; a passage shared by two texts shows as a run of
shared chunks in both, and reaches into the chunks around it.  Runs are
candidates: a run with its surroundings of at least ``min_words`` words is
confirmed exactly.  In a short one every window of ``min_words`` words is compared
with those of other texts; in a long one sequences of whole chunks that hold so
many words are, and its windows with those of the short ones.  Spans are unions
of what is confirmed, so every word of a span stands in a passage of
``min_words`` words that another document holds too.

Equal texts are compared once.  Hashes are shuffled, never text, and once with the
place they stand at: all places of a hash meet in one task, which keeps those of
shared hashes.  Hashes of very many texts are combined before the shuffle instead.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm.common import join_small, map_batches, packed, sized, staged

WINDOW_STEPS = (1, 2, 4, 8)                     # doubling sums: a window of 16 bytes
MASK = np.uint16(0b1111_1000_0000_0000)        # bits that the whole window reaches; a cut every 32 bytes or so
SMALLEST, LARGEST = 16, 256
GEAR = np.random.default_rng(20240610).integers(0, 1 << 16, size=256, dtype=np.uint16)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """h[t] = 2 h[t-1] + GEAR[data[t]] mod 2**16, by sums over doubled windows."""
    h = GEAR[data]
    for step in WINDOW_STEPS:
        shifted = h[:-step] << np.uint16(step)
        h[step:] += shifted
    return h


def chunk_ends(text: bytes) -> list[int]:
    """End offsets of the chunks of a text; all lie between UTF-8 characters."""
    n = len(text)
    if not n:
        return []
    data = np.frombuffer(text, np.uint8)
    found = (gear_hashes(data) & MASK) == 0
    found[:-1] &= (data[1:] & 0xC0) != 0x80
    ends, last = [], 0

    def forced(upto: int) -> int:
        at = last
        while upto - at > LARGEST:
            cut = at + LARGEST
            while text[cut] & 0xC0 == 0x80:
                cut -= 1
            ends.append(cut)
            at = cut
        return at

    for cut in (np.flatnonzero(found) + 1).tolist():
        if cut - last >= SMALLEST:
            last = forced(cut)
            if cut - last >= SMALLEST:
                ends.append(cut)
                last = cut
    last = forced(n)
    if last < n:
        ends.append(n)
    return ends


def word_counts(text: bytes, ends: list[int]) -> np.ndarray:
    """Words (runs of non-blanks) that start before each end."""
    data = np.frombuffer(text, np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    starts = ~blank
    starts[1:] &= blank[:-1]
    return np.cumsum(starts, dtype=np.int32)[np.array(ends, np.int64) - 1]


_CHUNKS = T.StructType([T.StructField("at", T.LongType()), T.StructField("doc_id", T.LongType()),
                        T.StructField("text_key", T.LongType()), T.StructField("ends", T.ArrayType(T.IntegerType())),
                        T.StructField("words", T.ArrayType(T.IntegerType())),
                        T.StructField("digests", T.ArrayType(T.LongType()))])
_RANGE = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_SPANS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text_key", T.LongType()),
                       T.StructField("span_start", T.LongType()), T.StructField("span_end", T.LongType()),
                       T.StructField("first_doc_id", T.LongType()), T.StructField("is_first", T.BooleanType()),
                       T.StructField("first_parts", T.ArrayType(_RANGE))])
_HOLDER = [T.StructField("text_key", T.LongType()), T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())]
# A hash with the bytes of the text that it stands for, and the least and greatest id that hold the text.
_MARKS = T.StructType([T.StructField("hash", T.LongType()), *_HOLDER, *_RANGE.fields])
_CANDIDATES = T.StructType([*_HOLDER, T.StructField("short", T.ArrayType(_RANGE)), T.StructField("long", T.ArrayType(_RANGE)),
                            T.StructField("sequences", T.ArrayType(_MARKS))])
TEXT_PART, HOT = 64, 32                        # a hash that so many texts of such a part of all texts hold is hot
BEFORE, AFTER = 192, 2                         # bytes before a run and chunks after it that its passage may reach into
_BASE, _SEQUENCES = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xA24BAED4963EE407)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(at, doc_id, text_key, ends, words, digests) of every row; ``at`` numbers the rows."""
    rows = docs.select(F.monotonically_increasing_id().alias("at"), docs[id_col].cast("long").alias("doc_id"),
                       F.xxhash64(docs[text_col]).alias("text_key"), docs[text_col].cast("binary").alias("text"))

    def cut(batch: pa.RecordBatch) -> dict:
        ends, words, digests = [], [], []
        for value in batch.column("text"):
            text = value.as_py() or b""
            stops = chunk_ends(text)
            ends.append(stops)
            words.append(word_counts(text, stops) if stops else [])
            hashed = [xxhash.xxh3_64_intdigest(text[a:b]) for a, b in zip([0, *stops], stops)]
            digests.append(np.array(hashed, np.uint64).view(np.int64))
        return {**{c: batch.column(c) for c in ("at", "doc_id", "text_key")}, "ends": ends,
                "words": words, "digests": digests}

    return map_batches(rows, cut, _CHUNKS)


def _regions(ends: list[int], words: list[int], hits: list[int], least: int, long_words: int) -> tuple[list, list]:
    """(short, long): runs of shared chunks with their surroundings as (first chunk, last chunk, run or None).

    A run and what a passage can reach into holds ``least`` words at least, in a
    long one ``long_words``.  Short ones that touch are one.
    """
    runs: list[list[int]] = []
    for i in hits:
        if runs and i == runs[-1][1] + 1:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    short, long = [], []
    for a, b in runs:
        # After a passage's start cuts agree at the second or third one in the middle; before its end at the last.
        low, high = a, min(len(words) - 1, b + AFTER)
        while low and ends[a - 1] - ends[low - 1] < BEFORE:
            low -= 1
        held = words[high] - (words[low - 1] if low else 0)
        if held >= long_words:
            long.append((low, high, (a, b)))
        elif held >= least:
            if short and low <= short[-1][1] + 1:
                short[-1] = short[-1][0], high, None
            else:
                short.append((low, high, None))
    return short, long


def _sequences(ends: list[int], words: list[int], digests: np.ndarray, run: tuple[int, int],
               least: int) -> list[tuple[int, int, int]]:
    """(hash, start, end) of the shortest sequences of a run's chunks, from each of them, with ``least`` whole words."""
    out = []
    j, b = run
    for i in range(run[0], b + 1):
        before = words[i - 1] if i else 0
        j = max(j, i)
        while j <= b and words[j] - before - 1 < least:  # the last word may reach beyond the chunk
            j += 1
        if j > b:
            break
        h = xxhash.xxh3_64_intdigest(digests[i:j + 1].tobytes(), seed=int(_SEQUENCES))
        out.append((h, ends[i - 1] if i else 0, ends[j]))
    return out


def window_marks(text: bytes, start: int, end: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends) of all windows of ``least`` whole words in ``text[start:end]``; offsets in the text."""
    data = np.frombuffer(text, np.uint8)[start:end]
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
    begins, stops = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    whole = slice(int(start > 0 and len(begins) and begins[0] == 0 and text[start - 1] not in b" \t\n\v\f\r"),
                  len(begins) - int(end < len(text) and len(stops) and stops[-1] == len(data)
                                    and text[end] not in b" \t\n\v\f\r"))
    begins, stops = begins[whole] + start, stops[whole] + start
    n = len(begins)
    if n < least:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    h = np.fromiter((xxhash.xxh3_64_intdigest(text[a:b]) for a, b in zip(begins.tolist(), stops.tolist())), np.uint64, n)
    ones = np.ones(n, np.uint64)
    ones[1:] = _BASE
    power = np.cumprod(ones)
    ones[1:] = _INVERSE
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power)])
    rolled = (sums[least:] - sums[:-least]) * np.cumprod(ones)[:n - least + 1]
    rolled = (rolled ^ (rolled >> np.uint64(31))) * _BASE
    return (rolled ^ (rolled >> np.uint64(29))).view(np.int64), begins[:n - least + 1], stops[least - 1:]


def _windows(rows: DataFrame, column: str, least: int) -> DataFrame:
    """``_MARKS`` of all windows in the ranges of ``column`` of rows (text_key, lo, hi, text, ranges)."""
    def emit(batch: pa.RecordBatch) -> dict:
        parts: dict = {f.name: [] for f in _MARKS}
        about = zip(*(batch.column(c).to_pylist() for c in ("text_key", "lo", "hi", column)))
        for (key, lo, hi, ranges), text in zip(about, batch.column("text")):
            value = text.as_py() or b""
            for r in ranges:
                hashes, begins, stops = window_marks(value, r["start"], r["end"], least)
                same = [np.full(len(hashes), x, np.int64) if x is not None else None for x in (key, lo, hi)]
                for name, x in zip(parts, (hashes, *same, begins, stops)):
                    parts[name].append(pa.array(x, pa.int64()) if x is not None else pa.nulls(len(hashes), pa.int64()))
        return {name: pa.concat_arrays(x) if x else pa.array([], pa.int64()) for name, x in parts.items()}

    return map_batches(rows.select("text_key", "lo", "hi", column, "text"), emit, _MARKS, rows=64)


def _part(df: DataFrame) -> DataFrame:
    """The rows of one in ``TEXT_PART`` texts."""
    return df.filter(F.pmod("text_key", F.lit(TEXT_PART)) == 0)


def _shared(rows: DataFrame, marks: Callable[[DataFrame], DataFrame], key: str) -> DataFrame:
    """``marks(rows)`` whose ``key`` documents of two ids hold, with ``first``, the smallest of these ids.

    ``marks`` takes any part of the rows and gives (text_key, lo, hi, joins, ``key``, ...);
    a key that only marks with ``joins`` false hold is not shared.  One shuffle by
    key.  The few keys that very many texts hold, which a part of the texts shows, are
    combined in every task first and sent to their marks, which are then dealt by text.
    """
    hot = staged(marks(_part(rows)).groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= HOT)
                 .select(key, F.lit(True).alias("_hot")), "hot-keys")
    count, found = hot.count(), marks(rows)
    held = {"first": F.min("lo"), "_hi": F.max("hi"), "_joins": F.max("joins")}
    if not count:
        met = found.withColumns({c: f.over(Window.partitionBy(key)) for c, f in held.items()})
        return met.filter("first < _hi and _joins").drop("_hi", "_joins")
    # Marks of other keys share one group, which every task makes one row of.
    totals = staged(found.join(sized(hot, 16, count), key, "left").groupBy(F.when(F.col("_hot"), F.col(key)).alias(key))
                    .agg(F.struct(*[f.alias(c) for c, f in held.items()]).alias("_all")).filter(F.col(key).isNotNull()),
                    "hot-totals")
    known = found.join(sized(totals, 40, count), key, "left")
    apart = Window.partitionBy(key, F.when(F.col("_all").isNotNull(), F.col("text_key")))
    met = known.withColumns({c: F.when(F.col("_all").isNotNull(), F.col("_all")[c]).otherwise(f.over(apart))
                             for c, f in held.items()})
    return met.filter("first < _hi and _joins").drop("_hi", "_joins", "_all")


def _candidates(chunks: DataFrame, min_words: int, long_words: int) -> DataFrame:
    """``_CANDIDATES`` of every distinct text with a run of shared chunks that can hold ``min_words`` words."""
    classes = staged(chunks.groupBy("text_key").agg(
        F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min("at").alias("at")), "text-classes")
    reps = chunks.drop("doc_id").join(sized(classes.select("at", "lo", "hi"), 40), "at").drop("at")

    def placed(texts: DataFrame) -> DataFrame:
        return texts.select("text_key", "lo", "hi", F.lit(True).alias("joins"), F.posexplode("digests").alias("i", "digest"))

    hits = (_shared(reps, placed, "digest").groupBy("text_key")
            .agg(F.sort_array(F.collect_list("i")).alias("hits")))

    def regions(batch: pa.RecordBatch) -> dict:
        out: dict = {f.name: [] for f in _CANDIDATES}
        columns = (batch.column(c).to_pylist() for c in ("text_key", "lo", "hi", "ends", "words", "digests", "hits"))
        for key, lo, hi, ends, words, digests, hit in zip(*columns):
            both, digests = _regions(ends, words, hit, min_words, long_words), np.array(digests, np.int64)
            short, long = ([{"start": ends[a - 1] if a else 0, "end": ends[b]} for a, b, _ in part] for part in both)
            sequences = [{"hash": int(np.uint64(h).view(np.int64)), "text_key": key, "lo": lo, "hi": hi, "start": s, "end": e}
                         for _, _, run in both[1] for h, s, e in _sequences(ends, words, digests, run, min_words)]
            if short or long:
                for name, value in zip(out, (key, lo, hi, short, long, sequences)):
                    out[name].append(value)
        return out

    return map_batches(reps.join(hits, "text_key"), regions, _CANDIDATES)


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted ranges with those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for start, end in ranges:
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((start, end))
    return out


_PARTS = T.StructType([T.StructField("text_key", T.LongType()), T.StructField("parts", T.ArrayType(T.StructType(
    [*_RANGE.fields, T.StructField("first", T.LongType())])))])


def _parts(batch: pa.RecordBatch) -> dict:
    """The ranges of a text, by their first holder, merged: (start, end, first) in order."""
    out = []
    for ranges in batch.column("ranges").to_pylist():
        found = []
        for first, mine in groupby(ranges, key=lambda r: r["first"]):
            found.extend((a, b, first) for a, b in _merged([(r["start"], r["end"]) for r in mine]))
        out.append([{"start": a, "end": b, "first": f} for a, b, f in sorted(found)])
    return {"text_key": batch.column("text_key"), "parts": out}


def repeated_spans(docs: DataFrame, min_words: int = 50, long_words: int = 150, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Spans of texts that other documents hold too, as byte offsets, one row for each.

    (doc_id, text_key, span_start, span_end, first_doc_id, is_first, first_parts):
    every word of a span stands in a passage of ``min_words`` words that documents of
    two ids hold, word by word.  ``first_doc_id`` is the smallest id that holds one
    of the span's passages and ``is_first`` says that this document is the first
    holder of all of them, so its span is the copy to keep.  ``first_parts`` are
    the parts (start, end) of the span whose passages it holds first.  In regions
    of ``long_words`` words or more spans may end up to a chunk before the passage does.

    A passage is found if a chunk lies in it whole; one that in all its documents
    stands right beside other repeated text, so that the run is long, needs whole
    chunks of ``min_words`` words.  A repeat inside one
    document, or in rows of the same id, does not count.  A null id is never a
    first holder.  Null and empty texts have no spans; an empty table gives an
    empty result; ``text_key`` (a hash of the text) tells rows of one id apart;
    other columns are not read.
    """
    chunks = staged(chunked(docs, id_col, text_col), "chunks")
    found = staged(_candidates(chunks, min_words, long_words), "candidates")
    of_text = sized(found.drop("sequences"), 160)
    rows = docs.select(docs[id_col].cast("long").alias("id"), F.xxhash64(docs[text_col]).alias("key"),
                       docs[text_col].cast("binary").alias("text"))
    # Of equal texts the row with the smallest id is read; rows that repeat it give the same marks again.
    texts = rows.join(of_text, (rows["key"] == of_text["text_key"]) & rows["id"].eqNullSafe(of_text["lo"]))

    def windows(texts: DataFrame) -> DataFrame:
        """Windows of short and long regions; those of long ones are compared with those of short ones."""
        of = [_windows(texts.filter(F.size(c) > 0), c, min_words).withColumn("joins", F.lit(c == "short"))
              for c in ("short", "long")]
        return of[0].unionByName(of[1])

    def sequences(candidates: DataFrame) -> DataFrame:
        return candidates.select(F.explode("sequences").alias("m")).select("m.*", F.lit(True).alias("joins"))

    held = ["text_key", "first", "start", "end"]
    met = _shared(texts, windows, "hash").select(*held).unionByName(_shared(found, sequences, "hash").select(*held))
    ranges = met.groupBy("text_key").agg(F.sort_array(F.collect_set(F.struct("first", "start", "end"))).alias("ranges"))
    of_texts = staged(map_batches(ranges, _parts, _PARTS), "text-parts")
    many, entries = of_texts.agg(F.count(F.lit(1)), F.sum(F.size("parts"))).first()
    joined = join_small(chunks.select("doc_id", "text_key"), of_texts, ["text_key"],
                        64 + 24 * (entries or 0) // max(1, many), F.col("doc_id"), how="inner")

    def spans(batch: pa.RecordBatch) -> dict:
        out: dict = {f.name: [] for f in _SPANS}

        for doc, key, parts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_key", "parts"))):
            at = 0
            for start, end in _merged([(p["start"], p["end"]) for p in parts]):
                inside = []
                while at < len(parts) and parts[at]["start"] < end:
                    inside.append(parts[at])
                    at += 1
                firsts = {p["first"] for p in inside}
                own = [{"start": p["start"], "end": p["end"]} for p in inside if p["first"] == doc]
                values = (doc, key, start, end, min(firsts), firsts == {doc}, own)
                for name, value in zip(out, values):
                    out[name].append(value)
        return out

    return map_batches(joined, spans, _SPANS)


def without_repeats(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all parts of spans that are not first copies cut out of their texts.

    Every repeated passage stays in the document that holds it first.  A null text stays null; texts without such spans are unchanged.
    """
    cuts = (spans.filter(~F.col("is_first")).groupBy("doc_id", "text_key")
            .agg(F.sort_array(F.collect_set(F.struct("span_start", "span_end", "first_parts"))).alias("cuts")))

    @F.pandas_udf("string")
    def cut(texts, cuts):
        out = []
        for text, holes in zip(texts, cuts):
            if text is not None and holes is not None:
                data, kept, at = text.encode(), [], 0
                for hole in holes:
                    kept.append(data[at:hole["span_start"]])
                    kept.extend(data[part["start"]:part["end"]] for part in hole["first_parts"])
                    at = hole["span_end"]
                text = b"".join([*kept, data[at:]]).decode()
            out.append(text)
        import pandas as pd
        return pd.Series(out, dtype=object)

    rows = docs.select(packed(docs), docs[id_col].cast("long").alias("id"), F.xxhash64(docs[text_col]).alias("key"))
    on = rows["id"].eqNullSafe(cuts["doc_id"]) & (rows["key"] == cuts["text_key"])
    joined = rows.join(cuts, on, "left").select("row", cut(F.col("row").getField(text_col), F.col("cuts")).alias("cut"))
    return joined.select(*[(F.col("cut") if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns])
