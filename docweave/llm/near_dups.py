"""Near-duplicate documents by chosen-path set similarity join.

A document's set is its distinct five-word shingles; equal sets form one class
and only classes are compared.  Every class has ``POSITIONS`` minwise tokens.
A tree starts with all classes; a node selects, by a hash of the node and
the token, each token with probability 1 / (similarity * POSITIONS), and a
class descends into the child of each selected token that it has.  Nodes of at
most ``small_node`` classes are compared exhaustively, larger ones branch
again; independent trees are repeated to the target recall.

Comparing happens in two steps.  In a node, sketches of the members are compared
and each group of members connected by similar sketches gives just its
spanning links, one for each further member.  These candidate links join classes
to clusters over all trees; a cluster's full shingle sets are then brought
together, every pair in it is compared exactly, and again only spanning links
leave.  Nothing grows with the square of a group's size but the comparisons
themselves; clusters (and nodes that stay large at the deepest level) beyond
one task's bound are compared in blocks, every block with every other.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm.common import map_batches, packed, sized, staged

POSITIONS = 64
LEAST_WEIGHT = 1000
_U = np.uint64
_SEEDS = np.random.default_rng(20240607).integers(1, 1 << 63, size=(4, POSITIONS), dtype=np.uint64)
_SCALE, _SHIFT, _PLACE, _WINDOW = _SEEDS[0] | _U(1), _SEEDS[1], _SEEDS[2], _SEEDS[3] | _U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit hash of 64-bit numbers (two multiply-xorshift rounds)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles of a text."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    if n < width:
        return mix((h * _WINDOW[:n]).sum(keepdims=True) + _U(n))
    total = h[:n - width + 1] * _WINDOW[0]
    for k in range(1, width):
        total += h[k:n - width + 1 + k] * _WINDOW[k]
    return np.unique(mix(total))


def minwise(shingles: np.ndarray) -> np.ndarray:
    """The minwise token of a set at each position."""
    low = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 2048):
        np.minimum(low, (shingles[i:i + 2048, None] * _SCALE + _SHIFT).min(axis=0), out=low)
    return (mix(low) >> _U(32)).astype(np.uint32)


def two_bits(tokens: np.ndarray) -> tuple[int, int]:
    """The lowest two bits of each token, 32 positions to a signed 64-bit number."""
    parts = (tokens.astype(np.uint64) & _U(3)).reshape(2, 32) << (_U(2) * np.arange(32, dtype=np.uint64))
    a, b = np.bitwise_or.reduce(parts, axis=1).astype(np.int64)
    return int(a), int(b)


def least_matches(similarity: float, deviations: float = 3.7) -> int:
    """Positions whose two bits must agree: the mean at this similarity less some deviations."""
    p = similarity + (1 - similarity) / 4
    return math.floor(POSITIONS * p - deviations * math.sqrt(POSITIONS * p * (1 - p)))


_PAIRS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
_PATHS = T.StructType([T.StructField("node", T.LongType()), T.StructField("rec", T.LongType())])
_SKETCHES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()),
    T.StructField("digest", T.BinaryType()), T.StructField("tokens", T.BinaryType()),
    T.StructField("s1", T.LongType()), T.StructField("s2", T.LongType())])


def _sketches(docs: DataFrame, width: int) -> DataFrame:
    def sketch(batch: pa.RecordBatch) -> dict:
        out: dict = {k: [] for k in ("n_shingles", "digest", "tokens", "s1", "s2")}
        for text in batch.column(1):
            found = shingle_set(text.as_py(), width)
            tokens = minwise(found) if len(found) else None
            s1, s2 = two_bits(tokens) if len(found) else (None, None)
            values = (len(found), xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None,
                      tokens.tobytes() if len(found) else None, s1, s2)
            for column, value in zip(out.values(), values):
                column.append(value)
        return {"doc_id": batch.column(0), **out}

    return map_batches(docs, sketch, _SKETCHES)


def _token_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, POSITIONS).astype(np.uint64)


def _paths(rows: DataFrame, similarity: float, trees: int | None) -> DataFrame:
    """(node, rec): children that the classes of ``rows`` (node, rec, tokens) descend into.

    With ``trees`` the rows are classes and the children are those of the roots.
    """
    limit = _U(int(2 ** 64 / (similarity * POSITIONS)))

    def descend(batch: pa.RecordBatch) -> dict:
        rec = batch.column("rec").to_numpy()
        tokens = mix(_token_rows(batch.column("tokens")) ^ _PLACE)
        starts = ([np.full(len(rec), k + 1, np.uint64) for k in range(trees)] if trees
                  else [batch.column("node").to_numpy().view(np.uint64)])
        nodes, recs = [], []
        for start in starts:
            child = mix(tokens + mix(start * _U(0x9E3779B97F4A7C15))[:, None])
            row, position = np.nonzero(mix(child + _U(0x5851F42D4C957F2D)) < limit)
            nodes.append(child[row, position].view(np.int64))
            recs.append(rec[row])
        return {"node": pa.array(np.concatenate(nodes)), "rec": pa.array(np.concatenate(recs))}

    return map_batches(rows, descend, _PATHS)


def _matches(s1: np.ndarray, s2: np.ndarray, t1: np.ndarray, t2: np.ndarray) -> np.ndarray:
    """Positions at which the two-bit sketches of rows and columns agree."""
    odd = _U(0x5555555555555555)
    out = np.full((len(s1), len(t1)), POSITIONS, np.int16)
    for a, b in ((s1, t1), (s2, t2)):
        x = a.view(np.uint64)[:, None] ^ b.view(np.uint64)[None, :]
        out -= np.bitwise_count((x | (x >> _U(1))) & odd)
    return out


def _spanning(n: int, linked: Callable[[int, np.ndarray], np.ndarray]) -> tuple[list[int], list[int]]:
    """A spanning forest of n members as (parents, children).

    ``linked(x, others)`` says which of ``others`` are linked with x.
    """
    parents, children = [], []
    rest = np.arange(n)
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            hit = linked(x, rest)
            found = rest[hit].tolist()
            rest = rest[~hit]
            parents.extend([x] * len(found))
            children.extend(found)
            queue.extend(found)
    return parents, children


def _pairs_of(members: DataFrame, keys: list[str], columns: list[str], compare: Callable) -> DataFrame:
    """The links (a, b) that ``compare`` (arrays of a group's columns) gives, over all groups."""
    lists = members.groupBy(*keys).agg(F.collect_list(F.struct(*columns)).alias("m")).select("m")

    def run(batch: pa.RecordBatch) -> dict:
        column = batch.column(0)
        fields = column.flatten().flatten()
        ends = np.cumsum(np.asarray(column.value_lengths()))
        a, b = [], []
        for i, j in zip([0, *ends[:-1].tolist()], ends.tolist()):
            rec = np.asarray(fields[0])[i:j]
            parents, children = compare(*[f.slice(i, j - i) for f in fields])
            a.append(rec[parents])
            b.append(rec[children])
        none = [np.empty(0, np.int64)]
        return {"a": pa.array(np.concatenate(none + a)), "b": pa.array(np.concatenate(none + b))}

    return map_batches(lists, run, _PAIRS)


def _by_sketches(least: int) -> Callable:
    """Compares a node's members (rec, s1, s2) by their two-bit sketches."""
    def compare(rec: pa.Array, s1: pa.Array, s2: pa.Array):
        s1, s2 = np.asarray(s1), np.asarray(s2)
        return _spanning(len(s1), lambda x, others: _matches(
            s1[x:x + 1], s2[x:x + 1], s1[others], s2[others])[0] >= least)
    return compare


def _by_sets(similarity: float) -> Callable:
    """Compares a cluster's members (rec, shingles) exactly, through an inverted index of their shingles."""
    hundred = round(100 * similarity)

    def compare(rec: pa.Array, shingles: pa.Array):
        sizes = np.asarray(shingles.value_lengths()).astype(np.int64)
        _, key = np.unique(np.asarray(shingles.flatten()), return_inverse=True)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        holders = owner[np.argsort(key, kind="stable")]
        many = np.bincount(key)
        first = np.cumsum(many) - many
        begin = np.cumsum(sizes) - sizes

        def linked(x: int, others: np.ndarray) -> np.ndarray:
            own = key[begin[x]:begin[x] + sizes[x]]
            runs = many[own]
            spots = np.arange(runs.sum()) + np.repeat(first[own] - (np.cumsum(runs) - runs), runs)
            common = np.bincount(holders[spots], minlength=len(sizes))[others]
            return 100 * common >= hundred * (sizes[x] + sizes[others] - common)

        return _spanning(len(sizes), linked)
    return compare


def _block_pairs(rows: DataFrame, key: str, block: int) -> DataFrame:
    """Rows (with ``n``, their group's size) dealt to (key, x, y): every two blocks of a group meet in one."""
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("rec", F.col(key)), blocks).cast("int")
    other = rows.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return other.withColumn("x", F.least("_own", "_other")).withColumn("y", F.greatest("_own", "_other")).drop(
        "_own", "_other")


def _sets(docs: DataFrame, clusters: DataFrame, width: int) -> DataFrame:
    """(rec, cluster, n, shingles) of the documents in ``clusters`` (rec, cluster, n)."""
    schema = T.StructType([*clusters.schema.fields, T.StructField("shingles", T.ArrayType(T.LongType()))])

    def run(batch: pa.RecordBatch) -> dict:
        return {**{c: batch.column(c) for c in ("rec", "root", "n")},
                "shingles": [shingle_set(t.as_py(), width).view(np.int64) for t in batch.column("text")]}

    wanted = docs.join(sized(clusters, 32), docs["doc_id"] == clusters["rec"])
    return map_batches(wanted.select(*clusters.columns, "text"), run, schema, rows=256)


def components(links: DataFrame) -> DataFrame:
    """(rec, root): smallest member of each linked record's component.

    Alternates large-star and small-star steps until the links no longer
    change; every step is a combined minimum per record and a join.
    """
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v")
                   .distinct(), "edges")
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen or not state[0]:
            return edges.select(F.col("u").alias("rec"), F.col("v").alias("root")).union(
                edges.select("v", "v").distinct())
        seen = state
        sides = edges.union(edges.select("v", "u"))
        least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = staged(sides.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                       .distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").select(F.explode(F.array(
            F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = staged(moved.select("e.*").filter("u <> v").distinct(), "small-star")


def _leaves(classes: DataFrame, similarity: float, trees: int, depth: int,
            small_node: int) -> tuple[DataFrame, DataFrame]:
    """(node, rec) of small nodes with several classes, and of nodes still large at the deepest level (with n)."""
    tokens = classes.select("rec", "tokens")
    level = staged(_paths(tokens, similarity, trees), "paths-1")
    small = None
    for k in range(1, depth + 1):
        sizes = level.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        members = staged(level.join(sizes, "node"), f"nodes-{k}")
        leaves = members.filter(F.col("n") <= small_node).select("node", "rec")
        small = leaves if small is None else small.unionByName(leaves)
        large = members.filter(F.col("n") > small_node)
        if k < depth:
            level = staged(_paths(large.join(tokens, "rec").select("node", "rec", "tokens"), similarity, None)
                           .distinct(), f"paths-{k + 1}")
    return small, large


def near_duplicates(docs: DataFrame, similarity: float = 0.75, width: int = 5, trees: int = 16, depth: int = 3,
                    small_node: int = 4000, cluster_block: int = 1_000_000, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``.

    A-Z are folded; words are runs of non-blanks; fewer than ``width`` words
    make one shingle.  A null text or one without words has no shingles, is
    linked with nothing and is its own component.  ``component_id`` is the
    smallest id reachable over links; ``kept`` says that it is the row's own id,
    so rows repeating an id share its fate.  A row with a null id joins the
    component of an equal text with an id (else null) and is kept only where
    it has no component.  Texts are read whole; an empty table gives an empty
    result; other columns are not read.

    A task compares at most ``small_node`` sketches, or the full sets of two
    blocks of about ``cluster_block`` shingles each (a document counts for at
    least ``LEAST_WEIGHT``).  ``trees`` sets the recall: a pair at the similarity
    shares a node at the first level of a tree with probability 1 - 1/e, at the
    third with 0.37.
    """
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("binary").alias("text"))
    sketches = staged(_sketches(base, width), "sketches")
    classes = staged(sketches.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("rec"), F.count(F.lit(1)).alias("copies"),
        *[F.first(c).alias(c) for c in ("n_shingles", "tokens", "s1", "s2")]), "classes")
    bits = classes.select("rec", "s1", "s2")
    small, large = _leaves(classes, similarity, trees, depth, small_node)
    compare, columns = _by_sketches(least_matches(similarity)), ["rec", "s1", "s2"]
    near = _pairs_of(small.join(bits, "rec"), ["node"], columns, compare).union(
        _pairs_of(_block_pairs(large.join(bits, "rec"), "node", small_node), ["node", "x", "y"], columns, compare))
    clusters = staged(components(near.distinct()), "near-clusters")
    weighed = clusters.join(classes.select("rec", "n_shingles"), "rec")
    sizes = weighed.groupBy("root").agg(F.sum(F.greatest("n_shingles", F.lit(LEAST_WEIGHT))).alias("n"))
    sets = staged(_sets(base, staged(clusters.join(sizes, "root").select("rec", "root", "n"), "near-members"), width),
                  "near-sets")
    links = _pairs_of(_block_pairs(sets, "root", cluster_block), ["root", "x", "y"], ["rec", "shingles"],
                      _by_sets(similarity))
    roots = staged(components(links.distinct()), "near-roots")

    grouped = classes.select("digest", "rec", "copies").join(roots, "rec", "left").select(
        "digest", "rec", "copies", F.coalesce("root", "rec").alias("component")).filter(
        "copies > 1 OR component <> rec").select("digest", "component")
    grouped = staged(grouped, "near-classes")
    joined = sketches.select("doc_id", "n_shingles", "digest").join(sized(grouped, 48), "digest", "left")
    component = F.coalesce("component", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"),
                         F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """``docs``, all columns, with one document of each near-duplicate group: the one with the smallest id.

    Rows that repeat an id are one document, of which one row stays.  Rows with a
    null id have nothing to decide by and stay.
    """
    found = staged(near_duplicates(docs, id_col=id_col, **settings).select("doc_id", "kept"), "near-verdicts")
    ids = found.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.bool_and("kept").alias("kept"),
                                                                   F.count(F.lit(1)).alias("n"))
    dropped = sized(staged(ids.filter("NOT kept").select("doc_id"), "near-dropped"), 16)
    repeated = sized(staged(ids.filter("n > 1").select("doc_id"), "near-repeated"), 16)
    rows = docs.select(packed(docs), docs[id_col].cast("long").alias("doc_id"))
    stay = rows.join(dropped, "doc_id", "left_anti")
    return stay.join(repeated, "doc_id", "left_anti").unionByName(
        stay.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])).select("row.*")
