"""Property tests against small plain-Python specifications."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from docweave.operators.tokens import cut_to_budget, pack_batches

LIMIT = 300
SETTINGS = settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
docs_strategy = st.lists(st.lists(st.integers(min_value=1, max_value=400), min_size=1, max_size=12),
                         min_size=1, max_size=6)


def spec_pack(tokens):
    out, batch, run = [], 0, 0
    for t in tokens:
        run += t
        out.append(batch)
        if run > LIMIT:
            batch, run = batch + 1, 0
    return out


def spec_cut(tokens, budget):
    kept, used = [], 0
    for t in tokens:
        if used > budget:
            break
        kept.append(t)
        used += t
    return kept


@SETTINGS
@given(docs_strategy)
def test_packing_matches_spec(spark, docs):
    data = [(d, i, t) for d, toks in enumerate(docs) for i, t in enumerate(toks)]
    df = spark.createDataFrame(data, "name long, pos long, n_tokens long")
    got = {}
    for r in pack_batches(df, LIMIT + 1024).collect():
        got.setdefault(r.name, {})[r.pos] = r.batch
    for d, toks in enumerate(docs):
        batches = [got[d][i] for i in range(len(toks))]
        assert batches == spec_pack(toks)
        # every closed batch exceeds the limit, and does not without its last fragment
        for b in set(batches[:-1]) if batches[-1] != batches[0] else set():
            members = [t for t, x in zip(toks, batches) if x == b]
            if b != batches[-1]:
                assert sum(members) > LIMIT and sum(members[:-1]) <= LIMIT


@SETTINGS
@given(docs_strategy, st.integers(min_value=0, max_value=900))
def test_cut_is_prefix(spark, docs, budget):
    data = [(d, i, t) for d, toks in enumerate(docs) for i, t in enumerate(toks)]
    df = spark.createDataFrame(data, "key long, rank long, n_tokens long")
    got = {}
    for r in cut_to_budget(df, "key", budget).collect():
        got.setdefault(r.key, []).append((r.rank, r.n_tokens))
    for d, toks in enumerate(docs):
        kept = [t for _, t in sorted(got.get(d, []))]
        assert kept == spec_cut(toks, budget)
