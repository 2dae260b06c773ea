from collections import Counter

import duckdb
from conftest import SMOKE

from docweave.llm import queries
from docweave.llm.common import join_small
from docweave.llm.line_dedup import drop_boilerplate
from tools.oracle_check import rows_of


def brute(rows, ratio, min_pages, min_hits, small_ratio=None):
    pages, hits = Counter(), Counter()
    for host, text in rows:
        pages[host] += 1
        hits.update({(host, x.strip(" \t\r\f\v")) for x in (text or "").split("\n")})
    out = []
    for host, text in rows:
        if text is None:
            out.append((host, None, 0, 0))
            continue
        lines = text.split("\n")
        bare = [x.strip(" \t\r\f\v") for x in lines]
        limit = ratio if pages[host] >= min_pages else small_ratio
        bad = [host is not None and b != "" and limit is not None and hits[host, b] >= min_hits
               and hits[host, b] > limit * pages[host] for b in bare]
        out.append((host, "\n".join(x for x, b in zip(lines, bad) if not b), sum(b != "" for b in bare), sum(bad)))
    return out


def pages():
    rows = [("a", f"menu\nstory {k}\n\n foot \nfoot" if k % 2 else f"story {k}\nfoot") for k in range(40)]
    rows += [("b", "menu\nfoot")] * 3 + [(None, "menu\nfoot")] * 30 + [("a", None), ("a", ""), ("c", None)]
    return rows + [("d", "same\nrow")] * 25


def test_against_brute_force(spark, make_docs):
    rows = pages()
    docs = make_docs([(k, t, "en", h) for k, (h, t) in enumerate(rows)])
    found = drop_boilerplate(docs, "source", "text", 0.3, 20, 5)
    assert set(docs.columns) | {"n_dropped"} == set(found.columns)
    got = sorted(((r.source, r.text, r.n_lines, r.n_dropped) for r in found.collect()), key=repr)
    assert got == sorted(brute(rows, 0.3, 20, 5), key=repr)


def test_small_hosts_have_their_own_ratio(make_docs):
    rows = pages() + [("s", f"menu\nrare\nstory {k}" if k < 3 else f"menu\nstory {k}") for k in range(6)]
    docs = make_docs([(k, t, "en", h) for k, (h, t) in enumerate(rows)])
    found = drop_boilerplate(docs, "source", "text", 0.3, 20, 3, small_ratio=0.5)
    got = sorted(((r.source, r.text, r.n_lines, r.n_dropped) for r in found.collect()), key=repr)
    assert got == sorted(brute(rows, 0.3, 20, 3, 0.5), key=repr)
    assert {r[3] for r in got if r[0] == "s"} == {1} and {r[1] for r in got if r[0] == "b"} == {""}


def test_query_against_sql_where_lines_go(spark, tmp_path):
    """Menus and footers of large and small sites, and one line exactly at the ratio, which stays."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    html = []
    for k in range(40):
        at_ratio = "<p>at the ratio</p>" if k < 4 else ""
        html.append((f"http://Large.example.com/{k}", f"<nav><li>Home</li></nav>{at_ratio}<p>story {k}</p><footer>end</footer>"))
    for k in range(4):
        half = "<p>on half</p>" if k < 2 else ""
        html.append((f"https://small.example.org/{k}", f"<ul><li>Shop</li></ul>{half}<p>item {k}</p>"))
    html += [("http://two.example.net/1", "<p>same</p>"), ("http://two.example.net/2", "<p>same</p>"), ("x", "<p>same</p>"),
             (None, None)]
    table = pa.table({"page_id": list(range(len(html))), "url": [u for u, _ in html], "html": [h for _, h in html]})
    pq.write_table(table, tmp_path / "pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet')")
    names = ["page_id", "host", "text", "n_lines", "n_dropped"]
    ours = queries.op2_site_line_dedup(spark, str(tmp_path)).select(*names).collect()
    theirs = con.sql(f"SELECT {', '.join(names)} FROM ({queries.OP2_SQL})").fetchall()
    gone = Counter()
    for r in ours:
        gone[r.host] += r.n_dropped
    assert gone == Counter({"large.example.com": 80, "small.example.org": 4, "two.example.net": 0, None: 0})
    assert all("at the ratio" in r.text for r in ours if r.page_id < 4)
    assert [r for r in rows_of(ours) if r[0] < len(html) - 1] == [r for r in rows_of(theirs) if r[0] < len(html) - 1]


def test_empty_table(make_docs):
    assert drop_boilerplate(make_docs([]), "source").count() == 0


def test_salted_join_is_the_same_join(spark, monkeypatch):
    from docweave.llm import common
    left = spark.createDataFrame([(k % 3 if k % 5 else None, k) for k in range(60)], "k int, v int")
    right = spark.createDataFrame([(0, "a"), (1, "b"), (None, "n")], "k int, w string")
    small = sorted(join_small(left, right, ["k"], 10, left["v"]).collect(), key=repr)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert sorted(join_small(left, right, ["k"], 10, left["v"], salts=4).collect(), key=repr) == small
    assert len(small) == 60


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SMOKE}/pages.parquet')")
    names = ["page_id", "host", "text", "n_lines", "n_dropped"]
    ours = queries.op2_site_line_dedup(spark, SMOKE).select(*names).collect()
    theirs = con.sql(f"SELECT {', '.join(names)} FROM ({queries.OP2_SQL})").fetchall()
    assert rows_of(ours) == rows_of(theirs)


def test_copies_of_a_text_do_not_make_its_lines_boilerplate(spark, make_docs):
    import corpus_pipeline
    copied = [("e", "one\n two\nfoot")] * 9 + [("e", "one\ntwo \n\nfoot")] + [("e", None), ("e", "")]
    own = [("e", f"story {k}\nfoot\nend {k}") for k in range(25)]
    all_same = [("d", "same\nrow")] * 25
    rows = copied + own + all_same
    docs = make_docs([(k, t, "en", h) for k, (h, t) in enumerate(rows)])
    found = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, SMOKE).collect()}
    want = [None if t is None else "\n".join(x for x in t.split("\n") if x != "foot") for _, t in rows]
    assert [found[k] for k in range(len(rows))] == want
