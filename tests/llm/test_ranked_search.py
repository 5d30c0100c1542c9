"""Ranked search beside scores of all documents."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tidegauge.llm import ranked_search
from tidegauge.llm.queries import ORACLES, QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, queries, k):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in queries:
        own = []
        for i, c in counts:
            m = 50 + 50 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                own.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(own, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(2)
    words = [f"w{int(rng.paretovariate(0.7)) % 500}" for _ in range(5000)] + ["É", "日本", "x-y", "A", "1.5"]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([1, 5, 40, 200])))) for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(150)] + [(None, None), (None, docs[8][1]), (None, docs[9][1]), (2000, ""), (2001, "- *"), (-5, docs[10][1]), docs[11]]
    docs.append((3000, "w1 w2 other " * 200_000))  # beyond one chunk
    queries = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 30, 80])))) for i in range(25)]
    queries += [(50, None), (51, ""), (52, "not there"), (None, "w1 W2"), (53, docs[7][1]), (3, "w5 w6"), (3, "w5 w6"), (54, "É"), (55, "é 日本")]
    return docs, queries


@pytest.mark.parametrize("k,more", [(50, {}), (7, {"shard": 500, "leaf": 1, "most_pairs": 200}), (3, {"leaf": 1000, "most_queries": 10})])
def test_search(spark, tables, k, more):
    docs, queries = tables
    d = spark.createDataFrame([(*x, "s") for x in docs], "doc_id long, text string, score string").repartition(3)
    q = spark.createDataFrame([(*x, 1) for x in queries], "item_id long, text string, doc_id int")
    got = sorted(map(tuple, ranked_search.search(d, q, k, **more).collect()), key=str)
    assert got == plain_search(docs, queries, k)


def test_search_of_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    for some, asked in ((d.limit(0), q), (d, q.limit(0)), (d.limit(0), q.limit(0))):
        out = ranked_search.search(some, asked)
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0


def test_bounds_hold_and_spare_documents():
    rng = np.random.default_rng(4)
    row, term = np.nonzero(rng.random((4000, 60)) < rng.random(60) ** 3)
    shard = ranked_search.Shard(np.arange(4000), rng.integers(50, 400, 4000), row, term, rng.integers(1, 9, len(row)), rng.integers(1, 9000, 60), 4000, 4000 * 225)
    asked = np.arange(0, 60, 3)
    docs, score = shard.scores(asked, np.zeros(1, np.int64), np.full(1, 4000))
    lo = np.sort(rng.integers(0, 4000, 50))
    hi = np.minimum(lo + rng.integers(1, 300, 50), 4000)
    bound, _ = shard.bounds(asked, lo, hi)
    assert all(b >= score[a:c].max() for a, c, b in zip(lo, hi, bound))
    alone, _ = shard.bounds(asked, docs[:200], docs[:200] + 1)
    assert (alone == score[:200]).all()
    (best, ids), opened = shard.search(asked, 10, (np.zeros(0, np.int64),) * 2)
    order = np.lexsort((docs, -score))[:10]
    assert (ids == docs[order]).all() and (best == score[order]).all() and opened < 2000


def test_norms_beyond_64_bits():
    n = np.array([1, 10**6], np.int64)
    assert ranked_search.norms(n, 10**13, 10**15).tolist() == [50 + 50 * 10**13 // 10**15, 50 + 50 * 10**19 // 10**15]


def test_search_beside_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = con.execute(ORACLES["op11_ranked_search"])
    names = [c[0] for c in cur.description]
    got = QUERIES["op11_ranked_search"](spark, sf).select(*names)
    want = sorted(cur.fetchall())
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100
