"""Periodic runs beside a search of all starts and periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tidegauge.llm import periodic_runs

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w, times=4, shortest=6):
    out = {}
    for s in range(len(w)):
        for q in range(1, (len(w) - s) // times + 1):
            if s and w[s - 1] == w[s - 1 + q]:
                continue
            e = s + q
            while e < len(w) and w[e] == w[e - q]:
                e += 1
            if e - s >= max(shortest, times * q):
                out.setdefault((s, e), q)
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def planted(doc_id, w):
    if doc_id is None or not w:
        return w
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return w
    g = h // 10
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]


def plain_report(doc_id, text):
    w = planted(doc_id, SPACE.findall(text or ""))
    runs = plain_runs(w)
    best = None
    for s, n, q in runs:
        if best is None or n * best[2] > best[1] * q or (n * best[2] == best[1] * q and (s, q) < (best[0], best[2])):
            best = (s, n, q)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (
        "".join(f"{s},{n},{q}\n" for s, n, q in runs), " ".join(x for i, x in enumerate(w) if i not in gone))]
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *sha)


def texts():
    rng = random.Random(3)
    out = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "A a A a A a A a", "é é é é é é é é é é é é",
           "x y x y x y x y x y z z z z z z x y x y x y x y", "a\x1fb a\x1fb a\x1fb a\x1fb a\x1fb a\x1fb", "a\x0ba\x0ca\ra\ta\na  "]
    for _ in range(180):
        words = rng.choice([["a", "b"], ["a", "b", "c"], [f"w{i}" for i in range(30)]])
        w = rng.choices(words, k=rng.randint(0, 70))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(w))
            w[at:at] = rng.choices(words, k=rng.randint(1, 6)) * rng.randint(3, 9)
        out.append(rng.choice([" ", "\n", "  \t"]).join(w))
    return out


def test_runs_of_many_texts():
    w = [SPACE.findall(t or "") for t in texts()]
    edge = np.concatenate([[0], np.cumsum([len(x) for x in w])]).astype(np.int64)
    number = {}
    code = np.array([number.setdefault(x, len(number)) for own in w for x in own], np.int64)
    start, end, period = periodic_runs.runs_of(code, edge)
    want = [(s + int(at), s + n + int(at), q) for own, at in zip(w, edge) for s, n, q in plain_runs(own)]
    assert list(zip(start.tolist(), end.tolist(), period.tolist())) == want and len(want) > 100


def test_report(spark):
    rows = [(i if i % 23 else None, t, "s") for i, t in enumerate(texts())]
    rows += [(10**12 + i, rows[20 + i][1], None) for i in range(40)] + [rows[30], rows[30], (-7, "b a b a b a b a", "s")]
    rows.append((1000000, " ".join(f"w{i % 5000}" for i in range(300_000)), "s"))  # beyond one chunk
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    planned = periodic_runs.report(periodic_runs.find_runs(periodic_runs.with_planted_periods(df)))
    got = sorted((tuple(r) for r in planned.collect() if r.doc_id != 1000000), key=str)
    assert got == sorted((plain_report(i, t) for i, t, _ in rows if i != 1000000), key=str)
    long = [r for r in planned.where("doc_id = 1000000").collect()]
    assert len(long) == 1 and (long[0].start, long[0].length, long[0].period, long[0].exponent_milli) == (0, 300_000, 5000, 60_000)
    assert any(zlib.crc32(str(r[0]).encode()) % 10 == 0 and r[1] for r in rows)


def test_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b a b a b a b c", "r", 7), (2, "a\tb", "r", 8), (3, None, None, None)],
                               "doc_id long, text string, runs string, Collapsed int")
    out = periodic_runs.collapse(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect())) == [(1, "a b c", "r", 7), (2, "a\tb", "r", 8), (3, None, None, None)]
    assert periodic_runs.find_runs(df.limit(0)).count() == 0
    assert periodic_runs.report(periodic_runs.find_runs(periodic_runs.with_planted_periods(df.limit(0)))).count() == 0


@pytest.mark.parametrize("k", [3, 17, 1000])
def test_texts_of_one_word_repeated(k):
    start, end, period = periodic_runs.runs_of(np.zeros(k, np.int64), np.array([0, k]))
    assert (start.tolist(), end.tolist(), period.tolist()) == (([0], [k], [1]) if k >= 6 else ([], [], []))
