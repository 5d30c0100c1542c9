"""Every stage of the corpus pipeline beside plain Python, each on what its predecessor kept."""

import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from test_llm import shingle_set, words
from tokenizers import Tokenizer

import corpus_pipeline
from tidegauge.llm import quality
from tidegauge.llm.arrow_text import Words, mix

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(12)
    vocabulary = [f"{a}{b}{c}" for a in ("ka", "mo", "ti", "re") for b in ("lun", "par", "sed", "vio") for c in ("a", "es", "or", "um", "ik")]
    lines = [" ".join(rng.choices(vocabulary, k=rng.randint(6, 25))) + "." for _ in range(400)]
    rows, marks = [], []
    for d in range(160):
        text = "\n".join(rng.sample(lines, rng.randint(3, 9)))
        if d % 8 == 1:
            text = re.sub(r"\w+", lambda m: m[0].upper() + "$$$ %%", text)  # symbols and capitals: poor
        if d % 20 == 3:
            text = text.replace(".", " vileword.")
        if d % 10 == 4 and d > 10:
            w = rows[d - 7][1].split(" ")
            w[rng.randrange(len(w))] = "changed"
            text = " ".join(w)
        rows.append((d, text, "x", "s", len(text)))
        if d % 3:
            marks.append((d, 0 if d % 8 == 1 else 1, int(d % 20 == 3)))
    rows += [(200, None, None, None, None), (201, "", "x", "s", 0), (None, lines[0], "x", "s", 1), rows[5], (202, "***\n!!", "x", "s", 6)]
    long = " ".join(rng.choices(vocabulary, k=9000))
    rows.append((203, long, "x", "s", len(long)))
    bench = [(1, " ".join(words(rows[12][1])[4:20])), (2, "never there at all in any of the texts here or there"), (3, None)]
    path = tmp_path_factory.mktemp("corpus")
    for name, data, schema in (("documents", rows, SCHEMA), ("labels", marks, "doc_id long, quality int, toxic int"), ("benchmark", bench, "item_id long, text string")):
        spark.createDataFrame(data, schema).coalesce(2).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def plain_score(text, flagged, weights):
    """Votes and hashed word counts of one text, written out."""
    raw = (text or "").encode()
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    spans = [m.span() for m in re.finditer(rb"[a-z0-9\x80-\xff]+", low)]
    own = [low[a:b] for a, b in spans]
    hashes = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).hash >> np.uint64(20)
    counts = {}
    for h in hashes.tolist():
        counts[h] = counts.get(h, 0) + 1
    n, size = len(own), len(raw)
    odd = sum(not (chr(b).isalnum() and b < 128 or b >= 128 or b in b"\t\n\r .,;:'\"-()?!") for b in raw)
    upper, letter = sum(65 <= b <= 90 for b in raw), sum(65 <= b <= 90 or 97 <= b <= 122 for b in raw)
    twice = sum(a == b for a, b in zip(own, own[1:]))
    stops = sum(b < size and raw[b] in b".?!:" for _, b in spans)
    mean = sum(map(len, own)) / max(n, 1)
    hit = any((h >> 4) in flagged for h in counts)

    def vote(bad, good):
        return 0 if bad else 2 if good else 1

    def share(a, b):
        return a / max(b, 1)

    votes = [
        vote(n < 3, n >= 20), vote(share(odd, size) > 0.04, share(odd, size) < 0.01), vote(share(upper, letter) > 0.3, share(upper, letter) < 0.12),
        vote(share(twice, n) > 0.2, share(twice, n) < 0.05), vote(share(len(counts), n) < 0.2 and n >= 50, share(len(counts), n) > 0.4),
        vote(share(raw.count(b"|"), n) > 0.1, b"|" not in raw), vote(share(raw.count(b"!"), n) > 0.1, share(raw.count(b"!"), n) < 0.02),
        vote(mean > 14 or mean < 2, 3 <= mean <= 10), vote(hit, False), vote(share(stops, n) < 0.01 and n >= 50, share(stops, n) > 0.02)]
    w = weights[:, 1] - weights[:, 0]
    total = sum(w[3 * i + v] for i, v in enumerate(votes))
    x = {h: math.log1p(c) for h, c in counts.items()}
    norm = math.sqrt(max(sum(v * v for v in x.values()), 1e-12))
    spots = quality.FIRST_WORD + (mix(np.array(list(x), np.uint64)) % np.uint64(quality.DIMS - quality.FIRST_WORD)).astype(int) if x else []
    return 1 / (1 + math.exp(-(total + sum(w[s] * v / norm for s, v in zip(spots, x.values())))))


def similar(a, b):
    return 9 * len(a & b) >= 4 * (len(a) + len(b))


def plain_line_filter(rows):
    seen, gone = [], set()
    for i, r in enumerate(rows):
        for k, line in enumerate((r.text or "").split("\n")):
            if words(line):
                seen.append(((r.doc_id if r.doc_id is not None else 2**63 - 1, i, k), frozenset(words(line))))
    seen.sort(key=lambda s: s[0])
    for a, (place, own) in enumerate(seen):
        if any(similar(own, other) for _, other in seen[:a]):
            gone.add(place[1:])
    out = []
    for i, r in enumerate(rows):
        lines = [] if r.text is None else r.text.split("\n")
        kept = [x for k, x in enumerate(lines) if (i, k) not in gone]
        text = None if r.text is None else "\n".join(kept)
        if len(kept) == len(lines) or words(text):
            out.append((r.doc_id, text, r.lang, r.source, None if text is None else len(text)))
    return out


def plain_near_groups(rows):
    sets, label = [shingle_set(r.text) for r in rows], list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and similar(sets[a], sets[b]):
                label[root(a)] = root(b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(i)
    return list(groups.values())


def test_stages_beside_plain_python(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages, kept = dict(corpus_pipeline.STAGES), {}

    def run(name, given):
        stages[name](spark, given, sf_dir).coalesce(1).write.parquet(str(tmp_path / name))
        kept[name] = spark.read.parquet(str(tmp_path / name))
        return [tuple(r) for r in kept[name].collect()]

    def same(got, want):
        assert sorted(map(str, got)) == sorted(map(str, want)) and got

    flagged, weights = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.collect()
    scores = [plain_score(r.text, set(flagged.tolist()), weights) for r in rows]
    assert min(abs(s - 0.5) for s in scores) > 1e-6
    same(run("quality_filter", docs), [tuple(r) for r, s in zip(rows, scores) if s >= 0.5])
    assert 0 < sum(s < 0.5 for s in scores) < len(rows) / 2

    rows = kept["quality_filter"].collect()
    got = run("line_filter", kept["quality_filter"])
    same(got, plain_line_filter(rows))

    rows = kept["line_filter"].collect()
    got = run("near_duplicates", kept["line_filter"])
    first = [min((rows[i] for i in g), key=lambda r: (r.doc_id is None, r.doc_id or 0)) for g in plain_near_groups(rows)]
    same([(r[0], r[1]) for r in got], [(r.doc_id, r.text) for r in first])

    rows = kept["near_duplicates"].collect()
    got = run("decontaminated", kept["near_duplicates"])
    windows = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[i : i + min(len(w), 10)]) for i in range(len(w) - min(len(w), 10) + 1) if w}
    same(got, [tuple(r) for r in rows if not any(tuple(words(r.text)[i : i + len(x)]) == x for x in windows for i in range(len(words(r.text))))])
    assert len(got) < len(rows)

    rows = kept["decontaminated"].collect()
    t, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for r in rows:
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            own = np.array(ids[at : at + 2048], "<u4")
            want.append((r.doc_id, k, at, len(own), zlib.crc32(own.tobytes())))
    packed = stages["packed"](spark, kept["decontaminated"], sf_dir).collect()
    same([tuple(r)[:5] for r in packed], want)
    bins = {}
    for r in packed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        assert [o for o, _ in sorted(own)] == list(np.cumsum([0, *(n for _, n in sorted(own))])[:-1]) and sum(n for _, n in own) <= 2048
    assert sorted(map(str, map(tuple, corpus_pipeline.run(spark, sf_dir).select("doc_id", "piece", "ids_crc32").collect()))) == sorted(
        str((r.doc_id, r.piece, r.ids_crc32)) for r in packed)


def test_stages_of_empty_tables(spark, tmp_path):
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
