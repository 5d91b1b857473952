"""Exact copies, near copies and near vectors against brute force."""
import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgloom.llm import exact_dedup, ngram_join, vector_dedup
from kgloom.llm.components import connected_components

from .edges import ROWS, documents, with_clashes


class Groups:
    def __init__(self):
        self.parent = {}

    def find(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def tie(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


def test_exact_groups(spark):
    rows = exact_dedup.exact_groups(documents(spark)).collect()
    assert len(rows) == len(ROWS)
    same = collections.Counter(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in ROWS)
    assert sorted(r.group_size for r in rows) == sorted(same[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")] for r in ROWS)
    by = {r.doc_id: r for r in rows}
    assert {d for d, r in by.items() if r.kept} == {1, 2, 4, 7, 8, 9, None}
    assert by[6].keep_id == by[5].keep_id == 1 and by[3].keep_id == 2 and by[7].keep_id == 7
    assert exact_dedup.exact_groups(documents(spark, [])).count() == 0


@pytest.mark.parametrize("few", [0, 200_000])
def test_exact_groups_alike_for_any_join(spark, monkeypatch, few):
    monkeypatch.setattr(exact_dedup, "broadcast_if_small", lambda df: F.broadcast(df) if few else df)
    for with_hash in (True, False):
        got = exact_dedup.exact_groups(documents(spark), with_hash=with_hash).select("doc_id", "keep_id", "group_size", "kept").collect()
        assert sorted(map(repr, got)) == sorted(map(repr, exact_dedup.exact_groups(documents(spark)).select("doc_id", "keep_id", "group_size", "kept").collect()))


def test_drop_exact_copies_keeps_columns(spark):
    docs = with_clashes(documents(spark))
    left = exact_dedup.drop_exact_copies(docs)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(["1", "1", "2", "4", "7", "8", "9", "None"])


def test_only_the_copy_itself_is_dropped(spark):
    near = " ".join(f"w{i}" for i in range(60))
    rows = [(3, "a b"), (7, "a  b"), (7, "one of its own"), (None, "a b"), (None, "no other has this"), (None, "twice  and no id"), (None, "twice and no id"),
            (20, near), (21, near + " x"), (21, "far from that"), (None, near + " y"), (None, "blank"), (5, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = [(r.doc_id, re.sub(" +", " ", r.text or "")) for r in exact_dedup.drop_exact_copies(docs).collect()]
    own = [(3, "a b"), (7, "one of its own"), (None, "no other has this"), (None, "twice and no id"), (20, near), (21, "far from that"), (None, "blank"), (5, "")]
    assert sorted(map(repr, left)) == sorted(map(repr, [*own, (21, near + " x"), (None, near + " y")]))
    left = [(r.doc_id, re.sub(" +", " ", r.text or "")) for r in ngram_join.drop_near_copies(docs).collect()]
    # texts without words link with nothing
    assert sorted(map(repr, left)) == sorted(map(repr, [*own, (None, "")]))


def test_hot_exact_group(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "one and the same").otherwise(F.concat(F.lit("own "), "id")).alias("text"))
    out = exact_dedup.exact_groups(docs)
    assert out.filter("kept").count() == 20_001 and out.agg(F.max("group_size")).first()[0] == 10_000


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 300)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)]
    links += [(None, 5), (7, None), (9, 9), (3, 2), (3, 2)]
    want = Groups()
    for a, b in links:
        if a is not None and b is not None and a != b:
            want.tie(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: want.find(x) for x in want.parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute_groups(rows):
    sets, groups = [(r[0], shingles(r[1])) for r in rows if r[0] is not None], Groups()
    for i, (a, x) in enumerate(sets):
        groups.find(a)
        for b, y in sets[:i]:
            if x and y and a != b and 100 * len(x & y) >= 80 * len(x | y):
                groups.tie(a, b)
    return {d: (len(s), groups.find(d)) for d, s in sets}


def near_corpus(seed, size=160):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [f"p{i}" for i in range(60)]
    rows, i = [], 0
    while i < size:
        base = [rng.choice(words) for _ in range(rng.choice([3, 4, 5, 6, 9, 12, 40, 120, 300]))]
        if rng.random() < 0.4:
            base = base + passage
        for _ in range(rng.choice([1, 1, 2, 5, 12])):
            text = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 30) + 1)):
                text[rng.randrange(len(text))] = rng.choice(words)
            if rng.random() < 0.3:
                text = text[:len(text) - rng.randrange(0, len(text) // 8 + 1)] or text
            rows.append((i, rng.choice([" ", "  ", "\n"]).join(w.upper() if rng.random() < 0.1 else w for w in text)))
            i += 1
    return rows


@pytest.mark.parametrize("seed,least", [(1, 24), (2, 0)])
def test_similar_groups_equal_brute_force(spark, monkeypatch, seed, least):
    # with a small table and a low limit, most tokens are frequent and pairs of tokens are indexed
    if not least:
        monkeypatch.setattr(ngram_join, "LEAST_FREQUENT", 1)
        monkeypatch.setattr(ngram_join, "DEVIATIONS", 0)
    rows = near_corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == brute_groups(rows)


def test_signatures_are_shared():
    rng = np.random.default_rng(4)
    for trial in range(400):
        n = int(rng.integers(4, 300))
        base = rng.integers(0, 1 << 63, n).astype(np.uint64)
        out = int(rng.integers(0, n // 9 + 1))
        a = np.unique(base)
        b = np.unique(np.concatenate([base[out:], rng.integers(0, 1 << 63, int(rng.integers(0, out + 1))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both < 80 * (len(a) + len(b) - both) or len(a) == len(b) == both:
            continue
        frequent = rng.random(1 << ngram_join.COUNTERS_LOG2) < rng.choice([0.0, 0.5, 0.9, 1.0])
        assert len(np.intersect1d(ngram_join.signatures(a, frequent), ngram_join.signatures(b, frequent)))
        assert ngram_join.most_shared(ngram_join.profile(a), ngram_join.profile(b)) >= both


def test_word_hashes_in_blocks(monkeypatch):
    text = (b"alpha  beta\tgamma " * 50 + b"d" * 200 + b" end").ljust(2000)
    whole = ngram_join.word_hashes(text)
    assert len(whole) == len(text.split())
    monkeypatch.setattr(ngram_join, "BLOCK", 64)
    assert (ngram_join.word_hashes(text) == whole).all() and len(set(whole.tolist())) == 5
    assert not len(ngram_join.word_hashes(b" \n\t")) and not len(ngram_join.shingle_set(None))


def test_similar_groups_edges(spark):
    rows = ngram_join.similar_groups(with_clashes(documents(spark))).collect()
    assert len(rows) == len(ROWS)
    by = {r.doc_id: r for r in rows}
    assert by[6].component_id == by[5].component_id == 1 and by[2].n_shingles == 0 and by[2].component_id == 2
    assert by[None].component_id is None and by[9].n_shingles == 1
    left = ngram_join.drop_near_copies(with_clashes(documents(spark)))
    assert {r.doc_id for r in left.collect()} == {1, 2, 3, 4, 7, 8, 9, None} and left.columns == with_clashes(documents(spark)).columns
    assert ngram_join.similar_groups(documents(spark, [])).count() == 0


def test_large_group_of_near_copies(spark):
    rng = random.Random(8)
    base = [f"b{i}" for i in range(60)]
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1:])) for i in range(1500) for k in [rng.randrange(60)]]
    out = ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    want = Groups()
    # an edit at an end costs few shingles, so all edits near the ends link
    got = {r.doc_id: r.component_id for r in out.collect()}
    sets = [shingles(t) for _, t in rows[:200]]
    for i in range(200):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                assert got[i] == got[j]
    assert len(got) == 1500


def brute_vectors(rows, threshold=0.93):
    n, links, groups = len(rows), [0] * len(rows), Groups()
    unit = []
    for _, v, label in rows:
        ok = v is not None and len(v) and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v, dtype=float) / np.linalg.norm(np.array(v, dtype=float)) if ok else None)
    for i in range(n):
        groups.find(i)
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                groups.tie(i, j)
    low = {}
    for i in range(n):
        g = groups.find(i)
        low[g] = min(low.get(g, rows[i][0]), rows[i][0])
    return sorted((rows[i][0], links[i], low[groups.find(i)]) for i in range(n))


@pytest.mark.parametrize("block", [512, 7])
def test_vectors_equal_brute_force(spark, block):
    rng = np.random.default_rng(6)
    rows, i = [], 0
    for _ in range(30):
        base, label = rng.standard_normal(16), int(rng.integers(0, 3))
        for k in range(int(rng.integers(1, 14))):
            v = base + rng.standard_normal(16) * rng.choice([0.0, 0.02, 0.1])
            rows.append((i, [float(np.float32(x)) for x in v], label if rng.random() < 0.95 else None))
            i += 1
    rows += [(i, None, 1), (i + 1, [0.0] * 16, 1), (i + 2, [float("nan")] * 16, 1), (i + 3, [None] * 16, 1), (i + 4, [], 1), (i + 5, [1e30] * 16, 1), (i + 6, [2e30] * 16, 1)]
    rows += [(i + 7 + k, rows[0][1], rows[0][2]) for k in range(25)]
    out = vector_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5), block=block).collect()
    got, want = sorted((r.vec_id, r.n_links, r.component_id) for r in out), brute_vectors(rows)
    assert sum(g[1] for g in got) >= 0.97 * sum(w[1] for w in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want)) and [g[2] for g in got] == [w[2] for w in want]
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)


def test_vectors_empty(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int, kept string")
    assert vector_dedup.near_duplicate_vectors(empty).count() == 0
