"""Exact search, hard negatives and spelling variants against brute force."""
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgloom.llm import exact_topk, hard_negatives, spelling, vector_cells

SCHEMA = "vec_id long, embedding array<double>, label int, row long, grp int, extra string"


def _vectors():
    """Clusters, a vector that many rows share, ties, rows to leave out, other lengths and large components."""
    rng = random.Random(5)
    center = [rng.gauss(0, 1) for _ in range(12)]
    rows = [(i, [rng.gauss(0, 1) for _ in range(12)], i % 4) for i in range(700)]
    rows += [(700 + i, [c + rng.gauss(0, 0.05) for c in center], 4) for i in range(150)]
    rows += [(900 + i, [0.5] * 12, i % 2) for i in range(420)]
    rows += [(2000, None, 1), (2100, [None] * 12, 1), (2200, [float("nan")] + [0.0] * 11, 1), (2300, [float("inf")] * 12, 1), (None, [9.0] * 12, 1),
             (2400, [1.0, 2.0], 1), (2401, [2.0, 1.0], 2), (2402, [0.5, 0.5], 1), (2500, [], 1), (2501, [], 2), (2502, [], 1), (2600, [0.0] * 12, 1), (2700, [1.0] * 12, None)]
    rows += [(2800, [1e9, -1e9, 3.0], 1), (2801, [1e9, 1e9, 1.0], 1), (2802, [-1e9, 1e9, 1.0], 2), (2803, [1e8, -9e8, 7.0], 2)]
    return rows


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, 2, "x") for i, v, label in rows], SCHEMA).repartition(5)


def _usable(rows, scale):
    out = []
    for i, v, label in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            out.append((i, [int(np.floor(scale * x)) for x in v], label))
    return out


def _score(a, b):
    return sum(x * y for x, y in zip(a, b))


def _clamp(s):
    return max(-(1 << 63), min((1 << 63) - 1, s))


def test_exact_topk_equals_brute_force(spark, rows):
    vectors = _vectors()
    usable = _usable(vectors, 1024)
    want = []
    for i, q, _ in usable:
        if i % 100 == 0:
            scored = sorted((-_score(q, v), j) for j, v, _ in usable if len(v) == len(q) and j != i)
            want += [(i, k + 1, j, _clamp(-s)) for k, (s, j) in enumerate(scored[:10])]
    assert rows(exact_topk.exact_topk(_frame(spark, vectors))) == sorted(want, key=repr)


def test_topk_with_few_rows_repeated_ids_and_none(spark, rows):
    few = [(0, [1.0], 1), (0, [2.0], 1), (5, [3.0], 1)]
    got = rows(exact_topk.exact_topk(_frame(spark, few)))
    assert got == sorted([(0, 1, 5, 3 << 20), (0, 2, 0, 2 << 20), (0, 1, 5, 6 << 20), (0, 2, 0, 2 << 20)], key=repr)
    empty = exact_topk.exact_topk(_frame(spark, few).limit(0))
    assert empty.columns == ["query_id", "rank", "vec_id", "score"] and empty.count() == 0


def test_blocks_are_pruned_without_loss():
    rng = np.random.default_rng(3)
    matrix = np.concatenate([rng.integers(-5, 5, (exact_topk.BLOCK * 6, 8)), rng.integers(90, 100, (exact_topk.BLOCK, 8))])
    ids = np.arange(len(matrix))
    blocks = exact_topk._Blocks(matrix, ids, ids)
    scored = []
    score = blocks.score
    blocks.score = lambda at, *rest: (scored.append(at), score(at, *rest))[1]
    q, s, i, _ = exact_topk.search_blocks(blocks, np.full((1, 8), 3), np.array([-1]), np.array([-(1 << 200)], dtype=object), 10)
    order = np.lexsort((ids, -(matrix @ np.full(8, 3))))[:10]
    assert i.tolist() == order.tolist() and scored == [6]


def _negatives(vectors, shift):
    usable = [(i, v, (label + 1) % 10 if shift and i % 7 == 0 else label) for i, v, label in _usable(vectors, 256) if label is not None]
    want = []
    for i, a, label in usable:
        if i % 100:
            continue
        others = sorted((-_score(a, v), j, x) for j, v, x in usable if j != i and len(v) == len(a))
        for p, j, _ in [o for o in others if o[2] == label][:5]:
            near = [o for o in others if o[2] != label and 30 * -p <= 100 * -o[0] <= 90 * -p][:10]
            want += [(i, j, k + 1, n, _clamp(-p), _clamp(-s)) for k, (s, n, _) in enumerate(near)]
    return sorted(want, key=repr)


def test_hard_negatives_equal_brute_force(spark, rows):
    vectors = _vectors()
    assert rows(hard_negatives.mined_negatives(_frame(spark, vectors))) == _negatives(vectors, True)
    assert rows(hard_negatives.hard_negatives(_frame(spark, vectors))) == _negatives(vectors, False)
    empty = hard_negatives.mined_negatives(_frame(spark, vectors).limit(0))
    assert empty.count() == 0 and empty.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("reach", [3, 1000, 1 << 30, 1 << 62])
def test_packed_products_are_exact(reach):
    rng = random.Random(reach)
    matrix = np.array([[rng.randint(-reach, reach) for _ in range(7)] for _ in range(40)], dtype=np.int64)
    block = hard_negatives.PackedBlock(matrix)
    for anchor in ([rng.randint(-reach, reach) for _ in range(7)], [0] * 7, [reach] * 7, [-reach] * 7, [1, -1] + [0] * 5):
        assert [int(x) for x in block.scores(anchor)] == [_score(anchor, row) for row in matrix.tolist()]


def test_windows():
    assert hard_negatives.window(100) == (30, 90) and hard_negatives.window(7) == (3, 6) and hard_negatives.window(0) == (0, 0)
    assert hard_negatives.window(-5)[0] > hard_negatives.window(-5)[1]


def test_groups_bound_what_a_task_holds(spark):
    rows = vector_cells.integer_vectors(_frame(spark, _vectors()), 1024)
    assert vector_cells.group_count(rows, 1000) > vector_cells.group_count(rows) >= 2


def _texts():
    rng = random.Random(11)
    base = ["colour", "color", "colours", "analyse", "analyze", "analyzed", "straße", "strasse", "naïvely", "naively", "Écologie", "écologie", "abcde", "bacde", "aaaaa", "aaaaaa", "aaaaaaa"]
    stem = "".join(rng.choice("abcdefgh") for _ in range(24))
    base += [stem[:k] + c + stem[k + 1:] for k in (0, 11, 12, 23) for c in "xyz"] + [stem[:k] + stem[k + 1:] for k in range(0, 24, 5)] + [stem]
    base += ["prefixes" + a + b for a in "abcdefghij" for b in "klmnopqrst"]
    base += ["x" * 5000 + "yz", "x" * 5000 + "y", "x" * 5001 + "yz"]
    rows = [(i, " ".join(rng.choices(base, weights=[1 + (k * 7919) % 23 for k in range(len(base))], k=80)) + ", ab×cd 7 " + base[i % len(base)].upper()) for i in range(60)]
    rows += [(100 + i, "catalog " * 20 + "catalogs " * 7 + "catalogss " * 2) for i in range(6)]
    return rows + [(None, "colour colour"), (3, None), (4, ""), (5, "colour-colour colour\tcolour"), (5, "colour-colour colour\tcolour"), (6, "1234 ... "), (7, "tiny word " * 9)]


def _lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def _brute_words(rows):
    import re
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = _lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode("utf-8"))
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def _one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


@pytest.mark.parametrize("pairs", [2, spelling.PAIRS])
def test_near_pairs_equal_brute_force(spark, pairs):
    words = sorted(_brute_words(_texts()))
    got = {tuple(r) for r in spelling.near_pairs(spark.createDataFrame([(w,) for w in words], "word string"), pairs).collect()}
    assert len(got) > 800
    assert {frozenset(p) for p in got} == {frozenset((a, b)) for k, a in enumerate(words) for b in words[k + 1:] if _one_edit(a, b)}


def test_spelling_variants_equal_brute_force(spark, rows):
    texts = _texts()
    words = _brute_words(texts)
    form = {}
    near = {w: [v for v in words if _one_edit(w, v)] for w in words}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w
    docs = spark.createDataFrame([(i, t, "w") for i, t in texts], "doc_id long, text string, word string").repartition(3)
    want = [(w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()]
    assert any(form[w] and form[form[w]] for w in words)
    assert rows(spelling.spelling_variants(docs)) == sorted(want, key=repr)
    none = spelling.spelling_variants(docs.filter(F.lit(False)))
    assert none.columns == ["word", "form", "root", "n", "n_near", "form_n"] and none.count() == 0


def test_runs_across_blocks(monkeypatch):
    text = " ".join(["wordy", "longer" * 9, "é" * 30] * 40)
    whole = spelling._runs(text)
    monkeypatch.setattr(spelling, "BLOCK", 7)
    assert spelling._runs(text) == whole == Counter({"wordy": 40, "longer" * 9: 40, "é" * 30: 40})
