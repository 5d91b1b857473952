"""Language, toxicity, URL filters and sharding on small fixtures."""
import random
import zlib
from datetime import date, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kgloom.llm import exact_dedup, gated_net, language_id, queries, sharding, toxicity, url_filters

from .edges import ROWS, documents, with_clashes

SF = "/root/testdata/sf0.001"


def test_held_out_rows_teach_nothing(spark):
    docs = documents(spark, [(i, t, l, "s", 1) for i in range(80) for t, l in [(f"the house and the garden {i}", "en"), (f"das Haus und der Garten {i}", "de")]])
    rows = language_id.language_report(docs).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    only = docs.filter("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2")
    assert {r.lang_pred for r in language_id.language_report(only).collect()} == {"und"}


def test_language_edges(spark):
    rows = {r.doc_id: r for r in language_id.language_report(documents(spark)).collect()}
    assert {d for d, r in rows.items() if r.lang_pred == "und"} == {2, 3, 7, 9}
    assert all(0 <= r.score <= 1 for r in rows.values()) and rows[4].lang_pred == "en"
    model = language_id.train(documents(spark))
    assert model["langs"] == ["en", "es"]
    docs = with_clashes(documents(spark))
    left = language_id.keep_identified(docs, model)
    assert left.columns == docs.columns and not {2, 3, 7, 9} & {r.doc_id for r in left.collect()}
    assert language_id.language_report(documents(spark, [])).count() == 0


def test_gram_blocks_lose_nothing(monkeypatch):
    text = "Überaus lange Wörter, 中文 und mehr " * 40
    whole = np.sort(np.concatenate(list(language_id.gram_buckets(text, 4096))))
    monkeypatch.setattr(language_id, "BLOCK", 17)
    assert (np.sort(np.concatenate(list(language_id.gram_buckets(text, 4096)))) == whole).all()
    assert len(whole) == sum(len(text) + 2 - n + 1 for n in language_id.SIZES)


def test_model_counts_every_text(spark):
    docs = documents(spark, [(i, text, "xx", "s", 1) for i, text in enumerate(["abc", "bcd", None, "abcabc"])])
    model = language_id.train(docs)
    counts = np.zeros(language_id.BUCKETS) + language_id.SMOOTHING
    for text in ("abc", "bcd", "abcabc"):
        for ids in language_id.gram_buckets(text, language_id.BUCKETS):
            np.add.at(counts, ids, 1)
    assert np.allclose(model["matrix"][:, 0], np.log(counts / counts.sum()), atol=1e-5)


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = language_id.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert out.filter("lang_pred = lang").count() >= 0.95 * out.count()


def test_gradients():
    p = {k: v.astype(np.float64) for k, v in gated_net.new_params(1).items()}
    windows, y, common = [["the", "idiot", "x"], ["lowei", "a"] * 10, ["ok"]], np.array([1, 0, 1.0]), np.ones(gated_net.WORD_BUCKETS, dtype=bool)
    _, g = gated_net.gradients(p, windows, y, common)
    for name, grad in g.items():
        at = int(np.abs(grad).argmax())
        flat, old = p[name].reshape(-1), p[name].reshape(-1)[at]
        losses = []
        for e in (1e-3, -1e-3):
            flat[at] = old + e
            losses.append(gated_net.gradients(p, windows, y, common)[0])
        flat[at] = old
        assert abs((losses[0] - losses[1]) / 2e-3 - grad.reshape(-1)[at]) < 2e-3 * max(1, abs(grad.reshape(-1)[at])), name


def toxic_corpus(n):
    rng = random.Random(4)
    syllables = ["ka", "lo", "mi", "ru", "te", "so", "na"]
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(5, 150))]
        toxic = i % 3 == 0
        for _ in range(rng.randrange(1, 4) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["zarg,", "Zargu", "vexxon."]))
        docs.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_toxicity(spark):
    docs, labels = toxic_corpus(420)
    extra = [(9001, None, "en", "s", 0), (9002, " ", "en", "s", 0), (9003, docs[1][1] + " zarg " + docs[2][1], "en", "s", 0), (9004, "x" * 100_000, "en", "s", 0), (None, "vexxon", "en", "s", 1)]
    frame = with_clashes(documents(spark, docs + extra))
    marks = spark.createDataFrame([*labels, (7777, 1, 1), (5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in toxicity.toxicity_report(frame, marks).collect()}
    assert len(out) == 425
    assert all(r.held_out == (d is not None and zlib.crc32(str(d).encode()) % 3 == 1) for d, r in out.items())
    right = [out[i].predicted == y for i, _, y in labels if out[i].held_out]
    assert np.mean(right) >= 0.95
    assert out[9001].score == out[9002].score == 0 and out[9003].predicted == 1 and 0 <= out[9004].score <= 1
    assert toxicity.toxicity_report(frame, marks.filter("toxic = 0")).agg(F.max("score")).first()[0] == 0
    assert toxicity.toxicity_report(documents(spark, []), marks).count() == 0


def test_scorer_is_the_same_for_any_batches():
    params = {"params": gated_net.new_params(3), "common": np.ones(gated_net.WORD_BUCKETS, dtype=bool)}
    texts = [r[1] for r in ROWS] + ["one two three " * 30]
    whole = gated_net.Scorer(**params).texts(texts)
    single = gated_net.Scorer(**params)
    single.WORDS = 40
    assert np.allclose(whole, [single.texts([t])[0] for t in texts], atol=1e-4)
    logits, owner = gated_net.Scorer(**params).windows(["w " * 100])
    assert len(logits) == len(range(0, 84, gated_net.STRIDE)) and set(owner.tolist()) == {0}


def brute_verdict(url, at, entries):
    host = url_filters_host(url)
    if not host or at is None:
        return "unlisted"
    labels = host.split(".")
    rules = [("url:" + url.split("#")[0], 1000), ("host:" + host, 999)] + [("domain:" + ".".join(labels[-k:]), k) for k in range(2, len(labels))]
    best = (0, "unlisted")
    for rule, rank in rules:
        past = [(d, a == "allow", e or date.max) for r, a, d, e in entries if r == rule and d is not None and d <= at]
        if past:
            _, allowed, ends = max(past)
            if at < ends:
                best = max(best, (rank, "allowed" if allowed else "blocked"))
    return best[1]


def url_filters_host(url):
    import re
    m = re.match(r"[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", (url or "").lower())
    return m[1] if m else ""


def test_url_filters(spark):
    rng = random.Random(9)
    day = lambda: date(2024, 1, 1) + timedelta(days=rng.randrange(60))
    hosts = ["a.example.com", "b.example.com", "example.com", "deep.x.y.example.org", "u.net"]
    urls = [f"https://{rng.choice(hosts)}/{rng.randrange(4)}{rng.choice(['', '#f', '?q'])}" for _ in range(300)] + ["https://a.example.com/hot"] * 300
    captures = [(i, u, day()) for i, u in enumerate(urls)] + [(900, None, day()), (901, "no url", day()), (902, "HTTP://User@A.Example.com:80/", day()), (903, urls[0], None), (None, urls[1], day())]
    rules = [f"host:{h}" for h in hosts] + ["domain:example.com", "domain:y.example.org", "url:https://a.example.com/hot", None]
    entries = [(rng.choice(rules), rng.choice(["block", "allow"]), rng.choice([day(), day(), day(), None]), rng.choice([None, None, day()])) for _ in range(120)]
    frame = spark.createDataFrame(captures, "capture_id long, url string, fetched_on date").withColumn("rule", F.lit("own"))
    lists = spark.createDataFrame(entries, "rule string, action string, listed_on date, expires_on date")
    out = url_filters.filter_urls(frame.repartition(7), lists).collect()
    assert len(out) == len(captures)
    want = {(i, u, d): brute_verdict(u, d, entries) for i, u, d in captures}
    assert {(r.capture_id, r.url, r.fetched_on): r.verdict for r in out} == want and len(set(want.values())) == 3
    assert url_filters.filter_urls(frame.limit(0), lists).count() == 0
    assert {r.verdict for r in url_filters.filter_urls(frame, lists.limit(0)).collect()} == {"unlisted"}


@pytest.mark.parametrize("name,table", [("op5_url_filters", "pages"), ("op9_exact_dedup", "documents")])
def test_twins(spark, name, table):
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.SQL[name])
    assert sorted(d[0] for d in want.description) == sorted(df.columns)
    order = [d[0] for d in want.description]
    assert sorted(tuple(map(str, r)) for r in df.select(*order).collect()) == sorted(tuple(map(str, r)) for r in want.fetchall())


def shards_of(rows, shards):
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows))) for s in range(shards))
    return [sum(r["size"] for r in rows if r.shard == s) for s in range(shards)]


def test_sharding(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.choice([3, 10, 40, 300]) + str(i % 900), "en", "s", 1) for i in range(1200)]
    rows += [(5000 + i, "copy of one text", "en", "s", 1) for i in range(600)] + [(9000, None, "en", "s", 1), (9001, "", "en", "s", 1), (9000, None, "en", "s", 1), (None, "ü", "en", "s", 1)]
    out = sharding.shard_report(with_clashes(documents(spark, rows)), 8).collect()
    assert len(out) == len(rows)
    sizes = shards_of(out, 8)
    assert max(sizes) <= 1.02 * sum(sizes) / 8 and min(sizes) >= 0.98 * sum(sizes) / 8
    by = {r.doc_id: r for r in out}
    assert (by[9000]["size"], by[9000].text_crc32) == (8, 0) and (by[None]["size"], by[None].text_crc32) == (10, zlib.crc32("ü".encode()))
    text_shards = {}
    for i, text, *_ in rows:
        text_shards.setdefault(text or "", set()).add(by[i].shard)
    # equal texts stay together unless they exceed a shard
    assert all(len(s) == 1 for t, s in text_shards.items() if t != "copy of one text") and len(text_shards["copy of one text"]) > 1
    assert sharding.shard_report(documents(spark, [])).count() == 0
    assert len(sharding.shard_report(documents(spark)).collect()) == len(ROWS)


def test_place_uses_all_dimensions():
    items = np.array([[10.0, 1, 1], [10, 1, 1], [1, 10, 1], [1, 10, 1]])
    chosen = sharding.place(items, 2)
    assert [sum(items[chosen == s, d].sum() for d in range(2)) for s in range(2)] == [22.0, 22.0]


def test_exact_prefix_groups_need_full_hash(spark):
    prefix = "p" * exact_dedup.PREFIX_CHARS
    out = exact_dedup.exact_groups(documents(spark, [(1, prefix + "a", None, None, 1), (2, prefix + "b", None, None, 1), (3, prefix + "a", None, None, 1)]), with_hash=False)
    assert {r.doc_id: r.keep_id for r in out.collect()} == {1: 1, 2: 2, 3: 1}
