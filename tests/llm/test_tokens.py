"""Encoding, counting and packing against the tokenizers library."""
import hashlib
import random
import zlib
from array import array

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kgloom.llm import bpe_codec, merges, packing, token_counts
from kgloom.llm.common import tokenizer_path

from .edges import ROWS, documents, with_clashes

WORD, BYTE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(3)
    letters = "aàéßñçΣσς İıǅ中文한국어кир'’.,!?-_ \t\n 0123²½x"
    return [r[1] or "" for r in ROWS] + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(400)] + [
        "a  b", " a", "a ", "a \n b", "\n\na", "a\n \nb", "don't WE'LL it's", "a\x1cb", "<|startoftext|>x<|endoftext|>", "aaaaaaaaaaaaaaaa" * 50]


def test_encoder_equals_library(odd_texts):
    for path in (WORD, BYTE):
        library, own = Tokenizer.from_file(path), merges.Encoder(merges.load(path))
        for text in odd_texts:
            ids = library.encode(text, add_special_tokens=False).ids
            assert own.encode(text) == array("I", ids).tobytes(), repr(text[:80])
    library, own = Tokenizer.from_file(WORD), merges.Encoder(merges.load(WORD))
    for text in odd_texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.decode(array("I", ids).tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_counter_equals_library(odd_texts):
    tables = merges.load(BYTE)
    counter = token_counts.TokenCounter({**tables, "whole": token_counts.whole_tokens(BYTE)})
    library = Tokenizer.from_file(BYTE)
    for text in odd_texts:
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text[:80])


def test_whole_tokens_are_proven():
    library = Tokenizer.from_file(BYTE)
    proven = token_counts.whole_tokens(BYTE)
    assert len(proven) > 40_000
    for text in random.Random(1).sample(proven, 500):
        assert len(library.encode(text, add_special_tokens=False).ids) == 1


def test_full_memo_is_emptied():
    memo = merges.Kept(len, 3)
    assert [memo[k] for k in ("a", "bb", "ccc", "dddd", "a", "x" * 999)] == [1, 2, 3, 4, 1, 999]
    assert len(memo) <= 3 and "x" * 999 not in memo


def test_codec_rows(spark):
    out = bpe_codec.codec_digests(documents(spark)).collect()
    assert len(out) == len(ROWS)
    library = Tokenizer.from_file(WORD)
    want = sorted((str(r[0]), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest(), len(ids))
                  for r in ROWS for ids in [library.encode(r[1] or "", add_special_tokens=False).ids])
    assert sorted((str(r.doc_id), r.ids_sha256, r.decoded_sha256, r.n_tokens) for r in out) == want
    clash = with_clashes(documents(spark)).drop("ids", "decoded")
    both = bpe_codec.decode(bpe_codec.encode(clash, WORD), WORD)
    assert both.columns == [*clash.columns, "ids", "decoded"] and both.count() == len(ROWS)


def test_counts_rows(spark):
    rows = {r.doc_id: r for r in token_counts.token_report(documents(spark)).collect()}
    assert (rows[2].n_bytes, rows[2].n_tokens, rows[2].over_limit) == (0, 0, False)
    assert rows[4].over_limit and rows[8].n_bytes == len(ROWS[8][1].encode())


@pytest.mark.parametrize("report", [bpe_codec.codec_digests, token_counts.token_report, packing.pack_documents])
def test_empty_table(spark, report):
    assert report(documents(spark, [])).count() == 0


def check_packing(rows, capacity):
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_seq), by_doc


def test_packing(spark):
    docs = documents(spark).filter("doc_id is not null").dropDuplicates(["doc_id"])
    rows = packing.pack_documents(with_clashes(docs), capacity=256).collect()
    sequences, by_doc = check_packing(rows, 256)
    library = Tokenizer.from_file(WORD)
    texts = {r[0]: r[1] for r in ROWS}
    total = 0
    for doc, parts in by_doc.items():
        ids = library.encode(texts[doc] or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        for k, (piece, start, length) in enumerate(sorted(parts)):
            assert (piece, start) == (k, 256 * k) and length == min(256, len(ids) - start)
    crc = {(r.doc_id, r.piece): r.ids_crc32 for r in rows}
    ids = library.encode(texts[4], add_special_tokens=False).ids + [0]
    assert crc[4, 1] == zlib.crc32(array("I", ids[256:512]).tobytes())
    assert sequences <= -(-total // 256) + 1


def test_packing_merges_over_rounds(spark):
    rng = np.random.default_rng(5)
    pieces = spark.createDataFrame([(i, 0, 0, int(n), 0) for i, n in enumerate(rng.integers(1, 101, 4000))],
                                   "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(40)
    total = pieces.agg(F.sum("length")).first()[0]
    for per_task, waste in ((100_000, 1.03), (50, 1.06)):
        sequences, by_doc = check_packing(packing.pack_pieces(pieces, 100, bins_per_task=per_task).collect(), 100)
        assert len(by_doc) == 4000 and sequences <= total / 100 * waste + 1
    wide = spark.createDataFrame([(i, 0, 0, 60, 0) for i in range(500)], pieces.schema).repartition(9)
    assert check_packing(packing.pack_pieces(wide, 100).collect(), 100)[0] == 500


def test_best_fit_is_tightest():
    assert len(set(packing.best_fit(np.array([6, 5, 4, 3, 2]), 10))) == 2
    bins = packing.best_fit(np.array([7, 8, 3, 2]), 10)
    assert bins[0] == bins[2] and bins[1] == bins[3]


def test_new_words_of_a_block_are_merged_together(monkeypatch, odd_texts):
    tables = merges.load(tokenizer_path("word_bpe_49k.json"))
    rng = random.Random(7)
    words = ["".join(rng.choices("thernadoüß", k=rng.randint(1, 60))) + rng.choice(["", ".", "?!", "'s", "7,"]) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=200)).title() for _ in range(40)] + ["", "a\x1cb <|endoftext|> İx ΑΣ é 'll", " ".join(tables["specials"]), *odd_texts]
    plain = merges.Encoder(tables)
    expected = [plain.encode(t) for t in texts]
    single = []
    monkeypatch.setattr(merges.BulkEncoder, "merge", lambda self, word: single.append(word) or merges.Encoder.merge(self, word))
    assert list(merges.BulkEncoder(tables).encode_all(texts)) == expected
    assert len(single) < len(words) / 3
    # blocks smaller than a text
    monkeypatch.setattr(merges, "BLOCK", 7)
    assert list(merges.BulkEncoder(tables).encode_all(texts)) == expected
    assert list(merges.BulkEncoder(tables).encode_all([])) == []


def test_encoder_of_many_texts_holds_little_at_a_time(odd_texts, monkeypatch):
    """Pieces become arrays part by part, and small parts give the same ids as one large one."""
    own, bulk = merges.Encoder(merges.load(WORD)), merges.BulkEncoder(merges.load(WORD))
    want = [own.encode(t) for t in odd_texts]
    held = []
    array_of = merges.pa.array
    monkeypatch.setattr(merges.pa, "array", lambda values, *a: (held.append(len(values)) if a == (merges.pa.string(),) else None) or array_of(values, *a))
    assert list(bulk.encode_all(["a bc def " * 20_000])) == [own.encode("a bc def " * 20_000)] and max(held) <= merges.BLOCK
    held.clear()
    assert list(bulk.encode_all(["a bc def " * 2000] * 60)) == [own.encode("a bc def " * 2000)] * 60
    assert max(held) <= merges.PART + 6000
    monkeypatch.setattr(merges, "PART", 5)
    monkeypatch.setattr(merges, "BLOCK", 17)
    assert list(bulk.encode_all(odd_texts)) == want
    assert list(bulk.encode_all([])) == [] and list(bulk.encode_all(["", " "])) == [b"", b""]
