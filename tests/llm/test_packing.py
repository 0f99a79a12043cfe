import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from llm.best_fit_packing import WordEncoder, best_fit, pack
from llm.queries import op9_packing
from tests.llm import brute

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_best_fit(lengths, capacity):
    rooms, out = [], []
    for n in lengths:
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms[rooms.index(min(fits))] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms), out


@pytest.mark.parametrize("capacity", [1, 7, 64, 100, 2048])
def test_best_fit(capacity):
    rng = np.random.default_rng(capacity)
    for _ in range(30):
        lengths = sorted(rng.integers(1, capacity + 1, 60).tolist(), reverse=True)
        bins, offsets = best_fit(lengths, capacity)
        used = {}
        for b, o, n in zip(bins, offsets, lengths):
            assert used.get(b, 0) == o
            used[b] = o + n
        assert sorted(capacity - u for u in used.values()) == plain_best_fit(lengths, capacity)[0]


TEXTS = [None, "", " ", "a", "A b C\x1cd\x85e f", "don't can't I'LL", "é ı İ Σας ΣΑΣ ς", "x" * 300, "👍🏽 中文 text<|endoftext|> <|startoftext|>", "one\ttwo\r\nthree\x0bfour\x0cfive", "á ́b", "w1 22 3.14 ..."]


def test_encoder_equals_the_tokenizer_on_whole_texts(spark, sf_dir):
    tokenizer = Tokenizer.from_file(PATH)
    own = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    for remembered in (50, 10**6):
        encoder = WordEncoder(PATH, remembered)
        for at in range(0, len(TEXTS + own), 40):
            block = [t or "" for t in (TEXTS + own)[at : at + 40]]
            want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in block]
            assert encoder.ids(block) == want


def laid_out(rows, length=2048):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= length
    return len(by)


def test_query(spark, sf_dir):
    tokenizer = Tokenizer.from_file(PATH)
    got = op9_packing(spark, sf_dir).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = [(d, *p) for d, t in docs.items() for p in brute.token_pieces(tokenizer, t)]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    assert laid_out(got) <= 1.02 * sum(r.length for r in got) / 2048 + 1


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0), (1, None, 0), (None, "a b", 0), (2, "x y " * 9000, 0)], "doc_id long, text string, piece int")
    got = pack(docs, PATH, group=2).collect()
    laid_out(got)
    assert sorted(r.length for r in got)[:3] == [1, 1, 3] and sum(r.length for r in got) == 18001 + 5
    assert pack(docs.limit(0), PATH).count() == 0


def test_rows_that_repeat_each_other_fill_several_groups(spark):
    docs = spark.range(1000).selectExpr("1L AS doc_id", "repeat('a b ', 500) AS text")
    got = pack(docs, PATH, group=50).collect()
    assert 500 <= laid_out(got) <= 520 and len({r.sequence_id % 20 for r in got}) > 10
