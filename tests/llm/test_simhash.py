import numpy as np
import pytest

from llm import simhash_golay as S
from llm.queries import op7_simhash
from tests.llm import brute


def test_golay_decodes_every_word_within_distance_three():
    words = np.arange(1 << 23, dtype=np.uint32)
    codes = words ^ S._errors()[S._remainder(words)]
    assert np.bitwise_count(words ^ codes).max() == 3 and not S._remainder(codes[::997]).any()
    assert len(np.unique(S.golay_index(words))) == 4096


def test_words_have_one_or_six_indices_and_neighbours_share_one():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 23, 3000).astype(np.uint32)
    keys = S.fuzzy_keys(x, 23)
    assert {len(set(k)) for k in keys.tolist()} == {1, 6}
    y = x ^ (np.uint32(1) << rng.integers(0, 23, 3000).astype(np.uint32))
    assert all(set(a) & set(b) for a, b in zip(keys.tolist(), S.fuzzy_keys(y, 23).tolist()))


@pytest.mark.parametrize("paired", [0, 3, 32])
def test_links_connect_all_within_two_bits(spark, paired):
    rng = np.random.default_rng(2)
    seeds = rng.integers(-(1 << 63), 1 << 63, 40)
    found = {int(s) for s in seeds}
    for s in seeds.tolist():
        for _ in range(12):
            a, b = rng.integers(0, 64, 2).tolist()
            found.add(int(np.int64(np.uint64(s & (1 << 64) - 1) ^ np.uint64(1 << a) ^ np.uint64(1 << b)).astype(np.int64)))
    fps = sorted(found)
    edges = [(r.a, r.b) for r in S.links(spark.createDataFrame([(f,) for f in fps], "fp long"), paired).collect()]
    u = np.array(fps).view(np.uint64)
    near = [(i, int(j)) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(u ^ u[i]) <= 2)]
    at = {f: i for i, f in enumerate(fps)}
    assert all(np.bitwise_count(u[at[a]] ^ u[at[b]]) <= 2 for a, b in edges)
    by = lambda pairs: [min(x) for x in [[i for i, r in enumerate(c) if r == c[k]] for k in range(len(fps))]] if (c := brute.components(len(fps), pairs)) else []
    assert by([(at[a], at[b]) for a, b in edges]) == by(near)


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in op7_simhash(spark, sf_dir).collect())
    assert got == sorted(brute.simhash_classes(rows))


def test_edges(spark):
    rows = [(5, None), (3, ""), (9, " \n"), (None, "one two three four"), (7, "ONE two three four"), (7, "one two three four"), (8, "a"), (4, "É b"), (6, "é b"), (2, "w " * 50000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int")
    key = lambda r: tuple(str(x) for x in r)
    got = sorted(((r.id, r.fingerprint, r.component_id) for r in S.near_duplicates(docs).collect()), key=key)
    assert got == sorted(brute.simhash_classes(rows), key=key)
    kept = S.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 6, 7, 8]
    assert S.near_duplicates(docs.limit(0)).count() == 0
