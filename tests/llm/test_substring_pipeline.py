import hashlib
import random
from collections import Counter

import pytest

import corpus_pipeline
from llm.queries import op6_substring_dedup
from llm.substring_dedup import Automaton, remove_repeats, segments
from tests.llm import brute


def test_segments_cover_each_window_once_and_depend_on_content():
    rng = random.Random(1)
    w = [rng.choice([b"a", b"b", b"c"]) for _ in range(300)]
    phrase, _, first, n = segments(w)
    assert [int(f) for f in first] == [0, *(int(x) for x in (first + n)[:-1])] and int((first + n)[-1]) == 251
    inner = segments(w[100:170])
    own = {int(s) + k: int(p) for p, s, c in zip(phrase, first, n) for k in range(int(c))}
    assert all(own[100 + int(s) + k] == int(p) for p, s, c in zip(inner[0], inner[2], inner[3]) for k in range(int(c)))


def test_automaton_finds_every_occurrence_of_earlier_owners_only():
    found = Automaton({b"a b c": 1, b"b c": 7, b"x": 3})
    assert found.covered(b"b c a b c z x a b".split(), 5).tolist() == [False, False, True, True, True, False, True, False, False]
    assert found.covered(b"b c a b c".split(), 8).tolist() == [True] * 5
    assert found.covered(b"b c".split(), 7) is None and found.covered([], 9) is None


def check(rows, got):
    gone = brute.removed_words(rows)
    for k, (ident, text) in enumerate(rows):
        w = brute.words(text)
        kept = " ".join(x for x, g in zip(w, gone[k]) if not g)
        assert got[ident] == (len(w), sum(gone[k]), hashlib.sha256(kept.encode()).hexdigest()), ident


def test_against_brute_force(spark):
    rng = random.Random(2)
    new = lambda n: [rng.choice("abcdefghij") + str(rng.randrange(50)) for _ in range(n)]
    passages = [new(n) for n in (49, 50, 51, 60, 120, 400)]
    rows = [(i, " ".join(sum((rng.choice(passages)[rng.choice([0, 0, 3]) :] if rng.random() < 0.6 else new(rng.randint(0, 60)) for _ in range(5)), []))) for i in rng.sample(range(500), 60)]
    again = new(90)
    rows += [(600, " ".join(new(9) + again)), (601, " ".join(again + new(70) + again)), (602, " ".join(again[5:] + again[:70] + again)), (603, " ".join(again[20:75]))]
    rows += [(900, "x " * 200), (901, "x " * 130), (902, None), (903, ""), (904, " ".join(new(30000))), (905, "é\x85 " * 60)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, print int")
    got = {r.id: (r.n_words, r.n_removed, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in remove_repeats(df).collect()}
    check(rows, got)


def test_edges(spark):
    text = " ".join(map(str, range(80)))
    rows = [(None, text), (3, text), (3, text), (2, text), (3, text + " x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.id), r.n_words, r.n_removed) for r in remove_repeats(docs).collect())
    assert got == [("2", 80, 0), ("3", 80, 80), ("3", 80, 80), ("3", 81, 80), ("None", 80, 0)]
    assert remove_repeats(docs.limit(0)).count() == 0


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(rows, {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op6_substring_dedup(spark, sf_dir).collect()})


def test_pipeline_stages_against_plain_versions(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, kept[-1], sf_dir).write.parquet(f"{tmp_path}/{name}")
        kept.append(spark.read.parquet(f"{tmp_path}/{name}"))
    assert all(k.columns == docs.columns for k in kept[:-1])
    rows = [[(r.doc_id, r.text) for r in k.collect()] for k in kept[:-1]]
    assert 0 < len(rows[1]) < len(rows[0])
    flags = brute.kept_lines(rows[1])
    lines = {i: "\n".join(x for x, on in zip(t.split("\n"), flags[k]) if on) for k, (i, t) in enumerate(rows[1])}
    assert dict(rows[2]) == {i: t for i, t in lines.items() if brute.words(t)}
    groups = brute.similar_classes(rows[2])
    assert sorted(i for i, _ in rows[3]) == sorted(i for i, c in groups if i == c)
    texts = dict(rows[3])
    assert all(texts[i] == t for i, t in rows[4]) and max(sum(i == j for j, _ in rows[4]) for i in {i for i, _ in rows[4]}) <= 3
    pieces = kept[-1].collect()
    assert sorted(r.doc_id for r in pieces if r.piece == 0) == sorted(i for i, _ in rows[4])


ODD = "doc_id long, text string, lang string, source string, n_chars long, id int, copies int, _gone string, score string, _w int, _nth int, print long, n_lines string, n_removed string, _i int, _t int, _p int, `x.y` int"


def odd_rows():
    line = " ".join(f"w{k}" for k in range(40))
    texts = [(1, line), (1, line), (1, "other " + line), (None, "null one " * 30), (None, "null two " * 30), (2, None), (3, ""), (4, " \n"), (5, "x " * 40000), (6, line + " end"), (7, "short\nshort\nlast"), (8, "short")]
    return [(i, t, "en", "ab"[k % 2] if k % 3 else None, 7, 1, 2, "g", "s", 3, 4, 5, "l", "r", 6, 7, 8, 9) for k, (i, t) in enumerate(texts)]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, sf_dir, name):
    stage, docs = dict(corpus_pipeline.STAGES)[name], spark.createDataFrame(odd_rows(), ODD)
    got = stage(spark, docs, sf_dir)
    assert stage(spark, docs.limit(0), sf_dir).count() == 0
    rows = got.collect()
    if name == "packing":
        assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter(r[0] for r in odd_rows())
        return
    assert got.columns == docs.columns and {tuple(r)[5:] for r in rows} == {(1, 2, "g", "s", 3, 4, 5, "l", "r", 6, 7, 8, 9)}
    found = sorted((str(r.doc_id), str(r.text)) for r in rows)
    own = sorted((str(i), str(t)) for i, t, *_ in odd_rows())
    if name == "toxicity":
        assert found == own
    elif name == "line_dedup":
        assert {t for i, t in found if i == "1"} in ({own[0][1]}, {own[2][1]}) and ("7", "short\nlast") in found and ("2", "None") in found and ("3", "") in found  # documents whose lines all went are gone
        assert not {"6", "8"} & {i for i, _ in found}
    elif name == "near_dedup":
        plain = brute.similar_classes([(k, t) for k, (_, t, *_) in enumerate(odd_rows())])
        assert len(found) == len({c for _, c in plain}) and Counter(i for i, _ in found)["None"] == 2
    else:
        assert set(found) <= set(own) and max(Counter(r.doc_id for r in rows if r.doc_id and r.doc_id > 1).values()) <= 3
