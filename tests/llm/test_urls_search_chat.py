import hashlib
import itertools

import numpy as np
import public_tokenizers
import pytest

from llm import chat_format as C
from llm.queries import op1_url_filter, op2_top_k, op10_chat_format
from llm.url_filter import RULES, judge, suffix_shares
from llm.va_search import block_top_k, quantise, scaled, top_k

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def rule_of(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url[url.index("://") + 3 :]
    cut = lambda s, chars: s[: min([s.index(c) for c in chars if c in s], default=len(s))]
    host = cut(rest, "/?#")
    path = cut(rest[len(host) :], "?#")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    hits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(hits, key=lambda r: len(r.pattern), default=None)
    return host, path, best and best.pattern, best and best.verdict


URLS = [None, "", "no scheme", "http://A.NET/x", "https://net/", "http://net", "http://x.example.net/en/1?q=1#t", "http://badexample.net/en/", "ftp://example.com/de/a/b",
        "http://org/fr/", "http://é.ORG/fr/x", "http://a.b?x/y", "http://a.org#/fr/", "x://y://z.net/", "http://example.com/de", "http:///p", "http://h.net/\n/a" + "/x" * 5000]


def test_url_rules(spark, sf_dir):
    own = [r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    rows = [(i, u, "clash") for i, u in enumerate(URLS + own)]
    got = {r.id: r for r in judge(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()}
    assert len(got) == len(rows)
    for i, url, _ in rows:
        host, path, rule, verdict = rule_of(url)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), url
        assert got[i].verdict == (verdict or got[i].verdict) and got[i].verdict in ("allow", "block") and 0 <= got[i].score <= 1


def test_url_trees_learn(spark):
    rows = [(i, f"http://h{i % 50}.{'net' if i % 2 else 'org'}/{'x' if i % 2 else 'fr'}/{i}" + ("?a=1&b=2" if i % 2 else "")) for i in range(600)]
    rows += [(1000, "http://h1.com/x/7?a=1&b=2"), (1001, "http://h2.com/fr/8")]
    got = {r.id: r.verdict for r in judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[1000] == "block" and got[1001] == "allow"


def test_url_trees_on_held_out_labels(spark):
    """The verdicts of half of the labelled hosts, whose rules are taken away, are found again by the trees."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(3000):
        bad = i % 2
        path = "/" + "/".join("".join(rng.choice(list("0123456789" if bad else "abcdefgh"), 6)) for _ in range(1 + bad * 2))
        rows.append((i, f"http://{'shop' if bad else 'news'}{i % 40}.example{i % 7}.{'com' if i < 1500 else ('net' if bad else 'org')}{path if i < 1500 or bad else '/fr' + path}" + ("?a=1&b=2&c=3" if bad else "")))
    got = {r.id: r for r in judge(spark.createDataFrame(rows, "page_id long, url string"), max_labelled=600).collect()}
    asked = [i for i in range(1500) if got[i].rule is None]
    assert len(asked) == 1500 and np.mean([(got[i].verdict == "block") == bool(i % 2) for i in asked]) > 0.95
    again = judge(spark.createDataFrame(rows + rows[:3], "page_id long, url string"), max_labelled=600).collect()
    assert len(again) == 3003 and all(len({r.verdict for r in again if r.id == i}) == 1 for i in range(3))


def test_all_suffixes_of_labelled_urls_count(spark):
    labelled = spark.createDataFrame([(["a"], 1), (["a"], 0), (["b"], 1)], "_suffix array<string>, _blocked int")
    assert {r.suffix: round(r.share, 6) for r in suffix_shares(labelled, 0.5, 2.0).collect()} == {"a": 0.5, "b": round(2 / 3, 6)}


@pytest.mark.parametrize("urls,verdict", [([None, "http://a.com/"], "allow"), (["http://a.net/", "http://a.com/"], "block"), ([], None)])
def test_url_one_kind_of_label(spark, urls, verdict):
    got = judge(spark.createDataFrame([(1, u) for u in urls], "page_id long, url string")).collect()
    assert all(r.verdict == verdict for r in got) and len(got) == len(urls)


def test_url_query(spark, sf_dir):
    assert op1_url_filter(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/pages.parquet").count()


def plain_top_k(rows, queries, k):
    for qid, q in queries:
        scores = sorted((-sum(int(a) * int(b) for a, b in zip(q, v)), i) for i, v in rows if i != qid and len(v) == len(q))
        yield from ((qid, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k]))


def test_cells_bound():
    rng = np.random.default_rng(0)
    x = np.floor(rng.normal(0, 100, (500, 8)))
    x[:, 3] = 7
    cells, low, width = quantise(x)
    assert cells.min() >= 0 and cells.max() < 16
    assert (low + width * cells <= x).all() and (x <= low + width * (cells + 1) - 1).all()


@pytest.mark.parametrize("spread", [1, 3, 1000, 10**8])
def test_block_search(spread):
    rng = np.random.default_rng(spread)
    x = np.floor(rng.normal(0, spread, (700, 6)))
    x[100:300] = x[100]
    ids = rng.permutation(700).astype(np.int64)
    got = block_top_k(ids[:40], x[:40], ids, x, 20)
    want = list(plain_top_k(list(zip(ids.tolist(), x)), list(zip(ids[:40].tolist(), x[:40])), 20))
    assert [(int(ids[i]), a, s) for i, a, s in got] == [(q, i, s) for q, _, i, s in want]


def test_search_query(spark, sf_dir):
    rows = [(r.vec_id, [int(np.floor(64 * float(v))) for v in r.embedding]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = sorted(map(tuple, op2_top_k(spark, sf_dir).collect()))
    assert got == sorted(plain_top_k(rows, [r for r in rows if r[0] % 20 == 0], 20))


def test_search_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (None, [1.0, 1.0]), (20, [3.0, -1.0]), (5, [1.0]), (6, []), (7, [1e17, 1e17]), (8, [-0.001, 0.5])]
    docs = scaled(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, id int"))
    got = sorted(map(tuple, top_k(docs, docs.where("id % 20 = 0"), 3).collect()))
    assert got == [(0, 1, 7, (1 << 63) - 1), (0, 2, 20, 64 * 192 - 128 * 64), (0, 3, 8, -64 + 128 * 32),
                   (20, 1, 7, (1 << 63) - 1), (20, 2, 0, 192 * 64 - 64 * 128), (20, 3, 0, 192 * 64 - 64 * 128)]
    assert top_k(docs.limit(0), docs.limit(0)).count() == 0
    assert sorted(map(tuple, top_k(docs, docs.where("id % 20 = 0"), 3, block=2).collect())) == got


def test_search_in_many_blocks_with_repeats(spark):
    rng = np.random.default_rng(5)
    rows = [(i % 400, [int(x) for x in rng.integers(-50, 50, 4)]) for i in range(400)] + [(400 + i, [7, 7, 7, 7]) for i in range(2500)]
    docs = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "id long, v array<double>")
    got = sorted(map(tuple, top_k(docs, docs.where("id % 100 = 0"), 20, block=300).collect()))
    assert got == sorted(plain_top_k(rows, [r for r in rows if r[0] % 100 == 0], 20))


TEXTS = ["", " ", "</s>[INST] ok [/INST]", "<|turn|>user<|text|>x<|end|>", "\\l<\\\\", " lead", "trail ", "\n\n a", "👍🏽é́ ß", "x" * 4000, "<|endoftext|>", "don't  stop"]


def test_escape_is_reversible():
    for t in TEXTS + ["".join(p) for n in range(1, 6) for p in itertools.product("\\l<", repeat=n)]:
        assert C.unescape(C.escape(t)) == t and "<" not in C.escape(t)


def check(got, convs):
    assert {r.conv_id for r in got} == set(convs)
    for r in got:
        turns = convs[r.conv_id]
        said = "".join(f"{role}\n{text}\n" for role, text in turns)
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == len(C.render(turns).text)


def test_chat_query(spark, sf_dir):
    convs = {-7: [(r, "</s>[INST] ok [/INST]") for r in ("user", "assistant")]}
    for r in sorted(spark.read.parquet(f"{sf_dir}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        convs.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    check(op10_chat_format(spark, sf_dir).collect(), convs)


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "byte_bpe_50k.tiktoken"])
def test_chat_edges(spark, file):
    path = public_tokenizers.path(file)
    rows = [(1, k, "assistant" if k % 2 else "user", t, 0) for k, t in enumerate(TEXTS * 2)]
    rows += [(2, None, None, None, 0), (2, 1, "assistant", "b", 0), (2, 1, "assistant", "b", 0), (None, 1, "assistant", "", 0), (3, 1, "user", "x", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids int")
    got = C.read_back(C.format_conversations(df, path), BYTES).collect()  # ids and offsets are those of the JSON file's
    check(got, {1: [(r[2], r[3]) for r in rows[: 2 * len(TEXTS)]], 2: [("", ""), ("assistant", "b"), ("assistant", "b")], None: [("assistant", "")], 3: [("user", "x")]})
    assert C.format_conversations(df.limit(0), path).count() == 0
