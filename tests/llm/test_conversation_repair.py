"""Conversation repair against a search over all edits, over states and over rows."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from llm import conversation_repair as R
from llm import queries as Q

WHITE = " \t\n\x0b\f\r"


def cheapest(turns):
    """Least cost and letters over (initial, forced) turns by searching strings of roles: no transitions, no runs. ``forced``: 0 sound, 1 truncated, 2 must go."""
    ok = re.compile(r"s?(ua)*u?").fullmatch
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, letters, at, roles = heapq.heappop(heap)
        if at == len(turns) and re.fullmatch(r"(s?(ua)+)?", roles):
            return cost, letters
        tail = (at, roles[-1:] or "", "s" in roles, len(roles) > 0)
        if (tail, letters) in done or any((cost, letters) > best for best in [BEST.setdefault((id(turns), tail), (cost, letters))]):
            continue
        done.add((tail, letters))
        for more, paid, step, role in [("I", 2, 0, "u"), ("I", 2, 0, "a")] + ([("D", 3, 1, "")] + ([("K", turns[at][1], 1, turns[at][0]), ("R", 2 + turns[at][1], 1, "u"), ("R", 2 + turns[at][1], 1, "a")] if turns[at][1] < 2 else []) if at < len(turns) else []):
            if ok(roles + role):
                heapq.heappush(heap, (cost + paid, letters + more, at + step, roles + role))


BEST: dict = {}


def plain(rows, ids):
    """The contract, row by row, of damaged (conv, turn, role, text) rows without nulls in role and text."""
    out = []
    for c in ids:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()[:16]))
        numbers = {r[1] for r in own if r[1] is not None}
        faults, seen = [], set()
        for _, _, role, text in own:
            bare = text.strip(WHITE)
            faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        firsts = [r[2][:1] for r in own]
        turns = tuple((f if f in "sua" and f else "?", {"": 0, "t": 1}.get(x, 2)) for f, x in zip(firsts, faults))
        BEST.clear()
        cost, letters = cheapest(turns)
        roles, at, repaired = "", 0, []
        nxt = lambda: "a" if roles[-1:] == "u" else "u"
        full = {"u": "user", "a": "assistant"}
        for x in letters:
            if x == "I":
                roles += nxt()
                repaired.append(f"{full[roles[-1]]}:")
                continue
            if x != "D":
                roles += firsts[at] if x == "K" else nxt()
                repaired.append(f"{own[at][2] if x == 'K' else full[roles[-1]]}:{own[at][3]}")
            at += 1
        bad = sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:]))
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        out.append((c, gaps, faults.count("b"), faults.count("d"), faults.count("t"), bad, cost, letters, hashlib.sha256("\n".join(repaired).encode()).hexdigest()))
    return sorted(out, key=str)


def damaged(rows):
    out = []
    for c, turn, role, text in rows:
        some = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{some(c)}:{some(turn)}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", some(text)) if kind == 2 else some(text)
        out += [(c, turn, "user" if kind == 4 else some(role), text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_unrolled_runs_are_the_cheapest_and_least_edits(seed):
    rng = random.Random(seed)
    for _ in range(150):
        turns = tuple(rng.choice([("s", 0), ("u", 0), ("a", 0), ("?", 0), ("u", 1), ("a", 1), ("s", 2), ("u", 2), ("?", 1)][: rng.choice([3, 6, 9])]) for _ in range(rng.randrange(6)))
        runs = []
        for initial, forced in turns:
            s = 3 * R.KINDS.index(initial) + forced
            runs = [*runs[:-1], (s, runs[-1][1] + 1)] if runs and runs[-1][0] == s else [*runs, (s, 1)]
        BEST.clear()
        cost, letters = cheapest(turns)
        whole = R.NOTHING
        for s, n in runs:
            whole = R._times(whole, R.run_matrix(s, n))
        assert R._before(whole, R.END)[R.START] == cost
        (audit, state), = R.unroll(runs, R.END, [R.START])
        assert audit + "I" * (R.END[state] // R.INSERT) == letters, turns


def test_powers_of_long_runs():
    for s in range(12):
        step = R.NOTHING
        for n in range(40):
            assert R.run_matrix(s, n) == step
            step = R._times(step, R.transition(s))
    assert R._before(R.run_matrix(4, 10**12), R.END)[R.START] == 10**12 * (R.STAYS + R.RETITLE // 2)


ODD = [
    (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, 0, "assistant", "x"), (2, 5, "user", "y!"), (2, 5, "user", "z!"), (2, None, "system", "s."), (3, 0, None, None), (3, 1, "", "a."), (4, None, "user", "q?"),
    (4, None, "user", "q?"), (None, 1, "user", "n."), (None, None, "user", "n."), (None, 2, "tool", "t.\x0b"), (5, 3, "user", "a."), (5, 4, "assistant", "a."), (5, 9, "user", "a."), (6, 0, "user", "w" * 50_000 + "."), (6, 1, "user", " \t\n"),
    (-(2**63), 2**63 - 1, "user", "u."), (-(2**63), -(2**63), "assistant", "a."), (7, 0, "s", "."), (7, 1, "u", "é?"), (7, 2, "a", "\U0001f600!"),
]


def test_odd_rows(spark):
    kinds = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame(ODD * 2, kinds).withColumns({"c": F.lit(1), "h": F.lit("x"), "part": F.lit(2), "x.y": F.lit(3)}).repartition(3)
    rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in ODD * 2]
    ids = [*dict.fromkeys(r[0] for r in rows), 99]
    want = [(c, min(g, 2**63 - 1), *rest) for c, g, *rest in plain(rows, ids)]
    assert got(R.repair(df, spark.createDataFrame([(i,) for i in ids], "conv_id long"))) == want
    assert R.repair(spark.createDataFrame([], kinds)).count() == 0 and R.repaired_turns(spark.createDataFrame([], kinds)).count() == 0
    turns = R.repaired_turns(df).where("conv_id = 7").orderBy("place").collect()
    assert [(r.role, r.text, r.edit) for r in turns] == [("s", ".", "K"), ("u", "é?", "K"), ("a", "\U0001f600!", "K")]


def test_a_conversation_in_many_parts(spark):
    rng = random.Random(5)
    rows = [(1, k, rng.choice(["user", "user", "assistant", "system"]) if k % 500 > 100 else "user", rng.choice(["same.", f"t{k}.", f"t{k}", ""])) for k in range(6000)] + [(c, k, rng.choice(["user", "assistant"]), f"{c} {k}.") for c in range(2, 200) for k in range(4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    few = got(R.repair(df))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        many = got(R.repair(df))
        slim = R._slim(df, "conv_id", "turn", "role", "text")
        assert R.audited(R.judged(slim)).where("c = 'v1'").count() > 5
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert few == many and {r[0] for r in many} == set(range(1, 200))
    own = [r for r in rows if r[0] == 1]
    seen, runs, bad = set(), [], 0
    for k, (_, _, role, text) in enumerate(own):
        forced = 2 if not text or (role, text) in seen else 0 if text[-1] == "." else 1
        seen.add((role, text))
        runs.append((3 * R.KINDS.index(role[0]) + forced, 1))
        bad += k > 0 and own[k - 1][2][0] + role[0] not in ("su", "ua", "au")
    (audit, state), = R.unroll(runs, R.END, [R.START])
    one = next(r for r in many if r[0] == 1)
    assert one[7] == audit + "I" * (R.END[state] // 2) and one[5] == bad


def test_query_agrees_with_rows(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(Q.op11_conversation_repair(spark, sf_dir)) == plain(damaged(rows), {r[0] for r in rows})


def test_query_on_nulls(spark, tmp_path):
    rows = [(c, t, r, x) for c in (*range(30), None) for t, r, x in [(None, "user", "a."), (1, None, "b"), (2, "assistant", None), (3, "user", "c d!"), (3, "user", "c d!"), (7, "assistant", "e?")]]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert got(Q.op11_conversation_repair(spark, str(tmp_path))) == plain(damaged(rows), {r[0] for r in rows})
