"""Repair of conversations: the cheapest edits that make roles alternate and take faulty turns out, by a dynamic program over runs of equal symbols.

A symbol is a turn's kind of role and what its fault forces. The program's states say which role comes next, and a turn is a min-plus transition between states, so that a run of equal turns is a power of
one transition, made of cached binary powers. Turns are range-partitioned by conversation and order: a conversation of any length lies in as many parts as it needs, each part is one transition, and what crosses its
bounds is a vector of four costs and, for the choices, one of four states.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm._common import SPACES, join_counted, materialize

#: Costs of edits; a turn that is truncated and stays costs `STAYS` more.
DELETE, RETITLE, INSERT, STAYS = 3, 2, 2, 1
#: States: nothing yet, after the system's turn, after a user's, after an assistant's; the first and the last may end.
START, TOLD, ASKED, ANSWERED = range(4)
STATES, FAR = 4, 1 << 50
#: Where a role's initial leads from a state. Users' turns can be made everywhere but after one, assistants' only there.
LEADS = {(START, "s"): TOLD, (START, "u"): ASKED, (TOLD, "u"): ASKED, (ASKED, "a"): ANSWERED, (ANSWERED, "u"): ASKED}
MADE = {START: ASKED, TOLD: ASKED, ASKED: ANSWERED, ANSWERED: ASKED}
NAMES = {ASKED: "user", ANSWERED: "assistant"}
KINDS = "sua?"
#: Of a symbol ``3 * kind + forced``: the turn is sound, is truncated, or must go.
SOUND, CUT, GOES = range(3)
#: Costs to an end that is allowed, by inserts alone.
END = (0, 2 * INSERT, INSERT, 0)
Matrix = tuple[tuple[int, ...], ...]


def _times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(a[i][k] + b[k][j] for k in range(STATES)) for j in range(STATES)) for i in range(STATES))


def _before(m: Matrix, v: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(min(m[i][k] + v[k] for k in range(STATES)) for i in range(STATES))


@cache
def _moves(symbol: int, state: int) -> tuple[tuple[str, int, int], ...]:
    """Edits of a turn in a state, in the order of their letters: letter, cost, next state."""
    kind, forced = KINDS[symbol // 3], symbol % 3
    moves = [("D", DELETE, state)]
    if forced != GOES:
        extra = STAYS if forced == CUT else 0
        if (state, kind) in LEADS:
            moves.append(("K", extra, LEADS[state, kind]))
        moves.append(("R", RETITLE + extra, MADE[state]))
    return tuple(moves)


@cache
def transition(symbol: int) -> Matrix:
    """Least costs from state to state over one turn, inserts before it included: more than two of them lead back."""
    rows = []
    for start in range(STATES):
        row, state, paid = [FAR] * STATES, start, 0
        for _ in range(3):
            for _, cost, after in _moves(symbol, state):
                row[after] = min(row[after], paid + cost)
            state, paid = MADE[state], paid + INSERT
        rows.append(tuple(row))
    return tuple(rows)


@cache
def _doubled(symbol: int, k: int) -> Matrix:
    """The transition of 2 ** k turns."""
    if not k:
        return transition(symbol)
    half = _doubled(symbol, k - 1)
    return _times(half, half)


NOTHING: Matrix = tuple(tuple(0 if i == j else FAR for j in range(STATES)) for i in range(STATES))


def run_matrix(symbol: int, n: int) -> Matrix:
    """The transition of ``n`` equal turns."""
    out = NOTHING
    for k in range(n.bit_length()):
        if n >> k & 1:
            out = _times(out, _doubled(symbol, k))
    return out


@lru_cache(1 << 16)
def _grown(whole: Matrix, symbol: int, n: int) -> tuple[Matrix, int]:
    """A transition, of which the least cost was taken off, and then a run of equal turns: again less its least cost, and this. Short conversations meet few different ones."""
    m = _times(whole, run_matrix(symbol, n))
    least = min(map(min, m))
    return tuple(tuple(x - least if x < FAR // 2 else FAR for x in row) for row in m), least


@lru_cache(1 << 16)
def _before_run(symbol: int, n: int, ahead: tuple[int, ...]) -> tuple[int, ...]:
    """Costs before a run by those after it, less the least of them."""
    v = _before(run_matrix(symbol, n), ahead)
    return tuple(x - min(v) for x in v)


@cache
def _back(symbol: int, ahead: tuple[int, ...]) -> tuple[int, ...]:
    """Costs before a turn by those after it, less the least of them: only differences tell choices apart, and there are few of them."""
    v = _before(transition(symbol), ahead)
    return tuple(x - min(v) for x in v)


@cache
def _choice(symbol: int, ahead: tuple[int, ...], state: int) -> tuple[str, int]:
    """The least letters among the cheapest edits up to and with a turn, and the state after it."""
    v, letters = _before(transition(symbol), ahead), ""
    while True:
        for letter, cost, after in sorted([*_moves(symbol, state), ("I", INSERT, -1)]):
            if letter == "I" and v[MADE[state]] + cost == v[state]:
                letters, state = letters + "I", MADE[state]
                break
            if letter != "I" and ahead[after] + cost == v[state]:
                return letters + letter, after


def unroll(runs: list[tuple[int, int]], ahead: tuple[int, ...], states: list[int]) -> list[tuple[str, int]]:
    """The edits of a part's runs, and the state they lead to, for each state before it, by the costs after it."""
    at = [tuple(x - min(ahead) for x in ahead)]
    for symbol, n in reversed(runs):
        at.append(_before_run(symbol, n, at[-1]))
    at.reverse()
    parts: list[list[str]] = [[] for _ in states]
    states = list(states)
    for r, (symbol, n) in enumerate(runs):
        inside = [at[r + 1]]  # costs after each turn of the run, from its last
        for _ in range(n - 1):
            inside.append(_back(symbol, inside[-1]))
        for k in range(len(states)):
            for v in reversed(inside):
                letters, states[k] = _choice(symbol, v, states[k])
                parts[k].append(letters)
    return [("".join(p), s) for p, s in zip(parts, states, strict=True)]


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    out = pa.RecordBatch.from_pylist(rows, schema=schema)
    rows.clear()
    return out


_PART = pa.schema([("c", pa.string()), ("part", pa.int32()), ("symbols", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int64())), ("matrix", pa.list_(pa.int64())), ("illegal", pa.int64())])


def _illegal(a: int, b: int) -> bool:
    return KINDS[a // 3] + KINDS[b // 3] not in ("su", "ua", "au")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation of a partition of ordered turns: its runs, their transition, and how many neighbours don't fit."""
    part, rows, own = TaskContext.get().partitionId(), [], None

    def close() -> None:
        c, runs, illegal = own
        whole, cost = NOTHING, 0
        for symbol, n in runs:
            whole, more = _grown(whole, symbol, n)
            cost += more
        rows.append({"c": c, "part": part, "symbols": [s for s, _ in runs], "lengths": [n for _, n in runs], "matrix": [x + cost if x < FAR else x for row in whole for x in row], "illegal": illegal})

    for batch in batches:
        for c, symbol, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if own and own[0] != c:
                close()
                own = None
            own = own or [c, [], 0]
            for s, m in ((symbol, 1), (3 * (symbol // 3) + GOES, n - 1)):  # copies of a turn must go
                if m:
                    runs = own[1]
                    own[2] += m if runs and _illegal(runs[-1][0], s) else m - 1
                    if runs and runs[-1][0] == s:
                        runs[-1] = s, runs[-1][1] + m
                    else:
                        runs.append((s, m))
            if len(rows) >= 2000:
                yield _batch(rows, _PART)
    if own:
        close()
    if rows:
        yield _batch(rows, _PART)


_ENDS = pa.schema([("c", pa.string()), ("part", pa.int32()), ("ahead", pa.list_(pa.int64())), ("cost", pa.int64()), ("leads", pa.bool_())])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The costs after each part, of parts from last to first; the cost of all that follows; whether a part is its conversation's first."""
    rows, last, v = [], None, END
    for batch in batches:
        for c, part, flat in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if last == c:
                rows[-1]["leads"] = False
            else:
                last, v = c, END
            if len(rows) >= 2000:
                yield _batch(rows, _ENDS)
            ahead, v = v, _before(tuple(tuple(flat[STATES * i : STATES * i + STATES]) for i in range(STATES)), v)
            rows.append({"c": c, "part": part, "ahead": list(ahead), "cost": v[START], "leads": True})
    if rows:
        yield _batch(rows, _ENDS)


_TOLD = pa.schema([("c", pa.string()), ("part", pa.int32()), ("audits", pa.list_(pa.string())), ("exits", pa.list_(pa.int32())), ("illegal", pa.int64()), ("cost", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of each part for each state in which it may begin: the first part begins in one."""
    rows = []
    for batch in batches:
        for c, part, symbols, lengths, ahead, illegal, cost, leads in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
            found = unroll(list(zip(symbols, lengths, strict=True)), tuple(ahead), [START] if leads else list(range(STATES)))
            rows.append({"c": c, "part": part, "audits": [a for a, _ in found], "exits": [s for _, s in found], "illegal": illegal, "cost": cost, "first": symbols[0], "last": symbols[-1]})
            if len(rows) >= 500:
                yield _batch(rows, _TOLD)
    if rows:
        yield _batch(rows, _TOLD)


_PICKED = pa.schema([("c", pa.string()), ("part", pa.int32()), ("audit", pa.string()), ("illegal", pa.int64()), ("cost", pa.int64())])


def _picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of each part for the state in which it does begin, of parts in order, with the inserts at the end. The cost is at a conversation's first part."""
    rows, state, last = [], START, None

    def end() -> None:
        rows[-1]["audit"] += "I" * (END[state] // INSERT)

    for batch in batches:
        for c, part, audits, exits, illegal, cost, first, final in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
            same = bool(rows) and rows[-1]["c"] == c
            if not same:
                if rows:
                    end()
                state = START
                if len(rows) >= 2000:
                    yield _batch(rows, _PICKED)
            elif len(rows) > 1:  # the row before is kept, the rest can go
                kept = rows.pop()
                yield _batch(rows, _PICKED)
                rows.append(kept)
            rows.append({"c": c, "part": part, "audit": audits[state if len(audits) > 1 else 0], "illegal": illegal + (same and _illegal(last, first)), "cost": 0 if same else cost})
            state, last = exits[state if len(exits) > 1 else 0], final
    if rows:
        end()
        yield _batch(rows, _PICKED)


def _slim(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Turns with a key of the conversation that is never null, and a digest of the text."""
    name = lambda c: F.col(f"`{c}`")
    key = F.when(name(conv).isNull(), "n").otherwise(F.concat(F.lit("v"), name(conv).cast("string")))
    own = rows.select(key.alias("c"), name(turn).alias("turn"), F.coalesce(name(role).cast("string"), F.lit(" ")).alias("role"), F.coalesce(name(text).cast("string"), F.lit(" ")).alias("text"))
    return own.withColumn("h", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))


def _ordered() -> list[Column]:
    return [F.asc("c"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("h")]


def judged(slim: DataFrame) -> DataFrame:
    """Each different turn of a conversation once: how many ``copies`` it has, whether it is ``blank``, ``again`` (role and text were seen on an earlier turn) or ``cut``, and its ``symbol``."""
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    each = slim.select("c", "turn", "role", "h", (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"))
    each = materialize(each.groupBy("c", "turn", "role", "h").agg(F.count("*").alias("copies"), F.min("blank").alias("blank"), F.min("cut").alias("cut")), "turns")
    at = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").alias("turn"))
    common = each.groupBy("c", "role", "h").agg(F.min(at).alias("first"), F.count("*").alias("rows")).where("rows > 1")
    seen = join_counted(each, materialize(common, "said"), ["c", "role", "h"], "rows", how="left", salt=F.xxhash64("turn"))
    again = F.col("first").isNotNull() & ~at.eqNullSafe(F.col("first"))
    kind = F.when(F.substring("role", 1, 1) == "s", 0).when(F.substring("role", 1, 1) == "u", 1).when(F.substring("role", 1, 1) == "a", 2).otherwise(3)
    forced = F.when(F.col("blank") | F.col("again"), GOES).when(F.col("cut"), CUT).otherwise(SOUND)
    return seen.withColumn("again", again).select("c", "turn", "role", "h", "copies", "blank", "again", "cut", (3 * kind + forced).cast("int").alias("symbol"))


def audited(turns: DataFrame) -> DataFrame:
    """The edits of each conversation in parts: ``c, part, audit``, the neighbours that don't fit, and at the first part the cost."""
    ordered = turns.repartitionByRange(*_ordered()).sortWithinPartitions(*_ordered()).select("c", "symbol", "copies")
    parts = materialize(ordered.mapInArrow(_parts, "c string, part int, symbols array<int>, lengths array<long>, matrix array<long>, illegal long"), "parts")
    back = parts.select("c", "part", "matrix").repartition("c").sortWithinPartitions("c", F.desc("part"))
    ends = back.mapInArrow(_ends, "c string, part int, ahead array<long>, cost long, leads boolean")
    each = parts.join(ends, ["c", "part"]).select("c", "part", "symbols", "lengths", "ahead", "illegal", "cost", "leads")
    told = each.mapInArrow(_told, "c string, part int, audits array<string>, exits array<int>, illegal long, cost long, first int, last int")
    return told.repartition("c").sortWithinPartitions("c", "part").mapInArrow(_picked, "c string, part int, audit string, illegal long, cost long")


_DIGEST = pa.schema([("c", pa.string()), ("audit", pa.string()), ("illegal", pa.int64()), ("cost", pa.int64()), ("sha", pa.string())])
_ROWS = pa.schema([("c", pa.string()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Conversations' audits and then their turns: yields ``("new", c)``, ``("audit", audit, illegal, cost)`` and, for each edit, ``(letter, role, text)``. Texts pass one by one."""
    c, audit, at, state = None, [], 0, START

    def made() -> Iterator[tuple]:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            state, at = MADE[state], at + 1
            yield "I", NAMES[state], b""

    for batch in batches:
        for key, part, told, illegal, cost, role, text in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
            if key != c:
                yield from made()
                c, audit, at, state = key, "", 0, START
                yield "new", c
            if part is not None:
                audit += told
                yield "audit", told, illegal, cost
                continue
            yield from made()
            letter, at = audit[at], at + 1
            if letter == "R":
                state = MADE[state]
                role = NAMES[state]
            elif letter == "K":
                state = LEADS[state, role[:1]]
            yield letter, role, text
    yield from made()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, own = [], None

    def close() -> None:
        rows.append({"c": own["c"], "audit": "".join(own["audit"]), "illegal": own["illegal"], "cost": own["cost"], "sha": own["sha"].hexdigest()})

    for step, *more in _steps(batches):
        if step == "new":
            if own:
                close()
            own = {"c": more[0], "audit": [], "illegal": 0, "cost": 0, "sha": hashlib.sha256(), "some": False}
            if len(rows) >= 2000:
                yield _batch(rows, _DIGEST)
        elif step == "audit":
            own["audit"].append(more[0])
            own["illegal"] += more[1]
            own["cost"] += more[2]
        elif step != "D":
            own["sha"].update(b"\n" * own["some"] + more[0].encode() + b":" + more[1])
            own["some"] = True
    if own:
        close()
    if rows:
        yield _batch(rows, _DIGEST)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, c, place, size = [], None, 0, 0
    for step, *more in _steps(batches):
        if step == "new":
            c, place = more[0], 0
        elif step not in ("audit", "D"):
            rows.append({"c": c, "place": place, "role": more[0], "text": more[1].decode(), "edit": step})
            place, size = place + 1, size + len(more[1])
            if len(rows) >= 2000 or size > 4 << 20:
                yield _batch(rows, _ROWS)
                size = 0
    if rows:
        yield _batch(rows, _ROWS)


def _replayed(slim: DataFrame, edits: DataFrame) -> DataFrame:
    """Each conversation's audit and then its turns, in order, for a task to run through."""
    none = lambda kind: F.lit(None).cast(kind)
    turns = slim.select("c", none("int").alias("part"), none("string").alias("audit"), none("long").alias("illegal"), none("long").alias("cost"), "role", F.col("text").cast("binary").alias("text"), "turn", "h")
    told = edits.select("c", "part", "audit", "illegal", "cost", none("string").alias("role"), none("binary").alias("text"), none(slim.schema["turn"].dataType).alias("turn"), none("binary").alias("h"))
    order = ["c", F.asc_nulls_last("part"), F.asc_nulls_first("turn"), "role", "h"]
    return turns.unionByName(told).repartition("c").sortWithinPartitions(*order).select("c", "part", "audit", "illegal", "cost", "role", "text")


def _id(kind) -> Column:
    return F.when(F.col("c") != "n", F.substring("c", 2, 1 << 30)).cast(kind)


def repaired_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The turns of repaired conversations, ``conv_id, place, role, text``, and the ``edit`` that kept (K), renamed (R) or made (I) each. Rows are treated as `repair` says."""
    slim = _slim(rows, conv, turn, role, text)
    found = _replayed(slim, audited(materialize(judged(slim), "judged"))).mapInArrow(_repaired, "c string, place long, role string, text string, edit string")
    return found.select(_id(rows.select(F.col(f"`{conv}`").alias("conv")).schema["conv"].dataType).alias("conv_id"), "place", "role", "text", "edit")


def repair(rows: DataFrame, conversations: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """What is wrong with each conversation and how it is repaired: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    Turns come by number, null first, of equal numbers by role and then by a digest of the text; rows that repeat all of these are copies, of which the first is no duplicate on their account. A null role or text is one
    space, and null ids are one conversation. Texts without anything but white space are blank, and are so first of all. A role goes by its first letter. Numbers that miss between the least and the largest are gaps, 2^63 - 1 at most.
    Every id of ``conversations``, a column named as ``conv``, has a row: zeros and the digest of nothing where it has no turns. An empty table gives no other rows. Other columns aren't in the result, whatever their names.

    A conversation's digest is made of all its texts in order, which one task reads one by one; its audit is one value in that task's memory. All else is dealt out in parts of conversations.
    """
    slim = _slim(rows, conv, turn, role, text)
    turns = materialize(judged(slim), "judged")
    n = lambda test, of: F.sum(F.when(test, of).otherwise(0))
    blank, again, copies = F.col("blank"), F.col("again"), F.col("copies")
    per = turns.groupBy("c", "turn").agg(
        n(blank, copies).alias("blank"), n(~blank, F.when(again, copies).otherwise(copies - 1)).alias("duplicate"), n(~blank & ~again & F.col("cut"), 1).alias("truncated")
    )
    wide = lambda c: c.cast("decimal(20,0)")
    missing, most = wide(F.max("turn")) - wide(F.min("turn")) + 1 - F.count("turn"), F.lit((1 << 63) - 1)
    counts = per.groupBy("c").agg(F.when(missing > most, most).otherwise(missing).alias("gaps"), *(F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated")))
    found = _replayed(slim, audited(turns)).mapInArrow(_digests, "c string, audit string, illegal long, cost long, sha string")
    ids = _slim(conversations.select(F.col(f"`{conv}`").alias("conv_id"), *(F.lit(None).cast("int").alias(x) for x in "trx")), "conv_id", "t", "r", "x").select("c").distinct() if conversations is not None else counts.select("c")
    whole = ids.join(counts, "c", "left").join(found, "c", "left")
    number = lambda c: F.coalesce(F.col(c).try_cast("long"), F.lit(0).cast("long")).alias(c)
    kind = rows.select(F.col(f"`{conv}`").alias("conv")).schema["conv"].dataType
    return whole.select(_id(kind).alias("conv_id"), *map(number, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
