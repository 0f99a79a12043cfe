"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as one string. Control strings open and close turns; they are added tokens of the tokenizer, so that no token
crosses the border of a text, and the first character of each is escaped inside texts, so that a text never holds one. The string
is encoded once, with character offsets. Turn spans and token spans are both sorted, so that the tokens of a turn are found by binary
search; those of the chosen role carry the loss.
"""

from __future__ import annotations

import base64
import hashlib
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm._common import remembered

OPEN, SPLIT, CLOSE = "<|turn|>", "<|text|>", "<|end|>"
ESCAPES = (("\\", "\\\\"), ("<", "\\l"))


def escape(text: str) -> str:
    for plain, safe in ESCAPES:
        text = text.replace(plain, safe)
    return text


def unescape(text: str) -> str:
    return "\\".join(part.replace("\\l", "<") for part in text.split("\\\\"))


@dataclass
class Rendered:
    text: str
    #: Start and end of each turn's text.
    spans: list[tuple[int, int]] = field(default_factory=list)
    roles: list[str] = field(default_factory=list)


def render(turns: list[tuple[str, str]]) -> Rendered:
    parts, at, out = [], 0, Rendered("")
    for role, text in turns:
        head, body = f"{OPEN}{escape(role)}{SPLIT}", escape(text)
        start = at + len(head)
        out.spans.append((start, start + len(body)))
        out.roles.append(role)
        parts += [head, body, CLOSE]
        at = start + len(body) + len(CLOSE)
    out.text = "".join(parts)
    return out


def parse(text: str) -> list[tuple[str, str]]:
    """The turns again, from the rendered string alone."""
    turns = [t.removesuffix(CLOSE).partition(SPLIT) for t in text.split(OPEN)[1:]]
    return [(unescape(role), unescape(body)) for role, _, body in turns]


@cache
def _tokenizer(path: str):
    from tokenizers import AddedToken, Tokenizer

    t = Tokenizer.from_file(path)
    t.add_special_tokens([AddedToken(x, normalized=False, special=True) for x in (OPEN, SPLIT, CLOSE)])
    t.post_processor = None  # it would trim spaces from the offsets
    return t


#: How byte-level tokenizers cut a text into pieces that don't see each other.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
Tokens = tuple[np.ndarray, np.ndarray, np.ndarray]


class RankEncoder:
    """Ids and character offsets by a file of ranks, a byte string and its rank on each line. The control strings get the ids after the last, and one more for the end of texts, which stays free.

    Tokens are the text's bytes one after the other, so that their lengths give their places, and a token that holds a part of a character's bytes has the whole character's place.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        own = {x: max(ranks.values()) + 2 + k for k, x in enumerate((OPEN, SPLIT, CLOSE))}
        self.tokenizer = tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens=own)
        self.allowed = set(own)
        self.length = np.zeros(max(own.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.length[rank] = len(token)
        for token, rank in own.items():
            self.length[rank] = len(token)

    def encode(self, text: str) -> Tokens:
        ids = self.tokenizer.encode_to_numpy(text, allowed_special=self.allowed, disallowed_special=()).astype(np.int32)
        ends = np.cumsum(self.length[ids])
        starts = ends - self.length[ids]
        if len(ids) and ends[-1] > len(text):
            character = np.cumsum((np.frombuffer(text.encode(), dtype=np.uint8) & 0xC0) != 0x80) - 1
            starts, ends = character[starts], character[ends - 1] + 1
        return ids, starts.astype(np.int32), ends.astype(np.int32)


class FileEncoder:
    """The same by a tokenizer's file of JSON."""

    def __init__(self, path: str) -> None:
        self.tokenizer = _tokenizer(path)

    def encode(self, text: str) -> Tokens:
        encoded = self.tokenizer.encode(text, add_special_tokens=False)
        offsets = np.array(encoded.offsets, dtype=np.int32).reshape(-1, 2)
        return np.array(encoded.ids, dtype=np.int32), offsets[:, 0], offsets[:, 1]


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """True for each token that lies in one of the spans. Tokens and spans are sorted; bytes of one character share its offsets."""
    mask = np.zeros(len(starts), dtype=bool)
    for start, end in spans:
        mask[np.searchsorted(ends, start, side="right") : np.searchsorted(starts, end, side="left")] = True
    return mask


def stretches(starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> list[tuple[int, int]]:
    """Starts and ends of the text under the mask, joined where tokens touch."""
    a, b = starts[mask], ends[mask]
    if not len(a):
        return []
    upto = np.maximum.accumulate(b)
    first = np.concatenate([[True], a[1:] > upto[:-1]])
    return list(zip(a[first].tolist(), upto[np.append(np.flatnonzero(first)[1:] - 1, len(a) - 1)].tolist(), strict=True))


def format_conversations(rows: DataFrame, tokenizer: str, learn_from: str = "assistant", conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, formatted, ids, starts, ends, loss_mask``: one row for each conversation; ``starts`` and ``ends`` are the tokens' offsets in characters. ``tokenizer`` is a file of ranks, ``.tiktoken``, or of JSON.

    Turns go by ``turn``, nulls first; ties by role and text, so that repeated turns stay, side by side. Null roles and texts count as empty. Rows with a null
    id make up one conversation. A conversation is one training example and has to fit a task; Spark spreads conversations. An empty table
    gives no rows. Other columns aren't in the result, whatever their names.
    """
    kind = rows.schema[conv_col].dataType.simpleString()
    clean = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in (role_col, text_col)]
    turns = rows.select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).cast("long").alias("turn"), *clean).alias("t"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")).select(
        "conv_id", F.transform("turns", lambda t: t[role_col]).alias("roles"), F.transform("turns", lambda t: t[text_col]).alias("texts")
    )

    def batches(it):
        encoder = remembered(("chat_format", tokenizer), lambda: (RankEncoder if tokenizer.endswith(".tiktoken") else FileEncoder)(tokenizer))
        for whole_batch in it:
            for at in range(0, whole_batch.num_rows, 64):
                batch = whole_batch.slice(at, 64)
                made = [render(list(zip(r, t, strict=True))) for r, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
                tokens = [encoder.encode(m.text) for m in made]
                masks = [loss_mask(starts, ends, [s for s, r in zip(m.spans, m.roles, strict=True) if r == learn_from]).tobytes() for m, (_, starts, ends) in zip(made, tokens, strict=True)]
                bounds = pa.array(np.concatenate([[0], np.cumsum([len(ids) for ids, _, _ in tokens])]), pa.int32())
                lists = [pa.ListArray.from_arrays(bounds, pa.array(np.concatenate([t[k] for t in tokens]), pa.int32())) for k in range(3)]
                yield pa.record_batch([batch.column(0), pa.array([m.text for m in made], pa.string()), *lists, pa.array(masks, pa.binary())], ["conv_id", "formatted", "ids", "starts", "ends", "loss_mask"])

    return whole.mapInArrow(batches, f"conv_id {kind}, formatted string, ids array<int>, starts array<int>, ends array<int>, loss_mask binary")


def read_back(formatted: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Digests of what the output alone tells: its turns, and the text under its mask, whose places the tokens' offsets give. With a ``tokenizer`` the ids and offsets are also held against a new encoding."""
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def batches(it):
        names = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
        for batch in it:
            rows = []
            for k, (text, mask) in enumerate(zip(batch.column(1).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                starts, ends = (np.asarray(batch.column(c)[k].values) for c in (2, 3))
                if tokenizer:
                    again = _tokenizer(tokenizer).encode(text, add_special_tokens=False)
                    assert again.ids == batch.column(5)[k].as_py() and again.offsets == list(zip(starts.tolist(), ends.tolist())), "the tokens are not those of the text"
                turns = parse(text)
                said = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode())
                under = "".join(unescape(text[a:b]) for a, b in stretches(starts, ends, np.frombuffer(mask, dtype=bool)))
                rows.append((len(turns), said.hexdigest(), len(under), hashlib.sha256(under.encode()).hexdigest(), len(text)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.record_batch([batch.column(0), *(pa.array(c, pa.string() if "sha" in n else pa.int64()) for n, c in zip(names, cols, strict=True))], ["conv_id", *names])

    wanted = ["conv_id", "formatted", "starts", "ends", "loss_mask", *(["ids"] if tokenizer else [])]
    return formatted.select(*wanted).mapInArrow(batches, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
