"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns.

States are roles.  A line is seen through its speaker marker (if any), whether it opens a row, its length (or that of
the row it opens), and whether it asks something; the chance of the next role depends on whether the line opens a row, as speakers seldom change within
one.  Parameters are counted from labelled rows (with one added to each count) and from `MARKER_WEIGHT` pretended lines
for each marker's own role; Viterbi's algorithm then finds the likeliest roles of all lines of a conversation, in order.

Viterbi is a product of matrices in which plus is max and times is plus, and such products can be bracketed at will.
Rows in order of conversation and turn are cut into ranges of about `BLOCK` rows, so a conversation of any size is a few
rows of one range or runs over many.  One pass makes a matrix of each block, a second chains the
matrices of a conversation and finds the state at each block's edge, and a third walks through each block between its
known edges.  So the roles are those of one walk over the whole conversation, while no task holds more of it than a
block, or one small matrix for each block.

A line loses its marker if that names the recovered role; else the marker is part of the text.  Lines of one role within
a row become one turn, blank lines between them included, and a turn is written as `<|im_start|>role`, a line break, the
text and `<|im_end|>`; where the text itself holds such a mark, a space inside it keeps it from opening or closing a turn.

Defined results: rows are read in order of turn, then text; a null turn counts as the first; a row without text (null,
empty or white space) gives no turn and does not change the walk; conversation ids are of any type that has a text, and
null ones are one conversation; repeated rows stay; roles in the input that are null or unknown are not learned from; an
empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, null_key

ROLES = ("system", "user", "assistant", "tool")
#: Rows of a range, about, and the characters of a text that ranges are cut by.
BLOCK = 20_000
CUT = 32
MARKER_WEIGHT = 1000.0
LENGTHS = 40

#: Names of speakers in transcripts, by role.
SPEAKERS = {
    "system": ("system", "instructions", "instruction", "context"),
    "user": ("user", "human", "prompter", "question", "q", "customer", "student", "you", "me"),
    "assistant": ("assistant", "ai", "bot", "chatbot", "gpt", "model", "answer", "a", "response", "agent"),
    "tool": ("tool", "function", "observation", "output"),
}
_ROLE_OF = {name: role for role, names in SPEAKERS.items() for name in names}
_NAMES = "|".join(sorted(_ROLE_OF, key=lambda x: (-len(x), x)))
#: `User:`, `**User**:`, `### User`, `[User]:`, `<|user|>`, `<|im_start|>user`, `>> User:`
_MARKER = re.compile(
    rf"^\s*(?:<\|im_start\|>\s*(?P<a>{_NAMES})\s*$|<\|(?P<b>{_NAMES})\|>|\#{{2,4}}\s*(?P<c>{_NAMES})\s*:?(?:\s|$)|(?:>+\s*)?(?:\*\*|__)?\[?(?P<d>{_NAMES})\]?(?:\*\*|__)?\s*:(?:\*\*|__)?(?:\s|$))",
    re.IGNORECASE,
)
_END = re.compile(r"<\|(?:im_end|end|eot_id)\|>\s*$")
_BREAK = re.compile(r"\r\n|[\n\r]")
_CONTROL = re.compile(r"<\|(?=im_(?:start|end)\|>)")


class Model(NamedTuple):
    step: np.ndarray  # [opens, from, to]; the last state is the beginning, which nothing leads back to
    marker: np.ndarray  # [opens, role, marker]; the last marker is none
    length: np.ndarray  # [opens, role, length]: of the whole row for the line that opens it, else of the line
    asks: np.ndarray  # [role, asks]


def split_marker(line: str) -> tuple[int, str]:
    """The role that a line's marker names (len(ROLES) if none), and the line without it."""
    match = _MARKER.match(line)
    line, role = (line[match.end() :].lstrip(), ROLES.index(_ROLE_OF[match[match.lastgroup].lower()])) if match else (line, len(ROLES))
    return role, _END.sub("", line)


def length_of(text: str) -> int:
    return min(LENGTHS - 1, int(2 * math.log2(len(text) + 1)))


def _lines(text: str | None) -> list[str]:
    return _BREAK.split(text or "")


def fit(rows: DataFrame, *, conversation: str, turn: str, role: str, text: str) -> Model:
    """Counts of roles with lengths and questions over all lines, and of first roles and steps between rows."""
    known = rows.filter(F.col(role).isin(*ROLES))
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = known.select(F.col(role).alias("role"), F.length(whole).alias("all"), F.posexplode(F.split(whole, r"\r\n|[\n\r]")).alias("at", "line")).filter(F.trim("line") != "")
    opens = (F.col("at") == 0).cast("int")
    chars = F.when(F.col("at") == 0, F.col("all")).otherwise(F.length("line"))
    size = F.least(F.lit(LENGTHS - 1), F.floor(2 * F.log2(chars + 1)).cast("int"))
    seen = lines.groupBy("role", opens.alias("opens"), size.alias("length"), F.rtrim("line").endswith("?").alias("asks")).agg(F.count(F.lit(1)).alias("n")).collect()
    one = known.select(F.coalesce(F.col(conversation).cast("string"), F.lit("")).alias("c"), F.coalesce(F.col(turn), F.lit(0)).cast("long").alias("t"), F.col(role).alias("role"))
    counts = one.groupBy("c", "t").agg(F.min("role").alias("role"))
    after = counts.select("c", (F.col("t") + 1).alias("t"), F.col("role").alias("before"))
    steps = counts.join(after, ["c", "t"], "left").groupBy("before", "role").agg(F.count(F.lit(1)).alias("n")).collect()
    n = len(ROLES)
    start, between, length, asks = np.ones(n), np.ones((n, n)), np.ones((2, n, LENGTHS)), np.ones((n, 2))
    for r in seen:
        at = ROLES.index(r["role"])
        length[r["opens"], at, r["length"]] += r["n"]
        asks[at, int(r["asks"])] += r["n"]
    for r in steps:
        if r["before"] is None:
            start[ROLES.index(r["role"])] += r["n"]
        else:
            between[ROLES.index(r["before"]), ROLES.index(r["role"])] += r["n"]
    share = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
    within = np.full((n, n), 0.002) + np.eye(n) * (1 - 0.002 * n)
    marker = np.ones((2, n, n + 1))
    for i in range(n):
        marker[:, i, i] += MARKER_WEIGHT
    marker[0, :, n] += 3 * MARKER_WEIGHT
    marker[1, :, n] += MARKER_WEIGHT
    begin = share(start)
    step = np.full((2, n + 1, n + 1), -np.inf)
    for opens, chances in enumerate((share(within), share(between))):
        step[opens, :n, :n], step[opens, n, :n] = chances, begin
    return Model(step, share(marker), share(length), share(asks))


class _Walk:
    """Scores of the lines of one row under a model."""

    def __init__(self, model: Model):
        self.m = model

    def lines(self, text: str | None) -> tuple[list[tuple[str, str, int]], list[np.ndarray]]:
        """The lines as (whole, without marker, marker; -1 if blank), and for each that is not blank the matrix [from, to] of its scores."""
        found, scores = [], []
        for line in _lines(text):
            if not line.strip():
                found.append((line, line, -1))
                continue
            opens = int(not scores)
            marker, bare = split_marker(line)
            of = self.m.marker[opens, :, marker] + self.m.length[opens, :, length_of(text if opens else line)] + self.m.asks[:, int(line.rstrip().endswith("?"))]
            # a marker speaks for a new turn wherever it stands
            scores.append((self.m.step[1] if marker < len(ROLES) else self.m.step[opens]) + np.append(of, 0.0)[None, :])
            found.append((_END.sub("", line), bare, marker))
        return found, scores


def chained(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The best scores from each state to each, through one and then two."""
    return (one[:, :, None] + two[None, :, :]).max(axis=1)


def walked(scores: list[np.ndarray], first: int, last: int) -> list[int]:
    """The best states after each step, from a known state to a known one."""
    values, best = scores[0][first], []
    for step in scores[1:]:
        both = values[:, None] + step
        best.append(both.argmax(axis=0))
        values = both.max(axis=0)
    states = [last]
    for back in reversed(best):
        states.append(int(back[states[-1]]))
    return states[::-1]


def _streamed(key: list[str], work: Callable[[pd.DataFrame], pd.DataFrame]):
    """Runs work on each run of rows that agree in the key columns; rows come sorted by them."""

    def some(out: pd.DataFrame) -> list[pd.DataFrame]:
        return [out] if len(out) else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            values = batch[key].to_numpy()
            edges = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1).tolist(), len(batch)]
            for a, b in zip(edges, edges[1:]):
                part = batch.iloc[a:b]
                if held and (held[0][key].iloc[0].to_numpy() != part[key].iloc[0].to_numpy()).any():
                    yield from some(work(pd.concat(held) if len(held) > 1 else held[0]))
                    held = []
                held.append(part)
        if held:
            yield from some(work(pd.concat(held) if len(held) > 1 else held[0]))

    return run


def _block_matrix(model: Model):
    walk = _Walk(model)

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        total = None
        for text in rows["text"]:
            for score in walk.lines(text)[1]:
                total = score if total is None else chained(total, score)
        head = rows.iloc[0]
        none = np.where(np.eye(len(ROLES) + 1) > 0, 0.0, -np.inf)
        return pd.DataFrame({"conv": [head["conv"]], "block": [head["block"]], "matrix": [(none if total is None else total).ravel()]})

    return _streamed(["conv", "block"], work)


def _edges(rows: pd.DataFrame) -> pd.DataFrame:
    """The states before and after each block of a conversation."""
    begin = len(ROLES)
    matrices = [np.asarray(m).reshape(begin + 1, begin + 1) for m in rows["matrix"]]
    values = matrices[0][begin]
    for matrix in matrices[1:]:
        values = (values[:, None] + matrix).max(axis=0)
    states = [begin, *walked(matrices, begin, int(values.argmax()))]
    return pd.DataFrame({"conv": rows["conv"], "block": rows["block"], "before": states[:-1], "after": states[1:]})


def rendered(role: str, text: str) -> str:
    return f"<|im_start|>{role}\n{_CONTROL.sub('<| ', text)}<|im_end|>"


def _turns(model: Model):
    walk = _Walk(model)

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        scored = [walk.lines(t) for t in rows["text"]]
        flat = [s for _, scores in scored for s in scores]
        states = walked(flat, int(rows["before"].iloc[0]), int(rows["after"].iloc[0])) if flat else []
        out, at = [], 0
        for row, (lines, _) in zip(rows.itertuples(index=False), scored, strict=True):
            part, before = -1, None
            for whole, bare, marker in lines:
                if marker < 0:
                    if part >= 0:
                        out[-1][-1].append("")
                    continue
                state = states[at]
                at += 1
                if state != before:
                    part, before = part + 1, state
                    out.append((row.conv, row.turn, part, ROLES[state], []))
                out[-1][-1].append(bare if marker == state else whole)
        made = [(c, t, p, role, "\n".join(lines).strip()) for c, t, p, role, lines in out]
        frame = pd.DataFrame(made, columns=["conv", "turn", "part", "role_pred", "text"]).astype({"turn": "int64", "part": "int32"})
        return frame.assign(rendered=[rendered(x[3], x[4]) for x in made])

    return _streamed(["conv", "block"], work)


def format_transcripts(rows: DataFrame, model: Model, *, conversation: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """The recovered turns: conversation, turn (of the row), part (within the row), role_pred, text, rendered."""
    kind = rows.schema[conversation].dataType
    names = rows.select(null_key(F.col(conversation)).alias("conv"), F.coalesce(F.col(turn).cast("long"), F.lit(0)).alias("turn"), F.col(text).alias("text"))
    ranges = max(1, -(-names.count() // BLOCK))
    by = ("conv", "turn", F.substring("text", 1, CUT))
    blocked = cut(names.repartitionByRange(ranges, *by).withColumn("block", F.spark_partition_id()), "blocks")
    ordered = blocked.repartition("conv", "block").sortWithinPartitions("conv", "block", "turn", "text")
    matrices = ordered.mapInPandas(_block_matrix(model), "conv string, block int, matrix array<double>")
    edges = matrices.repartition("conv").sortWithinPartitions("conv", "block").mapInPandas(_streamed(["conv"], _edges), "conv string, block int, before int, after int")
    edges = cut(edges, "edges")
    walked_rows = blocked.join(edges, ["conv", "block"]).repartition("conv", "block").sortWithinPartitions("conv", "block", "turn", "text").select("conv", "block", "turn", "text", "before", "after")
    turns = walked_rows.mapInPandas(_turns(model), "conv string, turn long, part int, role_pred string, text string, rendered string")
    conv: Column = F.when(F.col("conv") != "", F.expr("substring(conv, 2)")).cast(kind)
    return turns.select(conv.alias(conversation), F.col("turn").alias(turn), "part", "role_pred", F.col("text").alias(text), "rendered")


def op3(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    learned = rows.filter(F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).cast("binary")) % 5 != 0)
    model = fit(learned, conversation="conv_id", turn="turn", role="role", text="text")
    return format_transcripts(rows.drop("role"), model)
