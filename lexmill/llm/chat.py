"""Chat formatting: turns and roles of transcripts by hidden Markov models, then canonical rendering.

A row may be one turn or a transcript of many. Its lines are read first: a line emits its speaker marker (as "User:"), its
length and whether it asks, and its hidden state is the first line of a turn of some role, or a line inside a turn.
Probabilities are counted over all lines, and the Viterbi path of a row's lines cuts it into turns.

Turns are read next, by conversation. States are the roles. A turn emits its marker (the declared role for a row's first
turn, else the one that its first line has) and features of its lines: their number, length, whether it asks, and
whether it is the first turn. Start, transition and emission probabilities are counted over the turns whose marker
names a role. Viterbi then gives each conversation's most likely roles, also where markers are missing, unknown or wrong.

A conversation's turns are dealt to blocks of ``BLOCK`` turn numbers. In a block the best path between any two states is a
(max, +) matrix; conversations of several blocks combine these small matrices first, which fixes the states at the
borders, and every block is then decoded by itself. Turn numbers that stand very often are cut further. So no task holds a
long conversation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.session import Scratch, table

ROLES = ("system", "user", "assistant")
BLOCK = 256
#: Turns of a block, beyond which its turn numbers are blocks of their own, each cut further by the order within it.
CROWDED = 4096
#: Crowded blocks that are broadcast; more are joined by a sort.
BROADCAST_BLOCKS = 100_000
#: Pseudo-count of every probability.
PRIOR = 0.5

#: Markers that name each role, lower case.
MARKERS = {
    "system": ("system", "sys", "developer", "instructions"),
    "user": ("user", "human", "customer", "client", "question", "q", "me", "prompter"),
    "assistant": ("assistant", "ai", "bot", "agent", "model", "answer", "a", "gpt"),
}
_MARKER = r"^\s*[\[<(*#>|]*\s*([A-Za-z]{1,12})\s*[\])>*|]*\s*:+\s*"
FEATURES = ("marker", "lines", "length", "asks", "first")
#: Lines: share of turns that start anywhere, beside what is counted; how often a turn's first line inside a row has its
#: marker; how often some other line looks like one, at least.
ANY_START, MARKED, STRAY = 0.02, 0.98, 1e-6
LINE_FEATURES = ("length", "asks")


def _named(value: Column) -> Column:
    """The role that a marker names, else null."""
    low = F.lower(F.trim(value))
    out = F.lit(None).cast("string")
    for role in reversed(ROLES):
        out = F.when(low.isin(*MARKERS[role]), role).otherwise(out)
    return out


def _line_marker(line: Column) -> Column:
    return _named(F.regexp_extract(line, _MARKER, 1))


def _line_length(line: Column) -> Column:
    return F.floor(F.log2(F.length(line).cast("double") + 1)).cast("int")


def _learn_lines(turns: DataFrame) -> dict:
    """Log-probabilities of lines behind a row's first, from grouped counts: how states follow and what they emit.

    A line with a marker that names a role counts as the first of a turn, the others as lines inside one.
    """
    lines = F.transform(F.slice(F.split(F.coalesce("text", F.lit("")), "\n"), 2, 1 << 30), lambda x: F.struct(F.coalesce(_line_marker(x), F.lit("in")).alias("state"), _line_length(x).alias("length"), F.contains(x, F.lit("?")).cast("int").alias("asks")))
    counts = turns.select(F.explode(lines).alias("x")).groupBy("x.state", "x.length", "x.asks").count().collect()  # a few values each
    states = ("in", *ROLES)
    n = {s: sum(r["count"] for r in counts if r["state"] == s) for s in states}
    whole = sum(n.values())
    inside = (1 - ANY_START) * (n["in"] + PRIOR) / (whole + PRIOR * len(states))
    model: dict = {"in": np.log(inside), **{r: np.log((1 - ANY_START) * (n[r] + PRIOR) / (whole + PRIOR * len(states)) + ANY_START / len(ROLES)) for r in ROLES}, "emit": {}}
    for f in LINE_FEATURES:
        for s in states:
            values: dict[int, int] = {}
            for r in counts:
                if r["state"] == s:
                    values[r[f]] = values.get(r[f], 0) + r["count"]
            total = n[s] + PRIOR * (32 if f == "length" else 2)
            model["emit"][f, s] = {v: float(np.log((c + PRIOR) / total)) for v, c in values.items()} | {None: float(np.log(PRIOR / total))}
    return model


_MARK = re.compile(_MARKER.replace("^\\s*", "\\s*", 1))
_ROLE_OF = {name: role for role, names in MARKERS.items() for name in names}


def _cut(text: str, model: dict) -> list[tuple[str | None, str]]:
    """(role of the marker, body) of each turn of a row: the Viterbi path of its lines; the first line starts a turn.

    A turn's role is carried by its first line, so a path is one of starts and lines inside: each line's choice depends on
    the line before only through the weights of starting and going on, which are alike for all roles.
    """
    lines = text.split("\n")
    out: list[tuple[str | None, list[str]]] = []
    for i, line in enumerate(lines):
        m = _MARK.match(line)
        role = _ROLE_OF.get(m[1].lower()) if m else None
        if i:
            size, asks = int(np.floor(np.log2(len(line) + 1))), int("?" in line)
            emit = lambda s: sum(model["emit"][f, s].get(v, model["emit"][f, s][None]) for f, v in (("length", size), ("asks", asks)))  # noqa: E731, B023
            go_on = model["in"] + emit("in") + np.log(STRAY if role else 1 - STRAY)
            start = max(model[r] + emit(r) + np.log(MARKED if role == r else (1 - MARKED) / len(ROLES)) for r in ROLES)
        if i == 0 or start > go_on:
            out.append((role, [line[m.end() :] if role else line]))
        else:
            out[-1][1].append(line)
    return [(role, "\n".join(body)) for role, body in out]


def _cut_rows(turns: DataFrame, told) -> DataFrame:
    """A row for each turn of each row: part, inline (its marker's role) and body. Rows without a further marker are one turn."""

    @F.pandas_udf("array<struct<inline:string,body:string>>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"inline": r, "body": b} for r, b in _cut(t or "", told.value)])

    return turns.select("*", F.posexplode(cut("text")).alias("part", "__turn")).select(*turns.columns, "part", "__turn.inline", "__turn.body")


def _features(turns: DataFrame) -> DataFrame:
    """The symbols of each turn (conv, turn, part, role, inline, body); the declared role is that of a row's first turn."""
    size, first = F.length("body"), F.col("part") == 0
    declared = F.when(first, F.col("role"))
    return turns.withColumns({
        "marker": F.coalesce(_named(declared), F.col("inline"), F.when(F.trim(declared) != "", F.lit("?")), F.lit("")),
        "body": F.trim("body"),
        "lines": F.least(F.size(F.split("body", "\n")), F.lit(6)).cast("string"),
        "length": F.when(size > 0, F.floor(F.log2(size.cast("double")))).otherwise(F.lit(-1)).cast("string"),
        "asks": F.contains("body", F.lit("?")).cast("string"),
        "first": F.coalesce(((F.col("turn") == 0) & first).cast("string"), F.lit("")),
    })


def _learn(turns: DataFrame, edges: DataFrame) -> dict[str, np.ndarray | dict[str, np.ndarray]]:
    """Log-probabilities from grouped counts; features have few values, so this is small."""
    n = len(ROLES)
    at = {r: i for i, r in enumerate(ROLES)}
    emit: dict[str, dict[str, np.ndarray]] = {f: {} for f in FEATURES}
    named = turns.filter(F.col("marker").isin(*ROLES))
    stacked = named.select(F.col("marker").alias("role"), F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in FEATURES])).alias("x"))
    for r in stacked.groupBy("role", "x.f", "x.v").count().collect():
        emit[r["f"]].setdefault(r["v"], np.zeros(n))[at[r["role"]]] += r["count"]
    # A marker is right nearly always; its own turns cannot show how often it is not.
    logs = {}
    for f, values in emit.items():
        total = sum(values.values(), np.zeros(n)) + PRIOR * (len(values) + 1)
        logs[f] = {v: np.log((c + PRIOR) / total) for v, c in values.items()} | {None: np.log(PRIOR / total)}
    logs["marker"] = {r: np.where(np.arange(n) == i, np.log(0.998), np.log(0.001)) for r, i in at.items()} | {None: np.zeros(n)}
    start, move = np.full(n, PRIOR), np.full((n, n), PRIOR)
    for r in edges.collect():
        if r["a"] is None:
            start[at[r["b"]]] += r["n"]
        else:
            move[at[r["a"]], at[r["b"]]] += r["n"]
    return {"emit": logs, "start": np.log(start / start.sum()), "move": np.log(move / move.sum(axis=1, keepdims=True))}


def _scores(frame: pd.DataFrame, model) -> np.ndarray:
    out = np.zeros((len(frame), len(ROLES)))
    for f in FEATURES:
        known = model["emit"][f]
        out += np.stack([known.get(v, known[None]) for v in frame[f]])
    return out


def _groups(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole runs of (conv, block) from sorted rows; the last run of a batch waits for the next."""
    held = None
    for frame in frames:
        frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
        if not len(frame):
            continue
        last = (frame["key"] == frame["key"].iloc[-1]).to_numpy()
        cut = int(np.flatnonzero(~last)[-1]) + 1 if (~last).any() else 0
        held = frame.iloc[cut:]
        if cut:
            yield frame.iloc[:cut]
    if held is not None and len(held):
        yield held


def _runs(frame: pd.DataFrame) -> Iterator[tuple[int, int]]:
    key = frame["key"].to_numpy()
    cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
    yield from zip(cuts, cuts[1:], strict=False)


def _matrix(scores: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Best log-weight of a block from each state at its first turn to each at its last."""
    best = np.where(np.eye(len(move), dtype=bool), scores[0][:, None], -np.inf)
    for s in scores[1:]:
        best = (best[:, :, None] + move[None]).max(axis=1) + s
    return best


def _viterbi(scores: np.ndarray, move: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The best states, given weights of the first and the last state; ties to the role named first."""
    best, back = scores[0] + start, []
    for s in scores[1:]:
        options = best[:, None] + move
        back.append(options.argmax(axis=0))
        best = options.max(axis=0) + s
    path = [int((best + end).argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return np.array(path[::-1])


def _join_blocks(model):
    """The states at the borders of the blocks of one conversation."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("block")
        mats = [np.array(m).reshape(len(ROLES), -1) for m in frame["matrix"]]
        # Two turns for each block, its first and its last state.
        best, back = model["start"].copy(), []
        for i, m in enumerate(mats):
            if i:
                options = best[:, None] + model["move"]
                back.append(options.argmax(axis=0))
                best = options.max(axis=0)
            options = best[:, None] + m
            back.append(options.argmax(axis=0))
            best = options.max(axis=0)
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        path = path[::-1]
        return pd.DataFrame({"conv": frame["conv"], "block": frame["block"], "first_state": path[0::2], "last_state": path[1::2]})

    return run


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, part, role (recovered), declared and rendered of every turn.

    A row whose text holds markers of further speakers at the start of lines is several turns, by ``part`` from 0; the declared
    role is that of the first. rendered is the canonical turn: ``<|role|>``, a line break, the text without its marker
    and outer blanks, and ``<|end|>``. Turns are in the order of their numbers, then of a hash of text and role, then of
    parts. Rows repeated as a whole are one turn of the conversation and come back as often as they stand. Rows with a null conversation or turn number are
    conversations of one turn. Null and empty texts are turns with an empty body. Unknown and missing roles are
    recovered from the rest. Other columns are left aside. An empty table gives an empty result.
    """
    spark = turns.sparkSession
    scratch = Scratch(spark, "chat")
    kind = {c: turns.schema[c].dataType.simpleString() for c in (conv, turn)}
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("copies"))
    rows = rows.withColumn("ord", F.xxhash64("conv", "turn", "role", "text"))
    cutter = spark.sparkContext.broadcast(_learn_lines(rows))
    rows = _features(_cut_rows(rows, cutter)).drop("text", "inline")
    loose = F.col("conv").isNull() | F.col("turn").isNull()
    rows = scratch.table(rows.withColumns({"base": F.when(~loose, F.floor(F.col("turn") / BLOCK)).cast("long"), "loose": loose}), "cut")
    # Very many rows with turn numbers of one block: cut by turn number and by the first bits of the order within it.
    bits = F.ceil(F.log2(F.col("c") / (CROWDED / 4))).cast("int")
    crowded = scratch.table(rows.filter("not loose").groupBy("conv", "base").agg(F.count("*").alias("c")).filter(F.col("c") > CROWDED).select("conv", "base", bits.alias("bits")), "crowded")
    few = F.broadcast if crowded.count() <= BROADCAST_BLOCKS else lambda df: df
    rows = rows.join(few(crowded), ["conv", "base"], "left")
    piece = (F.col("turn") - F.col("base") * BLOCK) * F.expr("shiftleft(1L, bits)") + F.expr("shiftright(ord, 64 - bits) + shiftleft(1L, bits - 1)")
    block = F.when(~F.col("loose"), F.col("base") * (1 << 32) + F.coalesce(piece, F.lit(0))).otherwise(F.col("ord"))
    rows = rows.withColumn("block", block.cast("long")).drop("base", "bits")
    rows = rows.withColumn("key", F.concat_ws("/", F.coalesce(F.col("conv").cast("string"), F.lit("?")), "block", F.col("loose").cast("string")))
    rows = scratch.table(rows, "turns")
    order = [F.col("turn"), F.col("ord"), F.col("part")]
    within = Window.partitionBy("conv", "block").orderBy(*order)
    known = F.when(F.col("marker").isin(*ROLES), F.col("marker"))
    near = rows.filter("not loose").select("conv", "block", known.alias("b"), F.lag(known).over(within).alias("a"), F.lag("turn").over(within).isNull().alias("head"))
    # A block's first turn follows the last one of the block before it: one row for each block.
    last = rows.filter("not loose").groupBy("conv", "block").agg(F.max_by(F.struct(known.alias("k")), F.struct(*order)).alias("l"))
    before = last.select("conv", "block", F.lag("l.k").over(Window.partitionBy("conv").orderBy("block")).alias("k"), F.lag("block").over(Window.partitionBy("conv").orderBy("block")).isNull().alias("start"))
    heads = near.filter("head").join(before, ["conv", "block"]).select(F.when(~F.col("start"), F.col("k")).alias("a"), "b", "start")
    pairs = near.filter("not head").select("a", "b", F.lit(False).alias("start")).union(heads)
    edges = pairs.filter("b is not null and (start or a is not null)").groupBy("a", "b").agg(F.count("*").alias("n"))
    told = spark.sparkContext.broadcast(_learn(rows, edges))

    # Conversations of several blocks: their blocks' matrices, then the states at the borders.
    several = rows.filter("not loose").groupBy("conv").agg(F.min("block").alias("lo"), F.max("block").alias("hi")).filter("lo <> hi").select("conv")
    long = rows.filter("not loose").join(several, "conv", "left_semi").repartition("key").sortWithinPartitions("key", *order)

    def matrices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _groups(frames):
            scores, out = _scores(frame, told.value), []
            for a, b in _runs(frame):
                out.append((frame["conv"].iloc[a], frame["block"].iloc[a], _matrix(scores[a:b], told.value["move"]).ravel().tolist()))
            yield pd.DataFrame(out, columns=["conv", "block", "matrix"])

    found = long.mapInPandas(matrices, f"conv {kind[conv]}, block long, matrix array<double>")
    borders = found.groupBy("conv").applyInPandas(lambda frame: _join_blocks(told.value)(frame), f"conv {kind[conv]}, block long, first_state int, last_state int")
    borders = scratch.table(borders, "borders")

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, fixed = told.value, lambda s: np.where(np.arange(len(ROLES)) == int(s), 0.0, -np.inf)
        for frame in _groups(frames):
            scores, states = _scores(frame, model), np.zeros(len(frame), dtype=np.int64)
            first, last = frame["first_state"].to_numpy(), frame["last_state"].to_numpy()
            for a, b in _runs(frame):
                start, end = (model["start"], np.zeros(len(ROLES))) if pd.isna(first[a]) else (fixed(first[a]), fixed(last[a]))
                states[a:b] = _viterbi(scores[a:b], model["move"], start, end)
            yield pd.DataFrame({"conv": frame["conv"], "turn": frame["turn"], "part": frame["part"], "role": [ROLES[s] for s in states], "declared": frame["role"], "body": frame["body"], "copies": frame["copies"]})

    dealt = rows.join(borders, ["conv", "block"], "left").repartition("key").sortWithinPartitions("key", *order)
    out = dealt.mapInPandas(decode, f"conv {kind[conv]}, turn {kind[turn]}, part int, role string, declared string, body string, copies long")
    rendered = F.concat(F.lit("<|"), "role", F.lit("|>\n"), "body", F.lit("<|end|>"))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(F.col("conv").alias(conv), F.col("turn").alias(turn), "part", "role", "declared", rendered.alias("rendered"))


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of ``conversations`` with its recovered role and canonical form."""
    return format_chats(table(spark, sf_dir, "conversations")).drop("part")


#: Turns of one transcript of the query below.
PIECE = 8


def op1_chat_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``conversations`` written as transcripts of up to 8 turns without roles, and read again: turns and roles come from lines."""
    names = {"system": "System", "user": "Human", "assistant": "AI"}
    name = F.lit(None).cast("string")
    for role, label in names.items():
        name = F.when(F.col("role") == role, label).otherwise(name)
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.floor(F.col("turn") / PIECE).alias("piece"), "turn", F.concat(name, F.lit(": "), F.trim("text")).alias("line"))
    pieces = turns.groupBy("conv_id", "piece").agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("t"))  # a few turns
    rows = pieces.select("conv_id", F.col("piece").alias("turn"), F.lit(None).cast("string").alias("role"), F.array_join("t.line", "\n").alias("text"))
    return format_chats(rows).select("conv_id", F.col("turn").alias("piece"), "part", "role", "rendered")


SQL = r"""
SELECT conv_id, turn, role, role AS declared,
  '<|' || role || '|>' || chr(10) || trim(text, ' ') || '<|end|>' AS rendered
FROM conversations
"""

TRANSCRIPTS_SQL = r"""
SELECT conv_id, turn // 8 AS piece, (row_number() OVER (PARTITION BY conv_id, turn // 8 ORDER BY turn) - 1)::INTEGER AS part, role,
  '<|' || role || '|>' || chr(10) || trim(text, ' ') || '<|end|>' AS rendered
FROM conversations
"""
