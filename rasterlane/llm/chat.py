"""Chat transcripts: a hidden Markov model recovers who speaks and where turns begin, then turns are
rendered one way.

States are (role, first line of a turn, later line, or the empty line that closes it). A line shows a
speaker marker or none, whether it asks, and how long it is. Viterbi finds the best states for a whole
conversation. A transcript comes as rows of one or more lines in any order column; where a row begins
says nothing, so cutting a transcript into other rows changes no line's state. Conversations are dealt
by a range of (conversation, order), so one of any size spreads over tasks: a stretch of at most BLOCK
rows becomes a matrix of best scores from each state before it to each state at its end. Where a
conversation has several stretches, their ends are settled first: the stretches of one partition make
one matrix, a conversation's few of these settle each other, and each then settles its stretches.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import quoted, shared_dir, stored, table

ROLES = ("system", "user", "assistant")
FIRST, LATER, GAP = range(3)
STATES = len(ROLES) * 3  # role * 3 + FIRST, LATER or GAP
#: What precedes a conversation's first line, as a state that nothing returns to.
START = STATES
#: Names that transcripts give to speakers.
NAMES = {"system": ("system", "instructions", "context"), "user": ("user", "human", "question", "q", "customer"), "assistant": ("assistant", "ai", "bot", "answer", "a", "agent")}
MARKER = regex.compile(r"^\s*(?:<\|(?:im_start\|>)?|\[|#+\s*|\*\*|>\s*)?(" + "|".join(n for names in NAMES.values() for n in names) + r")(?:\|>|\]|\*\*)?\s*(?:[:>\-]+|$)(?:\*\*)?\s*", regex.I)
ROLE_OF = {n: r for r, names in enumerate(NAMES.values()) for n in names}
#: Marker (none or a role), asks or not, length in three steps; then an empty line.
SYMBOLS = (1 + len(ROLES)) * 2 * 3 + 1
EMPTY = SYMBOLS - 1
#: Rows of a stretch.
BLOCK = 256
#: Counts that every transition and symbol starts with, and symbols that a state should not show:
#: markers of another role or within a turn, lines with content in a gap.
SMOOTH, UNLIKELY = 0.5, 0.002


def marker(line: str) -> tuple[int, str]:
    """(1 + role or 0, the line without its marker)."""
    m = MARKER.match(line)
    return (1 + ROLE_OF[m[1].lower()], line[m.end() :]) if m else (0, line)


def symbol(line: str) -> int:
    who, rest = marker(line)
    if not who and not rest.strip():
        return EMPTY
    return (who * 2 + rest.rstrip().endswith("?")) * 3 + (len(rest) >= 40) + (len(rest) >= 200)


def symbols(text: str) -> np.ndarray:
    return np.array([symbol(x) for x in text.split("\n")], np.int64)


def turn_states(role: str, lines: np.ndarray) -> np.ndarray:
    """The states of one turn's lines."""
    out = np.full(len(lines), ROLES.index(role) * 3 + LATER)
    out[0] += FIRST - LATER
    if len(lines) > 1 and lines[-1] == EMPTY:
        out[-1] += GAP - LATER
    return out


def may_follow() -> np.ndarray:
    """(state, state): within a turn the role stays; a gap only ends a turn, and only a first line begins one."""
    out = np.zeros((STATES, STATES), bool)
    for a, b in itertools.product(range(STATES), repeat=2):
        out[a, b] = b % 3 == FIRST or (a // 3 == b // 3 and a % 3 != GAP)
    return out


def prior_symbols() -> np.ndarray:
    out = np.full((STATES, SYMBOLS), SMOOTH)
    for s, who in itertools.product(range(STATES), range(1, 1 + len(ROLES))):
        if s % 3 != FIRST or s // 3 != who - 1:
            out[s, who * 6 : who * 6 + 6] = UNLIKELY
    out[GAP::3, :EMPTY] = UNLIKELY
    return out


class Model:
    """Log probabilities: move (state or START, state), show (state, symbol); from counts."""

    def __init__(self, move: np.ndarray, show: np.ndarray):
        first = np.where(np.arange(STATES) % 3 == FIRST, move[START] + SMOOTH, 0)
        with np.errstate(divide="ignore"):
            self.move = np.log(norm(np.vstack([np.where(may_follow(), move[:START] + SMOOTH, 0), first])))
            self.show = np.log(norm(show + prior_symbols()))

    def matrix(self, rows: np.ndarray) -> np.ndarray:
        """Best scores from the state before (or START) to the state at the end of a run of symbols."""
        m = self.move + self.show[:, rows[0]]
        for x in rows[1:]:
            m = joined(m, self.move) + self.show[:, x]
        return m

    def path(self, rows: np.ndarray, before: int = START, end: int | None = None) -> np.ndarray:
        """The best states after the state before, up to the state end if it is given."""
        score = self.move[before] + self.show[:, rows[0]]
        back = np.zeros((len(rows), STATES), np.int64)
        for i, x in enumerate(rows[1:], 1):
            every = score[:, None] + self.move[:STATES]
            back[i] = every.argmax(axis=0)
            score = every.max(axis=0) + self.show[:, x]
        out = np.empty(len(rows), np.int64)
        out[-1] = score.argmax() if end is None else end
        for i in range(len(rows) - 1, 0, -1):
            out[i - 1] = back[i, out[i]]
        return out


def joined(m: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Best scores over m, then x."""
    return (m[:, :, None] + x[None, :STATES]).max(axis=1)


def norm(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def in_order(rows: DataFrame, conv_col: str, order_cols: tuple[str, ...], text_col: str) -> DataFrame:
    """conv (as text), ord (the order columns), text in order, dealt by ranges."""
    order = F.array(*[F.col(quoted(c)).cast("long") for c in order_cols])
    rows = rows.select(F.col(quoted(conv_col)).cast("string").alias("conv"), order.alias("ord"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, "conv", "ord", F.xxhash64("text")).sortWithinPartitions("conv", "ord", F.xxhash64("text"))


def learn(rows: DataFrame, conv_col: str = "conv_id", order_col: str = "turn", text_col: str = "text", role_col: str = "role") -> Model:
    """Counts moves and symbols over rows that each are one turn of a known role.

    Lines are counted where rows are read. Moves from a turn to the next (order + 1) are an equi-join on
    conversation and order. What the driver gets is a row for each pair of states and of state and
    symbol. Rows without a known role are left out; without any row the model knows its priors only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        move, show = np.zeros((STATES + 1, STATES)), np.zeros((STATES, SYMBOLS))
        for batch in batches:
            for text, role in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = symbols(text)
                at = turn_states(role, x)
                np.add.at(show, (at, x), 1)
                np.add.at(move, (at[:-1], at[1:]), 1)
        flat = np.concatenate([move.ravel(), show.ravel()])
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], ["at", "n"])

    text, role = F.coalesce(F.col(quoted(text_col)), F.lit("")), F.col(quoted(role_col))
    known = rows.where(role.isin(*ROLES)).select(F.col(quoted(conv_col)).alias("conv"), F.col(quoted(order_col)).cast("long").alias("ord"), text.alias("text"), role.alias("role"))
    flat = np.zeros(STATES * (STATES + 1 + SYMBOLS))
    for r in known.select("text", "role").mapInArrow(run, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).collect():
        flat[r["at"]] = r["n"]
    move, show = flat[: STATES * (STATES + 1)].reshape(STATES + 1, STATES), flat[STATES * (STATES + 1) :].reshape(STATES, SYMBOLS)
    last = F.when(F.col("text").rlike(r"\n\s*\z"), GAP).when(F.instr("text", "\n") > 0, LATER).otherwise(FIRST)
    turns = known.select("conv", "ord", "role", last.alias("last"))
    one = turns.groupBy("conv", "ord").agg(F.min(F.struct("role", "last")).alias("b"))  # repeats of a turn count once as the one before
    before = one.select("conv", (F.col("ord") + 1).alias("ord"), F.col("b.role").alias("of"), F.col("b.last").alias("of_last"))
    for r in turns.join(before, ["conv", "ord"], "left").groupBy("of", "of_last", "role").count().collect():
        state = START if r["of"] is None else ROLES.index(r["of"]) * 3 + r["of_last"]
        move[state, ROLES.index(r["role"]) * 3] += r["count"]
    return Model(move, show)


def stretches(rows: DataFrame, model: Model) -> DataFrame:
    """Rows with node (their stretch, numbered in order), open (whether the conversation may go on
    before or after it), run (the stretches of a conversation in one partition), states and last (of rows
    in closed stretches), m (of a stretch's first row)."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    kinds = {"conv": pa.string(), "ord": pa.list_(pa.int64()), "text": pa.string(), "node": pa.int64(), "run": pa.int64(), "open": pa.bool_(), "states": pa.list_(pa.int32()), "m": pa.list_(pa.float64()), "place": pa.int32(), "last": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = run = TaskContext.get().partitionId() << 32
        conv = object()

        def every() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns))

        def parts() -> Iterator[tuple[list[tuple], bool]]:
            """(rows of one conversation, whether it may have other rows elsewhere)."""
            held: list[tuple] = []
            edge, cut = True, False  # the partition's first rows may continue the one before
            for r in every():
                if held and (r[0] != held[0][0] or len(held) >= BLOCK):
                    cut = r[0] == held[0][0]
                    yield held, edge or cut
                    edge, held = cut, []
                held.append(r)
            if held:
                yield held, True

        out: list[tuple] = []
        for held, is_open in parts():
            number += 1
            if held[0][0] != conv:
                conv, run = held[0][0], number
            seen = [symbols(r[2]) for r in held]
            flat = np.concatenate(seen)
            states = [None] * len(held) if is_open else in_rows(sent.value.path(flat), seen)
            m = sent.value.matrix(flat).ravel().tolist() if is_open else None
            out += [(*r, number, run, is_open, s, m if i == 0 else None, i, i + 1 == len(held)) for i, (r, s) in enumerate(zip(held, states))]
            if len(out) >= 2000:
                yield table_of(out, kinds)
                out = []
        if out:
            yield table_of(out, kinds)

    return stored(rows.mapInArrow(run, "conv string, ord array<long>, text string, node long, run long, open boolean, states array<int>, m array<double>, place int, last boolean"), "chat-stretches")


def in_rows(states: np.ndarray, rows: list[np.ndarray]) -> list[list[int]]:
    return [x.tolist() for x in np.split(states, np.cumsum([len(x) for x in rows])[:-1])]


def table_of(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], list(kinds))


def as_matrix(m) -> np.ndarray:
    return np.array(m, float).reshape(STATES + 1, STATES)


def product(part: pd.DataFrame) -> pd.DataFrame:
    """The stretches of a run as one."""
    part = part.sort_values("node")
    m = as_matrix(part["m"].iloc[0])
    for x in part["m"].iloc[1:]:
        m = joined(m, as_matrix(x))
    return pd.DataFrame({"conv": part["conv"].iloc[:1], "node": part["run"].iloc[:1], "m": [m.ravel().tolist()]})


def settled(part: pd.DataFrame) -> pd.DataFrame:
    """(node, before, end) for a run of nodes, its own before and end (null: any) being known."""
    part = part.sort_values("node")
    before, end = part["before"].iloc[0], part["end"].iloc[0]
    ms = [as_matrix(m) for m in part["m"]]
    score, back = ms[0][int(before)], [np.full(STATES, int(before))]
    for m in ms[1:]:
        every = score[:, None] + m[:STATES]
        back.append(every.argmax(axis=0))
        score = every.max(axis=0)
    state, out = int(score.argmax()) if pd.isna(end) else int(end), []
    for node, b in zip(part["node"].iloc[::-1], reversed(back)):
        out.append((node, int(b[state]), state))
        state = int(b[state])
    return pd.DataFrame(out, columns=["node", "before", "end"])


def boundaries(nodes: DataFrame) -> DataFrame:
    """(node, before, end): the best states before and at the end of each stretch.

    nodes: conv, node, run, m. A task holds the matrices of one run, that is of one partition's
    stretches, or those of one conversation's runs, at most one a partition.
    """
    runs = stored(nodes.groupBy("run").applyInPandas(product, "conv string, node long, m array<double>"), "chat-runs")
    whole = runs.withColumns({"before": F.lit(START), "end": F.lit(None).cast("int")})
    ends = stored(whole.groupBy("conv").applyInPandas(settled, "node long, before int, end int"), "chat-ends")
    return stored(nodes.join(ends.withColumnRenamed("node", "run"), "run").groupBy("run").applyInPandas(settled, "node long, before int, end int"), "chat-ends")


def render(text: str, states: list[int], begins: bool, ends: bool) -> str:
    """What a row's lines become; the rows of a conversation, one after the other, are its canonical form."""
    out = []
    for line, s in zip(text.split("\n"), states):
        if s % 3 == FIRST:
            out += [] if begins else ["<|im_end|>"]
            out.append(f"<|im_start|>{ROLES[s // 3]}")
            line = marker(line)[1]
            if line:
                out.append(line)
        elif s % 3 == LATER:
            out.append(line)
        begins = False
    return "".join(f"{x}\n" for x in [*out, *(["<|im_end|>"] if ends else [])])


def formatted(rows: DataFrame, model: Model, conv_col: str = "conv_id", order_cols: tuple[str, ...] = ("turn",), text_col: str = "text") -> DataFrame:
    """One row per input row: <conv_col>, ord (array of the order columns), text, states (of its lines),
    rendered: joined in order, a conversation's rows are its turns in canonical form.

    Rows of a conversation are in the order of order_cols, then of a hash of the text; null ids and
    orders come first, and all rows without an id are one conversation. Ids of any type that casts
    to text and back. A row may hold any number of lines and of turns; turns may go on over rows.
    Null texts are one empty line; repeated rows are lines like any other. An empty table gives an
    empty result. Other columns are not read.
    """
    shared_dir(rows.sparkSession)
    found = stretches(in_order(rows, conv_col, order_cols, text_col), model)
    nodes = found.where("open and m is not null").select("conv", "node", "run", "m")
    last = nodes.groupBy("conv").agg(F.max("node").alias("node")).select("node", F.lit(True).alias("closes"))
    ends = boundaries(nodes).join(last, "node", "left")
    sent = rows.sparkSession.sparkContext.broadcast(model)
    schema = "conv string, ord array<long>, text string, states array<int>, rendered string"

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, order, text, states, place, last = batch.columns
            made = [render(*x) for x in zip(text.to_pylist(), states.to_pylist(), (p == 0 for p in place.to_pylist()), last.to_pylist())]
            yield pa.RecordBatch.from_arrays([conv, order, text, states, pa.array(made, pa.string())], ["conv", "ord", "text", "states", "rendered"])

    def decode(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place")
        seen = [symbols(t) for t in part["text"]]
        before = int(part["before"].iloc[0])
        states = in_rows(sent.value.path(np.concatenate(seen), before, int(part["end"].iloc[0])), seen)
        closes = part["closes"].iloc[0] is True or part["closes"].iloc[0] == True  # noqa: E712
        n = len(part)
        made = [render(t, s, before == START and i == 0, closes and i + 1 == n) for i, (t, s) in enumerate(zip(part["text"], states))]
        return part[["conv", "ord", "text"]].assign(states=states, rendered=made)

    done = found.where("not open").select("conv", "ord", "text", "states", "place", "last").mapInArrow(shown, schema)
    late = found.where("open").select("conv", "ord", "text", "node", "place").join(ends, "node").groupBy("node").applyInPandas(decode, schema)
    return done.unionByName(late).withColumn("conv", F.col("conv").cast(rows.schema[conv_col].dataType)).withColumnRenamed("conv", conv_col)


def as_transcripts(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) as their transcripts would have them.

    Marker styles differ by conversation, every second one has an empty line after each turn; by a
    hash, every eighth turn has lost its marker and every fortieth has another role's. role stays, to
    learn from and to compare with.
    """
    kind, odd = F.pmod(F.xxhash64("conv_id"), F.lit(8)), F.pmod(F.xxhash64("conv_id", "turn", "text"), F.lit(40))
    role = F.when(odd == 1, F.when(F.col("role") == "user", "assistant").otherwise("user")).otherwise(F.col("role"))
    name = F.when(role == "user", "Human").when(role == "assistant", "AI").otherwise("System")
    style = F.floor(kind / 2)
    mark = F.when(style == 0, F.concat(F.initcap(role), F.lit(": "))).when(style == 1, F.concat(F.lit("### "), name, F.lit(":\n")))
    mark = mark.when(style == 2, F.concat(F.lit("["), F.upper(role), F.lit("]: "))).otherwise(F.concat(F.lit("**"), role, F.lit("**: ")))
    text = F.coalesce(F.col("text"), F.lit(""))
    text = F.when(odd % 8 == 0, text).otherwise(F.concat(F.coalesce(mark, F.lit("")), text))
    return conversations.select("conv_id", "turn", "role", F.concat(text, F.when(kind % 2 == 0, "\n").otherwise("")).alias("text"))


def lines_of(rows: DataFrame) -> DataFrame:
    """conv_id, turn, line, text: a row for each line of a transcript, and no word of roles or turns in it."""
    return rows.select("conv_id", "turn", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of the conversations' transcripts with its role, whether it begins a turn, and what it
    is rendered as; learned from conversations whose crc32(conv_id) mod 5 is not 0. The parser sees
    lines in their order only; turn and line are those of the input, to compare with."""
    rows = as_transcripts(table(spark, sf_dir, "conversations"))
    found = formatted(lines_of(rows), learn(rows.where(~held_out_of("conv_id"))), order_cols=("turn", "line"))
    state = F.col("states")[0]
    return found.select(
        "conv_id", F.col("ord")[0].alias("turn"), F.col("ord")[1].alias("line"), role_of(state).alias("role_pred"), (state % 3 == FIRST).alias("begins_turn"), "rendered", held_out_of("conv_id").alias("held_out")
    )


def role_of(state: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ROLES)), (F.floor(state / 3) + 1).cast("int"))


def held_out_of(name: str) -> Column:
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % 5 == 0, F.lit(False))
