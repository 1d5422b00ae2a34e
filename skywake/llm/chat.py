"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in alternation, and ends with an assistant turn.
Repairs cost: a turn merged into the one before (1), an empty turn inserted (2), a turn relabelled (3; 1 where its role is none
of the three). Dynamic programming over the automaton of legal turns finds the cheapest repair; of equally cheap ones that which,
from the last turn backwards, comes first in `options`, and of the last states the first.

The step that a turn takes is a small matrix of costs, and matrices multiply (minimum for sum, sum for product), so a long
conversation is cut into runs of ``run`` turns: each run's matrix is made in a task of its own, a pass over the run matrices
gives each run its entry costs and exit state, and each run then finds its own path. No task holds more than a run of turns
or a run's worth of matrices; many runs are multiplied level by level. All of this knows roles and places alone: texts are stored once, with
their place, and join the turns they belong to in the end, so no row holds more than one of them.

Result: a row per turn, and per turn inserted, in rendered order; the ``rendered`` pieces of a conversation, one behind the other,
are its text. Conversations without turns have no row. A null conv_id is a conversation. Turns are ordered by ``turn``, null first,
then role and a hash of the text; rows that repeat are turns of their own. Null roles are none of the three; null texts are empty. Roles
are compared without outer blanks and case.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skywake.llm.common import table, written

ROLES = ("system", "user", "assistant")
#: States: nothing yet, or the role of the turn last written.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE, INSERT, RELABEL, NAME = 1, 2, 3, 1
RUN, FAN = 4_096, 512
FAR = 1 << 40
HEAD, JOINT, TAIL = "<|{role}|>\n", "\n\n", "<|end|>\n"

REPAIRED = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("place", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("action", pa.string()),
                      ("cost", pa.int32()), ("lead", pa.string()), ("tail", pa.string())])


@cache
def options(role: str) -> list[tuple[int, int, int, tuple[int, ...], bool]]:
    """The ways to take a turn of `role`: (state before, state after, cost, turns inserted before it, merged)."""
    own = ROLES.index(role) + 1 if role in ROLES else None
    found = []
    for before in range(4):
        for after in (SYSTEM, USER, ASSISTANT):
            label = 0 if after == own else NAME if own is None else RELABEL
            if before == after:
                found.append((before, after, label + MERGE, (), True))
            if after in NEXT[before]:
                found.append((before, after, label, (), False))
            found += [(before, after, label + INSERT, (middle,), False) for middle in NEXT[before] if after in NEXT[middle]]
            found += [
                (before, after, label + 2 * INSERT, (first, second), False)
                for first in NEXT[before] for second in NEXT[first] if after in NEXT[second]
            ]
    return found


@cache
def step_costs(role: str) -> np.ndarray:
    costs = np.full((4, 4), FAR, np.int64)
    for before, after, cost, _, _ in options(role):
        costs[before, after] = min(costs[before, after], cost)
    return costs


def times(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Minimum-plus product."""
    return np.minimum((left[:, :, None] + right[None, :, :]).min(axis=1), FAR)


def closing(state: int) -> tuple[int, tuple[int, ...]]:
    """Cost and turns to end a conversation in `state`."""
    return {START: (0, ()), SYSTEM: (2 * INSERT, (USER, ASSISTANT)), USER: (INSERT, (ASSISTANT,)), ASSISTANT: (0, ())}[state]


def run_matrix(roles: list[str]) -> np.ndarray:
    """The product of the turns' matrices."""
    total = np.where(np.eye(4, dtype=bool), 0, FAR).astype(np.int64)
    for role in roles:
        total = times(total, step_costs(role))
    return total


def walk(roles: list[str], entry: np.ndarray) -> list[np.ndarray]:
    """The least cost of each state before the run and behind each of its turns."""
    held = [entry]
    for role in roles:
        held.append(np.minimum((held[-1][:, None] + step_costs(role)).min(axis=0), FAR))
    return held


def path(roles: list[str], costs: list[np.ndarray], state: int) -> tuple[int, list[tuple]]:
    """The state before the run and the options taken, when it ends in `state`."""
    taken = []
    for place in range(len(roles) - 1, -1, -1):
        best = min(
            ((costs[place][o[0]] + o[2], order, o) for order, o in enumerate(options(roles[place])) if o[1] == state),
        )
        taken.append(best[2])
        state = best[2][0]
    return state, taken[::-1]


def last_state(costs: np.ndarray) -> int:
    return min(range(4), key=lambda s: (costs[s] + closing(s)[0], s))


def _role(column: str = "role"):
    plain = F.lower(F.trim(column))
    return F.when(plain.isin(*ROLES), plain)


def _numbered(turns: DataFrame, run: int) -> DataFrame:
    """`turns` with their `place` in the conversation, from 0, and the `run` they are in.

    One range-partitioned sort of all turns; a conversation that spans partitions continues behind the counts of those before.
    """
    order = ["conv_id", "turn", "role", "mark", "tie"]
    # equal turns are interchangeable; the tie only deals them out over partitions
    spread = turns.withColumn("mark", F.xxhash64("text")).withColumn("tie", F.monotonically_increasing_id())
    sorted_ = spread.repartitionByRange(*order).sortWithinPartitions(*order).drop("mark", "tie")
    held = written(sorted_.withColumn("part", F.spark_partition_id()).withColumn("spot", F.monotonically_increasing_id()), "sorted-turns")
    parts = held.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"), F.min("spot").alias("first"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("n")  # a row per partition
    offsets = parts.select(F.col("conv_id").alias("conv"), F.col("part").alias("in_part"), (before - F.col("first")).alias("shift"))
    place = F.col("spot") + F.col("shift")
    return (
        held.join(offsets, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("part") == F.col("in_part")))
        .withColumn("place", place)
        .withColumn("run", F.floor(place / run))
        .select("conv_id", "run", "place", "turn", "role", "text")
    )


def _scan(values: DataFrame, combine, step, start: list[int]) -> DataFrame:
    """conv_id, run and `entry` of `values` (conv_id, run, value): what `step` has made of `start` before each run.

    Runs are combined by FAN, level by level, and the entries handed down again, so no task holds more than FAN values of a conversation.
    """

    def grouped(level: DataFrame, whole: bool = False) -> DataFrame:
        key = F.lit(0).cast("long") if whole else F.floor(F.col("run") / FAN)
        return level.groupBy("conv_id", key.alias("run")).agg(F.array_sort(F.collect_list(F.struct("run", "value"))).alias("held"))

    def up(batches):
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.record_batch([pa.array([r["conv_id"] for r in rows], pa.int64()), pa.array([r["run"] for r in rows], pa.int64()),
                                   pa.array([combine([h["value"] for h in r["held"]]) for r in rows], pa.list_(pa.int64()))], names=["conv_id", "run", "value"])

    def down(batches):
        for batch in batches:
            ids, numbers, entries = [], [], []
            for row in batch.to_pylist():
                entry = row["entry"]
                for held in row["held"]:
                    ids.append(row["conv_id"])
                    numbers.append(held["run"])
                    entries.append(entry)
                    entry = step(entry, held["value"])
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(numbers, pa.int64()), pa.array(entries, pa.list_(pa.int64()))], names=["conv_id", "run", "entry"])

    levels = [values]
    while (levels[-1].agg(F.max("run")).first()[0] or 0) >= FAN:
        levels.append(written(grouped(levels[-1]).mapInArrow(up, "conv_id long, run long, value array<long>"), "runs"))
    entry = F.array(*(F.lit(x).cast("long") for x in start))
    schema = "conv_id long, run long, entry array<long>"
    entries = grouped(levels.pop(), whole=True).withColumn("entry", entry).mapInArrow(down, schema)
    for level in reversed(levels):
        above = entries.select(F.col("conv_id").alias("conv"), F.col("run").alias("group"), "entry")
        both = grouped(level).join(above, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("run") == F.col("group")))
        entries = both.select("conv_id", "run", "held", "entry").mapInArrow(down, schema)
    return entries


def _with(left: DataFrame, right: DataFrame, *columns: str) -> DataFrame:
    """`left` with `columns` of the row of `right` for the same conversation and run."""
    other = right.select(F.col("conv_id").alias("conv"), F.col("run").alias("number"), *columns)
    return left.join(other, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("run") == F.col("number"))).drop("conv", "number")


def _product(values: list[list[int]]) -> list[int]:
    total = np.array(values[0], np.int64).reshape(4, 4)
    for value in values[1:]:
        total = times(total, np.array(value, np.int64).reshape(4, 4))
    return total.ravel().tolist()


def _forward(entry: list[int], value: list[int]) -> list[int]:
    matrix = np.array(value, np.int64).reshape(4, 4)
    return np.minimum((np.array(entry, np.int64)[:, None] + matrix).min(axis=0), FAR).tolist()


def _compose(values: list[list[int]]) -> list[int]:
    total = list(range(4))
    for value in values:
        total = [value[state] for state in total]
    return total


def repair(turns: DataFrame, run: int = RUN) -> DataFrame:
    """conv_id, seq, turn, role, action, cost, text and rendered for `turns` (conv_id, turn, role, text).

    `seq` orders a conversation's rows; `turn` is null for inserted turns. `cost` is what the row costs.
    """
    chosen = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _role().alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    placed = _numbered(chosen, run)
    turn = F.struct("place", "turn", F.coalesce("role", F.lit("")).alias("role"))
    runs = written(placed.groupBy("conv_id", "run").agg(F.array_sort(F.collect_list(turn)).alias("held")), "turn-runs")
    roles = runs.select("conv_id", "run", F.col("held.role").alias("roles"))

    def matrices(batches):
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.record_batch([pa.array([r["conv_id"] for r in rows], pa.int64()), pa.array([r["run"] for r in rows], pa.int64()),
                                   pa.array([run_matrix(r["roles"]).ravel().tolist() for r in rows], pa.list_(pa.int64()))], names=["conv_id", "run", "value"])

    costs = written(roles.mapInArrow(matrices, "conv_id long, run long, value array<long>"), "run-costs")
    entries = written(_scan(costs, _product, _forward, [0, FAR, FAR, FAR]), "run-entries")
    last = costs.groupBy("conv_id").agg(F.max("run").alias("last")).withColumnRenamed("conv_id", "of")
    entered = _with(roles, entries, "entry").join(last, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")

    def returns(batches):
        """For each run, counted from the end, the state before it by the state behind it; run 0 is the end itself."""
        for batch in batches:
            ids, numbers, maps = [], [], []
            for row in batch.to_pylist():
                held = walk(row["roles"], np.array(row["entry"], np.int64))
                ids.append(row["conv_id"])
                numbers.append(row["last"] - row["run"] + 1)
                maps.append([0, *(path(row["roles"], held, state)[0] for state in (SYSTEM, USER, ASSISTANT))])
                if row["run"] == row["last"]:
                    ids.append(row["conv_id"])
                    numbers.append(0)
                    maps.append([last_state(held[-1])] * 4)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(numbers, pa.int64()), pa.array(maps, pa.list_(pa.int64()))], names=["conv_id", "run", "value"])

    back = written(entered.mapInArrow(returns, "conv_id long, run long, value array<long>"), "run-returns")
    exits = _scan(back, _compose, lambda entry, value: [value[entry[0]]], [0]).where("run > 0").join(last, F.col("conv_id").eqNullSafe(F.col("of")))
    exits = exits.select("conv_id", (F.col("last") - F.col("run") + 1).alias("run"), F.col("entry")[0].alias("exit"), (F.col("run") == 1).alias("final"))

    def render(batches):
        for batch in batches:
            for place in range(batch.num_rows):
                yield pa.RecordBatch.from_pylist(rendered(*(batch.column(c)[place].as_py() for c in ("conv_id", "held", "entry", "exit", "final"))), REPAIRED)

    schema = "conv_id long, seq long, place long, turn long, role string, action string, cost int, lead string, tail string"
    repaired = _with(_with(runs, entries, "entry"), exits, "exit", "final").select("conv_id", "held", "entry", "exit", "final").mapInArrow(render, schema)
    texts = placed.select(F.col("conv_id").alias("of"), F.col("place").alias("spot"), "text")
    both = repaired.join(texts, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("place") == F.col("spot")), "left")
    text = F.coalesce("text", F.lit(""))  # an inserted turn has none
    return both.select("conv_id", "seq", "turn", "role", "action", "cost", text.alias("text"), F.concat("lead", text, "tail").alias("rendered"))


def rendered(conv_id: int | None, held: list[dict], entry: list[int], state: int, final: bool) -> list[dict]:
    """The rows of one run of turns that is entered at the costs `entry` and left in `state`, with what stands before and behind their texts."""
    roles = [h["role"] for h in held]
    _, taken = path(roles, walk(roles, np.array(entry, np.int64)), state)
    out = []

    def add(seq: int, turn: dict | None, role: int, action: str, cost: int, lead: str) -> None:
        place, number = (turn["place"], turn["turn"]) if turn else (-1 - seq, None)  # no turn's, and spread like those of turns
        out.append({"conv_id": conv_id, "seq": seq, "place": place, "turn": number, "role": ROLES[role - 1], "action": action, "cost": cost, "lead": lead, "tail": ""})

    def opened(role: int, follows: bool) -> str:
        return (TAIL if follows else "") + HEAD.format(role=ROLES[role - 1])

    for h, (before, after, cost, inserted, merged) in zip(held, taken, strict=True):
        for number, role in enumerate(inserted):
            add(h["place"] * 4 + number, None, role, "insert", INSERT, opened(role, before != START or number > 0))
        same = h["role"] == ROLES[after - 1]
        action = ("merge" if same else "relabel and merge") if merged else "keep" if same else "relabel"
        lead = JOINT if merged else opened(after, before != START or bool(inserted))
        add(h["place"] * 4 + 2, h, after, action, cost - INSERT * len(inserted), lead)
    if final:
        for number, role in enumerate(closing(state)[1]):
            add((held[-1]["place"] + 1) * 4 + number, None, role, "insert", INSERT, opened(role, True))
        out[-1]["tail"] = TAIL
    return out


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, repaired and rendered."""
    return repair(table(spark, sf_dir, "conversations"))
