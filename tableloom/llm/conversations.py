"""Repair of conversation structure at least cost, with the least list of edits among the cheapest.

A conversation is well formed when its role initials read ``(s?(ua)+)?``. Four states say what came last (nothing, s, u,
a). Rows are kept, given another role or deleted, empty rows are inserted; every edit is an arc between nodes (rows
passed, state) and has a letter. A cost pass from the end gives every node its cheapest rest. On the arcs that lie on
cheapest paths, nodes are ranked by their audits (the letters to the end) of length one, two, four and so on: the rank
of twice the length is the pair of the node's own rank and that of the node its doubled pointer names. Ranks choose each
node's arc, and doubled pointers lay out the least path of all conversations of a batch at once.

Rows are range-partitioned by conversation, turn, role and text, so no conversation has to fit a task. Conversations
inside one partition are repaired there. Those at a partition's edges may go on in the next: each part is reduced to a
4 x 4 table of least costs from state to state, the parts' tables and then their exit states are combined, and only the
text that a digest needs in order passes one task as a stream.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tableloom.llm.common import named
from tableloom.session import materialise

DELETE, INSERT, KEEP, REROLE = range(4)
LETTERS = b"DIKR"  # in the order that breaks ties
COSTS = (4, 3, 0, 3)
TRUNCATED_COST = 3
#: States: nothing yet, after s, after u, after a. Initials: s, u, a, any other.
STATES, NOWHERE = 4, -1
AFTER_KEEP = np.array([[1, NOWHERE, NOWHERE, NOWHERE], [2, 2, NOWHERE, 2], [NOWHERE, NOWHERE, 3, NOWHERE], [NOWHERE] * 4])
AFTER_NEW = np.array([2, 2, 3, 2])
NEW_ROLE = {2: "user", 3: "assistant"}
FAR = 1 << 40
END = np.array([0, FAR, FAR, 0])
BLANKS = " \t\n\x0b\f\r"
PARTITION_ROWS = 32_768
#: Whole conversations repaired in one go hold about so many rows.
ROWS_AT_ONCE = 8_192


# -- the path search, for many conversations at once --------------------------------


@dataclass
class Graph:
    """Nodes of rows laid end to end: conversation k has its positions from ``base[k]`` on, one more than its rows."""

    base: np.ndarray
    costs: np.ndarray  # per node
    letter: np.ndarray  # of each node's arc on its least path; -1 where the path ends
    target: np.ndarray


def cheapest(initial: np.ndarray, must: np.ndarray, cut: np.ndarray, sizes: np.ndarray, exits: np.ndarray, last: np.ndarray):
    """Least cost from every node. ``exits`` are the costs still to come from each state after the last row; rows may be
    inserted there only by the ``last`` part of a conversation, so that every insertion has one place."""
    base = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    costs = np.full((int((sizes + 1).sum()), STATES), FAR, dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    lengths = sizes[order]
    for step in range(int(sizes.max(initial=0)) + 1):
        active = order[: np.searchsorted(-lengths, -step, side="right")]
        at = base[active] + sizes[active] - step
        if step == 0:
            here = exits[active].copy()
            closing = last[active]
        else:
            row = first[active] + sizes[active] - step
            rest = costs[at + 1]
            after = AFTER_KEEP[initial[row]]
            kept = np.where(after == NOWHERE, FAR, np.take_along_axis(rest, np.maximum(after, 0), axis=1))
            stays = np.minimum(kept, rest[:, AFTER_NEW] + COSTS[REROLE]) + TRUNCATED_COST * cut[row, None]
            here = np.minimum(rest + COSTS[DELETE], np.where(must[row, None], FAR, stays))
            closing = np.ones(len(active), dtype=bool)
        for _ in range(STATES - 1):  # insertions lead on from state to state
            inserted = np.where(closing[:, None], here[:, AFTER_NEW] + COSTS[INSERT], FAR)
            here = np.minimum(here, inserted)
        costs[at] = np.minimum(here, FAR)
    return base, first, costs


def least_paths(initial, must, cut, sizes, exits, last) -> tuple[Graph, list[np.ndarray]]:
    """The graph and its doubled pointers."""
    base, first, costs = cheapest(initial, must, cut, sizes, exits, last)
    positions, n = len(costs), len(costs) * STATES
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    at_end = np.zeros(positions, dtype=bool)
    at_end[base + sizes] = True
    row = np.minimum(np.arange(positions) - owner, max(len(initial) - 1, 0))  # an end position has one row less before it
    if len(initial):
        kind, blocked, extra = initial[row], must[row], TRUNCATED_COST * cut[row]
    else:
        kind, blocked, extra = (np.zeros(positions, dtype=np.int64) for _ in range(3))
    state = np.arange(STATES)[None, :]
    here = np.arange(positions)[:, None]
    flat = costs.ravel()
    onward = np.where(at_end, 0, 1)[:, None]
    keep = AFTER_KEEP[kind]
    targets = np.stack([
        (here + onward) * STATES + state, here * STATES + AFTER_NEW[None, :],
        (here + onward) * STATES + np.maximum(keep, 0), (here + onward) * STATES + AFTER_NEW[None, :],
    ])
    arc_costs = np.stack([
        np.full((positions, STATES), COSTS[DELETE]), np.full((positions, STATES), COSTS[INSERT]),
        np.repeat(extra[:, None], STATES, axis=1) + COSTS[KEEP], np.repeat(extra[:, None], STATES, axis=1) + COSTS[REROLE],
    ])
    open_end = (at_end & ~last[owner])[:, None]
    allowed = np.stack([
        np.broadcast_to(~at_end[:, None], costs.shape), np.broadcast_to(~open_end, costs.shape),
        ~at_end[:, None] & (keep != NOWHERE) & (blocked == 0)[:, None],
        np.broadcast_to((~at_end & (blocked == 0))[:, None], costs.shape),
    ])
    best = allowed & (flat[targets] + arc_costs == costs[None]) & (costs[None] < FAR)
    ends = at_end[:, None] & (costs == exits[owner])
    best = (best & ~ends[None]).reshape(4, n)
    targets = targets.reshape(4, n)

    rank = np.where(best.any(axis=0), best.argmax(axis=0) + 1, 0)  # audits of length one; 0 where the audit is over
    pointer = np.where(rank > 0, targets[np.maximum(rank - 1, 0), np.arange(n)], np.arange(n))
    doubled = [pointer]
    while True:
        longer = np.unique(rank * (int(rank.max(initial=0)) + 1) + rank[doubled[-1]], return_inverse=True)[1]
        if np.array_equal(doubled[-1], doubled[-1][doubled[-1]]):
            break
        rank = longer
        doubled.append(doubled[-1][doubled[-1]])
    # the arc of least letter and, behind it, least audit
    width = int(rank.max(initial=0)) + 1
    keys = np.where(best, np.arange(4)[:, None] * width + rank[targets], 4 * width)
    choice = keys.argmin(axis=0)
    letter = np.where(best.any(axis=0), choice, -1)
    doubled[0] = np.where(letter >= 0, targets[choice, np.arange(n)], np.arange(n))
    for i in range(1, len(doubled)):
        doubled[i] = doubled[i - 1][doubled[i - 1]]
    return Graph(base, flat, letter, doubled[0]), doubled


def laid_out(starts: np.ndarray, sizes: np.ndarray, doubled: list[np.ndarray], letter: np.ndarray) -> list[np.ndarray]:
    """Nodes of the least path from each start, as long as it has letters."""
    paths: list[np.ndarray] = [np.empty(0, dtype=np.int64)] * len(starts)
    classes = np.ceil(np.log2(sizes + 1)).astype(int)  # conversations of like length together
    for c in np.unique(classes):
        some = np.flatnonzero(classes == c)
        nodes = starts[some][:, None]
        for pointer in doubled:
            if (letter[nodes[:, -1]] < 0).all():
                break
            nodes = np.hstack([nodes, pointer[nodes]])
        for k, path in zip(some.tolist(), nodes):
            paths[k] = path[: np.count_nonzero(letter[path] >= 0) + 1]
    return paths


def audit_of(path: np.ndarray, letter: np.ndarray) -> str:
    return bytes(LETTERS[i] for i in letter[path[:-1]].tolist()).decode()


def repaired(audit: str, state: int, roles: list[str], texts: list[str]) -> Iterator[tuple[str, str]]:
    """The rows that an audit leaves, from the state before it."""
    at = 0
    for letter in audit:
        if letter == "I":
            state = int(AFTER_NEW[state])
            yield NEW_ROLE[state], ""
            continue
        if letter == "R":
            state = int(AFTER_NEW[state])
            yield NEW_ROLE[state], texts[at]
        elif letter == "K":
            state = int(AFTER_KEEP[initial_of(roles[at])][state])
            yield roles[at], texts[at]
        at += 1


def initial_of(role: str) -> int:
    return "sua".find(role[0]) % 4 if role else 3


LEGAL = {"su", "ua", "au"}


def faults(roles: list[str], texts: list[str], seen: set) -> tuple[list[int], list[int], list[int], list[int]]:
    """Initials, what must go, what is truncated, and (blank, duplicate, truncated) counts; ``seen`` holds and takes
    the pairs of role and text that came earlier."""
    initial, must, cut, counts = [], [], [], [0, 0, 0]
    for pair in zip(roles, texts):
        role, text = pair
        bare = text.rstrip(BLANKS)
        fault = 0 if not bare else 1 if pair in seen else 2 if bare[-1] not in ".!?" else None
        seen.add(pair)
        if fault is not None:
            counts[fault] += 1
        initial.append(initial_of(role))
        must.append(int(fault in (0, 1)))
        cut.append(int(fault == 2))
    return initial, must, cut, counts


def gaps_of(turns: list) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def illegal_of(roles: list[str]) -> int:
    return sum(a[:1] + b[:1] not in LEGAL for a, b in zip(roles, roles[1:]))


RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair(conversations: list[tuple[list, list[str], list[str]]]) -> list[tuple]:
    """One result per whole conversation, given as (turns, roles, texts) in order."""
    initial, must, cut, counted = [], [], [], []
    for _, roles, texts in conversations:
        a, b, c, counts = faults(roles, texts, set())
        initial += a
        must += b
        cut += c
        counted.append(counts)
    sizes = np.array([len(t) for t, _, _ in conversations], dtype=np.int64)
    k = len(sizes)
    graph, doubled = least_paths(
        np.array(initial, dtype=np.int64), np.array(must, dtype=np.int64), np.array(cut, dtype=np.int64), sizes,
        np.tile(END, (k, 1)), np.ones(k, dtype=bool),
    )
    starts = graph.base * STATES
    out = []
    for (turns, roles, texts), start, counts, path in zip(
        conversations, starts.tolist(), counted, laid_out(starts, sizes, doubled, graph.letter)
    ):
        audit = audit_of(path, graph.letter)
        text = "\n".join(f"{r}:{t}" for r, t in repaired(audit, 0, roles, texts))
        digest = hashlib.sha256(text.encode()).hexdigest()
        out.append((gaps_of(turns), *counts, illegal_of(roles), int(graph.costs[start]), audit, digest))
    return out


# -- damage, as a test bed -------------------------------------------------------------


def damaged(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, turn, role, text, gone): rows damaged by crc32 of ``key:turn``, modulo 20: 0 drops the row (it stays here,
    marked ``gone``), 1 empties its text, 2 takes its ``.!?`` out, 3 repeats it, 4 makes its role user. Null roles, texts,
    keys and turns count as one space where a string is made of them; null keys and turns stay null."""

    def shown(name: str) -> Column:
        return F.coalesce(named(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(shown(key), F.lit(":"), shown(turn)).cast("binary")) % 20
    words = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(shown(text), ".!?", "")).otherwise(shown(text))
    rows = df.select(
        named(key).alias("key"), named(turn).cast("bigint").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(shown(role)).alias("role"), words.alias("text"),
        (kind == 0).alias("gone"), kind.alias("kind"),
    )
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.withColumn("copy", copies).drop("kind", "copy")


# -- over all rows ------------------------------------------------------------------------


def repair_all(rows: DataFrame, partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """(key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every key of ``rows``.

    ``rows`` has key, turn, role, text (no nulls in the last two) and ``gone``: rows that only tell that their key
    exists. Order within a conversation: turn (nulls first), role, text. A null key is a conversation. Keys without any
    other row get zeros, an empty audit and the digest of the empty text. An empty table gives no rows.
    """
    partitions = max(1, math.ceil(rows.count() / partition_rows))
    start = F.substring("text", 1, 32)  # keeps the range bounds small
    order = [F.asc_nulls_first("key"), F.asc_nulls_first("turn"), F.col("role"), F.col("text")]
    ranged = (
        rows.select("key", "turn", "role", "text", "gone")
        .repartitionByRange(partitions, order[0], order[1], F.col("role"), start)
        .sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id())
    )
    kind = rows.schema["key"].dataType.simpleString()
    columns = ["key", *NUMBERS, "audit", "repaired_sha256", "part", "pos", "turn", "role", "text", "gone"]
    schema = f"key {kind}, {RESULT}, part int, pos bigint, turn bigint, role string, text string, gone boolean"
    types = [
        to_arrow_type(rows.schema["key"].dataType), *[pa.int64()] * len(NUMBERS), pa.string(), pa.string(), pa.int32(),
        pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(),
    ]

    def batch_of(made: list[tuple]) -> pa.RecordBatch:
        arrays = [pa.array(v, t) for v, t in zip(zip(*made), types)] if made else [pa.array([], t) for t in types]
        return pa.RecordBatch.from_arrays(arrays, names=columns)

    def finished(found: list[tuple]) -> pa.RecordBatch:
        """Whole conversations: (key, rows that are there)."""
        results = repair([([r[0] for r in run], [r[1] for r in run], [r[2] for r in run]) for _, run in found])
        return batch_of([(key, *result, *[None] * 6) for (key, _), result in zip(found, results)])

    def edge(key, run: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Rows of a conversation that may go on in another partition."""
        for at in range(0, len(run), ROWS_AT_ONCE):
            yield batch_of([(key, *[None] * 8, *r) for r in run[at : at + ROWS_AT_ONCE]])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: list[tuple] = []
        held = 0
        now, run, runs = None, [], 0
        position = 0
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for key, *row in zip(keys, *(batch.column(i).to_pylist() for i in range(1, 6))):
                if runs == 0 or key != now:
                    if runs == 1:
                        yield from edge(now, run)
                    elif runs > 1:
                        whole.append((now, [(t, r, x) for _, _, t, r, x, gone in run if not gone]))
                        held += len(run)
                    now, run, runs = key, [], runs + 1
                    if held >= ROWS_AT_ONCE:
                        yield finished(whole)
                        whole, held = [], 0
                turn, role, text, gone, part = row
                run.append((part, position, turn, role, text, gone))
                position += 1
        if runs:
            yield from edge(now, run)
        if whole:
            yield finished(whole)

    stored = materialise(ranged.mapInArrow(split, schema))
    done = stored.filter(F.col("part").isNull()).select("key", *NUMBERS, "audit", "repaired_sha256")
    parts = stored.filter(F.col("part").isNotNull()).select("key", "part", "pos", "turn", "role", "text", "gone")
    return done.unionByName(_across(parts, kind))


def _across(rows: DataFrame, kind: str) -> DataFrame:
    """Results of conversations whose rows lie in several parts, each part of bounded size."""
    # a pair of role and text was seen earlier if an earlier part has it: one row per part and pair
    pair = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))
    pairs = materialise(rows.filter(~F.col("gone")).select("key", "part", pair.alias("pair")).distinct())
    opening = pairs.groupBy(F.col("key").alias("k"), F.col("pair").alias("p")).agg(F.min("part").alias("first"))
    known = pairs.join(opening, F.col("key").eqNullSafe(F.col("k")) & (F.col("pair") == F.col("p"))).filter(
        F.col("part") > F.col("first")
    )
    fields = (
        f"key {kind}, part int, codes binary, through array<bigint>, blank bigint, duplicate bigint, truncated bigint,"
        " illegal bigint, first_role string, last_role string, low bigint, high bigint, turns bigint"
    )

    def summary(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """One row per part: its rows as codes, least costs from state to state, counts, and what its borders need."""
        empty = pd.DataFrame({n.split()[0]: [] for n in fields.split(", ")})
        if left.empty:
            return empty
        left = left.sort_values("pos")
        here = left[~left["gone"].astype(bool)]
        earlier = set(right["pair"])
        roles, texts, seen = here["role"].tolist(), here["text"].tolist(), set()
        for r, t in zip(roles, texts):
            if hashlib.md5(f"{len(r)}:{r}{t}".encode()).hexdigest() in earlier:
                seen.add((r, t))
        initial, must, cut, counts = faults(roles, texts, seen)
        codes = bytes(i + 4 * m + 8 * c for i, m, c in zip(initial, must, cut))
        through = [costs_through(codes, exit) for exit in range(STATES)]  # [exit][entry]
        turns = {int(t) for t in here["turn"].dropna()}
        return pd.DataFrame({
            "key": left["key"].iloc[:1].to_list(), "part": left["part"].iloc[:1].to_list(), "codes": [codes],
            "through": [[through[x][e] for e in range(STATES) for x in range(STATES)]],
            "blank": [counts[0]], "duplicate": [counts[1]], "truncated": [counts[2]], "illegal": [illegal_of(roles)],
            "first_role": [roles[0][:1] if roles else None], "last_role": [roles[-1][:1] if roles else None],
            "low": [min(turns, default=None)], "high": [max(turns, default=None)], "turns": [len(turns)],
        }).astype({"low": "Int64", "high": "Int64"})

    summaries = materialise(
        # turns as text: pandas has no nulls among integers
        rows.withColumn("turn", F.col("turn").cast("string")).groupBy("key", "part").cogroup(known.select("key", "part", "pair").groupBy("key", "part")).applyInPandas(summary, fields)
    )

    def exits_of(group: pd.DataFrame) -> pd.DataFrame:
        """One conversation, a row of 16 numbers per part: costs still to come after each part."""
        group = group.sort_values("part", ignore_index=True)
        exits, rest = [None] * len(group), END
        for i in range(len(group) - 1, -1, -1):
            exits[i] = [int(v) for v in rest]
            table = np.array(group["through"].iloc[i], dtype=np.int64).reshape(STATES, STATES)  # [entry][exit]
            if i == len(group) - 1:  # the last part may insert at its end
                rest = closed(rest)
                exits[i] = [int(v) for v in END]
            rest = np.minimum((table + rest[None, :]).min(axis=1), FAR)
        out = group[["key", "part"]].copy()
        out["exits"], out["last"] = exits, [i == len(group) - 1 for i in range(len(group))]
        return out

    exits = summaries.select("key", "part", "through").groupBy("key").applyInPandas(
        exits_of, f"key {kind}, part int, exits array<bigint>, last boolean"
    )
    joined = summaries.alias("s").join(exits.alias("e"), F.expr("s.key <=> e.key AND s.part = e.part")).select(
        "s.key", "s.part", "codes", "exits", "last"
    )

    def walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For every part and entry state: cost, least audit and exit state."""
        for batch in batches:
            made = [walk(bytes(c), np.array(x), bool(last)) for c, x, last in zip(batch["codes"], batch["exits"], batch["last"])]
            yield batch[["key", "part"]].assign(
                costs=[[m[0] for m in ms] for ms in made], audits=[[m[1] for m in ms] for ms in made],
                states=[[m[2] for m in ms] for ms in made],
            )

    walks = materialise(
        joined.mapInPandas(walked, f"key {kind}, part int, costs array<bigint>, audits array<string>, states array<int>")
    )

    def entries_of(group: pd.DataFrame) -> pd.DataFrame:
        """One conversation, a row of small numbers per part: the state in which its least path enters each part."""
        group = group.sort_values("part", ignore_index=True)
        state, entry = 0, []
        for states in group["states"]:
            entry.append(state)
            state = int(states[state])
        return group[["key", "part"]].assign(entry=entry)

    entries = walks.select("key", "part", "states").groupBy("key").applyInPandas(
        entries_of, f"key {kind}, part int, entry int"
    )
    at = F.col("entry") + 1
    chosen = materialise(
        walks.alias("w").join(entries.alias("e"), F.expr("w.key <=> e.key AND w.part = e.part")).select(
            "w.key", "w.part", "entry", F.element_at("audits", at).alias("audit"), F.element_at("costs", at).alias("cost")
        )
    )
    counted = summaries.alias("s").join(chosen.alias("c"), F.expr("s.key <=> c.key AND s.part = c.part")).select(
        "s.key", "s.part", "audit", "cost", "blank", "duplicate", "truncated", "illegal", "first_role", "last_role",
        "low", "high", "turns",
    )
    ordered = counted.groupBy("key").agg(
        F.sum("blank").alias("blank"), F.sum("duplicate").alias("duplicate"), F.sum("truncated").alias("truncated"),
        F.sum("illegal").alias("inside"), F.min_by("cost", "part").alias("cost"), F.sum("turns").alias("turns"),
        F.min("low").alias("low"), F.max("high").alias("high"),
        # one short entry per part of the conversation
        F.array_sort(F.collect_list(F.struct("part", "audit"))).alias("audits"),
        F.array_sort(F.collect_list(F.when(F.col("first_role").isNotNull(), F.struct("part", "first_role", "last_role")))).alias("roles"),
        F.array_sort(F.collect_list(F.when(F.col("low").isNotNull(), F.struct("part", "low", "high")))).alias("spans"),
    )
    legal = [F.lit(p) for p in sorted(LEGAL)]
    borders = F.expr("transform(sequence(1, greatest(size(roles) - 1, 1)), i -> concat(try_element_at(roles, i).last_role, "
                     "coalesce(try_element_at(roles, i + 1).first_role, '')))")  # fmt: skip
    shared = F.expr("size(filter(sequence(1, greatest(size(spans) - 1, 1)), i -> i < size(spans) AND "
                    "try_element_at(spans, i).high = try_element_at(spans, i + 1).low))")  # fmt: skip
    crossing = F.when(F.size("roles") > 1, F.size(F.filter(borders, lambda p: ~p.isin(*legal)))).otherwise(0)
    facts = ordered.select(
        "key",
        F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns") + F.when(F.size("spans") > 1, shared).otherwise(0), F.lit(0)).cast("bigint").alias("gaps"),
        "blank", "duplicate", "truncated", (F.col("inside") + crossing).cast("bigint").alias("illegal"), "cost",
        F.expr("array_join(transform(audits, a -> a.audit), '')").alias("audit"),
    )
    plans = chosen.select("key", "part", F.lit(-1).cast("bigint").alias("pos"), F.col("entry").cast("string").alias("role"), F.col("audit").alias("text"))
    texts = rows.filter(~F.col("gone")).select("key", "part", "pos", "role", "text")
    stream = plans.unionByName(texts).repartition("key").sortWithinPartitions(F.asc_nulls_first("key"), "part", "pos")

    key_type = to_arrow_type(rows.schema["key"].dataType)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One pass in order; of a conversation only the digest and the current part's audit are held."""
        now, digest, empty, seen = None, None, True, False
        keys, values = [], []
        audit, place, state = "", 0, 0

        def add(role: str, text: str) -> None:
            nonlocal empty
            digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
            empty = False

        def inserted(ending: bool = False) -> None:
            """Insertions in front of the next row, or after the last."""
            nonlocal place, state
            while place < len(audit) and audit[place] == "I":
                state = int(AFTER_NEW[state])
                add(NEW_ROLE[state], "")
                place += 1

        for batch in batches:
            for key, pos, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4))):
                if not seen or key != now:
                    if seen:
                        inserted()
                        keys.append(now)
                        values.append(digest.hexdigest())
                    now, digest, empty, seen, audit, place = key, hashlib.sha256(), True, True, "", 0
                if pos < 0:
                    inserted()  # what the part before inserts at its end
                    audit, place, state = text, 0, int(role)
                    continue
                inserted()
                for left_role, left_text in repaired(audit[place], state, [role], [text]):
                    add(left_role, left_text)
                    state = int(AFTER_NEW[state]) if audit[place] == "R" else int(AFTER_KEEP[initial_of(role)][state])
                place += 1
        if seen:
            inserted()
            keys.append(now)
            values.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.array(values, pa.string())], names=["key", "repaired_sha256"])

    hashed = stream.mapInArrow(digests, f"key {kind}, repaired_sha256 string")
    return facts.alias("f").join(hashed.alias("h"), F.expr("f.key <=> h.key")).select(
        "f.key", *NUMBERS, "audit", "repaired_sha256"
    )


def closed(costs: np.ndarray) -> np.ndarray:
    """Costs from each state when rows may be inserted first."""
    for _ in range(STATES - 1):
        costs = np.minimum(costs, costs[AFTER_NEW] + COSTS[INSERT])
    return costs


def decoded(codes: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes = np.frombuffer(codes, dtype=np.uint8).astype(np.int64)
    return codes & 3, (codes >> 2) & 1, codes >> 3


def costs_through(codes: bytes, exit: int) -> list[int]:
    """Least cost from every entry state to one exit state of a part."""
    initial, must, cut = decoded(codes)
    exits = np.full((1, STATES), FAR)
    exits[0, exit] = 0
    base, _, costs = cheapest(initial, must, cut, np.array([len(codes)]), exits, np.zeros(1, dtype=bool))
    return costs[0].tolist()


def walk(codes: bytes, exits: np.ndarray, last: bool) -> list[tuple[int, str, int]]:
    """Cost, least audit and exit state for every entry state of a part."""
    initial, must, cut = decoded(codes)
    size = np.array([len(codes)])
    graph, doubled = least_paths(initial, must, cut, size, exits[None, :], np.array([last]))
    out = []
    for entry in range(STATES):
        if graph.costs[entry] >= FAR:
            out.append((FAR, "", entry))
            continue
        path = laid_out(np.array([entry]), size, doubled, graph.letter)[0]
        out.append((int(graph.costs[entry]), audit_of(path, graph.letter), int(path[-1]) % STATES))
    return out
