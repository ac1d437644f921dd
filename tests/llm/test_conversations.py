"""Repair against all edit lists of small conversations, in whole and in parts."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tableloom.llm import conversations as c
from tableloom.llm.queries import op11_conversations

WORD = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    """(conv, turn, role, text) rows after damage, by conversation, and all conversations."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text, kind = " " if role is None else role, " " if text is None else text, zlib.crc32(key.encode()) % 20
        here = out[conv]
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        here += [(turn, role, text)] * (2 if kind == 3 else 1)
    for here in out.values():
        here.sort(key=lambda r: ((0, 0) if r[0] is None else (1, r[0]), r[1].encode(), r[2].encode()))
    return out


def plain(rows):
    """Result of one conversation by the definitions; the audit by comparing whole strings."""
    marks, seen, counts = [], set(), [0, 0, 0]
    for _, role, text in rows:
        last = WORD.findall(text)[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else ""
        seen.add((role, text))
        if fault:
            counts[["blank", "duplicate", "truncated"].index(fault)] += 1
        marks.append((role[:1], fault))

    @cache
    def best(i, done, inserted):
        """(cost, audit) after the role initials ``done`` (their last two and whether any came before)."""
        options = []
        good = done in ("", "ua")
        if i == len(marks) and good:
            options.append((0, ""))

        def onward(initial):
            grown = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "ua"}, "ua": {"u": "u"}}
            return grown[done].get(initial)

        if inserted < 3:
            for role in "ua":
                if onward(role):
                    cost, audit = best(i, onward(role), inserted + 1)
                    options.append((cost + 3, "I" + audit))
        if i < len(marks):
            initial, fault = marks[i]
            cost, audit = best(i + 1, done, 0)
            options.append((cost + 4, "D" + audit))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault else 0
                if onward(initial):
                    cost, audit = best(i + 1, onward(initial), 0)
                    options.append((cost + more, "K" + audit))
                for role in "ua":
                    if onward(role):
                        cost, audit = best(i + 1, onward(role), 0)
                        options.append((cost + more + 3, "R" + audit))
        return min(options) if options else (10**9, "")

    cost, audit = best(0, "", 0)
    kept, at, done = [], 0, ""
    for letter in audit:
        new = "assistant" if done[-1:] == "u" else "user"
        if letter == "I":
            kept.append((new, ""))
        elif letter in "KR":
            kept.append((new if letter == "R" else rows[at][1], rows[at][2]))
        at += letter != "I"
        done = "".join(r[:1] for r, _ in kept)
    assert re.fullmatch(r"(s?(ua)+)?", done)
    turns = {t for t, _, _ in rows if t is not None}
    roles = [r[:1] for _, r, _ in rows]
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts,
        sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])), cost, audit,
        hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest(),
    )


ROLES = ["user", "assistant", "system", "tool", " ", "u"]
TEXTS = ["Fine.", "Good?", "cut off", "", " \t", "Fine. ", "Yes!"]
ROWS = st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 4)), st.sampled_from(ROLES), st.sampled_from(TEXTS)), max_size=9)


@settings(max_examples=400, deadline=None)
@given(st.lists(ROWS, min_size=1, max_size=4))
def test_small_conversations(many):
    got = c.repair([([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]) for rows in many])
    for rows, found in zip(many, got):
        assert tuple(found) == plain(rows)


def test_ranks_and_pointers_on_a_long_conversation():
    rng = random.Random(4)
    rows = [(i, rng.choice(ROLES), rng.choice(TEXTS) + str(i // 2)) for i in range(300)]
    assert tuple(c.repair([([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows])])[0]) == plain_long(rows)


def plain_long(rows):
    import sys

    sys.setrecursionlimit(20_000)
    return plain(rows)


def results(frame):
    return {r.conv_id if "conv_id" in frame.columns else r.key: tuple(r[n] for n in (*c.NUMBERS, "audit", "repaired_sha256")) for r in frame.collect()}


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_by_definition(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/sf{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert results(op11_conversations(spark, f"/root/testdata/sf{sf}")) == {k: plain(v) for k, v in damage(rows).items()}


@pytest.mark.parametrize("partition_rows", [3, 11, 40])
def test_conversations_over_many_parts(spark, partition_rows):
    rng = random.Random(partition_rows)
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([None, *range(30)]), rng.choice([*ROLES, None]), rng.choice([*TEXTS, None]) or None) for _ in range(150)]
    rows += [(50 + i, i, "user", "Once.") for i in range(30)] + [(7, 5, "user", "Same text.")] * 20
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = results(c.repair_all(c.damaged(frame), partition_rows))
    assert got == {k: plain_long(v) for k, v in damage(rows).items()}


def test_odd_tables(spark):
    schema = "conv_id string, turn int, role string, text string, key int, part string, gone string"
    empty = spark.createDataFrame([], schema)
    assert c.repair_all(c.damaged(empty)).count() == 0
    rows = [("a", 1, "user", "x" * 100_000 + ".", 1, "p", "g"), ("a", 2, "assistant", None, 1, "p", "g"), (None, None, None, None, 1, "p", "g")]
    got = results(c.repair_all(c.damaged(spark.createDataFrame(rows, schema))))
    assert got == {k: plain(v) for k, v in damage([r[:4] for r in rows]).items()}
    # a conversation that the damage removes whole
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    one = spark.createDataFrame([(gone, 0, "user", "Hello.")], "conv_id bigint, turn bigint, role string, text string")
    assert results(c.repair_all(c.damaged(one))) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
