"""Repair of conversations against plain versions, on damaged and awkward rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from tidyloom.llm import conversations
from tidyloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
LEGAL = re.compile(r"(s?(ua)+)?\Z")
LEGAL_START = re.compile(r"s?(ua)*u?")


def damage(rows):
    """(conv, turn, role, text) after damage, and all conversations."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """Least (cost, audit, repaired) by relaxing all edits, with whole audits compared, until nothing improves."""
    n = len(rows)
    best = {(n, shape): (0, "", ()) for shape in ("", "ua")}
    edits = defaultdict(list)
    for i in range(n + 1):
        for shape in ("", "s", "u", "ua"):
            places = [("user", "u"), ("assistant", "ua")]
            follows = [(r, new) for r, new in places if LEGAL_START.fullmatch(shape + r[0])]
            edits[i, shape] += [(2, "I", (f"{r}:",), (i, new)) for r, new in follows]
            if i == n:
                continue
            _, _, role, text = rows[i]
            edits[i, shape].append((3, "D", (), (i + 1, shape)))
            if found[i] in ("b", "d"):
                continue
            cut = int(found[i] == "t")
            edits[i, shape] += [(2 + cut, "R", (f"{r}:{text}",), (i + 1, new)) for r, new in follows]
            if role and LEGAL_START.fullmatch(shape + role[0]):
                edits[i, shape].append((cut, "K", (f"{role}:{text}",), (i + 1, {"s": "s", "u": "u", "a": "ua"}[role[0]])))
    changed = True
    while changed:
        changed = False
        for i in range(n, -1, -1):
            for shape in ("", "s", "u", "ua"):
                for cost, letter, kept, to in edits[i, shape]:
                    if to in best:
                        c, audit, rest = best[to]
                        offer = (cost + c, letter + audit, kept + rest)
                        if (i, shape) not in best or offer[:2] < best[i, shape][:2]:
                            best[i, shape] = offer
                            changed = True
    return best[0, ""]


def expected(rows):
    convs = defaultdict(list, {r[0]: [] for r in rows})
    for row in damage(rows):
        convs[row[0]].append(row)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        found = faults(own)
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        cost, audit, kept = cheapest(own, found)
        digest = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        out[conv] = (gaps, *(found.count(f) for f in "bdt"), illegal, cost, audit, digest)
    return out


def odd_rows():
    rng = random.Random(11)
    rows = []
    for conv in range(120):
        size = rng.choice((0, 1, 2, 3, 5, 8))
        for turn in range(size):
            role = rng.choice(("user", "assistant", "system", "user", "assistant", "tool", "", "Übung", None))
            text = rng.choice(("Yes.", "no", "", " \t\n", "Why? ", "a.b", None, "Ünï!", "same.", "x\ny.\n"))
            rows.append((conv, rng.choice((turn, turn, turn, turn + 3, 2, None)), role, text))
    rows += [(None, i, r, "Hm.") for i, r in enumerate(("system", "user", "assistant", "user"))]
    rows += [(None, None, None, None), (-5, None, "user", "Hi!"), (9007199254740993, 9007199254740993, "user", "big."), (9007199254740993, -3, "assistant", "x")]
    rows += [(7, 1, "user", "same.")] * 3
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, conv string, code int, gone string, kind string, nth int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 5, "y", "z", 0) for r in rows], SCHEMA).repartition(3)


def summary(df):
    rows = conversations.summaries(conversations.damaged(df), gone=conversations.F.col("gone")).collect()
    out = {r.conv_id: tuple(r[f] for f in FIELDS) for r in rows}
    assert len(out) == len(rows)
    return out


def test_awkward_conversations(spark):
    rows = odd_rows()
    assert summary(frame(spark, rows)) == expected(rows)


def test_empty_table(spark):
    assert summary(frame(spark, [])) == {}
    assert conversations.repaired(frame(spark, []).drop("gone")).count() == 0


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r[f] for f in FIELDS) for r in QUERIES["op11_conversations"](spark, SF).collect()}
    assert got == expected(rows)


@pytest.mark.parametrize("held", [64, 1 << 24])
def test_giant_conversation_spills_and_streams(spark, held):
    """One conversation of most rows, with files for pointers and messages, gives the repaired rows and their digest."""
    rng = random.Random(2)
    rows = [(1, i, rng.choice(("user", "assistant", "assistant")), rng.choice(("Go.", "well", f"n{i}."))) for i in range(2500)]
    rows += [(2, 0, "user", "Hi."), (2, 1, "assistant", "Ho.")]
    df = frame(spark, rows).drop("gone")
    digests = {r.conv_id: (r.audit, r.repaired_sha256) for r in conversations.summaries(df, held=held).collect()}
    kept = defaultdict(list)
    for r in conversations.repaired(df, held=held).collect():
        kept[r.conv_id].append(r)
    for conv, messages in kept.items():
        messages.sort(key=lambda r: r.position)
        assert [m.position for m in messages] == list(range(len(messages)))
        assert LEGAL.fullmatch("".join(m.role[0] for m in messages))
        audit, digest = digests[conv]
        assert audit.replace("D", "") == "".join(m.edit for m in messages)
        assert hashlib.sha256("\n".join(f"{m.role}:{m.text}" for m in messages).encode()).hexdigest() == digest
    assert digests[2][0] == "KK"


def test_backwards_reads_every_record_last_first():
    for held in (1, 40, 10_000):
        records = [bytes([i]) * (i % 5) for i in range(50)]
        store = conversations.Backwards(held)
        for r in records:
            store.append(r)
        assert list(store) == records[::-1]
        store.close()
