"""A small table of awkward documents, and plain versions of the operators to hold against."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import xxhash

from pyspark.sql import DataFrame, SparkSession

#: Names that operators use inside or return, as extra columns of the input.
CLASHING = ("size", "shard", "slot", "target", "fp", "n_words", "kept", "spans", "items", "key", "line", "a", "n", "copies", "at", "value", "p_keep")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)

_rng = random.Random(5)
VOCABULARY = ["".join(_rng.choice("abcdeé") for _ in range(_rng.randint(2, 7))) for _ in range(400)]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(VOCABULARY) + ("\n" if rng.random() < 0.05 else "") for _ in range(n))


def texts() -> list[tuple[int | None, str | None, str | None]]:
    """(doc_id, text, source) with nulls, blanks, copies, near copies, shared passages and long texts."""
    rng = random.Random(3)
    base = [prose(rng, rng.choice((1, 2, 10, 34, 35, 36, 80, 200))) for _ in range(40)]
    passage, long = prose(rng, 60), prose(rng, 6000)
    rows: list[tuple[int | None, str | None, str | None]] = [(i, t, f"s{i % 5}") for i, t in enumerate(base)]
    rows += [(100 + i, base[i % 3 + 5], "hot") for i in range(25)]
    rows += [(200 + i, base[6] + " " + rng.choice(VOCABULARY) * (i % 3), "hot") for i in range(12)]
    rows += [(300 + i, f"{prose(rng, 20)} {passage}\t{prose(rng, 15)}", "s1") for i in range(6)]
    rows += [(400, long, "s2"), (401, long + " tail", None), (402, " ".join(["same"] * 90), "s2"), (403, passage + " " + passage, "s3")]
    rows += [(500, None, "s4"), (501, "", None), (502, " \t\n\x0b\x0c\r ", "empty"), (503, "A", "s1"), (504, "x" * 5000, "s1"), (505, "É 1-2_3 日本語 🙂  nbsp em", "s1")]
    rows += [(None, base[7], "s0"), (None, None, None), (None, prose(rng, 50), "s0"), (506, base[8], "s1"), (506, base[8], "s1"), (-7, prose(rng, 40), "S0")]
    return rows


def table(spark: SparkSession, rows=None) -> DataFrame:
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, "en", s, None, *(["x"] * len(CLASHING))) for i, t, s in rows], SCHEMA).repartition(3)


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_words(text: str | None) -> list[str]:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def counted(rows) -> Counter:
    return Counter(tuple(r) for r in rows)


def roots(n: int, links) -> list[int]:
    """Smallest number of each component."""
    up = list(range(n))

    def find(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def fingerprint(text: str | None) -> int:
    own = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not own:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(own[i : i + 3]).encode(), 42) for i in range(max(1, len(own) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
