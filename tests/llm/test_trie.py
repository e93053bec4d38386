"""The prefix trie against a brute-force one, on odd conversations."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from dubsar.llm import trie

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def _conversations(rows: list[tuple]) -> dict[int, list[tuple[str, str]]]:
    by: dict[int, list] = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            by.setdefault(conv, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), role, text))
    return {c: [r[3:] for r in sorted(t)] for c, t in by.items()}


def _rebuilt(by: dict[int, list]) -> dict[int, list]:
    out = {}
    for c, own in by.items():
        h = zlib.crc32(str(c).encode()) % 4
        first = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = by.get(first, [])[:h] + own[h:]
    return out


def _nodes(by: dict[int, list]) -> set[tuple]:
    members: dict[tuple, list[int]] = {}
    for c, turns in by.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    below = {p: [q for q in members if q[: len(p)] == p] for p in members}
    kids = {p: [q for q in members if len(q) == len(p) + 1 and q[:-1] == p] for p in members}
    words = {p: len(WORDS.findall(p[-1][1])) if p else 0 for p in members}
    out = set()
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(by[c]) == len(p)))
        saved = sum((len(members[q]) - 1) * words[q] for q in below[p])
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), sum(not kids[q] for q in below[p]), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, depth string, n_convs int"


def _rows() -> list[tuple]:
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a b", "c", None, "", "x y  z"])) for c in (*range(-3, 45), 5000, 2**40 + 7) for t in range(rng.randint(1, 6))]
    rows += [(60, t, "user", f"turn {t % 3}") for t in range(70)] + [(61, t, "user", f"turn {t % 3}") for t in range(75)]
    rows += [(80, None, "user", "no turn"), (80, None, "user", "no turn"), (80, 1, "b", "tie"), (80, 1, "a", "tie"), (None, 0, "user", "nobody's")]
    return rows + [(c, 0, "user", "alone") for c in range(101, 120)] + [(c, t, "user", "copy") for c in range(200, 240) for t in range(3)]


def test_trie_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 16)
    monkeypatch.setattr(trie, "CHUNK_BITS", 3)
    rows = _rows()
    given = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    turns, sizes = trie.placed(given)
    plain = trie.prefix_trie(turns, sizes)
    assert plain.columns == COLUMNS
    by = _conversations(rows)
    assert {tuple(r) for r in plain.collect()} == _nodes(by)
    got = [tuple(r) for r in trie.prefix_trie(*trie.rebuilt(turns, sizes)).collect()]
    want = _nodes(_rebuilt(by))
    assert len(got) == len(want) and set(got) == want
    assert any(not t for t in _rebuilt(by).values()), "a turnless conversation is among them"


def test_no_conversations(spark):
    turns, sizes = trie.placed(spark.createDataFrame([], SCHEMA))
    assert trie.prefix_trie(*trie.rebuilt(turns, sizes)).collect() == []


@pytest.mark.parametrize("length", [1, 2, 31])
def test_equal_conversations_share_every_node(spark, length):
    text = "long " * 30_000
    given = spark.createDataFrame([(c, t, "user", text if t == 0 else str(t)) for c in (7, 9) for t in range(length)], "conv_id long, turn long, role string, text string")
    got = trie.prefix_trie(*trie.placed(given)).collect()
    assert len(got) == length + 1 and all(r["n_convs"] == 2 and r["conv_id"] == 7 and r["n_leaves"] == 1 for r in got)
    assert {r["saved_tokens"] for r in got if r["depth"] == 0} == {30_000 + length - 1}
