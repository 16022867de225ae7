"""Conversation repair against a search over all edits."""

import hashlib
import heapq
import random
import zlib
from collections import Counter, defaultdict

import pytest

from tonearm.llm import turn_repair

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        named = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        hit, role, text = zlib.crc32(named.encode()) % 20, " " if role is None else role, " " if text is None else text
        if hit == 1:
            text = ""
        if hit == 2:
            text = "".join(c for c in text if c not in ".!?")
        if hit == 4:
            role = "user"
        out += [] if hit == 0 else [(conv, turn, role, text)] * (2 if hit == 3 else 1)
    return out


def cheapest(turns):
    """Least cost, then least audit, by a search over states (place, output so far); also the turns that come out."""
    heap, seen = [(0, "", 0, "e", ())], set()
    while heap:
        cost, audit, k, state, out = heapq.heappop(heap)
        if (k, state) in seen:
            continue
        seen.add((k, state))
        if k == len(turns) and state in "ea":
            return cost, audit, list(out)
        step = lambda c, letter, k2, s2, line=None: heapq.heappush(heap, (c, audit + letter, k2, s2, out + ((line,) if line is not None else ())))  # noqa: B023, E731
        user, assistant = state in "esa", state == "u"
        if user:
            step(cost + 3, "I", k, "u", "user:")
        if assistant:
            step(cost + 3, "I", k, "a", "assistant:")
        if k < len(turns):
            role, text, fault = turns[k]
            step(cost + 4, "D", k + 1, state)
            if fault in ("blank", "duplicate"):
                continue
            more, initial = 3 * (fault == "truncated"), role[:1]
            if initial == "s" and state == "e":
                step(cost + more, "K", k + 1, "s", f"{role}:{text}")
            if initial == "u" and user:
                step(cost + more, "K", k + 1, "u", f"{role}:{text}")
            if initial == "a" and assistant:
                step(cost + more, "K", k + 1, "a", f"{role}:{text}")
            if user:
                step(cost + more + 3, "R", k + 1, "u", f"user:{text}")
            if assistant:
                step(cost + more + 3, "R", k + 1, "a", f"assistant:{text}")


def brute(rows):
    convs = defaultdict(list)
    for row in brute_damage(rows):
        convs[row[0]].append(row)
    out = Counter()
    for conv in {r[0] for r in rows}:
        own = sorted(convs[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
        told, seen = [], set()
        for _, _, role, text in own:
            bare = text.rstrip(SPACE)
            fault = "blank" if not bare.strip(SPACE) else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            told.append((role, text, fault))
        faults = Counter(f for _, _, f in told)
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(told, told[1:]))
        cost, audit, lines = cheapest(told)
        out[conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()] += 1
    return out


def conversations(seed, n, most):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(r.randrange(1, most)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]) if r.random() < 0.5 else ["user", "assistant"][t % 2]
            text = r.choice(["Hello.", "Well!", "what", "Good?\n", "", " \t", None, "é. ", f"No {t}.", f"no {t}"])
            rows.append((None if c == 0 else c, r.choice([None, t, t, t, t, t + 3]), role, text))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, n, most, chunk", [(1, 120, 9, 256), (2, 25, 40, 4), (3, 2, 260, 3)])
def test_equal_to_a_search_over_all_edits(spark, monkeypatch, seed, n, most, chunk):
    monkeypatch.setattr(turn_repair, "CHUNK", chunk)
    monkeypatch.setattr(turn_repair, "WIDTH", 16 if chunk > 4 else 3)
    rows = conversations(seed, n, most)
    got = turn_repair.repaired(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert Counter(map(tuple, got)) == brute(rows)


def test_edges(spark):
    assert turn_repair.repaired(spark.createDataFrame([], SCHEMA)).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = turn_repair.repaired(spark.createDataFrame([(gone, 0, "user", "x.")], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    clash = spark.createDataFrame([(1, 0, "user", "x.", 5, 6, 7)], SCHEMA + ", pos long, part int, at int")
    assert turn_repair.repaired(clash).count() == 1


def test_turns_after_repair(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "user", "Hi."), (1, 2, "user", "Are you there?"), (1, 3, "assistant", "Yes.")]
    told, turns = turn_repair.repair(spark.createDataFrame(rows, SCHEMA), damage=False)
    assert [(r["cost"], r["audit"]) for r in told.collect()] == [(3, "KKIKK")]
    assert [tuple(r)[3:] for r in sorted(turns.collect(), key=lambda r: (r["at"], r["seq"]))] == [("K", "system", "Be brief."), ("K", "user", "Hi."), ("I", "assistant", ""), ("K", "user", "Are you there?"), ("K", "assistant", "Yes.")]
