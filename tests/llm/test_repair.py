import hashlib
import random
import re
import zlib
from itertools import groupby

import pytest

from tessera.llm import repair

WS = " \t\n\x0b\x0c\r"
LEGAL = re.compile(r"(s?(ua)+)?")


def brute_damage(rows):
    out = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        row = (c, t, "user" if kind == 4 else r, "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x)
        out += [] if kind == 0 else [row, row] if kind == 3 else [row]
    return out


def brute_best(rows, faults):
    """Cheapest (cost, audit, repaired) by search over (row, roles so far), without an automaton of suffixes."""
    n = len(rows)
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    start = {("", ""): (0, [])}
    for k in range(n + 1):
        todo, settled = [(c, audit, last, text) for (last, audit), (c, text) in start.items()], {}
        while todo:
            todo.sort(key=lambda w: w[0])
            c, audit, last, text = todo.pop(0)
            if (last, audit) in settled or sum(a == "I" for a in audit[-3:]) == 3:
                continue
            settled[last, audit] = (c, text)
            for r in "ua":
                if r in follow[last]:
                    todo.append((c + 3, audit + "I", r, [*text, ("user:" if r == "u" else "assistant:")]))
        if k == n:
            break
        start = {}

        def put(last, audit, c, text):
            if (last, audit) not in start or start[last, audit][0] > c:
                start[last, audit] = (c, text)

        role, x = rows[k][2], rows[k][3]
        extra = 3 if faults[k] == "truncated" else 0
        for (last, audit), (c, text) in settled.items():
            put(last, audit + "D", c + 4, text)
            if faults[k] not in ("blank", "duplicate"):
                if role[:1] and role[:1] in follow[last]:
                    put(role[:1], audit + "K", c + extra, [*text, f"{role}:{x}"])
                for r, name in (("u", "user"), ("a", "assistant")):
                    if r in follow[last]:
                        put(r, audit + "R", c + 3 + extra, [*text, f"{name}:{x}"])
        # of ways that end in one role, only the cheapest can go on
        least = {}
        for (last, _), (c, _) in start.items():
            least[last] = min(c, least.get(last, c))
        start = {k2: v for k2, v in start.items() if v[0] == least[k2[0]]}
    ends = [(c, audit, text) for (last, audit), (c, text) in settled.items() if last in ("", "a")]
    return min(ends, key=lambda w: w[:2])


def brute(rows, ids):
    out = []
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2], r[3])
    groups = {c: list(g) for c, g in groupby(sorted(rows, key=key), key=lambda r: r[0])}
    for c in ids:
        g, faults, seen = groups.get(c, []), [], set()
        for _, _, r, x in g:
            end = x.rstrip(WS)
            faults.append("blank" if not end else "duplicate" if (r, x) in seen else "truncated" if end[-1] not in ".!?" else None)
            seen.add((r, x))
        turns = {t for _, t, _, _ in g if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        initials = [r[:1] for _, _, r, _ in g]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit, text = brute_best(g, faults)
        assert LEGAL.fullmatch("".join(t[:1] for t in text))
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out.append((c, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def chats(seed, n=150, most=9):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "system", "tool", "", "s", None]) if rng.random() < 0.4 else ("user", "assistant")[t % 2]
            rows.append((c if c else None, None if rng.random() < 0.05 else t + (t > 4), role, rng.choice(["Yes.", "No!", "open", "", " \n", None, "Éh?\n", "a b. ", "x ", "one.", "two?", f"{c} {t}."])))
    return rows + [rows[0], rows[1], rows[1]]


def answer(spark, rows):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as conv", "1 as pos", "2 as part", "'y' as audit")
    return sorted(map(tuple, repair.repair(frame).select(COLUMNS).collect()), key=repr)


@pytest.mark.parametrize("bits", [8, 1, 0])
def test_matches_brute_force(spark, monkeypatch, bits):
    """Also with segments of two rows and of one, two at a time, so that conversations are put together in many rounds."""
    monkeypatch.setattr(repair, "SEGMENT_BITS", bits)
    monkeypatch.setattr(repair, "FAN_BITS", 6 if bits == 8 else 1)
    rows = chats(bits, n=150 if bits == 8 else 40)
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    found = answer(spark, rows)
    assert found == brute(plain, sorted({r[0] for r in rows}, key=repr)) and len({r[7] for r in found}) > 20


def test_query_damages_and_keeps_all_ids(spark, tmp_path):
    from tessera.llm import queries

    rows = chats(5, n=120, most=4)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    out = queries.op12_conversation_repair(spark, str(tmp_path))
    assert out.columns[: len(COLUMNS)] == COLUMNS
    found = sorted(map(tuple, out.select(COLUMNS).collect()), key=repr)
    ids = sorted({r[0] for r in rows}, key=repr)
    assert found == brute(brute_damage(rows), ids) and any(r[7] == "" for r in found)


def test_repaired_turns_are_legal(spark):
    rows = chats(7, n=60)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = sorted(map(tuple, repair.Repair(frame).turns().collect()), key=lambda r: (repr(r[0]), r[1]))
    sha = {c: hashlib.sha256("\n".join(f"{r}:{x}" for _, _, r, x in g).encode()).hexdigest() for c, g in groupby(turns, key=lambda r: r[0])}
    for row in answer(spark, rows):
        assert row[8] == sha.get(row[0], hashlib.sha256(b"").hexdigest())


def test_suffixes_are_shared():
    made = []
    real = repair._before
    repair._before = lambda s, rest: made.append(s) or real(s, rest)
    try:
        automaton = repair.Automaton()
        signatures = sorted(["uaua", "saua", "xua", "ua", "aua", "uaUA"], key=lambda s: s[::-1])
        nodes = {s: automaton.node(s) for s in signatures}
    finally:
        repair._before = real
    suffixes = {s[k:] for s in signatures for k in range(len(s))}
    assert len(made) == len(suffixes)
    assert nodes["uaua"][0][0] == (0, "KKKK") and nodes["xua"][0][0] == (4, "DKK") and nodes["aua"][0][0] == (3, "IKKK")


def test_empty_table(spark):
    assert answer(spark, []) == []
