import hashlib
import itertools
import random
import re
from zlib import crc32

import pytest

from sealmark.llm import turn_repair

SCHEMA = "conv_id long, turn long, role string, text string, digest string, kind string, audit string"  # columns that clash with the operator's own
COST = {"K": 0, "R": 2, "D": 3, "I": 2}
RUNS = [r for n in range(3) for r in itertools.product(("user", "assistant"), repeat=n)]


def faults(rows):
    """(blank, duplicate, truncated) of rows in order, by the words of the contract."""
    out, seen = [], set()
    for role, text in rows:
        said = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute(rows):
    """Cheapest edits by trying all of them, runs of up to two inserts: (cost, audit, repaired turns)."""
    kinds, best = faults(rows), None
    choices = [[("D", None)] if k in ("blank", "duplicate") else [("K", None), ("R", "user"), ("R", "assistant"), ("D", None)] for k in kinds]
    for edits in itertools.product(*choices):
        for runs in itertools.product(RUNS, repeat=len(rows) + 1):
            turns, audit, cost = [], "", 0
            for i, run in enumerate(runs):
                turns += [(x, "") for x in run]
                audit += "I" * len(run)
                cost += 2 * len(run)
                if i < len(rows):
                    edit, role = edits[i]
                    audit += edit
                    cost += COST[edit] + (edit != "D" and kinds[i] == "truncated")
                    if edit != "D":
                        turns.append((role or rows[i][0], rows[i][1]))
            if (best is None or (cost, audit) < best[:2]) and all(r for r, _ in turns) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in turns)):
                best = (cost, audit, turns)
    return best


def by_strings(rows):
    """The same over whole audit strings, for longer conversations: best (cost, audit, turns) by automaton state."""
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    kinds, layer = faults(rows), {"": (0, "", ())}

    def better(to, state, found):
        if state not in to or found[:2] < to[state][:2]:
            to[state] = found

    def inserts(layer):
        out = dict(layer)
        for _ in range(3):
            for s, (c, a, t) in list(out.items()):
                for x in ("user", "assistant"):
                    if x[0] in follow[s]:
                        better(out, x[0], (c + 2, a + "I", (*t, (x, ""))))
        return out

    # An audit may begin another one, so every (state, audit) that could still win is kept: those of each state by cost alone first.
    for (role, text), kind in zip(rows, kinds, strict=True):
        new = {}
        for s0, (c0, a0, t0) in layer.items():
            for s, (c, a, t) in inserts({s0: (c0, a0, t0)}).items():
                better(new, s, (c + 3, a + "D", t))
                if kind in ("", "truncated"):
                    if role[:1] and role[:1] in follow[s]:
                        better(new, role[0], (c + (kind != ""), a + "K", (*t, (role, text))))
                    for x in ("user", "assistant"):
                        if x[0] in follow[s]:
                            better(new, x[0], (c + 2 + (kind != ""), a + "R", (*t, (x, text))))
        layer = new
    done = inserts(layer)
    return min((v for s, v in done.items() if s in ("", "a")), key=lambda v: v[:2])


def random_rows(rng, most):
    return [(rng.choice(["user", "assistant", "system", "tool", "", "User"]), rng.choice(["", " \t", "Hi.", "Yes!", "no end", "no end ", "What?\n", "\xa0"])) for _ in range(rng.randint(0, most))]


def test_edits_are_the_cheapest_of_all():
    rng = random.Random(3)
    for _ in range(60):
        rows = random_rows(rng, 3)
        want = brute(rows)
        assert by_strings(rows)[:2] == want[:2], rows
        code = {"": turn_repair.OK, "blank": turn_repair.BLANK, "duplicate": turn_repair.DUPLICATE, "truncated": turn_repair.CUT_OFF}
        assert turn_repair.best_edits([(r[:1] or "-", code[k]) for (r, _), k in zip(rows, faults(rows), strict=True)]) == want[:2], rows


def test_codes_are_free_of_prefixes():
    assert not [(a, b) for a in turn_repair.CODES for b in turn_repair.CODES if a != b and b.startswith(a)]


def damage(rows):
    """conv_id -> rows after damage, in order, by the words of the contract."""
    out = {}
    for conv, turn, role, text, *_ in rows:
        n = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        kept = out.setdefault(conv, [])
        if n == 1:
            text = ""
        elif n == 2:
            text = re.sub("[.!?]", "", text)
        elif n == 4:
            role = "user"
        kept += [(turn, role, text)] * (0 if n == 0 else 2 if n == 3 else 1)
    for kept in out.values():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    return out


def expected(rows):
    out = {}
    for conv, kept in damage(rows).items():
        said = [(r, t) for _, r, t in kept]
        kinds = faults(said)
        turns = {t for t, _, _ in kept if t is not None}
        cost, audit, repaired = by_strings(said)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(said))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out[conv] = (min(gaps, 2**63 - 1), kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, digest)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "d", "k", "a") for r in rows], SCHEMA)


def answers(spark, rows):
    df = turn_repair.damaged(frame(spark, rows))
    got = turn_repair.digests(df, turn_repair.audits(df)).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r)[1:] for r in got}


def test_conversations_equal_brute_force(spark):
    rng = random.Random(8)
    rows = [(c, None if rng.random() < 0.1 else t * rng.choice([1, 1, 3]), *x) for c in [None, *range(150)] for t, x in enumerate(random_rows(rng, 7))]
    rows += [(900 + i % 3, i % 2, None if i % 5 == 0 else "user", None if i % 7 == 0 else "Same.") for i in range(40)]  # ties and repeated rows
    rows += [(950, -(2**63), "user", "Far."), (950, 2**63 - 1, "assistant", "apart.")]
    assert answers(spark, rows) == expected(rows)


def test_long_conversations_and_texts(spark):
    rng = random.Random(5)
    rows = [(1, t, *x) for t, x in enumerate([("user", "Copy."), ("assistant", "word " * 50_000 + "end."), *(random_rows(rng, 400) or [("user", "x")]) * 3])]
    assert answers(spark, rows) == expected(rows)


def test_no_rows(spark):
    assert answers(spark, []) == {}


def test_a_conversation_without_rows_after_damage(spark):
    conv = next(c for c in range(1000) if crc32(f"{c}:0".encode()) % 20 == 0)
    assert answers(spark, [(conv, 0, "user", "Gone.")]) == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_repaired_turns_follow_the_audit(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "user", "Bye."), (2, 5, "tool", "Found."), (2, 6, "user", " "), (2, 7, "assistant", "So it is."), (3, 0, "user", "")]
    df = frame(spark, rows)
    found = turn_repair.audits(df)
    got = {}
    for r in sorted(turn_repair.repaired(df, found).collect(), key=lambda r: (r.conv_id, r.place)):
        got.setdefault(r.conv_id, []).append((r.edit, r.role, r.text))
    assert got[1] == [("K", "system", "Be kind."), ("I", "user", ""), ("K", "assistant", "Hello."), ("K", "user", "Bye."), ("I", "assistant", "")]
    assert got[2] == [("R", "user", "Found."), ("K", "assistant", "So it is.")] and 3 not in got
    by = {r.conv_id: r for r in found.collect()}
    for conv, turns in got.items():
        assert re.fullmatch("(s?(ua)+)?", "".join(role[0] for _, role, _ in turns)) and by[conv].audit.replace("D", "") == "".join(e for e, _, _ in turns)


def test_the_query_on_the_given_table(spark):
    from sealmark.llm._common import table

    d = "/root/testdata/sf0.001"
    pytest.importorskip("pyarrow")
    rows = [tuple(r) for r in table(spark, d, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert {r.conv_id: tuple(r)[1:] for r in turn_repair.op11_turn_repair(spark, d).collect()} == expected(rows)
