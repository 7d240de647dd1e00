import hashlib
import random
import re
import zlib

import pytest

from tickforge.llm import conversations as C


def harm(rows):
    """rows (conv, turn, role, text) to {conv: rows after damage in order}."""
    out = {}
    for conv, turn, role, text in rows:
        here = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        here += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0], x[1].encode(), x[2].encode())) for c, r in out.items()}


def fault_of(rows):
    out, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\f\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen
                   else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """(cost, audit, repaired) by keeping every audit string of every cost: complete
    strings are compared, none is dropped before the end but for a higher cost."""
    # state -> {cost: set of (audit, repaired rows)}; strings are only pruned by cost
    now = {"": (0, {("", ())})}

    def add(to, state, cost, paths):
        if state not in to or cost < to[state][0]:
            to[state] = (cost, set(paths))
        elif cost == to[state][0]:
            to[state][1].update(paths)

    def after(state, initial):
        return {"s": {"": "s"}, "u": {"": "u", "s": "u", "a": "u"}, "a": {"u": "a"}}.get(initial, {}).get(state)

    def insertions(to):
        for _ in range(3):
            for state, (cost, paths) in list(to.items()):
                for role in ("user", "assistant"):
                    if s := after(state, role[0]):
                        add(to, s, cost + 2, {(a + "I", r + ((role, ""),)) for a, r in paths})
        return to

    now = insertions(now)
    for (_, role, text), fault in zip(rows, found, strict=True):
        new, late = {}, int(fault == "truncated")
        for state, (cost, paths) in now.items():
            add(new, state, cost + 3, {(a + "D", r) for a, r in paths})
            if fault in ("blank", "duplicate"):
                continue
            if s := after(state, role[:1]):
                add(new, s, cost + late, {(a + "K", r + ((role, text),)) for a, r in paths})
            for other in ("user", "assistant"):
                if s := after(state, other[0]):
                    add(new, s, cost + 2 + late, {(a + "R", r + ((other, text),)) for a, r in paths})
        now = insertions(new)
    return min((cost, audit, repaired) for s in ("", "a") if s in now for cost, paths in [now[s]] for audit, repaired in paths)


def brute(rows):
    out = []
    for conv, here in harm(rows).items():
        found = fault_of(here)
        cost, audit, repaired = cheapest(here, found)
        turns = [t for t, _, _ in here if t is not None]
        initials = [r[:1] for _, r, _ in here]
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
                    *(found.count(k) for k in ("blank", "duplicate", "truncated")),
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit,
                    hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()))
    return sorted(out, key=str)


def sample(seed, n=120):
    rng = random.Random(seed)
    out = []
    for conv in range(n):
        for turn in range(rng.randint(1, 7)):
            out.append((conv, turn * rng.choice([1, 1, 2]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool"]),
                        rng.choice(["Hi.", "Hi.", "Well", "So?", "  ", f"T{turn}.", "é!\n"])))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_query_columns_match_brute_force(spark, seed):
    rows = [*sample(seed), (None, None, None, None), (None, 1, "user", "x"), (500, None, "user", None),
            (501, 3, None, "Hello."), (501, 3, None, "Hello."), (501, 3, "assistant", "Hello."), (502, 1, "", ""),
            *[(503, t, "user", "Same.") for t in range(30)], *[(504, t, "assistant", f"A{t}") for t in range(9)]]
    rows += [(i, 0, "user", "x.") for i in range(600, 800)]  # some lose their only row
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = [tuple(r) for r in C.digest(C.repair(C.damage(df))).collect()]
    want = brute(rows)
    assert sorted(got, key=str) == want
    assert any(w[7] == "" for w in want) and any("I" in w[7] and "D" in w[7] for w in want)


@pytest.mark.parametrize("seed", range(40))
def test_search_matches_brute_force_on_hard_ties(seed):
    rng = random.Random(seed)
    rows = [(t, rng.choice("suax"), "") for t in range(rng.randint(0, 11))]
    found = [rng.choice([None, None, "truncated", "blank"]) for _ in rows]
    search, out = C.Repair(), []
    for (t, role, text), fault in zip(rows, found, strict=True):
        out += search.push((role, text, fault, t))
    out += search.finish()
    cost, audit, repaired = cheapest(rows, found)
    assert "".join(e for e, _, _ in out) == audit
    assert tuple((r, row[1] if row else "") for e, r, row in out if e != "D") == repaired


def test_edits_are_emitted_and_memory_stays_small():
    search, emitted, most = C.Repair(), 0, 0
    rng = random.Random(4)
    for i in range(20_000):
        role = "ua"[i % 2] if rng.random() < 0.9 else rng.choice("sua")
        emitted += len(search.push((role, "x", rng.choice([None] * 8 + ["blank", "truncated"]), i)))
        most = max(most, search.held())
    assert most < 60 and emitted > 19_900
    search, most = C.Repair(), 0
    for i in range(3000):  # nothing but rows that must go
        search.push(("user", "", "blank", i))
        most = max(most, search.held())
    assert most < 10


def test_repaired_rows_are_well_formed(spark):
    df = spark.createDataFrame(sample(9), "conv_id long, turn long, role string, text string")
    by = {}
    for r in C.repair(C.damage(df)).where("edit != 'D'").collect():
        by.setdefault(r.conv_id, {})[r.seq] = r.role
    assert by and all(re.fullmatch("(s?(ua)+)?", "".join(r[:1] for _, r in sorted(rows.items()))) for rows in by.values())


def test_empty_table_and_extra_columns(spark):
    schema = "conv_id long, turn long, role string, text string, fault string, present int, seq long, edit string"
    assert C.digest(C.repair(C.damage(spark.createDataFrame([], schema)))).count() == 0
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes.")]
    df = spark.createDataFrame([(*r, "f", 7, 8, "e") for r in rows], schema)
    assert sorted(tuple(r) for r in C.digest(C.repair(C.damage(df))).collect()) == brute(rows)


def test_long_conversation_streams(spark):
    rows = [(1, t, "ua"[t % 2] + "ser", f"T{t}.") for t in range(30_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = C.digest(C.repair(C.damage(df))).collect()
    assert len(got) == 1 and got[0].cost > 0 and len(got[0].audit) > 28_000
