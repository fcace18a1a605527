import hashlib
import itertools
import random
import re
import zlib

import pytest

from panelcast.llm import dialogues, queries

SCHEMA = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile(r"(s?(ua)+)?\Z")
FULL = {"u": "user", "a": "assistant"}
SPACE = " \t\n\v\f\r"


def damage(rows):
    out, convs = [], {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, [])
        spell = lambda v: " " if v is None else str(v)
        kind, role, text, copies = zlib.crc32(f"{spell(conv)}:{spell(turn)}".encode()) % 20, spell(role), spell(text), 1
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else copies)
    for r in out:
        convs[r[0]].append(r[1:])
    for turns in convs.values():
        turns.sort(key=lambda r: (r[0] is not None, r[0], r[1].encode(), r[2][:32].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
    return convs


def faults(turns):
    seen, out = set(), []
    for _, role, text in turns:
        kept = text.strip(SPACE)
        out.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(turns):
    """All edits, inserts of up to two turns in a place; paths meet where their last role is the same, in short conversations nowhere."""
    short = len(turns) <= 5
    inserts = [(2 * n, "I" * n, [(FULL[r], "") for r in roles]) for n in range(3) for roles in itertools.product("ua", repeat=n)]
    paths = {"": (0, "", [])}  # initials so far -> the cheapest edits

    def grown(paths, options):
        out = {}
        for initials, (cost, audit, text) in paths.items():
            for more, letters, rows in options:
                to = initials + "".join(r[:1] for r, _ in rows)
                if any(not r[:1] for r, _ in rows) or not re.match(r"(s?(ua)*u?|s)?\Z", to):
                    continue
                to = to if short or to[-1:] != "a" else "ua"
                to = to if short or to[-1:] != "u" else "u"
                new = (cost + more, audit + letters, text + rows)
                if to not in out or new[:2] < out[to][:2]:
                    out[to] = new
        return out
    for (_, role, text), fault in zip(turns, faults(turns)):
        edits = [(3, "D", [])]
        if fault not in ("blank", "duplicate"):
            cut = fault == "truncated"
            edits += [(cut, "K", [(role, text)]), (2 + cut, "R", [("user", text)]), (2 + cut, "R", [("assistant", text)])]
        paths = grown(grown(paths, inserts), edits)

    paths = {k: v for k, v in grown(paths, inserts).items() if GRAMMAR.match(k)}
    return min((v for v in paths.values()), key=lambda v: v[:2])


def brute(rows):
    out = []
    for conv, turns in damage(rows).items():
        kinds = faults(turns)
        numbers = [t for t, _, _ in turns if t is not None]
        cost, audit, text = cheapest(turns)
        pairs = zip(turns, turns[1:])
        out.append((conv, max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")),
                    sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs), cost, audit,
                    hashlib.sha256("\n".join(f"{r}:{t}" for r, t in text).encode()).hexdigest()))
    return sorted(out, key=str)


def repaired(spark, rows, schema=SCHEMA, **more):
    return sorted((tuple(r) for r in dialogues.repair(dialogues.damaged(spark.createDataFrame(rows, schema)), **more).collect()), key=str)


def random_rows(seed, convs, most):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    texts = ["Yes.", "No!", "Well", "", None, " \n", "A b c?", "Cut off ", "Done. \t"]
    rows = []
    for c in range(convs):
        for t in range(rng.randint(0, most)):
            rows.append((c, rng.choice([t, t, t, t + 1, None]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"Own {c} {t}."))
    return rows


def test_small_conversations_equal_all_edits(spark):
    rows = random_rows(1, 250, 6) + [(None, t, "user", f"Null {t}.") for t in range(4)]
    assert repaired(spark, rows) == brute(rows)


def test_tiny_blocks_and_long_conversations(spark):
    rows = random_rows(2, 60, 9)
    want = brute(rows)
    for size in (1, 2, 3):
        assert repaired(spark, rows, size=size) == want
    rng = random.Random(4)
    long_rows = [(5, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"Line {t}.", "Same.", "open"])) for t in range(700)] + random_rows(5, 8, 4)
    assert repaired(spark, long_rows, size=64) == brute(long_rows)


@pytest.mark.parametrize("size", [1, 4, 300])
def test_blocks_combine_to_one_block(size):
    rng = random.Random(size)
    for _ in range(30):
        slots = [(rng.choice(["s", "u", "a", ""]), rng.random() < 0.2, False) for _ in range(rng.randint(0, 40))]
        parts = [(dialogues.block_matrix(slots[k:k + size]), len(slots[k:k + size])) for k in range(0, max(1, len(slots)), size)]
        assert dialogues.decided(parts) == dialogues.decided([(dialogues.block_matrix(slots), len(slots))])


def test_edge_rows(spark):
    empty_hash = hashlib.sha256(b"").hexdigest()
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(dropped, 0, "user", "Gone."), (10_001, None, None, None), (10_002, None, "user", "x" * 3_000_000 + "."), (None, None, "assistant", "Lone.")]
    rows += [(10_003, 1, "user", "Again.")] * 3000 + [(10_004, 1, r, t) for r in ("user", "assistant") for t in ("Tie b.", "Tie a.")]
    got = repaired(spark, rows)
    assert got == brute(rows)
    assert (dropped, 0, 0, 0, 0, 0, 0, "", empty_hash) in got
    clash = spark.createDataFrame([(*r, 7, "x") for r in rows[:4]], f"{SCHEMA}, copies int, audit string")
    assert dialogues.repair(dialogues.damaged(clash)).count() == 4
    none = dialogues.repair(dialogues.damaged(spark.createDataFrame([], SCHEMA)))
    assert none.collect() == [] and none.columns[-1] == "repaired_sha256"


def test_repaired_turns_hash_to_the_report(spark):
    rows = dialogues.conversations(spark.createDataFrame(random_rows(7, 40, 7), SCHEMA))
    turns = {}
    for r in dialogues.repaired_turns(rows).orderBy("conv_id", "place").collect():
        turns.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for r in dialogues.repair(rows).collect():
        assert hashlib.sha256("\n".join(turns.get(r.conv_id, [])).encode()).hexdigest() == r.repaired_sha256


def test_query_equals_all_edits_on_a_whole_table(spark):
    at = "/root/testdata/sf0.001"
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{at}/conversations.parquet").collect()]
    got = queries.REGISTRY["op13_conversation_repair"](spark, at)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)
