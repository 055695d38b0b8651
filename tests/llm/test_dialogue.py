"""Conversation repair against all edits of short conversations, tried one by one."""

import hashlib
import random
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from geolake.llm import dialogue as d

SPACES = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, pos int, digest string, code string, _c int, p string"


def frame(spark, rows):
    """Conversations with columns whose names the operator uses itself."""
    return spark.createDataFrame([(*r, 1, "x", "y", 2, "z") for r in rows], SCHEMA)


def damaged(rows):
    out = []
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = (" " if r is None else r), (" " if x is None else x)
        if kind == 1:
            x = ""
        if kind == 2:
            x = "".join(ch for ch in x if ch not in ".!?")
        if kind == 4:
            r = "user"
        out += [(c, t, r, x)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    md5 = lambda x: hashlib.md5(x.encode()).digest()
    return sorted(out, key=lambda z: (z[0] is not None, z[0] or 0, z[1] is not None, z[1] or 0, z[2], md5(z[3])))


def faults(rows):
    seen, out = set(), []
    for _, _, r, x in rows:
        body = x.rstrip(SPACES)
        out.append("blank" if not body else "duplicate" if (r, x) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((r, x))
    return out


def best(rows):
    """Every edit tried at every row: cost, audit and repaired rows of the least."""
    marks = faults(rows)

    def fits(text):  # s?(ua)+ so far
        body = text[1:] if text[:1] == "s" else text
        return all(ch == "ua"[k % 2] for k, ch in enumerate(body))

    @lru_cache(None)
    def go(k, shape, inserted):
        ends = []
        body = shape[1:] if shape[:1] == "s" else shape
        if k == len(rows) and (shape == "" or (body and len(body) % 2 == 0)):
            ends.append((0, "", ()))
        if inserted < 2:
            for role in ("user", "assistant"):
                if fits(shape + role[0]):
                    got = go(k, shape + role[0], inserted + 1)
                    if got:
                        ends.append((got[0] + 5, "I" + got[1], ((role, ""), *got[2])))
        if k < len(rows):
            _, _, r, x = rows[k]
            got = go(k + 1, shape, 0)
            if got:
                ends.append((got[0] + 2, "D" + got[1], got[2]))
            if marks[k] in ("", "truncated"):
                more = 5 if marks[k] else 0
                for role, letter, paid in ((r, "K", 0), ("user", "R", 1), ("assistant", "R", 1)):
                    if r[:1] in ("s", "u", "a") or letter == "R":
                        if fits(shape + role[:1]) and (role[:1] != "s" or not shape):
                            got = go(k + 1, shape + role[:1], 0)
                            if got:
                                ends.append((got[0] + paid + more, letter + got[1], ((role, x), *got[2])))
        return min(ends, default=None)

    return go(0, "", 0)


def expected(rows):
    after = damaged(rows)
    out = {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, *_ in rows}
    for c in {r[0] for r in after}:
        own = [r for r in after if r[0] == c]
        marks = faults(own)
        turns = {r[1] for r in own if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        roles = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))
        cost, audit, text = best(own)
        digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in text).encode()).hexdigest()
        out[c] = (gaps, *(marks.count(m) for m in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return out


def found(df):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r[n] for n in names) for r in rows}


def made(seed, conversations, longest):
    rnd = random.Random(seed)
    out = []
    for c in range(conversations):
        for k in range(rnd.randrange(1, longest)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "Umpire"])
            text = rnd.choice(["Yes.", "no", "What now?", " \t", None, "Why!\n", "", f"t{k}.", f"t{k}"])
            turn = rnd.choice([k, k, k, k, k + 3, None])
            out.append((c if c else None, turn, role, text))
    return out


def test_repair_is_the_cheapest(spark):
    rows = made(1, 400, 8)
    assert found(d.check(frame(spark, rows))) == expected(rows)


@pytest.mark.parametrize("bits", [0, 1, 2])
def test_blocks_and_their_blocks(spark, monkeypatch, bits):
    """Blocks of one, two and four rows: the crossings come from above."""
    rows = made(2, 60, 12)
    rows += [(500, k, "user" if k % 2 == 0 else "assistant", f"turn {k}.") for k in range(300)]
    want = expected([r for r in rows if r[0] != 500])
    plain = found(d.check(frame(spark, rows)))
    monkeypatch.setattr(d, "BLOCK_BITS", bits)
    monkeypatch.setattr(d, "FAN_BITS", 1)
    got = found(d.check(frame(spark, rows)))
    assert got == plain and {c: v for c, v in got.items() if c != 500} == want


def test_edges(spark):
    assert d.check(frame(spark, [])).collect() == []
    assert d.check(frame(spark, [])).columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    # one row many times, a long text, only nulls, a conversation that is dropped whole
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(7001, 5, "user", "again.")] * 300 + [(7002, 1, "user", "x" * 300_000 + "."), (7002, 2, "assistant", "word " * 50_000)] + [(None, None, None, None)] * 3 + [(gone, 0, "user", "Hi.")]
    assert found(d.check(frame(spark, rows))) == expected(rows)


def test_repaired_rows(spark):
    rows = [(1, 1, "system", "Be kind."), (1, 2, "user", "Hi."), (1, 3, "user", "Hello?"), (1, 4, "assistant", "Yes."), (1, 5, "user", "")]
    done = d.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    a = done.audits.first()
    got = [(r.role, r.text, r.edit) for r in done.rows.orderBy("place", "part").collect()]
    assert (a.cost, a.audit, a.blank, a.illegal) == (4, "KDKKD", 1, 1)
    assert got == [("system", "Be kind.", "K"), ("user", "Hello?", "K"), ("assistant", "Yes.", "K")]


def test_least_letters_of_equal_costs():
    rnd = random.Random(5)
    for _ in range(300):
        n = rnd.randrange(1, 7)
        rows = [(0, k, rnd.choice(["system", "user", "assistant", "tool"]), rnd.choice([f"a{k}.", f"b{k}", ""])) for k in range(n)]
        marks = faults(rows)
        codes = [d.code(" sua".find(r[2][0]) if r[2][0] in "sua" else 0, m == "truncated", m in ("blank", "duplicate")) for r, m in zip(rows, marks, strict=True)]
        items = d.as_items(codes, [1] * n)
        end = d.last_state(*d.forward(items, 0, n, d.NONE))
        audit = "".join(d.moves(c)[w][1] for c, w in zip(codes, d.crossings(items, d.NONE, end), strict=True)) + d.TAIL[end][1]
        assert audit == best(rows)[1], (rows, audit)


def test_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert found(d.check(rows)) == expected([tuple(r) for r in rows.select("conv_id", "turn", "role", "text").collect()])
    assert d.check(rows).select(F.sum("cost")).first()[0] > 0
