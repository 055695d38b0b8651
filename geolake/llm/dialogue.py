"""Repair of conversation structure by Hirschberg's divide and conquer.

A repaired conversation has roles ``(s?(ua)+)?``, by their initials: four states,
nothing yet, system, user, assistant. Every row is kept, given another role or
deleted, and rows may be inserted before it; each choice has a cost and a letter.
To find the edits between two states, the forward costs of the first half and the
backward costs of the second meet in the middle, the best state there is chosen and
both halves are solved alone: no table over all rows is held.

Equal costs are told apart by the letters. The forward costs carry the order of the
cheapest texts that lead to each state. Each text of a row ends in the row's own
letter, so no such text begins another one, and the order of two texts is that of
their first differing rows: four ranks are enough to find the least crossing.

Rows are put in order by one range-partitioned sort and cut into blocks. A
conversation of several blocks is solved in the same way from above: blocks are
summed up by 4 x 4 costs and ranks, blocks of blocks too, and the crossings found
among them go down again. No task holds more of a conversation than a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .common import map_batches

SPACE = r"\x20\x09-\x0D"
ENDS = ".!?"
NONE, SYSTEM, USER, ASSISTANT = range(4)
INF = 1 << 60
RETYPE, DELETE, INSERT, OPEN_END = 1, 2, 5, 5
#: A block has at most 2^BLOCK_BITS different rows; FAN_BITS parts of the sort meet in one step upwards.
BLOCK_BITS, FAN_BITS = 12, 8

# --- costs -------------------------------------------------------------------------


def _step(state: int, role: int) -> int | None:
    """The state after a row of that role, if it may stand there."""
    if role == SYSTEM:
        return SYSTEM if state == NONE else None
    if role == USER:
        return USER if state != USER else None
    return ASSISTANT if role == ASSISTANT and state == USER else None


def _free(state: int) -> int:
    """The role, user or assistant, that may follow."""
    return ASSISTANT if state == USER else USER


def code(initial: int, truncated: bool, gone: bool) -> int:
    return initial + 4 * truncated + 8 * gone


@lru_cache(64)
def moves(c: int) -> dict[tuple[int, int], tuple[int, str]]:
    """Cost and letters of the best way to pass a row of code ``c`` between two states."""
    role, cut_off, gone = c % 4, c // 4 % 2, c // 8
    best: dict[tuple[int, int], tuple[int, str]] = {}

    def offer(p: int, q: int | None, cost: int, word: str) -> None:
        if q is not None and (p, q) not in best or q is not None and (cost, word) < best[p, q]:
            best[p, q] = (cost, word)

    for p in range(4):
        offer(p, p, DELETE, "D")
        if gone:
            continue
        fine = OPEN_END * cut_off
        for before, at, paid in (("", p, 0), ("I", _free(p), INSERT)):
            offer(p, _step(at, role), paid + fine, before + "K")
            offer(p, _free(at), paid + fine + RETYPE, before + "R")
    return best


#: Cost and letters that close a conversation after its last row.
TAIL = {NONE: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}

Table = tuple[tuple[int, int, int, int], ...]  # from, to, cost, rank of the letters among those of ``from``


@lru_cache(64)
def row_table(c: int) -> Table:
    m = moves(c)
    return tuple((p, q, m[p, q][0], sorted(w for (a, _), (_, w) in m.items() if a == p).index(m[p, q][1])) for p, q in sorted(m))


def forward(items: list[tuple[Table, int]], lo: int, hi: int, start: int) -> tuple[list[int], list[int]]:
    """Cheapest costs from ``start`` to each state over ``items[lo:hi]``, and the order
    of their letters. The second number of an item is what it costs in any case."""
    cost, rank = [INF] * 4, [0] * 4
    cost[start] = 0
    for table, paid in items[lo:hi]:
        new: list[tuple[int, int, int]] = [(INF, 0, 0)] * 4
        for p, q, c, r in table:
            if cost[p] < INF:
                offer = (cost[p] + c, rank[p], r)
                if offer < new[q]:
                    new[q] = offer
        order = sorted({n[1:] for n in new})
        cost = [min(n[0] + paid, INF) for n in new]
        rank = [order.index(n[1:]) for n in new]
    return cost, rank


def backward(items: list[tuple[Table, int]], lo: int, hi: int, end: int) -> list[int]:
    """Cheapest costs from each state to ``end`` over ``items[lo:hi]``."""
    cost = [INF] * 4
    cost[end] = 0
    for table, paid in reversed(items[lo:hi]):
        new = [INF] * 4
        for p, q, c, _ in table:
            new[p] = min(new[p], c + cost[q])
        cost = [min(n + paid, INF) for n in new]
    return cost


def crossings(items: list[tuple[Table, int]], start: int, end: int) -> list[tuple[int, int]]:
    """The states before and after each item on the cheapest way, of equal ones that
    with the least letters."""
    out: list[tuple[int, int]] = []

    def solve(lo: int, hi: int, p: int, q: int) -> None:
        if hi - lo == 1:
            out.append((p, q))
            return
        mid = (lo + hi) // 2
        cost, rank = forward(items, lo, mid, p)
        rest = backward(items, mid, hi, q)
        at = min(range(4), key=lambda s: (cost[s] + rest[s], rank[s]) if cost[s] + rest[s] < INF else (INF, s))
        solve(lo, mid, p, at)
        solve(mid, hi, at, q)

    if items:
        solve(0, len(items), start, end)
    return out


def last_state(cost: list[int], rank: list[int]) -> int:
    """The state at the end of the rows that closes the conversation best."""
    return min(range(4), key=lambda s: (cost[s] + TAIL[s][0], rank[s]))


def as_items(codes: Sequence[int], copies: Sequence[int]) -> list[tuple[Table, int]]:
    """A row and its further copies, which are deleted in any case."""
    return [(row_table(c), DELETE * (n - 1)) for c, n in zip(codes, copies, strict=True)]


def summary(items: list[tuple[Table, int]]) -> tuple[list[int], list[int]]:
    """The items as one: 16 costs and ranks."""
    cost, rank = [], []
    for p in range(4):
        c, r = forward(items, 0, len(items), p)
        cost += c
        rank += r
    return cost, rank


def table_of(cost: list[int], rank: list[int]) -> Table:
    return tuple((k // 4, k % 4, c, r) for k, (c, r) in enumerate(zip(cost, rank, strict=True)) if c < INF)


# --- damage --------------------------------------------------------------------------


def _id(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def damage(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text of a conversation table with faults put in by the CRC-32
    of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 takes the
    sentence ends out, 3 doubles it, 4 makes it the user's. Nulls count as one space;
    conv_id and turn themselves stay null."""
    kind = F.crc32(F.concat(_id(F.col(conv_id)), F.lit(":"), _id(F.col(turn))).cast("binary")) % 20
    own = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), _id(F.col(role)).alias("_role"), _id(F.col(text)).alias("_text"), kind.alias("_kind"))
    role_now = F.when(F.col("_kind") == 4, "user").otherwise(F.col("_role"))
    text_now = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("_text", ENDS, "")).otherwise(F.col("_text"))
    own = own.where("_kind <> 0").withColumn("_copy", F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return own.select("conv_id", "turn", role_now.alias("role"), text_now.alias("text"))


# --- repair --------------------------------------------------------------------------


@dataclass(frozen=True)
class Repair:
    """``audits``: one row a conversation; ``rows``: the repaired rows, in the order of
    ``place`` and ``part``."""

    audits: DataFrame
    rows: DataFrame


def _slim(rows: DataFrame) -> DataFrame:
    """Equal rows once, with their number, and what the costs depend on."""
    last = F.substring(F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     ")), -1, 1)
    own = rows.select(
        "conv_id",
        "turn",
        "role",
        F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"),
        F.coalesce(F.element_at(F.create_map(F.lit("s"), F.lit(SYSTEM), F.lit("u"), F.lit(USER), F.lit("a"), F.lit(ASSISTANT)), F.substring("role", 1, 1)), F.lit(NONE)).alias("initial"),
        (last == "").alias("blank"),
        (~last.isin(*ENDS)).alias("open_end"),
    )
    return own.groupBy("conv_id", "turn", "role", "digest", "initial", "blank", "open_end").agg(F.count("*").alias("n"))


def _ordered(slim: DataFrame) -> DataFrame:
    """``pos`` grows along the order of the rows; its upper 31 bits are the part of the sort."""
    key = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    n = int(slim.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(slim.repartitionByRange(n, *key).sortWithinPartitions(*key).withColumn("pos", F.monotonically_increasing_id()))


def _marked(ordered: DataFrame) -> DataFrame:
    """``again``: the same role and text stand earlier in the conversation."""
    first = ordered.groupBy("conv_id", "role", "digest").agg(F.min("pos").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    first = first.select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d"), "_first")
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d"))
    out = ordered.join(first, same, "left").withColumn("again", F.coalesce(F.col("pos") > F.col("_first"), F.lit(False)))
    gone = F.col("blank") | F.col("again")
    c = F.col("initial") + F.when(F.col("open_end") & ~gone, 4).otherwise(0) + F.when(gone, 8).otherwise(0)
    return out.withColumn("code", c.cast("int")).drop("_c", "_r", "_d", "_first")


def _counts(marked: DataFrame) -> DataFrame:
    """gaps, blank, duplicate, truncated of each conversation with rows."""
    n, blank, again = F.col("n"), F.col("blank"), F.col("again")
    return marked.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        F.sum(F.when(blank, n).otherwise(0)).cast("long").alias("blank"),
        F.sum(F.when(blank, 0).when(again, n).otherwise(n - 1)).cast("long").alias("duplicate"),
        F.sum(F.when(F.col("open_end") & ~blank & ~again, 1).otherwise(0)).cast("long").alias("truncated"),
    )


def _illegal(initials: Sequence[int], copies: Sequence[int]) -> int:
    legal = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
    return sum(n - 1 for n in copies) + sum(pair not in legal for pair in zip(initials, initials[1:], strict=False))


def _blocks(marked: DataFrame) -> DataFrame:
    """conv_id, block, rows: the rows of a block in order, with their marks."""
    item = F.struct("pos", "code", "n", "initial", "turn", "role", "digest")
    out = marked.groupBy("conv_id", F.shiftright("pos", BLOCK_BITS).alias("block")).agg(F.sort_array(F.collect_list(item)).alias("rows"))
    per = out.groupBy("conv_id").agg(F.count("*").alias("_blocks"), F.min("block").alias("_first"))
    per = per.select(F.col("conv_id").alias("_c"), "_blocks", "_first")
    return out.join(per, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")


def _sums(blocks: DataFrame) -> DataFrame:
    """The blocks of conversations with several ones, each as one item."""

    def setup():
        def step(b):
            made = [summary(as_items(c, n)) for c, n in zip(b["codes"], b["copies"], strict=True)]
            return {"conv_id": b["conv_id"], "node": b["node"], "cost": [m[0] for m in made], "rank": [m[1] for m in made]}

        return step

    kind = blocks.schema["conv_id"].dataType.simpleString()
    own = blocks.select("conv_id", F.col("block").alias("node"), F.col("rows.code").alias("codes"), F.col("rows.n").alias("copies"))
    return map_batches(own, f"conv_id {kind}, node long, cost array<long>, rank array<int>", setup)


def _up(nodes: DataFrame, bits: int) -> DataFrame:
    """Groups of neighbouring nodes as nodes of their own, with the nodes they hold."""

    def setup():
        def step(b):
            out = {"conv_id": b["conv_id"], "node": b["node"], "kids": b["kids"], "cost": [], "rank": []}
            for kids in b["kids"]:
                cost, rank = summary([(table_of(k["cost"], k["rank"]), 0) for k in kids])
                out["cost"].append(cost)
                out["rank"].append(rank)
            return out

        return step

    kind = nodes.schema["conv_id"].dataType.simpleString()
    kids = nodes.groupBy("conv_id", F.shiftright("node", bits).alias("_up")).agg(F.sort_array(F.collect_list(F.struct("node", "cost", "rank"))).alias("kids"))
    kids = kids.select("conv_id", F.col("_up").alias("node"), "kids")
    inside = "kids array<struct<node:long,cost:array<long>,rank:array<int>>>"
    return cut(map_batches(kids, f"conv_id {kind}, node long, {inside}, cost array<long>, rank array<int>", setup))


def _down(parents: DataFrame) -> DataFrame:
    """The states at both ends of the nodes inside ``parents`` (conv_id, kids, p, q)."""

    def setup():
        def step(b):
            ends = [crossings([(table_of(k["cost"], k["rank"]), 0) for k in kids], p, q) for kids, p, q in zip(b["kids"], b["p"], b["q"], strict=True)]
            return {"conv_id": b["conv_id"], "ends": [[{"node": k["node"], "p": p, "q": q} for k, (p, q) in zip(kids, e, strict=True)] for kids, e in zip(b["kids"], ends, strict=True)]}

        return step

    kind = parents.schema["conv_id"].dataType.simpleString()
    got = map_batches(parents.select("conv_id", "kids", "p", "q"), f"conv_id {kind}, ends array<struct<node:long,p:int,q:int>>", setup)
    return got.select("conv_id", F.explode("ends").alias("_e")).select("conv_id", "_e.*")


def _ends(blocks: DataFrame) -> DataFrame:
    """conv_id, block, p, q of the blocks of conversations with several blocks."""
    levels = [cut(_sums(blocks))]
    shifts = [33 - BLOCK_BITS]  # first the blocks of one part of the sort, then its parts
    while levels[-1].groupBy("conv_id").count().where("count > 1").limit(1).count():
        levels.append(_up(levels[-1], shifts[-1]))
        shifts.append(FAN_BITS)
    top = F.udf(lambda cost, rank: last_state(cost[:4], rank[:4]), "int")
    at = levels[-1].select("conv_id", "node", F.lit(NONE).alias("p"), top("cost", "rank").alias("q"))
    for level in reversed(levels[1:]):
        there = at.select(F.col("conv_id").alias("_c"), F.col("node").alias("_n"), "p", "q")
        at = _down(level.join(there, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("node") == F.col("_n"))))
    return at.withColumnRenamed("node", "block")


def _solved(blocks: DataFrame) -> DataFrame:
    """``blocks`` with words, before, states, cost, illegal: the letters at each row,
    the state before it, and the state after the last row of the conversation."""

    @F.pandas_udf("words array<string>, before array<int>, after int, cost long, illegal long")
    def solve(codes: pd.Series, copies: pd.Series, initials: pd.Series, p: pd.Series, q: pd.Series) -> pd.DataFrame:
        known: dict[tuple, tuple] = {}
        out = []
        for c, n, i, a, z in zip(codes, copies, initials, p, q, strict=True):
            c, n, i, a, z = tuple(c.tolist()), tuple(n.tolist()), tuple(i.tolist()), int(a), int(z)
            key = (c, n, i, a, z)
            if key not in known:
                if len(known) > 1 << 14:
                    known.clear()
                items = as_items(c, n)
                end = last_state(*forward(items, 0, len(items), a)) if z < 0 else z
                ways = crossings(items, a, end)
                made = [moves(x)[w] for x, w in zip(c, ways, strict=True)]
                cost = sum(m[0] for m in made) + sum(paid for _, paid in items)
                known[key] = ([m[1] for m in made], [w[0] for w in ways], end, cost, _illegal(i, n))
            out.append(known[key])
        return pd.DataFrame(out, columns=["words", "before", "after", "cost", "illegal"])

    got = solve(F.col("rows.code"), F.col("rows.n"), F.col("rows.initial"), "p", "q")
    return blocks.withColumn("_s", got).select("conv_id", "block", "_blocks", "rows", "_s.*")


def _solve_all(blocks: DataFrame) -> DataFrame:
    one = blocks.where("_blocks = 1").withColumns({"p": F.lit(NONE), "q": F.lit(-1)})
    many = blocks.where("_blocks > 1")
    ends = _ends(many).select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), "p", "q")
    many = many.join(ends, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b"))).select(*one.columns)
    return cut(_solved(one.unionByName(many)))


def _audits(solved: DataFrame) -> DataFrame:
    """cost, audit, illegal of each conversation from those of its blocks."""
    text = F.array_join(F.transform(F.arrays_zip("words", F.col("rows.n").alias("n")), lambda x: F.concat(x["words"], F.repeat(F.lit("D"), (x["n"] - 1).cast("int")))), "")
    own = solved.select("conv_id", "block", "cost", "illegal", "after", text.alias("_t"), F.element_at("rows", 1)["initial"].alias("_i"), F.element_at("rows", -1)["initial"].alias("_j"))
    before = F.lag("_j").over(Window.partitionBy("conv_id").orderBy("block"))
    pair = F.concat_ws(",", before, "_i")
    broken = before.isNotNull() & ~pair.isin(f"{SYSTEM},{USER}", f"{USER},{ASSISTANT}", f"{ASSISTANT},{USER}")
    own = own.withColumn("illegal", F.col("illegal") + broken.cast("long"))
    got = own.groupBy("conv_id").agg(
        F.sum("illegal").alias("illegal"),
        F.sum("cost").alias("_cost"),
        F.max(F.struct("block", "after"))["after"].alias("_end"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "_t"))), lambda x: x["_t"]), "").alias("_t"),
    )
    tail = {s: F.col("_end") == s for s in (SYSTEM, USER)}
    cost = F.when(tail[SYSTEM], TAIL[SYSTEM][0]).when(tail[USER], TAIL[USER][0]).otherwise(0)
    more = F.when(tail[SYSTEM], TAIL[SYSTEM][1]).when(tail[USER], TAIL[USER][1]).otherwise("")
    return got.select("conv_id", "illegal", (F.col("_cost") + cost).cast("long").alias("cost"), F.concat("_t", more).alias("audit"))


def _repaired(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """conv_id, place, part, turn, role, text, edit: the rows that stay, by place of the
    row and part (0 inserted before it, 1 itself, 2 and 3 inserted behind the last)."""
    free = F.when(F.col("state") == USER, "assistant").otherwise("user")
    other = F.when(F.col("state") == USER, "user").otherwise("assistant")
    each = solved.select("conv_id", F.posexplode(F.arrays_zip("words", "before", F.col("rows").alias("row"))).alias("_k", "_x"))
    each = each.select("conv_id", F.col("_x.row.pos").alias("place"), F.col("_x.words").alias("word"), F.col("_x.before").alias("state"), F.col("_x.row.turn").alias("turn"), F.col("_x.row.role").alias("old"), F.col("_x.row.digest").alias("digest"))
    each = each.where("word <> 'D'")
    own_role = F.when(F.col("word").endswith("K"), F.col("old")).when(F.length("word") == 2, other).otherwise(free)
    keys = each.select(F.col("conv_id").alias("_c"), "place", F.col("turn").alias("_u"), F.col("old").alias("_o"), F.col("digest").alias("_d"), own_role.alias("_role"), F.substring("word", -1, 1).alias("_edit"))
    texts = rows.withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary")))).groupBy("conv_id", "turn", "role", "digest").agg(F.first("text").alias("text"))
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("turn").eqNullSafe(F.col("_u")) & (F.col("role") == F.col("_o")) & (F.col("digest") == F.col("_d"))
    stay = texts.join(keys, same).select("conv_id", "place", F.lit(1).alias("part"), "turn", F.col("_role").alias("role"), "text", F.col("_edit").alias("edit"))
    made = each.where("word like 'I%'").select("conv_id", "place", F.lit(0).alias("part"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), free.alias("role"), F.lit("").alias("text"), F.lit("I").alias("edit"))
    last = solved.groupBy("conv_id").agg(F.max(F.struct("block", "after"))["after"].alias("state"), F.max(F.element_at("rows", -1)["pos"]).alias("place"))
    behind = F.when(F.col("state") == SYSTEM, F.array(F.lit("user"), F.lit("assistant"))).when(F.col("state") == USER, F.array(F.lit("assistant")))
    behind = last.where(F.col("state").isin(SYSTEM, USER)).select("conv_id", "place", F.posexplode(behind).alias("_k", "role"))
    behind = behind.select("conv_id", "place", (F.col("_k") + 2).alias("part"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), "role", F.lit("").alias("text"), F.lit("I").alias("edit"))
    return stay.unionByName(made).unionByName(behind)


def repair(rows: DataFrame) -> Repair:
    """Audits (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) and
    repaired rows of conversations (conv_id, turn, role, text; only conv_id and turn
    may be null, a null conv_id is a conversation of its own).

    Rows stand in the order of their turn, nulls first; rows of one turn by role, then
    by the MD5 of their text, so that equal rows are neighbours. A role counts by its
    first letter, other letters are never legal. A blank row has no character outside
    the ASCII white space; the second of two rows with one role and text is a
    duplicate, wherever it stands. Conversations of any length are cut into blocks.
    The audit of a conversation has a letter for each of its rows.
    """
    ordered = _ordered(_slim(rows))
    marked = _marked(ordered)
    solved = _solve_all(cut(_blocks(marked)))
    counts = _counts(marked)
    audits = _audits(solved).select(F.col("conv_id").alias("_c"), "illegal", "cost", "audit")
    audits = counts.join(audits, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
    return Repair(audits, _repaired(rows, solved))


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id, sha256 of ``role:text`` of the rows of a conversation, joined by newlines.
    A digest is a chain: the sorted rows of a conversation stream through one task,
    which holds one row at a time."""
    kind = repaired.schema["conv_id"].dataType.simpleString()

    def setup():
        open_id: list = []
        h = hashlib.sha256()

        def step(b):
            nonlocal h
            out: dict[str, list] = {"conv_id": [], "sha256": []}
            for c, r, t in zip(b["conv_id"], b["role"], b["text"], strict=True):
                if open_id and open_id[0] == c and r is not None:
                    h.update(b"\n")
                elif r is not None:
                    open_id[:] = [c]
                    h = hashlib.sha256()
                if r is None:
                    out["conv_id"].append(c)
                    out["sha256"].append(h.hexdigest())
                    open_id.clear()
                else:
                    h.update(f"{r}:{t}".encode("utf-8", "surrogatepass"))
            return out

        return step

    # one mark behind the rows of each conversation says that it is over
    mark = repaired.select("conv_id").distinct().select("conv_id", F.lit(None).cast("long").alias("place"), F.lit(None).cast("int").alias("part"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    rows = repaired.select("conv_id", "place", "part", "role", "text").unionByName(mark)
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("place").asc_nulls_last(), "part")
    return map_batches(rows.select("conv_id", "role", "text"), f"conv_id {kind}, sha256 string", setup)


def check(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Damage and repair: one row for every conv_id of ``rows``. Where the damage leaves
    no rows the counts are 0, the audit and the text that is hashed are empty."""
    done = repair(damage(rows, conv_id, turn, role, text))
    hashes = digests(done.rows).select(F.col("conv_id").alias("_h"), "sha256")
    every = rows.select(F.col(conv_id).alias("_id")).distinct()
    out = every.join(done.audits, F.col("_id").eqNullSafe(F.col("conv_id")), "left").join(hashes, F.col("_id").eqNullSafe(F.col("_h")), "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(F.col("_id").alias("conv_id"), *zero.values(), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", empty).alias("repaired_sha256"))
