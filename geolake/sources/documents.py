"""Large JSON documents read by many tasks.

The scan is Spark's text source with ``}`` as its line end, so a document of any size
and layout is split at byte ranges, on any store Spark reads. A range does not know
whether it starts inside a string, nor how deep. A first pass sums every range up for
both cases: the containers it closes, those it leaves open, and whether it ends in a
string. Put together in file order, a few values a range, these give the exact state
at the start of each. The second pass cuts the elements out; one that goes on in
later ranges is put together from its pieces. Elements are named by their byte offset,
which no split size changes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import cut

QUOTE, BACKSLASH, COLON = b'"\\:'
OPEN, CLOSE = b"{[", b"}]"
ANY = "*"
IS_BRACKET = np.isin(np.arange(256), list(OPEN + CLOSE))


@dataclass(frozen=True)
class Container:
    """An open ``{`` or ``[``, the key it stands under, and where it was opened."""

    kind: int
    key: str | None
    offset: int


@dataclass(frozen=True)
class State:
    """What is open at a place: ``closed`` containers of before are gone, ``stack``
    ones were opened since; ``partial`` holds the open string so far."""

    inside: bool = False
    closed: int = 0
    stack: tuple[Container, ...] = ()
    partial: bytes = b""
    offset: int = 0

    def then(self, later: State) -> State:
        """The state after a range that was summed up as ``later`` from where this one ends."""
        kept = len(self.stack) - later.closed
        shifted = tuple(replace(c, offset=c.offset + self.offset) for c in later.stack)
        partial = later.partial if later.inside else b""
        return State(later.inside, self.closed + max(0, -kept), self.stack[: max(0, kept)] + shifted, partial, self.offset + later.offset)


def _quotes(b: np.ndarray) -> np.ndarray:
    """Places of the quotes that no backslash escapes."""
    q = np.flatnonzero(b == QUOTE)
    marked = q[(q > 0) & (b[np.maximum(q - 1, 0)] == BACKSLASH)]
    escaped = []
    for p in marked:
        k = p - 1
        while k >= 0 and b[k] == BACKSLASH:
            k -= 1
        if (p - 1 - k) % 2:
            escaped.append(p)
    return np.setdiff1d(q, escaped) if escaped else q


def _marks(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the quotes; places of all brackets, +1 or -1 for each, and whether an
    odd number of quotes stands before it."""
    b = np.frombuffer(data, np.uint8)
    quotes = _quotes(b)
    at = np.flatnonzero(IS_BRACKET[b])
    return quotes, at, np.where((b[at] == OPEN[0]) | (b[at] == OPEN[1]), 1, -1), np.searchsorted(quotes, at) % 2 == 1


def _brackets(marks: tuple, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of the brackets outside strings, and +1 or -1 for each."""
    _, at, d, odd = marks
    out = odd == inside
    return at[out], d[out]


@lru_cache(1000)
def _key(raw: bytes) -> str:
    return json.loads(b'"' + raw + b'"')


def _container(data: bytes, quotes: np.ndarray, p: int, base: int, before: bytes) -> Container:
    """The container opened at ``p``; ``before`` is the string that was open at the start."""
    k = p - 1
    while k >= 0 and data[k] in b" \t\r\n":
        k -= 1
    key = None
    if k >= 0 and data[k] == COLON:
        n = int(np.searchsorted(quotes, k))
        start = int(quotes[n - 2]) + 1 if n > 1 else 0
        raw = (b"" if n > 1 else before) + data[start : int(quotes[n - 1])]
        key = _key(raw)
    return Container(data[p], key, base + p)


def advance(state: State, data: bytes, marks: tuple | None = None) -> State:
    """The state after ``data``, which ends with a ``}`` or the file."""
    marks = marks or _marks(data)
    q = marks[0]
    at, d = _brackets(marks, state.inside)
    level = np.cumsum(d)
    low = min(0, int(level.min())) if len(level) else 0
    end = int(level[-1]) if len(level) else 0
    opened = []
    for want in range(low + 1, end + 1):
        under = np.flatnonzero(level < want)
        opened.append(_container(data, q, int(at[under[-1] + 1 if len(under) else 0]), state.offset, state.partial))
    kept = len(state.stack) + low
    inside = bool((len(q) + state.inside) % 2)
    partial = b"" if not inside else data[int(q[-1]) + 1 :] if len(q) else state.partial + data
    return State(inside, state.closed + max(0, -kept), state.stack[: max(0, kept)] + tuple(opened), partial, state.offset + len(data))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bytes]]:
    """Bytes of consecutive pieces of one range."""
    for batch in batches:
        values, files, starts = (batch.column(k) for k in range(3))
        starts, ids = starts.to_numpy(zero_copy_only=False), files.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        at = np.flatnonzero((starts[1:] != starts[:-1]) | (ids[1:] != ids[:-1])) + 1
        cuts = [0, *at.tolist(), batch.num_rows] if batch.num_rows else []
        for a, z in zip(cuts, cuts[1:]):
            pieces = values.slice(a, z - a).cast(pa.large_binary())
            whole = pc.binary_join(pa.LargeListArray.from_arrays([0, z - a], pieces), pa.scalar(b"}", pa.large_binary()))
            yield (files[a].as_py(), int(starts[a])), whole[0].as_py() + b"}"


SIDE = "file string, start long, from_string boolean, inside boolean, closed int, stack array<struct<kind:int,key:string,offset:long>>, partial binary, size long"
ELEMENT = "file string, offset long, range long, seq long, kind string, keys array<string>, text string"


def _states(pieces: DataFrame) -> dict[tuple[str, int], State]:
    """The state at the start of every range: a few values each come to the driver."""
    schema = StructType.fromDDL(SIDE)
    arrow = to_arrow_schema(schema)

    def run(batches):
        now, both = None, {}

        def rows():
            stacks = {h: [{"kind": c.kind, "key": c.key, "offset": c.offset} for c in s.stack] for h, s in both.items()}
            return pa.RecordBatch.from_pylist([{"file": now[0], "start": now[1], "from_string": h, "inside": s.inside, "closed": s.closed, "stack": stacks[h], "partial": s.partial, "size": s.offset} for h, s in both.items()], schema=arrow)

        for where, data in _ranges(batches):
            if where != now:
                if now is not None:
                    yield rows()
                now, both = where, {h: State(h) for h in (False, True)}
            marks = _marks(data)
            both = {h: advance(s, data, marks) for h, s in both.items()}
        if now is not None:
            yield rows()

    got: dict[str, dict[int, dict[bool, State]]] = {}
    # all at once: an iterator would run the tasks one after another
    for r in pieces.mapInArrow(run, schema).collect():
        stack = tuple(Container(c["kind"], c["key"], c["offset"]) for c in r["stack"])
        side = State(r["inside"], r["closed"], stack, bytes(r["partial"]), r["size"])
        got.setdefault(r["file"], {}).setdefault(r["start"], {})[r["from_string"]] = side
    out = {}
    for file, parts in got.items():
        state = State()
        for start in sorted(parts):
            out[file, start] = state
            state = state.then(parts[start][state.inside])
    return out


def _fits(stack: tuple[Container, ...], path: tuple[str, ...] | None) -> bool:
    """Elements stand directly in this stack of containers."""
    if path is None:
        return not stack
    if len(stack) != len(path) + 1 or stack[0].kind != OPEN[0] or stack[-1].kind != OPEN[1]:
        return False
    return all(p == ANY or p == c.key for p, c in zip(path, stack[1:], strict=True))


def _cut_out(state: State, data: bytes, path: tuple[str, ...] | None, rest: bool) -> tuple[State, list[tuple[str, int, tuple, bytes]]]:
    """Elements in ``data`` as (kind, offset, keys, bytes): ``start``, ``middle`` and
    ``end`` are parts of one, ``whole`` is one, ``rest`` is what stands outside."""
    depth = len(path) + 2 if path is not None else 1
    marks = _marks(data)
    q = marks[0]
    at, d = _brackets(marks, state.inside)
    level = len(state.stack) + np.cumsum(d)
    shown = np.flatnonzero(np.where(d > 0, level <= depth, level < depth))
    stack = list(state.stack[:depth])  # what lies deeper inside an element is not looked at
    out: list[tuple[str, int, tuple, bytes]] = []
    keys = lambda: tuple(c.key or "" for c in stack[1 : depth - 1])
    taking = len(stack) >= depth and stack[depth - 1].kind == OPEN[0] and _fits(tuple(stack[: depth - 1]), path)
    within = _fits(tuple(stack[: depth - 1]), path) and path is not None
    begin, free = 0, 0  # where the element's bytes here, and those outside, begin
    partly, stop = taking, len(data)
    places, opens = at[shown].tolist(), (d[shown] > 0).tolist()
    ready, here = not taking and len(stack) == depth - 1 and _fits(tuple(stack), path), keys()
    i, n = 0, len(places)
    while i < n:
        p = places[i]
        if ready and opens[i] and data[p] == OPEN[0] and i + 1 < n:
            # what is deeper is not shown: the next one closes this element
            out.append(("whole", state.offset + p, here, data[p : places[i + 1] + 1]))
            i += 2
            continue
        if opens[i]:
            c = _container(data, q, p, state.offset, state.partial)
            if len(stack) == depth - 1 and c.kind == OPEN[0] and _fits(tuple(stack), path):
                taking, partly, begin = True, False, p
            stack.append(c)
            if path is not None and len(stack) == depth - 1 and _fits(tuple(stack), path):
                if rest:
                    out.append(("rest", state.offset + free, (), data[free : p + 1]))
                within = True
        else:
            if not stack:
                stop = p  # a bracket too many: the one that the scan adds behind the end
                break
            c = stack.pop()
            if taking and len(stack) == depth - 1:
                out.append(("end" if partly else "whole", c.offset, keys(), data[begin : p + 1]))
                taking = False
            elif within and len(stack) == depth - 2:
                within, free = False, p
        ready = not taking and len(stack) == depth - 1 and _fits(tuple(stack), path)
        here = keys() if ready else ()
        i += 1
    if taking:
        out.append(("middle" if partly else "start", stack[depth - 1].offset, keys(), data[begin:]))
    if rest and path is not None and not within:
        out.append(("rest", state.offset + free, (), data[free:stop]))
    return advance(state, data, marks), out


def _texts(texts: tuple[bytes, ...]) -> pa.Array:
    try:
        return pa.array(texts, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())


def _below(file: str, path: str) -> str:
    """The file's path below the folder that was asked for, or else its name."""
    file, root = (unquote(urlparse(x).path).rstrip("/") for x in (file, path))
    return file[len(root) + 1 :] if file.startswith(root + "/") else file.rsplit("/", 1)[-1]


def read_elements(spark: SparkSession, path: str, at: tuple[str, ...] | None, rest: bool = False) -> DataFrame:
    """file, offset, keys, text of the objects in the arrays under the keys ``at`` of the
    documents in ``path``; ``*`` stands for any key and None for the documents
    themselves, one after another in a file. ``keys`` are the keys that led to the
    element, ``offset`` is its first byte and ``file`` the file's path below ``path``.

    With ``rest`` each document is a row more, offset -1 and no keys, with the elements
    taken out; it is put together in one row, so what is left must be small.
    Documents are UTF-8; white space and the order of members are free. Array members
    that are no objects are left out. Text that is not JSON gives undefined rows.
    """
    own = spark.read.option("lineSep", "}").text(path)
    own = own.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    states = spark.sparkContext.broadcast(_states(own))
    schema = StructType.fromDDL(ELEMENT)
    arrow = to_arrow_schema(schema)

    def run(batches):
        now, state, n = None, State(), 0
        for where, data in _ranges(batches):
            if where != now:
                now, n = where, 0
                state = states.value.get(where)
                if state is None:
                    raise RuntimeError(f"{where[0]} was split in another way a moment ago; read it again")
            state, found = _cut_out(state, data, at, rest)
            if found:
                kinds, offsets, keys, texts = zip(*found, strict=True)
                m = len(found)
                cols = {"file": [_below(where[0], path)] * m, "offset": offsets, "range": [where[1]] * m, "seq": range(n, n + m), "kind": kinds, "keys": keys, "text": _texts(texts)}
                n += m
                yield pa.RecordBatch.from_pydict(cols, schema=arrow)

    rows = cut(own.mapInArrow(run, schema))  # read once, for the whole ones and the pieces
    pieces = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("range", "seq", "text"))), lambda p: p["text"]), "").alias("text")
    whole = rows.where("kind = 'whole'").select("file", "offset", "keys", "text")
    parts = rows.where("kind in ('start', 'middle', 'end')").groupBy("file", "offset", "keys").agg(pieces)
    out = whole.unionByName(parts)
    if rest:
        left = rows.where("kind = 'rest'").groupBy("file").agg(pieces)
        out = out.unionByName(left.select("file", F.lit(-1).cast("long").alias("offset"), F.array().cast("array<string>").alias("keys"), "text"))
    return out
