"""Repair of conversation structure at least cost, by a dynamic programme over runs of equal turns.

Each turn is a symbol: what its role is (system, user, assistant, other) and its first fault (blank, duplicate of an
earlier turn, truncated). Edits keep, re-role, delete or insert turns so that the roles read ``(s?(ua)+)?``. The states are:
nothing yet (0), after system (1), after user (2), after assistant (3). A symbol is a 4 x 4 matrix of least costs between
states, inserts before the turn included, and matrices multiply in the min-plus sense. Equal consecutive symbols are one
run, advanced through cached binary powers of its matrix; the choices are then unrolled forwards, at each step the first
letter (D, I, K, R) that still leads to the least cost, which gives the least audit string.

Any conversation may hold any share of the rows. Turns travel without their texts, as SHA-256 of them (equal hashes count
as equal texts; no two texts of equal SHA-256 are known), range partitioned by conversation and order, so a long
conversation is cut into slices; the product of a slice's matrices is all that its neighbours need of it. For the first
and the last conversation of each partition, sixteen numbers reach the driver, which multiplies them from the end and hands
each slice the costs behind it; the slices answer where they lead from each state (four numbers), and get the state
before them. Duplicates are found the same way: ordered by (conversation, role, text, turn), a turn is a duplicate when
the one before it has the same three, and only a partition's first row has to ask the partition before. Copies of a turn
are counted before they are shuffled. A conversation meets in one task only where its repaired text is put together in
order (``repaired_turns``, ``digests``); there it is a sorted stream, of which one turn is held at a time.

Defined results: a null role or text is one blank; null conversation ids are one conversation, a null turn comes first;
turns with equal number are ordered by role, then by the hash of the text; copies stand beside each other and all but one
are duplicates; a role is known by its first letter, and one of other letters than s, u, a (or an empty one) cannot be
kept; an empty text is blank; texts of any length are compared whole; an empty table gives an empty one. Extra columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import pin

NO_WAY = 1 << 40
DELETE, RENAME, INSERT, TRUNCATED = 2, 1, 5, 5
#: Turns of a run that are unrolled from one remembered vector.
STRIDE = 1024
SYSTEM, USER, ASSISTANT, OTHER = range(4)
SOUND, MUST_GO, CUT_SHORT = range(3)
#: Symbols are role * 3 + fault.
NAMES = ("system", "user", "assistant")

Vector = tuple[int, int, int, int]


def _after(state: int) -> int:
    """State after the turn that may come next: a user turn, or the assistant's answer to one."""
    return 3 if state == 2 else 2


def _kept(symbol: int, state: int) -> int | None:
    role = symbol // 3
    if role == SYSTEM:
        return 1 if state == 0 else None
    return _after(state) if role == (ASSISTANT if state == 2 else USER) else None


def _moves(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, state after) of what may be done with a turn."""
    moves, extra = [("D", DELETE, state)], TRUNCATED if symbol % 3 == CUT_SHORT else 0
    if symbol % 3 != MUST_GO:
        if _kept(symbol, state) is not None:
            moves.append(("K", extra, _kept(symbol, state)))
        moves.append(("R", RENAME + extra, _after(state)))
    return moves


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), NO_WAY)


@lru_cache(maxsize=1)
def _inserts() -> np.ndarray:
    """Least cost of inserted turns from state to state."""
    one = np.full((4, 4), NO_WAY)
    for s in range(4):
        one[s, s] = 0
        one[s, _after(s)] = min(one[s, _after(s)], INSERT)
    two = _times(one, one)
    return _times(two, two)


@lru_cache(maxsize=1024)
def power(symbol: int, k: int) -> np.ndarray:
    """Matrix of 2^k turns of one symbol."""
    if k:
        return _times(power(symbol, k - 1), power(symbol, k - 1))
    out = np.full((4, 4), NO_WAY)
    for s in range(4):
        for _, cost, to in _moves(symbol, s):
            out[s, to] = min(out[s, to], cost)
    return _times(_inserts(), out)


def run_matrix(symbol: int, n: int) -> np.ndarray:
    out = np.where(np.eye(4, dtype=bool), 0, NO_WAY)
    for k in range(n.bit_length()):
        if n >> k & 1:
            out = _times(power(symbol, k), out)
    return out


def matrix_of(runs: list[tuple[int, int]]) -> np.ndarray:
    out = np.where(np.eye(4, dtype=bool), 0, NO_WAY)
    for symbol, n in runs:
        out = _times(out, run_matrix(symbol, n))
    return out


def behind(matrix: np.ndarray, costs: Vector) -> Vector:
    """Least costs before the turns of a matrix, given those after them, less their least."""
    out = (matrix + np.array(costs)[None, :]).min(axis=1)
    return tuple(int(x) for x in np.minimum(out - out.min(), NO_WAY))


def at_end() -> Vector:
    """Costs after the last turn: nothing at all, or an answer, may end a conversation."""
    out = _inserts()[:, [0, 3]].min(axis=1)
    return tuple(int(x) for x in out)


@lru_cache(maxsize=1 << 16)
def _step(symbol: int, costs: Vector) -> Vector:
    return behind(power(symbol, 0), costs)


@lru_cache(maxsize=1 << 16)
def _choice(symbol: int, costs: Vector, state: int) -> tuple[str, tuple[int, ...], int]:
    """(letters, inserted and kept roles, state after) of one turn, given the costs after it: the least letters of least cost."""
    letters, roles = "", []
    while True:
        best = (_inserts()[state] + [min(c + costs[to] for _, c, to in _moves(symbol, s)) for s in range(4)]).min()
        options = [(letter, to) for letter, c, to in _moves(symbol, state) if c + costs[to] == best]
        via = _after(state)
        if INSERT + min(c + costs[to] for _, c, to in _moves(symbol, via)) == best:
            options.append(("I", via))
        letter, to = min(options)
        letters += letter
        if letter == "D":
            return letters, tuple(roles), to
        roles.append(symbol // 3 if letter == "K" else USER if to == 2 else ASSISTANT)
        if letter != "I":
            return letters, tuple(roles), to
        state = to


@lru_cache(maxsize=16)
def ending(state: int) -> tuple[str, tuple[int, ...]]:
    """Letters and roles inserted after the last turn."""
    roles = []
    while state not in (0, 3):
        state = _after(state)
        roles.append(USER if state == 2 else ASSISTANT)
    return "I" * len(roles), tuple(roles)


def unrolled(runs: list[tuple[int, int]], costs: Vector, state: int) -> Iterator[tuple[str, tuple[int, ...], int]]:
    """The choice for every turn of the runs, given the costs after the last and the state before the first."""
    after = [costs]
    for symbol, n in reversed(runs[1:]):
        after.append(behind(run_matrix(symbol, n), after[-1]))
    for (symbol, n), last in zip(runs, reversed(after), strict=True):
        left = n
        while left:
            own = (left - 1) % STRIDE + 1
            near = [behind(run_matrix(symbol, left - own), last)]
            while len(near) < own:
                near.append(_step(symbol, near[-1]))
            for costs_after in reversed(near):
                letters, roles, state = _choice(symbol, costs_after, state)
                yield letters, roles, state
            left -= own


def exits(runs: list[tuple[int, int]], costs: Vector) -> list[int]:
    """State after the runs from each state before them."""
    out = []
    for state in range(4):
        for _, _, state in unrolled(runs, costs, state):  # noqa: B007, PLW2901
            pass
        out.append(state)
    return out


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text, n after damage by the hash of conversation and turn; n is how often the turn stands there."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank(conv), F.lit(":"), blank(turn)).cast("binary")) % 20
    new_text = F.when(kind == 1, "").when(kind == 2, F.translate(blank(text), ".!?", "")).otherwise(blank(text))
    return rows.where(kind != 0).select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.when(kind == 4, "user").otherwise(blank(role)).alias("role"),
                                        new_text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("n"))


def _named(turns: DataFrame) -> DataFrame:
    return turns.withColumn("name", F.unhex(F.sha2("text", 256)))


def counted(turns: DataFrame) -> DataFrame:
    """conv, turn, role, name (hash of the text), n, state of the text: one row for equal turns. ``turns`` has conv, turn, role, text, n."""
    found = (F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), MUST_GO).when(F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), SOUND).otherwise(CUT_SHORT))
    return _named(turns).withColumn("found", found).groupBy("conv", "turn", "role", "name", "found").agg(F.sum("n").cast("long").alias("n"))


def _same(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Null-safe equality."""
    both = pc.and_(pc.is_null(a), pc.is_null(b))
    return pc.or_(pc.fill_null(pc.equal(a, b), False), both).to_numpy(zero_copy_only=False)


def with_repeats(turns: DataFrame) -> DataFrame:
    """Adds ``repeat``: an earlier turn of the conversation has the same role and text."""
    order = ["conv", "role", "name", "turn"]
    at = [turns.columns.index(c) for c in order[:3]]
    names = [*turns.columns, "repeat", "part", "edge"]
    fields = ", ".join(f"`{c}` {t}" for c, t in turns.dtypes)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None
        held = None  # the last row waits until it is known to be the last
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(i) for i in at]
            same = np.ones(batch.num_rows, bool)
            for k in keys:
                same[1:] &= _same(k[1:], k[:-1])
            same[0] = last is not None and [k[0].as_py() for k in keys] == last
            edge = np.zeros(batch.num_rows, np.int32)
            edge[0] = 1 if last is None else 0
            last = [k[-1].as_py() for k in keys]
            if held is not None:
                yield held
            held = pa.RecordBatch.from_arrays([*batch.columns, pa.array(same), pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(edge)], names)
        if held is not None:
            edge = np.array(held.column(len(names) - 1))
            edge[-1] |= 2
            yield pa.RecordBatch.from_arrays([*held.columns[:-1], pa.array(edge)], names)

    ranged = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = pin(ranged.mapInArrow(mark, f"{fields}, repeat boolean, part int, edge int"))
    # a partition's first row against the last row of the partition before: two rows a partition
    ends = marked.where("edge > 0").select("part", "edge", "conv", "role", "name").collect()
    first = {r["part"]: tuple(r)[2:] for r in ends if r["edge"] & 1}
    last = {r["part"]: tuple(r)[2:] for r in ends if r["edge"] & 2}
    parts = sorted(first)
    led = [b for a, b in zip(parts, parts[1:], strict=False) if last[a] == first[b]]
    return marked.withColumn("repeat", F.col("repeat") | ((F.col("edge").bitwiseAND(F.lit(1)) == 1) & F.col("part").isin(led))).drop("part", "edge")


def with_symbols(turns: DataFrame) -> DataFrame:
    """Adds symbol; ``found`` becomes the fault of the first copy."""
    letter = F.substring("role", 1, 1)
    role: Column = F.when(letter == "s", SYSTEM).when(letter == "u", USER).when(letter == "a", ASSISTANT).otherwise(OTHER)
    fault = F.when(F.col("found") == MUST_GO, "blank").when(F.col("repeat"), "duplicate").when(F.col("found") == CUT_SHORT, "truncated").otherwise("none")
    code = F.when(F.col("fault") == "none", SOUND).when(F.col("fault") == "truncated", CUT_SHORT).otherwise(MUST_GO)
    return turns.withColumn("fault", fault).withColumn("symbol", (role * 3 + code).cast("int")).drop("found", "repeat")


class _Runs(list):
    """Runs (symbol, number) of the turns that are added. Further copies of a turn are left out: deleting them moves no state."""

    def add(self, symbol: int) -> None:
        if self and self[-1][0] == symbol:
            self[-1] = (symbol, self[-1][1] + 1)
        else:
            self.append((symbol, 1))


def _sliced(ordered: DataFrame) -> DataFrame:
    """The turns in order, with part and at; and for the first and last conversation of a part a row with the product of its matrices."""
    kinds = dict(ordered.dtypes)
    columns = ["conv", "turn", "role", "name", "n", "fault", "symbol"]
    fields = ", ".join(f"{c} {kinds[c]}" for c in columns)

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, conv, runs, first = TaskContext.get().partitionId(), 0, None, _Runs(), None
        schema = None
        for batch in batches:
            n = batch.num_rows
            schema = schema or pa.schema([*batch.schema, ("part", pa.int32()), ("at", pa.int64()), ("matrix", pa.list_(pa.int64()))])
            for i, (c, symbol) in enumerate(zip(batch.column(0).to_pylist(), batch.column(6).to_pylist(), strict=True), at):
                if i and c != conv:
                    first, runs = first or (conv, runs), _Runs()
                conv = c
                runs.add(symbol)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n)), pa.nulls(n, pa.list_(pa.int64()))], schema=schema)
            at += n
        if schema:
            ends = [first, (conv, runs)] if first else [(conv, runs)]
            yield pa.RecordBatch.from_pylist([{"conv": c, "part": part, "at": place, "matrix": matrix_of(r).ravel().tolist()} for place, (c, r) in enumerate(ends)], schema=schema)

    order = ["conv", "turn", "role", "name"]
    ranged = ordered.select(columns).repartitionByRange(*order).sortWithinPartitions(*order)
    return pin(ranged.mapInArrow(slices, f"{fields}, part int, at long, matrix array<long>"))


def _in_order(turns: DataFrame, parts: int) -> DataFrame:
    """Each part in a task of its own, in order."""
    return turns.repartitionById(parts, "part").sortWithinPartitions("part", "at")


def _chains(sliced: DataFrame) -> tuple[list[list], int]:
    """Slices of cut conversations, in order; and how many parts there are."""
    chains: list[list] = []
    rows = sorted(sliced.where("matrix is not null").select("part", "at", "conv", "matrix").collect(), key=lambda r: (r["part"], r["at"]))
    for row in rows:
        if chains and chains[-1][-1]["conv"] == row["conv"] and chains[-1][-1]["part"] != row["part"]:
            chains[-1].append(row)
        else:
            chains.append([row])
    return [c for c in chains if len(c) > 1], rows[-1]["part"] + 1 if rows else 1


def edits(turns: DataFrame) -> DataFrame:
    """One row for equal turns, as ``counted`` gives them: conv, turn, role, name, n, fault, letters, roles, more.

    ``letters`` are the edits at the turn's first copy, with what is inserted before it; ``roles`` the roles (0 system, 1
    user, 2 assistant) of the turns that these leave, the last of them with the turn's own text unless it is deleted.
    Further copies are deleted. ``more`` are the roles inserted after a conversation's last turn.
    """
    sliced = _sliced(with_symbols(with_repeats(turns)))
    chains, parts = _chains(sliced)
    costs: dict[tuple[int, object], Vector] = {}
    for chain in chains:
        now = at_end()
        for row in reversed(chain):
            costs[row["part"], row["conv"]] = now
            now = behind(np.array(row["matrix"]).reshape(4, 4), now)
    rows = sliced.where("matrix is null").drop("matrix")
    known: dict[tuple[int, object], tuple[Vector, int, bool]] = {}
    if chains:
        ways = _exits(rows, costs, parts)
        for chain in chains:
            state = 0
            for row in chain:
                name = row["part"], row["conv"]
                known[name] = costs[name], state, row is chain[-1]
                state = ways[name][state]
    return _unrolled(rows, known, parts)


def _exits(rows: DataFrame, costs: dict[tuple[int, object], Vector], parts: int) -> dict[tuple[int, object], list[int]]:
    """Where each slice of a cut conversation leads from each state. One row a slice comes back, at most two a partition."""
    kind = rows.schema["conv"].dataType.simpleString()
    cut = sorted({p for p, _ in costs})

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part, conv), runs in _slices_of(batches):
            if (part, conv) in costs:
                yield pa.RecordBatch.from_pylist([{"part": part, "conv": conv, "exits": exits(runs, costs[part, conv])}], schema=out)

    out = pa.schema([("part", pa.int32()), ("conv", _arrow_type(rows, "conv")), ("exits", pa.list_(pa.int32()))])
    narrow = _in_order(rows.where(F.col("part").isin(cut)).select("part", "at", "conv", "symbol"), parts).select("part", "conv", "symbol")
    return {(r["part"], r["conv"]): r["exits"] for r in narrow.mapInArrow(leads, f"part int, conv {kind}, exits array<int>").collect()}


def _slices_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, object], _Runs]]:
    """((part, conv), runs) from rows (part, conv, symbol) in order."""
    name, runs = None, _Runs()
    for batch in batches:
        for part, conv, symbol in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if name is not None and (part, conv) != name:
                yield name, runs
                runs = _Runs()
            name = part, conv
            runs.add(symbol)
    if name is not None:
        yield name, runs


def _unrolled(rows: DataFrame, known: dict[tuple[int, object], tuple[Vector, int, bool]], parts: int) -> DataFrame:
    kinds = dict(rows.dtypes)
    columns = ["part", "conv", "symbol", "n", "turn", "role", "name", "fault"]
    fields = ", ".join(f"{c} {kinds[c]}" for c in columns[1:2] + columns[3:])
    whole = (at_end(), 0, True)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def settled(name, pieces):
            rows_ = pa.Table.from_batches(pieces)
            runs, letters, roles = _Runs(), [], []
            for symbol in rows_.column(2).to_pylist():
                runs.add(symbol)
            after, state, last = known.get(name, whole)
            for found, kept, state in unrolled(runs, after, state):  # noqa: B020
                letters.append(found), roles.append(list(kept))
            more = [None] * len(letters)
            more[-1] = list(ending(state)[1]) if last else None
            own = [rows_.column(i).combine_chunks() for i in (1, 3, 4, 5, 6, 7)]
            roles, more = pa.array(roles, pa.list_(pa.int32())), pa.array(more, pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([*own, pa.array(letters, pa.string()), roles, more], ["conv", "n", "turn", "role", "name", "fault", "letters", "roles", "more"])

        name, ready, size = None, [], 0
        for batch in batches:
            marks = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            start = 0
            for i, mark in enumerate(marks):
                if mark != name:
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    if held:
                        ready.append(settled(name, held))
                        size += ready[-1].num_rows
                    name, held, start = mark, [], i
                    if size >= 4096:
                        yield _one(ready)
                        ready, size = [], 0
            if len(marks) > start:
                held.append(batch.slice(start))
        if held:
            ready.append(settled(name, held))
        if ready:
            yield _one(ready)

    return _in_order(rows, parts).select(columns).mapInArrow(decide, f"{fields}, letters string, roles array<int>, more array<int>")


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(i) for b in batches]) for i in range(batches[0].num_columns)], batches[0].schema.names)


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


#: Keys of texts that a task remembers, so as to send a text of many copies once.
SENT = 1 << 16


def _distinct_texts(turns: DataFrame) -> DataFrame:
    """conv, turn, role, name, text; of equal rows a task sends one, as far as it remembers."""
    named = _named(turns).select("conv", "turn", "role", "name", "text")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set = set()
        for batch in batches:
            new = []
            for key in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                new.append(key not in sent)
                sent.add(key)
            if len(sent) > SENT:
                sent = set()
            yield batch.filter(pa.array(new, pa.bool_()))

    return named.mapInArrow(once, named.schema)


def _stream(turns: DataFrame, decided: DataFrame, convs: DataFrame | None) -> DataFrame:
    """Rows (conv, turn, role, name, kind, text, fault, n, letters, roles, more) in order: a mark of the conversation, then each decision and its text."""
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("fault", "string"), ("n", "long"), ("letters", "string"), ("roles", "array<int>"), ("more", "array<int>"))]
    texts = _distinct_texts(turns).select("conv", "turn", "role", "name", F.lit(2).alias("kind"), "text", *nothing)
    choices = decided.select("conv", "turn", "role", "name", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("text"), "fault", "n", "letters", "roles", "more")
    out = choices.unionByName(texts)
    if convs is not None:
        empty = [F.lit(None).cast(t).alias(c) for c, t in out.dtypes if c not in ("conv", "kind")]
        out = out.unionByName(convs.select("conv", F.lit(0).alias("kind"), *empty))
    return out.repartition("conv").sortWithinPartitions("conv", F.col("kind") > 0, "turn", "role", "name", "kind").select(
        "conv", "turn", "role", "name", "kind", "text", "fault", "n", "letters", "roles", "more")


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, tuple | None]]:
    """(conversation, None) at its beginning, then (conversation, (turn, role, fault, n, letters, roles, more, text)) for each turn."""
    conv, begun, choice, name = None, False, None, None
    for batch in batches:
        for c, turn, role, text_name, kind, text, *rest in zip(*(col.to_pylist() for col in batch.columns), strict=True):
            if not begun or c != conv:
                conv, begun = c, True
                yield conv, None
            if kind == 1:
                choice, name = (turn, role, *rest), (turn, role, text_name)
            elif kind == 2 and choice is not None and (turn, role, text_name) == name:
                yield conv, (*choice, text)
                choice = None  # further copies of the text are passed over


def _left(entry: tuple) -> Iterator[tuple[str, str]]:
    """(role, text) of what an entry leaves: inserted turns, itself, and turns inserted at the end."""
    _, role, _, _, letters, roles, more, text = entry
    inserted = roles if letters.endswith("D") else roles[:-1]
    yield from ((NAMES[r], "") for r in inserted)
    if not letters.endswith("D"):
        yield (role if letters.endswith("K") else NAMES[roles[-1]]), text
    yield from ((NAMES[r], "") for r in more or [])


def repaired_turns(turns: DataFrame) -> DataFrame:
    """conv, place, role, text of the repaired conversations. ``turns`` has conv, turn, role, text and n."""
    kind = turns.schema["conv"].dataType.simpleString()
    out = pa.schema([("conv", _arrow_type(turns, "conv")), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, size = 0, [], 0
        for conv, entry in _entries(batches):
            place = 0 if entry is None else place
            for role, text in _left(entry) if entry else ():
                held.append({"conv": conv, "place": place, "role": role, "text": text})
                place, size = place + 1, size + len(text)
            if len(held) >= 512 or size >= 4 << 20:
                yield pa.RecordBatch.from_pylist(held, schema=out)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=out)

    return _stream(turns, edits(counted(turns)), None).mapInArrow(write, f"conv {kind}, place long, role string, text string")


class _Digest:
    """Counts, audit and hash of one conversation, turn by turn."""

    def __init__(self, conv: object):
        self.conv, self.hash, self.audit, self.any_left = conv, hashlib.sha256(), [], False
        self.low = self.high = self.turn = self.letter = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0

    def add(self, entry: tuple) -> None:
        turn, role, fault, n, letters, _, more, _ = entry
        if turn is not None:
            self.low, self.high = turn if self.low is None else self.low, turn
            self.turns += turn != self.turn
            self.turn = turn
        letter = role[:1]
        self.illegal += (self.letter is not None and self.letter + letter not in ("su", "ua", "au")) + n - 1
        self.letter = letter
        self.blank += n if fault == "blank" else 0
        self.duplicate += 0 if fault == "blank" else n - (fault != "duplicate")
        self.truncated += fault == "truncated"
        self.cost += DELETE * (letters.count("D") + n - 1) + RENAME * letters.count("R") + INSERT * (letters.count("I") + len(more or ()))
        self.cost += TRUNCATED if fault == "truncated" and not letters.endswith("D") else 0
        self.audit.append(letters + "D" * (n - 1) + "I" * len(more or ()))
        for kept_role, text in _left(entry):
            self.hash.update(f"{chr(10) if self.any_left else ''}{kept_role}:{text}".encode())
            self.any_left = True

    def row(self) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"conv": self.conv, "gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal,
                "cost": self.cost, "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest()}


def digests(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """For each conversation in ``convs`` (column conv): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    kind = turns.schema["conv"].dataType.simpleString()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    out = pa.schema([("conv", _arrow_type(turns, "conv")), *[(c, pa.int64()) for c in counts], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for conv, entry in _entries(batches):
            if entry is not None:
                now.add(entry)
                continue
            if now is not None:
                done.append(now.row())
            now = _Digest(conv)
            if len(done) >= 4096:
                yield pa.RecordBatch.from_pylist(done, schema=out)
                done = []
        if now is not None:
            yield pa.RecordBatch.from_pylist([*done, now.row()], schema=out)

    fields = ", ".join(f"{c} long" for c in counts)
    return _stream(turns, edits(counted(turns)), convs.select("conv").distinct()).mapInArrow(summed, f"conv {kind}, {fields}, audit string, repaired_sha256 string")
