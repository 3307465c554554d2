"""Cheapest repair of conversation structure, with ties ranked by prefix doubling.

A repair walks the rows of a conversation through four states (nothing yet, after a system row, after a user row, after an assistant
row). Costs are a shortest path, so rows act as 4 x 4 matrices over (min, +). Rows are numbered in order and cut into chunks of
bounded size, whatever conversation they belong to; each piece of a conversation in a chunk is multiplied to one matrix, and cost vectors
travel over the pieces by doubling steps. Inside a piece every node on an optimal arc is ranked by the first letters of its least audit,
then by two, four, eight letters and so on, each rank coming from two ranks of the level before and a doubled pointer; the
pointers then give the least path. Every letter leads from a node to one node only, so the least audit of a length ends at one node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.tables import column
from tarmac.operators.ids import dense_id
from tarmac.sources.scratch import stage

# Rows of one chunk; a conversation of more rows is cut into pieces.
CHUNK = 4096
SPACES = " \t\n\v\f\r"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
NEW_ROLES = ("user", "assistant")

# States and codes of rows: initial s, u, a or another one, whole or truncated; last the rows that have to go.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
GONE = 8
_KEPT = {0: {NOTHING: SYSTEM}, 1: {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, 2: {USER: ASSISTANT}, 3: {}}
# The state after a new user or assistant row; every state has one.
_FILLED = {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
# Letters in ASCII order, by which ties are broken; the end comes before all of them.
LETTERS = "DIKR"
_D, _I, _K, _R = range(4)
_FAR = np.int64(1) << 60


def _arcs(code: int) -> list[tuple[int, int, int, int]]:
    """(state, letter, next state, cost) of the arcs that use up a row of this code."""
    out = [(state, _D, state, DELETE) for state in range(STATES)]
    if code < GONE:
        extra = TRUNCATED * (code % 2)
        out += [(state, _K, then, extra) for state, then in _KEPT[code // 2].items()]
        out += [(state, _R, then, REROLE + extra) for state, then in _FILLED.items()]
    return out


_INSERTS = np.full((STATES, STATES), _FAR)
for _state in range(STATES):
    _INSERTS[_state, _state] = 0
    _INSERTS[_state, _FILLED[_state]] = INSERT
for _state in range(STATES):  # two rows at most are ever put in at one place
    _then = _FILLED[_FILLED[_state]]
    _INSERTS[_state, _then] = min(_INSERTS[_state, _then], 2 * INSERT)


def _through(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.minimum((left[..., :, :, None] + right[..., None, :, :]).min(axis=-2), _FAR)


def _row_matrices() -> np.ndarray:
    out = np.full((GONE + 1, STATES, STATES), _FAR)
    for code in range(GONE + 1):
        for state, _, then, cost in _arcs(code):
            out[code, state, then] = min(out[code, state, then], cost)
    return _through(_INSERTS[None], out)


_ROWS = _row_matrices()
# A conversation may end with nothing or after an assistant row.
_END = (_INSERTS + np.array([0, _FAR, _FAR, 0])).min(axis=1)


def product(codes: np.ndarray) -> np.ndarray:
    """The cost matrix of a run of rows, multiplied in pairs."""
    found = _ROWS[codes]
    while len(found) > 1:
        odd = found[len(found) // 2 * 2:]
        found = np.concatenate([_through(found[0:len(found) // 2 * 2:2], found[1:len(found) // 2 * 2:2]), odd])
    return found[0]


class Pieces:
    """The pieces of conversations in one chunk, one behind the other: a place for every row, and one behind the last row of each piece.

    ``codes`` has the row's code at each place and -1 behind a piece; node ``place * 4 + state``.
    """

    def __init__(self, table: pa.Table):
        table = table.sort_by("pos")
        self.conv, self.pos = table.column("conv").to_pylist(), table.column("pos").to_numpy()
        rows = len(self.conv)
        begins = np.array([i == 0 or self.conv[i] != self.conv[i - 1] for i in range(rows)], dtype=bool)
        self.first_rows = np.flatnonzero(begins)
        self.lengths = np.diff(np.append(self.first_rows, rows))
        self.place = np.arange(rows) + np.cumsum(begins) - 1
        self.starts = self.first_rows + np.arange(len(self.first_rows))
        self.ends = self.starts + self.lengths
        self.codes = np.full(rows + len(self.starts), -1)
        self.codes[self.place] = table.column("code").to_numpy()
        # Facts stand on the first row of each piece.
        self.facts = table.take(pa.array(self.first_rows, pa.int64()))

    def rows_of(self, piece: int) -> np.ndarray:
        return self.codes[self.starts[piece]:self.ends[piece]]


def costs_before(codes: np.ndarray, ends: np.ndarray, lengths: np.ndarray, after: np.ndarray) -> np.ndarray:
    """[place, state]: the least cost from each place, given the costs ``after`` each piece; all pieces take a step back at once."""
    found = np.full((len(codes), STATES), _FAR)
    found[ends] = after
    for back in range(1, int(lengths.max(initial=0)) + 1):
        at = ends[lengths >= back] - back
        found[at] = (_ROWS[codes[at]] + found[at + 1][:, None, :]).min(axis=2)
    return np.minimum(found, _FAR)


def optimal_arcs(codes: np.ndarray, costs: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """[node, letter]: the node that an optimal arc with this letter leads to, -1 without one.

    Rows may be put in before every row, and at the places of ``filled``, which end a conversation.
    """
    then = np.full((len(codes) * STATES, len(LETTERS)), -1, dtype=np.int64)
    places = np.flatnonzero((codes >= 0) | filled)
    for state in range(STATES):
        best = places[costs[places, state] == INSERT + costs[places, _FILLED[state]]]
        then[best * STATES + state, _I] = best * STATES + _FILLED[state]
    for code in range(GONE + 1):
        at = np.flatnonzero(codes == code)
        for state, letter, following, cost in _arcs(code):
            best = at[costs[at, state] == cost + costs[at + 1, following]]
            then[best * STATES + state, letter] = (best + 1) * STATES + following
    return then


def ranked_pointers(then: np.ndarray) -> list[np.ndarray]:
    """Pointers of 1, 2, 4, ... letters along the least audit of every node; a final node points to itself.

    Ranks order the nodes by their least audits of that many letters: at first by the letter, then by the rank of the first half and that of the
    node where it ends. Of arcs with one letter the one to the lower rank would be taken; here there is one only.
    """
    nodes = np.arange(len(then))
    inner = then >= 0
    final = ~inner.any(axis=1)
    letter = np.where(final, -1, inner.argmax(axis=1))
    pointer = np.where(final, nodes, then[nodes, np.maximum(letter, 0)])
    rank = letter + 1
    pointers = [pointer]
    while True:
        pairs = rank * np.int64(len(then) + 2) + rank[pointer]
        rank = np.unique(pairs, return_inverse=True)[1]
        further = pointer[pointer]
        if (further == pointer).all():
            return pointers
        pointer = further
        pointers.append(pointer)


def least_paths(pointers: list[np.ndarray], starts: np.ndarray) -> np.ndarray:
    """All nodes on the least audits from ``starts``; each level halves the steps between the nodes known so far."""
    path = np.append(starts, pointers[-1][starts])
    for pointer in reversed(pointers):
        path = np.unique(np.append(path, pointer[path]))
    return path


def planned(then: np.ndarray, path: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By place: rows put in before it, its letter (-1 at the end of a piece) and the state in which it is met."""
    place, state = path // STATES, path % STATES
    inner = then[path] >= 0
    letter = np.where(inner.any(axis=1), inner.argmax(axis=1), -1)
    put_in = np.bincount(place[letter == _I], minlength=len(then) // STATES)
    letters, states = np.full(len(put_in), -1), np.full(len(put_in), -1)
    here = letter != _I
    letters[place[here]], states[place[here]] = letter[here], state[here]
    return put_in, letters, states


def _new_roles(count: int, state: int) -> list[str]:
    """Roles of rows put in, of which the last one leads to ``state``; they alternate."""
    last = NEW_ROLES[0] if state == USER else NEW_ROLES[1]
    other = NEW_ROLES[1] if state == USER else NEW_ROLES[0]
    return [other, last][2 - count:] if count else []


def _multiply(table: pa.Table) -> pa.Table:
    pieces = Pieces(table)
    matrices = [product(pieces.rows_of(piece)).ravel().tolist() for piece in range(len(pieces.starts))]
    return pa.table({"conv": pa.array([pieces.conv[row] for row in pieces.first_rows], pa.string()), "first": pa.array(pieces.pos[pieces.first_rows], pa.int64()),
                     "matrix": pa.array(matrices, pa.list_(pa.int64()))})


def _ranked(pieces: Pieces) -> tuple[np.ndarray, list[np.ndarray]]:
    after = np.array(pieces.facts.column("after").to_pylist(), dtype=np.int64).reshape(-1, STATES)
    costs = costs_before(pieces.codes, pieces.ends, pieces.lengths, after)
    filled = np.zeros(len(pieces.codes), dtype=bool)
    filled[pieces.ends] = np.array(pieces.facts.column("last").to_pylist(), dtype=bool)
    then = optimal_arcs(pieces.codes, costs, filled)
    return then, ranked_pointers(then)


def _exits(table: pa.Table) -> pa.Table:
    """Per piece: the state in which the least path leaves it, for every state in which it is entered."""
    pieces = Pieces(table)
    _, pointers = _ranked(pieces)
    nodes = pieces.starts[:, None] * STATES + np.arange(STATES)
    return pa.table({"first": pa.array(pieces.pos[pieces.first_rows], pa.int64()),
                     "exits": pa.array((pointers[-1][nodes] % STATES).tolist(), pa.list_(pa.int32()))})


def _edits(table: pa.Table) -> pa.Table:
    """Per row: how many rows are put in before it, its letter, its new role; the last row also tells how many follow it."""
    pieces = Pieces(table)
    then, pointers = _ranked(pieces)
    entries = np.array(pieces.facts.column("entry").to_pylist(), dtype=np.int64)
    put_in, letters, states = planned(then, least_paths(pointers, pieces.starts * STATES + entries))
    behind = {int(end) - 1: _new_roles(int(put_in[end]), int(states[end])) for end in pieces.ends if put_in[end]}
    out = []
    for pos, place in zip(pieces.pos.tolist(), pieces.place.tolist()):
        state, letter = int(states[place]), int(letters[place])
        new_role = (NEW_ROLES[0] if _FILLED[state] == USER else NEW_ROLES[1]) if letter == _R else None
        out.append((pos, _new_roles(int(put_in[place]), state), LETTERS[letter], new_role, behind.get(place, [])))
    kinds = {"_pos": pa.int64(), "before": pa.list_(pa.string()), "letter": pa.string(), "new_role": pa.string(), "behind": pa.list_(pa.string())}
    return pa.table({name: pa.array([row[i] for row in out], kind) for i, (name, kind) in enumerate(kinds.items())})


def _after_costs(pieces: DataFrame, longest: int) -> DataFrame:
    """first, conv, piece, last, after: the least costs from the end of each piece, by doubling over the pieces of a conversation.

    After k steps a piece knows the product of the 2^k pieces behind it; conversations of one piece need no step.
    """
    def joined(left: str, right: str) -> str:
        return f"""transform(sequence(0, 15), p -> least({_FAR}, array_min(transform(sequence(0, 3), k ->
            element_at({left}, CAST(4 * (p div 4) + k + 1 AS int)) + element_at({right}, CAST(4 * k + p % 4 + 1 AS int))))))"""

    state = pieces.withColumn("behind", F.lit(None).cast("array<bigint>"))
    further = pieces.select(F.col("conv").alias("_conv"), F.col("piece").alias("_piece"), F.col("matrix").alias("_matrix"))
    step = 1
    if longest > 1:
        # behind: the product of the pieces that follow, at first of the next one alone.
        state = stage(pieces.join(further, F.expr("conv <=> _conv AND piece + 1 = _piece"), "left").select(
            *pieces.columns, F.col("_matrix").alias("behind")), "repair-costs")
        while step < longest:
            far = state.where("behind IS NOT NULL").select(F.col("conv").alias("_conv"), F.col("piece").alias("_piece"), F.col("behind").alias("_behind"))
            state = stage(state.join(far, F.expr(f"conv <=> _conv AND piece + {step} = _piece"), "left").select(
                *pieces.columns, F.expr(f"CASE WHEN _behind IS NULL OR behind IS NULL THEN behind ELSE {joined('behind', '_behind')} END").alias("behind")), "repair-costs")
            step *= 2
    end = f"array({','.join(map(str, _END.tolist()))})"
    return state.withColumn("last", F.col("behind").isNull()).withColumn("after", F.expr(f"""
        CASE WHEN behind IS NULL THEN CAST({end} AS array<bigint>) ELSE transform(sequence(0, 3), s -> array_min(transform(sequence(0, 3), k ->
            element_at(behind, CAST(4 * s + k + 1 AS int)) + element_at(CAST({end} AS array<bigint>), CAST(k + 1 AS int))))) END""")).drop("behind")


def _entries(exits: DataFrame, longest: int) -> DataFrame:
    """first, entry: the state in which the least path enters each piece, by doubled pointers over the pieces."""
    # reach: the state after the 2^k pieces before this one, for every state in which the first of them is entered.
    previous = exits.select(F.col("conv").alias("_conv"), (F.col("piece") + 1).alias("_piece"), F.col("exits").alias("reach"))
    state = exits.select("first", "conv", "piece").withColumn("reach", F.lit(None).cast("array<int>"))
    step = 1
    if longest > 1:
        state = stage(exits.select("first", "conv", "piece").join(previous, F.expr("conv <=> _conv AND piece = _piece"), "left").select(
            "first", "conv", "piece", "reach"), "repair-entries")
        while step < longest:
            before = state.select(F.col("conv").alias("_conv"), (F.col("piece") + step).alias("_piece"), F.col("reach").alias("_reach"))
            state = stage(state.join(before, F.expr("conv <=> _conv AND piece = _piece"), "left").select("first", "conv", "piece", F.expr(
                "CASE WHEN _reach IS NULL OR reach IS NULL THEN reach ELSE transform(_reach, s -> element_at(reach, s + 1)) END").alias("reach")), "repair-entries")
            step *= 2
    return state.select("first", F.coalesce(F.col("reach")[NOTHING], F.lit(NOTHING)).alias("entry"))


def ordered_rows(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """pos, conv (text of the conversation's id, null for none), turn, role, text, code, fault: rows in order, with the first fault of each."""
    rows = df.select(F.col(column(conversation)).cast("string").alias("conv"), F.col(column(turn)).cast("bigint").alias("turn"),
                     F.coalesce(F.col(column(role)).cast("string"), F.lit(" ")).alias("role"),
                     F.coalesce(F.col(column(text)).cast("string"), F.lit(" ")).alias("text"))
    # Rows alike in all of these are interchangeable; they are spread over tasks by their physical position.
    numbered = dense_id(rows, order_by=["conv", "turn", "role", "text"], name="pos")
    marked = numbered.withColumn("trimmed", F.rtrim("text", F.lit(SPACES))).select(
        "pos", "conv", "turn", "role", "text", (F.col("trimmed") == "").alias("blank"),
        (~F.substring("trimmed", -1, 1).isin(".", "!", "?")).alias("open"),
        F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("same"))
    first = marked.groupBy("conv", "same").agg(F.min("pos").alias("_pos")).select("_pos")
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 2).when(initial == "a", 4).otherwise(6)
    fault = F.when(F.col("blank"), "blank").when(F.col("_pos").isNull(), "duplicate").when(F.col("open"), "truncated")
    return stage(marked.join(first, F.col("pos") == F.col("_pos"), "left").withColumn("fault", fault).select(
        "pos", "conv", "turn", "role", "text", "fault",
        F.when(F.col("fault").isin("blank", "duplicate"), GONE).otherwise(kind + F.coalesce((F.col("fault") == "truncated").cast("int"), F.lit(0))).alias("code")),
        "repair-rows")


def edits(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows of ``ordered_rows`` with before and behind (roles of rows to put in), letter and new_role; ``cost`` on a conversation's first row.

    No task holds more than ``chunk`` narrow rows, whatever their conversations.
    """
    narrow = rows.select("pos", "conv", "code", F.expr(f"pos div {chunk}").alias("chunk"))
    multiplied = stage(narrow.groupBy("chunk").applyInArrow(_multiply, "conv string, first bigint, matrix array<bigint>"), "repair-pieces")
    # Pieces of one conversation lie in chunks that follow each other.
    span = multiplied.groupBy("conv").agg(F.min(F.expr(f"first div {chunk}")).alias("_chunk"), F.max(F.expr(f"first div {chunk}")).alias("_to"))
    longest = span.agg(F.max(F.col("_to") - F.col("_chunk") + 1)).collect()[0][0] or 1
    pieces = stage(multiplied.join(span.withColumnRenamed("conv", "_conv"), F.col("conv").eqNullSafe(F.col("_conv"))).select(
        "first", "conv", F.expr(f"first div {chunk} - _chunk").alias("piece"), "matrix"), "repair-numbered")
    known = stage(_after_costs(pieces, longest), "repair-after")
    facts = known.select("first", "after", "last")

    def with_facts(facts: DataFrame) -> DataFrame:
        return narrow.join(facts, F.col("pos") == F.col("first"), "left")

    exits = stage(with_facts(facts).groupBy("chunk").applyInArrow(_exits, "first bigint, exits array<int>"), "repair-exits")
    entries = _entries(stage(exits.join(known.select(F.col("first").alias("_first"), "conv", "piece"), F.col("first") == F.col("_first")).drop("_first"),
                             "repair-exits"), longest)
    entered = stage(facts.join(entries.withColumnRenamed("first", "_first"), F.col("first") == F.col("_first")).drop("_first"), "repair-entered")
    found = stage(with_facts(entered).groupBy("chunk").applyInArrow(
        _edits, "_pos bigint, before array<string>, letter string, new_role string, behind array<string>"), "repair-edits")
    start = known.where("piece = 0").select(F.col("first").alias("_first"), F.expr(f"""
        array_min(transform(sequence(0, 3), k -> element_at(matrix, k + 1) + element_at(after, k + 1)))""").alias("cost"))
    return rows.join(found, F.col("pos") == F.col("_pos")).join(start, F.col("pos") == F.col("_first"), "left").drop("_pos", "_first")


def repaired(edited: DataFrame) -> DataFrame:
    """conv, pos, place, role, text: the rows that remain and the new ones, in the order of pos and place."""
    return edited.select("conv", "pos", F.inline(F.expr("""
        concat(transform(before, (r, i) -> named_struct('place', i, 'role', r, 'text', '')),
               IF(letter = 'D', array(), array(named_struct('place', size(before), 'role', coalesce(new_role, role), 'text', text))),
               transform(behind, (r, i) -> named_struct('place', size(before) + 1 + i, 'role', r, 'text', '')))""")))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by conversation and pos; a conversation is hashed row by row and never held whole."""
    names = ("blank", "duplicate", "truncated", "illegal", "cost")
    kinds = [pa.string(), *(pa.int64() for _ in names), pa.string(), pa.string()]
    key, counts, audit, digest, last, lines = None, None, [], None, None, 0
    done: list[tuple] = []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*done)) if done else [()] * len(kinds)
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(columns, kinds)],
                                          names=["conv", *names, "audit", "repaired_sha256"])

    def close() -> None:
        if counts is not None:
            done.append((key, *(counts[name] for name in names), "".join(audit), digest.hexdigest()))

    for batch in batches:
        for row in batch.to_pylist():
            if counts is None or row["conv"] != key:
                close()
                key, counts, audit, digest, last, lines = row["conv"], dict.fromkeys(names, 0), [], hashlib.sha256(), None, 0
            if row["fault"]:
                counts[row["fault"]] += 1
            if row["cost"] is not None:
                counts["cost"] = row["cost"]
            initial = row["role"][:1]
            if last is not None and last + initial not in ("su", "ua", "au"):
                counts["illegal"] += 1
            last = initial
            audit.append("I" * len(row["before"]) + row["letter"] + "I" * len(row["behind"]))
            kept = [] if row["letter"] == "D" else [f"{row['new_role'] or row['role']}:{row['text']}"]
            for line in [f"{r}:" for r in row["before"]] + kept + [f"{r}:" for r in row["behind"]]:
                digest.update((("\n" if lines else "") + line).encode("utf-8", "surrogatepass"))
                lines += 1
        yield flush()
    close()
    yield flush()


def damage(df: DataFrame) -> DataFrame:
    """Columns conv_id, turn, role, text of ``df`` with faults put in by crc32(``conv_id:turn``) modulo 20; nulls in texts count as one space."""
    def blank(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fault = F.expr("CAST(crc32(CAST(_key AS binary)) % 20 AS int)")
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return df.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"),
                     F.concat(blank("conv_id"), F.lit(":"), blank("turn")).alias("_key")).withColumn("_fault", fault).where("_fault <> 0").select(
        "conv_id", "turn", F.when(F.col("_fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.when(F.col("_fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")


def audit(df: DataFrame, conversations: DataFrame | None = None, chunk: int = CHUNK) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: one row per conversation.

    ``df`` has conv_id, turn, role, text; rows are ordered by turn (nulls first), then role and text, so that rows of one turn have a fixed
    order. A null role or text counts as one space, and a null conv_id names a conversation of its own. ``conversations`` (conv_id)
    may name more; those without rows get zeros, an empty audit and the hash of the empty text. Copies of a row beyond the first are duplicates.
    An empty table gives an empty result; other columns are not read.

    The hash and the audit of a conversation are made in its order by one task, row by row; all else is split inside a conversation.
    """
    given = df if conversations is None else conversations
    named = given.select(F.col("conv_id"), F.col("conv_id").cast("string").alias("_conv")).distinct()
    rows = ordered_rows(df)
    spans = rows.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1).alias("span"))
    # Distinct turns: counted where their first row stands, so that no set is held anywhere.
    turns = rows.where("turn IS NOT NULL").groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv").agg(F.count(F.lit(1)).alias("turns"))
    gaps = spans.join(turns.withColumnRenamed("conv", "_c"), F.col("conv").eqNullSafe(F.col("_c")), "left").select(
        "conv", F.coalesce(F.col("span") - F.col("turns"), F.lit(0)).alias("gaps"))
    edited = edits(rows, chunk).select("conv", "pos", "role", "text", "fault", "before", "letter", "new_role", "behind", "cost")
    found = edited.repartition("conv").sortWithinPartitions("conv", "pos").mapInArrow(
        _summaries, "conv string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string")
    result = named.join(gaps, F.col("_conv").eqNullSafe(F.col("conv")), "left").drop("conv").join(
        found, F.col("_conv").eqNullSafe(F.col("conv")), "left")
    numbers = [F.coalesce(F.col(name), F.lit(0)).cast("bigint").alias(name) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return result.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
                         F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
