"""Conversation repair: the cheapest edits that give every conversation the form (system? (user assistant)+)?.

Edits of a row: Keep (0), Rerole to user or assistant (3), Delete (4; the only one for blank and repeated rows); between rows:
Insert of an empty user or assistant row (3). A truncated row that is not deleted costs 3 more. Legal texts are walked by four states
(nothing yet, after system, after user, after assistant); from a state each edit leads to one state, so an audit, the edits'
initials in order, fixes the repaired rows.

Reconstruction is Hirschberg's: the cost vector over the four states forward from the start and the one backward from the end meet in
the middle of the rows, the cheapest crossing state is taken, and both halves are solved again. Of equally cheap crossings
that with the ASCII-least audit before it is taken; for this the forward vector carries, beside costs, the order of the states' least
audits: audits of different states that end at one row are never a prefix of another, so the order of two continued audits is that
of what they continue. Memory is one vector each way and the rows.

Rows are put in order by a range exchange on (conversation, turn, role, text), equal rows counted as one before, so a conversation of any
size is spread over tasks; it is cut into blocks of BLOCK_ROWS rows. A block stands for a table of 4 x 4 costs and orders; the same
divide-and-conquer over the few blocks of a conversation gives the states between blocks, and every block is then solved
by itself.

Order of rows: turn (null first), role, text. Null conv_id: one conversation. Null role or text: one space. Roles count by their
initial; another initial than s, u, a fits no place and is reroled or deleted. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stash

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: nothing yet, after system, after user, after assistant; those in which a conversation may end.
NONE, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NONE, ASSISTANT)
#: (state, role initial) -> state
STEPS = {(NONE, "s"): SYSTEM, (NONE, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
ROLE = {"u": "user", "a": "assistant"}
LEGAL_PAIRS = ("su", "ua", "au")
#: Rows, and characters of their texts, in one block.
BLOCK_ROWS, BLOCK_CHARS = 4096, 4 << 20
MUST_DELETE = "-"

#: entry -> exit -> (cost, what orders it among those of one entry), or None
Unit = tuple[tuple[tuple[int, object] | None, ...], ...]


def inserts(state: int) -> Iterator[tuple[int, str]]:
    """(state, edits): what insertions can lead to without coming back."""
    yield state, ""
    seen, edits = {state}, ""
    while True:
        state = ASSISTANT if state == USER else USER
        if state in seen:
            return
        seen.add(state)
        edits += "I"
        yield state, edits


@cache
def row_unit(initial: str, truncated: bool) -> Unit:
    """A row with the insertions before it: of each entry and exit the cheapest edits, of equal ones the least."""
    more = TRUNCATED * truncated
    best: list[list] = [[None] * 4 for _ in range(4)]
    for entry in range(4):
        for at, before in inserts(entry):
            ways = [(DELETE, "D", at)]
            if initial != MUST_DELETE:
                ways += [(KEEP + more, "K", STEPS[at, initial])] if (at, initial) in STEPS else []
                ways += [(REROLE + more, "R", STEPS[at, r]) for r in "ua" if (at, r) in STEPS]
            for cost, letter, leave in ways:
                found = (INSERT * len(before) + cost, before + letter)
                if best[entry][leave] is None or found < best[entry][leave]:
                    best[entry][leave] = found
    return tuple(map(tuple, best))


def tail(state: int) -> tuple[int, str]:
    """The cheapest insertions after the last row."""
    return min((INSERT * len(edits), edits) for at, edits in inserts(state) if at in ENDS)


def forward(units: list[Unit], vector: list) -> list:
    """vector: (cost, order) of each state, or None; after all units."""
    for unit in units:
        found: list = [None] * 4
        for s, have in enumerate(vector):
            if have is not None:
                for t, step in enumerate(unit[s]):
                    if step is not None:
                        new = (have[0] + step[0], have[1], step[1])
                        if found[t] is None or new < found[t]:
                            found[t] = new
        order = {x: i for i, x in enumerate(sorted(x[1:] for x in found if x is not None))}
        vector = [x and (x[0], order[x[1:]]) for x in found]
    return vector


def backward(units: list[Unit], costs: list) -> list:
    """costs: from each state to the end, or None; before all units."""
    for unit in reversed(units):
        costs = [min((step[0] + c for step, c in zip(row, costs, strict=True) if step is not None and c is not None), default=None) for row in unit]
    return costs


def only(state: int, value) -> list:
    return [value if s == state else None for s in range(4)]


def crossings(units: list[Unit], entry: int, leave: int) -> list[int]:
    """The states between units of the audit-least cheapest way from entry to leave, by divide and conquer."""
    if len(units) < 2:
        return []
    middle = len(units) // 2
    ahead, back = forward(units[:middle], only(entry, (0, 0))), backward(units[middle:], only(leave, 0))
    _, _, state = min((a[0] + b, a[1], s) for s, (a, b) in enumerate(zip(ahead, back, strict=True)) if a is not None and b is not None)
    return crossings(units[:middle], entry, state) + [state] + crossings(units[middle:], state, leave)


def last_state(vector: list) -> int:
    """Where the best whole way ends: vector as after the last unit."""
    return min((x[0] + tail(s)[0], x[1], s) for s, x in enumerate(vector) if x is not None)[2]


def block_unit(units: list[Unit]) -> Unit:
    return tuple(tuple(forward(units, only(s, (0, 0)))) for s in range(4))


# tables

_BLANK = r"[\x20\x09-\x0D]"
#: What a block's row carries of the whole block.
_SUMMARY = "n long, blank long, duplicate long, truncated long, illegal long, first_role string, last_role string, low long, high long, turns long, low_end long, high_end long"
_BLOCK = f"conv_id {{kind}}, part long, at long, kinds string, n_each array<long>, roles array<string>, texts array<string>, unit array<int>, {_SUMMARY}"


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, times): rows with nulls as one space, damaged by crc32("conv_id:turn") % 20: 0 drops a row (times 0),
    1 empties its text, 2 takes its .!? out, 3 repeats it, 4 makes it a user's."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    text, role = name("text"), name("role")
    text = F.when(how == 1, "").when(how == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    return conversations.select("conv_id", "turn", F.when(how == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.when(how == 0, 0).when(how == 3, 2).otherwise(1).alias("times"))


def with_faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n, kind, early): wholly equal rows as one with their number.

    kind: - blank, else the role's initial, in capitals if truncated (then the row's role is not needed), . for another initial, ! for
    another one truncated. early: role and text do not occur in an earlier turn, so the first of the n is no repetition.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    times = F.col("times") if "times" in rows.columns else F.lit(1)
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), name("role"), name("text"), times.alias("times"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").alias("n"))
    said = F.regexp_replace("text", f"^{_BLANK}+|{_BLANK}+$", "")
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise(".")
    cut = ~F.substring(said, -1, 1).isin(".", "!", "?")
    kind = F.when(said == "", MUST_DELETE).when(cut, F.when(kind == ".", "!").otherwise(F.upper(kind))).otherwise(kind)
    own = [F.col("conv_id").isNull(), F.coalesce(F.col("conv_id").cast("string"), F.lit("")), "role", "text"]
    rows = rows.select("*", kind.alias("kind"), F.xxhash64(*own).alias("h1"), F.xxhash64(*own[::-1]).alias("h2"))
    first = rows.where((F.col("n") > 0) & (F.col("kind") != MUST_DELETE)).groupBy("h1", "h2").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("first"))
    rows = rows.join(first, ["h1", "h2"], "left")
    return rows.select("conv_id", "turn", "role", "text", "n", "kind", F.col("first.turn").eqNullSafe(F.col("turn")).alias("early"))


def _expanded(kinds: str, n_each: list[int]) -> Iterator[tuple[int, str]]:
    """(record, kind) of every row of a block; a record's rows after its first are repetitions."""
    for i, (kind, n) in enumerate(zip(kinds, n_each, strict=True)):
        yield i, kind
        for _ in range(n - 1):
            yield i, MUST_DELETE


def _units(kinds: str, n_each: list[int]) -> list[Unit]:
    return [row_unit({"!": ".", "_": MUST_DELETE}.get(k, k).lower(), k.isupper() or k == "!") for _, k in _expanded(kinds, n_each)]


def _summary(rows: list[tuple]) -> tuple:
    """rows: (turn, role, text, n, kind); kind _ is a repetition, - blank."""
    initials = [(r[1][:1], r[3]) for r in rows]
    legal = lambda a, b: a + b in LEGAL_PAIRS
    illegal = sum((n - 1) * (not legal(i, i)) for i, n in initials) + sum(not legal(a[0], b[0]) for a, b in itertools.pairwise(initials))
    turns = [r[0] for r in rows if r[0] is not None]
    counts = [sum(r[3] for r in rows), sum(r[3] for r in rows if r[4] == "-"), sum(r[3] - (r[4] != "_") for r in rows if r[4] != "-"), sum(r[4].isupper() or r[4] == "!" for r in rows)]
    ends = (turns[0], turns[-1]) if turns else (None, None)
    return (*counts, illegal, initials[0][0] if rows else None, initials[-1][0] if rows else None, *ends, len(set(turns)), rows[0][0] if rows else None, rows[-1][0] if rows else None)


def blocks(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows with faults in order, a row for each block of a conversation. Stored: a block's name is its range and its place there."""
    ordered = rows.repartitionByRange("conv_id", "turn", "role", "text").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")
    kind = rows.schema["conv_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), itertools.count()

        def block(conv, held: list[tuple]) -> dict:
            held = [r for r in held if r[3] > 0]
            kinds, n_each = "".join(r[4] for r in held), [r[3] for r in held]
            unit = [-1 if x is None else x[k] for row in block_unit(_units(kinds, n_each)) for x in row for k in (0, 1)]
            found = [conv, part, next(made), kinds, n_each, [r[1] for r in held], [r[2] for r in held], unit, *_summary(held)]
            return dict(zip(names, found, strict=True))

        def flush(ready: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in ready], f.type) for f in schema], schema=schema)

        names, schema = [], None
        conv, held, chars, ready, size = None, [], 0, [], 0
        for b in batches:
            if schema is None:
                longs, words = pa.int64(), pa.string()
                schema = pa.schema([("conv_id", b.schema.field("conv_id").type), ("part", longs), ("at", longs), ("kinds", words), ("n_each", pa.list_(longs)), ("roles", pa.list_(words)), ("texts", pa.list_(words)), ("unit", pa.list_(pa.int32())), *((x.split()[0], words if x.endswith("string") else longs) for x in _SUMMARY.split(", "))])
                names = schema.names
            for own, turn, role, text, n, kind, early in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "n", "kind", "early")), strict=True):
                if held and (own != conv or len(held) >= block_rows or chars >= BLOCK_CHARS):
                    ready.append(block(conv, held))
                    size += chars
                    held, chars = [], 0
                    if len(ready) >= 256 or size >= BLOCK_CHARS:
                        yield flush(ready)
                        ready, size = [], 0
                conv = own
                held.append((turn, role, text, n, kind if early or kind == MUST_DELETE else "_"))
                chars += len(text)
        if held:
            ready.append(block(conv, held))
        if ready:
            yield flush(ready)

    return stash(ordered.mapInArrow(each, _BLOCK.format(kind=kind)), "conversation-blocks")


def _borders(stored: DataFrame) -> DataFrame:
    """(part, at, entry, leave, last) of the blocks of conversations with more than one."""
    several = stored.groupBy("conv_id").agg(F.count(F.lit(1)).alias("blocks")).where("blocks > 1").select(F.col("conv_id").alias("own"))
    parts = stored.select("conv_id", "part", "at", "unit").join(several, F.col("conv_id").eqNullSafe(F.col("own")), "left_semi")

    def chain(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("part", "at", "unit")), strict=True))
        units = [tuple(tuple(None if u[8 * s + 2 * t] < 0 else (u[8 * s + 2 * t], u[8 * s + 2 * t + 1]) for t in range(4)) for s in range(4)) for _, _, u in rows]
        end = last_state(forward(units, only(NONE, (0, 0))))
        states = [NONE, *crossings(units, NONE, end), end]
        return pa.table({"part": pa.array([r[0] for r in rows], pa.int64()), "at": pa.array([r[1] for r in rows], pa.int64()), "entry": pa.array(states[:-1], pa.int32()), "leave": pa.array(states[1:], pa.int32()), "last": pa.array([i == len(rows) - 1 for i in range(len(rows))])})

    return parts.groupBy("conv_id").applyInArrow(chain, "part long, at long, entry int, leave int, last boolean")


def solved(kinds: str, n_each: list[int], roles: list[str], texts: list[str], entry: int, leave: int | None, last: bool) -> tuple[int, str, list[tuple[str, str]]]:
    """(cost, audit, repaired rows) of one block; leave None: the best end."""
    units = _units(kinds, n_each)
    if leave is None:
        leave = last_state(forward(units, only(entry, (0, 0))))
    states = [entry, *crossings(units, entry, leave), leave] if units else [entry]
    cost, audit, out, here = 0, [], [], entry
    source = [i for i, _ in _expanded(kinds, n_each)]
    edits = [(units[k][a][b], source[k]) for k, (a, b) in enumerate(itertools.pairwise(states))]
    for (paid, letters), i in [*edits, *([(tail(leave), -1)] if last else [])]:
        cost += paid
        audit.append(letters)
        for x in letters:
            if x == "D":
                continue
            role = roles[i] if x == "K" else ROLE["a" if here == USER else "u"]
            out.append((role, "" if x == "I" else texts[i]))
            here = STEPS[here, role[:1]]
    return cost, "".join(audit), out


def repaired(conversations: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, and as `turns` its repaired (role, text) in order.

    gaps: turns between the least and the greatest that no row has. illegal: neighbouring rows whose roles' initials are not su, ua or au.
    """
    stored = blocks(with_faults(conversations), block_rows)
    kind = stored.schema["conv_id"].dataType.simpleString()
    at = ["part", "at"]
    work = stored.join(_borders(stored), at, "left")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("kinds", "n_each", "roles", "texts", "entry", "leave", "last")
        for b in batches:
            rows = [solved(k, n, r, t, e or NONE, leave, last is not False) for k, n, r, t, e, leave, last in zip(*(b.column(c).to_pylist() for c in names), strict=True)]
            columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([[{"role": x, "text": y} for x, y in r[2]] for r in rows], turns)]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("block"), *columns], names=["conv_id", "block", "cost", "audit", "turns"])

    turns = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    fields = [x.split()[0] for x in _SUMMARY.split(", ")]
    block = F.struct(*at, *fields)
    done = work.select("conv_id", block.alias("block"), "kinds", "n_each", "roles", "texts", "entry", "leave", "last")
    done = done.mapInArrow(each, f"conv_id {kind}, block {done.schema['block'].dataType.simpleString()}, cost long, audit string, turns array<struct<role: string, text: string>>")
    whole = done.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "cost", "audit", "turns"))).alias("x"))
    live = F.filter("x", lambda x: x["block"]["n"] > 0)
    whole = whole.select("conv_id", "x", F.transform(live, lambda x: x["block"]).alias("b"))
    add = lambda f: F.aggregate("b", F.lit(0).cast("long"), lambda acc, x: acc + x[f]).alias(f)

    def joints(ill: bool) -> Column:
        """Over neighbouring blocks: illegal pairs of roles, or turns that both have."""
        pairs = F.zip_with(F.slice("b", 1, F.greatest(F.size("b") - 1, F.lit(0))), F.slice("b", 2, F.greatest(F.size("b") - 1, F.lit(0))), lambda x, y: (~F.concat(x["last_role"], y["first_role"]).isin(*LEGAL_PAIRS)) if ill else (x["high_end"] == y["low_end"]))
        return F.size(F.filter(pairs, lambda x: F.coalesce(x, F.lit(False))))

    turns_between = F.array_max(F.transform("b", lambda x: x["high"])) - F.array_min(F.transform("b", lambda x: x["low"])) + 1 - (add("turns") - joints(False))
    return whole.select(
        "conv_id",
        F.coalesce(turns_between, F.lit(0)).cast("long").alias("gaps"),
        add("blank"),
        add("duplicate"),
        add("truncated"),
        (add("illegal") + joints(True)).cast("long").alias("illegal"),
        F.aggregate("x", F.lit(0).cast("long"), lambda acc, x: acc + x["cost"]).alias("cost"),
        F.array_join(F.transform("x", lambda x: x["audit"]), "").alias("audit"),
        F.flatten(F.transform("x", lambda x: x["turns"])).alias("turns"),
    )
