"""Conversation structure repair: the cheapest edits that give every conversation the roles ``(s?(ua)+)?``.

A turn is kept (0), given the role user or assistant (1) or deleted (2), and an empty turn of either role is inserted
anywhere (5). Blank and duplicate turns must go; a truncated turn that stays adds 5. The cheapest edits come from a
dynamic program over retained subsequences: the best completion after retaining turn j in role r is its own price, plus
the least, over the next retained turn and its role q, of the deletions between (a difference of prefix sums), the
inserts that the pair (r, q) needs, and the completion from there. The prefix sums let a running minimum a role price
all gaps, so a turn costs a constant number of steps. Of equally cheap edits those with the ASCII-least initials
(D, I, K, R) are taken: as a role and an initial name the next role, choosing the least initial that keeps the total at
its minimum, turn by turn, is that choice.

Conversations lie whole in a task, sorted and read in a stream, up to ``ROWS`` turns or ``BYTES`` of text. A longer one
is cut by ranges of its turns into segments: each gives the price of passing it between any two roles, these 16 numbers
are combined from the last segment to the first, every segment then writes its edits for each role it may be entered in,
and the roles at the cuts choose among these. Duplicates across segments come from the first segment that holds a turn's
role and digest. No task holds more than a segment; only ``summary``, whose hash covers a conversation's whole text, reads
a conversation in one stream, and keeps nothing of it but the initials.

Defined cases: null roles and texts are one space, so such a turn is blank, or its role fits nowhere; null turns come
first, turns of equal number by role and text; null conversation ids are one conversation; of equal turns all but one
are duplicates; a conversation whose turns were all dropped has no edits; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qanat.session import checkpointed, written

#: Turns and bytes of text up to which a conversation lies in one task; long conversations whose names are broadcast.
ROWS, BYTES, LONG = 100_000, 32 << 20, 100_000
SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
NEVER = 1 << 60
#: Roles before which a turn may stand: none yet, system, user, assistant; FULL names the roles that can be inserted.
START, S, U, A = range(4)
FULL = {U: "user", A: "assistant"}
INITIAL = {"s": S, "u": U, "a": A}
#: INSERTS[r][q]: turns to insert between roles r and q.
INSERTS = {START: {S: 0, U: 0, A: 1}, S: {U: 0, A: 1}, U: {U: 1, A: 0}, A: {U: 0, A: 1}}
#: What the end costs in each role: nothing for none and assistant, else the turns that complete a pair.
END = [0, 2 * INSERT, INSERT, 0]
#: The role that follows a role.
NEXT = {START: U, S: U, U: A, A: U}
BLANK, DUPLICATE, CUT = "blank", "duplicate", "truncated"
TURN = "conv_id long, turn long, role string, text string"
EDIT = TURN + ", fault string, edit string, new_role string"


def damaged(rows: DataFrame) -> DataFrame:
    """Turns as they are after damage by crc32(``conv_id:turn``) % 20; dropped ones stay as markers, with role null.

    0 drops a turn, 1 empties its text, 2 removes its full stops, 3 repeats it, 4 makes it a user's.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    read = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), name("role").alias("role"), name("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").when(F.col("kind") != 0, F.col("role"))
    done = read.select("conv_id", "turn", role.alias("role"), F.when(F.col("kind") != 0, text).alias("text"), "kind")
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return done.withColumn("copy", F.explode(times)).select("conv_id", "turn", "role", "text")


class Turns:
    """Some turns of a conversation in order, with their faults; what is known of the turns before counts as seen."""

    def __init__(self, turns: list[tuple], late: list[bool] | None = None):
        """turns: (turn, role, text). late: whether an earlier segment holds the turn's role and text."""
        self.turns = [t for t in turns if t[1] is not None]
        late = [x for x, t in zip(late, turns, strict=True) if t[1] is not None] if late else [False] * len(self.turns)
        seen: set[tuple[str, bytes]] = set()
        self.roles, self.faults = [], []
        for (_, role, text), before in zip(self.turns, late, strict=True):
            bare = text.rstrip(SPACE)
            key = (role, hashlib.blake2b(text.encode(), digest_size=16).digest())
            fault = BLANK if not bare else DUPLICATE if before or key in seen else CUT if bare[-1] not in ".!?" else None
            seen.add(key)
            self.roles.append(INITIAL.get(role[:1]))
            self.faults.append(fault)

    def completions(self, end: list[int]) -> list[list[int]]:
        """[k][r]: least cost from turn k on, role r standing before; end: what each role costs after the last turn."""
        n = len(self.turns)
        out = [list(end)]
        least = [NEVER] * 4  # over the next retained turn: its completion and the deletions before it, counted from turn 0
        last = [DELETE * n + e for e in end]
        for k in range(n - 1, -1, -1):
            if self.faults[k] not in (BLANK, DUPLICATE):
                own = TRUNCATED if self.faults[k] == CUT else 0
                after = out[-1]
                for q in (S, U, A):
                    price = KEEP if self.roles[k] == q else REROLE if q != S else NEVER
                    least[q] = min(least[q], own + price + after[q] + DELETE * k)
            cost = (min(last[r], *(least[q] + INSERT * ins for q, ins in INSERTS[r].items())) - DELETE * k for r in range(4))
            out.append([c if c < NEVER // 2 else NEVER for c in cost])
        return out[::-1]

    def edits(self, role: int, best: list[list[int]]) -> tuple[str, int]:
        """Initials of the cheapest, then ASCII-least edits of these turns from a role on, and the role they end in."""
        letters = []
        for k in range(len(self.turns)):
            if best[k][role] == DELETE + best[k + 1][role]:
                letters.append("D")
                continue
            own = TRUNCATED if self.faults[k] == CUT else 0
            ways = []
            for q, ins in INSERTS[role].items():
                kept = self.roles[k] == q
                price = KEEP if kept else REROLE if q != S else NEVER
                if INSERT * ins + own + price + best[k + 1][q] == best[k][role]:
                    ways.append(("I" * ins + "RK"[kept], q))
            word, role = min(ways)
            letters.append(word)
        return "".join(letters), role

    def rows(self, letters: str, role: int) -> Iterator[tuple]:
        """(turn, role, text, fault, edit, new role) for each edit; inserted turns have no turn, role, text and fault."""
        k = 0
        for x in letters:
            if x == "I":
                role = NEXT[role]
                yield None, None, None, None, x, FULL[role]
                continue
            turn = (*self.turns[k], self.faults[k], x)
            if x == "D":
                yield *turn, None
            else:
                role = self.roles[k] if x == "K" else NEXT[role]
                yield *turn, self.turns[k][1] if x == "K" else FULL[role]
            k += 1


def ending(role: int) -> str:
    """Inserts that complete what ends in a role."""
    return "I" * (END[role] // INSERT)


def repaired(turns: list[tuple]) -> list[tuple]:
    """The edits of one whole conversation."""
    own = Turns(turns)
    letters, role = own.edits(START, own.completions(END))
    return list(own.rows(letters + ending(role), START))


EDITS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), *((c, pa.string()) for c in ("role", "text", "fault", "edit", "new_role"))])


def batch_of(conv: list, rows: list[tuple]) -> pa.RecordBatch:
    columns = [conv, *zip(*rows, strict=True)] if rows else [[] for _ in EDITS]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, EDITS, strict=True)], schema=EDITS)


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple]]]:
    """(first column, other columns' rows) of each run of rows that are equal in the first column."""
    name, own, any_ = None, [], False
    for batch in batches:
        for first, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if any_ and first != name:
                yield name, own
                own = []
            name, any_ = first, True
            own.append(tuple(rest))
    if any_:
        yield name, own


def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns of whole conversations -> edits; a conversation without turns is one row without an edit."""
    names, rows = [], []
    for conv, turns in runs(batches):
        own = repaired(turns) or [(None,) * 6]
        names += [conv] * len(own)
        rows += own
        if len(rows) > 5000:
            yield batch_of(names, rows)
            names, rows = [], []
    yield batch_of(names, rows)


def order() -> list[Column]:
    return [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]


def cut(turns: DataFrame, segments: int) -> DataFrame:
    """Turns of long conversations with part, their range's number, written; a turn repeated without end is cut as well."""
    salted = turns.withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    by = [F.asc_nulls_first("conv_id"), *order(), F.asc("salt")]
    ranged = salted.repartitionByRange(segments, *by).withColumn("part", F.spark_partition_id())
    found = written(ranged.withColumn("digest", F.md5("text")), "turns")
    firsts = found.filter("role is not null").groupBy("conv_id", "role", "digest").agg(F.min("part").alias("first"))
    firsts = firsts.withColumnsRenamed({"conv_id": "_c", "role": "_r", "digest": "_d"})
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d"))
    known = found.join(firsts, same, "left").withColumn("late", F.coalesce(F.col("first") < F.col("part"), F.lit(False)))
    return written(known.select("conv_id", "part", "turn", "role", "text", "late"), "segments")


def segment(own: pa.Table) -> Turns:
    own = own.sort_by([("turn", "ascending"), ("role", "ascending"), ("text", "ascending")])
    rows = list(zip(*(own.column(c).to_pylist() for c in ("turn", "role", "text", "late")), strict=True))
    rows = [r for r in rows if r[0] is None] + [r for r in rows if r[0] is not None]
    return Turns([r[:3] for r in rows], [r[3] for r in rows])


def prices(own: pa.Table) -> pa.Table:
    """A segment -> the least cost of passing it from role x to role y, at 4 * x + y."""
    turns = segment(own)
    to = [turns.completions([0 if r == y else NEVER for r in range(4)])[0] for y in range(4)]
    cost = [min(to[y][x], NEVER) for x in range(4) for y in range(4)]
    return pa.table({"conv_id": own.column("conv_id").slice(0, 1), "part": own.column("part").slice(0, 1), "cost": pa.array([cost], pa.list_(pa.int64()))})


def after(own: pa.Table) -> pa.Table:
    """A conversation's segments' prices -> for each segment the least cost of all that follows it, by the role it ends in."""
    own = own.sort_by("part")
    left, ends = list(END), []
    for cost in own.column("cost").to_pylist()[::-1]:
        ends.append(left)
        left = [min(NEVER, *(cost[4 * x + y] + left[y] for y in range(4))) for x in range(4)]
    return pa.table({"conv_id": own.column("conv_id"), "part": own.column("part"), "left": pa.array(ends[::-1], pa.list_(pa.int64()))})


def ways(own: pa.Table) -> pa.Table:
    """A segment with ``left`` -> its initials and last role for each role it may be entered in."""
    turns = segment(own)
    best = turns.completions(own.column("left")[0].as_py())
    found = [turns.edits(r, best) if best[0][r] < NEVER else ("", r) for r in range(4)]
    one = {c: own.column(c).slice(0, 1) for c in ("conv_id", "part")}
    return pa.table(one | {"letters": pa.array([[x for x, _ in found]], pa.list_(pa.string())), "ends": pa.array([[r for _, r in found]], pa.list_(pa.int32()))})


def entered(own: pa.Table) -> pa.Table:
    """A conversation's segments' last roles -> the role each is entered in, and whether it is the last."""
    own = own.sort_by("part")
    roles = [START]
    for ends in own.column("ends").to_pylist():
        roles.append(ends[roles[-1]])
    n = own.num_rows
    return pa.table({"conv_id": own.column("conv_id"), "part": own.column("part"), "start": pa.array(roles[:-1], pa.int32()), "tail": pa.array([""] * (n - 1) + [ending(roles[-1])])})


def chosen(own: pa.Table) -> pa.Table:
    """A segment with the initials chosen for it -> its edits, numbered."""
    turns = segment(own)
    start = own.column("start")[0].as_py()
    rows = list(turns.rows(own.column("letters")[0].as_py() + own.column("tail")[0].as_py(), start)) or [(None,) * 6]
    out = pa.Table.from_batches([batch_of([own.column("conv_id")[0].as_py()] * len(rows), rows)])
    return out.append_column("part", pa.array([own.column("part")[0].as_py()] * len(rows), pa.int32())).append_column("seq", pa.array(range(len(rows)), pa.int32()))


def long_edits(turns: DataFrame, segments: int) -> DataFrame:
    """Edits of the turns of long conversations, with part and seq, their order."""
    held = cut(turns, segments)
    key = ["conv_id", "part"]

    def meet(rows: DataFrame) -> DataFrame:
        """Segments with what is known of each."""
        named = rows.withColumnsRenamed({"conv_id": "_c", "part": "_p"})
        return held.join(named, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p"))).drop("_c", "_p")

    cost = held.groupBy(*key).applyInArrow(prices, "conv_id long, part int, cost array<long>")
    left = checkpointed(cost.groupBy("conv_id").applyInArrow(after, "conv_id long, part int, left array<long>"))
    found = written(meet(left).groupBy(*key).applyInArrow(ways, "conv_id long, part int, letters array<string>, ends array<int>"), "ways")
    start = found.select(*key, "ends").groupBy("conv_id").applyInArrow(entered, "conv_id long, part int, start int, tail string")
    start = start.withColumnsRenamed({"conv_id": "_c", "part": "_p"})
    pick = found.join(start, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p")))
    pick = checkpointed(pick.select(*key, F.get("letters", "start").alias("letters"), "start", "tail"))
    return meet(pick).groupBy(*key).applyInArrow(chosen, EDIT + ", part int, seq int")


def repair(conversations: DataFrame, most_rows: int = ROWS, most_bytes: int = BYTES) -> DataFrame:
    """Edits (conv_id, turn, role, text, fault, edit, new_role, long, part, seq) of the damaged conversations.

    A conversation that is not ``long`` lies in one partition in order, without part and seq; a long one's edits are
    in the order of these. A conversation without turns has one row without an edit.
    """
    turns = damaged(conversations)
    size = turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    names = checkpointed(size.filter((F.col("n") > most_rows) | (F.col("bytes") > most_bytes)).withColumnRenamed("conv_id", "_c"))
    if not names.head(1):
        return _short(turns)
    total = names.agg(F.count("*").alias("long"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).head()
    segments = max(2, -(-2 * total["n"] // most_rows), -(-2 * (total["bytes"] or 0) // most_bytes))
    named = names.select("_c")
    named = F.broadcast(named) if total["long"] <= LONG else named
    same = F.col("conv_id").eqNullSafe(F.col("_c"))
    hot = long_edits(turns.join(named, same, "left_semi"), segments)
    return _short(turns.join(named, same, "left_anti")).unionByName(hot.withColumn("long", F.lit(True)))


def _short(turns: DataFrame) -> DataFrame:
    ordered = turns.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), *order())
    none = F.lit(None).cast("int")
    return ordered.mapInArrow(stream, EDIT).withColumns({"long": F.lit(False), "part": none, "seq": none})


SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits in order -> one row a conversation. Texts pass through the hash and are not kept."""
    out: list[tuple] = []
    now: dict | None = None

    def close() -> None:
        gaps = now["max"] - now["min"] + 1 - now["turns"] if now["turns"] else 0
        out.append((now["conv"], gaps, now[BLANK], now[DUPLICATE], now[CUT], now["illegal"], now["cost"], "".join(now["audit"]), now["sha"].hexdigest()))

    for batch in batches:
        for conv, turn, role, text, fault, edit, new_role in zip(*(batch.column(c).to_pylist() for c in EDITS.names), strict=True):
            if now is None or now["conv"] != conv:
                if now:
                    close()
                now = {"conv": conv, "turns": 0, "max": None, "min": None, BLANK: 0, DUPLICATE: 0, CUT: 0, "illegal": 0, "cost": 0, "audit": [], "sha": hashlib.sha256(), "role": None, "any": False}
            if edit is None:
                continue
            now["audit"].append(edit)
            now["cost"] += {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[edit] + (TRUNCATED if fault == CUT and edit != "D" else 0)
            if edit != "I":
                if turn is not None and turn != now["max"]:
                    now["turns"] += 1
                    now["max"] = turn
                    now["min"] = turn if now["min"] is None else now["min"]
                if fault:
                    now[fault] += 1
                now["illegal"] += now["role"] is not None and now["role"][:1] + role[:1] not in ("su", "ua", "au")
                now["role"] = role
            if edit != "D":
                now["sha"].update(("\n" * now["any"] + new_role + ":" + (text or "")).encode())
                now["any"] = True
        if len(out) > 1000:
            yield rows_of(out)
            out.clear()
    if now:
        close()
    yield rows_of(out)


def rows_of(found: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    columns = zip(*found, strict=True) if found else [[]] * 9
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [c.split()[0] for c in SUMMARY.split(", ")])


def summary(edits: DataFrame) -> DataFrame:
    """SUMMARY of each conversation of ``repair``: its gaps, faults, cost, initials, and a hash of what it became."""
    short = edits.filter(~F.col("long")).mapInArrow(summarise, SUMMARY)
    hot = edits.filter("long").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(summarise, SUMMARY)
    return short.unionByName(hot)
