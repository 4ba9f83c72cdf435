"""Repair of conversation structure by bidirectional Dijkstra over the edit lattice.

A conversation should read (system)? (user assistant)+ or be empty. Its rows,
in order of turn, may be kept, given the other role, deleted, or preceded by inserted
empty ones, each at a cost. A node of the lattice is a number of rows
read and what the repaired conversation ends with. One heap searches from the start and one from
the end; once they have met at some cost, both go on until no crossing of that cost can
be left. Among the crossings' equally cheap edits the least audit, the
initials of the edits in order, wins.

Rows are judged by a byte each (fault and role); texts move only to be written out.
Conversations are numbered over ranges and cut into segments of ``SEGMENT``
rows, so that one conversation may hold any share of the rows: a segment is
searched between each pair of states at its ends, and a conversation of several
segments takes the cheapest chain of them. Insertions belong to the segment of the row
behind them, so every chain of edits is one of these and audits compare segment by segment.

Cases: null roles and texts are one space, so such a text is blank; rows without conv_id are one
conversation; rows are in order of turn (nulls first), then role, then text (its first ``HEAD``
characters, then its digest); equal rows count each; an empty role fits nowhere; a conversation without
rows, or with all rows deleted, is empty and has the digest of an empty text; an empty table
has no rows; other columns of the input do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.functions.ranking import range_ranked
from shelfscope.llm.common import map_batches, materialise

#: Rows searched at once.
SEGMENT = 4096
#: Characters of a text that order rows of one turn and role.
HEAD = 64

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

# What the repaired rows end with: nothing, the system row, a user, an assistant.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NOTHING, ASSISTANT)
ROLES = "sua"
_KEEP = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
_DUE = {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
_NAME = {USER: "user", ASSISTANT: "assistant"}

FAULTS = ("", "blank", "duplicate", "truncated")
_BLANK = " \t\n\x0b\x0c\r"


# ---- search ----------------------------------------------------------------

def _steps(fault: int, role: str) -> list[list[tuple[str, int, int]]]:
    """For each state, the edits (initial, cost, next state) that read a row."""
    extra = TRUNCATED if FAULTS[fault] == "truncated" else 0
    out = []
    for state in range(4):
        steps = [("D", DELETE, state)]
        if FAULTS[fault] not in ("blank", "duplicate"):
            if (state, role) in _KEEP:
                steps.append(("K", extra, _KEEP[state, role]))
            steps.append(("R", REROLE + extra, _DUE[state]))
        out.append(steps)
    return out


#: By the code of a row, 4 * fault + role.
_FORWARD = [_steps(code // 4, (ROLES + " ")[code % 4]) for code in range(16)]
_BACK = [[[(cost, state) for state in range(4) for _, cost, to in steps[state] if to == end] for end in range(4)]
         for steps in _FORWARD]
_BEFORE = [[state for state in range(4) if _DUE[state] == end] for end in range(4)]


def search(codes: bytes, entry: int, exits: tuple[int, ...], closed: bool) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits from ``entry`` before the rows to one of ``exits`` behind
    them, or None where none lead there.

    Without ``closed`` nothing is inserted behind the last row. A node is 4 * rows
    read + state.
    """
    rows = len(codes)
    last = 4 * rows if closed else 4 * rows - 1  # nodes up to here may insert

    def after(node: int) -> list[tuple[str, int, int]]:
        row, state = divmod(node, 4)
        out = [("I", INSERT, 4 * row + _DUE[state])] if node // 4 * 4 <= last else []
        if row < rows:
            out += [(initial, cost, 4 * row + 4 + to) for initial, cost, to in _FORWARD[codes[row]][state]]
        return out

    def before(node: int) -> list[tuple[str, int, int]]:
        row, state = divmod(node, 4)
        out = [("I", INSERT, 4 * row + s) for s in _BEFORE[state]] if 4 * row <= last else []
        if row:
            out += [("", cost, 4 * row - 4 + s) for cost, s in _BACK[codes[row - 1]][state]]
        return out

    nearest = ({entry: 0}, {4 * rows + state: 0 for state in exits})
    heaps = ([(0, entry)], [(0, node) for node in nearest[1]])
    settled: tuple[set, set] = (set(), set())
    best = min((d for node, d in nearest[1].items() if node == entry), default=None)

    def settle(side: int) -> None:
        nonlocal best
        here, there = nearest[side], nearest[1 - side]
        far, node = heappop(heaps[side])
        if node in settled[side]:
            return
        settled[side].add(node)
        for _, cost, to in (after, before)[side](node):
            if far + cost < here.get(to, far + cost + 1):
                here[to] = far + cost
                heappush(heaps[side], (far + cost, to))
            if to in there and (best is None or here[to] + there[to] < best):
                best = here[to] + there[to]

    while heaps[0] and heaps[1]:
        tops = heaps[0][0][0], heaps[1][0][0]
        if best is not None and sum(tops) > best:
            break
        settle(0 if (tops[0], len(heaps[0])) <= (tops[1], len(heaps[1])) else 1)
    if best is None:
        return None
    for side in (0, 1):  # nodes as near as the next one are complete as well
        top = heaps[side][0][0] if heaps[side] else 0
        while heaps[side] and heaps[side][0][0] <= top:
            settle(side)

    # crossings: the forward nodes from which a settled reverse node is reached at the best cost,
    # and those that lead to them
    front, rear = nearest

    def crosses(node: int, cost: int, to: int) -> bool:
        return to in settled[1] and front[node] + cost + rear[to] == best

    leading = {node for node in settled[0] if node in settled[1] and front[node] + rear[node] == best
               or any(crosses(node, cost, to) for _, cost, to in after(node))}
    todo = list(leading)
    while todo:
        node = todo.pop()
        for _, cost, earlier in before(node):
            if earlier in settled[0] and earlier not in leading and front[earlier] + cost == front[node]:
                leading.add(earlier)
                todo.append(earlier)

    # the least audit: of the edits that lead to a crossing or go on from one, the least initial each time
    audit, node, spent = [], entry, 0
    while not (node // 4 == rows and node - 4 * rows in exits and spent == best):
        initial, cost, node = min(
            (initial, cost, to) for initial, cost, to in after(node)
            if (to in leading and front[to] == spent + cost) or (to in settled[1] and spent + cost + rear[to] == best))
        audit.append(initial)
        spent += cost
    return best, "".join(audit)


def lines(codes: bytes, entry: int, audit: str) -> list[tuple[int, str | None]]:
    """The repaired rows of an audit: (row, None) if kept, (row, role) with another role, (-1, role) if inserted."""
    out, state, row = [], entry, 0
    for initial in audit:
        if initial in "RI":
            state = _DUE[state]
            out.append((row if initial == "R" else -1, _NAME[state]))
        elif initial == "K":
            state = _KEEP[state, ROLES[codes[row] % 4]]
            out.append((row, None))
        row += initial != "I"
    return out


def chain(segments: list[list[dict]]) -> list[dict]:
    """The cheapest choice of one option a segment, whose states meet; equal costs by the least audits.

    Options from one state to different ones never have an audit that begins another's, so
    their ranks decide.
    """
    later: dict[int, tuple] = {end: (0, None, None) for end in ENDS}
    for options in reversed(segments):
        here: dict[int, tuple] = {}
        for option in options:
            if option["exit"] in later:
                found = (option["cost"] + later[option["exit"]][0], option["rank"])
                if option["entry"] not in here or found < here[option["entry"]][:2]:
                    here[option["entry"]] = (*found, option)
        later = {entry: (cost, option, later) for entry, (cost, _, option) in here.items()}
    chosen, state = [], NOTHING
    for _ in segments:
        _, option, later = later[state]
        chosen.append(option)
        state = option["exit"]
    return chosen


# ---- Spark -----------------------------------------------------------------

def _space(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after damage by the hash of ``conv_id:turn``: (key, turn, role, text, copies), with
    ``was_role`` and ``was_text`` from before; ``key`` names the conversation."""
    kind = F.crc32(F.concat_ws(":", "key", _space("turn")).cast("binary")) % 20
    rows = conversations.select(_space("conv_id").alias("key"), F.col("turn").cast("long").alias("turn"),
                                _space("role").alias("was_role"), _space("text").alias("was_text")).withColumn("kind", kind)
    return rows.where("kind != 0").select(
        "key", "turn", "was_role", "was_text", "kind",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("was_role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("was_text", ".!?", ""))
        .otherwise(F.col("was_text")).alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"))


def _digest(c: Column) -> Column:
    return F.unhex(F.sha2(c, 256))


def numbered(rows: DataFrame) -> DataFrame:
    """Distinct rows of ``damaged`` without texts, as (key, first, until) runs of row numbers in their conversation."""
    was = _digest(F.col("was_text"))
    last = F.substring(F.rtrim("text", F.lit(_BLANK)), -1, 1)
    skinny = rows.select(
        "key", "turn", "was_role", F.substring("was_text", 1, HEAD).alias("head"), was.alias("was"), "role",
        F.when(F.col("kind").isin(1, 2), _digest(F.col("text"))).otherwise(was).alias("digest"),
        (last == "").alias("blank"), last.isin(".", "!", "?").alias("ended"), "copies")
    keys = [c for c in skinny.columns if c != "copies"]
    skinny = materialise(skinny.groupBy(*keys).agg(F.sum("copies").alias("copies")), "structure-rows")
    ranked = range_ranked(skinny.select(F.struct(*keys, "copies").alias("row")), "row", F.col("row.copies")).select("row.*", "start")
    ranked = materialise(ranked, "structure-ranks")
    starts = ranked.groupBy("key").agg(F.min("start").alias("origin"))
    return ranked.join(starts, "key").select(
        *keys, (F.col("start") - F.col("origin")).cast("long").alias("first"),
        (F.col("start") - F.col("origin") + F.col("copies")).cast("long").alias("until"))


def _letter(fault: Column, role: Column) -> Column:
    """One letter for a row's code."""
    kind = F.when(role == "s", 0).when(role == "u", 1).when(role == "a", 2).otherwise(3)
    return F.char(F.lit(65) + 4 * fault + kind)


def segments(rows: DataFrame, size: int = SEGMENT) -> DataFrame:
    """(key, segment, codes, before): a letter for every row, and that of the row before the segment."""
    firsts = rows.where("NOT blank").groupBy("key", "role", "digest").agg(F.min("first").alias("earliest"))
    told = rows.join(firsts, ["key", "role", "digest"], "left")
    initial = F.substring("role", 1, 1)
    fault = F.when(F.col("blank"), 1).when(F.col("first") > F.col("earliest"), 2).when(~F.col("ended"), 3).otherwise(0)
    again = F.when(F.col("blank"), 1).otherwise(2)
    told = told.select("key", "first", "until", _letter(fault, initial).alias("own"), _letter(again, initial).alias("again"),
                       F.explode(F.sequence(F.floor(F.col("first") / size), F.floor(F.col("until") / size))).alias("segment"))
    begin = F.greatest("first", F.col("segment") * size)
    length = (F.least("until", (F.col("segment") + 1) * size) - begin).cast("int")
    opens = begin == F.col("first")
    letters = F.when(length <= 0, "").when(opens, F.concat("own", F.repeat("again", length - 1))).otherwise(F.repeat("again", length))
    before = F.when((F.col("segment") * size > F.col("first")) & (F.col("segment") * size <= F.col("until")),
                    F.when(F.col("segment") * size == F.col("first") + 1, F.col("own")).otherwise(F.col("again")))
    parts = told.select("key", "segment", F.struct(begin.alias("begin"), letters.alias("letters")).alias("part"), before.alias("before"))
    return parts.groupBy("key", "segment").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("part")), lambda p: p["letters"]), "").alias("codes"),
        F.max("before").alias("before")).where("codes != ''")


def _searched(parts: DataFrame) -> DataFrame:
    """Options of every segment: (key, segment, segments, codes, entry, exit, cost, rank, audit)."""
    counted = parts.join(parts.groupBy("key").agg(F.count("*").alias("segments")), "key")

    def per_batch(batch: pa.RecordBatch) -> dict:
        out: dict = {name: [] for name in ("row", "entry", "exit", "cost", "rank", "audit")}
        for row, (segment, many, letters) in enumerate(zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)))):
            codes = bytes(x - 65 for x in letters.encode())
            closed = segment == many - 1
            for entry in range(4) if segment else (NOTHING,):
                # one search for any end of the conversation, else one for each state
                found = []
                for exits in [ENDS] if closed else [(0,), (1,), (2,), (3,)]:
                    cheapest = search(codes, entry, exits, closed)
                    if cheapest:
                        found.append((*cheapest, exits[-1]))
                audits = sorted(audit for _, audit, _ in found)
                for cost, audit, end in found:
                    for name, value in (("row", row), ("entry", entry), ("exit", end), ("cost", cost),
                                        ("rank", audits.index(audit)), ("audit", audit)):
                        out[name].append(value)
        took = pa.array(out.pop("row"), pa.int64())
        return out | {name: batch.column(i).take(took) for i, name in enumerate(("key", "segment", "segments", "codes"))}

    return materialise(map_batches(
        counted.select("key", F.col("segment").cast("long").alias("segment"), "segments", "codes"), per_batch,
        "key string, segment long, segments long, codes string, entry int, exit int, cost long, rank int, audit string"),
        "structure-options")


def edits(parts: DataFrame) -> DataFrame:
    """(key, segment, codes, entry, cost, audit) of the chosen edits of every segment."""
    options = _searched(parts)
    lone = options.where("segments = 1")
    several = options.where("segments > 1")
    # costs and ranks only: some numbers for every SEGMENT rows
    gathered = several.groupBy("key").agg(F.sort_array(F.collect_list(
        F.struct("segment", "entry", "exit", "cost", "rank"))).alias("options"))

    def per_batch(batch: pa.RecordBatch) -> dict:
        keys, numbers, entries, exits = [], [], [], []
        for key, options in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            by_segment: dict = {}
            for option in options:
                by_segment.setdefault(option["segment"], []).append(option)
            for option in chain([by_segment[s] for s in sorted(by_segment)]):
                keys.append(key)
                numbers.append(option["segment"])
                entries.append(option["entry"])
                exits.append(option["exit"])
        return {"key": keys, "segment": numbers, "entry": entries, "exit": exits}

    chosen = map_batches(gathered, per_batch, "key string, segment long, entry int, exit int")
    columns = ["key", "segment", "codes", "entry", "cost", "audit"]
    return lone.select(*columns).union(several.join(chosen, ["key", "segment", "entry", "exit"]).select(*columns))


def repaired(rows: DataFrame, numbers: DataFrame, chosen: DataFrame, size: int = SEGMENT) -> DataFrame:
    """(key, segment, line, role, text): the rows of the repaired conversations, in order of segment and line."""
    def per_batch(batch: pa.RecordBatch) -> dict:
        out: dict = {"key": [], "segment": [], "line": [], "first": [], "given": []}
        for key, segment, letters, entry, audit in zip(*(c.to_pylist() for c in batch.columns)):
            codes = bytes(x - 65 for x in letters.encode())
            for line, (row, role) in enumerate(lines(codes, entry, audit)):
                for name, value in zip(out, (key, segment, line, None if row < 0 else segment * size + row, role)):
                    out[name].append(value)
        return out

    made = map_batches(chosen.select("key", "segment", "codes", "entry", "audit"), per_batch,
                       "key string, segment long, line int, first long, given string")
    made = materialise(made, "structure-lines")
    inserted = made.where("first IS NULL").select("key", "segment", "line", F.col("given").alias("role"), F.lit("").alias("text"))
    kept = made.where("first IS NOT NULL").join(numbers.select("key", "first", "turn", "was_role", "was", "role"), ["key", "first"])
    kept = kept.select("key", "segment", "line", F.coalesce("given", "role").alias("role"), _space("turn").alias("at"), "was_role", "was")
    identity = ["key", "at", "was_role", "was"]
    texts = rows.select("key", _space("turn").alias("at"), "was_role", _digest(F.col("was_text")).alias("was"), "text")
    return texts.dropDuplicates(identity).join(kept, identity).select("key", "segment", "line", "role", "text").union(inserted)


def digests(table: DataFrame) -> DataFrame:
    """(key, repaired_sha256) of the repaired rows as ``role:text`` lines. Rows stream through
    their conversation's digest one by one, so none is ever whole in memory."""
    placed = table.repartition("key").sortWithinPartitions("key", "segment", "line").select(
        "key", F.concat("role", F.lit(":"), "text").alias("line"))

    def table_of(done: list) -> pa.RecordBatch:
        done = [(key, digest.hexdigest()) for key, digest in done if digest]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], pa.string()) for i in (0, 1)],
                                          names=["key", "repaired_sha256"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            done = []
            for key, line in zip(batch.column(0).to_pylist(), batch.column(1)):
                if key != now:
                    done.append((now, digest))
                    now, digest = key, sha256()
                else:
                    digest.update(b"\n")
                digest.update(line.as_py().encode())
            yield table_of(done)
        yield table_of([(now, digest)])

    return placed.mapInArrow(run, "key string, repaired_sha256 string")


def _counts(parts: DataFrame) -> DataFrame:
    """(key, blank, duplicate, truncated, illegal) from the letters."""
    def faults(number: int) -> Column:
        return F.length(F.regexp_replace("codes", f"[^{chr(65 + 4 * number)}-{chr(68 + 4 * number)}]", ""))

    # as the letters s, u, a and o, of which su, ua and au may stand together
    spelled = F.translate(F.concat(F.coalesce("before", F.lit("")), "codes"), "ABCDEFGHIJKLMNOP", "suao" * 4)
    proper = F.length(F.regexp_replace(F.regexp_replace(spelled, "(?:(?=su|ua|au)(.))", "+"), "[^+]", ""))
    return parts.select("key", *[faults(n).alias(FAULTS[n]) for n in (1, 2, 3)],
                        (F.length(spelled) - 1 - proper).alias("illegal")).groupBy("key").agg(
        *[F.sum(c).alias(c) for c in (*FAULTS[1:], "illegal")])


def structure_report(conversations: DataFrame, size: int = SEGMENT) -> DataFrame:
    """One row for every conv_id: gaps and faults after damage, the cheapest repair and its digest."""
    rows = damaged(conversations)
    numbers = materialise(numbered(rows), "structure-numbers")
    parts = materialise(segments(numbers, size), "structure-segments")
    chosen = materialise(edits(parts), "structure-edits")
    spans = numbers.groupBy("key").agg((F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).alias("gaps"))
    audits = chosen.groupBy("key").agg(
        F.sum("cost").alias("cost"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("segment", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    ids = conversations.select("conv_id", _space("conv_id").alias("key")).dropDuplicates(["key"])
    joined = ids
    for part in (spans, _counts(parts), audits, digests(repaired(rows, numbers, chosen, size))):
        joined = joined.join(part, "key", "left")
    numbers_of = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *numbers_of, F.coalesce("audit", F.lit("")).alias("audit"),
                         F.coalesce("repaired_sha256", F.lit(sha256().hexdigest())).alias("repaired_sha256"))
