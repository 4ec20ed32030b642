"""Repair of conversation structure by rank-convergence parallel Viterbi.

A repaired conversation has the role initials ``(s?(ua)+)?``. Rows are kept, given another role or
deleted, and empty turns are inserted; the cheapest edits are a shortest path over four states (nothing
yet, after system, user, assistant). Rows are sorted into blocks by conversation and turn. Every block
runs backwards at once from a speculative cost vector, that of a conversation's end. Blocks whose
successor starts with another vector run again, until vectors differ only by constants: such a
difference changes no choice. What has not converged after ``PASSES`` passes takes whole 4x4 cost
matrices, which are stitched in order. The stitched backward costs then drive the tracing: from the
state that the blocks before end in, the least letter on a cheapest path is taken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.taskcontext import TaskContext

from rowtrail.llm.common import named, written

BLOCK_ROWS = 4096
BLOCK_BYTES = 1 << 20
OUT_BYTES = 4 << 20
PASSES = 4
STATES = 4  # nothing yet, after system, after user, after assistant
AFTER = (2, 2, 3, 2)  # the state after the user or assistant turn that a state lacks
LACKS = ("user", "assistant")
DELETE, REROLE, INSERT, CUT_OFF = 2, 1, 5, 5
FAR = 1 << 50
END = (0, 2 * INSERT, INSERT, 0)  # costs of ending in each state
LEGAL = {"su", "ua", "au"}
WHITE = " \t\n\x0b\x0c\r"

# A row's code: what its first copy is. The copies after it are repeats and always deleted.
GONE, OTHER, SYSTEM, USER, ASSISTANT = range(5)
BROKEN = 8  # added where the text is cut off


def damage(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, copies) with faults planted by a checksum of conversation and turn.

    Of 20 remainders 0 drops a row (no copies), 1 empties its text, 2 removes sentence ends, 3 repeats it
    and 4 makes it the user's. Null roles and texts are one space, also null ids within the checksum.
    """
    spelled = lambda c: F.coalesce(named(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spelled(conv_col), F.lit(":"), spelled(turn_col))) % 20
    text = F.coalesce(named(text_col), F.lit(" "))
    return df.select(
        named(conv_col).alias("conv_id"), named(turn_col).alias("turn"),
        F.when(kind == 4, "user").otherwise(F.coalesce(named(role_col), F.lit(" "))).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


# --- costs ----------------------------------------------------------------------------------------


def next_state(code: int, state: int) -> int:
    """The state after keeping a row, -1 where its role does not fit."""
    kind = code & 7
    if kind == SYSTEM:
        return 1 if state == 0 else -1
    if kind == USER:
        return 2 if state != 2 else -1
    return 3 if kind == ASSISTANT and state == 2 else -1


def back(codes: list[int], copies: list[int], end: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
    """From the last row to the first: the cost of finishing from each state before it, given ``end``."""
    now = end
    for code, n in zip(reversed(codes), reversed(copies), strict=True):
        extra = DELETE * (n - 1)
        if code == GONE:
            now = tuple(x + extra + DELETE for x in now)
        else:
            cut = CUT_OFF if code & BROKEN else 0
            best = []
            for state in range(STATES):
                to = next_state(code, state)
                best.append(extra + min(now[state] + DELETE, now[AFTER[state]] + REROLE + cut, now[to] + cut if to >= 0 else FAR))
            user = min(best[2], best[3] + INSERT)
            now = (min(best[0], user + INSERT), min(best[1], user + INSERT), user, min(best[3], best[2] + INSERT))
        yield now


def start_costs(codes: list[int], copies: list[int], end: tuple[int, ...]) -> tuple[int, ...]:
    now = tuple(end)
    for now in back(codes, copies, now):  # noqa: B007
        pass
    return now


def trace(codes: list[int], copies: list[int], end: tuple[int, ...], state: int, last: bool) -> tuple[list[str], int, int]:
    """Letters of the least cheapest edits from ``state``, one entry per row and one for the end, with cost and end state.

    Letters before a row's own are insertions; the deletions of its copies follow in the same entry.
    """
    costs = [tuple(end), *back(codes, copies, tuple(end))][::-1]
    out, total = [], 0
    for at, (code, n) in enumerate(zip(codes, copies, strict=True)):
        letters, after, extra = "", costs[at + 1], DELETE * (n - 1)
        while True:
            left = costs[at][state]
            cut = CUT_OFF if code & BROKEN else 0
            to = next_state(code, state) if code != GONE else -1
            if after[state] + DELETE + extra == left:
                letters, total = letters + "D", total + DELETE
                break
            if code != GONE and costs[at][AFTER[state]] + INSERT == left:
                letters, total, state = letters + "I", total + INSERT, AFTER[state]
                continue
            if to >= 0 and after[to] + cut + extra == left:
                letters, total, state = letters + "K", total + cut, to
                break
            letters, total, state = letters + "R", total + cut + REROLE, AFTER[state]
            break
        out.append(letters + "D" * (n - 1))
        total += extra
    tail = ""
    while last and state in (1, 2):
        tail, total, state = tail + "I", total + INSERT, AFTER[state]
    return [*out, tail], total, state


def rows_of(letters: list[str], roles: list[str], texts: list[str], state: int) -> Iterator[tuple[str, str]]:
    """(role, text) of what the edits of one block leave, from its start state on."""
    for entry, role, text in zip(letters, [*roles, ""], [*texts, ""], strict=True):
        for letter in entry:
            if letter == "I":
                yield LACKS[state == 2], ""
                state = AFTER[state]
            elif letter == "R":
                yield LACKS[state == 2], text
                state = AFTER[state]
            elif letter == "K":
                yield role, text
                state = {"s": 1, "u": 2, "a": 3}[role[0]]


def same_choices(a, b) -> bool:
    """True where two cost vectors differ by a constant only."""
    return len({x - y for x, y in zip(a, b, strict=True)}) == 1


# --- blocks ---------------------------------------------------------------------------------------


class Block:
    """Consecutive rows of one conversation."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.roles, self.texts, self.copies, self.codes, self.bytes = conv_id, [], [], [], [], [], 0
        self.blank = self.duplicate = self.truncated = 0

    def add(self, turn, role: str, text: str, copies: int, again: bool) -> None:
        body = text.strip(WHITE)
        broken = bool(body) and body[-1] not in ".!?"
        if not body:
            self.blank += copies
        else:
            self.duplicate += copies if again else copies - 1
            self.truncated += broken and not again
        kind = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(role[:1], OTHER)
        self.codes.append(GONE if not body or again else kind + BROKEN * broken)
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.copies.append(copies)
        self.bytes += len(role) + len(text) + 64

    def row(self, part: int, number: int) -> dict:
        turns = [t for t in self.turns if t is not None]
        initials = [r[:1] for r in self.roles]
        illegal = sum(x + y not in LEGAL for x, y in zip(initials, initials[1:])) + sum(n - 1 for n in self.copies)  # noqa: B905
        return {
            "conv_id": self.conv_id, "part": part, "no": number, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": illegal,
            "first": initials[0] if initials else None, "last": initials[-1] if initials else None,
            "low": turns[0] if turns else None, "high": turns[-1] if turns else None, "turns": len(set(turns)),
            "codes": bytes(self.codes), "copies": self.copies, "roles": self.roles, "texts": self.texts,
            "used": list(END), "out": list(start_costs(self.codes, self.copies, END)),
        }


def _schema(conv: T.DataType, turn: T.DataType) -> T.StructType:
    number, vector = T.LongType(), T.ArrayType(T.LongType())
    fields = {
        "conv_id": conv, "part": number, "no": number, "blank": number, "duplicate": number, "truncated": number, "illegal": number,
        "first": T.StringType(), "last": T.StringType(), "low": turn, "high": turn, "turns": number, "codes": T.BinaryType(), "copies": vector,
        "roles": T.ArrayType(T.StringType()), "texts": T.ArrayType(T.StringType()), "used": vector, "out": vector,
    }
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


def _packed(rows: Iterator[tuple[dict, int]], schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """Record batches of about ``OUT_BYTES`` from (row, bytes)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, held, size = to_arrow_schema(schema), [], 0
    for row, own in rows:
        held.append(row)
        size += own + 200
        if size >= OUT_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema=arrow)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=arrow)


def _records(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in it:
        for lo in range(0, batch.num_rows, 512):
            yield from batch.slice(lo, 512).to_pylist()


def blocks_of(rows: DataFrame) -> DataFrame:
    """Blocks of neighbouring rows, with the costs of the first, speculative pass.

    Equal rows are counted before they are shuffled. A row is a repeat where an earlier turn of its
    conversation holds the same role and text; only texts that come twice are joined for that. Range
    partitions cut a long conversation, whatever its share of all rows.
    """
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    which = F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))
    spelled = F.concat_ws("\0", F.length(which).cast("string"), which, F.length("role").cast("string"), F.col("role"))
    counted = written(counted.withColumn("digest", F.unhex(F.sha2(F.concat(spelled, F.lit("\0"), F.col("text")), 256))), "rows")
    seen = counted.filter("copies > 0").groupBy(F.col("digest").alias("held")).agg(F.min("turn").alias("earliest"), F.max(F.col("turn").isNull()).alias("unset"), F.count(F.lit(1)).alias("n"))
    again = F.col("held").isNotNull() & F.col("turn").isNotNull() & (F.col("unset") | (F.col("turn") > F.col("earliest")))
    marked = counted.join(seen.filter("n > 1"), F.col("digest") == F.col("held"), "left")
    marked = marked.select("conv_id", "turn", "role", "text", "copies", F.coalesce(again, F.lit(False)).alias("again"), F.substring("text", 1, 32).alias("head"))
    # Rows of one turn come by role and text; the head of the text serves to cut a turn of many rows.
    ordered = marked.repartitionByRange("conv_id", "turn", "role", "head").sortWithinPartitions("conv_id", "turn", "role", "text").drop("head")
    schema = _schema(rows.schema["conv_id"].dataType, rows.schema["turn"].dataType)

    def pack(it):
        part, number, block = TaskContext.get().partitionId(), 0, None
        for r in _records(it):
            if block is not None and (r["conv_id"] != block.conv_id or len(block.codes) >= BLOCK_ROWS or block.bytes >= BLOCK_BYTES):
                yield block.row(part, number), block.bytes
                block, number = None, number + 1
            if block is None:
                block = Block(r["conv_id"])
            if r["copies"]:
                block.add(r["turn"], r["role"], r["text"], r["copies"], r["again"])
        if block is not None:
            yield block.row(part, number), block.bytes

    return written(ordered.mapInArrow(lambda it: _packed(pack(it), schema), schema), "blocks")


# --- fix-up passes and stitching --------------------------------------------------------------------


def _by_conversation(df: DataFrame, *order) -> DataFrame:
    """Rows of one conversation behind each other in one task."""
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def _grouped(records: Iterator[dict]) -> Iterator[tuple[bool, dict]]:
    """(first of its conversation, row)."""
    last = None
    for r in records:
        yield last is None or last["conv_id"] != r["conv_id"], r
        last = r


def joints(blocks: DataFrame, passes: int = PASSES) -> DataFrame:
    """(part, no, start, end, closing) of all blocks of conversations that have several: start state and end costs.

    A row here is a block's codes without texts, so a pass costs a few bytes per row.
    """
    spark = blocks.sparkSession
    several = blocks.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("conv_id").alias("which"))
    small = blocks.select("conv_id", "part", "no", "codes", "copies", "used", "out")
    now = written(small.join(several, F.col("conv_id").eqNullSafe(F.col("which")), "left_semi"), "passes")
    after = F.lead("out").over(Window.partitionBy("conv_id").orderBy("part", "no"))
    schema = now.schema

    def rerun(it):
        for r in _records(it):
            if r["want"] is not None and not same_choices(r["want"], r["used"]):
                r["used"], r["out"] = r["want"], list(start_costs(list(r["codes"]), r["copies"], tuple(r["want"])))
            yield {c: r[c] for c in schema.names}, len(r["codes"]) * 9

    differs = "exists(transform(sequence(1, 3), k -> want[k] - used[k]), d -> d != want[0] - used[0])"
    for _ in range(passes):
        wanted = written(now.withColumn("want", after), "wanted")
        if not wanted.filter(f"want IS NOT NULL AND {differs}").take(1):
            break
        now = written(wanted.mapInArrow(lambda it: _packed(rerun(it), schema), schema), "passes")
    else:
        now = _by_matrices(now)
    kind = T.StructType([schema["conv_id"], schema["part"], schema["no"], T.StructField("maps", T.ArrayType(T.LongType())), T.StructField("end", T.ArrayType(T.LongType())), T.StructField("closing", T.BooleanType())])

    def ends(it):
        for r in _records(it):
            end, last = (tuple(r["want"]), False) if r["want"] is not None else (END, True)
            maps = [trace(list(r["codes"]), r["copies"], end, s, last)[2] for s in range(STATES)]
            yield {"conv_id": r["conv_id"], "part": r["part"], "no": r["no"], "maps": maps, "end": list(end), "closing": last}, 100

    mapped = now.withColumn("want", after).mapInArrow(lambda it: _packed(ends(it), kind), kind)
    out = "part long, no long, start long, end array<long>, closing boolean"

    def starts(it):
        state = 0
        for first, r in _grouped(_records(it)):
            state = 0 if first else state
            yield {"part": r["part"], "no": r["no"], "start": state, "end": r["end"], "closing": r["closing"]}, 100
            state = r["maps"][state]

    schema_out = spark.createDataFrame([], out).schema
    return written(_by_conversation(mapped, "part", "no").mapInArrow(lambda it: _packed(starts(it), schema_out), schema_out), "joints")


def _by_matrices(now: DataFrame) -> DataFrame:
    """Exact vectors: each block's costs between all states, made side by side, folded from the last block back."""
    schema = now.schema
    with_matrix = T.StructType([*schema, T.StructField("matrix", T.ArrayType(T.LongType()))])

    def matrices(it):
        for r in _records(it):
            units = [tuple(0 if s == t else FAR for s in range(STATES)) for t in range(STATES)]
            columns = [start_costs(list(r["codes"]), r["copies"], u) for u in units]
            yield r | {"matrix": [columns[t][s] for s in range(STATES) for t in range(STATES)]}, len(r["codes"]) * 9

    def fold(it):
        costs = END
        for first, r in _grouped(_records(it)):
            costs = END if first else costs
            m = np.array(r.pop("matrix"), np.int64).reshape(STATES, STATES)
            r["used"], costs = list(costs), tuple((m + np.array(costs, np.int64)).min(1).tolist())
            r["out"] = list(costs)
            yield r, len(r["codes"]) * 9

    made = now.mapInArrow(lambda it: _packed(matrices(it), with_matrix), with_matrix)
    back_first = _by_conversation(made, F.desc("part"), F.desc("no"))
    return written(back_first.mapInArrow(lambda it: _packed(fold(it), schema), schema), "passes")


# --- results --------------------------------------------------------------------------------------


def _with_joints(blocks: DataFrame) -> DataFrame:
    return blocks.drop("used", "out").join(joints(blocks), ["part", "no"], "left")


def _traced(r: dict) -> tuple[list[str], int, int]:
    start = r["start"] or 0
    end, last = (END, True) if r["end"] is None else (tuple(r["end"]), r["closing"])
    letters, cost, _ = trace(list(r["codes"]), r["copies"], end, start, last)
    return letters, cost, start


def repaired_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, part, no, place, role, text): the rows of all repaired conversations, in that order."""
    blocks = blocks_of(rows)
    schema = T.StructType([blocks.schema[c] for c in ("conv_id", "part", "no")] + [T.StructField("place", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])

    def run(it):
        for r in _records(it):
            letters, _, start = _traced(r)
            for place, (role, text) in enumerate(rows_of(letters, r["roles"], r["texts"], start)):
                yield {"conv_id": r["conv_id"], "part": r["part"], "no": r["no"], "place": place, "role": role, "text": text}, len(text)

    return _with_joints(blocks).mapInArrow(lambda it: _packed(run(it), schema), schema)


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text, copies): faults, edits and a digest of the result.

    Rows are taken by turn, nulls first, then by role and text, and repeated ``copies`` times; a
    conversation whose rows all have no copies gives zeros. Null conversation ids are one conversation.
    ``gaps`` counts missing turns, ``illegal`` the neighbours whose role initials are not su, ua or au.
    ``audit`` holds the initials of the cheapest edits, the ASCII-least on ties. Blocks of a long
    conversation are read in order by one task for its digest and audit, one block at a time.
    """
    blocks = blocks_of(rows)
    conv = blocks.schema["conv_id"]
    long, text = T.LongType(), T.StringType()
    # A part holds the repaired text itself only where the conversation goes on in other blocks.
    part_schema = T.StructType([
        conv, *(T.StructField(c, long) for c in ("part", "no")), *(T.StructField(c, long) for c in ("blank", "duplicate", "truncated", "illegal", "turns", "cost")),
        *(blocks.schema[c] for c in ("first", "last", "low", "high")), T.StructField("alone", T.BooleanType()), T.StructField("audit", text),
        T.StructField("body", text), T.StructField("repaired_sha256", text),
    ])

    def parts(it):
        for r in _records(it):
            letters, cost, start = _traced(r)
            lines = [f"{role}:{text}" for role, text in rows_of(letters, r["roles"], r["texts"], start)]
            body, alone = "\n".join(lines), r["end"] is None
            keep = {c: r[c] for c in ("conv_id", "part", "no", "blank", "duplicate", "truncated", "illegal", "turns", "first", "last", "low", "high")}
            digest = hashlib.sha256(body.encode("utf-8", "surrogatepass")).hexdigest() if alone else None
            yield keep | {"cost": cost, "alone": alone, "audit": "".join(letters), "body": None if alone or not lines else body, "repaired_sha256": digest}, len(body)

    done = written(_with_joints(blocks).mapInArrow(lambda it: _packed(parts(it), part_schema), part_schema), "parts")
    out = T.StructType([conv, *(T.StructField(c, long) for c in COUNTS), T.StructField("audit", text), T.StructField("repaired_sha256", text)])

    def fold(it):
        held = None
        for first, r in _grouped(_records(it)):
            if first:
                if held is not None:
                    yield finish(held)
                held = r | {"sha": hashlib.sha256(), "any": False, "audits": []}
            else:
                for c in ("blank", "duplicate", "truncated", "cost"):
                    held[c] += r[c]
                held["illegal"] += r["illegal"] + (held["last"] is not None and r["first"] is not None and held["last"] + r["first"] not in LEGAL)
                held["turns"] += r["turns"] - (held["high"] is not None and held["high"] == r["low"])
                held["low"] = r["low"] if held["low"] is None else held["low"]
                held["high"] = held["high"] if r["high"] is None else r["high"]
                held["last"] = held["last"] if r["last"] is None else r["last"]
            held["audits"].append(r["audit"])
            if r["body"] is not None:
                held["sha"].update((("\n" if held["any"] else "") + r["body"]).encode("utf-8", "surrogatepass"))
                held["any"] = True
        if held is not None:
            yield finish(held)

    def finish(h):
        gaps = 0 if h["low"] is None else h["high"] - h["low"] + 1 - h["turns"]
        row = {"conv_id": h["conv_id"], "gaps": gaps, "audit": "".join(h["audits"]), "repaired_sha256": h["sha"].hexdigest()}
        return row | {c: h[c] for c in ("blank", "duplicate", "truncated", "illegal", "cost")}, sum(map(len, h["audits"]))

    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long").alias("gaps")
    single = done.filter("alone").select("conv_id", gaps, *COUNTS[1:], "audit", "repaired_sha256")
    many = _by_conversation(done.filter("NOT alone"), "part", "no").mapInArrow(lambda it: _packed(fold(it), out), out)
    return single.unionByName(many)
