"""Repair of conversation structure by lightest derivations (operator 11)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from heapq import heappop, heappush
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmatch.llm.common import saved, table
from shelfmatch.skew import null_safe

#: State after a prefix of roles ``(s?(ua)+)?``: 0 nothing, 1 after s, 2 inside a pair, 3 after a pair.
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPTING = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows of a conversation solved together, and spans joined together.
BLOCK, FAN_IN = 64, 16

Edge = tuple[int, int, str]  # state reached, cost, audit


def row_edges(initial: str, fault: str, copies: int) -> list[list[Edge]]:
    """Edits of one row, by the state before it. Further copies of the row are duplicates, so deleted."""
    gone = (DELETE * copies, "D" * copies)
    out: list[list[Edge]] = [[(p, *gone)] for p in range(4)]
    if fault not in ("blank", "duplicate"):
        cost, rest = DELETE * (copies - 1) + (TRUNCATED if fault == "truncated" else 0), "D" * (copies - 1)
        for p, steps in enumerate(STEPS):
            if initial in steps:
                out[p].append((steps[initial], cost, "K" + rest))
            out[p].extend((steps[r], cost + REROLE, "R" + rest) for r in ROLES if r in steps)
    return out


INSERTS: list[list[Edge]] = [[(steps[r], INSERT, "I") for r in ROLES if r in steps] for steps in STEPS]


def lightest(steps: list[list[list[Edge]]], starts: tuple[int, ...], last: bool, inserts: bool) -> list[dict]:
    """Lightest derivations of the spans over ``steps`` from each start state, by Knuth's agenda.

    An item is [steps consumed, state]. A deduction joins an item with an edge (the edits of the next
    row, or the span of the next block) or with an insertion; its value is the sum of the costs and the
    audits one after the other. Values are compared by (cost, audit). The function is superior: a
    conclusion is never lighter than its premise. It keeps order too: two audits of one item with equal
    cost are never prefixes of each other, as an audit settles its cost and what it consumed. So the
    first value popped for an item is its lightest and final.

    ``last`` spans end a conversation: the agenda stops when the first accepting goal is final. Others
    stop when every goal that can be reached is. Ties go to the ASCII-least audit.
    """
    end, out = len(steps), []
    for start in starts:
        agenda, final, goals = [(0, "", 0, start, -1)], {}, 0
        while agenda:
            cost, audit, at, state, before = heappop(agenda)
            if (at, state) in final:
                continue
            final[at, state] = before
            if at == end and (not last or state in ACCEPTING):
                path, here = [state], state
                if not inserts:
                    for i in range(end, 0, -1):
                        here = final[i, here]
                        path.append(here)
                out.append({"p": start, "q": state, "cost": cost, "audit": audit, "path": path[::-1]})
                goals += 1
                if last or goals == 4:
                    break
            if at < end:
                for reached, more, letters in steps[at][state]:
                    if (at + 1, reached) not in final:
                        heappush(agenda, (cost + more, audit + letters, at + 1, reached, state))
            if inserts:
                for reached, more, letters in INSERTS[state]:
                    if (at, reached) not in final:
                        heappush(agenda, (cost + more, audit + letters, at, reached, state))
    return out


def block_spans(rows: list[dict], first: bool, last: bool) -> dict:
    """Spans of one block of rows and what its rows add to the conversation's counts."""
    out = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "head": rows[0]["initial"], "tail": rows[-1]["initial"]}
    for i, row in enumerate(rows):
        copies, fault = row["copies"], row["fault"]
        if fault in ("blank", "duplicate"):
            out[fault] += copies
        else:
            out["duplicate"] += copies - 1
            out["truncated"] += fault == "truncated"
        out["illegal"] += copies - 1 + (i > 0 and rows[i - 1]["initial"] + row["initial"] not in LEGAL)
    steps = [row_edges(r["initial"], r["fault"], r["copies"]) for r in rows]
    return out | {"spans": lightest(steps, (0,) if first else (0, 1, 2, 3), last, True)}


def joined_spans(parts: list[dict], first: bool, last: bool) -> dict:
    """Spans of neighbouring blocks joined to spans of all of them."""
    out = {k: sum(p[k] for p in parts) for k in ("blank", "duplicate", "truncated", "illegal")}
    out["illegal"] += sum(a["tail"] + b["head"] not in LEGAL for a, b in zip(parts, parts[1:]))
    steps = []
    for part in parts:
        edges: list[list[Edge]] = [[], [], [], []]
        for span in part["spans"]:
            edges[span["p"]].append((span["q"], span["cost"], span["audit"]))
        steps.append(edges)
    return out | {"head": parts[0]["head"], "tail": parts[-1]["tail"], "spans": lightest(steps, (0,) if first else (0, 1, 2, 3), last, False)}


def edits_of(rows: list[dict], audit: str, state: int) -> Iterator[tuple[int, int, str, str | None]]:
    """What a chosen audit does to a block: ``seq, place, edit, new role``; a run of copies deleted is one edit."""
    at, place, leading = 0, 0, len(audit) - len(audit.lstrip("I"))
    skip = 0
    for i, letter in enumerate(audit):
        if skip:
            skip -= 1
            continue
        role = ROLES["a" if state == 2 else "u"]
        if letter == "I":
            state = STEPS[state][role[0]]
            if at:
                place += 1
                yield rows[at - 1]["seq"], place, "I", role
            else:
                yield rows[0]["seq"], i - leading, "I", role
            continue
        row, place = rows[at], 0
        at += 1
        skip = row["copies"] - 1
        if letter != "D":
            state = STEPS[state][row["initial"] if letter == "K" else role[0]]
        yield row["seq"], 0, letter, role if letter == "R" else None


SPAN = "array<struct<p:int,q:int,cost:bigint,audit:string,path:array<int>>>"
STATS = f"blank bigint, duplicate bigint, truncated bigint, illegal bigint, head string, tail string, spans {SPAN}"
ARROW_STATS = [
    *[(n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal")], ("head", pa.string()), ("tail", pa.string()),
    ("spans", pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), ("path", pa.list_(pa.int32()))]))),
]


def _solved(groups: DataFrame, solve: Callable[[list[dict], bool, bool], dict], keep: int) -> DataFrame:
    """The first ``keep`` columns (conversation, node, last, ...) and the spans of the last column's parts."""
    names = groups.columns[:keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, lasts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            found = [solve(parts.as_py(), node == 0, last) for node, last, parts in zip(nodes, lasts, batch.column(batch.num_columns - 1))]
            columns = [pa.array([f[n] for f in found], kind) for n, kind in ARROW_STATS]
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], *columns], names=[*names, *[n for n, _ in ARROW_STATS]])

    schema = T.StructType([*groups.schema.fields[:keep], *T.StructType.fromDDL(STATS)])
    return groups.mapInArrow(run, schema)


class Repair(NamedTuple):
    """``turns``: ``conv_id, seq, place, edit, turn, role, text, copies``, rising by seq and place inside a
    conversation; edit D rows, and copies after the first of any row, are taken out. ``summaries``: a row per conversation that has rows."""

    turns: DataFrame
    summaries: DataFrame


def repair(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Repair:
    """Cheapest edits after which the roles of every conversation read ``(s?(ua)+)?``.

    Rows of a conversation are taken by turn, nulls first; ties by role, then by text. Null roles and
    texts count as one space, a null conversation is one of its own. A row's first fault counts: blank,
    duplicate (role and text seen earlier in the conversation), truncated (last character that is no
    blank is none of ``.!?``). Keep costs 0, rerole 3, delete 4 (forced for blank and duplicate rows),
    insert an empty turn 3; a truncated row that stays adds 3. Other columns are not read. No rows give
    no conversations.

    Equal rows are one row with a count. Rows get a place in the whole order, and every conversation is
    cut into blocks of 64 rows. Blocks are solved apart (``lightest``), then joined 16 at a time by the
    same deductions over their spans until one is left; its choice goes back down to the blocks. No task
    holds more of a long conversation than a block's rows, or the audits of 16 spans.
    """
    rows = df.select(
        F.col(conv_col).alias("__conv"), F.col(turn_col).alias("__turn"), F.coalesce(role_col, F.lit(" ")).alias("__role"),
        F.coalesce(text_col, F.lit(" ")).alias("__text"),
    ).groupBy("__conv", "__turn", "__role", "__text").agg(F.count(F.lit(1)).alias("__copies"))
    order = [F.col("__conv"), F.col("__turn").asc_nulls_first(), F.col("__role")]
    text = F.col("__text")
    # A range's bounds need no whole texts: rows that share 64 characters share a range and are sorted there.
    rows = saved(
        rows.repartitionByRange(*order, F.substring(text, 1, 64)).sortWithinPartitions(*order, text).select(
            "*", F.monotonically_increasing_id().alias("__seq"), F.spark_partition_id().alias("__part"),
            F.substring("__role", 1, 1).alias("__initial"), F.unhex(F.sha2(text, 256)).alias("__digest"),
            (~text.rlike(r"[^\x20\x09-\x0D]")).alias("__blank"), (~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("__cut"),
        )
    )
    thin = rows.drop("__text")
    keys = ["__conv", "__role", "__digest"]
    seen = thin.groupBy(*keys).agg(F.min("__seq").alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    seen = seen.select(*[F.col(k).alias(f"{k}_s") for k in keys], "__first")
    same = F.col("__conv").eqNullSafe(F.col("__conv_s")) & (F.col("__role") == F.col("__role_s")) & (F.col("__digest") == F.col("__digest_s"))
    fault = F.when(F.col("__blank"), "blank").when(F.col("__seq") > F.col("__first"), "duplicate").when(F.col("__cut"), "truncated").otherwise("")
    # A conversation has at most one row here per range of the order.
    across = Window.partitionBy("__conv").orderBy("__part")
    offsets = thin.groupBy("__conv", "__part").agg(F.min("__seq").alias("__low"), F.count(F.lit(1)).alias("__n")).select(
        F.col("__conv").alias("__conv_o"), F.col("__part").alias("__part_o"), "__low",
        F.coalesce(F.sum("__n").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        F.sum("__n").over(Window.partitionBy("__conv")).alias("__total"),
    )
    at_home = F.col("__conv").eqNullSafe(F.col("__conv_o")) & (F.col("__part") == F.col("__part_o"))
    node = F.floor((F.col("__seq") - F.col("__low") + F.col("__before")) / BLOCK)
    blocks = (
        thin.join(seen, same, "left").join(offsets, at_home)
        .select("__conv", node.alias("__node"), (node == F.floor((F.col("__total") - 1) / BLOCK)).alias("__last"), F.struct(
            F.col("__seq").alias("seq"), F.col("__initial").alias("initial"), fault.alias("fault"), F.col("__copies").alias("copies")).alias("row"))
        .groupBy("__conv", "__node", "__last").agg(F.sort_array(F.collect_list("row")).alias("__rows"))
    )
    # The rows stay beside their spans, for the way down.
    levels = [saved(_solved(blocks.select("*", F.col("__rows").alias("__parts")), block_spans, 4))]
    top = levels[0].agg(F.max("__node")).first()[0] or 0
    whole = (F.col("__node") == 0) & F.col("__last")
    roots = [levels[0].where(whole).drop("__rows")]
    part = F.struct("__node", *[n for n, _ in ARROW_STATS])
    while top:
        below = levels[-1].drop("__rows") if len(levels) > 1 else levels[0].where(~whole).drop("__rows")
        groups = below.groupBy("__conv", F.floor(F.col("__node") / FAN_IN).alias("__node")).agg(
            F.max("__last").alias("__last"), F.sort_array(F.collect_list(part)).alias("__parts"))
        levels.append(saved(_solved(groups, joined_spans, 3)))
        top //= FAN_IN
    if len(levels) > 1:
        roots.append(levels[-1])

    choice = F.col("spans")[0]
    chosen = levels[-1].where(whole).select("__conv", "__node", choice["p"].alias("__p"), choice["q"].alias("__q"))
    for above, below in zip(levels[:0:-1], levels[-2::-1]):
        span = F.filter("spans", lambda s: (s["p"] == F.col("__p")) & (s["q"] == F.col("__q")))[0]
        down = _picked(above, chosen).select("__conv", "__node", span["path"].alias("__path"))
        chosen = down.select("__conv", "__node", "__path", F.explode(F.sequence(F.lit(0), F.size("__path") - 2)).alias("__i")).select(
            "__conv", (F.col("__node") * FAN_IN + F.col("__i")).alias("__node"), F.get("__path", F.col("__i")).alias("__p"), F.get("__path", F.col("__i") + 1).alias("__q"))
    if len(levels) > 1:
        alone = levels[0].where(whole).select("__conv", "__node", choice["p"].alias("__p"), choice["q"].alias("__q"))
        chosen = chosen.unionByName(alone)
    turns = _edited(_picked(levels[0], chosen)).join(rows, "__seq").select(
        F.col("__conv_e").alias("conv_id"), F.col("__seq").alias("seq"), F.col("__place").alias("place"), F.col("__edit").alias("edit"),
        F.when(F.col("__edit") != "I", F.col("__turn")).alias("turn"),
        F.coalesce("__new", "__role").alias("role"), F.when(F.col("__edit") == "I", "").otherwise(text).alias("text"),
        F.when(F.col("__edit") == "I", 1).otherwise(F.col("__copies")).alias("copies"),
    )
    solved = roots[0] if len(roots) == 1 else roots[0].unionByName(roots[1])
    spans = thin.groupBy(F.col("__conv").alias("__conv_t")).agg(
        F.min("__turn").alias("__low"), F.max("__turn").alias("__high"), F.countDistinct("__turn").alias("__turns"))
    summaries = solved.join(spans, F.col("__conv").eqNullSafe(F.col("__conv_t"))).select(
        F.col("__conv").alias("conv_id"), F.coalesce(F.col("__high") - F.col("__low") + 1 - F.col("__turns"), F.lit(0)).cast("long").alias("gaps"),
        "blank", "duplicate", "truncated", "illegal", choice["cost"].alias("cost"), choice["audit"].alias("audit"),
    )
    return Repair(turns, summaries)


def _picked(level: DataFrame, chosen: DataFrame) -> DataFrame:
    """Nodes of a level with the states chosen for them."""
    named = chosen.select(F.col("__conv").alias("__conv_c"), F.col("__node").alias("__node_c"), "__p", "__q")
    return level.join(named, F.col("__conv").eqNullSafe(F.col("__conv_c")) & (F.col("__node") == F.col("__node_c")))


def _edited(leaves: DataFrame) -> DataFrame:
    """``__conv_e, __seq, __place, __edit, __new`` of every edit of the chosen spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, at = [], []
            for i, leaf in enumerate(zip(*[c.to_pylist() for c in batch.columns[1:]])):
                found.extend(edits_of(*leaf))
                at.extend([i] * (len(found) - len(at)))
            columns = list(zip(*found)) if found else [[], [], [], []]
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=["__conv_e", "__seq", "__place", "__edit", "__new"])

    schema = T.StructType([T.StructField("__conv_e", leaves.schema["__conv"].dataType), *T.StructType.fromDDL("__seq bigint, __place int, __edit string, __new string")])
    span = F.filter("spans", lambda s: (s["p"] == F.col("__p")) & (s["q"] == F.col("__q")))[0]
    return leaves.select("__conv", "__rows", span["audit"].alias("__audit"), "__p").mapInArrow(run, schema)


def conversation_digests(turns: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: digest of ``role:text`` of the turns that stay, joined by newlines.

    One digest reads its conversation's text from first to last, so the rows of a conversation pass
    through one task; it streams them in order and holds one batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, digest = None, None
        for batch in batches:
            ids, found = [], []
            values = batch.column(0).to_pylist()
            for i, (value, line) in enumerate(zip(values, batch.column(1).to_pylist())):
                if held is None or held[0] != value:
                    if held:
                        ids.append(held[1])
                        found.append(digest.hexdigest())
                    held, digest = (value, batch.column(0).slice(i, 1)), hashlib.sha256(line)
                else:
                    digest.update(b"\n")
                    digest.update(line)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array(found, pa.string())], names=["conv_id", "repaired_sha256"])
        if held:
            yield pa.RecordBatch.from_arrays([held[1], pa.array([digest.hexdigest()])], names=["conv_id", "repaired_sha256"])

    schema = T.StructType([turns.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])
    stay = turns.where("edit <> 'D'").repartition("conv_id").sortWithinPartitions("conv_id", "seq", "place")
    return stay.select("conv_id", F.concat("role", F.lit(":"), "text").cast("binary")).mapInArrow(run, schema)


def damaged(df: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` of conversations hurt by the rule of the query; nulls become one space."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    hurt = df.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array_repeat(F.lit(0), 2)).otherwise(F.array(F.lit(0)))
    return hurt.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage, repair and digests of every conversation; those left without rows have zeros."""
    given = table(spark, sf_dir, "conversations")
    done = repair(damaged(given))
    every = given.select("conv_id").distinct()
    summaries = done.summaries.withColumnRenamed("conv_id", "__of")
    digests = conversation_digests(done.turns).withColumnRenamed("conv_id", "__to")
    return every.join(summaries, F.col("conv_id").eqNullSafe(F.col("__of")), "left").join(
        digests, F.col("conv_id").eqNullSafe(F.col("__to")), "left"
    ).select(
        "conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
