"""Repair of conversation structure as a lightest derivation.

The rows of a conversation, by turn, are edited until their roles read `(s?(ua)+)?` by initials:
perhaps a system row, then user and assistant in turn, or nothing. Keep costs 0, Rerole (to user or
assistant) 1, Delete 2, Insert (an empty user or assistant row, anywhere) 5. Blank rows and
repeats of an earlier row must be deleted; a truncated row that stays costs 5 more. The `audit` is the
initials of the edits in order; of equal costs the audit that is least in ASCII counts.

A row's fault is the first of: blank (nothing but blanks), duplicate (role and text were seen
earlier), truncated (the last character that is no blank is none of `.!?`).

Derivation. An item (rows taken, roles read so far) is worth (cost, audit). An edit deduces an item from
one other by a function that is monotone and never better than what it starts from; a Keep costs
nothing, so the agenda is ordered by (cost, rows taken, audit). Knuth's rule then holds: what is popped
first is final. A conversation is cut into blocks of `BLOCK_ROWS` rows; an agenda runs per block and
state of roles at its start until all reachable states at its end are final. Spans of neighbouring
blocks combine as hyperedges with two antecedents, [i, j, p, r] and [j, k, r, q] to [i, k, p, q],
which add costs and join audits. Of equal rows and costs no audit is a proper prefix of another, since
more letters would be more inserts, so both functions keep the order.

Scale: rows are dealt into ranges of (conversation, turn), so a conversation of any share of the rows
is spread over tasks and read block by block. What comes together per conversation is one summary
per block, and, as a stream in order, its repaired text, of which a digest needs nothing but the
current block.

Defined cases: a null role, text, conversation or turn counts as one space; null turns come first and
do not count in gaps. Rows of one turn go by role, then text. Very long texts make blocks of few
rows. Repeated rows are rows of their own, the later ones duplicates. An empty table has no
conversations. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leasebook.llm.common import map_rows, stage

KEEP, REROLE, DELETE, INSERT, STAYS_TRUNCATED = 0, 1, 2, 5, 5
BLOCK_ROWS = 256
BLOCK_CHARS = 1 << 20
BLANKS = " \t\n\x0b\x0c\r"
USUAL = {"u": "user", "a": "assistant"}

# What may follow: by initial, from nothing read, a system row, a user row, an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ENDS = (START, ASSISTANT)

Span = tuple[int, str]
Spans = dict[tuple[int, int], Span]


def spans_from(start: int, initials: str, faults: str) -> Spans:
    """Best (cost, audit) from `start` to every state after these rows; faults by initial, '-' for none."""
    agenda: list[tuple[int, int, str, int]] = [(0, 0, "", start)]
    final: set[tuple[int, int]] = set()
    ends: Spans = {}
    while agenda:
        cost, taken, audit, state = heapq.heappop(agenda)
        if (taken, state) in final:
            continue
        final.add((taken, state))
        if taken == len(initials):
            ends[start, state] = (cost, audit)
        for initial, after in NEXT[state].items():
            if initial in USUAL and (taken, after) not in final:
                heapq.heappush(agenda, (cost + INSERT, taken, audit + "I", after))
        if taken == len(initials):
            continue
        heapq.heappush(agenda, (cost + DELETE, taken + 1, audit + "D", state))
        if faults[taken] in "bd":
            continue
        more = STAYS_TRUNCATED if faults[taken] == "t" else 0
        for initial, after in NEXT[state].items():
            if initial == initials[taken]:
                heapq.heappush(agenda, (cost + KEEP + more, taken + 1, audit + "K", after))
            if initial in USUAL:
                heapq.heappush(agenda, (cost + REROLE + more, taken + 1, audit + "R", after))
    return ends


def all_spans(initials: str, faults: str) -> Spans:
    return {k: v for start in NEXT for k, v in spans_from(start, initials, faults).items()}


def joined(left: Spans, right: Spans) -> tuple[Spans, dict[tuple[int, int], int]]:
    """Spans over both, and the state between them that each best one goes through."""
    best: Spans = {}
    via: dict[tuple[int, int], int] = {}
    for (p, r), (cost, audit) in left.items():
        for (r2, q), (cost2, audit2) in right.items():
            if r == r2:
                value = (cost + cost2, audit + audit2)
                if (p, q) not in best or value < best[p, q]:
                    best[p, q], via[p, q] = value, r
    return best, via


def lightest(blocks: list[Spans]) -> tuple[int, list[tuple[int, str]]]:
    """Cost of the goal, and for each block the state at its start and its audit."""
    levels: list[tuple[list[Spans], list]] = [(blocks, [])]
    while len(levels[-1][0]) > 1:
        below = levels[-1][0]
        pairs = [joined(*below[i: i + 2]) if i + 1 < len(below) else (below[i], None) for i in range(0, len(below), 2)]
        levels.append(([s for s, _ in pairs], [v for _, v in pairs]))
    whole = levels[-1][0][0]
    cost, _, end = min((*whole[START, q], q) for q in ENDS if (START, q) in whole)
    ways = [(START, end)]
    for _, vias in reversed(levels[1:]):
        ways = [w for (p, q), via in zip(ways, vias) for w in ([(p, q)] if via is None else [(p, via[p, q]), (via[p, q], q)])]
    return cost, [(p, block[p, q][1]) for (p, q), block in zip(ways, blocks)]


def repaired(state: int, audit: str, rows: list[tuple[str, str]]) -> Iterator[str]:
    """`role:text` of a block's rows after the edits."""
    at = iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(at)
        if edit == "D":
            continue
        initial = role[:1] if edit == "K" else next(i for i in NEXT[state] if i in USUAL)
        state = NEXT[state][initial]
        yield f"{role if edit == 'K' else USUAL[initial]}:{text}"


def _order() -> Column:
    return F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv, conv_id, turn, role, text, live) after the damage that each row's crc32 decides.

    Of 20 remainders, 0 drops the row (it stays with live false, so its conversation is known), 1 empties
    the text, 2 takes out `.!?`, 3 repeats the row, 4 makes the role user.
    """
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn"))), F.lit(20))
    return conversations.select(
        one("conv_id").alias("conv"), "conv_id", F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(one("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(one("text"), ".!?", "")).otherwise(one("text")).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(True), F.lit(True))).otherwise(F.array(kind != 0))).alias("live"))


def undamaged(conversations: DataFrame) -> DataFrame:
    """The same columns of conversations as they are."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return conversations.select(
        one("conv_id").alias("conv"), "conv_id", F.col("turn").cast("long").alias("turn"), one("role").alias("role"),
        one("text").alias("text"), F.lit(True).alias("live"))


_BLOCK = (
    "conv string, seq long, n int, roles array<string>, texts array<string>, first string, last string, illegal long, blank long, "
    "duplicate long, truncated long, low long, high long, turns long, spans array<struct<p:int,q:int,cost:long,audit:string>>"
)


def _blocks(rows: DataFrame) -> DataFrame:
    """Runs of rows of one conversation in order, with what is known of each run.

    Rows are dealt into ranges and written with their range, so that a lost task gives the same blocks.
    """
    live = rows.withColumns({"k1": F.xxhash64("role", "text"), "k2": F.xxhash64(F.lit(7), "role", "text")})
    live = live.withColumn("at", _order()).drop("conv_id")
    seen = live.where("live").groupBy("conv", "k1", "k2").agg(F.min("at").alias("since"), F.count(F.lit(1)).alias("times"))
    marked = live.join(seen.where("times > 1").drop("times"), ["conv", "k1", "k2"], "left")
    placed = stage(
        marked.select("conv", "at", "turn", "role", "text", "live", (F.col("since") < F.col("at")).alias("later"), F.col("since").isNotNull().alias("many"))
        .repartitionByRange("conv", "at", "role", "text").withColumn("part", F.spark_partition_id().cast("long")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: dict | None = None
        before: tuple | None = None
        for batch in batches:
            for row in batch.to_pylist():
                key = (row["part"], row["conv"])
                if held is None or held["key"] != key or len(held["rows"]) >= BLOCK_ROWS or held["chars"] >= BLOCK_CHARS:
                    if held:
                        yield held
                    seq = held["seq"] + 1 if held and held["key"][0] == key[0] else key[0] << 32
                    held = {"key": key, "seq": seq, "rows": [], "chars": 0}
                if not row["live"]:
                    continue
                same = (key, row["turn"], row["role"], row["text"]) if row["many"] else None
                bare = row["text"].rstrip(BLANKS)
                if not bare:
                    fault = "b"
                elif row["later"] or (same is not None and same == before):
                    fault = "d"
                else:
                    fault = "-" if bare[-1] in ".!?" else "t"
                before = same
                held["rows"].append((row["turn"], row["role"], row["text"], fault))
                held["chars"] += len(row["text"])
        if held:
            yield held

    def summed(held: dict) -> tuple:
        rows = held["rows"]
        # A role without characters has no initial, so it may stand nowhere.
        initials = "".join(r[1][:1] or " " for r in rows)
        faults = "".join(r[3] for r in rows)
        turns = sorted({r[0] for r in rows if r[0] is not None})
        spans = [(p, q, *v) for (p, q), v in all_spans(initials, faults).items()]
        illegal = sum(initials[i: i + 2] not in ("su", "ua", "au") for i in range(len(rows) - 1))
        return (
            held["key"][1], held["seq"], len(rows), [r[1] for r in rows], [r[2] for r in rows], initials[:1], initials[-1:], illegal,
            faults.count("b"), faults.count("d"), faults.count("t"), turns[0] if turns else None, turns[-1] if turns else None, len(turns), spans)

    schema = rows.sparkSession.createDataFrame([], _BLOCK).schema

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)

        def pack(ready: list[tuple]) -> pa.RecordBatch:
            spans = [[dict(zip("pq", s[:2]), cost=s[2], audit=s[3]) for s in r[-1]] for r in ready]
            columns = [*list(zip(*ready))[:-1], spans]
            return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, arrow)], schema=arrow)

        ready, chars = [], 0
        for held in cut(batches):
            ready.append(summed(held))
            chars += held["chars"]
            if len(ready) >= 512 or chars >= 4 * BLOCK_CHARS:
                yield pack(ready)
                ready, chars = [], 0
        if ready:
            yield pack(ready)

    ordered = placed.repartition("part").sortWithinPartitions("part", "conv", "at", "role", "text").drop("at")
    return stage(ordered.mapInArrow(write, schema))


def _ways(blocks: DataFrame) -> DataFrame:
    """Per conversation its figures, and per block the state at its start and its audit."""
    summary = F.struct("seq", "n", "first", "last", "illegal", "blank", "duplicate", "truncated", "low", "high", "turns", "spans")
    together = blocks.groupBy("conv").agg(F.sort_array(F.collect_list(summary)).alias("blocks"))

    def solve(batch: dict[str, list]) -> Iterator[tuple]:
        for conv, blocks in zip(batch["conv"], batch["blocks"]):
            cost, ways = lightest([{(s["p"], s["q"]): (s["cost"], s["audit"]) for s in b["spans"]} for b in blocks])
            filled = [b for b in blocks if b["n"]]
            timed = [b for b in blocks if b["turns"]]
            total = lambda c: sum(b[c] for b in blocks)
            illegal = total("illegal") + sum(a["last"] + b["first"] not in ("su", "ua", "au") for a, b in zip(filled, filled[1:]))
            turns = total("turns") - sum(a["high"] == b["low"] for a, b in zip(timed, timed[1:]))
            gaps = timed[-1]["high"] - timed[0]["low"] + 1 - turns if timed else 0
            yield (conv, gaps, total("blank"), total("duplicate"), total("truncated"), illegal, cost, "".join(a for _, a in ways),
                   [dict(seq=b["seq"], state=p, edits=a) for b, (p, a) in zip(blocks, ways)])

    return stage(map_rows(together, solve, (
        "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
        "ways array<struct<seq:long,state:int,edits:string>>")))


def repaired_rows(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations with their figures and audit, blocks of repaired rows (conv, seq, lines)).

    Takes rows as `damaged` and `undamaged` give them. Blocks of a conversation are in the order of seq.
    """
    blocks = _blocks(conversations)
    solved = _ways(blocks)
    ways = solved.select("conv", F.explode("ways").alias("w")).select("conv", "w.*")

    def edit(batch: dict[str, list]) -> Iterator[tuple]:
        for conv, seq, state, edits, roles, texts in zip(*(batch[c] for c in ("conv", "seq", "state", "edits", "roles", "texts"))):
            yield conv, seq, list(repaired(state, edits, list(zip(roles, texts))))

    joined = blocks.select("conv", "seq", "roles", "texts").join(ways, ["conv", "seq"])
    return solved.drop("ways"), map_rows(joined, edit, "conv string, seq long, lines array<string>", flush=64)


def repair(conversations: DataFrame) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    solved, lines = repaired_rows(conversations)
    # Streamed in order: a conversation's digest needs its current block only.
    ordered = lines.where(F.size("lines") > 0).repartition("conv").sortWithinPartitions("conv", "seq")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((c, x) for b in batches for c, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        for conv, blocks in groupby(rows, key=lambda r: r[0]):
            total = hashlib.sha256()
            for i, (_, part) in enumerate(blocks):
                total.update(("\n" if i else "").encode() + "\n".join(part).encode())
            yield pa.RecordBatch.from_pylist([{"conv": conv, "repaired_sha256": total.hexdigest()}])

    digests = ordered.select("conv", "lines").mapInArrow(digest, "conv string, repaired_sha256 string")
    nothing = F.lit(hashlib.sha256().hexdigest())
    kind = conversations.schema["conv_id"].dataType
    return solved.join(digests, "conv", "left").select(
        F.when(F.col("conv") != " ", F.col("conv")).cast(kind).alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal",
        "cost", "audit", F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))
