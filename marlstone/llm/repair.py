"""Repair of conversations: the cheapest edits after which roles alternate, found as the least whole number over a graph of turns.

A path's weight is one big integer: its high digits are the cost, its low digits the audit letters, each at the place that it has in the
audit, of fixed width and with zeros behind the last. The least integer is then the cheapest repair, and of equally cheap ones that with
the ASCII-least audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import materialise, placed, read

#: Turns that are searched at once; a longer conversation is cut, and its parts' least weights between all states are composed.
SEGMENT = 1_024
#: Parts of one conversation that are composed by one task.
COMPOSED = 32
BLANKS = " \t\n\x0b\x0c\r"

#: States of the roles so far: nothing, a system turn, a user turn last, an assistant turn last.
NOTHING, SYSTEM, USER, ASSISTANT = STATES = range(4)
#: Where an inserted or relabelled turn leads, and where a kept one does by its initial.
TURN = {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
KEPT = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: Letters by rising code, and their digits; DIGIT bits each.
LETTERS = " DIKR"
DELETE, INSERT, KEEP, REROLE = range(1, 5)
DIGIT = 3
COST = {DELETE: 3, INSERT: 2, KEEP: 0, REROLE: 2}
#: From a state to the end: cost and letters of the turns that are still inserted.
END = {NOTHING: (0, ""), SYSTEM: (4, "II"), USER: (2, "I"), ASSISTANT: (0, "")}


def least_paths(turns: list[tuple[str, bool, bool]], start: int) -> dict[int, tuple[int, str]]:
    """state: (cost, audit), the least path from start to every state that the turns (initial, bad, truncated) can lead to. A bad turn has to go.

    Turns are inserted before a turn only, so that parts of a conversation fit together without counting a place twice.
    """
    # No path inserts two turns but from the states without a user or assistant, which it leaves once.
    places = 2 * len(turns) + 2
    weigh = lambda letter, at, more=0: ((COST[letter] + more) << (DIGIT * places)) + (letter << (DIGIT * (places - 1 - at)))
    best: dict[int, tuple[int, int]] = {start: (0, 0)}

    def reach(table: dict[int, tuple[int, int]], state: int, weight: int, at: int) -> None:
        if state not in table or weight < table[state][0]:
            table[state] = (weight, at)

    for initial, bad, truncated in turns:
        before = dict(best)
        for state in (NOTHING, SYSTEM, ASSISTANT, USER):  # one turn inserted, or two from the first states
            if state in before:
                weight, at = before[state]
                if at < places - 1:
                    reach(before, TURN[state], weight + weigh(INSERT, at), at + 1)
        after: dict[int, tuple[int, int]] = {}
        kept = KEPT.get(initial, {})
        for state, (weight, at) in before.items():
            reach(after, state, weight + weigh(DELETE, at), at + 1)
            if not bad:
                if state in kept:
                    reach(after, kept[state], weight + weigh(KEEP, at, truncated), at + 1)
                reach(after, TURN[state], weight + weigh(REROLE, at, truncated), at + 1)
        best = after
    out = {}
    for state, (weight, at) in best.items():
        digits = weight & ((1 << (DIGIT * places)) - 1)
        out[state] = (weight >> (DIGIT * places), "".join(LETTERS[(digits >> (DIGIT * (places - 1 - i))) & 7] for i in range(at)))
    return out


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of rows after damage by crc32(`conv_id:turn`) % 20: 0 drops the row, 1 empties its text, 2 removes its `[.!?]`, 3 repeats it, 4 sets role user. A null is one blank, in role and text as in the code; conv_id and turn stay null."""
    c = {x: F.col(x).cast("string") for x in ("conv_id", "turn", "role", "text")}
    c = {x: F.coalesce(v, F.lit(" ")) for x, v in c.items()}
    code = F.crc32(F.concat(c["conv_id"], F.lit(":"), c["turn"])) % 20
    text = F.when(code == 1, "").when(code == 2, F.translate(c["text"], ".!?", "")).otherwise(c["text"])
    times = F.when(code == 0, 0).when(code == 3, 2).otherwise(1)
    done = rows.select("conv_id", "turn", F.when(code == 4, "user").otherwise(c["role"]).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(1), times)).alias("__copy"))
    return done.drop("__copy")


def _ordered(rows: DataFrame) -> DataFrame:
    """rows by conversation and turn (nulls first), then role and text; pos counts over all. Turns of one conversation are dealt over many tasks."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    own = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role"), blank("text"), F.monotonically_increasing_id().alias("row"))
    return placed(own, [F.col(c) for c in ("conv_id", "turn", "role", "text", "row")], "turns")


def _runs(ordered: DataFrame) -> DataFrame:
    """conv_id, seg, lo, edge, counts of faults, first and last initial and least paths of every run of turns of one conversation in a segment of pos."""
    body = F.rtrim(F.col("text"), F.lit(BLANKS))
    key = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    facts = ordered.select("conv_id", "pos", F.substring("role", 1, 1).alias("initial"), (body == "").alias("blank"), (~F.substring(body, -1, 1).isin(".", "!", "?")).alias("open"), F.lit(False).alias("first"))
    # The first turn of each role and text; all others repeat one. Tasks add up their own before, whatever repeats.
    firsts = ordered.groupBy("conv_id", key.alias("k")).agg(F.min("pos").alias("pos"))
    firsts = firsts.select("conv_id", "pos", F.lit("").alias("initial"), F.lit(False).alias("blank"), F.lit(False).alias("open"), F.lit(True).alias("first"))
    both = facts.union(firsts).withColumn("seg", F.floor(F.col("pos") / SEGMENT))
    parts = max(1, int(ordered.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kind = ordered.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            out: list[tuple] = []
            for row in zip(*(b.column(c).to_pylist() for c in ("seg", "conv_id", "pos", "initial", "blank", "open", "first")), strict=True):
                if held and held[-1][0] != row[0]:
                    out += _of_segment(held)
                    held = []
                held.append(row)
            yield _table(out, b.schema.field("conv_id").type)
        if held:
            yield _table(_of_segment(held), b.schema.field("conv_id").type)

    dealt = both.repartition(parts, "seg").sortWithinPartitions("pos", F.desc("first"))
    return dealt.mapInArrow(run, f"conv_id {kind}, seg long, lo long, edge boolean, blank long, duplicate long, truncated long, illegal long, initials string, paths array<struct<x:int,y:int,cost:long,audit:string>>")


def _table(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    path = pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    long, kinds = pa.int64(), None
    kinds = {"conv_id": kind, "seg": long, "lo": long, "edge": pa.bool_(), "blank": long, "duplicate": long, "truncated": long, "illegal": long, "initials": pa.string(), "paths": path}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], list(kinds))


def _of_segment(rows: list[tuple]) -> list[tuple]:
    """One row for each conversation of a segment; its first and last may go on in other segments and get the paths from every state."""
    runs: list[list] = []
    marked = None
    for _, conv, pos, initial, blank, open_, first in rows:
        if first:
            marked = pos
            continue
        if not runs or runs[-1][0] != conv:
            runs.append([conv, pos, []])
        runs[-1][2].append((initial, blank, not blank and marked != pos, open_))
    out = []
    for i, (conv, lo, turns) in enumerate(runs):
        edge = i in (0, len(runs) - 1)
        simple = [(initial, blank or again, open_) for initial, blank, again, open_ in turns]
        paths = [{"x": x, "y": y, "cost": cost, "audit": audit} for x in (STATES if edge else (NOTHING,)) for y, (cost, audit) in least_paths(simple, x).items()]
        initials = [t[0] for t in turns]
        faults = [sum(t[1] for t in turns), sum(t[2] for t in turns), sum(t[3] and not t[1] and not t[2] for t in turns)]
        out.append((conv, rows[0][0], lo, edge, *faults, _illegal(initials), "\n".join((initials[0], initials[-1])), paths))
    return out


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def _compose(t: pa.Table) -> pa.Table:
    """One row of the rows of neighbouring parts of one conversation."""
    rows = sorted(t.to_pylist(), key=lambda r: r["lo"])
    done = rows[0]
    for r in rows[1:]:
        best: dict[tuple[int, int], tuple[int, str]] = {}
        for p in done["paths"]:
            for q in r["paths"]:
                if p["y"] == q["x"]:
                    # Of equal cost no audit begins another: both hold a letter for every turn, and no letter follows the last turn.
                    new = (p["cost"] + q["cost"], p["audit"] + q["audit"])
                    if (p["x"], q["y"]) not in best or new < best[p["x"], q["y"]]:
                        best[p["x"], q["y"]] = new
        (first, last), (begin, end) = done["initials"].split("\n"), r["initials"].split("\n")
        done = done | {k: done[k] + r[k] for k in ("blank", "duplicate", "truncated")} | {"illegal": done["illegal"] + r["illegal"] + _illegal([last, begin]), "initials": f"{first}\n{end}"}
        done["paths"] = [{"x": x, "y": y, "cost": cost, "audit": audit} for (x, y), (cost, audit) in best.items()]
    return pa.Table.from_pylist([done], schema=t.schema)


def plans(ordered: DataFrame) -> DataFrame:
    """conv_id, lo (pos of the first turn), blank, duplicate, truncated, illegal, cost, audit of every conversation of ordered turns."""
    runs = materialise(_runs(ordered), "runs")
    whole, parts = runs.where("not edge"), runs.where("edge")
    while (parts.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0) > 1:
        parts = parts.withColumn("seg", F.floor(F.col("seg") / COMPOSED))
        parts = materialise(parts.groupBy("conv_id", "seg").applyInArrow(_compose, parts.schema), "composed")
    ends = lambda p, i: F.element_at(F.array(*[F.lit(END[s][i]) for s in STATES]), p["y"] + 1)
    closed = F.array_min(F.transform(F.filter("paths", lambda p: p["x"] == NOTHING), lambda p: F.struct((p["cost"] + ends(p, 0)).alias("cost"), F.concat(p["audit"], ends(p, 1)).alias("audit"))))
    return whole.unionByName(parts).withColumn("best", closed).select("conv_id", "lo", "blank", "duplicate", "truncated", "illegal", "best.cost", "best.audit")


def edits(planned: DataFrame) -> DataFrame:
    """conv_id, pos, nth, letter, role for every turn that plans keep, relabel or insert; role is null where it stays. Inserted turns stand before the turn at pos."""
    kind = planned.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for conv, pos, audit in zip(*(b.column(c).to_pylist() for c in ("conv_id", "lo", "audit")), strict=True):
                # Turns alternate from the user on, behind a system turn where their number is odd.
                done, nth = -((len(audit) - audit.count("D")) % 2), 0
                for letter in audit:
                    if letter != "D":
                        rows.append((conv, pos, nth if letter == "I" else 2, letter, None if letter == "K" else ("user", "assistant")[done % 2]))
                        done += 1
                    pos, nth = (pos, nth + 1) if letter == "I" else (pos + 1, 0)
                if len(rows) >= 50_000:
                    yield made(rows, b)
                    rows = []
            yield made(rows, b)

    def made(rows: list[tuple], b: pa.RecordBatch) -> pa.RecordBatch:
        kinds = {"conv_id": b.schema.field("conv_id").type, "pos": pa.int64(), "nth": pa.int32(), "letter": pa.string(), "role": pa.string()}
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], list(kinds))

    return planned.select("conv_id", "lo", "audit").mapInArrow(run, f"conv_id {kind}, pos long, nth int, letter string, role string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plans, repaired): of rows (conv_id, turn, role, text) the plan of every conversation (conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit) and its repaired turns (conv_id, pos, nth, role, text; in the order of pos and nth).

    Turns stand by turn, nulls first, and where they tie by role and text. A turn is blank if its text has nothing but ASCII blanks, else
    a duplicate if an earlier one has its role and text, else truncated if its last character that is no blank is none of `.!?`. Blank
    and duplicate turns are deleted (3); others are kept, relabelled user or assistant (2) or deleted (3), a truncated one that stays
    costs 1 more; empty turns are inserted (2). Afterwards the initials of the roles are nothing, or user and assistant in turn, behind
    a system turn or not. A null role or text is one blank, an empty role fits no place, a null conv_id is a conversation of its own
    like any other; rows that repeat are duplicates. gaps ignores null turns and is 0 if all are null. An empty table gives no rows;
    other columns play no part. However long a conversation is, its turns are ordered and searched in segments over many tasks.
    """
    ordered = _ordered(rows)
    planned = materialise(plans(ordered), "plans")
    changed = materialise(edits(planned), "edits")
    kept = changed.where("letter <> 'I'").select("pos", "nth", F.col("role").alias("new"))
    repaired = ordered.join(kept, "pos").select("conv_id", "pos", "nth", F.coalesce("new", "role").alias("role"), "text")
    repaired = repaired.union(changed.where("letter = 'I'").select("conv_id", "pos", "nth", "role", F.lit("").alias("text")))
    wide = lambda x: x.cast("decimal(20,0)")
    missing = F.least(wide(F.max("turn")) - wide(F.min("turn")) + 1 - F.count_distinct("turn"), wide(F.lit(2**63 - 1))).cast("long")
    gaps = ordered.groupBy("conv_id").agg(F.when(F.max("turn").isNotNull(), missing).alias("gaps"))
    # Both have one row for each conversation.
    both = planned.drop("lo").withColumn("gaps", F.lit(None).cast("long")).unionByName(gaps, allowMissingColumns=True)
    return both.groupBy("conv_id").agg(F.coalesce(F.max("gaps"), F.lit(0).cast("long")).alias("gaps"), *[F.max(c).alias(c) for c in planned.columns[2:]]), repaired


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id, sha256 over the `role:text` of a conversation's repaired turns, newline-joined. Turns stream through the task of their conversation in order; none holds more than one."""
    kind = repaired.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv = state = None
        for b in batches:
            names, shas = [], []
            for c, role, text in zip(*(b.column(x).to_pylist() for x in ("conv_id", "role", "text")), strict=True):
                if state is not None and c == conv:
                    state.update(b"\n")
                else:
                    if state is not None:
                        names.append(conv)
                        shas.append(state.hexdigest())
                    conv, state = c, hashlib.sha256()
                state.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array(names, b.schema.field("conv_id").type), pa.array(shas, pa.string())], ["conv_id", "sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], b.schema.field("conv_id").type), pa.array([state.hexdigest()], pa.string())], ["conv_id", "sha256"])

    parts = max(1, int(repaired.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return repaired.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "pos", "nth").mapInArrow(run, f"conv_id {kind}, sha256 string")


def op13_conversation_repair(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations")
    planned, repaired = repair(damage(rows))
    shas = digests(repaired)
    # Conversations of which no row is left have a row in neither; one task's sums for each conversation meet here.
    all_ = rows.select("conv_id").unionByName(planned, allowMissingColumns=True).unionByName(shas, allowMissingColumns=True)
    numbers = [F.coalesce(F.max(c), F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return all_.groupBy("conv_id").agg(*numbers, F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("sha256"), F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


#: CRC32 bit by bit; then turn by turn the least (cost, audit, lines) of every state, of all conversations at once.
OP13_SQL = r"""
WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
crc AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(k) + 1), lambda i: ascii(substr(k, i, 1))::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda y, i: xor(y >> 1, CASE WHEN y & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))), 4294967295::BIGINT) % 20 AS c FROM src),
dam AS (SELECT conv_id, turn, CASE WHEN c = 4 THEN 'user' ELSE role END AS role, CASE c WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(range(CASE c WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM crc),
o AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
  regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body FROM dam),
f AS MATERIALIZED (SELECT conv_id, turn, role, text, i, left(role, 1) AS g, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
  CASE WHEN body = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE 'f' END AS fault FROM o),
r AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, {'c': 0::BIGINT, 'e': '', 'l': []::VARCHAR[]} AS n, NULL::STRUCT(c BIGINT, e VARCHAR, l VARCHAR[]) AS s, NULL::STRUCT(c BIGINT, e VARCHAR, l VARCHAR[]) AS u, NULL::STRUCT(c BIGINT, e VARCHAR, l VARCHAR[]) AS a FROM src
  UNION ALL
  SELECT conv_id, i,
    {'c': n.c + 3, 'e': n.e || 'D', 'l': n.l},
    list_min(list_filter([CASE WHEN s IS NOT NULL THEN {'c': s.c + 3, 'e': s.e || 'D', 'l': s.l} END, CASE WHEN ok AND g = 's' THEN {'c': n.c + t, 'e': n.e || 'K', 'l': list_append(n.l, role || ':' || text)} END], lambda x: x IS NOT NULL)),
    list_min(list_filter([CASE WHEN u IS NOT NULL THEN {'c': u.c + 3, 'e': u.e || 'D', 'l': u.l} END,
      CASE WHEN ok AND g = 'u' THEN {'c': f.c + t, 'e': f.e || 'K', 'l': list_append(f.l, role || ':' || text)} END,
      CASE WHEN ok THEN {'c': f.c + t + 2, 'e': f.e || 'R', 'l': list_append(f.l, 'user:' || text)} END], lambda x: x IS NOT NULL)),
    list_min(list_filter([CASE WHEN a IS NOT NULL THEN {'c': a.c + 3, 'e': a.e || 'D', 'l': a.l} END,
      CASE WHEN ok AND g = 'a' THEN {'c': u.c + t, 'e': u.e || 'K', 'l': list_append(u.l, role || ':' || text)} END,
      CASE WHEN ok THEN {'c': u.c + t + 2, 'e': u.e || 'R', 'l': list_append(u.l, 'assistant:' || text)} END], lambda x: x IS NOT NULL))
  FROM (SELECT *, list_min(list_filter([n, s, a], lambda x: x IS NOT NULL)) AS f FROM (
    SELECT *, list_min(list_filter([a0, {'c': u.c + 2, 'e': u.e || 'I', 'l': list_append(u.l, 'assistant:')}], lambda x: x IS NOT NULL)) AS a FROM (
      SELECT f.conv_id, f.i, f.role, f.text, f.g, f.fault NOT IN ('b', 'd') AS ok, (f.fault = 't')::BIGINT AS t, r.n, r.s, r.a AS a0,
        list_min(list_filter([r.u, {'c': r.n.c + 2, 'e': r.n.e || 'I', 'l': list_append(r.n.l, 'user:')}, CASE WHEN r.s IS NOT NULL THEN {'c': r.s.c + 2, 'e': r.s.e || 'I', 'l': list_append(r.s.l, 'user:')} END,
          CASE WHEN r.a IS NOT NULL THEN {'c': r.a.c + 2, 'e': r.a.e || 'I', 'l': list_append(r.a.l, 'user:')} END], lambda x: x IS NOT NULL)) AS u
      FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.i = r.i + 1)))),
last AS (SELECT conv_id, max(i) AS i FROM r GROUP BY conv_id),
best AS (SELECT r.conv_id, list_min(list_filter([n, a, CASE WHEN u IS NOT NULL THEN {'c': u.c + 2, 'e': u.e || 'I', 'l': list_append(u.l, 'assistant:')} END,
  CASE WHEN s IS NOT NULL THEN {'c': s.c + 4, 'e': s.e || 'II', 'l': list_append(list_append(s.l, 'user:'), 'assistant:')} END], lambda x: x IS NOT NULL)) AS b
  FROM r JOIN last ON r.conv_id IS NOT DISTINCT FROM last.conv_id AND r.i = last.i),
st AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || g NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT best.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  b.c AS cost, b.e AS audit, sha256(coalesce(array_to_string(b.l, chr(10)), '')) AS repaired_sha256 FROM best LEFT JOIN st ON best.conv_id IS NOT DISTINCT FROM st.conv_id
"""
