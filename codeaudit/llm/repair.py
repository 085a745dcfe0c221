r"""Conversation structure repair: the cheapest edits to ``(s?(ua)+)?``, by checkpointed programming.

Messages are (conv_id, turn, role, text), in order of turn (nulls first), then a hash of role and
text. A message is kept (K, free), given the role user or assistant (R, 1), or deleted (D, 2), which
blank messages and ones seen earlier in the conversation must be; a message without text may be
inserted anywhere (I, 5); a truncated message that isn't deleted costs 5 more. The initials of the
roles that are left must be an optional system message, then pairs of user and assistant. Of the
cheapest edits the ASCII-least string is taken.

A state is what was said last (nothing, s, u, a); a state-cost vector holds the cheapest way from each
state to the end. Vectors are computed backwards, but only those at checkpoints are stored, one after
each block of about sqrt(n) messages; then the conversation is walked forward, block by block: a
block's vectors are recomputed from the checkpoint behind it, and of the edits that are tight (edit
plus vector behind it equal the vector before it) the least letter is emitted.

The same works across tasks. Messages without their texts are sorted over the cluster by ranges, so
that a conversation of any length spans as many tasks as it needs; equal messages of one turn are one
row with a number. What lies in one task is a segment. Segments at a task's ends have their 4 x 4
table of costs from state to state computed; these few tables, at most one for each task a
conversation spans, give the vectors behind the segments, the checkpoints between tasks. Each segment
is then walked from all four states at once, and the states that segments end in say which of the
four walks holds. Edits are joined to the texts by key.

Defined cases. A null role or text is one space, a null conversation is one conversation, null turns
come first and make no gaps. A role is known by its first character, s, u or a; others can't be kept.
Equal repeated rows are copies: the first counts, the others are duplicates. A conversation without
messages needs no edits. Texts may have any length, they are never held together. Empty tables give
empty results. Only the four columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from codeaudit.llm.words import crc32_sql
from codeaudit.sources.work import stored

BLANKS = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SAID = "?sua"  # states: nothing, system, user, assistant
NEXT = (2, 2, 3, 2)  # what a user or assistant message may lead to
KEEP = {(1, 0): 1, (2, 0): 2, (2, 1): 2, (2, 3): 2, (3, 2): 3}  # (initial, state): next state
FAR = 1 << 60
KEY = ["conv_id", "turn", "h1", "h2"]
Row = tuple[int, bool, bool, int]  # initial, must go, truncated, copies


def relaxed(v: list[int]) -> list[int]:
    """The vector with insertions in front."""
    u, a = min(v[2], INSERT + v[3]), min(v[3], INSERT + v[2])
    return [min(v[0], INSERT + u), min(v[1], INSERT + u), u, a]


LAST = relaxed([0, FAR, FAR, 0])


def back(v: list[int], row: Row) -> list[int]:
    """The vector before a row, from the one behind it."""
    initial, must, cut, copies = row
    if must:
        return [x + DELETE * copies for x in v]
    more, cut = DELETE * (copies - 1), TRUNCATED * cut
    out = []
    for s in range(4):
        best = min(DELETE + v[s], REROLE + cut + v[NEXT[s]])
        k = KEEP.get((initial, s))
        out.append(more + (best if k is None else min(best, cut + v[k])))
    return relaxed(out)


def step(s: int, row: Row, before: list[int], behind: list[int]) -> tuple[int, str, str]:
    """The least tight edits of a row in state s: the state behind it, edits, initials said."""
    initial, must, cut, copies = row
    if must:
        return s, "D" * copies, ""
    edits = said = ""
    more, cut = DELETE * (copies - 1), TRUNCATED * cut
    while before[s] != DELETE + more + behind[s]:
        if before[s] == INSERT + before[NEXT[s]]:
            s, edits = NEXT[s], edits + "I"
            said += SAID[s]
            continue
        k = KEEP.get((initial, s))
        s, letter = (k, "K") if k is not None and before[s] == cut + more + behind[k] else (NEXT[s], "R")
        return s, edits + letter + "D" * (copies - 1), said + SAID[s]
    return s, edits + "D" * copies, said


def walk(rows: list[Row], behind: list[int], starts: list[int]) -> Iterator[list[tuple[int, str, str]]]:
    """For each row, (state behind it, edits, initials said) by state in front of the first row."""
    width = max(1, isqrt(len(rows)))
    checkpoints, v = [], behind
    for i in range(len(rows) - 1, -1, -1):
        if (i + 1) % width == 0 or i == len(rows) - 1:
            checkpoints.append(v)
        v = back(v, rows[i])
    at = list(starts)
    for first in range(0, len(rows), width):
        block = rows[first:first + width]
        vectors = [checkpoints.pop()]
        for row in reversed(block):
            vectors.append(back(vectors[-1], row))
        for row in block:
            before = vectors.pop()
            told = [step(s, row, before, vectors[-1]) for s in at]
            at = [t[0] for t in told]
            yield told


def table(rows: list[Row]) -> list[int]:
    """Costs of a segment from each state to each state, row by row."""
    ends = []
    for e in range(4):
        v = [0 if s == e else FAR for s in range(4)]
        for row in reversed(rows):
            v = [min(x, FAR) for x in back(v, row)]
        ends.append(v)
    return [ends[e][s] for s in range(4) for e in range(4)]


def _segments(batches: Iterator[pa.RecordBatch], name: str = "conv_id") -> Iterator[tuple[tuple, dict, bool, bool]]:
    """Runs of equal (part, conversation) as lists of columns, each with whether it is its part's first
    and last."""
    held: dict[str, list] = {}
    key, first = None, True
    for b in batches:
        cols = {n: c.to_pylist() for n, c in zip(b.schema.names, b.columns)}
        keys = list(zip(cols["part"], cols[name]))
        start = 0
        for i in range(1, len(keys) + 1):
            if i < len(keys) and keys[i] == keys[start]:
                continue
            if held and keys[start] != key:
                last = keys[start][0] != key[0]
                yield key, held, first, last
                held, first = {}, last
            key = keys[start]
            for n, c in cols.items():
                held.setdefault(n, []).extend(c[start:i])
            start = i
    if held:
        yield key, held, first, True


def _rows(held: dict[str, list]) -> list[Row]:
    return list(zip(held["initial"], held["must"], held["cut"], held["copies"]))


SUMMARY = ("conv_id bigint, part int, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
           "turns bigint, low bigint, high bigint, first int, last int, costs array<bigint>")


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    legal = {(1, 2), (2, 3), (3, 2)}
    for (part, conv), held, first, last in _segments(batches):
        rows, turns = _rows(held), [t for t in held["turn"] if t is not None]
        initials = held["initial"]
        repeats = sum(c - (not m) for _, m, _, c in rows)
        blank = sum(c for c, b in zip(held["copies"], held["blank"]) if b)
        illegal = sum(p not in legal for p in zip(initials, initials[1:])) + sum(held["copies"]) - len(rows)
        yield pa.RecordBatch.from_pylist([{
            "conv_id": conv, "part": part, "blank": blank, "duplicate": repeats - blank,
            "truncated": sum(cut and not m for _, m, cut, _ in rows), "illegal": illegal, "turns": len(set(turns)),
            "low": min(turns, default=None), "high": max(turns, default=None), "first": initials[0],
            "last": initials[-1], "costs": table(rows) if first or last else None}], _schema(SUMMARY))


TOLD = ("conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
        "cost bigint, part int, starts array<int>, behind array<bigint>, ends boolean")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From each conversation's segments (few, sorted): its counts, and the vector behind each."""
    legal = {(1, 2), (2, 3), (3, 2)}
    for b in batches:
        out = []
        for conv, segments in zip(*(c.to_pylist() for c in b.columns)):
            vectors = [LAST]
            for s in reversed(segments[1:]):
                m = s["costs"]
                vectors.append([min(m[4 * x + e] + vectors[-1][e] for e in range(4)) for x in range(4)])
            vectors.reverse()
            sums = {n: sum(s[n] for s in segments) for n in ("blank", "duplicate", "truncated", "illegal", "turns")}
            highest = None
            for a, s in zip([None, *segments], segments):
                if a is not None:
                    sums["illegal"] += (a["last"], s["first"]) not in legal
                    sums["turns"] -= s["low"] is not None and s["low"] == highest
                highest = s["high"] if s["high"] is not None else highest
            low = min((s["low"] for s in segments if s["low"] is not None), default=None)
            turns = sums.pop("turns")
            for i, s in enumerate(segments):
                out.append({"conv_id": conv, "gaps": 0 if low is None else highest - low + 1 - turns, **sums, "part": s["part"],
                            "starts": [0, 1, 2, 3] if i else [0], "behind": vectors[i], "ends": s is segments[-1]})
        yield pa.RecordBatch.from_pylist([{"cost": None, **r} for r in out], _schema(TOLD))


EDITS = (f"{', '.join(f'{k} bigint' for k in KEY)}, place bigint, part int, edits array<string>, said array<string>, "
         "states array<int>, spent array<bigint>")


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (part, conv), held, _, _ in _segments(batches):
        rows, out = _rows(held), []
        starts, ends, behind = held["starts"][0], held["ends"][0], held["behind"][0]
        for i, told in enumerate(walk(rows, behind, starts)):
            states = None
            if i == len(rows) - 1:
                states = [t[0] for t in told]
                if ends:  # what is still missing
                    told = [(3, e + "II"[:3 - s], d + "ua"[s - 1:]) if s in (1, 2) else (s, e, d) for s, e, d in told]
            out.append({**{k: held[k][i] for k in KEY}, "place": held["place"][i], "part": part,
                        "edits": [t[1] for t in told], "said": [t[2] for t in told], "states": states,
                        "spent": [sum(map({"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}.get, t[1]))
                                  + TRUNCATED * (rows[i][2] and not rows[i][1] and ("K" in t[1] or "R" in t[1])) for t in told]})
        yield pa.RecordBatch.from_pylist(out, _schema(EDITS))


def _schema(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
    kinds |= {f"array<{k}>": pa.list_(t) for k, t in kinds.items()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def same(columns: list[str], left: str, right: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out &= F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out


def keyed(messages: DataFrame) -> DataFrame:
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return messages.select("conv_id", "turn", F.xxhash64(role, text).alias("h1"),
                           F.xxhash64(F.lit(13), role, text).alias("h2"), role.alias("role"), text.alias("text"))


def narrow(rows: DataFrame) -> DataFrame:
    """Messages without texts, copies of a turn as one row, sorted by ranges: KEY, initial, blank, must,
    cut, copies, part, place."""
    left = F.rtrim("text", F.lit(BLANKS))
    told = stored(rows.select(
        *KEY, F.greatest(F.instr(F.lit(SAID), F.substring("role", 1, 1)) - 1, F.lit(0)).cast("int").alias("initial"),
        (left == "").alias("blank"), (~F.right(left, F.lit(1)).isin(".", "!", "?")).alias("cut"))
        .groupBy(*KEY, "initial", "blank", "cut").agg(F.count("*").alias("copies")), "narrow")
    turn = F.struct(F.col("turn").isNotNull().alias("t"), "turn")
    first = told.groupBy("conv_id", "h1", "h2").agg(F.min(turn).alias("first"))
    told = told.alias("a").join(first.alias("b"), same(["conv_id", "h1", "h2"], "a", "b")).select(
        "a.*", (F.col("blank") | ~F.col("first.turn").eqNullSafe(F.col("a.turn"))).alias("must"))
    order = ["conv_id", "turn", "h1", "h2"]  # nulls first
    told = stored(told, "told").repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(told.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")), "sorted")


def by_part(rows: DataFrame) -> DataFrame:
    return rows.repartition("part").sortWithinPartitions("part", "place")


def repaired(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edits, one row each: conv_id, place and nth (their order), edit, role, text (of what stays); and
    one row per conversation with messages: conv_id, gaps, blank, duplicate, truncated, illegal, cost."""
    rows = keyed(messages)
    told = narrow(rows)
    segments = by_part(told).mapInArrow(_summaries, SUMMARY)
    own = [c.split()[0] for c in SUMMARY.split(", ")[1:]]
    conversations = stored(segments.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*own))).alias("segments"))
                           .mapInArrow(_joined, TOLD), "conversations")
    vectors = conversations.select("conv_id", "part", "starts", "behind", "ends")
    walked = told.alias("a").join(vectors.alias("b"), same(["conv_id", "part"], "a", "b")).select(
        "a.*", "b.starts", "b.behind", "b.ends")
    edits = stored(by_part(walked).mapInArrow(_edits, EDITS), "walked")
    # of conversations over several tasks: the state each segment begins in
    ends = (edits.filter("states is not null").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("part", "states"))).alias("s")).filter(F.size("s") > 1))
    begin = F.aggregate(
        "s", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<part:int,start:int>>").alias("out")),
        lambda acc, s: F.struct(F.get(s["states"], acc["at"]).alias("at"), F.array_append(
            acc["out"], F.struct(s["part"].alias("part"), acc["at"].alias("start"))).alias("out")))["out"]
    begins = ends.select("conv_id", F.inline(begin))
    edits = stored(edits.alias("a").join(begins.alias("b"), same(["conv_id", "part"], "a", "b"), "left").select(
        *[f"a.{k}" for k in KEY], "place", *[F.get(c, F.coalesce("start", F.lit(0))).alias(c) for c in ("edits", "said", "spent")]),
        "edits")
    costs = edits.groupBy("conv_id").agg(F.sum("spent").alias("cost"))
    counts = conversations.drop("cost", "part", "starts", "behind", "ends").distinct().alias("a").join(
        costs.alias("b"), same(["conv_id"], "a", "b")).select("a.*", "cost")
    # texts meet their edits; copies of a message are deleted, one stays
    stays = edits.filter(F.col("edits").rlike("[KR]"))
    texts = rows.alias("a").join(stays.alias("b"), same(KEY, "a", "b")).select(
        "b.conv_id", "place", F.length(F.regexp_extract("edits", "^I*", 0)).alias("nth"),
        F.regexp_extract("edits", "[KR]D*", 0).alias("edit"), "role", "text", "said")
    spoken = F.substring("said", F.col("nth") + 1, F.lit(1))
    texts = texts.withColumn("role", F.when(F.col("edit").startswith("K"), F.col("role")).when(spoken == "u", "user").otherwise("assistant"))
    alone = ~F.contains("edit", F.lit("D"))
    texts = texts.filter(alone).unionAll(texts.filter(~alone).dropDuplicates(["place"])).drop("said")
    letters = F.regexp_extract_all(F.regexp_replace("edits", "[KR]D*", "K"), F.lit("(D+|I|K)"))
    letter = F.col("edit")
    others = (edits.select("conv_id", "place", "edits", "said", F.posexplode(letters).alias("nth", "edit")).filter(letter != "K")
              .withColumn("role", F.when(letter == "I", F.when(F.substring(
                  "said", F.col("nth") + 1, F.lit(1)) == "u", "user").otherwise("assistant")))
              .select("conv_id", "place", "nth", "edit", "role", F.when(letter == "I", "").alias("text")))
    return texts.unionByName(others), counts


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, edit, role, text) in order; one conversation's hash is open at a time."""
    conv, audit, told = None, None, hashlib.sha256()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"conv_id": conv, "audit": "".join(audit), "repaired_sha256": told.hexdigest()}],
                                          _schema("conv_id bigint, audit string, repaired_sha256 string"))
    said = False
    for b in batches:
        for c, edit, role, text in zip(*(x.to_pylist() for x in b.columns)):
            if audit is None or c != conv:
                if audit is not None:
                    yield out()
                conv, audit, told, said = c, [], hashlib.sha256(), False
            audit.append(edit)
            if role is not None:
                told.update((("\n" if said else "") + role + ":" + text).encode())
                said = True
    if audit is not None:
        yield out()


def digests(edits: DataFrame, counts: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per conversation of ``conversations``: the counts, the edits as a string, and a hash of the
    repaired conversation."""
    hashed = (edits.repartition("conv_id").sortWithinPartitions("conv_id", "place", "nth")
              .select("conv_id", "edit", "role", "text")
              .mapInArrow(_digests, "conv_id bigint, audit string, repaired_sha256 string"))
    told = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return (conversations.select("conv_id").distinct().alias("a")
            .join(counts.alias("b"), same(["conv_id"], "a", "b"), "left")
            .join(hashed.alias("c"), same(["conv_id"], "a", "c"), "left")
            .select("a.conv_id", *[F.coalesce(f"b.{c}", F.lit(0)).cast("bigint").alias(c) for c in told],
                    F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")))


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` with a quarter of the rows dropped, emptied, cut, repeated or given a role."""
    one = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    rows = conversations.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")],
                                (F.crc32(F.concat(one[0], F.lit(":"), one[1]).cast("binary")) % 20).alias("_k"))
    k = F.col("_k")
    rows = rows.filter(k != 0).select(
        "conv_id", "turn", F.when(k == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(k == 1, "").when(k == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"), "_k")
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.when(
        k == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_n")).drop("_n")


def repair_sql() -> str:
    """The digests as SQL, for conversations whose turns are one message each: a forward programme that
    keeps the least string of the cheapest edits for each state."""
    blank = " || ".join(f"chr({ord(c)})" for c in BLANKS)
    keep = ", ".join(f"('K', {i}, {s}, {t}, 0)" for (i, s), t in KEEP.items())
    role = ", ".join(f"('R', {i}, {s}, {t}, {REROLE})" for i in range(4) for s, t in enumerate(NEXT))
    gone = ", ".join(f"('D', {i}, {s}, {s}, {DELETE})" for i in range(4) for s in range(4))
    crc = crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")
    return f"""WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS k FROM conversations),
broken AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, copy,
    CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM keyed, unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS u(copy) WHERE k <> 0),
ordered AS (
  SELECT *, row_number() OVER w AS i, rtrim(text, {blank}) AS bare,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
    lag(left(role, 1)) OVER w || left(role, 1) AS pair,
    greatest(position(left(role, 1) IN 'sua'), 0) AS initial
  FROM broken WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, copy)),
faulty AS (
  SELECT *, bare = '' AS blank, bare <> '' AND again AS duplicate,
    bare <> '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated FROM ordered),
edit(letter, initial, f, t, cost) AS (VALUES {keep}, {role}, {gone}),
insertion(f, t, cost, letters, said) AS (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
  (0, 2, {INSERT}, 'I', chr(10) || 'user:'), (1, 2, {INSERT}, 'I', chr(10) || 'user:'), (3, 2, {INSERT}, 'I', chr(10) || 'user:'),
  (2, 3, {INSERT}, 'I', chr(10) || 'assistant:'),
  (0, 3, {2 * INSERT}, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
  (1, 3, {2 * INSERT}, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
walked AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS state, {{'cost': CAST(0 AS BIGINT), 'audit': '', 'said': ''}} AS best FROM broken
  UNION ALL
  SELECT conv_id, i, state, min(best) FROM (
    SELECT w.conv_id, m.i, e.t AS state, {{'cost': w.best.cost + n.cost + e.cost
        + CASE WHEN m.truncated AND e.letter <> 'D' THEN {TRUNCATED} ELSE 0 END,
      'audit': w.best.audit || n.letters || e.letter,
      'said': w.best.said || n.said || CASE e.letter WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || m.role || ':' || m.text
        ELSE chr(10) || CASE e.t WHEN 2 THEN 'user:' ELSE 'assistant:' END || m.text END}} AS best
    FROM walked w JOIN faulty m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i + 1
      JOIN insertion n ON n.f = w.state
      JOIN edit e ON e.f = n.t AND e.initial = m.initial AND (e.letter = 'D' OR NOT (m.blank OR m.duplicate)))
  GROUP BY conv_id, i, state),
size AS (SELECT conv_id, max(i) AS n FROM ordered GROUP BY conv_id),
ended AS (
  SELECT w.conv_id, min({{'cost': w.best.cost + n.cost, 'audit': w.best.audit || n.letters, 'said': w.best.said || n.said}}) AS best
  FROM walked w JOIN size s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.n = w.i
    JOIN insertion n ON n.f = w.state WHERE n.t IN (0, 3) GROUP BY w.conv_id),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost,
  coalesce(best.audit, '') AS audit, sha256(coalesce(substr(best.said, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
  LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
  LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM a.conv_id"""
