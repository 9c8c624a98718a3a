"""Conversations repaired by the cheapest edits, found by Dijkstra's algorithm on an implicit lattice.

A node of the lattice is (turn index, grammar state); its key is (cost, audit), so that of equal costs the
least audit is popped first, and the first accepting end node that is popped ends the search. Conversations
are cut out of rows sorted by range, so a large one is spread over tasks: its chunks hand on one code per
row, the search goes through these chunk by chunk with the open states of a chunk as the sources of the
next, and what it decided is joined back to the texts.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import STEP, batched, stored

#: Costs of the edits, of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Roles that may be inserted or given, by initial; the white space that makes a row blank; what ends a text.
ROLES = {"u": "user", "a": "assistant"}
WHITE, ENDS = " \t\n\x0b\x0c\r", ".!?"
#: States of the grammar (s?(ua)+)?: nothing yet, after s, after u, after a. From each, what an initial leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
NEEDED = "uuau"
#: What it takes at most to go on from one state as from another: a state that costs more than that above it is never of use.
INSTEAD = {(ASSISTANT, START): DELETE, (USER, START): INSERT + DELETE, (ASSISTANT, SYSTEM): 0, (USER, SYSTEM): INSERT, (USER, ASSISTANT): INSERT, (ASSISTANT, USER): INSERT}
#: Faults of a row, the first that holds counts.
NONE, BLANK, DUPLICATE, CUT = range(4)
#: Rows of a chunk; it also ends with the row that fills STEP characters.
CHUNK = 512
#: Pairs of initials that may follow each other.
LEGAL = {"su", "ua", "au"}


def code(role, fault):
    """One byte for all that the search needs to know of a row."""
    return 65 + 4 * ("sua".find(role[:1]) if role else -1) + fault + 4


def decoded(c):
    return "?sua"[(c - 65) // 4], (c - 65) % 4


class Lattice:
    """The search through the rows of one conversation, given by their codes, chunk by chunk."""

    def __init__(self):
        self.cost, self.sources, self.settled = 0, {START: (0, "")}, []

    def walk(self, codes, to_end=False):
        """Keys of the states behind these rows, or of the first accepting one if the rows are the last."""
        heap = [(cost, audit, 0, state) for state, (cost, audit) in self.sources.items()]
        heapq.heapify(heap)
        done, ends, n = set(), {}, len(codes)
        while heap:
            cost, audit, i, state = heapq.heappop(heap)
            if (i, state) in done:
                continue
            done.add((i, state))
            if i == n:
                if to_end and state in (START, ASSISTANT):
                    return cost, audit
                ends[state] = cost, audit
            else:
                initial, fault = decoded(codes[i])
                heapq.heappush(heap, (cost + DELETE, audit + "D", i + 1, state))
                if fault in (NONE, CUT):
                    extra = TRUNCATED if fault == CUT else 0
                    if initial in AFTER[state]:
                        heapq.heappush(heap, (cost + extra, audit + "K", i + 1, AFTER[state][initial]))
                    if initial != NEEDED[state]:
                        heapq.heappush(heap, (cost + REROLE + extra, audit + "R", i + 1, AFTER[state][NEEDED[state]]))
            heapq.heappush(heap, (cost + INSERT, audit + "I", i, AFTER[state][NEEDED[state]]))
        return ends

    def read(self, codes):
        """Go on by a chunk; what all open paths share is settled and no longer carried along."""
        ends = self.walk(codes)
        cheap = {s: c for s, (c, _) in ends.items()}
        ends = {s: e for s, e in ends.items() if not any((t, s) in INSTEAD and cheap[t] + INSTEAD[t, s] < e[0] for t in cheap)}
        shared = os.path.commonprefix([a for _, a in ends.values()])
        self.settled.append(shared)
        self.sources = {s: (c, a[len(shared) :]) for s, (c, a) in ends.items()}

    def finish(self, codes=b""):
        """(cost, audit) of the whole conversation, these rows being its last."""
        cost, audit = self.walk(codes, to_end=True)
        return cost, "".join([*self.settled, audit])


def edited(roles, texts, audit, state=START):
    """([(role, text, edit)] of what the audit makes of the rows, the state behind them)."""
    rows, out = iter(zip(roles, texts)), []
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit != "D":
            initial = role[:1] if edit == "K" else NEEDED[state]
            out.append((role if edit == "K" else ROLES[initial], text, edit))
            state = AFTER[state][initial]
    return out, state


class Report:
    """Counts over the rows of a conversation in order, chunk by chunk."""

    def __init__(self):
        self.faults, self.illegal, self.last = [0] * 4, 0, None
        self.low = self.high = None
        self.turns = 0

    def read(self, codes, low, high, turns):
        for c in codes:
            initial, fault = decoded(c)
            self.faults[fault] += 1
            self.illegal += self.last is not None and self.last + initial not in LEGAL
            self.last = initial
        if low is not None:
            self.turns += turns - (self.high is not None and low == self.high)
            self.low, self.high = low if self.low is None else self.low, high

    def values(self):
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[CUT], self.illegal


REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def fault_of(text, seen):
    kept = text.rstrip(WHITE)
    return BLANK if not kept else DUPLICATE if seen else NONE if kept[-1] in ENDS else CUT


def content(role, text):
    """128 bits of a row's role and text, as `again` takes them in Spark."""
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()


def again(rows):
    """(conv, known, turn, mark): contents that the conversation has at an earlier turn already."""
    mark = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")))
    at = F.struct("known", "turn")
    light = rows.select("conv", mark.alias("mark"), at.alias("at")).distinct()
    first = light.groupBy("conv", "mark").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first < last")
    first = first.select(F.col("conv").alias("c"), F.col("mark").alias("m"), "first")
    later = light.join(first, F.col("conv").eqNullSafe(F.col("c")) & (F.col("mark") == F.col("m")) & (F.col("at") > F.col("first")))
    return later.select("conv", "at.known", "at.turn", "mark")


class Conversation:
    """The rows of a conversation that a task holds: a chunk at most."""

    def __init__(self, conv, whole):
        self.conv, self.whole = conv, whole
        self.prior, self.turn = None, None
        self.clear()

    def clear(self):
        self.codes, self.roles, self.texts, self.size, self.turns = bytearray(), [], [], 0, []

    def add(self, turn, role, text, marked):
        same = self.prior == (turn, role, text)
        self.prior = turn, role, text
        self.codes.append(code(role, fault_of(text, same or marked)))
        self.roles.append(role)
        self.texts.append(text)
        self.size += len(text)
        if turn is not None and turn != (self.turns[-1] if self.turns else None):
            self.turns.append(turn)

    def span(self):
        return (self.turns[0], self.turns[-1], len(self.turns)) if self.turns else (None, None, 0)


def joined(rows):
    return "\n".join(f"{role}:{text}" for role, text, _ in rows)


def repair(turns, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text", gone=None, keep="digest", chunk=CHUNK):
    """One row per conversation: its id, gaps, blank, duplicate, truncated, illegal, cost, audit, and with
    keep="digest" the SHA-256 of its repaired turns (`role:text`, joined by newlines) as repaired_sha256.
    keep="turns": one row per repaired turn instead: id, place (increasing, with gaps), role, text, edit (K, R or I).

    A null role or text is one space; rows come by turn, null first, those of one turn by role and text. A
    null id is an id. Repeated rows are duplicates. gone: a column that is true for rows that only name
    their conversation; one that has no others has zeros, an empty audit, the digest of nothing and no turns. An
    empty table gives an empty result; other columns aren't read. Rows are sorted by ranges of id and turn,
    so tasks share the rows of a large conversation; only rows of one id and turn stay together. A task holds
    a chunk of `chunk` rows and one batch; of a conversation that spans chunks, one task holds a byte per row and
    the audit, and its texts stream through one task in order, as their digest demands. Texts are read whole.
    """
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    off = F.lit(False) if gone is None else F.coalesce(F.col(gone), F.lit(False))
    rows = batched(turns).select(F.col(conv_col).alias("conv"), F.col(turn_col).isNotNull().alias("known"), F.col(turn_col).alias("turn"), F.when(off, 1).otherwise(2).alias("kind"), F.when(~off, space(role_col)).alias("role"), F.when(~off, space(text_col)).alias("text"))
    kind = rows.schema["conv"].dataType.simpleString()
    turn_kind = rows.schema["turn"].dataType.simpleString()
    marks = again(rows.where("kind = 2")).withColumn("kind", F.lit(0))
    every = rows.unionByName(marks, allowMissingColumns=True).repartitionByRange("conv", "known", "turn").sortWithinPartitions("conv", "known", "turn", "kind", "role", "text")
    report = ", ".join(f"{c} long" for c in REPORT) + ", audit string, repaired_sha256 string"
    rows_kind = "array<struct<role: string, text: string, edit: string>>"
    schema = f"conv {kind}, part int, seq int, {report}, turns {rows_kind}, codes binary, low {turn_kind}, high {turn_kind}, n_turns int, roles array<string>, texts array<string>"
    found = stored(every.mapInArrow(cutter(arrow(schema), keep, chunk), schema))
    whole, open_ = found.where("codes IS NULL"), found.where("codes IS NOT NULL")
    told = f"conv {kind}, part int, seq int, slice string, state int, report struct<{', '.join(f'{c}: long' for c in REPORT)}, audit: string>"
    codes = open_.select("conv", "part", "seq", "codes", "low", "high", "n_turns").repartition("conv").sortWithinPartitions("conv", "part", "seq")
    slices = stored(codes.mapInArrow(decider(arrow(told)), told))
    texts = open_.select("conv", "part", "seq", "roles", "texts").join(slices.drop("conv"), ["part", "seq"])
    if keep == "turns":
        fields = f"conv {kind}, part int, seq int, turns {rows_kind}"
        rest = texts.mapInArrow(editor(arrow(fields)), fields)
        rows = whole.select("conv", "part", "seq", "turns").unionByName(rest).select("conv", "part", "seq", F.posexplode("turns").alias("at", "t"))
        place = (F.shiftleft(F.col("part").cast("long"), 40) + F.shiftleft(F.col("seq").cast("long"), 16) + F.col("at")).alias("place")
        return rows.select(F.col("conv").alias(conv_col), place, "t.role", "t.text", "t.edit")
    fields = f"conv {kind}, {report}"
    rest = texts.select("conv", "part", "seq", "roles", "texts", "slice", "state", "report").repartition("conv").sortWithinPartitions("conv", "part", "seq").mapInArrow(hasher(arrow(fields)), fields)
    return whole.select(rest.columns).unionByName(rest).withColumnRenamed("conv", conv_col)


def arrow(schema):
    """The Arrow schema of a DDL string, made on the driver."""
    return to_arrow_schema(StructType.fromDDL(schema))


def batch_of(rows, schema):
    """Rows (dicts) as an Arrow batch; what a row lacks is null."""
    return pa.RecordBatch.from_pylist(rows, schema)


def cutter(schema, keep, most):
    """A function of batches of sorted rows: conversations that lie in the partition whole and in one
    chunk are repaired; of others, chunks with their codes. The first and the last of a partition may go on elsewhere."""

    def run(batches):
        part, seq, now, out, marks, at = TaskContext.get().partitionId(), 0, None, [], set(), None

        def chunk():
            nonlocal seq
            low, high, n = now.span()
            out.append({"conv": now.conv, "part": part, "seq": seq, "codes": bytes(now.codes), "low": low, "high": high, "n_turns": n, "roles": now.roles, "texts": now.texts})
            seq, now.whole = seq + 1, False
            now.clear()

        def close(last=False):
            if last or not now.whole:
                chunk()
                return
            tally, search = Report(), Lattice()
            tally.read(now.codes, *now.span())
            cost, audit = search.finish(now.codes)
            rows, _ = edited(now.roles, now.texts, audit)
            row = {"conv": now.conv, "part": part, "seq": 0, **dict(zip(REPORT, (*tally.values(), cost))), "audit": audit}
            if keep == "turns":
                row["turns"] = [dict(zip(("role", "text", "edit"), r)) for r in rows]
            else:
                row["repaired_sha256"] = hashlib.sha256(joined(rows).encode()).hexdigest()
            out.append(row)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv", "turn", "kind", "role", "text", "mark")]
            for conv, turn, kind, role, text, mark in zip(*columns):
                if now is None or conv != now.conv:
                    if now is not None:
                        close()
                    now, at = Conversation(conv, now is not None), None
                if at is None or at != (turn,):
                    at, marks = (turn,), set()
                if kind == 0:
                    marks.add(mark)
                elif kind == 2:
                    now.add(turn, role, text, bool(marks) and content(role, text) in marks)
                    if len(now.codes) >= most or now.size >= STEP:
                        chunk()
                if len(out) >= most:
                    yield batch_of(out, schema)
                    out.clear()
            yield batch_of(out, schema)
            out.clear()
        if now is not None:
            close(last=True)
            yield batch_of(out, schema)

    return run


def decider(schema):
    """A function of batches of chunks in order: the slice of the audit that falls to each chunk, the
    state before it, and beside the last one the report."""

    def run(batches):
        chunks, tally, search, conv, started = [], Report(), Lattice(), None, False

        def told():
            cost, audit = search.finish()
            at, state, rows = 0, START, []
            for k, (part, seq, codes) in enumerate(chunks):
                end = re.compile("(?:I*[DKR]){%d}" % len(codes)).match(audit, at).end() if k < len(chunks) - 1 else len(audit)
                rows.append({"conv": conv, "part": part, "seq": seq, "slice": audit[at:end], "state": state})
                state = behind(codes, audit[at:end], state)
                at = end
            rows[-1]["report"] = {**dict(zip(REPORT, (*tally.values(), cost))), "audit": audit}
            return batch_of(rows, schema)

        for batch in batches:
            for row in batch.to_pylist():
                if started and row["conv"] != conv:
                    yield told()
                    chunks, tally, search = [], Report(), Lattice()
                conv, started = row["conv"], True
                search.read(row["codes"])
                tally.read(row["codes"], row["low"], row["high"], row["n_turns"])
                chunks.append((row["part"], row["seq"], row["codes"]))
        if started:
            yield told()

    return run


def behind(codes, audit, state):
    """The state behind rows that are edited so."""
    rows = iter(codes)
    for edit in audit:
        initial = None if edit == "I" else decoded(next(rows))[0]
        if edit != "D":
            state = AFTER[state][initial if edit == "K" else NEEDED[state]]
    return state


def editor(schema):
    def run(batches):
        for batch in batches:
            rows = [(r, edited(r["roles"], r["texts"], r["slice"], r["state"])[0]) for r in batch.to_pylist()]
            yield batch_of([{"conv": r["conv"], "part": r["part"], "seq": r["seq"], "turns": [dict(zip(("role", "text", "edit"), t)) for t in turns]} for r, turns in rows], schema)

    return run


def hasher(schema):
    """A function of batches of chunks in order: the report of each conversation with the digest of its turns."""

    def run(batches):
        sha, empty = hashlib.sha256(), True
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                rows, _ = edited(row["roles"], row["texts"], row["slice"], row["state"])
                if rows:
                    sha.update((("" if empty else "\n") + joined(rows)).encode())
                    empty = False
                if row["report"] is not None:
                    out.append({"conv": row["conv"], **row["report"], "repaired_sha256": sha.hexdigest()})
                    sha, empty = hashlib.sha256(), True
            yield batch_of(out, schema)

    return run


def damaged(turns):
    """turns (conv_id, turn, role, text; null as one space) with a twentieth each dropped (gone), emptied, left
    without full stops, repeated, and said by the user, as crc32 of id and turn has it. DataFrame functions only."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.pmod(F.crc32(F.concat_ws(":", space("conv_id"), space("turn"))), F.lit(20))
    text = F.when(fate == 1, "").when(fate == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    role = F.when(fate == 4, "user").otherwise(space("role"))
    copies = F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), (fate == 0).alias("gone"), F.explode(copies).alias("copy")).drop("copy")


def oracle():
    """DuckDB SQL with the same rows: the lattice row by row, the least (cost, audit) of each state kept.
    Crc32 has no function there, so it is taken bit by bit over the bytes of id and turn."""
    return r"""
    WITH RECURSIVE bits(n, i, v) AS (SELECT n, 0, n::BIGINT FROM range(256) t(n) UNION ALL SELECT n, i + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM bits WHERE i < 8),
    tab AS MATERIALIZED (SELECT n, v FROM bits WHERE i = 8),
    keys AS (SELECT DISTINCT conv_id, turn, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
    crc(conv_id, turn, k, i, v) AS (SELECT conv_id, turn, k, 1, 4294967295::BIGINT FROM keys
        UNION ALL SELECT conv_id, turn, k, i + 1, xor(crc.v // 256, tab.v) FROM crc JOIN tab ON tab.n = xor(crc.v % 256, ascii(k[i])::BIGINT) WHERE i <= length(k)),
    fates AS (SELECT conv_id, turn, xor(v, 4294967295) % 20 AS fate FROM crc WHERE i = length(k) + 1),
    hurt AS (SELECT c.conv_id, c.turn, CASE WHEN fate = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
                    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text, unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
             FROM conversations c JOIN fates f ON f.conv_id IS NOT DISTINCT FROM c.conv_id AND f.turn IS NOT DISTINCT FROM c.turn),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM hurt),
    judged AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
                    left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair FROM placed),
    told AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM judged GROUP BY 1),
    ins(s, t, added, letters) AS (VALUES (0, 0, []::VARCHAR[], ''), (0, 2, ['user:'], 'I'), (0, 3, ['user:', 'assistant:'], 'II'), (1, 1, [], ''), (1, 2, ['user:'], 'I'), (1, 3, ['user:', 'assistant:'], 'II'),
        (2, 2, [], ''), (2, 3, ['assistant:'], 'I'), (3, 3, [], ''), (3, 2, ['user:'], 'I')),
    step(t, edit, initial, role, nxt) AS (VALUES (0, 'D', NULL, NULL, 0), (1, 'D', NULL, NULL, 1), (2, 'D', NULL, NULL, 2), (3, 'D', NULL, NULL, 3),
        (0, 'K', 's', NULL, 1), (0, 'K', 'u', NULL, 2), (1, 'K', 'u', NULL, 2), (2, 'K', 'a', NULL, 3), (3, 'K', 'u', NULL, 2), (0, 'R', NULL, 'user', 2), (1, 'R', NULL, 'user', 2), (2, 'R', NULL, 'assistant', 3), (3, 'R', NULL, 'user', 2)),
    walk(conv_id, i, s, best) AS (SELECT DISTINCT conv_id, 0::BIGINT, 0, {'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]} FROM conversations
        UNION ALL SELECT w.conv_id, w.i + 1, step.nxt, min({'cost': best.cost + 3 * length(letters) + CASE edit WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN edit <> 'D' AND fault = 'truncated' THEN 3 ELSE 0 END,
            'audit': best.audit || letters || edit, 'lines': list_concat(best.lines, added, CASE edit WHEN 'D' THEN []::VARCHAR[] ELSE [coalesce(step.role, j.role) || ':' || j.text] END)})
        FROM walk w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1 JOIN ins ON ins.s = w.s JOIN step ON step.t = ins.t
        WHERE (edit = 'D' OR fault NOT IN ('blank', 'duplicate')) AND (edit <> 'K' OR initial = left(j.role, 1)) GROUP BY ALL),
    ends AS (SELECT w.conv_id, min({'cost': best.cost + 3 * length(letters), 'audit': best.audit || letters, 'lines': list_concat(best.lines, added)}) AS b
             FROM walk w LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM w.conv_id JOIN ins ON ins.s = w.s WHERE w.i = coalesce(t.n, 0) AND ins.t IN (0, 3) GROUP BY 1)
    SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
           b.cost AS cost, b.audit AS audit, sha256(array_to_string(b.lines, chr(10))) AS repaired_sha256
    FROM ends e LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM e.conv_id
    """
