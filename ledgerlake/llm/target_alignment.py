"""Conversation repair by Wagner-Fischer alignment to an alternating target.

A conversation's role initials shall read ``(s?(ua)+)?``.  Turns can be kept (0), given the
role user or assistant (2) or deleted (3), and empty turns of these roles inserted (2); blank and
duplicate turns must be deleted, a truncated one that stays costs 1 more.  The cheapest
edits win, of several the ones whose initials in order (the audit) are ASCII-least.

Targets are known by their length alone, and all that end alike are suffixes of one string.  So
one table over (turns left, symbols left) holds the alignment costs of all feasible
lengths.  An incumbent (re-role what differs) bounds it to Ukkonen's band: i insertions or
deletions beyond the forced ones cost 2 i or 3 i.  For each length that attains the least
cost the edits are traced from the front, taking the ASCII-least edit that stays cheapest, and the
audits are compared.

A conversation is aligned in pieces of ``PIECE`` turns, each from every state of the
grammar (nothing yet, s, u, a) to every other, as a matrix of costs; matrices compose by (min, +),
and costs to go at a piece's end decide its audit.  Insertions stand before a turn of their
piece (or behind the last turn), so no audit of a piece is the beginning of another one.

Rows are range-partitioned by (conversation, turn), not by conversation, so that one
of very many turns is cut over many tasks.  Conversations that lie inside a partition are
done there.  The first and last of each partition, and those of over ``INSIDE`` turns, leave runs:
a byte a turn with the run's matrix, and their turns by pieces.  Runs of a conversation (one a
partition at most) meet as matrices, then as transitions, and then each run knows its audit.
Only the digest and the audit of the report are one value a conversation: its digest is streamed
piece by piece by one task, as checksums of one text can't be joined.

Defined cases: null roles and texts are one blank; null turns come first; null keys are one
conversation.  Turns with the same number are ordered by role, then by a checksum of
role and text; of equal rows one is first and the others are duplicates.  ``gone`` rows
only make their conversation appear.  Very long texts and conversations are taken whole.  An
empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import rewritten

#: Turns of a piece, and of a conversation that one task does by itself.
PIECE, INSIDE = 32, 4096
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
_INF = 1 << 40
#: A turn's code: its initial (u, a, s, another) + 4 * fault (none, truncated, must go).
_INITIALS = "uas"
_SYMBOL = {USER: 0, ASSISTANT: 1}
_ROLES = ("user", "assistant")
#: From each state: the symbol that must follow, and what closing the conversation there costs.
_NEXT = (0, 0, 1, 0)
CLOSING = (0, 2 * INSERT, INSERT, 0)


def _incumbent(codes: bytes, symbol: int) -> int:
    """The cost of deleting what must go and re-roling what differs from the alternation begun with ``symbol``."""
    total = 0
    for c in codes:
        if c >= 8:
            total += DELETE
        else:
            total += (c >> 2) * TRUNCATED + (KEEP if c & 3 == symbol else REROLE)
            symbol = 1 - symbol
    return total


class Piece:
    """Alignment tables of some turns for each state at the end."""

    def __init__(self, codes: bytes, entries: tuple[int, ...] = (BEGIN, SYSTEM, USER, ASSISTANT)):
        self.codes = codes
        n = len(codes)
        free = [0] * (n + 1)
        for i in range(n - 1, -1, -1):
            free[i] = free[i + 1] + (codes[i] < 8)
        u, a = _incumbent(codes, 0), _incumbent(codes, 1)
        worst = min(u, a + INSERT) if entries == (BEGIN,) else max(min(u, a + INSERT), min(a, u + INSERT))
        # The end may be another state than the incumbent's: one more insertion before the last turn, which is re-roled.
        slack = worst + INSERT + REROLE - DELETE * (n - free[0])
        self.up, self.down = slack // INSERT, slack // DELETE
        self.free = free
        self.left = {f: self._table(_SYMBOL[f]) for f in (USER, ASSISTANT)}
        deleted = [(0, [DELETE * (n - i)]) for i in range(n + 1)]
        self.left |= {BEGIN: deleted, SYSTEM: deleted}
        has_system = any(c & 3 == 2 and c < 8 for c in codes)
        self.headed = {f: self._headed(self.left[f]) for f in (SYSTEM, USER, ASSISTANT)} if has_system else {}

    def _table(self, symbol: int) -> list[tuple[int, list[int]]]:
        """By turn i: the least r of the band, and the costs of aligning turns i.. to the target's last r symbols (the
        last of all is ``symbol``), from that r on."""
        codes, free = self.codes, self.free
        rows: list[tuple[int, list[int]]] = [(0, [0])] * (len(codes) + 1)
        for i in range(len(codes) - 1, -1, -1):
            low, fault, kind = max(0, free[i] - self.down), codes[i] >> 2, codes[i] & 3
            at, below = rows[i + 1]
            cells, before = [], _INF
            for r in range(low, free[i] + self.up + 1):
                k = r - at
                best = below[k] + DELETE if 0 <= k < len(below) else _INF
                if r:
                    if fault < 2 and 0 < k <= len(below):
                        cost = below[k - 1] + fault * TRUNCATED + (KEEP if kind == (symbol if r & 1 else 1 - symbol) else REROLE)
                        if cost < best:
                            best = cost
                    if before + INSERT < best:
                        best = before + INSERT
                cells.append(best)
                before = best
            rows[i] = (low, cells)
        return rows

    def _headed(self, table: list[tuple[int, list[int]]]) -> list[tuple[int, list[int]]]:
        """The same with an s in front of the r symbols, which only a kept turn can give."""
        rows: list[tuple[int, list[int]]] = [(0, [])] * (len(self.codes) + 1)
        for i in range(len(self.codes) - 1, -1, -1):
            (at, below), (low, cells) = table[i + 1], rows[i + 1]
            code = self.codes[i]
            kept = code < 8 and code & 3 == 2
            to = max(at + len(below), low + len(cells)) if kept else low + len(cells)
            first = min(at, low) if kept and cells else at if kept else low
            out = []
            for r in range(first, to):
                best = cells[r - low] + DELETE if low <= r < low + len(cells) else _INF
                if kept and at <= r < at + len(below):
                    best = min(best, below[r - at] + (code >> 2) * TRUNCATED)
                out.append(best)
            rows[i] = (first, out)
        return rows

    def lengths(self, entry: int) -> Iterator[tuple[int, int, bool, int]]:
        """(cost, state at the end, with s in front, symbols) of every feasible target from a state."""
        for f, rows in self.left.items():
            low, cells = rows[0]
            for r, cost in enumerate(cells, low):
                if cost < _INF and (f == entry if r == 0 else f in _SYMBOL and (_SYMBOL[f] if r & 1 else 1 - _SYMBOL[f]) == _NEXT[entry]):
                    yield cost, f, False, r
        if entry == BEGIN:
            for f, rows in self.headed.items():
                low, cells = rows[0]
                for r, cost in enumerate(cells, low):
                    if cost < _INF and (f == SYSTEM if r == 0 else f in _SYMBOL and (_SYMBOL[f] if r & 1 else 1 - _SYMBOL[f]) == 0):
                        yield cost, f, True, r

    def costs(self, entry: int) -> list[int]:
        out = [_INF] * 4
        for cost, f, _, _ in self.lengths(entry):
            out[f] = min(out[f], cost)
        return out

    def audit(self, entry: int, to_go: list[int]) -> tuple[str, int]:
        """The ASCII-least audit among all lengths of least cost, and the state at its end."""
        found = [(cost + to_go[f], f, head, r) for cost, f, head, r in self.lengths(entry)]
        least = min(x[0] for x in found)
        return min((self._trace(f, head, r), f) for total, f, head, r in found if total == least)

    def _trace(self, end: int, head: bool, r: int) -> str:
        codes, out, i = self.codes, [], 0

        def cost(rows, i, r):
            low, cells = rows[i]
            return cells[r - low] if low <= r < low + len(cells) else _INF

        left = self.left[end]
        while i < len(codes):
            rows = self.headed[end] if head else left
            now = cost(rows, i, r)
            if now == cost(rows, i + 1, r) + DELETE:
                out.append("D")
                i += 1
            elif not head and r and now == cost(left, i, r - 1) + INSERT:
                out.append("I")
                r -= 1
            elif head:
                out.append("K")
                head, i = False, i + 1
            else:
                out.append("K" if codes[i] & 3 == (_SYMBOL[end] if r & 1 else 1 - _SYMBOL[end]) else "R")
                r, i = r - 1, i + 1
        return "".join(out)


def _pieces(codes: bytes) -> list[bytes]:
    return [codes[i:i + PIECE] for i in range(0, len(codes), PIECE)]


def _before(costs: list[list[int]], to_go: list[int]) -> list[int]:
    return [min(c + g for c, g in zip(row, to_go, strict=True)) for row in costs]


def aligned(codes: bytes) -> tuple[int, list[str]]:
    """Cost and audit (by pieces) of a whole conversation; closing insertions are a piece of their own."""
    cut = _pieces(codes)
    if len(cut) <= 1:
        pieces = [Piece(c, (BEGIN,)) for c in cut]
        ends = [list(CLOSING)]
        cost = min(c + g for c, g in zip(pieces[0].costs(BEGIN), CLOSING, strict=True)) if pieces else 0
    else:
        pieces = [Piece(c) for c in cut]
        ends = [list(CLOSING)]
        for p in reversed(pieces):
            ends.append(_before([p.costs(e) for e in range(4)], ends[-1]))
        cost = ends.pop()[BEGIN]
        ends.reverse()
    audits, state = [], BEGIN
    for p, to_go in zip(pieces, ends, strict=False):
        audit, state = p.audit(state, to_go)
        audits.append(audit)
    return cost, [*audits, "I" * (CLOSING[state] // INSERT)]


def matrix(codes: bytes) -> list[int]:
    """Costs from every state to every other over all pieces (row by row)."""
    total = [[0 if e == f else _INF for f in range(4)] for e in range(4)]
    for c in _pieces(codes):
        p = Piece(c)
        step = [p.costs(e) for e in range(4)]
        total = [[min(total[e][k] + step[k][f] for k in range(4)) for f in range(4)] for e in range(4)]
    return [min(x, _INF) for row in total for x in row]


def traced(codes: bytes, to_go: list[int]) -> list[tuple[int, list[str]]]:
    """From each state: the state at the end and the audits of the pieces."""
    pieces = [Piece(c) for c in _pieces(codes)]
    ends = [list(to_go)] if pieces else []
    for p in reversed(pieces[1:]):
        ends.append(_before([p.costs(e) for e in range(4)], ends[-1]))
    ends.reverse()
    out = []
    for entry in range(4):
        state, audits = entry, []
        for p, go in zip(pieces, ends, strict=True):
            if min(c + g for c, g in zip(p.costs(state), go, strict=True)) >= _INF:
                audits = []
                break
            audit, state = p.audit(state, go)
            audits.append(audit)
        out.append((state, audits))
    return out


def edited(turns: list[tuple[str, str, int]], audit: str, state: int) -> tuple[list[tuple[str, str | None, str | None]], int]:
    """(edit, role, text) of (role, text, code) turns under an audit from a state; deleted turns as they were."""
    out, at = [], 0
    for edit in audit:
        if edit == "I":
            role, text, kind = _ROLES[_NEXT[state]], "", _NEXT[state]
        else:
            role, text, code = turns[at]
            at += 1
            if edit == "D":
                out.append((edit, role, text))
                continue
            kind = code & 3
            if edit == "R":
                kind = _NEXT[state]
                role = _ROLES[kind]
        state = (USER, ASSISTANT, SYSTEM)[kind]
        out.append((edit, role, text))
    return out, state


def repaired_text(edits: list[tuple[str, str | None, str | None]]) -> str:
    return "\n".join(f"{role}:{text}" for edit, role, text in edits if edit != "D")


_COUNTS = ("n_turns", "least_turn", "most_turn", "distinct_turns", "blank", "duplicate", "truncated", "illegal")
_EDIT = pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
_TURN = pa.struct([("role", pa.string()), ("text", pa.string()), ("code", pa.int32())])
#: What a task leaves.  A conversation of its own: run is null, and seq is null (report) or its pieces' (edits).
#: Otherwise a run: its summary (seq is null) and its pieces.
_LEFT = pa.schema([
    ("conv", pa.string()), ("conv_id", pa.int64()), ("run", pa.int32()), ("seq", pa.int32()),
    *[(c, pa.int64()) for c in _COUNTS], ("head", pa.int32()), ("tail", pa.int32()),
    ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string()),
    ("codes", pa.binary()), ("matrix", pa.list_(pa.int64())), ("turns", pa.list_(_TURN)), ("edits", pa.list_(_EDIT))])
_LEFT_SQL = ("conv string, conv_id long, run int, seq int, " + ", ".join(f"{c} long" for c in _COUNTS) + ", head int, tail int, cost long, audit string, "
             "repaired_sha256 string, codes binary, matrix array<long>, turns array<struct<role:string,text:string,code:int>>, "
             "edits array<struct<edit:string,role:string,text:string>>")
#: Rows (and characters) of an output batch.
_BATCH, _BATCH_CHARS = 1000, 4_000_000


def _legal(first: int, second: int) -> bool:
    return (first, second) in ((2, 0), (0, 1), (1, 0))


class _Conversation:
    """What is counted while turns come in order."""

    def __init__(self, key: int | None):
        self.key = key
        self.count = dict.fromkeys(_COUNTS, 0) | {"least_turn": None, "most_turn": None}
        self.head = self.tail = None
        self.codes = bytearray()
        self.turns: list[tuple[str, str, int]] = []
        self.run = False
        self.seq = 0

    def add(self, turn: int | None, role: str, text: str, kind: int, blank: bool, duplicate: bool, truncated: bool) -> None:
        c = self.count
        c["n_turns"] += 1
        if turn is not None:
            c["distinct_turns"] += turn != c["most_turn"]
            c["least_turn"] = turn if c["least_turn"] is None else c["least_turn"]
            c["most_turn"] = turn
        fault = "blank" if blank else "duplicate" if duplicate else "truncated" if truncated else None
        if fault:
            c[fault] += 1
        if self.tail is None:
            self.head = kind
        else:
            c["illegal"] += not _legal(self.tail, kind)
        self.tail = kind
        code = kind + 4 * (2 if blank or duplicate else 1 if truncated else 0)
        self.codes.append(code)
        self.turns.append((role, text, code))


def _leave(edits_wanted: bool):
    """Aligns the conversations inside a sorted partition, leaves runs of the others."""

    def row(c: _Conversation, **more) -> dict:
        return {"conv": "" if c.key is None else str(c.key), "conv_id": c.key} | more

    def pieces(c: _Conversation, run: int, all_of_them: bool) -> Iterator[dict]:
        while len(c.turns) >= PIECE or (all_of_them and c.turns):
            yield row(c, run=run, seq=c.seq, turns=[dict(zip(("role", "text", "code"), t, strict=True)) for t in c.turns[:PIECE]])
            del c.turns[:PIECE]
            c.seq += 1

    def end(c: _Conversation, run: int, last: bool) -> Iterator[dict]:
        if c.run or last:
            yield from pieces(c, run, True)
            yield row(c, run=run, **c.count, head=c.head, tail=c.tail, codes=bytes(c.codes), matrix=matrix(bytes(c.codes)))
            return
        cost, audits = aligned(bytes(c.codes))
        state, texts, at = BEGIN, [], 0
        for k, audit in enumerate(audits):
            n = len(audit) - audit.count("I")
            edits, state = edited(c.turns[at:at + n], audit, state)
            at += n
            if edits_wanted and edits:
                yield row(c, seq=k, edits=[dict(zip(("edit", "role", "text"), e, strict=True)) for e in edits])
            texts.append(repaired_text(edits))
        if not edits_wanted:
            digest = hashlib.sha256("\n".join(t for t in texts if t).encode()).hexdigest()
            yield row(c, **c.count, cost=cost, audit="".join(audits), repaired_sha256=digest)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now, run = None, 0
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("pid", "conv_id", "gone", "turn", "role", "text", "kind", "blank", "duplicate", "truncated")]
            for run, key, gone, *turn in zip(*columns, strict=True):
                if now is None or key != now.key:
                    first = now is None
                    if now is not None:
                        yield from end(now, run, False)
                    now = _Conversation(key)
                    now.run = first  # it may have begun in the partition before
                if not gone:
                    now.add(*turn)
                    if not now.run and len(now.turns) > INSIDE:
                        now.run = True
                    if now.run and len(now.turns) >= PIECE:
                        yield from pieces(now, run, False)
        if now is not None:
            yield from end(now, run, True)

    return _in_batches(rows, _LEFT)


def _in_batches(rows, schema: pa.Schema):
    """A map over Arrow batches from a generator of rows."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chars = [], 0
        for r in rows(batches):
            held.append(r)
            chars += sum(len(t["text"]) for t in (r.get("turns") or r.get("edits") or ())) + len(r.get("codes") or b"") + len(r.get("repaired") or "")
            if len(held) >= _BATCH or chars >= _BATCH_CHARS:
                yield pa.RecordBatch.from_pylist(held, schema=schema)
                held, chars = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    return fn


def _dicts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _join_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """A conversation's runs in order: the costs to go at the end of each, and the whole's counts."""
    for c in _dicts(batches):
        runs = c["runs"]
        total = {n: sum(r[n] for r in runs) for n in _COUNTS if not n.endswith("t_turn")}
        least = most = tail = None
        for r in runs:
            if r["least_turn"] is not None:
                total["distinct_turns"] -= r["least_turn"] == most
                least, most = r["least_turn"] if least is None else least, r["most_turn"]
            if r["head"] is not None:
                if tail is not None:
                    total["illegal"] += not _legal(tail, r["head"])
                tail = r["tail"]
        ends = [list(CLOSING)]
        for r in reversed(runs):
            ends.append(_before([r["matrix"][4 * e:4 * e + 4] for e in range(4)], ends[-1]))
        cost = ends.pop()[BEGIN]
        for r, to_go in zip(runs, reversed(ends), strict=True):
            yield {"conv": c["conv"], "run": r["run"], "to_go": to_go, "cost": cost, "least_turn": least, "most_turn": most} | total


def _trace_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for r in _dicts(batches):
        found = traced(r["codes"], r["to_go"])
        ways = []
        for entry, (_, audits) in enumerate(found):
            state, at, way = entry, 0, []
            for audit in audits:
                way.append({"audit": audit, "state": state})
                for edit in audit:
                    if edit == "I":
                        state = (USER, ASSISTANT)[_NEXT[state]]
                        continue
                    kind = r["codes"][at] & 3
                    at += 1
                    if edit != "D":
                        state = (USER, ASSISTANT, SYSTEM)[kind if edit == "K" else _NEXT[state]]
            ways.append(way)
        yield {"conv": r["conv"], "run": r["run"], "exits": [s for s, _ in found], "ways": ways}


def _enter_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for c in _dicts(batches):
        state = BEGIN
        for k, r in enumerate(c["runs"]):
            entry, state = state, r["exits"][state]
            last = k == len(c["runs"]) - 1
            yield {"conv": c["conv"], "run": r["run"], "entry": entry, "closing": "I" * (CLOSING[state] // INSERT) if last else "", "state": state}


def _edit_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for r in _dicts(batches):
        edits, _ = edited([(t["role"], t["text"], t["code"]) for t in r["turns"] or ()], r["way"]["audit"], r["way"]["state"])
        yield {"conv": r["conv"], "run": r["run"], "seq": r["seq"], "audit": r["way"]["audit"],
               "edits": [dict(zip(("edit", "role", "text"), e, strict=True)) for e in edits]}


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row for each conversation of a stream of its pieces in order."""
    now, audits, digest, some = None, [], None, False

    def done() -> dict:
        return {"conv": now, "audit": "".join(audits), "repaired_sha256": digest.hexdigest()}

    for r in _dicts(batches):
        if now != r["conv"]:
            if now is not None:
                yield done()
            now, audits, digest, some = r["conv"], [], hashlib.sha256(), False
        audits.append(r["audit"])
        text = repaired_text([(e["edit"], e["role"], e["text"]) for e in r["edits"]])
        if text:
            digest.update((("\n" if some else "") + text).encode())
            some = True
    if now is not None:
        yield done()


def _turns(conversations: DataFrame, gone: Column | None) -> DataFrame:
    """Turns with their initials' kinds and faults, sorted within ranges of (conversation, turn)."""
    spark = conversations.sparkSession
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(gone if gone is not None else F.lit(False), F.lit(False)).alias("gone"),
        role.alias("role"), text.alias("text"))
    worded = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    kind = F.instr(F.lit(_INITIALS), F.substring("role", 1, 1))
    rows = rows.select(
        "*", F.monotonically_increasing_id().alias("id"), F.when((F.col("role") == "") | (kind == 0), 3).otherwise(kind - 1).alias("kind"),
        (worded == "").alias("blank"), (~F.substring(worded, -1, 1).isin(".", "!", "?")).alias("truncated"),
        F.md5(F.concat_ws("\x00", F.col("conv_id").cast("string"), F.length("role").cast("string"), "role", "text").cast("binary")).alias("mark"))
    turns = rewritten(rows, "conversation-turns")
    # Of equal (conversation, role, text) the first one; most marks occur once and drop out.
    repeats = rewritten(turns.where("NOT blank AND NOT gone").groupBy("mark").agg(F.min(F.struct("turn", "id")).alias("first"), F.count(F.lit(1)).alias("n"))
                        .where("n > 1").select("mark", "first"), "conversation-repeats")
    flagged = turns.join(repeats, "mark", "left").withColumn(
        "duplicate", F.coalesce(~F.struct("turn", "id").eqNullSafe(F.col("first")) & F.col("first").isNotNull() & ~F.col("blank") & ~F.col("gone"), F.lit(False)))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "mark", "id"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (flagged.drop("first").repartitionByRange(n, *order).withColumn("pid", F.spark_partition_id()).sortWithinPartitions(*order)
            .select("pid", "conv_id", "gone", "turn", "role", "text", "kind", "blank", "duplicate", "truncated"))


def _edited_runs(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of conversations that were cut: (conv, run, seq, audit, edits) of pieces, and their counts."""
    runs = left.where("run IS NOT NULL AND seq IS NULL")
    listed = runs.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("run", "matrix", *_COUNTS, "head", "tail"))).alias("runs"))
    fields = [(c, pa.int64()) for c in ("cost", *_COUNTS)]
    ends = rewritten(listed.mapInArrow(
        _in_batches(_join_runs, pa.schema([("conv", pa.string()), ("run", pa.int32()), ("to_go", pa.list_(pa.int64())), *fields])),
        "conv string, run int, to_go array<long>, " + ", ".join(f"{c} long" for c, _ in fields)), "conversation-ends")
    way = pa.struct([("audit", pa.string()), ("state", pa.int32())])
    ways = rewritten(runs.select("conv", "run", "codes").join(ends.select("conv", "run", "to_go"), ["conv", "run"]).mapInArrow(
        _in_batches(_trace_runs, pa.schema([("conv", pa.string()), ("run", pa.int32()), ("exits", pa.list_(pa.int32())), ("ways", pa.list_(pa.list_(way)))])),
        "conv string, run int, exits array<int>, ways array<array<struct<audit:string,state:int>>>"), "conversation-ways")
    entered = ways.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("run", "exits"))).alias("runs")).mapInArrow(
        _in_batches(_enter_runs, pa.schema([("conv", pa.string()), ("run", pa.int32()), ("entry", pa.int32()), ("closing", pa.string()), ("state", pa.int32())])),
        "conv string, run int, entry int, closing string, state int")
    closing = F.filter(F.array(F.struct(F.col("closing").alias("audit"), "state")), lambda c: c["audit"] != "")
    chosen = F.concat(F.col("ways")[F.col("entry")], closing)
    steps = ways.join(entered, ["conv", "run"]).select("conv", "run", F.posexplode(chosen).alias("seq", "way"))
    turns = left.where("run IS NOT NULL AND seq IS NOT NULL").select("conv", "run", "seq", "turns")
    edits = steps.join(turns, ["conv", "run", "seq"], "left").mapInArrow(
        _in_batches(_edit_pieces, pa.schema([("conv", pa.string()), ("run", pa.int32()), ("seq", pa.int32()), ("audit", pa.string()), ("edits", pa.list_(_EDIT))])),
        "conv string, run int, seq int, audit string, edits array<struct<edit:string,role:string,text:string>>")
    return edits, ends.drop("run", "to_go").distinct()


def repaired_turns(conversations: DataFrame, *, gone: Column | None = None) -> DataFrame:
    """One row for each edit: conv_id, (part, seq, place) in whose order a conversation reads, edit
    (K, R, D, I), role and text (of deleted turns as they were)."""
    left = rewritten(_turns(conversations, gone).mapInArrow(_leave(True), _LEFT_SQL), "conversation-runs")
    cut, _ = _edited_runs(left)
    key = F.when(F.col("conv") == "", None).otherwise(F.col("conv")).cast("long").alias("conv_id")
    whole = left.where("run IS NULL").select("conv_id", F.lit(0).alias("part"), "seq", "edits")
    return whole.unionByName(cut.select(key, F.col("run").alias("part"), "seq", "edits")).select(
        "conv_id", "part", "seq", F.posexplode("edits").alias("place", "e")).select("conv_id", "part", "seq", "place", "e.edit", "e.role", "e.text")


def repair_report(conversations: DataFrame, *, gone: Column | None = None) -> DataFrame:
    """One row for each conversation: gaps in its turn numbers, faults, illegal neighbours, the cost and audit of its
    cheapest repair, and a checksum of the repaired ``role:text`` lines."""
    left = rewritten(_turns(conversations, gone).mapInArrow(_leave(False), _LEFT_SQL), "conversation-runs")
    edits, counts = _edited_runs(left)
    chained = edits.repartition("conv").sortWithinPartitions("conv", "run", "seq").mapInArrow(
        _in_batches(_digests, pa.schema([("conv", pa.string()), ("audit", pa.string()), ("repaired_sha256", pa.string())])),
        "conv string, audit string, repaired_sha256 string")
    empty = hashlib.sha256().hexdigest()
    cut = counts.join(chained, "conv", "left").withColumn("conv_id", F.when(F.col("conv") != "", F.col("conv").cast("long"))) \
        .withColumn("audit", F.coalesce("audit", F.lit(""))).withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(empty)))
    names = ["conv_id", *_COUNTS, "cost", "audit", "repaired_sha256"]
    gaps = F.when(F.col("distinct_turns") > 0, F.col("most_turn") - F.col("least_turn") + 1 - F.col("distinct_turns")).otherwise(F.lit(0)).cast("long")
    return left.where("run IS NULL").select(*names).unionByName(cut.select(*names)).select(
        "conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults put in by a checksum of ``conv_id:turn``: dropped (column ``gone``), emptied, without
    sentence ends, repeated, or the role set to user."""
    text, role = (F.coalesce(F.col(c), F.lit(" ")) for c in ("text", "role"))
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(name.cast("binary")) % 20).alias("fault"))
    fault = F.col("fault")
    return rows.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"), (fault == 0).alias("gone"),
        F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")
