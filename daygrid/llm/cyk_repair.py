"""Structure repair of conversations: a weighted interval parse with an edit grammar.

A repaired conversation is empty, or an optional system turn followed by pairs of user and assistant turns. Rows may be
kept (0), sent by the user or the assistant instead (2), deleted (3; blank and repeated rows must be) and rows with an
empty text inserted (2); a truncated row that stays adds 1. Of the cheapest repairs the one with the ASCII-least audit
(initials of the edits in order: D, I, K, R) is taken.

Grammar in Chomsky normal form: a symbol ``(p, q)`` derives the rows that lead from place ``p`` of the pattern to place
``q``; ``(p, r) -> (p, q) (q, r)``, and ``(p, q)`` derives one row by an edit, closed under insertion on both sides. A
cell of the chart holds for every symbol the least (cost, audit) over its span. Every derivation can be cut between any
two rows, so one cut of a span gives what all cuts would: spans of 1, 2, 4, ... rows are combined in turn. Within one
span no audit of equal cost is the beginning of another (what it lacked could only be insertions, which cost), so the
order of audits survives joining them.

Rows of a conversation go by turn (nulls first), then role, then a hash of role and text; rows equal in all are alike.
Null role and text count as one space. A role whose initial is not s, u or a, or that is empty, cannot be kept. A null
conv_id is a conversation of its own. Other columns are ignored. A task holds of a conversation one byte a row and the
audits of its chart, never its texts, which are read once in order.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daygrid.llm import shared

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Places of the pattern: nothing yet, after the system turn, after a user turn, after a pair.
NEXT = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("a", 2): 3, ("u", 3): 2}
PLACES, FINAL = range(4), (0, 3)
ROLES = {"u": "user", "a": "assistant"}
_SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_LINES = "conv_id long, place int, edit string, role string, text string"
_SPACE = " \t\n\x0b\x0c\r"
#: Spans of at most this many rows are remembered by their rows.
_REMEMBERED = 16


def _least(cells, p, q, cost, audit):
    if cells[p][q] is None or (cost, audit) < cells[p][q]:
        cells[p][q] = (cost, audit)


def _join(left, right):
    """The cell of a span cut in two."""
    out = [[None] * 4 for _ in PLACES]
    for p in PLACES:
        for m in PLACES:
            if left[p][m] is not None:
                cost, audit = left[p][m]
                for q in PLACES:
                    if right[m][q] is not None:
                        _least(out, p, q, cost + right[m][q][0], audit + right[m][q][1])
    return out


def _inserted():
    """The cell of no rows: insertions alone, closed."""
    out = [[(0, "") if p == q else None for q in PLACES] for p in PLACES]
    for _ in PLACES:
        step = [[None] * 4 for _ in PLACES]
        for (role, p), q in NEXT.items():
            if role in ROLES:
                _least(step, p, q, INSERT, "I")
        longer = _join(out, step)
        for p in PLACES:
            for q in PLACES:
                if longer[p][q] is not None:
                    _least(out, p, q, *longer[p][q])
    return out


NO_ROWS = _inserted()


def _row(kind: str):
    """The cell of one row: ``x`` must go, a capital is truncated, ``o`` is a role of no place."""
    out = [[None] * 4 for _ in PLACES]
    for p in PLACES:
        _least(out, p, p, DELETE, "D")
        if kind == "x":
            continue
        more = TRUNCATED if kind.isupper() else 0
        for (role, at), q in NEXT.items():
            if at == p and role == kind.lower():
                _least(out, p, q, more, "K")
            elif at == p and role in ROLES:
                _least(out, p, q, REROLE + more, "R")
    return _join(_join(NO_ROWS, out), NO_ROWS)


@lru_cache(maxsize=1 << 15)
def _short(kinds: str):
    if len(kinds) == 1:
        return _row(kinds)
    cut = 1 << (len(kinds) - 1).bit_length() - 1
    return _join(_short(kinds[:cut]), _short(kinds[cut:]))


def parse(kinds: str) -> tuple[int, str]:
    """Least (cost, audit) of a conversation given as one letter a row."""
    if not kinds:
        return 0, ""
    cells = [_short(kinds[k:k + _REMEMBERED]) for k in range(0, len(kinds), _REMEMBERED)]
    while len(cells) > 1:
        cells = [_join(*cells[k:k + 2]) if k + 1 < len(cells) else cells[k] for k in range(0, len(cells), 2)]
    return min(cells[0][0][q] for q in FINAL if cells[0][0][q] is not None)


def _skinny(rows: DataFrame) -> DataFrame:
    """Rows with null roles and texts as one space, and the hash that orders rows of one turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
                       F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("hash"))


def faults(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """conv_id, turn, role, hash, fault (blank, duplicate, truncated or null) of every row, without its text.

    Rows of ``ids`` go along with nothing but their conv_id, and hash null.
    """
    end = F.expr(f"trim(TRAILING '{_SPACE}' FROM text)")
    skinny = _skinny(rows).select("conv_id", "turn", "role", F.substring("hash", 1, 16).alias("hash"), F.right(end, F.lit(1)).alias("end"))
    if ids is not None:  # joined before the one exchange, so that both lie by the same conv_id
        bare = [F.lit(None).cast(t).alias(c) for c, t in skinny.dtypes[1:]]
        skinny = skinny.unionByName(ids.select(F.col("conv_id").cast("long").alias("conv_id"), *bare))
    nth = F.row_number().over(Window.partitionBy("conv_id", "hash").orderBy(F.asc_nulls_first("turn")))
    fault = F.when(F.col("end") == "", "blank").when(F.col("nth") > 1, "duplicate").when(~F.col("end").isin(".", "!", "?"), "truncated")
    return skinny.repartition("conv_id").withColumn("nth", nth).select("conv_id", "turn", "role", "hash", F.when(F.col("hash").isNotNull(), fault).alias("fault"))


class _Conversation:
    def __init__(self, conv_id):
        self.conv_id, self.kinds, self.initial = conv_id, bytearray(), None
        self.count = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.turns, self.first, self.last = 0, 0, None, None

    def add(self, turn, role, fault):
        initial = role[:1]
        if self.kinds and (self.initial + initial) not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.turns = turn, self.turns + 1
        kind = initial if initial in ("s", "u", "a") else "o"
        if fault is not None:
            self.count[fault] += 1
            kind = kind.upper() if fault == "truncated" else "x"
        self.kinds += kind.encode()

    def told(self):
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return (self.conv_id, (gaps + (1 << 63)) % (1 << 64) - (1 << 63), *self.count.values(), self.illegal, *parse(self.kinds.decode()))


def _told(batches):
    import pyarrow as pa

    types = [pa.int64()] * 7 + [pa.string()]
    names = [c.split()[0] for c in _SUMMARY.split(", ")]
    now, out = None, []
    for batch in batches:
        for conv_id, turn, role, held, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "held", "fault"))):
            if now is None or conv_id != now.conv_id:
                out += [now.told()] if now is not None else []
                now = _Conversation(conv_id)
            if held:
                now.add(turn, role, fault)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
            out = []
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(now.told(), types)], names)


def summary(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row per conversation of ``ids`` and ``rows``: gaps, counts of faults, cost and audit of its repair; written once.

    gaps: turns missing between the first and last known one (a long; wraps). A conversation without rows: zeros, no edit.
    """
    ordered = faults(rows, ids).sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "hash")
    told = ordered.select("conv_id", "turn", "role", F.col("hash").isNotNull().alias("held"), "fault").mapInArrow(_told, _SUMMARY)
    return shared.written(told, "repairs")


def _edited(batches):
    import pyarrow as pa

    conv, audit, at, state, place = None, "", 0, 0, 0
    types, names = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()], ["conv_id", "place", "edit", "role", "text"]
    for batch in batches:
        out = []
        for conv_id, said, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text"))):
            if said is not None:
                conv, audit, at, state, place = conv_id, said, 0, 0, 0
            else:
                edit = audit[at]
                at += 1
                if edit != "D":
                    turned = "a" if state == 2 else "u"
                    role = role if edit == "K" else ROLES[turned]
                    state, place = NEXT[role[:1], state], place + 1
                    out.append((conv, place, edit, role, text))
            while at < len(audit) and audit[at] == "I":
                turned, at, place = "a" if state == 2 else "u", at + 1, place + 1
                state = NEXT[turned, state]
                out.append((conv, place, "I", ROLES[turned], ""))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)


def repaired(rows: DataFrame, told: DataFrame) -> DataFrame:
    """The repaired rows by the audits of ``summary``: conv_id, place (from 1), edit (K, R or I), role, text.

    Rows of a conversation lie together and in order in one partition.
    """
    rows = _skinny(rows).select("conv_id", "turn", "role", F.substring("hash", 1, 16).alias("hash"), "text", F.lit(None).cast("string").alias("audit"))
    audits = told.select("conv_id", *[F.lit(None).cast(t).alias(c) for c, t in rows.dtypes[1:-1]], "audit")
    both = rows.unionByName(audits).repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), F.asc_nulls_first("turn"), "role", "hash")
    return both.select("conv_id", "audit", "role", "text").mapInArrow(_edited, _LINES)


def _hashed(batches):
    import pyarrow as pa

    now, digest = None, None
    for batch in batches:
        out = []
        for conv_id, place, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text"))):
            if place == 1:
                out += [(now, digest.hexdigest())] if digest is not None else []
                now, digest = conv_id, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string()))], ["of", "repaired_sha256"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([digest.hexdigest()], pa.string())], ["of", "repaired_sha256"])


def line_hashes(lines: DataFrame) -> DataFrame:
    """of (a conv_id), repaired_sha256: hash of ``role:text`` lines of the rows of ``repaired``, read in their order as they come."""
    return lines.mapInArrow(_hashed, "of long, repaired_sha256 string")
