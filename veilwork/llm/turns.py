"""Conversation repair: turns are aligned to the strings of an alternating grammar at least cost.

The grammar is ``(s?(ua)+)?`` over role initials: an optional system turn, then user and assistant in turn. The edits are
Keep (0), Rerole to user or assistant (1), Delete (2; required for blank and duplicate rows) and Insert an empty user or
assistant turn (5); a truncated row that stays adds 5. The cost is that of the cheapest Wagner-Fischer alignment to any
feasible length of the grammar's string, the audit the least of the backtraced edit strings of all cheapest alignments.

All lengths share one table: a string of the grammar read from its end is a prefix of ``auauau...``, so cell (i, k) holds
the cost of rows i.. against the last k initials, and the strings with ``s`` are one more column set above it. The table
is a band, after Ukkonen: an alignment that costs no more than the incumbent strays from the diagonal by what the incumbent
leaves above the unavoidable cost; the band doubles until the incumbent lies inside it. Rows of the table are stored at
steps of the square root of their number, and made again in the trace, so memory grows with the band times the root of the length. The forward
trace keeps all cheapest alignments that agree so far and takes the least edit any of them allows.

Time is rows times band, so it grows with the square of a long conversation's faults (20,000 turns with 2,000 faults take
half a minute, 2,000 turns one second). A
conversation's turns pass through one task in order, as its digest demands: one byte a turn is held for the alignment,
texts stream by afterwards and are never gathered.

Nulls in role and text are one space, and in the id and turn of the damage rule too; a null conversation id is a
conversation of its own. Rows of equal turn are ordered by role, then the digest of their text; repeated rows are faults
like any other. Rows with another initial than s, u and a, or none, can be rerolled or deleted, not kept. Texts of any length
are read as streams of rows; other columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwork.llm.common import cell

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Conversations of this many turns or fewer are remembered with their audits, this many a task.
SHORT, REMEMBERED = 64, 50_000
#: Cost above the unavoidable that the first band allows.
SLACK = 12
_FAR = np.int64(1) << 40

ROLES = {"u": "user", "a": "assistant"}


# ---- alignment ----------------------------------------------------------------------------------------------------
# A row is one character: its initial (s, u, a, or x for others), in capitals if truncated, or D if it must go.


class _Band:
    """Rows i = n..0 of the cost table, each a band of columns; rows are kept at every ``step`` and made again between."""

    def __init__(self, codes: str, slack: int):
        self.codes, self.n = codes, len(codes)
        firm = np.array([c in "suax" for c in codes], np.int64)
        left = np.concatenate((np.cumsum(firm[::-1])[::-1], [0]))  # rows from i on that cost nothing to keep
        # a row deleted costs 2 of the slack, one inserted 5, a truncated one kept 3 more than deleted
        self.low = np.maximum(0, left - slack // 2)
        self.high = left + slack // 3 + 1
        self.step = max(1, isqrt(self.n))
        self.kept: dict[int, tuple] = {}
        row = self._last()
        for i in range(self.n, -1, -1):
            row = row if i == self.n else self._row(i, row)
            if i % self.step == 0 or i == self.n:
                self.kept[i] = row
        self.block: dict[int, tuple] = {}

    def _last(self) -> tuple[np.ndarray, np.ndarray]:
        k = np.arange(self.low[self.n], self.high[self.n] + 1)
        return INSERT * k, np.full(len(k), _FAR)

    def _fit(self, values: np.ndarray, i: int, shift: int) -> np.ndarray:
        """Row i + 1 as seen from the columns of row i, ``shift`` columns to the left."""
        low, high = self.low[i], self.high[i]
        at = np.arange(low, high + 1) - shift - self.low[i + 1]
        inside = (at >= 0) & (at < len(values))
        return np.where(inside, values[np.where(inside, at, 0)], _FAR)

    def _row(self, i: int, below: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        plain, system = below
        code = self.codes[i]
        k = np.arange(self.low[i], self.high[i] + 1)
        cost = self._fit(plain, i, 0) + DELETE
        above = self._fit(system, i, 0) + DELETE
        if code != "D":
            stay = TRUNCATED if code.isupper() else 0
            wanted = np.where(k % 2 == 1, code in "aA", code in "uU")
            cost = np.minimum(cost, self._fit(plain, i, 1) + np.where(wanted, 0, REROLE) + stay)
            if code in "sS":
                above = np.minimum(above, np.where((k % 2 == 0) & (k >= 2), self._fit(plain, i, 0) + stay, _FAR))
        cost = np.minimum.accumulate(cost - INSERT * k) + INSERT * k
        return cost, above

    def best(self) -> int:
        plain, system = self.kept[0]
        even = np.arange(self.low[0], self.high[0] + 1) % 2 == 0
        return int(min(plain[even].min(initial=_FAR), system[even].min(initial=_FAR)))

    def at(self, i: int, k: int, system: bool) -> int:
        row = self.kept.get(i) or self.block.get(i)
        if row is None:
            self.block = {}
            top = min(self.n, (i // self.step + 1) * self.step)
            row = self.kept[top]
            for j in range(top - 1, i // self.step * self.step, -1):
                row = self.block[j] = self._row(j, row)
            row = self.block[i]
        k -= self.low[i]
        return int(row[system][k]) if 0 <= k < len(row[0]) else int(_FAR)

    def audit(self) -> str:
        """The least edit string of all alignments at the best cost."""
        best, n = self.best(), self.n
        ks = range(int(self.low[0]) + int(self.low[0]) % 2, int(self.high[0]) + 1, 2)
        alive = {(k, s) for k in ks for s in (False, True) if self.at(0, k, s) == best}
        spent, i, edits = 0, 0, []
        while i < n or any(k for k, _ in alive):
            code = self.codes[i] if i < n else "D"
            stay = TRUNCATED if code.isupper() else 0
            ways: dict[str, dict] = {}
            for k, s in alive:
                rest = best - spent
                if i < n and self.at(i + 1, k, s) + DELETE == rest:
                    ways.setdefault("D", {})[k, s] = DELETE
                if not s and k and self.at(i, k - 1, False) + INSERT == rest:
                    ways.setdefault("I", {})[k - 1, False] = INSERT
                if code == "D":
                    continue
                if s:
                    if code in "sS" and k >= 2 and self.at(i + 1, k, False) + stay == rest:
                        ways.setdefault("K", {})[k, False] = stay
                elif k:
                    same = code.lower() == ("a" if k % 2 else "u")
                    if self.at(i + 1, k - 1, False) + stay + (0 if same else REROLE) == rest:
                        ways.setdefault("K" if same else "R", {})[k - 1, False] = stay + (0 if same else REROLE)
            edit = min(ways)
            spent += next(iter(ways[edit].values()))
            alive = set(ways[edit])
            i += edit != "I"
            edits.append(edit)
        return "".join(edits)


def align(codes: str) -> tuple[int, str]:
    """(cost, audit) of one conversation's row codes."""
    unavoidable = DELETE * sum(c not in "suax" for c in codes)
    slack = SLACK
    while True:
        band = _Band(codes, slack)
        incumbent = band.best() - unavoidable
        if incumbent <= slack:
            return incumbent + unavoidable, band.audit()
        slack = min(2 * slack, incumbent) if incumbent < _FAR // 2 else 2 * slack


# ---- conversations ------------------------------------------------------------------------------------------------


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, gone): rows damaged by the checksum of their place; dropped rows are marked."""
    none = F.lit(" ")
    conv, turn = cell(conv_col), cell(turn_col)
    role, text = F.coalesce(cell(role_col).cast("string"), none), F.coalesce(cell(text_col).cast("string"), none)
    mark = F.concat(F.coalesce(conv.cast("string"), none), F.lit(":"), F.coalesce(turn.cast("string"), none))
    rows = turns.select(conv.alias("conv_id"), turn.alias("turn"), role.alias("role"), text.alias("text"), (F.crc32(mark) % 20).alias("harm"))
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("harm") == 3, F.array_repeat(F.lit(0), 2)).otherwise(F.array(F.lit(0)))
    rows = rows.withColumn("copy", F.explode(copies))
    return rows.select("conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("harm") == 0).alias("gone"))


def _kind(rows: DataFrame, column: str) -> str:
    return rows.schema[column].dataType.simpleString()


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, key, fault, gone): the first fault of each row, ``key`` standing for its text.

    A duplicate is found among the rows of equal conversation, role and text, by rank; they lie together, as all rows
    of a conversation do.
    """
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    # what is left of the last mark on: nothing but white space follows it
    whole = F.substring(F.regexp_replace("text", r"[\x20\x09-\x0D]++$", ""), -1, 1).isin(".", "!", "?")
    slim = rows.select("conv_id", "turn", "role", F.sha2("text", 256).alias("key"), blank.alias("blank"), whole.alias("whole"), "gone").repartition("conv_id")
    nth = F.row_number().over(Window.partitionBy("conv_id", "role", "key", "gone").orderBy("turn"))
    fault = F.when(F.col("blank"), "blank").when(nth > 1, "duplicate").when(~F.col("whole"), "truncated")
    return slim.select("conv_id", "turn", "role", "key", fault.alias("fault"), "gone")


def audits(found: DataFrame) -> DataFrame:
    """One row per conversation: its counts, cost and audit."""
    fields = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
    names = ["conv_id", *[f.split()[0] for f in fields.split(", ")]]
    types = [pa.int64()] * 6 + [pa.string()]
    code = F.lower(F.substring("role", 1, 1))
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), code).otherwise("x")
    # one character a row: the initial and the fault
    rows = found.select("conv_id", "turn", "role", "key", initial.alias("initial"), F.coalesce("fault", F.lit("")).alias("fault"), "gone", F.col("turn").cast("long").alias("number"))
    rows = rows.sortWithinPartitions("conv_id", "turn", "role", "key", F.col("fault") == "duplicate")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(REMEMBERED)(align)
        kind, now, done = None, None, []

        def row(s: dict) -> tuple:
            counts, codes = s["counts"], s["codes"].decode()
            cost, audit = (known if len(codes) <= SHORT else align)(codes)
            gaps = s["last"] - s["first"] + 1 - s["turns"] if s["turns"] else 0
            return (s["id"], gaps, counts["blank"], counts["duplicate"], counts["truncated"], s["illegal"], cost, audit)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [kind, *types])], names=names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, initial, fault, gone, number in zip(*[batch.column(k).to_pylist() for k in range(5)]):
                if now is None or now["id"] != conv:
                    if now is not None:
                        done.append(row(now))
                    now = {"id": conv, "counts": {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}, "codes": bytearray(), "illegal": 0, "before": None, "turns": 0}
                if gone:
                    continue
                now["counts"][fault] += 1
                now["codes"] += (b"D" if fault in ("blank", "duplicate") else (initial.upper() if fault else initial).encode())
                now["illegal"] += now["before"] is not None and now["before"] + initial not in ("su", "ua", "au")
                now["before"] = initial
                if number is not None:
                    if not now["turns"]:
                        now["first"] = number
                    now["turns"] += not now["turns"] or now["last"] != number
                    now["last"] = number
            if done:
                yield batch_of(done)
                done = []
        if now is not None:
            yield batch_of([row(now)])

    return rows.select("conv_id", "initial", "fault", "gone", "number").mapInArrow(judged, f"conv_id {_kind(found, 'conv_id')}, {fields}")


def _repaired_rows(conv_rows: Iterator[tuple], audit: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired conversation, its rows read one by one."""
    size = sum(e != "D" for e in audit)
    place = size  # initials still to come; the last is an assistant's
    for edit in audit:
        role, text = (None, "") if edit == "I" else next(conv_rows)
        if edit == "D":
            continue
        yield (role if edit == "K" else ROLES["a" if place % 2 else "u"]), text
        place -= 1


def repair(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the rows of the repaired conversations, in order."""
    return _streamed(rows, judged, False)


def _streamed(rows: DataFrame, judged: DataFrame, hashed: bool) -> DataFrame:
    """The audit of a conversation comes first in its task, then its rows one by one, as repaired rows or as their digest."""
    kind = _kind(rows, "conv_id")
    empty = F.lit(None).cast("string")
    first = judged.select("conv_id", F.lit(0).alias("part"), F.lit(None).cast(_kind(rows, "turn")).alias("turn"), empty.alias("role"), F.col("audit").alias("text"))
    both = first.union(rows.where(~F.col("gone")).select("conv_id", F.lit(1).alias("part"), "turn", "role", "text"))
    keyed = both.withColumn("key", F.when(F.col("part") == 1, F.sha2("text", 256)))
    dealt = keyed.repartition("conv_id").sortWithinPartitions("conv_id", "part", "turn", "role", "key").select("conv_id", "part", "role", "text")
    fields = "repaired_sha256 string" if hashed else "place bigint, role string, text string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list = [None]

        def lines() -> Iterator[tuple]:
            for batch in batches:
                kinds[0] = batch.schema.field(0).type
                step = 512  # texts made at a time
                for at in range(0, batch.num_rows, step):
                    some = batch.slice(at, step)
                    yield from zip(*[some.column(k).to_pylist() for k in range(4)])

        def out(some: list[tuple]) -> pa.RecordBatch:
            types = [pa.string()] if hashed else [pa.int64(), pa.string(), pa.string()]
            names = [f.split()[0] for f in fields.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), [kinds[0], *types])], names=["conv_id", *names])

        stream, held, size = lines(), [], 0
        for conv, part, _, audit in stream:
            mine = ((role, text) for _, _, role, text in (next(stream) for _ in range(sum(e != "I" for e in audit))))
            digest = hashlib.sha256()
            for place, (role, text) in enumerate(_repaired_rows(mine, audit)):
                if hashed:
                    digest.update((("\n" if place else "") + role + ":" + text).encode())
                else:
                    held.append((conv, place, role, text))
                    size += len(text)
            if hashed:
                held.append((conv, digest.hexdigest()))
            if len(held) >= 2048 or size >= 1 << 24:
                yield out(held)
                held, size = [], 0
        if held:
            yield out(held)

    return dealt.mapInArrow(read, f"conv_id {kind}, {fields}")


def repair_digests(rows: DataFrame) -> DataFrame:
    """One row per conversation: its faults, cost, audit and the digest of what the repair leaves."""
    judged = audits(faults(rows))
    done = _streamed(rows, judged, True)
    return judged.join(done, judged["conv_id"].eqNullSafe(done["conv_id"])).drop(done["conv_id"])
