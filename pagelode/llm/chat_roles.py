"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns.

Hidden states are roles, observations the lines of a transcript with what they show: a speaker marker, whether a message
starts, length, number of lines, a question mark. Counts of labelled conversations give the model; Viterbi gives the roles.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import arrow_map, fold

ROLES = ("system", "user", "assistant", "tool")
#: Speaker markers at the start of a line, by the role they name.
MARKERS = (("system",), ("user", "human", "question", "q", "customer", "prompter"),
           ("assistant", "ai", "bot", "answer", "a", "agent", "gpt", "model"), ("tool", "function", "observation", "api"))
_NAMES = {name: i + 1 for i, names in enumerate(MARKERS) for name in names}
_MARK = re.compile(r"^\s*(?:\[|<\|?|\*\*|#{1,4}\s*)?([A-Za-z]{1,10})(?:\|?>|\])?(?:\*\*)?\s*[:>]\s*(?:\*\*)?\s*|^\s*<\|([a-z]{1,10})\|>\s*")
#: Values of each feature of a line: marker, length, lines of its message, question, first of the transcript.
SHAPE = (5, 8, 6, 2, 2)
S = len(ROLES)


def marker(line: str) -> tuple[int, str]:
    """The marker of a line (0: none) and the line without it."""
    found = _MARK.match(line)
    role = _NAMES.get((found[1] or found[2]).lower(), 0) if found else 0
    return (role, line[found.end():]) if role else (0, line)


def _level(n: int, steps: int) -> int:
    return min(steps - 1, n.bit_length() // 2 if steps == 8 else n.bit_length())


def observe(text: str | None, first: bool) -> list[tuple[int, ...]]:
    """``(starts a message, *features)`` of the lines of one message; an empty message is one empty line."""
    lines = (text or "").split("\n")
    out = []
    for i, line in enumerate(lines):
        mark, rest = marker(line)
        starts = i == 0 or mark > 0
        size = len(text or "") if i == 0 else len(rest)
        out.append((int(starts), mark, _level(size, 8), _level(len(lines), 6) if i == 0 else 0,
                    int(rest.rstrip().endswith("?")), int(first and i == 0)))
    return out


class Model:
    """Log probabilities: of the first role, of steps inside and between messages, and of each feature given the role."""

    def __init__(self, first: np.ndarray, steps: np.ndarray, seen: list[np.ndarray], smooth: float = 1.0):
        def share(counts):
            return (counts + smooth) / (counts + smooth).sum(-1, keepdims=True)

        inside = np.where(np.eye(S) > 0, 1 - 1e-6 * (S - 1), 1e-6)
        self.first, self.steps = np.log(share(first)), np.log(np.stack([inside, share(steps)]))
        # Roles with few labels lean on the lines of all roles, so that none becomes a home for odd lines.
        self.seen = [np.log(share(c + 20 * share(c.sum(0)))) for c in seen]
        # Markers may be missing from the labels: a fifth of the weight is on what they say.
        said = np.full((S, SHAPE[0]), 0.0005)
        said[:, 0] = 10
        said[np.arange(S), np.arange(S) + 1] = 1
        counts = seen[0] + seen[0].sum(0) / (1 + seen[0].sum()) + 0.001
        self.seen[0] = np.log(0.8 * counts / counts.sum(1, keepdims=True) + 0.2 * said / said.sum(1, keepdims=True))

    def emission(self, lines: np.ndarray) -> np.ndarray:
        return sum(table[:, lines[:, i + 1]].T for i, table in enumerate(self.seen))

    def transfer(self, lines: np.ndarray, begins: bool) -> np.ndarray:
        """Best log probability from each role before the lines to each role at their end; with ``begins``, all rows are alike."""
        score = np.where(np.eye(S) > 0, 0.0, -np.inf)
        for i, (line, emitted) in enumerate(zip(lines, self.emission(lines))):
            if begins and i == 0:
                score = np.tile(self.first + emitted, (S, 1))
            else:
                score = (score[:, :, None] + self.steps[line[0]][None]).max(1) + emitted
        return score

    def decode(self, lines: np.ndarray, before: int | None, after: int | None) -> np.ndarray:
        """Roles of the lines by Viterbi, between a known role before and a known role at the last line, if given."""
        emitted, n = self.emission(lines), len(lines)
        back = np.zeros((n, S), np.int8)
        score = self.first + emitted[0] if before is None else self.steps[lines[0, 0]][before] + emitted[0]
        for i in range(1, n):
            ways = score[:, None] + self.steps[lines[i, 0]]
            back[i] = ways.argmax(0)
            score = ways.max(0) + emitted[i]
        path = np.zeros(n, np.int64)
        path[-1] = score.argmax() if after is None else after
        for i in range(n - 1, 0, -1):
            path[i - 1] = back[i, path[i]]
        return path


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list]]:
    """``(conversation, rows)`` of each conversation of a sorted partition, or of its part in it."""
    conv = rows = None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if rows is None or row[0] != conv:
                if rows is not None:
                    yield conv, rows
                conv, rows = row[0], []
            rows.append(row)
    if rows is not None:
        yield conv, rows


def _observed(rows: list, begins: bool) -> tuple[np.ndarray, np.ndarray]:
    lines, ends = [], []
    for i, row in enumerate(rows):
        lines += observe(row[3], begins and i == 0)
        ends.append(len(lines))
    return np.array(lines, np.int64), np.array(ends)


def ordered(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, fold`` sorted by conversation and turn, in even ranges that may cut a conversation."""
    rows = conversations.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
                                fold(F.col("conv_id")).alias("fold"))
    keys = ["conv_id", "turn", "text", "role"]
    return cut_lineage(rows.repartitionByRange(*keys).sortWithinPartitions(*keys))


def _edges(parts: DataFrame) -> list:
    """First and last conversation of every partition, in order; a row per partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = last_role = first_role = None
        n = 0
        for batch in batches:
            if batch.num_rows:
                convs, roles = batch.column(0), batch.column(2)
                if not n:
                    first, first_role = convs[0].as_py(), roles[0].as_py()
                last, last_role, n = convs[batch.num_rows - 1].as_py(), roles[batch.num_rows - 1].as_py(), n + batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([first], batch.schema.field(0).type),
                                              pa.array([last], batch.schema.field(0).type), pa.array([first_role], pa.string()), pa.array([last_role], pa.string())],
                                             ["part", "first", "last", "first_role", "last_role"])

    kind = parts.schema["conv_id"].dataType.simpleString()
    return arrow_map(parts, run, f"part int, first {kind}, last {kind}, first_role string, last_role string").orderBy("part").collect()


def learn(parts: DataFrame, edges: list, held_out_fold: int) -> Model:
    """Counts over all labelled rows outside the fold ``held_out_fold``, as a few hundred sums.

    Steps between two partitions of one conversation are added from the partitions' edges, so none is lost.
    """
    before = {e.part: p for p, e in zip(edges, edges[1:]) if p.last == e.first}
    sent = parts.sparkSession.sparkContext.broadcast({part: e.last_role for part, e in before.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        first, steps = np.zeros(S), np.zeros((S, S))
        seen = [np.zeros((S, n)) for n in SHAPE]
        for _, rows in _segments(batches):
            goes_on = number == 0 and part in sent.value
            number += 1
            if rows[0][4] == held_out_fold:
                continue
            last = sent.value[part] if goes_on else None
            for i, row in enumerate(rows):
                begins = i == 0 and not goes_on
                if row[2] in ROLES:
                    role = ROLES.index(row[2])
                    if begins:
                        first[role] += 1
                    elif last in ROLES:
                        steps[ROLES.index(last), role] += 1
                    for line in observe(row[3], begins):
                        for f, v in enumerate(line[1:]):
                            seen[f][role, v] += 1
                last = row[2]
        sums = np.concatenate([first, steps.ravel(), *[c.ravel() for c in seen]])
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["at", "n"])

    total = np.zeros(S + S * S + S * sum(SHAPE))
    for r in arrow_map(parts, run, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).collect():
        total[r["at"]] = r["n"]
    first, steps, rest = total[:S], total[S:S + S * S].reshape(S, S), total[S + S * S:]
    cuts = np.cumsum([0, *(S * n for n in SHAPE)])
    return Model(first, steps, [rest[a:b].reshape(S, n) for a, b, n in zip(cuts, cuts[1:], SHAPE)])


def _borders(parts: DataFrame, edges: list, model: Model) -> tuple[dict[int, int], dict[int, int]]:
    """Role before the first line and role at the last line of partitions, where a conversation goes on over the border.

    Every partition sends one small matrix for its first and one for its last conversation; the chains of these along
    conversations that span partitions are solved here.
    """
    number = {e.part: i for i, e in enumerate(edges)}
    on = {e.part: i + 1 < len(edges) and edges[i + 1].first == e.last for i, e in enumerate(edges)}
    begins = {e.part: i == 0 or not on[edges[i - 1].part] for i, e in enumerate(edges)}
    before: dict[int, int] = {}
    at_last: dict[int, int] = {}
    if not any(on.values()):
        return before, at_last
    sent = parts.sparkSession.sparkContext.broadcast((begins, on, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        begin, goes_on, known = sent.value
        found, held, count = [], [], 0
        for _, rows in _segments(batches):
            if count == 0 and not begin[part]:
                found.append(("first", known.transfer(_observed(rows, False)[0], False)))
            held, count = rows, count + 1
        starts = count > 1 or (count == 1 and begin[part])
        if starts and goes_on[part]:
            found.append(("last", known.transfer(_observed(held, True)[0], True)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * len(found), pa.int32()), pa.array([f[0] for f in found], pa.string()),
             pa.array([f[1].ravel().tolist() for f in found], pa.list_(pa.float64())), pa.array([count == 1] * len(found), pa.bool_())],
            ["part", "side", "m", "whole"])

    sides = {(r.part, r.side): (np.array(r.m).reshape(S, S), r.whole)
             for r in arrow_map(parts, run, "part int, side string, m array<double>, whole boolean").collect()}
    for (part, side), (matrix, _) in sides.items():
        if side != "last":
            continue
        chain, score, back = [part], matrix[0], []
        while True:
            after = edges[number[chain[-1]] + 1].part
            step, whole = sides[after, "first"]
            ways = score[:, None] + step
            back.append(ways.argmax(0))
            score = ways.max(0)
            chain.append(after)
            if not (whole and on[after]):
                break
        role = int(score.argmax())
        for here, after, ways in zip(reversed(chain[:-1]), reversed(chain[1:]), reversed(back)):
            role = int(ways[role])
            at_last[here] = before[after] = role
    return before, at_last


def recover_roles(conversations: DataFrame, held_out_fold: int = 1) -> DataFrame:
    """One row per stretch of a message with one role: ``conv_id, turn, segment, role, predicted, begins_turn, rendered``.

    Conversations are transcripts in order of turn, then text; ``role`` is only read to learn from, and only in conversations
    outside the fold ``held_out_fold``. Joined in this order, ``rendered`` is the transcript in canonical turns: a turn opens
    where the role changes. Null and empty texts are empty lines, a null conversation or turn sorts first, equal rows stay.
    A conversation of any length is spread over partitions: only one small matrix for each border passes the driver.
    """
    parts = ordered(conversations)
    edges = _edges(parts)
    model = learn(parts, edges, held_out_fold)
    sent = parts.sparkSession.sparkContext.broadcast((*_borders(parts, edges, model), model))
    names = ["conv_id", "turn", "segment", "role", "predicted", "begins_turn", "rendered"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        befores, lasts, known = sent.value
        part = TaskContext.get().partitionId()
        kinds = None
        waiting, number = None, 0

        def decoded(item, last):
            index, rows = item
            before = befores.get(part) if index == 0 else None
            lines, ends = _observed(rows, before is None)
            path = known.decode(lines, before, lasts.get(part) if last else None)
            previous, at, out = before, 0, []
            for row, end in zip(rows, ends.tolist()):
                texts = [marker(line)[1] for line in (row[3] or "").split("\n")]
                begin, segment = at, 0
                while begin < end:
                    stop = begin + 1
                    while stop < end and path[stop] == path[begin]:
                        stop += 1
                    role = int(path[begin])
                    opens = role != previous
                    head = ("<|end|>\n" if opens and previous is not None else "") + (f"<|{ROLES[role]}|>\n" if opens else "")
                    out.append((row[0], row[1], segment, row[2], ROLES[role], opens, head + "\n".join(texts[begin - at:stop - at]) + "\n"))
                    previous, begin, segment = role, stop, segment + 1
                at = end
            return out

        def emit(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        held: list[tuple] = []

        def watched(source):
            nonlocal kinds
            for batch in source:
                kinds = [batch.schema.field(0).type, batch.schema.field(1).type, pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.string()]
                yield batch

        for _, rows in _segments(watched(batches)):
            if waiting is not None:
                held += decoded(waiting, False)
                if len(held) > 2000:
                    yield emit(held)
                    held = []
            waiting, number = (number, rows), number + 1
        if waiting is not None:
            held += decoded(waiting, True)
            yield emit(held)

    kind = {f.name: f.dataType.simpleString() for f in parts.schema}
    return arrow_map(parts, run, f"conv_id {kind['conv_id']}, turn {kind['turn']}, segment int, role string, predicted string, begins_turn boolean, rendered string")
