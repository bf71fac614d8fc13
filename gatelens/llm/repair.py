"""Conversation structure repair by weighted interval parsing.

A repaired dialogue is ``(s?(ua)+)?`` in initials of its roles. The grammar that describes it is in Chomsky normal form
over spans of rows: every nonterminal stands for what a span may leave behind, every rule joins two neighbouring spans,
and the edits of one row are the terminals. A cell holds the minimum ``(cost, audit)`` of a span and nonterminal, the
audit being the initials of the edits in order (Delete, Insert, Keep, Rerole). Two audits of one cell with equal cost are
never each other's prefix (both consume the same rows, and what follows would be insertions, which cost), so that
concatenation keeps their order and minima can be joined.

Cells are combined bottom-up by span length: all spans and all splits inside pieces of ``PIECE`` rows, for all pieces of
a batch at once; then pairs of neighbouring spans of equal length; then the spans of neighbouring partitions. Above a
piece one split is enough: whatever a repaired span looks like, each of its splits leaves a nonterminal on both sides, so
every split finds the same minimum.
"""

from __future__ import annotations


from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelens.llm.common import partitions, stored

PIECE = 8
FAN = 16

# What a span leaves: nothing, (ua)+, u(au)*, a(ua)*, (au)+, s, s(ua)+, su(au)*.
NONE, UA, U, A, AU, S, SUA, SU = range(8)
KINDS = 8
GOALS = (NONE, UA, SUA)

RULES = [
    *((NONE, x, x) for x in range(KINDS)),
    *((x, NONE, x) for x in range(KINDS) if x != NONE),
    (UA, UA, UA), (UA, U, U), (U, A, UA), (U, AU, U), (A, UA, A), (A, U, AU), (AU, A, A), (AU, AU, AU),
    (S, UA, SUA), (S, U, SU), (SUA, UA, SUA), (SUA, U, SU), (SU, A, SUA), (SU, AU, SU),
]

# Costs of the edits; a row that ends without a mark costs one more unless it is deleted.
DELETE, INSERT, KEEP, REROLE = 3, 2, 0, 2
LETTERS = "DIKR"

SPACES = " \t\n\x0b\x0c\r"
_COST, _LENGTH = np.uint64(56), np.uint64(255)
_FAR = np.uint64(200 << 56)


def _key(cost, letters: str = "") -> np.ndarray:
    """A cell as one number that orders like (cost, audit): cost, audit in two bits a letter from the left, length."""
    bits = 0
    for n, letter in enumerate(letters):
        bits |= LETTERS.index(letter) << (54 - 2 * n)
    return (np.asarray(cost, np.uint64) << _COST) + np.uint64(bits + len(letters))


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Cell of two neighbouring spans; a cell that cannot be stays beyond ``_FAR``."""
    letters = (right & np.uint64((1 << 56) - 1)) >> np.uint64(8) << np.uint64(8)
    shift = np.uint64(2) * (left & _LENGTH)
    moved = letters >> shift >> np.uint64(8) << np.uint64(8)
    cost = np.minimum((left >> _COST) + (right >> _COST), np.uint64(200))
    size = (left & _LENGTH) + (right & _LENGTH)
    key = (cost << _COST) + (left & np.uint64((1 << 56) - 256)) + moved + size
    return np.where(cost >= np.uint64(200), _FAR, key)


def _relax(cell: np.ndarray, to: int, new: np.ndarray) -> None:
    np.minimum(cell[to], new, out=cell[to])


def _closed(cell: np.ndarray) -> np.ndarray:
    """Insertion closure: turns of a user or an assistant put before or after the span, as long as that is cheaper.

    No path needs a nonterminal twice, and from any to any there is one of four insertions at most.
    """
    inserted = _key(INSERT, "I")
    for _ in range(4):
        before = cell.copy()
        for left, right, whole in RULES:
            if left in (U, A) and right != NONE:
                _relax(cell, whole, _joined(inserted, before[right]))
            if right in (U, A) and left != NONE:
                _relax(cell, whole, _joined(before[left], inserted))
        for one in (U, A):
            _relax(cell, one, _joined(before[NONE], inserted))
            _relax(cell, one, _joined(inserted, before[NONE]))
    return cell


def leaves(initial: np.ndarray, must_go: np.ndarray, truncated: np.ndarray, present: np.ndarray) -> np.ndarray:
    """Closed cells of single rows; a row that is not present is an empty span."""
    cell = np.full((KINDS, *initial.shape), _FAR)
    cell[NONE] = np.where(present, _key(DELETE, "D"), _key(0))
    free = present & ~must_go
    cost = truncated.astype(np.uint64)
    for role, kind in (("u", U), ("a", A), ("s", S)):
        cell[kind] = np.where(free & (initial == role), _key(KEEP + cost, "K"), cell[kind])
    for kind in (U, A):
        cell[kind] = np.where(free, np.minimum(cell[kind], _key(REROLE + cost, "R")), cell[kind])
    return _closed(cell)


def chart(cells: np.ndarray) -> np.ndarray:
    """Cells of whole pieces from those of their rows: every span, every split, by span length."""
    width = cells.shape[2]
    spans = {(i, i + 1): cells[:, :, i] for i in range(width)}
    for length in range(2, width + 1):
        for i in range(width - length + 1):
            whole = np.full(cells.shape[:2], _FAR)
            for k in range(i + 1, i + length):
                left, right = spans[i, k], spans[k, i + length]
                for x, y, z in RULES:
                    _relax(whole, z, _joined(left[x], right[y]))
            spans[i, i + length] = whole
    return spans[0, width]


def spelled(cells: np.ndarray) -> list[list[tuple[int, str] | None]]:
    """Cells of pieces as (cost, audit), one list of nonterminals per piece."""
    rows = []
    for piece in cells.T:
        row = []
        for key in piece.tolist():
            size = key & 255
            audit = "".join(LETTERS[key >> (54 - 2 * n) & 3] for n in range(size))
            row.append(None if key >= int(_FAR) else (key >> 56, audit))
        rows.append(row)
    return rows


def combined(left: list, right: list) -> list:
    """Cells of two neighbouring spans of any length."""
    whole: list = [None] * KINDS
    for x, y, z in RULES:
        if left[x] is not None and right[y] is not None:
            cost = left[x][0] + right[y][0]
            if whole[z] is None or cost <= whole[z][0]:
                new = (cost, left[x][1] + right[y][1])
                if whole[z] is None or new < whole[z]:
                    whole[z] = new
    return whole


def _folded(spans: list[tuple[int, list]], new: list) -> None:
    """Add a span to a row of spans of falling length; equal lengths combine."""
    size = 1
    while spans and spans[-1][0] == size:
        new = combined(spans.pop()[1], new)
        size *= 2
    spans.append((size, new))


def _whole(spans: list[tuple[int, list]]) -> list:
    cell = spans[-1][1]
    for _, left in reversed(spans[:-1]):
        cell = combined(left, cell)
    return cell


# -- rows of a span: counts that add up, ends that meet the neighbour, cells

_COUNTS = ("n_rows", "distinct_turns", "blank", "duplicate", "truncated", "illegal")
_SPAN = (
    "_conv long, _part int, _edge boolean, first_turn long, last_turn long, first_initial string, last_initial string, "
    + ", ".join(f"{c} long" for c in _COUNTS)
    + ", costs array<long>, audits array<string>"
)
LEGAL = {"su", "ua", "au"}


def _merged(left: dict, right: dict) -> dict:
    if not right["n_rows"]:
        return left
    if not left["n_rows"]:
        return right
    out = {c: left[c] + right[c] for c in _COUNTS}
    out["distinct_turns"] -= left["last_turn"] is not None and left["last_turn"] == right["first_turn"]
    out["illegal"] += left["last_initial"] + right["first_initial"] not in LEGAL
    out["first_turn"] = left["first_turn"] if left["first_turn"] is not None else right["first_turn"]
    out["last_turn"] = right["last_turn"] if right["last_turn"] is not None else left["last_turn"]
    out["first_initial"], out["last_initial"] = left["first_initial"], right["last_initial"]
    out["cells"] = combined(left["cells"], right["cells"])
    return out


def _as_span(row: dict) -> dict:
    row["cells"] = [None if c is None else (c, a) for c, a in zip(row.pop("costs"), row.pop("audits"), strict=True)]
    return row


def _as_row(span: dict, conv, part: int, edge: bool) -> dict:
    cells = span.pop("cells")
    return span | {
        "_conv": conv,
        "_part": part,
        "_edge": edge,
        "costs": [None if c is None else c[0] for c in cells],
        "audits": [None if c is None else c[1] for c in cells],
    }


def _schema():
    number, text = pa.int64(), pa.string()
    return pa.schema(
        [("_conv", number), ("_part", pa.int32()), ("_edge", pa.bool_()), ("first_turn", number), ("last_turn", number)]
        + [("first_initial", text), ("last_initial", text)]
        + [(c, number) for c in _COUNTS]
        + [("costs", pa.list_(number)), ("audits", pa.list_(text))]
    )


def _batches(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    """Rows of spans in batches; a long audit ends its batch."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(a) for a in row["audits"] if a)
        if size > 1 << 20:
            yield pa.RecordBatch.from_pylist(held, _schema())
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, _schema())


def _empty() -> dict:
    out = dict.fromkeys(_COUNTS, 0) | {"first_turn": None, "last_turn": None, "first_initial": "", "last_initial": ""}
    return out | {"cells": [(0, "")] + [None] * (KINDS - 1)}


class _Runs:
    """The runs of one conversation each in a partition, from batches of rows in order."""

    def __init__(self):
        self.conv, self.open, self.span, self.spans = None, False, _empty(), []

    def _closed(self) -> tuple:
        span = self.span
        if self.spans:
            span["cells"] = _whole(self.spans)
        return self.conv, span

    def feed(self, batch: pa.RecordBatch) -> Iterator[tuple]:
        convs = batch.column("_conv").to_pylist()
        turns, copies = batch.column("_turn").to_pylist(), batch.column("_copies").to_pylist()
        initials = batch.column("_initial").to_pylist()
        blank, again, cut = (batch.column(c).to_pylist() for c in ("_blank", "_again", "_truncated"))
        starts = [0] + [i for i in range(1, len(convs)) if convs[i] != convs[i - 1]]
        pieces, owner = [], []
        for n, low in enumerate(starts):
            high = starts[n + 1] if n + 1 < len(starts) else len(convs)
            rows = [i for i in range(low, high) if copies[i]]
            for at in range(0, len(rows), PIECE):
                pieces.append(rows[at : at + PIECE])
                owner.append(n)
        cells = _piece_cells(pieces, initials, blank, again, cut, copies)
        at = 0
        for n, low in enumerate(starts):
            if not (self.open and self.conv == convs[low]):
                if self.open:
                    yield self._closed()
                self.conv, self.open, self.span, self.spans = convs[low], True, _empty(), []
            while at < len(owner) and owner[at] == n:
                for i in pieces[at]:
                    self._count(turns[i], initials[i], blank[i], again[i], cut[i], copies[i])
                _folded(self.spans, cells[at])
                at += 1

    def end(self) -> Iterator[tuple]:
        if self.open:
            yield self._closed()

    def _count(self, turn, initial, blank, again, cut, copies) -> None:
        span = self.span
        span["illegal"] += (copies - 1) + (span["n_rows"] > 0 and span["last_initial"] + initial not in LEGAL)
        if not span["n_rows"]:
            span["first_initial"] = initial
        span["last_initial"] = initial
        span["n_rows"] += copies
        if turn is not None and turn != span["last_turn"]:
            span["distinct_turns"] += 1
            span["last_turn"] = turn
            if span["first_turn"] is None:
                span["first_turn"] = turn
        if blank:
            span["blank"] += copies
        else:
            span["duplicate"] += copies - (not again)
            span["truncated"] += cut and not again


def _deleted(n: int) -> list:
    """Closed cells of ``n`` rows that must go: turns are put in behind them, since D comes before I."""
    cell: list = [None] * KINDS
    for kind, more in ((NONE, 0), (U, 1), (A, 1), (UA, 2), (AU, 2)):
        cell[kind] = (DELETE * n + INSERT * more, "D" * n + "I" * more)
    return cell


def _piece_cells(pieces, initials, blank, again, cut, copies) -> list[list]:
    """Cells of the pieces; further copies of a row are deleted right behind it."""
    if not pieces:
        return []
    shape = (len(pieces), PIECE)
    role, go, short, here = np.full(shape, "", "U1"), np.zeros(shape, bool), np.zeros(shape, bool), np.zeros(shape, bool)
    for p, rows in enumerate(pieces):
        for k, i in enumerate(rows):
            role[p, k], go[p, k], short[p, k], here[p, k] = initials[i], blank[i] or again[i], cut[i], True
    cells = leaves(role, go, short, here)
    many = [p for p, rows in enumerate(pieces) if any(copies[i] > 1 for i in rows)]
    out = spelled(chart(cells))
    for p in many:  # the piece row by row, each with the run of its copies
        spans: list = []
        for k, i in enumerate(pieces[p]):
            own = spelled(cells[:, p : p + 1, k])[0]
            _folded(spans, combined(own, _deleted(copies[i] - 1)) if copies[i] > 1 else own)
        out[p] = _whole(spans)
    return out


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()

    def rows() -> Iterator[dict]:
        runs, held, first = _Runs(), None, True

        def found():
            for batch in batches:
                yield from runs.feed(batch)
            yield from runs.end()

        for conv, span in found():  # the first and the last run may go on in a neighbouring partition
            if held is not None:
                yield _as_row(held[1], held[0], part, first)
                first = False
            held = (conv, span)
        if held is not None:
            yield _as_row(held[1], held[0], part, True)

    yield from _batches(rows())


def _combined_group(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["_part"])
    conv, part = rows[0]["_conv"], rows[0]["_part"]
    spans = [_as_span(r) for r in rows]
    while len(spans) > 1:  # neighbours in pairs
        spans = [_merged(*spans[i : i + 2]) if i + 1 < len(spans) else spans[i] for i in range(0, len(spans), 2)]
    return pa.Table.from_pylist([_as_row({k: v for k, v in spans[0].items() if not k.startswith("_")}, conv, part // FAN, True)], _schema())


def _initial(role: Column) -> Column:
    return F.substring(role, 1, 1)


def damaged(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Rows with seeded faults, to measure a repair with: ``_conv, _turn, _role, _text, _copies``.

    ``crc32("conv:turn") % 20`` decides: 0 drops a row (no copies), 1 empties its text, 2 takes its ``.!?`` away, 3
    repeats it, 4 makes it a user's. A null is one space there, as role and as text.
    """

    def spaced(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(spaced(turns[conv_col]), F.lit(":"), spaced(turns[turn_col])).cast("binary")) % 20
    text = spaced(turns[text_col])
    return turns.select(
        turns[conv_col].cast("long").alias("_conv"),
        turns[turn_col].cast("long").alias("_turn"),
        F.when(fault == 4, F.lit("user")).otherwise(spaced(turns[role_col])).alias("_role"),
        F.when(fault == 1, F.lit("")).when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("_text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).cast("long").alias("_copies"),
    )


def plain(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Rows as they are, in the columns that the repair reads; null role and text are one space."""
    return turns.select(
        turns[conv_col].cast("long").alias("_conv"),
        turns[turn_col].cast("long").alias("_turn"),
        F.coalesce(turns[role_col].cast("string"), F.lit(" ")).alias("_role"),
        F.coalesce(turns[text_col].cast("string"), F.lit(" ")).alias("_text"),
        F.lit(1).cast("long").alias("_copies"),
    )


def _digest() -> Column:
    return F.md5(F.col("_text").cast("binary"))


def repair(rows: DataFrame) -> DataFrame:
    """``_conv, gaps, blank, duplicate, truncated, illegal, cost, audit`` for every conversation of ``plain`` or ``damaged``.

    Rows count by turn, null first, then by role, then by the MD5 of the text. A row's first fault counts: blank,
    duplicate (role and text seen earlier in the conversation), truncated (no ``.!?`` at the end). Blank and duplicate
    rows must be deleted. A role without a first letter cannot be kept, only reroled.

    Rows that agree in everything are counted before they are sorted; then the rows of all conversations are dealt by
    ranges of their order, so that a conversation of any length lies on as many tasks as it fills. A partition parses its
    runs; runs that touch a partition's border (two at most in each) are combined ``FAN`` parts at a time. The audit of a
    conversation is one text, as long as its rows.

    Null conversation: a conversation of its own. One with no rows (all dropped): zeros, empty audit. Empty input: no
    rows. Other columns play no part.
    """
    spark = rows.sparkSession
    ending = F.rtrim("_text", F.lit(SPACES))
    narrow = (
        rows.select("_conv", "_turn", "_role", _digest().alias("_digest"), "_copies", (ending == "").alias("_blank"),
                    (~F.right(ending, F.lit(1)).isin(".", "!", "?")).alias("_truncated"))
        .groupBy("_conv", "_turn", "_role", "_digest", "_blank", "_truncated")
        .agg(F.sum("_copies").alias("_copies"))
    )
    narrow = stored(narrow, "turns")
    first = (
        narrow.filter("_copies > 0")
        .groupBy("_conv", "_role", "_digest")
        .agg(F.min("_turn").alias("_first"), F.max(F.col("_turn").isNull()).alias("_unnumbered"), F.count("*").alias("_n"))
        .filter("_n > 1")
        .select(F.col("_conv").alias("_of"), F.col("_role").alias("_said_by"), F.col("_digest").alias("_said"), "_first", "_unnumbered")
    )
    same = F.col("_conv").eqNullSafe(F.col("_of")) & (F.col("_role") == F.col("_said_by")) & (F.col("_digest") == F.col("_said"))
    again = F.when(F.col("_unnumbered"), F.col("_turn").isNotNull()).otherwise(F.col("_turn") > F.col("_first"))
    marked = narrow.join(first, same, "left").select(
        "_conv", "_turn", "_role", "_digest", "_copies", "_blank", "_truncated", _initial(F.col("_role")).alias("_initial"),
        F.coalesce(again, F.lit(False)).alias("_again"),
    )
    order = [F.asc_nulls_first(c) for c in ("_conv", "_turn", "_role", "_digest")]
    ranged = marked.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    spans = stored(ranged.select("_conv", "_turn", "_initial", "_copies", "_blank", "_again", "_truncated").mapInArrow(_parsed, _SPAN), "spans")
    inner, edges = spans.filter("NOT _edge"), spans.filter("_edge")
    n = 1 + (spans.agg(F.max("_part")).first()[0] or 0)
    parts = 1
    while parts < n:
        grouped = edges.withColumn("_over", (F.col("_part") / FAN).cast("int")).groupBy("_conv", "_over")
        edges = grouped.applyInArrow(lambda t: _combined_group(t.drop_columns("_over")), _SPAN)
        parts *= FAN
    whole = inner.unionByName(edges)
    goals = F.array_sort(
        F.filter(
            F.array(*[F.struct(F.col("costs")[g].alias("cost"), F.col("audits")[g].alias("audit")) for g in GOALS]),
            lambda g: g["cost"].isNotNull(),
        )
    )
    best = whole.withColumn("_best", goals[0])
    counted = F.col("n_rows") > 0
    return best.select(
        "_conv",
        F.coalesce(F.when(counted, F.col("last_turn") - F.col("first_turn") + 1 - F.col("distinct_turns")), F.lit(0)).cast("long").alias("gaps"),
        "blank", "duplicate", "truncated", "illegal",
        F.when(counted, F.col("_best.cost")).otherwise(0).cast("long").alias("cost"),
        F.when(counted, F.col("_best.audit")).otherwise("").alias("audit"),
    )


_WALK = "_conv long, place long, turn long, edit string, role string, text string"


class _Walk:
    """The rows of one conversation under its audit, one after the other."""

    def __init__(self, conv, audit: str):
        self.conv, self.audit, self.at, self.kept, self.base = conv, audit, 0, 0, 0

    def _speaker(self) -> str:
        return "assistant" if (self.kept - self.base) % 2 else "user"

    def inserted(self) -> Iterator[tuple]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            yield None, "Insert", self._speaker(), ""
            self.at += 1
            self.kept += 1

    def row(self, turn, role: str, text: str, copies: int) -> Iterator[tuple]:
        for _ in range(copies):
            yield from self.inserted()
            letter = self.audit[self.at]
            self.at += 1
            if letter == "D":
                continue
            if letter == "K":
                if role[:1] == "s":
                    self.base = 1
                yield turn, "Keep", role, text
            else:
                yield turn, "Rerole", self._speaker(), text
            self.kept += 1


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``conv, row or None`` in order; ``None`` when a conversation ends."""
    walk = None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("_conv", "_audit", "_turn", "_role", "_text", "_copies")]
        for conv, audit, turn, role, text, copies in zip(*columns, strict=True):
            if audit is not None:
                if walk is not None:
                    for out in walk.inserted():
                        yield walk.conv, out
                    yield walk.conv, None
                walk = _Walk(conv, audit)
            else:
                for out in walk.row(turn, role, text, copies):
                    yield conv, out
    if walk is not None:
        for out in walk.inserted():
            yield walk.conv, out
        yield walk.conv, None


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["_conv", "place", "turn", "edit", "role", "text"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    held, place, size = [], 0, 0
    for conv, out in _walked(batches):
        if out is None:
            place = 0
            continue
        held.append((conv, place, *out))
        place += 1
        size += 64 + len(out[3])
        if size > 1 << 20:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), types, strict=True)], names)
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), types, strict=True)], names)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    state, begun, held = hashlib.sha256(), False, []
    for conv, out in _walked(batches):
        if out is None:
            held.append((conv, state.hexdigest()))
            state, begun = hashlib.sha256(), False
        else:
            state.update(f"{chr(10) if begun else ''}{out[2]}:{out[3]}".encode())
            begun = True
        if len(held) >= 4096:
            yield pa.record_batch([pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held])], ["_conv", "sha256"])
            held = []
    if held:
        yield pa.record_batch([pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held])], ["_conv", "sha256"])


def _side_by_side(rows: DataFrame, report: DataFrame) -> DataFrame:
    """Every conversation in one task, in order, its audit first; rows are streamed, not gathered."""
    none = F.lit(None)
    audits = report.select(
        "_conv", F.col("audit").alias("_audit"), none.cast("long").alias("_turn"), none.cast("string").alias("_role"),
        none.cast("string").alias("_digest"), none.cast("string").alias("_text"), none.cast("long").alias("_copies"),
    )
    texts = rows.filter("_copies > 0").select("_conv", none.cast("string").alias("_audit"), "_turn", "_role", _digest().alias("_digest"), "_text", "_copies")
    both = audits.unionByName(texts).repartition(partitions(rows.sparkSession), "_conv")
    order = ["_conv", F.col("_audit").isNull(), F.asc_nulls_first("_turn"), "_role", "_digest"]
    return both.sortWithinPartitions(*order).drop("_digest")


def repaired(rows: DataFrame, report: DataFrame) -> DataFrame:
    """``_conv, place, turn, edit, role, text``: the turns that the audits of ``repair`` leave, ``place`` from 0."""
    return _side_by_side(rows, report).mapInArrow(_edited, _WALK)


def fingerprints(rows: DataFrame, report: DataFrame) -> DataFrame:
    """``_conv, sha256`` of the repaired ``role:text`` lines. A hash over a whole conversation has to read it in one task;
    its rows pass one by one."""
    return _side_by_side(rows, report).mapInArrow(_digested, "_conv long, sha256 string")


def repair_report(rows: DataFrame) -> DataFrame:
    """The report of ``repair`` with ``repaired_sha256`` beside it."""
    report = stored(repair(rows), "repairs")
    prints = stored(fingerprints(rows, report), "prints").withColumnRenamed("_conv", "_own")
    return report.join(prints, report["_conv"].eqNullSafe(prints["_own"])).drop("_own").withColumnRenamed("sha256", "repaired_sha256")
