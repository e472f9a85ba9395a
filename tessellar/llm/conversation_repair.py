"""Cheapest repair of a conversation's turns, by a min-plus scan of 4 x 4 matrices.

The roles of a repaired conversation read (s?(ua)+)?, an automaton of four
states: start, after s, after u, after a. A turn is a matrix of the cheapest
(cost, audit) from state to state, with insertions allowed before it. Matrices
multiply associatively, so turns are folded in pairs inside each sorted range
of rows, and ranges of one conversation are folded in a tree of Spark rounds.

Equal costs go to the audit that is least in ASCII. That choice may be made in
every product: audits of equal cost over the same turns have the same number of
K, R and D, so none is a proper prefix of another, and order survives
concatenation on both sides.

Order of turns: by turn, nulls first; then by role and the MD5 of the text, so
equal rows are neighbours. Defined cases: a null role or text is one space,
which is blank as a text and no initial as a role (an empty role has none
either); rows of a null conv_id are one conversation; conversations of which
nothing is left have zeros, an empty audit and no text; columns of other names
are ignored. Audits and digests cover the whole conversation whatever its
length: the scan is spread over ranges of rows, while a digest reads its
conversation's rows one after another in one task, without holding them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
NAMES = {"u": "user", "a": "assistant"}
START, S, U, A = range(4)
STEP = {(START, "s"): S, (START, "u"): U, (S, "u"): U, (U, "a"): A, (A, "u"): U}
#: costs of the edits
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: partial results of one conversation that one call of a round folds
FAN_IN = 64

# A matrix is a tuple of 16 elements, row by row: (cost, audit), or None where there is no way.
Matrix = tuple


def product(x: Matrix, y: Matrix) -> Matrix:
    out = []
    for i in (0, 4, 8, 12):
        for j in range(4):
            best = None
            for k in range(4):
                p, q = x[i + k], y[4 * k + j]
                if p is not None and q is not None:
                    e = (p[0] + q[0], p[1] + q[1])
                    if best is None or e < best:
                        best = e
            out.append(best)
    return tuple(out)


def _plus(x: Matrix, y: Matrix) -> Matrix:
    return tuple(p if q is None else q if p is None else min(p, q) for p, q in zip(x, y))


def _matrix(entries: dict) -> Matrix:
    return tuple(entries.get((i, j)) for i in range(4) for j in range(4))


ONE = _matrix({(i, i): (0, "") for i in range(4)})
_SINGLE = _plus(ONE, _matrix({(i, j): (INSERT, "I") for (i, r), j in STEP.items() if r in NAMES}))
#: any number of insertions: no shortest way has more than three
CLOSURE = product(product(_SINGLE, _SINGLE), _SINGLE)


def turn_matrix(initial: str, must_delete: bool, truncated: bool) -> Matrix:
    """Insertions, then the turn kept, given another role or deleted."""
    late = TRUNCATED if truncated else 0
    own = _matrix({(i, i): (DELETE, "D") for i in range(4)})
    if not must_delete:
        own = _plus(own, _matrix({(i, j): (late, "K") for (i, r), j in STEP.items() if r == initial}))
        own = _plus(own, _matrix({(i, j): (REROLE + late, "R") for (i, r), j in STEP.items() if r in NAMES}))
    return product(CLOSURE, own)


TURNS = {(i, d, t): turn_matrix(i, d, t) for i in ("s", "u", "a", "") for d in (False, True) for t in (False, True)}


class Fold:
    """Ordered product of matrices in pairs of equal size, so that n audits are copied log n times."""

    def __init__(self) -> None:
        self.stack: list[tuple[int, Matrix]] = []

    def add(self, m: Matrix, size: int = 1) -> None:
        while self.stack and self.stack[-1][0] <= size:
            n, left = self.stack.pop()
            m, size = product(left, m), size + n
        self.stack.append((size, m))

    def result(self) -> Matrix:
        out = ONE
        for _, m in reversed(self.stack):
            out = product(m, out)
        return out


def best(m: Matrix) -> tuple[int, str]:
    """Cheapest way from the start to an accepted end, insertions at the end included."""
    closed = product(m, CLOSURE)
    return min(e for e in (closed[START], closed[A]) if e is not None)


def replay(audit: str) -> Iterator[tuple[str, str]]:
    """(edit, role or '') of every edit: the automaton leaves one role open to R and I, and K follows it by its own initial."""
    state = START
    for e in audit:
        role = ""
        if e in "RI":
            role = "a" if state == U else "u"
            state = STEP[state, role]
        got = yield e, NAMES.get(role, "")
        if e == "K":
            state = STEP[state, got]


# ------------------------------------------------------------------ damage


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage of the contract, keyed by the CRC of `conv_id:turn`."""
    plain = conversations.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(name.cast("binary")) % 20
    text = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    kept = plain.withColumn("_k", kind).where("_k <> 0")
    rows = kept.select("conv_id", "turn", F.when(F.col("_k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("_k") == 3, 2).otherwise(1).alias("_n"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("col")


# ------------------------------------------------------------------ scan


def _md5(text: str) -> Column:
    return F.unhex(F.md5(F.col(text)))


def _narrow(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, h, blank, cut, first): a turn without its text; `first` is the earliest turn of a repeated role and text."""
    last = F.substring(F.rtrim(F.col("text"), F.lit(SPACE)), -1, 1)
    rows = turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", _md5("text").alias("h"), (last == "").alias("blank"), (~last.isin(*ENDS)).alias("cut"))
    keys = ["conv_id", "role", "h"]
    order = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
    again = rows.groupBy(*keys).agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").select(*[F.col(k).alias(f"_{k}") for k in keys], "first")
    same = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("role") == F.col("_role")) & (F.col("h") == F.col("_h"))
    return rows.join(again, same, "left").select(*rows.columns, F.coalesce(order > F.col("first"), F.lit(False)).alias("later"))


PARTIAL = "conv_id bigint, part bigint, n bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, left string, right string, low bigint, high bigint, turns bigint, costs array<bigint>, audits array<string>"
_NAMES = [f.split()[0] for f in PARTIAL.split(", ")]
LEGAL = {"su", "ua", "au"}


class Partial:
    """What is known of a run of neighbouring turns of one conversation."""

    __slots__ = ("n", "blank", "duplicate", "truncated", "illegal", "left", "right", "low", "high", "turns", "fold")

    def __init__(self) -> None:
        self.n = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.left = self.right = self.low = self.high = None
        self.fold = Fold()

    def turn(self, initial: str, turn: int | None, blank: bool, duplicate: bool, cut: bool) -> None:
        fault = "blank" if blank else "duplicate" if duplicate else "truncated" if cut else None
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        self._beside(initial, initial, turn, turn, 1)
        self.n += 1
        self.fold.add(TURNS[initial if initial in ("s", "u", "a") else "", fault in ("blank", "duplicate"), fault == "truncated"])

    def _beside(self, left: str, right: str, low: int | None, high: int | None, turns: int) -> None:
        """Turns are in order, so neighbours share a turn at most where they meet."""
        if self.n and self.right + left not in LEGAL:
            self.illegal += 1
        if not self.n:
            self.left = left
        self.right = right
        if low is not None:
            self.turns += turns - (low == self.high)
            self.low = low if self.low is None else self.low
            self.high = high

    def append(self, row: dict) -> None:
        self._beside(row["left"], row["right"], row["low"], row["high"], row["turns"])
        for k in ("n", "blank", "duplicate", "truncated", "illegal"):
            setattr(self, k, getattr(self, k) + row[k])
        self.fold.add(tuple(None if c < 0 else (int(c), a) for c, a in zip(row["costs"], row["audits"])), row["n"])

    def row(self, conv_id: int | None, part: int) -> tuple:
        m = self.fold.result()
        costs, audits = [-1 if e is None else e[0] for e in m], ["" if e is None else e[1] for e in m]
        return (conv_id, part, self.n, self.blank, self.duplicate, self.truncated, self.illegal, self.left, self.right, self.low, self.high, self.turns, costs, audits)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_ARROW = {"bigint": pa.int64(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
_SCHEMA = pa.schema([(f.split()[0], _ARROW[f.split()[1]]) for f in PARTIAL.split(", ")])
_OUT_ROWS = 2048


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns in, a partial result per conversation of this range out."""
    part = TaskContext.get().partitionId()
    current, key, before, out = None, None, None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            conv_id, turn, role, h, blank, cut, later = row
            if current is None or conv_id != key:
                if current is not None:
                    out.append(current.row(key, part))
                    if len(out) >= _OUT_ROWS:
                        yield _batch(out, _SCHEMA)
                        out = []
                current, key, before = Partial(), conv_id, None
            same = (turn, role, h)
            current.turn(role[:1], turn, blank, later or same == before, cut)
            before = same
    if current is not None:
        out.append(current.row(key, part))
    if out:
        yield _batch(out, _SCHEMA)


def _folded(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Partial results of one conversation, FAN_IN of them at most, into one; `key` is the conversation and the new place."""
    whole = Partial()
    rows = pdf.sort_values("part").astype(object).where(lambda x: x.notna(), None).to_dict("records")
    for row in rows:
        whole.append(row)
    return pd.DataFrame([whole.row(rows[0]["conv_id"], int(key[1]))], columns=_NAMES).astype({"conv_id": "Int64", "low": "Int64", "high": "Int64"})


def scan(turns: DataFrame) -> DataFrame:
    """A row of PARTIAL per conversation of (conv_id, turn, role, text), the product of all its turns.

    Rows are sorted into ranges by conversation and turn; only a conversation
    that crosses the end of a range, and so at most two per range, has several
    partial results.
    """
    order = ["conv_id", "turn", "role", "h"]
    ranges = _narrow(turns).repartitionByRange(*order).sortWithinPartitions(*order)
    partials = stored(ranges.mapInArrow(_scan, PARTIAL), "turn-partials")
    done = None
    while True:
        several = partials.groupBy("conv_id").agg(F.count("*").alias("_c")).where("_c > 1").select(F.col("conv_id").alias("_id"))
        again = F.col("conv_id").eqNullSafe(F.col("_id"))
        alone = partials.join(several, again, "left_anti")
        done = alone if done is None else done.unionByName(alone)
        if several.isEmpty():
            return done
        pending = partials.join(several, again, "left_semi")
        partials = stored(pending.groupBy("conv_id", F.floor(F.col("part") / FAN_IN).alias("_p")).applyInPandas(_folded, PARTIAL), "turn-partials")


_best = "cost bigint, audit string"


def audits(turns: DataFrame) -> DataFrame:
    """(conv_id, blank, duplicate, truncated, illegal, gaps, cost, audit) of every conversation in (conv_id, turn, role, text)."""
    names = ["conv_id", "blank", "duplicate", "truncated", "illegal", "gaps"]

    def solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            found = [best(tuple(None if c < 0 else (c, a) for c, a in zip(cs, au))) for cs, au in zip(cells["costs"], cells["audits"])]
            columns = [pa.array(cells[n], pa.int64()) for n in names] + [pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "cost", "audit"])

    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    schema = ", ".join(f"{n} bigint" for n in names) + ", " + _best
    return scan(turns).withColumn("gaps", gaps).select(*names, "costs", "audits").mapInArrow(solve, schema)


# ------------------------------------------------------------------ repair


def _together(turns: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of one conversation in one task, in order, the audit before the turns."""
    rows = turns.select("conv_id", F.lit(1).alias("kind"), F.col("turn").cast("bigint").alias("turn"), "role", _md5("text").alias("h"), "text")
    heads = found.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("h"), F.col("audit").alias("text"))
    return rows.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "h").drop("h")


class _Replayed:
    """Walks an audit beside the turns of its conversation."""

    def __init__(self, audit: str) -> None:
        self.steps, self.waiting = replay(audit), None
        self._next(None)

    def _next(self, got: str | None) -> None:
        try:
            self.waiting = self.steps.send(got)
        except StopIteration:
            self.waiting = None

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.waiting and self.waiting[0] == "I":
            role = self.waiting[1]
            self._next(None)
            yield "I", role, ""

    def over(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit, other = self.waiting
        self._next(role[:1])
        if edit != "D":
            yield edit, other or role, text


def _lines(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, None) where a conversation begins, then (conv_id, (edit, role, text)) of every repaired turn."""
    walk, key = None, None
    for batch in batches:
        for conv_id, kind, _, role, text in zip(*[c.to_pylist() for c in batch.columns]):
            if kind == 0:
                if walk is not None:
                    yield from ((key, x) for x in walk.inserted())
                walk, key = _Replayed(text), conv_id
                yield key, None
            else:
                yield from ((key, x) for x in walk.over(role, text))
    if walk is not None:
        yield from ((key, x) for x in walk.inserted())


def repair(turns: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(conv_id, position, role, text, edit K, R or I) of the repaired conversations; `found` are their `audits`."""

    def solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
        out, position = [], 0
        for key, line in _lines(batches):
            if line is None:
                position = 0
                continue
            out.append((key, position, line[1], line[2], line[0]))
            position += 1
            if len(out) >= _OUT_ROWS:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)

    return _together(turns, audits(turns) if found is None else found).mapInArrow(solve, "conv_id bigint, position bigint, role string, text string, edit string")


def digests(turns: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the repaired `role:text` lines, hashed as they pass."""

    def solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
        out, digest, key, begun = [], None, None, False
        for conv_id, line in _lines(batches):
            if line is None:
                if digest is not None:
                    out.append((key, digest.hexdigest()))
                    if len(out) >= _OUT_ROWS:
                        yield _batch(out, schema)
                        out = []
                digest, key, begun = hashlib.sha256(), conv_id, False
                continue
            digest.update(f"{chr(10) if begun else ''}{line[1]}:{line[2]}".encode())
            begun = True
        if digest is not None:
            out.append((key, digest.hexdigest()))
        if out:
            yield _batch(out, schema)

    return _together(turns, found).mapInArrow(solve, "conv_id bigint, repaired_sha256 string")


def report(conversations: DataFrame) -> DataFrame:
    """A row per conversation of the undamaged table: faults, cost, audit and digest of the repaired turns."""
    turns = damaged(conversations.select("conv_id", "turn", "role", "text"))
    found = stored(audits(turns), "turn-audits")
    every = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    done = digests(turns, found)
    out = every.join(found.withColumnRenamed("conv_id", "_f"), F.col("conv_id").eqNullSafe(F.col("_f")), "left").join(done.withColumnRenamed("conv_id", "_d"), F.col("conv_id").eqNullSafe(F.col("_d")), "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select("conv_id", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
