"""Repair of damaged conversations: a grammar-compressed dynamic programme.

1. Rows are sorted by conversation and turn, in ranges, so that a conversation of
   any length is dealt to several tasks. A row becomes one of nine symbols, of its
   role's initial and its fault.
2. A chunk is up to ``CHUNK`` symbols of one conversation. Equal chunks are one.
3. Re-Pair: in rounds the most frequent pairs of neighbours become rules, in all
   chunks at once. A round counts pairs in the tasks and takes up to
   ``RULES_A_ROUND`` of those that occur twice; no pair that occurs once is a rule.
4. Each rule has one min-plus transfer matrix: from the state of the repaired
   roles before its symbols to the state after, the least cost and its audit. The
   audit is a rope of the audits of the rule's two parts. Matrices are evaluated
   bottom-up, once, and shared by all chunks of all conversations.
5. A chunk's matrix is the product of those of its few symbols; a conversation's
   cost and audit come from its chunks' matrices, one after another.
6. The audit is played on the conversation's texts.

Of two audits of the same rows with the same cost between the same states none is
a prefix of the other: the longer one would only insert more, at a cost. So the
least of concatenations is the concatenation of the least, as rules need it.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import SPACES, once_a_worker, stored

# Fixed values of the contract: what the edits cost.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}

CHUNK = 4096
RULES_A_ROUND = 256
# Rounds and rules bound the grammar that is broadcast; more would only compress better.
ROUNDS = 12

# States: nothing kept yet, then the initial of the last row.
START, SYSTEM, USER, ASSISTANT = range(4)
# Where a row of each initial may lead.
_NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
# Symbols: initial s, u, a or other, whole or truncated; and rows that must go.
_INITIALS = "sua"
GONE = 8
SYMBOLS = 9

Rope = str | tuple
# matrix[i][j]: the least cost from state i to j and its audit, or None.
Matrix = list[list[tuple[int, Rope] | None]]


def _flat(rope: Rope) -> str:
    out, todo = [], [rope]
    while todo:
        own = todo.pop()
        if isinstance(own, str):
            out.append(own)
        else:
            todo += reversed(own)
    return "".join(out)


def _before(a: Rope, b: Rope) -> bool:
    """Whether one rope's text is less than another's; what they share is not looked at."""
    left, right = [a], [b]
    while left and right:
        x, y = left.pop(), right.pop()
        if x is y:
            continue
        if isinstance(x, tuple):
            left += reversed(x)
            right.append(y)
        elif isinstance(y, tuple):
            right += reversed(y)
            left.append(x)
        else:
            n = min(len(x), len(y))
            if x[:n] != y[:n]:
                return x < y
            if x[n:]:
                left.append(x[n:])
            if y[n:]:
                right.append(y[n:])
    return any(map(_flat, right)) and not any(map(_flat, left))


def _least(one, other):
    """The cheaper of two entries, or the one whose audit is less."""
    if one is None or other is None:
        return one or other
    if one[0] != other[0]:
        return min(one, other, key=lambda e: e[0])
    return other if _before(other[1], one[1]) else one


def _joined(a: Rope, b: Rope) -> Rope:
    if not a or not b:
        return a or b
    return a + b if isinstance(a, str) and isinstance(b, str) and len(a) + len(b) < 32 else (a, b)


def _times(x: Matrix, y: Matrix) -> Matrix:
    return [_through(row, y) for row in x]


def _through(row: list, y: Matrix) -> list:
    """One row of states, taken through a matrix."""
    out: list = [None] * len(y)
    for k, first in enumerate(row):
        if first is not None:
            for j, second in enumerate(y[k]):
                if second is not None:
                    out[j] = _least(out[j], (first[0] + second[0], _joined(first[1], second[1])))
    return out


def _inserts() -> Matrix:
    """What insertions alone do; none is ever cheaper than the fewest."""
    out: Matrix = [[None] * 4 for _ in range(4)]
    for state in range(4):
        at, n = state, 0
        while out[state][at] is None:
            out[state][at] = (INSERT * n, "I" * n)
            at, n = _NEXT["a" if at == USER else "u"][at], n + 1
    return out


INSERTS = _inserts()


def symbol(initial: str, truncated: bool) -> int:
    """The symbol of a row that may stay."""
    return 2 * (_INITIALS.find(initial) if initial and initial in _INITIALS else 3) + truncated


def _row_matrix(own: int) -> Matrix:
    """Insertions, then what may become of one row."""
    out: Matrix = [[None] * 4 for _ in range(4)]
    for state in range(4):
        out[state][state] = (DELETE, "D")
    if own != GONE:
        initial, more = (*_INITIALS, "")[own // 2], TRUNCATED * (own % 2)
        ways = [(_NEXT.get(initial, {}), (more, "K")), *((_NEXT[r], (REROLE + more, "R")) for r in ROLES)]
        for leads, entry in ways:
            for state, to in leads.items():
                out[state][to] = _least(out[state][to], entry)
    return _times(INSERTS, out)


def matrices(rules: list[tuple[int, int]]) -> list[Matrix]:
    """The matrix of each symbol and, bottom-up, of each rule."""
    out = [_row_matrix(s) for s in range(SYMBOLS)]
    for left, right in rules:
        out.append(_times(out[left], out[right]))
    return out


def _ended(row: list) -> tuple[int, str]:
    """Cost and audit of a whole conversation: nothing is left of it, or it ends with the assistant."""
    row = _through(row, INSERTS)
    cost, audit = _least(row[START], row[ASSISTANT])
    return cost, _flat(audit)


def replaced(symbols: list[int], pairs: dict[tuple[int, int], int]) -> list[int]:
    """The symbols with pairs replaced by their rules, from left to right."""
    out, i, last = [], 0, len(symbols) - 1
    while i <= last:
        rule = pairs.get((symbols[i], symbols[i + 1])) if i < last else None
        out.append(symbols[i] if rule is None else rule)
        i += 1 if rule is None else 2
    return out


def _pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of neighbours in the chunks of a task, each pair counted once for every two of a run."""
    counts: Counter = Counter()
    for batch in batches:
        for symbols in batch.column(0).to_pylist():
            last = None
            for pair in zip(symbols, symbols[1:], strict=False):
                # Of three equal symbols only one pair can be replaced.
                if pair == last and pair[0] == pair[1]:
                    last = None
                    continue
                counts[pair] += 1
                last = pair
    columns = [pa.array([p[0] for p in counts], pa.int32()), pa.array([p[1] for p in counts], pa.int32()), pa.array(counts.values(), pa.int64())]
    yield pa.RecordBatch.from_arrays(columns, names=["x", "y", "n"])


def _replace(pairs: dict[tuple[int, int], int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [replaced(s, pairs) for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.list_(pa.int32()))], names=["chunk", "symbols"])

    return run


def grammar(chunks: DataFrame) -> tuple[list[tuple[int, int]], DataFrame]:
    """The rules of Re-Pair over ``chunks`` (``chunk``, ``symbols``), and the chunks in their symbols.

    The driver gets the pairs that become rules, ``RULES_A_ROUND`` a round at most.
    """
    rules: list[tuple[int, int]] = []
    for _ in range(ROUNDS):
        pairs = chunks.select("symbols").mapInArrow(_pairs_of, "x int, y int, n long").groupBy("x", "y").agg(F.sum("n").alias("n"))
        best = pairs.where("n > 1").orderBy(F.desc("n"), "x", "y").limit(RULES_A_ROUND).collect()
        if not best:
            break
        new = {(r.x, r.y): SYMBOLS + len(rules) + i for i, r in enumerate(best)}
        rules += new
        chunks = stored(chunks.mapInArrow(_replace(new), "chunk string, symbols array<int>"))
    return rules, chunks


_BLANK = rf"[^{SPACES}]"
_MARKS = ".!?"


def _content() -> Column:
    """A hash of role and text."""
    return F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))


def _facts(rows: DataFrame) -> DataFrame:
    """What the programme needs of each row in place of its text."""
    text = F.col("text")
    last = F.substring(F.regexp_replace(text, rf"[{SPACES}]+$", ""), -1, 1)
    return rows.select(
        "conv_id",
        "turn",
        "role",
        F.substring("role", 1, 1).alias("initial"),
        (~text.rlike(_BLANK)).alias("blank"),
        (~last.isin(*_MARKS)).alias("truncated"),
        _content().alias("own"),
    )


ORDER = ["conv_id", "turn", "role", "own"]


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows, numbered in their partition; ``again`` if role and text came earlier in it."""
    part, at, conv, seen = TaskContext.get().partitionId(), 0, (), set()
    for batch in batches:
        again = []
        for own, blank, content in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "blank", "own")), strict=True):
            if own != conv:
                conv, seen = own, set()
            again.append(not blank and content in seen)
            seen.add(content)
        n = batch.num_rows
        names = ["conv_id", "turn", "initial", "blank", "truncated", "own"]
        columns = [*(batch.column(c) for c in names), pa.array(again, pa.bool_()), pa.array([part] * n, pa.int32()), pa.array(range(at, at + n), pa.int64())]
        at += n
        yield pa.RecordBatch.from_arrays(columns, names=[*names, "again", "part", "place"])


_SWEPT = "conv_id long, turn long, initial string, blank boolean, truncated boolean, own binary, again boolean, part int, place long"


def _judged(rows: DataFrame) -> DataFrame:
    """Rows with ``duplicate``, whichever partitions of the sorted rows they are in."""
    firsts = rows.where("NOT again AND NOT blank")
    # Contents that the ranges of one conversation have several times.
    least = firsts.groupBy("conv_id", "own").agg(F.min("part").alias("first"), F.count("*").alias("k")).where("k > 1").drop("k")
    least = least.select(F.col("conv_id").alias("_conv"), F.col("own").alias("_own"), "first")
    joined = firsts.join(least, firsts["conv_id"].eqNullSafe(least["_conv"]) & (firsts["own"] == least["_own"]), "left")
    judged = joined.withColumn("duplicate", F.coalesce(F.col("part") > F.col("first"), F.lit(False)))
    columns = ["conv_id", "turn", "initial", "blank", "truncated", "part", "place", "duplicate"]
    rest = rows.where("again OR blank").withColumn("duplicate", F.col("again"))
    return judged.select(*columns).unionByName(rest.select(*columns))


_CHUNKS = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("part", pa.int32()),
        ("chunk_no", pa.int64()),
        ("chunk", pa.string()),
        ("symbols", pa.list_(pa.int32())),
        *((name, pa.int64()) for name in ("n_blank", "n_duplicate", "n_truncated", "illegal")),
        ("first_initial", pa.string()),
        ("last_initial", pa.string()),
        *((name, pa.int64()) for name in ("first_turn", "last_turn", "turns")),
    ]
)
_CHUNKS_TYPE = (
    "conv_id long, part int, chunk_no long, chunk string, symbols array<int>, n_blank long, n_duplicate long, n_truncated long,"
    " illegal long, first_initial string, last_initial string, first_turn long, last_turn long, turns long"
)
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk's symbols, faults and ends."""
    for batch in batches:
        out = []
        for chunk in batch.to_pylist():
            rows = chunk["rows"]
            symbols, faults = [], Counter()
            for r in rows:
                fault = "blank" if r["blank"] else "duplicate" if r["duplicate"] else "truncated" if r["truncated"] else None
                faults[fault] += 1
                symbols.append(GONE if fault in ("blank", "duplicate") else symbol(r["initial"], fault == "truncated"))
            initials = [r["initial"] for r in rows]
            illegal = sum(pair not in LEGAL for pair in zip(initials, initials[1:], strict=False))
            turns = [r["turn"] for r in rows if r["turn"] is not None]
            out.append(
                {
                    **{k: chunk[k] for k in ("conv_id", "part", "chunk_no")},
                    "chunk": "".join(map(str, symbols)),
                    "symbols": symbols,
                    **{f"n_{name}": faults[name] for name in ("blank", "duplicate", "truncated")},
                    "illegal": illegal,
                    "first_initial": initials[0],
                    "last_initial": initials[-1],
                    "first_turn": min(turns, default=None),
                    "last_turn": max(turns, default=None),
                    "turns": len(set(turns)),
                }
            )
        yield pa.RecordBatch.from_pylist(out, schema=_CHUNKS)


def _solved(rules: list[tuple[int, int]]):
    """Each chunk's matrix: costs by states, -1 where there is no way, and audits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = once_a_worker(("matrices", tuple(rules)), lambda: matrices(rules))
        for batch in batches:
            costs, audits = [], []
            for symbols in batch.column(1).to_pylist():
                whole = shared[symbols[0]]
                for s in symbols[1:]:
                    whole = _times(whole, shared[s])
                entries = [e for row in whole for e in row]
                costs.append([-1 if e is None else e[0] for e in entries])
                audits.append(["" if e is None else _flat(e[1]) for e in entries])
            columns = [batch.column(0), pa.array(costs, pa.list_(pa.int64())), pa.array(audits, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["chunk", "costs", "audits"])

    return run


_TOTALS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_FOLDED = pa.schema([("conv_id", pa.int64()), *((name, pa.int64()) for name in _TOTALS), ("audit", pa.string())])
_FOLDED_TYPE = f"conv_id long, {', '.join(f'{name} long' for name in _TOTALS)}, audit string"
_LONG = (1 << 63) - 1


class _Conversation:
    """What is known of a conversation after some of its chunks."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.row = conv_id, [(0, ""), None, None, None]
        self.counts: Counter = Counter()
        self.last, self.first_turn, self.last_turn, self.turns = None, None, None, 0

    def add(self, chunk: dict) -> None:
        for name in ("blank", "duplicate", "truncated"):
            self.counts[name] += chunk[f"n_{name}"]
        self.counts["illegal"] += chunk["illegal"]
        if self.last is not None:
            self.counts["illegal"] += (self.last, chunk["first_initial"]) not in LEGAL
        self.last = chunk["last_initial"]
        if chunk["turns"]:
            self.turns += chunk["turns"] - (self.last_turn == chunk["first_turn"])
            self.first_turn = chunk["first_turn"] if self.first_turn is None else self.first_turn
            self.last_turn = chunk["last_turn"]
        costs, audits = chunk["costs"], chunk["audits"]
        whole = [[None if costs[4 * i + j] < 0 else (costs[4 * i + j], audits[4 * i + j]) for j in range(4)] for i in range(4)]
        self.row = _through(self.row, whole)

    def result(self) -> dict:
        gaps = min(_LONG, self.last_turn - self.first_turn + 1 - self.turns) if self.turns else 0
        cost, audit = _ended(self.row)
        return {"conv_id": self.conv_id, "gaps": gaps, **{k: self.counts[k] for k in _TOTALS[1:5]}, "cost": cost, "audit": audit}


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The conversations of a partition, whose chunks come in order; a chunk without symbols names a conversation."""
    own: _Conversation | None = None
    for batch in batches:
        done = []
        for chunk in batch.to_pylist():
            if own is None or chunk["conv_id"] != own.conv_id:
                if own is not None:
                    done.append(own.result())
                own = _Conversation(chunk["conv_id"])
            if chunk["costs"] is not None:
                own.add(chunk)
        yield pa.RecordBatch.from_pylist(done, schema=_FOLDED)
    if own is not None:
        yield pa.RecordBatch.from_pylist([own.result()], schema=_FOLDED)


def _played(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each repaired conversation, row after row; its audit comes ahead of its rows."""
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    own = None

    def inserted() -> None:
        while own["at"] < len(own["audit"]) and own["audit"][own["at"]] == "I":
            own["at"] += 1
            say("a" if own["state"] == USER else "u", "", "")

    def say(initial: str, role: str, text: str) -> None:
        own["digest"].update(f"{own['mark']}{role or ROLES[initial]}:{text}".encode())
        own["mark"], own["state"] = "\n", _NEXT[initial][own["state"]]

    def ended() -> dict:
        inserted()
        return {"conv_id": own["conv_id"], "repaired_sha256": own["digest"].hexdigest()}

    for batch in batches:
        done = []
        for conv_id, audit, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text")), strict=True):
            if audit is not None:
                if own is not None:
                    done.append(ended())
                own = {"conv_id": conv_id, "audit": audit, "at": 0, "state": START, "mark": "", "digest": hashlib.sha256()}
                continue
            inserted()
            edit = own["audit"][own["at"]]
            own["at"] += 1
            if edit == "K":
                say(role[0], role, text)
            elif edit == "R":
                say("a" if own["state"] == USER else "u", "", text)
        yield pa.RecordBatch.from_pylist(done, schema=schema)
    if own is not None:
        yield pa.RecordBatch.from_pylist([ended()], schema=schema)


def repaired(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """The faults of each conversation, its cheapest repair and the digest of what that makes of it.

    ``rows`` has ``conv_id``, ``turn``, ``role`` and ``text``, a null role or
    text counting as one space; ``conversations`` names those to return by
    ``conv_id``, repeated or not, also if they have no rows. Rows are taken by
    turn, null first; those of one turn by role and a hash of role and text.
    Repeated rows are rows each, and duplicates. Rows without a ``conv_id`` are
    one conversation. An empty table of conversations gives an empty result;
    other columns are left out.

    ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``,
    ``audit`` and ``repaired_sha256`` are those of the task: the digest of a
    conversation is made in one task, which holds its audit and one row.
    """
    blank = F.lit(" ")
    given = {"role": F.coalesce(F.col("role").cast("string"), blank), "text": F.coalesce(F.col("text").cast("string"), blank)}
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *(c.alias(n) for n, c in given.items()))
    names = conversations.select(F.col("conv_id").cast("long")).distinct()
    keys = [F.col(c).asc_nulls_first() for c in ORDER]
    ordered = _facts(rows).repartitionByRange(*keys).sortWithinPartitions(*keys)
    swept = stored(ordered.mapInArrow(_swept, _SWEPT))
    chunks = _judged(swept).groupBy("conv_id", "part", F.floor(F.col("place") / CHUNK).alias("chunk_no"))
    chunks = chunks.agg(F.sort_array(F.collect_list(F.struct("place", "turn", "initial", "blank", "duplicate", "truncated"))).alias("rows"))
    chunks = stored(chunks.mapInArrow(_described, _CHUNKS_TYPE))
    rules, packed = grammar(stored(chunks.groupBy("chunk").agg(F.first("symbols").alias("symbols"))))
    solved = stored(packed.mapInArrow(_solved(rules), "chunk string, costs array<long>, audits array<string>"))
    known = chunks.drop("symbols").join(solved, "chunk").drop("chunk")
    stubs = names.withColumns({"part": F.lit(-1), "chunk_no": F.lit(-1).cast("long")})
    dealt = stubs.unionByName(known, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "part", "chunk_no")
    folded = stored(dealt.mapInArrow(_folded, _FOLDED_TYPE))
    played = rows.withColumn("own", _content())
    played = folded.select("conv_id", "audit").unionByName(played, allowMissingColumns=True)
    first = F.col("audit").isNull()
    order = [F.col("conv_id"), first, *(F.col(c).asc_nulls_first() for c in ORDER[1:])]
    digests = played.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "audit", "role", "text")
    digests = digests.mapInArrow(_played, "conv_id long, repaired_sha256 string").withColumnRenamed("conv_id", "_conv")
    return folded.join(digests, folded["conv_id"].eqNullSafe(digests["_conv"])).drop("_conv")
