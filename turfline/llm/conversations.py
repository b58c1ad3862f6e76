"""Repair of conversation structure by a dynamic program over persistent edit paths.

Each state of the program holds the cheapest edits that lead to it as a node of a tree: the node
has the last edit, a rolling hash of all edits from the root, and its ancestors 1, 2, 4, ... steps
up. Paths share their common beginnings. Equally cheap paths are compared where they first differ,
which binary lifting over the hashes finds in logarithmic time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turfline.llm.store import map_arrow, stored

#: White space of the blank test.
SPACE = " \t\n\x0b\x0c\r"

#: Faults of a row, the first that applies.
FINE, TRUNCATED, DUPLICATE, BLANK = 0, 1, 2, 3
#: Costs of the edits; KEEP and REROLE cost one more in a truncated row.
KEEP, REROLE, DELETE, INSERT = "KRDI"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
#: States: no row yet, after a system row, after a user row, after an assistant row.
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: States that may end a conversation, and where the initial of a kept row leads.
FINAL = (NONE, ASSISTANT)
NEXT = {"s": {NONE: SYSTEM}, "u": {NONE: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: Where a row of the role that fits (REROLE, INSERT) leads.
FITTING = {NONE: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
LEGAL = {"su", "ua", "au"}

_PRIME, _BASE = (1 << 61) - 1, 1_000_003
#: Rows after which the beginning that all paths share is written off.
SETTLE = 4096


class Path:
    """A list of edits as a node: its last edit, its length, a hash of all, and ancestors at distances 1, 2, 4, ..."""

    __slots__ = ("edit", "length", "hash", "up")

    def __init__(self, parent: Path | None, edit: str):
        self.edit = edit
        if parent is None:
            self.length, self.hash, self.up = 0, 0, []
            return
        self.length = parent.length + 1
        self.hash = (parent.hash * _BASE + ord(edit)) % _PRIME
        up, node, k = [parent], parent, 0
        while len(node.up) > k:
            node = node.up[k]
            up.append(node)
            k += 1
        self.up = up

    def ancestor(self, length: int) -> Path:
        node = self
        while node.length > length:
            step = (node.length - length).bit_length() - 1
            node = node.up[step]
        return node

    def edits(self, after: int = 0) -> str:
        """The edits beyond the first ``after``."""
        letters, node = [], self
        while node.length > after:
            letters.append(node.edit)
            node = node.up[0]
        return "".join(reversed(letters))


def _same(a: Path, b: Path) -> bool:
    """Whether two paths of one length and hash are equal, edit by edit. Equal ones are made to share
    their ancestors, so the next comparison ends where this one began."""
    x, y = a, b
    while x is not y:
        if x.edit != y.edit or x.hash != y.hash:
            return False
        if not x.length:
            break
        x, y = x.up[0], y.up[0]
    if a is not b:
        b.up = a.up
    return True


def less(a: Path, b: Path) -> bool:
    """Whether the edits of ``a`` come before those of ``b``, by letters; a beginning comes before the whole."""
    if a is b:
        return False
    n = min(a.length, b.length)
    x, y = a.ancestor(n), b.ancestor(n)
    if x is y or (x.hash == y.hash and _same(x, y)):
        return a.length < b.length
    left, right = x, y
    for k in range(max(len(x.up), 1) - 1, -1, -1):  # up to the first edit that differs
        if k < len(x.up) and k < len(y.up) and x.up[k] is not y.up[k] and x.up[k].hash != y.up[k].hash:
            x, y = x.up[k], y.up[k]
    if x.up:
        p, q = x.up[0], y.up[0]
        if x.edit == y.edit or not _same(p, q):  # a collision of hashes: compare edit by edit
            return left.edits() < right.edits()
    return x.edit < y.edit


class Repair:
    """The dynamic program over the rows of one conversation, one row at a time."""

    def __init__(self):
        self.cells: dict[int, tuple[int, Path]] = {NONE: (0, Path(None, ""))}
        self.done: list[str] = []
        self.settled = self.rows = 0
        self._insert()

    def _offer(self, cells: dict, state: int, cost: int, path: Path, edit: str) -> None:
        """Keeps the better one of a state: the cheaper, or of equally cheap ones the ASCII-least."""
        old = cells.get(state)
        if old is None or cost < old[0]:
            cells[state] = (cost, Path(path, edit))
        elif cost == old[0]:
            new = Path(path, edit)
            if less(new, old[1]):
                cells[state] = (cost, new)

    def _insert(self) -> None:
        """Rows inserted here: at most a user and an assistant row lead to a state that was dearer."""
        for state in (NONE, SYSTEM, ASSISTANT, USER):
            if state in self.cells:
                cost, path = self.cells[state]
                self._offer(self.cells, FITTING[state], cost + COST[INSERT], path, INSERT)

    def add(self, initial: str, fault: int) -> None:
        cells: dict[int, tuple[int, Path]] = {}
        extra = 1 if fault == TRUNCATED else 0
        for state, (cost, path) in self.cells.items():
            self._offer(cells, state, cost + COST[DELETE], path, DELETE)
            if fault < DUPLICATE:
                kept = NEXT.get(initial, {}).get(state)
                if kept is not None:
                    self._offer(cells, kept, cost + COST[KEEP] + extra, path, KEEP)
                self._offer(cells, FITTING[state], cost + COST[REROLE] + extra, path, REROLE)
        self.cells = cells
        self._insert()
        self._drop()
        self.rows += 1
        if self.rows % SETTLE == 0:
            self._settle()

    def _drop(self) -> None:
        """Drops states that cannot win any more. What follows an assistant row may also be what follows
        a system row, and what follows no row but for a system row, which it takes one more deletion to be rid of."""
        after = self.cells[ASSISTANT][0] if ASSISTANT in self.cells else None
        for state, more in ((NONE, COST[DELETE]), (SYSTEM, 0)):
            if after is not None and state in self.cells and self.cells[state][0] > after + more:
                del self.cells[state]

    def _settle(self) -> None:
        """Writes off the edits that all paths share, so that only the rest stays in memory."""
        paths = [path for _, path in self.cells.values()]
        n = min(p.length for p in paths)
        ends = [p.ancestor(n) for p in paths]
        for k in range(max(len(e.up) for e in ends) - 1, -1, -1):
            if all(k < len(e.up) for e in ends) and len({id(e.up[k]) for e in ends}) > 1:
                ends = [e.up[k] for e in ends]
        if len({id(e) for e in ends}) > 1:
            ends = [e.up[0] for e in ends]
        shared = ends[0]
        if shared.length == 0 or 2 * shared.length < n:
            return
        self.done.append(shared.edits())
        self.settled += shared.length
        root = Path(None, "")
        made: dict[tuple[int, str], Path] = {}
        for state, (cost, path) in self.cells.items():
            node = root
            for edit in path.edits(shared.length):
                if (id(node), edit) not in made:
                    made[id(node), edit] = Path(node, edit)
                node = made[id(node), edit]
            self.cells[state] = (cost, node)

    def result(self) -> tuple[int, str]:
        """Cost and edits of the best path that ends well."""
        best: dict[int, tuple[int, Path]] = {}
        for state in FINAL:
            if state in self.cells:
                cost, path = self.cells[state]
                old = best.get(0)
                if old is None or cost < old[0] or (cost == old[0] and less(path, old[1])):
                    best[0] = (cost, path)
        cost, path = best[0]
        return cost, "".join(self.done) + path.edits()


def _keyed(rows: DataFrame, present: Column | None) -> DataFrame:
    """conv_id, turn, role, text (nulls: one space), digest of the text and whether the row is there."""
    here = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), here.alias("here"))
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256)))


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]


AUDITS = ("conv_id long, n_rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def audit_conversations(rows: DataFrame, present: Column | None = None) -> DataFrame:
    """One row for each conv_id (null: one conversation): n_rows, gaps, faults, illegal neighbours,
    cost and audit of its cheapest edits.

    Rows (conv_id, turn, role, text) go by turn, nulls first, then by role and the sha256 of the text;
    a null role or text is one space. A row where ``present`` is false or null only names
    its conversation; one without rows has zeros and an empty audit. Equal rows are duplicates but for
    the first. A role whose initial is not s, u or a can only be reroled or deleted. Other columns are
    not read. An empty frame gives an empty frame.

    Texts do not move: a row is a role, a digest and two flags. A conversation's rows come sorted
    to one task (the program is sequential), which holds the paths alone, not the rows.
    """
    rows = _keyed(rows, present)
    end = F.rtrim("text", F.lit(SPACE))
    narrow = rows.select("conv_id", "turn", "role", "digest", "here", (end == "").alias("blank"),
                         (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("open")).repartition("conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "here", "role", "digest").orderBy(_order()[0])) > 1
    fault = F.when(F.col("blank"), BLANK).when(F.col("again"), DUPLICATE).when(F.col("open"), TRUNCATED).otherwise(FINE)
    narrow = narrow.withColumn("again", again).sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *_order(), "again")
    narrow = narrow.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), "here")

    def audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one: Conversation | None = None
        for batch in batches:
            done = []
            for conv, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if one is None or one.conv != conv:
                    if one is not None:
                        done.append(one.row())
                    one = Conversation(conv)
                one.add(*row)
            if done:
                yield _audits(done)
        if one is not None:
            yield _audits([one.row()])

    return map_arrow(narrow, audit, AUDITS)


class Conversation:
    """Counts and edits of the conversation whose rows are passing."""

    def __init__(self, conv: int | None):
        self.conv, self.program = conv, Repair()
        self.faults = [0, 0, 0, 0]
        self.illegal = self.turns = 0
        self.first = self.last = self.before = None

    def add(self, turn: int | None, initial: str, fault: int, here: bool) -> None:
        if not here:
            return
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.turns = turn, self.turns + 1
        if self.before is not None and self.before + initial not in LEGAL:
            self.illegal += 1
        self.before = initial
        self.faults[fault] += 1
        self.program.add(initial, fault)

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        cost, audit = self.program.result()
        return (self.conv, self.program.rows, gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[TRUNCATED],
                self.illegal, cost, audit)


def _audits(rows: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in AUDITS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "audit" else pa.int64()) for n, c in zip(names, zip(*rows))], names=names)


def repaired_rows(rows: DataFrame, audits: DataFrame, present: Column | None = None) -> DataFrame:
    """The rows that ``audits`` leave: conv_id, position (from 0), edit (K, R or I), role, text.

    ``rows`` and ``present`` are those that were audited. The rows of a conversation lie in one
    partition, in order. Whole rows move once and stream past their conversation's audit.
    """
    none = {"kind": F.lit(1), "audit": F.lit(None).cast("string")}
    body = _keyed(rows, present).where("here").drop("here").withColumns(none)
    heads = audits.select("conv_id", F.lit(0).alias("kind"), "audit")
    both = body.unionByName(heads, allowMissingColumns=True).repartition("conv_id")
    both = both.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "kind", *_order()).select("conv_id", "kind", "role", "text", "audit")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one: Editor | None = None
        for batch in batches:
            out: list[tuple] = []  # conv_id, position, edit, role, row of the batch that gives the text
            kinds, roles = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for i, (conv, kind) in enumerate(zip(batch.column(0).to_pylist(), kinds)):
                if kind == 0:
                    one = Editor(conv, batch.column(4)[i].as_py())
                    out += one.inserts()
                else:
                    out += one.edit(roles[i], i)
            if out:
                convs, places, edits, given, at = zip(*out)
                texts = pc.fill_null(batch.column(3).take(pa.array(at, pa.int64())), "")
                yield pa.RecordBatch.from_arrays([pa.array(convs, pa.int64()), pa.array(places, pa.int64()), pa.array(edits), pa.array(given), texts],
                                                 names=["conv_id", "position", "edit", "role", "text"])

    return map_arrow(both, apply, "conv_id long, position long, edit string, role string, text string")


class Editor:
    """Applies the audit of a conversation to its rows as they pass."""

    def __init__(self, conv: int | None, audit: str):
        self.conv, self.audit, self.at, self.state, self.position = conv, audit, 0, NONE, 0

    def _emit(self, edit: str, role: str, state: int, row: int | None) -> tuple:
        self.state, self.position = state, self.position + 1
        return (self.conv, self.position - 1, edit, role, row)

    def _fitting(self, edit: str, row: int | None) -> tuple:
        state = FITTING[self.state]
        return self._emit(edit, "user" if state == USER else "assistant", state, row)

    def inserts(self) -> list[tuple]:
        """The rows that are inserted here."""
        out = []
        while self.at < len(self.audit) and self.audit[self.at] == INSERT:
            out.append(self._fitting(INSERT, None))
            self.at += 1
        return out

    def edit(self, role: str, row: int) -> list[tuple]:
        edit = self.audit[self.at]
        self.at += 1
        out = []
        if edit == KEEP:
            out.append(self._emit(KEEP, role, NEXT[role[0]][self.state], row))
        elif edit == REROLE:
            out.append(self._fitting(REROLE, row))
        return out + self.inserts()


def digest_conversations(repaired: DataFrame) -> DataFrame:
    """conv_id and the sha256 of ``role:text`` joined by line feeds, over rows as ``repaired_rows`` gives
    them (a conversation in one partition, in order). One batch is in memory at a time."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, current, done = None, None, []
        for batch in batches:
            for conv, place, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if sha is None or place == 0:
                    if sha is not None:
                        done.append((current, sha.hexdigest()))
                    sha, current = hashlib.sha256(), conv
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode())
            if done:
                yield table(done)
                done = []
        if sha is not None:
            yield table([(current, sha.hexdigest())])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        convs, digests = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(convs, pa.int64()), pa.array(digests)], names=["conv_id", "repaired_sha256"])

    return map_arrow(repaired.select("conv_id", "position", "role", "text"), digest, "conv_id long, repaired_sha256 string")


def damage(rows: DataFrame) -> DataFrame:
    """The rows with the faults that the query repairs, by the CRC-32 of ``conv_id:turn`` modulo 20 (nulls: one
    space): 0 drops the row (``here`` false), 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 sets the role user."""
    of = lambda c: F.coalesce(F.col(c).cast("long").cast("string"), F.lit(" "))
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
                       (F.crc32(F.concat(of("conv_id"), F.lit(":"), of("turn"))) % 20).alias("_fault"))
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("_fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       (F.col("_fault") != 0).alias("here"), F.array_repeat(F.lit(0), F.when(F.col("_fault") == 3, 2).otherwise(1)).alias("_copies"))
    return rows.withColumn("_copies", F.explode("_copies")).drop("_copies")


def repair_report(rows: DataFrame, present: Column | None = None) -> DataFrame:
    """The audit of every conversation with the digest of what is left of it (nothing: of the empty string)."""
    audits = stored(audit_conversations(rows, present), "audits")
    digests = digest_conversations(repaired_rows(rows, audits, present)).withColumnRenamed("conv_id", "_conv")
    joined = audits.join(digests, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    return joined.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)))
