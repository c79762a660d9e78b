"""Conversation structure repair: cheapest edits by a Viterbi search that emits them once all survivors share an ancestor."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Costs of the edits, and what a truncated row adds that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
SPACE, STOPS = " \t\n\x0b\x0c\r", ".!?"
#: States: nothing yet, after the system row, after a user row, after an assistant row. The first and the last may end.
START, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (START, ASSISTANT)
#: Where a user row may follow; an assistant row follows a user row, a system row only the start.
BEFORE_USER = (START, SYSTEM, ASSISTANT)
#: What a state can cost more than another for the same rest of a conversation, row: in place of, column: the other.
#: In place of the start, say, a search after an assistant row has to delete a system row that the start could keep.
DETOUR = (
    (0, 0, 5, 0),
    (10, 0, 5, 10),
    (7, 5, 0, 5),
    (2, 0, 5, 0),
)
ROLES = {USER: "user", ASSISTANT: "assistant"}


@dataclass(slots=True)
class Turn:
    """A row of a conversation: its turn, role and text, and its first fault, empty if it has none."""

    turn: int | None
    role: str
    text: str
    fault: str = ""


@dataclass(slots=True)
class Edit:
    """``K``, ``R``, ``D`` or ``I``, with the row it is about (none for an inserted one) and the role of the result."""

    kind: str
    row: Turn | None
    role: str | None


class Node:
    """A place in the tree of back pointers: the edit that led here, its parent, and how many nodes and survivors point here."""

    __slots__ = ("children", "edit", "parent", "refs")

    def __init__(self, parent: Node | None, edit: Edit | None):
        self.parent, self.edit, self.refs, self.children = parent, edit, 0, []
        if parent is not None:
            parent.refs += 1
            parent.children.append(self)


class Search:
    """The cheapest edits of one conversation, row by row; of equal costs those whose initials come first.

    For each state the best way to it survives. A survivor ends with the edit of the last row, inserted rows belong to the
    next one; so of two survivors' edits neither begins the other's, and adding the same edits to both keeps their order.
    The comparison of the complete unresolved suffixes is therefore carried along as the survivors' order (``rank``): a tie
    between two ways is decided by the order of the survivors they come from and then by the letters of this row.

    Survivors that another one undercuts by more than any detour are dropped. Nodes without references leave the tree; while
    its root has a single child and is no survivor itself, the child's edit is settled and handed out, and the child becomes
    the root. What is held are the edits after the survivors' last common ancestor.
    """

    def __init__(self):
        self.root = Node(None, None)
        self.root.refs = 1
        #: state to (cost, rank, node)
        self.best: dict[int, tuple[int, int, Node]] = {START: (0, 0, self.root)}
        self.held = self.most_held = 0

    def _ways(self) -> dict[int, tuple[int, tuple[int, str], Node, tuple[int, ...]]]:
        """State to (cost, order, survivor, rows inserted) of the best way there without or with insertions after the last row."""
        ways = {s: (cost, (rank, ""), node, ()) for s, (cost, rank, node) in self.best.items()}

        def offer(target: int, sources: tuple[int, ...]) -> None:
            for s in sources:
                if s in ways:
                    cost, (rank, letters), node, rows = ways[s]
                    way = (cost + INSERT, (rank, letters + "I"), node, (*rows, target))
                    if target not in ways or way[:2] < ways[target][:2]:
                        ways[target] = way

        offer(USER, BEFORE_USER)
        offer(ASSISTANT, (USER,))
        return ways

    def add(self, row: Turn) -> Iterator[Edit]:
        """Take the next row; give the edits that are settled now."""
        ways, found = self._ways(), {}

        def offer(target: int, source: int, kind: str, price: int, role: str | None) -> None:
            if source in ways:
                cost, (rank, letters), node, rows = ways[source]
                way = (cost + price, (rank, letters + kind), node, rows, kind, role)
                if target not in found or way[:2] < found[target][:2]:
                    found[target] = way

        for s in range(4):
            offer(s, s, "D", DELETE, None)
        if row.fault not in ("blank", "duplicate"):
            more = TRUNCATED if row.fault == "truncated" else 0
            initial = row.role[:1]
            if initial == "s":
                offer(SYSTEM, START, "K", KEEP + more, row.role)
            for target, sources in ((USER, BEFORE_USER), (ASSISTANT, (USER,))):
                for s in sources:
                    if initial == ROLES[target][0]:
                        offer(target, s, "K", KEEP + more, row.role)
                    offer(target, s, "R", REROLE + more, ROLES[target])
        needed = [s for s, way in found.items() if not any(other[0] + DETOUR[o][s] < way[0] for o, other in found.items())]
        old = [node for _, _, node in self.best.values()]
        self.best = {}
        for rank, s in enumerate(sorted(needed, key=lambda s: found[s][1])):
            cost, _, node, rows, kind, role = found[s]
            for inserted in rows:
                node = self._grown(node, Edit("I", None, ROLES[inserted]))
            node = self._grown(node, Edit(kind, row, role))
            node.refs += 1
            self.best[s] = (cost, rank, node)
        for node in old:
            self._drop(node)
        self.most_held = max(self.most_held, self.held)
        yield from self._settled()

    def _grown(self, node: Node, edit: Edit) -> Node:
        self.held += 1
        return Node(node, edit)

    def _drop(self, node: Node) -> None:
        """A survivor less at ``node``; nodes that nothing points to go, up to the first that something does."""
        node.refs -= 1
        while node.refs == 0 and node.parent is not None:
            parent = node.parent
            parent.children.remove(node)
            parent.refs -= 1
            self.held -= 1
            node = parent

    def _settled(self) -> Iterator[Edit]:
        """The edits that all survivors share, which the tree then forgets."""
        while self.root.refs == 1 and self.root.children:
            self.root = self.root.children[0]
            self.root.parent = None
            self.held -= 1
            yield self.root.edit

    def end(self) -> Iterator[Edit]:
        """The edits that were still open, after the last row."""
        ways = self._ways()
        _, _, node, rows = min((ways[s] for s in FINAL if s in ways), key=lambda way: way[:2])
        path = []
        while node is not self.root:
            path.append(node.edit)
            node = node.parent
        yield from reversed(path)
        for inserted in rows:
            yield Edit("I", None, ROLES[inserted])


def repair_turns(turns: Iterator[Turn]) -> Iterator[Edit]:
    """The cheapest edits of one conversation, in order, given out as soon as they are settled."""
    search = Search()
    for turn in turns:
        yield from search.add(turn)
    yield from search.end()


def fault_of(text: str, repeated: bool) -> str:
    """A row's first fault: blank, duplicate, truncated or none."""
    inside = text.strip(SPACE)
    if not inside:
        return "blank"
    if repeated:
        return "duplicate"
    return "" if inside[-1] in STOPS else "truncated"


def damage(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, dropped``: rows damaged by the check sum of ``conv_id:turn`` modulo 20; nulls are one space.

    0 marks a row as dropped, 1 empties its text, 2 removes its full stops, exclamation and question marks, 3 repeats it, 4
    makes its role user.
    """
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    name = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit(" ")) for c in (conv, turn)])
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    kind = F.crc32(name) % 20
    rows = turns.select(
        conv.alias("conv_id"),
        turn.alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (kind == 0).alias("dropped"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return rows.drop("copy")


_ROWS = "conv_id long, turn long, was string, text string, fault string, edit string, role string"
_EDITS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("was", pa.string()), ("text", pa.string()), ("fault", pa.string()), ("edit", pa.string()), ("role", pa.string())])
_DIGEST = pa.schema(
    [("conv_id", pa.int64())]
    + [(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    + [("audit", pa.string()), ("repaired_sha256", pa.string())]
)
#: Rows, and characters of text, after which a batch of edits is handed on.
BATCH_ROWS, BATCH_CHARS = 8192, 1 << 22


def _batched(rows: Iterator[tuple], schema: pa.Schema, text: int | None = None) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[text] or "") if text is not None else 0
        if len(held) >= BATCH_ROWS or size >= BATCH_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], f.type) for k, f in enumerate(schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], f.type) for k, f in enumerate(schema)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch], step: int = 512) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield from zip(*[column.to_pylist() for column in batch.slice(at, step).columns], strict=True)


def _edit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of sorted rows ``conv_id, turn, role, text, dropped, later, repeated``; a conversation without rows gives one of nulls."""

    def named(conv: int | None, edits: Iterator[Edit]) -> Iterator[tuple]:
        for e in edits:
            if e.row is None:
                yield conv, None, None, "", "", e.kind, e.role
            else:
                yield conv, e.row.turn, e.row.role, e.row.text, e.row.fault, e.kind, e.role

    def run() -> Iterator[tuple]:
        search, conv, before, any_row = None, None, None, False
        for conv_id, turn, role, text, dropped, later, repeated in _rows(batches):
            if search is None or conv_id != conv:
                if search is not None:
                    yield from named(conv, search.end()) if any_row else [(conv, None, None, None, None, None, None)]
                search, conv, before, any_row = Search(), conv_id, None, False
            if dropped:
                continue
            any_row = True
            same = repeated and before == (turn, role, text)
            before = (turn, role, text)
            yield from named(conv, search.add(Turn(turn, role, text, fault_of(text, later or same))))
        if search is not None:
            yield from named(conv, search.end()) if any_row else [(conv, None, None, None, None, None, None)]

    return _batched(run(), _EDITS, text=3)


def repair(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, was, text, fault, edit, role``: the cheapest edits of each conversation, in order within it.

    ``turns`` has ``conv_id, turn, role, text`` and perhaps ``dropped``: rows for which it is true only say that their
    conversation exists. A conversation's rows are read by turn, nulls first, equal turns by role and text. Its repaired
    form, the rows of ``role: text`` whose edit isn't ``D``, is empty or has an optional system row and then user and
    assistant rows in turn. ``edit`` is ``K`` for a row that stays, ``R`` for one with another role (``was`` is the old one),
    ``D`` for one that goes (blank and duplicate rows have to), ``I`` for an empty row that was put in (turn and ``was`` are
    null). A conversation without rows has one row of nulls. Null roles and texts are one space; all null ids are one
    conversation; repeated rows are duplicates; further columns are ignored.

    Rows that repeat are found by a grouped digest, so a task needn't remember texts. A conversation is then streamed in
    order through one task, as its edits and the digest of its text follow one another; what the task holds are the edits
    that aren't settled yet. The result is partitioned by conversation and in order: read it without a shuffle.
    """
    dropped = F.coalesce(F.col("dropped").cast("boolean"), F.lit(False)) if "dropped" in [c.lower() for c in turns.columns] else F.lit(False)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    slim = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), dropped.alias("dropped"))
    named = slim.withColumn("same", F.sha2(F.concat_ws("|", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.length("role").cast("string"), "role", "text"), 256))
    seen = named.filter(~F.col("dropped")).groupBy("same").agg(F.count(F.lit(1)).alias("n"), F.min("turn").alias("turn"), F.max(F.col("turn").isNull()).alias("no_turn"))
    seen = seen.filter("n > 1").select("same", F.when(~F.col("no_turn"), F.col("turn")).alias("first_turn"), F.lit(True).alias("repeated"))
    told = named.join(seen, "same", "left")
    repeated = F.coalesce("repeated", F.lit(False))
    later = repeated & ~F.col("turn").eqNullSafe(F.col("first_turn"))
    told = told.select("conv_id", "turn", "role", "text", "dropped", later.alias("later"), repeated.alias("repeated"))
    ordered = told.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return ordered.mapInArrow(_edit_rows, _ROWS)


class _Digest:
    """Counts, audit and check sum of one conversation, from its edits in order."""

    PRICE = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.first = self.last = self.before = None
        self.turns = self.illegal = self.cost = 0
        self.audit, self.sha, self.lines = [], hashlib.sha256(), 0

    def add(self, turn: int | None, was: str | None, text: str, fault: str, edit: str, role: str | None) -> None:
        self.audit.append(edit)
        self.cost += self.PRICE[edit] + (TRUNCATED if fault == "truncated" and edit != "D" else 0)
        if fault:
            self.faults[fault] += 1
        if was is not None:
            if self.before is not None and self.before + was[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.before = was[:1]
            if turn is not None and turn != self.last:  # turns come in order
                self.first = turn if self.first is None else self.first
                self.last, self.turns = turn, self.turns + 1
        if edit != "D":
            self.sha.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            self.lines += 1

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return self.conv_id, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


def digests(edits: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of the result of ``repair``, streamed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            one = None
            for conv_id, turn, was, text, fault, edit, role in _rows(batches):
                if one is None or conv_id != one.conv_id:
                    if one is not None:
                        yield one.row()
                    one = _Digest(conv_id)
                if edit is not None:
                    one.add(turn, was, text, fault, edit, role)
            if one is not None:
                yield one.row()

        return _batched(rows(), _DIGEST, text=7)

    return edits.mapInArrow(run, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


#: The same in SQL: each state's whole string of edits and whole repaired text, row by row.
SQL = r"""
WITH RECURSIVE table_of(i, c, k) AS (
  SELECT i, i::BIGINT, 0 FROM range(256) AS t(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM table_of WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM table_of WHERE k = 8),
summed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))), '..'), lambda x: ('0x' || x)::BIGINT)),
                         lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS kind
  FROM conversations, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM summed)),
convs AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
ordered AS (
  SELECT c, turn, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i
  FROM damaged d JOIN convs ON d.conv_id IS NOT DISTINCT FROM convs.conv_id),
faulty AS (
  SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) AS earlier,
         CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][ 	-]*$') THEN 'truncated' ELSE '' END AS fault
  FROM ordered),
counted AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank')::BIGINT AS blank,
         count(*) FILTER (fault = 'duplicate')::BIGINT AS duplicate, count(*) FILTER (fault = 'truncated')::BIGINT AS truncated,
         count(*) FILTER (earlier IS NOT NULL AND earlier || initial NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal, count(*) AS n
  FROM faulty GROUP BY c),
search AS (
  SELECT c, 0::BIGINT AS i, {{'k': 0::BIGINT, 'w': '', 't': ''}} AS e, {none} AS s, {none} AS u, {none} AS a FROM convs
  UNION ALL
  SELECT c, i, {{'k': e.k + 2, 'w': e.w || 'D', 't': e.t}},
         least({{'k': s.k + 2, 'w': s.w || 'D', 't': s.t}}, CASE WHEN stays AND initial = 's' THEN {keep_e} ELSE {none} END),
         least({{'k': u1.k + 2, 'w': u1.w || 'D', 't': u1.t}}, CASE WHEN stays AND initial = 'u' THEN {keep_b} ELSE {none} END, CASE WHEN stays THEN {rerole_b} ELSE {none} END),
         least({{'k': a1.k + 2, 'w': a1.w || 'D', 't': a1.t}}, CASE WHEN stays AND initial = 'a' THEN {keep_u} ELSE {none} END, CASE WHEN stays THEN {rerole_u} ELSE {none} END)
  FROM (
    SELECT *, least(e, s, a1) AS b FROM (
      SELECT *, least(a, {{'k': u1.k + 5, 'w': u1.w || 'I', 't': u1.t || chr(10) || 'assistant:'}}) AS a1 FROM (
        SELECT p.c, f.i, e, s, u, a, role, text, initial, fault NOT IN ('blank', 'duplicate') AS stays, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS more,
               least(u, {{'k': least(e, s, a).k + 5, 'w': least(e, s, a).w || 'I', 't': least(e, s, a).t || chr(10) || 'user:'}}) AS u1
        FROM search p JOIN faulty f ON f.c = p.c AND f.i = p.i + 1)))),
ends AS (
  SELECT c, least(e, a, {{'k': u1.k + 5, 'w': u1.w || 'I', 't': u1.t || chr(10) || 'assistant:'}}) AS best
  FROM (SELECT p.*, least(u, {{'k': least(s, a).k + 5, 'w': least(s, a).w || 'I', 't': least(s, a).t || chr(10) || 'user:'}}) AS u1
        FROM search p LEFT JOIN counted USING (c) WHERE p.i = coalesce(counted.n, 0)))
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, best.k AS cost, best.w AS audit, sha256(substr(best.t, 2)) AS repaired_sha256
FROM convs JOIN ends USING (c) LEFT JOIN counted USING (c)
"""


def repair_sql() -> str:
    def put(state: str, kind: str, price: int, role: str) -> str:
        return f"{{'k': {state}.k + {price} + more, 'w': {state}.w || '{kind}', 't': {state}.t || chr(10) || {role} || ':' || text}}"

    return SQL.format(
        none="{'k': 1000000000::BIGINT, 'w': '', 't': ''}",
        keep_e=put("e", "K", KEEP, "role"),
        keep_b=put("b", "K", KEEP, "role"),
        keep_u=put("u1", "K", KEEP, "role"),
        rerole_b=put("b", "R", REROLE, "'user'"),
        rerole_u=put("u1", "R", REROLE, "'assistant'"),
    )
