"""Conversation structure repair: the cheapest edits that give a conversation a legal order of roles.

The roles' initials must read ``(s?(ua)+)?`` after the edits.  Keep costs 0, Rerole (to user or
assistant) 2, Delete 3 (the only choice for blank and duplicate rows), Insert (an empty text of user or
assistant) 2; a truncated row that is not deleted adds 1.  Of equally cheap audits (the edits' initials
in order) the ASCII-least is taken.

Method, a persistent audit DP.  Four states say what has been read so far (nothing, s, ...u, ...a), and
an edit's initial and the state before it give the state after it, so an audit has one path.  The best
audit of each state is a node: its last edit and a link to the node of the audit without it, so audits
share their prefixes.  A node has links to its ancestors 1, 2, 4, ... edits back and a rolling hash of
its audit; two audits that cost the same are compared at the end of their longest common prefix, which
is found by descending these links while hashes differ.  The prefixes found are then the same node, or
are compared edit by edit.  Equally cheap audits of a state are never prefixes of one another (the rest
would be Inserts, which cost), so the least prefix stays the least one.

On Spark:

1. Damage or any other change is made before (:func:`damaged`); equal rows of a conversation's turn
   meet in an aggregation and go on as one row with a count, so a row repeated without end is one row.
2. The first turn of each (conversation, role, text) is another aggregation, joined back by the whole
   key (each key once on both sides): later rows are duplicates.
3. Rows are dealt by ranges of (conversation, turn, role, text), so a conversation of any size is spread
   over tasks.  A task works on many conversations at once, a row of each a step (NumPy).  Conversations
   that lie in one task, in up to ``SEGMENT`` rows, are done.  Of the others each segment gives its cost
   and audit from every state to every state and, apart, its rows.
4. A conversation's segments meet in order: first the costs and audits (four best chains of segments,
   compared in the same way), then, one after the other, the rows, which only pass through SHA-256.

Memory: a task holds a bounded number of rows, and of a long conversation its segments' audits (some
bytes a row, as the result's ``audit`` has).  The digest of a conversation is by its nature made in one
task, which streams its rows.

Defined results: a null conv_id or turn counts as the smallest one (turns: left out of gaps); a null
role or text is one space; rows of the same turn stand in the order of role and text; conversations
without rows give zeros, an empty audit and the digest of no bytes; an empty table gives no rows.  Texts
are compared by 96 bits of hash within a conversation and role.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agewise.llm.frames import NULL_ID, id_column, original_id, partitions
from agewise.llm.hashing import U

#: Rows of a conversation that are worked on as one.
SEGMENT = 512
#: Rows and bytes of text that a task holds at a time.
HELD_ROWS, HELD_BYTES = 1 << 15, 8 << 20
WHITE = " \t\n\x0b\x0c\r"
_FAR = np.int64(1 << 60)
_DELETE, _INSERT, _KEEP, _REROLE = (ord(c) for c in "DIKR")
_START, _S, _U, _A = range(4)
OK, BLANK, DUPLICATE, TRUNCATED = range(4)
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
_PRIME = (1 << 61) - 1


def damaged(conversations: DataFrame) -> DataFrame:
    """``(conv, turn, role, text, copies)``: rows dropped (0 copies), emptied, shorn of stops, repeated or given
    to the user by the CRC-32 of ``conv_id:turn`` modulo 20."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind, role, text = F.crc32(F.encode(key, "UTF-8")) % 20, F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return conversations.select(id_column("conv_id").alias("conv"), id_column("turn").alias("turn"), kind.alias("kind"),
                                role.alias("role"), text.alias("text")).select(
        "conv", "turn",
        F.when(F.col("kind") == 0, "").when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"))


def judged(rows: DataFrame) -> DataFrame:
    """``(conv, turn, role, text, copies, fault)``: equal rows of a turn once, with the first one's fault."""
    keys = ["conv", "turn", "role", "h", "g"]
    once = (rows.withColumn("h", F.xxhash64("text")).withColumn("g", F.hash("text"))
            .groupBy(*keys).agg(F.first("text").alias("text"), F.sum("copies").alias("copies")))
    last = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    once = once.withColumn("fault", F.when(last == "", BLANK).when(last.isin(".", "!", "?"), OK).otherwise(TRUNCATED))
    first = (once.where(f"fault <> {BLANK} and copies > 0").groupBy("conv", "role", "h", "g").agg(F.min("turn").alias("turn"))
             .withColumn("first", F.lit(True)))
    fault = F.when((F.col("fault") == BLANK) | F.col("first"), F.col("fault")).otherwise(DUPLICATE)
    return once.join(first, keys, "left").select(
        "conv", "turn", "role", "text", "copies", fault.alias("fault"))


class Audits:
    """Audits as linked nodes; node 0 is the empty one."""

    def __init__(self, longest: int, room: int):
        self.levels = max(1, int(longest).bit_length())
        self.up = np.zeros((self.levels, room), np.int32)
        self.depth, self.edit, self.hash = np.zeros(room, np.int32), np.zeros(room, np.uint8), np.zeros(room, U)
        self.n = 1

    def add(self, parent: np.ndarray, edit) -> np.ndarray:
        a, b = self.n, self.n + len(parent)
        if b > len(self.depth):
            grow = max(b, 2 * len(self.depth)) - len(self.depth)
            self.up = np.pad(self.up, ((0, 0), (0, grow)))
            self.depth, self.edit, self.hash = (np.pad(x, (0, grow)) for x in (self.depth, self.edit, self.hash))
        self.n = b
        self.depth[a:b], self.edit[a:b] = self.depth[parent] + 1, edit
        self.hash[a:b] = self.hash[parent] * U(0x9E3779B97F4A7C15) + self.edit[a:b] + U(0x632BE59BD9B4E019)
        self.up[0, a:b] = parent
        for k in range(1, self.levels):
            self.up[k, a:b] = self.up[k - 1][self.up[k - 1, a:b]]
        return np.arange(a, b)

    def lift(self, node: np.ndarray, steps: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            node = np.where(steps >> k & 1, self.up[k][node], node)
        return node

    def less(self, a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
        """Whether audit ``a`` with one more edit ``la`` comes before ``b`` with ``lb``."""
        da, db = self.depth[a], self.depth[b]
        d = np.minimum(da, db)
        x, y = self.lift(a, da - d), self.lift(b, db - d)
        # one begins with the other: the edits after it decide, then the length
        after_a = np.where(da > d, self.edit[self.lift(a, np.maximum(da - d - 1, 0))], la)
        after_b = np.where(db > d, self.edit[self.lift(b, np.maximum(db - d - 1, 0))], lb)
        out = (after_a < after_b) | ((after_a == after_b) & (da < db))
        split = np.flatnonzero(x != y)
        if len(split):
            x, y = x[split], y[split]
            for k in reversed(range(self.levels)):
                u, v = self.up[k][x], self.up[k][y]
                differ = self.hash[u] != self.hash[v]
                x, y = np.where(differ, u, x), np.where(differ, v, y)
            u, v = self.up[0][x], self.up[0][y]
            while (u != v).any():  # equal hashes of other nodes: edit by edit
                differ = self.edit[u] != self.edit[v]
                x, y = np.where(differ, u, x), np.where(differ, v, y)
                u, v = self.up[0][u], self.up[0][v]
            same = self.edit[x] == self.edit[y]  # only a hash could have told them apart
            out[split] = np.where(same, out[split], self.edit[x] < self.edit[y])
        return out

    def spelled(self, node: np.ndarray) -> list[bytes]:
        depth = self.depth[node].astype(np.int64)
        at = np.cumsum(depth)
        out = np.zeros(int(at[-1]) if len(at) else 0, np.uint8)
        place, left, node = at.copy(), depth.copy(), node.copy()
        live = np.flatnonzero(left)
        while len(live):
            place[live] -= 1
            out[place[live]] = self.edit[node[live]]
            node[live] = self.up[0][node[live]]
            left[live] -= 1
            live = live[left[live] > 0]
        raw = out.tobytes()
        return [raw[e - n:e] for e, n in zip(at, depth, strict=True)]


class _Best:
    """The least (cost, audit) of candidates offered one after the other, in each of several lanes."""

    def __init__(self, audits: Audits, cost: np.ndarray, parent: np.ndarray, edit):
        self.audits, self.cost, self.parent = audits, np.minimum(cost, _FAR), parent.copy()
        self.edit = np.broadcast_to(np.asarray(edit, np.uint8), cost.shape).copy()

    def offer(self, cost: np.ndarray, parent: np.ndarray, edit) -> None:
        edit = np.broadcast_to(np.asarray(edit, np.uint8), cost.shape)
        better = cost < self.cost
        ties = np.flatnonzero((cost == self.cost) & (cost < _FAR))
        if len(ties):
            better[ties] = self.audits.less(parent[ties], edit[ties], self.parent[ties], self.edit[ties])
        self.cost = np.where(better, cost, self.cost)
        self.parent, self.edit = np.where(better, parent, self.parent), np.where(better, edit, self.edit)

    def node(self) -> np.ndarray:
        return self.audits.add(self.parent, self.edit)


def audit_lanes(start: np.ndarray, length: np.ndarray, entry: np.ndarray, begins: np.ndarray,
                role: np.ndarray, must_delete: np.ndarray, truncated: np.ndarray):
    """The DP of many lanes at once: rows ``start`` to ``start + length``, read from state ``entry``.

    ``role``: state that a kept row leads to, -1 for other roles; ``begins``: whether rows may be inserted
    before the first one.  Returns cost and node of every (lane, state), and the audits."""
    order = np.argsort(-length, kind="stable")
    start, length, entry, begins = start[order], length[order], entry[order], begins[order]
    lanes = len(start)
    audits = Audits(3 * int(length.max(initial=0)) + 3, 6 * int(length.sum()) + 3 * lanes + 1)
    cost, node = np.full((4, lanes), _FAR), np.zeros((4, lanes), np.int64)
    cost[entry, np.arange(lanes)] = 0
    if begins.any():
        first = np.flatnonzero(begins & (entry == _START))
        one = audits.add(np.zeros(len(first), np.int64), _INSERT)
        cost[_U, first], node[_U, first] = 2, one
        cost[_A, first], node[_A, first] = 4, audits.add(one, _INSERT)
    live = lanes
    for t in range(int(length.max(initial=0))):
        live = int(np.searchsorted(-length, -t, side="left"))  # lanes with more than t rows come first
        at = start[:live] + t
        c, n, r = cost[:, :live], node[:, :live], role[at]
        stays = np.where(must_delete[at], _FAR, truncated[at])
        as_u, as_a = (stays + np.where(r == s, 0, 2) for s in (_U, _A))
        edit_u, edit_a = (np.where(r == s, _KEEP, _REROLE).astype(np.uint8) for s in (_U, _A))
        best = {s: _Best(audits, c[s] + 3, n[s], _DELETE) for s in range(4)}
        best[_S].offer(np.where(r == _S, c[_START] + stays, _FAR), n[_START], _KEEP)
        best[_A].offer(c[_U] + as_a, n[_U], edit_a)
        node0, node1, node3 = (best[s].node() for s in (_START, _S, _A))
        for s in (_START, _S, _A):
            best[_U].offer(c[s] + as_u, n[s], edit_u)
        for s, x in ((_START, node0), (_S, node1), (_A, node3)):
            best[_U].offer(best[s].cost + 2, x, _INSERT)
        node2 = best[_U].node()
        before = best[_A].parent, best[_A].edit
        best[_A].offer(best[_U].cost + 2, node2, _INSERT)
        changed = np.flatnonzero((best[_A].parent != before[0]) | (best[_A].edit != before[1]))
        if len(changed):
            node3 = node3.copy()
            node3[changed] = audits.add(node2[changed], _INSERT)
        for s, x in ((_START, node0), (_S, node1), (_U, node2), (_A, node3)):
            cost[s, :live], node[s, :live] = np.minimum(best[s].cost, _FAR), x
    back = np.empty(lanes, np.int64)
    back[order] = np.arange(lanes)
    return cost[:, back].T, node[:, back].T, audits


def repaired_lines(audit: bytes, rows, state: int):
    """The repaired rows ``role:text`` of an audit over ``rows`` (role, text), and the state after it."""
    out, rows = [], iter(rows)
    for edit in audit:
        if edit == _DELETE:
            next(rows)
            continue
        role, text = next(rows) if edit != _INSERT else ("", "")
        if edit == _KEEP:
            state = {"s": _S, "u": _U, "a": _A}[role[0]]
        else:
            state = _A if state == _U else _U
            role = "assistant" if state == _A else "user"
        out.append(f"{role}:{text}")
    return out, state


class _Segment:
    """Consecutive rows of a conversation (equal ones counted out), with what the counts need."""

    def __init__(self, conv: int, seq: int):
        self.conv, self.seq = conv, seq
        self.rows: list = []       # role, text
        self.state, self.delete, self.cut = [], [], []
        self.bytes = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_turn = self.last_turn = None
        self.first_role = self.last_role = None

    def add(self, turn: int, role: str, text: str, fault: int, copies: int) -> None:
        if turn != NULL_ID and turn != self.last_turn:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
            self.turns += 1
        state = {"s": _S, "u": _U, "a": _A}.get(role[:1], -1)
        self.illegal += copies - 1 + (self.last_role is not None and not legal(self.last_role, state))
        self.first_role = state if self.first_role is None else self.first_role
        self.last_role = state
        self.bytes += len(text) + 64
        for i in range(copies):
            f = DUPLICATE if i and fault != BLANK else fault
            self.blank += f == BLANK
            self.duplicate += f == DUPLICATE
            self.truncated += f == TRUNCATED
            self.rows.append((role, text if f in (OK, TRUNCATED) else ""))
            self.state.append(state)
            self.delete.append(f in (BLANK, DUPLICATE))
            self.cut.append(f == TRUNCATED)

    def counts(self) -> list:
        return [self.blank, self.duplicate, self.truncated, self.illegal, self.turns, self.first_turn, self.last_turn,
                self.first_role, self.last_role]


def legal(before: int, after: int) -> bool:
    return (before, after) in ((_S, _U), (_U, _A), (_A, _U))


def wrapped(n: int) -> int:
    """As Spark's long."""
    return (n + (1 << 63)) % (1 << 64) - (1 << 63)


class _Counts:
    """The counts of a conversation, from its segments in order."""

    def __init__(self):
        self.sums = [0, 0, 0, 0]
        self.turns, self.least, self.last_turn, self.last_role = 0, None, None, None

    def add(self, c: list) -> None:
        *sums, turns, first_turn, last_turn, first_role, last_role = c
        self.sums = [x + y for x, y in zip(self.sums, sums, strict=True)]
        if first_role is not None:
            self.sums[3] += self.last_role is not None and not legal(self.last_role, first_role)
            self.last_role = last_role
        if first_turn is not None:
            self.turns += turns - (first_turn == self.last_turn)
            self.least = first_turn if self.least is None else self.least
            self.last_turn = last_turn

    def values(self) -> list:
        gaps = 0 if self.least is None else wrapped(self.last_turn - self.least + 1 - self.turns)
        return [gaps, *self.sums]


_DONE, _COSTS, _ROWS = range(3)
_FIELDS = [("conv", pa.int64()), ("phase", pa.int32()), ("part", pa.int32()), ("seq", pa.int64()), ("numbers", pa.list_(pa.int64())),
           ("audits", pa.list_(pa.binary())), ("sha256", pa.string()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))]
_SEGMENTS = pa.schema(_FIELDS)
_SEGMENTS_SQL = ("conv long, phase int, part int, seq long, numbers array<long>, audits array<binary>, sha256 string, "
                 "roles array<string>, texts array<string>")


def _written(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SEGMENTS, strict=True)], schema=_SEGMENTS)


def _solved(done: list[_Segment], open_: list[_Segment], part: int):
    """Rows of conversations that are whole, and of segments of others (costs and rows apart)."""
    lanes = [(s, _START, True) for s in done] + [(s, e, s.seq == 0) for s in open_ for e in range(4)]
    if not lanes:
        return
    segments = [*done, *open_]
    first = dict(zip(map(id, segments), np.cumsum([0] + [len(s.rows) for s in segments]), strict=False))
    together = lambda name, kind: np.array([x for s in segments for x in getattr(s, name)], kind)
    # a segment's part may begin a conversation in another task, so inserts before its first row are left to the chain
    cost, node, audits = audit_lanes(np.array([first[id(s)] for s, _, _ in lanes]), np.array([len(s.rows) for s, _, _ in lanes]),
                                     np.array([e for _, e, _ in lanes]), np.arange(len(lanes)) < len(done),
                                     together("state", np.int64), together("delete", bool), together("cut", np.int64))
    ends = np.full(len(done), _START)
    if done:
        c, n = cost[:len(done)], node[:len(done)]
        ends[c[:, _A] < c[:, _START]] = _A
        ties = np.flatnonzero(c[:, _A] == c[:, _START])
        zero = np.zeros(len(ties), np.uint8)
        ends[ties[audits.less(n[ties, _A], zero, n[ties, _START], zero)]] = _A
        at = np.arange(len(done))
        out = []
        for s, k, a in zip(done, c[at, ends], audits.spelled(n[at, ends]), strict=True):
            counts = _Counts()
            counts.add(s.counts())
            text = "\n".join(repaired_lines(a, s.rows, _START)[0])
            out.append((s.conv, _DONE, part, 0, [*counts.values(), int(k)], [a], hashlib.sha256(text.encode()).hexdigest(), None, None))
        yield _written(out)
    if open_:
        c, n = cost[len(done):].reshape(-1, 16), node[len(done):].reshape(-1, 16)
        spelled = audits.spelled(n.ravel())
        for i, s in enumerate(open_):
            names = [a if k < _FAR else None for a, k in zip(spelled[16 * i:16 * i + 16], c[i], strict=True)]
            roles, texts = zip(*s.rows, strict=True) if s.rows else ((), ())
            yield _written([(s.conv, _COSTS, part, s.seq, [*s.counts(), *c[i].tolist()], names, None, None, None),
                            (s.conv, _ROWS, part, s.seq, None, None, None, roles, texts)])


def _segments(segment: int, held: int):
    """From rows sorted by conversation, turn, role and text: see :func:`_solved`."""
    def run(batches):
        yield from _divided(batches, segment, held)
    return run


def _divided(batches, segment: int, held: int):
    part = TaskContext.get().partitionId()
    done, open_, rows, size = [], [], 0, 0
    now, whole, count = None, False, 0
    for b in batches:
        columns = [b.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "fault", "copies")]
        for conv, turn, role, text, fault, copies in zip(*columns, strict=True):
            if now is None or conv != now.conv:
                if now is not None:
                    (done if whole else open_).append(now)
                    whole = True  # the first one may have begun in the task before
                count = 0
                now = _Segment(conv, 0)
            while copies > 0 or now is None:
                if len(now.rows) >= segment or now.bytes > HELD_BYTES:
                    open_.append(now)
                    whole, count = False, count + 1
                    now = _Segment(conv, count)
                some = min(copies, segment - len(now.rows))
                now.add(turn, role, text, fault, some)
                rows, size, copies = rows + some, size + len(text), copies - some
                fault, text = (BLANK, "") if fault == BLANK else (DUPLICATE, "")
            if rows >= held or size >= HELD_BYTES:
                yield from _solved(done, open_, part)
                done, open_, rows, size = [], [], 0, 0
    if now is not None:
        open_.append(now)  # it may go on in the next task
    yield from _solved(done, open_, part)


class Chain:
    """Audits made of whole segments, as linked nodes; any prefix's hash comes from the links."""

    def __init__(self):
        self.up, self.piece, self.length, self.hash = [[0]], [b""], [0], [0]

    def add(self, parent: int, piece: bytes) -> int:
        node = len(self.piece)
        self.piece.append(piece)
        self.length.append(self.length[parent] + len(piece))
        self.hash.append((self.hash[parent] * pow(256, len(piece), _PRIME) + int.from_bytes(piece, "big")) % _PRIME)
        links, k = [parent], 0
        while links[-1] and k < len(self.up[links[-1]]):
            links.append(self.up[links[-1]][k])
            k += 1
        self.up.append(links)
        return node

    def holder(self, node: int, n: int) -> int:
        """The ancestor (or the node itself) whose own piece has the ``n``-th byte (from 1) of the audit."""
        while self.length[self.up[node][0]] >= n:
            above = self.up[node][0]
            for link in self.up[node]:
                if self.length[link] < n:
                    break
                above = link
            node = above
        return node

    def prefix(self, node: int, n: int) -> int:
        if not n:
            return 0
        node = self.holder(node, n)
        above = self.up[node][0]
        rest = self.piece[node][:n - self.length[above]]
        return (self.hash[above] * pow(256, len(rest), _PRIME) + int.from_bytes(rest, "big")) % _PRIME

    def byte(self, node: int, n: int) -> int:
        node = self.holder(node, n + 1)
        return self.piece[node][n - self.length[self.up[node][0]]]

    def spelled(self, node: int, n: int | None = None) -> bytes:
        parts = []
        while node:
            parts.append(self.piece[node])
            node = self.up[node][0]
        return b"".join(reversed(parts))[:n]

    def same(self, a: int, b: int, n: int) -> bool:
        """Whether two audits have the same first ``n`` edits, node by node until a shared one."""
        while n:
            a, b = self.holder(a, n), self.holder(b, n)
            if a == b:
                return True
            above = max(self.length[self.up[a][0]], self.length[self.up[b][0]])
            x, y = (self.piece[v][above - self.length[self.up[v][0]]:n - self.length[self.up[v][0]]] for v in (a, b))
            if x != y:
                return False
            n = above
        return True

    def less(self, a: int, b: int) -> bool:
        low, high = 0, min(self.length[a], self.length[b])
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.prefix(a, middle) == self.prefix(b, middle) else (low, middle - 1)
        if not self.same(a, b, low):  # equal hashes of unequal prefixes
            return self.spelled(a) < self.spelled(b)
        if low == min(self.length[a], self.length[b]):
            return self.length[a] < self.length[b]
        return self.byte(a, low) < self.byte(b, low)


class _Conversation:
    """A conversation put together from its segments."""

    def __init__(self, conv: int):
        self.conv, self.counts, self.chain = conv, _Counts(), Chain()
        one = self.chain.add(0, b"I")
        self.best = [(0, 0), None, (2, one), (4, self.chain.add(0, b"II"))]
        self.entries: list = []    # of every segment, the entry state of each exit state
        self.digest, self.lines, self.todo, self.state = hashlib.sha256(), 0, None, _START

    def add_costs(self, numbers: list, audits: list) -> None:
        self.counts.add(numbers[:9])
        new, entries = [None] * 4, [0] * 4
        for q in range(4):
            for e in range(4):
                audit = audits[4 * e + q]
                if audit is None or self.best[e] is None:
                    continue
                cost = self.best[e][0] + numbers[9 + 4 * e + q]
                if new[q] is None or cost <= new[q][0]:
                    node = self.chain.add(self.best[e][1], audit)
                    if new[q] is None or cost < new[q][0] or self.chain.less(node, new[q][1]):
                        new[q], entries[q] = (cost, node), e
        self.best = new
        self.entries.append(entries)

    def solve(self) -> None:
        """The audit of each segment, in order; the rows inserted before the first one come with it."""
        ends = [s for s in (_START, _A) if self.best[s] is not None]
        end = min(ends, key=lambda s: self.best[s][0])
        if len(ends) == 2 and self.best[_START][0] == self.best[_A][0] and self.chain.less(self.best[_A][1], self.best[_START][1]):
            end = _A
        self.cost, node = self.best[end]
        pieces = []
        while node:
            pieces.append(self.chain.piece[node])
            node = self.chain.up[node][0]
        pieces.reverse()
        head = pieces.pop(0) if len(pieces) > len(self.entries) else b""
        self.audit = head + b"".join(pieces)
        self.todo = iter(pieces)
        self.add_lines(head, ())

    def add_lines(self, audit: bytes, rows) -> None:
        lines, self.state = repaired_lines(audit, rows, self.state)
        for x in lines:
            self.digest.update(("\n" * (self.lines > 0) + x).encode())
            self.lines += 1

    def row(self) -> tuple:
        return (self.conv, _DONE, 0, 0, [*self.counts.values(), self.cost], [self.audit], self.digest.hexdigest(), None, None)


def _joined(batches):
    """Conversations that are whole pass; segments sorted by conversation, phase and place are put together."""
    now = None
    for b in batches:
        phase = b.column("phase").to_numpy()
        whole = b.filter(pa.array(phase == _DONE))
        if whole.num_rows:
            yield from _results(whole)
        if whole.num_rows == b.num_rows:
            continue
        b = b.filter(pa.array(phase != _DONE))
        for conv, kind, numbers, audits, roles, texts in zip(*(b.column(c).to_pylist() for c in (
                "conv", "phase", "numbers", "audits", "roles", "texts")), strict=True):
            if now is None or now.conv != conv:
                if now is not None:
                    yield from _results(_written([now.row()]))
                now = _Conversation(conv)
            if kind == _COSTS:
                now.add_costs(numbers, audits)
            else:
                if now.todo is None:
                    now.solve()
                now.add_lines(next(now.todo), zip(roles, texts, strict=True))
    if now is not None:
        yield from _results(_written([now.row()]))


_RESULT = pa.schema([("conv", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("cost", pa.int64()), ("audit", pa.string()),
                     ("repaired_sha256", pa.string())])


def _results(b: pa.RecordBatch):
    numbers = list(zip(*b.column("numbers").to_pylist(), strict=True))
    audits = [a[0].decode() for a in b.column("audits").to_pylist()]
    yield pa.RecordBatch.from_arrays([b.column("conv"), *(pa.array(x, pa.int64()) for x in numbers), pa.array(audits, pa.string()),
                                      b.column("sha256")], schema=_RESULT)


def repaired(rows: DataFrame, segment: int = SEGMENT, held: int = HELD_ROWS) -> DataFrame:
    """One row a conversation of ``rows`` (conv, turn, role, text, copies): counts, cost, audit and digest."""
    p = partitions(rows)
    dealt = judged(rows).repartitionByRange(p, "conv", "turn", "role", "text").sortWithinPartitions("conv", "turn", "role", "text")
    parts = dealt.mapInArrow(_segments(segment, held), _SEGMENTS_SQL)
    return (parts.repartition(p, "conv").sortWithinPartitions("conv", "phase", "part", "seq")
            .mapInArrow(_joined, "conv long, " + ", ".join(f"{c} long" for c in (*COUNTS, "cost")) + ", audit string, repaired_sha256 string"))


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """The damaged conversations' faults and their cheapest repair, one row a conversation."""
    out = repaired(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return out.select(original_id("conv").alias("conv_id"), *COUNTS, "cost", "audit", "repaired_sha256")
