"""Conversations with faults, mended by the cheapest edits, with an audit of every edit."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: What the edits of a row or between rows cost, and what a truncated row that stays adds.
KEEP, INSERT, REROLE, DELETE, TRUNCATED = 0, 2, 2, 3, 1
#: Rows that a conversation holds undecided before the part common to all its candidates is settled.
UNSETTLED = 512
#: Rolling hashes of audits are taken modulo this prime.
PRIME, BASE = (1 << 61) - 1, 1_000_003
SPACES = r"\x20\x09-\x0D"
#: States of a repaired conversation by the initial of its last role; it may end at the start or after an assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
_AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
_EDITS = {"u": "user", "a": "assistant"}
COLUMNS = ("conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
RESULTS = "blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Node:
    """The last edit of an audit; what came before is shared with the audits that begin alike.

    ``ups[k]`` is the node 2^k edits earlier, ``code`` the rolling hash of all edits to here.
    """

    __slots__ = ("code", "depth", "edit", "role", "ups")

    def __init__(self, before: Node | None, edit: str, role: str | None = None):
        self.edit, self.role = edit, role
        if before is None:
            self.depth, self.code, self.ups = 0, 0, ()
            return
        self.depth = before.depth + 1
        self.code = (before.code * BASE + ord(edit)) % PRIME
        ups, k = [before], 0
        while len(ups[k].ups) > k:
            ups.append(ups[k].ups[k])
            k += 1
        self.ups = tuple(ups)

    def at(self, depth: int) -> Node:
        """The node of that many edits."""
        node = self
        while node.depth > depth:
            node = node.ups[min((node.depth - depth).bit_length(), len(node.ups)) - 1]
        return node

    def back_to(self, root: Node) -> list[Node]:
        """The nodes after ``root``, first to last."""
        nodes, node = [], self
        while node is not root:
            nodes.append(node)
            node = node.ups[0]
        return nodes[::-1]


def common(a: Node, b: Node) -> tuple[Node, Node]:
    """The last nodes of both up to which the audits are equal.

    Hashes of ever shorter steps find them. Nodes with one hash are taken as equal at first; the
    edits between there and where both share a node are then compared one by one, so equal
    hashes of unequal audits are seen.
    """
    depth = min(a.depth, b.depth)
    x, y = a.at(depth), b.at(depth)
    if x.code != y.code:
        for k in range(len(x.ups) - 1, -1, -1):
            if k < len(x.ups) and x.ups[k].code != y.ups[k].code:
                x, y = x.ups[k], y.ups[k]
        x, y = x.ups[0], y.ups[0]
    last, p, q = (x, y), x, y
    while p is not q:
        if p.edit != q.edit:
            last = (p.ups[0], q.ups[0])
        p, q = p.ups[0], q.ups[0]
    return last


def earlier(a: Node, b: Node) -> bool:
    """Whether the audit of ``a`` comes before that of ``b`` in the order of ASCII strings."""
    if a is b:
        return False
    x, y = common(a, b)
    if x is a or y is b:  # one begins with the other
        return a.depth < b.depth
    return a.at(x.depth + 1).edit < b.at(y.depth + 1).edit


def _better(new: tuple[int, Node], old: tuple[int, Node] | None) -> bool:
    return old is None or new[0] < old[0] or new[0] == old[0] and earlier(new[1], old[1])


class Conversation:
    """The repair of one conversation, row by row; only what is not settled yet is held."""

    def __init__(self) -> None:
        self.root = Node(None, "")
        self.states: dict[int, tuple[int, Node]] = {START: (0, self.root)}
        self.rows: list[tuple[str, str]] = []
        self.audit: list[str] = []
        self.digest, self.written = hashlib.sha256(), False
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.last: tuple | None = None
        self.initial: str | None = None
        self._insert()

    def _offer(self, states: dict, state: int, cost: int, before: Node, edit: str, role: str | None = None) -> None:
        if state not in states or cost <= states[state][0]:
            new = (cost, Node(before, edit, role))
            if _better(new, states.get(state)):
                states[state] = new

    def _insert(self) -> None:
        """Rows between others: two at most can help, as each state is one insertion from some other."""
        for _ in range(2):
            for state, (cost, node) in sorted(self.states.items()):
                for initial, role in _EDITS.items():
                    after = _AFTER.get((state, initial))
                    if after is not None:
                        self._offer(self.states, after, cost + INSERT, node, "I", role)

    def row(self, role: str, text: str, fault: str | None) -> None:
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = role[:1]
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        more = TRUNCATED if fault == "truncated" else 0
        states: dict[int, tuple[int, Node]] = {}
        for state, (cost, node) in self.states.items():
            self._offer(states, state, cost + DELETE, node, "D")
            if fault in ("blank", "duplicate"):
                continue
            after = _AFTER.get((state, role[:1]))
            if after is not None:
                self._offer(states, after, cost + KEEP + more, node, "K")
            for initial, other in _EDITS.items():
                after = _AFTER.get((state, initial))
                if after is not None:
                    self._offer(states, after, cost + REROLE + more, node, "R", other)
        self.states = states
        self._insert()
        # After an assistant all goes on as from the start, but that a system row must go, and as after a system row.
        beyond = self.states[ASSISTANT][0]
        for state, most in ((START, beyond + DELETE), (SYSTEM, beyond)):
            if state in self.states and self.states[state][0] > most:
                del self.states[state]
        self.rows.append((role, text))
        if len(self.rows) >= UNSETTLED and len(self.rows) % UNSETTLED == 0:
            self._settle()

    def _settle(self) -> None:
        """What all candidates begin with can no longer change."""
        nodes = [n for _, n in self.states.values()]
        depth = min(n.depth for n in nodes)
        low, high = self.root.depth, depth
        while low < high:
            middle = (low + high + 1) // 2
            if len({id(n.at(middle)) for n in nodes}) == 1:
                low = middle
            else:
                high = middle - 1
        shared = nodes[0].at(low)
        if shared is not self.root:
            self._write(shared)
            # The settled part hangs on nothing any more: ancestors end at the shared node.
            kept = {id(shared): Node(None, "")}
            self.root = kept[id(shared)]

            def moved(node: Node) -> Node:
                for n in node.back_to(shared):
                    if id(n) not in kept:
                        kept[id(n)] = Node(kept[id(n.ups[0])], n.edit, n.role)
                return kept[id(node)]

            self.states = {s: (c, moved(n)) for s, (c, n) in self.states.items()}

    def _write(self, node: Node) -> None:
        """Append the edits up to a node to the audit, and what they leave to the repaired text."""
        used = 0
        for step in node.back_to(self.root):
            self.audit.append(step.edit)
            role, text = ("", "") if step.edit == "I" else self.rows[used]
            used += step.edit != "I"
            if step.edit != "D":
                line = f"{step.role or role}:{text}"
                self.digest.update((("\n" if self.written else "") + line).encode("utf-8", "surrogatepass"))
                self.written = True
        del self.rows[:used]

    def result(self) -> tuple[int, int, int, int, int, str, str]:
        best = None
        for state in (START, ASSISTANT):
            if state in self.states and _better(self.states[state], best):
                best = self.states[state]
        cost, node = best
        self._write(node)
        return (self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(self.audit), self.digest.hexdigest())


def with_faults(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``rows`` plus ``fault``: blank, duplicate, truncated or null, the first that a row has.

    A row is a duplicate when its conversation has its role and text earlier; of rows with one
    turn as well only the first of those that are equal is none, which ``again`` tells the reader
    of the sorted rows to see. The earliest turn of each text is summed up before it is shuffled.
    """
    blank = ~F.col(text).rlike(f"[^{SPACES}]")
    place = F.struct(F.col(turn).isNotNull().alias("known"), F.col(turn).alias("turn"))
    digest = F.sha2(F.concat_ws(":", F.length(role).cast("string"), F.col(role), F.col(text)), 256)
    given = rows.withColumns({"_llm_place": place, "_llm_said": digest})
    first = given.groupBy(F.col(key).alias("_llm_key"), F.col("_llm_said").alias("_llm_same")).agg(F.min("_llm_place").alias("_llm_first"))
    met = given.join(first, F.col(key).eqNullSafe(F.col("_llm_key")) & (F.col("_llm_said") == F.col("_llm_same")))
    fault = F.when(blank, "blank").when(F.col("_llm_place") > F.col("_llm_first"), "duplicate").when(
        ~F.col(text).rlike(f"[.!?][{SPACES}]*\\z"), "truncated")
    return met.select(*rows.columns, fault.alias("fault"))


def repair(
    rows: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None,
) -> DataFrame:
    """One row per conversation: ``conv_id``, the faults counted, ``cost``, ``audit`` and ``repaired_sha256``.

    Rows are taken by turn (nulls first), then role and text. The repaired roles begin with the
    letters ``(s?(ua)+)?``; keeping a row is free, a new role, a row without text between
    others and a removal have their costs, blank and repeated rows must go. Of equally cheap audits the least
    in ASCII is taken: audits share their beginnings as linked nodes, and two are compared by a
    search for their longest common prefix. Rows stream through sorted partitions, and what all
    candidates share is settled on the way, so a conversation of any length is held in part only.

    Null roles and texts count as empty. Rows that the boolean column ``gone`` marks, if one is named, only
    keep their conversation in the result. Null ids are one conversation. Other columns are not
    looked at; an empty table gives no rows.
    """
    absent = F.lit(False) if gone is None else F.coalesce(F.col(gone), F.lit(False))
    given = rows.select(
        F.col(key).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"), absent.alias("gone"))
    there = with_faults(given.filter("NOT gone"))
    every = there.unionByName(given.filter("gone").select(*given.columns, F.lit(None).cast("string").alias("fault")))
    ordered = every.repartition("conv_id").sortWithinPartitions("conv_id", "gone", "turn", "role", "text")
    kind = dict(given.dtypes)["conv_id"]
    mended = ordered.select("conv_id", "turn", "role", "text", "gone", "fault").mapInArrow(
        _mended(to_arrow_type(given.schema["conv_id"].dataType)), f"conv_id {kind}, {RESULTS}")
    turns = given.groupBy("conv_id").agg(
        F.max(F.when(~F.col("gone"), F.col("turn"))).alias("_high"), F.min(F.when(~F.col("gone"), F.col("turn"))).alias("_low"),
        F.count_distinct(F.when(~F.col("gone"), F.col("turn"))).alias("_turns")).withColumnRenamed("conv_id", "_id")
    gaps = F.coalesce((F.col("_high") - F.col("_low") + 1 - F.col("_turns")).cast("long"), F.lit(0))
    return mended.join(turns, F.col("conv_id").eqNullSafe(F.col("_id"))).select(
        "conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _mended(kind: pa.DataType):
    """Conversations out of sorted rows, each as soon as the next one begins."""

    def shaped(done: list[tuple]) -> pa.RecordBatch:
        types = [kind, *[pa.int64()] * 5, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], list(COLUMNS))

    def mended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, open_, before = None, None, None
        for batch in batches:
            done = []
            for key, turn, role, text, gone, fault in zip(*(c.to_pylist() for c in batch.columns)):
                if open_ is None or key != own:
                    if open_ is not None:
                        done.append((own, *open_.result()))
                    own, open_, before = key, Conversation(), None
                if gone:
                    continue
                if fault != "blank" and before == (turn, role, text):
                    fault = "duplicate"
                before = (turn, role, text)
                open_.row(role, text, fault)
            if done:
                yield shaped(done)
        if open_ is not None:
            yield shaped([(own, *open_.result())])

    return mended


def damaged(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``rows`` with planted faults, chosen by a checksum of id and turn, for measuring the repair.

    Nulls are one blank in the checksum, in roles and in texts. Of twenty rows one goes (it stays as
    ``gone``), one loses its text, one its sentence marks, one comes twice, one becomes the user's.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(blank(key), F.lit(":"), blank(turn)).cast("binary")) % 20
    marked = rows.select(
        F.col(key).alias(key), F.col(turn).alias(turn), blank(role).alias(role), blank(text).alias(text), lot.alias("_llm_lot"))
    changed = marked.withColumns({
        text: F.when(F.col("_llm_lot") == 1, "").when(F.col("_llm_lot") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(F.col(text)),
        role: F.when(F.col("_llm_lot") == 4, "user").otherwise(F.col(role)), "gone": F.col("_llm_lot") == 0})
    copies: Column = F.array_repeat(F.lit(0), F.when(F.col("_llm_lot") == 3, 2).otherwise(1))
    return changed.withColumn("_llm_copy", F.explode(copies)).drop("_llm_copy", "_llm_lot")
