"""Conversation structure repair: the cheapest edits that make roles alternate, in linear space.

A good conversation has role initials ``(s?(ua)+)?``. Rows are kept (0), given the role user or
assistant (1) or deleted (2, a must for blank and repeated rows); empty user and assistant rows
may be put in (5); a row with an unfinished text that stays costs 5 more. Among the cheapest
ways the one with the ASCII-least string of edit initials (D, I, K, R) is taken.

Four states say what came last: nothing, system, user, assistant. Hirschberg's scheme finds the
edits: costs of the four states are carried forward over the first half of a conversation and
backward over the second; the cheapest state at the crossing splits the problem in two, which
are solved in the same way, so no table of all rows times all states is ever held. An
insertion before a deletion is never ASCII-least, so insertions belong to the kept row behind
them; prefixes up to one row are then never prefixes of each other, and a rank of the four
forward prefixes beside their costs settles which optimal crossing is the least.
All conversations of a batch take each step together, as arrays.

Rows are dealt by ranges of (conversation, turn), so a conversation with a third of all rows
lies in many tasks. Each task reduces its stretch to a 4 x 4 matrix of costs and ranks; only these
meet to settle the states at the cuts, then every stretch is solved where its rows are. Only keys
and hashes take part in this. Texts are shuffled once, to the one task that writes a conversation's
digest in order (a digest can't be split): it holds a batch of rows and the audit, no more.

Rows: null ids are one conversation, null turns come first, null roles and texts are one space. Rows
of one turn are ordered by role and a hash of the text. Repeated rows are duplicates of the
first. Long texts are taken whole; an empty table gives no rows; other columns take no part.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendero.session import stored

c = F.col

BLANKS = " \t\n\x0b\f\r"
DELETE = 8  # code of a row that must go; others are 2 x class + unfinished
FAR = 1 << 40
TAIL = np.array([0, 10, 5, 0])  # insertions behind the last row, by state
TAIL_INSERTS = (0, 2, 1, 0)
SOLVED_ROWS = 40_000  # rows of conversations that are solved together


def _edits() -> tuple[np.ndarray, np.ndarray, list]:
    """Cost, order and letters of the cheapest way from state to state over one row, by code."""
    inserts = {0: ((0, 0), (2, 1), (3, 2)), 1: ((1, 0), (2, 1), (3, 2)), 2: ((2, 0), (3, 1)), 3: ((3, 0), (2, 1))}
    ranked = ["D", "IK", "IR", "K", "R"]
    cost, place = np.full((9, 4, 4), FAR), np.zeros((9, 4, 4), np.int64)
    letters = [[[""] * 4 for _ in range(4)] for _ in range(9)]
    for code in range(9):
        cls, unfinished = divmod(code, 2)
        for s in range(4):
            ways = [(s, 2, "D")]
            if code < DELETE:
                for before, n in inserts[s]:
                    after = 3 if before == 2 else 2
                    ways.append((after, 5 * n + 5 * unfinished + 1, "I" * n + "R"))
                    if (cls == 0 and before == 0) or (cls == 1 and before != 2) or (cls == 2 and before == 2):
                        ways.append((cls + 1, 5 * n + 5 * unfinished, "I" * n + "K"))
            for t, price, said in sorted(ways, key=lambda w: (w[1], w[2]), reverse=True):
                if price < FAR and said in ranked:
                    cost[code, s, t], place[code, s, t], letters[code][s][t] = price, ranked.index(said), said
    return cost, place, letters


COST, PLACE, LETTERS = _edits()
_SAID = np.array([x.encode() for code in LETTERS for row in code for x in row]).reshape(9, 4, 4)


# --- many stretches of rows at once --------------------------------------------------

def _steps(length: np.ndarray):
    """(k, how many stretches have more than k rows) for stretches in descending length."""
    down = -length
    for k in range(int(length.max(initial=0))):
        yield k, int(np.searchsorted(down, -k, "left"))


def forward(codes: np.ndarray, at: np.ndarray, length: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Costs of the four states after each stretch, and the order of their ASCII-least edits."""
    order = np.argsort(-length, kind="stable")
    at, length = at[order], length[order]
    cost, rank = np.full((len(at), 4), FAR), np.zeros((len(at), 4), np.int64)
    cost[np.arange(len(at)), state[order]] = 0
    for k, m in _steps(length):
        code = codes[at[:m] + k]
        total = np.minimum(cost[:m, :, None] + COST[code], FAR)
        best = ((total << 5) | (rank[:m, :, None] << 3) | PLACE[code]).min(1)
        cost[:m] = best >> 5
        low = np.where(cost[:m] < FAR, best & 31, 99)
        rank[:m] = (low[:, :, None] > low[:, None, :]).sum(2)
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return cost[back], rank[back]


def backward(codes: np.ndarray, at: np.ndarray, length: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Costs from each of the four states before a stretch to a given state behind it."""
    order = np.argsort(-length, kind="stable")
    last, length = (at + length)[order] - 1, length[order]
    cost = np.full((len(last), 4), FAR)
    cost[np.arange(len(last)), state[order]] = 0
    for k, m in _steps(length):
        cost[:m] = np.minimum((COST[codes[last[:m] - k]] + cost[:m, None, :]).min(2), FAR)
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return cost[back]


def solved(codes: np.ndarray, at: np.ndarray, length: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Edit letters of every row of stretches that start and end in given states."""
    out = np.zeros(len(codes), _SAID.dtype)
    while len(at):
        one = length == 1
        out[at[one]] = _SAID[codes[at[one]], first[one], last[one]]
        more = length > 1
        at, length, first, last = at[more], length[more], first[more], last[more]
        half = length // 2
        cost, rank = forward(codes, at, half, first)
        total = cost + backward(codes, at + half, length - half, last)
        middle = ((total << 2) | rank).argmin(1)
        at, length = np.concatenate((at, at + half)), np.concatenate((half, length - half))
        first, last = np.concatenate((first, middle)), np.concatenate((middle, last))
    return out


def _end(cost: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The state behind the last row."""
    return (((cost + TAIL) << 2) | rank).argmin(1)


# --- stretches -----------------------------------------------------------------------

_FACTS = ["rows", "blank", "duplicate", "truncated", "illegal", "turns"]
_PIECE = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("slot", pa.int32()), *[(x, pa.int64()) for x in _FACTS],
                    ("least", pa.int64()), ("most", pa.int64()), ("first_class", pa.int64()), ("last_class", pa.int64()),
                    ("cost", pa.int64()), ("audit", pa.string()), ("codes", pa.binary()), ("matrix", pa.binary())])
PIECE = ("conv_id long, part int, slot int, rows long, blank long, duplicate long, truncated long, illegal long, turns long, "
         "least long, most long, first_class long, last_class long, cost long, audit string, codes binary, matrix binary")


def _facts(turn: np.ndarray, known: np.ndarray, cls: np.ndarray, code: np.ndarray, kind: np.ndarray, n: np.ndarray) -> tuple[dict, np.ndarray]:
    """Counts of one stretch of counted rows, and the code of every single row."""
    kept = kind < 3  # rows that the damage left
    turn, known, cls, code, kind, n = (x[kept] for x in (turn, known, cls, code, kind, n))
    legal = np.isin(cls[:-1] * 4 + cls[1:], (1, 6, 9))  # su, ua, au
    turn = turn[known]
    blank, fresh = int(n[kind == 1].sum()), (kind != 1) & (code < DELETE)
    facts = {"rows": int(n.sum()), "blank": blank, "duplicate": int(n.sum()) - blank - int(fresh.sum()),
             "truncated": int((fresh & (kind == 2)).sum()),
             "illegal": int((n - 1).sum()) + int((~legal).sum()), "turns": int((np.diff(turn) != 0).sum()) + 1 if len(turn) else 0,
             "least": int(turn[0]) if len(turn) else None, "most": int(turn[-1]) if len(turn) else None,
             "first_class": int(cls[0]) if len(cls) else None, "last_class": int(cls[-1]) if len(cls) else None}
    single = np.full(int(n.sum()), DELETE, np.uint8)
    single[np.cumsum(n) - n] = code
    return facts, single


def _pieces(batches):
    """Conversations of a sorted partition; the first and the last may go on in another one."""
    part, number, held, waiting, rows = TaskContext.get().partitionId(), 0, None, [], 0

    def closed(last: bool = False):
        nonlocal held, number, rows
        name, parts = held
        facts, codes = _facts(*(np.concatenate(x) for x in zip(*parts)))
        waiting.append(({"conv_id": name, "part": part, "slot": 0 if number == 0 else 1 if last else None, **facts}, codes))
        number, held, rows = number + 1, None, rows + len(codes)

    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0)
        key = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), batch.num_rows]
        turn = batch.column(1)
        values = [turn.fill_null(0).to_numpy(), turn.is_valid().to_numpy(zero_copy_only=False),
                  *[batch.column(k).to_numpy() for k in (2, 3, 4, 5)]]
        names = ids.take(pa.array(cuts[:-1])).to_pylist()
        for lo, hi, name in zip(cuts[:-1], cuts[1:], names):
            if held is not None and (held[0] != name):
                closed()
            held = held or (name, [])
            held[1].append([x[lo:hi] for x in values])
        if rows >= SOLVED_ROWS:
            yield _solved_pieces(waiting)
            waiting, rows = [], 0
    if held is not None:
        closed(last=True)
    if waiting:
        yield _solved_pieces(waiting)


def _solved_pieces(waiting: list) -> pa.RecordBatch:
    """Whole conversations with their audits; open stretches with their codes and matrices."""
    length = np.array([len(x) for _, x in waiting])
    codes, at = np.concatenate([x for _, x in waiting]), np.cumsum(length) - length
    is_open = np.array([row["slot"] is not None for row, _ in waiting])
    whole = np.flatnonzero(~is_open)
    if len(whole):
        start = np.zeros(len(whole), np.int64)
        cost, rank = forward(codes, at[whole], length[whole], start)
        end = _end(cost, rank)
        some = length[whole] > 0
        said = solved(codes, at[whole][some], length[whole][some], start[some], end[some])
        price = cost[np.arange(len(end)), end] + TAIL[end]
        for k, w in enumerate(whole.tolist()):
            audit = b"".join(said[at[w]:at[w] + length[w]].tolist()).decode()
            waiting[w][0].update(cost=int(price[k]), audit=audit + "I" * TAIL_INSERTS[end[k]])
    for w in np.flatnonzero(is_open).tolist():
        cost, rank = forward(codes, np.full(4, at[w]), np.full(4, length[w]), np.arange(4))
        waiting[w][0].update(codes=waiting[w][1].tobytes(), matrix=np.stack((cost, rank)).astype(np.int64).tobytes())
    return pa.RecordBatch.from_pylist([row for row, _ in waiting], _PIECE)


_CROSS = "part int, slot int, first int, last int, tail int, " + ", ".join(f"{x} long" for x in (*_FACTS, "least", "most", "cost"))


def _crossed(table: pa.Table) -> pa.Table:
    """The states at the cuts of one conversation, from the matrices of its stretches; facts go to its last one."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["slot"]))
    cost, rank, ways = [0, FAR, FAR, FAR], [0, 0, 0, 0], []
    for row in rows:
        m = np.frombuffer(row["matrix"], np.int64).reshape(2, 4, 4)
        # the rows of a state that can't be reached have costs of FAR or more
        best = [min((cost[s] + int(m[0, s, t]), rank[s], int(m[1, s, t]), s) for s in range(4)) for t in range(4)]
        ways.append([b[3] for b in best])
        cost = [min(b[0], FAR) for b in best]
        lows = [(b[1], b[2]) if b[0] < FAR else (9, 9) for b in best]
        rank = [sum(x < y for x in lows) for y in lows]
    end = int(_end(np.array([cost]), np.array([rank]))[0])
    total = {x: sum(r[x] for r in rows) for x in _FACTS}
    turned = [r for r in rows if r["least"] is not None]
    total["turns"] -= sum(a["most"] == b["least"] for a, b in zip(turned, turned[1:]))
    filled = [r for r in rows if r["first_class"] is not None]
    total["illegal"] += sum(a["last_class"] * 4 + b["first_class"] not in (1, 6, 9) for a, b in zip(filled, filled[1:]))
    facts = {**total, "least": min((r["least"] for r in turned), default=None), "most": max((r["most"] for r in turned), default=None),
             "cost": cost[end] + int(TAIL[end])}
    out, state = [], end
    for row, way in zip(rows[::-1], ways[::-1]):
        out.append({"part": row["part"], "slot": row["slot"], "first": way[state], "last": state,
                    "tail": TAIL_INSERTS[end] if not out else 0, **(facts if not out else {})})
        state = way[state]
    kinds = {"int": pa.int32(), "long": pa.int64()}
    return pa.Table.from_pylist(out, pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in _CROSS.split(", ")]))


def _open_audits(batches):
    for batch in batches:
        audits = []
        for codes, first, last, tail in zip(*(batch.column(k).to_pylist() for k in ("codes", "first", "last", "tail"))):
            codes = np.frombuffer(codes, np.uint8)
            said = solved(codes, np.zeros(1, np.int64), np.array([len(codes)]), np.array([first]), np.array([last])) if len(codes) else []
            audits.append(b"".join(list(said)).decode() + "I" * tail)
        yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in _AUDIT_COLUMNS[:-1]], pa.array(audits, pa.string())], _AUDIT_COLUMNS)


_AUDIT_COLUMNS = ["conv_id", "part", "slot", "rows", "blank", "duplicate", "truncated", "illegal", "turns", "least", "most", "cost", "audit"]
AUDIT = ("conv_id long, part int, slot int, rows long, blank long, duplicate long, truncated long, illegal long, turns long, "
         "least long, most long, cost long, audit string")
ORDER = ["conv_id", "turn", "role", "h1", "h2"]


def audits(rows: DataFrame) -> DataFrame:
    """Counts and edits of every conversation, one row for each stretch of it.

    ``rows``: conv_id, turn, role, text, and gone (rows that only name their conversation).
    """
    end = F.rtrim("text", F.lit(BLANKS))
    kind = F.when(c("gone"), 3).when(end == "", 1).when(F.right(end, F.lit(1)).isin(".", "!", "?"), 0).otherwise(2)
    initial = F.substring("role", 1, 1)
    cls = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    keys = rows.select(
        "conv_id", *[F.when(~c("gone"), c(x)).alias(x) for x in ("turn", "role")],
        *[F.when(~c("gone"), f("text")).alias(x) for x, f in (("h1", F.xxhash64), ("h2", F.hash))],
        cls.alias("cls"), kind.alias("kind"))
    # equal rows of a turn are one counted row before anything is sorted
    keys = stored(keys.groupBy("conv_id", "turn", "role", "h1", "h2", F.when(c("kind") < 3, c("cls")).otherwise(3).alias("cls"), "kind")
                  .agg(F.count("*").alias("n")), "turns")
    text = ["conv_id", "role", "h1", "h2"]
    firsts = (keys.where(c("kind").isin(0, 2)).groupBy(*text).agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("times"))
              .where("times > 1").select(c("conv_id").alias("_c"), c("role").alias("_r"), c("h1").alias("_1"), c("h2").alias("_2"), "first"))
    same = c("conv_id").eqNullSafe(c("_c")) & (c("role") == c("_r")) & (c("h1") == c("_1")) & (c("h2") == c("_2"))
    seen = c("first").isNotNull() & ~c("first.turn").eqNullSafe(c("turn"))
    code = F.when((c("kind") == 1) | seen, DELETE).otherwise(c("cls") * 2 + F.when(c("kind") == 2, 1).otherwise(0))
    coded = keys.join(firsts, same, "left").select(*ORDER, "cls", code.alias("code"), "kind", "n")
    sorted_ = coded.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    pieces = stored(sorted_.select("conv_id", "turn", "cls", "code", "kind", "n").mapInArrow(_pieces, PIECE), "stretches")
    # a partition has two open stretches at most
    cut = pieces.where("slot is not null")
    states = cut.drop("codes", "cost", "audit").groupBy("conv_id").applyInArrow(_crossed, _CROSS)
    settled = cut.select("conv_id", "part", "slot", "codes").join(states, ["part", "slot"]).mapInArrow(_open_audits, AUDIT)
    return pieces.where("slot is null").select(*_AUDIT_COLUMNS).union(settled)


# --- repaired conversations -----------------------------------------------------------

class _Writer:
    """Applies the edits of one conversation row by row."""

    def __init__(self, letters: str):
        self.letters, self.at, self.state = letters, 0, 0

    def inserted(self):
        while self.at < len(self.letters) and self.letters[self.at] == "I":
            self.at += 1
            yield self._forced(), ""

    def _forced(self) -> str:
        self.state = 3 if self.state == 2 else 2
        return "assistant" if self.state == 3 else "user"

    def rows(self, role: str, text: str):
        yield from self.inserted()
        letter = self.letters[self.at]
        self.at += 1
        if letter == "K":
            self.state = {"s": 1, "u": 2, "a": 3}[role[0]]
            yield role, text
        elif letter == "R":
            yield self._forced(), text


def _conversations(batches, begun, row, ended):
    """Feeds sorted audits and rows, conversation by conversation, to three functions, and yields what they yield."""
    name, writer, parts, facts = None, None, [], None
    for batch in batches:
        tags, ids, audit, role, text = (batch.column(k).to_pylist() for k in ("tag", "conv_id", "audit", "role", "text"))
        for k, tag in enumerate(tags):
            if tag:
                writer = writer or begun(name, "".join(parts), facts)
                yield from row(writer, role[k], text[k])
                continue
            if parts and (writer is not None or ids[k] != name):
                yield from ended(writer or begun(name, "".join(parts), facts))
                writer, parts = None, []
            name = ids[k]
            parts.append(audit[k])
            if batch.column("cost")[k].is_valid:  # the counts stand beside the last stretch
                facts = {x: batch.column(x)[k].as_py() for x in (*_FACTS, "least", "most", "cost")}
    if parts:
        yield from ended(writer or begun(name, "".join(parts), facts))


def _together(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Audits, then rows, of each conversation side by side in order."""
    blank = lambda names, frame: [F.lit(None).cast(frame.schema[x].dataType).alias(x) for x in names]
    texts = rows.where("not gone").select("conv_id", "turn", "role", "text", F.xxhash64("text").alias("h1"), F.hash("text").alias("h2"))
    facts = [x for x in _AUDIT_COLUMNS if x not in ("conv_id",)]
    one = found.select(F.lit(0).alias("tag"), "conv_id", *facts, *blank(["turn", "role", "text", "h1", "h2"], texts))
    two = texts.select(F.lit(1).alias("tag"), "conv_id", *blank(facts, found), "turn", "role", "text", "h1", "h2")
    return one.unionByName(two).repartition("conv_id").sortWithinPartitions("conv_id", "tag", "part", "slot", *ORDER[1:])


_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Digest(_Writer):
    """The digest of a conversation's repaired lines, fed in order."""

    def __init__(self, name, letters: str, facts: dict):
        super().__init__(letters)
        self.name, self.facts, self.sha, self.begun = name, facts, hashlib.sha256(), False

    def add(self, lines) -> tuple:
        for role, text in lines:
            self.sha.update((f"\n{role}:{text}" if self.begun else f"{role}:{text}").encode())
            self.begun = True
        return ()

    def row(self) -> tuple:
        f = self.facts
        gaps = 0 if f["least"] is None else f["most"] - f["least"] + 1 - f["turns"]
        return (self.name, gaps, *[f[x] for x in ("blank", "duplicate", "truncated", "illegal", "cost")], self.letters, self.sha.hexdigest())


def _packed(rows, schema: str):
    """Record batches of rows."""
    fields = [x.split() for x in schema.split(", ")]
    names, kinds = [x[0] for x in fields], [pa.string() if x[1] == "string" else pa.int64() for x in fields]
    rows = iter(rows)
    while part := list(itertools.islice(rows, 5000)):
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*part), kinds)], names)


def _digests(batches):
    def ended(writer):
        writer.add(writer.inserted())
        yield writer.row()

    yield from _packed(_conversations(batches, _Digest, lambda writer, role, text: writer.add(writer.rows(role, text)), ended), _RESULT)


def repaired(rows: DataFrame) -> DataFrame:
    """One row per conversation: counts, cost, edits and a digest of what they make of it."""
    return _together(rows, audits(rows)).mapInArrow(_digests, _RESULT)


_LINES = "conv_id long, position long, role string, text string"


class _Numbered(_Writer):
    def __init__(self, name, letters: str, facts: dict):
        super().__init__(letters)
        self.name, self.count = name, 0

    def lines(self, lines):
        for role, text in lines:
            yield self.name, self.count, role, text
            self.count += 1


def _written(batches):
    yield from _packed(_conversations(batches, _Numbered, lambda writer, role, text: writer.lines(writer.rows(role, text)),
                                      lambda writer: writer.lines(writer.inserted())), _LINES)


def repaired_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, position, role, text): the repaired conversations themselves."""
    return _together(rows, audits(rows)).mapInArrow(_written, _LINES)


def plain_rows(conversations: DataFrame) -> DataFrame:
    """The columns that repair takes, null roles and texts as one space."""
    return conversations.select(c("conv_id").cast("long"), c("turn").cast("long"),
                                *[F.coalesce(c(x).cast("string"), F.lit(" ")).alias(x) for x in ("role", "text")], F.lit(False).alias("gone"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults put in by a checksum of conversation and turn; rows taken out stay as ``gone``."""
    rows = plain_rows(conversations)
    name = F.concat_ws(":", *[F.coalesce(c(x).cast("string"), F.lit(" ")) for x in ("conv_id", "turn")])
    fault = F.pmod(F.crc32(name.cast("binary")), F.lit(20)).cast("int")
    rows = rows.withColumn("_fault", fault)
    # the copy of a repeated row is made here; both are equal, so their order doesn't matter
    rows = rows.withColumn("_copy", F.explode(F.when(c("_fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.select("conv_id", "turn", F.when(c("_fault") == 4, "user").otherwise(c("role")).alias("role"),
                       F.when(c("_fault") == 1, "").when(c("_fault") == 2, F.translate("text", ".!?", "")).otherwise(c("text")).alias("text"),
                       (c("_fault") == 0).alias("gone"))


def repaired_after_damage(conversations: DataFrame) -> DataFrame:
    return repaired(damaged(conversations))
