"""Conversation structure repair at the least cost, with the least audit among the cheapest.

Rows of a conversation stand by turn (nulls first), rows of one turn by the SHA-256 of role and text, equal rows side by
side. The first fault of a row counts: blank (only white space), duplicate (role and text seen earlier), truncated (the
last character is none of ``.!?``). The edits are Keep (cost 0), Rerole to user or assistant (2), Delete (3; the only edit
of blank and duplicate rows) and Insert of an empty user or assistant row (2); a truncated row that stays adds 1. The
role initials that result match ``(s?(ua)+)?``; the audit, the initials of all edits in order, is the ASCII-least one.

1. Pieces. Equal rows are counted first. The counted rows, without texts, are dealt by range, so each partition holds a
   stretch of the global order and a hot conversation is cut into as many pieces as it needs. At most two conversations
   of a partition go on in other ones.
2. Cost DP. States: nothing yet, after s, after u, after a. A piece is a 4 x 4 matrix of least costs; the matrices of a
   conversation with several pieces are folded from its end, which tells each piece what each exit costs.
3. Prefix-doubling path ranking. Nodes are (place, state), arcs are edits on cheapest paths. Nodes are ranked by the first
   letter of their least path, then by 2, 4, 8, ... letters: the rank of 2n letters is the rank of the pair (rank of n
   letters, rank of n letters from where those end), and the pointer over n arcs doubles with it. An arc is chosen by its
   letter, then the rank of its target. A node has one arc per letter, so its least n-letter path ends in one node. The
   doubled pointers then list all places of a path at once, without a walk.
4. Pieces of one conversation are joined by their entry states, and decisions meet their texts by unique keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibliospark.llm.common import stored

SYSTEM, USER, ASSISTANT, OTHER = range(4)
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
LETTERS = np.frombuffer(b"DIKR", np.uint8)  # in ASCII order
D, I, K, R = range(4)
FAR = 1 << 40
KEPT = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1] * 4])  # [role, state]: the state after a row of that role
MADE = np.array([2, 2, 3, 2])  # the state after the user or assistant row that fits
ENDING = np.array([0, 4, 2, 0])  # cost of the inserts that close a conversation
LEGAL = np.zeros((4, 4), bool)
LEGAL[[SYSTEM, USER, ASSISTANT], [USER, ASSISTANT, USER]] = True
SPACES = " \t\n\x0b\x0c\r"


def keyed(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys where null equals null."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    match = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, match, how).drop(*[f"_r_{k}" for k in keys])


class Units:
    """The rows of several pieces as units: one per row, and one more for its further copies, which all go.

    ``bounds``: the first unit of each piece; ``first``: the unit of each row; copies: rows that a unit stands for.
    """

    def __init__(self, pieces: list):
        sizes = [len(p) for p in pieces]
        rows = [x for p in pieces for x in p]
        take = lambda name: np.fromiter((x[name] for x in rows), np.int64, len(rows))
        role, fault, n = take("role"), take("fault"), take("n")
        more = (n > 1).astype(np.int64)
        self.first = np.arange(len(rows)) + np.cumsum(more) - more
        self.row = np.repeat(np.arange(len(rows)), 1 + more)
        extra = np.ones(len(self.row), bool)
        extra[self.first] = False
        self.role, self.goes, self.late = role[self.row], extra | np.isin(fault[self.row], (BLANK, DUPLICATE)), (fault[self.row] == TRUNCATED) & ~extra
        self.copies = np.where(extra, n[self.row] - 1, 1)
        ends = np.cumsum(sizes)
        self.bounds = np.append(0, np.append(self.first, len(self.row))[ends]).astype(np.int64)

    def __len__(self) -> int:
        return len(self.row)


def edit_costs(units: Units) -> tuple[np.ndarray, np.ndarray]:
    """(cost, next state) of [unit, state, letter]; FAR where an edit is not possible. Inserts stay at the unit."""
    n = len(units)
    state = np.broadcast_to(np.arange(4), (n, 4))
    cost, to = np.full((n, 4, 4), FAR), np.zeros((n, 4, 4), np.int64)
    late, stays = units.late[:, None], ~units.goes[:, None]
    cost[:, :, D], to[:, :, D] = (3 * units.copies)[:, None], state
    cost[:, :, I], to[:, :, I] = 2, MADE
    kept = KEPT[units.role]
    cost[:, :, K], to[:, :, K] = np.where(stays & (kept >= 0), late, FAR), np.maximum(kept, 0)
    cost[:, :, R], to[:, :, R] = np.where(stays & (kept != MADE), 2 + late, FAR), MADE
    return cost, to


def least_costs(units: Units, goals: np.ndarray) -> np.ndarray:
    """Least cost from [node place, state, goal]; goals: cost of leaving each piece in [piece, state, goal].

    Places of a piece: one per unit and its end, where nothing is inserted (the next piece or the ending does that). All
    pieces are walked from their ends in step.
    """
    cost, to = edit_costs(units)
    sizes, places = np.diff(units.bounds), units.bounds[:-1] + np.arange(len(units.bounds) - 1)
    out = np.full((len(units) + len(sizes), 4, goals.shape[2]), FAR)
    out[places + sizes] = goals
    by = np.argsort(-sizes, kind="stable")
    active = np.searchsorted(-sizes[by], -np.arange(sizes.max(initial=0)), "left")  # pieces with more units than the step
    for step, many in enumerate(active):
        piece = by[:many]
        unit, place = units.bounds[piece + 1] - 1 - step, places[piece] + sizes[piece] - 1 - step
        after = out[place + 1]
        index = np.arange(many)[:, None]
        best = np.min([cost[unit, :, e][:, :, None] + after[index, to[unit, :, e]] for e in (D, K, R)], 0)
        for _ in range(2):
            best = np.minimum(best, 2 + best[:, MADE])
        out[place] = np.minimum(best, FAR)
    return out


def ranked_paths(first: np.ndarray, arcs: np.ndarray, targets: np.ndarray, entries: np.ndarray) -> list[np.ndarray]:
    """Nodes of the least path from each entry, by prefix doubling.

    arcs[node, letter]: whether the letter's edit lies on a cheapest path, with its target; a node without an arc ends a
    path. ``first`` has the least letter of each node (4 at an end).
    """
    nodes = np.arange(len(first))
    open_ = first < 4
    rank, pointer = np.unique(first, return_inverse=True)[1], np.where(open_, targets[nodes, np.minimum(first, 3)], nodes)
    pointers = [pointer]
    while not np.array_equal(further := pointer[pointer], pointer):
        rank, pointer = np.unique(rank * np.int64(len(nodes) + 1) + rank[pointer], return_inverse=True)[1], further
        pointers.append(pointer)
    key = np.where(arcs, np.arange(4) * np.int64(len(nodes) + 1) + rank[targets], np.iinfo(np.int64).max)
    choice = np.where(open_, targets[nodes, key.argmin(1)], nodes)
    assert np.array_equal(choice, pointers[0])  # one arc per letter: the rank decides between arcs only by their letters
    owner, at, step = np.arange(len(entries)), entries, np.zeros(len(entries), np.int64)
    for level in range(len(pointers) - 1, -1, -1):
        far = pointers[level][at]
        moved = far != at
        owner, at, step = np.append(owner, owner[moved]), np.append(at, far[moved]), np.append(step, step[moved] + (1 << level))
    order = np.lexsort((step, owner))
    owner, at, step = owner[order], at[order], step[order]
    again = np.append(False, (owner[1:] == owner[:-1]) & (at[1:] == at[:-1]))  # jumps that ran into the end
    return np.split(at[~again], np.flatnonzero(np.diff(owner[~again])) + 1)


class Solved:
    """Cheapest edits of several pieces, by entry state."""

    def __init__(self, pieces: list, goals: np.ndarray, entry_states: int = 4):
        self.units = units = Units(pieces)
        cost, to = edit_costs(units)
        sizes = np.diff(units.bounds)
        self.places = units.bounds[:-1] + np.arange(len(sizes))
        least = least_costs(units, goals[:, :, None])[:, :, 0]
        place = np.arange(len(units)) + np.repeat(np.arange(len(sizes)), sizes)
        ahead = (place + 1)[:, None, None] * 4 + to
        ahead[:, :, I] -= 4
        value, flat = cost + least.ravel()[ahead], np.full((len(least) * 4, 4), False)
        arcs = (value == least[place][:, :, None]) & (value < FAR)
        node = (place[:, None] * 4 + np.arange(4)).ravel()
        flat[node] = arcs.reshape(-1, 4)
        targets = np.zeros((len(least) * 4, 4), np.int64)
        targets[node] = ahead.reshape(-1, 4)
        first = np.where(flat.any(1), flat.argmax(1), 4)
        entries = (self.places[:, None] * 4 + np.arange(entry_states)).ravel()
        self.letter = first
        self.unit_of = np.repeat(np.arange(len(least)) - np.repeat(np.arange(len(sizes)), sizes + 1), 4)
        self.paths = ranked_paths(first, flat, targets, entries)
        self.cost = least[self.places]
        self.entry_states = entry_states

    def path(self, piece: int, entry: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(letters, unit of each, exit state) from an entry state."""
        nodes = self.paths[piece * self.entry_states + entry]
        return self.letter[nodes[:-1]], self.unit_of[nodes[:-1]], int(nodes[-1] % 4)

    def audit(self, piece: int, entry: int) -> str:
        letters, units, _ = self.path(piece, entry)
        times = np.where(letters == D, self.units.copies[units] if len(units) else 1, 1)
        return np.repeat(LETTERS[letters], times).tobytes().decode()


def counted_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id as a string, turn, role, text, digest, n): equal rows once, counted; null roles and texts are one space."""
    role, text = F.coalesce(F.col("role"), F.lit(" ")), F.coalesce(F.col("text"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("digest", F.unhex(F.sha2(F.concat(F.sha2("role", 256), F.col("text")), 256)))


def role_number() -> Column:
    initial = F.substring("role", 1, 1)
    return F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)


def with_faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, n, role, fault): the fault of the first of the n equal rows, roles as numbers."""
    shown = F.rtrim("text", F.lit(SPACES))
    kinds = rows.select("conv_id", "turn", "digest", "n", role_number().alias("role"),
                        F.when(shown == "", BLANK).when(~F.substring(shown, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(FINE).alias("kind"))
    seen = kinds.groupBy("conv_id", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("later"), F.col("turn"))).alias("_first"))
    seen = seen.select("conv_id", "digest", F.col("_first.turn").alias("turn"), F.lit(True).alias("_new"))
    fault = F.when(F.col("kind") == BLANK, BLANK).when(F.col("_new").isNull(), DUPLICATE).otherwise(F.col("kind"))
    return keyed(kinds, seen, ["conv_id", "digest", "turn"], "left").select("conv_id", "turn", "digest", "n", "role", fault.alias("fault"))


def pieces_of(rows: DataFrame) -> DataFrame:
    """(conv_id, piece, rows): the stretches of conversations, in the order of pieces, cut at the bounds of range partitions."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, "conv_id", "turn", "digest").withColumn("piece", F.spark_partition_id())
    item = F.struct("turn", "digest", F.col("n").cast("long").alias("n"), F.col("role").cast("int").alias("role"), F.col("fault").cast("int").alias("fault"))
    return stored(dealt, "ranged").groupBy("conv_id", "piece").agg(F.sort_array(F.collect_list(item)).alias("rows"))


def _measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        units = Units(frame["rows"])
        goals = np.broadcast_to(np.where(np.eye(4, dtype=bool), 0, FAR), (len(frame), 4, 4))
        costs = least_costs(units, goals)[units.bounds[:-1] + np.arange(len(frame))] if len(frame) else np.empty((0, 4, 4))
        made = []
        for rows in frame["rows"]:
            roles = np.array([r["role"] for r in rows])
            made.append((int((~LEGAL[roles[:-1], roles[1:]]).sum()) + sum(r["n"] - 1 for r in rows), int(roles[0]), int(roles[-1])))
        yield pd.DataFrame({"conv_id": frame["conv_id"], "piece": frame["piece"], "costs": list(costs.reshape(len(frame), 16)),
                            "illegal": [m[0] for m in made], "opens": [m[1] for m in made], "closes": [m[2] for m in made]})


def _goals(parts: pd.Series) -> pd.Series:
    """What each exit of a piece costs to the end, and whether the step from the piece before is an illegal pair of roles."""
    out = []
    for pieces in parts:
        pieces, goal, made = sorted(pieces, key=lambda p: p["piece"]), ENDING, []
        for k in range(len(pieces) - 1, -1, -1):
            here = pieces[k]
            made.append({"piece": here["piece"], "goal": goal.tolist(), "illegal": int(k > 0 and not LEGAL[pieces[k - 1]["closes"], here["opens"]])})
            goal = np.minimum((np.array(here["costs"]).reshape(4, 4) + goal).min(1), FAR)
        out.append(made)
    return pd.Series(out)


def _solved(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        if not len(frame):
            continue
        several = frame["goal"].notna().to_numpy()
        goals = np.array([ENDING if not s else np.asarray(g) for g, s in zip(frame["goal"], several, strict=True)], np.int64)
        solved = Solved(list(frame["rows"]), goals)
        paths = [[{"audit": solved.audit(i, e), "leaves": solved.path(i, e)[2]} if e == 0 or several[i] else None for e in range(4)] for i in range(len(frame))]
        yield pd.DataFrame({"conv_id": frame["conv_id"], "piece": frame["piece"], "cost": solved.cost[:, 0], "paths": paths})


def _entries(parts: pd.Series) -> pd.Series:
    """The entry state of each piece of a conversation."""
    out = []
    for pieces in parts:
        state, made = 0, []
        pieces = sorted(pieces, key=lambda p: p["piece"])
        for p in pieces:
            made.append({"piece": p["piece"], "entry": state, "last": p["piece"] == pieces[-1]["piece"]})
            state = p["leaves"][state]
        out.append(made)
    return pd.Series(out)


def _edits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows that result from a piece's audit: the source row of each, or none for an insert."""
    for frame in frames:
        for conv, piece, rows, audit, state in zip(*(frame[c] for c in ("conv_id", "piece", "rows", "audit", "entry")), strict=True):
            roles, turns, digests, row, left = [], [], [], 0, rows[0]["n"]
            for letter in audit:
                if letter != "D":
                    state = int(MADE[state]) if letter != "K" else int(KEPT[rows[row]["role"], state])
                    roles.append(None if letter == "K" else "user" if state == 2 else "assistant")
                    turns.append(None if letter == "I" else rows[row]["turn"])
                    digests.append(None if letter == "I" else rows[row]["digest"])
                if letter != "I":
                    left -= 1
                    if not left:
                        row += 1
                        left = rows[row]["n"] if row < len(rows) else 0
            yield pd.DataFrame({"conv_id": np.full(len(roles), conv, object), "piece": piece, "place": np.arange(len(roles)), "role": np.array(roles, object),
                                "turn": pd.array(turns, "Int64"), "digest": pd.Series(digests, dtype=object)})


def repaired(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summary, rows) of conversations(conv_id, turn, role, text); other columns are ignored.

    summary: one row per conversation: conv_id, gaps (turns missing between the smallest and the largest), blank,
    duplicate, truncated, illegal (neighbouring rows whose role initials are not su, ua or au), cost, audit. rows: the
    repaired conversations, conv_id, piece, place, role, text, in the order of piece and place; a conversation that keeps
    nothing has none. A null conv_id is a conversation, null turns come first, null roles and texts are one space.
    Repeated rows are duplicates of each other. An empty table gives two empty ones. Audits are one value per
    conversation; everything before them is cut into pieces.
    """
    kind = conversations.schema["conv_id"].dataType
    texts = stored(counted_rows(conversations), "turns")
    faulty = stored(with_faults(texts), "faults")
    pieces = stored(pieces_of(faulty), "pieces")
    measured = stored(pieces.mapInPandas(_measured, "conv_id string, piece int, costs array<long>, illegal long, opens int, closes int"), "measured")
    joined = measured.groupBy("conv_id").agg(F.collect_list(F.struct("piece", "costs", "opens", "closes")).alias("_p"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    goals = stored(joined.select("conv_id", F.explode(F.pandas_udf(_goals, "array<struct<piece:int,goal:array<long>,illegal:long>>")("_p")).alias("_g")).select("conv_id", "_g.*"), "goals")
    asked = keyed(pieces, goals.drop("illegal"), ["conv_id", "piece"], "left")
    solved = stored(asked.mapInPandas(_solved, "conv_id string, piece int, cost long, paths array<struct<audit:string,leaves:int>>"), "paths")
    several = keyed(solved, goals.select("conv_id", "piece"), ["conv_id", "piece"])
    chains = several.groupBy("conv_id").agg(F.collect_list(F.struct("piece", F.col("paths.leaves").alias("leaves"))).alias("_p"))
    entries = chains.select("conv_id", F.explode(F.pandas_udf(_entries, "array<struct<piece:int,entry:int,last:boolean>>")("_p")).alias("_e")).select("conv_id", "_e.*")
    chosen = keyed(solved, entries, ["conv_id", "piece"], "left").select(
        "conv_id", "piece", F.coalesce("entry", F.lit(0)).alias("entry"), F.coalesce("last", F.lit(True)).alias("last"), "cost", "paths")
    path = F.get("paths", F.col("entry"))
    ending = F.when(F.col("last"), F.when(path.leaves == 1, "II").when(path.leaves == 2, "I")).otherwise("")
    chosen = stored(chosen.select("conv_id", "piece", "entry", F.concat(path.audit, F.coalesce(ending, F.lit(""))).alias("audit"), "cost"), "audits")
    parts = F.sort_array(F.collect_list(F.struct("piece", "audit", "cost")))
    audits = chosen.groupBy("conv_id").agg(parts.alias("_a")).select("conv_id", F.col("_a")[0].cost.alias("cost"), F.array_join("_a.audit", "").alias("audit"))
    illegal = measured.select("conv_id", "illegal").unionByName(goals.select("conv_id", "illegal")).groupBy("conv_id").agg(F.sum("illegal").alias("illegal"))
    number = lambda which: F.sum(F.when(F.col("fault") == which, F.col("n")).otherwise(0))
    copies = F.sum(F.when(F.col("fault").isin(FINE, TRUNCATED), F.col("n") - 1).otherwise(0))
    late = F.sum(F.when(F.col("fault") == TRUNCATED, 1).otherwise(0))
    turns = faulty.groupBy("conv_id", "turn").agg(number(BLANK).alias("blank"), (number(DUPLICATE) + copies).alias("duplicate"), late.alias("truncated"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
    counts = turns.groupBy("conv_id").agg(gaps.alias("gaps"), F.sum("blank").alias("blank"), F.sum("duplicate").alias("duplicate"), F.sum("truncated").alias("truncated"))
    summary = keyed(keyed(counts, illegal, ["conv_id"]), audits, ["conv_id"])
    edits = keyed(pieces, chosen.drop("cost"), ["conv_id", "piece"]).mapInPandas(_edits, "conv_id string, piece int, place long, role string, turn long, digest binary")
    edits = stored(edits, "edits")
    old = texts.select("conv_id", "turn", "digest", F.col("role").alias("_role"), "text")
    moved = keyed(edits.filter("digest is not null"), old, ["conv_id", "turn", "digest"]).select("conv_id", "piece", "place", F.coalesce("role", "_role").alias("role"), "text")
    made = edits.filter("digest is null").select("conv_id", "piece", "place", "role", F.lit("").alias("text"))
    typed = lambda df: df.withColumn("conv_id", F.col("conv_id").cast(kind))
    return typed(summary), typed(moved.unionByName(made))


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, sha256): SHA-256 of the rows ``role:text`` of each conversation, joined by newlines.

    One digest is one chain of blocks, so the rows of a conversation stream through one task, in order; memory holds a batch.
    """
    kind = rows.schema["conv_id"].dataType

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for frame in frames:
            done = []
            for is_null, conv, line in zip(frame["none"], frame["conv_id"], frame["line"], strict=True):
                data = line.encode("utf-8", "surrogatepass")
                if state is not None and current == (is_null, conv):
                    state.update(b"\n" + data)
                    continue
                if state is not None:
                    done.append((current[1], state.hexdigest()))
                current, state = (is_null, conv), hashlib.sha256(data)
            yield pd.DataFrame(done, columns=["conv_id", "sha256"], dtype=object)
        if state is not None:
            yield pd.DataFrame([(current[1], state.hexdigest())], columns=["conv_id", "sha256"], dtype=object)

    lines = rows.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("conv_id").isNull().alias("none"), "piece", "place", F.concat("role", F.lit(":"), "text").alias("line"))
    ordered = lines.repartition("conv_id").sortWithinPartitions("conv_id", "piece", "place")
    hashed = ordered.mapInPandas(run, "conv_id string, sha256 string")
    return hashed.select(F.col("conv_id").cast(kind).alias("conv_id"), "sha256")
