"""Tries of conversation prefixes: burst tries whose containers Spark deals out to tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.scans import running_before
from tessera.plans.tables import saved

#: Turns that a container holds at most; larger ones burst.
CONTAINER = 512
#: Lanes of the key of a prefix, 32 bits each, and conversation ids that one piece of a list of them spells out.
LANES, LISTED = 4, 4096
_MASK = (1 << 32) - 1
_WORD = r"[^\x20\x09-\x0D]+"


def placed_turns(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Turns with their places from 0: ``conv long, place long, turn_key string, words long``, by turn (nulls first), role and text.

    ``turn_key`` is the MD5 digest of role and text, null ones empty.  Rows without an id take no part; repeated rows are turns of their own.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.filter(F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").cast("long").alias("conv"), "turn", role.alias("role"), F.sha2(text, 256).alias("tie"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("turn_key"), F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words"),
    )
    return running_before(rows, "conv", ["turn", "role", "tie"], {"place": F.lit(1)}, {}).select("conv", "place", "turn_key", "words")


def rebuilt(placed: DataFrame, block: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that start as the first one of their block does: the table of their ids and their turns, as ``placed_turns`` gives.

    With ``h = crc32(decimal id) % heads`` conversation c has the first h turns of conversation ``c - c % block`` (all, if fewer; none without it) and then its own after its first h.
    """
    placed = saved(placed)
    convs = saved(placed.select("conv").distinct().withColumns({"h": F.crc32(F.col("conv").cast("string").cast("binary")) % heads, "base": F.col("conv") - F.col("conv") % block}))
    first = placed.filter(F.col("place") < heads - 1).withColumnRenamed("conv", "base")
    lent = convs.join(first, "base").filter(F.col("place") < F.col("h")).select("conv", "place", "turn_key", "words")
    sizes = first.groupBy("base").agg(F.count("*").alias("there"))
    known = convs.join(sizes, "base", "left").select("conv", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("lent"))
    own = placed.join(known, "conv").filter(F.col("place") >= F.col("h")).select("conv", (F.col("place") - F.col("h") + F.col("lent")).alias("place"), "turn_key", "words")
    return convs.select("conv"), lent.unionByName(own)


def prefix_trie(convs: DataFrame, turns: DataFrame, container: int = CONTAINER) -> DataFrame:
    """The trie of all prefixes of conversations.

    ``convs``: ``conv long``, each id once, also of conversations without turns.  ``turns``: ``conv, place``
    (from 0 without gaps), ``turn_key, words``, as ``placed_turns`` gives.  Returns a row per distinct
    sequence of first turns, the empty one included: ``conv_id long`` (smallest member), ``depth long,
    parent_conv_id long`` (null for the root), ``n_convs, n_children, n_leaves`` (childless nodes in its
    subtree, itself included), ``saved_tokens`` (over its subtree the words of each node's last turn times
    its members but one) and ``ends_sha256`` (over the ids, ascending and joined by commas, of the
    members that end there).

    Method: burst trie.  A prefix has a key of 128 bits: sums over its turns of numbers drawn from turn
    and place, by a scan over ranges.  Conversations with the same sequence are one, with a weight, so
    copies weigh nothing.  A node under which more than ``container`` turns lie bursts: it becomes
    a trie head, and its suffixes go on by their next turn.  As keys name whole prefixes, one aggregation
    finds all heads, however deep.  What is under no further head are containers of suffixes, which are
    dealt out by their first node, sorted and swept into nodes by one stack.  Heads take counts, leaves and savings
    from their conversations' sums: each node is owned by the smallest sequence through it, and what a
    sequence owns below a depth follows from another scan.  So neither a common first turn nor
    a very long conversation meets in one task.

    Ids of members that end at one node are written in pieces of 4096 by a range sort; only the digest, which
    has to read them in order, runs over the pieces in one task.  Different sequences share a key with
    a chance of about 2**-128 for a pair.  Sums of places are exact up to 2**31 turns of one conversation.
    Tables without conversations give no rows; those without any turn a root alone.
    """
    numbered = turns.select("conv", "place", "words", *(_drawn(i).alias(f"x{i}") for i in range(LANES)))
    scanned = saved(running_before(numbered, "conv", ["place"], {f"s{i}": F.col(f"x{i}") for i in range(LANES)}, {}))
    steps = scanned.select("conv", (F.col("place") + 1).alias("depth"), "words", *_key("n", inclusive=True), *_key("p", inclusive=False))
    roots = convs.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), *(F.lit(0).cast("long").alias(c) for c in ("n1", "n2")), *(F.lit(None).cast("long").alias(c) for c in ("p1", "p2")))
    steps = saved(roots.unionByName(steps))

    ends = saved(steps.groupBy("conv").agg(F.max(F.struct("depth", "n1", "n2")).alias("end")).select("conv", "end.*"))
    sequences = saved(ends.groupBy("n1", "n2").agg(F.count("*").alias("weight"), F.min("conv").alias("owner"), F.first("depth").alias("length")))
    digests = _digests(ends.join(sequences.filter("weight > 1").select("n1", "n2", "owner"), ["n1", "n2"]).select("owner", "conv"))
    kept = saved(steps.join(sequences.select(F.col("owner").alias("conv"), "weight", "length"), "conv"))

    about = kept.groupBy("n1", "n2").agg(
        F.sum(F.col("length") - F.col("depth") + 1).alias("size"), F.min("conv").alias("conv_id"), F.sum("weight").alias("n_convs"), F.max(F.when(F.col("depth") == F.col("length"), F.col("conv"))).alias("ended"),
        F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("depth").alias("depth"), F.first("words").alias("words"),
    )
    heads = saved(about.filter(F.col("size") > container).drop("size"))
    marked = saved(kept.join(heads.select("n1", "n2", F.lit(True).alias("head"), F.col("conv_id").alias("node_owner"), "n_convs"), ["n1", "n2"], "left"))
    below = marked.filter("head is null")
    tops = below.groupBy("conv").agg(F.min(F.struct("depth", "n1", "n2")).alias("top")).select("conv", F.col("top.n1").alias("t1"), F.col("top.n2").alias("t2"))
    dealt = below.join(tops, "conv").select("t1", "t2", "conv", "depth", "n1", "n2", "p1", "p2", "words", "weight").repartition("t1", "t2").sortWithinPartitions("t1", "t2", "conv", "depth")
    swept = saved(dealt.mapInArrow(sweep_containers, _SWEPT))

    # What each sequence owns of heads, at which depth, and of its container.
    owned = F.when(F.col("node_owner") == F.col("conv"), (F.col("n_convs") - 1) * F.col("words")).otherwise(0)
    own = running_before(marked.filter("head").select("conv", "depth", "n1", "n2", owned.alias("own")), "conv", ["depth"], {"before": F.col("own")}, {})
    own = saved(own)
    totals = own.groupBy("conv").agg(F.sum("own").alias("all"))
    contained = swept.filter("top").select(F.col("conv_id").alias("conv"), F.col("saved_tokens").alias("c_saved"), F.col("n_leaves").alias("c_leaves"))
    per_sequence = totals.join(contained, "conv", "left")
    under = own.join(per_sequence, "conv").groupBy("n1", "n2").agg(F.sum(F.col("all") - F.col("before") + F.coalesce("c_saved", F.lit(0))).alias("saved_tokens"), F.sum(F.coalesce("c_leaves", F.lit(0))).alias("n_leaves"))
    children = heads.select("p1", "p2").unionByName(swept.filter("top").select("p1", "p2")).groupBy(F.col("p1").alias("n1"), F.col("p2").alias("n2")).agg(F.count("*").alias("n_children"))
    parents = heads.select(F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("conv_id").alias("above"))
    upper = heads.join(under, ["n1", "n2"]).join(children, ["n1", "n2"], "left").join(parents, ["p1", "p2"], "left")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ended"]
    upper = upper.withColumns({"parent_conv_id": F.col("above"), "n_children": F.coalesce("n_children", F.lit(0))}).select(columns)
    tops_ = swept.filter("top").join(parents, ["p1", "p2"], "left").withColumn("parent_conv_id", F.col("above")).select(columns)
    nodes = upper.unionByName(tops_).unionByName(swept.filter("not top").select(columns))
    one, none = F.sha2(F.col("ended").cast("string"), 256), F.lit(hashlib.sha256(b"").hexdigest())
    return nodes.join(digests, nodes["ended"] == digests["owner"], "left").select(*columns[:-1], F.coalesce("digest", one, none).alias("ends_sha256"))


_SWEPT = "p1 long, p2 long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ended long, top boolean"


def _drawn(lane: int) -> Column:
    """A number of 32 bits for a turn at its place."""
    whole = F.xxhash64(F.lit(lane // 2), "turn_key", "place")
    return (F.shiftrightunsigned(whole, 32) if lane % 2 else whole).bitwiseAND(F.lit(_MASK))


def _key(name: str, inclusive: bool) -> list[Column]:
    sums = [(F.col(f"s{i}") + F.col(f"x{i}") if inclusive else F.col(f"s{i}")).bitwiseAND(F.lit(_MASK)) for i in range(LANES)]
    return [F.shiftleft(sums[2 * k], 32).bitwiseOR(sums[2 * k + 1]).alias(f"{name}{k + 1}") for k in range(LANES // 2)]


def _digests(members: DataFrame) -> DataFrame:
    """For each ``owner`` the digest of its ids ``conv``, ascending and joined by commas: ``owner long, digest string``."""
    ranges = members.repartitionByRange("owner", "conv").withColumn("part", F.spark_partition_id()).sortWithinPartitions("owner", "conv")
    pieces = ranges.mapInArrow(_spelled, "owner long, part int, piece int, ids binary")
    return pieces.repartition("owner").sortWithinPartitions("owner", "part", "piece").mapInArrow(_hashed, "owner long, digest string")


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ids as text, in pieces."""
    owner, part, held, piece = None, None, [], 0

    def given() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"owner": pa.array([owner], pa.int64()), "part": pa.array([part], pa.int32()), "piece": pa.array([piece], pa.int32()), "ids": pa.array([",".join(map(str, held)).encode()], pa.binary())})

    for batch in batches:
        for o, c, p in zip(*(batch.column(x).to_pylist() for x in ("owner", "conv", "part")), strict=True):
            if held and (o != owner or len(held) == LISTED):
                yield given()
                piece, held = piece + 1, []
            owner, part = o, p
            held.append(c)
    if held:
        yield given()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    owner, running = None, hashlib.sha256()

    def given() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"owner": pa.array([owner], pa.int64()), "digest": [running.hexdigest()]})

    for batch in batches:
        for o, ids in zip(batch.column("owner").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if o == owner:
                running.update(b",")
            else:
                if owner is not None:
                    yield given()
                owner, running = o, hashlib.sha256()
            running.update(ids)
    if owner is not None:
        yield given()


def sweep_containers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sweeps containers, which follow each other whole, into nodes; rows are sorted by container, conversation and depth."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        waiting.append(batch)
        table = pa.Table.from_batches(waiting)
        t1, t2 = (table.column(c).to_numpy() for c in ("t1", "t2"))
        other = ((t1 != t1[-1]) | (t2 != t2[-1])).nonzero()[0] if len(t1) else []
        if len(other):  # the last container may go on in the next batch
            whole = int(other[-1]) + 1
            yield _swept(table.slice(0, whole))
            waiting = table.slice(whole).to_batches()
    if sum(b.num_rows for b in waiting):
        yield _swept(pa.Table.from_batches(waiting))


def _swept(table: pa.Table) -> pa.RecordBatch:
    rows = list(zip(*(table.column(c).to_pylist() for c in ("t1", "t2", "conv", "depth", "n1", "n2", "p1", "p2", "words", "weight")), strict=True))
    containers: dict[tuple, list[list]] = {}
    for i, row in enumerate(rows):
        suffixes = containers.setdefault(row[:2], [])
        if not i or rows[i - 1][2] != row[2] or rows[i - 1][:2] != row[:2]:
            suffixes.append([])
        suffixes[-1].append(row)
    found: list[tuple] = []
    for suffixes in containers.values():
        suffixes.sort(key=lambda s: [r[4:6] for r in s])
        _sweep(suffixes, found)
    names = ["p1", "p2", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ended", "top"]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.bool_() if n == "top" else pa.int64()) for n, c in zip(names, zip(*found, strict=True), strict=True)], names=names)


class _Node:
    __slots__ = ("children", "ended", "first", "inside", "leaves", "members", "row", "saved")

    def __init__(self, row: tuple):
        self.row, self.first, self.members, self.ended, self.leaves, self.saved = row, row[2], 0, None, 0, 0
        self.children, self.inside = 0, []


def _sweep(suffixes: list[list[tuple]], found: list[tuple]) -> None:
    """Sorted suffixes become nodes: the stack holds the path of the last one, and what it leaves is complete."""
    path: list[_Node] = []

    def leave(keep: int) -> None:
        while len(path) > keep:
            node = path.pop()
            node.leaves = node.leaves or 1
            node.saved += (node.members - 1) * node.row[8]
            top = not path
            if not top:
                above = path[-1]
                above.first, above.members, above.saved = min(above.first, node.first), above.members + node.members, above.saved + node.saved
                above.leaves, above.children = above.leaves + node.leaves, above.children + 1
                above.inside.append(len(found))
            for at in node.inside:  # children know their parent's smallest member only now
                found[at] = (*found[at][:4], node.first, *found[at][5:])
            found.append((node.row[6] if top else None, node.row[7] if top else None, node.first, node.row[3], None, node.members, node.children, node.leaves, node.saved, node.ended, top))

    for suffix in suffixes:
        shared = 0
        while shared < min(len(path), len(suffix)) and path[shared].row[4:6] == suffix[shared][4:6]:
            shared += 1
        leave(shared)
        path.extend(_Node(row) for row in suffix[shared:])
        last = path[-1]
        last.ended, last.members = suffix[-1][2], last.members + suffix[-1][9]
        last.first = min(last.first, suffix[-1][2])
    leave(0)
