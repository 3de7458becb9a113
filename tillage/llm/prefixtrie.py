"""Trie of conversations by their turns: what starts alike is one node, and what it would save to store it once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillage.llm.common import cut, drop_cut, in_arrow, lookup, whole_text

#: Bytes of a turn in a path: the first 16 of the SHA-256 of its role and text, and 8 of its text's length.
TURN = 24
#: Turns of different conversations that one task makes a trie of; a larger subtrie is dealt anew by its next turn.
MAX_TURNS = 100_000
#: Conversation ids of one end whose numbers meet at a time are those of a range of this width.
RANGE = 65_536

NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """id, turn, code: a turn as TURN bytes in hexadecimal, null role and text being empty. Rows without an id are left out."""
    role, text = F.coalesce(whole_text(role_col), F.lit("")), F.coalesce(whole_text(text_col), F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * TURN - 16)
    code = F.concat(digest, F.lpad(F.hex(F.octet_length(text)), 16, "0"))
    found = conversations.select(F.col(id_col).cast("long").alias("id"), F.col(turn_col).alias("turn"), F.lower(code).alias("code"), *([role.alias("role"), text.alias("text")] if keep_text else []))
    return found.where("id is not null")


def taken(id_col: Column, most: int = 9) -> Column:
    """How many turns a conversation takes from its family's first: CRC-32 of the id's digits, modulo `most`."""
    return (F.crc32(id_col.cast("string").cast("binary")) % most).cast("int")


def rebuilt(coded: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """id, path (its turns' codes, one after another, as binary) of each conversation: the first taken(id) turns of
    conversation id - id % family, then its own turns after as many. One shuffle, by family; equal turn numbers go by code."""
    head = F.col("id") - F.col("id") % family
    rows = coded.groupBy(head.alias("head")).agg(F.sort_array(F.collect_list(F.struct("id", "turn", "code"))).alias("rows"))
    each = rows.select("head", "rows", F.explode(F.array_distinct("rows.id")).alias("id")).withColumn("h", taken(F.col("id"), most))
    path = F.expr("concat(slice(filter(rows, r -> r.id = head).code, 1, h), slice(filter(rows, r -> r.id = id).code, h + 1, size(rows)))")
    return each.select("id", F.unhex(F.array_join(path, "")).alias("path"))


def distinct_paths(conversations: DataFrame) -> DataFrame:
    """path, n, least, ends_sha256 of id, path: how many conversations have exactly this path, the smallest id and the
    digest of all ids. Copies meet as ranges of ids, whose numbers a task reads in order, so it holds a range at a time."""
    keyed = conversations.select(F.sha2("path", 256).alias("key"), F.floor(F.col("id") / RANGE).alias("range"), "id", "path")
    ranges = keyed.groupBy("key", "range").agg(F.any_value("path").alias("path"), F.sort_array(F.collect_list("id")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: list | None = None  # key, path, n, least, digest

        def batch(rows: list[list]) -> pa.RecordBatch:
            path, n, least, digest = ([r[k] for r in rows] for k in range(1, 5))
            return pa.RecordBatch.from_arrays([pa.array(path, pa.binary()), pa.array(n, pa.int64()), pa.array(least, pa.int64()), pa.array([d.hexdigest() for d in digest], pa.string())], names=["path", "n", "least", "ends_sha256"])

        for b in batches:
            done = []
            for key, path, ids in zip(b.column(0), b.column(2), b.column(3)):
                key, ids = key.as_py(), ids.as_py()
                if at is None or at[0] != key:
                    if at:
                        done.append(at)
                    at = [key, path.as_py(), 0, ids[0], hashlib.sha256()]
                at[4].update(("," * (at[2] > 0) + ",".join(map(str, ids))).encode())
                at[2] += len(ids)
            yield batch(done)
        yield batch([at] if at else [])

    dealt = ranges.select("key", "range", "path", "ids").repartition("key").sortWithinPartitions("key", "range")
    return in_arrow(dealt, run, "path binary, n long, least long, ends_sha256 string")


def subtries(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes from `depth` on of paths; `above` is the smallest member of the node above a path's first `depth` turns.

    A trie of dictionaries from a turn to a node; what is summed over subtrees comes from an iterative postorder. Node 0
    only holds the tops."""
    depth = int(rows["depth"].iloc[0])
    children: list[dict[bytes, int]] = [{}]
    parent, size, n, least, ends, level = [-1], [0], [0], [0], [NO_ENDS], [depth - 1]
    above: dict[int, int] = {}
    for path, times, smallest, digest, over in zip(rows["path"], rows["n"], rows["least"], rows["ends_sha256"], rows["above"]):
        path, node, at = bytes(path), 0, depth * TURN
        turn = path[:at]
        while turn:
            below = children[node].get(turn)
            if below is None:
                below = children[node][turn] = len(children)
                children.append({})
                parent.append(node)
                size.append(int.from_bytes(turn[-8:], "big"))
                n.append(0)
                least.append(smallest)
                ends.append(NO_ENDS)
                level.append(level[node] + 1)
                if not node:
                    above[below] = over
            node = below
            n[node] += times
            least[node] = min(least[node], smallest)
            turn = path[at : at + TURN]
            at += TURN
        ends[node] = digest
    order, waiting = [], [0]
    while waiting:
        order.append(node := waiting.pop())
        waiting.extend(children[node].values())
    leaves, saved = [0] * len(children), [0] * len(children)
    for node in reversed(order):  # children before their parent
        leaves[node] += not children[node]
        saved[node] += (n[node] - 1) * size[node]
        if node:
            leaves[parent[node]] += leaves[node]
            saved[parent[node]] += saved[node]
    over = [above[k] if not parent[k] else least[parent[k]] for k in range(1, len(children))]
    columns = (least[1:], level[1:], over, n[1:], [len(c) for c in children[1:]], leaves[1:], saved[1:], ends[1:])
    return pd.DataFrame(dict(zip((c.split()[0] for c in NODES.split(", ")), columns)))


def nodes(paths: DataFrame, max_turns: int = MAX_TURNS) -> DataFrame:
    """The nodes of the trie of distinct paths (path, n, least, ends_sha256), the root among them. Runs jobs.

    Paths are dealt out by a hash of their first turn's digest, so that a task's groups hold some first turns' subtries. A
    first turn with more than max_turns turns after it isn't gathered: its node is summed on the map side and its paths
    are dealt out by their next turn, and so on; so each round is over the oversized rest alone, and there are no more
    rounds than turns that so many different conversations share. A path that is alone is never divided. At last the tops
    of the parts are summed into the nodes above them, from the deepest up.
    """
    spark, long = paths.sparkSession, lambda x: F.lit(x).cast("long")
    size = (F.octet_length("path") / TURN).cast("long")
    top = paths.agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.coalesce(F.sum(size), F.lit(0)).alias("turns")).first()
    if top.n is None:
        return spark.createDataFrame([], NODES)
    prefix = lambda depth: F.substring("path", 1, depth * TURN)
    # the nodes whose paths are divided, by depth: key, and what is known before their parts are
    split = [spark.createDataFrame([(hashlib.sha256(b"").hexdigest(), top.least, None, top.n, 0)], "key string, conv_id long, parent_conv_id long, n_convs long, own_bytes long")]
    rest, depth, left, whole, made = paths.withColumn("above", long(top.least)), 0, top.turns, [], []
    while True:
        split[-1] = split[-1].join(rest.where(size == depth).select(F.sha2(prefix(depth), 256).alias("key"), "ends_sha256"), "key", "left")
        depth += 1
        keyed = rest.where(size >= depth).withColumn("key", F.sha2(prefix(depth), 256))
        sums = [F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n_convs"), F.min("least").alias("conv_id"), F.sum(size - depth + 1).alias("turns"), F.any_value(F.substring("path", depth * TURN - 7, 8)).alias("own"), F.any_value("above").alias("parent_conv_id")]
        large = cut(keyed.groupBy("key").agg(*sums).where((F.col("turns") > max_turns) & (F.col("rows") > 1)))
        made.append(large)
        total = large.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("turns"), F.lit(0)).alias("turns")).first()
        known = large.select("key", "rows", F.col("conv_id").alias("group_least"))
        met = lookup(keyed, known, ["key"], "rows", total.rows, F.xxhash64("path"), "left") if total.rows else keyed.withColumns({"rows": long(None), "group_least": long(None)})
        parts = max(1, -(-2 * (left - total.turns) // max_turns))
        small = met.where(F.col("rows").isNull()).select(F.pmod(F.xxhash64("key"), F.lit(parts)).alias("part"), long(depth).alias("depth"), "above", "path", "n", "least", "ends_sha256")
        whole.append(cut(small.groupBy("part").applyInPandas(subtries, NODES)))
        if not total.rows:
            break
        split.append(large.select("key", "conv_id", "parent_conv_id", "n_convs", F.conv(F.hex("own"), 16, 10).cast("long").alias("own_bytes")))
        rest, left = cut(met.where(F.col("rows").isNotNull()).select(*paths.columns, F.col("group_least").alias("above"))), total.turns
        made.append(rest)
    # a top names the node above it by its smallest member
    for at in range(len(split) - 1, -1, -1):
        below = [w.where(F.col("depth") == at + 1).select("parent_conv_id", "n_leaves", "saved_tokens") for w in ([whole[at]] if at == len(split) - 1 else [whole[at], whole[-1]])]
        tops = below[0] if len(below) == 1 else below[0].unionByName(below[1])
        tops = tops.groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
        found = split[at].join(tops, "conv_id", "left").select(
            "conv_id", long(at).alias("depth"), "parent_conv_id", "n_convs", F.coalesce("n_children", long(0)).alias("n_children"), F.coalesce("n_leaves", long(1)).alias("n_leaves"),
            (F.coalesce("saved_tokens", long(0)) + (F.col("n_convs") - 1) * F.col("own_bytes")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
        )
        whole.append(cut(found))
    for frame in made:
        drop_cut(frame)
    found = whole[0]
    for more in whole[1:]:
        found = found.unionByName(more)
    return found


def prefix_trie(conversations: DataFrame, *, family: int = 5, most: int = 9, max_turns: int = MAX_TURNS, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each node of the trie of rebuilt conversations (see `rebuilt`): conv_id (the smallest member, which with
    depth names the node), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens (bytes of
    text saved in the node's subtree by storing each node once), ends_sha256 (of the ids that end here). Runs jobs.

    Turns go by number, null first, equal numbers by their digest; a null role or text is empty, and equal to an empty
    one. A row that repeats is a turn more. A conversation of which nothing is left ends at the root; rows without an id
    take no part; an empty table has no nodes, not even a root. Only the four columns are read, so further columns may
    have any names. Turns are told apart by 128 bits of SHA-256 and the text's length; texts themselves are never
    shuffled, so very long ones cost no more than short ones. One conversation's codes, TURN bytes a turn, are one row.
    Copies of a conversation are one path with a number, so that they make no group larger.
    """
    coded = turns(conversations, id_col, turn_col, role_col, text_col)
    paths = cut(distinct_paths(rebuilt(coded, family, most)))
    found = nodes(paths, max_turns)
    drop_cut(paths)
    return found


def with_text(found: DataFrame, conversations: DataFrame, *, family: int = 5, most: int = 9, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Nodes with role and text of their last turn, null for the root: the turn at the node's depth in its smallest
    member, which is its family's first if the depth is within taken(id). A join by (id, place), which are unique."""
    coded = turns(conversations, id_col, turn_col, role_col, text_col, keep_text=True)
    placed = coded.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.asc_nulls_first("turn"), "code")).cast("long")).drop("turn", "code")
    head = F.col("conv_id") - F.col("conv_id") % family
    lengths = placed.groupBy(F.col("id").alias("head")).agg(F.max("place").alias("length"))
    at = found.withColumns({"head": head, "h": taken(F.col("conv_id"), most)}).join(lengths, "head", "left")
    shared = F.least("h", F.coalesce("length", F.lit(0)))
    at = at.withColumns({"id": F.when(F.col("depth") <= shared, F.col("head")).otherwise(F.col("conv_id")), "place": F.when(F.col("depth") <= shared, F.col("depth")).when(F.col("depth") > 0, F.col("h") + F.col("depth") - shared)})
    return at.join(placed, ["id", "place"], "left").select(*found.columns, "role", "text")
