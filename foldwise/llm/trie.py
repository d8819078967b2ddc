"""Conversation prefix trie, rolled up by centroid decomposition.

Conversations are rebuilt from a shared beginning and their own rest; each distinct beginning is a node. A
node is named by its smallest member and its depth, so the nodes of one name form a chain, and the node of a
conversation at any depth is one lookup by (conversation, depth).

A beginning is recognised by two running XORs of 64-bit hashes of (place, MD5 of role and text). Running
values need no task per conversation: turns are sorted over all partitions, pieces of a conversation are
numbered where they lie, and longer ones are summed by cells of ``CELL`` places.

Totals over subtrees come from centroid decomposition. Every node starts with the number of (conversation,
turn) rows in its subtree as its weight, which the members' lengths give directly. In each round every
component of the forest of parent edges is split at its centroid, the deepest node that holds over half of the
component's weight: the nodes over half are exactly the path from the centroid to the component's top. The total
of the centroid and of all below it is aggregated once per component and added along that path; then the pieces
below the centroid and the rest above it go on as components of at most half the weight. The number of rounds is
the logarithm of the number of turns, however long a conversation is. Components of up to ``TASK_NODES`` nodes
take their remaining rounds, which are the same, inside a task; larger ones take them as joins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.llm.graph import split_join
from foldwise.llm.words import session_limits
from foldwise.session import settle

#: At most so many turns are taken from the beginning of another conversation.
MOST_SHARED = 8
GROUP = 5
CELL = 4096
TASK_NODES = 20_000


def shared_turns(conv: Column) -> Column:
    """How many turns of its group's first conversation a conversation starts with."""
    return (F.crc32(conv.cast("string")) % (MOST_SHARED + 1)).cast("int")


def group_head(conv: Column) -> Column:
    return conv - conv % GROUP


def _numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, rank, of, digest, bytes): turns with their place among all ``of`` turns of the conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn",
        F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.octet_length(text).cast("bigint").alias("bytes"), F.monotonically_increasing_id().alias("row"),
    )
    order = ["conv_id", F.asc_nulls_first("turn"), "digest", "row"]
    partitions = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Settled: a partition keeps its number, and a conversation that spans several is counted piece by piece.
    placed = settle(turns.repartitionByRange(partitions, *order).sortWithinPartitions(*order)).withColumn("piece", F.spark_partition_id())
    inside = Window.partitionBy("conv_id", "piece").orderBy(*order[1:])
    pieces = placed.groupBy("conv_id", "piece").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(
        "conv_id", "piece", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("conv_id")).alias("of")
    )
    numbered = placed.withColumn("rank", F.row_number().over(inside)).join(pieces, ["conv_id", "piece"])
    return numbered.select("conv_id", (F.col("before") + F.col("rank")).alias("rank"), "of", "digest", "bytes")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, length, digest, bytes) for every rebuilt turn, and a row of depth 0 per conversation.

    A conversation starts with the first ``shared_turns`` turns of its ``group_head`` and goes on with its own
    turns behind as many.
    """
    turns = settle(_numbered(conversations))
    first = turns.filter("rank = 1")
    heads = first.select(F.col("conv_id").alias("head"), F.col("of").alias("head_n"))
    plan = first.select("conv_id", group_head(F.col("conv_id")).alias("head"), shared_turns(F.col("conv_id")).alias("h"), "of").join(heads, "head", "left")
    taken = F.least(F.col("h"), F.coalesce("head_n", F.lit(0)))
    plan = plan.select("conv_id", "head", "h", taken.alias("taken"), (taken + F.greatest(F.col("of") - F.col("h"), F.lit(0))).alias("length"))
    plan = settle(plan)
    own = split_join(turns, plan.select("conv_id", "h", "taken", "length"), ["conv_id"]).filter("rank > h")
    own = own.select("conv_id", (F.col("taken") + F.col("rank") - F.col("h")).alias("depth"), "length", "digest", "bytes")
    begin = turns.filter(f"rank <= {MOST_SHARED} and conv_id % {GROUP} = 0").select(F.col("conv_id").alias("head"), F.col("rank").alias("depth"), "digest", "bytes")
    begin = begin.join(plan.select("conv_id", "head", "taken", "length"), "head").filter("depth <= taken")
    root = plan.select("conv_id", F.lit(0).cast("bigint").alias("depth"), "length", F.lit("").alias("digest"), F.lit(0).cast("bigint").alias("bytes"))
    return root.unionByName(begin.drop("head", "taken")).unionByName(own)


def _prefixed(turns: DataFrame) -> DataFrame:
    """Rebuilt turns with the two names of their beginning (a, b) and of the one before it (up_a, up_b)."""
    names = ("a", "b")
    # The textless root is named 0.
    own = [F.when(F.col("depth") > 0, F.xxhash64(F.lit(x), "depth", "digest")).otherwise(F.lit(0).cast("bigint")).alias(f"own_{x}") for x in names]
    rows = settle(turns.select("conv_id", "depth", "length", "bytes", F.floor(F.col("depth") / CELL).alias("cell"), *own))
    earlier = Window.partitionBy("conv_id").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy("conv_id", "cell").agg(*[F.bit_xor(f"own_{x}").alias(f"cell_{x}") for x in names])
    cells = cells.select("conv_id", "cell", *[F.coalesce(F.bit_xor(f"cell_{x}").over(earlier), F.lit(0).cast("bigint")).alias(f"before_{x}") for x in names])
    inside = Window.partitionBy("conv_id", "cell").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", *[F.bit_xor(f"own_{x}").over(inside).alias(f"in_{x}") for x in names]).join(cells, ["conv_id", "cell"])
    total = {x: F.col(f"before_{x}").bitwiseXOR(F.col(f"in_{x}")) for x in names}
    return rows.select("conv_id", "depth", "length", "bytes", *[total[x].alias(x) for x in names], *[total[x].bitwiseXOR(F.col(f"own_{x}")).alias(f"up_{x}") for x in names])


def trie(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, paths) of the rebuilt conversations.

    nodes: (rep, depth, up, n_convs, n_children, bytes, weight); ``rep`` is the smallest member, ``up`` the
    parent's. paths: (conv_id, depth, rep, up, length), the node of every conversation at every depth.
    """
    rows = settle(_prefixed(rebuilt(conversations)))
    key = ["depth", "a", "b"]
    nodes = rows.groupBy(*key).agg(
        F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("n_convs"), F.min("bytes").alias("bytes"), F.min("up_a").alias("up_a"), F.min("up_b").alias("up_b"),
        F.sum(F.col("length") - F.col("depth") + 1).alias("weight"),
    )
    nodes = settle(nodes)
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("rep").alias("up"))
    nodes = settle(split_join(nodes, parents, ["depth", "up_a", "up_b"], "left").select(*key, "rep", "up", "n_convs", "bytes", "weight"))
    paths = settle(split_join(rows.select("conv_id", "length", *key), nodes.select(*key, "rep", "up"), key).select("conv_id", "depth", "rep", "up", "length"))
    children = nodes.filter("depth > 0").groupBy(F.col("up").alias("rep"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.drop("a", "b").join(children, ["rep", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint")))
    return settle(nodes), paths


def _solve(component: list[tuple], n_values: int) -> list[list]:
    """Totals of one component, in place: rows (rep, depth, up, weight, value, ...) by depth, the top first."""
    place = {(r[0], r[1]): i for i, r in enumerate(component)}
    parent = [place.get((r[2], r[1] - 1)) for r in component]
    weight, total = [r[3] for r in component], [[0] * n_values for _ in component]
    open_pieces = [list(range(len(component)))]
    while open_pieces:
        piece = open_pieces.pop()
        whole = weight[piece[0]]
        path = [i for i in piece if 2 * weight[i] > whole]
        centre = path[-1]
        under, rest, sums = {centre: None}, [], [0] * n_values
        parts: dict[int, list[int]] = {}
        for i in piece:  # parents come first
            if i != centre:
                if parent[i] not in under:
                    rest.append(i)
                    continue
                under[i] = i if parent[i] == centre else under[parent[i]]
                parts.setdefault(under[i], []).append(i)
            for j, x in enumerate(component[i][4:]):
                sums[j] += x
        for i in path:
            for j, x in enumerate(sums):
                total[i][j] += x
            if i != centre:
                weight[i] -= weight[centre]
        open_pieces += [*parts.values(), *([rest] if rest else [])]
    return total


def _solver(names: list[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def solved() -> pa.RecordBatch:
            totals = _solve(rows, len(names))
            columns = [[r[0] for r in rows], [r[1] for r in rows], *([t[j] for t in totals] for j in range(len(names)))]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

        for batch in batches:
            for top, top_depth, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (top, top_depth) != now:
                    if rows:
                        yield solved()
                    now, rows = (top, top_depth), []
                rows.append(tuple(row))
        if rows:
            yield solved()

    return run


def balanced_rollup(nodes: DataFrame, paths: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(rep, depth, one total per value): each long value summed over every node's subtree by centroid decomposition.

    ``nodes`` has (rep, depth, up, weight) with the weight of the whole subtree, ``paths`` the node of every
    ``rep`` at every depth above it.
    """
    names, top, kept = list(values), ["top", "top_depth"], []
    columns = ["rep", "depth", "up", "weight", *names]
    schema = pa.schema([(c, pa.int64()) for c in ("rep", "depth", *names)])
    lookup = paths.select(F.col("conv_id").alias("rep"), F.col("depth").alias("next_depth"), F.col("rep").alias("next"), F.col("up").alias("passed"))
    root = nodes.filter("depth = 0").select(F.col("rep").alias("top"), F.lit(0).cast("bigint").alias("top_depth"))
    # One row: the root.
    state = nodes.select("rep", "depth", "up", "weight", *[v.alias(k) for k, v in values.items()]).join(F.broadcast(root))
    while True:
        state = settle(state)
        whole = settle(state.groupBy(*top).agg(F.max("weight").alias("whole"), F.count(F.lit(1)).alias("n")))
        sized = split_join(state, whole, top)
        small = sized.filter(F.col("n") <= TASK_NODES).select(*top, *columns).repartition(*top).sortWithinPartitions(*top, "depth")
        kept.append(small.mapInArrow(_solver(names, schema), ", ".join(f"{c} bigint" for c in schema.names)))
        large = sized.filter(F.col("n") > TASK_NODES)
        if whole.filter(F.col("n") > TASK_NODES).isEmpty():
            break
        centroid = large.filter("2 * weight > whole").groupBy(*top).agg(F.max(F.struct("depth", "rep", "weight")).alias("c"))
        centroid = settle(centroid.select(*top, *[F.col("c")[x].alias(f"c_{x}") for x in ("rep", "depth", "weight")]))
        placed = split_join(large.drop("n"), centroid, top)
        # A chain lies below the centroid from where it passes through it.
        chains = placed.filter("depth > c_depth").select(*top, "rep", "c_rep", (F.col("c_depth") + 1).alias("next_depth")).distinct()
        passing = chains.join(lookup, ["rep", "next_depth"]).filter("passed = c_rep").select(*top, "rep", "next")
        placed = settle(split_join(placed, passing, [*top, "rep"], "left").withColumn("next", F.when(F.col("depth") > F.col("c_depth"), F.col("next"))))
        centre = (F.col("rep") == F.col("c_rep")) & (F.col("depth") == F.col("c_depth"))
        path = 2 * F.col("weight") > F.col("whole")
        below = placed.filter(F.col("next").isNotNull() | centre).groupBy(*top).agg(*[F.sum(k).alias(k) for k in names])
        kept.append(split_join(placed.filter(path).select("rep", "depth", *top), below, top).select("rep", "depth", *names))
        state = placed.filter(~centre).select(
            "rep", "depth", "up", F.when(path & F.col("next").isNull(), F.col("weight") - F.col("c_weight")).otherwise(F.col("weight")).alias("weight"), *names,
            F.coalesce("next", "top").alias("top"), F.when(F.col("next").isNull(), F.col("top_depth")).otherwise(F.col("c_depth") + 1).alias("top_depth"),
        )
    found = kept[0]
    for more in kept[1:]:
        found = found.unionByName(more)
    return found.groupBy("rep", "depth").agg(*[F.sum(k).alias(k) for k in names])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per node from its sorted chunks of ids; a node's ids stream through, they are never held."""
    now, running, first, out = None, None, True, {"rep": [], "depth": [], "ends_sha256": []}

    def close():
        if now is not None:
            for k, v in zip(out, (*now, running.hexdigest())):
                out[k].append(v)

    def made():
        batch = pa.RecordBatch.from_pydict({"rep": pa.array(out["rep"], pa.int64()), "depth": pa.array(out["depth"], pa.int64()), "ends_sha256": pa.array(out["ends_sha256"], pa.string())})
        for v in out.values():
            v.clear()
        return batch

    for batch in batches:
        for row in batch.to_pylist():
            if (row["rep"], row["depth"]) != now:
                close()
                now, running, first = (row["rep"], row["depth"]), hashlib.sha256(), True
            running.update((("" if first else ",") + ",".join(map(str, row["ids"]))).encode())
            first = False
        yield made()
    close()
    yield made()


def end_digests(paths: DataFrame) -> DataFrame:
    """(rep, depth, ends_sha256) of the nodes at which conversations end: SHA-256 of their ids, ascending, comma-joined."""
    session_limits(paths.sparkSession)
    ends = paths.filter("depth = length").select("rep", "depth", "conv_id", F.floor(F.col("conv_id") / CELL).alias("chunk"))
    chunks = ends.groupBy("rep", "depth", "chunk").agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    dealt = chunks.repartition("rep", "depth").sortWithinPartitions("rep", "depth", "chunk")
    return dealt.mapInArrow(_digests, "rep bigint, depth bigint, ends_sha256 string")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """One row per distinct beginning of the rebuilt conversations, with totals over its subtree.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256). Turns are taken
    by ``turn``, nulls first; turns that tie, in the order of a checksum of role and text, repeated rows each.
    A null role or text counts as empty; rows without a conversation id are left out; other columns are not
    read. A conversation without turns is a member of the root. An empty table has no node.
    """
    session_limits(conversations.sparkSession)
    nodes, paths = trie(conversations)
    own = {"n_leaves": F.when(F.col("n_children") == 0, 1).otherwise(0).cast("bigint"), "saved_tokens": (F.col("n_convs") - 1) * F.col("bytes")}
    totals = balanced_rollup(nodes, paths, own)
    found = nodes.join(totals, ["rep", "depth"]).join(end_digests(paths), ["rep", "depth"], "left")
    return found.select(
        F.col("rep").alias("conv_id"), "depth", F.col("up").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
