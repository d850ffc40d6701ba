"""A prefix trie of conversations whose nodes are owned by their smallest members.

The smallest member of a node is the smallest member of the next node on its own
path too, so each conversation owns a suffix of its path and every node has one
owner.  Thus nothing of the trie is built: a prefix is named by a running sum of
its turns' names, a group-by of the names gives each node's owner, and each
conversation then knows from which depth on it owns its path.  What a subtree saves
is what its members' turns hold less what its nodes hold, which for each member are
its turns before its own ones: one more group-by of the names sums these, the heads
of owned paths (children) and the ends of owned paths without children (leaves).

Hot prefixes are combined before each shuffle.  A conversation of any length is
dealt over tasks by range, see :func:`running_sums`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import exchange as X

#: Consecutive numbers of conversations whose ends of one node make a piece of its list.
_PIECE_BITS = 12


def running_sums(rows: DataFrame, key: str, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Sums over the rows of the same key up to and with each one, in ascending order (nulls first).

    Rows are dealt by range of key and order, so a key with any share of the rows
    spreads over tasks.  Windows run within a range; a key that goes on from an
    earlier range (one for each range at most) adds what its earlier ranges hold,
    which are at most two rows for each range and are broadcast.
    """
    n = X.partitions(rows.sparkSession)
    dealt = rows.withColumns(sums).repartitionByRange(n, key, *order).withColumn("_range", F.spark_partition_id())
    dealt = X.checkpoint(dealt)  # the dealing must not change between the readings
    going_on = dealt.groupBy("_range").agg(F.min(key).alias(key)).select(key).distinct()
    parts = dealt.join(F.broadcast(going_on), key).groupBy(key, "_range").agg(*(F.sum(s).alias(s) for s in sums))
    earlier = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(key, "_range", *(F.sum(s).over(earlier).alias(f"_{s}") for s in sums))
    upto = Window.partitionBy("_range", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = dealt.select("*", *(F.sum(s).over(upto).alias(f"_upto_{s}") for s in sums)).join(F.broadcast(carried), [key, "_range"], "left")
    own = [c for c in dealt.columns if c not in sums and c != "_range"]
    return within.select(*own, *(F.col(s).alias(f"own_{s}") for s in sums), *((F.col(f"_upto_{s}") + F.coalesce(f"_{s}", F.lit(0))).alias(s) for s in sums))


def ordered_turns(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(c, place, digest, bytes): turns by place from 1; null roles and texts are empty, null conversations take no part."""
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(r).cast("string"), F.lit(":"), r, t), 256))
    named = rows.filter(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("c"), F.col(turn).alias("turn"), digest.alias("digest"), F.octet_length(t).cast("long").alias("bytes"))
    return running_sums(named, "c", ["turn", "digest"], {"place": F.lit(1).cast("long")}).select("c", "place", "digest", "bytes")


def branched_turns(turns: DataFrame, family: int, shared: int) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on the first of their family: (c, length) and (c, length, depth, digest, bytes).

    Conversation c starts with the first h turns of conversation c - c % family, all if
    it has fewer and none if it is absent, and goes on with its own after its first
    h, where h is the CRC-32 of c's decimal digits modulo ``shared``.
    """
    sizes = turns.groupBy("c").agg(F.count("*").alias("own"))
    heads = sizes.select("c", "own", (F.crc32(F.col("c").cast("string").cast("binary")) % shared).alias("h"), (F.col("c") - F.col("c") % family).alias("base"))
    heads = heads.join(sizes.select(F.col("c").alias("base"), F.col("own").alias("held")), "base", "left").withColumn("lent", F.least("h", F.coalesce("held", F.lit(0))))
    convs = X.checkpoint(heads.select("c", "base", "h", "lent", (F.col("lent") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")))
    lent = turns.filter(F.col("place") < shared).withColumnRenamed("c", "base").join(convs, "base").filter("place <= h").select("c", "length", F.col("place").alias("depth"), "digest", "bytes")
    own = turns.join(convs, "c").filter("place > h").select("c", "length", (F.col("lent") + F.col("place") - F.col("h")).alias("depth"), "digest", "bytes")
    return convs.select("c", "length"), lent.unionByName(own)


def _paths(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """Every conversation at every depth from 0: (c, length, depth, bytes, upto, node, parent).

    A node's name comes from its depth and two sums of 60-bit names of (depth, turn),
    so that it can be summed over any dealing; equal names are 120 bits apart from chance.
    """
    word = F.sha2(F.concat_ws(" ", "depth", F.hex("digest")), 256)
    name = [F.conv(F.substring(word, 1 + 15 * k, 15), 16, 10).cast("decimal(19,0)") for k in (0, 1)]
    zero = F.lit(0).cast("decimal(19,0)")
    steps = turns.select("c", "length", "depth", "bytes", name[0].alias("a"), name[1].alias("b"))
    roots = convs.select("c", "length", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("bytes"), zero.alias("a"), zero.alias("b"))
    run = running_sums(steps.unionByName(roots), "c", ["depth"], {"upto": F.col("bytes"), "a": F.col("a"), "b": F.col("b")})

    def node(depth: Column, *sums: Column) -> Column:
        return F.unhex(F.md5(F.concat_ws(" ", depth, *(s.cast("decimal(38,0)").cast("string") for s in sums))))

    here, above = node(F.col("depth"), F.col("a"), F.col("b")), node(F.col("depth") - 1, F.col("a") - F.col("own_a"), F.col("b") - F.col("own_b"))
    return X.checkpoint(run.select("c", "length", "depth", F.col("own_upto").alias("bytes"), "upto", here.alias("node"), above.alias("parent")))


def _ends(paths: DataFrame) -> DataFrame:
    """(node, ends_sha256): the SHA-256 of the ascending numbers that end at a node, joined by commas.

    Numbers become text in pieces of at most 4,096 conversations; the pieces of a node
    then pass through one hash in order, of which a task holds one batch at a time.
    """
    number = F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda x: x.cast("string")), ",")
    pieces = paths.filter("depth = length").groupBy("node", F.shiftright("c", _PIECE_BITS).alias("at")).agg(number.alias("piece"))
    dealt = pieces.repartition(X.partitions(paths.sparkSession), "node").sortWithinPartitions("node", "at")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, hashlib.sha256()
        for b in batches:
            done: list[tuple[bytes, str]] = []
            for own, piece in zip(b.column("node").to_pylist(), b.column("piece").to_pylist(), strict=True):
                if own == node:
                    state.update(b"," + piece.encode())
                    continue
                if node is not None:
                    done.append((node, state.hexdigest()))
                node, state = own, hashlib.sha256(piece.encode())
            yield from rows(done)
        if node is not None:
            yield from rows([(node, state.hexdigest())])

    def rows(done: list[tuple[bytes, str]]) -> Iterator[pa.RecordBatch]:
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.binary()), pa.array([x for _, x in done], pa.string())], names=["node", "ends_sha256"])

    return dealt.select("node", "piece").mapInArrow(hashed, "node binary, ends_sha256 string")


def conversation_trie(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", family: int | None = None, shared: int = 9) -> DataFrame:
    """One row for each distinct sequence of first turns (role, text) of the conversations, and for the empty one, the root.

    Columns, all long but the last: ``conv_id`` (the smallest member, a conversation
    that starts so), ``depth``, ``parent_conv_id`` (the parent's; null for the root),
    ``n_convs`` (members), ``n_children``, ``n_leaves`` (childless nodes of the
    subtree, itself included), ``saved_tokens`` (over the subtree, each node's members
    less one times the UTF-8 bytes of its last text) and ``ends_sha256`` (of the
    members that end here, ascending, joined by commas).  With ``family`` the
    conversations are first rebuilt, see :func:`branched_turns`.

    Turns are ordered by number, null first; those that share a number, by a digest
    of role and text.  Repeated rows are repeated turns.  A null role or text is
    empty; rows without a conversation take no part.  An empty table gives no rows.
    Other columns are not read.  A conversation or a prefix may hold any share of
    the rows, and texts may be long: they are read once and only digests move on.
    """
    X.prepare(rows.sparkSession)
    turns = X.checkpoint(ordered_turns(rows, conv_col, turn_col, role_col, text_col))
    if family is None:
        convs = turns.groupBy("c").agg(F.count("*").alias("length"))
        steps = turns.join(convs, "c").withColumnRenamed("place", "depth")
    else:
        convs, steps = branched_turns(turns, family, shared)
    paths = _paths(convs, steps)

    nodes = X.checkpoint(paths.groupBy("node", "depth").agg(F.min("c").alias("owner"), F.max("length").alias("reach"), F.min(F.col("upto") - F.col("bytes")).alias("before")))
    owned = nodes.groupBy(F.col("owner").alias("c")).agg(F.min("depth").alias("own"), F.min("before").alias("before"), F.max(F.col("reach") == F.col("depth")).alias("leaf"))
    ends = paths.filter("depth = length").select("c", "length", "upto").join(owned, "c", "left")
    # a conversation that owns nothing shares all of its turns
    marks = ends.select("c", F.coalesce("own", F.col("length") + 1).alias("own"), F.coalesce("before", "upto").alias("until"), F.coalesce("leaf", F.lit(False)).alias("leaf"))

    at = X.checkpoint(paths.join(marks, "c").select("c", "depth", "length", "node", "parent", "own", "leaf", (F.col("until") - F.col("upto") + F.col("bytes")).alias("shared")))
    sums = at.groupBy("node", "depth").agg(
        F.min("c").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.count_if((F.col("depth") + 1 >= F.col("own")) & (F.col("depth") < F.col("length"))).alias("n_children"),
        F.count_if("leaf").alias("n_leaves"),
        F.sum(F.when(F.col("depth") < F.col("own"), F.col("shared")).otherwise(F.lit(0))).alias("saved_tokens"),
    )
    # a node has its owner's parent, unless the owner's path begins here
    heads = at.filter("own = depth and depth > 0").select("node", F.col("parent").alias("up"))
    heads = heads.join(nodes.select(F.col("node").alias("up"), F.col("owner").alias("above")), "up").select("node", "above")
    out = sums.join(heads, "node", "left").join(_ends(paths), "node", "left")
    parent = F.when(F.col("depth") > 0, F.coalesce("above", "conv_id")).alias("parent_conv_id")
    return out.select("conv_id", "depth", parent, "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
