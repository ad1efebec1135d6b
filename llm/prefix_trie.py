"""The trie of conversations that begin alike, by SQL ROLLUP over columns of turn ids.

A conversation becomes rows of WIDTH turn ids, one row a block of turns. ROLLUP over these columns groups all
prefixes of a block at once, and grouping_id tells how long each is. A later block's rows are keyed by the node
that the block before it ended at: by a 128-bit digest of all turns up to there. So one ROLLUP does all
blocks together, and nothing waits for the block before.

Turn ids are the first 16 bytes of SHA-256 over role and text; a node's digest is the XOR of 64-bit hashes, two of
each, of its turns' ids with their places.

Sums over subtrees need no walk. A node is owned by its smallest member, and what a conversation owns is the tail of
its path. A subtree's nodes are those that the members of its top own, but for what the top's owner owns above it.
So a second ROLLUP adds up what members own, and a running sum along each owner's nodes takes off the rest.

A first turn that most conversations share is pre-aggregated where it is read. A conversation of very many turns is
many rows, of which only those of one chunk of blocks meet in a task (`cellfleet.plans.scan`).
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellfleet.plans import scan
from llm.common import store

WIDTH = 8
#: A piece of a node's list of ends has at most 2 ** PIECE conversation ids.
PIECE = 12


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, position (from 0), id and bytes of each turn, by turn (null first), then role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    t = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.substring(digest, 1, 32)).alias("id"), F.octet_length(text).cast("long").alias("bytes"),
        role.alias("role"), F.sha2(text, 256).alias("rest"))
    # Turns of one number, role and text are equal, so their order is of no account; texts order by digest here.
    return scan.ordered_scan(t, "conv_id", ["turn", "role", "rest"], pos="pos", at_most=conversations.count()).select("conv_id", "pos", "id", "bytes")


def rebuilt(t: DataFrame, step: int = 5, mod: int = 9) -> tuple[DataFrame, DataFrame]:
    """All conversations (conv_id, n turns) and their turns, where a conversation begins with another's first turns.

    The first h turns come from conversation c - c % step, h = crc32(decimal c) % mod, the rest from its own after h.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % mod
    sizes = t.groupBy("conv_id").agg(F.count("*").alias("size"))
    lead = sizes.select(F.col("conv_id").alias("base"), F.col("size").alias("lead"))
    convs = sizes.select("conv_id", "size", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % step).alias("base")).join(lead, "base", "left")
    convs = convs.withColumn("k", F.least("h", F.coalesce("lead", F.lit(0))))
    heads = t.where((F.col("pos") < mod - 1) & (F.col("conv_id") % step == 0)).withColumnRenamed("conv_id", "base")
    heads = heads.join(convs.select("base", "conv_id", "h"), "base").where("pos < h").select("conv_id", "pos", "id", "bytes")
    own = t.join(convs.select("conv_id", "h", "k"), "conv_id").where("pos >= h")
    own = own.select("conv_id", (F.col("k") + F.col("pos") - F.col("h")).alias("pos"), "id", "bytes")
    length = F.col("k") + F.greatest(F.col("size") - F.col("h"), F.lit(0))
    return convs.select("conv_id", length.cast("long").alias("n")), heads.unionByName(own)


def _marks(pos: Column, turn_id: Column) -> list[Column]:
    """Two hashes of a turn at its place."""
    return [F.xxhash64(pos, turn_id), F.xxhash64(turn_id, F.lit("second"), pos)]


def blocks(convs: DataFrame, t: DataFrame, width: int = WIDTH) -> DataFrame:
    """Rows of turn ids: conv_id, block, t0.., digest of all turns before (k1, k2) and up to its end (e1, e2), and
    n where the conversation ends in it. One without turns has one row without ids."""
    m1, m2 = _marks(F.col("pos"), F.col("id"))
    cell = lambda i: F.max(F.when(F.col("pos") % width == i, F.struct("id", "bytes"))).alias(f"t{i}")
    rows = t.withColumn("block", F.expr(f"pos div {width}")).groupBy("conv_id", "block").agg(
        *[cell(i) for i in range(width)], F.bit_xor(m1).alias("x1"), F.bit_xor(m2).alias("x2"))
    bare = convs.where("n = 0").select("conv_id", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("x1"), F.lit(0).cast("long").alias("x2"))
    rows = store(rows.unionByName(bare, allowMissingColumns=True), "blocks")
    rows = scan.halo(rows, key="conv_id", pos="block").drop("home")
    rows = scan.attach(rows, before={f"b{i}": (F.bit_xor(f"x{i}"), F.bit_xor) for i in (1, 2)}, key="conv_id", pos="block")
    run = scan.running("conv_id", "block")
    for i in (1, 2):
        rows = rows.withColumn(f"e{i}", F.coalesce(F.col(f"b{i}"), F.lit(0)).bitwiseXOR(F.bit_xor(f"x{i}").over(run)))
    rows = rows.select("conv_id", "block", *[f"t{i}" for i in range(width)], *[F.col(f"e{i}").bitwiseXOR(F.col(f"x{i}")).alias(f"k{i}") for i in (1, 2)], "e1", "e2")
    ends = convs.select("conv_id", F.expr(f"greatest(n - 1, 0) div {width}").alias("block"), "n")
    return store(rows.join(ends, ["conv_id", "block"], "left"), "blocks")


def prefixes(rows: DataFrame, measures: dict[str, str], width: int = WIDTH) -> DataFrame:
    """Every node: depth, digests of itself (d1, d2) and its parent (p1, p2), bytes of its last turn, and measures.

    ``measures`` are SQL aggregates over the members' rows of `blocks`.
    """
    ids = [f"t{i}" for i in range(width)]
    asked = ", ".join(f"{e} AS {n}" for n, e in measures.items())
    found = rows.sparkSession.sql(
        f"SELECT block, k1, k2, {', '.join(ids)}, {width} - bit_count(grouping_id()) AS level, {asked} "
        f"FROM {{rows}} GROUP BY block, k1, k2, ROLLUP({', '.join(ids)})", rows=rows)
    at_level = lambda cells, none: F.coalesce(*[F.when(F.col("level") == i + 1, c) for i, c in enumerate(cells)], none)
    real = F.when(F.col("level") == 0, F.col("block") == 0).otherwise(at_level([F.col(c).isNotNull() for c in ids], F.lit(False)))
    zero = F.lit(0).cast("long")
    marks = [_marks(F.col("block") * width + i, F.col(f"{c}.id")) for i, c in enumerate(ids)]
    cols = {"depth": F.col("block") * width + F.col("level"), "bytes": at_level([F.col(f"{c}.bytes") for c in ids], zero)}
    for k in (0, 1):
        whole = F.col(f"k{k + 1}")
        for c, m in zip(ids, marks):
            whole = whole.bitwiseXOR(F.when(F.col(c).isNull(), zero).otherwise(m[k]))
        cols[f"d{k + 1}"] = whole
        cols[f"p{k + 1}"] = whole.bitwiseXOR(at_level([m[k] for m in marks], zero))
    return found.where(real).select(*[e.alias(n) for n, e in cols.items()], *measures)


def _ends(rows: DataFrame) -> DataFrame:
    """SHA-256 over the ascending ids of the conversations that end at each node: depth, d1, d2, ends_sha256.

    Ids are joined in pieces first; a node's pieces then pass one task one after another and are never held together.
    """
    piece = F.shiftright("conv_id", PIECE)
    parts = rows.where("n IS NOT NULL").groupBy(F.col("n").alias("depth"), F.col("e1").alias("d1"), F.col("e2").alias("d2"), piece.alias("piece")).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    key = ["depth", "d1", "d2"]

    def run(batches):
        last, digest = None, None
        out: list[tuple] = []
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(5)]
            for depth, d1, d2, _, ids in zip(*cols):
                if (node := (depth, d1, d2)) == last:
                    digest.update(b"," + ids.encode())
                else:
                    if last:
                        out.append((*last, digest.hexdigest()))
                    last, digest = node, hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], [*key, "ends_sha256"])
                out = []
        if last:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*last, digest.hexdigest())], [*key, "ends_sha256"])

    ordered = parts.select(*key, "piece", "ids").repartition(*key).sortWithinPartitions(*key, "piece")
    return ordered.mapInArrow(run, "depth long, d1 long, d2 long, ends_sha256 string")


def trie(convs: DataFrame, t: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row a node (conv_id of the smallest member and depth name it): parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (bytes of last texts that sharing saves, over the subtree) and ends_sha256.

    ``convs`` and ``t`` are as `rebuilt` gives them. The root has depth 0 and no text; no conversations, no root.
    """
    rows = blocks(convs, t, width)
    saved = (F.col("n_convs") - 1) * F.col("bytes")
    shape = {"n_convs": "count(*)", "conv_id": "min(conv_id)"}
    nodes = store(prefixes(rows, shape, width).withColumn("saved", saved), "nodes")
    owners = nodes.groupBy("conv_id").agg(F.min("depth").alias("first"), F.max("depth").alias("last"), F.sum("saved").alias("owned"))
    tops = nodes.join(owners.select("conv_id", F.col("first").alias("depth")), ["conv_id", "depth"])
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    tops = store(tops.join(parents, ["depth", "p1", "p2"], "left").select("conv_id", "depth", "parent_conv_id"), "tops")
    kids = tops.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("others"))
    last = owners.select("conv_id", F.col("last").alias("depth"), "owned", "first")
    whole = last.join(kids, ["conv_id", "depth"], "left").join(tops.select("conv_id", "parent_conv_id"), "conv_id")
    owners = store(whole.select("conv_id", "first", F.col("depth").alias("last"), "owned", F.col("others").isNull().cast("long").alias("leaf"), "parent_conv_id"), "owners")
    own = rows.join(owners.select("conv_id", "owned", "leaf"), "conv_id", "left")
    found = prefixes(own, {**shape, "owned": "coalesce(sum(owned), 0)", "leaves": "coalesce(sum(leaf), 0)"}, width).withColumn("saved", saved)
    # Along an owner's nodes, what lies above a node is not below it.
    found = scan.halo(store(found, "nodes"), key="conv_id", pos="depth").drop("home")
    found = scan.running_sums(found, {"upto": "saved"}, key="conv_id", pos="depth").drop("chunk")
    found = found.join(owners.select("conv_id", "first", "last", "parent_conv_id"), "conv_id")
    found = found.join(kids, ["conv_id", "depth"], "left").join(_ends(rows), ["depth", "d1", "d2"], "left")
    none = hashlib.sha256(b"").hexdigest()
    return found.select(
        "conv_id", "depth", F.when(F.col("depth") > F.col("first"), F.col("conv_id")).otherwise(F.col("parent_conv_id")).alias("parent_conv_id"),
        "n_convs", (F.coalesce("others", F.lit(0)) + (F.col("depth") < F.col("last")).cast("long")).alias("n_children"),
        F.col("leaves").alias("n_leaves"), (F.col("owned") - F.col("upto") + F.col("saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations (`rebuilt`).

    Turns order by turn (null first), then role and text; null role or text is empty. Rows without a conv_id are left
    out; repeated rows are turns of their own. Negative ids take the remainder towards zero. Texts of any length
    count whole and enter as digests; an empty table gives an empty result; other columns are ignored.
    """
    t = store(turns(conversations), "turns")
    return trie(*rebuilt(t))
