"""Merkle manifest of a table: one tree per group of rows, one tree over the groups, a proof path for every row.

Leaves are digests of whole rows, made in the scan. They are put in order by a range partitioning on (group, key,
leaf) and numbered inside their group from the rows that each partition holds of it: at most one number per partition
and group, no ordered window over a group. Then level by level: `arity` consecutive nodes are one run; lag and lead
columns at the fixed offsets 1 .. arity - 1, masked by the node's slot in its run and by the run's length, supply
its siblings, and the first node of a run hashes the run to its parent. A level is 1 / arity of the one below, and the windows are runs,
so no group is bound to one task however many rows it has. The nodes that are left, one per group, go through the same steps
as leaves of the tree over the groups. Paths are handed down from the root, so a row meets only its parent's path.

Digests are lowercase hex SHA-256 of concatenated texts. Every node but a lone leaf is hashed with its run, also a run of one.

Defined results: a null field is `-`, an empty one `0:`; a null group is a group of its own, before all others, and
differs from an empty name; null keys come first in their group; rows of one key are ordered by their leaf, equal rows are
interchangeable leaves; long texts are hashed whole; an empty table has no tree and gives an empty result; other columns
are not looked at, those to be carried travel in one struct, so their names cannot clash with any column in here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palinode.llm.scratch import stored

_ROW_BITS = 33  # of monotonically_increasing_id, the rest is the partition
PATH = "array<struct<left:string,right:string>>"


def digest(*texts: Column) -> Column:
    return F.sha2(F.concat(*texts).cast("binary"), 256)


def leaf_digest(*fields: Column) -> Column:
    """Digest of a row: each field as `-` if null, else its UTF-8 byte count, a colon and its value."""
    def framed(field: Column) -> Column:
        text = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return digest(*map(framed, fields))


def fold(leaf: Column, path: Column) -> Column:
    """Root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda h, run: digest(run["left"], h, run["right"]))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda run: F.concat(run["left"], run["right"])), ""))


def _numbered(rows: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """`rows` (with `group`) with `idx`, the place in the group in the order of `by` from 0, and `n`, the size of
    the group. Rows alike in `by` may trade places."""
    # equal rows are spread by a hash of where they come from, so that they never have to fit one partition
    salted = rows.withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    keys = ["group", *by, "salt"]
    ordered = salted.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("salt")
    at = F.monotonically_increasing_id()
    placed = stored(ordered.withColumns({
        "part": F.shiftright(at, _ROW_BITS), "place": at.bitwiseAND(F.lit((1 << _ROW_BITS) - 1))}), f"merkle-{name}")
    spans = placed.groupBy("group", "part").agg(F.min("place").alias("first"), F.count("*").alias("here"))
    all_parts = W.partitionBy("group")
    before = F.coalesce(F.sum("here").over(all_parts.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select("group", "part", (before - F.col("first")).alias("shift"), F.sum("here").over(all_parts).alias("n"))
    return placed.join(spans, ["group", "part"]).withColumn("idx", F.col("place") + F.col("shift")).drop(
        "part", "place", "shift")


def _with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Adds `run`, `slot`, `left` and `right`: the digests of the run before and after the node, joined."""
    placed = nodes.withColumns({"run": F.expr(f"idx div {arity}"), "slot": F.col("idx") % arity})
    in_run = W.partitionBy("group", "run").orderBy("idx")
    length = F.least(F.lit(arity), F.col("n") - F.col("run") * arity)
    lags = [F.when(F.col("slot") >= k, F.lag("h", k).over(in_run)) for k in range(arity - 1, 0, -1)]
    leads = [F.when(F.col("slot") + k < length, F.lead("h", k).over(in_run)) for k in range(1, arity)]
    return placed.withColumns({"left": F.concat_ws("", *lags), "right": F.concat_ws("", *leads)})


def _parents(nodes: DataFrame, arity: int) -> DataFrame:
    """Nodes of the next level, made by the first node of each run."""
    firsts = _with_siblings(nodes, arity).where((F.col("slot") == 0) & (F.col("n") > 1))
    return firsts.select("group", F.col("run").alias("idx"), digest(F.col("h"), F.col("right")).alias("h"),
                         F.ceil(F.col("n") / arity).cast("long").alias("n"))


def _levels(leaves: DataFrame, arity: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """(levels from the leaves up, last nodes): in the last level every node is alone in its group."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels, tops = [leaves], leaves.where("n = 1").select("group", "h")
    while most > 1:
        levels.append(stored(_parents(levels[-1], arity), f"merkle-{name}-{len(levels)}"))
        tops = tops.union(levels[-1].where("n = 1").select("group", "h"))
        most = -(-most // arity)
    return levels, tops


def _hand_down(levels: list[DataFrame], roots: DataFrame, arity: int) -> DataFrame:
    """The leaves with what `roots` (group, path, ...) says of their group; a path begins with the leaf's own run."""
    carried = [c for c in roots.columns if c not in ("group", "path")]
    above = None
    for nodes in reversed(levels):
        alone = nodes.where("n = 1").join(roots, "group")
        if above is not None:
            run = F.struct("left", "right").alias("run_path")
            inner = _with_siblings(nodes.where("n > 1"), arity).select(*nodes.columns, "run", run)
            joined = inner.join(above, ["group", "run"]).withColumn("path", F.concat(F.array("run_path"), "path"))
            alone = alone.select(*nodes.columns, "path", *carried).union(joined.select(*nodes.columns, "path", *carried))
        above = alone.select("group", F.col("idx").alias("run"), "path", *carried)
    return alone


def merkle_manifest(rows: DataFrame, leaf: Column, key: str = "doc_id", group: str = "lang", carry: Sequence[str] = (),
                    arity: int = 8) -> DataFrame:
    """(key, group, leaf_no, leaf, path, subroot, root, carried): a row per row of the table. `leaf_no` is its place in its
    group, `path` its runs from the leaf's to the root's as (left siblings, right siblings), `carried` a
    struct of the columns named in `carry` (null without any)."""
    # a group name that is never null and keeps the order of the bytes, nulls first
    name = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    extra = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.lit(None).cast("string")
    kept = rows.select(name.alias("group"), F.struct(F.col(group).alias("name")).alias("own"), F.col(key).alias("key"),
                       leaf.alias("h"), extra.alias("carried"))
    leaves = stored(_numbered(kept, ["key", "h"], "leaves"), "merkle-level-0")
    levels, tops = _levels(leaves.select("group", "idx", "h", "n", "own", "key", "carried"), arity, "level")

    # the tree over the groups: their last nodes are its leaves
    named = tops.select(F.lit("").alias("group"), F.col("group").alias("name"), "h")
    forest = stored(_numbered(named, ["name"], "groups"), "merkle-groups")
    upper, top = _levels(forest.select("group", "idx", "h", "n", "name"), arity, "root")
    root = top.select("group", F.array().cast(PATH).alias("path"), F.col("h").alias("root"))
    placed = _hand_down(upper, root, arity).select(F.col("name").alias("group"), "path", F.col("h").alias("subroot"), "root")
    return _hand_down(levels, stored(placed, "merkle-paths"), arity).select(
        F.col("key").alias(key), F.col("own.name").alias(group), F.col("idx").alias("leaf_no"), F.col("h").alias("leaf"),
        "path", "subroot", "root", "carried")
