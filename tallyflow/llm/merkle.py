"""A Merkle manifest of a dataset: a tree of hashes for each group of rows, and one over the groups.

A level of a tree is kept as hex strings, one for each aligned block of
``fan ** depth`` nodes. Fixed-width substrings of a level are what its parents hash; what
stands before and behind a node in its run are the sibling segments of its proof. The
tops of blocks are the nodes of the next round, until a group has one. Then paths go
back down, from the blocks above to the blocks below. SQL functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyflow.session import settle

#: Hex digits of a digest.
HEX = 64
PATH = "array<struct<before:string,after:string>>"


@dataclass(frozen=True)
class Tree:
    """``fan`` consecutive nodes have one parent; a block holds ``depth`` levels below its top."""

    fan: int = 16
    depth: int = 2

    @property
    def block(self) -> int:
        return self.fan**self.depth


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf(*fields: Column) -> Column:
    """The hash of a row: each field as ``-`` if null, else its bytes, a colon and its value."""
    values = [f.cast("string") for f in fields]
    return digest(F.concat(*(F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in values)))


def fold(node: Column, path: Column) -> Column:
    """The root that a node and its path of sibling segments lead to."""
    return F.aggregate(path, node, lambda acc, p: digest(F.concat(p["before"], acc, p["after"])))


def siblings(path: Column) -> Column:
    """All sibling segments of a path, from the leaf up, each run's from left to right."""
    return F.array_join(F.transform(path, lambda p: F.concat(p["before"], p["after"])), "")


# --- numbering ---------------------------------------------------------------


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``idx``, each row's place in its group by ``order`` from 0, and ``total``, the group's rows.

    Rows are range-partitioned by group and order, so one group may hold any share of
    them; a scan number tells equal rows apart. A row for each partition and group adds up the rest.
    """
    keys = [group, *order]
    spread = rows.withColumn("uid", F.monotonically_increasing_id())
    spread = spread.repartitionByRange(*keys, "uid").sortWithinPartitions(*keys, "uid").drop("uid")
    spread = settle(spread.withColumn("place", F.monotonically_increasing_id()), name).withColumn("part", F.shiftright("place", 33))
    parts = spread.groupBy(group, "part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    of = Window.partitionBy(group)
    earlier = of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(group, "part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(of).alias("total"))
    joined = spread.join(settle(parts, f"{name}-parts"), [group, "part"])
    return joined.withColumn("idx", F.col("before") + F.col("place") - F.col("first")).drop("place", "part", "first", "before")


# --- up ----------------------------------------------------------------------


def parents(level: Column, tree: Tree) -> Column:
    """The level above a level: the hashes of its substrings of ``fan`` digests."""
    width = tree.fan * HEX
    runs = F.sequence(F.lit(0), F.ceil(F.length(level) / width).cast("int") - 1)
    return F.array_join(F.transform(runs, lambda i: digest(F.substr(level, i * width + 1, F.lit(width)))), "")


def blocks(nodes: DataFrame, group: str, tree: Tree, carried: list[str], name: str) -> DataFrame:
    """A row for each block of ``nodes`` (``idx, total, node`` and what is carried): ``members`` in order, ``level0`` and so on up to the top.

    Where a group has one node on a level, that is its root and goes up as it is.
    """
    member = F.struct(F.expr(f"cast(idx % {tree.block} as int)").alias("pos"), "node", *carried)
    rows = nodes.groupBy(group, "total", F.expr(f"idx div {tree.block}").alias("block")).agg(F.sort_array(F.collect_list(member)).alias("members"))
    rows = rows.withColumn("level0", F.array_join(F.transform("members", lambda m: m["node"]), ""))
    for k in range(tree.depth):
        below = F.col(f"level{k}")
        rows = rows.withColumn(f"level{k + 1}", F.when(F.col("total") > tree.fan**k, parents(below, tree)).otherwise(below))
    return settle(rows, name)


def rounds(nodes: DataFrame, group: str, tree: Tree, carried: list[str], name: str) -> list[DataFrame]:
    """Blocks of the nodes, of the tops of those blocks, and so on until each group has one block."""
    out = [blocks(nodes, group, tree, carried, f"{name}0")]
    most = out[0].agg(F.max("total")).first()[0] or 0
    while most > tree.block:
        tops = out[-1].select(group, F.col("block").alias("idx"), F.expr(f"(total + {tree.block - 1}) div {tree.block}").alias("total"), F.col(f"level{tree.depth}").alias("node"))
        out.append(blocks(tops, group, tree, [], f"{name}{len(out)}"))
        most = -(-most // tree.block)
    return out


def roots(levels: list[DataFrame], group: str, tree: Tree) -> DataFrame:
    return levels[-1].select(group, F.col(f"level{tree.depth}").alias("node"))


# --- down --------------------------------------------------------------------


def path(pos: Column, tree: Tree) -> Column:
    """Sibling segments of a member within its block: what flanks its node in the run, on each level that has more than one node."""
    width, steps = tree.fan * HEX, []
    for k in range(tree.depth):
        at = F.floor(pos / tree.fan**k).cast("int")
        run = F.substr(F.col(f"level{k}"), F.floor(at / tree.fan).cast("int") * width + 1, F.lit(width))
        within = (at % tree.fan) * HEX
        step = F.struct(F.substr(run, F.lit(1), within).alias("before"), F.substr(run, within + HEX + 1, F.lit(width)).alias("after"))
        steps.append(F.when(F.col("total") > tree.fan**k, F.array(step)).otherwise(F.array().cast(PATH)))
    return F.concat(*steps)


def paths(rows: DataFrame, group: str, tree: Tree, carried: list[str]) -> DataFrame:
    """``group, block, above`` and what is carried for the blocks of the round below, from blocks with their own ``above``."""
    found = rows.select(group, F.explode(F.transform("members", lambda m: F.struct(m["pos"].alias("pos"), path(m["pos"], tree).alias("own")))).alias("m"), F.col("block").alias("up"), "above", *carried)
    return found.select(group, (F.col("up") * tree.block + F.col("m.pos")).alias("block"), F.concat("m.own", "above").alias("above"), *carried)


def lowest(levels: list[DataFrame], above: DataFrame, group: str, tree: Tree) -> DataFrame:
    """The first round's blocks with ``above``: the paths of their tops to the root, given those of the last round's blocks."""
    carried = [c for c in above.columns if c not in (group, "block", "above")]
    rows = levels[-1].join(above, [group, "block"])
    for k in range(len(levels) - 2, -1, -1):
        rows = levels[k].join(settle(paths(rows, group, tree, carried), f"paths{k}"), [group, "block"])
    return rows


def manifest(leaves: DataFrame, tree: Tree = Tree()) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` for every row of ``leaves``.

    ``leaves`` has ``doc_id, source, leaf`` and ``found``, the hash recomputed from the row
    as it is met now (null: as the leaf). A source's leaves ascend by ``doc_id``, null
    first, rows that repeat an id by their hash. While a level has more than one node, every ``fan`` of them, the
    last run fewer, have their hash as parent. The subroots in the order of their sources,
    null first, are the leaves of the tree that gives ``root``. ``proof_sha256`` is the hash
    of all sibling segments up to the root, ``folded_root`` what they and ``found`` lead to.
    No rows give none.
    """
    rows = leaves.select("doc_id", F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source")).alias("of"), "leaf", F.coalesce("found", "leaf").alias("found"))
    ranked = numbered(settle(rows, "leaves"), "of", ["doc_id", "leaf"], "ranked")
    trees = rounds(ranked.withColumnRenamed("leaf", "node"), "of", tree, ["doc_id", "found"], "leaves")
    subroots = settle(roots(trees, "of", tree), "subroots")
    sources = numbered(subroots.withColumn("all", F.lit(0)), "all", ["of"], "sources")
    top = rounds(sources, "all", tree, ["of"], "top")
    root = settle(roots(top, "all", tree), "root")
    start = top[-1].select("all", "block", F.array().cast(PATH).alias("above")).join(root.withColumnRenamed("node", "root"), "all")
    found = lowest(top, start, "all", tree)
    each = F.transform("members", lambda m: F.struct(m["of"].alias("of"), m["node"].alias("subroot"), F.concat(path(m["pos"], tree), "above").alias("above")))
    start = settle(found.select("root", F.explode(each).alias("m")).select("m.*", "root", F.lit(0).cast("long").alias("block")), "subroot-paths")
    found = lowest(trees, start, "of", tree)

    def proof(m):
        return F.struct(m["doc_id"].alias("doc_id"), m["node"].alias("leaf"), m["found"].alias("found"), F.concat(path(m["pos"], tree), F.col("above")).alias("path"))

    rows = found.select("subroot", "root", F.explode(F.transform("members", proof)).alias("m"))
    rows = rows.select("m.doc_id", "m.leaf", "subroot", "root", digest(siblings(F.col("m.path"))).alias("proof_sha256"), fold(F.col("m.found"), F.col("m.path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
