"""Merkle manifest of a dataset: a hash tree per group of rows, and a tree over their roots.

Rows of a group get positions in their order. An aligned block of WIDTH ** LEVELS nodes
keeps each of its levels as one string of concatenated hex digests, so the children of a
parent are a substring of fixed width, and the siblings of a node are what flanks it there.
The roots of the blocks are the nodes of the next round, which numbers the levels above;
rounds grow with the logarithm of the group. The groups' roots go through the same rounds
as one group of their own. On the way back each round hands its blocks the path above them.

The largest thing a task holds of a group is one block. Positions come from ranges of the
order, counted in a table with a row for each range and group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from breezeway.llm.common import attach_small, let
from breezeway.session import discard, materialise

#: Children of a node.
WIDTH = 8
#: Levels of the tree that a block spans.
LEVELS = 3
_HEX = 64
_PLACE = (1 << 33) - 1


def encoded(value: Column) -> Column:
    """``-`` for null, else the length of the value's UTF-8 text in bytes, a colon and the text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lower-case hex sha256 of the concatenated parts."""
    return F.sha2(F.concat(*parts), 256)


def leaf(*values: Column) -> Column:
    """The leaf of a row of these values."""
    return digest(*[encoded(v) for v in values])


def _cut(level: Column) -> Column:
    """The runs of a level: fixed-width substrings, each the children of one parent."""
    width = WIDTH * _HEX
    return let(level, lambda s: F.transform(
        F.sequence(F.lit(0), F.ceil(F.length(s) / width).cast("int") - 1),
        lambda i: F.substring(s, i * width + 1, F.lit(width))))


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``position`` in their group from 0 and ``total``, the group's rows; written.

    Nulls come first. Rows equal in ``order`` follow each other in any order.
    """
    salted = materialise(rows.withColumn("_salt", F.rand(13)), "merkle-rows")
    keys = [*[F.col(c).asc_nulls_first() for c in (group, *order)], F.col("_salt")]
    placed = materialise(
        salted.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_salt")
        .withColumn("_at", F.monotonically_increasing_id()), "merkle-placed")
    discard(salted)
    part, place = F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit(_PLACE))
    runs = placed.groupBy(part, group).agg(F.count(F.lit(1)).alias("_n"), F.min(place).alias("_first"))
    every = Window.partitionBy(group)
    earlier = every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialise(runs.select(
        "_part", group, (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_start"),
        F.sum("_n").over(every).alias("total")), "merkle-starts")
    found = attach_small(placed.withColumn("_part", part), starts, ["_part", group], starts.count(), F.col("_at"))
    out = materialise(found.withColumn("position", F.col("_start") + place).drop("_start", "_part", "_at"), "merkle-numbered")
    discard(placed, starts)
    return out


def _blocks(nodes: DataFrame, group: str, carry: Sequence[str], levels: int) -> DataFrame:
    """One row a block of ``nodes`` (group, position, total, node, carry): members in order,
    the runs of each level, and the block's own ``node``."""
    size = WIDTH ** levels
    member = F.struct("position", "node", *carry)
    rows = nodes.groupBy(group, F.expr(f"position div {size}").alias("block")).agg(
        F.first("total").alias("total"), F.sort_array(F.collect_list(member)).alias("members"))
    rows = rows.withColumn("_level", F.array_join(F.transform("members", lambda m: m["node"]), ""))
    for k in range(levels):
        # the group's tree goes on above this level only if it has more than one node here
        rows = rows.withColumn(f"runs{k}", F.when(F.col("total") > WIDTH ** k, _cut(F.col("_level"))))
        rows = rows.withColumn("_level", F.coalesce(
            F.array_join(F.transform(f"runs{k}", lambda run: F.sha2(run, 256)), ""), F.col("_level")))
    return materialise(rows.withColumnRenamed("_level", "node"), "merkle-blocks")


def _climb(nodes: DataFrame, group: str, carry: Sequence[str], levels: int) -> list[DataFrame]:
    """Blocks of each round, from the leaves to the last one, in which every group is one block."""
    rounds = [_blocks(nodes, group, carry, levels)]
    size = WIDTH ** levels
    while (rounds[-1].agg(F.max("total")).first()[0] or 0) > size:
        above = rounds[-1].where(F.col("total") > size).select(
            group, F.col("block").alias("position"), F.ceil(F.col("total") / size).cast("long").alias("total"), "node")
        rounds.append(_blocks(above, group, [], levels))
    return rounds


def _roots(rounds: list[DataFrame], group: str, levels: int) -> DataFrame:
    """The root of each group: the node of the block that holds all of it."""
    tops = [b.where(F.col("total") <= WIDTH ** levels).select(group, "node") for b in rounds]
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return out


def _members(blocks: DataFrame, paths: DataFrame, group: str, given: Sequence[str], levels: int) -> DataFrame:
    """The members of ``blocks`` with ``siblings``, those of their block and then those of ``paths``.

    ``paths``: group, block, siblings above it, and the columns ``given`` of the group.
    """
    above = paths.select(F.col(group).alias("_group"), F.col("block").alias("_block"), F.col("siblings").alias("_above"), *given)
    both = blocks.join(above, F.col(group).eqNullSafe(F.col("_group")) & (F.col("block") == F.col("_block")))

    def flanks(k: int, at: Column) -> Column:
        node = at if k == 0 else F.floor(at / WIDTH ** k).cast("int")
        inside = (node % WIDTH) * _HEX
        run = F.element_at(f"runs{k}", F.floor(node / WIDTH).cast("int") + 1)
        return F.when(F.col(f"runs{k}").isNotNull(), F.struct(
            F.substring(run, F.lit(1), inside).alias("left"),
            F.substring(run, inside + _HEX + 1, F.lit(WIDTH * _HEX)).alias("right")))

    def placed(m: Column, at: Column) -> Column:
        own = F.filter(F.array(*[flanks(k, at) for k in range(levels)]), lambda s: s.isNotNull())
        return F.struct(m.alias("member"), F.concat(own, F.col("_above")).alias("siblings"))

    found = both.select(group, *given, F.explode(F.transform("members", placed)).alias("_m"))
    return found.select(group, *given, "_m.member.*", "_m.siblings")


def _descend(rounds: list[DataFrame], tops: DataFrame, group: str, given: Sequence[str], levels: int) -> DataFrame:
    """The nodes of the first round with all their siblings; ``tops``: group, siblings above its root, given."""
    whole = tops.withColumn("block", F.lit(0).cast("long"))
    paths = whole
    for blocks in reversed(rounds[1:]):
        below = _members(blocks, paths, group, given, levels).select(
            group, F.col("position").alias("block"), "siblings", *given)
        # a group that was whole in an earlier round has its only block there
        paths = materialise(whole.join(
            below.select(F.col(group).alias("_known")).distinct(), F.col(group).eqNullSafe(F.col("_known")), "left_anti",
        ).unionByName(below), "merkle-paths")
    return _members(rounds[0], paths, group, given, levels)


def manifest(
    rows: DataFrame, *, group: str = "lang", order: str = "doc_id", node: str = "leaf",
    carry: Sequence[str] = (), levels: int = LEVELS,
) -> DataFrame:
    """Per row of ``rows``: group, order, node and ``carry``, with ``subroot``, ``root`` and ``siblings``.

    ``node`` is the row's hash. In each group (null is one, and comes first) rows are taken
    by ``order``, nulls first, then by hash; every eight nodes become one, the last run as
    many as are left, until one remains: ``subroot``. The subroots in order of their groups
    make the ``root`` in the same way. ``siblings`` are the neighbours in each run from the
    row to the root: {left, right}, concatenated digests, both empty in a run of one. Equal
    rows are leaves of their own beside each other. An empty table gives an empty one.
    """
    names = {group: "_g", order: "_o", node: "node"}
    plain = rows.select(*[F.col(c).alias(n) for c, n in names.items()],
                        F.struct(*([F.col(c) for c in carry] or [F.lit(0).alias("none")])).alias("_carry"))
    nodes = numbered(plain, "_g", ["_o", "node"])
    trees = _climb(nodes, "_g", ["_o", "_carry"], levels)
    discard(nodes)
    subroots = _roots(trees, "_g", levels)
    over = numbered(subroots.select(F.lit(0).alias("_all"), F.col("_g").alias("_of"), "node"), "_all", ["_of"])
    upper = _climb(over, "_all", ["_of"], levels)
    top = _roots(upper, "_all", levels).select(
        "_all", F.array().cast("array<struct<left:string,right:string>>").alias("siblings"), F.col("node").alias("root"))
    tops = materialise(_descend(upper, top, "_all", ["root"], levels).select(
        F.col("_of").alias("_g"), "siblings", "root", F.col("node").alias("subroot")), "merkle-tops")
    out = _descend(trees, tops, "_g", ["root", "subroot"], levels)
    return out.select(F.col("_g").alias(group), F.col("_o").alias(order), F.col("node").alias(node),
                      *[F.col(f"_carry.{c}").alias(c) for c in carry], "subroot", "root", "siblings")


def proof(siblings: Column) -> Column:
    """sha256 of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(siblings, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(node: Column, siblings: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(siblings, node, lambda below, s: digest(s["left"], below, s["right"]))
