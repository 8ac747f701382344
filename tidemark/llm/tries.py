"""Prefix trie of conversations by the Euler-tour technique.

A node is a distinct sequence of first turns. Conversations that start with it are its members; it is named by the smallest of them and its
depth, which is unique. Each node gives two arcs, one that enters it and one that leaves it, and each arc names the arc after it. The
tour of the tree is that linked list; its prefix sums of leaves and savings, taken at the arcs of a node, differ by what lies below it.

The list is ranked without walking it. Arcs of one conversation that follow each other are first joined to runs. Runs are then joined
in rounds: a run whose coin shows heads takes in the next one if that shows tails, which removes a quarter of them each time, and each
round is one join. The last ``BASE`` runs, a fixed number, are ranked in one task, and the rounds are undone in reverse. Work is proportional
to the list, and every round is a table in the shared folder, so a lost executor repeats one round at most.

Nothing needs the turns of one conversation, the children of one node or the members of one node in one task: prefixes are sums of
hashes of (turn, position), which add up over slices, positions and siblings come from a ``Panel``, and digests are streamed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rolling import lag_k
from tidemark.llm.common import stored
from tidemark.panel import ROW_NUMBER, SERIES_ROWS, Panel

#: Positions of one conversation, or depths of one path, that a window takes at once.
SLICE = 4096
#: Runs that one task ranks at the end.
BASE = 20_000
ENTER, EXIT = 0, 1
WEIGHTS = ["steps", "leaves", "saved"]


# -- conversations -----------------------------------------------------------------------------


def turns_of(conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", **options) -> DataFrame:
    """Stored narrow rows (`conv`, `pos` from 1, `t1`, `t2`, `bytes`, `n` turns of the conversation): two hashes stand for role and text.

    Turns are ordered by their number, null first; those of equal number by the hashes. Null roles and texts are empty, a
    repeated row is a turn of its own, and rows without a conversation are left out. `options` go to `Panel`, which numbers
    a conversation of any length.
    """
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text)]
    narrow = conversations.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("turn"), F.xxhash64(*said).alias("t1"),
        F.xxhash64(F.lit(1), *reversed(said)).alias("t2"), F.octet_length(said[1]).cast("long").alias("bytes"),
    )
    rows = Panel(narrow, "conv", "turn", ["t1", "t2"], **options).numbered().rows
    return stored(rows.select("conv", F.col(ROW_NUMBER).alias("pos"), "t1", "t2", "bytes", F.col(SERIES_ROWS).alias("n")), "turns")


def lengths_of(turns: DataFrame) -> DataFrame:
    return turns.filter("pos = 1").select("conv", "n")


def grafted(turns: DataFrame, base: Column, most: Column, limit: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first turns of another: `most` turns (at most `limit`, all if it has fewer) of conversation `base`,
    then the own turns after the first `most`. Both are expressions over `conv`. Returns the rows and the lengths, zero included.

    Own turns meet their conversation's lengths by slice, so a conversation of very many turns is not one key.
    """
    lengths = lengths_of(turns)
    lent = lengths.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs = lengths.select("conv", F.col("n").alias("own_n"), base.cast("long").alias("base"), most.cast("long").alias("most"))
    convs = convs.join(lent, "base", "left").withColumn("lent", F.least("most", F.coalesce("base_n", F.lit(0))))
    convs = convs.withColumn("n", F.col("lent") + F.greatest(F.col("own_n") - F.col("most"), F.lit(0)))
    convs = stored(convs.select("conv", "base", "own_n", "most", "lent", "n"), "lengths")
    slot = F.floor(F.col("pos") / SLICE)
    keys = convs.select("conv", "most", "lent", F.col("n").alias("total"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("own_n") / SLICE))).alias("slot"))
    own = turns.drop("n").withColumn("slot", slot).join(keys, ["conv", "slot"]).filter("pos > most")
    own = own.select("conv", (F.col("pos") - F.col("most") + F.col("lent")).alias("pos"), "t1", "t2", "bytes", F.col("total").alias("n"))
    first = turns.filter(F.col("pos") <= limit).select(F.col("conv").alias("base"), "pos", "t1", "t2", "bytes")
    taken = convs.filter("lent > 0").select("conv", "base", "lent", "n").join(first, "base").filter("pos <= lent")
    return own.unionByName(taken.select("conv", "pos", "t1", "t2", "bytes", "n")), convs.select("conv", "n")


# -- nodes -------------------------------------------------------------------------------------


def _name(depth: Column, sums: list[Column]) -> list[Column]:
    """128 bits that stand for a sequence of turns."""
    return [F.xxhash64(depth, *sums), F.xxhash64(*reversed(sums), depth)]


def prefixes(turns: DataFrame) -> DataFrame:
    """One row for each prefix of each conversation: names of the node (`a`, `b`) and its parent (`pa`, `pb`), `last` where it is all of it.

    Two 64-bit hashes of turn and position are cut into four numbers of 32 bits, whose running sums name the prefix. Sums of
    slices add up, so that no window is longer than a slice.
    """
    hashes = [F.xxhash64("t1", "t2", "pos"), F.xxhash64("pos", "t2", "t1")]
    parts = [p for h in hashes for p in (F.shiftrightunsigned(h, 32), h.bitwiseAND(0xFFFFFFFF))]
    names = [f"p{i}" for i in range(4)]
    rows = turns.select("conv", "pos", "bytes", "n", *(p.alias(n) for p, n in zip(parts, names)), F.floor((F.col("pos") - 1) / SLICE).alias("slice"))
    within = Window.partitionBy("conv", "slice").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", *(F.sum(n).over(within).alias(f"s{n}") for n in names))
    short, long = rows.filter(F.col("n") <= SLICE), rows.filter(F.col("n") > SLICE)
    totals = long.groupBy("conv", "slice").agg(*(F.max(f"s{n}").alias(f"t{n}") for n in names))
    before = Window.partitionBy("conv").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select("conv", "slice", *(F.coalesce(F.sum(f"t{n}").over(before), F.lit(0)).alias(f"c{n}") for n in names))
    long = long.join(carry, ["conv", "slice"]).withColumns({f"s{n}": F.col(f"s{n}") + F.col(f"c{n}") for n in names}).select(*rows.columns)
    own = _name(F.col("pos"), [F.col(f"s{n}") for n in names])
    parent = _name(F.col("pos") - 1, [F.col(f"s{n}") - F.col(n) for n in names])
    columns = [c.alias(n) for c, n in zip([*own, *parent], ("a", "b", "pa", "pb"))]
    return short.unionByName(long).select("conv", F.col("pos").alias("depth"), *columns, "bytes", (F.col("pos") == F.col("n")).alias("last"))


def _root(spark) -> DataFrame:
    none = [F.lit(0).cast("long")] * 4
    return spark.range(1).select(*(c.alias(n) for c, n in zip(_name(F.lit(0).cast("long"), none), ("a", "b"))))


def nodes_of(paths: DataFrame, lengths: DataFrame) -> DataFrame:
    """Stored nodes: `a`, `b`, `conv` (smallest member), `depth`, `parent`, `n_convs`, and `cost`, the bytes that sharing the node saves.

    The root's name is known, so the children of the root, which may be most nodes, need no join to find their parent.
    """
    root = _root(paths.sparkSession)
    top = lengths.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    made = paths.groupBy("a", "b", "depth").agg(
        F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes"), F.max("pa").alias("pa"), F.max("pb").alias("pb")
    ).withColumn("cost", (F.col("n_convs") - 1) * F.col("bytes"))
    columns = ["a", "b", "conv", "depth", "parent", "n_convs", "cost"]
    at_root = made.filter("depth = 1").join(F.broadcast(top.select(F.col("conv").alias("parent"))))
    parents = made.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv").alias("parent"))
    below = made.filter("depth > 1").join(parents, ["pa", "pb"])
    first = root.join(F.broadcast(top)).select("a", "b", "conv", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent"), "n_convs", F.lit(0).cast("long").alias("cost"))
    return stored(at_root.select(*columns).unionByName(below.select(*columns)).unionByName(first), "nodes")


def end_digests(paths: DataFrame, lengths: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at each node (`a`, `b`, `ends_sha256`), ascending and joined by commas.

    Ids of a narrow range are joined first; then each node's pieces stream through the digest in order. However many conversations are
    equal, no task holds more than one batch of pieces.
    """
    ends = paths.filter("last").select("a", "b", "conv").unionByName(lengths.filter("n = 0").join(F.broadcast(_root(paths.sparkSession))).select("a", "b", "conv"))
    pieces = ends.groupBy("a", "b", F.shiftright("conv", 10).alias("range")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            done = []
            for a, b, ids in zip(batch["a"], batch["b"], batch["ids"]):
                if (a, b) == key:
                    state.update(b"," + ids.encode())
                else:
                    if state:
                        done.append((*key, state.hexdigest()))
                    key, state = (a, b), hashlib.sha256(ids.encode())
            yield pd.DataFrame(done, columns=["a", "b", "ends_sha256"])
        if state:
            yield pd.DataFrame([(*key, state.hexdigest())], columns=["a", "b", "ends_sha256"])

    # More partitions than the setting are never needed: digests are few bytes.
    ordered = pieces.repartition("a", "b").sortWithinPartitions("a", "b", "range").select("a", "b", "ids")
    return ordered.mapInPandas(digest, "a long, b long, ends_sha256 string")


# -- the tour ----------------------------------------------------------------------------------


def arcs_of(nodes: DataFrame, **options) -> DataFrame:
    """Two arcs for each node: (`conv`, `arc` = 2 depth, plus one to leave) and the arc after it (`next_conv`, `next_arc`).

    Children are visited by their smallest member. Leaving arcs carry the node's figures. `options` go to `Panel`, which finds the next
    sibling among any number of children.
    """
    below = nodes.filter("depth > 0").select("parent", "depth", "conv")
    children = below.groupBy("parent", "depth").agg(F.count(F.lit(1)).alias("n_children"), F.min("conv").alias("child"))
    siblings = Panel(below, ["parent", "depth"], "conv", **options).roll({"sibling": lag_k("conv", -1)}).df.select("conv", "depth", "sibling")
    children = children.select(F.col("parent").alias("conv"), (F.col("depth") - 1).alias("depth"), "n_children", "child")
    rows = nodes.join(children, ["conv", "depth"], "left").join(siblings, ["conv", "depth"], "left")
    rows = rows.withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    arc, leaf = 2 * F.col("depth"), F.col("child").isNull()
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    enter = F.struct(
        arc.alias("arc"), F.coalesce("child", "conv").alias("next_conv"), F.when(leaf, arc + EXIT).otherwise(arc + 2).alias("next_arc"),
        leaf.cast("long").alias("leaves"), F.col("cost").alias("saved"), none.alias("parent"), none.alias("n_convs"), none.alias("n_children"),
    )
    up = F.when(F.col("depth") > 0, arc - 1)
    leave = F.struct(
        (arc + EXIT).alias("arc"), F.coalesce("sibling", "parent").alias("next_conv"), F.when(F.col("sibling").isNotNull(), arc).otherwise(up).alias("next_arc"),
        zero.alias("leaves"), zero.alias("saved"), F.col("parent"), F.col("n_convs"), F.col("n_children"),
    )
    return rows.select("conv", F.inline(F.array(enter, leave))).withColumn("steps", F.lit(1).cast("long"))


def runs_of(arcs: DataFrame) -> DataFrame:
    """The arcs with the run they belong to (`head`), their sums before them within it, and whether they are its `tail`.

    Arcs into the nodes of one conversation follow each other downwards, arcs out of them upwards, as far as no other branch comes between.
    """
    kind = F.col("arc") % 2
    order = F.when(kind == ENTER, F.col("arc")).otherwise(-F.col("arc"))
    keyed = arcs.withColumns({"kind": kind, "slice": F.floor(F.col("arc") / (2 * SLICE)), "at": order})
    w = Window.partitionBy("conv", "kind", "slice").orderBy("at")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    follows = (F.lag("next_conv").over(w) == F.col("conv")) & (F.lag("next_arc").over(w) == F.col("arc"))
    begun = keyed.select("*", (~F.coalesce(follows, F.lit(False))).alias("start"), *(F.sum(c).over(upto).alias(f"sum_{c}") for c in WEIGHTS))
    start = lambda c: F.last(F.when(F.col("start"), c), ignorenulls=True).over(upto)
    run = begun.select(
        "*", start(F.col("arc")).alias("head"), F.coalesce(F.lead("start").over(w), F.lit(True)).alias("tail"),
        *(start(F.col(f"sum_{c}") - F.col(c)).alias(f"base_{c}") for c in WEIGHTS),
    )
    before = {f"before_{c}": F.col(f"sum_{c}") - F.col(c) - F.col(f"base_{c}") for c in WEIGHTS}
    return run.withColumns(before).select(*arcs.columns, "head", "tail", *before)


def _coin(conv: str, arc: str, number: int) -> Column:
    return F.xxhash64(F.col(conv), F.col(arc), F.lit(number)).bitwiseAND(1) == 1


def _walk(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums before each element of linked lists that fit one task."""
    key = list(zip(rows["conv"], rows["arc"]))
    place = {k: i for i, k in enumerate(key)}
    after = [place.get(k) for k in zip(rows["next_conv"], rows["next_arc"])]
    weights = rows[WEIGHTS].to_numpy(np.int64)
    before = np.zeros_like(weights)
    for i in set(range(len(key))) - {x for x in after if x is not None}:
        total = np.zeros(len(WEIGHTS), np.int64)
        at: int | None = i
        while at is not None:
            before[at] = total
            total = total + weights[at]
            at = after[at]
    return rows[["conv", "arc"]].assign(**{f"p_{c}": before[:, i] for i, c in enumerate(WEIGHTS)})


def list_ranks(links: DataFrame, base: int = BASE) -> DataFrame:
    """Sums of the weights before each element of a linked list, by contraction in rounds.

    Elements are (`conv`, `arc`) with `next_conv`, `next_arc` (null at the end) and the columns WEIGHTS; returned are the sums
    `p_` of each. A list without elements gives none.
    """
    names = ["conv", "arc", "next_conv", "next_arc", *WEIGHTS]
    live = stored(links.select(*names), "links")
    levels: list[DataFrame] = []
    gone = ["gone_conv", "gone_arc", *(f"gone_{c}" for c in WEIGHTS)]
    while live.count() > base:
        number = len(levels)
        tails, next_tails = _coin("conv", "arc", number), F.coalesce(_coin("next_conv", "next_arc", number) & F.col("next_conv").isNotNull(), F.lit(False))
        taking = live.filter(~tails & next_tails)
        idle = live.filter(~tails & ~next_tails)
        other = live.filter(tails).select(*(F.col(c).alias(f"o_{c}") for c in names))
        met = taking.join(other, (F.col("next_conv") == F.col("o_conv")) & (F.col("next_arc") == F.col("o_arc")), "full_outer")
        takes, taken = F.col("conv").isNotNull(), F.col("o_conv").isNotNull()
        level = met.select(
            F.coalesce("conv", "o_conv").alias("conv"), F.when(takes, F.col("arc")).otherwise(F.col("o_arc")).alias("arc"),
            *(F.when(taken, F.col(f"o_{c}")).otherwise(F.col(c)).alias(c) for c in ("next_conv", "next_arc")),
            *((F.coalesce(c, F.lit(0)) + F.coalesce(f"o_{c}", F.lit(0))).alias(c) for c in WEIGHTS),
            *(F.when(takes & taken, F.col(f"o_{c}")).alias(f"gone_{c}") for c in ("conv", "arc")),
            *(F.when(takes & taken, F.col(c)).alias(f"gone_{c}") for c in WEIGHTS),
        ).unionByName(idle.select(*names, *(F.lit(None).cast("long").alias(c) for c in gone)))
        levels.append(stored(level, "round"))
        live = levels[-1].select(*names)
    schema = "conv long, arc long, " + ", ".join(f"p_{c} long" for c in WEIGHTS)
    ranks = live.groupBy((F.col("arc") < 0).alias("_all")).applyInPandas(_walk, schema)
    for level in reversed(levels):
        ranks = stored(ranks, "ranks")
        removed = level.filter("gone_conv is not null").join(ranks, ["conv", "arc"]).select(
            F.col("gone_conv").alias("conv"), F.col("gone_arc").alias("arc"), *((F.col(f"p_{c}") + F.col(f"gone_{c}")).alias(f"p_{c}") for c in WEIGHTS)
        )
        ranks = ranks.unionByName(removed)
    return stored(ranks, "ranks")


def prefix_trie(turns: DataFrame, lengths: DataFrame, base: int = BASE, **options) -> DataFrame:
    """The nodes of the trie of conversations, each with its place and what lies below it.

    `turns` has the rows of `turns_of` or `grafted`, `lengths` one row (`conv`, `n`) for each conversation, those without turns
    included. Returned are `conv_id` (smallest member), `depth`, `parent_conv_id`, `n_convs`, `n_children`, `n_leaves` (nodes without
    children in the subtree, the top included), `saved_tokens` (over the subtree, bytes of a node's text for each member but one),
    `ends_sha256`, and `entered` and `left`, the places of the node's arcs in the tour from 0. No conversations, no nodes.
    """
    paths = stored(prefixes(turns), "prefixes")
    nodes = nodes_of(paths, lengths)
    arcs = stored(runs_of(arcs_of(nodes, **options)), "arcs")
    links = arcs.filter("tail").select(
        "conv", F.col("head").alias("arc"), "next_conv", "next_arc", *((F.col(f"before_{c}") + F.col(c)).alias(c) for c in WEIGHTS)
    )
    ranks = list_ranks(links, base).withColumnRenamed("arc", "head")
    placed = arcs.join(ranks, ["conv", "head"]).withColumns({f"at_{c}": F.col(f"p_{c}") + F.col(f"before_{c}") for c in WEIGHTS})
    at = lambda c, kind: F.max(F.when(F.col("arc") % 2 == kind, F.col(f"at_{c}")))
    below = lambda c: at(c, EXIT) - at(c, ENTER)
    figures = placed.groupBy("conv", F.shiftright("arc", 1).alias("depth")).agg(
        F.max("parent").alias("parent_conv_id"), F.max("n_convs").alias("n_convs"), F.max("n_children").alias("n_children"),
        below("leaves").alias("n_leaves"), below("saved").alias("saved_tokens"), at("steps", ENTER).alias("entered"), at("steps", EXIT).alias("left"),
    )
    digests = nodes.select("a", "b", "conv", "depth").join(end_digests(paths, lengths), ["a", "b"]).select("conv", "depth", "ends_sha256")
    nobody = hashlib.sha256(b"").hexdigest()
    return figures.join(digests, ["conv", "depth"], "left").select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(nobody)).alias("ends_sha256"), "entered", "left",
    )
