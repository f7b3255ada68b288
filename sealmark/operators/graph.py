"""Dependency graphs as edges: components, cycles, reachability, digests of what is reached, missing and stale dependencies.

Graphs are first made smaller, round by round. A node that no more than one edge enters, or no more than one leaves, is taken out and
the edges through it are joined to one; a round takes out a set of such nodes no two of which are neighbours, about a third of a chain, so
a chain or ring of n nodes takes log n rounds of geometrically falling size. What every round took out is put back in reverse. A graph of at most
``LOCAL_EDGES`` edges, a bound that does not grow, is then answered within tasks. Graphs in which too few such nodes are left, and which
are larger than that, take the rounds of ``_spread`` and ``_stepped``, as many as their paths are long.

Tables of a round meet sorted (``_met``) and are never sent through the driver: files of ids are packed so well that their size says little of their rows.

Where pairs are only asked about (``ancestors``), what reaches a node is a bit for each start, ``BLOCK`` of them a row, and not a row each.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby
from math import ceil
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealmark.operators.chain import numbered, tree_digests
from sealmark.operators.settled import scratch, settle

#: Edges that one task may hold.
LOCAL_EDGES = 1 << 17
#: A round that takes out less than this share of the nodes is the last one.
WORTH = 0.05
#: Starts that one pass over a graph in a task follows at once, a bit each.
STARTS = 4096
#: Starts that one row of a node tells of, a bit each.
BLOCK = 64


def _plain(edges: DataFrame) -> DataFrame:
    return edges.filter("src != dst").select("src", "dst").distinct()


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def _at(nodes: DataFrame, end: str) -> DataFrame:
    return nodes.select(F.col("node").alias(end))


def _met(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    return left.join(right.hint("merge"), on, how)


# --- within a task ---------------------------------------------------------------------------------


class Small:
    """A graph of bounded size: components in the order of a topological sort (an edge leads to a later component, or stays)."""

    def __init__(self, src: list, dst: list):
        self.place: dict[Any, int] = {}
        for x in (*src, *dst):
            self.place.setdefault(x, len(self.place))
        self.names = list(self.place)
        a, b = (np.fromiter((self.place[x] for x in side), np.int64, len(side)) for side in (src, dst))
        order = np.argsort(a, kind="stable")
        self.ends, self.to = np.searchsorted(a[order], np.arange(len(self.names) + 1)).tolist(), b[order].tolist()
        self.component = self._components()

    def _components(self) -> list[int]:
        """By paths: open nodes stand on a stack, and a second one holds where each component that may still be joined begins."""
        n = len(self.names)
        seen, component, found = [-1] * n, [-1] * n, 0
        opened: list[int] = []
        begins: list[int] = []
        clock = 0
        for root in range(n):
            if seen[root] >= 0:
                continue
            walk = [(root, self.ends[root])]
            seen[root], clock = clock, clock + 1
            opened.append(root)
            begins.append(root)
            while walk:
                node, i = walk.pop()
                if i < self.ends[node + 1]:
                    walk.append((node, i + 1))
                    near = self.to[i]
                    if seen[near] < 0:
                        seen[near], clock = clock, clock + 1
                        opened.append(near)
                        begins.append(near)
                        walk.append((near, self.ends[near]))
                    elif component[near] < 0:
                        while seen[begins[-1]] > seen[near]:
                            begins.pop()
                elif begins[-1] == node:
                    begins.pop()
                    while component[node] < 0:
                        component[opened.pop()] = found
                    found += 1
        return [found - 1 - c for c in component]

    def reached(self, starts: list) -> Iterator[tuple[Any, int, bool]]:
        """(node, bits, again) for every node that one of the ``starts`` reaches, a bit each; ``again``: also from itself, by an edge or more."""
        return self.marked((s, 1 << i) for i, s in enumerate(starts))

    def marked(self, marks: Iterable[tuple[Any, int]]) -> Iterator[tuple[Any, int, bool]]:
        """(node, bits, again) for every node that has or is reached by bits of ``marks`` (node, bits)."""
        n = max(self.component, default=-1) + 1
        bits, members = [0] * n, [[] for _ in range(n)]
        for node, c in enumerate(self.component):
            members[c].append(node)
        for s, held in marks:
            if (at := self.place.get(s)) is not None:
                bits[self.component[at]] |= held
        for c in range(n):
            if bits[c]:
                for node in members[c]:
                    for k in range(self.ends[node], self.ends[node + 1]):
                        bits[self.component[self.to[k]]] |= bits[c]
        for c, held in enumerate(bits):
            if held:
                for node in members[c]:
                    yield self.names[node], held, len(members[c]) > 1


def _pairs(left: DataFrame) -> tuple[list, list]:
    """A graph that has been counted to be within the bound."""
    rows = left.select("src", "dst").toArrow()
    return rows.column("src").to_pylist(), rows.column("dst").to_pylist()


def _local_components(left: DataFrame) -> DataFrame:
    kind = left.schema["src"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, dst, of = [], [], pa.int64()
        for b in batches:
            of = b.schema.field(0).type
            src += b.column(0).to_pylist()
            dst += b.column(1).to_pylist()
        g = Small(src, dst)
        first: dict[int, Any] = {}
        for name, c in zip(g.names, g.component, strict=True):
            first.setdefault(c, name)
        if g.names:
            yield pa.RecordBatch.from_arrays([pa.array(g.names, of), pa.array([first[c] for c in g.component], of)], names=["node", "component"])

    return left.select("src", "dst").coalesce(1).mapInArrow(run, f"node {kind}, component {kind}")


def _local_reached(starts: DataFrame, left: DataFrame) -> DataFrame:
    """(of, node, again) of the distinct ``starts`` (of), in passes of so many starts, a task each."""
    kind = left.schema["src"].dataType.simpleString()
    graph = starts.sparkSession.sparkContext.broadcast(_pairs(left))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = None
        for b in batches:
            g = g or Small(*graph.value)
            of, every = b.schema.field(0).type, b.column(0).to_pylist()
            for i in range(0, len(every), STARTS):
                some = every[i : i + STARTS]
                place = {s: k for k, s in enumerate(some)}
                size, out, held = len(some) // 8 + 1, ([], [], []), 0
                for node, bits, again in g.reached(some):
                    hit = np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes(size, "little"), np.uint8), bitorder="little"))
                    mine = place.get(node)
                    out[0].append(hit)
                    out[1].append((node, len(hit)))
                    out[2].append(np.ones(len(hit), bool) if again or mine is None else hit != mine)
                    held += len(hit)
                    if held > 1 << 16:
                        yield _made(some, out, of)
                        out, held = ([], [], []), 0
                if held:
                    yield _made(some, out, of)

    return starts.select("of").repartition(ceil(starts.count() / STARTS) or 1, "of").mapInArrow(run, f"of {kind}, node {kind}, again boolean")


def _made(starts: list, out: tuple[list, list, list], kind: pa.DataType) -> pa.RecordBatch:
    of = pa.array(starts, kind).take(pa.array(np.concatenate(out[0])))
    node = pa.array([n for n, _ in out[1]], kind).take(pa.array(np.repeat(np.arange(len(out[1])), [k for _, k in out[1]])))
    return pa.RecordBatch.from_arrays([of, node, pa.array(np.concatenate(out[2]))], names=["of", "node", "again"])


def _local_marks(marks: DataFrame, left: DataFrame) -> DataFrame:
    """``marks`` (node, block, bits) of nodes of the graph, carried on to all that they reach, in passes of ``STARTS`` bits."""
    kind, wide = left.schema["src"].dataType.simpleString(), STARTS // BLOCK
    graph = marks.sparkSession.sparkContext.broadcast(_pairs(left))
    dealt = marks.select("node", F.floor(F.col("block") / wide).alias("_pass"), (F.col("block") % wide).alias("_at"), "bits")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Any, int]]:
        for b in batches:
            for node, turn, at, bits in zip(*(c.to_pylist() for c in b.columns), strict=True):
                yield turn, node, (bits & (1 << BLOCK) - 1) << at * BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Small(*graph.value)
        of = pa.array(g.names[:1]).type
        for turn, some in groupby(rows(batches), lambda x: x[0]):
            names, blocks, bits = [], [], []
            for name, held, _ in g.marked((node, b) for _, node, b in some):
                words = np.frombuffer(held.to_bytes(STARTS // 8, "little"), "<i8")
                at = np.flatnonzero(words)
                names.append((name, len(at)))
                blocks.append(at + turn * wide)
                bits.append(words[at])
                if len(names) > 1 << 14:
                    yield _marks_made(names, blocks, bits, of)
                    names, blocks, bits = [], [], []
            if names:
                yield _marks_made(names, blocks, bits, of)

    return dealt.repartition("_pass").sortWithinPartitions("_pass").mapInArrow(run, f"node {kind}, block long, bits long")


def _marks_made(names: list[tuple[Any, int]], blocks: list, bits: list, kind: pa.DataType) -> pa.RecordBatch:
    node = pa.array([n for n, _ in names], kind).take(pa.array(np.repeat(np.arange(len(names)), [k for _, k in names])))
    return pa.RecordBatch.from_arrays([node, pa.array(np.concatenate(blocks)), pa.array(np.concatenate(bits))], names=["node", "block", "bits"])


# --- making a graph smaller ------------------------------------------------------------------------


def _thin(left: DataFrame, need: DataFrame | None, turn: int) -> DataFrame:
    """(node): nodes that at most one edge enters or leaves, none of them neighbours of each other; of ``need``, those that at most one edge leaves."""
    ends = left.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(left.select("dst", F.lit(0), F.lit(1)))
    few = ends.groupBy("node").agg(F.sum("o").alias("o"), F.sum("i").alias("i")).filter("o <= 1 OR i <= 1")
    few = few if need is None else _met(few, need.withColumn("_need", F.lit(True)), "node", "left").filter("o <= 1 OR _need IS NULL")
    few = few.select("node")
    rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)), F.col(c))
    between = _met(_met(left, _at(few, "src"), "src", "left_semi"), _at(few, "dst"), "dst", "left_semi")
    beaten = between.select(F.when(rank("src") < rank("dst"), F.col("dst")).otherwise(F.col("src")).alias("node")).distinct()
    return _met(few, beaten, "node", "left_anti")


def _through(left: DataFrame, out: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(u, node) and (node, w): the edges that enter and leave the nodes taken out."""
    return _met(left.select(F.col("src").alias("u"), F.col("dst").alias("node")), out, "node"), _met(left.select(F.col("src").alias("node"), F.col("dst").alias("w")), out, "node")


def _moved(nodes: DataFrame, out: DataFrame, way: DataFrame, to: str) -> DataFrame:
    """``nodes`` after a round: those taken out give way to the ones next to them."""
    return _met(nodes, out, "node", "left_anti").union(_met(way, nodes, "node", "left_semi").select(F.col(to).alias("node"))).distinct()


def _smaller(edges: DataFrame, need: DataFrame | None, most: int) -> tuple[list[tuple[DataFrame, DataFrame]], DataFrame, int, list[DataFrame], list[DataFrame | None]]:
    """(edges, nodes taken out) of each round, the edges left, their number, nodes with a way back to themselves that came up, and ``need`` before each round.

    A node of ``need`` that is taken out is answered from the one node that its edge leads to, which is then needed in its place.
    """
    left, rounds, loops, needs = settle(_plain(edges)), [], [], [need]
    n = left.count()
    while n > most:
        out = settle(_thin(left, needs[-1], len(rounds)))
        if out.count() < WORTH * n:
            break
        enter, leave = _through(left, out)
        over = _met(enter, leave, "node").select(F.col("u").alias("src"), F.col("w").alias("dst"))
        rest = _met(_met(left, _at(out, "src"), "src", "left_anti"), _at(out, "dst"), "dst", "left_anti").select("src", "dst")
        both = settle(rest.union(over).distinct())
        rounds.append((left, out))
        loops.append(both.filter("src = dst").select(F.col("src").alias("node")))
        needs.append(None if need is None else settle(_moved(needs[-1], out, leave, "w")))
        left = both.filter("src != dst")
        n = left.count()
    return rounds, left, n, loops, needs


# --- components ------------------------------------------------------------------------------------


def _least_label(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): the least label of all nodes that reach each node. Only labels that changed are sent on."""
    now = settle(labels.select("node", "label", F.lit(True).alias("new")))
    while not now.filter("new").isEmpty():
        sent = now.filter("new").select(F.col("node").alias("src"), "label").join(edges.hint("merge"), "src").select(F.col("dst").alias("node"), "label", F.lit(None).alias("was"))
        met = now.select("node", "label", F.col("label").alias("was")).union(sent).groupBy("node").agg(F.min("label").alias("label"), F.max("was").alias("was"))
        now = settle(met.select("node", "label", (F.col("label") < F.col("was")).alias("new")))
    return now.select("node", "label")


def _reaching(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label) of the roots and of all nodes from which edges of a label (src, dst, label) lead to its root. Each round writes what is new."""
    parts = [settle(roots)]
    while not parts[-1].isEmpty():
        back = _met(edges, parts[-1].withColumnRenamed("node", "dst"), ["dst", "label"]).select(F.col("src").alias("node"), "label").distinct()
        for p in parts:
            back = _met(back, p, ["node", "label"], "left_anti")
        parts.append(settle(back))
        if len(parts) > 8:
            parts = [settle(_all(parts[:-1])), parts[-1]]
    return _all(parts)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _spread(left: DataFrame) -> DataFrame:
    """(node, component) by labels that spread forward and are met backward.

    The nodes of a label from which its own node can be reached are a component, and all edges between labels or at such nodes go. Nodes are
    their own labels in the first round and get random ones after that.
    """
    found, turn = left.limit(0).select(F.col("src").alias("node"), F.col("src").alias("component")), 0
    while not left.isEmpty():
        # A node that nothing enters or leaves is a component of its own.
        inner = settle(_met(_met(left, left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"), left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"))
        rank = F.xxhash64("node", F.lit(turn)) if turn else F.lit(0).cast("long")
        labels = _least_label(_nodes(inner).select("node", F.struct(rank.alias("rank"), "node").alias("label")), inner)
        of = lambda end, name: labels.select(F.col("node").alias(end), F.col("label").alias(name))
        same = settle(_met(_met(inner, of("src", "label"), "src"), of("dst", "_other"), "dst").filter("label = _other").select("src", "dst", "label"))
        got = settle(_reaching(labels.filter("label.node = node"), same).select("node", F.col("label.node").alias("component")))
        found = settle(found.union(got))
        done = got.select("node")
        left = settle(_met(_met(same, _at(done, "src"), "src", "left_anti"), _at(done, "dst"), "dst", "left_anti").select("src", "dst"))
        turn += 1
    return found


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, component): strongly connected components, named by their least node; every node of an edge is in one.

    A node taken out is in a component that an edge enters it from and an edge leaves it for, if there is one.
    """
    with scratch(edges.sparkSession) as keep:
        rounds, left, n, *_ = _smaller(edges, None, local_edges)
        found = settle(_local_components(left) if n <= local_edges else _spread(left))
        for before, out in reversed(rounds):
            named = lambda side, end: _met(side, found.withColumnRenamed("node", end), end, "left").select("node", F.coalesce("component", end).alias("component"))
            enter, leave = _through(before, out)
            back = named(enter, "u").intersect(named(leave, "w"))
            found = settle(found.union(back))
        # A component may be named by a node that came back first, and has no row of its own.
        own = found.select(F.col("component").alias("node")).distinct().join(found.select("node").hint("merge"), "node", "left_anti")
        whole = found.union(own.select("node", F.col("node").alias("component")))
        least = whole.groupBy("component").agg(F.min("node").alias("_least"))
        named_ = _met(whole, least, "component").select("node", F.col("_least").alias("component"))
        return keep(_met(_nodes(edges), named_, "node", "left").select("node", F.coalesce("component", "node").alias("component")))


def cycle_edges(edges: DataFrame) -> DataFrame:
    """Edges inside a component of two nodes or more."""
    c = components(edges)
    of = lambda end, name: c.select(F.col("node").alias(end), F.col("component").alias(name))
    return _met(_met(edges, of("src", "_a"), "src"), of("dst", "_b"), "dst").filter("_a = _b AND src != dst").select("src", "dst", F.col("_a").alias("component"))


# --- reachability ----------------------------------------------------------------------------------


def _stepped(starts: DataFrame, left: DataFrame) -> DataFrame:
    """(of, node, again) by one edge a round, from the starts alone; each round writes what is new."""
    parts = [settle(starts.select("of", F.col("of").alias("at")))]
    front, back = parts[0], []
    while not front.isEmpty():
        step = _met(front.withColumnRenamed("at", "src"), left, "src").select("of", F.col("dst").alias("at")).distinct()
        back.append(settle(step.filter("of = at")))
        for p in parts:
            step = _met(step, p, ["of", "at"], "left_anti")
        front = settle(step)
        parts.append(front)
        if len(parts) > 8:
            parts, back = [settle(_all(parts))], [settle(_all(back))]
    again = _all(back).distinct().withColumn("_again", F.lit(True))
    return _met(_all(parts), again, ["of", "at"], "left").select("of", F.col("at").alias("node"), ((F.col("of") != F.col("at")) | F.col("_again").isNotNull()).alias("again"))


def _reached(starts: DataFrame, edges: DataFrame, local_edges: int) -> DataFrame:
    """(of, node, again) of the distinct ``starts`` (of): themselves and all that they reach."""
    begun = settle(starts.select(F.col("of").alias("node")).filter("node IS NOT NULL").distinct())
    rounds, left, n, loops, needs = _smaller(edges, begun, local_edges)
    left, asked = settle(left), _at(needs[-1], "of")
    if n <= local_edges:
        inside = _at(_nodes(left), "of")
        found = _local_reached(settle(_met(asked, inside, "of", "left_semi")), left)
        found = found.union(_met(asked, inside, "of", "left_anti").select("of", F.col("of").alias("node"), F.lit(False)))
    else:
        found = _stepped(asked, left)
    found = settle(found)
    for i in range(len(rounds) - 1, -1, -1):
        enter, leave = _through(*rounds[i])
        # What enters a node taken out reaches it, and it reaches what the one node does that it leads to.
        more = _met(found.select("of", F.col("node").alias("u")), enter, "u").select("of", "node", F.lit(True).alias("again")).distinct()
        found = settle(found.union(more))
        back = _met(leave, needs[i], "node", "left_semi").select(F.col("node").alias("_of"), F.col("w").alias("of"))
        back = _met(back, found, "of").select(F.col("_of").alias("of"), "node", F.lit(True).alias("again"))
        own = _met(rounds[i][1], needs[i], "node", "left_semi").select(F.col("node").alias("of"), "node", F.lit(False).alias("again"))
        own = _met(own, back.filter("of = node").select("of"), "of", "left_anti").select("of", "node", "again")
        found = settle(_met(found, _at(needs[i], "of"), "of", "left_semi").select("of", "node", "again").union(back).union(own))
    ways = _all([edges.filter("src = dst").select(F.col("src").alias("node")), *loops]).distinct()
    same = _met(found.filter("of = node"), ways.withColumn("_way", F.lit(True)), "node", "left")
    return found.filter("of != node").union(same.select("of", "node", (F.col("again") | F.col("_way").isNotNull()).alias("again")))


def reached(starts: DataFrame, edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(of, node): every node that a path of one edge or more leads to from the ``starts`` (of)."""
    with scratch(edges.sparkSession) as keep:
        return keep(_reached(starts, edges, local_edges).filter("again").select("of", "node"))


def closure(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(src, dst) of every path: all pairs, which is what is asked for."""
    return reached(edges.select(F.col("src").alias("of")), edges, local_edges).select(F.col("of").alias("src"), F.col("node").alias("dst"))


def _either(rows: DataFrame) -> DataFrame:
    return rows.select("node", "block", "bits").groupBy("node", "block").agg(F.bit_or("bits").alias("bits"))


def _stepped_marks(marks: DataFrame, left: DataFrame) -> DataFrame:
    """(node, block, bits) by one edge a round; only bits that are new to a node are sent on."""
    none = F.lit(0).cast("long")
    now = settle(marks.select("node", "block", "bits", F.col("bits").alias("new")))
    while not now.filter("new != 0").isEmpty():
        sent = _met(now.filter("new != 0").select(F.col("node").alias("src"), "block", "new"), left, "src").select(F.col("dst").alias("node"), "block", none.alias("bits"), "new")
        met = now.select("node", "block", "bits", none.alias("new")).union(sent).groupBy("node", "block").agg(F.bit_or("bits").alias("bits"), F.bit_or("new").alias("got"))
        now = settle(met.select("node", "block", F.col("bits").bitwiseOR(F.col("got")).alias("bits"), F.col("got").bitwiseAND(F.bitwise_not("bits")).alias("new")))
    return now.select("node", "block", "bits")


def _marked(starts: DataFrame, edges: DataFrame, local_edges: int, ends: DataFrame) -> DataFrame:
    """(node, block, bits): the ``starts`` (node, block, bits) that are or reach each of the ``ends`` (node).

    A start that is taken out of the graph marks what its edges lead to, so any may be taken out.
    """
    rounds, left, n, *_ = _smaller(edges, None, local_edges)
    marks, wants = [settle(starts)], [settle(ends.select("node").distinct())]
    for before, out in rounds:
        enter, leave = _through(before, out)
        on = _met(marks[-1], leave, "node").select(F.col("w").alias("node"), "block", "bits")
        marks.append(settle(_either(_met(marks[-1], out, "node", "left_anti").union(on))))
        wants.append(settle(_moved(wants[-1], out, enter, "u")))
    left = settle(left)
    found = _local_marks(marks[-1], left) if n <= local_edges else _stepped_marks(marks[-1], left)
    found = settle(_met(_either(found.union(marks[-1])), wants[-1], "node", "left_semi"))
    for i in range(len(rounds) - 1, -1, -1):
        out = _met(rounds[i][1], wants[i], "node", "left_semi")
        came = _met(found.withColumnRenamed("node", "u"), _through(rounds[i][0], out)[0], "u")
        back = _either(came.select("node", "block", "bits").union(_met(marks[i], out, "node", "left_semi")))
        found = settle(_met(found, wants[i], "node", "left_semi").union(back))
    return found


def ancestors(pairs: DataFrame, edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``pairs`` (of, node) whose ``node`` is ``of`` or is reached from it along (src, dst). Followed from the side that has fewer different nodes.

    Pairs meet their starts sorted, or, where starts are so few that many pairs share each, by a broadcast of at most ``STARTS`` rows.
    """
    with scratch(edges.sparkSession) as keep:
        asked = settle(pairs)
        far = asked.filter("of != node")
        ofs, nodes = (settle(far.select(F.col(c).alias("node")).distinct()) for c in ("of", "node"))
        n_ofs, n_nodes = ofs.count(), nodes.count()
        start, end, begun, ends, way = "of", "node", ofs, nodes, edges.select("src", "dst")
        if n_nodes < n_ofs:
            start, end, begun, ends, way = "node", "of", nodes, ofs, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        bit = F.expr(f"shiftleft(1L, CAST(position % {BLOCK} AS INT))")
        starts = settle(numbered(begun, "node").select("node", F.floor(F.col("position") / BLOCK).alias("block"), bit.alias("bits")))
        found = _marked(starts, way, local_edges, ends)
        own = starts.select(F.col("node").alias(start), "block", F.col("bits").alias("_bit"))
        dealt = far.join(F.broadcast(own) if min(n_ofs, n_nodes) <= STARTS else own.hint("merge"), start)
        met = _met(dealt, found.select(F.col("node").alias(end), "block", F.col("bits").alias("_bits")), [end, "block"])
        return keep(asked.filter("of = node").union(met.filter(F.col("_bits").bitwiseAND(F.col("_bit")) != 0).select(*pairs.columns)))


def digests_of_reached(entries: DataFrame, edges: DataFrame, files: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(of, digest, n): one digest over path and content digest of an entry (of) and everything it reaches, in order of path, and the number of files.

    ``files`` has (node, path, sha). What is reached but is no file does not count. Rows of an entry stream by in order; none is gathered.
    """
    with scratch(edges.sparkSession) as keep:
        rows = _met(_reached(entries, edges, local_edges), files.select("node", "path", "sha"), "node").select("of", "path", "sha")
        return keep(tree_digests(rows, "of").withColumnRenamed("area", "of"))


def dependency_faults(works: DataFrame, needs: DataFrame) -> DataFrame:
    """(id, needs, problem): unknown works, a work that needs itself, and revisions that are no longer current."""
    known = works.select(F.col("id").alias("needs"), F.col("revision").alias("_current"))
    problem = F.when(F.col("needs") == F.col("id"), "self").when(F.col("_current").isNull(), "unknown").when(F.col("_current") != F.col("revision"), "stale")
    return needs.join(known, "needs", "left").select("id", "needs", problem.alias("problem")).filter("problem IS NOT NULL")
