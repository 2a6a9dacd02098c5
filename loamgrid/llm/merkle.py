"""Merkle manifest of a table: a leaf for each row, a tree for each language, one root, and a proof for each leaf.

A leaf is the digest of a row's fields, each ``-`` if null and else its byte count, ``:`` and its value.
``FAN`` consecutive nodes are one run and become their digest; a last run may be shorter. Trees of
languages grow from their leaves, and the tree of the table from the languages' subroots.

Witnesses are kept while a tree grows (``Witnesses``): an appended node takes the siblings that its open
run already has, later siblings are added to the open run as they come, and a run that is complete is
appended one level up as a node of its own. What stands above a node is shared by all that stands below
it, so an append touches one open run a level. Places in a tree are found by a range sort and by counts
of its partitions, never by one sorted task. A tree is cut into blocks of ``FAN ** BLOCK_LEVELS`` aligned
places: each block is appended by itself, and the roots of the blocks are appended in turn, in as many
rounds as the largest tree asks for. Then the blocks' own witnesses go down to their leaves, where the
block is appended once more and the two halves of each witness meet; no witness of a leaf is ever
shuffled. Everything that one task holds is one block.

Digests are SHA-256 of the inputs' lower-case hexadecimal text, one after the other. Defined results:
rows ascend by doc_id, those without an id first; rows that share an id ascend by their leaf, and rows
that are equal in all fields keep an order of their own (their leaves are equal); a null lang is a
language of its own before all others; the others ascend by their UTF-8 bytes; an empty table has no
rows and no root; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamgrid.llm.exactdup import _LOWER, _UPPER
from loamgrid.plans.session import Scratch

FAN, BLOCK_LEVELS = 8, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(nodes: list[bytes]) -> bytes:
    return hashlib.sha256("".join([x.hex() for x in nodes]).encode()).digest()


class _Run:
    """An open run: its nodes so far, and for each the runs or leaves below it."""

    __slots__ = ("nodes", "below")

    def __init__(self):
        self.nodes, self.below = [], []


class Witnesses:
    """A tree that grows by appends and keeps what proves each of its leaves.

    ``append`` takes the next leaf; ``finish`` closes the open runs, up to ``levels`` levels or, where that
    is None, until one node remains. ``proofs`` then gives each leaf's witness from the bottom up: at
    each level the place in the run and the run's other nodes.
    """

    def __init__(self, fan: int = FAN):
        self.fan, self.open, self.size = fan, [], 0

    def append(self, leaf: bytes) -> None:
        self.size += 1
        self._put(0, leaf, None)

    def _put(self, level: int, node: bytes, below: _Run | None) -> None:
        if level == len(self.open):
            self.open.append(_Run())
        run = self.open[level]
        # All nodes of an open run share its list: who comes later is a sibling of all who came before.
        run.nodes.append(node)
        run.below.append(below)
        if len(run.nodes) == self.fan:
            self.open[level] = _Run()
            self._put(level + 1, digest(run.nodes), run)

    def finish(self, levels: int | None = None) -> bytes:
        """The root, after the last append."""
        level = 0
        while True:
            run = self.open[level] if level < len(self.open) else _Run()
            above = any(x.nodes for x in self.open[level + 1 :])
            if levels is None and not above and len(run.nodes) == 1 or level == levels:
                self.top = run.below[0]
                return run.nodes[0]
            if run.nodes:
                self.open[level] = _Run()
                self._put(level + 1, digest(run.nodes), run)
            level += 1

    def proofs(self) -> Iterator[bytes]:
        """The packed witness of each leaf, in order of the appends."""
        yield from self._down(self.top, b"")

    def _down(self, run: _Run | None, above: bytes) -> Iterator[bytes]:
        if run is None:
            yield above
            return
        for i, below in enumerate(run.below):
            yield from self._down(below, pack_step(i, run.nodes) + above)


def pack_step(place: int, nodes: list[bytes]) -> bytes:
    """One level of a witness: the place of the proven node and the run's others, left to right."""
    return bytes([place, len(nodes) - 1]) + b"".join(nodes[:place] + nodes[place + 1 :])


def steps(witness: bytes) -> Iterator[tuple[int, list[bytes]]]:
    at = 0
    while at < len(witness):
        place, n = witness[at], witness[at + 1]
        at += 2
        yield place, [witness[i : i + 32] for i in range(at, at + 32 * n, 32)]
        at += 32 * n


def fold(leaf: bytes, witness: bytes) -> bytes:
    """The root that a leaf and its witness lead to."""
    for place, others in steps(witness):
        leaf = digest([*others[:place], leaf, *others[place:]])
    return leaf


def proof_digest(witness: bytes) -> bytes:
    return digest([x for _, others in steps(witness) for x in others])


# Leaves


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(fields: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[_field(x) for x in fields]), 256))


def tampered(doc_id: Column) -> Column:
    """Whether the unsigned CRC-32 of the decimal id is divisible by three; never without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, tree, leaf, forged): forged is the leaf after tampering, null where that changes nothing."""
    c = {n: F.col(n) for n in FIELDS}
    c |= {n: F.col(n).cast("long") for n in ("doc_id", "n_chars")}
    lower = {**c, "text": F.translate(c["text"].cast("string"), _UPPER, _LOWER)}
    name = c["lang"].cast("string")
    changed = tampered(c["doc_id"]) & (lower["text"] != c["text"].cast("string"))
    return docs.select(
        c["doc_id"].alias("doc_id"),
        F.when(name.isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), name)).alias("tree"),
        leaf_digest(list(c.values())).alias("leaf"),
        F.when(changed, leaf_digest(list(lower.values()))).alias("forged"),
    )


# Places


def placed(rows: DataFrame, s: Scratch, tree: str, order: list[Column | str]) -> DataFrame:
    """``rows`` with ``pos`` and ``size``, the place in its tree from 0 and the tree's number of rows.

    Rows are dealt by ranges, sorted and numbered within their partition; the partitions before it add
    their counts. ``rows`` must be a written table. Ties beyond ``order`` go by a number written with it.
    """
    schema = _with(rows, ("part", pa.int64()), ("nth", pa.int64()))
    column = rows.columns.index(tree)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, name, n = TaskContext.get().partitionId(), None, 0
        for b in batches:
            nth = []
            for x in b.column(column).to_pylist():
                n = n + 1 if x == name else 0
                name = x
                nth.append(n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * b.num_rows, pa.int64()), pa.array(nth, pa.int64())], names=[*b.schema.names, "part", "nth"])

    cut = rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)
    cut = s.keep(cut.mapInArrow(number, schema), "sorted")
    counts = cut.groupBy(tree, "part").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy(tree)  # as many rows as there are partitions
    counts = counts.withColumn("before", F.sum("n").over(by.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    counts = counts.select(tree, "part", F.coalesce("before", F.lit(0)).alias("before"), F.sum("n").over(by).alias("size"))
    return cut.join(counts, [tree, "part"]).withColumn("pos", F.col("before") + F.col("nth")).drop("part", "nth", "before")


def _with(rows: DataFrame, *more: tuple[str, pa.DataType]) -> str:
    kinds = {pa.int64(): "bigint", pa.binary(): "binary"}
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [f"`{n}` {kinds[k]}" for n, k in more])


# Trees


def grow(nodes: DataFrame, s: Scratch, label: str, levels: int = BLOCK_LEVELS) -> DataFrame:
    """(tree, block, above, root) for the blocks of ``nodes(tree, pos, size, node)``: the witness above each block's root."""
    blocks = s.keep(nodes.withColumn("block", _block(levels)).groupBy("tree", "block").applyInArrow(_root_of(levels), "tree string, block bigint, blocks bigint, node binary"), f"{label}-roots")
    if not blocks.filter("blocks > 1").limit(1).count():
        return blocks.select("tree", "block", F.lit(b"").alias("above"), F.col("node").alias("root"))
    upper = blocks.select("tree", F.col("block").alias("pos"), F.col("blocks").alias("size"), "node")
    above = grow(upper, s, f"{label}-up", levels)
    return s.keep(proven(upper, above, levels).select("tree", F.col("pos").alias("block"), F.col("witness").alias("above"), "root"), f"{label}-above")


def _block(levels: int) -> Column:
    return F.floor(F.col("pos") / FAN**levels)


def _append_block(t: pa.Table, levels: int) -> tuple[Witnesses, bytes, list[int]]:
    order = t.column("pos").to_numpy().argsort()
    w, node = Witnesses(), t.column("node")
    for i in order:
        w.append(node[int(i)].as_py())
    alone = t.column("size")[0].as_py() <= FAN**levels  # the tree ends in this block; else all blocks have one height
    return w, w.finish(None if alone else levels), order.tolist()


def _root_of(levels: int):
    def run(t: pa.Table) -> pa.Table:
        root = _append_block(t, levels)[1]
        first = {n: t.column(n)[0].as_py() for n in ("tree", "block", "size")}
        blocks = -(-first["size"] // FAN**levels)
        return pa.table({"tree": pa.array([first["tree"]], pa.string()), "block": pa.array([first["block"]], pa.int64()), "blocks": pa.array([blocks], pa.int64()), "node": pa.array([root], pa.binary())})

    return run


def proven(nodes: DataFrame, above: DataFrame, levels: int = BLOCK_LEVELS, then: Callable[[pa.Table], pa.Table] | None = None, schema: str | None = None) -> DataFrame:
    """``nodes(tree, pos, size, node)`` with each one's whole ``witness`` and its tree's ``root``; ``above`` comes from ``grow``.

    ``then`` makes rows of ``schema`` of them in the same task, so that witnesses need not leave it.
    """
    names = nodes.columns

    def both(t: pa.Table, up: pa.Table) -> pa.Table:
        w, _, order = _append_block(t, levels)
        t = t.take(pa.array(order)).select(names)
        rest, root = up.column("above")[0].as_py(), up.column("root")[0].as_py()
        t = t.append_column("witness", pa.array([x + rest for x in w.proofs()], pa.binary()))
        t = t.append_column("root", pa.array([root] * t.num_rows, pa.binary()))
        return then(t) if then else t

    schema = schema or _with(nodes, ("witness", pa.binary()), ("root", pa.binary()))
    nodes = nodes.withColumn("block", _block(levels))
    return nodes.groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInArrow(both, schema)


class Manifest:
    """The trees of a table: ``leaves`` with their places, ``blocks`` with the witness of each block and both roots."""

    def __init__(self, docs: DataFrame, s: Scratch, levels: int = BLOCK_LEVELS):
        self.levels = levels
        own = s.keep(leaves(docs).withColumn("n", F.monotonically_increasing_id()), "leaves")
        order = [F.col("doc_id").asc_nulls_first(), "leaf", "n"]
        self.leaves = s.keep(placed(own, s, "tree", order).drop("n").withColumnRenamed("leaf", "node"), "placed")
        blocks = s.keep(grow(self.leaves.select("tree", "pos", "size", "node"), s, "langs", levels), "blocks")
        # The subroots are the leaves of one more tree, named nothing.
        subroots = s.keep(blocks.filter("block = 0").select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("root").alias("node")), "subroots")
        subroots = s.keep(placed(subroots, s, "tree", ["of"]), "languages")
        tops = proven(subroots, grow(subroots.select("tree", "pos", "size", "node"), s, "table", levels), levels)
        self.languages = s.keep(tops.select(F.col("of").alias("tree"), F.col("node").alias("subroot"), F.col("witness").alias("top"), "root"), "tops")
        joined = blocks.drop("root").join(self.languages, "tree")
        self.blocks = joined.select("tree", "block", F.concat("above", "top").alias("above"), "subroot", "root")

    def proofs(self) -> DataFrame:
        """doc_id, tree, leaf, forged, subroot, root and the packed witness, from the leaf to the root of the table."""
        nodes = proven(self.leaves, self._above(), self.levels)
        two = F.col("root")
        return nodes.select("doc_id", "tree", F.col("node").alias("leaf"), "forged", F.substring(two, 1, 32).alias("subroot"), F.substring(two, 33, 32).alias("root"), "witness")

    def checked(self) -> DataFrame:
        """Each proof folded with the leaf as it came: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
        return proven(self.leaves, self._above(), self.levels, _check, "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")

    def _above(self) -> DataFrame:
        return self.blocks.select("tree", "block", "above", F.concat("subroot", "root").alias("root"))


def _check(t: pa.Table) -> pa.Table:
    c = {n: t.column(n).to_pylist() for n in ("node", "forged", "root", "witness")}
    folded = [fold(f or x, w) for x, f, w in zip(c["node"], c["forged"], c["witness"])]
    text = lambda v: pa.array([x.hex() for x in v], pa.string())
    columns = {"doc_id": t.column("doc_id"), "leaf": text(c["node"]), "subroot": text(x[:32] for x in c["root"]), "root": text(x[32:] for x in c["root"])}
    columns |= {"proof_sha256": text(map(proof_digest, c["witness"])), "folded_root": text(folded), "verified": pa.array([x == r[32:] for x, r in zip(folded, c["root"])], pa.bool_())}
    return pa.table(columns)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scratch(spark, "merkle")
    return s.finish(Manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"), s).checked())


def _oracle(levels: int = 8, tops: int = 3) -> str:
    """SQL for trees of 8 ** ``levels`` rows a language and 8 ** ``tops`` languages at most."""
    f = lambda e: f"CASE WHEN {e} IS NULL THEN '-' ELSE strlen(CAST({e} AS VARCHAR)) || ':' || {e} END"
    low = f"translate(text, '{_UPPER}', '{_LOWER}')"
    leaf = lambda t: f"sha256(concat({', '.join(f(x) for x in ('doc_id', 'source', 'lang', 'n_chars', t))}))"
    crc = """xor(list_reduce(list_concat([4294967295], list_transform(range(1, len(CAST(doc_id AS VARCHAR)) + 1), lambda i: ord(substr(CAST(doc_id AS VARCHAR), i, 1)))),
      lambda c, x: list_reduce(list_concat([xor(c, x)], range(8)), lambda y, k: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END)), 4294967295)"""
    out = [f"""WITH a AS (SELECT doc_id, coalesce('+' || lang, '') AS tree, {leaf('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {leaf(low)} ELSE {leaf('text')} END AS forged FROM documents),
n0 AS MATERIALIZED (SELECT tree, leaf AS node, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, doc_id, forged FROM a)"""]

    def climb(name: str, count: int) -> None:
        for i in range(count):
            here = f"{name}{i}"
            out.append(f"""{here}c AS (SELECT tree, count(*) AS n FROM {here} GROUP BY 1)""")
            out.append(f"""{name}{i + 1} AS MATERIALIZED (SELECT tree, CASE WHEN any_value(n) = 1 THEN any_value(node) ELSE sha256(string_agg(node, '' ORDER BY pos)) END AS node, pos // 8 AS pos FROM {here} JOIN {here}c USING (tree) GROUP BY tree, pos // 8)""")

    def proofs(rows: str, name: str, count: int) -> str:
        """Left and right siblings of each row at each level; empty above the end of a tree."""
        for i in range(count):
            side = lambda op: f"coalesce((SELECT string_agg(s.node, '' ORDER BY s.pos) FROM {name}{i} s WHERE s.tree = r.{name}_tree AND s.pos // 8 = r.{name}_pos // {8 ** (i + 1)} AND s.pos {op} r.{name}_pos // {8 ** i}), '')"  # noqa: E731, B023
            new = f"{name}p{i}"
            out.append(f"""{new} AS MATERIALIZED (SELECT r.* EXCLUDE (proof, folded), proof || lft || rgt AS proof, CASE WHEN n = 1 THEN folded ELSE sha256(lft || folded || rgt) END AS folded
FROM (SELECT r.*, c.n, {side('<')} AS lft, {side('>')} AS rgt FROM {rows} r JOIN {name}{i}c c ON c.tree = r.{name}_tree) r)""".replace("r.* EXCLUDE (proof, folded)", "r.* EXCLUDE (proof, folded, n, lft, rgt)"))
            rows = new
        return rows

    climb("n", levels)
    out.append(f"m0 AS MATERIALIZED (SELECT 'all' AS tree, tree AS of, node, row_number() OVER (ORDER BY tree) - 1 AS pos FROM n{levels})")
    climb("m", tops)
    out.append("start AS (SELECT n0.doc_id, n0.node AS leaf, m0.node AS subroot, n0.tree AS n_tree, n0.pos AS n_pos, 'all' AS m_tree, m0.pos AS m_pos, '' AS proof, forged AS folded FROM n0 JOIN m0 ON m0.of = n0.tree)")
    last = proofs(proofs("start", "n", levels), "m", tops)
    return ", ".join(out) + f" SELECT doc_id, leaf, subroot, r.node AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = r.node AS verified FROM {last} CROSS JOIN m{tops} r"


ORACLE = {"op13_merkle_manifest": _oracle()}
