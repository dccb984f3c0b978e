"""Merkle manifest of a table: a persistent tree in which a changed leaf copies its ancestors only."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofgrid.llm.common import LOWER, UPPER, stored
from proofgrid.operators.ranking import with_position

RUN = 8  # consecutive nodes that one node of the next level stands for
HEIGHT = 3  # levels that one task group builds
BLOCK = RUN**HEIGHT  # nodes of such a group at most
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "struct<place: int, others: array<binary>>"


class Node(NamedTuple):
    """Never changed once made, so that versions can share it."""

    digest: bytes
    children: tuple[Node, ...] = ()


def joined(digests: Sequence[bytes]) -> bytes:
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def parent(children: Sequence[Node]) -> Node:
    return Node(joined([c.digest for c in children]), tuple(children))


def tree(leaves: list[bytes], whole: bool) -> tuple[Node, int]:
    """Root and height over the nodes of an aligned block; ``whole``: over all nodes of the level there are."""
    nodes, height = [Node(d) for d in leaves], 0
    while len(nodes) > 1 if whole else height < HEIGHT:
        nodes = [parent(nodes[i : i + RUN]) for i in range(0, len(nodes), RUN)]
        height += 1
    return nodes[0], height


def replaced(node: Node, height: int, at: int, leaf: bytes) -> Node:
    """The version of the tree with another leaf: copies of its ancestors, all other nodes shared."""
    if height == 0:
        return Node(leaf)
    place, rest = divmod(at, RUN ** (height - 1))
    child = replaced(node.children[place], height - 1, rest, leaf)
    return parent((*node.children[:place], child, *node.children[place + 1 :]))


def path(node: Node, height: int, at: int) -> list[dict]:
    """Place and siblings at each level, from the leaf up."""
    steps = []
    for level in range(height - 1, -1, -1):
        place, at = divmod(at, RUN**level)
        steps.append({"place": place, "others": [c.digest for i, c in enumerate(node.children) if i != place]})
        node = node.children[place]
    return steps[::-1]


def climbed(digest: bytes, steps: list[dict]) -> bytes:
    """The root that the copied ancestors above a block lead to."""
    for step in steps:
        digest = joined([*step["others"][: step["place"]], digest, *step["others"][step["place"] :]])
    return digest


def _block(rows: pa.Table, digest: str) -> tuple[pa.Table, Node, int]:
    """The rows of a block in order, and its tree."""
    rows = rows.sort_by("at")
    return rows, *tree(rows[digest].to_pylist(), rows["n"][0].as_py() <= BLOCK)


def _in_blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"at div {BLOCK}"))


def _paths(nodes: DataFrame, most: int) -> DataFrame:
    """``g, at, path, root`` for ``g, at, n, digest``: groups, places in them, sizes of groups (at most ``most``).

    Blocks of 512 nodes each build their part of the tree; their roots are the nodes of the next round.
    """
    if most <= 1:
        return nodes.select("g", "at", F.lit(None).cast(f"array<{STEP}>").alias("path"), F.col("digest").alias("root"))

    def local(rows: pa.Table) -> pa.Table:
        rows, root, height = _block(rows, "digest")
        kind = pa.list_(pa.struct([("place", pa.int32()), ("others", pa.list_(pa.binary()))]))
        steps = pa.array([path(root, height, i) for i in range(len(rows))], kind)
        return pa.table({"g": rows["g"], "at": rows["at"], "n": rows["n"], "path": steps, "top": pa.array([root.digest] * len(rows), pa.binary())})

    schema = f"g long, at long, n long, path array<{STEP}>, top binary"
    low = stored(_in_blocks(nodes).groupBy("g", "block").applyInArrow(local, schema), "merkle-paths")
    upper = low.filter(F.col("at") % BLOCK == 0).select("g", F.expr(f"at div {BLOCK}").alias("at"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("top").alias("digest"))
    high = _paths(upper, -(-most // BLOCK)).select(F.col("g").alias("_g"), F.col("at").alias("_at"), F.col("path").alias("_path"), "root")
    met = low.join(high, (F.col("g") == F.col("_g")) & (F.expr(f"at div {BLOCK}") == F.col("_at")))
    return met.select("g", "at", _together(F.col("path"), F.col("_path")).alias("path"), "root")


def _together(low: Column, high: Column) -> Column:
    none = F.array().cast(f"array<{STEP}>")
    return F.concat(F.coalesce(low, none), F.coalesce(high, none))


def with_versions(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with their place in the tree; they have binary digests ``leaf`` and ``changed`` (null: as it was).

    Leaves of a group ascend by ``order`` (nulls first; then by digest), 8 consecutive nodes become one until
    one remains, the group's subroot; subroots by group (null first) become the root in the same way. Added:
    ``proof`` (the siblings' digests as hex text from the leaf up, left to right), ``subroot``, ``root`` and
    ``version_root``, the root of the version in which this leaf alone is the changed one.

    Places come from a range partitioning with offsets, so a group of any size is spread. Aligned blocks of
    512 leaves each build a tree whose nodes never change; a changed leaf copies its ancestors inside its
    block and shares all other nodes. Block roots are built in the same way in rounds that shrink
    512-fold; each block then gets the path from its root to the top, along which its versions go on.

    Null digests are not allowed. Equal leaves stand side by side. An empty table gives no rows; columns
    named like the new ones, or ``position``, ``g``, ``at``, ``n`` and ``block``, must not be there.
    """
    placed = with_position(rows, F.col(group).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order], "leaf")
    groups = placed.groupBy(group).agg(F.min("position").alias("_first"), F.count("*").alias("n"))
    groups = stored(with_position(groups, F.col(group).asc_nulls_first(), out="g"), "merkle-groups")
    sizes = groups.agg(F.count("*").alias("groups"), F.max("n").alias("most")).first()
    met = placed.join(groups.withColumnRenamed(group, "_group"), F.col(group).eqNullSafe(F.col("_group")))
    leaves = _in_blocks(met.withColumn("at", F.col("position") - F.col("_first")).select(*rows.columns, "g", "at", "n"))

    def top(rows: pa.Table) -> pa.Table:
        rows, root, _ = _block(rows, "leaf")
        return pa.table({"g": rows["g"][:1], "at": rows["block"][:1], "n": pa.array([-(-rows["n"][0].as_py() // BLOCK)], pa.int64()), "digest": pa.array([root.digest], pa.binary())})

    tops = stored(leaves.select("g", "block", "at", "n", "leaf").groupBy("g", "block").applyInArrow(top, "g long, at long, n long, digest binary"), "merkle-tops")
    inside = stored(_paths(tops, -(-(sizes["most"] or 0) // BLOCK)), "merkle-inside")
    subroots = inside.filter("at = 0").select(F.lit(0).cast("long").alias("g"), F.col("g").alias("at"), F.lit(sizes["groups"]).cast("long").alias("n"), F.col("root").alias("digest"))
    above = _paths(subroots, sizes["groups"]).select(F.col("at").alias("_g"), F.col("path").alias("_path"), F.col("root").alias("_root"))
    known = inside.join(above, F.col("g") == F.col("_g"))
    known = known.select("g", F.col("at").alias("block"), _together(F.col("path"), F.col("_path")).alias("path"), F.col("root").alias("subroot"), F.col("_root").alias("root"))

    def versions(rows: pa.Table, above: pa.Table) -> pa.Table:
        rows, root, height = _block(rows, "leaf")
        upper, subroot, whole = above["path"][0].as_py(), above["subroot"][0].as_py().hex(), above["root"][0].as_py().hex()
        high = [d.hex() for step in upper for d in step["others"]]
        proofs, made = [], []
        for i, (leaf, changed) in enumerate(zip(rows["leaf"].to_pylist(), rows["changed"].to_pylist())):
            proofs.append([d.hex() for step in path(root, height, i) for d in step["others"]] + high)
            version = replaced(root, height, i, leaf if changed is None else changed)
            made.append(climbed(version.digest, upper).hex())
        out = rows.select(own)
        for name, cells in (("proof", proofs), ("subroot", [subroot] * len(rows)), ("root", [whole] * len(rows)), ("version_root", made)):
            out = out.append_column(name, pa.array(cells, pa.list_(pa.string()) if name == "proof" else pa.string()))
        return out

    own = rows.columns
    fields = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in rows.schema)
    schema = f"{fields}, proof array<string>, subroot string, root string, version_root string"
    return leaves.groupBy("g", "block").cogroup(known.groupBy("g", "block")).applyInArrow(versions, schema)


def field(value: Column) -> Column:
    """``-`` for null, else the bytes in UTF-8, ``:`` and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def query(documents: DataFrame) -> DataFrame:
    """Every document's leaf, proof and version; where 3 divides the crc32 of the id, the changed text has no capitals A to Z.

    The leaves are written first: range bounds come from a sample, which would else read all texts again.
    """
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = F.translate("text", UPPER, LOWER)
    cells = [F.col(c) for c in FIELDS]
    rows = documents.select("doc_id", "lang", leaf(*cells).alias("leaf"), F.when(hit, leaf(*cells[:-1], lowered)).alias("changed"))
    found = with_versions(stored(rows, "merkle-leaves"), "lang", ["doc_id"])
    return found.select(
        "doc_id", F.lower(F.hex("leaf")).alias("leaf"), "subroot", "root", F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256"),
        F.col("version_root").alias("folded_root"), (F.col("version_root") == F.col("root")).alias("verified"),
    )


def _sql_field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"


_CRC = """xor(list_reduce(list_concat([4294967295::UBIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''),
    lambda c: [ord(c)::UBIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda c, x: CASE WHEN xor(c, x) & 1 = 1
    THEN xor(xor(c, x) >> 1, 3988292384::UBIGINT) ELSE xor(c, x) >> 1 END), 4294967295::UBIGINT)"""
_HEAD = " || ".join(_sql_field(c) for c in FIELDS[:-1])
_UP = f"sha256(array_to_string(list_concat(ds[1:pos % {RUN}], [cur], ds[pos % {RUN} + 2:]), ''))"
_OTHERS = f"array_to_string(list_concat(ds[1:pos % {RUN}], ds[pos % {RUN} + 2:]), '')"
SQL = f"""
WITH RECURSIVE
d AS (SELECT *, translate(text, '{UPPER}', '{LOWER}') AS lowered, {_CRC} % 3 = 0 AS hit FROM documents),
e AS (SELECT doc_id, lang, sha256({_HEAD} || {_sql_field("text")}) AS leaf, CASE WHEN hit THEN sha256({_HEAD} || {_sql_field("lowered")}) END AS changed FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER () AS k FROM e),
t AS (SELECT 0 AS level, lang, pos, leaf AS digest, n FROM o
  UNION ALL SELECT level + 1, lang, pos // {RUN}, sha256(string_agg(digest, '' ORDER BY pos)), (n + {RUN - 1}) // {RUN} FROM t WHERE n > 1 GROUP BY level, lang, pos // {RUN}, n),
s AS (SELECT lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS level, pos, digest, n FROM s
  UNION ALL SELECT level + 1, pos // {RUN}, sha256(string_agg(digest, '' ORDER BY pos)), (n + {RUN - 1}) // {RUN} FROM u WHERE n > 1 GROUP BY level, pos // {RUN}, n),
tr AS (SELECT level, lang, pos // {RUN} AS run, list(digest ORDER BY pos) AS ds FROM t WHERE n > 1 GROUP BY ALL),
ur AS (SELECT level, pos // {RUN} AS run, list(digest ORDER BY pos) AS ds FROM u WHERE n > 1 GROUP BY ALL),
p AS (SELECT k, lang, 0 AS level, pos, coalesce(changed, leaf) AS cur, '' AS sib FROM o
  UNION ALL SELECT k, p.lang, p.level + 1, pos // {RUN}, {_UP}, sib || {_OTHERS} FROM p JOIN tr ON p.level = tr.level AND p.lang IS NOT DISTINCT FROM tr.lang AND pos // {RUN} = run),
q AS (SELECT k, s.lang, s.digest AS subroot, s.pos, arg_max(p.cur, p.level) AS cur, arg_max(p.sib, p.level) AS sib FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang GROUP BY ALL),
r AS (SELECT k, 0 AS level, pos, cur, sib FROM q
  UNION ALL SELECT k, r.level + 1, pos // {RUN}, {_UP}, sib || {_OTHERS} FROM r JOIN ur ON r.level = ur.level AND pos // {RUN} = run),
z AS (SELECT k, arg_max(cur, level) AS folded_root, arg_max(sib, level) AS sib FROM r GROUP BY k)
SELECT doc_id, leaf, q.subroot, w.digest AS root, sha256(z.sib) AS proof_sha256, folded_root, folded_root = w.digest AS verified
FROM o JOIN q USING (k) JOIN z USING (k) CROSS JOIN (SELECT digest FROM u WHERE n = 1) w
"""
