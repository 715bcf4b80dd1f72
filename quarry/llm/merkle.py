"""Merkle manifest of a dataset, with octopus multiproofs.

Every row is a leaf: the SHA-256 of its fields. The leaves of a group (here a
language), in the order of their ids, form a tree of hashes; the groups' roots
form one more tree, whose root stands for the whole dataset.

A tree is built in passes: a pass takes runs of ``2 ** BITS`` neighbouring
nodes, one group of bounded size each, and climbs up to ``BITS`` levels in it,
so a language with a third of all rows is spread over as many tasks as it has
runs. All nodes are stored with their coordinates (tree, level, place).

A proof of one leaf is the list of its siblings on the way to the root. Proofs
are made by the octopus method: a leaf partition (the wanted leaves of one
run) walks up all its paths at once and lists the smallest set of coordinates
that its own leaves do not give; these are fetched in one join, the interior
nodes that the paths share are derived from them, and each leaf's own proof is
spelt out from these on the spot.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.ranks import ranked
from quarry.llm.store import keep

#: A run holds 2 ** BITS nodes; a pass climbs BITS levels.
BITS = 12
#: The tree of the groups' roots.
TOP = -1

NODE = "tree long, n long, level int, idx long, digest string"


def encoded(column: Column) -> Column:
    """A field as it enters the leaf: ``-`` if null, else byte count, ``:``, value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(columns: list[Column]) -> Column:
    """Lower-case hexadecimal SHA-256 of the fields, one after the other."""
    return F.sha2(F.concat(*[encoded(c) for c in columns]).cast("binary"), 256)


def _hash(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def depth(n: int) -> int:
    """Levels above ``n`` leaves."""
    return (n - 1).bit_length() if n > 1 else 0


def width(n: int, level: int) -> int:
    """Nodes at ``level`` of a tree of ``n`` leaves."""
    return -(-n >> level)


_DEPTH = "if(n > 1, length(bin(n - 1)), 0)"


@dataclass
class Manifest:
    """``leaves``: tree, n (leaves of the tree), idx and the rows' columns,
    the leaf's digest among them. ``nodes``: all other nodes. ``trees``: tree,
    group, n, subroot. ``n_trees``; ``root``, None for a table without rows."""
    leaves: DataFrame
    nodes: list[DataFrame]
    trees: DataFrame
    n_trees: int
    root: str | None


def _climb(nodes: DataFrame, level: int) -> DataFrame:
    """All nodes of the next ``BITS`` levels over ``nodes`` (tree, n, idx, digest) of ``level``."""

    def run(_key, table):
        import numpy as np
        import pyarrow as pa

        order = np.argsort(table.column("idx").to_numpy())
        tree, n = table.column("tree")[0].as_py(), table.column("n")[0].as_py()
        first = table.column("idx").to_numpy()[order[0]]
        now = table.column("digest").take(pa.array(order)).to_pylist()
        levels, places, out = [], [], []
        for k in range(level + 1, level + BITS + 1):
            if width(n, k - 1) == 1:
                break
            now = [_hash("".join(now[i:i + 2])) for i in range(0, len(now), 2)]
            first >>= 1
            levels += [k] * len(now)
            places += range(first, first + len(now))
            out += now
        m = len(out)
        return pa.table({"tree": pa.array([tree] * m, pa.int64()), "n": pa.array([n] * m, pa.int64()),
                         "level": pa.array(levels, pa.int32()), "idx": pa.array(places, pa.int64()),
                         "digest": pa.array(out, pa.string())})

    return (nodes.select("tree", "n", "idx", "digest")
            .groupBy("tree", F.shiftright("idx", BITS).alias("run")).applyInArrow(run, NODE))


def _grow(leaves: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """Stored nodes over ``leaves`` (tree, n, idx, digest), whose largest tree
    has ``most``; and (tree, subroot) of every tree."""
    nodes, now = [], leaves
    tops = leaves.filter("n = 1").select("tree", F.col("digest").alias("subroot"))
    for level in range(0, depth(most), BITS):
        made = keep(_climb(now, level), "nodes")
        nodes.append(made)
        tops = tops.unionByName(made.filter(f"level = {_DEPTH}").select("tree", F.col("digest").alias("subroot")))
        now = made.filter(f"level = {level + BITS} and level < {_DEPTH}")
    return nodes, tops


def build(rows: DataFrame, group: str = "grp", id_col: str = "id", leaf: str = "leaf") -> Manifest:
    """The manifest of ``rows``, whose column ``leaf`` has the leaves' digests;
    further columns stay with them. Groups come in the order of their bytes,
    null (a group of its own) first; leaves by id, nulls first, ties by
    digest. Rows alike in all columns take neighbouring places, which no one can tell
    apart. Columns named tree, n, idx or rank are not allowed."""
    stored = keep(rows, "leaves")
    placed = ranked(stored, [group, id_col, leaf])
    groups = keep(placed.groupBy(group).agg(F.min("rank").alias("first"), F.count("*").alias("n")), "groups")
    trees = keep(ranked(groups, [group], "tree"), "trees")
    size = trees.agg(F.max("n").alias("most"), F.count("*").alias("trees")).first()
    if not size["trees"]:
        return Manifest(placed.selectExpr("0L as tree", "0L as n", "0L as idx", "*").drop("rank"), [],
                        trees.selectExpr("tree", f"`{group}`", "n", "'' as subroot"), 0, None)
    t = trees.select("tree", "n", "first", F.col(group).alias("__group"))
    leaves = keep(placed.join(t, F.col(group).eqNullSafe(F.col("__group")))
                  .select("tree", "n", (F.col("rank") - F.col("first")).alias("idx"),
                          *[f"`{c}`" for c in rows.columns]), "placed")
    nodes, tops = _grow(leaves.select("tree", "n", "idx", F.col(leaf).alias("digest")), size["most"])
    trees = keep(trees.select("tree", group, "n").join(tops, "tree"), "trees")
    top = trees.select(F.lit(TOP).cast("long").alias("tree"), F.lit(size["trees"]).cast("long").alias("n"),
                       F.col("tree").alias("idx"), F.col("subroot").alias("digest"))
    above, root = _grow(top, size["trees"])
    low = keep(top.withColumn("level", F.lit(0)).select("tree", "n", "level", "idx", "digest"), "nodes")
    return Manifest(leaves, [*nodes, low, *above], trees, size["trees"], root.first()["subroot"])


def missing(places: list[int], n: int) -> list[tuple[int, int]]:
    """(level, place) of the nodes of a tree of ``n`` leaves that proofs of the
    leaves at ``places`` need and these leaves do not give: the smallest such set."""
    now, out = set(places), []
    for level in range(depth(n)):
        last = width(n, level) - 1
        out += [(level, i ^ 1) for i in sorted(now) if i ^ 1 not in now and i ^ 1 <= last]
        now = {i >> 1 for i in now}
    return out


def ways(known: dict[int, str], fetched: dict[tuple[int, int], str], n: int, above: tuple = ()) -> dict[int, tuple]:
    """The proof of each known leaf (place -> digest): (digest, is left) of its
    sibling at each level up, an empty digest where it has none, then ``above``.
    Interior nodes are derived once for all leaves below them."""
    levels, given = [dict(known)], [{} for _ in range(depth(n))]
    for (level, i), d in fetched.items():
        given[level][i] = d
    for level in range(depth(n)):
        now = levels[-1]
        now |= given[level]
        last = width(n, level) - 1
        levels.append({i >> 1: _hash(now[i] + (now[i + 1] if i < last else ""))
                       for i in now if not i & 1 and (i == last or i + 1 in now)})
    way = dict.fromkeys(levels.pop(), above)
    for now in reversed(levels):
        way = {i: ((now.get(i ^ 1, ""), bool(i & 1)), *way[i >> 1]) for i in now if i >> 1 in way}
    return {i: way[i] for i in known}


def prove(manifest: Manifest, wanted: DataFrame | None = None, leaf: str = "leaf") -> DataFrame:
    """The wanted leaves (a part of ``manifest.leaves``, all if None) with
    their proofs up to the root of the dataset: siblings array<string>, level by
    level, an empty string where a node has none; lefts array<boolean>: whether the
    sibling stands on the left."""
    leaves = manifest.leaves if wanted is None else wanted
    n_trees = manifest.n_trees
    runs = leaves.withColumn("__run", F.shiftright("idx", BITS))

    def list_missing(key, table):
        import pyarrow as pa

        tree, n = key[0].as_py(), table.column("n")[0].as_py()
        own = [(tree, k, i) for k, i in missing(table.column("idx").to_pylist(), n)]
        own += [(TOP, k, i) for k, i in missing([tree], n_trees)]
        m = len(own)
        return pa.table({"tree": pa.array([tree] * m, pa.int64()), "__run": pa.array([key[1].as_py()] * m, pa.int64()),
                         "at": pa.array([x[0] for x in own], pa.int64()), "level": pa.array([x[1] for x in own], pa.int32()),
                         "idx": pa.array([x[2] for x in own], pa.int64())})

    asked = keep(runs.select("tree", "__run", "n", "idx").groupBy("tree", "__run")
                 .applyInArrow(list_missing, "tree long, __run long, at long, level int, idx long"), "asked")
    # leaves and low nodes are read only if a run lacks some of them
    whole = wanted is None
    nodes = [d.select(F.col("tree").alias("at"), "level", "idx", "digest") for d in manifest.nodes]
    nodes = [d.filter(f"at = {TOP} or level >= {BITS}") for d in nodes] if whole else [
        manifest.leaves.select(F.col("tree").alias("at"), F.lit(0).alias("level"), "idx", F.col(leaf).alias("digest")), *nodes]
    store = nodes[0]
    for d in nodes[1:]:
        store = store.unionByName(d)
    fetched = asked.join(store, ["at", "level", "idx"]).select("tree", "__run", "at", "level", "idx", "digest")

    def spell_out(key, table, got):
        import pyarrow as pa

        tree, n = key[0].as_py(), table.column("n")[0].as_py()
        own, top = {}, {}
        for at, k, i, d in zip(*(got.column(c).to_pylist() for c in ("at", "level", "idx", "digest")), strict=True):
            (top if at == TOP else own)[k, i] = d
        places = table.column("idx").to_pylist()
        known = dict(zip(places, table.column(leaf).to_pylist(), strict=True))
        # the way from this tree's root up needs no digest of the root itself
        above = ways({tree: ""}, top, n_trees)[tree]
        found = ways(known, own, n, above)
        ends, digests, lefts = [0], [], []
        for i in places:
            digests += [d for d, _ in found[i]]
            lefts += [x for _, x in found[i]]
            ends.append(len(digests))
        ends = pa.array(ends, pa.int32())
        return (table.drop_columns(["__run"])
                .append_column("siblings", pa.ListArray.from_arrays(ends, pa.array(digests, pa.string())))
                .append_column("lefts", pa.ListArray.from_arrays(ends, pa.array(lefts, pa.bool_()))))

    schema = leaves.select("*", F.lit(None).cast("array<string>").alias("siblings"),
                           F.lit(None).cast("array<boolean>").alias("lefts")).schema
    return (runs.groupBy("tree", "__run").cogroup(fetched.groupBy("tree", "__run")).applyInArrow(spell_out, schema))


def folded(leaf: str) -> Column:
    """The root that the leaf in column ``leaf`` and its proof lead to."""
    return F.expr(f"aggregate(arrays_zip(siblings, lefts), `{leaf}`, (a, x) -> "
                  "sha2(cast(if(x.lefts, concat(x.siblings, a), concat(a, x.siblings)) as binary), 256))")


def audit(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
          id_col: str = "doc_id", group: str = "lang", count: str = "n_chars", every: int = 7) -> DataFrame:
    """Proofs of all rows, tried on leaves of which some are tampered with:
    where ``every`` divides the CRC-32 of the id, ``count`` is one more (a null
    stays). doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.
    A null id is never tampered with; repeated rows each get a row; an empty table gives none."""
    hit = (F.crc32(F.col(id_col).cast("string").cast("binary")) % every == 0) & F.col(count).isNotNull()
    more = (F.col(count).cast("decimal(20,0)") + 1).cast("string")
    rows = docs.select(F.col(group).alias("grp"), F.col(id_col).alias("id"), digest([F.col(c) for c in columns]).alias("leaf"),
                       F.when(hit, digest([more if c == count else F.col(c) for c in columns])).alias("altered"))
    manifest = build(rows)
    if manifest.root is None:
        return rows.selectExpr("id as doc_id", "leaf", "leaf as subroot", "leaf as root", "leaf as proof_sha256",
                               "leaf as folded_root", "true as verified")
    proved = prove(manifest).withColumn("shown", F.coalesce("altered", "leaf"))
    return (proved.join(manifest.trees.select("tree", "subroot"), "tree")
            .select(F.col("id").alias("doc_id"), "leaf", "subroot", F.lit(manifest.root).alias("root"),
                    F.sha2(F.array_join("siblings", "").cast("binary"), 256).alias("proof_sha256"),
                    folded("shown").alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))
