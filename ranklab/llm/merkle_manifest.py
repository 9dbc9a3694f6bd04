"""A Merkle manifest of a dataset: digests, inclusion proofs, and their check.

Rows are leaves. The leaves of a source, in ascending id order, are hashed in
runs of ``FAN`` until one digest, the subroot, is left; the subroots in order of
their sources are hashed alike to the root.

*Build.* A range partitioning by (source, id, digest, row) gives every leaf its
rank in its source; what goes over the partitions is one row for each run of a
source in a partition. ``PAGE_LEVELS`` levels are built at a time: a page is the
subtree over FAN ** PAGE_LEVELS consecutive nodes, of bounded size whatever the
source. It is stored as records *digest -> digests of its children*, and
identified by its own root digest and its place.

*Descent.* A request for a leaf starts at the root and, level by level, looks up
the current digest's children; the digit of the leaf's rank chooses the child to
go on with, the other children are the siblings of that level. Requests that
share the way down go together: what is joined to the pages is one row for each
page on the way, never one for each request at the root. At the end the levels
are reversed, from the leaf up. A leaf's proof and the root folded from it are
computed where the leaf's page is.

Defined cases: a null field counts as ``-``, an empty one as ``0:``; a null
source is a source of its own and comes first; null ids come first in their
source; equal ids are ordered by leaf digest, and equal rows are leaves each
(their proofs may differ, in any order); a source of one row has its leaf as
subroot, and a table of one source its subroot as root; an empty table gives an
empty result; texts of any length are hashed whole; other columns are not read,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions_for, record_batch, ship, stored

FAN = 3
#: Levels of a page; it has FAN ** PAGE_LEVELS lowest nodes at most.
PAGE_LEVELS = 6
#: Rows of a range of leaves.
RANGE_ROWS = 50_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PAGES = pa.schema([("tree", pa.int64()), ("page", pa.int64()), ("levels", pa.int64()), ("digest", pa.string()), ("records", pa.string())])
_NODES = pa.schema([("tree", pa.int64()), ("rank", pa.int64()), ("digest", pa.string()), ("path", pa.string()), ("subroot", pa.string())])
_NODES_DDL = "tree long, rank long, digest string, path string, subroot string"
_PROOFS = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()),
                     ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_())])


class Manifest(NamedTuple):
    """``sources``: tree, n, levels, digest (the subroot). ``leaves``: pages of the lowest tier with their
    leaves' requests. ``upper``: pages of the tiers above, from the second on. ``top``: the pages over the
    subroots, by tier. ``root``: None for an empty table."""
    sources: DataFrame
    leaves: DataFrame
    upper: list[DataFrame]
    top: list[DataFrame]
    top_levels: int
    root: str | None


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """One row at a time: a page is large, a batch holds many."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def sha(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(fields: dict[str, Column]) -> Column:
    def part(c: Column) -> Column:
        text = c.cast("string")
        return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))
    return F.sha2(F.concat(*[part(c) for c in fields.values()]).cast("binary"), 256)


def levels_of(n: Column) -> Column:
    """The least k with FAN ** k >= n."""
    return sum(((n > F.lit(FAN ** k)).cast("long") for k in range(1, 39)), (n > 1).cast("long"))


def _ranked(leaves: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """(leaves with tree and rank, one row a tree). The tree is the source's place among all sources."""
    keys = ["src", F.col("doc_id").asc_nulls_first(), "leaf", "row"]
    dealt = leaves.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(partitions_for(rows, RANGE_ROWS), *keys)
    ranged = stored(dealt.sortWithinPartitions(*keys).select(
        F.spark_partition_id().alias("slice"), F.monotonically_increasing_id().alias("at"), "src", "doc_id", "leaf", "claim"))
    runs = stored(ranged.groupBy("slice", "src").agg(F.count("*").alias("here"), F.min("at").alias("first")))
    # a source's runs, one a slice at most
    within = Window.partitionBy("src").orderBy("slice")
    before = runs.withColumn("before", F.sum("here").over(within) - F.col("here"))
    # sources are in order over the slices: place = sources that begin in earlier slices + place among those that begin in this one
    sources = runs.groupBy("src").agg(F.sum("here").alias("n"), F.min("slice").alias("slice"))
    begin = sources.groupBy("slice").agg(F.count("*").alias("sources"))
    begin = begin.select("slice", (F.sum("sources").over(Window.orderBy("slice")) - F.col("sources")).alias("earlier"))
    trees = stored(sources.join(begin, "slice").select(
        "src", "n", (F.col("earlier") + F.row_number().over(Window.partitionBy("slice").orderBy("src")) - 1).alias("tree"))
        .withColumn("levels", levels_of(F.col("n"))))
    # (slice, src) has one slice's rows at most, so no source is one join key
    runs = before.join(trees, "src").select("slice", "src", "tree", "levels", "before", "first")
    ranked = ranged.join(runs, ["slice", "src"]).select(
        "tree", "levels", (F.col("before") + F.col("at") - F.col("first")).alias("rank"), "doc_id", "leaf", "claim")
    return ranked, trees


def _subtree(digests: list[str], levels: int) -> tuple[str, str]:
    """(root digest, records) of ``levels`` levels above ``digests``."""
    records = {}
    for _ in range(levels):
        runs = [digests[i:i + FAN] for i in range(0, len(digests), FAN)]
        digests = [sha(r) for r in runs]
        records.update(zip(digests, runs))
    return digests[0], "\n".join(f"{d} {' '.join(kids)}" for d, kids in records.items())


def _build(levels_each: int, requests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in _rows(batch):
                digests = [x["digest"] for x in r["nodes"]]
                out.append((r["tree"], r["page"], r["levels"], *_subtree(digests, min(r["levels"], levels_each))))
            if out:
                made = record_batch(_PAGES, *zip(*out))
                yield pa.RecordBatch.from_arrays([*made.columns, batch.column("nodes")], names=[*_PAGES.names, "nodes"]) if requests else made
    return run


def _pages(nodes: DataFrame, columns: list[str], requests: bool = False) -> DataFrame:
    """Stored pages over ``nodes`` (tree, levels, rank and ``columns``, of which ``digest`` is one)."""
    size = FAN ** PAGE_LEVELS
    bundles = nodes.groupBy("tree", F.expr(f"rank div {size}").alias("page"), "levels").agg(
        F.sort_array(F.collect_list(F.struct("rank", *columns))).alias("nodes"))
    schema = "tree long, page long, levels long, digest string, records string"
    if requests:
        schema += ", nodes " + dict(bundles.dtypes)["nodes"]
    return stored(bundles.mapInArrow(_build(PAGE_LEVELS, requests), schema))


def _tiers_above(pages: DataFrame, levels: int) -> list[DataFrame]:
    """Pages over pages until each tree has one; ``levels`` is the most that a tree has."""
    out, below = [], pages
    while levels > PAGE_LEVELS:
        nodes = below.where(F.col("levels") > PAGE_LEVELS).select(
            "tree", (F.col("levels") - PAGE_LEVELS).alias("levels"), F.col("page").alias("rank"), "digest")
        below = _pages(nodes, ["digest"])
        out.append(below)
        levels -= PAGE_LEVELS
    return out


def build(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", source_col: str = "source",
          claims: dict[str, Column] | None = None) -> Manifest:
    """The manifest of ``docs``. ``claims`` replaces fields in the row that is later checked against the
    leaf's proof (all fields as they are by default)."""
    ship(docs.sparkSession)
    own = {c: F.col(c) for c in fields}
    source = F.col(source_col).cast("string")
    leaves = stored(docs.select(F.when(source.isNull(), "0").otherwise(F.concat(F.lit("1"), source)).alias("src"),
                         F.col(id_col).cast("long").alias("doc_id"), leaf_digest(own).alias("leaf"),
                         leaf_digest(own | (claims or {})).alias("claim")))
    ranked, trees = _ranked(leaves, leaves.count())
    lowest = _pages(ranked.withColumnRenamed("leaf", "digest"), ["digest", "doc_id", "claim"], requests=True)
    most = trees.agg(F.max("levels"), F.count("*")).first()
    upper = _tiers_above(lowest, most[0] or 0)
    roots = [t.where(F.col("levels") <= PAGE_LEVELS).select("tree", "digest") for t in [lowest.drop("nodes"), *upper]]
    subroots = roots[0]
    for r in roots[1:]:
        subroots = subroots.unionByName(r)
    sources = stored(trees.join(subroots, "tree").select("tree", "n", "levels", "digest"))
    top_levels = next(k for k in range(64) if FAN ** k >= most[1])
    over = sources.select(F.lit(0).cast("long").alias("tree"), F.lit(top_levels).cast("long").alias("levels"),
                          F.col("tree").alias("rank"), "digest")
    first = _pages(over, ["digest"])
    top = [first, *_tiers_above(first, top_levels)]
    root = top[-1].select("digest").first()
    return Manifest(sources, lowest, upper, top, top_levels, root.digest if root else None)


# descent

def _records(text: str) -> dict[str, list[str]]:
    return {line[0]: line[1:] for line in (x.split(" ") for x in text.split("\n") if x)}


def _down(records: dict[str, list[str]], digest: str, rank: int, levels: int) -> tuple[str, list[str]]:
    """From ``digest`` down by the digits of ``rank``: (the leaf reached, 'digit sibling ...' of each level from the top)."""
    path = []
    for level in reversed(range(levels)):
        kids, digit = records[digest], rank // FAN ** level % FAN
        path.append(" ".join([str(digit), *kids[:digit], *kids[digit + 1:]]))
        digest = kids[digit]
    return digest, path


def _expand(page_levels: int):
    """All lowest nodes of each page, with the way to them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _rows(batch):
                records, levels, out = _records(r["records"]), min(r["levels"], page_levels), []
                nodes = [r["digest"]]
                for _ in range(levels):
                    nodes = [k for d in nodes for k in records[d]]
                for rank in range(len(nodes)):  # the last runs may be short: only ranks that exist
                    digest, path = _down(records, r["digest"], rank, levels)
                    out.append((r["tree"], r["page"] * FAN ** levels + rank, digest, "\n".join([x for x in (r["path"], *path) if x]), r["subroot"]))
                yield record_batch(_NODES, *zip(*out))
    return run


def _meet(frontier: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages whose place and root digest the frontier has reached. Both sides have one row a page."""
    return pages.join(frontier.withColumnRenamed("rank", "page"), ["tree", "page", "digest"])


def _descend(start: DataFrame, tiers: list[DataFrame]) -> DataFrame:
    """From ``start`` (tree, levels, digest, path, subroot) to the lowest tier's pages: tree, rank (of the page), digest, path, subroot."""
    def entering(tier: int) -> DataFrame:
        least = F.greatest(F.expr(f"(levels + {PAGE_LEVELS - 1}) div {PAGE_LEVELS}"), F.lit(1)) - 1
        return start.where(least == tier).select("tree", F.lit(0).cast("long").alias("rank"), "digest", "path", "subroot")

    frontier = entering(len(tiers) - 1)
    for tier in reversed(range(1, len(tiers))):
        reached = _meet(frontier, tiers[tier]).mapInArrow(_expand(PAGE_LEVELS), _NODES_DDL)
        frontier = reached.unionByName(entering(tier - 1))
    return frontier


def _prove(root: str, page_levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _rows(batch):
                records, levels, out = _records(r["records"]), min(r["levels"], page_levels), []
                above = [x.split(" ") for x in r["path"].split("\n") if x]
                for x in r["nodes"]:
                    leaf, path = _down(records, r["digest"], x["rank"] % FAN ** page_levels, levels)
                    way = [*above, *(p.split(" ") for p in path)][::-1]
                    folded = x["claim"]
                    for digit, *siblings in way:
                        folded = sha([*siblings[:int(digit)], folded, *siblings[int(digit):]])
                    proof = sha([s for _, *siblings in way for s in siblings])
                    out.append((x["doc_id"], leaf, r["subroot"], root, proof, folded, folded == root))
                yield record_batch(_PROOFS, *zip(*out))
    return run


def proofs(manifest: Manifest) -> DataFrame:
    """For every leaf: its digest, subroot and root, the digest of its proof, the root folded from the
    claimed row, and whether that is the root."""
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if manifest.root is None:
        return manifest.leaves.sparkSession.createDataFrame([], schema)
    start = manifest.top[-1].where(F.col("digest") == manifest.root).select(
        "tree", F.lit(manifest.top_levels).alias("levels"), "digest", F.lit("").alias("path"), F.lit("").alias("subroot"))
    lowest = _meet(_descend(start, manifest.top), manifest.top[0]).mapInArrow(_expand(PAGE_LEVELS), _NODES_DDL)
    trees = stored(lowest.select(F.col("rank").alias("tree"), "digest", "path", F.col("digest").alias("subroot")).join(manifest.sources.select("tree", "levels"), "tree"))
    frontier = _descend(trees, [manifest.leaves, *manifest.upper])
    return _meet(frontier, manifest.leaves).mapInArrow(_prove(manifest.root, PAGE_LEVELS), schema)
