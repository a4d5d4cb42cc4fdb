"""Ownership closures, garbage collection and retention.

edges: (parent, child); packs: (pack, sealed); owners: (owner, root); places: (node, pack); owned: (owner, pack);
tombstones: (pack). Which packs are held at all is asked of the union of roots, in time linear in the graph; only
what must be known for each owner walks a closure for each distinct root.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weir.errors import UnsafeRecovery
from weir.functions.canon import sha256_hex
from weir.sources.kept import kept

from .reach import closure, reached, reaching


def owned_packs(owners: DataFrame, edges: DataFrame, places: DataFrame) -> DataFrame:
    """(owner, pack) over the closures of the owners' roots."""
    reach = closure(owners.select("root").distinct(), edges)
    return owners.join(reach, "root").join(places, "node").select("owner", "pack").distinct()


def held_packs(owners: DataFrame, edges: DataFrame, places: DataFrame) -> DataFrame:
    """(pack) that any owner holds."""
    return reached(owners.select(F.col("root").alias("node")), edges).join(places, "node").select("pack").distinct()


def refused(roots: DataFrame, edges: DataFrame, places: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Those roots whose closure has a pack that is gone: nothing may be retained through them."""
    gone = places.join(tombstones.select("pack"), "pack", "left_semi").select("node")
    return roots.join(reaching(gone, edges).select(F.col("node").alias("root")), "root", "left_semi")


def collectable(packs: DataFrame, held: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Sealed packs that nobody owns and that are not gone already."""
    return packs.where("sealed").join(held.select("pack"), "pack", "left_anti").join(tombstones.select("pack"), "pack", "left_anti").select("pack")


def collection_summary(packs: DataFrame, owners: DataFrame, held: DataFrame, tombstones: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row: what a collection reclaims and what stays."""
    gone = collectable(packs, held, tombstones)
    freed = gone.join(sizes, "pack", "left").agg(F.count("*").alias("reclaimed_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("reclaimed_bytes"))
    counts = owners.agg(F.count_distinct("owner").alias("owners")).join(held.agg(F.count("*").alias("retained_packs")))
    open_ = packs.agg(F.count_if(~F.col("sealed")).alias("open_packs"))
    return freed.join(counts).join(open_).join(tombstones.agg(F.count("*").alias("tombstones")))


def live_roots(parts: list[DataFrame]) -> DataFrame:
    """The union of what tasks, commits, batches, readers, consumers, producers and checkpoints hold."""
    out = parts[0].select("root", "holder")
    for p in parts[1:]:
        out = out.unionByName(p.select("root", "holder"))
    return out.where("root IS NOT NULL").distinct()


def dead_owners(owners: DataFrame, live: DataFrame, prefix: str) -> DataFrame:
    return owners.where(F.col("owner").startswith(prefix)).join(live.select("owner"), "owner", "left_anti")


def unretained(live: DataFrame, places: DataFrame, owned: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Live roots (root) that are nowhere, that nobody owns, or whose pack is gone, with the reason."""
    at = live.select("root").distinct().join(places.select(F.col("node").alias("root"), "pack"), "root", "left")
    at = at.join(owned.select("pack", F.lit(True).alias("own")).distinct(), "pack", "left").join(tombstones.select("pack", F.lit(True).alias("gone")), "pack", "left")
    reason = F.when(F.col("gone"), "gone").when(F.col("pack").isNull(), "missing").when(F.col("own").isNull(), "unowned")
    return at.select("root", reason.alias("reason")).where("reason IS NOT NULL")


def require_retained(live: DataFrame, places: DataFrame, owned: DataFrame, tombstones: DataFrame) -> None:
    if bad := unretained(live, places, owned, tombstones).first():
        raise UnsafeRecovery(f"root {bad.root} is {bad.reason}")


def reactivation(roots: DataFrame, edges: DataFrame, places: DataFrame, held: DataFrame, tombstones: DataFrame) -> DataFrame:
    """(root, allowed): every pack of its closure is owned now and none is gone. Asked from the bad packs backwards."""
    bad = places.join(held.select("pack"), "pack", "left_anti").unionByName(places.join(tombstones.select("pack"), "pack", "left_semi"))
    spoiled = reaching(bad.select("node"), edges).select(F.col("node").alias("root"), F.lit(False).alias("fine"))
    return roots.select("root").distinct().join(spoiled, "root", "left").select("root", F.coalesce("fine", F.lit(True)).alias("allowed"))


def category(owner: Column) -> Column:
    return F.split(owner, ":")[0]


def retention_summary(owned: DataFrame, owners_shown: int = 4, packs_shown: int = 3) -> DataFrame:
    """Owners and distinct packs of each kind of owner, and its least owners with their least packs as examples."""
    kinds = owned.select(category(F.col("owner")).alias("category"), "owner", "pack").distinct()
    sums = kinds.groupBy("category").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("pack").alias("packs"))
    names = kinds.groupBy("category", "owner").agg(F.count("*").alias("n"))
    first = names.withColumn("k", F.row_number().over(Window.partitionBy("category").orderBy("owner"))).where(F.col("k") <= owners_shown)
    own = kinds.join(F.broadcast(first.select("owner")), "owner")  # a few owners for each kind
    own = own.withColumn("k", F.row_number().over(Window.partitionBy("owner").orderBy("pack"))).where(F.col("k") <= packs_shown)
    shown = own.groupBy("category", "owner").agg(F.concat(F.col("owner"), F.lit("="), F.array_join(F.array_sort(F.collect_list("pack")), ",")).alias("x"))
    return sums.join(shown.groupBy("category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("owner", "x"))), lambda p: p["x"]), ";").alias("examples")), "category")


def open_writers(packs: DataFrame, limit: int = 64) -> DataFrame:
    """Writers with a pack that is not sealed, the least ones."""
    return packs.where(~F.col("sealed")).groupBy("writer").agg(F.count("*").alias("open_packs")).orderBy("writer").limit(limit)


def orphans(files: DataFrame, held: DataFrame) -> DataFrame:
    """Files that no reference reaches, by whether they are whole."""
    return files.join(held.select("pack").distinct(), "pack", "left_anti").select("pack", F.when(F.col("sealed"), "sealed").otherwise("partial").alias("kind"))


def orphan_report(files: DataFrame, held: DataFrame) -> tuple[DataFrame, str]:
    """The orphans and a digest of them: an order-free sum of hashes, so none is gathered."""
    found = kept(orphans(files, held))
    line = sha256_hex(F.concat_ws(":", "pack", "kind"))
    r = found.agg(F.count("*").alias("n"), *[F.sum(F.conv(F.substring(line, 1 + 8 * k, 8), 16, 10).cast("bigint")).alias(f"s{k}") for k in range(8)]).first()
    return found, ":".join(str(x) for x in r)


def cleanup_orphans(files: DataFrame, held: DataFrame, reported: str, stopped: bool, errors: int = 0) -> DataFrame:
    """The orphans to delete: only of a stopped store, without errors, and if they are still those of the report."""
    found, digest = orphan_report(files, held)
    if not stopped or errors or digest != reported:
        raise UnsafeRecovery("orphans are deleted from a stopped store with an unchanged report only")
    return found


def retained(owned: DataFrame, owner: str, refs: DataFrame, edges: DataFrame, places: DataFrame) -> DataFrame:
    """owned after owner holds the closure of refs (root) instead of what it held."""
    new = held_packs(refs, edges, places).select(F.lit(owner).alias("owner"), "pack")
    return owned.where(F.col("owner") != owner).unionByName(new)


def released(owned: DataFrame, owner: str) -> DataFrame:
    return owned.where(F.col("owner") != owner)


def held_too(owned: DataFrame, owner: str, packs: DataFrame) -> DataFrame:
    """owned after owner holds packs besides what it held."""
    return owned.unionByName(packs.select(F.lit(owner).alias("owner"), "pack")).distinct()


def released_publications(owned: DataFrame, pubs: DataFrame, edges: DataFrame) -> DataFrame:
    """owned without the staging owners of pubs (node) and of all that they depend on."""
    done = reached(pubs, edges).select(F.concat(F.lit("staged:"), F.col("node").cast("string")).alias("owner"))
    return owned.join(done, "owner", "left_anti")


def released_tensor_publications(owned: DataFrame, tensors: DataFrame, edges: DataFrame) -> DataFrame:
    """The same for the sets of tensors (pub, ordinal); several tensors of a set count once."""
    return released_publications(owned, tensors.select(F.col("pub").alias("node")).distinct(), edges)


def handoffs_once(asked: DataFrame, consumed: DataFrame) -> DataFrame:
    """Handoffs not yet consumed, each once."""
    return asked.distinct().join(consumed, "handoff", "left_anti")


def queue_collection(owners: DataFrame, live: DataFrame, prefix: str, edges: DataFrame, places: DataFrame, packs: DataFrame, tombstones: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(owners that stay, packs to reclaim) after the queue of a prefix drops the owners that no live root has.

    owners: (owner, root), live: (owner, root). It refuses if a live root is not retained.
    """
    held = held_packs(owners, edges, places)
    require_retained(live, places, held.select(F.lit("any").alias("owner"), "pack"), tombstones)
    dead = dead_owners(owners.select("owner").distinct(), live, prefix)
    stay = kept(owners.join(dead, "owner", "left_anti"))
    return stay, collectable(packs, held_packs(stay, edges, places), tombstones)


class Ownership:
    """The owned packs of a store as a table that operations replace; each version is written once."""

    def __init__(self, owned: DataFrame, edges: DataFrame, places: DataFrame, tombstones: DataFrame) -> None:
        self.owned, self.edges, self.places, self.tombstones = owned, edges, places, tombstones

    def retain(self, owner: str, refs: DataFrame) -> None:
        if bad := refused(refs, self.edges, self.places, self.tombstones).first():
            raise UnsafeRecovery(f"the closure of {bad.root} is gone in part")
        self.owned = kept(retained(self.owned, owner, refs, self.edges, self.places))

    def release(self, owner: str) -> None:
        self.owned = kept(released(self.owned, owner))

    def release_publications(self, pubs: DataFrame) -> None:
        self.owned = kept(released_publications(self.owned, pubs, self.edges))

    @contextmanager
    def pin(self, name: str, refs: DataFrame) -> Iterator[None]:
        """Holds refs as a reader for as long as the block runs."""
        self.retain(f"reader:{name}", refs)
        try:
            yield
        finally:
            self.release(f"reader:{name}")
