"""Exact self-join of documents by the Jaccard similarity of their word shingles.

1. Equal sets are one class, a node named by a hash of the set; one row of it stands for it.
2. Two sets that reach the threshold share a shingle among the first ``n - ceil(t n) + 1``
   of each in any fixed order of all shingles.  The order puts shingles known to occur in
   several documents last, the more frequent the later, so few documents meet by chance.
   (Those are counted over all documents; how many are told apart is bounded, which
   only affects how many documents meet.)
3. Documents that meet at a shingle are candidates if their sizes allow it and if their
   bitmaps do: each shingle flips one of 1,024 bits, and the bits in which two bitmaps
   differ bound the overlap from above.  Where more than ``PAIRS_UP_TO`` meet, pairs are
   not listed: all become neighbours of one of them.
4. Connected candidates form a cluster.  A cluster of more than ``BLOCK`` may hang together by shingles that
   are merely common, such as a template's; it is refined first: sizes and bitmaps alone, of about eight bits
   a shingle, are compared in tiles of up to ``BITS_BLOCK`` documents a side, and what stays connected by
   pairs that both bounds allow is a cluster of its own.  Linked documents pass both, so no link is lost,
   and documents that share a template and no more need no shingles at all.  In a cluster of more than ``BLOCK`` every document is first
   held against the cluster's leader, its least one, and those that link with it form its team; what
   is left gets a new leader, ``LEADERS`` times.  So a large group of near copies costs
   a comparison for each of them.
5. A cluster is cut into blocks by size band (a factor of 1/t), team and hash, bounded in documents
   and in shingles; a tile holds one or two blocks of equal or adjacent bands that aren't of the
   same leader's team.  In a tile bitmaps are compared first, then sorted arrays are
   intersected, and pairs that are already connected are skipped.
6. Links make components; every document takes its class's.

Defined cases: a null, empty or blank text has no shingle and links with nothing, so its component
is its own doc_id; fewer words than a shingle make one; rows that share a doc_id keep their own
texts and links; a null doc_id names no component in which there is another id; repeated rows each
get their row; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vector_text as V
from .components import components
from .shared import written

BITS = 1024
KNOWN_SHINGLES = 1_000_000
HOT = 1024
PAIRS_UP_TO = 64
BLOCK, BLOCK_SHINGLES = 128, 1 << 20
BITS_BLOCK, MAX_BITS = 2048, 1 << 16
LEADERS = 3
BROADCAST_ROWS = 500_000


def prefix_length(n, percent: int):
    """How many first shingles of a set of ``n`` must be looked at; at least one of a non-empty set."""
    return n - (percent * n + 99) // 100 + 1


def _bitmaps(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each set the parities of its shingles over ``BITS`` cells, as 64-bit integers."""
    sets = len(at) - 1
    cell = np.repeat(np.arange(sets), np.diff(at)) * BITS + (values & np.uint64(BITS - 1)).astype(np.int64)
    odd = (np.bincount(cell, minlength=sets * BITS) & 1).astype(np.uint8).reshape(sets, BITS)
    return np.packbits(odd, axis=1, bitorder="little").view(np.uint64)


def _pick(values: np.ndarray, at: np.ndarray, take: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first ``take`` values of every set."""
    place = np.arange(len(values)) - np.repeat(at[:-1], np.diff(at))
    keep = place < np.repeat(take, np.diff(at))
    return values[keep], np.append(0, np.cumsum(np.minimum(take, np.diff(at))))


def _node() -> Column:
    """The class of a set, from its size and a 128-bit key."""
    return F.xxhash64("n", "s1", "s2").alias("node")


def _keys_of(values: np.ndarray, first: np.ndarray) -> list[pa.Array]:
    """Size and the two halves of the key of each set."""
    sums = [np.append(np.zeros(1, np.uint64), np.cumsum(x)) for x in (values, V.mix(values ^ np.uint64(0x5851F42D4C957F2D)))]
    return [pa.array(np.diff(first)), *[pa.array((x[first[1:]] - x[first[:-1]]).view(np.int64)) for x in sums]]


def _sets(docs: DataFrame, percent: int, width: int) -> DataFrame:
    """doc_id, text_hash, n, node, and the set's first shingles in the order of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in V.chunks(batch.column("text")):
                values, first = V.shingle_sets(data, at, width)
                n = np.diff(first)
                keys, ends = _pick(values, first, np.where(n > 0, prefix_length(n, percent), 0))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), *_keys_of(values, first), V.list_column(keys, ends)], ["doc_id", "text_hash", "n", "s1", "s2", "keys"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    found = rows.mapInArrow(run, "doc_id long, text_hash long, n long, s1 long, s2 long, keys array<long>")
    return found.select("doc_id", "text_hash", "n", _node(), "keys")


def _known(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most ``KNOWN_SHINGLES`` of the shingles that several documents begin with, the most
    frequent, with their counts.  This bounded list only orders shingles."""
    counts = written(sets.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "jaccard-counts")
    by_count = sorted(((r["m"], r["k"]) for r in counts.groupBy(F.least("n", F.lit(1000)).alias("m")).agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)
    least, total = 1001, 0
    for m, k in by_count:
        total += k
        if total > KNOWN_SHINGLES:
            break
        least = m
    found = counts.where(F.col("n") >= least).toArrow()
    key, n = found.column("key").to_numpy().astype(np.int64).view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(key)
    return key[order], n[order]


def _prefixes(docs: DataFrame, reps: DataFrame, known: tuple[np.ndarray, np.ndarray], percent: int, width: int) -> DataFrame:
    """node, n, the first shingles in the final order (those of hot ones apart) and the bitmap, of one row of each class."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = shared.value
        for batch in batches:
            for lo, hi, data, at in V.chunks(batch.column("text")):
                values, first = V.shingle_sets(data, at, width)
                n, bits, keys_of = np.diff(first), _bitmaps(values, first), _keys_of(values, first)
                count = np.zeros(len(values), np.int64)
                if len(keys) and len(values):
                    where = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
                    count = np.where(keys[where] == values, counts[where], 0)
                    owner = np.repeat(np.arange(len(n)), n)
                    order = np.lexsort((values, count, owner)) if count.any() else np.arange(len(values))
                    values, count = values[order], count[order]
                take = np.where(n > 0, prefix_length(n, percent), 0)
                picked, ends = _pick(values, first, take)
                hot = _pick(count, first, take)[0] >= HOT
                split = lambda mask, p=picked, e=ends: V.list_column(p[mask], np.append(0, np.cumsum(mask))[e])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), *keys_of, split(~hot), split(hot), V.list_column(bits.ravel(), np.arange(len(n) + 1) * (BITS // 64))],
                    ["doc_id", "n", "s1", "s2", "cold", "hot", "bits"],
                )

    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, s1 long, s2 long, cold array<long>, hot array<long>, bits array<long>")
    return _one_of_each(found.select("doc_id", _node(), "n", "cold", "hot", "bits"), reps)


def _one_of_each(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """One row of each class in ``reps`` (rep, class): of its least doc_id's rows, which are equal, any."""
    mine = written(rows.join(reps, (F.col("node") == F.col("class")) & F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi").drop("doc_id"), "jaccard-reps")
    if mine.count() == reps.count():
        return mine
    # rows are there twice with one doc_id and one set; only then is there anything to bring together
    return written(mine.groupBy("node").agg(*[F.first(c).alias(c) for c in mine.columns if c != "node"]), "jaccard-reps")


def _meetings(postings: DataFrame, percent: int, parts: int) -> DataFrame:
    """Pairs (a, b) of documents that meet at a shingle; ``wide`` marks the neighbours made where too many meet.

    Reads postings sorted by shingle as a stream; no more than ``PAIRS_UP_TO`` of one shingle are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a, b, wide):
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(wide, pa.bool_())], ["a", "b", "wide"])

        key, docs, sizes, leader = None, [], [], None
        pairs: set[tuple[int, int, bool]] = set()

        def close():
            for i in range(len(docs) - 1):
                for j in range(i + 1, len(docs)):
                    if sizes[j] * percent > 100 * sizes[i]:
                        break
                    if docs[i] != docs[j]:
                        pairs.add((min(docs[i], docs[j]), max(docs[i], docs[j]), False))

        for batch in batches:
            keys = batch.column("key").to_numpy()
            # shingles met once, the most of them, are left out without a loop
            same = keys[1:] == keys[:-1]
            use = np.append(same, True) | np.append(True, same)
            ids, ns = batch.column("node").to_numpy()[use].tolist(), batch.column("n").to_numpy()[use].tolist()
            for k, d, n in zip(keys[use].tolist(), ids, ns, strict=True):
                if k != key:
                    close()
                    key, docs, sizes, leader = k, [], [], None
                if leader is not None:
                    pairs.add((min(leader, d), max(leader, d), True))
                    continue
                docs.append(d)
                sizes.append(n)
                if len(docs) > PAIRS_UP_TO:
                    leader = docs[0]
                    pairs.update((min(leader, x), max(leader, x), True) for x in docs[1:] if x != leader)
                    docs, sizes = [], []
            if len(pairs) > 200_000:
                yield out(*zip(*pairs, strict=True))
                pairs.clear()
        close()
        if pairs:
            yield out(*zip(*pairs, strict=True))

    return postings.repartition(parts, "key").sortWithinPartitions("key", "n", "node").mapInArrow(run, "a long, b long, wide boolean")


def _candidates(reps: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between documents that may reach the threshold."""
    parts = max(int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    meet = written(_meetings(reps.select(F.explode("cold").alias("key"), "node", "n"), percent, parts).distinct(), "jaccard-meetings")
    side = lambda x: reps.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    pairs = meet.where("not wide").join(side("a"), "a").join(side("b"), "b")
    differ = sum((F.bit_count(F.col("bits_a")[i].bitwiseXOR(F.col("bits_b")[i])) for i in range(BITS // 64)), F.lit(0))
    sizes = F.col("n_a") + F.col("n_b")
    # the overlap is at most (sizes - differ) / 2
    near = pairs.where((100 + percent) * (sizes - differ) >= 2 * percent * sizes).select("a", "b")
    hot = reps.select(F.explode("hot").alias("key"), "node")
    leaders = written(hot.groupBy("key").agg(F.min("node").alias("leader")), "jaccard-leaders")
    stars = hot.join(leaders, "key").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    return near.union(meet.where("wide").select("a", "b")).union(stars)


def _tiles(members: DataFrame, percent: int, block: int, block_shingles: int) -> DataFrame:
    """(node, team, tile): each cluster's documents (node, n, cluster, team, which is 0 for those of
    no leader) dealt to tiles so that any two that may link, and aren't of one leader's team, share one."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int")
    teams = LEADERS + 1
    m = members.withColumn("kind", band * teams + F.col("team"))
    counts = m.groupBy("cluster", "kind").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("shingles"))
    blocks = F.ceil(F.greatest(F.col("k") / block, F.col("shingles") / block_shingles)).cast("int")
    plan = counts.groupBy("cluster").agg(F.sum("k").alias("total"), F.sum("shingles").alias("size"), F.map_from_entries(F.collect_list(F.struct("kind", blocks.alias("blocks")))).alias("blocks"))
    plan = written(plan.where((F.col("total") > block) | (F.col("size") > block_shingles)), "jaccard-plan")
    joined = m.join(plan.select(F.col("cluster").alias("c"), "blocks"), F.col("cluster") == F.col("c"), "left")
    own = F.pmod(F.xxhash64("node", F.lit(11)), F.try_element_at("blocks", F.col("kind")).cast("long"))

    def with_blocks_of(kind):
        """Tiles with each block of a kind: named by the two blocks, the lesser first."""
        many = F.coalesce(F.try_element_at("blocks", kind), F.lit(0))
        mine = F.struct(F.col("kind").cast("long").alias("kind"), own.alias("block"))

        def name(t):
            other = F.struct(kind.cast("long").alias("kind"), t.cast("long").alias("block"))
            low, high = F.least(mine, other), F.greatest(mine, other)
            return F.xxhash64("cluster", low["kind"], low["block"], high["kind"], high["block"])

        same = (F.col("team") > 0) & (F.pmod(kind, F.lit(teams)) == F.col("team"))
        return F.when((many > 0) & ~same, F.transform(F.sequence(F.lit(0), many - 1), name)).otherwise(F.array().cast("array<bigint>"))

    base = F.col("kind") - F.col("team")
    near = F.concat(*[with_blocks_of(base + step * teams + t) for step in (-1, 0, 1) for t in range(teams)])
    tiles = F.when(F.col("blocks").isNull(), F.array(F.xxhash64("cluster"))).otherwise(near)
    return joined.select("node", "team", F.explode(tiles).alias("tile"))


def linked(ids: list[int], arrays: list[np.ndarray], percent: int, teams: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that connect the sets of a tile as all links between them do; sets of one team (above 0) are connected already."""
    order = np.argsort([len(a) for a in arrays], kind="stable")
    ids, arrays = [ids[i] for i in order], [arrays[i] for i in order]
    team = np.zeros(len(ids), np.int64) if teams is None else np.array(teams, np.int64)[order]
    sizes = np.array([len(a) for a in arrays], np.int64)
    at = np.append(0, np.cumsum(sizes))
    bits = _bitmaps(np.concatenate(arrays), at)
    group = np.where(team > 0, len(ids) + team, np.arange(len(ids)))
    out = []
    for i in range(len(ids) - 1):
        end = int(np.searchsorted(sizes, 100 * sizes[i] // percent, "right"))
        if end <= i + 1:
            continue
        differ = np.bitwise_count(bits[i + 1 : end] ^ bits[i]).sum(1).astype(np.int64)
        total = sizes[i + 1 : end] + sizes[i]
        able = np.flatnonzero(((100 + percent) * (total - differ) >= 2 * percent * total) & (group[i + 1 : end] != group[i])) + i + 1
        for j in able:
            if group[j] == group[i]:
                continue
            where = np.minimum(np.searchsorted(arrays[j], arrays[i]), sizes[j] - 1)
            both = int((arrays[j][where] == arrays[i]).sum())
            if 100 * both >= percent * (sizes[i] + sizes[j] - both):
                out.append((ids[i], ids[j]))
                group[group == group[j]] = group[i]
    return out


def _wide_bitmaps(values: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """For each set a bitmap of its own length, a power of two of about eight bits a shingle."""
    out = []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        size = min(MAX_BITS, max(BITS, 1 << int(8 * max(1, hi - lo) - 1).bit_length()))
        odd = (np.bincount((values[lo:hi] & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8)
        out.append(np.packbits(odd, bitorder="little").view(np.uint64))
    return out


def near_by_bits(ids: np.ndarray, sizes: np.ndarray, bits: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs whose sizes and bitmaps allow a link, as many as connect the documents as all such pairs do.

    Of two bitmaps of different lengths the longer is folded: parities of its halves are those of half as many cells.
    """
    order = np.argsort(sizes, kind="stable")
    ids, sizes, bits = ids[order], sizes[order], [bits[k] for k in order]
    length = np.array([len(b) for b in bits])
    group, out = np.arange(len(ids)), []
    for cells in np.unique(length).tolist():
        # lengths grow with sizes, and a set that may link with one of this length has at most twice the length
        lo, hi = np.searchsorted(length, [cells, cells + 1])
        top = int(np.searchsorted(length, 2 * cells, "right"))
        same = np.stack([*bits[lo:hi], *[b[:cells] ^ b[cells:] for b in bits[hi:top]]])
        for i in range(lo, hi):
            end = min(top, int(np.searchsorted(sizes, 100 * sizes[i] // percent, "right")))
            rest = i + 1 + np.flatnonzero(group[i + 1 : end] != group[i])
            for at in range(0, len(rest), 1024):
                some = rest[at : at + 1024]
                differ = np.bitwise_count(same[some - lo] ^ same[i - lo]).sum(1, dtype=np.int64)
                total = sizes[some] + sizes[i]
                for j in some[(100 + percent) * (total - differ) >= 2 * percent * total].tolist():
                    if group[j] != group[i]:
                        out.append((int(ids[i]), int(ids[j])))
                        group[group == group[j]] = group[i]
    return out


def _bits_of(docs: DataFrame, reps: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """(node, bits) of the members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in V.chunks(batch.column("text")):
                values, first = V.shingle_sets(data, at, width)
                bits = _wide_bitmaps(values, first)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *_keys_of(values, first), V.list_column(np.concatenate(bits), np.append(0, np.cumsum([len(b) for b in bits])))], ["doc_id", "n", "s1", "s2", "bits"])

    return _of_members(docs, reps, members, run, "bits")


def _refined(docs: DataFrame, reps: DataFrame, members: DataFrame, percent: int, width: int) -> DataFrame:
    """The members, large clusters being cut to what sizes and bitmaps connect; a document that is left alone goes."""
    large = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > BLOCK).select("cluster")
    wide = written(members.join(large, "cluster", "left_semi"), "jaccard-wide")
    if wide.isEmpty():
        return members

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sizes, bits = None, [], [], []

        def close():
            found = near_by_bits(np.array(ids), np.array(sizes), bits, percent) if len(ids) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

        for batch in batches:
            column = batch.column("bits")
            for k, (tile, node, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("tile", "node", "n")), strict=True)):
                if tile != now:
                    if ids:
                        yield close()
                    now, ids, sizes, bits = tile, [], [], []
                ids.append(node)
                sizes.append(n)
                bits.append(column[k].values.to_numpy().astype(np.int64).view(np.uint64))
        if ids:
            yield close()

    parts = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = _tiles(wide.withColumn("team", F.lit(0)), percent, BITS_BLOCK, BITS_BLOCK << 12).join(wide.select("node", "n"), "node").join(_bits_of(docs, reps, wide, width), "node")
    edges = written(dealt.select("tile", "node", "n", "bits").repartition(parts, "tile").sortWithinPartitions("tile").mapInArrow(run, "a long, b long"), "jaccard-bits")
    again = components(edges).join(wide.select("node", "n"), "node").select("node", "n", F.col("component").alias("cluster"))
    return written(members.join(large, "cluster", "left_anti").select("node", "n", "cluster").union(again), "jaccard-refined")


def _shingles(docs: DataFrame, reps: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of the members, as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in V.chunks(batch.column("text")):
                values, first = V.shingle_sets(data, at, width)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *_keys_of(values, first), V.list_column(values, first)], ["doc_id", "n", "s1", "s2", "shingles"])

    return _of_members(docs, reps, members, run, "shingles")


def _of_members(docs: DataFrame, reps: DataFrame, members: DataFrame, run, column: str) -> DataFrame:
    """(node, ``column``) of the members, made by ``run`` from the texts of one row of each."""
    mine = written(reps.join(members.select(F.col("node").alias("class")), "class", "left_semi"), "jaccard-members-reps")
    ids = mine.select(F.col("rep").alias("id")).distinct()
    few = ids.count() <= BROADCAST_ROWS  # a larger list is joined by a shuffle
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(ids) if few else ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    found = texts.mapInArrow(run, f"doc_id long, n long, s1 long, s2 long, {column} array<long>").select("doc_id", _node(), column)
    return _one_of_each(found, mine)


def _teams(members: DataFrame, arrays: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(members with their team, links with leaders).

    A round holds the documents of large clusters that have no team yet against the least of them.
    """
    large = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > BLOCK).select("cluster")
    loose = written(members.join(large, "cluster", "left_semi"), "jaccard-loose")
    if not loose.isEmpty():
        arrays = written(arrays.join(loose.select("node"), "node", "left_semi"), "jaccard-large")
    links, placed = None, None
    for team in range(1, LEADERS + 1):
        if loose.isEmpty():
            break
        leaders = loose.groupBy("cluster").agg(F.min("node").alias("leader"), F.min_by("n", "node").alias("n_leader"))
        theirs = leaders.join(arrays.withColumnRenamed("node", "leader"), "leader").withColumnRenamed("shingles", "held")
        sizes = F.least("n", "n_leader") * 100 >= F.greatest("n", "n_leader") * percent
        pairs = loose.join(theirs, "cluster").where(sizes).join(arrays, "node")
        both = F.size(F.array_intersect("shingles", "held"))
        met = written(pairs.where(100 * both >= percent * (F.col("n") + F.col("n_leader") - both)).select("node", "leader"), "jaccard-team")
        found = met.select("node", F.lit(team).alias("team"))
        placed = found if placed is None else placed.union(found)
        edges = met.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b"))
        links = edges if links is None else links.union(edges)
        loose = written(loose.join(met, "node", "left_anti"), "jaccard-loose")
    if placed is None:
        return members.withColumn("team", F.lit(0)), members.select(F.col("node").alias("a"), F.col("node").alias("b")).where("false")
    return written(members.join(placed, "node", "left").withColumn("team", F.coalesce("team", F.lit(0))), "jaccard-teams"), links


def _links(docs: DataFrame, reps: DataFrame, members: DataFrame, percent: int, width: int) -> DataFrame:
    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, arrays, teams = None, [], [], []

        def close():
            found = linked(ids, arrays, percent, teams) if len(ids) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

        for batch in batches:
            column = batch.column("shingles")
            for k, (tile, doc, team) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("tile", "node", "team")), strict=True)):
                if tile != now:
                    if len(ids) > 1:
                        yield close()
                    now, ids, arrays, teams = tile, [], [], []
                ids.append(doc)
                teams.append(team)
                arrays.append(column[k].values.to_numpy().astype(np.int64).view(np.uint64))
        if len(ids) > 1:
            yield close()

    arrays = _shingles(docs, reps, members, width)
    placed, links = _teams(members, arrays, percent)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = arrays.join(_tiles(placed, percent, BLOCK, BLOCK_SHINGLES), "node").repartition(parts, "tile").sortWithinPartitions("tile")
    return links.union(dealt.mapInArrow(tiles, "a long, b long"))


def classes(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component, component_id) of every row; ``component`` is null for sets without a shingle."""
    sets = written(_sets(docs, percent, width), "jaccard-sets")
    nodes = written(sets.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")), "jaccard-classes")
    reps = nodes.select("rep", F.col("node").alias("class"))
    first = _prefixes(docs, reps, _known(sets), percent, width)
    clusters = components(_candidates(first, percent))
    members = written(clusters.join(nodes.select("node", "n"), "node").select("node", "n", F.col("component").alias("cluster")), "jaccard-members")
    links = written(_links(docs, reps, _refined(docs, reps, members, percent, width), percent, width), "jaccard-links")
    found = components(links)
    named = written(nodes.join(found, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component")), "jaccard-named")
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "component").select("node", "component", "component_id")
    with_set = sets.where("n > 0").drop("keys").join(named, "node").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "component", "component_id")
    without = sets.where("n = 0").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
    return with_set.union(without)


def join(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of ``docs`` (doc_id, text)."""
    return classes(docs, percent, width).select("doc_id", "n_shingles", "component_id")
