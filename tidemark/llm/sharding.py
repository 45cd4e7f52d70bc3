"""Sharding by a k-d tree over metadata, cut at distributed weighted medians.

Every document is a point: its language, source and length, each as a number that
keeps the column's order.  A node of the tree is cut along its widest dimension at
the point that halves its bytes, until there are ``2 ** depth`` leaves, which is
where a leaf has the target bytes.  Equal texts are one group, stand at one point (the
least language and source of the group) and stay in one shard: where a cut falls into a group,
the group goes as a whole to the side that brings the cut nearer to half, and where that misses
half by more than ``FINE`` of a leaf, the cut is sought again among the others for the bytes still
missing (for up to ``PLACED`` groups of a node).  Only a group that is heavier than a whole
leaf, which no shard could take, is divided, by a hash of doc_id.

A weighted median is found without sorting: the bytes of a node are summed in
``BINS`` equal bins of the key's range, the bin that holds the half is binned again,
and so on, so the table is read and partly aggregated by every task and only bin
sums move.  What reaches the driver is a few numbers for each node.  Only DataFrame
functions are used.

Defined cases: a null text weighs one byte (the separator) and all null texts are
one group; null language or source comes first; repeated rows get slots of their
own; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

BINS = 1024
FINE, PLACED = 0.01, 8
SLOT_ROWS = 20_000
_TOP = 2**62


def _as_number(name: str) -> Column:
    """The first seven bytes of a string as a number in the strings' order; null is -1."""
    return F.coalesce(F.conv(F.rpad(F.hex(F.substring(F.encode(name, "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("long"), F.lit(-1).cast("long"))


def points(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the coordinates of every row."""
    plain = written(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
            F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 2).alias("grp"),
            _as_number("lang").alias("x0"),
            _as_number("source").alias("x1"),
        ),
        "shard-rows",
    )
    groups = written(
        plain.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.min("x0").alias("g0"), F.min("x1").alias("g1"), F.max("x0").alias("h0"), F.max("x1").alias("h1")).where("n > 1 and (g0 < h0 or g1 < h1)").select("grp", "g0", "g1"),
        "shard-groups",
    )
    row_key = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(5)), 2)
    joined = plain.join(groups, "grp", "left")
    return joined.select("doc_id", "size", "text_crc32", "grp", F.coalesce("g0", "x0").alias("x0"), F.coalesce("g1", "x1").alias("x1"), F.col("size").alias("x2"), row_key.alias("row"))


def _cut(rows: DataFrame, nodes: dict[int, dict], leaf_bytes: float) -> dict[int, dict]:
    """For each node the key (dimension, coordinate, group, row) at which its bytes are halved, and the
    groups placed as a whole to its left and right.

    Rounds of binning over coordinate, then group, then row; every round narrows each
    node's interval by ``BINS``.
    """
    state = {n: {"level": 0, "lo": v["lo"], "hi": v["hi"], "below": 0, "at": [], "want": v["bytes"] / 2, "left": [], "right": []} for n, v in nodes.items()}
    open_ = set(state)
    while open_:
        parts = []
        for level in sorted({state[n]["level"] for n in open_}):
            mine = [n for n in open_ if state[n]["level"] == level]
            column = F.lit(None).cast("long")
            hit = F.lit(False)
            lo, step = F.lit(None).cast("long"), F.lit(None).cast("long")
            for n in mine:
                s = state[n]
                keys = [F.col(f"x{nodes[n]['dim']}"), F.col("grp"), F.col("row")]
                s["step"] = max(1, -(-(s["hi"] - s["lo"] + 1) // BINS))
                inside = (F.col("node") == n) & keys[level].between(s["lo"], s["hi"])
                for k, at in zip(keys, s["at"], strict=False):
                    inside &= k == at
                if s["left"] or s["right"]:
                    inside &= ~F.col("grp").isin(s["left"] + s["right"])
                column, hit = F.when(inside, keys[level]).otherwise(column), hit | inside
                lo, step = F.when(inside, F.lit(s["lo"])).otherwise(lo), F.when(inside, F.lit(s["step"])).otherwise(step)
            parts.append(rows.where(hit).select("node", "size", F.call_function("div", column - lo, step).alias("bin"), column.alias("key")))
        binned = parts[0]
        for p in parts[1:]:
            binned = binned.unionByName(p)
        sums = binned.groupBy("node", "bin").agg(F.sum("size").alias("bytes"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        found: dict[int, list] = {n: [] for n in open_}
        for row in sums.collect():  # at most BINS rows for each node, whatever the table
            found[row["node"]].append(row)
        for n, bins in found.items():
            s, run = state[n], state[n]["below"]
            if not bins:  # every group of the node is placed
                s["cut"] = (_TOP * 2 - 1,) * 3
                open_.discard(n)
                continue
            bins.sort(key=lambda b: b["bin"])
            for b in bins:
                if run + b["bytes"] >= s["want"] or b is bins[-1]:
                    break
                run += b["bytes"]
            lo, hi = b["lo"], b["hi"]
            s["below"], s["lo"], s["hi"] = run, lo, hi
            over = s["want"] - run > b["bytes"] / 2  # the upper of the bin's two ends is the nearer
            missed = abs(s["want"] - run - (b["bytes"] if over else 0))
            whole = lo == hi and s["level"] == 1 and b["bytes"] <= leaf_bytes
            placed = len(s["left"]) + len(s["right"])
            if b["bytes"] <= FINE * leaf_bytes or lo == hi and s["level"] == 2 or whole and (missed <= FINE * leaf_bytes or placed == PLACED):
                s["cut"] = (*s["at"], hi if over else lo - 1, *([_TOP * 2 - 1] * (2 - s["level"])))
                open_.discard(n)
            elif whole:
                s["left" if over else "right"].append(lo)
                s |= {"level": 0, "lo": nodes[n]["lo"], "hi": nodes[n]["hi"], "below": 0, "at": [], "want": s["want"] - (b["bytes"] if over else 0)}
            elif lo == hi:
                s["at"].append(lo)
                s["level"] += 1
                s["lo"], s["hi"] = (0, _TOP - 1)
    return {n: {"dim": nodes[n]["dim"], "cut": s["cut"], "left": s["left"], "right": s["right"]} for n, s in state.items()}


def shard(docs: DataFrame, depth: int = 4) -> DataFrame:
    """Every row with its leaf (``shard``, 0 to ``2 ** depth - 1``) and a gapless ``slot`` in it."""
    rows = written(points(docs), "shard-points")
    node = F.lit(1)
    dims = ("x0", "x1", "x2")
    for level in range(depth):
        rows_now = rows.withColumn("node", node)
        stats = rows_now.groupBy("node").agg(F.sum("size").alias("bytes"), *[f(d).alias(f"{f.__name__}_{d}") for d in dims for f in (F.min, F.max)]).collect()
        if not stats:
            break
        if level == 0:
            span = {d: max(1, stats[0][f"max_{d}"] - stats[0][f"min_{d}"]) for d in dims}
            leaf_bytes = stats[0]["bytes"] / 2**depth
        nodes = {}
        for s in stats:
            dim = max(range(3), key=lambda k: ((s[f"max_x{k}"] - s[f"min_x{k}"]) / span[f"x{k}"], -k))
            nodes[s["node"]] = {"bytes": s["bytes"], "dim": dim, "lo": s[f"min_x{dim}"], "hi": s[f"max_x{dim}"]}
        below = F.lit(True)
        for n, found in _cut(rows_now, nodes, leaf_bytes).items():
            c, (x, g, r) = F.col(f"x{found['dim']}"), found["cut"]
            less = (c < x) | ((c == x) & ((F.col("grp") < g) | ((F.col("grp") == g) & (F.col("row") <= r))))
            for side in ("left", "right"):
                if found[side]:
                    less = F.when(F.col("grp").isin(found[side]), side == "left").otherwise(less)
            below = F.when(node == n, less).otherwise(below)
        rows = written(rows.select("doc_id", "size", "text_crc32", "grp", *dims, "row", (node * 2 + F.when(below, 0).otherwise(1)).alias("n")), "shard-level")
        node = F.col("n")
    placed = rows.select("doc_id", "size", "text_crc32", "row", (node - 2**depth if rows.columns[-1] == "n" else F.lit(0)).cast("int").alias("shard"))
    return with_slots(placed)


def with_slots(placed: DataFrame) -> DataFrame:
    """``slot`` numbers the rows of each shard from 0 without gaps: rows are dealt by hash to
    groups of about ``SLOT_ROWS``, numbered inside them, and each group starts where the one before ends."""
    n = placed.count()
    parts = max(1, n // (16 * SLOT_ROWS))
    dealt = placed.withColumn("part", F.pmod("row", F.lit(parts)).cast("int"))
    counts = dealt.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n_rows"))
    before = F.coalesce(F.sum("n_rows").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("shard", "part", before.cast("long").alias("start"))
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row", "doc_id", "text_crc32", "size"))
    return dealt.withColumn("at", inside).join(starts, ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("at") - 1).alias("slot"))
