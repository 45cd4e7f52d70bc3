"""Mixing sources to target weights by pivotal dependent rounding.

Each source has a target of words.  A document's expected number of copies is its
source's target over its source's size; the whole part is certain and the
fraction is rounded together with those of other documents of the source.  Two
documents meet and, at random but without bias, one hands words to the other
until one of the two is wholly in or wholly out; the other goes on to meet the
next.  The words expected of a source never change in this, so what it takes
differs from its target by at most half of one document.

The meetings form a reduction tree: groups of about ``FAN`` documents of a source
are folded inside one task each, which leaves one undecided document a group, and
these are grouped again, until one is left for a source.  A hot source is merely
more groups.  Rows that are alike (source, doc_id and text) are added up first: as many of
them as their fractions fill are wholly in, one is left undecided for what remains, and
that one goes to the meetings.  Only DataFrame functions are used.

Defined cases: a null text or a text without words has size 0 and takes nothing;
null is a source of its own and comes last; repeated rows each get their row; rows that share a
doc_id are told apart by a hash of their text; an empty table gives an empty table; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

FAN = 64
WORD = r"[^\x20\x09-\x0D]+"
_KEYS = ("doc_id", "text_hash", "size", "many", "full")
_FIELDS = ",".join(f"{k}:bigint" for k in _KEYS)
_DOC = f"struct<{_FIELDS},mass:double>"
_DONE = f"array<struct<{_FIELDS},up:int>>"


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """A row for each source: its size, its documents and its target.

    Targets are ``share`` of all words dealt by weight, none above ``cap`` times its
    source's size.  With sources by ascending cap over weight, the level of the
    dealt words is the largest of (words left after the caps so far) / (weights left).
    The windows run over sources, not documents.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    ranked = by_source.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    all_rows = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rising = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("most").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(all_rows) * F.lit(float(share)) - before) / left
    return (
        ranked.withColumn("level", level)
        .withColumn("target", F.least("most", F.max("level").over(all_rows) * F.col("weight")))
        .select("source", "source_size", "n_docs", "target")
    )


def _uniform(*values: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*values), 11).cast("double") / F.lit(float(2**53))


def _meet(seed: int):
    """One step of the fold: the undecided document ``now`` meets ``new``."""

    def settled(doc: Column, up: int) -> Column:
        return F.array(F.struct(*[doc[k].alias(k) for k in _KEYS], F.lit(up).alias("up")))

    def holding(doc: Column, mass: Column) -> Column:
        return F.struct(*[doc[k].alias(k) for k in _KEYS], mass.alias("mass")).cast(_DOC)

    def step(state: Column, new: Column) -> Column:
        now = state["now"]
        nobody = F.lit(None).cast(_DOC)
        total = now["mass"] + new["mass"]
        gain, loss = F.least(now["size"] - now["mass"], new["mass"]), F.least(now["mass"], new["size"] - new["mass"])
        draw = _uniform(F.lit(seed), now["doc_id"], new["doc_id"], now["text_hash"], new["text_hash"])
        rises = draw * (gain + loss) < loss  # so that the mean change is nought
        # where the transfer fills one document and empties the other at once, both are settled
        giver_out = F.when(total > now["size"], F.struct(F.concat(state["done"], settled(now, 1)).alias("done"), holding(new, total - now["size"]).alias("now")))
        giver_out = giver_out.when(total == now["size"], F.struct(F.concat(state["done"], settled(now, 1), settled(new, 0)).alias("done"), nobody.alias("now")))
        giver_out = giver_out.otherwise(F.struct(F.concat(state["done"], settled(new, 0)).alias("done"), holding(now, total).alias("now")))
        taker_full = F.when(total > new["size"], F.struct(F.concat(state["done"], settled(new, 1)).alias("done"), holding(now, total - new["size"]).alias("now")))
        taker_full = taker_full.when(total == new["size"], F.struct(F.concat(state["done"], settled(new, 1), settled(now, 0)).alias("done"), nobody.alias("now")))
        taker_full = taker_full.otherwise(F.struct(F.concat(state["done"], settled(now, 0)).alias("done"), holding(new, total).alias("now")))
        both = F.when(rises, giver_out).otherwise(taker_full)
        return F.when(now.isNull(), F.struct(state["done"].alias("done"), new.cast(_DOC).alias("now"))).otherwise(both)

    return step


def _fold(docs: DataFrame, seed: int) -> DataFrame:
    start = F.struct(F.array().cast(_DONE).alias("done"), F.lit(None).cast(_DOC).alias("now"))
    members = F.sort_array(F.collect_list(F.struct(*_KEYS, "mass")))
    return docs.groupBy("source", "bucket", "buckets").agg(members.alias("members")).select("source", "bucket", "buckets", F.aggregate("members", start, _meet(seed)).alias("state")).select("source", "bucket", "buckets", "state.done", "state.now")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text, source): ``copies`` to take of it, its size in words,
    and its source's size and target.  ``text_hash`` tells apart rows that share a doc_id."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sizes = written(docs.select("doc_id", "source", size.alias("size"), F.xxhash64("text").alias("text_hash")), "mix-sizes")
    targets = written(source_targets(sizes, weights, share, cap), "mix-targets")
    most = targets.agg(F.max("n_docs")).first()[0] or 0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    alike = sizes.groupBy("source", "doc_id", "text_hash", "size").agg(F.count(F.lit(1)).alias("many"))
    joined = alike.join(targets, alike["source"].eqNullSafe(targets["source"])).select(alike["*"], "n_docs", rate.alias("rate"))
    total = (F.col("rate") - F.floor("rate")) * F.col("size") * F.col("many")
    joined = joined.withColumn("full", F.when(F.col("size") > 0, F.least(F.floor(total / F.col("size")), "many")).otherwise(0).cast("long"))
    joined = joined.withColumn("mass", total - F.col("full") * F.col("size"))
    open_ = (F.col("mass") > 0) & (F.col("mass") < F.col("size")) & (F.col("full") < F.col("many"))
    n_buckets = F.ceil(F.col("n_docs") / FAN)
    bucket = F.pmod(F.xxhash64("doc_id", "text_hash", F.lit(seed)), n_buckets)
    level = _fold(joined.where(open_).select("source", *_KEYS, "mass", bucket.alias("bucket"), n_buckets.alias("buckets")), seed)
    settled, buckets = [], -(-most // FAN)
    while True:
        level = written(level, "mix-level")
        settled.append(level.select("source", F.explode("done").alias("doc")).select("source", "doc.*"))
        left = level.where("now is not null")
        if buckets <= 1:
            break
        buckets = -(-buckets // FAN)
        level = _fold(left.select("source", "now.*", F.floor(F.col("bucket") / FAN).alias("bucket"), F.ceil(F.col("buckets") / FAN).alias("buckets")), seed)
    last = left.select("source", *[f"now.{k}" for k in _KEYS], (F.col("now.mass") * 2 >= F.col("now.size")).cast("int").alias("up"))
    rounded = joined.where(~open_).select("source", *_KEYS, (F.col("mass") >= F.col("size")).cast("int").alias("up"))
    for part in [*settled, last]:
        rounded = rounded.unionByName(part)
    further = (F.col("number") <= F.col("full") + F.col("up")).cast("int")
    copies = F.when(F.col("size") > 0, F.floor("rate") + further).otherwise(0).cast("int")
    out = rounded.join(targets.withColumn("rate", rate), rounded["source"].eqNullSafe(targets["source"])).withColumn("number", F.explode(F.sequence(F.lit(1).cast("long"), "many")))
    return out.select("doc_id", "text_hash", rounded["source"], "size", "source_size", "target", copies.alias("copies"))
