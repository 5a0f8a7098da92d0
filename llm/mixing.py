"""Mixing sources to target weights by systematic sampling.

Each source gets a target number of words; a document of it is expected target /
source size times. The documents of a source are put in order of size, the expected
copies are summed along the order from one offset per source, and a document is taken
once for each whole number its step crosses. As neighbours in the order have similar
sizes, what is taken stays within about one document of the target.

Everything is made of DataFrame operations. A source may hold any share of the rows:
the order is cut into slices of similar size (:mod:`stockloom.operators.ordered`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from stockloom.operators.ordered import along_order, in_order
from stockloom.sources.scratch import keep

from .common import WORD

#: Weights of the sources in order of their names, over and over.
WEIGHTS = (5, 2, 1)
#: Targets sum to so many halves of all words (150 %), and no target is above so many times its source.
HALVES, MOST = 3, 2
SEED = "mix"

_WHOLE = "decimal(38,0)"


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``source_no``, ``source``, ``source_size`` and ``target`` of each source.

    Sources count by code point, null last. Each is to have its weight's share of 150 % of
    all words; a target above twice its source stops there, and the excess goes to the
    others by weight until none is above. Whole numbers decide who is at the limit. Only
    sums over the sources come to the driver, once per round.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = in_order(totals.withColumn("no_name", F.col("source").isNull()), ["no_name", "source"], "sources")
    slices = ordered.groupBy("slice").agg(F.count(F.lit(1)).alias("rows"), F.min("line_no").alias("first_no"))
    earlier = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # a row per slice
    slices = slices.select("slice", "first_no", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    numbered = ordered.join(slices, "slice").select(
        (F.col("before") + F.col("line_no") - F.col("first_no")).alias("source_no"), "source", "source_size"
    )
    choice = F.array(*[F.lit(w) for w in weights])
    sources = keep(
        numbered.select(
            "*",
            F.get(choice, (F.col("source_no") % len(weights)).cast("int")).cast(_WHOLE).alias("weight"),
            (F.col("source_size") * MOST).cast(_WHOLE).alias("limit"),
        ),
        "source_weights",
    )
    whole = sources.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights")).first()
    share, weight = HALVES * int(whole.words or 0), int(whole.weights or 1)
    over, under = share, 2 * weight
    while True:
        at_limit = F.col("weight") * F.lit(over).cast(_WHOLE) > F.col("limit") * F.lit(under).cast(_WHOLE)
        held = sources.where(at_limit).agg(F.sum("limit").alias("limits"), F.sum("weight").alias("weights")).first()
        found = share - 2 * int(held.limits or 0), 2 * (weight - int(held.weights or 0))
        if found == (over, under):
            break
        over, under = found
    level = (F.col("weight") * F.lit(over).cast(_WHOLE)).cast("double") / F.lit(float(under))
    return sources.select(
        "source_no", "source", "source_size", F.when(at_limit, F.col("limit").cast("double")).otherwise(level).alias("target")
    )


def copies(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED) -> DataFrame:
    """Key, size, source_size, target, and the number of copies (0, 1 or 2) of each row.

    The size of a text is its number of words; a null text has none. A null source is a
    source of its own. The same rows get the same copies on every run.
    """
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")
    sized = keep(df.select(F.col(key).alias("key"), F.col(source).alias("source"), size.alias("size")), "sizes")
    targets = keep(source_targets(sized), "source_targets")
    joined = sized.join(targets, sized.source.eqNullSafe(targets.source)).select(
        "key", "source_no", targets.source, "size", "source_size", "target"
    )
    placed = along_order(
        in_order(joined, ["source_no", "size", "key"], "documents_in_order"), ["source_no"], running={"place": F.lit(1)}
    )
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    first_digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit(""))).cast("binary")), 1, 8)
    offset = F.conv(first_digits, 16, 10).cast("double") / 4294967296.0
    reached = lambda place: F.floor(expected * place + offset)
    return placed.select(
        F.col("key").alias(key),
        "size",
        "source_size",
        "target",
        (reached(F.col("place")) - reached(F.col("place") - 1)).cast("int").alias("copies"),
    )


def mixed(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of the mix: each document as often as it is taken, with all its columns.

    Rows with the same key share the copies of that key, one after the other in the order
    of a hash of text and source. Columns may have any names.
    """
    # Inside, a row is one struct: its columns cannot clash with those made here.
    rows = df.select(F.struct("*").alias("doc"), F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), F.xxhash64(source).alias("source_hash"))
    taken = copies(df, key, text, source).groupBy(F.col(key).alias("taken_key")).agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("rows"))
    taken = keep(taken.where("n > 0"), "taken")
    # Merged whatever the size: the keys grow with the documents.
    once, shared = taken.where("rows = 1").hint("merge"), taken.where("rows > 1").hint("merge")
    found = rows.join(once, rows["key"].eqNullSafe(once["taken_key"])).select("doc", F.col("n").alias("times"))
    if not shared.isEmpty():
        # One key may hold any share of the rows: they are numbered in slices, not in a window
        # over the key. The rows' own numbers are written first, so that they stay the same.
        several = rows.join(shared, rows["key"].eqNullSafe(shared["taken_key"])).drop("taken_key")
        several = keep(several.withColumn("row", F.monotonically_increasing_id()), "shared_keys")
        narrow = several.select(
            "row", F.col("key").isNull().alias("no_name"), F.coalesce(F.col("key").cast("string"), F.lit("")).alias("name"), "text_hash", "source_hash"
        )
        group = ["no_name", "name"]
        ordered = in_order(narrow, [*group, "text_hash", "source_hash", "row"], "shared_keys_in_order")
        turns = along_order(ordered, group, running={"turn": F.lit(1)}).select("row", "turn")
        even, rest = F.floor(F.col("n") / F.col("rows")), F.col("n") % F.col("rows")
        found = found.unionByName(several.join(turns, "row").select("doc", (even + (F.col("turn") <= rest).cast("bigint")).alias("times")))
    found = found.where("times > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy"))
    return found.select("doc.*")
