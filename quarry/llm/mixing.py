"""Mixing sources to target weights by capped water-filling.

Each source is to make up a share of the mix that goes with its weight, but no
source may be repeated more than ``max_epochs`` times. The targets are found
by water-filling: sources whose share would pass their cap are clamped to it,
and what is left over goes to the others in proportion to their weights, until
none is above its cap. Sums are whole numbers (the level is a fraction of two
sums), so the set of clamped sources does not depend on the order of addition.
Every round is one aggregate over the table of sources, which is never gathered.

A source whose target is 2.4 times its size is taken twice as a whole, and
documents with 0.4 of its words once more: those whose seeded hash lies below
the source's threshold. The threshold is found by radix selection: 12 bits of
the hash a round, sums of sizes by (source, digit) only, without sorting a source;
one more document is put in or left out if that brings the words nearer. A
source with a third of all rows is an ordinary partial aggregate. Whether a
document is taken hangs on its own hash and its source's threshold alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.ranks import ranked
from quarry.llm.store import keep, release

#: Weights of the sources in order, over and over.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 42
#: Radix selection: bits a round, rounds.
DIGIT_BITS, ROUNDS = 12, 5
_HASH_BITS = DIGIT_BITS * ROUNDS


def words(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` of a text, 0 for a null one."""
    parts = F.split(text, r"[\x20\x09-\x0D]+")
    blank_ends = (F.element_at(parts, 1) == "").cast("int") + ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")
    return F.coalesce((F.size(parts) - blank_ends).cast("long"), F.lit(0).cast("long"))


def source_key(source: Column) -> Column:
    """A key that is never null, other for a null source than for any other."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def weighted(sources: DataFrame, source: str = "source", weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``sources`` with a long column weight: the weights in turn, by code point, null last."""
    first = ranked(sources.withColumn("__null", F.col(f"`{source}`").isNull()), ["__null", source], "__rank")
    w = F.array(*[F.lit(x).cast("long") for x in weights])
    return first.withColumn("weight", F.get(w, (F.col("__rank") % len(weights)).cast("int"))).drop("__null", "__rank")


def water_fill(sources: DataFrame, total: int | None = None, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sources`` (a stored table with long columns source_size and weight)
    with a double column target. ``total`` words are shared out (default: all
    sizes); with more than the caps hold, every source is at its cap. A weight
    of 0 or null gives 0. An empty table stays empty."""
    cap, w = F.col("source_size").cast("decimal(38,0)") * max_epochs, F.coalesce("weight", F.lit(0)).cast("decimal(38,0)")
    s = sources.select("*", cap.cast("decimal(38,0)").alias("__cap"), w.alias("__w"))
    if total is None:
        total = sources.agg(F.sum("source_size")).first()[0] or 0
    # the level is room / open: words left for the open sources, and their weights
    room, open_w = total, int(s.agg(F.sum("__w")).first()[0] or 0)

    def clamped(level_room: int, level_open: int) -> Column:
        return F.col("__cap") * F.lit(level_open).cast("decimal(38,0)") <= F.col("__w") * F.lit(level_room).cast("decimal(38,0)")

    over = F.lit(False)
    while open_w > 0:
        # the level only rises, so a clamped source stays clamped
        over = clamped(room, open_w)
        r = s.agg(F.sum(F.when(over, F.col("__cap"))).alias("held"), F.sum(F.when(~over, F.col("__w"))).alias("open")).first()
        left, still = max(total - int(r["held"] or 0), 0), int(r["open"] or 0)
        if still == open_w or not still:
            break
        room, open_w = left, still
    share = (F.col("__w").cast("double") * room / open_w) if open_w else F.lit(0.0)
    return s.withColumn("target", F.when(over, F.col("__cap").cast("double")).otherwise(share)).drop("__cap", "__w")


def fractions(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """``sources`` (sid, source_size, target) with ``whole``, how often every
    document is taken, and ``below``: documents with a smaller __hash are taken
    once more, but for the one at ``swap``, with which it is the other way round. ``docs`` is a stored table with sid, size and __hash (of ``_HASH_BITS`` bits)."""
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = (sources.withColumn("whole", F.floor(epochs).cast("long"))
            .withColumn("need", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")))
    # at each round: the digits before the boundary are taken, the search goes on inside it
    at = plan.select("sid", "need", F.lit(0).cast("long").alias("below"), F.lit(True).alias("open"))
    stored = []
    for k in range(ROUNDS):
        shift = _HASH_BITS - DIGIT_BITS * (k + 1)
        now = at.filter("open and need > 0").select("sid", "need", "below")
        part = F.shiftright("__hash", shift + DIGIT_BITS)
        inside = docs.filter("size > 0").join(now, "sid").filter(part == F.shiftright("below", shift + DIGIT_BITS))
        digits = (inside.withColumn("__digit", F.shiftright("__hash", shift))
                  .groupBy("sid", "__digit").agg(F.sum("size").alias("s"), F.count("*").alias("n"), F.min("__hash").alias("lo"),
                                                 F.max("__hash").alias("hi"), F.first("need").alias("need")))
        # at most 2 ** DIGIT_BITS rows a source
        up_to = Window.partitionBy("sid").orderBy("__digit").rowsBetween(Window.unboundedPreceding, 0)
        edge = (digits.withColumn("c", F.sum("s").over(up_to)).filter("c >= need")
                .groupBy("sid").agg(F.min_by(F.struct("__digit", "s", "c", "lo", "hi"), "__digit").alias("e")))
        found = (at.join(edge, "sid", "left").select(
            "sid", F.col("need").alias("before"), F.when(F.col("e").isNull(), F.col("need"))
            .otherwise(F.col("need") - (F.col("e.c") - F.col("e.s"))).alias("need"),
            "below", "open", "e"))
        one = F.col("e.lo") == F.col("e.hi")  # a single hash: all of it or nothing, whichever is nearer
        take = 2 * F.col("need") > F.col("e.s")
        low = F.shiftleft(F.col("e.__digit"), shift)
        nxt = found.select(
            "sid", F.when(F.col("e").isNull(), F.lit(0)).otherwise(F.col("need")).cast("long").alias("need"),
            F.when(F.col("e").isNull(), F.col("below"))
            .when(one, F.col("e.lo") + F.when(take, 1).otherwise(0)).otherwise(low).cast("long").alias("below"),
            (F.col("e").isNotNull() & ~one).alias("open"))
        at = keep(nxt, "thresholds")
        stored.append(at)
        if not at.filter("open and need > 0").head(1):
            break
    # stored, so that Spark knows its size when it joins it with the documents
    found = keep(plan.join(at.select("sid", "below"), "sid"), "plan")
    stored.append(found)
    # what is still over or short is mended by the one document whose size is nearest to it
    taken = docs.join(found.select("sid", "below"), "sid").filter("__hash < below").groupBy("sid").agg(F.sum("size").alias("s"))
    found = keep(found.join(taken, "sid", "left").withColumn("over", F.coalesce("s", F.lit(0)) - F.col("need")).drop("s", "need"), "plan")
    off = F.abs(F.col("size") - F.abs("over"))
    swap = (docs.join(found.filter("over <> 0").select("sid", "below", "over"), "sid")
            .filter((F.col("__hash") < F.col("below")) == (F.col("over") > 0)).filter(off < F.abs("over"))
            .groupBy("sid").agg(F.min_by("__hash", F.struct(off, "__hash")).alias("swap")))
    out = keep(found.drop("over").join(swap, "sid", "left"), "plan")
    release(*stored, found)
    return out


def extra(hashed: str = "__hash") -> Column:
    """Whether a document is among those taken once more."""
    h = F.col(hashed)
    return (h < F.col("below")) != F.coalesce(h == F.col("swap"), F.lit(False))


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS,
        max_epochs: int = MAX_EPOCHS, total: int | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, size, source, source_size, target, copies of every row: its
    words, those of its source, the source's target and how often the document
    is taken. A null source is a source of its own, last in the order. The extra
    copies follow a hash of seed, id and text, so that reruns agree; rows with
    the same id and text share one lot. Empty texts have size 0 and are taken with the rest."""
    # the upper bits of the hash
    spread = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.col(f"`{text}`")), 64 - _HASH_BITS)
    sized = keep(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source}`").alias("source"),
                             words(F.col(f"`{text}`")).alias("size"), spread.alias("__hash")), "sized")
    sums = keep(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    filled = water_fill(keep(weighted(sums, "source", weights), "sources"), total, max_epochs)
    plan = keep(filled.select(source_key(F.col("source")).alias("sid"), "source", "source_size", "target"), "sources")
    sized = sized.withColumn("sid", source_key(F.col("source")))
    found = fractions(sized, plan.select("sid", "source_size", "target"))
    return (sized.join(found, "sid").select("doc_id", "size", "source", "source_size", "target",
                                            (F.col("whole") + extra().cast("long")).alias("copies")))


def repeated(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The mix itself: every row of ``docs`` as often as ``mixed`` says, with
    its epoch from 0. Ids must be unique and not null."""
    copies = mixed.filter("copies > 0").select(F.col("doc_id").alias("__id"), F.sequence(F.lit(0), F.col("copies").cast("int") - 1).alias("__e"))
    return (docs.join(copies, F.col(f"`{id_col}`") == F.col("__id")).drop("__id")
            .withColumn("epoch", F.explode("__e")).drop("__e"))
