"""Mixing sources to target weights by temperature.

A source's share of the tokens is raised to an exponent and normalised; the
exponent is bisected until the weights meet a limit on how often a source
repeats, or a target entropy. Weights times the budget give each source its
tokens. They are realised as block permutations: a source's documents fall
into blocks by a hash, and each epoch goes through the blocks, and through
the documents of a block, in an order of its own (``turn``, ``place``). Whole
epochs come first; the last one takes its blocks in its order while the
budget lasts, and inside the block at the boundary its documents.

DataFrame and SQL functions only. Source totals and block totals are combined
before their shuffles. Sources are summed up by aggregates, never gathered,
so there may be many; windows run over at most 4096 sums of block totals of a
source, over the blocks of one such sum, and over the documents of one
block, never over a source, so a source with a third of all rows is no hot
task. The number of blocks follows the number of documents.

Defined results: a null source is a source of its own, after the others; a
null or empty text has no tokens but is kept in its source's whole epochs;
ties of hashes fall back on the id; repeated rows are drawn each; an empty
table gives an empty result. Other columns are ignored, or kept whatever
their names (``mix_rows``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import staged

ROUNDS = 30
PARTS, PASSES = 16, 8
REPEATS = 2.0
BLOCK_DOCS = 2048
TURN_DIGITS = 3
SALT = 64


def tokens_of(text: Column) -> Column:
    """Runs of anything but white space."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, F.lit(0)).otherwise(F.size(F.split(trimmed, r"[ \t\n\x0B\f\r]+"))).cast("long")


def _one_row(df: DataFrame, *values: Column) -> DataFrame:
    """``df`` with values aggregated over all of it: one row, so its broadcast has a fixed size."""
    return df.crossJoin(F.broadcast(df.agg(*values)))


def exponent(shares: DataFrame, max_repeats: float | None = REPEATS, entropy: float | None = None) -> DataFrame:
    """One row, the exponent in (0, 1], from a table (source, tokens).

    ``max_repeats``: the largest ratio, over sources, of a source's draw rate
    to the smallest rate, which grows as the exponent falls; the smallest
    exponent within the limit is wanted. It depends on the smallest and the
    largest source alone and is bisected ``ROUNDS`` times in one row.
    ``entropy``: the entropy in nats falls as the exponent grows; the largest
    exponent that reaches it is wanted. Each pass over the sources tells in
    which of ``PARTS`` equal parts it lies, ``PASSES`` times.
    """
    sized = shares.where("tokens > 0").select(F.col("tokens").cast("double").alias("t"))
    if entropy is not None:
        p = _one_row(sized, F.sum("t").alias("all")).select((F.col("t") / F.col("all")).alias("p"))
        low, high = 0.0, 1.0
        for _ in range(PASSES):
            at = [low + (high - low) * k / PARTS for k in range(1, PARTS)]
            sums = [x for k, a in enumerate(at) for x in (F.sum(F.pow("p", F.lit(a))).alias(f"z{k}"), F.sum(F.pow("p", F.lit(a)) * F.log("p")).alias(f"s{k}"))]
            got = p.agg(*sums).first()
            reached = [a for k, a in enumerate(at) if got[f"z{k}"] is not None and math.log(got[f"z{k}"]) - a * got[f"s{k}"] / got[f"z{k}"] >= entropy]
            low, high = (max(reached), max(reached) + (high - low) / PARTS) if reached else (low, low + (high - low) / PARTS)
        return sized.agg(F.when(F.count(F.lit(1)) == 0, F.lit(1.0)).otherwise(F.lit(round(low, 6))).alias("exponent"))
    edge = sized.agg(F.min("t").alias("least"), F.max("t").alias("most"))

    def step(interval: Column, _: Column) -> Column:
        mid = (interval["lo"] + interval["hi"]) / 2
        grow = F.pow(F.col("least") / F.col("most"), mid - 1) > F.lit(float(max_repeats))  # draw rate of the smallest source over the largest's
        return F.struct(F.when(grow, mid).otherwise(interval["lo"]).alias("lo"), F.when(grow, interval["hi"]).otherwise(mid).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")), step)
    return edge.select(F.when(F.col("least").isNull(), F.lit(1.0)).otherwise(F.round(found["hi"], 6)).alias("exponent"))


def weights(shares: DataFrame, max_repeats: float | None = REPEATS, entropy: float | None = None, budget: int | None = None) -> DataFrame:
    """(source, tokens, weight, budget, epochs, rest) per source.

    ``budget``: tokens to draw. None draws the smallest budget that takes
    every document at least once. ``epochs`` whole passes and ``rest`` tokens
    of one more make up a source's budget.
    """
    held = F.col("tokens") > 0
    known = _one_row(shares, F.sum(F.when(held, F.col("tokens"))).alias("all")).crossJoin(F.broadcast(exponent(shares, max_repeats, entropy)))
    raised = known.withColumn("raised", F.when(held, F.pow(F.col("tokens") / F.col("all"), F.col("exponent"))).otherwise(0.0)).select("source", "tokens", "raised")
    weighed = _one_row(raised, F.sum("raised").alias("whole")).withColumn("weight", F.when(F.col("whole") > 0, F.round(F.col("raised") / F.col("whole"), 9)).otherwise(0.0)).select("source", "tokens", "weight")
    if budget is None:
        weighed = _one_row(weighed, F.min(F.when(held, F.col("weight") / F.col("tokens"))).alias("rate"))
        own = F.greatest(F.col("tokens"), F.floor(F.round(F.col("weight") / F.col("rate"), 3)).cast("long"))
    else:
        own = F.floor(F.round(F.col("weight") * F.lit(budget), 3)).cast("long")
    sized = weighed.withColumn("budget", F.when(held, own).otherwise(F.lit(0)).cast("long"))
    epochs = F.when(held, F.expr("budget div tokens")).otherwise(F.lit(1))
    return sized.select("source", "tokens", "weight", "budget", epochs.cast("int").alias("epochs"), F.when(held, F.col("budget") % F.col("tokens")).otherwise(F.lit(0)).cast("long").alias("rest"))


def _block_digits(docs: int, block_docs: int) -> int:
    """Hex digits of the hash that name a block, so that a block has at most about ``block_docs`` documents."""
    digits = 1
    while docs > block_docs * 16**digits:
        digits += 1
    return digits


def _turn(epoch: str) -> Column:
    return F.md5(F.concat_ws(":", F.col(epoch).cast("string"), F.coalesce(F.col("source").cast("string"), F.lit("")), "block"))


def _place(epoch: str) -> Column:
    return F.md5(F.concat_ws(":", F.col(epoch).cast("string"), F.col("id").cast("string")))


def _before(blocks: DataFrame) -> DataFrame:
    """``blocks`` with the tokens of its source's blocks that come earlier by ``turn``: sums of blocks first, then inside one of them."""
    parts = blocks.groupBy("source", F.substring("turn", 1, TURN_DIGITS).alias("part")).agg(F.sum("in_block").alias("sum"))
    ahead = F.sum("sum").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(F.col("source").alias("_source"), F.col("part").alias("_part"), F.coalesce(ahead, F.lit(0)).alias("ahead"))
    inside = F.sum("in_block").over(Window.partitionBy("source", "part").orderBy("turn", "block").rowsBetween(Window.unboundedPreceding, -1))
    own = blocks.withColumn("part", F.substring("turn", 1, TURN_DIGITS)).withColumn("inside", F.coalesce(inside, F.lit(0)))
    return own.join(parts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("part") == F.col("_part"))).withColumn("before", F.col("ahead") + F.col("inside")).drop("_source", "_part", "part", "ahead", "inside")


def _drawn(docs: DataFrame, max_repeats: float | None, entropy: float | None, budget: int | None, id_col: str, text_col: str, source_col: str, block_docs: int) -> DataFrame:
    """(id, source, same, tokens, epoch, block, turn, place) of every draw; ``same`` is the text's hash."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.xxhash64(text).alias("same"), tokens_of(text).alias("tokens")).withColumn("spot", F.md5(F.col("id").cast("string")))
    rows = staged(rows, "tokens")  # the only look at the texts
    shares = staged(rows.groupBy("source").agg(F.sum("tokens").alias("tokens")), "shares")
    # a few numbers a source and a block: written once, else every reader's plan repeats how they came about
    plan = staged(weights(shares, max_repeats, entropy, budget), "weights")
    digits = _block_digits(rows.count(), block_docs)
    rows = rows.withColumn("block", F.coalesce(F.substring("spot", 1, digits), F.lit("")))

    totals = rows.groupBy("source", "block").agg(F.sum("tokens").alias("in_block"))
    p, b, r = plan.alias("p"), totals.alias("b"), rows.alias("r")
    blocks = b.join(p, F.col("b.source").eqNullSafe(F.col("p.source"))).select("b.source", "b.block", "b.in_block", "p.epochs", "p.rest")
    blocks = _before(blocks.withColumn("turn", _turn("epochs")))
    state = F.when(F.col("rest") == 0, 0).when(F.col("before") + F.col("in_block") <= F.col("rest"), 2).when(F.col("before") < F.col("rest"), 1).otherwise(0)
    blocks = staged(blocks.select("source", "block", "epochs", "rest", "before", state.alias("state")), "blocks").alias("k")
    planned = r.join(blocks, F.col("r.source").eqNullSafe(F.col("k.source")) & (F.col("r.block") == F.col("k.block"))).select("r.id", "r.source", "r.same", "r.tokens", "r.block", "k.epochs", "k.rest", "k.before", "k.state")
    whole = planned.where("epochs > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
    more = planned.where("state = 2").withColumn("epoch", F.col("epochs"))
    running = F.sum("tokens").over(Window.partitionBy("source", "block").orderBy(_place("epochs"), "id", "tokens").rowsBetween(Window.unboundedPreceding, 0))
    edge = planned.where("state = 1").withColumn("epoch", F.col("epochs")).withColumn("to", F.col("before") + running).where("to <= rest").drop("to")
    chosen = whole.unionByName(more).unionByName(edge)
    return chosen.select("id", "source", "same", "tokens", F.col("epoch").cast("int").alias("epoch"), "block", _turn("epoch").alias("turn"), _place("epoch").alias("place"))


def draw(docs: DataFrame, max_repeats: float | None = REPEATS, entropy: float | None = None, budget: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(id, source, tokens, epoch, block, turn, place) of every draw: ``epoch`` from 0.

    An epoch of a source is read by ``turn``, the hash of epoch and block,
    then by ``place`` (and id where two agree), the hash of epoch and document.
    """
    drawn = _drawn(docs, max_repeats, entropy, budget, id_col, text_col, source_col, block_docs)
    return drawn.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "tokens", "epoch", "block", "turn", "place")


def mix_rows(docs: DataFrame, max_repeats: float | None = REPEATS, entropy: float | None = None, budget: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``docs`` with each row as often as it is drawn; all columns stay.

    Rows that agree in id, source and text share their draws as evenly as can
    be: those that can't be shared go to the first of them, numbered in salted
    pieces.
    """
    key = ["id", "source", "same"]
    drawn = _drawn(docs, max_repeats, entropy, budget, id_col, text_col, source_col, block_docs).groupBy(*key).agg(F.count(F.lit(1)).alias("draws"))
    own = {"id": F.col(f"`{id_col}`"), "source": F.col(f"`{source_col}`"), "same": F.xxhash64(F.col(f"`{text_col}`"))}
    alike = docs.groupBy(*(c.alias(k) for k, c in own.items())).agg(F.count(F.lit(1)).alias("rows"))
    agree = lambda a, b: F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source")) & (F.col(f"{a}.same") == F.col(f"{b}.same"))
    times = drawn.alias("d").join(alike.alias("a"), agree("d", "a")).select(*(F.col(f"d.{k}") for k in key), F.expr("draws div rows").cast("int").alias("each"), (F.col("draws") % F.col("rows")).alias("extra"))
    times = staged(times, "times")
    # a row travels as one column, so that no name of its own can clash with ours
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(c.alias(k) for k, c in own.items())).alias("r")
    even = packed.join(times.alias("t"), agree("r", "t")).where("each > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("each"))).alias("turn")).select("row")
    if not times.where("extra > 0").isEmpty():
        even = even.unionByName(_shared_out(packed.join(times.where("extra > 0").alias("t"), agree("r", "t")).select("row", "extra", *(F.col(f"r.{k}") for k in key)), key, agree))
    return even.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def _shared_out(uneven: DataFrame, key: list[str], agree) -> DataFrame:
    """The first ``extra`` rows of each ``key``, numbered in ``SALT`` pieces."""
    uneven = staged(uneven.withColumn("n", F.monotonically_increasing_id()).withColumn("salt", F.col("n") % SALT), "uneven")
    sizes = uneven.groupBy(*key, "salt").agg(F.count(F.lit(1)).alias("m"))
    ahead = F.coalesce(F.sum("m").over(Window.partitionBy(*key).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nth = F.row_number().over(Window.partitionBy(*key, "salt").orderBy("n"))
    ranked, sizes = uneven.withColumn("nth", nth).alias("r"), sizes.select(*key, "salt", ahead.alias("ahead")).alias("s")
    return ranked.join(sizes, agree("r", "s") & (F.col("r.salt") == F.col("s.salt"))).where("ahead + nth <= extra").select("row")


def op10_mix(spark, sf_dir: str) -> DataFrame:
    return draw(spark.read.parquet(f"{sf_dir}/documents.parquet"))
