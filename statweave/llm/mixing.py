"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts; built-ins only.

Every row gets a random key from the MD5 of its id, a seed and its text. Within a source rows are taken in the order
of the key, so a key's leading hexadecimal digits are ranges of that order: sums per (source, range) give each range
its starting total, and a running sum inside the range gives each row its own. No task holds a source, only the keys
and sizes of one of its 4,096 ranges. Rows of one key and size are counted for each partition they are read in before
they are placed, and numbered there, so that however many equal rows there are, a range holds a few counts of them.
A source's budget is whole epochs of all its rows and a rest that is cut exactly: rows before the cut are taken once
more, the row at the cut in part. Sources themselves are ranked by prefix sums over ranges, so there may be very many.

Null and empty sources are different sources, null sorts last; null sizes count 0; rows without an id, or of one id,
differ by their texts; which of wholly equal rows is at the cut follows the partition it is read in; an empty table
gives an empty result. Other columns are carried along untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpoint, parallelism

#: Leading hexadecimal digits of the key that make a range: 16**3 ranges a source.
RANGE_DIGITS = 3
#: Columns that rows must agree in to be counted together.
ALIKE = ["name", "key", "size", "salt"]


def prefix_sums(rows: DataFrame, order: list[Column], **sums: str) -> DataFrame:
    """``rows`` and, under each name, the sum of its column over the rows that come before in ``order``.

    Rows are dealt to ranges of the order; the totals of the ranges, one row for each shuffle partition, give each
    range its start. The order must tell all rows apart; an empty table gives an empty result.
    """
    dealt = checkpoint(rows.repartitionByRange(parallelism(rows.sparkSession), *order).withColumn("part", F.spark_partition_id()))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("part").agg(*[F.sum(c).alias(f"{name} all") for name, c in sums.items()])
    starts = totals.select("part", *[F.coalesce(F.sum(f"{name} all").over(earlier), F.lit(0)).alias(f"{name} from") for name in sums])
    placed = dealt.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"{name} in") for name, c in sums.items()])
    both = placed.join(F.broadcast(starts), "part")  # as many rows as there are shuffle partitions
    return both.select(*rows.columns, *[(F.col(f"{name} from") + F.col(f"{name} in")).alias(name) for name in sums])


def source_targets(totals: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), cap: int = 2) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` of all sizes; a target stops at
    ``cap`` times its source's size and the excess is shared anew by weight. In order of size by weight the sources
    that stop are the first ones, so one running sum finds them.
    """
    num, den = share
    exact = "decimal(20,0)"
    by_name = F.col("source").asc_nulls_last()
    ranked = prefix_sums(totals.withColumn("one", F.lit(1)), [by_name], rank="one")
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    x = ranked.select("source", "source_size", weight.alias("w")).withColumn("room", F.col("source_size") / F.col("w"))
    x = prefix_sums(x, [F.col("room").asc(), by_name], before="source_size", w_before="w")
    t, w_all = x.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
    free = F.lit(num * t).cast(exact) - den * cap * F.col("before").cast(exact)
    x = x.withColumn("stops", free * F.col("w").cast(exact) >= den * cap * F.col("source_size").cast(exact) * (F.lit(w_all) - F.col("w_before")).cast(exact))
    c, w_rest = x.agg(F.coalesce(F.sum(F.expr("if(stops, source_size, 0)")), F.lit(0)), F.coalesce(F.sum(F.expr("if(stops, 0, w)")), F.lit(0))).first()
    shared = F.col("w") * F.lit(num * t - den * cap * c).cast("long") / F.lit(float(den) * max(w_rest, 1))
    return x.select("source", "source_size", F.when(F.col("stops"), F.lit(float(cap)) * F.col("source_size")).otherwise(shared).cast("double").alias("target"))


def mix(rows: DataFrame, seed: str = "mix", weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), cap: int = 2) -> DataFrame:
    """(row, doc_id, size, source_size, target, epochs, taken) of each of ``rows`` (doc_id, source, size, tag, row).

    ``taken`` is what the mix takes of the row's size, repeats counted: ``epochs`` times all of it and a cut rest.
    ``tag`` is any text that tells rows of one id apart.
    """
    name = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}:"), F.coalesce("tag", F.lit(""))))
    size = F.coalesce(F.col("size").cast("long"), F.lit(0))
    rows = checkpoint(rows.select("row", "doc_id", size.alias("size"), name.alias("name"), key.alias("key"), F.spark_partition_id().alias("salt")))
    lots = rows.groupBy(*ALIKE).agg(F.count("*").alias("n")).withColumn("range", F.substring("key", 1, RANGE_DIGITS)).withColumn("words", F.col("n") * F.col("size"))
    ranges = checkpoint(lots.groupBy("name", "range").agg(F.sum("words").alias("n")))
    source = F.when(F.col("name") != "n", F.expr("substring(name, 2)"))
    goals = source_targets(ranges.groupBy("name").agg(F.sum("n").alias("source_size")).select(source.alias("source"), "source_size"), weights, share, cap).withColumn("name", name).drop("source")
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("name").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranges.select("name", "range", ahead.alias("ahead")).join(goals, "name")
    inside = Window.partitionBy("name", "range").orderBy("key", "size", "salt").rowsBetween(Window.unboundedPreceding, -1)
    found = lots.withColumn("inside", F.coalesce(F.sum("words").over(inside), F.lit(0))).join(starts, ["name", "range"])
    found = found.select(*ALIKE, "source_size", "target", (F.col("ahead") + F.col("inside")).alias("before"))
    nth = F.row_number().over(Window.partitionBy(*ALIKE).orderBy("size")) - 1
    placed = rows.withColumn("nth", nth).join(found, ALIKE)
    placed = placed.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(F.lit(0)))
    rest = F.floor("target") - F.col("epochs") * F.col("source_size") - F.col("before") - F.col("nth") * F.col("size")
    part = F.greatest(F.lit(0), F.least(rest, F.col("size")))
    return placed.select("row", "doc_id", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))


def sized(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` for ``mix``: the row itself as a struct, its number of words and a digest of its text."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    words = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0))
    return docs.select(row.alias("row"), F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), words.cast("long").alias("size"), F.md5(F.col("text").cast("string")).alias("tag"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, in the columns of ``docs``: a row for each epoch, and the cut row with its first words only."""
    taken = mix(sized(docs), **options)
    part = F.col("taken") - F.col("epochs") * F.col("size")
    whole = F.expr("(taken - epochs * size) = size and size > 0").cast("long")
    copies = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("epochs") + whole)
    cut = F.when((part > 0) & (part < F.col("size")), part).otherwise(F.lit(0))
    lots = F.concat(F.array_repeat(F.lit(-1).cast("long"), copies.cast("int")), F.when(cut > 0, F.array(cut.cast("long"))).otherwise(F.array().cast("array<bigint>")))
    rows = taken.withColumn("lot", F.explode(lots))
    first = F.regexp_extract(F.col("row.text"), r"^[\x20\x09-\x0D]*", 0)
    words = F.split(F.regexp_replace(F.col("row.text"), r"^[\x20\x09-\x0D]+", ""), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    head = F.concat(first, F.rtrim(F.array_join(F.slice(words, F.lit(1), F.col("lot").cast("int")), "")))
    fields = {c: F.col("row").getField(c) for c in docs.columns}
    fields["text"] = F.when(F.col("lot") < 0, fields["text"]).otherwise(head)
    if "n_chars" in fields:
        fields["n_chars"] = F.when(F.col("lot") < 0, fields["n_chars"]).otherwise(F.length(head).cast("long"))
    return rows.select(*[v.alias(c) for c, v in fields.items()])
