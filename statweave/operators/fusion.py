"""Literature search: one work found by several indexes, merged, scored and ranked."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import cut
from ..functions.text import norm_doi, norm_title

RRF_K = 60
SHORTEST_TITLE = 12

ITEM = "source string, source_order int, rank int, doi string, title string, year int, authors array<string>, abstract string, cited_by long, is_oa boolean, item_id string"


def blocks(items: DataFrame) -> DataFrame:
    """A block for each item such that items sharing a DOI or a long enough title share it.

    Labels travel over the keys that several items hold until none changes; every decision on an item looks at such
    items only, so the fold below may run block by block. Keys are hashes: equal ones of different texts only make a
    block larger, as the fold compares whole texts.
    """
    title = norm_title(F.col("title"))
    rows = items.withColumn("_doi", norm_doi(F.col("doi"))).withColumn("_title", F.when(F.length(title) >= SHORTEST_TITLE, title)).withColumn("_row", F.xxhash64("source", "source_order", "rank", "item_id", "title", "doi"))
    keys = [F.when(F.col(c).isNotNull(), F.xxhash64(F.lit(c), c)) for c in ("_doi", "_title")]
    links = cut(rows.select("_row", F.explode(F.array_compact(F.array(*keys))).alias("k")))
    links = cut(links.join(links.groupBy("k").agg(F.min("_row").alias("a"), F.max("_row").alias("b")).where("a < b").select("k"), "k"))
    labels = links.select("_row", F.col("_row").alias("_block")).distinct()
    while True:
        low = links.join(labels, "_row").groupBy("k").agg(F.min("_block").alias("b"))
        moved = links.join(low, "k").groupBy("_row").agg(F.min("b").alias("b"))
        labels = cut(labels.join(moved, "_row").select("_row", F.least("_block", "b").alias("_block"), (F.col("b") < F.col("_block")).alias("_moved")))
        if labels.where("_moved").isEmpty():
            return rows.join(labels.drop("_moved"), "_row", "left").withColumn("_block", F.coalesce("_block", "_row"))


class Fold:
    """The groups of one block's items, which come in order, by tables of who owns a DOI, a title, a title's year."""

    def __init__(self) -> None:
        self.groups: list[dict] = []
        self.by_doi: dict[str, int] = {}
        self.by_title: dict[str, list[int]] = {}
        self.by_year: dict[tuple[str, int], list[int]] = {}

    def titled(self, at: int) -> None:
        g = self.groups[at]
        heapq.heappush(self.by_title.setdefault(g["title"], []), at)
        heapq.heappush(self.by_year.setdefault((g["title"], g["year"]), []), at)

    def near(self, title: str, year: int) -> int | None:
        """The first group with the title and a near year."""
        if not year:
            return next(iter(self.by_title.get(title, [])), None)
        unknown = self.by_year.get((title, 0), [])
        while unknown and self.groups[unknown[0]]["year"]:  # it has met its year since
            heapq.heappop(unknown)
        return min((found[0] for y in (0, year - 1, year, year + 1) if (found := self.by_year.get((title, y)))), default=None)

    def join(self, doi: str | None, title: str | None, year: int, item_id: str, seq: int) -> int:
        at = self.by_doi.get(doi) if doi else None
        if at is None and title:
            at = self.near(title, year)
        if at is None:
            at = len(self.groups)
            self.groups.append({"dois": [], "title": None, "year": year, "id": item_id, "seq": seq})
        g = self.groups[at]
        if year and not g["year"]:
            g["year"] = year
            if g["title"]:
                heapq.heappush(self.by_year.setdefault((g["title"], year), []), at)
        if title and not g["title"]:
            g["title"] = title
            self.titled(at)
        if doi and doi not in self.by_doi:
            self.by_doi[doi] = at
            g["dois"].append(doi)
        return at


def resolve(items: DataFrame) -> DataFrame:
    """Items with the group they join: the first group that owns the DOI, else the first with the title and a near year.

    Items come in the order of source, then rank. A year of null or 0 is near every year; a group takes the first year
    it meets; later DOIs are the group's other ones. Groups are numbered by their first item. A partition's blocks
    follow each other, so one pass over Arrow batches folds them all; an item costs a few look-ups.
    """
    schema = "item_id string, group_id string, group_seq long, doi string, other_dois array<string>"
    types = pa.schema([("item_id", pa.string()), ("group_id", pa.string()), ("group_seq", pa.int64()), ("doi", pa.string()), ("other_dois", pa.list_(pa.string()))])

    def fold(batches):
        block, state, ids, joined = None, Fold(), [], []
        out: list[list] = [[] for _ in types]

        def close() -> None:
            for item_id, at in zip(ids, joined, strict=True):
                g = state.groups[at]
                for column, value in zip(out, (item_id, g["id"], g["seq"], g["dois"][0] if g["dois"] else None, g["dois"][1:]), strict=True):
                    column.append(value)

        for batch in batches:
            for key, item_id, order, rank, year, doi, title in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != block:
                    close()
                    block, state, ids, joined = key, Fold(), [], []
                ids.append(item_id)
                joined.append(state.join(doi, title, year or 0, item_id, order * 1_000_000 + rank))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, types, strict=True)], schema=types)
                out = [[] for _ in types]
        close()
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, types, strict=True)], schema=types)

    order = ["source_order", "rank", "item_id", "doi_key", "title_key", "year"]
    rank = F.when(F.coalesce("rank", F.lit(0)) == 0, 99).otherwise(F.col("rank"))
    rows = blocks(items).select("_block", F.col("item_id").cast("string").alias("item_id"), F.col("source_order").cast("long").alias("source_order"), rank.cast("long").alias("rank"), F.col("year").cast("long").alias("year"), F.col("_doi").alias("doi_key"), F.col("_title").alias("title_key"))
    return rows.repartition("_block").sortWithinPartitions("_block", *[F.asc_nulls_last(c) for c in order]).mapInArrow(fold, schema)


def best_of_group(items: DataFrame, groups: DataFrame) -> DataFrame:
    """One row for each group: first non-empty fields in source order, longest author list, most citations, any open access.

    The items of a group and source are merged first, which gives the source's best rank, then the group's sources; so
    ``groups`` is computed once.
    """
    rows = items.drop("doi").join(groups, "item_id").where("group_id is not null")
    order = [F.col(c) for c in ("source_order", "rank", "item_id")]

    def first(c: str, when: Column) -> Column:
        return F.min(F.when(when, F.struct(*order, F.col(c).alias("value")))).alias(c)

    def full(c: str) -> Column:
        return F.col(c).isNotNull() & (F.col(c).cast("string") != "")

    of_source = rows.groupBy("group_id", "source").agg(
        F.min_by("rank", F.struct(*order)).alias("rank"),
        F.min("group_seq").alias("group_seq"),
        F.min("doi").alias("doi"),
        first("title", full("title")),
        first("abstract", full("abstract")),
        first("year", F.coalesce("year", F.lit(0)) != 0),
        F.max(F.struct(F.size("authors").alias("n"), (-F.col("source_order")).alias("s"), (-F.col("rank")).alias("r"), F.col("authors").alias("value"))).alias("authors"),
        F.max("cited_by").alias("cited_by"),
        F.bool_or("is_oa").alias("is_oa"),
        F.collect_list("item_id").alias("item_ids"),
    )
    return of_source.groupBy("group_id").agg(
        F.min("group_seq").alias("group_seq"),
        F.min("doi").alias("doi"),
        *[F.min(c)["value"].alias(c) for c in ("title", "abstract", "year")],
        F.max("authors")["value"].alias("authors"),
        F.max("cited_by").alias("cited_by"),
        F.bool_or("is_oa").alias("is_oa"),
        F.array_sort(F.flatten(F.collect_list("item_ids"))).alias("item_ids"),
        F.sum(F.lit(1.0) / (RRF_K + F.col("rank"))).alias("rrf"),
        F.count("*").alias("sources"),
    )


def coverage(text: Column, terms: list[str]) -> Column:
    """Share of the query's terms that some word of the text begins with (longer terms without a plural s)."""
    if not terms:
        return F.lit(1.0)
    words = F.split(norm_title(text), " ")
    stems = [t[:-1] if len(t) > 3 and t.endswith("s") else t for t in (x.lower() for x in terms)]
    hits = [_begins(words, s) for s in stems]
    total = F.lit(0)
    for h in hits:
        total = total + F.when(h, 1).otherwise(0)
    return total / F.lit(float(len(terms)))


def _begins(words: Column, stem: str) -> Column:
    return F.exists(words, lambda w: F.startswith(w, F.lit(stem)))


def ranked(merged: DataFrame, terms: list[str]) -> DataFrame:
    """Groups by reciprocal-rank score weighed by coverage, then citations, then first place."""
    cover = F.bround(coverage(F.concat_ws(" ", "title", "abstract"), terms), 2)
    scored = merged.withColumn("coverage", cover).withColumn("score", F.bround(F.col("rrf") * (F.lit(0.5) + F.lit(0.5) * F.col("coverage")), 5))
    return scored.orderBy(F.col("score").desc(), F.coalesce("cited_by", F.lit(0)).desc(), "group_seq")


def search(sources: list[DataFrame], terms: list[str], limit: int | None = None) -> DataFrame:
    """The federated search over items that the sources gave: union, resolution, merge, ranking."""
    items = sources[0]
    for s in sources[1:]:
        items = items.unionByName(s, allowMissingColumns=True)
    out = ranked(best_of_group(items, resolve(items)), terms)
    return out.limit(limit) if limit else out
