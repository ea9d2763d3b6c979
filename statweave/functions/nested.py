"""Arrays, maps and polymorphic JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_seen(seq: Column, value: Column) -> Column:
    """Aggregate: distinct non-empty values in the order in which they first come."""
    pairs = F.array_sort(F.collect_list(F.when(value.isNotNull() & (value.cast("string") != ""), F.struct(seq.alias("seq"), value.cast("string").alias("v")))))
    return F.array_distinct(F.transform(pairs, lambda x: x["v"]))


def distinct_join(seq: Column, value: Column, sep: str = ",", most: int | None = None) -> Column:
    """Aggregate: distinct non-empty values in first-seen order, or ``N values (see file)`` beyond ``most``."""
    values = first_seen(seq, value)
    joined = F.array_join(values, sep)
    return joined if most is None else F.when(F.size(values) > most, F.concat(F.size(values).cast("string"), F.lit(" values (see file)"))).otherwise(joined)


def inverted_to_text(index: Column) -> Column:
    """``{word: [positions]}`` back to the text."""
    places = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(places), lambda x: x["w"]), " ")


def inverted_index(text: Column) -> Column:
    """``{word: [positions]}`` of a text's blank-separated words: sorted words, cut where a new one begins."""
    pairs = F.array_sort(F.transform(F.split(text, " "), lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    def entries(pairs: Column) -> Column:
        n = F.size(pairs)
        first = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(pairs, i)["w"] != F.get(pairs, i - 1)["w"]))

        def entry(first: Column) -> Column:
            def places(i: Column, k: Column) -> Column:
                end = F.coalesce(F.get(first, k + 1), n)
                return F.struct(F.get(pairs, i)["w"].alias("key"), F.transform(F.slice(pairs, i + 1, end - i), lambda x: x["i"]).alias("value"))

            return F.transform(first, places)

        return once(first, entry)

    return F.map_from_entries(once(pairs, entries))


def once(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_sums(numbers: Column) -> Column:
    """Sums of an integer array up to and with each item, in one pass over the array for each doubling of its length."""
    steps = F.filter(F.transform(F.sequence(F.lit(0), F.lit(30)), lambda i: F.pow(F.lit(2), i).cast("int")), lambda back: back < F.size(numbers))
    return F.aggregate(steps, numbers, lambda now, back: F.transform(now, lambda x, i: x + F.when(i >= back, F.get(now, i - back)).otherwise(F.lit(0))))


def packed_list(json: Column, value_ddl: str = "string") -> Column:
    """A list that may come as ``{"0": v, …}``, as an array or as one value."""
    as_array = F.from_json(json, f"array<{value_ddl}>")
    as_map = F.map_values(F.from_json(json, f"map<string,{value_ddl}>"))
    return F.when(json.rlike(r"^\s*\["), as_array).when(json.rlike(r"^\s*\{"), as_map).otherwise(F.array(json.cast("string")) if value_ddl == "string" else F.lit(None))


def entity_of(dims: Column) -> Column:
    """The value of the dimension that names a place: preferred names first, then any that sounds like one."""
    low = F.transform_keys(dims, lambda k, v: F.lower(k))
    named = [F.element_at(low, F.lit(k)) for k in ("ref_area", "reference_area", "country", "geo", "area", "economy", "location", "reporter")]
    other = F.map_values(F.map_filter(low, lambda k, v: k.rlike("country|area|geo")))
    return F.coalesce(*named, F.get(other, F.lit(0)))


def frequency_of(record: Column, dims: Column) -> Column:
    low = F.transform_keys(dims, lambda k, v: F.lower(k))
    return F.coalesce(record, F.element_at(low, F.lit("freq")), F.element_at(low, F.lit("frequency")))


def english(names: Column) -> Column:
    """The English one of ``array<struct<lang,text>>``, else the first."""
    return F.coalesce(F.get(F.filter(names, lambda n: F.startswith(F.coalesce(n["lang"], F.lit("en")), F.lit("en"))), F.lit(0))["text"], F.get(names, F.lit(0))["text"])


def first_metadata(metadata: Column, *keys: str) -> Column:
    """First non-empty value of ``map<string,array<struct<value>>>`` under the keys in turn."""
    return F.coalesce(*[F.nullif(F.get(F.element_at(metadata, F.lit(k)), F.lit(0))["value"], F.lit("")) for k in keys])


def all_metadata(metadata: Column, *keys: str) -> Column:
    found = [F.coalesce(F.transform(F.element_at(metadata, F.lit(k)), lambda x: x["value"]), F.array().cast("array<string>")) for k in keys]
    return F.array_distinct(F.filter(F.concat(*found), lambda v: v.isNotNull() & (v != "")))


def series_key(dims: Column, order: list[str]) -> Column:
    return F.array_join(F.transform(F.array(*[F.lit(d) for d in order]), lambda d: F.coalesce(F.element_at(dims, d), F.lit(""))), ".")


def headline_amount(*amounts: Column) -> Column:
    """First that is neither null nor zero."""
    return F.coalesce(*[F.nullif(a, F.lit(0)) for a in amounts])


def public_columns(columns: list[str]) -> list[str]:
    return [c for c in columns if not c.startswith("_")]


def json_probe(c: Column, pattern: str) -> Column:
    """First match of a pattern anywhere in a JSON text."""
    return F.nullif(F.regexp_extract(c, pattern, 0), F.lit(""))
