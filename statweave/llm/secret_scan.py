"""Secret scans with multipart credential linking; built-in expressions only.

Strong spans stand alone: assigned secrets, access identifiers and long hexadecimal strings. Weak candidates are
parts of credentials that mean little by themselves: login names, opaque strings and endpoints. A weak candidate
is reported only when a complementary part lies in its scope, that is, the intervals are at most ``SCOPE`` code
points apart in the same text: a strong part of another role, or weak parts of both other roles. Roles are
identifier (access, login), secret (assign, hex, opaque) and endpoint. Weak candidates that overlap a strong span
are dropped.

Matches of a pattern come from the text's matches and the gaps between them, whose running lengths are the places.
The interval join runs inside a row, over the row's spans in order of their starts: running maxima tell the last end of
the parts of a sort so far, running minima from behind the next start. They take a pass over the array for each doubling
of its length, so nothing is shuffled and the work grows with n log n of a row's spans, not with their pairs. Places are code points from 0, ends exclusive. Null texts are empty and have no spans; equal rows give equal results; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCOPE = 200


class Kind(NamedTuple):
    name: str
    pattern: str
    role: str
    value: int = 0
    least: int = 0


#: The base kinds' patterns, in the order in which equal starts are listed.
STRONG = (
    Kind("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "secret", 2, 6),
    Kind("access", r"AKIA[A-Z0-9]{16,}", "identifier"),
    Kind("hex", r"[0-9a-f]{24,}", "secret"),
)
#: The weak candidates.
WEAK = (
    Kind("login", r"""([Uu][Ss][Ee][Rr]|[Uu][Ss][Ee][Rr][Nn][Aa][Mm][Ee]|[Ll][Oo][Gg][Ii][Nn]|[Aa][Cc][Cc][Oo][Uu][Nn][Tt])["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)""", "identifier", 2, 3),
    Kind("opaque", r"[A-Za-z0-9+/]{32,}", "secret"),
    Kind("endpoint", r"[Hh][Tt][Tt][Pp][Ss]?://[A-Za-z0-9.-]+(:[0-9]+)?", "endpoint"),
)
FIELDS = "start:int,rank:int,end:int,kind:string,value:string"
SPAN = f"array<struct<{FIELDS}>>"
KINDS = STRONG + WEAK
#: A place after all others.
BEYOND = 2**31 - 1 - SCOPE
#: Code points of a piece of text that is cut by places.
PIECE = 4096


def running(rows: Column, values: dict[str, object], join) -> Column:
    """Running results of ``join`` (sum, greatest, least) over the values of an array's items, as an array of structs."""
    start = F.transform(rows, lambda x: F.struct(*[value(x).alias(name) for name, value in values.items()]))
    passes = F.filter(F.transform(F.sequence(F.lit(0), F.lit(30)), lambda i: F.pow(F.lit(2), i).cast("int")), lambda back: back < F.size(rows))

    def one(now: Column, back: Column) -> Column:
        def joined(x: Column, i: Column) -> Column:
            earlier = F.get(now, i - back)
            return F.when(i >= back, F.struct(*[join(x[n], earlier[n]).alias(n) for n in values])).otherwise(x)

        return F.transform(now, joined)

    return F.aggregate(passes, start, one)


def given(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def found(text: Column, kind: Kind, rank: int) -> Column:
    """Spans of a kind: leftmost matches without overlap, those with a short value dropped afterwards."""
    p = F.lit(kind.pattern)
    whole = F.regexp_extract_all(text, p, F.lit(0))
    values = F.regexp_extract_all(text, p, F.lit(kind.value)) if kind.value else whole
    parts = F.arrays_zip(F.split(text, kind.pattern, -1).alias("gap"), whole.alias("all"), values.alias("value"))

    def spans(parts: Column) -> Column:
        def placed(ends: Column) -> Column:
            def span(x: Column, i: Column) -> Column:
                end = F.get(ends, i)["end"]
                return F.struct((end - F.length(x["all"])).alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind.name).alias("kind"), x["value"].alias("value"))

            return F.filter(F.transform(parts, span), lambda x: F.length(x["value"]) >= kind.least)

        return given(running(parts, {"end": lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["all"]), F.lit(0))}, lambda a, b: a + b), placed)

    return F.when(text.rlike(kind.pattern), given(parts, spans)).otherwise(F.array().cast(SPAN))


def linked(spans: Column) -> Column:
    """Of sorted spans the strong ones and the weak ones with complementary parts in their scope, sorted.

    Of two spans the one with the later start is near if it starts at most SCOPE after the other's end, so the next
    start of a sort of parts tells whether a later one is near, and the last end whether an earlier one is. A span's
    own sort is never asked for, so the running values may include the span itself.
    """
    strong = len(STRONG)

    def one_of(kinds: list[int]):
        return lambda x: x["rank"].isin(kinds)

    def ends(spans: Column, sorts: dict[str, list[int]]) -> Column:
        return running(spans, {n: (lambda x, k=k: F.when(one_of(k)(x), x["end"]).otherwise(-SCOPE - 1)) for n, k in sorts.items()}, F.greatest)

    def starts(spans: Column, sorts: dict[str, list[int]]) -> Column:
        return running(F.reverse(spans), {n: (lambda x, k=k: F.when(one_of(k)(x), x["start"]).otherwise(BEYOND)) for n, k in sorts.items()}, F.least)

    def clear(spans: Column) -> Column:
        firm = {"strong": list(range(strong))}

        def kept(x: Column) -> Column:
            def free(s: Column, i: Column) -> Column:
                return (s["rank"] < strong) | (F.get(x["ends"], i)["strong"] <= s["start"]) & (F.get(x["starts"], F.size(spans) - 1 - i)["strong"] >= s["end"])

            return F.filter(spans, free)

        return given(F.struct(ends(spans, firm).alias("ends"), starts(spans, firm).alias("starts")), kept)

    sorts = {f"{'strong' if k in STRONG else 'weak'}_{k.role}": [i for i, other in enumerate(KINDS) if other.role == k.role and (other in STRONG) == (k in STRONG)] for k in KINDS}

    def complemented(spans: Column) -> Column:
        def kept(x: Column) -> Column:
            def reported(s: Column, i: Column) -> Column:
                last, following = F.get(x["ends"], i), F.get(x["starts"], F.size(spans) - 1 - i)

                def near(sort: str) -> Column:
                    return (last[sort] + SCOPE >= s["start"]) | (following[sort] <= s["end"] + SCOPE)

                report = s["rank"] < strong
                for role in {k.role for k in WEAK}:
                    firm, others = F.lit(False), F.lit(True)
                    for sort in sorts:
                        if not sort.endswith(role):
                            firm, others = (firm | near(sort), others) if sort.startswith("strong") else (firm, others & near(sort))
                    report = report | s["rank"].isin(sorts[f"weak_{role}"]) & (firm | others)
                return report

            return F.filter(spans, reported)

        return given(F.struct(ends(spans, sorts).alias("ends"), starts(spans, sorts).alias("starts")), kept)

    return given(given(spans, clear), complemented)


def reported(rows: DataFrame) -> DataFrame:
    """``rows`` with ``spans``, all reported spans of the column ``text`` in order of start, then kind."""
    strong = F.sort_array(F.concat(*[found(F.col("text"), k, i) for i, k in enumerate(STRONG)]))
    weak = F.concat(*[found(F.col("text"), k, len(STRONG) + i) for i, k in enumerate(WEAK)])
    rows = rows.withColumns({"strong": strong, "weak": weak})
    return rows.withColumn("spans", F.when(F.size("weak") > 0, linked(F.sort_array(F.concat("strong", "weak")))).otherwise(F.col("strong"))).drop("weak")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, text, strong, spans): strong spans and all reported spans of each row, ordered by start, then kind."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").alias("doc_id"), text.alias("text"))
    return reported(rows).select("doc_id", "text", "strong", "spans")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each span replaced by ``mark``; overlapping spans become one.

    What stays is cut from pieces of PIECE code points, so no place is looked up from the start of a long text.
    """

    def cut(pieces: Column, low: Column, high: Column) -> Column:
        first, last = F.floor(low / PIECE).cast("int"), F.floor(high / PIECE).cast("int")
        head, tail = low - first * PIECE, high - last * PIECE

        def piece(i: Column) -> Column:
            return F.coalesce(F.get(pieces, i), F.lit(""))

        inside = F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        across = F.concat(F.substr(piece(first), head + 1), inside, F.substr(piece(last), F.lit(1), tail))
        return F.when(first == last, F.substr(piece(first), head + 1, high - low)).otherwise(across)

    def masked(x: Column) -> Column:
        def before(i: Column) -> Column:
            return F.coalesce(F.get(x["ends"], i - 1)["end"], F.lit(0))

        gaps = F.transform(x["spans"], lambda s, i: F.struct(before(i).alias("low"), s["start"].alias("high")))
        texts = F.transform(F.filter(gaps, lambda g: g["low"] <= g["high"]), lambda g: cut(x["pieces"], g["low"], g["high"]))
        return F.concat(F.array_join(texts, mark), F.lit(mark), cut(x["pieces"], before(F.size(x["spans"])), F.length(text)))

    parts = F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("pieces"), spans.alias("spans"), running(spans, {"end": lambda s: s["end"]}, F.greatest).alias("ends"))
    return F.when(F.size(spans) == 0, text).otherwise(given(parts, masked))


def masked_documents(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with the reported spans of each text masked, in its own columns; n_chars, if there, follows the text."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(row.alias("row"), text.alias("text"))
    rows = reported(rows)
    rows = rows.select("row", F.size("spans").alias("n"), redacted(F.col("text"), F.col("spans"), mark).alias("clean"))
    fields = {c: F.col("row").getField(c) for c in docs.columns}
    fields["text"] = F.when(F.col("n") == 0, fields["text"]).otherwise(F.col("clean"))
    if "n_chars" in fields:
        fields["n_chars"] = F.when(F.col("n") == 0, fields["n_chars"]).otherwise(F.length("clean").cast("long"))
    return rows.select(*[v.alias(c) for c, v in fields.items()])
