"""Text expressions: titles, DOIs, URLs, authors, slugs, quote normalisation. Built-in functions unless named ``*_udf``."""

from __future__ import annotations

import html
import re
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that join the parts of a broken word.
DASHES = "-­‐‑‒–—―−"
#: Name particles that belong to the surname that follows.
PARTICLES = ("da", "de", "del", "della", "der", "di", "dos", "du", "la", "le", "ten", "ter", "van", "von")
#: DOI prefixes of working-paper series.
SERIES = (("10.1596/1813-9450-", "Policy Research Working Paper"), ("10.3386/w", "NBER Working Paper"))
#: The five entities that markup must escape, and the no-break space.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


@cache
def _fold_tables() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Characters whose compatibility form without marks is one ASCII letter or digit, and ligatures of several."""
    source, target, several = [], [], []
    for i in range(0x80, 0x10000):
        if 0xD800 <= i < 0xE000:
            continue
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(i)) if not unicodedata.combining(c))
        if plain == chr(i) or not plain.isascii() or not plain.isalnum():
            continue
        if len(plain) == 1:
            source.append(chr(i))
            target.append(plain)
        elif unicodedata.name(chr(i), "").startswith("LATIN"):
            several.append((chr(i), plain))
    return "".join(source), "".join(target), tuple(several)


def fold(c: Column) -> Column:
    """ASCII base letters for accented and compatibility characters; combining marks go."""
    source, target, several = _fold_tables()
    folded = F.translate(F.regexp_replace(c, r"\p{Mn}+", ""), source, target)
    for a, b in several:
        folded = F.replace(folded, F.lit(a), F.lit(b))
    return F.when(c.rlike(r"[^\x00-\x7F]"), folded).otherwise(c)


def norm_title(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(fold(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", " "))


def norm_doi(c: Column) -> Column:
    bare = F.regexp_replace(F.trim(c), r"(?i)^(?:https?://)?(?:dx\.)?doi\.org/|^doi:\s*", "")
    return F.nullif(F.lower(F.trim(bare)), F.lit(""))


def clean(c: Column) -> Column:
    """Runs of white space as one blank."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^<>]{1,200}>", " ")


def clean_text(c: Column) -> Column:
    """Markup tags as blanks, the common entities resolved, white space collapsed."""
    out = strip_tags(F.coalesce(c, F.lit("")))
    for a, b in ENTITIES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return clean(out)


@F.pandas_udf(T.StringType())
def unescape_udf(texts: pd.Series) -> pd.Series:
    """All named and numeric entities."""
    return texts.map(lambda t: t if t is None or "&" not in t else html.unescape(t))


def snippet(c: Column, n: int = 300) -> Column:
    return F.left(clean(strip_tags(F.coalesce(c, F.lit("")))), F.lit(n))


def surname(name: Column) -> Column:
    """``Surname, First`` or the last word with the particles before it."""
    parts = F.split(clean(name), " ")
    walked = F.aggregate(
        F.reverse(parts),
        F.struct(F.lit("").alias("out"), F.lit(False).alias("done")),
        lambda s, w: F.when(s["out"] == "", F.struct(w.alias("out"), F.lit(False).alias("done")))
        .when(~s["done"] & F.lower(w).isin(*PARTICLES), F.struct(F.concat_ws(" ", w, s["out"]).alias("out"), F.lit(False).alias("done")))
        .otherwise(F.struct(s["out"].alias("out"), F.lit(True).alias("done"))),
        lambda s: s["out"],
    )
    return F.when(F.contains(name, F.lit(",")), F.trim(F.split_part(name, F.lit(","), F.lit(1)))).otherwise(walked)


def author_label(authors: Column) -> Column:
    first, second = surname(F.get(authors, F.lit(0))), surname(F.get(authors, F.lit(1)))
    n = F.size(authors)
    return F.when(n == 1, first).when(n == 2, F.concat(first, F.lit(" and "), second)).when(n > 2, F.concat(first, F.lit(" et al."))).otherwise(F.lit(""))


def short_title(c: Column, words: int = 10) -> Column:
    head = F.regexp_extract(clean(c), r"^(.*?)(?:[:–—]\s| - |$)", 1)
    parts = F.split(head, " ")
    return F.when(F.size(parts) > words, F.concat(F.array_join(F.slice(parts, 1, words), " "), F.lit("..."))).otherwise(head)


def series_from_doi(doi: Column) -> Column:
    out = F.lit(None).cast("string")
    for prefix, name in SERIES:
        number = F.regexp_extract(doi, "^" + re.escape(prefix) + r"(\d+)", 1)
        out = F.when(number != "", F.concat(F.lit(f"{name} "), number)).otherwise(out)
    return out


def url_part(u: Column, part: str) -> Column:
    """HOST or PATH of a URL; null if there is none."""
    pattern = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)" if part == "HOST" else r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
    return F.nullif(F.regexp_extract(u, pattern, 1), F.lit(""))


def looks_like_pdf(u: Column) -> Column:
    path = F.lower(F.coalesce(url_part(u, "PATH"), F.lit("")))
    return path.endswith(".pdf") | F.contains(path, F.lit("/pdf"))


def canonical_url(u: Column) -> Column:
    """Host in lower case and path, without scheme, query, closing slash or the numbered documents host."""
    host = F.regexp_replace(F.lower(F.coalesce(url_part(u, "HOST"), F.lit(""))), r"^documents1\.", "documents.")
    return F.concat(host, F.rtrim(F.coalesce(url_part(u, "PATH"), F.lit("")), F.lit("/")))


def https_upgrade(u: Column, domain: str = "worldbank.org") -> Column:
    return F.regexp_replace(u, r"^http://((?:[A-Za-z0-9-]+\.)*" + re.escape(domain) + r")(?=[/:?#]|$)", "https://$1")


def split_flow(c: Column) -> Column:
    """``agency,id,version`` or ``agency/id/version`` with defaults; a bare id has no agency."""
    p = F.split(c, "[,/]", 3)
    n = F.size(p)
    return F.struct(
        F.when(n > 1, F.get(p, F.lit(0))).alias("agency"), F.when(n > 1, F.get(p, F.lit(1))).otherwise(F.get(p, F.lit(0))).alias("id"), F.coalesce(F.nullif(F.get(p, F.lit(2)), F.lit("")), F.lit("latest")).alias("version")
    )


def split_series_id(c: Column) -> Column:
    """``provider/dataset/series``; the series keeps further slashes."""
    p = F.split(c, "/", 3)
    return F.struct(F.get(p, F.lit(0)).alias("provider"), F.get(p, F.lit(1)).alias("dataset"), F.get(p, F.lit(2)).alias("series"))


def split_values(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), lambda v: F.trim(v)), lambda x: x != "")


def safe_name(c: Column, longest: int | None = 120, mark: str = "-") -> Column:
    """A file stem; a name that is too long ends in its checksum."""
    kept = F.trim(F.regexp_replace(c, "[^A-Za-z0-9._-]+", mark), F.lit(mark + "."))
    if longest is None:
        return kept
    tail = F.lpad(F.lower(F.hex(F.crc32(c.cast("binary")))), 8, "0")
    return F.when(F.length(kept) > longest, F.concat(F.left(kept, F.lit(longest)), F.lit(mark), tail)).otherwise(kept)


def slug(c: Column, longest: int = 60, mark: str = "-") -> Column:
    return F.rtrim(F.left(F.trim(F.regexp_replace(F.lower(fold(c)), "[^a-z0-9]+", mark), F.lit(mark)), F.lit(longest)), F.lit(mark))


def normalize_quote(c: Column) -> Column:
    """Quote text: runs without letters or digits become one blank, or nothing if they hold a dash; lower case, folded."""
    inside = "[" + "".join(f"\\x{{{ord(d):x}}}" for d in DASHES) + "]"
    other = r"[^\p{L}\p{N}]*"
    out = F.regexp_replace(F.coalesce(c, F.lit("")), other + inside + other, "")
    return F.lower(fold(F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))))


def normalize_with_offsets(text: str) -> tuple[str, list[int]]:
    """The same in Python, with the place in ``text`` of each character of the result."""
    out: list[str] = []
    at: list[int] = []
    run, dash = False, False
    for i, c in enumerate(text):
        if c.isalnum():
            if run and out and not dash:
                out.append(" ")
                at.append(i - 1)
            run = dash = False
            for d in c.lower() if c.isascii() else unicodedata.normalize("NFKD", c).lower():
                if d.isalnum():
                    out.append(d)
                    at.append(i)
        else:
            run, dash = True, dash or c in DASHES
    return "".join(out), at


@F.pandas_udf(T.StructType([T.StructField("norm", T.StringType()), T.StructField("at", T.ArrayType(T.IntegerType()))]))
def normalize_offsets_udf(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([normalize_with_offsets(t or "") for t in texts], columns=["norm", "at"])


#: Abbreviations after which a full stop doesn't end a sentence.
ABBREVIATIONS = frozenset("al approx cf ch dr ed eds e.g eq etc fig figs i.e jr mr mrs ms no nos p pp prof sec sr st vol vs".split())


def sentence_around(text: str, start: int, end: int, longest: int = 480) -> str:
    """The sentence that holds ``text[start:end]``: between full stops, blank lines, or about the quote if too long."""
    ends = []
    for m in re.finditer(r"[.!?][\"')\]”’]*(?=\s)|\n\s*\n", text):
        word = re.search(r"([\w.]+)$", text[max(0, m.start() - 12) : m.start()])
        if m.group()[0] == "." and word and (word[1].lower() in ABBREVIATIONS or re.fullmatch(r"[A-Z]", word[1])):
            continue
        ends.append(m.end())
    a = max((e for e in ends if e <= start), default=0)
    b = min((e for e in ends if e >= end), default=len(text))
    if b - a > longest:
        spare = max(longest - (end - start), 0) // 2
        a, b = max(a, start - spare), min(b, end + spare)
    out = re.sub(r"(\w)[-­‐]\n\s*(\w)", r"\1\2", text[a:b])
    return re.sub(r"\s+", " ", out).strip()


@F.pandas_udf(T.StringType())
def sentence_udf(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    return pd.Series([sentence_around(t or "", int(a), int(b)) for t, a, b in zip(texts, starts, ends, strict=True)])


def odata_quote(c: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))


def plural(n: Column, one: str) -> Column:
    return F.concat(F.format_number(n, 0), F.lit(f" {one}"), F.when(n == 1, F.lit("")).otherwise(F.lit("s")))


#: Region codes that pass through, and two countries with codes of their own.
GEO_OWN = {"GR": "EL", "GB": "UK"}


def to_geo(token: Column, iso2: Column) -> Column:
    up = F.upper(F.trim(token))
    own = F.coalesce(*[F.when(iso2 == a, F.lit(b)) for a, b in GEO_OWN.items()], iso2, up)
    return F.when(up.isin("EL", "UK") | up.rlike("^(EU|EA|EFTA|EEA)"), up).otherwise(own)


def labelled_query(query: Column, filters: dict[str, Column]) -> Column:
    """The query text and ``name=value`` of each active filter, for a log."""
    return F.concat_ws(" | ", F.nullif(query, F.lit("")), *[F.when(v.isNotNull() & (v != ""), F.concat(F.lit(f"{k}="), v)) for k, v in filters.items()])


def hint(doi: Column, hints: dict[str, str]) -> Column:
    """Advice by DOI prefix; the first prefix that fits."""
    return F.coalesce(*[F.when(F.startswith(doi, F.lit(p)), F.lit(t)) for p, t in hints.items()], F.lit(None).cast("string"))


def mapped(c: Column, table: dict[str, str]) -> Column:
    """A label map; null where the value has none."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def id_kind(c: Column) -> Column:
    """Routes a paper's or document's identifier to what it is."""
    t = F.trim(c)
    return (
        F.when(t.rlike(r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:)?10\.\d{4,}/"), "doi")
        .when(t.rlike(r"^W\d+$"), "openalex")
        .when(t.rlike(r"^(?:arXiv:)?\d{4}\.\d{4,5}(?:v\d+)?$"), "arxiv")
        .when(t.rlike(r"^[0-9]{12,}$"), "guid")
        .when(t.rlike(r"^(?:wds:|D)?[0-9]+$"), "document")
        .when(t.rlike(r"^[0-9a-f]{40}$"), "s2")
        .otherwise("report")
    )
