import random

from pyspark.sql import functions as F

from statweave.functions import masks, nested, periods, text


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_titles_and_dois(spark):
    c = F.col("t")
    assert one(spark, text.norm_title(c), t="Économie: ﬁscal  Policy—Ångström!") == "economie fiscal policy angstrom"
    assert one(spark, text.norm_title(c), t="Straße ø") == "stra e"
    assert one(spark, text.norm_doi(c), t="https://doi.org/10.1596/ABC") == "10.1596/abc"
    assert one(spark, text.norm_doi(c), t="doi: 10.3386/W123") == "10.3386/w123"
    assert one(spark, text.norm_doi(c), t="") is None
    assert one(spark, text.series_from_doi(c), t="10.3386/w30000") == "NBER Working Paper 30000"
    assert one(spark, text.clean_text(c), t="<p>A &amp; B</p>\n c") == "A & B c"
    assert one(spark, text.short_title(c), t="Growth: a long story") == "Growth"


def test_names(spark):
    assert one(spark, text.surname(F.col("t")), t="Ludwig van Beethoven") == "van Beethoven"
    assert one(spark, text.surname(F.col("t")), t="Beethoven, Ludwig") == "Beethoven"
    three = F.array(F.lit("Ann Lee"), F.lit("Bo Sy"), F.lit("C D"))
    assert one(spark, text.author_label(three)) == "Lee et al."
    assert one(spark, text.author_label(F.slice(three, 1, 2))) == "Lee and Sy"


def test_urls_and_ids(spark):
    assert one(spark, text.canonical_url(F.col("t")), t="https://Documents1.worldbank.org/a/b/?x=1") == "documents.worldbank.org/a/b"
    assert one(spark, text.https_upgrade(F.col("t")), t="http://data.worldbank.org/x") == "https://data.worldbank.org/x"
    assert one(spark, text.https_upgrade(F.col("t")), t="http://example.org/x") == "http://example.org/x"
    assert one(spark, text.looks_like_pdf(F.col("t")), t="https://e.org/x.PDF?download=1") is True
    assert one(spark, text.safe_name(F.col("t"), 5), t="abcdefgh").startswith("abcde-")
    assert one(spark, text.slug(F.col("t"), 10, "_"), t="Été à Paris 2020") == "ete_a_pari"
    assert one(spark, text.split_values(F.col("t")), t="a, b,,c ") == ["a", "b", "c"]
    assert one(spark, text.id_kind(F.col("t")), t="10.1000/xyz") == "doi"


def test_normalised_quotes_agree_with_the_python_version(spark):
    random.seed(1)
    alphabet = "aB1é -–.,\n ﬁß("
    texts = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 30))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    rows = df.select("t", text.normalize_quote(F.col("t")).alias("a"), text.normalize_offsets_udf("t").alias("b")).collect()
    for r in rows:
        assert r["a"] == r["b"]["norm"]
        assert len(r["b"]["norm"]) == len(r["b"]["at"])


def test_sentences():
    t = "One here. We use data, e.g. from Fig. 2, with care. Next one."
    at = t.index("data")
    assert text.sentence_around(t, at, at + 4) == "We use data, e.g. from Fig. 2, with care."


def test_periods(spark):
    c = F.col("t")
    assert one(spark, periods.period_bound(c, end=True), t="2020-Q2") == "2020-06-31"
    assert str(one(spark, periods.date_bound(c, end=True), t="2020-02")) == "2020-02-29"
    assert one(spark, periods.iso_date(c), t="1-01-01") is None
    assert one(spark, periods.year_in_text(c), t="in 1998 and 2005") == 1998
    assert one(spark, periods.iso_month(c), t="January 2011") == "2011-01"
    assert one(spark, periods.version_key(c), t="1.10.x") == [1, 10, -1]
    assert one(spark, periods.amount(c), t="12.9") == 12
    assert one(spark, periods.period_tag(F.lit("2015"), F.lit(None).cast("string"))) == "from2015"


def test_masks(spark):
    import pytest

    df = spark.createDataFrame([("A", "X"), ("B", "X"), ("C", "Y")], "a string, b string")
    keep = lambda m: {r["a"] for r in df.where(masks.series_mask([F.col("a"), F.col("b")], m)).collect()}
    assert keep("A+B.") == {"A", "B"} and keep(".Y") == {"C"} and keep("all") == {"A", "B", "C"} and keep("A") == {"A"}
    with pytest.raises(ValueError):
        masks.series_mask([F.col("a")], "A.B")
    column, sent = masks.odata_filter({"a": ["A", "it's"]}, low={"b": "X"})
    assert sent == "(a eq 'A' or a eq 'it''s') and b ge X"
    assert df.where(column).count() == 1


def test_nested(spark):
    assert one(spark, nested.inverted_to_text(F.from_json(F.col("j"), "map<string,array<int>>")), j='{"b":[1],"a":[0,2]}') == "a b a"
    assert one(spark, nested.packed_list(F.col("j")), j='{"0":"x","1":"y"}') == ["x", "y"]
    assert one(spark, nested.packed_list(F.col("j")), j='["x"]') == ["x"]
    assert one(spark, nested.entity_of(F.create_map(F.lit("GEO"), F.lit("FR")))) == "FR"
    assert one(spark, nested.headline_amount(F.lit(0), F.lit(None).cast("int"), F.lit(5))) == 5
