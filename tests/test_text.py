import pytest
from pyspark.sql import functions as F

from pairmend.functions.colors import PROTOTYPES, nearest_color
from pairmend.functions.text import canonical_text, clean, first_color, is_text_missing, json_map, resolve_path, text_color
from pairmend.functions.vectors import cosine, fit, normalize


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(make(F.col("c")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("given", "want"),
    [
        (None, {}), ("", {}), ("  ", {}), ("{bad", {}), ("[1, 2]", {}), ("3", {}), ('"x"', {}), ("{}", {}),
        (' {"a": "1", "b": 2} ', {"a": "1", "b": "2"}), ('{"b": 1, "a": 2, "b": 3}', {"b": "3", "a": "2"}), ('{"color": null}', {"color": None}),
        ('{"é": true, "l": ["a", 1]}', {"é": "true", "l": '["a",1]'}),
    ],
)
def test_json_map(spark, given, want):
    assert one(spark, given, json_map) == want
    assert one(spark, given, lambda c: F.map_keys(json_map(c))) == list(want)


def test_clean_takes_unicode_space(spark):
    assert one(spark, "  a b\t ", clean) == "a b"
    assert one(spark, None, clean) == ""


def test_canonical_text(spark):
    text = lambda c: canonical_text(F.lit("T"), F.lit("C"), json_map(c))
    assert one(spark, '{"b": 1, "a": null}', text) == "T. Category: C. Attributes: b=1, a=None."
    assert one(spark, "", text) == "T. Category: C. Attributes: ."


def test_text_missing_needs_both(spark):
    rows = spark.createDataFrame([("", "{}"), ("", '{"a": 1}'), ("t", "{}")], "t string, a string")
    got = [r[0] for r in rows.select(is_text_missing(F.col("t"), json_map("a"))).collect()]
    assert got == [True, False, False]


@pytest.mark.parametrize(("title", "want"), [("red and black cat", "black"), ("Redish coat", ""), ("A RED hat", "red"), (None, ""), ("rouge-red", "red"), ("éred", "")])
def test_first_color_goes_by_list_order(spark, title, want):
    assert one(spark, title, first_color) == want


def test_text_color_prefers_attribute(spark):
    color = lambda c: text_color(json_map(c), F.lit("blue shoe"))
    assert one(spark, '{"color": " Red "}', color) == "red"
    assert one(spark, '{"color": ""}', color) == "blue"
    assert one(spark, '{"color": null}', color) == "none"
    assert one(spark, "{}", color) == "blue"


def test_resolve_path(spark):
    path = lambda c: resolve_path("/root/x/", c)
    assert one(spark, "a/b.jpg", path) == "/root/x/a/b.jpg"
    assert one(spark, "/a", path) == "/a" and one(spark, "s3://a", path) == "s3://a"


def test_nearest_color_names_its_prototypes(spark):
    rows = spark.createDataFrame([(n, *p) for n, p in PROTOTYPES.items()], "n string, r int, g int, b int")
    assert all(r["n"] == r["x"] for r in rows.select("n", nearest_color(F.col("r"), F.col("g"), F.col("b")).alias("x")).collect())
    assert rows.select(nearest_color(F.lit(None).cast("int"), F.col("g"), F.col("b")).alias("x")).first()["x"] is None


def test_vectors(spark):
    v = "array<float>"
    assert one(spark, [3.0, 4.0], lambda c: cosine(c, c), v) == pytest.approx(1.0)
    assert one(spark, [0.0, 0.0], lambda c: cosine(c, c), v) == 0.0
    assert one(spark, None, lambda c: cosine(c, c), v) is None
    assert one(spark, [float("nan"), 1.0], lambda c: cosine(c, c), v) is None
    assert one(spark, [3.0, 4.0], normalize, v) == pytest.approx([0.6, 0.8])
    assert one(spark, [1.0, 2.0, 3.0], lambda c: fit(c, 2), v) == [1.0, 2.0]
    assert one(spark, [1.0], lambda c: fit(c, 3), v) == [1.0, 0.0, 0.0]
    assert one(spark, None, lambda c: fit(c, 2), v) == [0.0, 0.0]
