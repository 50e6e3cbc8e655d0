import pytest
from pyspark.sql import functions as F

from vectorscape.functions import text as T
from vectorscape.functions.tonal import encode_key, entropy_bits, quadrant, scale_alignment
from vectorscape.operators.tags import npmi, with_top_tags


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


def s(v):
    return F.lit(v).cast("string")


@pytest.mark.parametrize(
    ("tags", "weights", "expected"),
    [("A, b,a", "3,3,1", ["a", "b"]), ("A, b,a", "3,x,3", ["a"]), ("A, b,a", "1,2", ["a", "b"]), ("A, b,a", "", ["a", "b"]), ("A, b,a", None, ["a", "b"]), ("A, b", "1.5,2", ["b"]), (None, "1", []), (" , ", "1,2", [])],
)
def test_top_weight_tags(spark, tags, weights, expected):
    assert one(spark, T.top_weight_tags(s(tags), s(weights))) == expected


def test_missing_columns(spark):
    df = spark.createDataFrame([("B, a",)], "genre string")
    r = with_top_tags(df).first()
    assert (r.top_k_genre, r.top_k_mood) == (["b", "a"], [])


def test_cleaning_trims_all_white_space(spark):
    assert one(spark, T.clean_tag_list(F.array(*map(F.lit, [" Happy", "happy ", "", "Sad\t"])))) == ["happy", "sad"]
    assert one(spark, T.parse_tags(s(" a ,,A, a"))) == ["a", "A", "a"]


def test_categories(spark):
    assert one(spark, T.consolidate(F.array(*map(F.lit, ["Pop/Rock", "Rap", "Holiday", "Rap"])))) == ["Rock/Pop", "Hip-Hop/Rap"]
    assert one(spark, T.consolidate(F.array(F.lit("pop/rock")), ignore_case=True)) == ["Rock/Pop"]
    assert one(spark, T.has_valid_category(F.array(F.lit("Polka")))) is True
    assert one(spark, T.has_valid_category(T.parse_tags(s("Holiday,")))) is False
    assert one(spark, T.has_valid_category_text(s("Holiday,"))) is True


def test_labels(spark):
    labels = {"T1": ["joy"], "T2": ["club"]}
    given = [(["joy", "club"], "T1,T2"), (["joy", "zzz"], "T0,T1"), ([], "")]
    for tags, expected in given:
        assert one(spark, T.assign_labels(F.array(*map(F.lit, tags)).cast("array<string>"), labels)) == expected


def test_npmi(spark):
    def value(*n, **how):
        return one(spark, npmi(*map(F.lit, n), **how))

    assert value(4, 5, 3, 10) == pytest.approx(0.336773, abs=1e-6)
    assert value(0, 5, 3, 10) == 0.0
    assert value(5, 5, 5, 5, on_degenerate="null") is None
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        value(5, 5, 5, 5)


def test_tonal(spark):
    flat = F.array(*[F.lit(1.0)] * 12)
    assert one(spark, entropy_bits(flat)) == pytest.approx(3.584963, abs=1e-6)
    assert one(spark, scale_alignment(flat)) == pytest.approx(0.583333, abs=1e-6)
    g = one(spark, encode_key(F.lit("G"), F.lit("minor")))
    assert (round(g.key_cos, 6), round(g.key_sin, 6), g.is_minor) == (-0.866025, -0.5, 1.0)
    assert one(spark, encode_key(F.lit("Bb"), F.lit("major"))).key_cos == 1.0
    for (a, v), q in {(0.0, 0.0): 1, (0.0, -1.0): 2, (-1.0, -1.0): 3, (-1.0, 0.0): 4}.items():
        assert one(spark, quadrant(F.lit(a), F.lit(v))) == q


def test_required_raises(spark):
    assert one(spark, T.required(s(" a "), "x")) == "a"
    with pytest.raises(Exception, match="missing value in x"):
        one(spark, T.required(s(" "), "x"))
    assert one(spark, T.parse_float(s("1.5x"), 0.5)) == 0.5
