import pytest
from pyspark.sql import functions as F

from tessera.functions import ranges as R
from tessera.functions import text as X
from tessera.functions import vectors as V


def one(spark, column, **values):
    names = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    df = spark.createDataFrame([tuple(v for _, v in values.values())], names) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def plain(ranges):
    return [(r["start"], r["end"]) for r in ranges]


def test_tokens_keep_runs_of_one_script(spark):
    assert one(spark, X.tokens(F.lit("Bach3 노래는 a-B12"))) == ["bach", "3", "노래는", "a", "b", "12"]


def test_document_tokens_strip_particles_and_add_variants(spark):
    assert one(spark, X.document_tokens(F.lit("반주는 p x 7 딕션을"))) == ["반주", "p", "7", "발음"]
    assert one(spark, X.variants(F.lit("포렐레"))) == ["포렐레", "포렐", "렐레"]
    assert one(spark, X.variants(F.lit("trout"))) == ["trout"]


def test_query_tokens_are_distinct_and_stemmed(spark):
    got = one(spark, X.query_tokens(F.lit("호흡하려면 호흡 정말"), ("정말",)))
    assert got == [["호흡"]]


@pytest.mark.parametrize(
    ("concept", "known", "expected"),
    [("발음", ["발음법"], True), ("발음", ["발"], False), ("trout", ["trouts"], True), ("tro", ["trout"], False), ("trout", ["troutfishes"], False), ("x", ["x"], True)],
)
def test_concept_matches(spark, concept, known, expected):
    assert one(spark, X.concept_matches(F.lit(concept), F.array(*map(F.lit, known)))) is expected


def test_coverage_of_nothing_is_zero_and_not_covered(spark):
    none = F.array().cast("array<string>")
    assert one(spark, X.coverage(none, F.array(F.lit("a")))) == 0.0
    assert one(spark, X.all_covered(none, F.array(F.lit("a")))) is False


def test_alias_score(spark):
    aliases = F.array(F.array(F.lit("trout"), F.lit("brook")), F.array(F.lit("river")))
    assert one(spark, X.alias_score(F.array(F.lit("trout")), aliases)) == 0.5
    assert one(spark, X.alias_score(F.array(F.lit("stone")), aliases)) == 0.0


def test_hash_mod_is_that_of_the_digest(spark):
    assert one(spark, X.hash_mod(F.lit("abc"), F.lit(7))) == 2


def test_screen_form_drops_invisible_characters(spark):
    assert one(spark, X.screen_form(F.col("t")), t=("string", "Ig​NORE   ＡＬＬ\x07 Straße")) == "ignore all strasse"
    assert one(spark, X.screen_form(F.col("t")), t=("string", None)) is None


def test_json_strings_walks_keys_and_values(spark):
    assert one(spark, X.json_strings(F.col("t")), t=("string", '{"a": ["b", {"c": 1}]}')) == ["a", "b", "c"]
    assert one(spark, X.json_strings(F.col("t")), t=("string", "no json")) == ["no json"]


def test_canonical_hash_ignores_key_order(spark):
    a = one(spark, X.canonical_sha256(F.col("t")), t=("string", '{"b": 1, "a": 2}'))
    assert a == one(spark, X.canonical_sha256(F.col("t")), t=("string", '{"a":2,"b":1}')) and a.startswith("sha256:")


def test_untrusted_json_hides_delimiters(spark):
    got = one(spark, X.untrusted_json(F.struct(F.lit("<|end|> [INST]").alias("t"), F.lit(None).cast("string").alias("n"))))
    assert "<" not in got and "[INST]" not in got and '"n":null' in got


def test_strip_thinking_and_translation(spark):
    assert one(spark, X.strip_thinking(F.lit("<think>a\nb</think> yes"))) == "yes"
    assert one(spark, X.strip_thinking(F.lit("left over</think> yes <think>open"))) == "yes"
    assert one(spark, X.clean_translation(F.lit('\n  Translation: "숨을 쉬어요"\nmore'))) == "숨을 쉬어요"


def test_range_parsing_and_its_errors(spark):
    assert plain(one(spark, R.parsed(F.col("t")), t=("string", "1, 3 - 5, 7–9"))) == [(1, 1), (3, 5), (7, 9)]
    assert one(spark, R.parsed(F.col("t")), t=("string", "  ")) == []
    for wrong in ("0", "5-3", "a", "1,,2"):
        with pytest.raises(Exception, match="not a range"):
            one(spark, R.parsed(F.col("t")), t=("string", wrong))


def ranges(*pairs):
    return F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in pairs)) if pairs else F.array().cast(R.RANGES)


def test_merging_touching_and_adjoining(spark):
    r = ranges((4, 6), (1, 2), (3, 3), (6, 9))
    assert plain(one(spark, R.merged(r, 0))) == [(1, 2), (3, 3), (4, 9)]
    assert plain(one(spark, R.merged(r, 1))) == [(1, 9)]
    assert one(spark, R.merged(ranges(), 1)) == []


def test_cover_chains_adjoining_ranges(spark):
    assert one(spark, R.covers(ranges((1, 3), (4, 8)), ranges((2, 7)))) is True
    assert one(spark, R.covers(ranges((1, 3), (5, 8)), ranges((2, 7)))) is False
    assert one(spark, R.covers(ranges(), ranges())) is True


def test_scope_labels(spark):
    here, away, none = ranges((4, 6)), ranges((9, 9)), ranges()
    label = lambda r, s, q: one(spark, R.scope_label(r, F.lit(s).cast("string"), q))
    assert [label(here, "specific", none), label(none, None, none), label(none, "unspecified", none)] == ["local_example", "general_evidence", "unspecified_scope"]
    assert [label(here, None, here), label(here, None, away), label(none, None, away), label(here, "unspecified", here)] == ["overlaps_query_range", "other_range_context", "global_context", "unspecified_context"]


def test_boost_of_recurring_and_final(spark):
    boost = lambda r, scope, final, q: one(spark, R.scope_boost(r, F.lit("specific"), F.lit(scope), F.lit(final), q))
    assert boost(ranges((1, 2)), "recurring", False, ranges((2, 2))) == 6.0
    assert boost(ranges((1, 2)), "local", True, ranges()) == 1.0
    assert boost(ranges((1, 2)), "local", False, ranges()) == 0.75


def test_format(spark):
    assert one(spark, R.formatted(ranges((5, 5), (2, 4)))) == "5, 2-4"
    assert one(spark, R.formatted(ranges())) == "general / no specific measure"


def test_wilson_of_none_is_null(spark):
    low, high = V.wilson(F.lit(0), F.lit(0))
    assert one(spark, low) is None and one(spark, high) is None
    low, high = V.wilson(F.lit(1), F.lit(2))
    assert 0.09 < one(spark, low) < 0.1 and 0.9 < one(spark, high) < 0.91


def test_unit_refuses_zero(spark):
    assert one(spark, V.unit(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8]
    with pytest.raises(Exception, match="no direction"):
        one(spark, V.unit(F.col("v")), v=("array<double>", [0.0]))
