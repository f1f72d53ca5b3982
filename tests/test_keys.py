"""Keys, labels, dedup, rules."""

import re
import warnings

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from moltabula.constants import HELPER_VALUES
from moltabula.functions.labels import decode_label, encode_label, ensure_label_name
from moltabula.functions.text import contains_any, normalize_key
from moltabula.operators import dedup, rowfn, rules
from moltabula.plans import pipelines


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_normalize_key(spark):
    cases = [(None, None), ("", None), ("  ", None), (" C[C@H]O ", "C[CH]O"), ("C/C=C/C", "CC=CC"),
             ("C=C\\C", "C=CC"), ("@ @", None), ("a \t\n b", "a b")]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, s string")
    got = dict(df.select("i", normalize_key(F.col("s"))).collect())
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]


def test_labels(spark):
    df = spark.createDataFrame([("PKS",), ("bio",), (None,)], "source string")
    got = df.select(encode_label(F.col("source")).alias("y"), "source").select("y", decode_label(F.col("y"))).collect()
    assert [tuple(r) for r in got] == [(1, "PKS"), (0, "non-PKS"), (0, "non-PKS")]
    assert [r["is_pks"] for r in ensure_label_name(df).collect()] == ["PKS", "non-PKS", "non-PKS"]
    kept = ensure_label_name(df.withColumn("is_pks", F.lit("x")))
    assert {r["is_pks"] for r in kept.collect()} == {"x"}
    with pytest.raises(ValueError):
        ensure_label_name(df.select(F.lit(1).alias("other")))


def test_forbidden(spark):
    df = spark.createDataFrame([("C@",), ("C/",), ("C\\",), ("CC",)], "s string")
    assert rows(df.filter(~contains_any(F.col("s")))) == [("CC",)]


def test_compile_keeps_positive_copies(spark):
    data = [("C", "PKS"), ("C", "PKS"), ("CC", "bio"), ("CC", "chem"), ("C", "chem")]
    got = rows(dedup.compile_dedup(spark.createDataFrame(data, "smiles string, source string")))
    assert got == [("C", "PKS"), ("C", "PKS"), ("C", "chem"), ("CC", "bio")]


def test_compile_molecules_drops_invalid(spark):
    make = lambda *v: spark.createDataFrame([(x,) for x in v], "smiles string")
    got = rows(pipelines.compile_molecules({"PKS": make("C", " C@"), "bio": make("", None, "N"), "chem": make("N")}))
    assert got == [("C", "PKS"), ("C", "PKS"), ("N", "bio")]


def test_first_seen_last_wins(spark):
    data = [(1, 1, "x"), (1, 2, "y"), (2, 1, "y"), (2, 2, "z"), (3, 1, "x")]
    got = dedup.first_seen_last_wins(spark.createDataFrame(data, "d int, m int, p string"), "d", "p", ["m"])
    assert rows(got) == [(1, "y", 2), (2, "z", 1)]
    assert sum(r["n_counted"] for r in got.collect()) == 3


def test_exclusions(spark):
    df = spark.createDataFrame([("S",), ("O=C=O",), ("CO",), ("",), ("CCC",), (None,)], "p string")
    assert rows(dedup.exclude_values(df, "p", ("S", "O=C=O"), drop_blank=False)) == [("",), ("CCC",), ("CO",)]
    assert rows(dedup.exclude_values(df, "p", HELPER_VALUES)) == [("CCC",)]
    unwanted = spark.createDataFrame([("S",), (None,)], "u string")
    assert dedup.exclude_table(df, "p", unwanted, "u").count() == 5
    assert dedup.restrict_to(df, "p", None, "u").count() == 6
    assert rows(dedup.restrict_to(df, "p", unwanted, "u")) == [("S",)]


def test_drop_failed_counts_on_the_same_pass(spark):
    seen = Observation("failed")
    df = spark.createDataFrame([(1,), (None,), (3,)], "v int")
    assert dedup.drop_failed(df, "v", seen).count() == 2
    assert seen.get == {"n_seen": 3, "n_failed": 1}


def test_rewrite_one_site_at_a_time(spark):
    df = spark.createDataFrame([("CSCS",), ("CCC",), ("SX",)], "s string")
    made = rules.apply_rules(df, "s", [rules.Rule("r", "S", "[O]")])
    assert rows(made.select("s", "site", "product")) == [
        ("CSCS", 0, "C[O]CS"), ("CSCS", 1, "CSC[O]"), ("SX", 0, "[O]X")]


def test_empty_matches_are_sites(spark):
    df = spark.createDataFrame([("abc",), ("",), ("b",), ("xyz",)], "s string")
    for pattern, swap in (("b*", "Z"), ("(?=c)", "-"), ("$", "!"), ("[ab]", "Q"), ("q", "Q")):
        want = sorted((t, t[:m.start()] + swap + t[m.end():]) for t in ("abc", "", "b", "xyz") for m in re.finditer(pattern, t))
        got = sorted((r["s"], r["product"]) for r in rules.apply_rules(df, "s", [rules.Rule("r", pattern, swap)]).collect())
        assert got == want


def test_chain_stops_after_a_rule_without_match(spark):
    df = spark.createDataFrame([("ab",), ("b",)], "s string")
    steps = [rules.Rule("one", "a", "x"), rules.Rule("two", "b", "y")]
    assert rows(rules.apply_rules(df, "s", steps, chain=True).select("s", "rule", "product")) == [
        ("ab", "one", "xb"), ("ab", "two", "ay")]
    assert rows(rules.rule_counts(df, "s", steps)) == [("one", 1, 1), ("two", 2, 0)]


def test_expand_one_step(spark):
    df = spark.createDataFrame([("CO",), ("CO",), ("CS",)], "s string")
    step = [rules.Rule("r", "S", "O")]
    assert rows(rules.expand_one_step(df, "s", step)) == [("CO",), ("CS",)]
    assert rows(rules.expand_one_step(df, "s", step, exclude=("CO",), keep_input=False)) == []


def test_release_takes_first_seen_products(spark):
    designs = spark.createDataFrame([("d1", "A*B"), ("d2", "A*B"), ("d3", "*")], "design string, bound string")
    got = pipelines.release(designs, "bound", "design", [rules.Rule("cut", r"\*", "O"), rules.Rule("ring", r"\*", "N")])
    assert rows(got.select("design", "product")) == [("d1", "ANB"), ("d3", "N")]


def test_enumerate_designs(spark):
    starters = spark.createDataFrame([("s",), ("t",)], "s string")
    modules = spark.createDataFrame([("a",), ("b",)], "m string")
    made = rules.enumerate_designs(starters, "s", modules, "m", (1, 3))
    assert made.count() == 2 * 2 + 2 * 8 and made.distinct().count() == 20
    alike = lambda s, m: F.size(F.array_distinct(m)) == 1
    assert rules.enumerate_designs(starters, "s", modules, "m", (1, 2, 3), alike).count() == 12
    with pytest.raises(ValueError):
        rules.enumerate_designs(starters, "s", modules, "m", (3,), limit=10)


def test_map_rows(spark):
    df = spark.range(6)

    def fn(row):
        if row["id"] == 1:
            raise ValueError
        return None if row["id"] == 2 else [{"v": row["id"]}] * (row["id"] % 3)

    assert rows(rowfn.map_rows(df, fn, "v bigint")) == [(4,), (5,), (5,)]
    with pytest.raises(Exception):
        rowfn.map_rows(df, fn, "v bigint", on_error="raise").collect()


def test_split_warning(spark):
    few = spark.createDataFrame([(f"p{i}", "PKS") for i in range(9)] + [(f"n{i}", "bio") for i in range(100)],
                                "smiles string, source string")
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        counts = dict(pipelines.split_molecules(few, warn=True).groupBy("split").count().collect())
    assert caught and counts == {"train": 87, "val": 11, "test": 11}
