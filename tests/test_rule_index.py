"""The index of rules against the rules applied one by one."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from moltabula.operators import rule_index, rules

PATTERNS = ["b", "b*", "a|b", "[ab]c", "(a)b", "ab?c", "a.c$", "^ab", "x{2}y", "a+?b", "[^a]b", "\\.b", "[a[b]c]", "é+", "😀", "", "a||b", "a{0}b", "b{1,2}c", "[]a]b", "zz"]
TEXTS = ["abc", "", "bbb", "ac.b", "xxy", "ébé", "a😀b", None, "abc abc", "q" * 5000 + "abc"]


def test_same_rows_as_one_by_one(spark):
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS + TEXTS)], "i int, t string, rules int").repartition(3)
    own = [rules.Rule(f"r{i % 4}", p, "<>") for i, p in enumerate(PATTERNS)]
    got = sorted(tuple(r) for r in rule_index.apply_indexed(df, "t", own).collect())
    assert got == sorted(tuple(r) for r in rules.apply_rules(df, "t", own).collect()) and got


@settings(max_examples=400, deadline=None)
@given(st.text("ab.|[]^?*+{}12$", max_size=8), st.text("ab12", max_size=10))
def test_every_match_holds_a_required_text(pattern, text):
    texts = rule_index.required_texts(pattern)
    try:
        found = re.search(pattern, text, re.S)
    except (re.error, RecursionError):
        return
    if texts and found:
        assert any(t in text for t in texts)


def test_required_texts():
    known = {"gear": ("gear",), "[a-z]+ gear$": (" gear",), "bolt|ring": ("bolt", "ring"), "ab?cd": ("cd",), "a*": None, "(gear)": None, "": None, "x|": None, "a{0}bc": ("bc",)}
    assert {p: rule_index.required_texts(p) for p in known} == known


def test_only_rules_that_may_match_are_met(spark):
    many = [(i, f"r{i}", f"part{i:05d}", "x") for i in range(5000)]
    df = spark.createDataFrame([(f"part{i:05d}",) for i in range(300)], "t string")
    met = df.select(rule_index._candidates(many)("t").alias("m")).selectExpr("max(size(m)) AS n").first().n
    assert met == 1


def test_bounds_and_missing_values(spark, monkeypatch):
    df = spark.createDataFrame([("ab",), (None,)], "t string")
    table = spark.createDataFrame([(0, "r", None, "x"), (1, "s", "a", None), (2, None, "b", "x"), (None, "n", "a", "y")], rule_index.RULE)
    got = {tuple(r) for r in rule_index.apply_indexed(df, "t", table).collect()}
    assert got == {("ab", 2, None, 0, "ax"), ("ab", None, "n", 0, "yb")}
    assert rule_index.apply_indexed(df, "t", table.limit(0)).count() == 0
    assert rule_index.apply_indexed(df.limit(0), "t", table).count() == 0
    with pytest.raises(ValueError):
        rule_index.apply_indexed(df, "t", [])
    monkeypatch.setattr(rule_index, "INDEX_BYTES", 100)
    with pytest.raises(ValueError, match="bytes"):
        rule_index.apply_indexed(df, "t", table)


def test_bodies(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None), (3, "")], "i int, t string")
    got = rule_index.apply_bodies(df, "t", {"first": lambda t: [t[0], None], "both": lambda t: [t, t + t]}).collect()
    assert sorted(map(tuple, got)) == [
        (1, "ab", 0, "first", 0, "a"), (1, "ab", 1, "both", 0, "ab"), (1, "ab", 1, "both", 1, "abab"), (3, "", 1, "both", 0, ""), (3, "", 1, "both", 1, "")]
    with pytest.raises(ValueError):
        rule_index.apply_bodies(df, "t", {})
