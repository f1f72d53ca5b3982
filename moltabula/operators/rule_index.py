"""Many rewrite rules at once: a row meets only rules whose required text it holds.

Most patterns cannot match without some plain text, ``"gear"`` in ``"[a-z]+ gear$"``. One automaton over these texts finds in a single pass over a
row which rules may match it. Patterns without such a text meet every row. The rules found are then applied as ``rules.apply_rules`` does it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moltabula.operators.rowfn import map_rows
from moltabula.operators.rules import Rule, rewrite_sites, rule_table

INDEX_BYTES = 64 << 20  # of all rules, which every task holds
RULE = "rule_order int, rule string, pattern string, replacement string"
_CLASS = re.compile(r"\[\^?[^\]\[&\\]+\]")
_OPTIONAL = re.compile(r".(?:[?*]|\{[^}]*\})", re.S)


def required_texts(pattern: str) -> tuple[str, ...] | None:
    """Texts one of which lies in every match: the longest plain run of each alternative; None where that is not certain.

    Patterns with groups, escapes or nested classes are not looked into.
    """
    if any(sign in pattern for sign in "()\\\0"):
        return None
    bare = _CLASS.sub("\0", pattern)
    if "[" in bare or "]" in bare:
        return None
    found = []
    for part in bare.split("|"):
        runs = re.split(r"[\0.+^$?*{}]+", _OPTIONAL.sub("\0", part))
        found.append(max(runs, key=len))
    return tuple(found) if all(found) else None


def _candidates(rules: list[tuple]):
    """Array of the rules that may match a text, in their order."""

    @F.pandas_udf(f"array<struct<{', '.join(f.replace(' ', ':') for f in RULE.split(', '))}>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        needs: dict[str, list[int]] = {}
        always = []
        for place, rule in enumerate(rules):
            texts = required_texts(rule[2])
            if texts is None:
                always.append(place)
            for text in texts or ():
                needs.setdefault(text, []).append(place)
        automaton = ahocorasick.Automaton()
        for text, places in needs.items():
            automaton.add_word(text, text)
        automaton.make_automaton()
        names = [f.split()[0] for f in RULE.split(", ")]

        def of(text: str) -> list[dict]:
            met = set(always)
            if needs:
                for held in {word for _, word in automaton.iter(text)}:
                    met.update(needs[held])
            return [dict(zip(names, rules[place])) for place in sorted(met)]

        for batch in batches:
            yield batch.map(of)

    return find


def apply_indexed(df: DataFrame, text: str, rules: list[Rule] | DataFrame) -> DataFrame:
    """The rows of ``apply_rules`` without ``chain``: ``rule_order, rule, site, product``, one row per match site.

    The rules, at most 64 MB of them, go to every task. A rule with a null pattern or replacement matches nothing, nor does any rule match a null text.
    """
    if isinstance(rules, list):
        if not rules:
            raise ValueError("no rules")
        rules = rule_table(df.sparkSession, rules)
    usable = rules.select("rule_order", "rule", "pattern", "replacement").dropna(subset=["pattern", "replacement"])
    size = F.octet_length("pattern") + F.octet_length("replacement") + F.coalesce(F.octet_length("rule"), F.lit(0)) + 64
    total = usable.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    if total > INDEX_BYTES:
        raise ValueError(f"the rules take {total} bytes, more than {INDEX_BYTES}")
    held = sorted((tuple(r) for r in usable.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[2], r[3]))
    rows = df.filter(F.col(text).isNotNull()).withColumn("_rule", F.explode(_candidates(held)(F.col(text))))
    products = rewrite_sites(F.col(text), F.col("_rule.pattern"), F.col("_rule.replacement"))
    grown = rows.select(*df.columns, "_rule.rule_order", "_rule.rule", F.posexplode(products).alias("site", "product"))
    return grown.filter(F.col("product").isNotNull())


def apply_bodies(df: DataFrame, text: str, bodies: dict[str, Callable[[str], list[str]]]) -> DataFrame:
    """Rules whose body is a Python function from a text to its products: ``rule_order, rule, site, product``.

    A body that raises gives nothing for that text, the others go on; null texts and null products give no row.
    """
    if not bodies:
        raise ValueError("no bodies")
    named = list(enumerate(bodies.items()))

    def run(row: dict) -> list[dict]:
        made = []
        for order, (name, body) in named:
            try:
                products = [] if row[text] is None else list(body(row[text]))
            except Exception:
                continue
            made += [{**row, "rule_order": order, "rule": name, "site": site, "product": product}
                     for site, product in enumerate(products) if product is not None]
        return made

    added = T._parse_datatype_string("rule_order int, rule string, site int, product string")
    return map_rows(df, run, T.StructType([*df.schema.fields, *added.fields]), on_error="raise")
