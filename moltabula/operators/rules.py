"""Enumerating designs and deriving candidates with rewrite rules."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moltabula.functions.vectors import bind


MARK = "\uffff\ufffe"


@dataclass(frozen=True)
class Rule:
    """Replace one match of ``pattern`` at a time by ``replacement``, a plain text."""

    name: str
    pattern: str
    replacement: str


def enumerate_designs(starters: DataFrame, starter: str, modules: DataFrame, module: str,
                      lengths: tuple[int, ...] = (1, 2, 3), valid: Callable[[Column, Column], Column] | None = None,
                      limit: int | None = None) -> DataFrame:
    """``(starter, modules, length)``: every starter with every module sequence of the given lengths.

    The module catalog is a short list of names and reaches the rows as one array, attached after each shuffle, so a step is an
    explode. ``valid(starter, modules)`` is tested after each step, so a bad prefix is not extended. With a
    ``limit`` more sequences than that, valid or not, are refused.
    """
    names = modules.select(F.col(module).alias("_m")).filter("_m is not null").distinct()
    n_modules, n_starters = names.count(), starters.select(starter).distinct().count()
    total = sum(n_starters * n_modules**k for k in lengths)
    if limit is not None and total > limit:
        raise ValueError(f"{total} designs exceed the limit of {limit}")
    catalog = names.agg(F.array_sort(F.collect_list("_m")).alias("c")).scalar()
    rows = starters.select(F.col(starter).alias("starter")).distinct()
    rows = rows.withColumn("modules", F.expr("cast(array() as array<string>)"))
    result = None
    for length in range(1, max(lengths) + 1):
        rows = rows.withColumn("_next", F.explode(catalog))
        rows = rows.withColumn("modules", F.array_append("modules", F.col("_next").cast("string"))).drop("_next")
        if valid is not None:
            rows = rows.filter(valid(F.col("starter"), F.col("modules")))
        if length == 1 and total > n_starters * n_modules:
            # rows multiply in place from here on, so spread the prefixes by the size of the result
            tasks = max(starters.sparkSession.sparkContext.defaultParallelism, min(total // 1_000_000, n_starters * n_modules))
            rows = rows.repartition(int(tasks), "starter", "modules")
        if length in lengths:
            done = rows.select("starter", "modules", F.lit(length).alias("length"))
            result = done if result is None else result.unionByName(done)
    return result


def rewrite_sites(text: Column, pattern: Column, replacement: Column) -> Column:
    """One candidate per match of a pattern, empty matches included: the text with only that match replaced; none without a match.

    Matches are marked in place, so gaps and matches take turns. The mark consists of two characters that Unicode keeps out of texts; a text that holds
    it is an error.
    """
    marked = F.regexp_replace(text, pattern, F.lit(f"{MARK}$0{MARK}"))
    clean = F.when(F.instr(text, MARK) > 0, F.raise_error(F.lit("a text holds the mark of matches"))).otherwise(marked)
    woven = F.split(clean, F.lit(MARK), -1)

    def candidate(parts: Column, site: Column) -> Column:
        swapped = F.transform(parts, lambda part, at: F.when(at == 2 * site + 1, replacement).otherwise(part))
        return F.array_join(swapped, "")

    def candidates(parts: Column) -> Column:
        n = F.floor(F.size(parts) / 2).cast("int")
        return F.transform(F.filter(F.sequence(F.lit(0), n), lambda site: site < n), lambda site: candidate(parts, site))

    return bind(woven, candidates)


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """``rule_order, rule, pattern, replacement``: rules as data."""
    rows = [(i, r.name, r.pattern, r.replacement) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rule_order int, rule string, pattern string, replacement string")


def apply_rules(df: DataFrame, text: str, rules: list[Rule] | DataFrame, chain: bool = False) -> DataFrame:
    """Every row with every rule: ``rule_order, rule, site, product``, one row per match site.

    The rules, a list or a table as ``rule_table`` makes it, reach the rows as one array value, so there is no join and the plan has the same size
    for any number of rules. With ``chain`` a rule without a match stops the later rules of that row.
    """
    if isinstance(rules, list):
        if not rules:
            raise ValueError("no rules")
        rules = rule_table(df.sparkSession, rules)
    packed = rules.agg(F.array_sort(F.collect_list(F.struct("rule_order", "rule", "pattern", "replacement"))).alias("r")).scalar()
    rows = df.filter(F.col(text).isNotNull()).withColumn("_rules", packed)
    if chain:
        failed = F.filter("_rules", lambda r: ~F.regexp_like(F.col(text), r["pattern"]))
        stop = F.array_min(F.transform(failed, lambda r: r["rule_order"]))
        rows = rows.withColumn("_stop", stop)
        rows = rows.withColumn("_rules", F.filter("_rules", lambda r: F.col("_stop").isNull() | (r["rule_order"] < F.col("_stop"))))
    rows = rows.select(*df.columns, F.explode("_rules").alias("_rule"))
    products = rewrite_sites(F.col(text), F.col("_rule.pattern"), F.col("_rule.replacement"))
    grown = rows.select(*df.columns, "_rule.rule_order", "_rule.rule", F.posexplode(products).alias("site", "product"))
    return grown.filter(F.col("product").isNotNull())


def rule_counts(df: DataFrame, text: str, rules: list[Rule]) -> DataFrame:
    """Rows with and without a match, per rule, in one aggregate."""
    sums = df.agg(*[
        F.count_if(F.regexp_like(F.col(text), F.lit(rule.pattern))).alias(f"_{i}") for i, rule in enumerate(rules)
    ], F.count(F.col(text)).alias("_n"))
    rows = F.array(*[
        F.struct(
            F.lit(rule.name).alias("rule"),
            F.col(f"_{i}").alias("n_matched"),
            (F.col("_n") - F.col(f"_{i}")).alias("n_unmatched"),
        )
        for i, rule in enumerate(rules)
    ])
    return sums.select(F.inline(rows))


def expand_one_step(df: DataFrame, text: str, rules: list[Rule], exclude: tuple[str, ...] = (),
                    keep_input: bool = True) -> DataFrame:
    """Distinct products of one round of all rules, by default with the inputs themselves.

    With ``exclude`` the listed values and blanks are dropped. Inputs are made distinct first, so copies
    are expanded once.
    """
    inputs = df.select(F.col(text).alias("product")).filter(F.col("product").isNotNull()).distinct()
    products = apply_rules(inputs.withColumnRenamed("product", "_input"), "_input", rules).select("product")
    if keep_input:
        products = products.unionByName(inputs)
    if exclude:
        products = products.filter(~F.col("product").isin(*exclude) & (F.col("product") != ""))
    return products.distinct()
