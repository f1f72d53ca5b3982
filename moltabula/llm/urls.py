"""URL rules by a sort-merge range join.

A host with its labels reversed (``net.example.blog.``) turns "this host and all below it" into an interval of
keys, ``[net.example., net.example/)``: no host holds a slash, and it follows the dot. Pages and rules go to the same ranges of keys and are sorted
together; one sweep keeps a stack of the rules whose interval is open. Intervals nest, so a page's candidates
are just the stack, and the longest whose path fits decides.

Cut points between ranges come from quantiles of the hosts, a list of fixed length. A rule goes to
every range that its interval meets. A host that fills several ranges makes equal cut points; its
pages spread over those ranges by their id and path.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moltabula.scratch import written

DEFAULT_VERDICT = "allow"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str


def rule_table(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    return spark.createDataFrame([(r.verdict, r.host, r.path) for r in rules], "verdict string, host string, path string")


def url_parts(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host and path: both empty for null or where there is no ``://``."""
    found = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(found > 0, F.substr(url, found + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def reversed_host(host: F.Column) -> F.Column:
    """Labels from the last to the first, each closed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _ranges(cuts: list[str], low: F.Column, high: F.Column) -> F.Column:
    """Numbers of the ranges that keys from ``low`` to ``high`` may lie in."""
    points = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<string>")
    first = F.size(F.filter(points, lambda c: c < low))
    last = F.size(F.filter(points, lambda c: c <= high))
    return F.sequence(first, last)


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", n_ranges: int | None = None,
          default: str = DEFAULT_VERDICT) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for each page.

    A rule fits its host and all hosts below it, if the page's path starts with the rule's path. The longest
    (host and path together, then the greater text) wins; ``rule`` is its host and path, null where none fits and
    ``default`` decides. Null or malformed urls have an empty host and path and meet no rule with a host. Rules with a
    null host or path fit nothing; of equal rules with different verdicts ``block`` wins. Repeated and null page ids are
    judged row by row.
    """
    spark = pages.sparkSession
    n_ranges = n_ranges or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    host, path = url_parts(F.col(url_col))
    sites = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    sites = sites.withColumn("key", reversed_host(F.col("host")))
    # Quantiles of keys, from one row for each host with its number of pages: a table far smaller than the pages.
    heads = written(sites.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "hosts")
    cuts = _cut_points(heads, n_ranges)
    salt = F.pmod(F.xxhash64("page_id", "path"), F.size("ranges")) + 1
    placed = (
        sites.withColumn("ranges", _ranges(cuts, F.col("key"), F.col("key")))
        .withColumn("range", F.element_at("ranges", salt.cast("int"))).drop("ranges")
        .select("range", "key", F.lit(1).alias("kind"), "page_id", "host", "path", F.lit(None).cast("string").alias("verdict"))
    )
    ruled = rules.where("host is not null and path is not null").groupBy("host", "path").agg(
        F.max(F.coalesce("verdict", F.lit(default))).alias("verdict"))
    ruled = ruled.withColumn("key", reversed_host(F.col("host")))
    opened = (
        ruled.withColumn("range", F.explode(_ranges(cuts, F.col("key"), F.concat(F.expr("substr(key, 1, length(key) - 1)"), F.lit("/")))))
        .select("range", "key", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("page_id"), "host", "path", "verdict")
    )
    together = placed.unionByName(opened).repartition(n_ranges, "range").sortWithinPartitions("range", "key", "kind")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_rules: list[tuple[str, list[tuple[int, str, str, str]]]] = []
        current = None
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                where, key, kind, page_id, name, way, verdict = row
                if where != current:
                    open_rules, current = [], where
                while open_rules and not key.startswith(open_rules[-1][0]):
                    open_rules.pop()
                if kind == 0:
                    if not open_rules or open_rules[-1][0] != key:
                        open_rules.append((key, []))
                    open_rules[-1][1].append((len(name) + len(way), name + way, way, verdict))
                    continue
                fits = [r for _, rules_here in open_rules for r in rules_here if way.startswith(r[2])]
                best = max(fits, default=(0, None, "", default))
                out.append((page_id, name, way, best[1], best[3]))
            columns = list(zip(*out)) or [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["page_id", "host", "path", "rule", "verdict"])

    return together.mapInArrow(sweep, "page_id long, host string, path string, rule string, verdict string")


def _cut_points(heads: DataFrame, n_ranges: int) -> list[str]:
    """Up to ``n_ranges - 1`` host keys at about even numbers of pages; a busy host appears several times.

    Hosts are dealt to ``n_ranges`` tasks, sorted by Spark, and each task marks a host whenever a fixed number of pages has gone by, from a start of its
    own so that their errors even out. A task holds only its marks; the driver gets about 64 times ``n_ranges`` of them, whatever the number of hosts.
    """
    total = heads.agg(F.sum("n").alias("n")).first()["n"] or 0
    step = max(1, -(-total // (min(64, n_ranges) * n_ranges)))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = TaskContext.get().partitionId() * 0x9E3779B1 % step
        for batch in batches:
            marks = []
            for key, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                passed = (seen + n) // step - seen // step
                seen += n
                if passed:
                    marks.append((key, passed * step))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in marks], pa.string()), pa.array([n for _, n in marks], pa.int64())], ["key", "n"])

    spread = heads.select("key", "n").repartition(n_ranges, "key").sortWithinPartitions("key")
    marks = sorted((r["key"], r["n"]) for r in spread.mapInArrow(local, "key string, n long").collect())
    total, seen, cuts = sum(n for _, n in marks), 0, []
    for key, n in marks:
        seen += n
        cuts += [key] * (min(n_ranges - 1, seen * n_ranges // max(1, total)) - len(cuts))
    return cuts
