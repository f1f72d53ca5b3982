"""Every operator as a query over the test tables.

``documents`` with ``labels`` stands for the molecule table: a text is the key, a toxic document is
positive, English ones are the first and all others the second non-positive source.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moltabula.functions.bits import pack_words, popcount, unpack_words
from moltabula.functions.edits import character_features, edit_bound, edit_similarity
from moltabula.functions.labels import decode_label, encode_label, ensure_label_name
from moltabula.functions.text import key_digest, normalize_key, tokens
from moltabula.functions.vectors import as_doubles, dot, l2_norm
from moltabula.operators import aggregate, contrastive, corrected, dedup, descent, features, fingerprint, layout, metrics, models, overlap
from moltabula.operators import quality, rowfn, rule_index, rules, sampling, similarity, split
from moltabula.plans import pipelines
from moltabula.operators.rank import rank_by_value, seeded_hash
from moltabula.scratch import scratch_path, written
from moltabula.sources import readers, shards, writers
from moltabula.sources.resolve import read_table, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__.removeprefix("run_")] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tidy(df: DataFrame, digits: int = 9) -> DataFrame:
    """Whole numbers as bigint and other numbers rounded, so that engines can be compared."""
    def column(field: T.StructField):
        col = F.col(field.name)
        if isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            return col.cast("bigint").alias(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            return F.round(col.cast("double"), digits).alias(field.name)
        return col

    return df.select(*[column(f) for f in df.schema.fields])


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    marks = table(spark, folder, "labels").select("doc_id", "toxic")
    source = F.when(F.col("toxic") == 1, "PKS").when(F.col("lang") == "en", "bio").otherwise("chem")
    return docs.join(marks, "doc_id", "left").select(F.col("doc_id").alias("ordinal"), "text", source.alias("source"))


def compiled(spark: SparkSession, folder: str, *columns) -> DataFrame:
    """Named columns of the molecule table, normalised once and stored, as later stages read it often."""
    docs = spread(table(spark, folder, "documents").select("doc_id", "text", "lang"), "doc_id")
    marks = table(spark, folder, "labels").select("doc_id", "toxic")
    source = F.when(F.col("toxic") == 1, "PKS").when(F.col("lang") == "en", "bio").otherwise("chem")
    rows = docs.join(marks, "doc_id", "left").select(
        F.col("doc_id").alias("ordinal"), normalize_key(F.col("text")).alias("smiles"), source.alias("source")
    )
    return written(rows.select(*columns), "molecules")


def molecules(spark: SparkSession, folder: str) -> DataFrame:
    key = key_digest(F.col("smiles")).alias("key")
    return compiled(spark, folder, "ordinal", "smiles", key, "source").filter(F.col("smiles").isNotNull())


def keyed(spark: SparkSession, folder: str) -> DataFrame:
    """Molecules with the digest of the key only, so that keyed shuffles do not move texts."""
    key = key_digest(F.col("smiles")).alias("key")
    return compiled(spark, folder, "ordinal", key, "source").filter(F.col("key").isNotNull())


def labels_of(rows: DataFrame) -> DataFrame:
    return split.label_any(rows, "key", encode_label(F.col("source")) == 1)


def assigned_rows(rows: DataFrame) -> DataFrame:
    return split.assign_splits(rows, split.stratified_split(labels_of(rows), "key"), "key")


def prints_of(rows: DataFrame) -> DataFrame:
    return fingerprint.hash_fingerprint(rows.withColumn("label", encode_label(F.col("source"))), "smiles")


def key_labels(spark: SparkSession, folder: str) -> DataFrame:
    return labels_of(keyed(spark, folder))


def assigned(spark: SparkSession, folder: str) -> DataFrame:
    return assigned_rows(keyed(spark, folder))


def prints(spark: SparkSession, folder: str) -> DataFrame:
    return prints_of(molecules(spark, folder))


def stored_prints(spark: SparkSession, folder: str) -> DataFrame:
    return written(prints(spark, folder).select("ordinal", "on_bits", "label"), "fingerprints")


def split_prints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints with their split, stored as the fingerprint stage does."""
    rows = molecules(spark, folder)
    marked = assigned_rows(rows.select("ordinal", "key", "source")).select("ordinal", "split")
    return written(prints_of(rows).drop("smiles").join(marked, "ordinal"), "fingerprints")


def scored_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    return lines.select(
        (F.col("l_discount") >= F.lit(0.05)).cast("int").alias("label"),
        (F.col("l_quantity") / 50.0).alias("score"),
        "l_extendedprice",
    )


# sources, sinks, projections and filters


@query
def text_lines(spark, folder):
    return readers.explode_lines(table(spark, folder, "documents"), "text", keep=["doc_id"])


@query
def distinct_lines(spark, folder):
    docs = readers.explode_lines(table(spark, folder, "documents"), "text")
    pages = readers.explode_lines(table(spark, folder, "pages"), "html")
    return dedup.distinct_values([docs, pages], "line")


@query
def map_values(spark, folder):
    props = F.from_json("props", "map<string,bigint>").alias("m")
    return readers.mapping_values(table(spark, folder, "events").select("event_id", props), "m", keep=["event_id"])


@query
def tagged_union(spark, folder):
    return readers.tagged_union({
        "documents": table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text"),
        "benchmark": table(spark, folder, "benchmark").select(F.col("item_id").alias("id"), "text"),
        "conversations": table(spark, folder, "conversations").select(F.col("conv_id").alias("id"), "text"),
    })


@query
def csv_roundtrip(spark, folder):
    """Texts with line breaks, quotes and commas."""
    path = scratch_path(spark, "documents") + ".csv"
    rows = table(spark, folder, "documents").select("doc_id", "text", "lang", "n_chars")
    writers.write_table(rows, path, "csv")
    return tidy(read_table(spark, path, schema=rows.schema))


@query
def parquet_roundtrip(spark, folder):
    path = scratch_path(spark, "molecules") + ".parquet"
    writers.write_table(molecules(spark, folder).select("ordinal", "smiles", "source"), path)
    return read_table(spark, path, ["ordinal", "source"])


@query
def split_files(spark, folder):
    """Splits written as files in the usual layout, found again and read with the split as a tag."""
    base = scratch_path(spark, "splits")
    pipelines.write_splits(assigned(spark, folder).select("key", "source", "split"), base)
    return readers.load_splits(spark, base, features=False).select("key", "source", "split")


@query
def training_export(spark, folder):
    """The training arrays as files, described from what was written."""
    path = scratch_path(spark, "export")
    writers.write_training_arrays(prints(spark, folder), path)
    described = spark.read.json(f"{path}/description")
    weighed = spark.read.parquet(f"{path}/arrays").agg(
        F.sum(F.aggregate("fps", F.lit(0.0), lambda acc, v: acc + v.cast("double"))).cast("bigint"))
    return described.select("n_rows", "width", "n_pos", "n_neg").withColumn("n_set", weighed.scalar())


@query
def label_fallback(spark, folder):
    """Labels of a table that has only a source."""
    return ensure_label_name(labelled(spark, folder).select("ordinal", "source"), "name").select("ordinal", "name")


@query
def shard_merge(spark, folder):
    path = scratch_path(spark, "shards")
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("index"), "o_orderkey", "o_totalprice")
    writers.write_shards(rows, path, 8, "index")
    spark.range(1).selectExpr("'not a table' as value").write.text(f"{path}/shard=broken")
    return tidy(readers.merge_shards(spark, f"{path}/shard=*", rows.schema))


def _eight_shards(spark, folder):
    """Orders in eight shards, with an empty one and a broken one beside them."""
    path = scratch_path(spark, "shards")
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("index"), "o_orderkey", "o_totalprice")
    marked = rows.withColumn("shard", F.col("index") % 8)
    marked.repartition(8, "shard").write.partitionBy("shard").parquet(path)
    rows.limit(0).coalesce(1).write.parquet(f"{path}/shard=empty")
    rows.selectExpr("'not a table' as value").write.text(f"{path}/shard=broken")
    return path, rows.schema


@query
def shard_states(spark, folder):
    path, schema = _eight_shards(spark, folder)
    expected = [f"shard={i}" for i in range(9)]
    return shards.shard_states(spark, path, schema, expected).select("shard", "state", "rows")


@query
def shard_merge_checked(spark, folder):
    """The merged rows with the number of shards that the removal took."""
    path, schema = _eight_shards(spark, folder)
    target = scratch_path(spark, "merged")
    states = shards.merge_good(spark, path, schema, target)
    removed = shards.remove_merged(spark, path, states, target)
    return tidy(spark.read.parquet(target).withColumn("n_removed", F.lit(removed)))


@query
def ordered_merge(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return tidy(rank_by_value(rows, "o_orderkey", out="place", total="n"))


@query
def metrics_nan_null(spark, folder):
    parts = table(spark, folder, "lineitem").groupBy("l_suppkey").agg(
        F.sqrt(F.avg("l_quantity") - 25.5).alias("spread"), F.count(F.lit(1)).alias("n")
    )
    return tidy(writers.clean_record(parts), 6)


@query
def ml_export(spark, folder):
    arrays = writers.training_arrays(prints(spark, folder))
    on = F.aggregate("fps", F.lit(0.0), lambda acc, v: acc + v.cast("double"))
    return writers.describe_training_arrays(arrays, F.sum(on).cast("bigint").alias("n_set"))


@query
def label_encode(spark, folder):
    return tidy(labelled(spark, folder).select("ordinal", encode_label(F.col("source")).alias("label")))


@query
def label_decode(spark, folder):
    return labelled(spark, folder).select("ordinal", decode_label(encode_label(F.col("source"))).alias("name"))


@query
def run_normalize_key(spark, folder):
    return compiled(spark, folder, "ordinal", key_digest(F.col("smiles")).alias("key"))


@query
def drop_invalid(spark, folder):
    lines = table(spark, folder, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    kept = dedup.drop_failed(lines.withColumn("line", normalize_key(F.col("line"))), "line")
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_kept"))


@query
def exclude_helpers(spark, folder):
    rows = table(spark, folder, "part").select("p_partkey", "p_type")
    return dedup.exclude_values(rows, "p_type", ("ECONOMY", "SMALL"))


@query
def exclude_table(spark, folder):
    debtors = table(spark, folder, "customer").filter("c_acctbal < 0")
    rows = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return dedup.exclude_table(rows, "o_custkey", debtors, "c_custkey")


@query
def allow_list(spark, folder):
    allowed = table(spark, folder, "nation").filter("n_regionkey in (1, 2)")
    rows = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    return tidy(dedup.restrict_to(rows, "s_nationkey", allowed, "n_nationkey"))


@query
def forbidden_chars(spark, folder):
    return quality.forbidden_rows(table(spark, folder, "documents").select("doc_id", "text", "lang"), "text").select(
        "doc_id", "lang"
    )


@query
def forbidden_preview(spark, folder):
    return tidy(quality.first_offenders(forbidden_chars(spark, folder), "lang", "doc_id"))


@query
def row_at(spark, folder):
    return table(spark, folder, "orders").filter(F.col("o_orderkey") == 100).select("o_orderkey", "o_custkey")


# labels, dedup and splits


@query
def label_any(spark, folder):
    return tidy(key_labels(spark, folder))


@query
def class_counts(spark, folder):
    return tidy(split.class_counts(key_labels(spark, folder)))


@query
def class_weights(spark, folder):
    return tidy(split.class_weights(key_labels(spark, folder)))


@query
def domain_counts(spark, folder):
    return split.domain_counts(labelled(spark, folder), "source", ("PKS", "bio", "chem", "other"))


@query
def compile_dedup(spark, folder):
    return dedup.compile_dedup(keyed(spark, folder), "key")


@query
def keep_first(spark, folder):
    rows = table(spark, folder, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    return dedup.keep_first(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query
def first_seen_last_wins(spark, folder):
    lines = table(spark, folder, "lineitem")
    order = ["l_returnflag", "l_linenumber", "l_suppkey", "l_partkey"]
    return dedup.first_seen_last_wins(lines, "l_orderkey", "l_partkey", order, exclude=())


@query
def distinct_products(spark, folder):
    producers = [table(spark, folder, t).select(key_digest(normalize_key(F.col("text"))).alias("key"))
                 for t in ("documents", "benchmark", "conversations")]
    return dedup.distinct_values(producers, "key")


@query
def stratified_split(spark, folder):
    return tidy(split.stratified_split(key_labels(spark, folder), "key"))


@query
def split_segments(spark, folder):
    rows = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    return split.stratified_split(rows, "c_custkey", "c_mktsegment")


@query
def split_rows(spark, folder):
    return assigned(spark, folder).select("ordinal", "split")


@query
def split_leakage(spark, folder):
    return quality.split_leakage(assigned(spark, folder), "key")


@query
def row_split_leakage(spark, folder):
    """A split by row instead of by key, which does leak its copies."""
    digit = F.conv(F.substring(seeded_hash(F.col("ordinal")), 1, 1), 16, 10)
    rows = keyed(spark, folder).withColumn(
        "split", F.when(digit.cast("int") < 12, "train").when(digit.cast("int") < 14, "val").otherwise("test")
    )
    return quality.split_leakage(rows, "key")


@query
def leaked_keys(spark, folder):
    rows = keyed(spark, folder).withColumnRenamed("source", "split")
    return quality.leaked_keys(rows, "key", ("PKS", "bio", "chem"))


@query
def split_ratio_check(spark, folder):
    rows = assigned(spark, folder).withColumn("label", encode_label(F.col("source")))
    return tidy(quality.split_ratio_check(rows, "label"))


@query
def pipeline_counts(spark, folder):
    key = key_digest(normalize_key(F.col("text"))).alias("key")
    return quality.pipeline_counts(labelled(spark, folder).select("text", "source", key), "text", "key", "source")


# positions, batches and samples


@query
def even_chunks(spark, folder):
    return sampling.even_chunks(table(spark, folder, "orders").select("o_orderkey"), "o_orderkey", 7)


@query
def fixed_batches(spark, folder):
    return sampling.fixed_batches(table(spark, folder, "orders").select("o_orderkey"), "o_orderkey", 256, True)


@query
def epoch_batches(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey")
    return sampling.epoch_batches(rows, "o_orderkey", 256, epoch=3, drop_last=True)


@query
def head_cap(spark, folder):
    return sampling.head_cap(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 1000)


@query
def stratified_cap(spark, folder):
    rows = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    return sampling.stratified_cap(rows, "c_custkey", "c_mktsegment", 500)


@query
def sample_exact(spark, folder):
    return sampling.sample_exact(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 1000)


@query
def weighted_resample(spark, folder):
    rows = labelled(spark, folder).select("ordinal", encode_label(F.col("source")).alias("label"))
    return tidy(sampling.weighted_resample(rows, "ordinal"))


# fingerprints


@query
def hash_fingerprint(spark, folder):
    return prints(spark, folder).select("ordinal", F.explode(F.col("on_bits").cast("array<bigint>")).alias("bit"))


@query
def gram_fingerprint(spark, folder):
    """Short keys by runs of three characters."""
    rows = fingerprint.hash_fingerprint(table(spark, folder, "part").select("p_partkey", "p_name"), "p_name", grams=3)
    return rows.select("p_partkey", F.explode(F.col("on_bits").cast("array<bigint>")).alias("bit"))


@query
def fingerprint_rows(spark, folder):
    rows = prints(spark, folder)
    total = F.aggregate("on_bits", F.lit(0).cast("bigint"), lambda acc, b: acc + b)
    return rows.select("ordinal", F.col("n_on").cast("bigint").alias("n_on"), total.alias("bit_sum"))


@query
def run_popcount(spark, folder):
    counts = popcount(pack_words(F.col("on_bits"))).cast("bigint")
    return prints(spark, folder).select("ordinal", counts.alias("n_on"))


@query
def run_pack_words(spark, folder):
    packed = prints(spark, folder).select("ordinal", pack_words(F.col("on_bits")).alias("words"))
    return packed.select("ordinal", F.posexplode("words").alias("word", "value")).select(
        "ordinal", F.col("word").cast("bigint").alias("word"), "value"
    )


@query
def run_unpack_words(spark, folder):
    back = unpack_words(pack_words(F.col("on_bits")))
    return prints(spark, folder).select("ordinal", F.explode(back.cast("array<bigint>")).alias("bit"))


@query
def assemble_norms(spark, folder):
    vectors = fingerprint.bit_vectors(prints(spark, folder)).select(
        "ordinal", vector_to_array("features").alias("v")
    )
    zero = F.lit(0.0)
    return vectors.select(
        "ordinal",
        F.aggregate("v", zero, lambda acc, x: acc + x).cast("bigint").alias("n_on"),
        F.aggregate(F.transform("v", lambda x, i: x * i), zero, lambda acc, x: acc + x).cast("bigint").alias("bit_sum"),
    )


def order_graphs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Each order as a graph of its parts and suppliers, one edge per line."""
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("graph"), "l_partkey",
        (F.col("l_partkey") * 2).alias("p"),
        (F.col("l_suppkey") * 2 + 1).alias("s"),
        F.col("l_returnflag").alias("bond"),
    )
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    labelled = written(lines.join(parts, "l_partkey").drop("l_partkey"), "lines")
    vertices = labelled.select("graph", F.col("p").alias("vertex"), F.col("p_type").alias("label")).unionByName(
        labelled.select("graph", F.col("s").alias("vertex"), F.lit("supplier").alias("label"))
    ).distinct()
    there = labelled.select("graph", F.col("p").alias("src"), F.col("s").alias("dst"), "bond")
    back = labelled.select("graph", F.col("s").alias("src"), F.col("p").alias("dst"), "bond")
    return written(vertices, "vertices"), there.unionByName(back)


@query
def graph_fingerprint(spark, folder):
    return tidy(fingerprint.graph_fingerprint(*order_graphs(spark, folder)))


@query
def graph_fingerprint_rows(spark, folder):
    bits = fingerprint.graph_sets(*order_graphs(spark, folder))
    total = F.aggregate("on_bits", F.lit(0).cast("bigint"), lambda acc, b: acc + b)
    return bits.select("graph", F.col("n_on").cast("bigint").alias("n_on"), total.alias("bit_sum"))


# neighbours


@query
def tanimoto_nn(spark, folder):
    rows = split_prints(spark, folder)
    test, train = (rows.filter(F.col("split") == s) for s in ("test", "train"))
    return tidy(similarity.tanimoto_nn(test, train))


@query
def tanimoto_nn_prefix(spark, folder):
    rows = split_prints(spark, folder)
    test, train = (rows.filter(F.col("split") == s) for s in ("test", "train"))
    return tidy(similarity.tanimoto_nn(test, train, thresholds=(0.9, 0.7)))


@query
def knn_graph(spark, folder):
    return tidy(similarity.knn_graph(stored_prints(spark, folder)))


@query
def knn_lsh(spark, folder):
    return tidy(similarity.knn_lsh(stored_prints(spark, folder), k=10))


@query
def knn_descent(spark, folder):
    return tidy(descent.knn_descent(stored_prints(spark, folder), k=10))


@query
def knn_descent_recall(spark, folder):
    """Recall of the descent for the rows whose ordinal is divisible by 20, against all rows."""
    rows = stored_prints(spark, folder)
    found = written(descent.knn_descent(rows, k=10), "descent")
    return tidy(descent.neighbour_recall(found, rows, rows.filter("ordinal % 20 = 0"), k=10))


@query
def overlap_nn(spark, folder):
    rows = molecules(spark, folder)
    marked = assigned_rows(rows.select("ordinal", "key", "source")).select("ordinal", "split")
    rows = rows.join(marked, "ordinal").select(
        "ordinal", "split", encode_label(F.col("source")).alias("label"), tokens(F.col("smiles")).alias("tokens"),
        F.col("key").alias("smiles"),
    )
    test, train = (rows.filter(F.col("split") == s) for s in ("test", "train"))
    return tidy(overlap.overlap_nn(test, train))


@query
def overlap_nn_bounded(spark, folder):
    """Toxic documents against all others, by groups of like vocabulary."""
    rows = molecules(spark, folder).select(
        "ordinal", "source", encode_label(F.col("source")).alias("label"), tokens(F.col("smiles")).alias("tokens"), F.col("key").alias("smiles"))
    test, train = rows.filter("source = 'PKS'"), rows.filter("source <> 'PKS'")
    return tidy(overlap.overlap_nn(test, train, buckets=32))


@query
def udf_pair_bounded(spark, folder):
    """For each page with an id divisible by 20 the most similar address of all other pages by edits."""
    pages = table(spark, folder, "pages").select(F.col("page_id").alias("ordinal"), (F.col("page_id") % 2).cast("int").alias("label"), "url")
    asked = F.col("ordinal") % 20 == 0
    found = overlap.best_match_bounded(
        pages.filter(asked), pages.filter(~asked), edit_similarity, "url", character_features(F.col("url"), URL_CHARACTERS), edit_bound)
    return tidy(found)


@query
def udf_pair_score(spark, folder):
    items = table(spark, folder, "benchmark").select(
        F.col("item_id").alias("ordinal"), F.lit(1).alias("label"), F.length("text").alias("size")
    )
    docs = table(spark, folder, "documents").select(
        F.col("doc_id").alias("ordinal"), F.lit(0).alias("label"), F.col("n_chars").cast("int").alias("size")
    )
    found = overlap.best_match(items, docs, lambda a, b: min(a, b) / max(a, b), "size")
    return tidy(found.select("ordinal", "pred_label", "score", "nn_text"))


@query
def neighbour_table(spark, folder):
    return tidy(pipelines.neighbour_table(split_prints(spark, folder), "key"))


# rules


URL_CHARACTERS = "abcdefghiklmnoprstuvwxy0123456789"
REWRITES = [
    rules.Rule("soften", "i", "y"),
    rules.Rule("rename", "bolt|ring", "rod"),
    rules.Rule("shorten", "[aeo]+", "u"),
]


@query
def enumerate_designs(spark, folder):
    def no_repeat(starter, modules):
        return (F.size(modules) < 2) | (F.element_at(modules, -1) != F.try_element_at(modules, F.lit(-2)))

    made = rules.enumerate_designs(
        table(spark, folder, "supplier"), "s_name", table(spark, folder, "nation"), "n_name", (1, 2), no_repeat
    )
    return made.select("starter", F.array_join("modules", "|").alias("modules"),
                       F.col("length").cast("bigint").alias("length"))


@query
def apply_rules(spark, folder):
    rows = table(spark, folder, "part").select("p_partkey", "p_name")
    return tidy(rules.apply_rules(rows, "p_name", REWRITES))


@query
def apply_rules_chain(spark, folder):
    rows = table(spark, folder, "part").select("p_partkey", "p_name")
    return tidy(rules.apply_rules(rows, "p_name", REWRITES, chain=True))


@query
def apply_rules_indexed(spark, folder):
    """5,000 rules over all customers; a name meets the few whose digits it holds."""
    many = [rules.Rule(f"end {i}", f"{i:04d}$", "last") for i in range(4999)] + [rules.Rule("any", "[#]0+|mer", "~")]
    rows = table(spark, folder, "customer").select("c_custkey", "c_name")
    return tidy(rule_index.apply_indexed(rows, "c_name", many))


def _halves(text):
    at = text.index(" ")
    return [text[:at], text[at + 1:]]


@query
def rule_bodies(spark, folder):
    """Rules as Python functions; the second one fails on short names."""
    rows = table(spark, folder, "part").select("p_partkey", "p_name")
    return tidy(rule_index.apply_bodies(rows, "p_name", {"halves": _halves, "tenth": lambda t: [t[9] + t]}))


@query
def rule_counts(spark, folder):
    return rules.rule_counts(table(spark, folder, "part"), "p_name", REWRITES)


@query
def expand_one_step(spark, folder):
    return rules.expand_one_step(table(spark, folder, "part"), "p_name", REWRITES, exclude=("red gear", "blue rod"))


@query
def udf_map_rows(spark, folder):
    def pages(row):
        if row["n_chars"] < 100:
            raise ValueError("too short")
        return [{"doc_id": row["doc_id"], "page": i} for i in range(row["n_chars"] // 2000)]

    rows = table(spark, folder, "documents").select("doc_id", "n_chars")
    return rowfn.map_rows(rows, pages, "doc_id bigint, page bigint")


@query
def own_geometric_mean(spark, folder):
    """A caller's aggregate over few groups, one of them hot."""
    rows = table(spark, folder, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_extendedprice").cast("double").alias("price"))
    found = aggregate.aggregate(rows, ["l_returnflag", "l_linestatus"], ["price"], aggregate.geometric_mean("price"), "geometric_mean double, n bigint")
    return tidy(found, 4)


@query
def own_top_three(spark, folder):
    """A caller's aggregate over many groups: the three dearest lines of each order, by their line number."""
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey", F.col("l_extendedprice").cast("double").alias("price"), F.col("l_linenumber").cast("bigint").alias("line"))
    found = aggregate.aggregate(rows, ["l_orderkey"], ["price", "line"], aggregate.greatest(3, "price", "line"), "carried array<bigint>")
    return found.select("l_orderkey", F.array_join(F.col("carried").cast("array<string>"), ",").alias("lines"))


# metrics


@query
def confusion_report(spark, folder):
    rows = scored_lines(spark, folder).withColumn("prediction", (F.col("score") >= 0.5).cast("int"))
    return tidy(metrics.confusion_report(rows))


@query
def roc_auc(spark, folder):
    return tidy(metrics.roc_auc(scored_lines(spark, folder), score="l_extendedprice"))


@query
def average_precision(spark, folder):
    return tidy(metrics.average_precision(scored_lines(spark, folder), score="l_extendedprice"))


@query
def eval_report(spark, folder):
    return tidy(metrics.eval_report(scored_lines(spark, folder)))


@query
def neighbour_report(spark, folder):
    return tidy(metrics.neighbour_report(tanimoto_nn(spark, folder), "true_label"))


@query
def best_epoch(spark, folder):
    history = table(spark, folder, "events").select("event_type", F.col("event_id").alias("epoch"), F.col("value").alias("ap"))
    return tidy(metrics.best_epoch(history, "epoch", "ap", ["event_type"]))


# vectors


@query
def feature_stats(spark, folder):
    return tidy(features.feature_stats(table(spark, folder, "embeddings"), "embedding"))


@query
def standardize(spark, folder):
    rows = table(spark, folder, "embeddings")
    scaled = features.standardize_with(rows, rows, "embedding")
    return tidy(scaled.select("vec_id", F.posexplode("scaled").alias("feature", "value")), 6)


@query
def l2_normalize(spark, folder):
    unit = features.normalize_rows(table(spark, folder, "embeddings"), "embedding")
    return tidy(unit.select("vec_id", F.posexplode("unit").alias("feature", "value")))


@query
def vector_products(spark, folder):
    rows = table(spark, folder, "embeddings")
    return tidy(rows.select("vec_id", l2_norm(F.col("embedding")).alias("norm"),
                            dot(F.col("embedding"), F.reverse("embedding")).alias("mirrored")))


@query
def supcon_loss(spark, folder):
    return tidy(contrastive.supcon_loss(table(spark, folder, "embeddings"), "embedding", "label", "vec_id", 50))


@query
def supcon_one_batch(spark, folder):
    """All vectors as one batch, in blocks over the tasks."""
    return tidy(contrastive.supcon_loss_spread(table(spark, folder, "embeddings"), "embedding", "label", "vec_id", block_rows=512))


@query
def supcon_epoch_mean(spark, folder):
    losses = contrastive.supcon_loss(table(spark, folder, "embeddings"), "embedding", "label", "vec_id", 50, epoch=1)
    return tidy(contrastive.epoch_mean(losses))


# models


def bit_weights(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """A weight per bit from the share of positives among its rows, and a fixed intercept."""
    bits = rows.select(F.explode("on_bits").alias("feature"), "label")
    weights = bits.groupBy("feature").agg((F.avg("label") - F.lit(0.05)).alias("weight"))
    bias = spark.range(1).select(F.lit(-1).alias("feature"), F.lit(-0.5).alias("weight"))
    return weights.unionByName(bias)


@query
def score_from_weights(spark, folder):
    rows = stored_prints(spark, folder)
    scored = models.score_from_weights(rows, bit_weights(spark, rows))
    return tidy(scored.select("ordinal", "score"))


@query
def saved_weights(spark, folder):
    """The same with weights that were saved and loaded."""
    path = scratch_path(spark, "weights")
    rows = stored_prints(spark, folder)
    models.save_weights(bit_weights(spark, rows), models.model_metadata(rows, "label", ["on_bits"]), path)
    weights, _ = models.load_weights(spark, path)
    return tidy(models.score_from_weights(rows, weights).select("ordinal", "score"))


def training_rows(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint.bit_vectors(split_prints(spark, folder))


@query
def train_linear(spark, folder):
    """Whether the loss with its penalty is flat at the fitted weight of each feature; the intercept is feature -1."""
    train = written(training_rows(spark, folder).filter(F.col("split") == "train"), "training")
    weights = models.coefficients(models.train_linear(train), spark)
    rows = split.with_balanced_weight(models.score_from_weights(train, weights), "label")
    bits = F.array_append(F.col("on_bits").cast("array<int>"), F.lit(-1))
    pulls = rows.select(F.explode(bits).alias("feature"), ((F.col("score") - F.col("label")) * F.col("weight")).alias("pull"))
    sums = pulls.groupBy("feature").agg(F.sum("pull").alias("pull"))
    slope = F.coalesce("pull", F.lit(0.0)) + F.when(F.col("feature") >= 0, F.col("weight")).otherwise(0.0)
    flat = F.abs(slope) < 1e-4 * train.count()
    return tidy(weights.join(sums, "feature", "left").select("feature", flat.alias("flat")))


@query
def score_linear(spark, folder):
    """Scores of the test rows against those from the table of weights."""
    rows = written(training_rows(spark, folder), "training")
    model = models.train_linear(rows.filter(F.col("split") == "train"))
    scored = models.score_linear(model, rows.filter(F.col("split") == "test"))
    scored = models.score_from_weights(scored, models.coefficients(model, spark), out="again")
    return tidy(scored.select("ordinal", "label", F.round(F.abs(F.col("score") - F.col("again")), 6).alias("difference")))


@query
def linear_weights(spark, folder):
    """The fitted weights themselves."""
    train = training_rows(spark, folder).filter(F.col("split") == "train")
    return tidy(models.coefficients(models.train_linear(train), spark), 6)


@query
def linear_scores(spark, folder):
    """The scores of the test rows themselves."""
    rows = written(training_rows(spark, folder), "training")
    model = models.train_linear(rows.filter(F.col("split") == "train"))
    return tidy(models.score_linear(model, rows.filter(F.col("split") == "test")).select("ordinal", "label", "score"), 6)


@query
def train_incremental(spark, folder):
    train = split_prints(spark, folder).filter(F.col("split") == "train")
    return tidy(models.train_incremental(train, "ordinal"), 6)


@query
def corrected_weights(spark, folder):
    """The weights of ``linear_weights`` by corrected chunk steps."""
    train = split_prints(spark, folder).filter(F.col("split") == "train")
    return tidy(corrected.train_corrected(train)[0], 3)


@query
def corrected_scores(spark, folder):
    """The test rows by such weights, saved and loaded, with the loss and the greatest slope they were left with."""
    rows = written(split_prints(spark, folder), "split-prints")
    train = rows.filter(F.col("split") == "train")
    weights, history = corrected.train_corrected(train)
    path = scratch_path(spark, "weights")
    models.save_weights(weights, models.model_metadata(train, "label", ["on_bits"]), path)
    scored = models.score_from_weights(rows.filter(F.col("split") == "test"), models.load_weights(spark, path)[0])
    last = history.agg(F.max(F.struct("round", "loss", "slope")).alias("l")).select("l").scalar()
    scored = scored.select("ordinal", "label", "score").withColumn("_last", last)
    return tidy(scored.select("ordinal", "label", "score", F.col("_last.loss").alias("train_loss"), F.col("_last.slope").alias("train_slope")), 4)


def probe_rows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        "vec_id", "embedding", (F.col("label") == 3).cast("int").alias("label")
    )


@query
def linear_probe(spark, folder):
    return tidy(models.linear_probe(probe_rows(spark, folder), "embedding"), 6)


def _probe_parts(spark: SparkSession, folder: str) -> DataFrame:
    rows = probe_rows(spark, folder).withColumn("features", array_to_vector(as_doubles(F.col("embedding"))))
    placed = split.stratified_split(rows.select("vec_id", "label"), "vec_id").drop("label")
    return written(rows.join(placed, "vec_id"), "probe")


@query
def mlp_epochs(spark, folder):
    """The scores of the validation rows from the best of 25 epochs, with its number and its average precision."""
    parts = _probe_parts(spark, folder)
    train, held_out = (parts.filter(F.col("split") == s) for s in ("train", "val"))
    model, history = models.train_mlp_epochs(train, held_out, width=64, hidden=(128, 64))
    best = metrics.best_epoch(history, "epoch", "val_ap").select(F.struct("best_epoch", "best_val_ap")).scalar()
    scored = models.score_linear(model, held_out).select("vec_id", "label", "score").withColumn("_best", best)
    return tidy(scored.select("vec_id", "label", "score", "_best.best_epoch", "_best.best_val_ap"))


@query
def train_mlp(spark, folder):
    rows = probe_rows(spark, folder).withColumn("features", array_to_vector(as_doubles(F.col("embedding"))))
    parts = rows.join(split.stratified_split(rows.select("vec_id", "label"), "vec_id").drop("label"), "vec_id")
    train = sampling.weighted_resample(parts.filter(F.col("split") == "train"), "vec_id")
    _, history = models.train_mlp(train, parts.filter(F.col("split") == "val"), width=64, hidden=(128, 64))
    return tidy(history, 6)


@query
def coordinates_2d(spark, folder):
    """Both coordinates of every vector."""
    rows = _probe_parts(spark, folder).select(F.col("vec_id").cast("string").alias("smiles"), F.lit("bio").alias("source"), "split", "label", "features")
    return tidy(models.project_2d(rows), 6)


@query
def graph_layout(spark, folder):
    """Every vector placed by the graph of vectors that are positive in the same places, from principal components on."""
    rows = _probe_parts(spark, folder)
    positive = F.filter(F.transform("embedding", lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull())
    graph = similarity.knn_graph(rows.select("vec_id", positive.alias("on_bits")), "vec_id", n_bits=64)
    placed = models.project_2d(rows, columns=("vec_id",))
    edges = written(layout.symmetric_edges(graph, "vec_id"), "graph")
    start = placed.select(F.col("vec_id").alias("a"), F.col("component_1").alias("x"), F.col("component_2").alias("y"))
    found = layout.graph_layout(edges, start).withColumnRenamed("a", "vec_id")
    return tidy(found, 6)


@query
def project_2d(spark, folder):
    rows = table(spark, folder, "embeddings").select(
        "vec_id", F.col("vec_id").cast("string").alias("smiles"), F.col("label").cast("string").alias("source"),
        (F.col("label") == 3).cast("int").alias("label"),
        array_to_vector(as_doubles(F.col("embedding"))).alias("features"),
    )
    parts = split.stratified_split(rows.select("vec_id", "label"), "vec_id").drop("label")
    points = written(models.project_2d(rows.join(parts, "vec_id")), "points")
    spread_ = points.agg(F.covar_pop("component_1", "component_2").alias("c"), (F.var_pop("component_1") >= F.var_pop("component_2")).alias("o"))
    stored = written(spread_, "spread")
    return tidy(points.drop("component_1", "component_2").withColumn("off_diagonal", F.round(F.abs(stored.select("c").scalar()), 6))
                .withColumn("ordered", stored.select("o").scalar()))


@query
def model_metadata(spark, folder):
    meta = models.model_metadata(key_labels(spark, folder), "label", [f"fp_{i}" for i in range(2048)], solver="l-bfgs")
    return meta.select(
        "train_rows", F.size("feature_columns").cast("bigint").alias("n_features"),
        F.col("class_counts")["PKS"].alias("n_pos"), F.col("class_counts")["non-PKS"].alias("n_neg"),
    )
