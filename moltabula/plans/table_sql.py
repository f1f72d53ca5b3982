"""The same results as plain SQL over the test tables."""

from __future__ import annotations

WS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


def _norm(col: str) -> str:
    bare = f"translate(trim({col}, {WS}), '@/\\', '')"
    return f"nullif(trim(regexp_replace({bare}, '[ \\t\\n\\r\\x0B\\f]+', ' ', 'g'), {WS}), '')"


def _bit(value: str, n_bits: int = 2048) -> str:
    return f"(('0x' || substr(md5({value}), 1, 8))::BIGINT % {n_bits})"


def _piece(value: str, start: int, digits: int = 8) -> str:
    return f"('0x' || substr(md5({value}), {start}, {digits}))::BIGINT"


def _uniform(value: str) -> str:
    return f"(('0x' || substr(md5({value}), 1, 12))::BIGINT::DOUBLE / 281474976710656e0)"


MOL = f"""
mol AS (
  SELECT d.doc_id AS ordinal, d.text, {_norm('d.text')} AS smiles,
         CASE WHEN l.toxic = 1 THEN 'PKS' WHEN d.lang = 'en' THEN 'bio' ELSE 'chem' END AS source
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""

KEYED = MOL + """,
keyed AS (SELECT ordinal, sha256(smiles) AS key, source FROM mol WHERE smiles IS NOT NULL),
key_labels AS (SELECT key, max(CASE WHEN source = 'PKS' THEN 1 ELSE 0 END)::BIGINT AS label FROM keyed GROUP BY key)"""


def _split(rows: str, key: str, label: str) -> str:
    return f"""
strata AS (
  SELECT {key}, {label}, CASE WHEN (SELECT min(n) >= 10 FROM (SELECT count(*) AS n FROM {rows} GROUP BY {label}))
    THEN {label}::VARCHAR ELSE 'all' END AS stratum FROM {rows}
),
placed AS (
  SELECT {key}, {label}, row_number() OVER (PARTITION BY stratum ORDER BY md5('42|' || {key}), {key}) AS r,
         count(*) OVER (PARTITION BY stratum) AS n FROM strata
),
held AS (SELECT *, ceil(round(n * 0.2e0, 9)) AS h FROM placed),
cut AS (
  SELECT {key}, {label}, CASE WHEN r <= n - h THEN 'train' WHEN r <= n - ceil(h / 2) THEN 'val' ELSE 'test' END AS split
  FROM held
)"""


SPLIT = KEYED + "," + _split("key_labels", "key", "label") + """,
assigned AS (SELECT k.ordinal, k.key, k.source, c.split FROM keyed k JOIN cut c ON k.key = c.key)"""

BITS = f"""
bits AS (
  SELECT DISTINCT ordinal, {_bit('t')} AS bit FROM (
    SELECT ordinal, unnest(regexp_split_to_array(lower(smiles), '[^\\p{{L}}\\p{{N}}]+')) AS t FROM mol WHERE smiles IS NOT NULL
  ) WHERE t <> ''
),
sizes AS (
  SELECT m.ordinal, m.smiles, CASE WHEN m.source = 'PKS' THEN 1 ELSE 0 END AS label, count(b.bit) AS n_on,
         coalesce(sum(b.bit), 0)::BIGINT AS bit_sum
  FROM mol m LEFT JOIN bits b ON m.ordinal = b.ordinal WHERE m.smiles IS NOT NULL GROUP BY ALL
)"""

NEAREST = SPLIT + "," + BITS + """,
side AS (SELECT s.ordinal, s.label, s.n_on, a.split FROM sizes s JOIN assigned a ON s.ordinal = a.ordinal),
shared AS (
  SELECT t.ordinal AS q, r.ordinal AS t, count(*) AS common
  FROM bits t JOIN bits r ON t.bit = r.bit
  JOIN side qs ON qs.ordinal = t.ordinal AND qs.split = 'test'
  JOIN side ts ON ts.ordinal = r.ordinal AND ts.split = 'train'
  GROUP BY ALL
),
pairs AS (
  SELECT q.ordinal AS q, t.ordinal AS t, q.label AS true_label, t.label AS pred_label,
         coalesce(s.common, 0)::DOUBLE / greatest(q.n_on + t.n_on - coalesce(s.common, 0), 1) AS score
  FROM side q JOIN side t ON q.split = 'test' AND t.split = 'train'
  LEFT JOIN shared s ON s.q = q.ordinal AND s.t = t.ordinal
),
nearest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, t) AS place FROM pairs) WHERE place = 1
)"""

NEAREST_ROWS = f"""WITH {NEAREST}
SELECT q AS ordinal, true_label::BIGINT AS true_label, pred_label::BIGINT AS pred_label,
       round(score, 9) AS nn_similarity, t AS nn_ordinal FROM nearest"""


def _metrics(rows: str, score: str, threshold: str) -> str:
    """AUC, average precision and confusion counts of (label, score) rows."""
    return f"""
g AS (SELECT {score} AS s, sum(label) AS pos, sum(1 - label) AS neg FROM {rows} GROUP BY 1),
c AS (
  SELECT s, pos::DOUBLE AS pos, neg::DOUBLE AS neg,
         coalesce(sum(pos) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS pb,
         coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS nb,
         (sum(pos) OVER ())::DOUBLE AS p, (sum(neg) OVER ())::DOUBLE AS n
  FROM g
),
m AS (
  SELECT CASE WHEN max(p) > 0 AND max(n) > 0 THEN sum(pos * (nb + neg / 2)) / (max(p) * max(n)) END AS roc_auc,
         CASE WHEN max(p) > 0 THEN sum(pos * (p - pb) / (p - pb + n - nb)) / max(p)
              WHEN max(n) > 0 THEN 0e0 END AS average_precision
  FROM c
),
k AS (
  SELECT count(*) FILTER (label = 0 AND {threshold} = 0) AS tn, count(*) FILTER (label = 0 AND {threshold} = 1) AS fp,
         count(*) FILTER (label = 1 AND {threshold} = 0) AS fn, count(*) FILTER (label = 1 AND {threshold} = 1) AS tp
  FROM {rows}
)"""


RATES = """tn, fp, fn, tp, tn + fp + fn + tp AS n_samples,
  round(coalesce((tn + tp)::DOUBLE / nullif(tn + fp + fn + tp, 0), 0), 9) AS accuracy,
  round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 9) AS precision,
  round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 9) AS recall,
  round(coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1"""

LINES = """
rows AS (SELECT CASE WHEN l_discount >= 0.05e0 THEN 1 ELSE 0 END AS label, l_quantity / 50.0e0 AS score,
                l_extendedprice, CASE WHEN l_quantity / 50.0e0 >= 0.5e0 THEN 1 ELSE 0 END AS hard FROM lineitem)"""


def _rewrites(chain: bool) -> str:
    rules = [("soften", "i", "y"), ("rename", "bolt|ring", "rod"), ("shorten", "[aeo]+", "u")]
    parts = []
    for order, (name, pattern, replacement) in enumerate(rules):
        earlier = [p for _, p, _ in rules[:order]] if chain else []
        alive = " AND ".join([f"regexp_matches(p_name, '{p}')" for p in earlier]) or "true"
        parts.append(f"""
SELECT p_partkey, {order}::BIGINT AS rule_order, '{name}' AS rule, (i - 1)::BIGINT AS site,
  array_to_string(list_transform(range(1, i), lambda j: parts[j] || hits[j]), '') || parts[i] || '{replacement}'
  || parts[i + 1] || array_to_string(list_transform(range(i + 1, len(hits) + 1), lambda j: hits[j] || parts[j + 1]), '')
  AS product
FROM (
  SELECT p_partkey, parts, hits, unnest(range(1, len(hits) + 1)) AS i FROM (
    SELECT p_partkey, regexp_split_to_array(p_name, '{pattern}') AS parts,
           regexp_extract_all(p_name, '{pattern}') AS hits
    FROM part WHERE {alive}
  )
)""")
    return " UNION ALL ".join(parts)


def _round(i: int) -> str:
    pair = "bond || '|' || a || '|' || b"
    own = "h.a || '|' || h.b || '|' || coalesce(lo, 0) || '|' || coalesce(hi, 0)"
    return f"""s{i} AS (
  SELECT e.g, e.src AS v, sum({_piece(pair, 1)})::BIGINT AS lo, sum({_piece(pair, 9)})::BIGINT AS hi
  FROM edg e JOIN h{i - 1} h ON e.g = h.g AND e.dst = h.v GROUP BY 1, 2
),
h{i} AS (
  SELECT h.g, h.v, {_piece(own, 1, 15)} AS a, {_piece(own, 17, 15)} AS b
  FROM h{i - 1} h LEFT JOIN s{i} s ON h.g = s.g AND h.v = s.v
)"""


GRAPH = f"""
lab AS (SELECT l_orderkey AS g, l_partkey * 2 AS p, l_suppkey * 2 + 1 AS s, l_returnflag AS bond, p_type
        FROM lineitem JOIN part ON l_partkey = p_partkey),
vtx AS (SELECT g, p AS v, p_type AS label FROM lab UNION SELECT g, s, 'supplier' FROM lab),
edg AS (SELECT g, p AS src, s AS dst, bond FROM lab UNION ALL SELECT g, s, p, bond FROM lab),
h0 AS (SELECT g, v, {_piece('label', 1, 15)} AS a, {_piece('label', 17, 15)} AS b FROM vtx),
{_round(1)},
{_round(2)},
gb AS (SELECT DISTINCT g AS graph, a % 2048 AS bit FROM (
  SELECT g, a FROM h0 UNION ALL SELECT g, a FROM h1 UNION ALL SELECT g, a FROM h2))"""

DOT = "list_dot_product(a.e, b.e)"


def _supcon(order: str, size: int = 50) -> str:
    return f"""
z AS (SELECT vec_id, embedding::DOUBLE[] AS e, label AS y, (row_number() OVER (ORDER BY {order}) - 1) // {size} AS batch
      FROM embeddings),
sims AS (SELECT a.batch, a.vec_id AS i, a.y = b.y AS same, {DOT} / 0.1e0 AS s
         FROM z a JOIN z b ON a.batch = b.batch AND a.vec_id <> b.vec_id),
tops AS (SELECT *, max(s) OVER (PARTITION BY batch, i) AS top FROM sims),
anchors AS (SELECT batch, i, count(*) FILTER (same) AS npos,
                   sum(CASE WHEN same THEN s ELSE 0 END) AS spos, max(top) + ln(sum(exp(s - top))) AS lse
            FROM tops GROUP BY 1, 2),
losses AS (SELECT batch::BIGINT AS batch, count(*) AS n, count(*) FILTER (npos > 0) AS n_anchors,
                  coalesce(-avg(CASE WHEN npos > 0 THEN spos / npos - lse END), 0) AS loss
           FROM anchors GROUP BY 1)"""


DIMS = "unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS feature"

STATS = f"""
flat AS (SELECT vec_id, {DIMS} FROM embeddings),
stats AS (SELECT feature::BIGINT AS feature, avg(x) AS mean, stddev_pop(x) + 1e-8 AS std FROM flat GROUP BY 1)"""

LEAKS = """
pairs(l, r) AS (VALUES ('train', 'val'), ('train', 'test'), ('val', 'test')),
member AS (SELECT DISTINCT key, split FROM assigned)
SELECT l AS "left", r AS "right", (SELECT count(*) FROM member a JOIN member b ON a.key = b.key
  WHERE a.split = l AND b.split = r) AS n_shared FROM pairs"""


def _clean(col: str) -> str:
    return f"trim({col}, {WS})"


def _overlap(rows: str) -> str:
    """Best partner in 'train' by multiset overlap, for the 'test' rows of a table ``ordinal, key, source, split``."""
    return f"""
tok AS (SELECT ordinal, t, count(*) AS c FROM (SELECT ordinal,
  unnest(regexp_split_to_array(lower(smiles), '[^\\p{{L}}\\p{{N}}]+')) AS t FROM mol WHERE smiles IS NOT NULL)
  WHERE t <> '' GROUP BY 1, 2),
side AS (SELECT a.ordinal, a.key, a.split, CASE WHEN a.source = 'PKS' THEN 1 ELSE 0 END AS label,
  coalesce((SELECT sum(c) FROM tok WHERE tok.ordinal = a.ordinal), 0)::BIGINT AS n FROM {rows} a),
shared AS (SELECT a.ordinal AS q, b.ordinal AS t, sum(least(a.c, b.c)) AS common
  FROM tok a JOIN tok b ON a.t = b.t JOIN side qs ON qs.ordinal = a.ordinal AND qs.split = 'test'
  JOIN side ts ON ts.ordinal = b.ordinal AND ts.split = 'train' GROUP BY ALL),
pairs AS (SELECT q.ordinal AS q, t.ordinal AS t, q.label AS ql, t.label AS tl, t.key,
  coalesce(coalesce(s.common, 0)::DOUBLE / nullif(q.n + t.n - coalesce(s.common, 0), 0), 0) AS score
  FROM side q JOIN side t ON q.split = 'test' AND t.split = 'train'
  LEFT JOIN shared s ON s.q = q.ordinal AND s.t = t.ordinal),
best AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, t) AS place FROM pairs)
SELECT q AS ordinal, ql::BIGINT AS true_label, tl::BIGINT AS pred_label, round(score, 9) AS score, key AS nn_text
FROM best WHERE place = 1"""


SQL: dict[str, str] = {
    "text_lines": f"""SELECT doc_id, line FROM (
        SELECT doc_id, {_clean('x')} AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents)
      ) WHERE line <> ''""",
    "distinct_lines": f"""SELECT DISTINCT line FROM (
        SELECT {_clean('x')} AS line FROM (
          SELECT unnest(string_split(text, chr(10))) AS x FROM documents
          UNION ALL SELECT unnest(string_split(html, chr(10))) FROM pages)) WHERE line <> ''""",
    "map_values": """SELECT event_id, unnest(map_values(props::JSON::MAP(VARCHAR, BIGINT))) AS value FROM events""",
    "tagged_union": """SELECT doc_id AS id, text, 'documents' AS split FROM documents
        UNION ALL SELECT item_id, text, 'benchmark' FROM benchmark
        UNION ALL SELECT conv_id, text, 'conversations' FROM conversations""",
    "csv_roundtrip": "SELECT doc_id, text, lang, n_chars FROM documents",
    "parquet_roundtrip": f"WITH {MOL} SELECT ordinal, source FROM mol",
    "shard_merge": "SELECT o_orderkey, round(o_totalprice, 9) AS o_totalprice FROM orders",
    "shard_states": """SELECT 'shard=' || (o_orderkey % 8) AS shard, 'good' AS state, count(*) AS rows FROM orders GROUP BY 1
        UNION ALL VALUES ('shard=empty', 'empty', 0), ('shard=broken', 'broken', 0), ('shard=8', 'missing', 0)""",
    "shard_merge_checked": "SELECT o_orderkey, round(o_totalprice, 9) AS o_totalprice, 9::BIGINT AS n_removed FROM orders",
    "ordered_merge": """SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) AS place,
        count(*) OVER () AS n FROM orders""",
    "metrics_nan_null": """SELECT l_suppkey, CASE WHEN a >= 0 THEN round(sqrt(a), 6) END AS spread, n FROM (
        SELECT l_suppkey, avg(l_quantity) - 25.5e0 AS a, count(*) AS n FROM lineitem GROUP BY 1)""",
    "ml_export": f"""WITH {MOL}, {BITS} SELECT count(*) AS n_rows, 2048::BIGINT AS width, sum(label)::BIGINT AS n_pos,
        sum(1 - label)::BIGINT AS n_neg, sum(n_on)::BIGINT AS n_set FROM sizes""",
    "label_encode": f"""WITH {MOL} SELECT ordinal, CASE WHEN source = 'PKS' THEN 1 ELSE 0 END::BIGINT AS label FROM mol""",
    "label_fallback": f"""WITH {MOL} SELECT ordinal, CASE WHEN source = 'PKS' THEN 'PKS' ELSE 'non-PKS' END AS name FROM mol""",
    "label_decode": f"""WITH {MOL} SELECT ordinal, CASE WHEN source = 'PKS' THEN 'PKS' ELSE 'non-PKS' END AS name FROM mol""",
    "normalize_key": f"WITH {MOL} SELECT ordinal, sha256(smiles) AS key FROM mol",
    "drop_invalid": f"""SELECT doc_id, count(*) AS n_kept FROM (
        SELECT doc_id, {_norm('x')} AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents)
      ) WHERE line IS NOT NULL GROUP BY 1""",
    "exclude_helpers": "SELECT p_partkey, p_type FROM part WHERE p_type NOT IN ('ECONOMY', 'SMALL') AND p_type <> ''",
    "exclude_table": """SELECT o_orderkey, o_custkey FROM orders o
        WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_acctbal < 0 AND c_custkey = o.o_custkey)""",
    "allow_list": """SELECT s_suppkey, s_nationkey::BIGINT AS s_nationkey FROM supplier
        WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 2))""",
    "forbidden_chars": r"""SELECT doc_id, lang FROM documents
        WHERE contains(text, '@') OR contains(text, '/') OR contains(text, '\')""",
    "forbidden_preview": r"""SELECT doc_id, lang, place FROM (
        SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS place FROM documents
        WHERE contains(text, '@') OR contains(text, '/') OR contains(text, '\')) WHERE place <= 10""",
    "row_at": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 100",
    "label_any": f"WITH {KEYED} SELECT key, label FROM key_labels",
    "class_counts": f"WITH {KEYED} SELECT label, count(*) AS n FROM key_labels GROUP BY 1",
    "class_weights": f"""WITH {KEYED}, n AS (SELECT count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1
        FROM key_labels), c AS (SELECT 0::BIGINT AS label, n0 AS n, n0, n1 FROM n UNION ALL SELECT 1, n1, n0, n1 FROM n)
        SELECT label, n, round((n0 + n1)::DOUBLE / (2 * n), 9) AS balanced,
        round(greatest(n0, 1)::DOUBLE / greatest(n1, 1), 9) AS positive_weight,
        round(1 / (n + 1e-12), 9) AS inverse FROM c""",
    "domain_counts": f"""WITH {MOL}, d(source) AS (VALUES ('PKS'), ('bio'), ('chem'), ('other'))
        SELECT d.source, count(m.source) AS n FROM d LEFT JOIN mol m ON m.source = d.source GROUP BY 1""",
    "compile_dedup": f"""WITH {KEYED} SELECT key, source FROM keyed WHERE source = 'PKS'
        UNION ALL SELECT key, min(source) FROM keyed WHERE source <> 'PKS' GROUP BY key""",
    "keep_first": """SELECT o_custkey, o_orderdate, o_orderkey, o_orderstatus FROM (SELECT *,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1""",
    "first_seen_last_wins": """WITH f AS (SELECT *, row_number() OVER (PARTITION BY l_partkey
          ORDER BY l_orderkey, l_returnflag, l_linenumber, l_suppkey, l_partkey) AS r FROM lineitem),
        g AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey
          ORDER BY l_returnflag DESC, l_linenumber DESC, l_suppkey DESC, l_partkey DESC) AS last,
          count(*) OVER (PARTITION BY l_orderkey) AS n_counted FROM f WHERE r = 1)
        SELECT l_orderkey, l_partkey, n_counted FROM g WHERE last = 1""",
    "distinct_products": f"""SELECT DISTINCT sha256({_norm('text')}) AS key FROM (
        SELECT text FROM documents UNION ALL SELECT text FROM benchmark UNION ALL SELECT text FROM conversations)""",
    "stratified_split": f"WITH {KEYED}, {_split('key_labels', 'key', 'label')} SELECT key, label, split FROM cut",
    "split_segments": f"""WITH {_split('customer', 'c_custkey', 'c_mktsegment')}
        SELECT c_custkey, c_mktsegment, split FROM cut""",
    "split_rows": f"WITH {SPLIT} SELECT ordinal, split FROM assigned",
    "split_leakage": f"WITH {SPLIT}, {LEAKS}",
    "row_split_leakage": f"""WITH {KEYED}, digits AS (
          SELECT key, ('0x' || substr(md5('42|' || ordinal), 1, 1))::INT AS d FROM keyed),
        assigned AS (SELECT key, CASE WHEN d < 12 THEN 'train' WHEN d < 14 THEN 'val' ELSE 'test' END AS split
          FROM digits), {LEAKS}""",
    "leaked_keys": f"""WITH {KEYED}, member AS (SELECT DISTINCT key, source FROM keyed)
        SELECT a.key, a.source AS "left", b.source AS "right" FROM member a JOIN member b ON a.key = b.key
        AND (a.source, b.source) IN (('PKS', 'bio'), ('PKS', 'chem'), ('bio', 'chem'))""",
    "split_ratio_check": f"""WITH {SPLIT},
        ratio AS (SELECT split, avg(CASE WHEN source = 'PKS' THEN 1e0 ELSE 0e0 END) AS v FROM assigned GROUP BY 1),
        pairs(l, r) AS (VALUES ('train', 'val'), ('train', 'test'), ('val', 'test'))
        SELECT l AS "left", r AS "right", round(a.v, 9) AS ratio_left, round(b.v, 9) AS ratio_right,
          round(abs(a.v - b.v), 9) AS difference, abs(a.v - b.v) <= 0.05e0 AS within
        FROM pairs JOIN ratio a ON a.split = l JOIN ratio b ON b.split = r""",
    "pipeline_counts": f"""WITH {MOL} SELECT source, count(*) AS n_loaded, count(text) AS n_not_null,
        count(*) FILTER (smiles IS NULL) AS n_dropped, count(DISTINCT sha256(smiles)) AS n_keys FROM mol GROUP BY 1""",
    "even_chunks": "SELECT o_orderkey, ntile(7) OVER (ORDER BY o_orderkey) - 1 AS chunk FROM orders",
    "fixed_batches": """SELECT o_orderkey, batch FROM (SELECT o_orderkey,
        (row_number() OVER (ORDER BY o_orderkey) - 1) // 256 AS batch, count(*) OVER () AS n FROM orders)
        WHERE (batch + 1) * 256 <= n""",
    "epoch_batches": """SELECT o_orderkey, batch FROM (SELECT o_orderkey,
        (row_number() OVER (ORDER BY md5('42|3|' || o_orderkey), o_orderkey) - 1) // 256 AS batch,
        count(*) OVER () AS n FROM orders) WHERE (batch + 1) * 256 <= n""",
    "head_cap": "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 1000",
    "stratified_cap": """SELECT c_custkey, c_mktsegment FROM (SELECT c_custkey, c_mktsegment,
        row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('42|' || c_custkey), c_custkey) AS r,
        count(*) OVER (PARTITION BY c_mktsegment) AS n, count(*) OVER () AS a FROM customer)
        WHERE r <= ceil(500 * n / a)""",
    "sample_exact": """SELECT o_orderkey, o_custkey FROM orders
        ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 1000""",
    "weighted_resample": f"""WITH {MOL},
        lab AS (SELECT ordinal, CASE WHEN source = 'PKS' THEN 1 ELSE 0 END::BIGINT AS label FROM mol),
        pos AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY ordinal) AS r FROM lab),
        cnt AS (SELECT count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1, count(*) AS n FROM lab),
        num AS (SELECT unnest(range(1, n + 1)) AS draw, n0, n1 FROM cnt),
        pick AS (SELECT draw, n0, n1, CASE WHEN n1 = 0 THEN 0 WHEN n0 = 0 THEN 1
          WHEN {_uniform("'42|class|' || draw")} >= 0.5e0 THEN 1 ELSE 0 END AS label FROM num),
        place AS (SELECT draw, label, floor({_uniform("'42|row|' || draw")} * (CASE WHEN label = 1 THEN n1 ELSE n0 END))::BIGINT
          + 1 AS r FROM pick)
        SELECT draw, ordinal, pos.label FROM place JOIN pos ON pos.label = place.label AND pos.r = place.r""",
    "hash_fingerprint": f"WITH {MOL}, {BITS} SELECT ordinal, bit FROM bits",
    "gram_fingerprint": f"""SELECT DISTINCT p_partkey, {_bit('g')} AS bit FROM (SELECT p_partkey,
        substr(p_name, unnest(range(1, greatest(length(p_name) - 2, 1) + 1))::INT, 3) AS g FROM part) WHERE g <> ''""",
    "fingerprint_rows": f"WITH {MOL}, {BITS} SELECT ordinal, n_on, bit_sum FROM sizes",
    "popcount": f"WITH {MOL}, {BITS} SELECT ordinal, n_on FROM sizes",
    "pack_words": f"""WITH {MOL}, {BITS}, w AS (
          SELECT ordinal, bit // 64 AS word, bit_or(CASE WHEN bit % 64 = 63 THEN (-9223372036854775807 - 1)::BIGINT
            ELSE (1::BIGINT << (bit % 64)::INT) END) AS value FROM bits GROUP BY 1, 2)
        SELECT s.ordinal, x.word, coalesce(w.value, 0)::BIGINT AS value
        FROM sizes s CROSS JOIN (SELECT unnest(range(0, 32)) AS word) x
        LEFT JOIN w ON w.ordinal = s.ordinal AND w.word = x.word""",
    "unpack_words": f"WITH {MOL}, {BITS} SELECT ordinal, bit FROM bits",
    "assemble_norms": f"WITH {MOL}, {BITS} SELECT ordinal, n_on, bit_sum FROM sizes",
    "graph_fingerprint": f"WITH {GRAPH} SELECT graph, bit FROM gb",
    "graph_fingerprint_rows": f"WITH {GRAPH} SELECT graph, count(*) AS n_on, sum(bit)::BIGINT AS bit_sum FROM gb GROUP BY 1",
    "tanimoto_nn": NEAREST_ROWS,
    "tanimoto_nn_prefix": NEAREST_ROWS,
    "knn_graph": f"""WITH {MOL}, {BITS},
        shared AS (SELECT a.ordinal AS q, b.ordinal AS t, count(*) AS common FROM bits a JOIN bits b
          ON a.bit = b.bit AND a.ordinal <> b.ordinal GROUP BY ALL),
        pairs AS (SELECT q.ordinal AS ordinal, t.ordinal AS neighbour,
          coalesce(s.common, 0)::DOUBLE / greatest(q.n_on + t.n_on - coalesce(s.common, 0), 1) AS score
          FROM sizes q JOIN sizes t ON q.ordinal <> t.ordinal
          LEFT JOIN shared s ON s.q = q.ordinal AND s.t = t.ordinal),
        placed AS (SELECT *, row_number() OVER (PARTITION BY ordinal ORDER BY score DESC, neighbour) AS place FROM pairs)
        SELECT ordinal, place, neighbour, round(score, 9) AS score FROM placed
        WHERE place <= least(50, greatest(10, (SELECT floor(sqrt(count(*)) / 10) FROM sizes)))""",
    "overlap_nn": f"WITH {SPLIT}, {_overlap('assigned')}",
    "overlap_nn_bounded": f"""WITH {KEYED},
        parted AS (SELECT *, CASE WHEN source = 'PKS' THEN 'test' ELSE 'train' END AS split FROM keyed), {_overlap('parted')}""",
    "udf_pair_bounded": """WITH q AS (SELECT * FROM pages WHERE page_id % 20 = 0), t AS (SELECT * FROM pages WHERE page_id % 20 <> 0),
        p AS (SELECT q.page_id AS q, t.page_id AS t, t.url, 1 - levenshtein(q.url, t.url) / greatest(length(q.url), length(t.url))::DOUBLE AS score FROM q, t),
        r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, t) AS place FROM p)
        SELECT q::BIGINT AS ordinal, (q % 2)::BIGINT AS true_label, (t % 2)::BIGINT AS pred_label, round(score, 9) AS score, url AS nn_text
        FROM r WHERE place = 1""",
    "udf_pair_score": """WITH p AS (SELECT item_id, doc_id, n_chars,
          least(length(b.text), n_chars)::DOUBLE / greatest(length(b.text), n_chars) AS score FROM benchmark b, documents),
        r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM p)
        SELECT item_id AS ordinal, 0::BIGINT AS pred_label, round(score, 9) AS score, n_chars::VARCHAR AS nn_text
        FROM r WHERE place = 1""",
    "enumerate_designs": """SELECT s_name AS starter, n_name AS modules, 1::BIGINT AS length FROM supplier, nation
        UNION ALL SELECT s_name, a.n_name || '|' || b.n_name, 2 FROM supplier, nation a, nation b
        WHERE a.n_name <> b.n_name""",
    "apply_rules": f"SELECT p_partkey, p_name, rule_order, rule, site, product FROM ({_rewrites(False)}) JOIN part USING (p_partkey)",
    "apply_rules_indexed": """SELECT c_custkey, c_name, rule_order, rule, site, product FROM (
        SELECT c_custkey, c_name, right(c_name, 4)::BIGINT AS rule_order, 'end ' || right(c_name, 4)::BIGINT AS rule, 0::BIGINT AS site,
          left(c_name, length(c_name) - 4) || 'last' AS product FROM customer WHERE right(c_name, 4)::BIGINT < 4999
        UNION ALL SELECT c_custkey, c_name, 4999, 'any', 0, replace(c_name, 'mer', '~') FROM customer WHERE contains(c_name, 'mer')
        UNION ALL SELECT c_custkey, c_name, 4999, 'any', CASE WHEN contains(c_name, 'mer') THEN 1 ELSE 0 END,
          regexp_replace(c_name, '#0+', '~') FROM customer WHERE regexp_matches(c_name, '#0'))""",
    "rule_bodies": """SELECT p_partkey, p_name, 0::BIGINT AS rule_order, 'halves' AS rule, 0::BIGINT AS site, split_part(p_name, ' ', 1) AS product
        FROM part WHERE contains(p_name, ' ')
        UNION ALL SELECT p_partkey, p_name, 0, 'halves', 1, substr(p_name, instr(p_name, ' ') + 1) FROM part WHERE contains(p_name, ' ')
        UNION ALL SELECT p_partkey, p_name, 1, 'tenth', 0, substr(p_name, 10, 1) || p_name FROM part WHERE length(p_name) >= 10""",
    "apply_rules_chain": f"SELECT p_partkey, p_name, rule_order, rule, site, product FROM ({_rewrites(True)}) JOIN part USING (p_partkey)",
    "rule_counts": " UNION ALL ".join(
        f"SELECT '{name}' AS rule, count(*) FILTER (regexp_matches(p_name, '{p}')) AS n_matched, "
        f"count(*) FILTER (NOT regexp_matches(p_name, '{p}')) AS n_unmatched FROM part"
        for name, p in (("soften", "i"), ("rename", "bolt|ring"), ("shorten", "[aeo]+"))
    ),
    "expand_one_step": f"""SELECT DISTINCT product FROM (SELECT product FROM ({_rewrites(False)})
        UNION ALL SELECT p_name FROM part) WHERE product NOT IN ('red gear', 'blue rod') AND product <> ''""",
    "udf_map_rows": "SELECT doc_id, unnest(range(0, n_chars // 2000)) AS page FROM documents WHERE n_chars >= 100",
    "own_geometric_mean": """SELECT l_returnflag, l_linestatus, round(exp(avg(ln(l_extendedprice::DOUBLE))), 4) AS geometric_mean,
        count(*) AS n FROM lineitem GROUP BY 1, 2""",
    "own_top_three": """SELECT l_orderkey, string_agg(l_linenumber::VARCHAR, ',' ORDER BY place) AS lines FROM (
        SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS place
        FROM lineitem) WHERE place <= 3 GROUP BY 1""",
    "confusion_report": f"WITH {LINES}, {_metrics('rows', 'score', 'hard')} SELECT {RATES} FROM k",
    "roc_auc": f"WITH {LINES}, {_metrics('rows', 'l_extendedprice', 'hard')} SELECT round(roc_auc, 9) AS roc_auc FROM m",
    "average_precision": f"""WITH {LINES}, {_metrics('rows', 'l_extendedprice', 'hard')}
        SELECT round(average_precision, 9) AS average_precision FROM m""",
    "eval_report": f"""WITH {LINES}, {_metrics('rows', 'score', 'hard')} SELECT {RATES}, round(roc_auc, 9) AS roc_auc,
        round(average_precision, 9) AS average_precision FROM k, m""",
    "neighbour_report": f"""WITH {NEAREST}, hits AS (SELECT true_label AS label, pred_label FROM nearest),
        {_metrics('hits', 'pred_label', 'pred_label')}
        SELECT round((tn + tp)::DOUBLE / (tn + fp + fn + tp), 9) AS acc, round(roc_auc, 9) AS auroc,
          round(average_precision, 9) AS auprc, tn + fp + fn + tp AS n_rows, tp + fn AS n_pos FROM k, m""",
    "best_epoch": """SELECT event_type, event_id AS best_epoch, round(value, 9) AS best_ap FROM (SELECT *, row_number()
        OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events WHERE value IS NOT NULL) WHERE r = 1""",
    "feature_stats": f"WITH {STATS} SELECT feature, round(mean, 9) AS mean, round(std, 9) AS std FROM stats",
    "standardize": f"""WITH {STATS} SELECT vec_id, f.feature::BIGINT AS feature, round((x - mean) / std, 6) AS value
        FROM flat f JOIN stats s ON s.feature = f.feature""",
    "l2_normalize": """SELECT vec_id, (generate_subscripts(e, 1) - 1)::BIGINT AS feature, round(unnest(e), 9) AS value FROM (
        SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / greatest(
          sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12)) AS e FROM embeddings)""",
    "vector_products": """SELECT vec_id, round(sqrt(list_dot_product(e, e)), 9) AS norm,
        round(list_dot_product(e, list_reverse(e)), 9) AS mirrored
        FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)""",
    "supcon_loss": f"WITH {_supcon('vec_id')} SELECT batch, n, n_anchors, round(loss, 9) AS loss FROM losses",
    "supcon_one_batch": f"WITH {_supcon('vec_id', 10**15)} SELECT batch, n, n_anchors, round(loss, 9) AS loss FROM losses",
    "supcon_epoch_mean": f"""WITH {_supcon("md5('42|1|' || vec_id), vec_id")}
        SELECT round(avg(loss), 9) AS mean_loss, count(*) AS n_batches FROM losses""",
    "score_from_weights": f"""WITH {MOL}, {BITS},
        w AS (SELECT bit, avg(label) - 0.05e0 AS weight FROM bits JOIN sizes USING (ordinal) GROUP BY 1)
        SELECT s.ordinal, round(1 / (1 + exp(-(-0.5e0 + coalesce(sum(weight), 0)))), 9) AS score
        FROM sizes s LEFT JOIN bits b ON b.ordinal = s.ordinal LEFT JOIN w ON w.bit = b.bit GROUP BY 1""",
    "saved_weights": f"""WITH {MOL}, {BITS},
        w AS (SELECT bit, avg(label) - 0.05e0 AS weight FROM bits JOIN sizes USING (ordinal) GROUP BY 1)
        SELECT s.ordinal, round(1 / (1 + exp(-(-0.5e0 + coalesce(sum(weight), 0)))), 9) AS score
        FROM sizes s LEFT JOIN bits b ON b.ordinal = s.ordinal LEFT JOIN w ON w.bit = b.bit GROUP BY 1""",
    "train_linear": "SELECT unnest(range(-1, 2048)) AS feature, true AS flat",
    "score_linear": f"""WITH {SPLIT}, {BITS} SELECT s.ordinal, s.label::BIGINT AS label, 0e0 AS difference
        FROM sizes s JOIN assigned a ON s.ordinal = a.ordinal WHERE a.split = 'test'""",
    "project_2d": f"""WITH r AS (SELECT vec_id, label::VARCHAR AS source, CASE WHEN label = 3 THEN 1 ELSE 0 END AS label
          FROM embeddings), {_split('r', 'vec_id', 'label')}
        SELECT vec_id::VARCHAR AS smiles, source, split, CASE WHEN r.label = 1 THEN 'PKS' ELSE 'non-PKS' END AS is_pks,
        0e0 AS off_diagonal, true AS ordered FROM r JOIN cut USING (vec_id)""",
    "split_files": f"WITH {SPLIT} SELECT key, source, split FROM assigned",
    "training_export": f"""WITH {MOL}, {BITS} SELECT count(*) AS n_rows, 2048::BIGINT AS width, sum(label)::BIGINT AS n_pos,
        sum(1 - label)::BIGINT AS n_neg, sum(n_on)::BIGINT AS n_set FROM sizes""",
    "neighbour_table": f"""WITH {NEAREST}
        SELECT a.key, CASE WHEN true_label = 1 THEN 'PKS' ELSE 'non-PKS' END AS true_label,
          CASE WHEN pred_label = 1 THEN 'PKS' ELSE 'non-PKS' END AS pred_label, round(score, 9) AS nn_similarity, b.key AS nn_key
        FROM nearest n JOIN assigned a ON a.ordinal = n.q JOIN assigned b ON b.ordinal = n.t""",
    "model_metadata": f"""WITH {KEYED} SELECT count(*) AS train_rows, 2048::BIGINT AS n_features,
        count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg FROM key_labels""",
}
