"""The queries as DuckDB SQL, where SQL can express them."""

SQL = {
    "op3_exact_dedup": r"""
        with t as (
            select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents
        )
        select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size,
            doc_id is not distinct from min(doc_id) over w as kept, sha256(norm) as text_sha256
        from t window w as (partition by norm)
    """,
    "op5_top_k": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
            where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), s as (
            select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
            from v q, v c where q.vec_id % 50 = 0 and c.vec_id <> q.vec_id
        )
        select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
        from s qualify row_number() over (partition by query_id order by score desc, vec_id) <= 5
    """,
    "op10_url_filter": r"""
        with p as (
            select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest
            from pages
        ), q as (
            select page_id, regexp_extract(rest, '^[^/?#]*') as host,
                regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') as path from p
        ), h as (
            select page_id, translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from q
        ), rules(verdict, host, path) as (
            values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
        ), fits as (
            select h.page_id, max_by(r.host || r.path, length(r.host || r.path)) as rule,
                max_by(r.verdict, length(r.host || r.path)) as verdict
            from h join rules r on (h.host = r.host or ends_with(h.host, '.' || r.host)) and starts_with(h.path, r.path)
            group by h.page_id
        )
        select h.page_id, h.host, h.path, f.rule, coalesce(f.verdict, 'allow') as verdict from h left join fits f using (page_id)
    """,
    "op11_conversation_trie": r"""
        with t as (
            select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as p,
                coalesce(role, '') as role, coalesce(text, '') as text
            from conversations where conv_id is not null
        ), c as (
            select distinct conv_id, conv_id - conv_id % 20 as base, xor(list_reduce(
                flatten(list_transform(string_split(conv_id::varchar, ''), lambda x: [ascii(x), -1, -1, -1, -1, -1, -1, -1, -1])),
                lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, 3988292384 * (a & 1)) end, 4294967295::bigint), 4294967295) % 4 as h
            from t
        ), lengths as (
            select conv_id as base, count(*) as m from t group by all
        ), r as (
            select c.conv_id, t.p as d, t.role, t.text from c join t on t.conv_id = c.base and t.p < c.h
            union all
            select c.conv_id, least(c.h, coalesce(m, 0)) + t.p - c.h, t.role, t.text
            from c join t using (conv_id) left join lengths using (base) where t.p >= c.h
        ), s as (
            select c.conv_id, coalesce(list({'r': role, 't': text} order by d) filter (d is not null), []) as seq
            from c left join r using (conv_id) group by all
        ), prefixes as (
            select conv_id, len(seq) as n, d, seq[1:d] as node from (select conv_id, seq, unnest(range(0, len(seq) + 1)) as d from s)
        ), nodes as (
            select node, d as depth, count(*) as n_convs, min(conv_id) as conv_id,
                coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (n = d), '') as ends
            from prefixes group by all
        ), kids as (
            select node[1:depth - 1] as node, count(*) as n_children from nodes where depth > 0 group by all
        ), own as (
            select nodes.*, coalesce(n_children, 0) as n_children,
                case when depth = 0 then 0 else (n_convs - 1) * len(regexp_extract_all(node[depth].t, '[^\x20\x09-\x0D]+')) end as saved
            from nodes left join kids using (node)
        ), subtrees as (
            select node[1:a] as node, count(*) filter (n_children = 0) as n_leaves, sum(saved)::bigint as saved_tokens
            from (select node, n_children, saved, unnest(range(0, depth + 1)) as a from own) group by all
        )
        select o.conv_id, o.depth, p.conv_id as parent_conv_id, o.n_convs, o.n_children, n_leaves, saved_tokens, sha256(o.ends) as ends_sha256
        from own o join subtrees using (node) left join nodes p on o.depth > 0 and p.node = o.node[1:o.depth - 1]
    """,
    "op12_centroids": """
        with v as materialized (
            select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as x from embeddings
            where embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), c0 as (
            select row_number() over (order by sha256('1:' || vec_id) nulls last, x) - 1 as cluster, x from v
            qualify row_number() over (order by sha256('1:' || vec_id) nulls last, x) <= 16
        ), ROUNDS, a as materialized (
            ASSIGN3
        )
        select vec_id, cluster::integer as cluster, distance, sum(distance) over (partition by cluster)::bigint as cluster_inertia,
            sum(distance) over ()::bigint as inertia, sha256(array_to_string(c3.x, ',')) as centroid_sha256
        from a join c3 using (cluster)
    """,
    "op13_decontaminate": r"""
        with d as (
            select row_number() over () as row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
        ), i as (
            select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where text is not null
        ), grams as (
            select distinct item_id, n, array_to_string(w[a:a + n - 1], ' ') as gram
            from (select item_id, w, least(10, len(w)) as n, unnest(range(1, len(w) - least(10, len(w)) + 2)) as a from i where len(w) > 0)
        ), windows as (
            select row, a, n, array_to_string(w[a:a + n - 1], ' ') as gram
            from (select row, w, n, unnest(range(1, len(w) - n + 2)) as a from d, (select distinct n from grams) where len(w) >= n)
        ), hits as (
            select row, a, n, item_id from windows join grams using (n, gram)
        ), words as (
            select row, count(distinct word) as n_hit from (select distinct row, unnest(range(a, a + n)) as word from hits) group by all
        ), items as (
            select row, count(*) as n_items, string_agg(id, ',' order by id) as ids
            from (select distinct row, item_id::varchar as id from hits where item_id is not null) group by all
        )
        select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
            coalesce(n_hit, 0) > 0 as contaminated
        from d left join words using (row) left join items using (row)
    """,
}

_ASSIGN = """
            select vec_id, x, cluster, distance from (
                select v.vec_id, v.x, c.cluster, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as distance,
                    v.row
                from (select row_number() over () as row, * from v) v, c{n} c
            ) qualify row_number() over (partition by row order by distance, cluster) = 1
"""
_ROUND = """a{n} as materialized ({assign}), s{n} as (
            select cluster, dim, count(*) as n, sum(value)::bigint as s from (select cluster, unnest(x) as value, unnest(range(1, 65)) as dim from a{n}) group by all
        ), c{next} as materialized (
            select c{n}.cluster, coalesce(m.x, c{n}.x) as x from c{n}
            left join (select cluster, list((s - ((s % n) + n) % n) // n order by dim) as x from s{n} group by all) m using (cluster)
        )"""
SQL["op12_centroids"] = SQL["op12_centroids"].replace("ASSIGN3", _ASSIGN.format(n=3).strip()).replace(
    "ROUNDS", ", ".join(_ROUND.format(n=n, next=n + 1, assign=_ASSIGN.format(n=n).strip()) for n in range(3)))
