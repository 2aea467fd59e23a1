"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from scholia.llm import bpe, chat, codes, decontam, lexical, licenses, linededup, neardup, packing, quality, sharding, tokenfile, toxicity

QUERIES = {
    "op1_kd_shards": sharding.op1,
    "op2_license_scan": licenses.op2,
    "op3_chat_windows": chat.op3,
    "op4_superminhash": neardup.op4,
    "op5_decision_list": quality.op5,
    "op6_shortest_pack_first": packing.op6,
    "op7_template_leaks": decontam.op7,
    "op8_weak_supervision": toxicity.op8,
    "op9_line_similarity_join": linededup.op9,
    "op10_token_files": tokenfile.op10,
    "op11_rank_array_bpe": bpe.op11,
    "op12_active_entry_lloyd": codes.op12,
    "op13_geometric_blocks": lexical.op13,
}

_LOWER = f"translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}')"

#: Whole tables, exact: links by shared shingles, groups by reach.
_OP4 = rf"""with recursive w as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as w from documents),
 sets as (select doc_id, case when len(w) >= 5 then list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from w),
 n as (select doc_id, len(s) as n from sets), sh as (select doc_id, unnest(s) as s from sets),
 pairs as (select a.doc_id as x, b.doc_id as y, count(*) as c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
 links as (select x, y from pairs join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 75 * (nx.n + ny.n - c)),
 arcs as (select x, y from links union all select y, x from links),
 reach(d, r) as (select doc_id, doc_id from n union select d, y from reach join arcs on x = r)
 select doc_id, n::bigint as n_shingles, least_id as component_id, doc_id = least_id as kept from n join (select d, min(r) as least_id from reach group by 1) on d = doc_id"""

_OP9 = r"""with l as (select doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i, unnest(string_split(text, chr(10))) as line from documents where text is not null),
 w as (select doc_id, i, line, regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+') as w from l),
 sets as (select doc_id, i, row_number() over (order by doc_id, i) as o, case when len(w) >= 5 then list_distinct([array_to_string(w[k:k + 4], ' ') for k in range(1, len(w) - 3)]) else [array_to_string(w, ' ')] end as s from w where len(w) > 0),
 sh as (select o, len(s) as n, unnest(s) as s from sets),
 dup as (select distinct x from (select a.o as x, b.o as y, any_value(a.n) as nx, any_value(b.n) as ny, count(*) as c from sh a join sh b on a.s = b.s and b.o < a.o group by 1, 2) where 100 * c >= 75 * (nx + ny - c)),
 gone as (select doc_id, i from sets join dup on x = o),
 kept as (select l.doc_id, count(g.i) as n, coalesce(string_agg(line, chr(10) order by l.i) filter (g.i is null), '') as t from l left join gone g on g.doc_id = l.doc_id and g.i = l.i group by 1)
 select doc_id, n::bigint as n_removed, length(t)::bigint as n_chars, md5(t) as text_md5 from kept"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Every document against every item that shares a term with it.
_OP13 = rf"""with t as materialized (select d, doc_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) as t from (select row_number() over () as d, * from documents)),
 tf as (select d, any_value(doc_id) as doc_id, t, count(*) as tf from t group by d, t), dl as (select d, count(*) as n from t group by 1),
 g as (select count(*) as n_docs, sum(n)::bigint as n_words from dl), df as (select t, count(*) as df from tf group by 1),
 q as (select distinct item_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) as t from benchmark),
 w as (select t, floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)::double))::bigint as w from df, g where t in (select t from q)),
 c as (select d, doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_words))) as c from tf join dl using (d) join w using (t), g),
 s as (select item_id, d, any_value(doc_id) as doc_id, sum(c)::bigint as score from q join c using (t) group by 1, 2 having sum(c) > 0)
 select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score from s qualify rank <= {lexical.BEST}"""


def _op12() -> str:
    """Six full rounds, each with all distances; a part's code is the least of
    distance * entries + entry."""
    k, parts = codes.ENTRIES, codes.PARTS
    near = f"min(list_sum(list_transform(range(1, len(v.x) + 1), lambda i: (v.x[i] - b.x[i]) * (v.x[i] - b.x[i])))::bigint * {k} + b.e)"
    steps = [f"""v as materialized (select vec_id, label, list_transform(embedding, lambda c: floor({codes.SCALE} * c::double)::bigint) as x from embeddings
 where len(embedding) > 0 and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
 p as materialized (select vec_id, label, k.k as p, x[k.k * (len(x) // {parts}) + 1:(k.k + 1) * (len(x) // {parts})] as x from v, range({parts}) k(k)),
 b0 as materialized (select p, e, x from p join (select vec_id, row_number() over (order by vec_id) - 1 as e from v qualify e < {k}) using (vec_id))"""]
    for i in range(codes.ROUNDS + 1):
        steps.append(f"a{i} as materialized (select v.vec_id, v.p, any_value(v.label) as label, any_value(v.x) as x, {near} as m from p v join b{i} b using (p) group by 1, 2)")
        if i < codes.ROUNDS:
            steps.append(f"""b{i + 1} as materialized (select p, e, coalesce(s.x, b.x) as x from b{i} b left join
 (select p, e, list((s - ((s % n) + n) % n) // n order by c) as x from (select p, e, c, sum(y)::bigint as s, count(*) as n from
 (select p, m % {k} as e, unnest(x) as y, generate_subscripts(x, 1) as c from a{i}) group by 1, 2, 3) group by 1, 2) s using (p, e))""")
    last = codes.ROUNDS
    return f"""with {", ".join(steps)},
 r as (select vec_id, any_value(label) as label, string_agg(printf('%02x', m % {k}), '' order by p) as code, sum(m // {k})::bigint as error from a{last} group by 1)
 select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error,
 (select sha256(string_agg(y, ',' order by p, e, c)) from (select p, e, unnest(x)::varchar as y, generate_subscripts(x, 1) as c from b{last})) as codebooks_sha256 from r"""


#: The others rest on learned models, tokenizers or encodings, which SQL doesn't
#: have; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op4_superminhash": _OP4.replace("\\\\", "\\"), "op9_line_similarity_join": _OP9.replace("\\\\", "\\"), "op12_active_entry_lloyd": _op12(), "op13_geometric_blocks": _OP13}
