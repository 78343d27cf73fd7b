"""DuckDB SQL, written from the contracts, for the queries whose whole result SQL can express."""

from __future__ import annotations

from periodica.llm.quality import ORACLE as QUALITY

_COMPONENTS = """both_ways as (select a, b from link union all select b, a from link),
reach as (select a node, b other from both_ways union select r.node, e.b from reach r join both_ways e on e.a = r.other),
least as (select node, min(other) m from reach group by 1)"""

NEAR = (
    """with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w from documents),
s as (select distinct doc_id, s from (select doc_id, case when len(w) < 4 then array_to_string(w, ' ') else w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] end s from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) i from w where len(w) > 0))),
n as (select doc_id, count(*) n from s group by 1),
pair as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
link as (select a, b from pair join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
"""
    + _COMPONENTS
    + """
select w.doc_id, coalesce(n.n, 0)::bigint n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) component_id, least(w.doc_id, coalesce(m, w.doc_id)) = w.doc_id kept from w left join n using (doc_id) left join least on least.node = w.doc_id"""
)

VECTORS = (
    """with recursive v as (select vec_id, label, embedding::double[] e from embeddings where label is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
  and list_max(list_transform(embedding, lambda x: abs(x))) > 0),
link as (select a.vec_id a, b.vec_id b from v a join v b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id < b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.93),
"""
    + _COMPONENTS
    + """
select x.vec_id, (select count(*) from both_ways where a = x.vec_id)::bigint n_links, least(x.vec_id, coalesce(m, x.vec_id)) component_id, least(x.vec_id, coalesce(m, x.vec_id)) = x.vec_id kept from embeddings x left join least on least.node = x.vec_id"""
)

WARC = """with p as (select page_id, coalesce(html, '') h from pages), d as (select page_id, octet_length(encode(h))::bigint n, sha1(h) x, h from p),
b as (select *, max(page_id) over (partition by h) m, list_transform(range(40), lambda i: instr('0123456789abcdef', x[i+1]) - 1) hex from d)
select page_id, n payload_bytes, array_to_string(list_transform(range(32), lambda j: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + list_sum(list_transform(range(5), lambda t: (((hex[(5*j+t)//4 + 1] >> (3 - (5*j+t)%4)) & 1) << (4 - t))))::int]), '') payload_digest,
 case when m = page_id then 'response' else 'revisit' end record_type, case when m <> page_id then m end refers_to from b"""


def oracle_sql() -> dict[str, str]:
    return {"op5_minhash_dedup": NEAR, "op6_quality_rules": QUALITY.format(docs="documents"), "op8_vector_dedup": VECTORS, "op10_warc": WARC}
