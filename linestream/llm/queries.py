"""One query per operator, over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from linestream.llm.alignment import alignment_digest
from linestream.llm.common import table
from linestream.llm.curves import nearest
from linestream.llm.jaccard import jaccard_components
from linestream.llm.licences import licence_digest
from linestream.llm.mixing import mix_documents
from linestream.llm.packing import pack_documents
from linestream.llm.pii import scan_personal_data
from linestream.llm.quality import score_quality
from linestream.llm.scoring import score_documents
from linestream.llm.secrets import scan_secrets
from linestream.llm.topk import top_products
from linestream.llm.urls import filter_sql, filter_urls
from linestream.llm.whitening import whiten

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return put


@query("op4_quality_classifier")
def _(spark, sf):
    return score_quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op8_curve_packing")
def _(spark, sf):
    return pack_documents(table(spark, sf, "documents"))


@query("op10_source_mixing")
def _(spark, sf):
    return mix_documents(table(spark, sf, "documents"))


OP2 = """
with v as (
  select vec_id, min(embedding) x from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0
  group by vec_id),
w as (select vec_id, list_transform(x, lambda e: floor(256 * e::double)::bigint) q from v),
s as (
  select a.vec_id query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::bigint score
  from w a, w b where a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""


@query("op2_norm_bucket_topk", OP2)
def _(spark, sf):
    return top_products(table(spark, sf, "embeddings"))


@query("op3_shifted_curves")
def _(spark, sf):
    return nearest(table(spark, sf, "embeddings"))


OP5 = r"""
with recursive w as (
  select row_number() over () uid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws
  from documents),
s as (
  select distinct uid, unnest(case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) end) sh
  from w),
n as (select uid, count(*) n from s group by uid),
p as (
  select a.uid u, b.uid v, count(*) i from s a join s b on a.sh = b.sh and a.uid < b.uid group by all),
l as (
  select u, v from p join n x on x.uid = u join n y on y.uid = v where 100 * i >= 90 * (x.n + y.n - i)),
e as (select u, v from l union all select v, u from l),
r(uid, node) as (select uid, uid from w union select r.uid, e.v from r join e on e.u = r.node),
c as (select r.uid, min(w.doc_id) component_id from r join w on w.uid = r.node group by r.uid)
select w.doc_id, coalesce(n.n, 0)::bigint n_shingles, c.component_id
from w left join n using (uid) join c using (uid)
"""


@query("op5_prefix_tree_join", OP5)
def _(spark, sf):
    return jaccard_components(table(spark, sf, "documents"))


@query("op7_markov_secrets")
def _(spark, sf):
    return scan_secrets(table(spark, sf, "documents"))


@query("op9_candidate_boosting")
def _(spark, sf):
    return scan_personal_data(table(spark, sf, "documents"))


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query("op1_link_propagation", filter_sql(URL_RULES))
def _(spark, sf):
    return filter_urls(table(spark, sf, "pages"), URL_RULES)


@query("op6_elias_fano_scores")
def _(spark, sf):
    return score_documents(table(spark, sf, "documents"))


@query("op11_qdwh_whitening")
def _(spark, sf):
    return whiten(table(spark, sf, "embeddings"))


@query("op12_licence_scan")
def _(spark, sf):
    return licence_digest(table(spark, sf, "documents"))


@query("op13_token_alignment")
def _(spark, sf):
    return alignment_digest(table(spark, sf, "documents"))
