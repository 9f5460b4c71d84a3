"""DuckDB SQL for the queries that have an exact answer in SQL, built from shared CTEs."""

from __future__ import annotations


def uniform(text: str, start: int = 1) -> str:
    return f"((('0x' || substr({text}, {start}, 13))::bigint + 0.5) / 4503599627370496.0)"


RAW = """
accounts as (select ((max(user_id) + 1) * 11) // 10 n from events),
drawn as (
  select *, cast(props->>'$.k' as int) k,
         (event_id % 2147483647 * 48271 % 2147483647 * 69621 % 2147483647) / 2147483647.0::double d
  from events),
raw as (
  select case when k <> 13
              then event_type || '-' || strftime(ts, '%Y%m%d') || '-' || user_id end tweet_id,
         'u' || user_id src_user_id,
         case when event_id % 67 <> 0 then 'u' || cast(floor(pow(d, 2.0) * n) as bigint)
                || case when event_id % 59 = 0 then ' ' else '' end end dst_user_id,
         event_type interaction_type,
         case when event_id % 53 = 0 then ' ' else '' end
           || case when k < 50 then 'fake' when k < 75 then 'unverified' when k < 95 then 'real'
                   else 'satire' end veracity,
         event_id "timestamp"
  from drawn, accounts)"""

CLEAN = f"""{RAW},
numbered as (
  select *, row_number() over (
    partition by tweet_id
    order by "timestamp" nulls first, src_user_id nulls first, dst_user_id nulls first,
             interaction_type nulls first, veracity nulls first) rn
  from raw
  where src_user_id is not null and dst_user_id is not null and veracity is not null
    and src_user_id <> dst_user_id),
clean as (
  select tweet_id, src_user_id, dst_user_id, interaction_type, veracity, "timestamp"
  from numbered where rn = 1 and veracity in ('fake', 'real', 'unverified')),
weighted as (
  select *, case veracity when 'fake' then 1.0::double when 'unverified' then 0.5::double
                 else 0.2::double end veracity_weight
  from clean)"""

EDGES = f"""{CLEAN},
totals as (
  select src_user_id, dst_user_id,
         sum(veracity_weight::decimal(18, 6))::double veracity_score,
         count(*) interaction_count,
         first(interaction_type order by "timestamp" nulls first, tweet_id nulls first,
               interaction_type nulls first) interaction_type
  from weighted group by 1, 2),
edge_table as (
  select *, veracity_score + ln(1.0::double + interaction_count) edge_weight from totals)"""

GRAPH = f"""{EDGES},
e as (select src_user_id src, dst_user_id dst, edge_weight::decimal(28, 9)::double weight
      from edge_table where edge_weight >= 0.1),
nodes as (select src id from e union select dst from e),
outs as (select src, sum(weight::decimal(28, 9))::double out_weight, count(*) out_degree from e group by 1)"""

EDGE_COLUMNS = """src_user_id, dst_user_id, round(veracity_score, 6) veracity_score,
  interaction_count, interaction_type, round(edge_weight, 6) edge_weight"""


def pagerank_ctes(rounds: int = 12) -> str:
    """The rounds unrolled; ``pr`` is the first one that changes by less than the tolerance."""
    ctes = [
        "size as (select count(*)::double n from nodes)",
        "r0 as (select id, 1.0 / n rank, 1e9::double change from nodes, size)",
    ]
    for k in range(1, rounds + 1):
        ctes.append(
            f"""i{k} as (select e.dst id, sum(r.rank * e.weight / o.out_weight) inflow
  from e join r{k-1} r on r.id = e.src join outs o on o.src = e.src group by 1),
d{k} as (select coalesce(sum(rank), 0.0) dangling from r{k-1} where id not in (select src from e)),
n{k} as (select r.id, r.rank old,
    0.15 * (coalesce(inflow, 0.0) + dangling / n) + 0.85 / n rank
  from r{k-1} r left join i{k} i on i.id = r.id, d{k}, size),
r{k} as (select id, rank, abs(rank - old) change from n{k})"""
        )
    each = " union all ".join(
        f"select {k} k, id, rank, change from r{k}" for k in range(1, rounds + 1)
    )
    ctes.append(f"all_rounds as ({each})")
    ctes.append(
        "stop as (select min(k) k from (select k, sum(change) c from all_rounds group by 1), size"
        " where c < n * 1e-6)"
    )
    ctes.append("pr as (select id, rank pagerank from all_rounds join stop using (k))")
    return ",\n".join(ctes)


VECTORS = """
vectors as (
  select 'u' || vec_id id,
         list_transform(embedding, lambda x: x::double * (1 + vec_id % 7)) vector
  from embeddings),
clusters as (select 'u' || vec_id id, (label % 3)::int "cluster" from embeddings),
norms as (select id, sqrt(list_sum(list_transform(vector, lambda x: x * x))) emb_norm from vectors)"""

SCORES = f"""{GRAPH},
{pagerank_ctes()},
{VECTORS},
inputs as (
  select v.id node_id, emb_norm, coalesce(pagerank, 0.0) pagerank,
         coalesce(out_weight, 0.0) weighted_outdegree
  from norms v left join pr on pr.id = v.id left join outs o on o.src = v.id),
ranges as (
  select min(emb_norm) a0, max(emb_norm) a1, min(pagerank) b0, max(pagerank) b1,
         min(weighted_outdegree) c0, max(weighted_outdegree) c1 from inputs),
scaled as (
  select inputs.*,
         case when a1 > a0 then (emb_norm - a0) / (a1 - a0) else 0.0 end emb_norm_n,
         case when b1 > b0 then (pagerank - b0) / (b1 - b0) else 0.0 end pagerank_n,
         case when c1 > c0 then (weighted_outdegree - c0) / (c1 - c0) else 0.0 end outdegree_n
  from inputs, ranges),
scored as (
  select *, 0.3::double * emb_norm_n + 0.3::double * pagerank_n + 0.4::double * outdegree_n
            influence_score from scaled),
influence as (
  select row_number() over (order by influence_score desc, node_id) "rank", * from scored),
top as (select node_id id from influence where "rank" <= 10)"""

EGO = f"""{SCORES},
near as (
  select dst id from (
    select e.*, row_number() over (partition by src order by weight desc, dst) place
    from e where src in (select id from top)) where place <= 5),
ego as (select id from near union select id from top where id in (select id from nodes)),
ego_edges as (
  select * from e where src in (select id from ego) and dst in (select id from ego))"""


def walk_ctes(num_walks: int, walk_length: int, trials: int = 64) -> str:
    """Each step draws all trials at once and takes the first that is kept (p = 1, q = 0.5)."""
    ctes = [
        """running as (
  select src, dst, sum(weight::decimal(28, 9)) over w upto from e
  window w as (partition by src order by md5(dst), dst rows unbounded preceding)),
shares as (
  select src, dst,
         coalesce(lag(upto) over (partition by src order by md5(dst), dst), 0)::double
           / (max(upto) over (partition by src))::double lo,
         upto::double / (max(upto) over (partition by src))::double hi
  from running)""",
        f"""w0 as (
  select id || '#' || i walk_id, null::varchar prev, id cur
  from nodes, range({num_walks}) t(i))""",
    ]
    for s in range(1, walk_length):
        key = f"md5('42|' || walk_id || '|{s-1}|' || trial)"
        ctes.append(
            f"""a{s} as (
  select w.*, trial, {uniform(key)} u, {uniform(key, 14)} v,
         coalesce(b.hi - b.lo, 0.0) back, b.lo back_lo
  from w{s-1} w cross join range({trials}) t(trial)
  left join shares b on b.src = w.cur and b.dst = w.prev),
x{s} as (
  select *, u * (back / 1.0 + (1.0 - back) * 2.0) x from a{s}),
p{s} as (
  select *, x < back returns,
         case when x < back then back_lo
              when (x - back) / 2.0 >= back_lo then (x - back) / 2.0 + back
              else (x - back) / 2.0 end point
  from x{s}),
c{s} as (
  select p.walk_id, p.cur, p.trial, s.dst,
         p.prev is null or returns
           or (s.dst <> p.prev and v * 2.0 < case when k.src is null then 2.0 else 1.0 end) kept
  from p{s} p join shares s on s.src = p.cur and p.point >= s.lo and p.point < s.hi
  left join e k on k.src = p.prev and k.dst = s.dst),
w{s} as (
  select walk_id, any_value(cur) prev, arg_min(dst, trial) cur from c{s} where kept group by 1)"""
        )
    each = " union all ".join(
        f"select walk_id, {s} step, cur node from w{s}" for s in range(walk_length)
    )
    ctes.append(f"walks as ({each})")
    return ",\n".join(ctes)


WALKS = f"{GRAPH},\n{walk_ctes(10, 30)}"

WEDGES = """
wedges as (
  select a.src prev, a.dst cur, b.dst, b.weight,
         case when b.dst = a.src then 'return' when k.src is not null then 'common'
              else 'far' end kind
  from e a join e b on b.src = a.dst left join e k on k.src = a.src and k.dst = b.dst),
biased as (
  select *, case kind when 'far' then weight / 0.5 else weight end bias from wedges)"""

CENTROIDS = f"""{VECTORS},
entries as (
  select id, unnest(vector) x, generate_subscripts(vector, 1) i from vectors),
centers as (
  select "cluster", i, avg(x) c from entries join clusters using (id) group by 1, 2),
distances as (
  select v.id, c."cluster", sum((x - c) * (x - c)) d from entries v join centers c using (i)
  group by 1, 2)"""

TOP_SAMPLE = """
chosen as (
  select id, count(src) outdegree from nodes left join e on e.src = id
  group by 1 order by 2 desc, 1 limit 50)"""


def drawn(ids: str, size: str, more: str = "") -> str:
    return f"""select n.id, {more}round(coalesce(influence_score, 0.01) * {size}, 4) size,
  coalesce("cluster", 0) "cluster", n.id in (select id from top) is_top
from {ids} n left join influence i on i.node_id = n.id left join clusters c on c.id = n.id"""


COVARIANCE = f"""{VECTORS},
numbers as (select id, generate_subscripts(vector, 1) - 1 i, unnest(vector) v from vectors),
covariances as (
  select a.i, b.i j, covar_samp(a.v, b.v) c from numbers a join numbers b using (id) group by a.i, b.i)"""


def axis_ctes(name: str, matrix: str) -> str:
    """``name``: the direction of greatest variance of ``matrix``. Its powers, squared again and again and divided by
    their trace, come to be the outer product of that direction with itself."""
    return f"""
{name}_power as (
  select 0 step, i, j, c from {matrix}
  union all
  select step + 1, i, j, c / sum(case when i = j then c else 0.0 end) over () from (
    select a.step, a.i, b.j, sum(a.c * b.c) c from {name}_power a join {name}_power b on a.j = b.i
    where a.step < 40 group by a.step, a.i, b.j)),
{name}_last as (select i, j, c from {name}_power where step = 40),
{name} as (
  select i, c / sqrt(sum(c * c) over ()) loading from {name}_last
  where j = (select arg_max(i, c) from {name}_last where i = j))"""


PROJECTION = f"""with recursive {COVARIANCE},
{axis_ctes("first_axis", "covariances")},
spread as (select sum(a.loading * c * b.loading) most from covariances join first_axis a using (i) join first_axis b on b.i = j),
rest as (
  select c.i, c.j, c - most * a.loading * b.loading c
  from covariances c join first_axis a on a.i = c.i join first_axis b on b.i = c.j, spread),
{axis_ctes("second_axis", "rest")},
means as (select i, avg(v) mean from numbers group by i)
select id, round(sum((v - mean) * a.loading), 6) x, round(sum((v - mean) * b.loading), 6) y
from numbers join means using (i) join first_axis a using (i) join second_axis b using (i) group by id"""

ORACLES: dict[str, str] = {
    "clean_interactions": f"with {CLEAN} select * from clean",
    "weighted_interactions": f"with {CLEAN} select * from weighted",
    "edges": f"with {EDGES} select {EDGE_COLUMNS} from edge_table where edge_weight >= 0.1",
    "edges_min_weight": f"with {EDGES} select {EDGE_COLUMNS} from edge_table where edge_weight >= 1.5",
    "stage_counts": f"""with {EDGES}
select 'loaded' stage, count(*) "rows" from raw
union all select 'cleaned', count(*) from clean
union all select 'edges', count(*) from edge_table where edge_weight >= 0.1""",
    "observed_counts": f"""with {EDGES}
select 'loaded' stage, count(*) "rows" from raw
union all select 'cleaned', count(*) from clean
union all select 'edges', count(*) from edge_table where edge_weight >= 0.1""",
    "graph_nodes": f"with {GRAPH} select id from nodes",
    "graph_stats": f"""with {GRAPH}
select (select count(*) from nodes) n_nodes, (select count(*) from e) n_edges, true is_directed""",
    "top5_outdegree": f"""with {GRAPH}
select id, round(coalesce(out_weight, 0), 9) weighted_outdegree
from nodes left join outs on src = id order by coalesce(out_weight, 0) desc, id limit 5""",
    "weighted_outdegree": f"""with {GRAPH}
select id, round(coalesce(out_weight, 0.0), 9) weighted_outdegree
from nodes left join outs on src = id""",
    "outdegree": f"""with {GRAPH}
select id, coalesce(out_degree, 0) outdegree from nodes left join outs on src = id""",
    "pagerank": f"""with {GRAPH}, {pagerank_ctes()}
select id, round(pagerank, 9) pagerank from pr""",
    "transition_prob": f"""with {GRAPH}
select src, dst, round(weight, 9) weight, round(weight / out_weight, 8) prob
from e join outs using (src)""",
    "second_order_prob": f"""with {GRAPH}, {WEDGES}
select prev, cur, round(sum(bias), 9) total,
  round(coalesce(sum(bias) filter (kind = 'return'), 0) / sum(bias), 6) prob_return,
  round(coalesce(sum(bias) filter (kind = 'common'), 0) / sum(bias), 6) prob_common,
  round(coalesce(sum(bias) filter (kind = 'far'), 0) / sum(bias), 6) prob_far
from biased group by 1, 2""",
    "transition_bias": f"""with {WALKS}, {WEDGES},
seen as (
  select distinct a.node prev, b.node cur, c.node dst
  from walks a join walks b on b.walk_id = a.walk_id and b.step = a.step + 1
  join walks c on c.walk_id = a.walk_id and c.step = a.step + 2),
shared as (select *, bias / sum(bias) over (partition by prev, cur) prob from biased)
select prev, cur, dst, round(bias, 9) bias, round(prob, 6) prob
from seen join shared using (prev, cur, dst)""",
    "walks": f"with {WALKS} select walk_id, step, node from walks",
    "walks_vocab": f"""with {WALKS}
select row_number() over (order by count(*) desc, node) - 1 place, node, count(*) frequency
from walks group by node""",
    "csv_round_trip": f"with {RAW} select * from raw",
    "sample_graph": f"with {GRAPH}, {TOP_SAMPLE} select id, outdegree from chosen",
    "sample_graph_edges": f"""with {GRAPH}, {TOP_SAMPLE}
select src, dst, round(weight, 9) weight from e
where src in (select id from chosen) and dst in (select id from chosen)""",
    "ego_network": f"with {EGO} select src, dst, round(weight, 9) weight from ego_edges",
    "successors": f"""with {SCORES}
select src, dst, round(weight, 9) weight from e where src in (select id from top)""",
    "embedding_norm": f"with {VECTORS} select id, round(emb_norm, 6) emb_norm from norms",
    "most_similar": f"""with {VECTORS}, wanted as (select vector w from vectors where id = 'u7')
select id, round(list_cosine_similarity(vector, w), 6) similarity
from vectors, wanted where id <> 'u7'
order by list_cosine_similarity(vector, w) desc, id limit 5""",
    "most_similar_unknown": f"""with {VECTORS}, wanted as (select vector w from vectors where id = 'nobody')
select id, list_cosine_similarity(vector, w) similarity
from vectors, wanted order by 2 desc, 1 limit 5""",
    "most_similar_many": f"""with {VECTORS}, near as (
  select a.id node, b.id, round(list_cosine_similarity(a.vector, b.vector), 12) s from vectors a join vectors b
    on a.id <> b.id and substr(a.id, 2)::bigint % 25 = 0),
ranked as (select *, row_number() over (partition by node order by s desc, id)::int "rank" from near)
select node, "rank", id, round(s, 6) similarity from ranked where "rank" <= 5""",
    "score_inputs": f"""with {SCORES}
select node_id, round(emb_norm, 6) emb_norm, round(pagerank, 6) pagerank,
  round(weighted_outdegree, 9) weighted_outdegree from inputs""",
    "score_scaled": f"""with {SCORES}
select node_id, round(emb_norm_n, 6) emb_norm_n, round(pagerank_n, 6) pagerank_n,
  round(outdegree_n, 6) outdegree_n from scaled""",
    "influence": f"""with {SCORES}
select "rank", node_id, round(emb_norm, 6) emb_norm, round(pagerank, 6) pagerank,
  round(weighted_outdegree, 9) weighted_outdegree, round(emb_norm_n, 6) emb_norm_n,
  round(pagerank_n, 6) pagerank_n, round(outdegree_n, 6) outdegree_n,
  round(influence_score, 6) influence_score from influence""",
    "top_spreaders": f"""with {SCORES}
select "rank", node_id, round(influence_score, 6) influence_score from influence where "rank" <= 10""",
    "nearest_centroid": f"""with {CENTROIDS}
select id, "cluster" from distances
qualify row_number() over (partition by id order by d, "cluster") = 1""",
    "community_sizes": f"""with {VECTORS}
select i::int "cluster", count(id) size from range(4) t(i) left join clusters on "cluster" = i
group by 1""",
    "bridges": f"""with {SCORES},
reached as (
  select src, count(distinct "cluster") n from e left join clusters on id = dst group by 1),
bridges as (
  select src node_id, "cluster" own_cluster, n n_communities_connected, influence_score,
         influence_score * n bridge_score
  from reached join clusters c on c.id = src left join influence i on i.node_id = src)
select row_number() over (order by bridge_score desc nulls last, node_id) "rank", node_id,
  own_cluster, n_communities_connected, round(influence_score, 6) influence_score,
  round(bridge_score, 6) bridge_score from bridges""",
    "plot_network_nodes": f"with {EGO} {drawn('ego', '3000 + 100')}",
    "plot_network_edges": f"""with {EGO}
select src, dst, round(weight / max(weight) over (), 6) weight_share from ego_edges""",
    "plot_points": f"""with {SCORES},
points as (select id, vector[1] x, vector[2] y from vectors order by {uniform("md5('42|' || id)")}, id limit 100)
{drawn('points', '500 + 30', 'round(x, 6) x, round(y, 6) y, ')}""",
    "report_round_trip": f"""with {SCORES}
select "rank", node_id, round(influence_score, 6) influence_score from influence""",
    "plot_bars": f"""with {SCORES}
select node_id, round(influence_score, 6) influence_score, printf('%.3f', influence_score) label
from influence where "rank" <= 10""",
    "skipgram_in_tables": f"with {GRAPH} select id, 64 length, true finite, true moved from nodes",
    "node2vec_vectors": f"with {GRAPH} select id, 64 length, true finite, true moved from nodes",
    "kmeans_clusters": f"with {VECTORS} select id, true is_label, true is_nearest, true is_cheapest from vectors",
    "pca_points": f"""with {VECTORS}
select count(*) n, 0.0::double mean_x, 0.0::double mean_y, 0.0::double covariance, true variance_falls
from vectors""",
    "pca_covariance": f"""with {COVARIANCE}
select i::int i, j::int j, round(c, 9) covariance from covariances where i <= j""",
    "pca_projection": PROJECTION,
    "clustering_bridges": f"""with {GRAPH}, {VECTORS}
select distinct src node_id, true score_is_product, true count_in_range from e join vectors on id = src""",
    "full_run": f"""with {GRAPH},
{pagerank_ctes()},
inputs as (
  select n.id node_id, coalesce(pagerank, 0.0) pagerank, coalesce(out_weight, 0.0) weighted_outdegree
  from nodes n left join pr on pr.id = n.id left join outs on src = n.id)
select node_id, round(pagerank, 9) pagerank, round(weighted_outdegree, 9) weighted_outdegree,
  round((pagerank - min(pagerank) over ()) / (max(pagerank) over () - min(pagerank) over ()), 6) pagerank_n,
  round((weighted_outdegree - min(weighted_outdegree) over ())
    / (max(weighted_outdegree) over () - min(weighted_outdegree) over ()), 6) outdegree_n
from inputs""",
}
