"""Queries over the property graph."""
from pyspark.sql import functions as F

from kgloom.functions import text as T
from kgloom.operators import extraction as X
from kgloom.operators import graph as G
from kgloom.operators import traversal as R
from kgloom.plans import lenses as N
from kgloom.plans.lenses import MENTION, STAR, with_ctes
from kgloom.plans.registry import query


def sql_label(c):
    return (f"coalesce(nullif(array_to_string(list_transform(string_split(replace(replace({c},'-','_'),' ','_'),'_'), "
            "lambda p: upper(p[1:1])||lower(p[2:])), ''), ''), 'Entity')")


def star_nodes(spark, sf):
    return G.nodes_from(N.star_entities(spark, sf))


def star_edges(spark, sf):
    return G.edges_from(N.star_relationships(spark, sf))


def mention_nodes(spark, sf):
    return G.nodes_from(N.mention_entities(spark, sf))


def mention_edges(spark, sf):
    return G.edges_from(N.mention_relationships(spark, sf))


@query("graph_safe_labels", f"""
with t as (select p_type as raw from part union select p_name from part union select c_mktsegment from customer union select o_orderpriority from orders
           union select '-'||source||' _x' from documents)
select raw, {sql_label('raw')} as label from t""")
def _(spark, sf):
    t = N.table
    raw = (t(spark, sf, "part").select(F.explode(F.array("p_type", "p_name")).alias("raw"))
           .unionByName(t(spark, sf, "customer").select(F.col("c_mktsegment").alias("raw")))
           .unionByName(t(spark, sf, "orders").select(F.col("o_orderpriority").alias("raw")))
           .unionByName(t(spark, sf, "documents").select(F.concat(F.lit("-"), "source", F.lit(" _x")).alias("raw"))).distinct())
    return raw.select("raw", T.safe_label("raw").alias("label"))


def _node_merge(spark, sf):
    e = N.star_entities(spark, sf)
    old = G.nodes_from(e.filter("entity_type in ('Location', 'Company')").withColumn("confidence", F.lit(0.1)))
    return G.merge_nodes(old, e.filter("entity_type <> 'Location'"))


def _edge_merge(spark, sf):
    r = N.star_relationships(spark, sf)
    old = G.edges_from(r.filter("relationship_type in ('LOCATED_IN', 'BELONGS_TO')").withColumn("confidence", F.lit(0.1)))
    incoming = X.merge_results(r.filter("relationship_type <> 'BELONGS_TO'"), N.mention_relationships(spark, sf))
    return G.merge_edges(old, star_nodes(spark, sf), incoming)


@query("graph_merge_nodes", with_ctes(STAR, body=f"""
select {sql_label('entity_type')} as label, id, name, document_id, entity_type,
       case when entity_type='Location' then 0.1::double else confidence end as confidence,
       entity_type not in ('Company') as was_created from star_e"""))
def _(spark, sf):
    return _node_merge(spark, sf)[0].drop("attributes")


@query("graph_merge_edges", with_ctes(STAR, body="""
select src, tgt, id, type, max(case when type='BELONGS_TO' then 0.1::double else confidence end) as confidence, '' as evidence, document_id, type<>'LOCATED_IN' as was_created
from star_r group by all"""))
def _(spark, sf):
    return _edge_merge(spark, sf)[0]


@query("graph_merge_counts", with_ctes(STAR, MENTION, body="""
, made as (select distinct src, tgt, id from star_r where type not in ('LOCATED_IN','BELONGS_TO'))
select count_if(entity_type not in ('Location','Company'))::bigint as nodes_created, count_if(entity_type='Company')::bigint as nodes_updated,
       (select count(*) from made) as edges_created,
       (select count(*) from star_r where type<>'BELONGS_TO')-(select count(*) from made) as edges_updated, (select count(*) from men_r) as edges_skipped from star_e"""))
def _(spark, sf):
    return G.merge_counts(_node_merge(spark, sf)[1], _edge_merge(spark, sf)[1])


BOTH = STAR + "," + MENTION + """,
all_e as (select id, document_id, entity_type, name, confidence from star_e union all select id, document_id, entity_type, name, confidence from men_e),
all_r as (select * from star_r union all select * from men_r)"""


def _both(spark, sf):
    return (star_nodes(spark, sf).unionByName(mention_nodes(spark, sf)), star_edges(spark, sf).unionByName(mention_edges(spark, sf)))


@query("graph_document_counts", with_ctes(BOTH, body="""
, inside as (select s.document_id from all_r r join all_e s on s.id=r.src join all_e t on t.id=r.tgt and t.document_id=s.document_id)
select n.document_id, node_count, coalesce(edge_count,0)::bigint as edge_count
from (select document_id, count(*) as node_count from all_e group by 1) n left join (select document_id, count(*) as edge_count from inside group by 1) e using (document_id)"""))
def _(spark, sf):
    return G.document_graph_counts(*_both(spark, sf))


@query("graph_document_edges", with_ctes(BOTH, body="""
select s.document_id, r.id, r.type, r.src as source_id, r.tgt as target_id from all_r r join all_e s on s.id=r.src join all_e t on t.id=r.tgt and t.document_id=s.document_id"""))
def _(spark, sf):
    return G.document_graph(*_both(spark, sf))[1]


@query("graph_stats", with_ctes(BOTH, body=f"""
select {sql_label('entity_type')} as label, count(*) as cnt, (select count(*) from all_e) as node_count, (select count(*) from all_r) as edge_count from all_e group by 1"""))
def _(spark, sf):
    return G.graph_stats(*_both(spark, sf))


@query("graph_type_distribution", with_ctes(BOTH, body="select entity_type, count(*) as cnt from all_e group by 1"))
def _(spark, sf):
    return G.type_distribution(_both(spark, sf)[0])


@query("graph_seed_nodes", with_ctes(BOTH, body="""
select id, name, entity_type, upper(entity_type[1:1])||lower(entity_type[2:]) as label, confidence from all_e where lower(entity_type) in ('company','gadget') order by id limit 60"""))
def _(spark, sf):
    return G.seed_nodes(_both(spark, sf)[0], ["COMPANY", "Gadget"])


@query("graph_seed_nodes_fallback", with_ctes(BOTH, body="""
select id, name, entity_type, upper(entity_type[1:1])||lower(entity_type[2:]) as label, confidence from all_e order by id limit 60"""))
def _(spark, sf):
    return G.seed_nodes(_both(spark, sf)[0], ["Organization"])


@query("graph_touching_edges", with_ctes(BOTH, body="""
select r.id, r.type, r.src as source_id, r.tgt as target_id, s.name as source_name, t.name as target_name
from all_r r join all_e s on s.id=r.src join all_e t on t.id=r.tgt
where lower(s.entity_type) in ('location','person') or lower(t.entity_type) in ('location','person') order by r.id limit 80"""))
def _(spark, sf):
    n, e = _both(spark, sf)
    return G.touching_edges(e, n, ["Location", "Person"])


@query("graph_find", with_ctes(STAR, body="""
select id, name, confidence from star_e where entity_type in ('Company','Product') and confidence>=0.7 and (id like 'c:%' and (select c_mktsegment from customer where 'c:'||c_custkey=id)='BUILDING') order by id limit 50"""))
def _(spark, sf):
    return G.graph_find(star_nodes(spark, sf), ["Company", "Product"], {"confidence": {"gte": 0.7}, "segment": "BUILDING"}).select("id", "name", "confidence")


@query("graph_count", with_ctes(STAR, body="select entity_type, count(*) as cnt from star_e where entity_type in ('Company','Product') and confidence<0.5 group by 1"))
def _(spark, sf):
    return G.graph_count(star_nodes(spark, sf), ["Company", "Product"], {"confidence": {"lt": 0.5}})


RELATE = """select r.id as edge_id, r.src as source_id, s.name as source_name, r.type, r.tgt as target_id, t.name as target_name, r.confidence
from all_r r join all_e s on s.id=r.src join all_e t on t.id=r.tgt"""


@query("graph_relate", with_ctes(BOTH, body=RELATE + " where s.entity_type in ('Company','Location') and r.type in ('LOCATED_IN','OWNS','BELONGS_TO')"))
def _(spark, sf):
    n, e = _both(spark, sf)
    return G.graph_relate(n, e, ["Company", "Location"], ["LOCATED_IN", "OWNS", "BELONGS_TO"])


@query("graph_pattern_uses", with_ctes(BOTH, body=RELATE + " where s.entity_type='Company' and r.type='USES' and t.entity_type='Technology'"))
def _(spark, sf):
    n, e = _both(spark, sf)
    return G.pattern(n, e, "Company", "USES", "Technology")


@query("graph_edges_of_documents", with_ctes(BOTH, body="""
select r.document_id, r.id as edge_id, s.name as source_name, r.type, t.name as target_name from all_r r join all_e s on s.id=r.src join all_e t on t.id=r.tgt"""))
def _(spark, sf):
    return G.edges_of_documents(*_both(spark, sf))


@query("graph_repeated_names", with_ctes(BOTH, body="select name, count(*) as cnt from all_e group by 1 having count(*)>1"))
def _(spark, sf):
    return G.repeated_names(_both(spark, sf)[0])


@query("graph_low_confidence_edges", with_ctes(BOTH, body=", w as (select * from all_r where confidence<0.5) " + RELATE.replace("all_r", "w")))
def _(spark, sf):
    return G.low_confidence_edges(*_both(spark, sf))


@query("graph_orphan_nodes", with_ctes(BOTH, body="select id, name, entity_type from all_e where id not in (select src from all_r union select tgt from all_r)"))
def _(spark, sf):
    return G.orphan_nodes(*_both(spark, sf))


@query("graph_first_nodes", with_ctes(BOTH, body="select id, name, entity_type from all_e order by id limit 50"))
def _(spark, sf):
    return G.all_nodes(_both(spark, sf)[0]).select("id", "name", "entity_type")


@query("graph_induced_subgraph", with_ctes(BOTH, body="""
, k as (select id from all_e where entity_type in ('Company','company','Location'))
select 'node' as kind, id from k union all select 'edge', id from all_r where src in (select id from k) and tgt in (select id from k)"""))
def _(spark, sf):
    n, e = G.induced_subgraph(*_both(spark, sf), ["Company", "Location"])
    return n.select(F.lit("node").alias("kind"), "id").unionByName(e.select(F.lit("edge").alias("kind"), "id"))


@query("graph_of_names", with_ctes(BOTH, body="""
, rn as (select r.id, coalesce(s.name, r.src) as s, coalesce(t.name, r.tgt) as t, r.type from all_r r left join star_e s on s.id=r.src left join star_e t on t.id=r.tgt),
ty as (select lower(name) as k, arg_max(entity_type, pos) as ty from star_e group by 1)
select 'node' as kind, n.name, null as other, ty.ty as label from (select s as name from rn union select t from rn) n left join ty on ty.k=lower(n.name)
union all select 'edge', s, t, case when instr(type,'_')>0 then substr(type,1,instr(type,'_')-1)||' '||substr(type,instr(type,'_')+1) else type end from rn"""))
def _(spark, sf):
    e = N.star_entities(spark, sf)
    rels = X.relationship_rows(X.merge_results(N.star_relationships(spark, sf), N.mention_relationships(spark, sf)), e)
    nodes, edges = G.name_graph(rels, e)
    return (nodes.select(F.lit("node").alias("kind"), "name", F.lit(None).cast("string").alias("other"), F.col("entity_type").alias("label"))
            .unionByName(edges.select(F.lit("edge").alias("kind"), F.col("source").alias("name"), F.col("target").alias("other"), "label")))


BFS = """,
adj as (select src as a, tgt as b from star_r union select tgt, src from star_r),
bfs as (select 'r:'||r_regionkey as s, 'r:'||r_regionkey as id, 0 as dist from region
        union select s, b, dist+1 from bfs join adj on a=id where dist<{depth}),
near as (select s, id, min(dist)::int as dist from bfs group by 1,2)"""


def _regions(spark, sf):
    return N.table(spark, sf, "region").select(F.concat(F.lit("r:"), F.col("r_regionkey").cast("string")).alias("start_id"))


@query("graph_neighborhood_nodes", with_ctes(STAR + BFS.format(depth=2), body=" select s as start_id, near.id, dist, name, entity_type from near join star_e on star_e.id=near.id"))
def _(spark, sf):
    n, _e = R.neighborhood(star_nodes(spark, sf), star_edges(spark, sf), _regions(spark, sf), 2)
    return n.select("start_id", "id", "dist", "name", "entity_type")


@query("graph_neighborhood_edges", with_ctes(STAR + BFS.format(depth=2), body="""
select distinct near.s as start_id, r.id, r.type, r.src, r.tgt from star_r r join near on near.id in (r.src, r.tgt) where near.dist<=1"""))
def _(spark, sf):
    return R.neighborhood(star_nodes(spark, sf), star_edges(spark, sf), _regions(spark, sf), 2)[1]


@query("graph_shortest_paths", with_ctes(STAR + BFS.format(depth=3), body=""",
par as (select n.s, n.id, n.dist, min(adj.a) as parent from near n join adj on adj.b=n.id join near m on m.s=n.s and m.id=adj.a and m.dist=n.dist-1 group by 1,2,3),
w1 as (select p.s, p.id as to_id, p.dist as hops, p.parent as p1 from par p where p.id like 'o:%' or p.id like 'c:%'),
w2 as (select w1.*, q.parent as p2 from w1 left join par q on q.s=w1.s and q.id=w1.p1),
w3 as (select w2.*, q.parent as p3 from w2 left join par q on q.s=w2.s and q.id=w2.p2)
select s as from_id, to_id, hops, concat_ws('->', p3, p2, p1, to_id) as path from w3"""))
def _(spark, sf):
    # every customer and every order, from the region of the customer's nation
    t = N.table
    home = t(spark, sf, "customer").join(t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.concat(F.lit("r:"), F.col("n_regionkey").cast("string")).alias("from_id"))
    customers = home.select("from_id", F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("to_id"))
    orders = t(spark, sf, "orders").join(home, F.col("o_custkey") == F.col("c_custkey")).select(
        "from_id", F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("to_id"))
    pairs = customers.unionByName(orders)
    return R.shortest_paths(star_nodes(spark, sf), star_edges(spark, sf), pairs, 3)


@query("graph_components", with_ctes(MENTION, body="""
, adj as (select src as a, tgt as b from men_r union select tgt, src from men_r),
lab as (select a as id, a as l from adj union select id2.b, lab.l from lab join adj id2 on id2.a=lab.id where lab.l<id2.b)
select id, min(l) as component from lab group by 1"""))
def _(spark, sf):
    return R.connected_components(mention_edges(spark, sf).select("src", "tgt"))
