"""Queries over embeddings, search, retrieval contexts and runs."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from kgloom import vocab as V
from kgloom.operators import extraction as X
from kgloom.operators import graph as G
from kgloom.operators import ontology as O
from kgloom.operators import quality as Q
from kgloom.operators import retrieval as R
from kgloom.operators import runs as U
from kgloom.operators import vectors as E
from kgloom.plans import extraction_queries as XQ
from kgloom.plans import lenses as N
from kgloom.plans.extraction_queries import TOKENS
from kgloom.plans.graph_queries import star_edges, star_nodes
from kgloom.plans.lenses import MENTION, STAR, TEXT, with_ctes
from kgloom.plans.ontology_queries import MATCHED, question_classes
from kgloom.plans.quality_queries import sql_metrics
from kgloom.plans.registry import query
from kgloom.plans.text_queries import sql_sliding
from kgloom.session import cut_lineage, stable_id


def sql_vectors(src, key, text, name):
    """CTEs giving ``name``(key, vec) hashed bag-of-words vectors, blank texts left out."""
    return f"""
{name}_t as (select {key} as key, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')) as w from {src}),
{name}_c as (select key, (('0x'||substr(md5(w),1,8))::bigint%64)::int as d, count(*)::double as n from {name}_t group by 1,2),
{name}_n as (select key, sqrt(sum(n*n)) as norm from {name}_c group by 1),
{name} as (select key, d, n/norm as v from {name}_c join {name}_n using (key))"""


CHUNKS_1000 = sql_sliding("docs", "id", "raw_text", 1000, 100)


@query("embed_chunks", with_ctes(TEXT, CHUNKS_1000, sql_vectors("chunks", "document_id*4294967296+chunk_index", "text", "cv"), body="""
 select key//4294967296 as document_id, (key%4294967296)::int as chunk_index, d as dim, round(v,6) as value from cv"""))
def _(spark, sf):
    c = E.embed_chunks(N.text_documents(spark, sf))
    return (c.select("document_id", "chunk_index", F.posexplode("embedding").alias("dim", "value")).filter("value <> 0")
            .withColumn("value", F.round("value", 6)))


@query("vector_search_all_pairs", """
with e as (select vec_id, label, embedding::double[] as v from embeddings),
s as (select a.vec_id as query_id, b.vec_id as chunk_id, round(list_cosine_similarity(a.v, b.v), 12) as sim from e a, e b)
select query_id, rank::int as rank, chunk_id, b.label as document_id, 'set_'||b.label as filename, round(sim,4) as similarity
from (select *, row_number() over (partition by query_id order by sim desc, chunk_id) as rank from s) join embeddings b on b.vec_id=chunk_id where rank<=5""")
def _(spark, sf):
    e = N.table(spark, sf, "embeddings")
    chunks = e.select(F.col("vec_id").alias("id"), F.col("label").alias("document_id"), F.lit(0).alias("chunk_index"), F.lit("").alias("text"), F.lit(0).alias("token_count"), "embedding")
    docs = e.select(F.col("label").alias("id")).distinct().withColumn("filename", F.concat(F.lit("set_"), F.col("id").cast("string")))
    out = E.semantic_search(chunks, docs, e.select(F.col("vec_id").alias("query_id"), "embedding"), 5)
    return out.select("query_id", "rank", "chunk_id", "document_id", "filename", "similarity")


def _chunk_store(spark, sf):
    docs = N.text_documents(spark, sf)
    c = E.embed_chunks(docs).withColumn("id", F.col("document_id") * (1 << 32) + F.col("chunk_index"))
    # stands for the stored chunk table, which is read for the vectors and again for the texts
    return docs, cut_lineage(c)


def _asked(spark, sf):
    return E.hashed_bag_of_words(N.questions(spark, sf).select(F.col("question_id").alias("query_id"), F.col("question").alias("text")))


def _search(spark, sf, k=3):
    docs, c = _chunk_store(spark, sf)
    return E.semantic_search(c, docs, _asked(spark, sf), k)


SEARCH = CHUNKS_1000 + "," + sql_vectors("chunks", "document_id*4294967296+chunk_index", "text", "cv") + "," + sql_vectors("questions", "question_id", "question", "qv") + """,
sims as (select q.key as question_id, c.key as chunk_id, round(sum(q.v*c.v),12) as sim from qv q join cv c using (d) group by 1,2),
allp as (select q.key as question_id, c.key as chunk_id, coalesce(sim,0.0::double) as sim from (select distinct key from qv) q cross join (select distinct key from cv) c
         left join sims s on s.question_id=q.key and s.chunk_id=c.key),
tops as (select *, row_number() over (partition by question_id order by sim desc, chunk_id) as rank from allp qualify rank<=3),
found as (select question_id, rank::int as rank, chunk_id, k.document_id, k.chunk_index, k.text, 'doc_'||k.document_id||'.txt' as filename, round(sim,4) as similarity
          from tops join chunks k on k.document_id*4294967296+k.chunk_index=chunk_id)"""


@query("retrieval_sources", with_ctes(TEXT, SEARCH, body=" select question_id as query_id, rank, substr(text,1,300) as chunk, filename, similarity, chunk_index from found"))
def _(spark, sf):
    return R.rag_sources(_search(spark, sf))


RAG_TEXT = "'[Source: '||filename||' | similarity: '||printf('%.2f', round(similarity,2))||']'||chr(10)||text"


@query("retrieval_passage_context", with_ctes(TEXT, SEARCH, body=f""" select question_id as query_id,
 coalesce((select string_agg({RAG_TEXT}, chr(10)||chr(10)||'---'||chr(10)||chr(10) order by rank) from found f where f.question_id=q.question_id), '{V.NO_SOURCES_MESSAGE}') as context from questions q"""))
def _(spark, sf):
    return R.rag_context(_asked(spark, sf).select("query_id"), _search(spark, sf))


def _text_graph(spark, sf):
    """Graph of the extracted entities; an entity's type is its name, so questions can ask for it."""
    found = XQ.stored_found(spark, sf)
    nodes = G.nodes_from(X.entity_rows(found).withColumn("entity_type", F.col("name")))
    # consecutive entities of a chunk are related; its rows meet by their keys, ids are made of these afterwards
    near = found.select(*X.ENTITY_KEYS, X.place("chunk_index", "word_pos").alias("pos")).repartition("document_id", "chunk_index").withColumn("id", X.entity_id())
    w = Window.partitionBy("document_id", "chunk_index").orderBy("pos", "id")
    ahead = near.withColumn("nxt", F.lead(F.struct(*X.ENTITY_KEYS)).over(w)).filter("nxt is not null")
    ahead = cut_lineage(ahead.select(*X.ENTITY_KEYS, F.col("nxt.name").alias("_name"), F.col("nxt.entity_type").alias("_type")))
    rel = ahead.withColumn("id", X.entity_id()).select(
        F.concat(F.lit("x"), "id").alias("id"), "document_id", F.col("id").alias("source_entity_id"),
        stable_id("document_id", "chunk_index", "_name", "_type").alias("target_entity_id"),
        F.lit("USES").alias("relationship_type"), F.lit(1.0).alias("confidence"))
    return nodes, G.edges_from(rel)


def _retrieve(spark, sf):
    nodes, edges = _text_graph(spark, sf)
    docs, c = _chunk_store(spark, sf)
    names = question_classes(spark, sf)
    return names, R.graphrag_retrieve(N.questions(spark, sf), names, nodes, edges, c, docs, 3)


GRAPHRAG = MATCHED + """,
gn as (select *, lower(name) as lname from ext),
ge as (select 'x'||id as id, id as src, lead(id) over (partition by document_id, chunk_index order by pos, id) as tgt, name as sname, lead(name) over (partition by document_id, chunk_index order by pos, id) as tname from gn),
ge2 as (select * from ge where tgt is not null),
wn as (select distinct question_id, gn.id, gn.name from matched join gn on gn.lname=lower(class_name)),
hn as (select *, row_number() over (partition by question_id order by id) as rn from wn qualify rn<=60),
noq as (select distinct question_id from matched where question_id not in (select question_id from hn)),
fn as (select question_id, id, name from hn union all select question_id, id, name from noq, (select id, name from gn order by id limit 60)),
we as (select distinct question_id, ge2.id, src, tgt, sname, tname from matched join ge2 on lower(class_name) in (lower(sname), lower(tname))),
he as (select *, row_number() over (partition by question_id order by id) as rn from we qualify rn<=80),
fe as (select question_id, id, src, tgt, sname, tname from he where question_id not in (select question_id from noq)
       union all select question_id, id, src, tgt, sname, tname from noq, (select * from ge2 order by id limit 80))"""


@query("graphrag_nodes", with_ctes(TEXT, TOKENS + GRAPHRAG, body=" select question_id, id, name from fn"))
def _(spark, sf):
    return _retrieve(spark, sf)[1]["nodes"].select("question_id", "id", "name")


@query("graphrag_edges", with_ctes(TEXT, TOKENS + GRAPHRAG, body=" select question_id, id, src as source_id, tgt as target_id, sname as source_name, tname as target_name, 'USES' as type from fe"))
def _(spark, sf):
    return _retrieve(spark, sf)[1]["edges"].select("question_id", "id", "source_id", "target_id", "source_name", "target_name", "type")


SEARCH_B = SEARCH.replace(CHUNKS_1000, sql_sliding("docs", "id", "raw_text", 1000, 100, "bigs")).replace("from chunks)", "from bigs)").replace("join chunks k", "join bigs k")

CONTEXT = """,
nt as (select question_id, string_agg('- ['||name||'] '||name, chr(10) order by id) as t from (select *, row_number() over (partition by question_id order by id) as rn2 from fn qualify rn2<=30) group by 1),
et as (select question_id, string_agg('- '||sname||' --[USES]--> '||tname, chr(10) order by id) as t from (select *, row_number() over (partition by question_id order by id) as rn2 from fe qualify rn2<=30) group by 1),
ct as (select question_id, string_agg('['||filename||', similarity='||printf('%.2f', round(similarity,2))||']'||chr(10)||text, chr(10) order by rank) as t from found group by 1)"""


@query("graphrag_context", with_ctes(TEXT, TOKENS + GRAPHRAG + "," + SEARCH_B + CONTEXT, body="""
 select q.question_id, concat_ws(chr(10)||chr(10), nullif(concat_ws(chr(10), '=== Knowledge Graph Entities ==='||chr(10)||nt.t, chr(10)||'=== Graph Relationships ==='||chr(10)||et.t),''),
   '=== Document Passages ==='||chr(10)||ct.t) as context
 from questions q left join nt using (question_id) left join et using (question_id) left join ct using (question_id)"""))
def _(spark, sf):
    return R.graphrag_context(N.questions(spark, sf), _retrieve(spark, sf)[1])


TRACE = """,
tc as (select question_id, count(*) as n, string_agg(class_name, ', ' order by class_name) as names from matched group by 1),
tn as (select question_id, count(*) as n from fn group by 1), te as (select question_id, count(*) as n from fe group by 1),
tk2 as (select question_id, count(*) as n, max(similarity) as best from found group by 1),
tr as (select q.question_id, coalesce(tc.n,0) as nc, coalesce(names,'none') as nm, coalesce(names,'all') as nma, coalesce(tn.n,0) as nn, coalesce(te.n,0) as ne, coalesce(tk2.n,0) as nk, best, (select count(*) from cnames) as av
       from questions q left join tc using (question_id) left join tn using (question_id) left join te using (question_id) left join tk2 using (question_id))"""


@query("graphrag_trace", with_ctes(TEXT, TOKENS + GRAPHRAG + "," + SEARCH_B + TRACE, body="""
 select question_id, 1 as step_no, 'ontology_matching' as step, nc as result_count, 'Matched: '||nm||' (from '||av||' available classes)' as detail from tr
 union all select question_id, 2, 'graph_traversal', nn, nn||' nodes, '||ne||' edges retrieved (entity types: '||nma||')' from tr
 union all select question_id, 3, 'vector_retrieval', nk, case when nk>0 then 'Top-3 chunks; best similarity: '||printf('%.3f', round(best,3)) else 'No embeddings found' end from tr
 union all select question_id, 4, 'synthesis', null, 'Used '||nn||' graph nodes, '||ne||' edges, '||nk||' text chunks' from tr"""))
def _(spark, sf):
    names, parts = _retrieve(spark, sf)
    return R.graphrag_trace(N.questions(spark, sf), parts, names, 3).drop("description")


@query("answer_inputs", with_ctes(TEXT + MATCHED + "," + SEARCH, body="""
 select q.question_id, (select count(*) from matched m where m.question_id=q.question_id)::int as graph_rows, (select count(*) from found f where f.question_id=q.question_id)::int as sources,
        (select string_agg(class_name, ',' order by class_name) from matched m where m.question_id=q.question_id) as first_rows from questions q"""))
def _(spark, sf):
    q = N.questions(spark, sf)
    rows = O.match_classes(q, question_classes(spark, sf)).select("question_id", F.col("class_name").alias("value"))
    out = R.answer_inputs(q, rows, R.rag_sources(_search(spark, sf)))
    return out.select("question_id", F.size("graph_rows").alias("graph_rows"), F.when(F.col("sources").isNull(), 0).otherwise(F.size("sources")).alias("sources"),
                      F.array_join("graph_rows", ",").alias("first_rows"))


# -- runs ------------------------------------------------------------------

TYPES = {"signup": "step_start", "click": "step_start", "view": "step_complete", "error": "step_failed", "purchase": "run_complete"}


def run_events(events):
    """Business events as run events: a user is a run, steps by event id."""
    pairs = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    steps = F.array(*[F.lit(s) for s in V.RUN_STEPS])
    return events.select("event_id", F.col("user_id").alias("run_id"), F.element_at(pairs, F.col("event_type")).alias("type"),
                         F.element_at(steps, (F.col("event_id") % 5 + 1).cast("int")).alias("step"), "ts", F.col("props").alias("summary"),
                         F.when(F.col("event_type") == "error", F.col("props")).alias("error"))


RUN_EVENTS = """
rev as (select event_id, user_id as run_id, ts, case event_type when 'signup' then 'step_start' when 'click' then 'step_start' when 'view' then 'step_complete' when 'error' then 'step_failed' else 'run_complete' end as type,
        ['entity_extraction','relationship_discovery','ontology_builder','graph_update','vector_memory'][(event_id%5+1)::int] as step, props as summary, case when event_type='error' then props end as error from events),
fold as (select run_id, step as step_name, arg_max(case type when 'step_start' then 'running' when 'step_complete' then 'completed' else 'failed' end, {'t':ts,'e':event_id}) as status,
  min(ts) filter (type='step_start') as started_at, max(ts) filter (type in ('step_complete','step_failed')) as completed_at, arg_max(summary, {'t':ts,'e':event_id}) as output_summary,
  arg_max_null(error, {'t':ts,'e':event_id}) as error from rev where type like 'step%' group by 1,2),
stat as (select run_id, arg_max({'y':type,'s':step}, {'t':ts,'e':event_id}) as l, max(ts) as last_ts from rev group by 1)"""


@query("run_steps_folded", with_ctes(RUN_EVENTS, body=" select run_id, step_name, status, started_at, completed_at, output_summary, error, floor((epoch_us(completed_at)-epoch_us(started_at))/1000)::bigint as duration_ms from fold"))
def _(spark, sf):
    return U.fold_run_events(run_events(N.table(spark, sf, "events")))


@query("run_status", with_ctes(RUN_EVENTS, body=" select run_id, case l.y when 'run_complete' then 'completed' when 'run_failed' then 'failed' else 'running' end as status, case when l.y='step_start' then l.s end as current_step, last_ts from stat"))
def _(spark, sf):
    return U.run_status(run_events(N.table(spark, sf, "events")))


@query("run_decision_log", """
select user_id as run_id, 0 as pos, event_type as agent, 'value '||value as message, event_id::varchar as timestamp from events where event_type<>'error'
union all select user_id, 1, 'second', 'note', event_id::varchar from events where event_type<>'error' and event_id%2=0""")
def _(spark, sf):
    ev = N.table(spark, sf, "events")
    body = F.concat(
        F.lit('[{"agent":"'), "event_type", F.lit('","message":"value '), F.col("value").cast("string"), F.lit('","timestamp":"'), F.col("event_id").cast("string"), F.lit('"},'),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"agent":"second","message":"note","timestamp":"'), F.col("event_id").cast("string"), F.lit('"}'))).otherwise('{"agent":"second"}'),
        F.when(F.col("event_type") == "error", "").otherwise("]"))
    return U.decision_log(ev.select(F.col("user_id").alias("run_id"), body.alias("decisions_json")))


def _runs(spark, sf):
    """Run table folded from the events, one run per user, its document by number."""
    ev = run_events(N.table(spark, sf, "events"))
    steps = U.fold_run_events(ev).groupBy("run_id").agg(F.collect_list(F.struct("step_name", "status")).alias("steps"), F.min("started_at").alias("started_at"))
    return U.run_status(ev).join(steps, "run_id").withColumn("document_id", F.col("run_id"))


RUNS = """,
runs as (select s.run_id, case l.y when 'run_complete' then 'completed' when 'run_failed' then 'failed' else 'running' end as status, min(f.started_at) as started_at,
         count(*) filter (f.status='completed') as done from stat s join fold f using (run_id) group by 1,2)"""


@query("run_listing", with_ctes(RUN_EVENTS + RUNS, body="""
 select run_id, r.status, started_at, done::int as completed_steps_count, case when d.doc_id is not null then 'doc_'||run_id||'.txt' end as document_name, 5 as steps_count,
        round(done*100/5.0)::int as progress, (select count(*) from runs where status='running') as total from runs r left join documents d on d.doc_id=run_id where r.status='running' order by started_at desc, run_id limit 20 offset 5"""))
def _(spark, sf):
    out = U.list_runs(_runs(spark, sf), N.text_documents(spark, sf), status="running", offset=5)
    return out.select("run_id", "status", "started_at", "completed_steps_count", "document_name", "steps_count", "progress", "total")


@query("runs_stuck", with_ctes(RUN_EVENTS + RUNS, body=" select run_id from runs where status='running' and started_at + interval 15 minute < timestamp '2024-01-01 12:00:00'"))
def _(spark, sf):
    return U.stuck_runs(_runs(spark, sf), "2024-01-01 12:00:00").select("run_id")


@query("health_alerts", with_ctes(MENTION, body=", m as (" + sql_metrics("men_e", "men_r") + """)
 select 'ontology_coverage' as alert, ontology_coverage as value, 'Knowledge evolution engine needs attention' as action from m where ontology_coverage<0.5
 union all select 'duplicate_entities', duplicate_entities::double, 'Run analysis with auto-correction' from m where duplicate_entities>50
 union all select 'edge_count', edge_count::double, 'Graph build has not been run' from m where edge_count=0 and (select count(*) from documents)>0"""))
def _(spark, sf):
    m = Q.knowledge_metrics(N.mention_entities(spark, sf), N.mention_relationships(spark, sf), O.default_classes(spark), None, None)
    return U.health_alerts(m, N.text_documents(spark, sf))
