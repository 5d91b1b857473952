"""Queries over entity and relationship extraction."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from kgloom import vocab as V
from kgloom.functions import chunking as K
from kgloom.operators import extraction as X
from kgloom.plans import lenses as N
from kgloom.plans.lenses import MENTION, STAR, TEXT, sql_strip, with_ctes
from kgloom.plans.registry import query
from kgloom.plans.text_queries import sql_sliding
from kgloom.session import cut_lineage

TYPES_SQL = "(" + ",".join(f"'{t}'" for t in V.ENTITY_TYPES) + ")"
RELS_SQL = "(" + ",".join(f"'{t}'" for t in V.RELATIONSHIP_TYPES) + ")"
CHUNKS = sql_sliding("docs", "id", "raw_text", 600, 50)


def _chunks(spark, sf):
    return K.sliding_chunks(N.text_documents(spark, sf), *V.ENTITY_WINDOW, offsets=False)


def _entities(spark, sf):
    return X.extract_entities(cut_lineage(_chunks(spark, sf)), N.gazetteer(spark, sf))


def stored_found(spark, sf):
    """Stands for the stored entity table where one is read more than once, without what follows from its columns."""
    return cut_lineage(X.found_entities(cut_lineage(_chunks(spark, sf)), N.gazetteer(spark, sf)))


def stored_entities(spark, sf):
    return X.entity_rows(stored_found(spark, sf))


# every run of tokens as long as some name, the mentions among them, and one row per (chunk, name)
TOKENS = CHUNKS + r""",
tk0 as (select document_id, chunk_index, text, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from chunks),
ext_pat as (
  select document_id, chunk_index, name, 'Person' as entity_type, min(i)-1+2147483648 as word_pos, name as evidence, 0.6::double as confidence
  from (select document_id, chunk_index, m[i] as name, i from (select document_id, chunk_index,
          regexp_extract_all(text, '[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[a-z]{2,}') as m from chunks), unnest(range(1, len(m)+1)) as u(i)) group by 1,2,3
  union all
  select document_id, chunk_index, name, 'Technology', min(i)-1+2147483648, name, 0.6::double
  from (select document_id, chunk_index, m[i] as name, i from (select document_id, chunk_index,
          regexp_extract_all(text, 'https?://[^""" + N.SPACES[1:-1] + r"""]+') as m from chunks), unnest(range(1, len(m)+1)) as u(i)) group by 1,2,3
),
lens as (select distinct len(regexp_extract_all(lower(name), '[\p{L}\p{N}]+')) as n from (select name from gaz union select name from ext_pat)),
tk as (select document_id, chunk_index, array_to_string(w[i:i+n-1], ' ') as token, i as word_pos,
       array_to_string(w[greatest(i-5,1) : greatest(i-5,1)+least(i-1,5)+n+5-1], ' ') as evidence
       from tk0, lens, unnest(range(1, len(w)-n+2)) as u(i)),
ext_known as (
  select document_id, chunk_index, g.name, g.entity_type, min(word_pos) as word_pos, arg_min(evidence, word_pos) as evidence, max(confidence) as confidence
  from tk join gaz g on g.name=tk.token group by all),
ext as (
  select sha256(document_id||'|'||chunk_index||'|'||name||'|'||entity_type) as id, document_id, chunk_index, entity_type, name, confidence,
         evidence as evidence_chunk, (chunk_index::bigint*4294967296+word_pos)::bigint as pos
  from (select * from ext_known union all select * from ext_pat)
),
nmap as (
  select document_id, lower(name) as key, arg_max({'id':id,'name':name,'entity_type':entity_type}, {'p':pos,'i':id}) as entity from ext group by 1,2)"""


@query("extract_entities_by_gazetteer", with_ctes(TEXT, TOKENS, body="select id, document_id, chunk_index, entity_type, name, confidence, evidence_chunk, pos from ext"))
def _(spark, sf):
    return _entities(spark, sf).drop("attributes")


@query("visible_entity_names", with_ctes(TEXT, TOKENS, body="""
, vis as (select c.document_id, c.chunk_index, n.entity.id as entity_id, n.entity.name as name, n.entity.entity_type as entity_type
          from chunks c join nmap n on n.document_id=c.document_id and contains(lower(c.text), n.key))
select *, count(*) over (partition by document_id, chunk_index) as chunk_names from vis
qualify chunk_names>=2"""))
def _(spark, sf):
    chunks = cut_lineage(_chunks(spark, sf))
    return X.visible_entities(chunks, cut_lineage(X.extract_entities(chunks, N.gazetteer(spark, sf))))


EXTREL = TOKENS + r""",
spot as (select t.document_id, t.chunk_index, t.word_pos, n.entity.id as eid, n.entity.entity_type as t
         from tk t join nmap n on n.document_id=t.document_id
         and array_to_string(regexp_extract_all(n.key, '[\p{L}\p{N}]+'), ' ')=t.token),
enough as (select document_id, chunk_index from spot group by 1,2 having count(distinct eid)>=2),
mark as (select t.document_id, t.chunk_index, t.word_pos, c.* from tk t join cues c on c.cue=t.token join enough using (document_id, chunk_index)),
srcs as (select m.document_id, m.chunk_index, m.word_pos, m.relationship_type, arg_max(s.eid, {'p':s.word_pos,'e':s.eid}) as sid
         from mark m join spot s on s.document_id=m.document_id and s.chunk_index=m.chunk_index and s.word_pos<m.word_pos and s.t=m.source_type group by 1,2,3,4),
tgts as (select m.document_id, m.chunk_index, m.word_pos, m.relationship_type, arg_min(s.eid, {'p':s.word_pos,'e':s.eid}) as oid
         from mark m join spot s on s.document_id=m.document_id and s.chunk_index=m.chunk_index and s.word_pos>m.word_pos and s.t=m.target_type group by 1,2,3,4),
rel0 as (select sha256(document_id||'|'||chunk_index||'|'||word_pos||'|'||relationship_type||'|'||m.source_type||'|'||m.target_type) as id, document_id, chunk_index, sid as source_entity_id,
         oid as target_entity_id, relationship_type, m.confidence, m.cue as evidence_text, (chunk_index::bigint*4294967296+word_pos)::bigint as seq
         from mark m join srcs using (document_id, chunk_index, word_pos, relationship_type) join tgts using (document_id, chunk_index, word_pos, relationship_type)
         where sid<>oid),
extrel as (select * from rel0 qualify row_number() over (partition by lower(source_entity_id), relationship_type, lower(target_entity_id) order by confidence desc, seq)=1)"""


@query("extract_relations_by_cues", with_ctes(TEXT, EXTREL, body="select * from extrel"))
def _(spark, sf):
    return X.extract_relations(_chunks(spark, sf), stored_entities(spark, sf), N.cue_words(spark, sf))


# -- response tables -------------------------------------------------------

def entity_responses(spark, sf):
    """One JSON answer per document built from its gazetteer names: fenced, plain, badly typed or broken by id."""
    docs = N.text_documents(spark, sf)
    ch = docs.select(F.col("id").alias("document_id"), F.lit(0).alias("chunk_index"), F.col("raw_text").alias("text"))
    hits = X.mentions(ch, N.gazetteer(spark, sf), evidence=False).groupBy("document_id", "name", "entity_type").agg(F.min("word_pos").alias("p"))
    k = F.col("document_id") % 4
    item = F.struct(
        "p", F.concat(F.lit('{"name":" '), "name", F.lit(' ","type":"'), F.when(k == 1, F.upper("entity_type")).otherwise(F.col("entity_type")),
                      F.lit('","attributes":'), F.when(F.col("p") % 3 == 0, '"none"').otherwise(F.concat(F.lit('{"at":"'), "p", F.lit('"}'))),
                      F.lit(',"evidence":"seen at '), "p", F.lit('"'),
                      F.when(F.col("p") % 2 == 0, F.concat(F.lit(',"confidence":'), F.col("p") / 100.0)).otherwise(F.when(F.col("p") % 5 == 0, ',"confidence":"high"').otherwise("")),
                      F.lit("}")).alias("j"))
    body = F.concat(F.lit('{"entities":['), F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.j), ","),
                    F.when(F.first("document_id") % 7 == 0, "").otherwise("]}"))
    per = hits.groupBy("document_id").agg(body.alias("b"))
    fenced = F.when(F.col("document_id") % 3 == 0, F.concat(F.lit("```json\n"), "b", F.lit("\n```"))).otherwise(F.col("b"))
    return per.select("document_id", F.lit(0).alias("chunk_index"), fenced.alias("response"))


RESPONSES = r"""
rs_w as (select id, regexp_extract_all(lower(raw_text), '[\p{L}\p{N}]+') as w from docs),
rs_n as (select distinct len(regexp_extract_all(name, '[\p{L}\p{N}]+')) as n from gaz),
rs_h as (
  select document_id, name, entity_type, min(i) as p from (
    select id as document_id, array_to_string(w[i:i+n-1], ' ') as token, i from rs_w, rs_n, unnest(range(1, len(w)-n+2)) as u(i)
  ) join gaz on gaz.name=token group by 1,2,3)"""
# rows a response reader must produce: broken answers (id % 7 = 0) and shouted types (id % 4 = 1) give none
RESP_ENTITIES = RESPONSES + """,
rs_i as (select *, row_number() over (partition by document_id order by p, name) - 1 as item from rs_h),
resp_e as (
  select sha256(document_id||'|0|'||item) as id, document_id, 0 as chunk_index, entity_type, name,
         case when p%2=0 then greatest(0.0::double, least(1.0::double, p/100.0::double)) else 0.8::double end as confidence,
         'seen at '||p as evidence_chunk, case when p%3=0 then null else p::varchar end as at, item::bigint as pos
  from rs_i where document_id%7<>0 and document_id%4<>1)"""


@query("entities_from_responses", with_ctes(TEXT, RESP_ENTITIES, body="select * from resp_e"))
def _(spark, sf):
    e = X.entities_from_responses(entity_responses(spark, sf))
    return e.withColumn("at", F.try_element_at("attributes", F.lit("at"))).drop("attributes")


@query("responses_malformed", with_ctes(TEXT, RESPONSES, body="select distinct document_id from rs_h where document_id%7=0"))
def _(spark, sf):
    return X.parse_responses(entity_responses(spark, sf), X.ENTITY_RESPONSE)[1].select("document_id")


def relation_responses(spark, sf, answers=None):
    """One JSON answer per document relating each found name to the next, with unknown types and names mixed in; ``answers`` for entities may be given."""
    e = cut_lineage(X.entities_from_responses(entity_responses(spark, sf) if answers is None else answers))
    w = Window.partitionBy("document_id").orderBy("pos")
    nxt = e.withColumn("nxt", F.lead("name").over(w)).filter("nxt is not null")
    typ = F.element_at(F.array(*[F.lit(t) for t in ("uses", "OWNS", "ACQUIRED_BY", "Located_In")]), (F.col("pos") % 4 + 1).cast("int"))
    item = F.struct("pos", F.concat(
        F.lit('{"source":"'), F.upper("name"), F.lit('","type":" '), typ, F.lit(' ","target":"'),
        F.when(F.col("pos") % 5 == 4, "nobody").otherwise(F.col("nxt")), F.lit('","evidence":"next","confidence":'), F.col("pos") / 10.0, F.lit("}")).alias("j"))
    per = nxt.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.j), ",").alias("b"))
    return per.select("document_id", F.lit(0).alias("chunk_index"), F.concat(F.lit('{"relations":['), "b", F.lit("]}")).alias("response")), e


RESP_RELATIONS = RESP_ENTITIES + """,
resp_n as (select *, lead(name) over (partition by document_id order by pos) as nxt,
           ['USES','OWNS','ACQUIRED_BY','LOCATED_IN'][(pos%4+1)::int] as rt from resp_e),
resp_j as (select *, row_number() over (partition by document_id order by pos)-1 as item from resp_n where nxt is not null),
resp_r as (
  select sha256(j.document_id||'|0|'||j.item) as id, j.document_id, 0 as chunk_index, s.id as source_entity_id, t.id as target_entity_id,
         j.rt as relationship_type, least(1.0::double, j.pos/10.0::double) as confidence, 'next' as evidence_text, j.item::bigint as seq
  from resp_j j join resp_e s on s.document_id=j.document_id and s.name=j.name join resp_e t on t.document_id=j.document_id and t.name=j.nxt
  where j.rt<>'ACQUIRED_BY' and j.pos%5<>4)"""


@query("relations_from_responses", with_ctes(TEXT, RESP_RELATIONS, body="select * from resp_r"))
def _(spark, sf):
    resp, e = relation_responses(spark, sf)
    return X.relations_from_responses(resp, e)


# -- table operators -------------------------------------------------------

@query("relations_dedup", with_ctes(STAR, body="""
select src, type, tgt, confidence, id from star_r
qualify row_number() over (partition by lower(src), type, lower(tgt) order by coalesce(confidence,0) desc, id)=1"""))
def _(spark, sf):
    r = N.star_relationships(spark, sf)
    ranked = X.dedup_relations(r, seq="id")
    return ranked.select(F.col("source_entity_id").alias("src"), F.col("relationship_type").alias("type"), F.col("target_entity_id").alias("tgt"), "confidence", "id")


@query("relations_from_templates", with_ctes(STAR, body="""
, f as (select document_id, id, row_number() over (partition by document_id order by pos, id)-1 as i from star_e),
t(p, s, o, c, e) as (values """ + ",".join(f"('{p}',{s},{t},{c}::double,'{e}')" for p, s, t, c, e in V.RELATION_TEMPLATES) + """)
select sha256(a.document_id||'|'||t.p) as id, a.document_id, a.id as source_entity_id, b.id as target_entity_id, t.p as relationship_type, t.c as confidence, t.e as evidence_text
from t join f a on a.i=t.s join f b on b.document_id=a.document_id and b.i=t.o where a.id<>b.id"""))
def _(spark, sf):
    return X.template_relations(N.star_entities(spark, sf))


@query("relationship_rows_with_names", with_ctes(STAR, MENTION, body="""
select r.id, r.document_id, r.src as source_entity_id, r.tgt as target_entity_id, coalesce(s.name, r.src) as source_entity_name,
       coalesce(t.name, r.tgt) as target_entity_name, r.type as relationship_type, coalesce(r.confidence,0.0::double) as confidence, '' as evidence_text
from (select * from star_r union all select * from men_r) r left join star_e s on s.id=r.src left join star_e t on t.id=r.tgt"""))
def _(spark, sf):
    rels = X.merge_results(N.star_relationships(spark, sf), N.mention_relationships(spark, sf))
    return X.relationship_rows(rels, N.star_entities(spark, sf))


@query("extraction_results_merged", with_ctes(TEXT, TOKENS, RESP_ENTITIES, body="""
select id, document_id, entity_type, name, confidence from ext union all select id, document_id, entity_type, name, confidence from resp_e"""))
def _(spark, sf):
    cols = ["id", "document_id", "entity_type", "name", "confidence"]
    return X.merge_results(_entities(spark, sf).select(cols), X.entities_from_responses(entity_responses(spark, sf)).select(cols))


@query("entity_listing", with_ctes(MENTION, body="""
select m.id, m.document_id, m.entity_type, name, 'ev '||m.pos as evidence_chunk, confidence, ts as created_at
from men_e m join events on event_id=m.pos where m.entity_type='Company' order by ts desc, m.id limit 500 offset 20"""))
def _(spark, sf):
    ts = N.table(spark, sf, "events").select(F.col("event_id").alias("pos"), F.col("ts").alias("created_at"))
    e = N.mention_entities(spark, sf).join(ts, "pos").withColumn("evidence_chunk", F.lit("")).withColumn(
        "attributes", F.to_json(F.create_map(F.lit("_evidence"), F.concat(F.lit("ev "), "pos"), F.lit("k"), F.lit("v"))))
    return X.list_entities(e, entity_type="Company", limit=500, offset=20).drop("attributes")


@query("relationship_listing", with_ctes(MENTION, body="""
select m.id, m.document_id, src as source_entity_id, tgt as target_entity_id, type as relationship_type, confidence, ts as created_at
from men_r m join events on 'm:'||event_id=m.id where type='USES' order by ts desc, m.id limit 100 offset 5"""))
def _(spark, sf):
    ts = N.table(spark, sf, "events").select(F.concat(F.lit("m:"), "event_id").alias("id"), F.col("ts").alias("created_at"))
    return X.list_relationships(N.mention_relationships(spark, sf).join(ts, "id"), relationship_type="USES", limit=100, offset=5)


@query("type_counts", with_ctes(STAR, MENTION, body="""
select 'entity' as kind, entity_type as type, count(*) as cnt from (select entity_type from star_e union all select entity_type from men_e) group by 2
union all select 'relationship', type, count(*) from (select type from star_r union all select type from men_r) where type in ('USES','OWNS','DEPENDS_ON') group by 2"""))
def _(spark, sf):
    e = X.merge_results(N.star_entities(spark, sf).select("entity_type"), N.mention_entities(spark, sf).select("entity_type"))
    r = X.merge_results(N.star_relationships(spark, sf).select("relationship_type"), N.mention_relationships(spark, sf).select("relationship_type"))
    a = X.type_counts(e, "entity_type").select(F.lit("entity").alias("kind"), F.col("entity_type").alias("type"), "cnt")
    b = X.type_counts(r, "relationship_type", ["USES", "OWNS", "DEPENDS_ON"])
    return a.unionByName(b.select(F.lit("relationship").alias("kind"), F.col("relationship_type").alias("type"), "cnt"))
