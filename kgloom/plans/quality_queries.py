"""Queries over issue detection, metrics, corrections, proposals and validation."""
from pyspark.sql import functions as F

from kgloom import vocab as V
from kgloom.operators import extraction as X
from kgloom.operators import ontology as O
from kgloom.operators import quality as Q
from kgloom.operators import validation as C
from kgloom.plans import lenses as N
from kgloom.plans.graph_queries import BOTH, mention_edges, mention_nodes, star_edges, star_nodes
from kgloom.plans.lenses import MENTION, STAR, with_ctes
from kgloom.plans.registry import query

NOW = "2024-02-01 00:00:00"
KNOWN = "(" + ",".join(f"'{t.lower()}'" for t in V.ENTITY_TYPES) + ")"
KNOWN_RELS = "(" + ",".join(f"'{t.lower()}'" for t in V.RELATIONSHIP_TYPES) + ")"


def both_entities(spark, sf):
    return X.merge_results(N.star_entities(spark, sf), N.mention_entities(spark, sf))


def both_relationships(spark, sf):
    return X.merge_results(N.star_relationships(spark, sf), N.mention_relationships(spark, sf))


@query("quality_low_confidence_entities", with_ctes(BOTH, body="select id, document_id, entity_type, name, confidence from all_e where confidence<0.5"))
def _(spark, sf):
    return Q.low_confidence_entities(both_entities(spark, sf)).select("id", "document_id", "entity_type", "name", "confidence")


@query("quality_low_confidence_relationships", with_ctes(BOTH, body="select id, document_id, src as source_entity_id, tgt as target_entity_id, type as relationship_type, confidence from all_r where confidence<0.5"))
def _(spark, sf):
    return Q.low_confidence_relationships(both_relationships(spark, sf))


@query("quality_duplicate_entities", with_ctes(BOTH, body="select name, document_id, count(*) as cnt from all_e group by 1,2 having count(*)>1"))
def _(spark, sf):
    return Q.duplicate_entities(both_entities(spark, sf))


@query("quality_orphan_entities", with_ctes(BOTH, body="select id, document_id, entity_type, name from all_e where id not in (select src from all_r union select tgt from all_r)"))
def _(spark, sf):
    return Q.orphan_entities(both_entities(spark, sf), both_relationships(spark, sf)).select("id", "document_id", "entity_type", "name")


@query("quality_unknown_entity_types", with_ctes(BOTH, body=f"select entity_type, count(*) as cnt from all_e where entity_type<>'' and lower(entity_type) not in {KNOWN} group by 1"))
def _(spark, sf):
    return Q.unknown_entity_types(both_entities(spark, sf))


SPARSE = """(select e.document_id, ec as entity_count, coalesce(rc,0)::bigint as relationship_count
from (select document_id, count(*) as ec from all_e group by 1 having count(*)>5) e left join (select document_id, count(*) as rc from all_r group by 1) r using (document_id) where coalesce(rc,0)<2)"""


@query("quality_sparse_documents", with_ctes(BOTH, body=f"select * from {SPARSE}"))
def _(spark, sf):
    return Q.sparse_documents(both_entities(spark, sf), both_relationships(spark, sf))


ISSUES = f""",
rn as (select r.*, coalesce(s.name, r.src) as sn, coalesce(t.name, r.tgt) as tn from men_r r left join men_e s on s.id=r.src left join men_e t on t.id=r.tgt),
all_e as (select * from men_e), all_r as (select * from men_r),
found as (
  select 'low_confidence_entity' as issue_type, 'warning' as severity, id as entity_id, null::varchar as relationship_id, document_id,
         'Entity '''||name||''' ('||entity_type||') has confidence '||printf('%.2f', round(confidence,2))||', below threshold 0.5' as description
  from (select * from men_e where confidence<0.5)
  union all
  select 'low_confidence_relationship', 'warning', null, id, document_id,
         'Relationship '''||sn||''' -['||type||']-> '''||tn||''' has confidence '||printf('%.2f', round(confidence,2)) from (select * from rn where confidence<0.5)
  union all
  select 'duplicate_entity', 'error', null, null, document_id, 'Entity '''||name||''' appears '||cnt||' times in document '||document_id[1:8]||'…'
  from (select name, document_id, count(*) as cnt from men_e group by 1,2 having count(*)>1)
  union all
  select 'orphan_entity', 'info', id, null, document_id, 'Entity '''||name||''' ('||entity_type||') has no relationships'
  from (select * from men_e where id not in (select src from men_r union select tgt from men_r))
  union all
  select 'unknown_entity_type', 'warning', null, null, null, 'Entity type '''||entity_type||''' is not in the known taxonomy ('||count(*)||' entities)'
  from men_e where lower(entity_type) not in {KNOWN} group by entity_type
  union all
  select 'sparse_relationships', 'info', null, null, document_id, 'Document has '||entity_count||' entities but only '||relationship_count||' relationships — consider re-running relationship extraction' from {SPARSE}
)"""


def _issue_inputs(spark, sf):
    e = N.mention_entities(spark, sf)
    return e, X.relationship_rows(N.mention_relationships(spark, sf), e)


def old_issues(spark, sf):
    """Earlier issues, one per error event: open, resolved and dismissed ones."""
    ev = N.table(spark, sf, "events").filter("event_type = 'error'")
    status = F.element_at(F.array(*[F.lit(s) for s in ("open", "resolved", "dismissed")]), (F.col("event_id") % 3 + 1).cast("int"))
    return ev.select(
        F.concat(F.lit("old:"), "event_id").alias("id"), F.lit("orphan_entity").alias("issue_type"), F.lit("info").alias("severity"),
        F.concat(F.lit("e:"), "event_id").alias("entity_id"), F.lit(None).cast("string").alias("relationship_id"),
        F.concat(F.lit("u:"), "user_id").alias("document_id"), F.lit("old").alias("description"),
        F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise("broken").alias("detail_json"), status.alias("status"), F.col("ts").alias("detected_at"))


OLD_ISSUES = """,
old as (select 'old:'||event_id as id, 'orphan_entity' as issue_type, 'info' as severity, 'e:'||event_id as entity_id, null::varchar as relationship_id, 'u:'||user_id as document_id,
        'old' as description, ['open','resolved','dismissed'][(event_id%3+1)::int] as status, ts as detected_at,
        case when event_id%2=0 then json_extract_string(props,'$.k') end as k from events where event_type='error')"""


@query("quality_detect_issues", with_ctes(MENTION + ISSUES + OLD_ISSUES, body="""
select issue_type, severity, entity_id, relationship_id, document_id, description, status from old where status<>'open'
union all select issue_type, severity, entity_id, relationship_id, document_id, description, 'open' from found"""))
def _(spark, sf):
    e, r = _issue_inputs(spark, sf)
    return Q.detect_issues(e, r, old_issues(spark, sf), 0.5, NOW).select("issue_type", "severity", "entity_id", "relationship_id", "document_id", "description", "status")


@query("quality_issue_details", with_ctes(MENTION + ISSUES, body="""
select issue_type, count(*) as issues, count(distinct description) as descriptions from found group by 1"""))
def _(spark, sf):
    e, r = _issue_inputs(spark, sf)
    found = Q.find_issues(e, r, 0.5, NOW)
    return found.groupBy("issue_type").agg(F.count("*").alias("issues"), F.count_distinct("description").alias("descriptions"))


@query("quality_issue_listing", with_ctes(OLD_ISSUES.strip(",\n"), body=" select id, issue_type, severity, document_id, status, detected_at, k from old where status='resolved' and severity='info' order by detected_at desc, id"))
def _(spark, sf):
    out = Q.list_issues(old_issues(spark, sf), "resolved", severity="info")
    return out.withColumn("k", F.try_element_at("detail", F.lit("k"))).select("id", "issue_type", "severity", "document_id", "status", "detected_at", "k")


def sql_metrics(e, r, t=0.5, nodes="0::bigint", edges="0::bigint"):
    return f"""
select ne as entity_count, nr as relationship_count, round(he/ne::double,4) as entity_accuracy, round(hr/nr::double,4) as relationship_accuracy,
       round(cov/ty::double,4) as ontology_coverage, round(nr/ne::double,4) as graph_completeness, (ne-he)::bigint as low_confidence_entities, (nr-hr)::bigint as low_confidence_relationships,
       (select count(*) from (select name, document_id from {e} group by 1,2 having count(*)>1)) as duplicate_entities,
       (select count(*) from {e} where id not in (select src from {r} union select tgt from {r})) as orphan_entities,
       ty as unique_entity_types, 5::bigint as ontology_class_count, {nodes} as node_count, {edges} as edge_count
from (select count(*) as ne, count_if(confidence>={t}) as he from {e}), (select count(*) as nr, count_if(confidence>={t}) as hr from {r}),
     (select count(distinct entity_type) as ty, count(distinct entity_type) filter (lower(entity_type) in ('entity','person','organization','location','concept')) as cov from {e} where entity_type<>'')"""


@query("quality_metrics", with_ctes(BOTH, body=sql_metrics("all_e", "all_r", 0.5, "(select count(*) from star_e)", "(select count(*) from star_r)")))
def _(spark, sf):
    return Q.knowledge_metrics(both_entities(spark, sf), both_relationships(spark, sf), O.default_classes(spark), star_nodes(spark, sf), star_edges(spark, sf))


DEDUPED = ", kept as (select * from all_e qualify row_number() over (partition by name, document_id order by confidence desc, id)=1)"
RECASE = "case lower(entity_type) " + " ".join(f"when '{t.lower()}' then '{t}'" for t in V.ENTITY_TYPES) + " else entity_type end"


@query("quality_drop_duplicates", with_ctes(BOTH + DEDUPED, body=" select id, document_id, entity_type, name, confidence from kept"))
def _(spark, sf):
    return Q.drop_duplicate_entities(both_entities(spark, sf)).select("id", "document_id", "entity_type", "name", "confidence")


@query("quality_normalized_types", with_ctes(BOTH, body=f"select id, {RECASE} as entity_type from all_e"))
def _(spark, sf):
    return Q.normalize_entity_types(both_entities(spark, sf)).select("id", "entity_type")


@query("quality_correction_count", with_ctes(BOTH + DEDUPED, body=f" select ((select count(*) from all_e)-count(*)+count_if({RECASE}<>entity_type))::bigint as corrections from kept"))
def _(spark, sf):
    return Q.auto_correct(both_entities(spark, sf))[1]


DRIFT = f""", drift as (select 'entity' as kind, entity_type as type, count(*) as cnt from all_e where entity_type<>'' and lower(entity_type) not in {KNOWN} group by 2
union all select 'relationship', type, count(*) from all_r where type<>'' and lower(type) not in {KNOWN_RELS} group by 2)"""


@query("quality_vocabulary_drift", with_ctes(BOTH + DRIFT, body=" select * from drift"))
def _(spark, sf):
    return Q.vocabulary_drift(both_entities(spark, sf), both_relationships(spark, sf))


# -- proposals: ontology versions are made from part brands and market segments ----------------

def versions_table(spark, sf):
    """One ontology version per (brand, size): its classes are the brand's type words."""
    p = N.table(spark, sf, "part")
    cls = F.array_sort(F.collect_set(F.element_at(F.split("p_type", " "), 1)))
    item = F.concat_ws(",", F.transform(cls, lambda c: F.concat(F.lit('{"name":"'), c, F.lit('","description":"d '), c, F.lit('"}'))))
    v = p.groupBy("p_brand", "p_size").agg(item.alias("i"), F.count("*").alias("n"))
    return v.select(
        F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("id"), F.when(F.col("p_size") % 5 == 0, None).otherwise(F.col("p_brand")).alias("document_id"),
        F.col("p_size").alias("size"), F.concat(F.lit('{"domain":"parts","classes":['), "i", F.lit(',{"name":"person"}],"relationships":[]}')).alias("ontology_json"),
        (F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(days=F.col("p_size"))).alias("created_at"))


VERSIONS = """
vers as (select p_brand||'/'||p_size as id, case when p_size%5=0 then null else p_brand end as document_id, p_size as size,
         list_sort(list(distinct string_split(p_type,' ')[1])) as cls, timestamp '2024-01-01' + to_days(p_size) as created_at from part group by p_brand, p_size),
last5 as (select * from vers),
vcls as (select id as version_id, i-1 as pos, cls[i] as name, 'd '||cls[i] as description from last5, unnest(range(1, len(cls)+1)) as u(i)),
from_versions as (select 'add_class' as proposal_type, 'Add ontology class '''||name||''' discovered in extracted ontology' as description,
   'Class '''||name||''' was discovered during ontology analysis but is not in the active ontology manager.' as rationale,
   to_json({'subject': name, 'description': description})::varchar as detail_json from vcls)"""


def _proposal_view(df):
    return df.select("proposal_type", "status", "description", "rationale", "detail_json", "proposed_at")


@query("proposals_from_versions", with_ctes(VERSIONS, body=f" select *, 'pending' as status, timestamp '{NOW}' as proposed_at from from_versions"))
def _(spark, sf):
    return _proposal_view(Q.proposals_from_versions(versions_table(spark, sf), O.default_classes(spark), NOW))


@query("proposals_from_responses", f"""
select case when turn%2=0 then 'add_class' else 'merge_class' end as proposal_type, 'pending' as status, 'about '||role as description, '' as rationale,
       to_json({{'subject': role||turn, 'target': case when turn%3=0 then 'Entity' else null end}})::varchar as detail_json, timestamp '{NOW}' as proposed_at
from conversations where conv_id%4<>3""")
def _(spark, sf):
    c = N.table(spark, sf, "conversations")
    body = F.concat(
        F.lit('["noise",{"proposal_type":"'), F.when(F.col("turn") % 2 == 0, "add_class").otherwise("merge_class"), F.lit('","subject":"'), "role", F.col("turn").cast("string"),
        F.lit('","target":'), F.when(F.col("turn") % 3 == 0, '"Entity"').otherwise("null"), F.lit(',"description":"about '), "role", F.lit('"},{"subject":"no kind"}'),
        F.when(F.col("conv_id") % 4 == 3, " broken").otherwise("]"))
    resp = c.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("response_id"),
                    F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body).alias("response"))
    out = _proposal_view(Q.proposals_from_responses(resp, NOW))
    return out


FROM_DRIFT = """,
known(name) as (values """ + ",".join(f"('{t}')" for t in V.ENTITY_TYPES + [n for n, _ in V.DEFAULT_CLASSES]) + """),
bare as (select *, regexp_replace(lower(type),'[^\\p{L}\\p{N}]','','g') as b from dr where kind='entity'),
kb as (select distinct name, regexp_replace(lower(name),'[^\\p{L}\\p{N}]','','g') as b from known),
near as (select type, cnt, min({'d': levenshtein(bare.b, kb.b), 't': kb.name}) as m from bare, kb where levenshtein(bare.b, kb.b)<=2 group by 1,2),
from_drift as (
  select 'add_relationship' as proposal_type, 'Add relationship type '''||type||'''' as description, cnt, type, null::varchar as target from dr where kind='relationship'
  union all select 'rename_class', 'Rename '''||type||''' to '''||m.t||'''', cnt, type, m.t from near where m.d=0
  union all select 'merge_class', 'Merge '''||type||''' into '''||m.t||'''', cnt, type, m.t from near where m.d>0
  union all select 'add_class', 'Add ontology class '''||type||'''', cnt, type, null from bare where type not in (select type from near)
)"""


def _drift_input(spark, sf):
    """Drift over noisy spellings made from market segments, priorities and the mention types."""
    cu = N.table(spark, sf, "customer").select(F.explode(F.array(F.col("c_mktsegment"), F.lit("Com-pany"), F.lit("Produkt"), F.lit("per_son"), F.lit("Gadget"))).alias("entity_type"))
    o = N.table(spark, sf, "orders").select(F.when(F.col("o_orderstatus") == "O", "uses").otherwise(F.concat(F.lit("has "), "o_orderpriority")).alias("relationship_type"))
    return Q.vocabulary_drift(cu, o)


DRIFT_INPUT = f"""
dr as (select 'entity' as kind, t as type, count(*) as cnt from (select c_mktsegment as t from customer union all select 'Com-pany' from customer union all select 'Produkt' from customer
        union all select 'per_son' from customer union all select 'Gadget' from customer) where lower(t) not in {KNOWN} group by 2
       union all select 'relationship', 'has '||o_orderpriority, count(*) from orders where o_orderstatus<>'O' group by 2)"""


def _known_names(spark):
    return spark.createDataFrame([(n,) for n in V.ENTITY_TYPES + [c for c, _ in V.DEFAULT_CLASSES]], "name string")


@query("proposals_from_drift", with_ctes(DRIFT_INPUT + FROM_DRIFT, body=f"""
 select proposal_type, 'pending' as status, description, cnt||' rows use the unknown type '''||type||'''' as rationale,
        to_json({{'subject': type, 'target': target}})::varchar as detail_json, timestamp '{NOW}' as proposed_at from from_drift"""))
def _(spark, sf):
    return _proposal_view(Q.proposals_from_drift(_drift_input(spark, sf), _known_names(spark), NOW))


def _old_proposals(spark, sf):
    """Earlier proposals, one per conversation turn."""
    c = N.table(spark, sf, "conversations")
    k = F.col("turn") % 4
    kind = F.element_at(F.array(*[F.lit(x) for x in ("add_class", "add_relationship", "merge_class", "rename_class")]), (k + 1).cast("int"))
    status = F.element_at(F.array(*[F.lit(x) for x in ("pending", "applied", "dismissed")]), (F.col("conv_id") % 3 + 1).cast("int"))
    return c.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), kind.alias("proposal_type"), status.alias("status"),
        F.concat(F.lit("turn "), "turn").alias("description"), F.lit("").alias("rationale"),
        F.concat(F.lit('{"subject":"'), F.when(F.col("conv_id") % 5 == 0, "").otherwise(F.concat(F.initcap("role"), (F.col("conv_id") % 7).cast("string"))), F.lit('"}')).alias("detail_json"),
        (F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(hours=F.col("conv_id").cast("int"))).alias("proposed_at"), F.lit(None).cast("timestamp_ntz").alias("applied_at"))


OLD_PROPOSALS = """
oldp as (select conv_id||'-'||turn as id, ['add_class','add_relationship','merge_class','rename_class'][(turn%4+1)::int] as proposal_type,
         ['pending','applied','dismissed'][(conv_id%3+1)::int] as status, 'turn '||turn as description,
         case when conv_id%5=0 then '' else upper(role[1:1])||role[2:]||(conv_id%7) end as subject, timestamp '2024-01-01' + to_hours(conv_id) as proposed_at from conversations)"""


@query("proposals_generated", with_ctes(OLD_PROPOSALS, VERSIONS, DRIFT_INPUT + FROM_DRIFT, body="""
 select proposal_type, status, description from oldp where status<>'pending'
 union all select proposal_type, 'pending', description from from_versions union all select proposal_type, 'pending', description from from_drift"""))
def _(spark, sf):
    out = Q.generate_proposals(_old_proposals(spark, sf), Q.proposals_from_versions(versions_table(spark, sf), O.default_classes(spark), NOW),
                               Q.proposals_from_drift(_drift_input(spark, sf), _known_names(spark), NOW))
    return out.select("proposal_type", "status", "description")


def _apply(spark, sf):
    asked = N.table(spark, sf, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), (F.col("turn") + 1).cast("string")).alias("id"))
    vocabulary = spark.createDataFrame([(t,) for t in V.RELATIONSHIP_TYPES], "relationship_type string")
    return Q.apply_proposals(asked, _old_proposals(spark, sf), O.default_classes(spark), vocabulary, NOW)


APPLY = OLD_PROPOSALS + """,
asked as (select distinct conv_id||'-'||(turn+1) as id from conversations),
j as (select a.id, p.proposal_type, p.status, p.subject from asked a left join oldp p using (id)),
made as (select min(id) as id, lower(subject) as k from j where status='pending' and proposal_type='add_class' and subject<>'' and lower(subject) not in ('entity','person','organization','location','concept') group by 2)"""


@query("proposals_applied", with_ctes(APPLY, body=""" select id, coalesce(status='pending', false) as success,
 case when proposal_type is null then 'Proposal not found' when status<>'pending' then 'Proposal is already '||status
      when proposal_type='add_class' and subject='' then 'No class name in proposal detail'
      when proposal_type='add_class' and id in (select id from made) then 'Added ontology class '''||subject||''''
      when proposal_type='add_class' then 'Class '''||subject||''' already exists — marked as applied'
      when proposal_type='add_relationship' and subject='' then 'No relationship type in proposal detail'
      when proposal_type='add_relationship' then 'Registered relationship type '''||subject||''''
      else 'Proposal marked applied — manual graph rebuild required to propagate '||proposal_type end as message from j"""))
def _(spark, sf):
    return _apply(spark, sf)[0]


@query("proposals_after_apply", with_ctes(APPLY, body=f""" select p.id, proposal_type, case when p.status='pending' and a.id is not null then 'applied' else p.status end as status,
 case when p.status='pending' and a.id is not null then timestamp '{NOW}' end as applied_at from oldp p left join asked a on a.id=p.id"""))
def _(spark, sf):
    return _apply(spark, sf)[1].select("id", "proposal_type", "status", "applied_at")


@query("proposals_applied_vocabulary", with_ctes(APPLY, body=""" select 'class' as kind, subject as name from j where id in (select id from made)
 union all select 'class', c from (values ('Entity'),('Person'),('Organization'),('Location'),('Concept')) t(c)
 union all select 'relationship', t from (values """ + ",".join(f"('{t}')" for t in V.RELATIONSHIP_TYPES) + """) t(t)
 union all select 'relationship', arg_max(subject, id) from j where status='pending' and proposal_type='add_relationship' and subject<>'' group by lower(subject)"""))
def _(spark, sf):
    _r, _p, classes, vocabulary = _apply(spark, sf)
    return classes.select(F.lit("class").alias("kind"), "name").unionByName(vocabulary.select(F.lit("relationship").alias("kind"), F.col("relationship_type").alias("name")))


@query("proposals_dismissed", with_ctes(OLD_PROPOSALS, body=" select id, case when id in (select conv_id||'-'||(turn*2) from conversations) then 'dismissed' else status end as status from oldp"))
def _(spark, sf):
    ids = N.table(spark, sf, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), (F.col("turn") * 2).cast("string")).alias("id"))
    return Q.dismiss_proposals(ids, _old_proposals(spark, sf)).select("id", "status")


@query("proposal_listing", with_ctes(OLD_PROPOSALS, body=" select id, proposal_type, description, proposed_at from oldp where status='pending' order by proposed_at desc, id"))
def _(spark, sf):
    return Q.list_proposals(_old_proposals(spark, sf), "pending").select("id", "proposal_type", "description", "proposed_at")


@query("quality_analysis", with_ctes(MENTION + ISSUES + DEDUPED + DRIFT, VERSIONS, body=f""",
 keptn as (select id, document_id, {RECASE} as entity_type, name, confidence from kept),
 m as ({sql_metrics('keptn', 'men_r')})
 select m.*, (select count(*) from found) as issues_detected, ((select count(*) from drift)+(select count(*) from from_versions))::bigint as proposals_generated,
        ((select count(*) from men_e)-(select count(*) from kept)+(select count_if({RECASE}<>entity_type) from kept))::bigint as auto_corrections_applied from m"""))
def _(spark, sf):
    e, r = _issue_inputs(spark, sf)
    return Q.analyze(e, r, O.default_classes(spark), versions_table(spark, sf), old_issues(spark, sf), _old_proposals(spark, sf), None, None, NOW, correct=True)[0]


@query("quality_confidence_by_type", with_ctes(BOTH, body="select entity_type, count(*) as cnt, round(avg(confidence),6) as mean_confidence from all_e group by 1"))
def _(spark, sf):
    return Q.confidence_by_type(both_entities(spark, sf)).withColumn("mean_confidence", F.round("mean_confidence", 6))


@query("quality_weakest_entities", with_ctes(BOTH, body="select id, name, confidence from all_e where confidence<0.7 order by confidence, id limit 20"))
def _(spark, sf):
    return Q.weakest_entities(both_entities(spark, sf)).select("id", "name", "confidence")


# -- validation ------------------------------------------------------------

def _flawed(spark, sf):
    """Mentions with blank names and relationships to filtered-out or missing ends and without type."""
    e = N.mention_entities(spark, sf).filter("entity_type <> 'Gadget'").withColumn("name", F.when(F.col("name") == "error", "  ").otherwise(F.col("name")))
    r = N.mention_relationships(spark, sf).withColumn("relationship_type", F.when(F.col("confidence") == 1.0, " ").otherwise(F.col("relationship_type")))
    return e, r


FLAWED = MENTION + """,
fe as (select id, document_id, case when name='error' then '  ' else name end as name from men_e where entity_type<>'Gadget'),
fr as (select id, document_id, src, tgt, case when confidence=1.0 then ' ' else type end as type from men_r),
vio as (
  select 'ENT_001' as rule_id, 'error' as severity, 'Entity has empty text' as message, id as node_id, document_id from fe where trim(name)=''
  union all select 'REL_001', 'error', 'Relation subject '''||src||''' not found in entities', id, document_id from fr where src not in (select id from fe)
  union all select 'REL_002', 'error', 'Relation object '''||tgt||''' not found in entities', id, document_id from fr where tgt not in (select id from fe)
  union all select 'REL_003', 'warning', 'Relation has empty predicate', id, document_id from fr where trim(type)='')"""


@query("validation_consistency", with_ctes(FLAWED, body=" select * from vio"))
def _(spark, sf):
    return C.consistency_violations(*_flawed(spark, sf)).drop("property_name")


REPORT = """, rep as (select document_id, 'consistency' as rule_set, sum(c)::bigint as total_checked, sum(er)::bigint as error_count, sum(wa)::bigint as warning_count, sum(er)=0 as passed from (
  select document_id, 1 as c, 0 as er, 0 as wa from fe union all select document_id, 1, 0, 0 from fr
  union all select document_id, 0, (severity='error')::int, (severity='warning')::int from vio) group by 1)"""


@query("validation_report_total", with_ctes(FLAWED, REPORT.strip(", "), body=" select null::varchar as document_id, 'consistency' as rule_set, sum(total_checked)::bigint as total_checked, sum(error_count)::bigint as error_count, sum(warning_count)::bigint as warning_count, bool_and(passed) as passed from rep"))
def _(spark, sf):
    e, r = _flawed(spark, sf)
    return C.validation_report(C.consistency_violations(e, r), e, r)


@query("validation_report_per_document", with_ctes(FLAWED, REPORT.strip(", "), body=" select * from rep"))
def _(spark, sf):
    e, r = _flawed(spark, sf)
    return C.validation_report(C.consistency_violations(e, r), e, r, per_document=True)


@query("validation_report_lines", with_ctes(FLAWED, REPORT.strip(", "), body=""" select document_id,
 'Validation '||case when passed then 'PASSED' else 'FAILED' end||': '||error_count||' errors, '||warning_count||' warnings across '||total_checked||' items' as summary,
 to_json({'document_id': document_id, 'rule_set': rule_set, 'total_checked': total_checked, 'error_count': error_count, 'warning_count': warning_count, 'passed': passed})::varchar as report_json from rep"""))
def _(spark, sf):
    e, r = _flawed(spark, sf)
    return C.report_summary(C.validation_report(C.consistency_violations(e, r), e, r, per_document=True))


@query("validation_violation_objects", with_ctes(FLAWED, body=""" select document_id,
 to_json({'rule_id': rule_id, 'severity': severity, 'message': message, 'node_id': node_id, 'property_name': null::varchar})::varchar as violation from vio"""))
def _(spark, sf):
    return C.violations_json(C.consistency_violations(*_flawed(spark, sf)))


# fixed rules for the property lens
RULES = [
    ("segment-required", "minCount", "Company", "segment", None),
    ("price-number", "datatype", "Product", "price", "float"),
    ("status-number", "datatype", "Contract", "status", "integer"),
    ("brand-form", "pattern", "Product", "brand", "^Brand#1[0-9]*$"),
    ("depends-target", "class", "Product", "DEPENDS_ON", None),
    ("owns-target", "class", "Product", "OWNS", None),
]


@query("validation_shapes", with_ctes(STAR, body="""
select 'segment-required' as rule_id, 'error' as severity, 'Required property ''segment'' is missing' as message, id as node_id, 'segment' as property_name, document_id from star_e where entity_type='Company' and id like 's:%'
union all select 'status-number', 'error', 'Property ''status'' is not of type integer', id, 'status', document_id from star_e join orders on id='o:'||o_orderkey where try_cast(o_orderstatus as bigint) is null
union all select 'brand-form', 'warning', 'Property ''brand'' does not match ^Brand#1[0-9]*$', id, 'brand', document_id from star_e join part on id='p:'||p_partkey where not regexp_matches(p_brand, '^Brand#1[0-9]*$')
union all select 'depends-target', 'warning', 'Target of DEPENDS_ON is not a Product', r.id, 'DEPENDS_ON', r.document_id from star_r r left join star_e t on t.id=r.tgt where r.type='DEPENDS_ON' and t.entity_type is distinct from 'Product'
union all select 'owns-target', 'warning', 'Target of OWNS is not a Product', r.id, 'OWNS', r.document_id from star_r r left join star_e t on t.id=r.tgt where r.type='OWNS' and t.entity_type is distinct from 'Product'"""))
def _(spark, sf):
    rules = spark.createDataFrame(RULES, "rule_id string, kind string, target_class string, property string, argument string")
    return C.shape_violations(star_nodes(spark, sf), star_edges(spark, sf), rules)


@query("validation_contradictions", """
with a as (select 's:'||l_suppkey as s, 'p:'||l_partkey as t, 'SELLS_TO' as ty, l_orderkey||'-'||l_linenumber||'-'||l_partkey||'-'||l_suppkey as id, l_returnflag from lineitem),
r as (select id, case when l_returnflag='R' then t else s end as s, case when l_returnflag='R' then s else t end as t, ty from a)
select least(s,t) as low_id, greatest(s,t) as high_id, ty as relationship_type, count(*) filter (s<t) as forward, count(*) filter (s>t) as backward, min(id) as first_id
from r group by 1,2,3 having count(*) filter (s<t)>0 and count(*) filter (s>t)>0""")
def _(spark, sf):
    li = N.table(spark, sf, "lineitem")
    s, p = F.concat(F.lit("s:"), "l_suppkey"), F.concat(F.lit("p:"), "l_partkey")
    back = F.col("l_returnflag") == "R"
    r = li.select(F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("id"),
                  F.when(back, p).otherwise(s).alias("source_entity_id"), F.when(back, s).otherwise(p).alias("target_entity_id"), F.lit("SELLS_TO").alias("relationship_type"))
    return C.contradicting_relations(r)


@query("validation_duplicate_name_type", with_ctes(BOTH, body="select name, entity_type, count(*) as cnt from all_e group by 1,2 having count(*)>1"))
def _(spark, sf):
    return C.duplicate_name_type(both_entities(spark, sf))


@query("validation_conflicting_types", with_ctes(BOTH, body="""
select name, count(distinct entity_type) as type_count, string_agg(distinct entity_type, ',' order by entity_type) as types, count(*) as cnt from all_e group by 1 having count(distinct entity_type)>1"""))
def _(spark, sf):
    return C.conflicting_types(both_entities(spark, sf))


@query("validation_missing_properties", with_ctes(STAR, body="""
select id, entity_type, 'segment' as property from star_e where entity_type='Company' and id like 's:%'
union all select id, entity_type, 'country' from star_e where entity_type in ('Company','Location')
union all select id, entity_type, 'expires' from star_e where entity_type='Contract'"""))
def _(spark, sf):
    want = spark.createDataFrame([("Company", "segment"), ("Company", "country"), ("Location", "country"), ("Contract", "expires"), ("Contract", "status")], "class_name string, property string")
    return C.missing_properties(N.star_entities(spark, sf), want)


@query("validation_sparse_entities", with_ctes(BOTH, body="""
select id, name, coalesce(d,0)::bigint as degree from all_e left join (select id, count(*) as d from (select src as id from all_r union all select tgt from all_r) group by 1) using (id) where coalesce(d,0)<2"""))
def _(spark, sf):
    return C.sparse_entities(star_nodes(spark, sf).unionByName(mention_nodes(spark, sf)), star_edges(spark, sf).unionByName(mention_edges(spark, sf)))


@query("validation_low_confidence_clusters", with_ctes(MENTION, body="""
, adj as (select src as a, tgt as b from men_r union select tgt, src from men_r),
lab as (select a as id, a as l from adj union select x.b, lab.l from lab join adj x on x.a=lab.id where lab.l<x.b),
comp as (select id, min(l) as component from lab group by 1)
select component, count(distinct n) as node_count, count(distinct r.id) as edge_count, max(confidence) as max_confidence
from (select *, unnest([src, tgt]) as n from men_r) r join comp on comp.id=r.src group by 1 having max(confidence)<0.4"""))
def _(spark, sf):
    return C.low_confidence_clusters(mention_edges(spark, sf))
