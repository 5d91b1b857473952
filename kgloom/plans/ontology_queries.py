"""Queries over class tables, profiles, versions and class matching."""
from pyspark.sql import functions as F

from kgloom import vocab as V
from kgloom.operators import extraction as X
from kgloom.operators import ontology as O
from kgloom.plans import lenses as N
from kgloom.plans.graph_queries import BOTH, star_nodes
from kgloom.plans.lenses import STAR, TEXT, with_ctes
from kgloom.plans.quality_queries import VERSIONS, both_entities, versions_table
from kgloom.plans.registry import query

SEEDS = "(values ('Entity',null),('Person','Entity'),('Organization','Entity'),('Location','Entity'),('Concept','Entity')) s(name, parent_class)"


def _segment_classes(spark, sf):
    """Candidate classes from nations, regions, market segments and types, many of them repeated."""
    c = N.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.initcap("c_mktsegment").alias("name"))
    e = N.star_entities(spark, sf).select("id", F.lower("entity_type").alias("name"))
    rows = c.withColumn("id", F.concat(F.lit("seg:"), "id")).unionByName(e)
    return rows.select("id", "name", F.lit(None).cast("string").alias("description"), F.lit("Entity").alias("parent_class"),
                       F.expr("cast(array() as array<string>)").alias("properties"), F.expr("cast(array() as array<string>)").alias("synonyms"))


CANDIDATES = STAR + """,
cand as (select 'seg:'||c_custkey as id, upper(c_mktsegment[1:1])||lower(c_mktsegment[2:]) as name from customer union all select id, lower(entity_type) from star_e),
firsts as (select lower(name) as k, min(id) as id from cand group by 1),
taken as (select c.* from cand c join firsts f on f.k=lower(c.name) and f.id=c.id where f.k not in (select lower(name) from """ + SEEDS + "))"


@query("ontology_classes_added", with_ctes(CANDIDATES, body=" select name, parent_class, true as accepted, 1::bigint as cnt from " + SEEDS + """
 union all select name, 'Entity', true, 1 from taken union all select name, 'Entity', false, count(*) from cand where id not in (select id from taken) group by 1"""))
def _(spark, sf):
    classes, rejected = O.add_classes(O.default_classes(spark), _segment_classes(spark, sf))
    a = classes.select("name", "parent_class", F.lit(True).alias("accepted"), F.lit(1).cast("bigint").alias("cnt"))
    b = rejected.groupBy("name", "parent_class").agg(F.count("*").alias("cnt")).select("name", "parent_class", F.lit(False).alias("accepted"), "cnt")
    return a.unionByName(b)


@query("ontology_classes_dropped", with_ctes(CANDIDATES, body=" select name from " + SEEDS + " union all select name from taken where id not like 'seg:%'"))
def _(spark, sf):
    classes, _r = O.add_classes(O.default_classes(spark), _segment_classes(spark, sf))
    ids = N.table(spark, sf, "customer").select(F.concat(F.lit("seg:"), F.col("c_custkey").cast("string")).alias("id"))
    return O.drop_classes(classes, ids).select("name")


@query("ontology_class_by_name", with_ctes(CANDIDATES, body=" select name from taken where lower(name)='building'"))
def _(spark, sf):
    return O.class_by_name(O.add_classes(O.default_classes(spark), _segment_classes(spark, sf))[0], "bUILDing").select("name")


def _properties(spark, sf):
    """One property per part brand and per order priority."""
    p = N.table(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("n")).select(F.col("p_brand").alias("id"), F.lower("p_brand").alias("name"), F.lit("Product").alias("domain_class"))
    o = N.table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")).select(
        F.col("o_orderpriority").alias("id"), F.col("o_orderpriority").alias("name"), F.lit("Contract").alias("domain_class"), F.lit("integer").alias("range_type"), F.lit(True).alias("required"))
    return O.add_properties(o, p)


@query("ontology_properties", """
select o_orderpriority as id, o_orderpriority as name, 'Contract' as domain_class, 'integer' as range_type, true as required from orders group by 1
union all select p_brand, lower(p_brand), 'Product', 'string', false from part group by 1""")
def _(spark, sf):
    return _properties(spark, sf)


@query("ontology_properties_of_class", "select p_brand as id from part group by 1")
def _(spark, sf):
    return O.list_properties(_properties(spark, sf), "Product").select("id")


def _tree(spark, sf):
    """Class tree: market segments under nations' regions, via the tables."""
    n = N.table(spark, sf, "nation")
    r = N.table(spark, sf, "region")
    c = N.table(spark, sf, "customer")
    a = n.join(r, n.n_regionkey == r.r_regionkey).select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("r_name").alias("parent_class"))
    b = c.join(n, c.c_nationkey == n.n_nationkey).select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("n_name").alias("parent_class"))
    return a.unionByName(b).unionByName(r.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit("Entity").alias("parent_class")))


@query("ontology_ancestors", """
with t as (select n_name as child, r_name as p from nation join region on n_regionkey=r_regionkey union all select c_name, n_name from customer join nation on c_nationkey=n_nationkey
           union all select r_name, 'Entity' from region),
u as (select child, p, 1 as d from t union all select a.child, b.p, 2 from t a join t b on b.child=a.p union all select a.child, c.p, 3 from t a join t b on b.child=a.p join t c on c.child=b.p)
select child, p as ancestor, min(d)::int as distance from u group by 1,2""")
def _(spark, sf):
    return O.ancestor_pairs(_tree(spark, sf))


@query("ontology_subclass_test", "select 'r'||r_regionkey as id, r_name as name, true as is_subclass from region where r_name=(select min(r_name) from region)")
def _(spark, sf):
    t = _tree(spark, sf)
    # the region that comes first by name
    first = N.table(spark, sf, "region").agg(F.min("r_name")).scalar()
    return O.is_subclass_of(t, first, "Entity")


PROFILE = """,
ppos as (select id, entity_type, name, pos from star_e union all select id, entity_type, name, pos from men_e),
pn as (select entity_type, name, count(*) as n, min(pos) as f from ppos group by 1,2),
pr as (select *, row_number() over (partition by entity_type order by f, name) as rn from pn),
prof as (select entity_type, sum(n)::bigint as instances, count(*) as distinct_names, string_agg(case when rn<=10 then name end, ', ' order by rn) as sample,
         greatest(count(*)-10,0)::bigint as more from pr group by 1)"""


@query("ontology_type_profile", with_ctes(BOTH + PROFILE, body=" select * from prof"))
def _(spark, sf):
    return O.type_profile(both_entities(spark, sf))


PATTERNS = """,
ty_id as (select id, entity_type from star_e),
ty_name as (select name, arg_max(entity_type, pos) as entity_type from star_e group by 1),
rnm as (select r.*, coalesce(s.name, r.src) as sn, coalesce(t.name, r.tgt) as tn from all_r r left join star_e s on s.id=r.src left join star_e t on t.id=r.tgt),
pat as (select coalesce(a.entity_type, c.entity_type, 'Unknown') as source_type, type as relationship_type, coalesce(b.entity_type, d.entity_type, 'Unknown') as target_type, count(*) as cnt
  from rnm left join ty_id a on a.id=src left join ty_id b on b.id=tgt left join ty_name c on c.name=sn left join ty_name d on d.name=tn group by 1,2,3)"""


def _named_rels(spark, sf, entities=N.star_entities):
    e = entities(spark, sf)
    return e, X.relationship_rows(X.merge_results(N.star_relationships(spark, sf), N.mention_relationships(spark, sf)), e)


@query("ontology_class_patterns", with_ctes(STAR, body="""
 select a.entity_type as source_type, type as relationship_type, b.entity_type as target_type, count(*) as cnt from star_r join star_e a on a.id=src join star_e b on b.id=tgt group by 1,2,3"""))
def _(spark, sf):
    return O.class_patterns(N.star_entities(spark, sf), N.star_relationships(spark, sf))


@query("ontology_class_patterns_by_name", with_ctes(BOTH + PATTERNS, body=" select * from pat"))
def _(spark, sf):
    return O.class_patterns(*_named_rels(spark, sf))


@query("ontology_profile_lines", with_ctes(BOTH + PROFILE + PATTERNS.replace("star_e", "ppos"), body="""
 select 'Domain hint: trade' as line union all select '' union all select 'Entity types observed:' union all select '' union all select 'Relationship patterns observed:'
 union all select '  '||entity_type||' ('||instances||' instances): '||sample||case when more>0 then ' (+'||more||' more)' else '' end from prof
 union all select '  '||source_type||' --'||relationship_type||'--> '||target_type||'  ('||cnt||case when cnt=1 then ' occurrence)' else ' occurrences)' end from pat"""))
def _(spark, sf):
    e, r = _named_rels(spark, sf, both_entities)
    return O.render_profile(e, r, "trade").select("line")


ONTO = """
select 'class' as kind, entity_type as a, '' as b, '' as c, count(*) as cnt from star_e group by 2
union all select 'attribute', x.t, x.k, x.v, n from (values ('Company','segment','string',(select count(*) from customer)), ('Product','brand','string',(select count(*) from part)),
   ('Product','type','string',(select count(*) from part)), ('Product','price','float',(select count(*) from part)), ('Contract','status','string',(select count(*) from orders)),
   ('Contract','priority','string',(select count(*) from orders))) x(t,k,v,n)
union all select 'relationship', s.entity_type, type, t.entity_type, count(*) from star_r join star_e s on s.id=src join star_e t on t.id=tgt group by 2,3,4"""


@query("ontology_derived", with_ctes(STAR, body=ONTO))
def _(spark, sf):
    c, a, r = O.derive_ontology(N.star_entities(spark, sf), N.star_relationships(spark, sf))
    return (c.select(F.lit("class").alias("kind"), F.col("name").alias("a"), F.lit("").alias("b"), F.lit("").alias("c"), F.col("instances").alias("cnt"))
            .unionByName(a.select(F.lit("attribute").alias("kind"), F.col("class_name").alias("a"), F.col("attribute").alias("b"), F.col("value_type").alias("c"), F.col("seen").alias("cnt")))
            .unionByName(r.select(F.lit("relationship").alias("kind"), F.col("source_class").alias("a"), F.col("predicate").alias("b"), F.col("target_class").alias("c"), "cnt")))


@query("ontology_parts", with_ctes(STAR, body=""",
att as (select * from (values ('Company','segment','string'), ('Product','brand','string'), ('Product','price','float'), ('Product','type','string'), ('Contract','priority','string'), ('Contract','status','string')) x(t,k,v)),
cls as (select name, row_number() over (order by name) as n, '{"name":"'||name||'"'||coalesce(',"attributes":['||(select string_agg('{"name":"'||k||'","type":"'||v||'"}', ',' order by k) from att where t=name)||']','')||'}' as j
  from (select distinct entity_type as name from star_e)),
rel as (select row_number() over (order by a, p, b) as n, '{"source_class":"'||a||'","predicate":"'||p||'","target_class":"'||b||'"}' as j
  from (select distinct s.entity_type as a, type as p, t.entity_type as b from star_r join star_e s on s.id=src join star_e t on t.id=tgt)),
cp as (select (n-1)//3 as piece, string_agg(case when n>1 then ',' else '' end||j, '' order by n) as text from cls group by 1),
rp as (select (n-1)//3 as piece, string_agg(case when n>1 then ',' else '' end||j, '' order by n) as text from rel group by 1)
select 0::bigint as part, '{"domain":"trade","classes":[' as text union all select (piece+1)::bigint, text from cp
union all select (select count(*) from cp)::bigint+1, '],"relationships":[' union all select (piece+2+(select count(*) from cp))::bigint, text from rp
union all select (select count(*) from cp)::bigint+(select count(*) from rp)+2, ']}'"""))
def _(spark, sf):
    return O.ontology_parts(N.star_entities(spark, sf), N.star_relationships(spark, sf), "trade", per_part=3)


@query("ontology_derived_counts", with_ctes(STAR, body="""select count(distinct entity_type)::int as classes_count,
 (select count(*) from (select distinct s.entity_type, type, t.entity_type from star_r join star_e s on s.id=src join star_e t on t.id=tgt))::int as relationships_count from star_e"""))
def _(spark, sf):
    return O.ontology_document(N.star_entities(spark, sf), N.star_relationships(spark, sf), "trade").select("classes_count", "relationships_count")


def _ontology_responses(spark, sf):
    """One ontology answer per part brand, some fenced, some broken."""
    p = N.table(spark, sf, "part")
    types = F.array_sort(F.collect_set(F.element_at(F.split("p_type", " "), 1)))
    cls = F.array_join(F.transform(types, lambda t: F.concat(
        F.lit('{"name":"'), t, F.lit('","description":"kind","attributes":[{"name":"size","type":"integer","description":""},{"name":"price","type":"float"}],"synonyms":["'), F.lower(t), F.lit('"],"parent_class":null}'))), ",")
    rel = F.array_join(F.transform(types, lambda t: F.concat(F.lit('{"source_class":"'), t, F.lit('","predicate":"USES","target_class":"Brand","description":"x"}'))), ",")
    per = p.groupBy("p_brand").agg(F.concat(F.lit('{"domain":"d","classes":['), cls, F.lit('],"relationships":['), rel).alias("b"))
    k = F.substring("p_brand", -1, 1).cast("int") % 3
    body = F.concat("b", F.when(k == 2, "").otherwise("]}"))
    return per.select(F.col("p_brand").alias("scope_id"), F.when(k == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body).alias("response"))


@query("ontology_from_responses", """
with b as (select p_brand, list_sort(list(distinct string_split(p_type,' ')[1])) as ty, right(p_brand,1)::int%3 as k from part group by 1),
t as (select p_brand, unnest(ty) as t from b where k<>2)
select 'class' as kind, p_brand as scope_id, t as a, lower(t) as b from t
union all select 'attribute', p_brand, t, x from t, (values ('size/integer'),('price/float')) v(x)
union all select 'relationship', p_brand, t, 'USES/Brand' from t
union all select 'error', p_brand, '', '' from b where k=2""")
def _(spark, sf):
    o = O.ontology_from_responses(_ontology_responses(spark, sf))

    def part(kind, df, a, b):
        return df.select(F.lit(kind).alias("kind"), "scope_id", a.alias("a"), b.alias("b"))
    return (part("class", o["classes"], F.col("name"), F.array_join("synonyms", ","))
            .unionByName(part("attribute", o["attributes"], F.col("class_name"), F.concat_ws("/", "name", "type")))
            .unionByName(part("relationship", o["relationships"], F.col("source_class"), F.concat_ws("/", "predicate", "target_class")))
            .unionByName(part("error", o["errors"], F.lit(""), F.lit(""))))


@query("ontology_versions_assigned", with_ctes(VERSIONS, body="""
, old as (select document_id, max(size) as m from vers where size<=20 group by 1)
select n.id, n.document_id, (coalesce(o.m,0)+row_number() over (partition by n.document_id order by n.created_at, n.id))::bigint as version
from vers n left join old o on o.document_id is not distinct from n.document_id where n.size>20"""))
def _(spark, sf):
    v = versions_table(spark, sf)
    old = v.filter("size <= 20").withColumn("version", F.col("size"))
    new = v.filter("size > 20").drop("size")
    return O.assign_versions(old, new).select("id", "document_id", F.col("version").cast("bigint").alias("version"))


@query("ontology_version_listing", with_ctes(VERSIONS, body=" select id, document_id, created_at from vers order by created_at desc, id limit 100 offset 10"))
def _(spark, sf):
    return O.list_versions(versions_table(spark, sf), limit=100, offset=10).select("id", "document_id", "created_at")


@query("ontology_version_contents", with_ctes(VERSIONS, body=" select id, 'parts' as domain, (len(cls)+1)::int as classes, array_to_string(cls,',')||',person' as names from vers"))
def _(spark, sf):
    v = versions_table(spark, sf).withColumn("content", F.from_json("ontology_json", O.ONTOLOGY_RESPONSE))
    return v.select("id", "content.domain", F.size("content.classes").alias("classes"), F.array_join(F.transform("content.classes", lambda c: c["name"]), ",").alias("names"))


@query("ontology_version_detail", with_ctes(VERSIONS, body=" select id, 'parts' as domain, unnest(list_append(cls, 'person')) as class_name from vers where id=(select min(id) from vers)"))
def _(spark, sf):
    v = versions_table(spark, sf)
    # the version that comes first by id
    one = O.get_version(v, v.agg(F.min("id")).scalar())
    return one.select("id", "content.domain", F.explode("content.classes").alias("c")).select("id", "domain", F.col("c.name").alias("class_name"))


def _classes_with_synonyms(spark):
    """Class table for alignment: seeds plus two classes with synonyms."""
    extra = spark.createDataFrame([("org", "Firm", None, "Entity", [], ["company", "business"]), ("thing", "Gadgets", None, "Entity", [], []), ("tech", "Technologie", None, "Entity", [], ["tool"])], O.CLASS_SCHEMA)
    return O.default_classes(spark).unionByName(extra)


ALIGNED = """,
cls(name) as (values ('Entity'),('Person'),('Organization'),('Location'),('Concept'),('Firm'),('Gadgets'),('Technologie')),
tys as (select distinct entity_type from all_e where entity_type<>''),
cand as (
  select entity_type, {'r':0,'d':0,'n':name,'c':1.0::double} as m from tys join cls on lower(name)=lower(entity_type)
  union all select entity_type, {'r':1,'d':0,'n':'Firm','c':0.9::double} from tys where lower(entity_type) in ('company','business')
  union all select entity_type, {'r':2,'d':levenshtein(lower(entity_type),lower(name)),'n':name,'c':round(1-levenshtein(lower(entity_type),lower(name))/greatest(length(entity_type),length(name))::double,4)}
    from tys, cls where levenshtein(lower(entity_type),lower(name))<=2),
best as (select entity_type, min(m) as m from cand group by 1)"""


@query("ontology_alignment", with_ctes(BOTH + ALIGNED, body=" select id as entity_id, m.n as ontology_class, m.c as confidence from all_e join best using (entity_type)"))
def _(spark, sf):
    return O.align_entities(both_entities(spark, sf), _classes_with_synonyms(spark))[0]


@query("ontology_alignment_unresolved", with_ctes(BOTH + ALIGNED, body=" select count(*) as unresolved from all_e where entity_type not in (select entity_type from best)"))
def _(spark, sf):
    return O.align_entities(both_entities(spark, sf), _classes_with_synonyms(spark))[1]


@query("ontology_alignment_violations", with_ctes(BOTH + ALIGNED, body="""
 select id as entity_id, name as entity_text, m.n as ontology_class, case when m is null then 'Entity has no ontology alignment' else 'Aligned class '''||m.n||''' does not exist in ontology' end as message,
 case when m is null then 'warning' else 'error' end as severity from all_e left join best using (entity_type)
 where m is null or lower(m.n) not in ('entity','person','organization','location','concept')"""))
def _(spark, sf):
    e = both_entities(spark, sf)
    aligned, _n = O.align_entities(e, _classes_with_synonyms(spark))
    # an earlier alignment to Person exists for every entity and must lose
    both = aligned.withColumn("pos", F.lit(2)).unionByName(aligned.withColumn("ontology_class", F.lit("Person")).withColumn("pos", F.lit(1)))
    return O.alignment_violations(e, both, O.default_classes(spark))


AVAILABLE = """,
avail as (select name from """ + SEEDS + """ union select name from vcls union select 'person' union (select distinct entity_type from star_e))"""


@query("ontology_available_classes", with_ctes(STAR, VERSIONS + AVAILABLE, body=" select name from avail"))
def _(spark, sf):
    return O.available_classes(O.default_classes(spark), versions_table(spark, sf), star_nodes(spark, sf))


def question_classes(spark, sf):
    """Class names for matching: the gazetteer, phrases included, and the seed classes."""
    return N.gazetteer(spark, sf).select("name").unionByName(O.default_classes(spark).select("name"))


MATCHED = """,
cnames as (select name from gaz union all select name from """ + SEEDS + """),
cterms as (select name, name as term from cnames union all select name, 'company' from cnames where lower(name)='organization' union all select name, 'organization' from cnames where lower(name)='company'),
cwords as (select name, term, unnest(ws) as w, len(ws) as need from (select *, list_distinct(regexp_extract_all(lower(term), '[\\p{L}\\p{N}]+')) as ws from cterms)),
qtok as (select question_id, unnest(list_distinct(regexp_extract_all(lower(question), '[\\p{L}\\p{N}]+'))) as w from questions),
hit as (select distinct question_id, name as class_name from (select question_id, name, term, need, count(*) as got from qtok join cwords using (w) group by all) where got=need),
matched as (select * from hit union all select question_id, name from questions, (select name from cnames order by name limit 3) where question_id not in (select question_id from hit))"""


@query("ontology_classes_of_questions", with_ctes(TEXT + MATCHED, body=" select * from matched"))
def _(spark, sf):
    return O.match_classes(N.questions(spark, sf), question_classes(spark, sf))
