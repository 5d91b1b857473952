"""Views of the business tables as documents, entities and relationships.

Each lens exists twice: as DataFrames for the operators and as SQL common table
expressions for the twin queries.
"""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom import vocab as V
from kgloom.functions.arrays import spread
from kgloom.session import next_within


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table of texts, spread over the cores for the CPU-heavy work on it."""
    return spread(table(spark, sf, name))


def _id(prefix, col):
    return F.concat(F.lit(prefix + ":"), F.col(col).cast("string"))


# -- star lens -------------------------------------------------------------

def star_entities(spark, sf):
    """Entities of the star schema: id, document_id, entity_type, name, confidence, attributes, pos."""
    def ent(tab, prefix, key, doc, typ, name, conf, attrs, rank):
        return table(spark, sf, tab).select(
            _id(prefix, key).alias("id"),
            doc.alias("document_id"),
            F.lit(typ).alias("entity_type"),
            name.alias("name"),
            conf.cast("double").alias("confidence"),
            attrs.alias("attributes"),
            (F.lit(rank).cast("bigint") * 10_000_000_000 + F.col(key).cast("bigint")).alias("pos"),
        )
    empty = F.expr("cast(map() as map<string,string>)")

    def attr(**kv):
        parts = []
        for k, c in kv.items():
            parts += [F.lit(k), F.col(c).cast("string")]
        return F.create_map(*parts)
    parts = [
        ent("region", "r", "r_regionkey", _id("r", "r_regionkey"), "Location", F.col("r_name"), F.lit(1.0), empty, 1),
        ent("nation", "n", "n_nationkey", _id("r", "n_regionkey"), "Location", F.col("n_name"), F.lit(1.0), empty, 2),
        ent("supplier", "s", "s_suppkey", _id("n", "s_nationkey"), "Company", F.col("s_name"), F.lit(0.9), empty, 3),
        ent("customer", "c", "c_custkey", _id("n", "c_nationkey"), "Company", F.col("c_name"),
            (F.col("c_custkey") % 100) / F.lit(100.0), attr(segment="c_mktsegment"), 4),
        ent("part", "p", "p_partkey", F.concat(F.lit("b:"), F.col("p_brand")), "Product", F.col("p_name"),
            F.col("p_size") / F.lit(50.0), attr(brand="p_brand", type="p_type", price="p_retailprice"), 5),
        ent("orders", "o", "o_orderkey", _id("c", "o_custkey"), "Contract",
            F.concat(F.lit("Order#"), F.col("o_orderkey").cast("string")), F.lit(0.8),
            attr(status="o_orderstatus", priority="o_orderpriority"), 6),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def star_relationships(spark, sf, names=False):
    """Relationships of the star schema; ``names=True`` attaches the end names."""
    def rel(tab, rid, src, typ, tgt, conf, doc):
        return table(spark, sf, tab).select(
            rid.alias("id"), doc.alias("document_id"),
            src.alias("source_entity_id"), tgt.alias("target_entity_id"),
            F.lit(typ).alias("relationship_type"), conf.cast("double").alias("confidence"))
    line_id = F.concat_ws("-", F.lit("l"), *[F.col(c).cast("string") for c in
                          ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    parts = [
        rel("customer", _id("lc", "c_custkey"), _id("c", "c_custkey"), "LOCATED_IN", _id("n", "c_nationkey"), F.lit(0.95), _id("n", "c_nationkey")),
        rel("supplier", _id("ls", "s_suppkey"), _id("s", "s_suppkey"), "LOCATED_IN", _id("n", "s_nationkey"), F.lit(0.95), _id("n", "s_nationkey")),
        rel("nation", _id("bn", "n_nationkey"), _id("n", "n_nationkey"), "BELONGS_TO", _id("r", "n_regionkey"), F.lit(1.0), _id("r", "n_regionkey")),
        rel("orders", _id("oo", "o_orderkey"), _id("c", "o_custkey"), "OWNS", _id("o", "o_orderkey"), F.lit(0.9), _id("c", "o_custkey")),
        rel("lineitem", line_id, _id("o", "l_orderkey"), "DEPENDS_ON", _id("p", "l_partkey"),
            F.round(F.col("l_discount") * 10, 4), _id("o", "l_orderkey")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


STAR = """
star_e as (
  select 'r:'||r_regionkey as id, 'r:'||r_regionkey as document_id, 'Location' as entity_type, r_name as name,
         1.0::double as confidence, 10000000000+r_regionkey::bigint as pos from region
  union all select 'n:'||n_nationkey, 'r:'||n_regionkey, 'Location', n_name, 1.0::double, 20000000000+n_nationkey::bigint from nation
  union all select 's:'||s_suppkey, 'n:'||s_nationkey, 'Company', s_name, 0.9::double, 30000000000+s_suppkey from supplier
  union all select 'c:'||c_custkey, 'n:'||c_nationkey, 'Company', c_name, (c_custkey%100)/100.0::double, 40000000000+c_custkey from customer
  union all select 'p:'||p_partkey, 'b:'||p_brand, 'Product', p_name, p_size/50.0::double, 50000000000+p_partkey from part
  union all select 'o:'||o_orderkey, 'c:'||o_custkey, 'Contract', 'Order#'||o_orderkey, 0.8::double, 60000000000+o_orderkey from orders
),
star_r as (
  select 'lc:'||c_custkey as id, 'n:'||c_nationkey as document_id, 'c:'||c_custkey as src, 'n:'||c_nationkey as tgt,
         'LOCATED_IN' as type, 0.95::double as confidence from customer
  union all select 'ls:'||s_suppkey, 'n:'||s_nationkey, 's:'||s_suppkey, 'n:'||s_nationkey, 'LOCATED_IN', 0.95::double from supplier
  union all select 'bn:'||n_nationkey, 'r:'||n_regionkey, 'n:'||n_nationkey, 'r:'||n_regionkey, 'BELONGS_TO', 1.0::double from nation
  union all select 'oo:'||o_orderkey, 'c:'||o_custkey, 'c:'||o_custkey, 'o:'||o_orderkey, 'OWNS', 0.9::double from orders
  union all select 'l-'||l_orderkey||'-'||l_linenumber||'-'||l_partkey||'-'||l_suppkey, 'o:'||l_orderkey,
         'o:'||l_orderkey, 'p:'||l_partkey, 'DEPENDS_ON', round(l_discount*10,4)::double from lineitem
)"""


# -- mention lens ----------------------------------------------------------

_MENTION_TYPES = ["Company", "company", "PERSON", "Gadget", "Technology"]


def mention_entities(spark, sf):
    """Events as entity mentions, with noisy types."""
    ev = table(spark, sf, "events")
    return ev.select(
        _id("e", "event_id").alias("id"),
        _id("u", "user_id").alias("document_id"),
        F.element_at(F.array(*[F.lit(t) for t in _MENTION_TYPES]), (F.col("event_id") % 5 + 1).cast("int")).alias("entity_type"),
        F.col("event_type").alias("name"),
        F.least(F.col("value") / 100.0, F.lit(1.0)).alias("confidence"),
        F.create_map(F.lit("props"), F.col("props")).alias("attributes"),
        F.col("event_id").alias("pos"),
    )


def mention_relationships(spark, sf):
    """An event followed by the same user's next event, whatever the day; a user's events are cut into ranges."""
    ev = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    nxt = next_within(ev, ["user_id"], ["ts", "event_id"], "event_id", "nxt")
    return (nxt.filter(F.col("event_type").isin("click", "purchase") & F.col("nxt").isNotNull())
            .select(_id("m", "event_id").alias("id"), _id("u", "user_id").alias("document_id"),
                    _id("e", "event_id").alias("source_entity_id"), _id("e", "nxt").alias("target_entity_id"),
                    F.when(F.col("event_type") == "click", "USES").otherwise("renews").alias("relationship_type"),
                    F.least(F.col("value") / 100.0, F.lit(1.0)).alias("confidence")))


MENTION = """
men_e as (
  select 'e:'||event_id as id, 'u:'||user_id as document_id,
         ['Company','company','PERSON','Gadget','Technology'][(event_id%5+1)::int] as entity_type,
         event_type as name, least(value/100.0::double, 1.0::double) as confidence, event_id as pos, props from events
),
men_r as (
  select 'm:'||event_id as id, 'u:'||user_id as document_id, 'e:'||event_id as src, 'e:'||nxt as tgt,
         case when event_type='click' then 'USES' else 'renews' end as type,
         least(value/100.0::double, 1.0::double) as confidence
  from (select *, lead(event_id) over (partition by user_id order by ts, event_id) as nxt from events)
  where event_type in ('click','purchase') and nxt is not null
)"""


# -- text lens -------------------------------------------------------------

def text_documents(spark, sf):
    """documents as ingested rows: id, filename, raw_text, language, mime_type."""
    d = texts(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("id"),
                    F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
                    F.col("text").alias("raw_text"), F.col("lang").alias("language"),
                    F.lit("text/plain").alias("mime_type"))


def _benchmark_words(spark, sf, low, high):
    b = table(spark, sf, "benchmark")
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    return (b.select(words.alias("word")).filter(F.length("word").between(low, high)).distinct()
            .withColumn("h", F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("bigint")))


def _benchmark_phrases(spark, sf):
    """Two and three words that follow each other in a benchmark passage, some of them, picked by hash."""
    w = table(spark, sf, "benchmark").select(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("w"))

    def runs(n):
        starts = F.sequence(F.lit(1), F.size("w") - (n - 1))
        return w.filter(F.size("w") >= n).select(F.lit(n).alias("n"), F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, n), " "))).alias("word"))
    rows = runs(2).unionByName(runs(3)).distinct().withColumn("h", F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("bigint"))
    return rows.filter(F.col("h") % 9 == F.col("n") - 2).select("word", "h")


def gazetteer(spark, sf):
    """Known names: the longer words of the benchmark passages and some phrases of two and three words, typed by hash."""
    types = F.array(*[F.lit(t) for t in V.ENTITY_TYPES])
    return _benchmark_words(spark, sf, 6, 1000).unionByName(_benchmark_phrases(spark, sf)).select(
        F.col("word").alias("name"), F.element_at(types, (F.col("h") % 8 + 1).cast("int")).alias("entity_type"),
        (F.lit(0.5) + (F.col("h") % 50) / F.lit(100.0)).alias("confidence"))


def cue_words(spark, sf):
    """Cue table: the five-letter benchmark words, relation and end types by hash."""
    types = F.array(*[F.lit(t) for t in V.ENTITY_TYPES])
    rels = F.array(*[F.lit(t) for t in V.RELATIONSHIP_TYPES])
    return _benchmark_words(spark, sf, 5, 5).select(
        F.col("word").alias("cue"),
        F.element_at(rels, (F.col("h") % 10 + 1).cast("int")).alias("relationship_type"),
        F.element_at(types, (F.floor(F.col("h") / 10) % 8 + 1).cast("int")).alias("source_type"),
        F.element_at(types, (F.floor(F.col("h") / 80) % 8 + 1).cast("int")).alias("target_type"),
        (F.lit(0.4) + (F.col("h") % 60) / F.lit(100.0)).alias("confidence"))


def questions(spark, sf):
    """User turns of the conversations as questions."""
    c = table(spark, sf, "conversations")
    return c.filter("role = 'user'").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("question_id"),
        F.col("text").alias("question"))


SPACES = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_strip(c):
    return f"regexp_replace({c}, '^{SPACES}+|{SPACES}+$', '', 'g')"


def sql_words(c):
    return f"list_filter(regexp_split_to_array({c}, '{SPACES}+'), lambda w: w <> '')"


TEXT = """
docs as (select doc_id as id, 'doc_'||doc_id||'.txt' as filename, text as raw_text, lang as language from documents),
bench_words as (
  select word, ('0x'||substr(md5(word),1,8))::bigint as h
  from (select distinct unnest(regexp_extract_all(lower(text), '[a-z]+')) as word from benchmark)
),
bench_phrases as (
  select word, n, ('0x'||substr(md5(word),1,8))::bigint as h from (
    select distinct array_to_string(w[i:i+n-1], ' ') as word, n
    from (select regexp_extract_all(lower(text), '[a-z]+') as w from benchmark), (values (2), (3)) v(n), unnest(range(1, len(w)-n+2)) as u(i))
),
gaz as (
  select word as name,
         ['Company','Person','Product','Contract','Location','Technology','Policy','Regulation'][(h%8+1)::int] as entity_type,
         0.5::double + (h%50)/100.0::double as confidence
  from (select word, h from bench_words where length(word)>=6 union all select word, h from bench_phrases where h%9=n-2)
),
cues as (
  select word as cue,
         ['WORKS_FOR','OWNS','USES','BELONGS_TO','RENEWS','EXPIRES_ON','LOCATED_IN','DEPENDS_ON','SELLS_TO','GOVERNED_BY'][(h%10+1)::int] as relationship_type,
         ['Company','Person','Product','Contract','Location','Technology','Policy','Regulation'][((h//10)%8+1)::int] as source_type,
         ['Company','Person','Product','Contract','Location','Technology','Policy','Regulation'][((h//80)%8+1)::int] as target_type,
         0.4::double + (h%60)/100.0::double as confidence
  from bench_words where length(word)=5
),
questions as (
  select conv_id||'-'||turn as question_id, text as question from conversations where role='user'
)"""


def with_ctes(*ctes, body):
    """One SQL statement from shared CTE groups and a body (which may add CTEs after a leading comma)."""
    head = "with recursive " + ",".join(c.strip() for c in ctes)
    return head + body
