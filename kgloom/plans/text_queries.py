"""Queries over text preparation, document sources and table maintenance."""
from functools import reduce

from pyspark.sql import functions as F

from kgloom import vocab as V
from kgloom.functions import chunking as K
from kgloom.functions import language as L
from kgloom.functions import text as T
from kgloom.functions.arrays import explode_rows
from kgloom.operators import graph as G
from kgloom.plans import lenses as N
from kgloom.plans.lenses import SPACES, STAR, MENTION, TEXT, sql_strip, sql_words, with_ctes
from kgloom.plans.quality_queries import OLD_ISSUES, VERSIONS, old_issues, versions_table
from kgloom.plans.registry import query
from kgloom.sources import documents as D
from kgloom.sources import tables as S

CONTROL = r"[\x00-\x08\x0b-\x1f\x7f-\x{9f}]"


def sql_unicode(c):
    return f"regexp_replace(nfc_normalize({c}), '{CONTROL}', '', 'g')"


def sql_whitespace(c):
    return sql_strip(
        f"regexp_replace(regexp_replace(regexp_replace({c}, '\\r\\n|\\r', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10)||chr(10), 'g')")


def sql_clean(c, options=False):
    s = sql_whitespace(sql_unicode(c))
    if options:
        s = f"regexp_replace({s}, 'https?://[^{SPACES[1:-1]}]+', '', 'g')"
        s = f"regexp_replace({s}, '[\\p{{L}}\\p{{N}}_.+-]+@[\\p{{L}}\\p{{N}}_-]+\\.[a-z]{{2,}}', '', 'g')"
        s = f"lower({s})"
    s = f"regexp_replace(regexp_replace({s}, '-{{3,}}', '—', 'g'), '\\.{{3,}}', '…', 'g')"
    return sql_strip(s)


def _bodies(spark, sf):
    """Texts of documents, pages and conversations with a key."""
    d = N.texts(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("key"), F.col("text").alias("body"))
    p = N.texts(spark, sf, "pages").select(F.concat(F.lit("p"), F.col("page_id")).alias("key"), F.col("html").alias("body"))
    c = N.texts(spark, sf, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), F.col("turn")).alias("key"), F.col("text").alias("body"))
    return d.unionByName(p).unionByName(c)


BODIES = """bodies as (
  select 'd'||doc_id as key, text as body from documents
  union all select 'p'||page_id, html from pages
  union all select 'c'||conv_id||'-'||turn, text from conversations
)"""


@query("text_normalize_unicode", with_ctes(BODIES, body=f"select key, {sql_unicode('body')} as body from bodies"))
def _(spark, sf):
    return _bodies(spark, sf).select("key", T.normalize_unicode("body").alias("body"))


@query("text_normalize_whitespace", with_ctes(BODIES, body=f"select key, {sql_whitespace('body')} as body from bodies"))
def _(spark, sf):
    return _bodies(spark, sf).select("key", T.normalize_whitespace("body").alias("body"))


@query("text_clean", with_ctes(BODIES, body=f"select key, {sql_clean('body')} as plain, {sql_clean('body', True)} as stripped from bodies"))
def _(spark, sf):
    return _bodies(spark, sf).select(
        "key", T.clean_text("body").alias("plain"),
        T.clean_text("body", remove_urls=True, remove_emails=True, lowercase=True).alias("stripped"))


@query("text_token_counts", with_ctes(BODIES, body=f"""
select key, len({sql_words('body')})::int as words, floor(len({sql_words('body')})*0.75)::int as tokens,
       substr(body, 1, 200) as truncated from bodies"""))
def _(spark, sf):
    return _bodies(spark, sf).select(
        "key", T.word_count("body").alias("words"), T.count_tokens("body").alias("tokens"),
        T.truncate_to_tokens("body", 50).alias("truncated"))


def sql_sentences(c):
    cut = f"string_split(regexp_replace({c}, '([.!?]){SPACES}+', '\\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({cut}, lambda s: {sql_strip('s')}), lambda s: s <> '')"


@query("text_sentences", f"""
select id, (i-1)::int as pos, s[i] as sentence
from (select doc_id as id, {sql_sentences('text')} as s from documents), unnest(range(1, len(s)+1)) as u(i)""")
def _(spark, sf):
    return explode_rows(N.text_documents(spark, sf), ["id"], T.sentences("raw_text"), "sentence", "pos")


def sql_sliding(src, key, text, max_tokens, overlap, name="chunks"):
    """CTEs producing ``name``(document_id, chunk_index, text, token_count, start_char, end_char)."""
    per_chunk, step = K.window_sizes(max_tokens, overlap)
    return f"""
{name}_w as (select {key} as document_id, {text} as t, {sql_words(text)} as w from {src}),
{name}_b as (
  select document_id, t, i::int as chunk_index, array_to_string(w[i*{step}+1 : i*{step}+{per_chunk}], ' ') as text
  from {name}_w, unnest(range(0, ((len(w)+{step}-1)//{step}))) as u(i)
),
{name}_f as (
  select document_id, chunk_index, text, t, instr(t, text)-1 as p from {name}_b where chunk_index=0
  union all
  select b.document_id, b.chunk_index, b.text, b.t,
         case when instr(substr(b.t, greatest(f.p,0)+1), b.text) = 0 then -1
              else greatest(f.p,0) + instr(substr(b.t, greatest(f.p,0)+1), b.text) - 1 end
  from {name}_f f join {name}_b b on b.document_id=f.document_id and b.chunk_index=f.chunk_index+1
),
{name} as (
  select document_id, chunk_index, text, floor(len({sql_words('text')})*0.75)::int as token_count,
         greatest(p,0)::int as start_char, (case when p<0 then 0 else p+length(text) end)::int as end_char
  from {name}_f
)"""


@query("chunk_sliding_window", with_ctes(TEXT, sql_sliding("docs", "id", "raw_text", 1000, 100), body="select * from chunks"))
def _(spark, sf):
    return K.sliding_chunks(N.text_documents(spark, sf))


def sql_sentence_chunks(src, key, text, max_tokens):
    return f"""
sc_s as (select {key} as document_id, {text} as t, {sql_sentences(text)} as s from {src}),
sc_n as (select document_id, i, s[i] as sent, floor(len({sql_words('s[i]')})*0.75)::int as n
         from sc_s, unnest(range(1, len(s)+1)) as u(i)),
sc_g as (
  select document_id, i, n, n as running, 0 as g from sc_n where i=1
  union all
  select b.document_id, b.i, b.n, case when a.running+b.n>{max_tokens} then b.n else a.running+b.n end,
         case when a.running+b.n>{max_tokens} then a.g+1 else a.g end
  from sc_g a join sc_n b on b.document_id=a.document_id and b.i=a.i+1
),
sc_c as (
  select g.document_id, g.g::int as chunk_index, string_agg(b.sent, ' ' order by g.i) as text, sum(g.n)::int as token_count
  from sc_g g join sc_n b on b.document_id=g.document_id and b.i=g.i group by 1,2
),
sc_t as (select c.*, s.t from sc_c c join sc_s s using (document_id)),
sc_f as (
  select document_id, chunk_index, text, token_count, t, instr(t, text)-1 as p from sc_t where chunk_index=0
  union all
  select b.document_id, b.chunk_index, b.text, b.token_count, b.t,
         case when instr(substr(b.t, greatest(f.p+length(f.text),0)+1), b.text)=0 then -1
              else greatest(f.p+length(f.text),0)+instr(substr(b.t, greatest(f.p+length(f.text),0)+1), b.text)-1 end
  from sc_f f join sc_t b on b.document_id=f.document_id and b.chunk_index=f.chunk_index+1
)
select document_id, chunk_index, text, token_count, greatest(p,0)::int as start_char, greatest(p+length(text),0)::int as end_char from sc_f"""


@query("chunk_sentence_groups", with_ctes(TEXT, sql_sentence_chunks("docs", "id", "raw_text", 200), body=""))
def _(spark, sf):
    return K.sentence_chunks(N.text_documents(spark, sf), 200)


def sql_language(words):
    hits = [f"struct_pack(r := -len(list_filter({words}, lambda w: lower(w) in ({','.join(chr(39)+s+chr(39) for s in stop)}))), c := '{code}')"
            for code, stop in sorted(V.STOP_WORDS.items())]
    best = f"list_min([{','.join(hits)}])"
    return f"case when len({words})>=5 and {best}.r<0 then {best}.c end"


@query("text_language", f"select id, {sql_language('w')} as language from (select doc_id as id, {sql_words('text')} as w from documents)")
def _(spark, sf):
    return N.text_documents(spark, sf).select("id", L.detect_language("raw_text").alias("language"))


@query("text_preprocess", with_ctes(
    TEXT, f"clean as (select id as document_id, {sql_clean('raw_text')} as clean from docs)",
    sql_sliding("clean", "document_id", "clean", 1000, 100),
    body=f"""
select c.document_id, {sql_language(sql_words('c.clean'))} as language, len({sql_words('c.clean')})::int as word_count,
       coalesce(k.chunks, 0)::bigint as chunks, coalesce(k.tokens, 0)::bigint as tokens
from clean c left join (select document_id, count(*) as chunks, sum(token_count) as tokens from chunks group by 1) k using (document_id)"""))
def _(spark, sf):
    docs, chunks = L.preprocess(N.text_documents(spark, sf))
    per_doc = chunks.groupBy("document_id").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"))
    return docs.join(per_doc, "document_id", "left").select(
        "document_id", "language", "word_count", F.coalesce("chunks", F.lit(0).cast("bigint")).alias("chunks"),
        F.coalesce("tokens", F.lit(0).cast("bigint")).alias("tokens"))


@query("text_strip_fences", """
with r as (
  select doc_id as id, case doc_id%3 when 0 then '```json'||chr(10)||text||chr(10)||'```' when 1 then '```'||chr(10)||text||chr(10)||'```  ' else '  '||text end as body
  from documents)
select id, """ + f"""case when regexp_matches({sql_strip('body')}, '(?s)^```[a-zA-Z]*\\n?(.*?)\\n?```$')
  then {sql_strip("regexp_extract(" + sql_strip('body') + ", '(?s)^```[a-zA-Z]*\\n?(.*?)\\n?```$', 1)")} else {sql_strip('body')} end as any_tag,
  {sql_strip(f"regexp_replace(regexp_replace({sql_strip('body')}, '^```(?:json)?{SPACES}*', ''), '{SPACES}*```$', '')")} as json_tag from r""")
def _(spark, sf):
    d = N.text_documents(spark, sf)
    k = F.col("id") % 3
    body = (F.when(k == 0, F.concat(F.lit("```json\n"), "raw_text", F.lit("\n```")))
            .when(k == 1, F.concat(F.lit("```\n"), "raw_text", F.lit("\n```  "))).otherwise(F.concat(F.lit("  "), "raw_text")))
    return d.select("id", T.strip_fences(body).alias("any_tag"), T.strip_json_fences(body).alias("json_tag"))


@query("text_to_json", "select doc_id as id, to_json({'id': doc_id, 'language': case when doc_id%7=3 then null else lang end, 'source': source, 'words': len(" + sql_words("text") + ")})::varchar as body from documents")
def _(spark, sf):
    d = N.texts(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("id"), T.to_json_text(F.struct(
        F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 7 != 3, F.col("lang")).alias("language"), "source", T.word_count("text").alias("words"))).alias("body"))


# -- sources ---------------------------------------------------------------

@query("ingest_raw_text", f"""
select sha256(conv_id||'|'||turn) as id, case when role='user' then 'raw_text' else role end as filename, 'text/plain' as mime_type,
       {sql_strip('text')} as raw_text, len({sql_words('text')})::int as word_count, 'en' as language
from conversations where {sql_strip('text')}<>''""")
def _(spark, sf):
    c = N.texts(spark, sf, "conversations").withColumn("fn", F.when(F.col("role") != "user", F.col("role")))
    return D.ingest_text(c, "text", "fn", ["conv_id", "turn"])


EXTENSIONS = [".txt", ".md", ".pdf", ".docx", ".doc", ".png", ".TXT", ""]


@query("files_routed_by_mime", """
with f as (select 'store/doc_'||doc_id||['.txt','.md','.pdf','.docx','.doc','.png','.TXT',''][(doc_id%8+1)::int] as path,
                  case when doc_id%11=0 then '%PDF-1.7 ' else '' end||text as content, doc_id from documents),
m as (select doc_id, path, case when content like '\\%PDF-%' escape '\\' then 'application/pdf' else
        coalesce(map {'.txt':'text/plain','.md':'text/markdown','.pdf':'application/pdf',
          '.docx':'application/vnd.openxmlformats-officedocument.wordprocessingml.document','.doc':'application/msword'}
          [lower(regexp_extract(path,'(\\.[A-Za-z0-9]+)$',1))], 'application/octet-stream') end as mime_type from f)
select doc_id, mime_type, mime_type<>'application/octet-stream' as supported from m""")
def _(spark, sf):
    d = N.texts(spark, sf, "documents")
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("doc_id") % 8 + 1).cast("int"))
    files = d.select("doc_id", F.concat(F.lit("store/doc_"), F.col("doc_id"), ext).alias("path"),
                     F.concat(F.when(F.col("doc_id") % 11 == 0, "%PDF-1.7 ").otherwise(""), "text").alias("content"))
    ok, rejected = D.route_by_mime(files)
    return (ok.withColumn("supported", F.lit(True)).unionByName(rejected.withColumn("supported", F.lit(False)))
            .select("doc_id", "mime_type", "supported"))


# fixed values: the character references that the pages hold;
# the ampersand comes last so that its own output is never unescaped again
NAMED_ENTITIES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'",
    "&nbsp;": " ", "&copy;": "©", "&reg;": "®", "&middot;": "·",
    "&mdash;": "—", "&ndash;": "–", "&hellip;": "…", "&euro;": "€",
    "&amp;": "&",
}


def sql_unescape(c):
    for ref, ch in NAMED_ENTITIES.items():
        c = f"replace({c}, '{ref}', chr({ord(ch)}))"
    return c


def sql_html(c):
    c = f"regexp_replace({c}, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->', ' ', 'g')"
    c = f"regexp_replace({c}, '(?s)<[^>]*>', ' ', 'g')"
    return sql_strip(f"regexp_replace({sql_unescape(c)}, '{SPACES}+', ' ', 'g')")


@query("pages_to_documents", f"""
select page_id as id, url, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) as host,
       {sql_html("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} as title,
       {sql_html('html')} as raw_text, len({sql_words(sql_html('html'))})::int as word_count from pages""")
def _(spark, sf):
    return D.html_to_documents(N.texts(spark, sf, "pages"))


@query("documents_exact_dedup", """
select doc_id as id, sha256(text) as sha256 from documents
where doc_id in (select min(doc_id) from documents group by sha256(text))""")
def _(spark, sf):
    return D.dedup_exact(N.text_documents(spark, sf)).select("id", "sha256")


@query("pages_safe_filenames", f"""
select page_id as id, {sql_strip("regexp_replace(url, '[^\\p{L}\\p{N}._\\- ]', '', 'g')")} as filename,
       {sql_strip("regexp_replace(html, '[^\\p{L}\\p{N}._\\- ]', '', 'g')")} as from_html from pages""")
def _(spark, sf):
    return N.texts(spark, sf, "pages").select(
        F.col("page_id").alias("id"), T.safe_filename("url").alias("filename"), T.safe_filename("html").alias("from_html"))


@query("document_listing", f"""
select doc_id as id, case when source='src0' then 'text' else 'file' end as source_type,
       case when source='src0' then 'raw_text' else source end as filename, 'text/plain' as mime_type,
       round(strlen(text)/1024.0::double,2) as size_kb, len({sql_words('text')})::int as word_count, lang as language,
       timestamp '2024-01-01' + to_seconds(doc_id) as ingested_at, 'ingested' as status from documents""")
def _(spark, sf):
    d = N.texts(spark, sf, "documents")
    docs = d.select(
        F.col("doc_id").alias("id"), F.when(F.col("source") == "src0", "raw_text").otherwise(F.col("source")).alias("filename"),
        F.lit("text/plain").alias("mime_type"), F.col("text").alias("raw_text"), T.word_count("text").alias("word_count"),
        F.col("lang").alias("language"),
        (F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(secs=F.col("doc_id"))).alias("created_at"))
    return D.list_documents(docs)


# -- table maintenance -----------------------------------------------------

@query("tables_cascade_delete", with_ctes(TEXT, MENTION, VERSIONS, sql_sliding("docs", "'u:'||id", "raw_text", 1000, 100), OLD_ISSUES.strip(",\n"), body=""",
gone as (select 'u:'||doc_id as d from labels where toxic=1 union select p_brand from part where p_brand like '%1')
select 'documents' as table_name, 'u:'||id as id, 'u:'||id as document_id from docs where 'u:'||id not in (from gone)
union all select 'chunks', document_id||'/'||chunk_index, document_id from chunks where document_id not in (from gone)
union all select 'entities', id, document_id from men_e where document_id not in (from gone)
union all select 'relationships', id, document_id from men_r where document_id not in (from gone)
union all select 'ontology_versions', id, case when document_id not in (from gone) then document_id end from vers
union all select 'runs', doc_id::varchar, case when 'u:'||doc_id not in (from gone) then 'u:'||doc_id end from labels
union all select 'issues', id, case when document_id not in (from gone) then document_id end from old"""))
def _(spark, sf):
    labels, part = N.table(spark, sf, "labels"), N.table(spark, sf, "part")
    docs = N.text_documents(spark, sf).withColumn("id", F.concat(F.lit("u:"), "id"))
    gone = labels.filter("toxic = 1").select(F.concat(F.lit("u:"), "doc_id").alias("document_id")).unionByName(
        part.filter(F.endswith("p_brand", F.lit("1"))).select(F.col("p_brand").alias("document_id")))
    out = S.cascade_delete({
        "documents": docs.withColumn("document_id", F.col("id")),
        "chunks": K.sliding_chunks(docs, offsets=False).withColumn("id", F.concat_ws("/", "document_id", F.col("chunk_index").cast("string"))),
        "entities": N.mention_entities(spark, sf), "relationships": N.mention_relationships(spark, sf),
        "ontology_versions": versions_table(spark, sf),
        "runs": labels.select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("u:"), "doc_id").alias("document_id")),
        "issues": old_issues(spark, sf)}, gone)
    parts = [df.select(F.lit(name).alias("table_name"), "id", "document_id") for name, df in out.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("tables_replace_by_document", with_ctes(TEXT, sql_sliding("docs", "id", "raw_text", 1000, 100, "ca"),
                                               sql_sliding("(select * from docs where id in (select doc_id from labels))", "id", "raw_text", 600, 50, "cb"), body="""
select document_id, chunk_index, token_count from ca where document_id not in (select document_id from cb)
union all select document_id, chunk_index, token_count from cb"""))
def _(spark, sf):
    docs = N.text_documents(spark, sf)
    again = docs.join(N.table(spark, sf, "labels").select(F.col("doc_id").alias("id")), "id", "left_semi")
    out = S.replace_by_key(K.sliding_chunks(docs, offsets=False), K.sliding_chunks(again, *V.ENTITY_WINDOW, offsets=False))
    return out.select("document_id", "chunk_index", "token_count")


@query("tables_append", with_ctes(MENTION, STAR, body="""
select id, document_id, entity_type, name, confidence from men_e union all select id, document_id, entity_type, name, confidence from star_e"""))
def _(spark, sf):
    cols = ["id", "document_id", "entity_type", "name", "confidence"]
    return S.append_rows(N.mention_entities(spark, sf).select(cols), N.star_entities(spark, sf).select(cols))


@query("tables_page", with_ctes(STAR, body="""
select id, name, confidence, (select count(*) from star_e) as total from star_e order by confidence desc, id limit 50 offset 100"""))
def _(spark, sf):
    e = N.star_entities(spark, sf).select("id", "name", "confidence")
    return S.paginate(e, [F.col("confidence").desc(), "id"], 50, 100)


@query("graph_export_ntriples", with_ctes(STAR, body="""
select '<urn:kg:node:'||url_encode(id)||'> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <urn:kg:type:'||entity_type||'> .' as value from star_e
union all
select '<urn:kg:node:'||url_encode(id)||'> <urn:kg:prop:name> "'||replace(replace(name,'\\','\\\\'),'"','\\"')||'" .' from star_e
union all
select '<urn:kg:node:'||url_encode(src)||'> <urn:kg:prop:'||type||'> <urn:kg:node:'||url_encode(tgt)||'> .' from star_r"""))
def _(spark, sf):
    return S.ntriples(G.nodes_from(N.star_entities(spark, sf)), G.edges_from(N.star_relationships(spark, sf)))


@query("graph_export_jsonld", with_ctes(STAR, body="""
select to_json({'@context': {'@vocab': 'urn:kg:prop:'}, '@id': 'urn:kg:node:'||url_encode(id), '@type': 'urn:kg:type:'||entity_type, 'name': name})::varchar as value from star_e
union all
select to_json({'@context': {'@vocab': 'urn:kg:prop:'}, '@id': 'urn:kg:node:'||url_encode(src), 'relation': {'@id': 'urn:kg:prop:'||type}, 'target': {'@id': 'urn:kg:node:'||url_encode(tgt)}})::varchar from star_r"""))
def _(spark, sf):
    return S.jsonld(G.nodes_from(N.star_entities(spark, sf)), G.edges_from(N.star_relationships(spark, sf)))
