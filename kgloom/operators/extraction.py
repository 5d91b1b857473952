"""Entity and relationship tables: from response tables, or by deterministic extraction.

entities: id, document_id, chunk_index, entity_type, name, confidence, evidence_chunk, attributes, pos
relations: id, document_id, chunk_index, source_entity_id, target_entity_id, relationship_type, confidence, evidence_text
"""
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom import vocab as V
from kgloom.functions import text as T
from kgloom.functions.arrays import bound_rows, explode_rows
from kgloom.session import BROADCAST_ROWS, broadcast_if_small, cut_lineage, page, stable_id


def parse_responses(df: DataFrame, schema: str, col: str = "response") -> tuple[DataFrame, DataFrame]:
    """(parsed, malformed): fenced JSON answers read with ``schema`` into ``parsed``.

    A response that is no JSON of the wanted shape becomes a row of the second
    table instead of failing the job.
    """
    body = T.strip_json_fences(col)
    full = schema[:-1] + (", " if not schema.endswith("<>") else "") + "_corrupt: string>"
    # bound, as the filters would read the answer again
    rows = bound_rows(df, [c for c in df.columns if c != "parsed"], body,
                      lambda b: F.from_json(b, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}), name="parsed")
    broken = F.col("parsed").isNull() | F.col("parsed._corrupt").isNotNull()
    return rows.filter(~broken), rows.filter(broken)


def _confidence(raw) -> Column:
    """Numeric confidence clamped to [0, 1]; missing or non-numeric gives the default."""
    num = raw.try_cast("double")
    return F.when(num.isNull(), F.lit(V.DEFAULT_CONFIDENCE)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), num)))


ENTITY_RESPONSE = "struct<entities: array<struct<name: string, type: string, attributes: string, evidence: string, confidence: string>>>"
RELATION_RESPONSE = "struct<relations: array<struct<source: string, type: string, target: string, evidence: string, confidence: string>>>"


def entities_from_responses(resp: DataFrame) -> DataFrame:
    """Entity rows from (document_id, chunk_index, response).

    Types must match the vocabulary exactly; blank names are dropped; duplicates
    are kept, as extraction does not merge them.
    """
    ok, _ = parse_responses(resp, ENTITY_RESPONSE)
    items = explode_rows(ok, ["document_id", "chunk_index"], "parsed.entities", "e", "item")
    evidence = T.strip(F.coalesce("e.evidence", F.lit("")))
    # what is no object would be read as a failure, which is slow
    is_object = F.startswith(F.ltrim("e.attributes", F.lit(" \t\r\n")), F.lit("{"))
    given = F.coalesce(F.when(is_object, F.from_json("e.attributes", "map<string,string>")), F.expr("cast(map() as map<string,string>)"))
    attrs = F.map_concat(F.map_filter(given, lambda k, v: k != "_evidence"), F.create_map(F.lit("_evidence"), evidence))
    rows = items.select(
        stable_id("document_id", "chunk_index", "item").alias("id"), "document_id", "chunk_index",
        T.strip("e.type").alias("entity_type"), T.strip("e.name").alias("name"), _confidence(F.col("e.confidence")).alias("confidence"),
        evidence.alias("evidence_chunk"), attrs.alias("attributes"), place("chunk_index", "item").alias("pos"))
    return rows.filter(F.col("entity_type").isin(V.ENTITY_TYPES) & (F.col("name") != ""))


def _tokens(col) -> Column:
    return F.regexp_extract_all(F.lower(col), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _token_table(chunks: DataFrame) -> DataFrame:
    """Chunks as token arrays ``t`` with a number ``row`` of their own, so that lookups come back to the very row, whatever its keys."""
    return chunks.select(F.monotonically_increasing_id().alias("row"), "document_id", "chunk_index", _tokens("text").alias("t"))


def _around() -> Column:
    """The name at ``word_pos`` with five words on both sides."""
    return F.array_join(F.slice("t", F.greatest(F.col("word_pos") - 5, F.lit(1)), F.least(F.col("word_pos") - 1, F.lit(5)) + F.col("words") + 5), " ")


def _occurrences(table: DataFrame, names: DataFrame, name_col: str, keys: list = (), evidence: bool = False, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Every place where the tokens of a name follow each other in a chunk: row, document_id, chunk_index, word_pos (from 1), words and the columns of ``names``.

    A name of any length is looked up by one of its tokens; a name of several tokens is
    then compared with the chunk at that place. ``keys`` are columns of a chunk that have
    to be equal to those of the name, NULL matching NULL. Up to ``limit`` names are sent
    to the chunks, each by the token that fewest names have, so chunks are read once and
    not moved. Of more names the token is taken that is rarest in the corpus, those with
    an absent token are left out, and the rest meets the tokens by a shuffle.
    """
    names = cut_lineage(names.withColumns({"_nt": _tokens(name_col), "_nid": F.monotonically_increasing_id()}).filter(F.size("_nt") > 0))
    parts = names.select("_nid", F.posexplode("_nt").alias("_off", "_token"))
    few = names.limit(limit + 1).count() <= limit
    if few:
        counts = parts.groupBy("_token").agg(F.count(F.lit(1)).alias("_n"))
    else:
        table = cut_lineage(table)
        words = broadcast_if_small(cut_lineage(parts.select("_token").distinct()))
        counts = explode_rows(table, [], "t", "_token").join(words, "_token", "left_semi").groupBy("_token").agg(F.count(F.lit(1)).alias("_n"))
    known = parts.join(counts, "_token", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    # of tokens that are as rare, the longest
    rarest = known.groupBy("_nid").agg(F.min_by(F.struct("_token", "_off"), F.struct("_n", -F.length("_token"), "_off")).alias("_a"), F.min("_n").alias("_least")).filter("_least > 0")
    anchors = cut_lineage(names.join(rarest, "_nid").withColumn("words", F.size("_nt")).select("words", "_nt", "_a.*", *[F.col(k).alias(f"_k_{k}") for k in keys], *[
        c for c in names.columns if c not in ("_nt", "_nid", *keys)]))
    few = few or anchors.limit(limit + 1).count() <= limit
    # the tokens of a chunk go along only as long as nothing is shuffled
    flat = explode_rows(table, ["row", "document_id", "chunk_index", *(["t"] if few else [])], "t", "_token", "_p")
    if few:
        # tokens meet by a number, which is the faster lookup; the tokens themselves are compared below
        flat, anchors = (df.withColumn("_token", F.xxhash64("_token")) for df in (flat, anchors))
    else:
        flat = flat.join(broadcast_if_small(cut_lineage(anchors.select("_token").distinct())), "_token", "left_semi")
    same = F.col("flat._token") == F.col("anchors._token")
    for k in keys:
        same = same & F.col(f"flat.{k}").eqNullSafe(F.col(f"anchors._k_{k}"))
    hits = flat.alias("flat").join((F.broadcast(anchors) if few else anchors).alias("anchors"), same).withColumn("word_pos", F.col("_p") - F.col("_off") + 1).drop(
        "_token", "_p", "_off", *[f"_k_{k}" for k in keys])
    whole = (F.col("word_pos") > 0) & (F.slice("t", F.greatest("word_pos", F.lit(1)), F.col("words")) == F.col("_nt"))
    if few:
        found = hits.filter(whole)
    elif evidence:
        found = hits.join(table.select("row", "t"), "row").filter(whole)
    else:
        several = hits.filter("words > 1").join(table.select("row", "t"), "row").filter(whole)
        found = hits.filter("words = 1").withColumn("t", F.array().cast("array<string>")).unionByName(several)
    return (found.withColumn("evidence", _around()) if evidence else found).drop("t", "_nt")


# fixed rules beside the gazetteer: (pattern, entity type, confidence, text every match holds)
DEFAULT_PATTERNS = [(V.EMAIL_PATTERN, "Person", 0.6, "@"), (V.URL_PATTERN, "Technology", 0.6, "://")]
# words and items of a chunk are counted in 32 bits, so this many keep chunks apart
CHUNK_SPAN = 1 << 32
# pattern matches come after all words of their chunk
AFTER_WORDS = 1 << 31


def place(chunk_index, at) -> Column:
    """Number that orders places by chunk, then by position in the chunk."""
    return (F.col(chunk_index).cast("bigint") * CHUNK_SPAN + (F.col(at) if isinstance(at, str) else at)).cast("bigint")


def mentions(chunks: DataFrame, gazetteer: DataFrame, evidence: bool = True) -> DataFrame:
    """Every occurrence of a gazetteer name: document_id, chunk_index, word_pos, name, entity_type, confidence.

    Names of any number of words are found; punctuation between words does not
    count. ``evidence`` adds the five words on both sides.
    """
    return _occurrences(_token_table(chunks), gazetteer.select("name", "entity_type", "confidence"), "name", evidence=evidence).drop("row", "words")


ENTITY_KEYS = ["document_id", "chunk_index", "name", "entity_type"]


def entity_id() -> Column:
    """Id of a row of ``found_entities``."""
    return stable_id(*ENTITY_KEYS)


def entity_rows(found: DataFrame) -> DataFrame:
    """Entities from ``found_entities``: ids, attributes and places follow from its columns, so what is stored can do without them."""
    return found.select(
        entity_id().alias("id"), "document_id", "chunk_index", "entity_type", "name", "confidence", F.col("evidence").alias("evidence_chunk"),
        F.create_map(F.lit("_evidence"), F.col("evidence")).alias("attributes"), place("chunk_index", "word_pos").alias("pos"))


def extract_entities(chunks: DataFrame, gazetteer: DataFrame, patterns=None) -> DataFrame:
    """Entities named in chunks: one row per (chunk, name), placed at its first occurrence; see ``found_entities``."""
    return entity_rows(found_entities(chunks, gazetteer, patterns))


def found_entities(chunks: DataFrame, gazetteer: DataFrame, patterns=None) -> DataFrame:
    """document_id, chunk_index, name, entity_type, word_pos, evidence, confidence of every (chunk, name).

    ``gazetteer``: name, entity_type, confidence. ``patterns``: (regex, type,
    confidence, needle) rules whose matches become names themselves; a chunk
    without the needle is not searched. ``chunks`` are read twice, for names and for
    rules, so pass a stored table where they are costly to make.
    """
    keys = ENTITY_KEYS
    # rows with the same names fold map-side, so a frequent name does not pile up
    first = mentions(chunks, gazetteer).groupBy(*keys).agg(F.min(F.struct("word_pos", "evidence")).alias("at"), F.max("confidence").alias("confidence"))
    out = first.select(*keys, F.col("at.word_pos").cast("bigint").alias("word_pos"), "at.evidence", "confidence")
    rules = DEFAULT_PATTERNS if patterns is None else patterns
    if rules:
        # one pass for all rules; chunks without any needle are left out first
        def matches(rx, typ, conf, needle):
            names = F.when(F.contains("text", F.lit(needle)), F.regexp_extract_all("text", F.lit(rx), F.lit(0)))
            return F.coalesce(F.transform(names, lambda n, i: F.struct(n.alias("name"), F.lit(typ).alias("entity_type"), i.cast("bigint").alias("i"), F.lit(float(conf)).alias("confidence"))),
                              F.expr("cast(array() as array<struct<name:string,entity_type:string,i:bigint,confidence:double>>)"))
        asked = chunks.filter(reduce(lambda a, b: a | b, [F.contains("text", F.lit(needle)) for *_, needle in rules]))
        found = (explode_rows(asked, ["document_id", "chunk_index"], F.concat(*[matches(*rule) for rule in rules]), "m")
                 .groupBy(*keys[:2], F.col("m.name").alias("name"), F.col("m.entity_type").alias("entity_type"), F.col("m.confidence").alias("confidence"))
                 .agg((F.min("m.i") + AFTER_WORDS).alias("word_pos")))
        out = out.unionByName(found.withColumn("evidence", F.col("name")))
    return out.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))))


def name_map(entities: DataFrame, fields: tuple = ("name", "entity_type")) -> DataFrame:
    """document_id, key (lower-case name) -> entity with id and ``fields``; the last entity of a name wins."""
    last = entities.groupBy("document_id", F.lower("name").alias("key")).agg(F.max(F.struct("pos", "id", *fields)).alias("e"))
    return last.select("document_id", "key", F.struct("e.id", *[f"e.{f}" for f in fields]).alias("entity"))


def _grams(col: str, n: int) -> Column:
    """The distinct substrings of length ``n``; none of a shorter text."""
    return F.when(F.length(col) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(col) - (n - 1)), lambda i: F.substring(col, i, n))))


def _words_containing(words: DataFrame, parts: DataFrame, q: int) -> DataFrame:
    """(word, part) for every distinct word that contains the part. Exact, by equi joins on substrings.

    A part is looked up by the substring of length q that fewest words have, and not at
    all if one of its substrings is in no word; a part shorter than q by its whole text.
    """
    found = None
    for n in range(1, q + 1):
        own = parts.filter(F.length("part") >= q if n == q else F.length("part") == n)
        asked = cut_lineage(explode_rows(own, ["part"], _grams("part", n), "gram"))
        if asked.isEmpty():
            continue
        held = cut_lineage(explode_rows(words, ["word"], _grams("word", n), "gram").join(broadcast_if_small(cut_lineage(asked.select("gram").distinct())), "gram", "left_semi"))
        counts = held.groupBy("gram").agg(F.count(F.lit(1)).alias("_n"))
        rarest = (asked.join(counts, "gram", "left").groupBy("part").agg(F.min_by("gram", F.struct(F.coalesce("_n", F.lit(0)), "gram")).alias("gram"), F.min(F.coalesce("_n", F.lit(0))).alias("_least"))
                  .filter("_least > 0").drop("_least"))
        met = held.join(broadcast_if_small(cut_lineage(rarest)), "gram").filter(F.contains("word", F.col("part"))).select("word", "part")
        found = met if found is None else found.unionByName(met)
    return words.select("word", F.col("word").alias("part")).limit(0) if found is None else found


# chunks times names of a document up to which they are compared one by one
DOCUMENT_PAIRS = 1 << 18


def visible_entities(chunks: DataFrame, entities: DataFrame, q: int = 4, min_visible: int = 2, pairs: int = DOCUMENT_PAIRS) -> DataFrame:
    """Names that occur as a substring of a chunk: document_id, chunk_index, entity_id, name, entity_type, chunk_names.

    Chunks with fewer than ``min_visible`` names are left out. A chunk meets the list
    of its document's names in one row, as long as the document has at most ``pairs``
    chunks times names. In larger documents, NULL among them, chunks meet names by their
    words. NULL documents are equal to each other; repeated keys neither lose nor
    multiply rows.
    """
    names = cut_lineage(name_map(entities).filter("key <> ''").select(F.col("document_id").alias("_doc"), "key", "entity"))
    low = cut_lineage(chunks.select(F.monotonically_increasing_id().alias("row"), "document_id", "chunk_index", F.lower("text").alias("_text")))
    n_chunks, n_names = (df.groupBy(F.col(c).alias(f"_{n}")).agg(F.count(F.lit(1)).alias(n)) for df, c, n in ((low, "document_id", "chunks"), (names, "_doc", "names")))
    large = cut_lineage(n_chunks.join(n_names, F.col("_chunks").eqNullSafe(F.col("_names"))).filter(F.col("chunks") * F.col("names") > pairs).select(F.col("_chunks").alias("_large")))
    if large.isEmpty():
        return _visible_in_rows(low, names, min_visible)
    large = broadcast_if_small(large)

    def part(df, c, how):
        return df.join(large, F.col(c).eqNullSafe(F.col("_large")), how)
    return _visible_in_rows(part(low, "document_id", "left_anti"), part(names, "_doc", "left_anti"), min_visible).unionByName(
        _visible_by_words(part(low, "document_id", "left_semi"), part(names, "_doc", "left_semi"), q, min_visible))


_VISIBLE = ("document_id", "chunk_index", "entity.id as entity_id", "entity.name as name", "entity.entity_type as entity_type", "chunk_names")


def _visible_in_rows(low: DataFrame, names: DataFrame, min_visible: int) -> DataFrame:
    """Chunks with the names of their document in one row."""
    own = names.groupBy("_doc").agg(F.collect_list(F.struct("key", "entity")).alias("_own")).filter(F.size("_own") >= min_visible)
    met = low.join(own, F.col("document_id").eqNullSafe(F.col("_doc")))
    # names that are words of the chunk are found at once, the others are searched in its text
    met = bound_rows(met, ["document_id", "chunk_index", "_text", "_own"], F.array_intersect(F.transform("_own", lambda n: n.key), F.split("_text", " ")), name="_words")
    seen = bound_rows(met, ["document_id", "chunk_index"], F.filter("_own", lambda n: F.array_contains("_words", n.key) | F.contains("_text", n.key)), name="_seen")
    seen = explode_rows(seen, ["document_id", "chunk_index", F.size("_seen").cast("bigint").alias("chunk_names")], "_seen", "n")
    return seen.filter(F.col("chunk_names") >= min_visible).withColumn("entity", F.col("n.entity")).selectExpr(*_VISIBLE)


def _visible_by_words(low: DataFrame, names: DataFrame, q: int, min_visible: int) -> DataFrame:
    """Where a name occurs, some word of the chunk contains the name's longest word.

    Which words contain which longest words is worked out once on the distinct words;
    chunks then meet their document's names by equi joins on words, never one by one,
    and names of several words are verified against the text.
    """
    longest = F.expr("reduce(split(key, ' '), '', (a, w) -> if(length(w) > length(a), w, a))")
    names, low = cut_lineage(names.withColumn("part", longest)), cut_lineage(low)
    words = explode_rows(low, ["row", "document_id"], F.array_distinct(F.split("_text", " ")), "word").filter("word <> ''")
    known = cut_lineage(_words_containing(words.select("word").distinct(), names.select("part").distinct(), q))
    met = cut_lineage(words.join(broadcast_if_small(known), "word").select("row", "document_id", "part").distinct())
    cand = cut_lineage(met.join(names, met["document_id"].eqNullSafe(names["_doc"]) & (met["part"] == names["part"])).select("row", "key", "entity"))
    single = F.instr("key", " ") == 0
    verified = cand.filter(~single).join(low.select("row", "_text"), "row").filter(F.contains("_text", F.col("key")))
    seen = cand.filter(single).drop("key").unionByName(verified.select("row", "entity"))
    enough = seen.groupBy("row").agg(F.count(F.lit(1)).alias("chunk_names")).filter(F.col("chunk_names") >= min_visible)
    return seen.join(enough, "row").join(low.drop("_text"), "row").selectExpr(*_VISIBLE)


def relations_from_responses(resp: DataFrame, entities: DataFrame) -> DataFrame:
    """Relation rows from (document_id, chunk_index, response); ends resolved by name within the document."""
    ok, _ = parse_responses(resp, RELATION_RESPONSE)
    items = explode_rows(ok, ["document_id", "chunk_index"], "parsed.relations", "r", "item")
    rows = items.select(
        "document_id", "chunk_index", "item", F.upper(T.strip("r.type")).alias("relationship_type"),
        F.lower(T.strip("r.source")).alias("src_key"), F.lower(T.strip("r.target")).alias("tgt_key"),
        T.strip(F.coalesce("r.evidence", F.lit(""))).alias("evidence_text"),
        _confidence(F.col("r.confidence")).alias("confidence")).filter(F.col("relationship_type").isin(V.RELATIONSHIP_TYPES))
    m = name_map(entities, ()).select("document_id", "key", F.col("entity.id").alias("eid"))
    rows = (rows.join(m.select("document_id", F.col("key").alias("src_key"), F.col("eid").alias("source_entity_id")), ["document_id", "src_key"])
            .join(m.select("document_id", F.col("key").alias("tgt_key"), F.col("eid").alias("target_entity_id")), ["document_id", "tgt_key"]))
    return rows.select(
        stable_id("document_id", "chunk_index", "item").alias("id"), "document_id", "chunk_index", "source_entity_id", "target_entity_id",
        "relationship_type", "confidence", "evidence_text", place("chunk_index", "item").alias("seq"))


def extract_relations(chunks: DataFrame, entities: DataFrame, cues: DataFrame, dedup: bool = True, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Relations stated by cue words inside a chunk.

    ``cues``: cue, relationship_type, source_type, target_type, confidence. A cue
    relates the nearest entity of its source type before it to the nearest of its
    target type after it. Entities are those of the document whose name, of any
    number of words, stands in the chunk; chunks with fewer than two are skipped.
    Work per chunk is bounded by the chunk window, and no entity pairs are formed. Up to
    ``limit`` distinct names and cues are looked up in one pass over the chunks, whatever
    the document; places then meet the names of their own document.
    """
    names = name_map(entities, ("entity_type",))
    cue_rows = cues.select("cue", F.struct("cue", "relationship_type", "source_type", "target_type", "confidence").alias("c"))
    names, keys = cut_lineage(names), ["row", "document_id", "chunk_index"]
    asked = cut_lineage(names.select(F.col("key").alias("name")).unionByName(cues.select(F.col("cue").alias("name"))).distinct().withColumn("_id", F.monotonically_increasing_id()))
    if asked.limit(limit + 1).count() <= limit:
        places = cut_lineage(_occurrences(_token_table(chunks), asked, "name").select(*keys, "word_pos", "_id"))
        known, sent = names.withColumnRenamed("document_id", "_doc"), F.broadcast(asked)
        known = known.join(sent, F.col("key") == F.col("name")).select("_doc", F.col("_id").alias("_n"), "entity")
        spots = places.join(known, places["document_id"].eqNullSafe(known["_doc"]) & (places["_id"] == known["_n"]))
        marks = places.join(F.broadcast(cue_rows.join(sent, F.col("cue") == F.col("name")).select("_id", "c")), "_id")
    else:
        table = cut_lineage(_token_table(chunks))
        spots, marks = _occurrences(table, names, "key", ["document_id"]), _occurrences(table, cue_rows, "cue")
    spots = spots.select(*keys, F.struct("word_pos", F.col("entity.entity_type").alias("t"), F.col("entity.id").alias("eid")).alias("spot"))
    marks = marks.select(*keys, F.struct("word_pos", "c.*").alias("mark"))
    # the window of a chunk bounds what is collected for it
    per_chunk = spots.unionByName(marks, allowMissingColumns=True).groupBy(*keys).agg(F.collect_set("spot").alias("spots"), F.collect_set("mark").alias("marks"))
    per_chunk = per_chunk.filter((F.size("marks") > 0) & (F.size(F.array_distinct(F.transform("spots", lambda s: s.eid))) >= 2))
    marks = explode_rows(per_chunk, ["document_id", "chunk_index", "spots"], "marks", "m").select("document_id", "chunk_index", "spots", "m.*")
    before = F.array_max(F.filter("spots", lambda s: (s.word_pos < F.col("word_pos")) & (s.t == F.col("source_type"))))
    after = F.array_min(F.filter("spots", lambda s: (s.word_pos > F.col("word_pos")) & (s.t == F.col("target_type"))))
    rows = marks.withColumn("s", before).withColumn("o", after).filter("s is not null and o is not null and s.eid <> o.eid")
    out = rows.select(
        stable_id("document_id", "chunk_index", "word_pos", "relationship_type", "source_type", "target_type").alias("id"), "document_id", "chunk_index",
        F.col("s.eid").alias("source_entity_id"), F.col("o.eid").alias("target_entity_id"), "relationship_type", "confidence",
        F.col("cue").alias("evidence_text"), place("chunk_index", "word_pos").alias("seq"))
    return dedup_relations(out) if dedup else out


def dedup_relations(rels: DataFrame, seq: str = "seq") -> DataFrame:
    """One row per (source, type, target): the highest confidence, on a tie the lowest ``seq``.

    A min-by aggregate folds map-side, so a triple stated very often is not
    gathered in one task.
    """
    best = rels.groupBy(
        F.lower("source_entity_id").alias("_s"), F.col("relationship_type").alias("_p"), F.lower("target_entity_id").alias("_o")
    ).agg(F.min_by(F.struct(*rels.columns), F.struct(-F.coalesce("confidence", F.lit(0.0)), seq)).alias("_r"))
    return best.select("_r.*")


def template_relations(entities: DataFrame) -> DataFrame:
    """Deterministic relations by entity position within a document (at least two entities).

    Only the first five entities of a document matter; the row limit is applied
    before the shuffle, so a huge document contributes five rows per task.
    """
    need = max(max(s, t) for _, s, t, _, _ in V.RELATION_TEMPLATES) + 1
    w = Window.partitionBy("document_id").orderBy("pos", "id")
    first = (entities.select("document_id", "id", "pos").withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= need))
    slots = first.groupBy("document_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("_rn") - 1, "id"))).alias("slot"))
    templates = F.array(*[F.struct(F.lit(p).alias("relationship_type"), F.lit(s).alias("s"), F.lit(t).alias("t"), F.lit(c).alias("confidence"),
                                   F.lit(e).alias("evidence_text")) for p, s, t, c, e in V.RELATION_TEMPLATES])
    rows = slots.filter(F.size("slot") >= 2).select("document_id", "slot", F.explode(templates).alias("x")).select(
        "document_id", F.try_element_at("slot", F.col("x.s")).alias("source_entity_id"),
        F.try_element_at("slot", F.col("x.t")).alias("target_entity_id"), "x.relationship_type", "x.confidence", "x.evidence_text")
    rows = rows.filter("source_entity_id is not null and target_entity_id is not null and source_entity_id <> target_entity_id")
    return rows.withColumn("id", stable_id("document_id", "relationship_type"))


# what ``relationship_rows`` adds on demand: the type of an end in a struct, NULL for an unknown end
END_TYPES = ("source_of", "target_of")


def relationship_rows(rels: DataFrame, entities: DataFrame, types: bool = False) -> DataFrame:
    """Relationships with the names of both ends (the id itself where unknown) and defaults filled; with ``types`` also ``END_TYPES``."""
    n = entities.select("id", "name", *([F.struct("entity_type").alias("of")] if types else []))
    evidence = F.coalesce("evidence_text", F.lit("")) if "evidence_text" in rels.columns else F.lit("")
    joined = (rels.join(n.withColumnsRenamed({"id": "source_entity_id", "name": "_sn", "of": "source_of"}), "source_entity_id", "left")
              .join(n.withColumnsRenamed({"id": "target_entity_id", "name": "_tn", "of": "target_of"}), "target_entity_id", "left"))
    return joined.select(
        "id", "document_id", "source_entity_id", "target_entity_id", F.coalesce("_sn", "source_entity_id").alias("source_entity_name"),
        F.coalesce("_tn", "target_entity_id").alias("target_entity_name"), "relationship_type",
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"), evidence.alias("evidence_text"), *(END_TYPES if types else []))


def merge_results(*dfs: DataFrame) -> DataFrame:
    """Results of several runs as one table."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def _bounded(limit: int, low: int, high: int) -> int:
    if not low <= limit <= high:
        raise ValueError(f"limit must be between {low} and {high}")
    return limit


def list_entities(df: DataFrame, document_id=None, entity_type=None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Newest entities first; stored evidence is lifted out of the attributes. ``page_size`` is the number of rows returned."""
    _bounded(limit, 1, 500)
    if document_id is not None:
        df = df.filter(F.col("document_id") == document_id)
    if entity_type is not None:
        df = df.filter(F.col("entity_type") == entity_type)
    rows = page(df, [F.col("created_at").desc(), "id"], limit, offset)
    attrs = F.col("attributes")
    if dict(df.dtypes)["attributes"] == "string":
        attrs = F.from_json("attributes", "map<string,string>")
    attrs = F.coalesce(attrs, F.expr("cast(map() as map<string,string>)"))
    return rows.select("id", "document_id", "entity_type", "name",
                       F.map_filter(attrs, lambda k, v: k != "_evidence").alias("attributes"),
                       F.coalesce(F.try_element_at(attrs, F.lit("_evidence")), "evidence_chunk").alias("evidence_chunk"), "confidence", "created_at")


def list_relationships(df: DataFrame, document_id=None, relationship_type=None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Newest relationships first."""
    _bounded(limit, 1, 500)
    if document_id is not None:
        df = df.filter(F.col("document_id") == document_id)
    if relationship_type is not None:
        df = df.filter(F.col("relationship_type") == relationship_type)
    return page(df, [F.col("created_at").desc(), "id"], limit, offset)


def type_counts(df: DataFrame, col: str, only=None) -> DataFrame:
    """Rows per type, optionally of some types only."""
    if only:
        df = df.filter(F.col(col).isin(*only))
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("cnt"))


def run_extractor(chunks: DataFrame, extract, schema: str) -> DataFrame:
    """Runs a plug-in over chunk batches: ``extract(pandas batches) -> pandas batches`` of ``schema``."""
    return chunks.mapInPandas(extract, schema)
