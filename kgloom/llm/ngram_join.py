"""N-gram Jaccard join: exact near-duplicate groups of texts by sets of word shingles.

Texts of equal shingle sets form a class and are compared once. Candidates come
from token-combination prefixes: tokens are ordered rare ones first; a class is
indexed by the single rare tokens of its prefix and, where those do not suffice, by
pairs of frequent tokens that fall into one group, the prefix being extended by one
token per group. Two sets at the threshold share such a signature, whatever the
counts are; counts only decide which tokens are frequent. They come from a hashed
count table over all texts, of fixed size.

Signatures that many classes share do not make all pairs. First every class is
verified against the most typical class of the signature only (the one with the
fewest rare tokens); those links join most of a large group. Then only pairs of one
signature whose ends are still in different components can matter. Signatures are put
together by their largest component, so that classes outside it meet its classes, and
each other, once and not once per signature. Blocks of both sides meet in a task: first
with profiles of their sets (how many tokens fall into each part of the hash space),
a bound that leaves few classes, then with the whole sets of these. A task gives the
links it found, for a class one into each component; pairs are never sent on.

Words are hashed to 64 bits in numpy over whole texts, in blocks; sets are compared
by built-in functions. A signature is combined inside each task before the shuffle.

Defined cases: a null or blank text has an empty set and links with nothing; a text
with fewer words than a shingle is one shingle; rows without id are counted but not
compared and have no component; rows that repeat an id share its component; an empty
table gives no rows.
"""
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgloom.llm.common import PAIRS, cut_lineage, hand_back, slices, whole_groups, without_rows
from kgloom.llm.components import connected_components
from kgloom.session import broadcast_if_small

WORDS = 5
PERCENT = 80
# counters of the hashed count table, and the part of it that travels as one row
COUNTERS_LOG2 = 21
CHUNK_LOG2 = 16
# a token is frequent when its counter is this many standard deviations, and this many occurrences, above the mean
DEVIATIONS, LEAST_FREQUENT = 6, 24
# frequent tokens of a text of 2^k shingles fall into 2^k / GROUP_SPAN groups, whose pairs are indexed
GROUP_SPAN = 8
# bytes of a text that are hashed at once, and signatures that are combined at once
BLOCK = 1 << 20
FLUSH = 1 << 18
# classes, and tokens of their sets, per block; bytes of profiles that are compared at once
CLASSES = 512
TOKENS = 1 << 20
COMPARED = 1 << 25
REMEMBERED = 1 << 20

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit integers (finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    factors = np.full(n, 0x9E3779B97F4A7C15, dtype=np.uint64)
    factors[:1] = 1
    return np.multiply.accumulate(factors)


_POWERS = _powers(4096)


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of the lower-cased text, in order."""
    codes = np.frombuffer(text.lower(), dtype=np.uint8)
    out, at = [], 0
    while at < len(codes):
        end = min(at + BLOCK, len(codes))
        while end < len(codes) and not _BLANK[codes[end]]:  # up to the end of the word
            ahead = _BLANK[codes[end:end + BLOCK]]
            end += int(ahead.argmax()) if ahead.any() else len(ahead)
        part = codes[at:end]
        blank = _BLANK[part]
        start = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
        if len(start):
            place = np.arange(len(part)) - np.repeat(start, np.diff(np.append(start, len(part)))) if start[0] == 0 else None
            if place is None:
                part, blank, start = part[start[0]:], blank[start[0]:], start - start[0]
                place = np.arange(len(part)) - np.repeat(start, np.diff(np.append(start, len(part))))
            place[blank] = 0
            longest = int(place.max()) + 1
            powers = _POWERS if longest <= len(_POWERS) else _powers(longest)
            value = (part.astype(np.uint64) + np.uint64(1)) * powers[place]
            value[blank] = 0
            size = np.add.reduceat((~blank).astype(np.uint64), start)
            out.append(mix(np.add.reduceat(value, start) + mix(size)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def shingle_set(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text."""
    hashed = word_hashes(text or b"")
    if not len(hashed):
        return hashed
    width = min(words, len(hashed))
    total = np.full(len(hashed) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        total = (total + hashed[k:len(hashed) - width + 1 + k]) * np.uint64(0xD6E8FEB86659FD93)
        total ^= total >> np.uint64(32)
    return np.unique(mix(total))


def _digest(tokens: np.ndarray) -> int:
    """A signed 64-bit number for the whole set."""
    return int(mix(mix(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(tokens))).view(np.int64)[0])


def profile(tokens: np.ndarray) -> bytes:
    """How many tokens fall into each of 2^k equal parts of the hash space, about 4 to 8 in each."""
    parts_log2 = max(4, len(tokens).bit_length() - 3)
    counts = np.bincount((mix(~tokens) >> np.uint64(64 - parts_log2)).astype(np.int64), minlength=1 << parts_log2)
    return bytes([parts_log2]) + counts.astype(np.uint8 if counts.max() < 256 else np.uint32).tobytes()


def most_shared(a: bytes, b: bytes) -> int:
    """Tokens that two sets can share at most, by their profiles."""
    folded, least = [], min(a[0], b[0])
    for x in (a, b):
        counts = np.frombuffer(x, dtype=np.uint8 if len(x) == 1 + (1 << x[0]) else np.uint32, offset=1)
        folded.append(counts.reshape(1 << least, -1).sum(axis=1, dtype=np.int64))
    return int(np.minimum(*folded).sum())


def _counter(tokens: np.ndarray) -> np.ndarray:
    return (mix(tokens) >> np.uint64(64 - COUNTERS_LOG2)).astype(np.int64)


def signatures(tokens: np.ndarray, frequent: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Signatures of one set; any two different sets whose Jaccard similarity reaches the threshold share one."""
    n = len(tokens)
    prefix = n - -(-n * percent // 100) + 1
    if n * 100 < percent * (n + 1):  # another set of this size or more cannot be that similar
        return tokens[:0]
    often = frequent[_counter(tokens)]
    rare = tokens[~often]
    if len(rare) >= prefix:
        return rare[:prefix]
    out, missing, often = [rare], prefix - len(rare), tokens[often]
    smallest = -(-n * percent // 100)
    for level in {n.bit_length(), smallest.bit_length()}:
        groups = max(1, (1 << level) // 2 // GROUP_SPAN)
        group = (mix(often + np.uint64(level)) % np.uint64(groups)).astype(np.int64)
        # each token after the first of its group counts
        first = np.zeros(len(often), dtype=bool)
        first[np.unique(group, return_index=True)[1]] = True
        used = int(np.searchsorted(np.cumsum(~first), missing)) + 1
        part, group = often[:used], group[:used]
        order = np.argsort(group, kind="stable")
        part, group = part[order], group[order]
        size = np.bincount(group, minlength=groups)
        end = np.repeat(np.cumsum(size), size)
        after = end - np.arange(len(part)) - 1  # later tokens of the group
        left = np.repeat(np.arange(len(part)), after)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(after) - after, after)
        out.append(mix(mix(part[left] + np.uint64(level)) + part[right]))
    return np.unique(np.concatenate(out))


SETS = "doc_id long, n int, cls long, profile binary, chunk int, counts binary"


def _texts(batch: pa.RecordBatch) -> list:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield from slices(batch, "text")
    hand_back()


def _summarize(words: int):
    """Size and digest of every set; at the end the task's hashed counts, each set counted once while it is remembered."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = np.zeros(1 << COUNTERS_LOG2, dtype=np.uint32), set()
        names = [c.split()[0] for c in SETS.split(", ")]
        for batch in _sliced(batches):
            sizes, digests, profiles = [], [], []
            for text in _texts(batch):
                tokens = shingle_set(text, words)
                digest = _digest(tokens) if len(tokens) else None
                sizes.append(len(tokens))
                digests.append(digest)
                profiles.append(profile(tokens) if len(tokens) else None)
                if digest is not None and digest not in known:
                    np.add.at(table, _counter(tokens), 1)
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known.add(digest)
            rows = len(sizes)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int32()), pa.array(digests, pa.int64()),
                                              pa.array(profiles, pa.binary()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names=names)
        if known:
            parts = table.reshape(-1, 1 << CHUNK_LOG2)
            packed = [zlib.compress(p.tobytes(), 1) for p in parts]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(parts), pa.int64()), pa.nulls(len(parts), pa.int32()), pa.nulls(len(parts), pa.int64()),
                                              pa.nulls(len(parts), pa.binary()), pa.array(range(len(parts)), pa.int32()), pa.array(packed, pa.binary())], names=names)
    return run


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the count tables of all tasks, one row per chunk, holding one table per chunk."""
    totals: dict = {}
    for batch in batches:
        for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
            part = np.frombuffer(zlib.decompress(counts), dtype=np.uint32)
            totals[chunk] = totals.get(chunk, 0) + part.astype(np.uint64)
    yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([t.tobytes() for t in totals.values()], pa.binary())], names=["chunk", "counts"])


def _frequent_tokens(summaries: DataFrame) -> np.ndarray:
    """Which counters belong to frequent tokens: a table of fixed size, whatever the corpus."""
    chunks = 1 << (COUNTERS_LOG2 - CHUNK_LOG2)
    rows = summaries.filter("chunk is not null").select("chunk", "counts").repartition(chunks, "chunk").mapInArrow(_add_counts, "chunk int, counts binary").collect()
    counts = np.zeros((chunks, 1 << CHUNK_LOG2), dtype=np.uint64)
    for r in rows:
        counts[r["chunk"]] = np.frombuffer(r["counts"], dtype=np.uint64)
    counts = counts.ravel()
    mean = float(counts.mean())
    return counts > mean + max(LEAST_FREQUENT, DEVIATIONS * np.sqrt(mean))


INDEX = "sig long, cls long, n int, rare int, center long, center_n int"


def _index(frequent, words: int, percent: int):
    """Signatures of every set. Of the sets of a task that share one, all name the most typical as center, and only that goes on."""
    def flush(sigs, classes, sizes, rares, counts):
        cls, n, rare = (np.repeat(np.array(x, dtype=kind), counts) for x, kind in ((classes, np.int64), (sizes, np.int32), (rares, np.int32)))
        sig = np.concatenate(sigs).view(np.int64)
        order = np.lexsort((cls, n, rare, sig))
        sig, cls, n, rare = sig[order], cls[order], n[order], rare[order]
        new = np.concatenate([[True], sig[1:] != sig[:-1]])
        first = np.maximum.accumulate(np.where(new, np.arange(len(sig)), 0))
        return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(cls), pa.array(n), pa.array(rare), pa.array(cls[first], mask=new), pa.array(n[first], mask=new)],
                                          names=["sig", "cls", "n", "rare", "center", "center_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, known = frequent.value, set()
        sigs, classes, sizes, rares, counts, held = [], [], [], [], [], 0
        for batch in _sliced(batches):
            for text in _texts(batch):
                tokens = shingle_set(text, words)
                digest = _digest(tokens) if len(tokens) else None
                if digest is None or digest in known:
                    continue
                if len(known) >= REMEMBERED:
                    known.clear()
                known.add(digest)
                found = signatures(tokens, bits, percent)
                if len(found):
                    sigs.append(found)
                    classes.append(digest)
                    sizes.append(len(tokens))
                    rares.append(len(tokens) - int(bits[_counter(tokens)].sum()))
                    counts.append(len(found))
                    held += len(found)
                if held >= FLUSH:
                    yield flush(sigs, classes, sizes, rares, counts)
                    sigs, classes, sizes, rares, counts, held = [], [], [], [], [], 0
        if held:
            yield flush(sigs, classes, sizes, rares, counts)
    return run


def _class_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(cls, tokens) of the wanted classes, from the text of the smallest id of each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            keep, sets = [], []
            for text, cls in zip(_texts(batch), batch.column("cls").to_pylist()):
                tokens = shingle_set(text, words)
                if len(tokens) and _digest(tokens) == cls:
                    keep.append(cls)
                    sets.append(tokens.view(np.int64))
                if len(keep) >= 256:
                    yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["cls", "tokens"])
                    keep, sets = [], []
            if keep:
                yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["cls", "tokens"])
    held = docs.join(broadcast_if_small(wanted.select(F.col("low").alias("doc_id"), "cls")), "doc_id").select("cls", "text")
    return held.mapInArrow(run, "cls long, tokens array<long>")


def _profiles(ends: DataFrame, summaries: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls, profile) of the classes in ``ends``, written to the shared folder."""
    wanted = ends.select("cls").distinct().join(classes, "cls")
    rows = summaries.select("cls", "profile", F.col("doc_id").alias("low")).join(wanted, ["cls", "low"])
    return cut_lineage(rows.dropDuplicates(["cls"]).select("cls", "profile"))


def _within_bound(profiles: list, n: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether the sets at positions ``a`` and ``b`` can reach the threshold by their profiles."""
    level = np.array([p[0] for p in profiles], dtype=np.int64)
    place, tables = np.zeros(len(profiles), dtype=np.int64), {}
    for at in np.unique(level).tolist():
        own = np.flatnonzero(level == at)
        place[own] = np.arange(len(own))
        counts = [np.frombuffer(profiles[i], dtype=np.uint8 if len(profiles[i]) == 1 + (1 << at) else np.uint32, offset=1) for i in own.tolist()]
        tables[at] = np.stack(counts) if len({c.dtype for c in counts}) == 1 else np.stack([c.astype(np.uint32) for c in counts])
    shared = np.zeros(len(a), dtype=np.int64)
    for la, lb in np.unique(np.stack([level[a], level[b]]), axis=1).T.tolist():
        pairs, least = np.flatnonzero((level[a] == la) & (level[b] == lb)), min(la, lb)
        step = max(1, COMPARED >> max(la, lb))
        for k in range(0, len(pairs), step):
            part = pairs[k:k + step]
            sides = [tables[at][place[x[part]]] for x, at in ((a, la), (b, lb))]
            sides = [x if at == least else x.reshape(len(x), 1 << least, -1).sum(axis=2, dtype=np.uint32) for x, at in zip(sides, (la, lb))]
            shared[part] = np.minimum(*sides).sum(axis=1, dtype=np.int64)
    return 100 * shared >= percent * (n[a].astype(np.int64) + n[b] - shared)


def _plausible(pairs: DataFrame, summaries: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that can reach the threshold by the profiles of their sets: only their sets are fetched."""
    profiles = _profiles(pairs.select(F.col("a").alias("cls")).union(pairs.select("b")), summaries, classes)
    both = pairs.join(profiles.select(F.col("cls").alias("a"), F.col("profile").alias("pa")), "a").join(
        profiles.select(F.col("cls").alias("b"), F.col("profile").alias("pb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            profiles = [*batch.column("pa").to_pylist(), *batch.column("pb").to_pylist()]
            n = np.array([int(np.frombuffer(p, dtype=np.uint8 if len(p) == 1 + (1 << p[0]) else np.uint32, offset=1).sum(dtype=np.int64)) for p in profiles], dtype=np.int64)
            half = np.arange(batch.num_rows)
            keep = _within_bound(profiles, n, half, half + batch.num_rows, percent) if batch.num_rows else np.zeros(0, dtype=bool)
            yield batch.select(["a", "b"]).filter(pa.array(keep))
    return cut_lineage(both.mapInArrow(run, "a long, b long"))


def _verified(docs: DataFrame, pairs: DataFrame, summaries: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar enough."""
    pairs = _plausible(pairs, summaries, classes, percent)
    ends = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
    wanted = cut_lineage(ends.join(classes, "cls").select("cls", "low"))
    # rows that repeat an id give a set more than once
    sets = _class_sets(docs, wanted, words).dropDuplicates(["cls"])
    shared = F.size(F.array_intersect("tokens_a", "tokens_b"))
    both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("tokens").alias("tokens_a")), "a").join(
        sets.select(F.col("cls").alias("b"), F.col("tokens").alias("tokens_b")), "b")
    return cut_lineage(both.select("a", "b", shared.alias("shared"), (F.size("tokens_a") + F.size("tokens_b")).alias("sizes"))
                       .filter(F.col("shared").cast("long") * 100 >= percent * (F.col("sizes") - F.col("shared"))).select("a", "b"))


def _ordered(left: str, right: str) -> list:
    return [F.least(left, right).alias("a"), F.greatest(left, right).alias("b")]


def similar_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row; the component is the smallest id that links reach."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    summaries = cut_lineage(texts.mapInArrow(_summarize(words), SETS))
    rows = summaries.filter("chunk is null").select("doc_id", "n", "cls")
    frequent = texts.sparkSession.sparkContext.broadcast(_frequent_tokens(summaries))
    classes = cut_lineage(rows.filter("cls is not null and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("low")))
    indexed = _index_table(texts, frequent, words, percent)
    pairs = cut_lineage(indexed.filter(_alike_in_size("n", "center_n", percent)).select(*_ordered("center", "cls")).distinct())
    links = _verified(texts, pairs, summaries, classes, words, percent)
    groups = connected_components(links)
    more = _links_across(texts, _arenas(indexed, groups), summaries, classes, words, percent)
    if more.limit(1).count():
        groups = _tied(groups, more)
    # a component is named by the smallest id of its classes
    named = classes.join(groups.withColumnRenamed("node", "cls"), "cls", "left").withColumn("group", F.coalesce("component", "cls"))
    named = cut_lineage(named)
    lowest = cut_lineage(named.groupBy("group").agg(F.min("low").alias("component_id")))
    of_class = broadcast_if_small(cut_lineage(named.join(broadcast_if_small(lowest), "group").select("cls", "component_id")))
    known = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.join(of_class, "cls", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), known.alias("component_id"))


def _tied(groups: DataFrame, more: DataFrame) -> DataFrame:
    """``groups`` (node, component) after further links: components are tied together, not all their nodes again."""
    small = broadcast_if_small(groups)
    ends = more
    for side in ("a", "b"):
        ends = ends.join(small.withColumnRenamed("node", side), side, "left").withColumn(side, F.coalesce("component", side)).drop("component")
    tied = connected_components(ends).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    alone = more.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(small, "node", "left_anti").withColumn("component", F.col("node"))
    return cut_lineage(groups.union(alone).join(broadcast_if_small(tied), "component", "left").select("node", F.coalesce("whole", "component").alias("component")))


def _index_table(texts: DataFrame, frequent, words: int, percent: int) -> DataFrame:
    """(sig, center, center_n, cls, n) for every class that shares a signature with a more typical one, written to the shared folder."""
    index = texts.filter("doc_id is not null").select("text").mapInArrow(_index(frequent, words, percent), INDEX)
    # rows that already name the center of their task are dealt by it; the centers of all tasks meet by signature
    typical = Window.partitionBy("sig", "center").orderBy("rare", "n", "cls")
    first = index.withColumn("first", F.first(F.struct("cls", "n")).over(typical))
    return cut_lineage(first.select("sig", F.coalesce("center", "first.cls").alias("center"), F.coalesce("center_n", "first.n").alias("center_n"), "cls", "n")
                       .filter("center <> cls"))


def _alike_in_size(n: str, m: str, percent: int):
    """Whether sets of these sizes can reach the threshold."""
    return F.least(n, m).cast("long") * 100 >= F.greatest(n, m).cast("long") * percent


CELL = ["arena", "xb", "yb"]


def _arenas(indexed: DataFrame, groups: DataFrame) -> DataFrame:
    """(arena, cls, n, component) of the classes of each signature that still holds more than one component.

    The arena of a signature is its largest component. Signatures of one large group
    name the same arena, so its classes are looked at once and not once per signature.
    """
    size = groups.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    known = broadcast_if_small(cut_lineage(groups.join(broadcast_if_small(cut_lineage(size)), "component").select(F.col("node").alias("cls"), "component", "size")))
    members = cut_lineage(indexed.select("sig", "cls", "n").union(indexed.select("sig", "center", "center_n")).distinct().join(known, "cls", "left").select(
        "sig", "cls", "n", F.coalesce("component", "cls").alias("component"), F.coalesce("size", F.lit(1)).alias("size")))
    home = members.groupBy("sig").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.min_by("component", F.struct(-F.col("size"), "component")).alias("arena"))
    home = cut_lineage(home.filter("least <> most").select("sig", "arena"))
    return cut_lineage(members.join(home, "sig").select("arena", "cls", "n", "component").distinct())


def _in_cells(arenas: DataFrame) -> DataFrame:
    """Rows of arenas dealt into cells: classes outside the arena's component (``x``) meet all classes (``y``), a block of bounded size each."""
    outside = F.col("component") != F.col("arena")

    def blocks(count, tokens):
        return F.greatest(F.ceil(count / CLASSES), F.ceil(tokens / TOKENS), F.lit(1)).cast("int")
    sizes = arenas.groupBy("arena").agg(
        blocks(F.count_if(outside), F.sum(F.when(outside, F.col("n")).otherwise(0))).alias("xbs"), blocks(F.count(F.lit(1)), F.sum("n")).alias("ybs"))
    dealt = arenas.join(cut_lineage(sizes), "arena").withColumns({"own_x": F.pmod(F.xxhash64("cls"), "xbs").cast("int"), "own_y": F.pmod(F.xxhash64("cls", F.lit(1)), "ybs").cast("int")})
    columns = ["arena", "xb", "yb", "cls", "n", "component", "x", "y"]
    as_y = dealt.withColumn("xb", F.explode(F.sequence(F.lit(0), F.col("xbs") - 1))).withColumns(
        {"yb": F.col("own_y"), "x": outside & (F.col("xb") == F.col("own_x")), "y": F.lit(True)})
    as_x = dealt.filter(outside & (F.col("ybs") > 1)).withColumn("yb", F.explode(F.sequence(F.lit(0), F.col("ybs") - 1))).filter("yb <> own_y").withColumns(
        {"xb": F.col("own_x"), "x": F.lit(True), "y": F.lit(False)})
    return as_y.select(columns).union(as_x.select(columns))


def _meetings(group: np.ndarray, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all (x row, y row) of equal ``group``, about ``PAIRS`` at a time; nothing is sent on."""
    left, right = np.flatnonzero(x), np.flatnonzero(y)
    begin, end = (np.searchsorted(group[right], group[left], side=side) for side in ("left", "right"))
    number = end - begin
    edges = np.searchsorted(np.cumsum(number), np.arange(0, number.sum(), PAIRS), side="left")
    for a, b in zip(edges, [*edges[1:].tolist(), len(left)]):
        part = number[a:b]
        yield np.repeat(left[a:b], part), right[np.repeat(begin[a:b], part) + np.arange(part.sum()) - np.repeat(np.cumsum(part) - part, part)]


def _plausible_classes(percent: int):
    """(arena, cls) of the classes that have a partner in another component which size and profile allow."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, CELL):
            n, component, x, y, group = (table.column(c).to_numpy() for c in ("n", "component", "x", "y", "group"))
            n, profiles, found = n.astype(np.int64), table.column("profile").to_pylist(), np.zeros(len(n), dtype=bool)
            for a, b in _meetings(group, x, y):
                # rows that play both parts in a cell meet once
                keep = (component[a] != component[b]) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])) & ((a < b) | ~(x[b] & y[a]))
                a, b = a[keep], b[keep]
                if len(a):
                    keep = _within_bound(profiles, n, a, b, percent)
                    found[a[keep]] = found[b[keep]] = True
            yield table.select(["arena", "cls"]).filter(pa.array(found)).combine_chunks().to_batches()[0] if found.any() else pa.RecordBatch.from_arrays(
                [pa.array([], pa.int64()), pa.array([], pa.int64())], names=["arena", "cls"])
    return run


def _links_in_cells(percent: int):
    """Links between x rows and y rows, by their whole sets: for each x row one into every component that it links to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, CELL):
            component, cls, x, y, group = (table.column(c).to_numpy() for c in ("component", "cls", "x", "y", "group"))
            sets = table.column("tokens").combine_chunks()
            n = np.diff(sets.offsets.to_numpy())
            first = np.concatenate([[0], np.cumsum(n)])
            _, flat = np.unique(sets.flatten().to_numpy(), return_inverse=True)
            marked = np.zeros(len(flat) + 1, dtype=bool)
            begin, end = (np.searchsorted(group, group, side=side) for side in ("left", "right"))
            links = []
            for at in np.flatnonzero(x).tolist():
                a, b = int(begin[at]), int(end[at])
                own = flat[first[at]:first[at + 1]]
                marked[own] = True
                shared = np.add.reduceat(marked[flat[first[a]:first[b]]], first[a:b] - first[a], dtype=np.int64)
                marked[own] = False
                near = a + np.flatnonzero((100 * shared >= percent * (n[at] + n[a:b] - shared)) & y[a:b] & (component[a:b] != component[at]))
                if len(near):
                    _, one = np.unique(component[near], return_index=True)
                    links += [(cls[at], c) for c in cls[near[one]].tolist()]
            if links:
                pairs = np.array(links, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1)), pa.array(pairs.max(axis=1))], names=["a", "b"])
    return run


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(*CELL).sortWithinPartitions(*CELL)


def _links_across(texts: DataFrame, arenas: DataFrame, summaries: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) that tie together classes of different components: enough of them to tie all that are similar."""
    profiles = _profiles(arenas, summaries, classes)
    possible = cut_lineage(_dealt(_in_cells(arenas).join(profiles, "cls")).mapInArrow(_plausible_classes(percent), "arena long, cls long").distinct())
    left = cut_lineage(arenas.join(possible, ["arena", "cls"]))
    wanted = cut_lineage(left.select("cls").distinct().join(classes, "cls").select("cls", "low"))
    # rows that repeat an id give a set more than once
    sets = cut_lineage(_class_sets(texts, wanted, words).dropDuplicates(["cls"]))
    return cut_lineage(_dealt(_in_cells(left).join(sets, "cls")).mapInArrow(_links_in_cells(percent), "a long, b long").distinct())


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that are the first of their group by (id, nulls last, text); all columns as they are.

    A row is named by id and text: rows that repeat an id with another text are
    documents of their own, and so are rows without id, one of each text.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("key", F.xxhash64("text"))
    rows = texts.select(F.xxhash64("id", "key").alias("row"), "id", "key", "text")
    groups = similar_groups(rows, id_col="row").select(F.col("doc_id").alias("row"), "component_id").distinct()
    groups = cut_lineage(groups)
    linked = cut_lineage(groups.filter("row <> component_id").select("component_id").distinct())
    members = broadcast_if_small(cut_lineage(groups.join(broadcast_if_small(linked), "component_id", "left_semi")))
    named = cut_lineage(rows.select("row", "id", "key").join(members, "row").distinct())
    first = named.groupBy("component_id").agg(F.min_by("row", F.struct(F.col("id").isNull(), "id", "key")).alias("first"))
    dropped = named.join(broadcast_if_small(cut_lineage(first)), "component_id").filter("row <> first").select(F.col("id").alias("doc_id"), "key")
    return without_rows(docs, dropped, id_col, F.xxhash64(text_col))
