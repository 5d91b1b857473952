"""URL filters by a temporal list join.

A dated list entry holds from its date until it expires or the next entry for the
same rule replaces it. Every capture is evaluated against the entries that are
active when it was fetched: an as-of join on each of its rules (the URL itself, its
host, every parent domain); the most specific active entry decides.

The as-of join sorts entries and captures together by rule and time in ranges, so
a host that holds a third of all captures, or has very many entries, is cut into
many tasks. Inside a range the last entry is carried forward; what reaches into a
range from earlier ones is one row per range and rule.

Defined cases: a null URL or one without a host matches nothing and is ``unlisted``;
so is a capture without a time; entries without rule or date are ignored; of entries
for one rule and date, ``allow`` wins, then the later expiry; repeated captures get
one row each.
"""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.llm.common import cut_lineage

# higher is more specific; a domain counts its labels
URL_RANK, HOST_RANK = 1000, 999


def url_host(url: Column) -> Column:
    """Lower-case host without user and port; empty if there is none."""
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)


def url_rules(url: Column) -> Column:
    """Rules a URL can match: array of (rule, rank)."""
    host = url_host(url)
    labels = F.split(host, r"\.")
    exact = F.regexp_replace(url, "#.*$", "")
    pair = lambda rule, rank: F.struct(rule.alias("rule"), rank.cast("int").alias("rank"))
    domains = F.when(F.size(labels) > 2, F.transform(F.sequence(F.lit(2), F.size(labels) - 1), lambda k: pair(
        F.concat(F.lit("domain:"), F.array_join(F.slice(labels, F.size(labels) - k + 1, k), ".")), k)))
    own = F.array(pair(F.concat(F.lit("url:"), exact), F.lit(URL_RANK)), pair(F.concat(F.lit("host:"), host), F.lit(HOST_RANK)))
    return F.when(host != "", F.concat(own, F.coalesce(domains, F.array().cast("array<struct<rule:string,rank:int>>"))))


def asof_entries(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """The newest entry at or before each capture's time: captures (rule, at, row) with the entry's struct.

    captures: rule, at, row (a unique number), rank. entries: rule, at, entry (struct).
    """
    both = entries.select("rule", "at", F.lit(0).alias("late"), F.lit(None).cast("long").alias("row"), F.lit(None).cast("int").alias("rank"), "entry").unionByName(
        captures.select("rule", "at", F.lit(1).alias("late"), "row", "rank", F.lit(None).cast(entries.schema["entry"].dataType).alias("entry")))
    ranged = cut_lineage(both.repartitionByRange("rule", "at", "late", "row").withColumn("part", F.spark_partition_id()))
    carry = Window.partitionBy("part", "rule").orderBy("at", "late", "entry").rowsBetween(Window.unboundedPreceding, 0)
    here = ranged.withColumn("found", F.last("entry", ignorenulls=True).over(carry))
    ends = ranged.filter("late = 0").groupBy("part", "rule").agg(F.max_by("entry", F.struct("at", F.struct("entry"))).alias("entry"))
    spans = ranged.groupBy("part", "rule").agg(F.count(F.lit(1)).alias("n")).join(ends, ["part", "rule"], "left")
    before = Window.partitionBy("rule").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    reaching = spans.withColumn("carried", F.last("entry", ignorenulls=True).over(before)).filter("carried is not null").select("part", "rule", "carried")
    return (here.filter("late = 1").join(reaching, ["part", "rule"], "left")
            .select("row", "rule", "rank", "at", F.coalesce("found", "carried").alias("entry")).filter("entry is not null"))


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "capture_id") -> DataFrame:
    """One row per capture: id, url, host, fetched_on, verdict (blocked, allowed, unlisted), rule, listed_on.

    captures: id, url, fetched_on. entries: rule (``url:``, ``host:`` or ``domain:`` and its value), action (block or allow),
    listed_on, expires_on (null: never).
    """
    rows = cut_lineage(captures.select(F.col(id_col).alias("capture_id"), "url", "fetched_on", F.monotonically_increasing_id().alias("row")))
    keys = rows.filter("fetched_on is not null").select("row", F.col("fetched_on").alias("at"), F.explode(url_rules(F.col("url"))).alias("r")).select(
        "row", "at", "r.rule", "r.rank")
    # of equal dates the greatest struct is carried on: allow before block, then the later expiry
    listed = entries.filter("rule is not null and listed_on is not null").select("rule", F.col("listed_on").alias("at"), F.struct(
        F.when(F.col("action") == "block", 0).otherwise(1).alias("allowed"), F.datediff(F.coalesce("expires_on", F.lit("9999-12-31").cast("date")), F.lit("1970-01-01").cast("date")).alias("ends"),
        "listed_on").alias("entry"))
    active = asof_entries(keys, listed).filter(F.datediff("at", F.lit("1970-01-01").cast("date")) < F.col("entry.ends"))
    best = active.groupBy("row").agg(F.max(F.struct("rank", "rule", "entry")).alias("best"))
    verdict = F.when(F.col("best").isNull(), "unlisted").when(F.col("best.entry.allowed") == 1, "allowed").otherwise("blocked")
    return rows.join(best, "row", "left").select("capture_id", "url", F.coalesce(url_host(F.col("url")), F.lit("")).alias("host"), "fetched_on", verdict.alias("verdict"),
                                                  F.col("best.rule").alias("rule"), F.col("best.entry.listed_on").alias("listed_on"))


def page_captures(pages: DataFrame) -> DataFrame:
    """Pages as captures: the day of 2024 they were fetched on follows from the id."""
    return pages.select(F.col("page_id").alias("capture_id"), "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int")).alias("fetched_on"))


def _digit(text: Column, at: int) -> Column:
    return F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(text), at, 1)) - 1


def page_lists(pages: DataFrame) -> DataFrame:
    """Dated entries for rules that the pages' URLs can match, drawn by the digits of a hash of the rule.

    A rule whose first digit is below 6 is blocked on some day, a third of those allowed later, and some entries expire.
    """
    rules = pages.select(F.explode(url_rules(F.col("url"))).alias("r")).select("r.rule").distinct()
    rule = F.col("rule")
    day = lambda a, b: F.date_add(F.lit("2024-01-01").cast("date"), (_digit(rule, a) * 16 + _digit(rule, b)).cast("int"))
    first = rules.filter(_digit(rule, 1) < 6).select("rule", F.lit("block").alias("action"), day(2, 3).alias("listed_on"), F.when(
        _digit(rule, 4) < 5, F.date_add(day(2, 3), (_digit(rule, 5) * 10 + 1).cast("int"))).alias("expires_on"))
    later = rules.filter(_digit(rule, 1) < 2).select("rule", F.lit("allow").alias("action"), F.date_add(day(2, 3), (_digit(rule, 6) * 8 + 1).cast("int")).alias("listed_on"),
                                                    F.lit(None).cast("date").alias("expires_on"))
    return first.unionByName(later)


SQL = r"""
with p as (
  select page_id as capture_id, url, date '2024-01-01' + cast((page_id * 37) % 366 as int) as fetched_on, regexp_replace(url, '#.*$', '') as exact,
         regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1) as host from pages),
l as (select *, string_split(host, '.') as labels from p),
r as (
  select capture_id, fetched_on, 'url:' || exact as rule, 1000 as rank from l where host <> ''
  union all select capture_id, fetched_on, 'host:' || host, 999 from l where host <> ''
  union all select capture_id, fetched_on, 'domain:' || array_to_string(labels[len(labels) - k + 1:], '.'), k
    from (select *, unnest(range(2, len(labels))) as k from l where host <> '' and len(labels) > 2)),
d as (select distinct rule, md5(rule) as h from r),
n as (select rule, [instr('0123456789abcdef', substr(h, i, 1)) - 1 for i in range(1, 7)] as x from d),
e as (
  select rule, 'blocked' as verdict, date '2024-01-01' + cast(x[2] * 16 + x[3] as int) as listed_on,
         case when x[4] < 5 then date '2024-01-01' + cast(x[2] * 16 + x[3] + x[5] * 10 + 1 as int) end as expires_on from n where x[1] < 6
  union all select rule, 'allowed', date '2024-01-01' + cast(x[2] * 16 + x[3] + x[6] * 8 + 1 as int), null from n where x[1] < 2),
v as (select *, lead(listed_on) over (partition by rule order by listed_on) as replaced_on from e),
m as (select r.capture_id, r.rule, r.rank, v.verdict, v.listed_on from r join v on r.rule = v.rule and v.listed_on <= r.fetched_on
      and (v.replaced_on is null or r.fetched_on < v.replaced_on) and (v.expires_on is null or r.fetched_on < v.expires_on)),
b as (select capture_id, max_by(struct_pack(rule := rule, verdict := verdict, listed_on := listed_on), rank) as best from m group by capture_id)
select p.capture_id, p.url, p.host, cast(p.fetched_on as date) as fetched_on, coalesce(b.best.verdict, 'unlisted') as verdict, b.best.rule as rule,
       cast(b.best.listed_on as date) as listed_on
from p left join b using (capture_id)
"""
