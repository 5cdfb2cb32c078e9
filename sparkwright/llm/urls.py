"""URL filter by association rules, in DataFrame functions only.

Fixed rules (host suffix and path prefix, the longest wins) label the urls that they
fit. Spark's FP-growth mines combinations of url tokens with these labels. A mined rule
(up to MOST_TOKENS tokens imply a verdict) stays if its support and confidence suffice
and no rule on fewer of its tokens with the same verdict is as confident. Rules are
held in an inverted index by their first token in order of text, a table: a url's tokens are joined to it, and
of the rules whose tokens it has all of the most confident decides.

All labels of the host, all segments of the path and all keys of the query are tokens, whole; support alone decides which
can be in rules. A rule's token is in at least ``support`` of the labelled urls, so that there are at most
(mean tokens of a url) / support such tokens, whatever the input's size; these, and no urls, reach the driver. The index is broadcast when
counted to be within MOST_BROADCAST rules, else joined by shuffle.

Defined results: null urls and urls without ``://`` have an empty host and path, no
rule, and the verdict that the mined rules or the default give; repeated rows each have
a result; of fixed rules that fit the one with the longest host and path wins, of mined ones the more confident, then the one of more
support, then ``block``; urls of any length are read whole; only page_id and url are read, whatever other columns
there are; without labelled urls nothing is mined and the default holds; an empty table gives no rows.
"""

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, documents

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
SUPPORT, CONFIDENCE, MOST_TOKENS, MOST_BROADCAST, DEFAULT = 0.005, 0.8, 3, 100_000, "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LABEL = "verdict="


def host_path(url: Column) -> tuple[Column, Column]:
    known = url.isNotNull() & (F.instr(url, "://") > 0)
    rest = F.when(known, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting(rules) -> Column:
    """struct(rule, verdict) of the longest rule that fits columns host and path, or null."""
    fits = [
        F.when(((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path), F.struct(F.lit(len(host + path)).alias("size"), F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict")))
        for verdict, host, path in rules
    ]
    return F.array_max(F.array_compact(F.array(*fits)))


def tokens() -> Column:
    """The tokens of columns url, host and path: the top label, the last two, each label before; each segment, of those after the first also how it begins; the ending; each key of the query; whether there is a fragment."""
    labels, steps = F.split("host", r"\."), F.filter(F.split("path", "/"), lambda s: s != "")
    keys = F.filter(F.split(F.regexp_extract("url", r"^[^?#]*\?([^#]*)", 1), "&"), lambda k: k != "")
    n, m = F.size(labels), F.size(steps)
    named = lambda name, value: F.concat(F.lit(f"{name}="), value)
    single = F.array_compact(
        F.array(
            F.when(F.col("host") != "", named("top", F.element_at(labels, -1))),
            F.when(n >= 2, named("site", F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), F.lit(2)), "."))),
            F.when(F.col("path").rlike(r"\.[A-Za-z0-9]{1,5}$"), named("end", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]{1,5})$", 1)))),
            F.when(F.col("url").contains("#"), F.lit("mark=yes")),
        )
    )
    earlier = F.transform(F.when(n > 2, F.slice(labels, F.lit(1), F.greatest(n - 2, F.lit(0)))).otherwise(F.array().cast("array<string>")), lambda x: named("label", x))
    begins = F.transform(F.when(m > 1, F.slice(steps, F.lit(2), F.greatest(m - 1, F.lit(0)))).otherwise(F.array().cast("array<string>")), lambda x: named("next", F.substring(x, 1, 1)))
    every = F.concat(single, earlier, F.transform(steps, lambda x: named("step", x)), begins, F.transform(keys, lambda k: named("query", F.regexp_extract(k, "^[^=]*", 0))))
    return F.array_sort(F.array_distinct(F.coalesce(every, F.array().cast("array<string>"))))


def mined(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """tokens, verdict, confidence, support of the rules that stay; labelled has items (tokens) and verdict."""
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(labelled.select(F.concat("items", F.array(F.concat(F.lit(LABEL), "verdict"))).alias("items")))
    rules = model.associationRules.filter((F.size("antecedent") <= MOST_TOKENS) & F.col("consequent")[0].startswith(LABEL) & ~F.exists("antecedent", lambda t: t.startswith(LABEL)))
    rules = rules.select(F.array_sort("antecedent").alias("tokens"), F.substring(F.col("consequent")[0], len(LABEL) + 1, 100).alias("verdict"), "confidence", "support")
    part = lambda i, j=None: F.when(F.size("tokens") > (i if j is None else max(i, j)), F.array(F.get("tokens", F.lit(i))) if j is None else F.array(F.get("tokens", F.lit(i)), F.get("tokens", F.lit(j))))
    smaller = F.filter(F.array_compact(F.array(part(0), part(1), part(2), part(0, 1), part(0, 2), part(1, 2))), lambda s: F.size(s) < F.size("tokens"))
    wide = rules.select("tokens", "verdict", "confidence", F.explode(smaller).alias("fewer"))
    less = rules.select(F.col("tokens").alias("fewer"), "verdict", F.col("confidence").alias("known"))
    redundant = wide.join(less, ["fewer", "verdict"]).filter("known >= confidence").select("tokens", "verdict").distinct()
    return rules.join(redundant, ["tokens", "verdict"], "left_anti")


def looked_up(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows (page_id, host, path, items) with ``match``, the best rule whose tokens are all among the items, or null."""
    rules = cut(rules)
    known = [r["t"] for r in rules.select(F.explode("tokens").alias("t")).distinct().collect()]  # bounded: see above
    index = rules.select(F.col("tokens")[0].alias("token"), F.struct("confidence", "support", "verdict", "tokens").alias("found"))
    index = F.broadcast(index) if index.count() <= MOST_BROADCAST else index
    rows = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("items", F.filter("items", lambda t: t.isin(known)))
    one = rows.select("row", "page_id", "host", "path", "items", F.explode_outer("items").alias("token")).join(index, "token", "left")
    fits = F.when(F.forall("found.tokens", lambda t: F.array_contains("items", t)), F.col("found"))
    return one.select("row", "page_id", "host", "path", fits.alias("match")).groupBy("row", "page_id", "host", "path").agg(F.max("match").alias("match"))


def judged(pages: DataFrame, rules=RULES, support: float = SUPPORT, confidence: float = CONFIDENCE, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict, and the mined rule's tokens and confidence where it decided."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    host, path = host_path(F.col("url"))
    rows = rows.withColumn("host", host).withColumn("path", path).withColumn("fit", fitting(rules))
    labelled = rows.filter("fit is not null").select(tokens().alias("items"), F.col("fit.verdict").alias("verdict"))
    fixed = rows.filter("fit is not null").select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("verdict"), F.expr("cast(null as array<string>)").alias("mined_tokens"), F.expr("cast(null as double)").alias("mined_confidence"))
    rest = rows.filter("fit is null").select("page_id", "host", "path", tokens().alias("items"))
    if labelled.isEmpty():
        rest = rest.withColumn("match", F.expr("cast(null as struct<confidence:double,support:double,verdict:string,tokens:array<string>>)"))
    else:
        rest = looked_up(rest, mined(labelled, support, confidence))
    return fixed.unionAll(rest.select("page_id", "host", "path", F.lit(None).cast("string"), F.coalesce("match.verdict", F.lit(default)), "match.tokens", "match.confidence"))


def parts(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and its verdict: what needs no mining."""
    host, path = host_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("fit", fitting(rules))
    return rows.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("verdict"))


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(documents(spark, sf_dir, "pages"))


PARTS_SQL = """
WITH p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages) t
), r AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) t(verdict, h, f)),
m AS (
  SELECT page_id, max(struct_pack(size := length(r.h || r.f), rule := r.h || r.f, verdict := r.verdict)) AS best
  FROM p JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.f) GROUP BY page_id
)
SELECT p.page_id, p.host, p.path, best.rule AS rule, best.verdict AS verdict FROM p LEFT JOIN m ON p.page_id = m.page_id
"""


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(documents(spark, sf_dir, "pages"))
