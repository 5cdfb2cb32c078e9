"""Queries in the dialect's own words, which session.sql rewrites, and queries over functions and sinks, each with DuckDB's SQL."""

from pyspark.sql import functions as F

from ..functions import collections as C
from ..functions import extras as X
from ..functions import registry
from ..functions import scalar as S
from ..functions import temporal as D
from ..operators import changes as H
from ..operators import fulltext as FT
from ..operators import windows as WN
from ..operators.recursion import shared_folder
from ..session import analyse, explain, sql, table
from ..sources import readers, sinks
from .functional import NEW, OLD, _states, entry

#: name: the dialect's text, DuckDB's, and values of parameters.
DIALECT = {
    "scan_backward": ("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC", None),
    "scan_multi_index_and": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey = 3 AND l_partkey < 900", None),
    "dialect_operators": ("SELECT p_partkey, p_size == 9 AS a, p_name ISNULL AS b, p_name NOTNULL AS c, p_size IS 9 AS d, p_size IS NOT 9 AS e FROM part WHERE p_type LIKE 'p%o%' OR p_name GLOB '[a-c]*'", "SELECT p_partkey, p_size = 9 AS a, p_name IS NULL AS b, p_name IS NOT NULL AS c, p_size IS NOT DISTINCT FROM 9 AS d, p_size IS DISTINCT FROM 9 AS e FROM part WHERE p_type ILIKE 'p%o%' OR p_name GLOB '[a-c]*'"),
    "dialect_like_escape": ("SELECT p_partkey FROM part WHERE p_type || '_x' LIKE '%!_X' ESCAPE '!' AND p_name NOT LIKE 'A%'", "SELECT p_partkey FROM part WHERE p_type || '_x' ILIKE '%!_X' ESCAPE '!' AND p_name NOT ILIKE 'A%'"),
    "dialect_int_division": ("SELECT p_partkey, p_size / 7 AS q, (p_partkey - 500) % 7 AS r, p_size / 0 AS z, p_size % 0 AS y, p_retailprice / p_size AS f FROM part", "SELECT p_partkey, CAST(p_size // 7 AS BIGINT) AS q, (p_partkey - 500) % 7 AS r, CAST(NULL AS BIGINT) AS z, CAST(NULL AS INTEGER) AS y, p_retailprice / p_size AS f FROM part"),
    "dialect_literals": ("SELECT p_partkey, p_size + 0x1F AS h, hex(x'4142ff') AS b, TRUE AS t, FALSE AS f, 1.5e3D AS e FROM part", "SELECT p_partkey, p_size + 31 AS h, '4142FF' AS b, TRUE AS t, FALSE AS f, 1500.0::DOUBLE AS e FROM part"),
    "dialect_parameters": ("SELECT o_orderkey FROM orders WHERE o_custkey > ?1 AND o_totalprice > :low AND (o_orderstatus = @status OR o_orderpriority = $priority)", "SELECT o_orderkey FROM orders WHERE o_custkey > 50 AND o_totalprice > 1000.0 AND (o_orderstatus = 'F' OR o_orderpriority = '1-URGENT')", {"p1": 50, "low": 1000.0, "status": "F", "priority": "1-URGENT"}),
    "dialect_hints": ("SELECT o_orderkey FROM orders NOT INDEXED WHERE likely(o_totalprice > 1000) AND unlikely(o_custkey < 100) AND likelihood(o_orderkey > 3, 0.9)", "SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 AND o_custkey < 100 AND o_orderkey > 3"),
    "dialect_indexed_by": ("SELECT c_custkey FROM customer INDEXED BY by_nation WHERE c_nationkey = 7", "SELECT c_custkey FROM customer WHERE c_nationkey = 7"),
    "dialect_row_compare": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey, l_linenumber) < (700, 3) AND (l_orderkey, l_linenumber) >= (5, 2)", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey < 700 OR (l_orderkey = 700 AND l_linenumber < 3)) AND (l_orderkey > 5 OR (l_orderkey = 5 AND l_linenumber >= 2))"),
    "dialect_limit_comma": ("SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 5, 10", "SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 10 OFFSET 5"),
    "dialect_limit_negative": ("SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT -1", "SELECT n_nationkey FROM nation"),
    "dialect_offset_negative": ("SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 4 OFFSET -2", "SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 4"),
    "sort_nulls_first": ("SELECT k, v FROM (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS v FROM customer) t ORDER BY v DESC NULLS FIRST, k", None),
    "cte_materialized": ("WITH a AS MATERIALIZED (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), b AS NOT MATERIALIZED (SELECT c_custkey, c_name FROM customer) SELECT c_name, n FROM a JOIN b ON o_custkey = c_custkey", None),
    "win_chained": ("SELECT event_id, CAST(row_number() OVER (w ORDER BY ts, event_id) AS BIGINT) AS a, count(*) OVER w AS b, CAST(row_number() OVER v AS BIGINT) AS c FROM events WINDOW w AS (PARTITION BY user_id), v AS (w ORDER BY event_id DESC)", "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS a, count(*) OVER (PARTITION BY user_id) AS b, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS BIGINT) AS c FROM events"),
    "win_any_aggregate": ("SELECT event_id, round(stddev(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND 1 FOLLOWING), 6) AS s, round(median(value) OVER (PARTITION BY user_id), 6) AS m, round(total(value) OVER (PARTITION BY event_type), 2) AS t FROM events", "SELECT event_id, round(stddev_samp(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND 1 FOLLOWING), 6) AS s, round(median(value) OVER (PARTITION BY user_id), 6) AS m, round(sum(value) OVER (PARTITION BY event_type), 2) AS t FROM events"),
    # collations
    "collate_compare": ("SELECT c_custkey FROM customer WHERE c_mktsegment = 'building' COLLATE NOCASE OR c_name < 'CUSTOMER#000000020' COLLATE NOCASE", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building' OR lower(c_name) < 'customer#000000020'"),
    "collate_order": ("SELECT p_partkey FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE lower(p_name) END AS x FROM part) t ORDER BY x COLLATE NOCASE, p_partkey LIMIT 50", "SELECT p_partkey FROM part ORDER BY lower(p_name), p_partkey LIMIT 50"),
    "collate_group": ("SELECT lower(CAST(min(x) AS STRING)) AS x, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE p_brand END COLLATE NOCASE AS x FROM part) t GROUP BY x", "SELECT lower(p_brand) AS x, count(*) AS n FROM part GROUP BY lower(p_brand)"),
    "collate_distinct": ("SELECT DISTINCT lower(CAST(x AS STRING)) AS x FROM (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN upper(p_type) ELSE p_type END COLLATE NOCASE AS x FROM part) t", "SELECT DISTINCT lower(p_type) AS x FROM part"),
    "collate_min_max": ("SELECT p_brand, lower(CAST(min(x) AS STRING)) AS lo, lower(CAST(max(x) AS STRING)) AS hi FROM (SELECT p_brand, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE lower(p_name) END COLLATE NOCASE AS x FROM part) t GROUP BY p_brand", "SELECT p_brand, min(lower(p_name)) AS lo, max(lower(p_name)) AS hi FROM part GROUP BY p_brand"),
    "collate_rtrim": ("SELECT c_custkey FROM customer WHERE c_mktsegment || '   ' = 'BUILDING' COLLATE RTRIM AND c_name <> 'x' COLLATE BINARY", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'"),
    # functions by name
    "fn_conditional": ("SELECT p_partkey, iif(p_size > 25, 'big', 'small') AS a, iif(p_size > 45, 1) AS b, ifnull(nullif(p_size, 7), -1) AS c, typeof(p_size) AS d, typeof(p_name) AS e, typeof(p_retailprice) AS f, typeof(NULL) AS g, typeof(x'00') AS h FROM part", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS a, CASE WHEN p_size > 45 THEN 1 END AS b, coalesce(nullif(p_size, 7), -1) AS c, 'integer' AS d, 'text' AS e, 'real' AS f, 'null' AS g, 'blob' AS h FROM part"),
    "fn_lengths": ("SELECT doc_id, length(text) AS a, char_length(text) AS b, character_length(text) AS c, octet_length(text) AS d, length(repeat(lang, 3)) AS e FROM documents", "SELECT doc_id, CAST(length(text) AS INTEGER) AS a, CAST(length(text) AS INTEGER) AS b, CAST(length(text) AS INTEGER) AS c, CAST(strlen(text) AS INTEGER) AS d, CAST(length(repeat(lang, 3)) AS INTEGER) AS e FROM documents"),
    "fn_text": ("SELECT p_partkey, substr(p_name, 0, 3) AS a, substr(p_name, 4, -2) AS b, substr(p_name, -3) AS c, unicode(p_name) AS d, char(65, 233, 8364) AS e, quote(p_name) AS f, quote(p_size) AS g, quote(NULL) AS h, strpos(p_name, 'a') AS i, string_reverse(p_brand) AS j, repeat('ab', p_size % 3) AS k FROM part", "SELECT p_partkey, substr(p_name, 1, 2) AS a, substr(p_name, 2, 2) AS b, right(p_name, 3) AS c, unicode(p_name) AS d, 'Aé€' AS e, '''' || replace(p_name, '''', '''''') || '''' AS f, CAST(p_size AS VARCHAR) AS g, 'NULL' AS h, CAST(instr(p_name, 'a') AS INTEGER) AS i, reverse(p_brand) AS j, repeat('ab', p_size % 3) AS k FROM part"),
    "fn_printf": ("SELECT p_partkey, printf('%o|%X|%e|%%|%8.3f|%-6d|%+d', p_partkey, p_partkey, p_retailprice, p_retailprice, p_partkey, p_partkey) AS f FROM part", "SELECT p_partkey, printf('%o|%X|%e|%%|%8.3f|%-6d|%+d', p_partkey, p_partkey, p_retailprice, p_retailprice, p_partkey, p_partkey) AS f FROM part"),
    "fn_blob": ("SELECT n_nationkey, hex(unhex('41-42', '-')) AS a, hex(zeroblob(3)) AS b, length(randomblob(20)) AS c, typeof(random()) AS d, hex(unhex(hex(n_name))) AS e, unhex('xyz') AS f FROM nation", "SELECT n_nationkey, '4142' AS a, '000000' AS b, 20 AS c, 'integer' AS d, hex(n_name) AS e, CAST(NULL AS BLOB) AS f FROM nation"),
    "fn_soundex": ("SELECT n_nationkey, soundex(n_name) AS s FROM (SELECT n_nationkey, n_name FROM nation) t WHERE n_nationkey < 0 UNION ALL SELECT * FROM (VALUES (1, soundex('Robert')), (2, soundex('Tymczak')), (3, soundex('Pfister')), (4, soundex('Honeyman'))) v(a, b)", "SELECT * FROM (VALUES (1, 'R163'), (2, 'T522'), (3, 'P236'), (4, 'H555')) t(n_nationkey, s)"),
    "fn_regexp": ("SELECT p_partkey, regexp_like(p_name, '^[a-m]') AS a, regexp_substr(p_name, '[aeiou]{2}') AS b, regexp_capture(p_type, '^([A-Za-z]+) ([A-Za-z]+)', 2) AS c, regexp_replace(p_name, '[aeiou]', '*') AS d FROM part WHERE p_name REGEXP '[aeiou]'", "SELECT p_partkey, regexp_matches(p_name, '^[a-m]') AS a, nullif(regexp_extract(p_name, '[aeiou]{2}'), '') AS b, nullif(regexp_extract(p_type, '^([A-Za-z]+) ([A-Za-z]+)', 2), '') AS c, regexp_replace(p_name, '[aeiou]', '*', 'g') AS d FROM part WHERE regexp_matches(p_name, '[aeiou]')"),
    "fn_encodings": ("SELECT n_nationkey, sha1(n_name) AS a, base64(n_name) AS b, CAST(unbase64(base64(n_name)) AS STRING) AS c, url_encode(n_name || ' é/') AS d, url_decode('a%20b') AS e FROM nation", "SELECT n_nationkey, sha1(n_name) AS a, to_base64(encode(n_name)) AS b, n_name AS c, replace(url_encode(n_name || ' é/'), '%20', '+') AS d, 'a b' AS e FROM nation"),
    # mathematics
    "math_trig_all": ("SELECT p_partkey, round(acos(x), 9) AS a, round(asin(x), 9) AS b, round(atan(x), 9) AS c, round(cos(x), 9) AS d, round(tan(x), 9) AS e, round(sin(x), 9) AS f, round(atan2(x, 0.5D), 9) AS g FROM (SELECT p_partkey, p_size / 60.0D AS x FROM part) t", "SELECT p_partkey, round(acos(x), 9) AS a, round(asin(x), 9) AS b, round(atan(x), 9) AS c, round(cos(x), 9) AS d, round(tan(x), 9) AS e, round(sin(x), 9) AS f, round(atan2(x, 0.5), 9) AS g FROM (SELECT p_partkey, p_size / 60.0::DOUBLE AS x FROM part) t"),
    "math_hyperbolic": ("SELECT p_partkey, round(acosh(1 + x), 9) AS a, round(asinh(x), 9) AS b, round(atanh(x), 9) AS c, round(cosh(x), 9) AS d, round(sinh(x), 9) AS e, round(tanh(x), 9) AS f FROM (SELECT p_partkey, p_size / 60.0D AS x FROM part) t", "SELECT p_partkey, round(acosh(1 + x), 9) AS a, round(asinh(x), 9) AS b, round(atanh(x), 9) AS c, round(cosh(x), 9) AS d, round(sinh(x), 9) AS e, round(tanh(x), 9) AS f FROM (SELECT p_partkey, p_size / 60.0::DOUBLE AS x FROM part) t"),
    "math_rounding": ("SELECT p_partkey, CAST(ceil(x) AS BIGINT) AS a, CAST(ceiling(x) AS BIGINT) AS b, CAST(floor(x) AS BIGINT) AS c, round(degrees(x), 6) AS d, round(radians(x), 9) AS e, round(pi(), 9) AS f FROM (SELECT p_partkey, p_retailprice - 1500.5 AS x FROM part) t", None),
    "math_power": ("SELECT p_partkey, mod(p_partkey, 7) AS a, pow(p_size, 2) AS b, round(power(p_size, 0.5D), 9) AS c, round(sqrt(p_size), 9) AS d, CAST(sign(p_size - 25) AS BIGINT) AS e, abs(p_size - 25) AS f FROM part", "SELECT p_partkey, p_partkey % 7 AS a, pow(p_size, 2) AS b, round(power(p_size, 0.5), 9) AS c, round(sqrt(p_size), 9) AS d, CAST(sign(p_size - 25) AS BIGINT) AS e, abs(p_size - 25) AS f FROM part"),
    # dates
    "dt_by_name": ("SELECT event_id, date(ts) AS a, time(ts) AS b, datetime(ts) AS c, unixepoch(ts) AS d, round(julianday(ts), 5) AS e FROM events", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS a, strftime(ts, '%H:%M:%S') AS b, strftime(ts, '%Y-%m-%d %H:%M:%S') AS c, epoch_us(ts) // 1000000 AS d, round(epoch_us(ts) / 86400000000.0 + 2440587.5, 5) AS e FROM events"),
    "dt_modifiers": ("SELECT event_id, datetime(ts, '+1 month', '-2 days') AS a, date(ts, 'start of year', '+3 months') AS b, datetime(ts, '+90 minutes', '-30 seconds', '+2 hours') AS c, date(ts, 'weekday 3') AS d, date(ts, '-1 year') AS e FROM events", "SELECT event_id, strftime(date_trunc('month', ts) + INTERVAL 1 MONTH + (ts - date_trunc('month', ts)) - INTERVAL 2 DAY, '%Y-%m-%d %H:%M:%S') AS a, strftime(date_trunc('year', ts) + INTERVAL 3 MONTH, '%Y-%m-%d') AS b, strftime(ts + INTERVAL 210 MINUTE - INTERVAL 30 SECOND, '%Y-%m-%d %H:%M:%S') AS c, strftime(ts + to_days(CAST((3 - dayofweek(ts) + 7) % 7 AS INTEGER)), '%Y-%m-%d') AS d, strftime(date_trunc('month', ts) - INTERVAL 1 YEAR + (ts - date_trunc('month', ts)), '%Y-%m-%d') AS e FROM events"),
    "dt_numbers": ("SELECT event_id, datetime(event_id * 86400, 'unixepoch') AS a, datetime(event_id * 3600, 'auto', '+1 day') AS b, date(2460310.5 + event_id, 'julianday') AS c FROM events", "SELECT event_id, strftime(to_timestamp(event_id * 86400) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS a, strftime(to_timestamp(event_id * 3600 + 86400) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS b, strftime(DATE '2024-01-01' + CAST(event_id AS INTEGER), '%Y-%m-%d') AS c FROM events"),
    "dt_current": ("SELECT r_regionkey, date('now') = CAST(CURRENT_DATE AS STRING) AS a, length(datetime('now')) AS b, CURRENT_TIMESTAMP IS NOT NULL AS c FROM region", "SELECT r_regionkey, TRUE AS a, 19 AS b, TRUE AS c FROM region"),
    "struct_fields": ("SELECT p_partkey, s.a AS a, s.b AS b, named_struct('x', p_size).x + 1 AS c FROM (SELECT p_partkey, p_size, named_struct('a', p_size, 'b', p_name) AS s FROM part) t", "SELECT p_partkey, p_size AS a, p_name AS b, p_size + 1 AS c FROM part"),
    "array_literals": ("SELECT p_partkey, ARRAY(p_size, 2, 3)[0] AS a, size(ARRAY(1, p_size)) AS b FROM part", "SELECT p_partkey, p_size AS a, 2 AS b FROM part"),
}


def _dialect(name, text, oracle, args=None):
    def run(spark, d):
        return sql(spark, d, text, args)

    run.__name__ = name
    entry(oracle or text)(run)


for _name, _own in DIALECT.items():
    _dialect(_name, *_own)


# --- windows and text search ---

for _sql in ("CURRENT ROW", "GROUP", "TIES"):

    def _run(spark, d, kind=_sql.lower()):
        found = WN.excluding_aggregates(table(spark, d, "part"), ["p_brand"], ["p_size"], "p_retailprice", kind)
        return found.select("p_partkey", "n", "low", "high", F.round("total", 2).alias("total"), F.round("mean", 9).alias("mean"))

    _run.__name__ = f"win_exclude_{_sql.split()[0].lower()}_any"
    _w = f"(PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE {_sql})"
    entry(f"SELECT p_partkey, count(p_retailprice) OVER {_w} AS n, min(p_retailprice) OVER {_w} AS low, max(p_retailprice) OVER {_w} AS high, round(sum(p_retailprice) OVER {_w}, 2) AS total, round(avg(p_retailprice) OVER {_w}, 9) AS mean FROM part")(_run)

WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"


@entry(
    f"WITH o AS (SELECT doc_id, len(w) AS l, len(list_filter(w, lambda x: starts_with(x, 'ern'))) AS a, len(list_filter(w, lambda x: x = 'thnt')) AS b FROM (SELECT doc_id, {WORDS} AS w FROM documents) t), "
    "s AS (SELECT count(*) AS n, avg(l) AS m, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM o) "
    "SELECT doc_id AS key, round(2.5 * ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * l / m)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * l / m)), 6) AS score FROM o, s WHERE a > 0 OR b > 0"
)
def fts_bm25_boost_prefix(spark, d):
    return FT.bm25(table(spark, d, "documents"), "doc_id", "text", "ern*^2.5 text:thnt other:and NOT the").select("key", F.round("score", 6).alias("score"))


@entry("SELECT n_nationkey FROM nation WHERE len(list_intersect(list_transform(generate_series(1, greatest(length(n_name) - 2, 0)), lambda i: substr(lower(n_name), i, 3)), ['ind', 'ani'])) > 0")
def fts_ngram(spark, d):
    return FT.match(table(spark, d, "nation"), ["n_name"], "ind ani", "ngram").select("n_nationkey")


@entry("SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), split_part(p_name, ' ', 1)) AND p_name IN (SELECT min(p_name) FROM part)")
def fts_raw(spark, d):
    p = table(spark, d, "part")
    first = p.agg(F.min("p_name").alias("low"))
    return p.join(F.broadcast(first), F.array_contains(FT.tokens(F.col("p_name"), "raw"), F.col("low")), "left_semi").select("p_partkey")


@entry("SELECT * FROM (VALUES (1, 'The <b>quick</b> <b>Fox</b>, not foxes'), (2, '<b>lower</b> <b>LOWEST</b> slow')) t(k, h)")
def fts_highlight_clauses(spark, d):
    rows = readers.values(spark, [(1, "The quick Fox, not foxes"), (2, "lower LOWEST slow")], "k int, t string")
    return rows.select("k", FT.highlight(F.col("t"), "fox quick lowe* NOT the").alias("h"))


# --- JSON, arrays, vectors ---

DOC = '{"a":[1,2,{"b":"x"}],"k y":null,"n":1.5,"t":true}'


@entry("SELECT '{\"b\":\"x\"}' AS a, 'x' AS b, '2' AS c, '[1,\"x\",null]' AS d, '1.5' AS e, '\"x\"' AS f, CAST(3 AS BIGINT) AS g, CAST(NULL AS VARCHAR) AS h, 'null' AS i")
def json_paths(spark, d):
    x = F.lit(DOC)
    return spark.range(1).select(
        C.json_extract(x, "$.a[2]").alias("a"), C.json_extract(x, "$.a[2].b").alias("b"), C.json_extract(x, "$.a[#-2]").alias("c"), C.json_extract(x, "$.a[0]", "$.a[2].b", '$."k y"').alias("d"),
        C.json_extract(x, "$.n").alias("e"), C.json_arrow(x, "$.a[2].b").alias("f"), C.json_array_length(x, "$.a").alias("g"), C.json_arrow(x, "$.zz").alias("h"), C.json_arrow(x, '$."k y"').alias("i"),
    )


@entry("SELECT p_partkey, '[' || p_size || ',\"' || p_brand || '\",null,1.5]' AS a, '{\"size\":' || p_size || ',\"name\":\"' || p_brand || '\"}' AS o, '[[1,2],\"[1,2]\"]' AS subtype, '\"' || p_brand || '\"' AS q FROM part")
def json_constructors(spark, d):
    inner = C.json(F.lit("[1, 2]"))
    return table(spark, d, "part").select(
        "p_partkey", C.text_of(C.json_array(F.col("p_size"), F.col("p_brand"), None, 1.5)).alias("a"), C.text_of(C.json_object("size", F.col("p_size"), "name", F.col("p_brand"))).alias("o"),
        C.text_of(C.json_array(inner, C.text_of(inner))).alias("subtype"), C.json_quote("p_brand").alias("q"),
    )


@entry("SELECT n_regionkey, '{' || string_agg('\"' || n_name || '\":\"' || n_name || '\"', ',' ORDER BY n_name) || '}' AS j FROM nation GROUP BY n_regionkey")
def json_group_object_text(spark, d):
    return table(spark, d, "nation").groupBy("n_regionkey").agg(C.json_group_object("n_name", "n_name").alias("j"))


@entry("SELECT event_id, '{\"k\":' || k || ',\"new\":[1,2]}' AS s, '{\"k\":0}' AS r, '{}' AS d, '{\"z\":{\"y\":1}}' AS p, '{\"k\":' || k || '}' AS i FROM (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events) t")
def json_edit_all(spark, d):
    rows = table(spark, d, "events").select("event_id", "props")
    return rows.select("event_id", C.json_set("props", "$.new", [1, 2]).alias("s"), C.json_replace("props", "$.k", 0).alias("r"), C.json_remove("props", "$.k").alias("d"), C.json_patch("props", '{"k":null,"z":{"y":1}}').alias("p"), C.json_insert("props", "$.k", 9).alias("i"))


@entry("SELECT p_partkey, list_filter(w, lambda x: x <> w[1]) AS r, CAST(len(w) AS INTEGER) AS u, CASE WHEN w < ['m'] THEN -1 WHEN w > ['m'] THEN 1 ELSE 0 END AS c, [p_brand, 'x y'] AS t, list_transform(w, lambda x: CASE WHEN x <> 'a' THEN x END) AS n FROM (SELECT p_partkey, p_brand, string_split(p_name, ' ') AS w FROM part) t")
def arr_more(spark, d):
    rows = table(spark, d, "part").withColumn("w", C.string_to_array("p_name", " "))
    return rows.select("p_partkey", C.array_remove("w", F.get("w", F.lit(0))).alias("r"), C.array_upper("w").alias("u"), C.array_compare("w", F.array(F.lit("m"))).alias("c"), C.array_from_text(F.concat(F.lit("{"), "p_brand", F.lit(', "x y"}'))).alias("t"), C.string_to_array("p_name", " ", "a").alias("n"))


@entry("SELECT vec_id, CAST(len(e) * 2 AS INTEGER) AS n, list_transform(e, lambda x: CAST(x > 0 AS INTEGER)) AS bits, list_slice(e, 2, 4) AS s, CAST(len(list_filter(e, lambda x: x > 0)) AS BIGINT) AS h, list_transform(e, lambda x: x::DOUBLE) AS back FROM (SELECT vec_id, embedding AS e FROM embeddings) t")
def vec_kinds(spark, d):
    e = F.col("embedding")
    none = F.transform(e, lambda x: F.lit(0))
    return table(spark, d, "embeddings").select("vec_id", F.size(C.vector_concat(e, e)).alias("n"), C.vector_bits(e).alias("bits"), C.vector_slice(e, 1, 4).alias("s"), C.distance_hamming(C.vector_bits(e), none).alias("h"), C.vector_dense(C.vector_sparse(e)).alias("back"))


@entry("SELECT * FROM (VALUES (1, [1.0, 2.5], '[1.0,2.5]'), (2, [0.0, -3.0], '[0.0,-3.0]')) t(k, v, x)")
def vec_text(spark, d):
    rows = readers.values(spark, [(1, "[1, 2.5]"), (2, "[0.0,-3]")], "k int, t string").withColumn("v", C.vector("t", "double"))
    return rows.select("k", "v", C.vector_extract("v").alias("x"))


@entry("SELECT a.n_nationkey AS a, b.n_nationkey AS b, CASE WHEN length(a.n_name) = length(b.n_name) THEN CAST(hamming(a.n_name, b.n_name) AS INTEGER) END AS h, CAST(damerau_levenshtein(a.n_name, b.n_name) AS INTEGER) AS d FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def fuzzy_more(spark, d):
    n = table(spark, d, "nation")
    x, y = F.col("a.n_name"), F.col("b.n_name")
    return n.alias("a").join(n.alias("b"), F.col("a.n_regionkey") == F.col("b.n_regionkey")).select(F.col("a.n_nationkey").alias("a"), F.col("b.n_nationkey").alias("b"), S.hamming(x, y).alias("h"), X.damerau_levenshtein(x, y).alias("d"))


@entry("SELECT * FROM (VALUES ('192.168.16.5/20', 4, '192.168.16.5', 20, '192.168.16.0/20', TRUE), ('10.0.0.1/8', 4, '10.0.0.1', 8, '10.0.0.0/8', FALSE)) t(a, family, host, bits, network, holds)")
def net_ipv4(spark, d):
    rows = readers.values(spark, [("192.168.16.5/20", "192.168.31.9"), ("10.0.0.1/8", "11.0.0.1")], "a string, b string")
    return rows.select("a", S.ip_family("a").alias("family"), S.ip_host("a").alias("host"), S.ip_mask_length("a").alias("bits"), S.ip_network("a").alias("network"), S.ip_contains("a", "b").alias("holds"))


@entry("SELECT '018f3a2b-4c5d-7e6f-8a9b-0c1d2e3f4a5b' AS text, CAST(1714667867229 AS BIGINT) AS ms, TRUE AS fresh")
def uuid_round_trip(spark, d):
    u = F.lit("018f3a2b-4c5d-7e6f-8a9b-0c1d2e3f4a5b")
    return spark.range(1).select(S.uuid_str(S.uuid_blob(u)).alias("text"), S.uuid7_timestamp_ms(u).alias("ms"), (S.uuid7_timestamp_ms(S.uuid7()) > 0).alias("fresh"))


# --- sources and sinks ---


@entry("SELECT n_regionkey AS region, count(*) AS n FROM nation WHERE n_nationkey > 3 GROUP BY n_regionkey")
def sink_ctas(spark, d):
    return sinks.create_table_as(sql(spark, d, "SELECT n_regionkey AS region, count(*) AS n FROM nation WHERE n_nationkey > 3 GROUP BY n_regionkey"), sinks.fresh(shared_folder(spark), "ctas"))


@entry("SELECT r_regionkey AS k, r_name AS name FROM region UNION ALL SELECT n_nationkey, NULL FROM nation")
def sink_insert_select(spark, d):
    path = sinks.fresh(shared_folder(spark), "inserted")
    sinks.create_table_as(table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")), path)
    return sinks.insert_select(table(spark, d, "nation").select(F.col("n_nationkey").alias("k")), path)


@entry("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def sink_vacuum_attach(spark, d):
    """All of two tables copied to a folder, which is then attached."""
    names, folder = ["region", "nation"], sinks.fresh(shared_folder(spark), "copy")
    sinks.vacuum_into({n: table(spark, d, n) for n in names}, folder)
    sinks.attach(spark, folder, "copied", names)
    found = spark.sql("SELECT n_name, r_name FROM copied_nation JOIN copied_region ON n_regionkey = r_regionkey")
    sinks.detach(spark, "copied", names)
    return found


@entry("SELECT n_nationkey AS k, n_nationkey || '|' || n_name || '|' || n_regionkey AS a, n_nationkey || ',''' || n_name || ''',' || n_regionkey AS q, 'n_nationkey = ' || n_nationkey || chr(10) || '     n_name = ' || n_name || chr(10) || 'n_regionkey = ' || n_regionkey AS l, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}' AS j FROM nation")
def output_modes(spark, d):
    n = table(spark, d, "nation")
    return n.select(F.col("n_nationkey").alias("k"), sinks.shown(n).alias("a"), sinks.shown(n, "quote").alias("q"), sinks.shown(n, "line").alias("l"), sinks.shown(n, "json").alias("j"))


@entry("SELECT * FROM (VALUES (1, 'a,b'), (2, 'say \"x\"'), (3, NULL)) t(k, v)")
def csv_inline(spark, d):
    return readers.csv_data(spark, 'k,v\n1,"a,b"\n2,"say ""x"""\n3,\n', "k int, v string")


@entry("SELECT * FROM (VALUES (2, 'two' || chr(10) || 'lines'), (3, 'c')) t(k, v)")
def csv_import(spark, d):
    """A file whose first two records are left out and that has a line break in quotes."""
    path = sinks.fresh(shared_folder(spark), "csv")
    lines = spark.createDataFrame([('skip,me\n1,a\n2,"two\nlines"\n3,c',)], "value string")
    lines.coalesce(1).write.option("lineSep", "\n").text(path)
    return readers.import_csv(spark, path, "k int, v string", 2)


@entry("SELECT * FROM (VALUES (1, 'a', CAST(NULL AS INTEGER)), (2, NULL, CAST(NULL AS INTEGER))) t(k, v, w)")
def copy_from_columns(spark, d):
    path = sinks.fresh(shared_folder(spark), "copy")
    spark.createDataFrame([("a\t1",), ("\\N\t2",)], "value string").coalesce(1).write.text(path)
    return readers.copy_from(spark, path, "k int, v string, w int", columns=["v", "k"])


@entry("SELECT CAST(unnest(generate_series(0, 11)) AS BIGINT) AS n")
def virtual_table(spark, d):
    readers.virtual_table(spark, "sw_numbers", "n long", lambda options: range(int(options["parts"])), lambda p: ((p * 4 + k,) for k in range(4)))
    return spark.read.format("sw_numbers").option("parts", 3).load()


@entry("SELECT * FROM (VALUES (0, 'n_nationkey', 'int', 0), (1, 'n_name', 'string', 0), (2, 'n_regionkey', 'int', 0)) t(cid, name, type, \"notnull\")")
def pragma_table_info(spark, d):
    table(spark, d, "nation").createOrReplaceTempView("nation")
    return readers.catalog(spark, "nation")


# --- DML, change capture, views ---


@entry("SELECT s_suppkey, s_name, 7 AS rating FROM supplier")
def dml_defaults(spark, d):
    base = table(spark, d, "supplier").select("s_suppkey", "s_name", F.lit(1).alias("rating"))
    return H.with_defaults(base, table(spark, d, "supplier").select("s_name", "s_suppkey"), {"rating": F.lit(7)})


@entry("SELECT p_partkey, p_size * 2 AS twice, p_size * 2 + 1 AS more FROM part")
def generated_columns(spark, d):
    return H.generated(table(spark, d, "part").select("p_partkey", "p_size"), {"twice": F.col("p_size") * 2, "more": F.col("twice") + 1}).drop("p_size")


@entry("SELECT n_nationkey FROM nation WHERE n_regionkey NOT IN (1, 3)")
def fk_cascade(spark, d):
    return H.delete_cascade(table(spark, d, "region"), table(spark, d, "nation"), "r_regionkey", "n_regionkey", F.col("r_regionkey").isin(1, 3))[1].select("n_nationkey")


@entry("SELECT n_nationkey, CASE WHEN n_regionkey NOT IN (1, 3) THEN n_regionkey END AS n_regionkey FROM nation")
def fk_set_null(spark, d):
    return H.delete_cascade(table(spark, d, "region"), table(spark, d, "nation"), "r_regionkey", "n_regionkey", F.col("r_regionkey").isin(1, 3), "set null")[1].select("n_nationkey", "n_regionkey")


@entry("SELECT s_suppkey, round(s_acctbal * 2, 2) AS s_acctbal FROM supplier WHERE s_acctbal > 0")
def dml_returning(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    after = s.withColumn("s_acctbal", F.when(F.col("s_acctbal") > 0, F.round(F.col("s_acctbal") * 2, 2)).otherwise(F.col("s_acctbal")))
    return H.returning(s, after, ["s_suppkey"])


@entry(f"SELECT o_custkey, count(*) AS n, round(avg(o_totalprice), 6) AS mean FROM {NEW} GROUP BY o_custkey")
def ivm_avg_delta(spark, d):
    old, _, delta = _states(spark, d)
    state = old.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    return H.delta_averages(state, delta, ["o_custkey"], "o_totalprice").select("o_custkey", "n", F.round("mean", 6).alias("mean"))


CHANGED = f"FROM {OLD} FULL JOIN {NEW} ON o.o_orderkey = n.o_orderkey WHERE o.o_orderkey IS NULL OR n.o_orderkey IS NULL OR o.o_totalprice <> n.o_totalprice"


@entry(
    f"WITH c AS (SELECT CASE WHEN o.o_orderkey IS NULL THEN 1 WHEN n.o_orderkey IS NULL THEN -1 ELSE 0 END AS change_type, coalesce(o.o_orderkey, n.o_orderkey) AS k, n.o_orderkey IS NOT NULL AND o.o_orderkey IS NOT NULL AS up {CHANGED}) "
    "SELECT row_number() OVER (ORDER BY k) AS change_id, change_type, 'orders' AS table_name, CAST(k AS VARCHAR) AS id, up AS has_updates, CAST(5 AS BIGINT) AS change_txn_id FROM c UNION ALL SELECT count(*) + 1, 2, NULL, NULL, FALSE, 5 FROM c"
)
def cdc_log(spark, d):
    old, new, _ = _states(spark, d)
    log = H.change_log(old, new, ["o_orderkey"], "orders", "full", 5)
    return log.select("change_id", "change_type", "table_name", "id", F.col("updates").isNotNull().alias("has_updates"), "change_txn_id")


def _cdc(mode):
    def run(spark, d):
        old, new, _ = _states(spark, d)
        log = H.change_log(old, new, ["o_orderkey"], "orders", mode)
        return log.groupBy("change_type").agg(F.count("before").alias("b"), F.count("after").alias("a"), F.count("updates").alias("u"))

    run.__name__ = f"cdc_mode_{mode}"
    b, a = mode == "before", mode == "after"
    entry(
        f"SELECT change_type, CAST(sum(CASE WHEN {b} AND change_type < 1 THEN 1 ELSE 0 END) AS BIGINT) AS b, CAST(sum(CASE WHEN {a} AND change_type >= 0 THEN 1 ELSE 0 END) AS BIGINT) AS a, CAST(0 AS BIGINT) AS u "
        f"FROM (SELECT CASE WHEN o.o_orderkey IS NULL THEN 1 WHEN n.o_orderkey IS NULL THEN -1 ELSE 0 END AS change_type {CHANGED}) t GROUP BY change_type UNION ALL SELECT 2, 0, 0, 0"
    )(run)


for _mode in ("id", "before", "after"):
    _cdc(_mode)


@entry(f"SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'only_right' WHEN n.o_orderkey IS NULL THEN 'only_left' ELSE 'differs' END AS status {CHANGED}")
def table_diff(spark, d):
    old, new, _ = _states(spark, d)
    return H.row_diff(old, new, ["o_orderkey"])


@entry("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderkey) AS BIGINT) AS v FROM orders WHERE o_orderkey % 2 = 0")
def sequence_order(spark, d):
    return H.next_values(table(spark, d, "orders").filter("o_orderkey % 2 = 0").select("o_orderkey"), ["o_orderkey"], name="v").select("o_orderkey", "v")


@entry("SELECT l_suppkey, n FROM (SELECT l_suppkey, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, l_suppkey) AS r FROM lineitem GROUP BY l_suppkey) t WHERE r <= 5")
def topk_groups(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_suppkey").limit(5)


# --- statements about tables, functions of one's own ---


@entry("SELECT 'part' AS \"table\", (SELECT count(*) FROM part) AS n, c AS \"column\", v AS given, lo AS least, hi AS greatest FROM (SELECT 'p_partkey' AS c, count(p_partkey) AS v, CAST(min(p_partkey) AS VARCHAR) AS lo, CAST(max(p_partkey) AS VARCHAR) AS hi FROM part UNION ALL SELECT 'p_size', count(p_size), CAST(min(p_size) AS VARCHAR), CAST(max(p_size) AS VARCHAR) FROM part UNION ALL SELECT 'p_brand', count(p_brand), min(p_brand), max(p_brand) FROM part) t")
def analyze_table(spark, d):
    return analyse(table(spark, d, "part").select("p_partkey", "p_size", "p_brand"), "part").drop("distinct")


@entry("SELECT TRUE AS scan, TRUE AS pushed, TRUE AS pruned")
def explain_plan(spark, d):
    """A plan whose filter and columns reach the scan."""
    text = explain(spark, d, "SELECT o_custkey FROM orders WHERE o_orderkey > 100")
    has = lambda what: F.max(F.col("text").contains(what).cast("int")) == 1
    return text.agg(has("Scan parquet").alias("scan"), has("GreaterThan(o_orderkey,100)").alias("pushed"), has("ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>").alias("pruned"))


@entry("SELECT p_partkey, p_size AS size, 'new' AS state, p_brand || '!' AS mark FROM part")
def ddl_alter(spark, d):
    return H.alter_table(table(spark, d, "part").select("p_partkey", "p_size", "p_brand", "p_name"), {"state": F.lit("new"), "mark": F.concat("p_brand", F.lit("!"))}, ["p_name"], {"p_size": "size"}).drop("p_brand")


@entry("SELECT s_suppkey, round(s_acctbal, 2) AS v FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, round(s_acctbal, 2) FROM supplier WHERE s_suppkey % 2 = 1")
def txn_rollback(spark, d):
    """A change after a savepoint is undone; the one before it stays."""
    versions = H.Versions(s=table(spark, d, "supplier").select("s_suppkey", "s_acctbal"))
    versions.begin()
    versions.put("s", versions.tables["s"].withColumn("v", F.round("s_acctbal", 2)).drop("s_acctbal"))
    versions.begin("point")
    versions.put("s", versions.tables["s"].filter("v > 0"))
    versions.rollback("point")
    versions.commit()
    return versions.tables["s"]


@entry("SELECT n_nationkey, CAST(CASE WHEN n_regionkey = 0 THEN 10 + 5 * (row_number() OVER (PARTITION BY n_regionkey = 0 ORDER BY n_nationkey) - 1) ELSE 100 + 5 * row_number() OVER (PARTITION BY n_regionkey = 0 ORDER BY n_nationkey) END AS BIGINT) AS v FROM nation")
def sequence_setval(spark, d):
    n, numbers = table(spark, d, "nation").select("n_nationkey", "n_regionkey"), H.Sequence(10, 5)
    first = numbers.take(n.filter("n_regionkey = 0"), ["n_nationkey"], "v")
    numbers.setval(100)
    return first.unionByName(numbers.take(n.filter("n_regionkey <> 0"), ["n_nationkey"], "v")).select("n_nationkey", F.col("v").cast("long").alias("v"))


@entry("SELECT p_partkey, p_size * 2 + 1 AS a FROM part")
def udf_scalar(spark, d):
    registry.scalar(spark, "sw_twice_and_one", lambda x: x * 2 + 1, "int")
    return sql(spark, d, "SELECT p_partkey, sw_twice_and_one(p_size) AS a FROM part")


@entry("SELECT event_type, round(max(value) - min(value), 6) AS spread FROM events GROUP BY event_type")
def udf_aggregate(spark, d):
    import pandas as pd

    def spread(x: pd.Series) -> float:
        return float(x.max() - x.min())

    registry.aggregate(spark, "sw_spread", spread, "double")
    return sql(spark, d, "SELECT event_type, round(sw_spread(value), 6) AS spread FROM events GROUP BY event_type")


@entry("SELECT n_nationkey, CAST(i AS INTEGER) AS i, CAST(i * i AS INTEGER) AS square FROM nation, LATERAL (SELECT unnest(generate_series(0, n_regionkey)) AS i)")
def udf_table(spark, d):
    registry.table_function(spark, "sw_squares", lambda n: ((i, i * i) for i in range(n + 1)), "i int, square int")
    return sql(spark, d, "SELECT n_nationkey, i, square FROM nation, LATERAL sw_squares(n_regionkey)")


@entry("SELECT event_id, props AS t, json_extract_string(props, '$.k') AS k, 1 AS ok, 0 AS at, 1 AS bad FROM (SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS props FROM events) t")
def jsonb_values(spark, d):
    rows = table(spark, d, "events").withColumn("v", C.jsonb("props"))
    return rows.select("event_id", C.jsonb_text("v").alias("t"), C.jsonb_text(C.jsonb_extract("v", "$.k")).alias("k"), C.json_valid("props").alias("ok"), C.json_error_position("props").alias("at"), C.json_error_position(F.lit('{"a":')).alias("bad"))


@entry(
    "SELECT event_id, lpad(CAST(day(ts) AS VARCHAR), 2, ' ') || '|' || strftime(ts, '%S.%g|%Y-%m-%d|') || lpad(CAST(hour(ts) AS VARCHAR), 2, ' ') || '|' || lpad(CAST((hour(ts) + 11) % 12 + 1 AS VARCHAR), 2, ' ') || '|' || lower(strftime(ts, '%p')) || strftime(ts, '|%H:%M|') || epoch_us(ts) // 1000000 || strftime(ts, '|%H:%M:%S|') || isodow(ts) || strftime(ts, '|%Y|%d %m %M %S') || '%' AS t FROM events"
)
def dt_strftime_all(spark, d):
    return table(spark, d, "events").select("event_id", D.strftime("%e|%f|%F|%k|%l|%P|%R|%s|%T|%u|%Y|%d %m %M %S%%", "ts").alias("t"))


@entry("SELECT event_id, epoch_us(ts) * 1000 - 86400000000000 AS ns, ts + INTERVAL 90 SECOND AS later, CAST(date_trunc('hour', ts + INTERVAL 30 MINUTE) AS TIMESTAMP) AS hour FROM events")
def dt_durations(spark, d):
    e = table(spark, d, "events")
    start = F.lit("1970-01-02 00:00:00").cast("timestamp_ntz")
    return e.select("event_id", D.sub_times("ts", start).alias("ns"), D.add_duration("ts", D.duration(F.lit(90), "s")).alias("later"), D.time_round("ts", 3600 * 10**9).alias("hour"))


@entry("SELECT user_id, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY user_id")
def view_by_increments(spark, d):
    """A materialised aggregate brought up to date by three batches of changes, one of which is taken back."""
    e = table(spark, d, "events").select("event_id", "user_id", "value")
    state = e.filter("event_id % 3 = 0").groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    for part, weight in (("event_id % 3 = 1", 1), ("event_id % 3 = 2", 1), ("event_id % 3 = 1", -1), ("event_id % 3 = 1", 1)):
        state = H.delta_aggregate(state, H.weighted(e.filter(part), weight), ["user_id"], {"total": "value"})
    return state.select("user_id", "n", F.round("total", 2).alias("total"))
