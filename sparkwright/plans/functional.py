"""Queries that exercise the library's functions and operators, each with DuckDB's SQL for the same rows where there is one."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import collections as C
from ..functions import scalar as S
from ..functions import temporal as D
from ..operators import changes as H
from ..operators import fulltext as FT
from ..operators import recursion as R
from ..operators import triggers as T
from ..operators import windows as WN
from ..session import table
from ..sources import readers

ENTRIES: dict = {}


def entry(oracle: str | None = None):
    def keep(f):
        ENTRIES[f.__name__] = (f, oracle)
        return f

    return keep


# --- windows ---


@entry("SELECT p_partkey, count(*) OVER w AS n, CAST(sum(p_size) OVER w AS BIGINT) AS s FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 2 FOLLOWING)")
def win_groups_frame(spark, d):
    return WN.groups_frame(table(spark, d, "part"), ["p_brand"], ["p_size"], 1, 2, n=F.count("*"), s=F.sum("p_size")).select("p_partkey", "n", "s")


def _exclude(name, sql):
    def run(spark, d):
        return WN.excluding(table(spark, d, "part"), ["p_brand"], ["p_size"], "p_size", name).select("p_partkey", "n", F.col("total").cast("long").alias("total"))

    run.__name__ = f"win_exclude_{name.split()[0]}"
    entry(f"SELECT p_partkey, count(p_size) OVER w AS n, CAST(sum(p_size) OVER w AS BIGINT) AS total FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE {sql})")(run)


_exclude("current row", "CURRENT ROW")
_exclude("group", "GROUP")
_exclude("ties", "TIES")
_exclude("no others", "NO OTHERS")


@entry("SELECT event_id, count(*) OVER w AS n, round(sum(value) OVER w, 4) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW)")
def win_exclude_rows_frame(spark, d):
    return WN.excluding(table(spark, d, "events"), ["user_id"], ["event_id"], "value", "current row", (-2, 2)).select("event_id", "n", F.round("total", 4).alias("total"))


@entry("SELECT event_id, CAST(CASE WHEN r < (c % k) * (c // k + 1) THEN r // (c // k + 1) ELSE (c % k) + (r - (c % k) * (c // k + 1)) // greatest(c // k, 1) END + 1 AS BIGINT) AS tile FROM (SELECT event_id, user_id % 3 + 2 AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS r, count(*) OVER (PARTITION BY user_id) AS c FROM events) t")
def win_ntile_per_row(spark, d):
    rows = table(spark, d, "events").withColumn("k", F.col("user_id") % 3 + 2)
    return WN.ntile_by_row(rows, ["user_id"], ["event_id"], "k").select("event_id", F.col("tile").cast("long").alias("tile"))


# --- aggregates ---


@entry("SELECT n_regionkey, list(CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_name END ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey")
def agg_array_agg_nulls(spark, d):
    return table(spark, d, "nation").groupBy("n_regionkey").agg(C.array_agg(F.when(F.col("n_nationkey") % 4 != 0, F.col("n_name")), "n_nationkey").alias("names"))


@entry("SELECT n_regionkey, '[' || string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey) || ']' AS j FROM nation GROUP BY n_regionkey")
def agg_json_group_array(spark, d):
    return table(spark, d, "nation").groupBy("n_regionkey").agg(C.json_group_array("n_nationkey", "n_nationkey").alias("j"))


@entry("SELECT n_regionkey, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_name) || '}' AS j FROM nation GROUP BY n_regionkey")
def agg_json_group_object(spark, d):
    return table(spark, d, "nation").groupBy("n_regionkey").agg(C.json_group_object("n_name", "n_nationkey").alias("j"))


@entry("SELECT n_regionkey, min(n_name) FILTER (WHERE r = CAST(ceil(0.5 * c) AS BIGINT)) AS middle FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS r, count(*) OVER (PARTITION BY n_regionkey) AS c FROM nation) t GROUP BY n_regionkey")
def agg_percentile_disc_text(spark, d):
    by = Window.partitionBy("n_regionkey")
    rows = table(spark, d, "nation").withColumn("r", F.row_number().over(by.orderBy("n_name"))).withColumn("c", F.count("*").over(by))
    return rows.filter(F.col("r") == F.ceil(F.col("c") * 0.5)).select("n_regionkey", F.col("n_name").alias("middle"))


@entry("SELECT event_type, round(exp(avg(ln(value + 1))), 6) AS g FROM events GROUP BY event_type")
def agg_user_defined(spark, d):
    """A grouped-aggregate Arrow UDF: a geometric mean of value + 1."""
    import numpy as np
    import pandas as pd

    @F.pandas_udf("double")
    def geometric(x: pd.Series) -> float:
        return float(np.exp(np.log(x + 1).mean()))

    return table(spark, d, "events").groupBy("event_type").agg(F.round(geometric("value"), 6).alias("g"))


# --- strings and numbers ---


@entry("SELECT p_partkey, lpad(p_brand, 12, '*') AS l, rpad(p_brand, 12, '-') AS r, trim(p_brand, 'Bd#') AS t, ltrim(p_name, 'aeiou') AS lt FROM part")
def str_pad_trim(spark, d):
    return table(spark, d, "part").select("p_partkey", S.pad("p_brand", 12, "*", True).alias("l"), S.pad("p_brand", 12, "-", False).alias("r"), S.trim("p_brand", "Bd#").alias("t"), S.trim("p_name", "aeiou", "left").alias("lt"))


@entry("SELECT p_partkey, substr(p_name, 2, 4) AS a, substr(p_name, 1, 2) AS b, right(p_name, 3) AS c, instr(p_name, 'a') AS i FROM part")
def str_substr_instr(spark, d):
    return table(spark, d, "part").select("p_partkey", S.substr("p_name", 2, 4).alias("a"), S.substr("p_name", 0, 3).alias("b"), S.substr("p_name", -3).alias("c"), F.instr("p_name", "a").cast("long").alias("i"))


@entry("SELECT c_custkey, concat('<', x, '>') AS a, '<' || x || '>' AS b, concat_ws('/', c_mktsegment, x) AS w FROM (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS x FROM customer) t")
def str_concat_null(spark, d):
    x = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", S.concat(F.lit("<"), x, F.lit(">")).alias("a"), F.concat(F.lit("<"), x, F.lit(">")).alias("b"), F.concat_ws("/", "c_mktsegment", x).alias("w"))


@entry("SELECT p_partkey, hex(p_brand) AS h, '''' || replace(p_name, '''', '''''') || '''' AS q, reverse(p_name) AS r, replace(p_name, 'e', 'EE') AS e, upper(p_name) AS u, unicode(p_name) AS c FROM part")
def str_hex_quote(spark, d):
    return table(spark, d, "part").select("p_partkey", F.hex("p_brand").alias("h"), S.quote("p_name").alias("q"), F.reverse("p_name").alias("r"), F.replace("p_name", F.lit("e"), F.lit("EE")).alias("e"), F.upper("p_name").alias("u"), S.unicode("p_name").cast("int").alias("c"))


@entry("SELECT p_partkey, printf('%05d|%.2f|%s|%x', p_partkey, p_retailprice, p_brand, p_partkey) AS f FROM part")
def str_format(spark, d):
    return table(spark, d, "part").select("p_partkey", F.format_string("%05d|%.2f|%s|%x", "p_partkey", "p_retailprice", "p_brand", "p_partkey").alias("f"))


@entry("SELECT n_nationkey, ord(n_name[1]) AS b, 'Z' || n_name[2:] AS z, 'Hé€' AS c, '000000' AS zero FROM nation")
def str_soundex_blob(spark, d):
    return table(spark, d, "nation").select("n_nationkey", S.get_byte(F.encode("n_name", "UTF-8"), 0).alias("b"), F.decode(S.set_byte(F.encode("n_name", "UTF-8"), 0, 90), "UTF-8").alias("z"), S.char(72, 233, 8364).alias("c"), F.hex(S.zeroblob(3)).alias("zero"))


@entry("SELECT p_partkey, p_name FROM part WHERE p_name GLOB '*[a-c]?e*'")
def filter_glob(spark, d):
    return table(spark, d, "part").filter(S.glob("*[a-c]?e*", "p_name")).select("p_partkey", "p_name")


@entry("SELECT x, coalesce(try_cast(regexp_extract(x, '^\\s*([+-]?[0-9]+)', 1) AS BIGINT), 0) AS i, coalesce(try_cast(regexp_extract(x, '^\\s*([+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?)', 1) AS DOUBLE), 0.0) AS r FROM (VALUES ('12abc'), ('1e3'), (''), ('-7.5x'), ('abc'), ('  8')) t(x)")
def cast_prefix(spark, d):
    rows = readers.values(spark, [(v,) for v in ("12abc", "1e3", "", "-7.5x", "abc", "  8")], "x string")
    return rows.select("x", S.to_integer("x").alias("i"), S.to_real("x").alias("r"))


@entry("SELECT a.n_nationkey AS a, b.n_nationkey AS b, round(jaro_winkler_similarity(a.n_name, b.n_name), 6) AS s FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def fuzzy_jaro(spark, d):
    n = table(spark, d, "nation")
    return n.alias("a").join(n.alias("b"), F.col("a.n_regionkey") == F.col("b.n_regionkey")).select(F.col("a.n_nationkey").alias("a"), F.col("b.n_nationkey").alias("b"), F.round(S.jaro_winkler(F.col("a.n_name"), F.col("b.n_name")), 6).alias("s"))


@entry("SELECT p_partkey, p_partkey & p_size AS a, p_partkey | p_size AS o, ~p_partkey AS n, CASE WHEN p_size >= 64 THEN 0 ELSE (p_partkey % 8) << p_size END AS l, p_partkey >> 2 AS r FROM part")
def num_bitwise(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", k.bitwiseAND(F.col("p_size")).alias("a"), k.bitwiseOR(F.col("p_size")).alias("o"), F.bitwise_not(k).alias("n"), S.shift_left(k % 8, "p_size").alias("l"), S.shift_right(k, 2).alias("r"))


@entry("SELECT p_partkey, round(p_retailprice, 1) AS r, CAST(sign(p_size - 20) AS BIGINT) AS s, abs(p_size - 20) AS a, CASE WHEN p_size % 2 = 0 THEN NULL ELSE greatest(p_size, 10) END AS g, CAST(trunc((p_size - 20) / 7) AS DOUBLE) AS t FROM part")
def num_round(spark, d):
    p = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", S.round_half_up("p_retailprice", 1).alias("r"), S.sign(p - 20).alias("s"), F.abs(p - 20).alias("a"), S.largest(F.when(p % 2 != 0, p), 10).alias("g"), S.trunc((p - 20) / 7).alias("t"))


@entry("SELECT p_partkey, round(sin(p_size), 9) AS s, round(atan2(p_size, 3), 9) AS a, CASE WHEN p_size <= 25 THEN round(acos(p_size / 25.0), 9) END AS c, round(degrees(p_size), 6) AS deg, round(tanh(p_size / 10.0), 9) AS th FROM part")
def math_trig(spark, d):
    p = F.col("p_size").cast("double")
    return table(spark, d, "part").select("p_partkey", F.round(F.sin(p), 9).alias("s"), F.round(F.atan2(p, F.lit(3.0)), 9).alias("a"), F.round(S.domain(F.acos, p / 25), 9).alias("c"), F.round(F.degrees(p), 6).alias("deg"), F.round(F.tanh(p / 10), 9).alias("th"))


@entry("SELECT p_partkey, round(log10(p_size), 9) AS a, round(ln(p_size) / ln(3), 9) AS b, round(log2(p_size), 9) AS c, round(exp(p_size / 10.0), 6) AS e, CASE WHEN p_size >= 20 THEN round(sqrt(p_size - 20), 9) END AS q FROM part")
def math_log10(spark, d):
    p = F.col("p_size").cast("double")
    return table(spark, d, "part").select("p_partkey", F.round(S.log(p), 9).alias("a"), F.round(S.log(p, 3), 9).alias("b"), F.round(F.log2(p), 9).alias("c"), F.round(F.exp(p / 10), 6).alias("e"), F.round(S.domain(F.sqrt, p - 20), 9).alias("q"))


@entry("SELECT l_orderkey, l_linenumber, CAST(gcd(l_partkey, l_suppkey) AS BIGINT) AS g, CAST(lcm(l_partkey, l_suppkey) AS BIGINT) AS l FROM lineitem")
def math_gcd_lcm(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.gcd("l_partkey", "l_suppkey").alias("g"), S.lcm("l_partkey", "l_suppkey").alias("l"))


# --- dates ---


@entry("SELECT event_id, strftime(ts, '%Y-%m-%d') AS d, strftime(ts, '%H:%M:%S|%j|%w|%W|%p|%I') AS t FROM events")
def dt_strftime(spark, d):
    return table(spark, d, "events").select("event_id", D.strftime("%Y-%m-%d", "ts").alias("d"), D.strftime("%H:%M:%S|%j|%w|%W|%p|%I", "ts").alias("t"))


@entry("SELECT event_id, round(epoch_us(ts) / 86400000000.0 + 2440587.5, 4) AS j, epoch_us(ts) // 1000000 AS e FROM events")
def dt_julianday(spark, d):
    return table(spark, d, "events").select("event_id", F.round(D.julianday("ts"), 4).alias("j"), D.unixepoch("ts").alias("e"))


@entry("SELECT event_id, (date_trunc('month', ts) + INTERVAL 1 MONTH + to_days(CAST(day(ts) - 1 AS INTEGER)) + (ts - date_trunc('day', ts)))::TIMESTAMP AS rolled, (date_trunc('month', ts) + INTERVAL 36 HOUR)::TIMESTAMP AS start, (date_trunc('day', ts) + to_days(CAST((7 - dayofweek(ts)) % 7 AS INTEGER)))::TIMESTAMP AS sunday FROM events")
def dt_modifiers_rollover(spark, d):
    return table(spark, d, "events").select("event_id", D.modify("ts", "+1 month").alias("rolled"), D.modify("ts", "start of month", "+36 hours").alias("start"), D.modify("ts", "start of day", "weekday 0").alias("sunday"))


@entry("SELECT * FROM (VALUES ('2024-02-29', TIMESTAMP '2024-02-29 00:00:00', '+0001-00-28 14:00:00.000', CAST(34005600000000000 AS BIGINT), TIMESTAMP '2024-02-29 00:00:00'), ('2460310.5', TIMESTAMP '2024-01-01 00:00:00', '+0000-00-00 00:00:00.000', 0, TIMESTAMP '2024-01-01 00:00:00'), ('12:30', TIMESTAMP '2000-01-01 12:30:00', '+0000-00-00 12:30:00.000', 45000000000000, TIMESTAMP '2000-01-01 13:00:00'), ('x', NULL, NULL, NULL, NULL)) t(a, t, diff, ns, hour)")
def dt_values_diff(spark, d):
    rows = readers.values(spark, [("2024-02-29", "2023-01-31 10:00:00"), ("2460310.5", "2024-01-01"), ("12:30", "2000-01-01"), ("x", "2024-01-01")], "a string, b string")
    return rows.select("a", D.time_value("a").alias("t"), D.timediff(D.time_value("a"), D.time_value("b")).alias("diff"), D.sub_times(D.time_value("a"), D.time_value("b")).alias("ns"), D.time_round(D.time_value("a"), 3600 * 10**9).alias("hour"))


# --- JSON ---


@entry("SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS v, CAST(json_valid(props) AS INTEGER) AS ok, CASE json_type(props, '$.k') WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'VARCHAR' THEN 'text' WHEN 'DOUBLE' THEN 'real' END AS t FROM events")
def json_functions(spark, d):
    return table(spark, d, "events").select("event_id", C.json_get("props", "$.k").alias("v"), C.json_valid("props").alias("ok"), C.json_type("props", "$.k").alias("t"))


@entry("SELECT event_id, j.key AS key, CAST(j.value AS VARCHAR) AS value, 'integer' AS type, CAST(j.atom AS VARCHAR) AS atom, CAST(NULL AS INTEGER) AS parent, j.fullkey AS fullkey, j.path AS path FROM events, json_each(props) j")
def json_each(spark, d):
    return readers.json_each(table(spark, d, "events").select("event_id", "props"), "props").select("event_id", "key", "value", "type", "atom", "parent", "fullkey", "path")


TREE = """SELECT * FROM (VALUES
 (1, 0, NULL, NULL, '{"a":[1,{"b":null}],"c":"x"}', 'object', NULL, '$', '$'), (1, 1, 0, 'a', '[1,{"b":null}]', 'array', NULL, '$.a', '$'), (1, 2, 1, '0', '1', 'integer', '1', '$.a[0]', '$.a'),
 (1, 3, 1, '1', '{"b":null}', 'object', NULL, '$.a[1]', '$.a'), (1, 4, 3, 'b', NULL, 'null', NULL, '$.a[1].b', '$.a[1]'), (1, 5, 0, 'c', 'x', 'text', 'x', '$.c', '$'), (2, 0, NULL, NULL, '[]', 'array', NULL, '$', '$')
) t(k, id, parent, key, value, type, atom, fullkey, path)"""


@entry(TREE)
def json_tree(spark, d):
    rows = readers.values(spark, [(1, '{"a":[1,{"b":null}],"c":"x"}'), (2, "[]"), (3, None)], "k int, j string")
    return rows.select("k", F.explode(readers.json_tree(F.col("j"))).alias("n")).select("k", "n.*")


# --- arrays and vectors ---


@entry("SELECT p_partkey, list_append(w, 'z') AS a, list_concat(['y'], w) AS p, array_to_string(w, '-') AS j, CAST(len(w) AS INTEGER) AS n, w[2] AS second FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part) t")
def arr_ops(spark, d):
    rows = table(spark, d, "part").withColumn("w", C.string_to_array("p_name", " "))
    return rows.select("p_partkey", C.array_append("w", F.lit("z")).alias("a"), C.array_prepend(F.lit("y"), "w").alias("p"), C.array_to_string("w", "-").alias("j"), C.array_length("w").alias("n"), C.array_get("w", 2).alias("second"))


@entry("SELECT vec_id, list_slice(e, 2, 4) AS s, nullif(list_position(e, 0.0::FLOAT), 0) AS zero, CAST(list_position(list_transform(e, lambda x: CAST(x > 0.2 AS INTEGER)), 1) AS BIGINT) AS first_big FROM (SELECT vec_id, embedding AS e FROM embeddings) t")
def arr_slice_position(spark, d):
    rows = table(spark, d, "embeddings")
    return rows.select("vec_id", C.array_slice("embedding", 2, 4).alias("s"), C.array_position("embedding", F.lit(0.0).cast("float")).cast("int").alias("zero"), C.array_position(F.transform("embedding", lambda x: (x > 0.2).cast("int")), F.lit(1)).alias("first_big"))


@entry("SELECT p_partkey, list_has_any(w, ['a', 'b']) AS o, list_has_all(w, [w[1]]) AS c FROM (SELECT p_partkey, string_split(lower(p_type), ' ') AS w FROM part) t")
def arr_overlap_contains(spark, d):
    rows = table(spark, d, "part").withColumn("w", F.split(F.lower("p_type"), " "))
    return rows.select("p_partkey", C.array_overlap("w", F.array(F.lit("a"), F.lit("b"))).alias("o"), C.array_contains_all("w", F.slice("w", 1, 1)).alias("c"))


VEC = "SELECT a.vec_id AS a, b.vec_id AS b, {} AS d FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id = b.vec_id - 10"


def _vector(name, function, sql):
    def run(spark, d):
        e = table(spark, d, "embeddings")
        pairs = e.alias("a").join(e.alias("b"), (F.col("a.label") == F.col("b.label")) & (F.col("a.vec_id") == F.col("b.vec_id") - 10))
        return pairs.select(F.col("a.vec_id").alias("a"), F.col("b.vec_id").alias("b"), F.round(function(F.col("a.embedding"), F.col("b.embedding")), 5).alias("d"))

    run.__name__ = name
    entry(VEC.format(sql))(run)


DOUBLES = "a.embedding::DOUBLE[], b.embedding::DOUBLE[]"
_vector("vec_cos", C.distance_cos, f"round(list_cosine_distance({DOUBLES}), 5)")
_vector("vec_l2", C.distance_l2, f"round(list_distance({DOUBLES}), 5)")
_vector("vec_dot", C.distance_dot, f"round(-list_inner_product({DOUBLES}), 5)")
_vector("vec_jaccard", C.distance_jaccard, "round(1 - list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: least(p[1], p[2])::DOUBLE)) / list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: greatest(p[1], p[2])::DOUBLE)), 5)")


@entry("SELECT b.vec_id AS vec_id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS d FROM embeddings a, embeddings b WHERE a.vec_id = 7 ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id LIMIT 10")
def vec_topk(spark, d):
    e = table(spark, d, "embeddings")
    asked = e.filter("vec_id = 7").select("embedding").first()  # one vector, as a constant
    if asked is None:
        return e.select("vec_id", F.lit(0.0).alias("d")).limit(0)
    asked = asked[0]
    near = e.select("vec_id", C.distance_l2("embedding", F.array(*(F.lit(float(x)) for x in asked))).alias("far"))
    return near.orderBy("far", "vec_id").limit(10).select("vec_id", F.round("far", 5).alias("d"))


# --- text search ---

WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"


@entry(f"SELECT doc_id FROM (SELECT doc_id, {WORDS} AS w FROM documents) t WHERE (list_contains(w, 'ernt') AND NOT list_contains(w, 'thnt')) OR list_contains(w, 'mentré')")
def fts_match_and_or(spark, d):
    return FT.match(table(spark, d, "documents"), ["text"], "ernt AND NOT thnt OR mentré").select("doc_id")


@entry("SELECT doc_id FROM documents WHERE regexp_matches(' ' || array_to_string(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), ' ') || ' ', ' and the ')")
def fts_phrase(spark, d):
    return FT.match(table(spark, d, "documents"), ["text"], '"and the"').select("doc_id")


@entry(f"SELECT doc_id FROM (SELECT doc_id, {WORDS} AS w FROM documents) t WHERE len(list_filter(w, lambda x: starts_with(x, 'lowe'))) > 0 OR len(list_filter(w, lambda x: starts_with(x, 'stup'))) > 0")
def fts_prefix(spark, d):
    return FT.match(table(spark, d, "documents"), ["text"], "lowe* stup*").select("doc_id")


@entry(
    f"WITH t AS (SELECT doc_id, {WORDS} AS w FROM documents), o AS (SELECT doc_id, len(w) AS l, len(list_filter(w, lambda x: x = 'ernt')) AS a, len(list_filter(w, lambda x: x = 'thnt')) AS b FROM t), "
    "s AS (SELECT count(*) AS n, avg(l) AS m, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM o) "
    "SELECT doc_id AS key, round(ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * l / m)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * l / m)), 6) AS score FROM o, s WHERE a > 0 OR b > 0"
)
def fts_bm25(spark, d):
    return FT.bm25(table(spark, d, "documents"), "doc_id", "text", "ernt thnt").select("key", F.round("score", 6).alias("score"))


@entry(f"SELECT doc_id, regexp_replace(text, '(^|[^\\p{{L}}\\p{{N}}])(idiot)($|[^\\p{{L}}\\p{{N}}])', '\\1<b>\\2</b>\\3', 'gi') AS text FROM (SELECT doc_id, text, {WORDS} AS w FROM documents) t WHERE list_contains(w, 'idiot')")
def fts_highlight(spark, d):
    return FT.match(table(spark, d, "documents"), ["text"], "idiot").select("doc_id", FT.highlight(F.col("text"), "idiot").alias("text"))


# --- recursion ---


@entry("WITH RECURSIVE t(x) AS (SELECT CAST(1 AS BIGINT) UNION SELECT (x * 3 + 1) % 50 FROM t) SELECT x FROM t")
def recursive_union_dedup(spark, d):
    return R.recursive_union(spark.range(1, 2).toDF("x"), lambda t: t.select(((F.col("x") * 3 + 1) % 50).alias("x")))


@entry("WITH RECURSIVE t(id, depth) AS (SELECT CAST(0 AS BIGINT), 0 UNION ALL SELECT p_partkey, depth + 1 FROM t JOIN part ON p_partkey // 3 = id AND p_partkey > 0) SELECT id, depth FROM t")
def recursive_queue_order(spark, d):
    p = table(spark, d, "part").filter("p_partkey > 0").select(F.floor(F.col("p_partkey") / 3).alias("parent"), F.col("p_partkey").alias("child"))
    return R.walk(p, spark.range(1), depth_first=True).select("id", "depth")


@entry("SELECT CAST(unnest(generate_series(20, 3, -4)) AS BIGINT) AS value")
def generate_series_desc(spark, d):
    return readers.generate_series(spark, 20, 3, -4)


@entry("SELECT CAST(1 AS BIGINT) AS value WHERE false")
def generate_series_empty(spark, d):
    return readers.generate_series(spark, 1, 5, -1)


# --- deltas, change capture, DML ---


def _states(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    old = o.filter("o_orderkey % 5 <> 0")
    new = o.filter("o_orderkey % 7 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 11 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return old, new, H.consolidate(H.weighted(new).unionByName(H.weighted(old, -1)))


NEW = "(SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 11 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 7 <> 0) n"
OLD = "(SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 5 <> 0) o"


@entry(f"SELECT o_orderkey, o_totalprice * 2 AS twice FROM {NEW} WHERE o_totalprice > 100000 AND o_custkey % 2 = 0")
def ivm_filter_project(spark, d):
    old, _, delta = _states(spark, d)
    view = lambda t, *w: t.filter("o_totalprice > 100000 and o_custkey % 2 = 0").select("o_orderkey", (F.col("o_totalprice") * 2).alias("twice"), *w)
    return H.apply_delta(view(old), view(delta, H.W))


@entry(f"SELECT o_custkey, o_orderkey, c_name FROM {NEW} JOIN (SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 <> 0) c ON o_custkey = c_custkey")
def ivm_join_delta(spark, d):
    old, _, delta = _states(spark, d)
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    c_old, c_new = c.filter("o_custkey % 2 = 0"), c.filter("o_custkey % 3 <> 0")
    dc = H.consolidate(H.weighted(c_new).unionByName(H.weighted(c_old, -1)))
    keys = ["o_custkey", "o_orderkey"]
    change = H.delta_join(H.weighted(old.select(*keys)), delta.select(*keys, H.W), H.weighted(c_old), dc, ["o_custkey"])
    return H.apply_delta(old.select(*keys).join(c_old, "o_custkey"), change)


@entry(f"SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {NEW} GROUP BY o_custkey")
def ivm_agg_delta(spark, d):
    old, _, delta = _states(spark, d)
    state = old.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    return H.delta_aggregate(state, delta, ["o_custkey"], {"total": "o_totalprice"}).select("o_custkey", "n", F.round("total", 2).alias("total"))


@entry(f"SELECT o_custkey, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM {NEW} GROUP BY o_custkey")
def ivm_minmax_delta(spark, d):
    old, new, delta = _states(spark, d)
    state = old.groupBy("o_custkey").agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    return H.delta_extremes(new, state, delta, ["o_custkey"], "o_totalprice")


@entry(f"SELECT DISTINCT o_custkey FROM {NEW}")
def ivm_union(spark, d):
    old, _, delta = _states(spark, d)
    keys = old.select("o_custkey")
    return H.apply_delta(keys.distinct(), H.delta_distinct(H.weighted(keys), delta.select("o_custkey", H.W)))


@entry(f"SELECT CASE WHEN o.o_orderkey IS NULL THEN 1 WHEN n.o_orderkey IS NULL THEN -1 ELSE 0 END AS change_type, coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, o.o_totalprice AS old_price, n.o_totalprice AS new_price FROM {OLD} FULL JOIN {NEW} ON o.o_orderkey = n.o_orderkey WHERE o.o_orderkey IS NULL OR n.o_orderkey IS NULL OR o.o_totalprice <> n.o_totalprice OR o.o_custkey <> n.o_custkey")
def cdc_full_diff(spark, d):
    old, new, _ = _states(spark, d)
    price = lambda c: F.get_json_object(c, "$.o_totalprice").cast("double")
    return H.changes(old, new, ["o_orderkey"]).select("change_type", "o_orderkey", price("before").alias("old_price"), price("after").alias("new_price"))


ROWS = "(SELECT s_suppkey + 50 AS s_suppkey, s_acctbal AS v FROM supplier) e"
BASE = "(SELECT s_suppkey, s_acctbal AS v FROM supplier) t"


def _dml(spark, d):
    s = table(spark, d, "supplier")
    return s.select("s_suppkey", F.col("s_acctbal").alias("v")), s.select((F.col("s_suppkey") + 50).alias("s_suppkey"), F.col("s_acctbal").alias("v"))


@entry(f"SELECT coalesce(t.s_suppkey, e.s_suppkey) AS s_suppkey, CASE WHEN t.s_suppkey IS NULL THEN e.v WHEN e.v > 0 THEN round(t.v + e.v, 2) ELSE t.v END AS v FROM {BASE} FULL JOIN {ROWS} ON t.s_suppkey = e.s_suppkey")
def dml_upsert(spark, d):
    base, rows = _dml(spark, d)
    return H.upsert(base, rows, ["s_suppkey"], {"v": F.round(F.col("t.v") + F.col("excluded.v"), 2)}, F.col("excluded.v") > 0)


@entry(f"SELECT coalesce(t.s_suppkey, e.s_suppkey) AS s_suppkey, coalesce(e.v, t.v) AS v FROM {BASE} FULL JOIN {ROWS} ON t.s_suppkey = e.s_suppkey")
def dml_replace(spark, d):
    base, rows = _dml(spark, d)
    return H.insert(base, rows, ["s_suppkey"], "replace")


@entry(f"SELECT coalesce(t.s_suppkey, e.s_suppkey) AS s_suppkey, coalesce(t.v, e.v) AS v FROM {BASE} FULL JOIN {ROWS} ON t.s_suppkey = e.s_suppkey")
def dml_insert_ignore(spark, d):
    base, rows = _dml(spark, d)
    return H.insert(base, rows, ["s_suppkey"], "ignore")


@entry(f"SELECT t.s_suppkey AS s_suppkey, CASE WHEN e.s_suppkey IS NULL THEN t.v ELSE e.v * 2 END AS v FROM {BASE} LEFT JOIN {ROWS} ON t.s_suppkey = e.s_suppkey")
def dml_update_from(spark, d):
    base, rows = _dml(spark, d)
    return H.update_from(base, rows, ["s_suppkey"], {"v": F.col("s.v") * 2})


@entry("SELECT c_custkey, c_acctbal FROM customer WHERE NOT (c_acctbal < 0 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW'))")
def dml_delete_subquery(spark, d):
    c, gone = table(spark, d, "customer").select("c_custkey", "c_acctbal"), table(spark, d, "orders").filter("o_orderpriority = '5-LOW'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return H.delete(c, F.col("c_acctbal") < 0).join(gone, "c_custkey", "left_anti")


@entry('SELECT \'CHECK size\' AS "constraint", p_partkey FROM part WHERE p_size > 45 UNION ALL SELECT \'UNIQUE p_name\', p_partkey FROM part WHERE p_name IN (SELECT p_name FROM part GROUP BY p_name HAVING count(*) > 1)')
def check_constraint_violations(spark, d):
    p = table(spark, d, "part")
    return H.violations(p, {"size": F.col("p_size") <= 45}, ["p_name"], [["p_name"]]).select("constraint", F.get_json_object("row", "$.p_partkey").cast("long").alias("p_partkey"))


@entry("SELECT o_orderkey, CAST(100 + 10 * (row_number() OVER (ORDER BY o_orderkey) - 1) AS BIGINT) AS nextval FROM orders")
def sequence_nextval(spark, d):
    return H.next_values(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 100, 10).select("o_orderkey", "nextval")


@entry()
def table_hash(spark, d):
    return H.table_hash(table(spark, d, "lineitem"))


@entry("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_replay_counts(spark, d):
    """events read as a stream, counted by type, into a memory sink."""
    import uuid

    schema, name = table(spark, d, "events").schema, f"replay_{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    query = stream.groupBy("event_type").agg(F.count("*").alias("n")).writeStream.outputMode("complete").format("memory").option("checkpointLocation", f"{R.shared_folder(spark)}/{name}").queryName(name).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.table(name)


@entry("SELECT user_id, count(*) AS sessions FROM (SELECT user_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS first FROM events) t WHERE first = 1 GROUP BY user_id")
def session_windows(spark, d):
    gap = F.col("ts").cast("timestamp").cast("double") - F.lag(F.col("ts").cast("timestamp").cast("double")).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").select("user_id", F.when(gap < 6 * 3600, 0).otherwise(1).alias("first")).filter("first = 1").groupBy("user_id").agg(F.count("*").alias("sessions"))


@entry(
    f"SELECT CASE WHEN o.o_orderkey IS NULL THEN 'added' WHEN n.o_orderkey IS NULL THEN 'gone' ELSE 'dearer' END AS what, coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey, coalesce(n.o_totalprice, 0) - coalesce(o.o_totalprice, 0) AS difference "
    f"FROM {OLD} FULL JOIN {NEW} ON o.o_orderkey = n.o_orderkey WHERE o.o_orderkey IS NULL OR n.o_orderkey IS NULL OR n.o_totalprice > o.o_totalprice"
)
def trigger_audit(spark, d):
    old, new, _ = _states(spark, d)
    price = lambda side: F.col(f"{side}.o_totalprice")
    row = lambda what, key, difference: {"what": F.lit(what), "o_orderkey": F.col(key), "difference": difference}
    return T.fired(
        T.row_changes(old, new, ["o_orderkey"]),
        [
            T.Trigger("insert", row("added", "new.o_orderkey", price("new"))),
            T.Trigger("delete", row("gone", "old.o_orderkey", -price("old"))),
            T.Trigger("update", row("dearer", "new.o_orderkey", price("new") - price("old")), price("new") > price("old"), ["o_totalprice"]),
        ],
    )


@entry()
def crypto_blake3(spark, d):
    from ..functions import extras

    return table(spark, d, "part").select("p_partkey", F.hex(extras.blake3("p_name")).alias("h"))
