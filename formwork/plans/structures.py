"""Queries of nested violations, inference by group, keys, and decided subtypes."""

from __future__ import annotations

from pyspark.sql import functions as F

from formwork.operators import conform, inference, keys, paths, sql
from formwork.operators import validation as v
from formwork.operators.variant import parsed
from formwork.plans.catalogue import _LINE, _ORDERS, _soundness, column_query, query, string_query
from formwork.sources import table

# ------------------------------------------------------- alternatives of ranges, predicates

column_query("f22_all_but_one", "lineitem", _LINE, "l_suppkey", "(int, x != 3 && !(x in [7, 9]))", "l_suppkey NOT IN (3, 7, 9)")
column_query("f23_union_of_ranges", "orders", "o_orderkey", "o_totalprice", "(float, x < 1000 || 5000 < x <= 90000.5 || !(x < 250000))", "(o_totalprice < 1000 OR (o_totalprice > 5000 AND o_totalprice <= 90000.5::DOUBLE) OR o_totalprice >= 250000)")
string_query("f20_one_argument", '(string, x == "ok" || x == "failed" || startsWith("success"))', ((5, ["ok", "failed", "success ", "okay", "a success"]), (2, ["", "!"])), "event_id % 5 = 2 OR (event_id % 5 < 2 AND event_id % 2 = 0)")
string_query("f21_date_layout", '(string, parsedate(x, "rfc3339"))', ("2024-", (3, ["01", "13", "02"]), "-05", (2, ["T", " "]), "10:00:00", (5, ["Z", "+01:00", ".25Z", "", "+1"])), "event_id % 3 <> 1 AND event_id % 2 = 0 AND event_id % 5 < 3")

_soundness("s07_residues", "lineitem", "l_partkey", "(int, x % 4 == 0)", "(int, x % 2 == 0)", "l_partkey % 4 = 0", "l_partkey % 2 = 0")
_soundness("s08_enum_in_residue", "part", "p_size", "(int, x in [2, 4, 18])", "(int, x % 2 == 0, x != 3)", "p_size IN (2, 4, 18)", "p_size % 2 = 0 AND p_size <> 3")
_soundness("s09_covered_by_sum", "lineitem", "l_partkey", "(int, x >= 0)", "(int, x % 3 == 0) | (int, x % 3 != 0)", "l_partkey >= 0", "true")
_soundness("s10_bounded_arithmetic", "part", "p_size", "(int, 0 <= x < 100, x * 2 + 1 < 30)", "(int, x <= 14)", "p_size BETWEEN 0 AND 99 AND p_size * 2 + 1 < 30", "p_size <= 14")

# ------------------------------------------------------------------------ nested violations

_NESTED = '{"l_orderkey":(int),"lines":([{"n":(int, x <= 6),"quantity":(float, x <= 45),"flag":(string, x in ["A","N"])}], len(x) <= 6)}'
_LINES = """
WITH lines AS (
  SELECT l_orderkey, l_linenumber AS n, l_quantity AS quantity, l_returnflag AS flag,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_returnflag) - 1 AS i FROM lineitem),
inner_ones AS (
  SELECT l_orderkey, i, 'n' AS field FROM lines WHERE n > 6 UNION ALL SELECT l_orderkey, i, 'quantity' FROM lines WHERE quantity > 45
  UNION ALL SELECT l_orderkey, i, 'flag' FROM lines WHERE flag NOT IN ('A', 'N')),
found AS (
  SELECT l_orderkey, 'lines[' || i || '].' || field AS path, 'lines[].' || field AS place, 'value' AS problem FROM inner_ones
  UNION ALL SELECT l_orderkey, 'lines', 'lines', 'value' FROM lines GROUP BY l_orderkey HAVING count(*) > 6 AND l_orderkey NOT IN (SELECT l_orderkey FROM inner_ones))
"""


def _orders_with_lines(spark, sf_dir):
    line = F.struct(F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))


@query("n01_nested_violations", f"{_LINES} SELECT * FROM found")
def n01(spark, sf_dir):
    """Elements of each order's list of lines that violate a schema, by path."""
    return paths.nested_violations(_orders_with_lines(spark, sf_dir), _NESTED, ["l_orderkey"])


@query("n02_by_place", f"{_LINES} SELECT place, problem, count(*) AS n FROM found GROUP BY ALL")
def n02(spark, sf_dir):
    return paths.by_place(paths.nested_violations(_orders_with_lines(spark, sf_dir), _NESTED, ["l_orderkey"]))


@query("n03_samples", f"{_LINES} SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY place, problem ORDER BY l_orderkey, path) <= 5")
def n03(spark, sf_dir):
    """The first five violations of each place: a report's examples."""
    return paths.samples(paths.nested_violations(_orders_with_lines(spark, sf_dir), _NESTED, ["l_orderkey"]), 5)


@query(
    "n04_variant_violations",
    """
WITH held AS (SELECT user_id, event_type, (props::JSON->>'$.k')::BIGINT AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events),
bad AS (SELECT user_id, '[' || i || '].k' AS path, '[].k' AS place, 'value' AS problem FROM held WHERE event_type <> 'click' AND k > 50
  UNION ALL SELECT user_id, '[' || i || '].t', '[].t', 'missing' FROM held WHERE event_type = 'view'
  UNION ALL SELECT user_id, '[' || i || '].error', '[].error', 'unknown' FROM held WHERE event_type = 'error'
  UNION ALL SELECT user_id, '[' || i || '].k', '[].k', 'kind' FROM held WHERE event_type = 'click')
SELECT * FROM bad
""",
)
def n04(spark, sf_dir):
    """Each user's events as one JSON list, with fields that are wrong, missing and unknown by type."""
    k = F.get_json_object("props", "$.k")
    kind = F.col("event_type")
    fields = F.concat_ws(",", F.concat(F.lit('"k":'), F.when(kind == "click", F.concat(F.lit('"'), k, F.lit('"'))).otherwise(k)), F.when(kind != "view", F.lit('"t":1')), F.when(kind == "error", F.lit('"error":null')))
    one = F.struct("event_id", F.concat(F.lit("{"), fields, F.lit("}")).alias("doc"))
    held = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(one)).alias("all"))
    docs = held.select("user_id", parsed(F.concat(F.lit("["), F.array_join("all.doc", ","), F.lit("]"))).alias("value"))
    return paths.value_violations(docs, "value", '[{"k":(int, x <= 50),"t":(int)}]', ["user_id"])


# ------------------------------------------------------------------------ inference by group


@query("g01_json_schema_by_group", """SELECT event_type, '{"k":(int,x>=' || min((props::JSON->>'$.k')::BIGINT) || ',x<=' || max((props::JSON->>'$.k')::BIGINT) || ')}' AS schema FROM events GROUP BY event_type""")
def g01(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_type", parsed(F.col("props")).alias("value"))
    return inference.infer_by(df, "value", ["event_type"])


@query(
    "g02_table_schema_by_group",
    """SELECT o_orderstatus, '{"key":(int,x>=' || min(o_orderkey) || ',x<=' || max(o_orderkey) || '),"priority":(string,x in [' || string_agg(DISTINCT '"' || o_orderpriority || '"', ',' ORDER BY '"' || o_orderpriority || '"')
    || ']),"urgent":(int,x>=' || min(o_custkey) FILTER (WHERE o_orderpriority = '1-URGENT') || ',x<=' || max(o_custkey) FILTER (WHERE o_orderpriority = '1-URGENT') || ',optional)}' AS schema FROM orders GROUP BY o_orderstatus""",
)
def g02(spark, sf_dir):
    """Bounds, enums and a field that is optional, of a struct."""
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_custkey"))
    row = F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("priority"), urgent.alias("urgent"))
    return inference.infer_by(table(spark, sf_dir, "orders").select("o_orderstatus", row.alias("row")), "row", ["o_orderstatus"])


@query("g03_merged_states", """SELECT event_type, '{"k":(int,x>=' || min((props::JSON->>'$.k')::BIGINT) || ',x<=' || max((props::JSON->>'$.k')::BIGINT) || ')}' AS schema FROM events GROUP BY event_type""")
def g03(spark, sf_dir):
    """The state of each user's events, merged to that of each type: what is kept by part gives the whole."""
    df = table(spark, sf_dir, "events").select("event_type", "user_id", parsed(F.col("props")).alias("value"))
    return inference.schemas(inference.merged(inference.observed(df, "value", ["event_type", "user_id"]), ["event_type"]), ["event_type"])


# ----------------------------------------------------------------------- keys and references

_KEYED = {"lineitem": '{"l_orderkey":(int,pk,ref="orders.o_orderkey"),"l_linenumber":(int,pk)}', "orders": '{"o_orderkey":(int,pk),"o_custkey":(int,unique)}'}


@query(
    "k01_keys_and_references",
    """
WITH good AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice <= 200000)
SELECT 'lineitem' AS of, 'pk' AS rule, 'l_orderkey,l_linenumber' AS fields, '{"l_orderkey":' || l_orderkey || ',"l_linenumber":' || l_linenumber || '}' AS key, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'lineitem', 'ref', 'l_orderkey', '{"l_orderkey":' || l_orderkey || '}', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM good) GROUP BY l_orderkey
UNION ALL SELECT 'orders', 'pk', 'o_orderkey', '{"o_orderkey":' || o_orderkey || '}', count(*) FROM good GROUP BY o_orderkey HAVING count(*) > 1
UNION ALL SELECT 'orders', 'unique', 'o_custkey', '{"o_custkey":' || o_custkey || '}', count(*) FROM good GROUP BY o_custkey HAVING count(*) > 1
""",
)
def k01(spark, sf_dir):
    """All lines against the orders that conform: quarantined orders leave orphans behind."""
    good = v.split(table(spark, sf_dir, "orders"), _ORDERS, closed=False)[0]
    return keys.key_violations({"lineitem": table(spark, sf_dir, "lineitem"), "orders": good}, _KEYED)


# ------------------------------------------------------------------ conforming projections


@query(
    "c01_conform_json",
    """SELECT event_id AS id, lower('User' || event_id || '@Mail.Example.ORG') AS mail, CASE WHEN event_type <> 'view' THEN (props::JSON->>'$.k')::BIGINT END AS k,
    (props::JSON->>'$.k')::BIGINT + 1 AS first_n FROM events WHERE event_type <> 'click' AND (props::JSON->>'$.k')::BIGINT <= 80""",
)
def c01(spark, sf_dir):
    """JSON to typed columns: mail addresses in normal form, optional and nested fields, wrong ones left out."""
    k, kind = F.get_json_object("props", "$.k"), F.col("event_type")
    fields = F.concat_ws(",", F.concat(F.lit('"id":'), "event_id"), F.concat(F.lit('"mail":"User'), "event_id", F.lit('@Mail.Example.ORG"')), F.when(kind != "view", F.concat(F.lit('"k":'), k)), F.when(kind == "click", F.lit('"z":1')), F.concat(F.lit('"list":[{"n":'), (k.cast("long") + 1).cast("string"), F.lit("}]")))
    docs = table(spark, sf_dir, "events").select(parsed(F.concat(F.lit("{"), fields, F.lit("}"))).alias("value"))
    schema = '{"id":(int),"mail":(email),"k":(int,x<=80,optional),"list":([{"n":(int,x<=81)}],len(x)==1)}'
    typed = conform.conform_value(docs, "value", schema, "row").filter("row IS NOT NULL")
    return typed.select("row.id", "row.mail", "row.k", F.col("row.list")[0]["n"].alias("first_n"))


@query("c02_conform_table", "SELECT o_custkey, o_orderkey, lower(o_orderstatus || o_orderkey || '@x.ORG') AS contact, NULL::BIGINT AS later FROM orders WHERE o_orderkey % 3 = 0 AND o_totalprice < 200000")
def c02(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumn("contact", F.concat("o_orderstatus", "o_orderkey", F.lit("@x.ORG")))
    schema = '{"o_orderkey":(int,x%3==0),"o_custkey":(int),"contact":(email),"later":(int,optional),"o_totalprice":(float,x<200000)}'
    return conform.conform(df, schema, closed=False).drop("o_totalprice")


# ----------------------------------------------------------------------------- SQL surface


@query("q01_sql_function", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE (o_totalprice < 50000 OR o_totalprice >= 150000.5::DOUBLE) AND o_orderpriority IN ('1-URGENT', '3-MEDIUM') AND o_orderkey % 4 = 0 GROUP BY o_orderstatus")
def q01(spark, sf_dir):
    """Types as functions of the session, called in plain SQL."""
    sql.create_function(spark, "fair_price", "(float, x < 50000 || x >= 150000.5)", "double")
    sql.create_function(spark, "soon", '(string, x in ["1-URGENT", "3-MEDIUM"])', "string")
    sql.create_function(spark, "fourth", "(int, x % 4 == 0)", "bigint")
    return spark.sql("SELECT o_orderstatus, count(*) AS n FROM {orders} WHERE fair_price(o_totalprice) AND soon(o_orderpriority) AND fourth(o_orderkey) GROUP BY o_orderstatus", orders=table(spark, sf_dir, "orders"))


@query("q02_sql_condition", "SELECT vec_id, len([e FOR e IN embedding IF e::DOUBLE < -0.3::DOUBLE OR e::DOUBLE > 0.3::DOUBLE]) = 0 AND len(embedding) = 64 AS valid FROM embeddings")
def q02(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    return df.selectExpr("vec_id", f"coalesce({sql.sql_condition(df, 'embedding', '([(float, -0.3 <= x <= 0.3)], len(x) == 64)')}, false) AS valid")
