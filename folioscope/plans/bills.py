"""Bills as XML, made from ``orders``, and what a scan must find in them, in SQL.

Each order is one element of a title: headings of three levels with and without text, a heading in parentheses, one without
words, sections plain and around accounts, and containers within each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KIND = "CAST(o_orderkey % 8 AS INTEGER)"


def _element(tag: str, header: Column | None, *inner: Column, enum: Column | None = None) -> Column:
    parts = [F.lit(f"<{tag} id='e"), F.col("k").cast("string"), F.lit("'>")]
    if enum is not None:
        parts += [F.lit("<enum>"), enum, F.lit(".</enum>")]
    if header is not None:
        parts += [F.lit("<header>"), header, F.lit("</header>")]
    return F.concat(*parts, *inner, F.lit(f"</{tag}>"))


def xml_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content) of one bill for each 320 order keys, a title for each 40."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey AS k", f"{KIND} AS kind", "floor(o_totalprice) AS amount")
    name = F.col("k").cast("string")
    named = lambda x: F.concat(F.lit(f"{x} "), name)
    text = F.concat(F.lit("<text>For <i>item</i>  "), name, F.lit(", $"), F.col("amount").cast("string"), F.lit(": (1) each.</text>"))
    bare = lambda x: F.concat(F.lit("<text>"), named(x), F.lit("</text>"))
    part = _element("part", named("Part"), _element("section", None, bare("Deep"), enum=F.concat(name, F.lit("b"))))
    kinds = [
        _element("appropriations-major", named("Dept"), F.when(F.col("k") % 3 == 0, text).otherwise("")),
        _element("appropriations-intermediate", named("Office"), text),
        _element("appropriations-small", named("Account"), text),
        _element("appropriations-small", F.lit("(including transfer of funds)"), text),
        _element("section", named("Rule"), text, enum=name),
        _element("section", None, F.lit("<text/>"), _element("appropriations-small", named("Inner"), text), enum=name),
        _element("subtitle", named("Subtitle"), _element("section", None, bare("Held"), enum=name), part),
        _element("appropriations-intermediate", None, text),
    ]
    one = kinds[-1]
    for i, x in enumerate(kinds[:-1]):
        one = F.when(F.col("kind") == i, x).otherwise(one)
    gathered = lambda c, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, c))), lambda x: x[c]), "")
    titles = o.select((F.col("k") / 320).cast("long").alias("bill"), (F.col("k") / 40).cast("long").alias("title"), "k", one.alias("x")).groupBy("bill", "title").agg(gathered("x", "k").alias("x"))
    t = F.col("title").cast("string")
    titles = titles.withColumn("x", F.concat(F.lit("<title><enum>I</enum><header>Agency "), t, F.lit("</header>"), F.col("x"), F.lit("</title>")))
    bills = titles.groupBy("bill").agg(gathered("x", "title").alias("x"))
    b = F.col("bill").cast("string")
    held = F.when(F.col("bill") % 2 == 0, F.concat(F.lit("<division><enum>A</enum><header>Div "), b, F.lit("</header>"), F.col("x"), F.lit("</division>"))).otherwise(F.col("x"))
    short = F.concat(F.lit("<section id='s'><enum>1.</enum><header>Short title</header><text>This is bill "), b, F.lit(".</text></section>"))
    body = F.concat(F.lit("<bill><form><congress>118th CONGRESS</congress><legis-num>H. R. "), b, F.lit("</legis-num></form><legis-body>"), short, held, F.lit("</legis-body></bill>"))
    return bills.select(F.concat(F.lit("bills/118-hr-"), b, F.lit("/1_reported-in-house.xml")).alias("path"), body.cast("binary").alias("content"))


_FRAME = "OVER (PARTITION BY title ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND {}CURRENT ROW)"
_NOW, _BEFORE = _FRAME.format(""), "OVER (PARTITION BY title ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
#: SQL of the nodes: rows (k, bill, n, path, shown, number, header, body, division), n telling an element's nodes apart.
NODES = f"""
WITH t AS (SELECT o_orderkey AS k, CAST(floor(o_orderkey / 320) AS BIGINT) AS bill, CAST(floor(o_orderkey / 40) AS BIGINT) AS title, o_orderkey % 8 AS kind, 'For item ' || o_orderkey || ', $' || CAST(floor(o_totalprice) AS BIGINT) || ':(1) each.' AS words FROM orders),
g AS (SELECT *, count(*) FILTER (WHERE kind = 0) {_NOW} AS part, 'Agency ' || title AS agency, last_value(CASE WHEN kind = 0 THEN 'Dept ' || k END IGNORE NULLS) {_NOW} AS major,
             last_value(CASE kind WHEN 0 THEN 'Dept ' || k WHEN 1 THEN 'Office ' || k WHEN 2 THEN 'Account ' || k END IGNORE NULLS) {_BEFORE} AS named FROM t),
m AS (SELECT *, nullif(last_value(CASE kind WHEN 1 THEN 'Office ' || k WHEN 7 THEN '' END IGNORE NULLS) OVER (PARTITION BY title, part ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS middle FROM g),
p AS (SELECT k, bill, 1 AS n, [agency, major] AS path, '' AS number, 'Dept ' || k AS header, words AS body FROM m WHERE kind = 0 AND k % 3 = 0
      UNION ALL SELECT k, bill, 1, [agency, major, 'Office ' || k], '', 'Office ' || k, words FROM m WHERE kind = 1
      UNION ALL SELECT k, bill, 1, [agency, major], '', '', words FROM m WHERE kind = 7
      UNION ALL SELECT k, bill, 1, [agency, major, middle, 'Account ' || k], '', 'Account ' || k, words FROM m WHERE kind = 2
      UNION ALL SELECT k, bill, 1, [agency, major, middle, CASE WHEN named IS DISTINCT FROM major AND named IS DISTINCT FROM middle THEN named END], '', '(including transfer of funds)', words FROM m WHERE kind = 3
      UNION ALL SELECT k, bill, 1, [agency, major, middle, 'sec. ' || k], 'Sec. ' || k, 'Rule ' || k, words FROM m WHERE kind = 4
      UNION ALL SELECT k, bill, 1, [agency, major, middle, 'sec. ' || k], 'Sec. ' || k, '', '' FROM m WHERE kind = 5
      UNION ALL SELECT k, bill, 2, [agency, major, middle, 'Inner ' || k], '', 'Inner ' || k, words FROM m WHERE kind = 5
      UNION ALL SELECT k, bill, 1, [agency, 'Subtitle ' || k, 'sec. ' || k], 'Sec. ' || k, '', 'Held ' || k FROM m WHERE kind = 6
      UNION ALL SELECT k, bill, 2, [agency, 'Subtitle ' || k, 'Part ' || k, 'sec. ' || k || 'b'], 'Sec. ' || k || 'b', '', 'Deep ' || k FROM m WHERE kind = 6),
s AS (SELECT k, bill, n, array_to_string([x FOR x IN path IF x IS NOT NULL], '/') AS shown, number, header, body FROM p
      UNION ALL SELECT DISTINCT -1, bill, 0, 'Sec. 1', 'Sec. 1', 'Short title', 'This is bill ' || bill || '.' FROM t),
nodes AS (SELECT *, CASE WHEN bill % 2 = 0 AND n > 0 THEN 'Division A: Div ' || bill ELSE '' END AS division, CAST(row_number() OVER (PARTITION BY bill ORDER BY k, n) - 1 AS INTEGER) AS ord FROM s)"""
