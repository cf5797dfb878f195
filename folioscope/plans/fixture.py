"""Versions made from ``orders`` by rules that SQL states too, for queries and their oracles.

Numbers decide what happens to a node: dropped on one side, its amount changed, annotated, rewritten, moved to another
path or division.  Every tenth node shares its path with three others.  The words of a text differ, and stand in the same
order wherever two texts share some, so that their similarity is twice the shared words over all words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = """
SELECT o_orderkey AS k, CAST(floor(o_orderkey / 40) AS BIGINT) % 64 AS pair_id, lower(o_orderpriority) AS top,
       CASE WHEN o_orderkey % 10 = 0 THEN 'dup ' || CAST(CAST(floor(o_orderkey / 40) AS BIGINT) AS STRING) ELSE 'sec. ' || CAST(o_orderkey AS STRING) END AS leaf,
       'Division A' || CAST(o_orderkey % 4 AS STRING) || ': Title ' || CAST(o_orderkey % 3 AS STRING) AS division,
       CAST(floor(o_totalprice) AS BIGINT) AS amount, 'account' || CAST(o_custkey AS STRING) AS account, 'key' || CAST(o_orderkey AS STRING) AS word,
       ' plan' || CAST(o_orderkey % 97 AS STRING) || ' part' || CAST(o_orderkey % 89 AS STRING) || ' under item' || CAST(o_orderkey % 83 AS STRING)
           || ' list' || CAST(o_orderkey % 79 AS STRING) || ' box' || CAST(o_orderkey % 73 AS STRING) AS slots
FROM orders
"""
OLD = "SELECT *, word || ' grants $' || CAST(amount AS STRING) || ' to ' || account || slots || ' and expenses' AS body FROM base WHERE k % 11 <> 0"
NEW = """
SELECT k, pair_id, top, CASE WHEN k % 17 = 0 AND k % 10 <> 0 THEN 'sec. moved ' || CAST(k AS STRING) ELSE leaf END AS leaf,
       CASE WHEN k % 20 = 0 THEN 'Division B: Title ' || CAST((k + 1) % 3 AS STRING) ELSE division END AS division, amount, account, word, slots,
       CASE WHEN k % 7 = 0 THEN 'repealed ' || word || ' by act' || CAST(k AS STRING) || 'x of chapter ' || account
            ELSE word || ' grants $' || CAST(amount + CASE WHEN k % 3 = 0 THEN 1000 ELSE 0 END AS STRING) || CASE WHEN k % 5 = 0 THEN ' (increased by $7)' ELSE '' END
                 || ' to ' || account || slots || CASE WHEN k % 3 = 1 THEN ' and expenses' ELSE ' and charges' END END AS body
FROM base WHERE k % 13 <> 0
"""
WITH = f"WITH RECURSIVE base AS ({BASE}), old AS ({OLD}), new AS ({NEW})"


def rows(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    base = spark.sql(BASE.replace("FROM orders", "FROM {orders}"), orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    return spark.sql((OLD if side == "old" else NEW).replace("FROM base", "FROM {base}"), base=base)


def nodes(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    path = F.when(F.col("leaf").startswith("dup"), F.array("leaf")).otherwise(F.array("top", "leaf"))
    return rows(spark, sf_dir, side).select(
        "pair_id", F.col("k").cast("int").alias("ord"), path.alias("match_path"), F.concat(F.array("division"), path).alias("display_path"), F.lit("section").alias("tag"),
        F.concat(F.lit(f"{side}-"), F.col("k").cast("string")).alias("element_id"), F.lit("").alias("header_text"), F.col("body").alias("body_text"),
        F.when(F.col("leaf").startswith("sec"), F.concat(F.lit("Sec. "), F.col("k").cast("string"))).otherwise("").alias("section_number"), F.col("division").alias("division_label"),
    )


def claims(name: str, cand: str) -> str:
    """SQL of the greedy one-to-one choice from ``cand`` (g, oi, ni, sim), round by round: the best left of each g, and what doesn't meet it."""
    return f"""{name}_r AS (SELECT g, oi, ni, sim, false AS won FROM {cand}
    UNION ALL SELECT g, oi, ni, sim, oi = bo AND ni = bn
              FROM (SELECT *, first_value(oi) OVER w AS bo, first_value(ni) OVER w AS bn FROM {name}_r WHERE NOT won WINDOW w AS (PARTITION BY g ORDER BY sim DESC, oi DESC, ni DESC))
              WHERE (oi = bo AND ni = bn) OR (oi <> bo AND ni <> bn)),
{name} AS (SELECT g, oi, ni, sim FROM {name}_r WHERE won)"""


def alike(a: str, b: str) -> str:
    """SQL of the similarity of two texts of the fixture."""
    x, y = (f"string_split({c}, ' ')" for c in (a, b))
    return f"(CAST(2 * len(list_intersect({x}, {y})) AS DOUBLE) / (len({x}) + len({y})))"


_SIDE = "SELECT k, pair_id, CASE WHEN leaf LIKE 'dup%' THEN leaf ELSE top || '/' || leaf END AS path, division, 'Title ' || right(division, 1) AS title, CASE WHEN leaf LIKE 'sec%' THEN 'Sec. ' || k ELSE '' END AS section, body"
_AT = "row_number() OVER (PARTITION BY pair_id, path ORDER BY division_no, k)"
_CAND = "SELECT o.pair_id || '|' || o.path{more} AS g, o.spot AS oi, n.spot AS ni, CASE WHEN count(*) OVER (PARTITION BY o.pair_id, o.path{title}) = 1 THEN 1 ELSE " + alike("o.body", "n.body") + " END AS sim"
#: SQL of the matching: rows (pair_id, path, o, n, stage, out_ord).
MATCHED = f"""{WITH},
o AS ({_SIDE} FROM old), n AS ({_SIDE} FROM new),
sizes AS (SELECT pair_id, path, sum(a) AS no, sum(b) AS nn FROM (SELECT pair_id, path, 1 AS a, 0 AS b FROM o UNION ALL SELECT pair_id, path, 0, 1 FROM n) GROUP BY ALL),
divisions AS (SELECT pair_id, path, title, row_number() OVER (PARTITION BY pair_id, path ORDER BY fo IS NULL, coalesce(fo, fn)) AS division_no
              FROM (SELECT pair_id, path, title, min(a) AS fo, min(b) AS fn FROM (SELECT pair_id, path, title, k AS a, NULL AS b FROM o UNION ALL SELECT pair_id, path, title, NULL, k FROM n) GROUP BY ALL)),
ro AS (SELECT o.*, division_no, {_AT} AS spot FROM o JOIN sizes USING (pair_id, path) JOIN divisions USING (pair_id, path, title) WHERE no > 1 OR nn > 1),
rn AS (SELECT n.*, division_no, {_AT} AS spot FROM n JOIN sizes USING (pair_id, path) JOIN divisions USING (pair_id, path, title) WHERE no > 1 OR nn > 1),
c1 AS ({_CAND.format(more=" || '|' || o.title", title=', o.title')} FROM ro o JOIN rn n USING (pair_id, path, title)),
{claims('g1', 'c1')},
m1 AS (SELECT o.pair_id, o.path, oi, ni, 1 AS stage, o.division_no AS d, sim FROM g1 JOIN ro o ON g = o.pair_id || '|' || o.path || '|' || o.title AND oi = o.spot),
lo AS (SELECT * FROM ro ANTI JOIN m1 ON ro.pair_id = m1.pair_id AND ro.path = m1.path AND ro.spot = m1.oi), ln AS (SELECT * FROM rn ANTI JOIN m1 ON rn.pair_id = m1.pair_id AND rn.path = m1.path AND rn.spot = m1.ni),
c2 AS ({_CAND.format(more='', title='')} FROM lo o JOIN ln n USING (pair_id, path)),
{claims('g2', 'c2')},
m2 AS (SELECT o.pair_id, o.path, oi, ni, 2 AS stage, 0 AS d, sim FROM g2 JOIN lo o ON g = o.pair_id || '|' || o.path AND oi = o.spot),
m3 AS (SELECT pair_id, path, spot AS oi, NULL AS ni, 3 AS stage, 0 AS d, 0 AS sim FROM lo ANTI JOIN m2 ON lo.pair_id = m2.pair_id AND lo.path = m2.path AND lo.spot = m2.oi),
m4 AS (SELECT pair_id, path, NULL AS oi, spot AS ni, 4 AS stage, 0 AS d, 0 AS sim FROM ln ANTI JOIN m2 ON ln.pair_id = m2.pair_id AND ln.path = m2.path AND ln.spot = m2.ni),
hard AS (SELECT m.pair_id, m.path, o.k AS o, n.k AS n, stage,
                row_number() OVER (PARTITION BY m.pair_id, m.path ORDER BY stage, d, m.sim DESC, CASE WHEN stage <= 2 THEN -oi ELSE coalesce(oi, ni) END, ni DESC) AS place
         FROM (FROM m1 UNION ALL FROM m2 UNION ALL FROM m3 UNION ALL FROM m4) m LEFT JOIN ro o ON o.pair_id = m.pair_id AND o.path = m.path AND o.spot = oi LEFT JOIN rn n ON n.pair_id = m.pair_id AND n.path = m.path AND n.spot = ni),
easy AS (SELECT coalesce(o.pair_id, n.pair_id) AS pair_id, coalesce(o.path, n.path) AS path, o.k AS o, n.k AS n, 0 AS stage, 1 AS place
         FROM (SELECT o.* FROM o JOIN sizes USING (pair_id, path) WHERE no <= 1 AND nn <= 1) o FULL JOIN (SELECT n.* FROM n JOIN sizes USING (pair_id, path) WHERE no <= 1 AND nn <= 1) n ON o.pair_id = n.pair_id AND o.path = n.path),
matched AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY fo IS NULL, coalesce(fo, fn), place) AS out_ord
            FROM (SELECT *, min(o) OVER (PARTITION BY pair_id, path) AS fo, min(n) OVER (PARTITION BY pair_id, path) AS fn FROM (FROM easy UNION ALL FROM hard)))"""
#: SQL of the changes: rows (pair_id, kind, path, ok, nk, spot), moves reconciled; ok and nk are the nodes' numbers.
CHANGES = f"""{MATCHED},
judged AS (SELECT m.*, o.body AS a, n.body AS b, CASE WHEN o.body IS NOT NULL AND n.body IS NOT NULL THEN {alike('o.body', 'n.body')} END AS sim FROM matched m LEFT JOIN old o ON m.o = o.k LEFT JOIN new n ON m.n = n.k),
split AS (SELECT pair_id, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'removed' WHEN a = b THEN 'unchanged' ELSE 'modified' END AS kind, path, o AS ok, n AS nk, CAST(out_ord AS DOUBLE) AS spot, a, b
          FROM judged WHERE a IS NULL OR b IS NULL OR a = b OR sim >= 0.4
          UNION ALL SELECT pair_id, 'removed', path, o, NULL, CAST(out_ord AS DOUBLE), a, NULL FROM judged WHERE a <> b AND sim < 0.4
          UNION ALL SELECT pair_id, 'added', path, NULL, n, out_ord + 0.5, NULL, b FROM judged WHERE a <> b AND sim < 0.4),
placed AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY spot, kind) AS cid FROM split),
c3 AS (SELECT * FROM (SELECT r.pair_id AS g, r.cid AS oi, d.cid AS ni, {alike('r.a', 'd.b')} AS sim FROM placed r JOIN placed d USING (pair_id) WHERE r.kind = 'removed' AND d.kind = 'added') WHERE sim >= 0.6),
{claims('g3', 'c3')},
last AS (SELECT pair_id, max(spot) AS last FROM placed GROUP BY 1),
changes AS (SELECT pair_id, kind, path, ok, nk, spot, a, b FROM placed ANTI JOIN (SELECT g, oi AS cid FROM g3 UNION ALL SELECT g, ni FROM g3) u ON placed.pair_id = u.g AND placed.cid = u.cid
            UNION ALL SELECT g, 'moved', r.path, r.ok, d.nk, last + row_number() OVER (PARTITION BY g ORDER BY sim DESC, oi DESC, ni DESC), r.a, d.b
                      FROM g3 JOIN placed r ON r.pair_id = g AND r.cid = oi JOIN placed d ON d.pair_id = g AND d.cid = ni JOIN last ON last.pair_id = g)"""
