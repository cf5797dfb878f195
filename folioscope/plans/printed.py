"""Printed pages in two versions, made from ``orders``, and what the page pipeline must make of them, in SQL.

Each order is a title, a section, one of two forms of account, or plain lines, some without a number.  Version 2 lacks some
orders, renumbers sections and changes amounts and words.  The words of a block differ, as in the other fixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixture import alike, claims

ROMAN = "['I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII']"
#: Lines of each order: (what it is, whether it has a number, its text), in both dialects' SQL; {s} is the string type.
_K, _AMOUNT = "CAST(k AS STRING)", "CAST(amount + CASE WHEN version = 2 AND k % 3 = 0 THEN 1000 ELSE 0 END AS STRING)"
PARTS = {
    0: [("title", 1, f"'TITLE ' || roman || ' Part k' || {_K}")],
    1: [("section", 1, f"'SEC. ' || {_K} || CASE WHEN version = 2 AND k % 7 = 0 THEN '9' ELSE '' END || '. Word' || {_K} || ' rule' || {_K} || ' that' || {_K}")],
    2: [("head", 1, f"'OFFICE OF K' || {_K}"), ("account", 1, f"'For necessary expenses of key' || {_K} || ', $' || {_AMOUNT} || ', appro-'"), ("rest", 1, f"'priated plan' || {_K}")],
    3: [("head", 1, f"'SECRET SERVICE K' || {_K}"), ("plain", 0, f"'note' || {_K}"), ("account", 1, f"'For necessary expenses of unit' || {_K} || ', $' || {_AMOUNT}")],
    4: [("plain", 1, f"'w' || {_K} || ' x' || {_K} || CASE WHEN version = 2 AND k % 5 = 0 THEN ' z' ELSE ' y' END || {_K}")],
    5: [("plain", 1, f"'v' || {_K} || ' u' || {_K}")],
    6: [("plain", 0, f"'free' || {_K} || ' line' || {_K}")],
    7: [("plain", 1, f"'t' || {_K}")],
}
_LINES = " UNION ALL ".join(f"SELECT doc_id, version, page, k, {i} AS i, '{what}' AS what, {numbered} AS numbered, {text} AS text FROM v WHERE k % 8 = {kind}" for kind, parts in PARTS.items() for i, (what, numbered, text) in enumerate(parts))
_VERSIONS = "SELECT o.*, 1 AS version FROM o UNION ALL SELECT o.*, 2 FROM o WHERE k % 13 <> 0"
_ORDERS = "SELECT o_orderkey AS k, CAST(floor(o_orderkey / 320) AS BIGINT) AS doc_id, CAST(floor(o_orderkey / 40) % 8 + 1 AS INTEGER) AS page, CAST(floor(o_totalprice) AS BIGINT) AS amount, {roman} AS roman FROM {orders}"
_NUMBERED = "SELECT *, row_number() OVER (PARTITION BY doc_id, version, page ORDER BY k, i) AS at_line, CASE WHEN numbered = 1 THEN CAST(sum(numbered) OVER (PARTITION BY doc_id, version, page ORDER BY k, i) AS INTEGER) END AS line_number FROM l"


def raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, version, page, raw): page text with a number line, line numbers, and a footer."""
    orders = _ORDERS.replace("{roman}", f"element_at(array({ROMAN[1:-1]}), CAST(floor(o_orderkey / 40) % 8 + 1 AS INTEGER))")
    sql = f"WITH o AS ({orders}), v AS ({_VERSIONS}), l AS ({_LINES}) {_NUMBERED}"
    lines = spark.sql(sql, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    shown = F.concat(F.when(F.col("line_number").isNotNull(), F.concat(F.col("line_number").cast("string"), F.lit(" "))).otherwise(""), F.col("text"))
    rows = lines.withColumn("shown", shown).groupBy("doc_id", "version", "page").agg(F.array_sort(F.collect_list(F.struct("at_line", "shown"))).alias("p"))
    body = F.array_join(F.transform("p", lambda x: x["shown"]), "\n")
    return rows.select("doc_id", "version", "page", F.concat(F.col("page").cast("string"), F.lit("\n"), body, F.lit("\n•HR 5 RH")).alias("raw"))


_ORDER = "PARTITION BY doc_id, version ORDER BY page, k, i"
_WORDS = lambda x: f"replace({x}, chr(10), ' ')"
#: SQL of the pipeline's tables: lines, anchors, crumbs, blocks, steps and hunks.
PIPELINE = f"""WITH RECURSIVE o AS ({_ORDERS.replace('{roman}', ROMAN + '[CAST(floor(o_orderkey / 40) % 8 + 1 AS INTEGER)]').replace('{orders}', 'orders')}), v AS ({_VERSIONS}), l AS ({_LINES}), numbered AS ({_NUMBERED}),
lines AS (SELECT doc_id, version, page, k, i, what, line_number, CASE WHEN what = 'account' AND k % 8 = 2 THEN left(text, length(text) - 1) || 'priated plan' || k ELSE text END AS text FROM numbered WHERE what <> 'rest'),
anchors AS (SELECT doc_id, version, page, k, i, line_number, CASE what WHEN 'head' THEN 'account' ELSE what END AS kind,
                   CASE what WHEN 'title' THEN regexp_extract(text, '^TITLE [IVX]+') WHEN 'section' THEN regexp_extract(text, '^SEC. [0-9]+') ELSE text END AS text FROM lines WHERE what IN ('title', 'section', 'head')),
crumbs AS (SELECT *, CASE WHEN kind = 'title' THEN text ELSE coalesce(last_value(CASE WHEN kind = 'title' THEN text END IGNORE NULLS) OVER ({_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) || ' > ', '') || text END AS crumb FROM anchors),
marked AS (SELECT l.*, a.text AS anchor, crumb, count(a.text) OVER (PARTITION BY l.doc_id, l.version ORDER BY l.page, l.k, l.i) AS block_ord FROM lines l LEFT JOIN crumbs a USING (doc_id, version, page, k, i)),
joined AS (SELECT doc_id, version, block_ord, max(anchor) AS anchor, max(crumb) AS crumb, string_agg(text, chr(10) ORDER BY page, k, i) AS text, arg_min((page, line_number), CAST(page AS BIGINT) * 1000000000000 + k * 3 + i) AS a, arg_max((page, line_number), CAST(page AS BIGINT) * 1000000000000 + k * 3 + i) AS z FROM marked GROUP BY ALL),
blocks AS (SELECT *, coalesce(anchor, '(preamble)') || '::' || regexp_replace(left(text, 80), '^\\s+|\\s+$', '', 'g') AS key FROM joined),
keyed AS (SELECT *, count(*) OVER (PARTITION BY doc_id, key) = 2 AS met FROM blocks),
gaps AS (SELECT *, sum(CASE WHEN met THEN 1 ELSE 0 END) OVER w AS gap FROM keyed WINDOW w AS (PARTITION BY doc_id, version ORDER BY block_ord)),
spots AS (SELECT *, CASE WHEN met THEN 0 ELSE row_number() OVER (PARTITION BY doc_id, version, gap, met ORDER BY block_ord) END AS spot FROM gaps),
steps AS (SELECT doc_id, a.anchor AS a1, b.anchor AS a2, a.crumb AS c1, b.crumb AS c2, a.text AS t1, b.text AS t2, a.a AS s1, a.z AS e1, b.a AS s2, b.z AS e2,
                 row_number() OVER (PARTITION BY doc_id ORDER BY gap, spot > 0, CASE WHEN a.text IS NULL THEN 2 WHEN b.text IS NULL THEN 1 ELSE 0 END, spot) - 1 AS step
          FROM (SELECT * FROM spots WHERE version = 1) a FULL JOIN (SELECT * FROM spots WHERE version = 2) b USING (doc_id, gap, spot)),
scored AS (SELECT *, CASE WHEN t1 IS NOT NULL AND t2 IS NOT NULL THEN {alike(_WORDS('t1'), _WORDS('t2'))} END AS sim FROM steps WHERE t1 IS DISTINCT FROM t2),
split AS (SELECT doc_id, 'removed' AS kind, CAST(step AS DOUBLE) AS spot, a1, NULL AS a2, c1, NULL AS c2, t1, NULL AS t2, s1, e1, NULL AS s2, NULL AS e2 FROM scored WHERE t2 IS NULL OR sim < 0.4
          UNION ALL SELECT doc_id, 'added', CASE WHEN t1 IS NULL THEN step ELSE step + 0.5 END, NULL, a2, NULL, c2, NULL, t2, NULL, NULL, s2, e2 FROM scored WHERE t1 IS NULL OR sim < 0.4
          UNION ALL SELECT doc_id, CASE WHEN a1 <> a2 AND sim >= 0.6 THEN 'moved' ELSE 'modified' END, step, a1, a2, c1, c2, t1, t2, s1, e1, s2, e2 FROM scored WHERE sim >= 0.4),
cand AS (SELECT * FROM (SELECT r.doc_id AS g, r.spot AS oi, d.spot AS ni, {alike(_WORDS('r.t1'), _WORDS('d.t2'))} AS sim FROM split r JOIN split d USING (doc_id) WHERE r.kind = 'removed' AND d.kind = 'added') WHERE sim >= 0.6),
{claims('took', 'cand')},
hunks AS (SELECT * FROM split ANTI JOIN (SELECT g, oi AS spot, 'removed' AS kind FROM took UNION ALL SELECT g, ni, 'added' FROM took) u ON split.doc_id = u.g AND split.spot = u.spot AND split.kind = u.kind
          UNION ALL SELECT g, 'moved', oi, r.a1, d.a2, r.c1, d.c2, r.t1, d.t2, r.s1, r.e1, d.s2, d.e2 FROM took JOIN split r ON r.doc_id = g AND r.spot = oi AND r.kind = 'removed' JOIN split d ON d.doc_id = g AND d.spot = ni AND d.kind = 'added')"""
