"""Fixture tables derived from the driver's tables by SQL.

Each fixture exists twice: as a Spark job over the given DataFrames, and as
DuckDB SQL text over the pre-registered views, so the oracle queries can
rebuild exactly the same rows.  Fixtures read whole tables and whole texts.

incidents      -- burglary reports: one per order, co-offender pairs (orders
                  2m and 2m+1 share a narrative), the stolen-property list is
                  the order's part names.
tokens         -- (doc_id, pos, token) of every document, whitespace split
tagged_tokens  -- (token, tag) tagger training data
senses         -- (term, sense, gloss_term) word senses of part-name words
ancestors      -- (sense, ancestor, dist) two-level sense hierarchy
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- incidents ---------------------------------------------------------------

_NARRATIVE = """
  CASE WHEN o.k % 202 = 0 THEN NULL ELSE
    CASE o.k % 8 WHEN 0 THEN 'PREMISES-REAR POINT OF ENTRY-DOOR. '
                 WHEN 2 THEN 'PREMISES-FRONT POE - WINDOW. '
                 WHEN 4 THEN 'PREMISES-SIDE POE - GARAGE. '
                 ELSE 'ACCESS NOT STATED. ' END
    || '__________________________________ CREATED BY UNIT ' || CAST(o.k AS STRING)
    || CASE o.k % 6 WHEN 0 THEN ' NARRATIVE: HOUSE WAS LOCKED. ROOMS RUMMAGED. '
                    WHEN 2 THEN ' CIRCUMSTANCES: GATE NOT LOCKED. NO MESSY ROOM. '
                    WHEN 4 THEN ' NARRATIVE: DRAWERS TIPPED OUT. WINDOW BOLTED. '
                    ELSE ' NO HEADING ' END
    || 'OFFENDER TOOK ' || coalesce(i.stolen, 'NOTHING') || ' FROM '
    || lower(o.o_orderpriority) || ' ROOM. '
    || 'PROPERTY STOLEN: ' || coalesce(i.stolen, 'NOTHING') || '_ END * TAIL'
  END"""

_INCIDENT_SELECT = """
SELECT o.o_orderkey AS incident_id,
       'P' || CAST(o.o_custkey AS STRING) AS offender,
       CASE o.k % 10 WHEN 0 THEN 'Residential' WHEN 2 THEN 'Farm' WHEN 4 THEN 'Commercial'
                     WHEN 6 THEN 'Public Place' ELSE 'Other' END AS location_type,
       lpad(CAST(day(o.o_orderdate) AS STRING), 2, '0') || '/'
         || lpad(CAST(month(o.o_orderdate) AS STRING), 2, '0') || '/'
         || CAST(year(o.o_orderdate) AS STRING) AS occurred_date,
       CAST(1 + o.o_orderkey % 12 AS STRING) || ':30 '
         || CASE WHEN o.o_orderkey % 5 < 2 THEN 'AM' ELSE 'PM' END AS occurred_time,
       5000000 + (o.o_custkey * 7919) % 90000 AS northing,
       1700000 + (o.o_orderkey * 104729) % 90000 AS easting,
       {narrative} AS narrative
FROM (SELECT o_orderkey, o_custkey, o_orderdate, o_orderpriority,
             o_orderkey - o_orderkey % 2 AS k FROM {orders}) o
LEFT JOIN items i ON i.k = o.k
"""

INCIDENTS_SPARK = """
WITH items AS (
  SELECT l.l_orderkey - l.l_orderkey % 2 AS k,
         array_join(transform(array_sort(collect_list(named_struct('n', l.l_linenumber, 'pk', l.l_partkey, 'name', p.p_name))),
                              x -> x.name), ', ') AS stolen
  FROM {lineitem} l JOIN {part} p ON p.p_partkey = l.l_partkey
  GROUP BY l.l_orderkey - l.l_orderkey % 2)
""" + _INCIDENT_SELECT.replace("{narrative}", _NARRATIVE)

INCIDENTS_DUCK = """
items AS (
  SELECT l.l_orderkey - l.l_orderkey % 2 AS k, string_agg(p.p_name, ', ' ORDER BY l.l_linenumber, l.l_partkey, p.p_name) AS stolen
  FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey
  GROUP BY l.l_orderkey - l.l_orderkey % 2),
incidents AS (""" + _INCIDENT_SELECT.replace("{narrative}", _NARRATIVE).replace("{orders}", "orders") + ")"


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report table of the linkage job, derived from orders, lineitem, part."""
    return spark.sql(INCIDENTS_SPARK,
                     orders=load(spark, sf_dir, "orders"),
                     lineitem=load(spark, sf_dir, "lineitem"),
                     part=load(spark, sf_dir, "part"))


# --- tokens, tagged tokens -------------------------------------------------------

TOKENS_SPARK = """
SELECT doc_id, pos, token FROM (
  SELECT doc_id, posexplode(filter(split(lower(text), '\\\\s+'), x -> x <> '')) AS (pos, token)
  FROM {documents})
"""

TOKENS_DUCK = """
tokens AS (
  SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, toks[i] AS token
  FROM (SELECT doc_id, toks, unnest(range(1, len(toks) + 1)) AS i
        FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS toks
              FROM documents)))"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TOKENS_SPARK, documents=load(spark, sf_dir, "documents"))


_TAGGED_SELECT = """
SELECT token, CASE WHEN doc_id % 5 = 0 THEN 'VB' WHEN length(token) % 3 = 0 THEN 'NN'
                   WHEN length(token) % 3 = 1 THEN 'NNS' ELSE 'DT' END AS tag
FROM {tokens}
UNION ALL
SELECT lower(w) AS token, CASE WHEN i = n THEN 'NN' ELSE 'JJ' END AS tag
FROM {part_words}"""

_PART_WORDS_SPARK = """
SELECT posexplode(split(p_name, ' ')) AS (i0, w), size(split(p_name, ' ')) AS n FROM {part}"""

TAGGED_DUCK = """tagged_tokens AS (""" + _TAGGED_SELECT.replace("{tokens}", "tokens").replace(
    "{part_words}", """(SELECT unnest(string_split(p_name, ' ')) AS w,
        unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS i, len(string_split(p_name, ' ')) AS n FROM part)""") + ")"


def tagged_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagger training rows: document tokens tagged by a rule, plus part-name
    words (last word NN, the others JJ)."""
    words = spark.sql(_PART_WORDS_SPARK, part=load(spark, sf_dir, "part")) \
        .selectExpr("w", "i0 + 1 AS i", "n")
    return spark.sql(_TAGGED_SELECT, tokens=tokens(spark, sf_dir), part_words=words)


# --- senses, ancestors -----------------------------------------------------------

_SENSES_SELECT = """
SELECT DISTINCT w AS term, w || '.' || lower(p_type) AS sense, g AS gloss_term
FROM {part} LATERAL VIEW explode(split(p_name, ' ')) a AS w
            LATERAL VIEW explode(split(p_name, ' ')) b AS g"""

_SENSES_DUCK = """
senses AS (
  SELECT DISTINCT w AS term, w || '.' || lower(p_type) AS sense, g AS gloss_term
  FROM (SELECT p_type, w, unnest(string_split(p_name, ' ')) AS g
        FROM (SELECT p_type, p_name, unnest(string_split(p_name, ' ')) AS w FROM part)))"""

_ANCESTORS_SELECT = """
WITH s AS (SELECT DISTINCT sense, substring_index(sense, '.', -1) AS kind FROM {senses})
SELECT sense, sense AS ancestor, 0 AS dist FROM s
UNION ALL SELECT sense, kind AS ancestor, 1 AS dist FROM s
UNION ALL SELECT sense, 'root' AS ancestor, 2 AS dist FROM s"""

_ANCESTORS_DUCK = """
ancestors AS (
  WITH s AS (SELECT DISTINCT sense, split_part(sense, '.', 2) AS kind FROM senses)
  SELECT sense, sense AS ancestor, 0 AS dist FROM s
  UNION ALL SELECT sense, kind AS ancestor, 1 AS dist FROM s
  UNION ALL SELECT sense, 'root' AS ancestor, 2 AS dist FROM s)"""

SENSES_DUCK = _SENSES_DUCK
ANCESTORS_DUCK = _ANCESTORS_DUCK


def senses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_SENSES_SELECT, part=load(spark, sf_dir, "part"))


def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_ANCESTORS_SELECT, senses=senses(spark, sf_dir))


# --- gaps (nulls for the fill / impute operators) ------------------------------

GAPS_SELECT = """
SELECT o_orderkey, o_custkey, o_orderpriority,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(floor(o_totalprice / 1000) AS INT) END AS price_k,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS priority
FROM {orders}"""

GAPS_DUCK = "gaps AS (" + GAPS_SELECT.replace("{orders}", "orders") + ")"


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with holes: every 13th price, every 11th int price, every 7th priority."""
    return spark.sql(GAPS_SELECT, orders=load(spark, sf_dir, "orders"))
