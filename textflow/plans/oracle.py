"""DuckDB SQL for each registered query (the correctness oracle)."""

from __future__ import annotations

from textflow.plans import fixtures as FX

SQL: dict = {}

# ---- shared SQL fragments (DuckDB dialect) ----------------------------------

def vote(c: str, words: str) -> str:
    neg = "NOT |NO |HAVEN'T|DIDN'T|DIDNT|HAVENT".replace("'", "''")
    return (f"CASE WHEN {c} IS NULL THEN NULL WHEN coalesce(list_sum(list_transform("
            f"list_filter(string_split({c}, '.'), lambda s: regexp_matches(s, '{words}')), "
            f"lambda s: CASE WHEN regexp_matches(s, '{neg}') THEN -1 ELSE 1 END)), 0) > 0 THEN 1 ELSE 0 END")


def first_match(c: str, pairs) -> str:
    parts = " ".join(f"WHEN contains({c}, '{n}') THEN '{v}'" for n, v in pairs)
    return f"CASE WHEN {c} IS NULL THEN NULL {parts} ELSE 'UNKNOWN' END"


SECTION = """CASE WHEN contains(string_split(coalesce(narrative, ''), '__________________________________ CREATED BY')[-1], 'NARRATIVE')
       OR contains(string_split(coalesce(narrative, ''), '__________________________________ CREATED BY')[-1], 'CIRCUMSTANCES')
  THEN regexp_split_to_array(substr(regexp_split_to_array(string_split(coalesce(narrative, ''),
         '__________________________________ CREATED BY')[-1], 'NARRATIVE|CIRCUMSTANCES')[-1], 2), '[*:]')[1]
  ELSE string_split(coalesce(narrative, ''), '__________________________________ CREATED BY')[-1] END"""

FEATURES_SELECT = f"""
SELECT incident_id, offender, narrative, northing, easting,
  {first_match('location_type', [('Farm', '1'), ('Residenti', '2'), ('Commerci', '3'), ('Publi', '4')])} AS location_code,
  CAST(CAST(try_strptime(trim(occurred_date), '%d/%m/%Y') AS DATE) - DATE '0001-01-01' + 1 AS INTEGER) AS ordinal_date,
  CAST(TRY_CAST(trim(split_part(occurred_time, ':', 1)) AS INTEGER)
       + CASE WHEN contains(occurred_time, 'PM') THEN 12 ELSE 0 END AS INTEGER) AS hour,
  {first_match('narrative', [(x, x) for x in ['PREMISES-REAR', 'PREMISES-FRONT', 'PREMISES-SIDE']])} AS entry_location,
  CASE WHEN narrative IS NULL THEN NULL
       WHEN contains(narrative, 'POINT OF ENTRY-DOOR') OR contains(narrative, 'POE - DOOR') THEN 'POINT OF ENTRY-DOOR'
       WHEN contains(narrative, 'POINT OF ENTRY-WINDOW') OR contains(narrative, 'POE - WINDOW') THEN 'POINT OF ENTRY-WINDOW'
       WHEN contains(narrative, 'POINT OF ENTRY-FENCE') OR contains(narrative, 'POE - FENCE') THEN 'POINT OF ENTRY-FENCE'
       WHEN contains(narrative, 'POINT OF ENTRY-DOOR: GARAGE') OR contains(narrative, 'POE - GARAGE') THEN 'POINT OF ENTRY-DOOR: GARAGE'
       ELSE 'UNKNOWN' END AS entry_point,
  CAST(isodow(CAST(try_strptime(occurred_date, '%d/%m/%Y') AS DATE)) - 1 AS INTEGER) AS day_of_week,
  CAST(northing AS VARCHAR) || '-' || CAST(easting AS VARCHAR) AS grid_key,
  {SECTION} AS method_of_entry,
  {first_match('narrative', [('DEFECA', '1'), ('URINAT', '2'), ('MASTURB', '3'), ('GRAFFIT', '4')])} AS signature,
  {vote('narrative', 'LOCKED|FENCED|GATED|SECURED|BOLTED')} AS property_secure
FROM (SELECT * REPLACE (coalesce(narrative, '') AS narrative) FROM incidents)"""

FEATURES_DUCK = f"""features AS (
SELECT *, {vote('method_of_entry', 'MESSY|MESSIL|RUMMAG|TIPPED')} AS messy FROM ({FEATURES_SELECT}))"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


INCIDENT_CTES = with_ctes(FX.INCIDENTS_DUCK, FEATURES_DUCK)

SQL["incident_features"] = INCIDENT_CTES + """
SELECT incident_id, offender, location_code, ordinal_date, hour, entry_location, entry_point,
       day_of_week, grid_key, method_of_entry, messy, signature, property_secure
FROM features"""


# ---- linkage -------------------------------------------------------------------

from textflow.operators.draws import draw_steps, key_steps, mixed, sql_steps  # noqa: E402
from textflow.plans.stopwords import ENGLISH as _STOP  # noqa: E402

STOP_LIST = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in _STOP) + "]"
_PUNCT = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"

K1_CTES = """,
counts AS (SELECT offender, count(*) AS cnt FROM features GROUP BY offender),
cand AS (SELECT DISTINCT narrative, offender FROM features WHERE narrative <> ''),
best AS (SELECT c.narrative, first(c.offender ORDER BY k.cnt DESC, c.offender) AS primary_off
         FROM cand c JOIN counts k USING (offender) GROUP BY c.narrative),
reports AS MATERIALIZED (SELECT f.* REPLACE (coalesce(b.primary_off, f.offender) AS offender),
                   f.offender AS original_offender
            FROM features f LEFT JOIN best b USING (narrative)),
sizes AS (SELECT offender, count(*) AS n FROM reports GROUP BY offender),
stats AS (SELECT count(*) AS groups, CAST(sum(n * (n - 1) / 2) AS BIGINT) AS linked,
                 CAST(sum(n) AS BIGINT) AS reports FROM sizes),
stats2 AS (SELECT *, CAST(ceil(linked / groups) * 1 AS BIGINT) AS to_select FROM stats)
"""

LINK_CTES = INCIDENT_CTES.rstrip() + K1_CTES

SQL["fingerprint"] = with_ctes(FX.INCIDENTS_DUCK).rstrip() + """
SELECT incident_id, sha256(coalesce(narrative, '')) AS narrative_hash FROM incidents"""

SQL["primary_offender"] = LINK_CTES + "SELECT incident_id, original_offender, offender FROM reports"

SQL["primary_offender_merged"] = (
    LINK_CTES.replace("FROM features WHERE narrative <> ''", "FROM features")
    + "SELECT incident_id, original_offender, offender FROM reports")

SQL["link_stats"] = LINK_CTES + """
SELECT groups, linked, reports, to_select,
       round(to_select * reports / (linked + to_select * reports), 6) AS balance FROM stats2"""

POS_CTE = """,
pos AS (SELECT a.incident_id AS l, b.incident_id AS r, 1.0 / s.n AS weight, 1 AS class
        FROM reports a JOIN reports b ON a.offender = b.offender AND a.incident_id < b.incident_id
        JOIN sizes s ON s.offender = a.offender)
"""

NEG_CTE = """,
grp AS (SELECT offender, n, CAST(row_number() OVER (ORDER BY gkey) - 1 AS BIGINT) AS gid
        FROM (SELECT offender, min(incident_id) AS gkey, count(*) AS n FROM reports GROUP BY offender)),
rep AS (SELECT r.incident_id AS id, g.gid,
               CAST(row_number() OVER (PARTITION BY r.offender ORDER BY r.incident_id) - 1 AS BIGINT) AS rk
        FROM reports r JOIN grp g USING (offender)),
st AS (SELECT G, K, arg_min(a, ((a - (G - 1) % a) % a) * 1000000 + abs(a - root)) AS a FROM (
         SELECT groups AS G, to_select AS K, greatest(1, CAST(floor(sqrt(groups - 1)) AS BIGINT)) AS root,
                unnest(range(greatest(1, CAST(floor(sqrt(groups - 1)) AS BIGINT) // 4), 4 * greatest(1, CAST(floor(sqrt(groups - 1)) AS BIGINT)) + 1)) AS a FROM stats2)
       GROUP BY G, K),
keyed AS (""" + sql_steps("""SELECT rep.id AS l, rep.gid, (rep.id % 2147483647 + rep.id // 2147483647 % 2147483647 * 40503) % 2147483647 AS h FROM rep""",
                           key_steps("h")) + """),
draws AS (SELECT l, _pick, (gid + 1 + _draw) % G AS tg FROM (""" + sql_steps(
    """SELECT keyed.*, unnest(range(0, st.K)) AS j, st.G, st.a, (st.G - 1 + st.a - 1) // st.a AS b FROM keyed, st""",
    draw_steps("j", "(G - 1)", "a", "b", 4) + [("_y", mixed("j", "_k1")[0]), ("_pick", mixed("j", "_k1")[1].format(y="_y"))]) + """)),
neg AS (SELECT d.l, t.id AS r, 1.0 AS weight, 0 AS class
        FROM draws d JOIN grp gt ON gt.gid = d.tg
        JOIN rep t ON t.gid = d.tg AND t.rk = d._pick % gt.n)
"""

SQL["positive_pairs"] = LINK_CTES + POS_CTE + "SELECT l, r, round(weight, 6) AS weight, class FROM pos"
SQL["negative_pairs"] = LINK_CTES + NEG_CTE + "SELECT l, r, weight, class FROM neg"

TERMS_CTE = f""",
toks AS (SELECT incident_id, list_filter(list_filter(regexp_split_to_array(
           regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
             translate(lower(method_of_entry), '{_PUNCT}', ''),
             '\\b(can)(not)\\b', '\\1 \\2', 'g'), '\\b(gim)(me)\\b', '\\1 \\2', 'g'),
             '\\b(gon)(na)\\b', '\\1 \\2', 'g'), '\\b(got)(ta)\\b', '\\1 \\2', 'g'),
             '\\b(lem)(me)\\b', '\\1 \\2', 'g'), '\\b(wan)(na)\\b', '\\1 \\2', 'g'),
           '\\s+'), lambda t: t <> ''), lambda t: NOT list_contains({STOP_LIST}, t)) AS tokens
         FROM reports),
grams AS (SELECT incident_id, tokens,
                 list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1]) AS bigrams
          FROM toks),
ndocs AS (SELECT count(*) AS n FROM reports),
tf1 AS (SELECT incident_id, term, count(*) AS tf FROM (SELECT incident_id, unnest(tokens) AS term FROM grams) GROUP BY ALL),
tf2 AS (SELECT incident_id, term, count(*) AS tf FROM (SELECT incident_id, unnest(bigrams) AS term FROM grams) GROUP BY ALL),
w1 AS MATERIALIZED (SELECT t.incident_id, t.term, t.tf * ln((ndocs.n + 1.0) / (d.df + 1.0)) AS w
       FROM tf1 t JOIN (SELECT term, count(*) AS df FROM tf1 GROUP BY term) d USING (term), ndocs),
w2 AS MATERIALIZED (SELECT t.incident_id, t.term, t.tf * ln((ndocs.n + 1.0) / (d.df + 1.0)) AS w
       FROM tf2 t JOIN (SELECT term, count(*) AS df FROM tf2 GROUP BY term) d USING (term), ndocs),
n1 AS (SELECT incident_id, sqrt(sum(w * w)) AS norm FROM w1 GROUP BY incident_id),
n2 AS (SELECT incident_id, sqrt(sum(w * w)) AS norm FROM w2 GROUP BY incident_id)
"""


def _cos(pairs: str, w: str, nrm: str, name: str) -> str:
    # pair -> left terms first, then the right side on (id, term): never a term-only join
    return f"""(SELECT p.l, p.r,
      CASE WHEN nl.norm IS NULL OR nr.norm IS NULL OR nl.norm * nr.norm = 0 THEN NULL
           ELSE coalesce(d.dot, 0.0) / (nl.norm * nr.norm) END AS {name}
    FROM (SELECT DISTINCT l, r FROM {pairs}) p
    LEFT JOIN {nrm} nl ON nl.incident_id = p.l LEFT JOIN {nrm} nr ON nr.incident_id = p.r
    LEFT JOIN (SELECT pa.l, pa.r, sum(pa.w * b.w) AS dot FROM {pairs}_{w} pa
               JOIN {w} b ON b.incident_id = pa.r AND b.term = pa.term
               GROUP BY pa.l, pa.r) d ON d.l = p.l AND d.r = p.r)"""


def _nominal(a: str, b: str) -> str:
    return (f"CASE WHEN {a} IS NULL OR {b} IS NULL OR CAST({a} AS VARCHAR) = 'UNKNOWN' "
            f"OR CAST({b} AS VARCHAR) = 'UNKNOWN' THEN NULL WHEN CAST({a} AS VARCHAR) = CAST({b} AS VARCHAR) "
            f"THEN 1 ELSE 0 END")


_PAIRS_CTE = """,
pairs AS MATERIALIZED (SELECT * FROM pos UNION ALL SELECT * FROM neg)"""
PF_CTE = _PAIRS_CTE + f""",
pairs_w1 AS MATERIALIZED (SELECT p.l, p.r, a.term, a.w FROM (SELECT DISTINCT l, r FROM pairs) p
                          JOIN w1 a ON a.incident_id = p.l),
pairs_w2 AS MATERIALIZED (SELECT p.l, p.r, a.term, a.w FROM (SELECT DISTINCT l, r FROM pairs) p
                          JOIN w2 a ON a.incident_id = p.l),
pf0 AS (SELECT p.l, p.r,
   {_nominal('a.location_code', 'b.location_code')} AS location_code,
   CAST(abs(a.ordinal_date - b.ordinal_date) AS INTEGER) AS ordinal_date,
   CAST(least(abs(a.hour - b.hour), 24 - abs(a.hour - b.hour)) AS INTEGER) AS hour,
   {_nominal('a.entry_location', 'b.entry_location')} AS entry_location,
   {_nominal('a.entry_point', 'b.entry_point')} AS entry_point,
   CAST(least(abs(a.day_of_week - b.day_of_week), 7 - abs(a.day_of_week - b.day_of_week)) AS INTEGER) AS day_of_week,
   CAST(trunc(sqrt((a.easting - b.easting) * (a.easting - b.easting)
                   + (a.northing - b.northing) * (a.northing - b.northing))) AS INTEGER) AS grid_distance,
   {_nominal('a.messy', 'b.messy')} AS messy,
   {_nominal('a.property_secure', 'b.property_secure')} AS property_secure,
   p.weight, p.class
  FROM pairs p JOIN reports a ON a.incident_id = p.l JOIN reports b ON b.incident_id = p.r),
pf AS (SELECT pf0.*, c1.cosine_tfidf, c2.cosine_tfidf2 FROM pf0
  LEFT JOIN {_cos('pairs', 'w1', 'n1', 'cosine_tfidf')} c1 ON c1.l = pf0.l AND c1.r = pf0.r
  LEFT JOIN {_cos('pairs', 'w2', 'n2', 'cosine_tfidf2')} c2 ON c2.l = pf0.l AND c2.r = pf0.r)
"""

PAIR_CTES = LINK_CTES + POS_CTE + NEG_CTE + TERMS_CTE + PF_CTE

SQL["pair_features"] = PAIR_CTES + """
SELECT l, r, location_code, ordinal_date, hour, entry_location, entry_point, day_of_week,
       grid_distance, messy, property_secure, round(weight, 6) AS weight, class,
       round(cosine_tfidf, 6) AS cosine_tfidf, round(cosine_tfidf2, 6) AS cosine_tfidf2
FROM pf"""

_INTS = ["location_code", "ordinal_date", "hour", "entry_location", "entry_point", "day_of_week",
         "grid_distance", "messy", "property_secure"]
_DBLS = ["property_senses", "cosine_tfidf", "cosine_tfidf2"]

# ---- text on whole documents ------------------------------------------------------

def _long(list_expr: str, name: str = "token", src: str = "documents", id_col: str = "doc_id") -> str:
    return f"""SELECT {id_col}, CAST(i - 1 AS INTEGER) AS pos, toks[i] AS {name}
FROM (SELECT {id_col}, toks, unnest(range(1, len(toks) + 1)) AS i
      FROM (SELECT {id_col}, {list_expr} AS toks FROM {src}))"""


T2_LIST = "list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')"
T3_LIST = f"""list_filter(regexp_split_to_array(
           regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
             translate(lower(text), '{_PUNCT}', ''),
             '\\b(can)(not)\\b', '\\1 \\2', 'g'), '\\b(gim)(me)\\b', '\\1 \\2', 'g'),
             '\\b(gon)(na)\\b', '\\1 \\2', 'g'), '\\b(got)(ta)\\b', '\\1 \\2', 'g'),
             '\\b(lem)(me)\\b', '\\1 \\2', 'g'), '\\b(wan)(na)\\b', '\\1 \\2', 'g'),
           '\\s+'), lambda t: t <> '')"""
T5_LIST = f"list_filter({T2_LIST}, lambda t: NOT list_contains({STOP_LIST}, t))"
BIGRAMS = "list_transform(range(1, len(t2)), lambda i: t2[i] || ' ' || t2[i + 1])"

SQL["tokenize"] = _long("regexp_split_to_array(lower(text), '\\s')")
SQL["tokenize_regex"] = _long(T2_LIST)
SQL["normalize_tokens"] = _long(T3_LIST)
SQL["remove_stopwords"] = _long(T5_LIST)
SQL["ngrams"] = _long(BIGRAMS, "ngram", src=f"(SELECT doc_id, {T2_LIST} AS t2 FROM documents)")
SQL["sentences"] = _long("string_split(text, '.')", "sentence")

DOC_TF = f"""WITH tf AS (SELECT doc_id, term, CAST(count(*) AS DOUBLE) AS tf
  FROM (SELECT doc_id, unnest({T2_LIST}) AS term FROM documents) GROUP BY doc_id, term)
"""
SQL["count_vector_terms"] = DOC_TF + "SELECT doc_id, term, tf FROM tf"
SQL["tf_idf_terms"] = DOC_TF + """,
d AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
SELECT doc_id, term, tf, df, round(ln(((SELECT count(*) FROM documents) + 1.0) / (df + 1.0)), 6) AS idf,
       round(tf * ln(((SELECT count(*) FROM documents) + 1.0) / (df + 1.0)), 6) AS tfidf
FROM tf JOIN d USING (term)"""

# ---- feature vectors --------------------------------------------------------------

SQL["index_labels"] = """
SELECT c_custkey, c_mktsegment, CAST(r.idx AS DOUBLE) AS segment_index FROM customer
JOIN (SELECT c_mktsegment, row_number() OVER (ORDER BY count(*) DESC, c_mktsegment) - 1 AS idx
      FROM customer GROUP BY c_mktsegment) r USING (c_mktsegment)"""

SQL["one_hot"] = """
WITH r AS (SELECT o_orderpriority, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) - 1 AS idx,
                  count(*) OVER () AS k FROM orders GROUP BY o_orderpriority)
SELECT o_orderkey, o_orderpriority, CAST(CASE WHEN idx < k - 1 THEN idx END AS INTEGER) AS hot,
       CAST(k - 1 AS INTEGER) AS width
FROM orders JOIN r USING (o_orderpriority)"""

_N = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
SQL["assemble_minmax"] = "WITH m AS (SELECT " + ", ".join(
    f"min({c}) AS mn_{c}, max({c}) AS mx_{c}" for c in _N) + " FROM lineitem)\nSELECT l_orderkey, l_linenumber, l_partkey, " + ", ".join(
    f"round(CASE WHEN mx_{c} = mn_{c} THEN 0.5 ELSE ({c} - mn_{c}) / (mx_{c} - mn_{c}) END, 6) AS s_{c}" for c in _N) + " FROM lineitem, m"
SQL["standardize"] = "WITH m AS (SELECT " + ", ".join(
    f"stddev_samp({c}) AS sd_{c}" for c in _N) + " FROM lineitem)\nSELECT l_orderkey, l_linenumber, l_partkey, " + ", ".join(
    f"round(CASE WHEN sd_{c} = 0 THEN 0.0 ELSE {c} / sd_{c} END, 6) AS z_{c}" for c in _N) + " FROM lineitem, m"

# ---- relational -----------------------------------------------------------------

GAPS = with_ctes(FX.GAPS_DUCK)
SQL["select_rename_drop"] = "SELECT o_orderkey, o_custkey AS customer, o_totalprice FROM orders"
SQL["fill_nulls"] = GAPS + """SELECT o_orderkey, o_custkey, o_orderpriority, coalesce(o_totalprice, 0.0) AS o_totalprice,
  price_k, coalesce(priority, 'UNKNOWN') AS priority FROM gaps"""
SQL["drop_nulls"] = GAPS + "SELECT * FROM gaps WHERE o_totalprice IS NOT NULL AND priority IS NOT NULL"
SQL["fill_int_mean"] = GAPS + """SELECT o_orderkey,
  coalesce(price_k, (SELECT CAST(round_even(avg(price_k), 0) AS INTEGER) FROM gaps)) AS price_k FROM gaps"""
SQL["impute_mean"] = GAPS + """SELECT o_orderkey,
  round(coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM gaps)), 6) AS o_totalprice_imputed FROM gaps"""
SQL["split_by_key"] = """SELECT o_orderkey, o_custkey,
  CASE WHEN ((o_orderkey % 1000003) * 40503 + 12345) % 100 < 90 THEN 'train' ELSE 'test' END AS split FROM orders"""
SQL["join_on"] = """SELECT o_orderkey, o_custkey, o_totalprice, c_name, c_mktsegment
  FROM orders JOIN customer ON c_custkey = o_custkey"""
SQL["join_branches"] = f"""SELECT doc_id, CAST(len(t2) AS INTEGER) AS n_tokens,
  CAST(greatest(len(t2) - 1, 0) AS INTEGER) AS n_bigrams, CAST(length(text) AS INTEGER) AS n_chars
  FROM (SELECT doc_id, text, {T2_LIST} AS t2 FROM documents)"""
SQL["attach_count"] = """SELECT l_orderkey, l_linenumber, l_partkey,
  count(*) OVER (PARTITION BY l_orderkey) AS n_lines FROM lineitem"""
SQL["count_by"] = "SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey"
SQL["primary_by"] = """SELECT o_custkey, first(o_orderpriority ORDER BY o_totalprice DESC, o_orderpriority)
  AS o_orderpriority FROM orders GROUP BY o_custkey"""
SQL["means"] = "SELECT " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in _N) + " FROM lineitem"
SQL["sql_source"] = """SELECT o.o_orderstatus, count(*) AS n_lines,
  round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderstatus"""
SQL["table_source"] = """SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"""
SQL["profile"] = """SELECT column_name AS "column",
  CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
       WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(column_type) END AS type,
  CAST(row_number() OVER () - 1 AS INTEGER) AS position, (SELECT count(*) FROM lineitem) AS n_rows,
  CAST(count(*) OVER () AS INTEGER) AS n_cols
FROM (DESCRIBE lineitem)"""


def _role(table: str, col: str, kind: str) -> str:
    if kind == "meta":
        return f"SELECT '{col}' AS \"column\", 'meta' AS role, CAST(NULL AS VARCHAR) AS \"values\""
    if kind == "float":
        return f"SELECT '{col}' AS \"column\", 'continuous' AS role, CAST(NULL AS VARCHAR) AS \"values\""
    d, m = f"count(DISTINCT {col})", f"max({col})"
    return (f"SELECT '{col}' AS \"column\", CASE WHEN {d} >= 13 OR {m} > {d} THEN 'continuous' ELSE 'discrete' END AS role, "
            f"CASE WHEN {d} >= 13 OR {m} > {d} THEN NULL ELSE array_to_string(list_sort(list_distinct(list({col}))), ',') END "
            f"AS \"values\" FROM {table}")


SQL["column_roles"] = "\nUNION ALL ".join([
    _role("nation", "n_nationkey", "int"), _role("nation", "n_name", "meta"),
    _role("nation", "n_regionkey", "int"), _role("part", "p_partkey", "int"),
    _role("part", "p_name", "meta"), _role("part", "p_brand", "meta"), _role("part", "p_type", "meta"),
    _role("part", "p_size", "int"), _role("part", "p_retailprice", "float")])

SQL["preview"] = """SELECT CAST(vec_id AS VARCHAR) AS vec_id,
  '[' || array_to_string(list_transform(embedding[1:10], lambda x: printf('%.4f', CAST(x AS DOUBLE))), ', ')
      || CASE WHEN len(embedding) > 10 THEN ', ...' ELSE '' END || ']' AS embedding,
  CAST(label AS VARCHAR) AS label
FROM embeddings ORDER BY embeddings.vec_id LIMIT 100"""


# ---- learning and evaluation -------------------------------------------------------

LABELLED = """WITH lab AS (SELECT d.doc_id, d.text, CAST(d.n_chars AS DOUBLE) AS score,
    CAST(len(string_split(d.text, chr(10))) AS DOUBLE) AS n_lines, l.quality, l.toxic
  FROM documents d JOIN labels l USING (doc_id))
"""


def _auc_sql(score: str) -> str:
    return f"""(SELECT sum(p * (coalesce(n_below, 0) + 0.5 * n)) / (sum(p) * sum(n)) FROM (
  SELECT p, n, sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n_below
  FROM (SELECT {score} AS s, sum(CASE WHEN quality > 0.5 THEN 1 ELSE 0 END) AS p,
               sum(CASE WHEN quality > 0.5 THEN 0 ELSE 1 END) AS n FROM lab GROUP BY {score})))"""


SQL["auc"] = LABELLED + f"SELECT round({_auc_sql('score')}, 6) AS auc"
SQL["compare_auc"] = LABELLED + f"""SELECT 'length' AS name, round({_auc_sql('score')}, 6) AS auc
UNION ALL SELECT 'lines' AS name, round({_auc_sql('n_lines')}, 6) AS auc"""

CUM = LABELLED + """, c AS (SELECT score AS threshold, sum(CASE WHEN quality > 0.5 THEN 1 ELSE 0 END) AS pos,
    sum(CASE WHEN quality > 0.5 THEN 0 ELSE 1 END) AS neg FROM lab GROUP BY score),
cum AS (SELECT threshold, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn,
          sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM c
        WINDOW w AS (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
"""
SQL["roc_points"] = CUM + "SELECT threshold, round(cn / N, 6) AS fpr, round(cp / P, 6) AS tpr FROM cum"
SQL["f_by_threshold"] = CUM + """SELECT threshold, round(cp / (cp + cn), 6) AS precision, round(cp / P, 6) AS recall,
  round(coalesce(CASE WHEN (cp / (cp + cn)) + (cp / P) = 0 THEN NULL
       ELSE 2 * (cp / (cp + cn)) * (cp / P) / ((cp / (cp + cn)) + (cp / P)) END, 0.0), 6) AS f FROM cum"""

SQL["measures"] = """
SELECT 'rmse' AS metric, round(sqrt(avg((l_extendedprice - l_quantity * p_retailprice) ^ 2)), 6) AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey
UNION ALL SELECT 'mae', round(avg(abs(l_extendedprice - l_quantity * p_retailprice)), 6)
  FROM lineitem JOIN part ON l_partkey = p_partkey
UNION ALL SELECT 'accuracy', round(avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END), 6) FROM labels"""

SQL["linear_regression"] = """SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS coefficient,
  round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem"""

SQL["model_round_trip"] = SQL["linear_regression"]
SQL["logistic_odds"] = """WITH c AS (SELECT
  count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') AS a, count(*) FILTER (o_orderstatus <> 'F' AND o_orderpriority = '1-URGENT') AS b,
  count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT') AS c, count(*) FILTER (o_orderstatus <> 'F' AND o_orderpriority <> '1-URGENT') AS d FROM orders)
SELECT round(ln(a * d * 1.0 / (b * c)), 4) AS coefficient, round(ln(c * 1.0 / d), 4) AS intercept FROM c"""
SQL["tree_majority"] = """SELECT l_linenumber, arg_max(l_returnflag, n) AS predicted
FROM (SELECT l_linenumber, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_linenumber"""
SQL["pca_variance"] = """WITH m AS (SELECT var_samp(l_quantity) AS a, var_samp(l_tax * 100) AS c, covar_samp(l_quantity, l_tax * 100) AS b FROM lineitem),
e AS (SELECT (a + c) / 2 AS h, sqrt((a - c) * (a - c) / 4 + b * b) AS d FROM m)
SELECT 1 AS component, round((h + d) / (2 * h), 6) AS share FROM e UNION ALL SELECT 2, round((h - d) / (2 * h), 6) FROM e"""
SQL["arff_lines"] = """SELECT CAST(l_quantity AS VARCHAR) || ',' || CAST(l_discount AS VARCHAR) || ',1.0,' || (l_linenumber % 2) AS value, count(*) AS n
FROM lineitem GROUP BY 1"""
SQL["cached"] = """SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders) GROUP BY o_custkey"""
SQL["naive_bayes"] = LABELLED + f""", tok AS (SELECT quality AS label, unnest({T2_LIST}) AS term FROM lab),
vocab AS (SELECT DISTINCT term FROM tok),
cls AS (SELECT quality AS label, count(*) AS nc FROM lab GROUP BY quality),
cnt AS (SELECT label, term, count(*) AS c FROM tok GROUP BY label, term),
tot AS (SELECT label, count(*) AS t FROM tok GROUP BY label)
SELECT CAST(cls.label AS INTEGER) AS label, vocab.term,
  round(ln(coalesce(cnt.c, 0) + 1.0) - ln(tot.t + (SELECT count(*) FROM vocab)), 6) AS log_prob
FROM cls CROSS JOIN vocab JOIN tot ON tot.label = cls.label
LEFT JOIN cnt ON cnt.label = cls.label AND cnt.term = vocab.term
UNION ALL
SELECT CAST(label AS INTEGER), NULL, round(ln(nc + 1.0) - ln((SELECT count(*) FROM lab) + (SELECT count(*) FROM cls)), 6)
FROM cls"""

SQL["naive_bayes_predict"] = LABELLED + f""", tok AS (SELECT doc_id, quality AS label, unnest({T2_LIST}) AS term FROM lab),
cls AS (SELECT quality AS label, count(*) AS nc FROM lab GROUP BY quality),
cnt AS (SELECT label, term, count(*) AS c FROM tok GROUP BY label, term),
tot AS (SELECT label, count(*) AS t FROM tok GROUP BY label),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY doc_id, term),
score AS (SELECT tf.doc_id, cls.label, sum(tf.tf * (ln(coalesce(cnt.c, 0) + 1.0) - ln(tot.t + (SELECT count(DISTINCT term) FROM tok)))) AS s
  FROM tf CROSS JOIN cls JOIN tot ON tot.label = cls.label LEFT JOIN cnt ON cnt.label = cls.label AND cnt.term = tf.term GROUP BY tf.doc_id, cls.label)
SELECT lab.doc_id, CAST(arg_max(cls.label, coalesce(s, 0) + ln(nc + 1.0)) AS INTEGER) AS prediction
FROM lab CROSS JOIN cls LEFT JOIN score ON score.doc_id = lab.doc_id AND score.label = cls.label GROUP BY lab.doc_id"""


# ---- stems, tags, stolen terms, relations, senses -----------------------------------

from textflow.operators.text import REMOVABLE as _REMOVABLE  # noqa: E402

LEX = with_ctes(FX.TOKENS_DUCK, FX.TAGGED_DUCK, """lex AS (
  SELECT token, first(tag ORDER BY c DESC, tag) AS tag
  FROM (SELECT token, tag, count(*) AS c FROM tagged_tokens GROUP BY token, tag) GROUP BY token)""")

SQL["tagger"] = LEX + "SELECT token, tag FROM lex"
SQL["tag_tokens"] = LEX + "SELECT t.token, t.doc_id, t.pos, lex.tag FROM tokens t LEFT JOIN lex USING (token)"

_leads = ", ".join(f"lead(token, {k}) OVER w AS t{k}, lead(tag, {k}) OVER w AS g{k}" for k in range(1, 5))
_noun = " ".join(f"WHEN g{k} LIKE 'NN%' THEN t{k}" for k in range(1, 5))
SQL["verb_object_pairs"] = LEX + f""", tagged AS (SELECT t.doc_id, t.pos, t.token, lex.tag
  FROM tokens t LEFT JOIN lex USING (token)),
nx AS (SELECT doc_id, pos, token, tag, {_leads} FROM tagged WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, pos, token AS verb, noun, token || ' ' || noun AS relation FROM (
  SELECT *, CASE {_noun} END AS noun FROM nx WHERE tag LIKE 'VB%') WHERE noun IS NOT NULL"""

_REMOVE = "[" + ", ".join(f"'{w}'" for w in _REMOVABLE) + "]"
STOLEN_CTES = LEX.rstrip() + ",\n" + FX.INCIDENTS_DUCK + f""",
pt AS (SELECT incident_id, CASE WHEN contains(coalesce(narrative, ''), 'PROPERTY') THEN array_to_string(
         list_transform(regexp_split_to_array(coalesce(narrative, ''), 'PROPERTY LIST SUMMARY:|PROPERTY STOLEN:'),
                        lambda p: regexp_split_to_array(p, '[:_]')[1]), ' ') END AS text FROM incidents),
ptoks AS ({_long(T3_LIST, 'token', src='pt', id_col='incident_id')}),
stolen AS (SELECT incident_id, pos, token AS term FROM ptoks LEFT JOIN lex USING (token)
           WHERE tag IN ('NN', 'NNS') AND NOT list_contains({_REMOVE}, token) AND length(token) >= 3)
"""
SQL["stolen_terms"] = STOLEN_CTES + "SELECT incident_id, pos, term FROM stolen"

SENSE_CTES = f""",
{FX.SENSES_DUCK.strip()},
{FX.ANCESTORS_DUCK.strip()},
tdist AS (SELECT DISTINCT incident_id, term FROM stolen),
scand AS (SELECT DISTINCT t.incident_id, t.term, s.sense FROM tdist t JOIN senses s ON s.term = t.term),
gl AS (SELECT DISTINCT sense, gloss_term FROM senses),
hits AS (SELECT c.incident_id, c.term, c.sense, count(*) AS o FROM scand c JOIN gl USING (sense)
         JOIN tdist x ON x.incident_id = c.incident_id AND x.term = gl.gloss_term GROUP BY ALL),
chosen AS (SELECT c.incident_id, c.term, first(c.sense ORDER BY coalesce(h.o, 0) DESC, c.sense) AS sense
           FROM scand c LEFT JOIN hits h USING (incident_id, term, sense) GROUP BY c.incident_id, c.term)
"""
SQL["choose_sense"] = STOLEN_CTES + SENSE_CTES + "SELECT incident_id, term, sense FROM chosen"

# the pair CTEs need the feature CTEs; stolen terms need the lexicon
_PAIRS_ONLY = (with_ctes(FX.TOKENS_DUCK, FX.TAGGED_DUCK).rstrip() + ",\n" + INCIDENT_CTES[len("WITH "):].rstrip()
               + K1_CTES.rstrip() + POS_CTE.rstrip() + NEG_CTE.rstrip() + """,
pairs AS MATERIALIZED (SELECT * FROM pos UNION ALL SELECT * FROM neg),
lex AS (SELECT token, first(tag ORDER BY c DESC, tag) AS tag
  FROM (SELECT token, tag, count(*) AS c FROM tagged_tokens GROUP BY token, tag) GROUP BY token)""")
_STOLEN_ONLY = STOLEN_CTES[STOLEN_CTES.index("pt AS ("):]
PAIR_SENSE = _PAIRS_ONLY + ",\n" + _STOLEN_ONLY.rstrip() + SENSE_CTES + """,
sp AS (SELECT p.l, p.r, a.sense AS a, b.sense AS b FROM (SELECT DISTINCT l, r FROM pairs) p
       JOIN chosen a ON a.incident_id = p.l JOIN chosen b ON b.incident_id = p.r),
sims AS (SELECT ab.a, ab.b, -ln((min(x.dist + y.dist) + 1) / (2.0 * (SELECT max(dist) + 1 FROM ancestors))) AS sim
         FROM (SELECT DISTINCT a, b FROM sp) ab JOIN ancestors x ON x.sense = ab.a
         JOIN ancestors y ON y.sense = ab.b AND y.ancestor = x.ancestor GROUP BY ab.a, ab.b)
"""
SQL["sense_best"] = PAIR_SENSE + """,
sbest AS (SELECT l, r, avg(bs) AS sense_best FROM (SELECT sp.l, sp.r, sp.a, max(sims.sim) AS bs
         FROM sp LEFT JOIN sims USING (a, b) GROUP BY sp.l, sp.r, sp.a) GROUP BY l, r)
SELECT p.l, p.r, round(sbest.sense_best, 6) AS sense_best FROM pairs p LEFT JOIN sbest USING (l, r)"""
# In a tree of senses the best assignment matches as many as it can below each ancestor, the lowest first: so many at
# most below one ancestor as its shorter side has there, and the sums of these over the ancestors of one height follow.
ASSIGN_CTES = """,
level AS (SELECT c.incident_id AS id, a.dist, a.ancestor, count(*) AS n
          FROM chosen c JOIN ancestors a ON a.sense = c.sense GROUP BY ALL),
nsense AS (SELECT incident_id AS id, count(*) AS n FROM chosen GROUP BY ALL),
{pairs_level} AS (SELECT l, r, sum(CASE WHEN dist = 0 THEN least(ln, n) END) AS m0, sum(CASE WHEN dist = 1 THEN least(ln, n) END) AS m1,
          sum(CASE WHEN dist = 2 THEN least(ln, n) END) AS m2
  FROM (SELECT pl.l, pl.r, pl.dist, pl.n AS ln, y.n FROM (SELECT p.l, p.r, x.dist, x.ancestor, x.n
          FROM (SELECT DISTINCT l, r FROM pairs) p JOIN level x ON x.id = p.l) pl
        JOIN level y ON y.id = pl.r AND y.dist = pl.dist AND y.ancestor = pl.ancestor) GROUP BY l, r),
assigned AS (SELECT m.l, m.r, (coalesce(m0, 0) * -ln(1 / 6.0) + (coalesce(m1, 0) - coalesce(m0, 0)) * -ln(3 / 6.0)
          + (m2 - coalesce(m1, 0)) * -ln(5 / 6.0)) / s.n AS sense_assignment
  FROM {pairs_level} m JOIN nsense s ON s.id = m.l)
""".replace("{pairs_level}", "matched")
SQL["sense_assignment"] = PAIR_SENSE[:PAIR_SENSE.index(",\nsp AS (")] + ASSIGN_CTES + """
SELECT p.l, p.r, round(a.sense_assignment, 6) AS sense_assignment FROM pairs p LEFT JOIN assigned a USING (l, r)"""
SQL["sense_mean"] = PAIR_SENSE + """,
m AS (SELECT sp.l, sp.r, sum(coalesce(sims.sim, 0.0)) / (count(DISTINCT sp.a) * count(DISTINCT sp.b)) AS sense_mean
      FROM sp LEFT JOIN sims USING (a, b) GROUP BY sp.l, sp.r)
SELECT p.l, p.r, round(m.sense_mean, 6) AS sense_mean FROM pairs p LEFT JOIN m USING (l, r)"""

_fill = ", ".join(f"coalesce({c}, (SELECT CAST(round_even(avg({c}), 0) AS INTEGER) FROM pf12)) AS {c}"
                  for c in _INTS)
_imp = ", ".join(f"coalesce(CASE WHEN isnan({c}) THEN NULL ELSE {c} END, "
                 f"(SELECT avg({c}) FROM pf12 WHERE NOT isnan({c}))) AS {c}" for c in _DBLS)
_mm = ", ".join(f"min({c}) AS mn_{c}, max({c}) AS mx_{c}" for c in _INTS + _DBLS)
_scaled = ", ".join(f"round(CASE WHEN mx_{c} = mn_{c} THEN 0.5 ELSE ({c} - mn_{c}) / (mx_{c} - mn_{c}) END, 6) AS s_{c}"
                    for c in _INTS + _DBLS)

# the fixtures' CTEs once, then features, pairs, pair features, stolen terms, senses and their assignment
SQL["linkage_dataset"] = (_PAIRS_ONLY + TERMS_CTE.rstrip() + PF_CTE.replace(_PAIRS_CTE, "").rstrip() + ",\n" + _STOLEN_ONLY.rstrip() + SENSE_CTES.rstrip()
                          + ASSIGN_CTES.rstrip()) + f""",
pf12 AS MATERIALIZED (SELECT pf.*, a.sense_assignment AS property_senses FROM pf LEFT JOIN assigned a ON a.l = pf.l AND a.r = pf.r),
filled AS (SELECT l, r, weight, class, {_fill}, {_imp} FROM pf12),
mm AS (SELECT {_mm} FROM filled)
SELECT l, r, round(weight, 6) AS weight, class, {_scaled} FROM filled, mm"""


OVERLAP = _PAIRS_ONLY + ",\n" + _STOLEN_ONLY.rstrip() + """,
cnt AS (SELECT incident_id, term, count(*) AS c FROM stolen GROUP BY ALL),
sz AS (SELECT incident_id, count(*) AS s FROM stolen GROUP BY ALL),
idf AS (SELECT term, ln(((SELECT count(*) FROM incidents) + 1.0) / (count(DISTINCT incident_id) + 1)) AS w
        FROM stolen GROUP BY term),
pa AS MATERIALIZED (SELECT p.l, p.r, a.term, a.c FROM (SELECT DISTINCT l, r FROM pairs) p
      JOIN cnt a ON a.incident_id = p.l),
m AS (SELECT pa.l, pa.r, sum(pa.c * b.c * {W}) AS m FROM pa
      JOIN cnt b ON b.incident_id = pa.r AND b.term = pa.term {J} GROUP BY pa.l, pa.r)
SELECT p.l, p.r, round(CASE WHEN sl.s IS NULL OR sr.s IS NULL THEN NULL
                      ELSE coalesce(m.m, 0.0) / ((sl.s + 1) * (sr.s + 1)) END, 6) AS overlap
FROM pairs p LEFT JOIN sz sl ON sl.incident_id = p.l LEFT JOIN sz sr ON sr.incident_id = p.r
LEFT JOIN m ON m.l = p.l AND m.r = p.r"""
SQL["pair_overlap"] = OVERLAP.replace("{W}", "1.0").replace("{J}", "")
SQL["pair_overlap_idf"] = OVERLAP.replace("{W}", "coalesce(idf.w, 0.0)").replace(
    "{J}", "LEFT JOIN idf ON idf.term = pa.term")


# ---- sources, user steps, stages ---------------------------------------------------------

SQL["read_delimited"] = """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, fmt
FROM orders, (SELECT 'csv' AS fmt UNION ALL SELECT 'tsv')"""
SQL["row_id"] = "SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) - 1 AS _id FROM customer"
SQL["user_step"] = """SELECT c_mktsegment, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment"""
SQL["pipeline_stages"] = INCIDENT_CTES + _long(T3_LIST.replace("lower(text)", "lower(method_of_entry)"),
                                               "token", src="features", id_col="incident_id")

SQL["streaming_incident_features"] = SQL["incident_features"]

# Cosine of verb-object relation tf-idf vectors of the method-of-entry text
SQL["cosine_relations"] = _PAIRS_ONLY + f""",
mt AS ({_long(T3_LIST.replace("lower(text)", "lower(method_of_entry)"), 'token', src='reports', id_col='incident_id')}),
lex2 AS (SELECT token, first(tag ORDER BY c DESC, tag) AS tag FROM (
         SELECT token, tag, count(*) AS c FROM (
           SELECT token, tag FROM tagged_tokens
           UNION ALL SELECT token, CASE WHEN suffix(token, 'ed') THEN 'VBD' ELSE 'NN' END FROM mt)
         GROUP BY token, tag) GROUP BY token),
mtag AS (SELECT mt.incident_id, mt.pos, mt.token, lex2.tag FROM mt LEFT JOIN lex2 USING (token)),
mnx AS (SELECT incident_id, pos, token, tag, {_leads} FROM mtag
        WINDOW w AS (PARTITION BY incident_id ORDER BY pos)),
rel AS (SELECT incident_id, token || ' ' || noun AS term FROM (
          SELECT *, CASE {_noun} END AS noun FROM mnx WHERE tag LIKE 'VB%') WHERE noun IS NOT NULL),
tfr AS (SELECT incident_id, term, count(*) AS tf FROM rel GROUP BY ALL),
wr AS MATERIALIZED (SELECT t.incident_id, t.term,
        t.tf * ln(((SELECT count(*) FROM reports) + 1.0) / (d.df + 1.0)) AS w
      FROM tfr t JOIN (SELECT term, count(*) AS df FROM tfr GROUP BY term) d USING (term)),
nr AS (SELECT incident_id, sqrt(sum(w * w)) AS norm FROM wr GROUP BY incident_id),
pairs_wr AS MATERIALIZED (SELECT p.l, p.r, a.term, a.w FROM (SELECT DISTINCT l, r FROM pairs) p
                          JOIN wr a ON a.incident_id = p.l),
cm AS {_cos('pairs', 'wr', 'nr', 'cosine_mo')}
SELECT p.l, p.r, round(cm.cosine_mo, 6) AS cosine_mo FROM pairs p LEFT JOIN cm ON cm.l = p.l AND cm.r = p.r"""


# ---- samples by key, search from sums ---------------------------------------------------

from textflow.operators.sampling import poisson_bounds  # noqa: E402

_HASHED = "(SELECT o_orderkey, o_totalprice, CAST('0x' || substr(md5(o_orderkey::VARCHAR || ':1'), 1, 8) AS BIGINT) AS h FROM orders)"
SQL["sample_by_key"] = f"SELECT o_orderkey, o_totalprice FROM {_HASHED} WHERE h < {2 ** 31}"
SQL["sample_with_replacement"] = f"""SELECT o_orderkey, o_totalprice, unnest(range(1, times + 1))::INTEGER AS copy FROM (
  SELECT *, {" + ".join(f"(h >= {b})::INTEGER" for b in poisson_bounds(0.75))} AS times FROM {_HASHED})"""
SQL["sample_exactly"] = f"SELECT o_orderkey, o_totalprice FROM {_HASHED} ORDER BY h, o_orderkey LIMIT 1000"
SQL["ridge_search"] = """WITH x AS (SELECT l_quantity AS a, l_discount * 100 AS b, l_extendedprice / 1000 AS y, CAST((l_orderkey * 31 + l_linenumber) % 3 AS INTEGER) AS fold FROM lineitem),
g AS (SELECT f.fold, p.penalty, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) + penalty AS aa, var_pop(b) + penalty AS bb,
             covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_
      FROM x, (SELECT DISTINCT fold FROM x) f, (SELECT unnest([0.0, 1.0, 100.0])::DOUBLE AS penalty) p WHERE x.fold <> f.fold GROUP BY f.fold, p.penalty),
m AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS qa, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS qb FROM g)
SELECT m.fold, penalty, round(any_value(my - qa * ma - qb * mb), 5) AS intercept, round(any_value(qa), 5) AS quantity, round(any_value(qb), 5) AS discount,
       round(avg((y - (my - qa * ma - qb * mb) - qa * a - qb * b) ** 2), 4) AS mse
FROM m JOIN x ON x.fold = m.fold GROUP BY m.fold, penalty"""


# ---- trained sentence splitting ---------------------------------------------------------

_STRIPPED = """regexp_replace({t}, '[)\\]"'']+$', '')"""
SENTENCE_CTES = f"""WITH list AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS toks FROM documents),
flat AS (SELECT doc_id, unnest(toks) AS token, unnest(range(0, len(toks))) AS pos FROM list),
tok AS MATERIALIZED (SELECT doc_id, pos, token, regexp_replace({_STRIPPED.format(t='lower(token)')}, '[.]$', '') AS word,
               regexp_extract({_STRIPPED.format(t='token')}, '([.!?])$', 1) AS mark FROM flat),
words AS (SELECT word, count(*) FILTER (mark = '.') AS with_stop, count(*) FILTER (mark <> '.') AS without FROM tok WHERE word <> '' GROUP BY word),
share AS (SELECT sum(with_stop) * 1.0 / sum(with_stop + without) AS p FROM words),
abbr AS (SELECT word, with_stop, without, 2 * (with_stop * ln(0.99) + without * ln(0.01) - with_stop * ln(p) - without * ln(1 - p))
           * (length(word) - length(replace(word, '.', '')) + 1) * exp(-length(replace(word, '.', '')))
           * pow(greatest(length(replace(word, '.', '')), 1), -without) AS score
         FROM words, share WHERE with_stop > 0),
short AS (SELECT word FROM abbr WHERE score >= 0.3 AND regexp_matches(word, '\\p{{L}}')),
near AS MATERIALIZED (SELECT t.*, s.word IS NOT NULL AS short, lead(t.word) OVER w AS next_word,
                lead(regexp_matches(t.token, '^[(\\["'']*\\p{{Lu}}')) OVER w AS next_capital
         FROM tok t LEFT JOIN short s ON s.word = t.word WINDOW w AS (PARTITION BY t.doc_id ORDER BY t.pos)),
total AS (SELECT count(*)::DOUBLE AS n, (count(*) FILTER (mark <> '' AND NOT short))::DOUBLE AS ends FROM near),
after AS (SELECT next_word AS word, count(*) AS at_start FROM near WHERE mark <> '' AND NOT short AND next_word <> '' GROUP BY next_word),
cand AS (SELECT a.word, a.at_start, c.n, a.at_start::DOUBLE AS k, c.n::DOUBLE AS m, total.n AS total, total.ends
         FROM after a JOIN (SELECT word, count(*) AS n FROM tok GROUP BY word) c ON c.word = a.word, total WHERE a.at_start / total.ends > c.n / total.n),
ratio AS (SELECT *, m / total AS p, k / ends AS p1, (m - k) / (total - ends) AS p2 FROM cand),
starters AS (SELECT word, at_start, n, -2 * (
  (CASE WHEN k > 0 THEN k * ln(p) ELSE 0 END) + (CASE WHEN ends > k THEN (ends - k) * ln(1 - p) ELSE 0 END)
  + (CASE WHEN m - k > 0 THEN (m - k) * ln(p) ELSE 0 END) + (CASE WHEN total - ends > m - k THEN (total - ends - m + k) * ln(1 - p) ELSE 0 END)
  - (CASE WHEN k > 0 THEN k * ln(p1) ELSE 0 END) - (CASE WHEN p1 < 1 THEN (ends - k) * ln(1 - p1) ELSE 0 END)
  - (CASE WHEN m - k > 0 THEN (m - k) * ln(p2) ELSE 0 END) - (CASE WHEN p2 < 1 THEN (total - ends - m + k) * ln(1 - p2) ELSE 0 END)) AS score FROM ratio)
"""
SQL["abbreviations"] = SENTENCE_CTES + "SELECT word, with_stop, without, round(score, 6) + 0.0 AS score FROM abbr"
SQL["sentence_starters"] = SENTENCE_CTES + "SELECT word, at_start, n, round(score, 4) AS score FROM starters"
SQL["trained_sentences"] = SENTENCE_CTES + """,
ended AS (SELECT e.doc_id, e.pos, e.token, e.mark <> '' AND NOT (e.mark = '.' AND (
            (e.short OR regexp_matches(e.word, '^\\p{L}$')) AND NOT (coalesce(e.next_capital, false) AND s.word IS NOT NULL)
            OR regexp_matches(e.word, '^[0-9]+$') AND NOT coalesce(e.next_capital, false))) AS last
          FROM near e LEFT JOIN (SELECT word FROM starters WHERE score >= 30) s ON s.word = e.next_word),
numbered AS (SELECT *, coalesce(sum(last::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS n FROM ended)
SELECT doc_id, n, string_agg(token, ' ' ORDER BY pos) AS sentence FROM numbered GROUP BY doc_id, n"""


# ---- verb relations with learned heads --------------------------------------------------

from textflow.operators.relations import PASSIVE, PRIOR, ROUNDS  # noqa: E402

_AUX = ", ".join(f"'{p}'" for p in PASSIVE)


def _em_round(i: int) -> str:
    """One round: counts by shape and by (verb, noun) from the weights of candidates ``em{i}``, and the weights that follow."""
    return f""",
shape{i} AS (SELECT shape, sum(w) / count(*) AS s FROM em{i} GROUP BY shape),
pair{i} AS (SELECT verb, noun, sum(w) AS w FROM em{i} GROUP BY verb, noun),
verb{i} AS (SELECT verb, sum(w) AS v, count(*) AS kinds FROM pair{i} GROUP BY verb),
em{i + 1} AS MATERIALIZED (SELECT *, score / sum(score) OVER (PARTITION BY doc_id, pos) AS w FROM (
  SELECT e.doc_id, e.pos, e.noun, e.vpos, e.verb, e.kind, e.shape, s.s * (p.w + {PRIOR}) / (v.v + {PRIOR} * v.kinds) AS score
  FROM em{i} e JOIN shape{i} s USING (shape) JOIN pair{i} p ON p.verb = e.verb AND p.noun = e.noun JOIN verb{i} v ON v.verb = e.verb))"""


SQL["verb_relations"] = LEX + f""", run AS MATERIALIZED (SELECT t.doc_id, t.pos, t.token, lex.tag,
  sum((coalesce(lex.tag, '') LIKE 'NN%')::INTEGER) OVER w AS nouns, sum((t.token IN ({_AUX}))::INTEGER) OVER w AS aux
  FROM tokens t LEFT JOIN lex USING (token) WINDOW w AS (PARTITION BY t.doc_id ORDER BY t.pos)),
cand AS (SELECT n.doc_id, n.pos, n.token AS noun, v.pos AS vpos, v.token AS verb, v.pos - n.pos AS k,
    CASE WHEN v.pos < n.pos THEN n.nouns - 1 - v.nouns ELSE v.nouns - n.nouns END AS inside,
    CASE WHEN v.pos < n.pos THEN n.aux - (n.token IN ({_AUX}))::INTEGER - v.aux ELSE v.aux - n.aux END > 0 AS helped
  FROM run n JOIN run v ON v.doc_id = n.doc_id AND v.pos BETWEEN n.pos - 4 AND n.pos + 4 AND v.pos <> n.pos
  WHERE n.tag LIKE 'NN%' AND v.tag LIKE 'VB%' AND v.token NOT IN ({_AUX})),
em0 AS MATERIALIZED (SELECT doc_id, pos, noun, vpos, verb, CASE WHEN k < 0 THEN 'dobj' ELSE 'nsubjpass' END AS kind,
    k || ':' || inside || ':' || helped::INTEGER AS shape, 1.0 / count(*) OVER (PARTITION BY doc_id, pos) AS w
  FROM cand WHERE k < 0 OR helped)""" + "".join(_em_round(i) for i in range(ROUNDS)) + f""",
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, pos ORDER BY round(score, 9) DESC, abs(vpos - pos), vpos) AS place FROM em{ROUNDS})
SELECT doc_id, pos, noun, vpos, verb, kind, verb || ' ' || noun AS relation FROM best WHERE place = 1"""


# ---- co-occurrence and document PMI -------------------------------------------------------

_PMI = """, total AS (SELECT sum(n)::DOUBLE AS t FROM counts), ls AS (SELECT {l}, sum(n) AS x FROM counts GROUP BY {l}), rs AS (SELECT {r}, sum(n) AS y FROM counts GROUP BY {r}),
p AS (SELECT c.{l}, c.{r}, c.n, ln(c.n * t / (x * y)) - ln({shift}) AS pmi FROM counts c JOIN ls ON ls.{l} = c.{l} JOIN rs ON rs.{r} = c.{r}, total)
SELECT {l}, {r}, n, round(pmi, 6) AS pmi FROM p WHERE pmi > 0"""
SQL["document_pmi"] = with_ctes(FX.TOKENS_DUCK).rstrip() + """,
counts AS (SELECT doc_id, token, count(*) AS n FROM tokens GROUP BY doc_id, token)""" + _PMI.format(l="doc_id", r="token", shift="2.0")
SQL["cooccurrence_pmi"] = with_ctes(FX.TOKENS_DUCK).rstrip() + """,
near AS (SELECT token AS word, unnest([lead(token, 1) OVER w, lead(token, 2) OVER w, lead(token, 3) OVER w, lead(token, 4) OVER w]) AS context
         FROM tokens WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
one AS (SELECT word, context, count(*) AS n FROM near WHERE context IS NOT NULL GROUP BY word, context),
counts AS (SELECT word, context, sum(n)::BIGINT AS n FROM (SELECT word, context, n FROM one UNION ALL SELECT context, word, n FROM one) GROUP BY word, context)""" + _PMI.format(l="word", r="context", shift="1.0")
