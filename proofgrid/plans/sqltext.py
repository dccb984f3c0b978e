"""SQL twins of ``inputs``: expressions and common table expressions for the oracle queries."""

from __future__ import annotations

from proofgrid.plans.inputs import CLASSES, PRIORITY_CATEGORY


def h60(x: str) -> str:
    return f"CAST(('0x' || substr(md5({x}), 1, 15)) AS BIGINT)"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def canon(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '\\s+', ' ', 'g'))"


def words(x: str) -> str:
    return f"list_filter(string_split({canon(x)}, ' '), lambda w: w <> '')"


def seed32(x: str) -> str:
    return f"CAST(('0x' || substr(sha256({x}), 9, 8)) AS BIGINT)"


_CLASSES = "[" + ", ".join(f"'{c}'" for c in CLASSES) + "]"

QA = f"""
turns AS (
  SELECT u.conv_id, u.turn, u.text AS asked, a.text AS said, {h60("u.conv_id || '|' || u.turn")} AS h
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'),
qa0 AS (
  SELECT CAST(conv_id AS VARCHAR) AS source, {strip('asked')} AS question, said AS answer,
    CAST(1 + turn % 3 AS VARCHAR) AS complexity, 'turn ' || turn AS original,
    CASE WHEN h % 7 <> 0 THEN
      CASE WHEN h % 3 = 0 THEN [{_CLASSES}[CAST(h % 5 + 1 AS INT)], {_CLASSES}[CAST((h // 8) % 5 + 1 AS INT)]]
           ELSE [{_CLASSES}[CAST(h % 5 + 1 AS INT)]] END END AS classes,
    CASE WHEN h % 10 = 0 THEN 'test' ELSE 'train' END AS split,
    'images/' || conv_id || '.jpg' AS image
  FROM turns),
qa AS (
  SELECT *, {canon('question')} AS question_key, {canon('answer')} AS answer_key,
    substr(sha256(source || '|' || question), 1, 20) AS item_id,
    {h60("substr(sha256(source || '|' || question), 1, 20)")} AS ih
  FROM qa0)"""

_SHORT = "array_to_string(list_filter(string_split(answer, ' '), lambda t, i: (i - 1) % 5 <> 4), ' ')"
_BACK = "array_to_string(list_reverse(string_split(answer, ' ')), ' ')"

PRED = f"""{QA},
pred AS (
  SELECT item_id, source, question, answer AS reference, complexity, classes, split, image, ih, c.condition,
    CASE c.condition
      WHEN 'paired' THEN CASE WHEN ih % 3 <> 0 THEN answer ELSE {_SHORT} END
      WHEN 'unadapted' THEN {_SHORT}
      WHEN 'question_only' THEN question
      WHEN 'constant' THEN CASE WHEN ih % 2 = 0 THEN answer ELSE {_SHORT} END
      ELSE {_BACK} END AS prediction
  FROM qa, (VALUES ('paired'), ('unadapted'), ('question_only'), ('constant'), ('shuffled')) c(condition))"""

SCORED = f"""{PRED},
lp AS (
  SELECT *, CAST({canon('reference')} = {canon('prediction')} AS DOUBLE) AS exact_match,
    list_transform(string_split(prediction, ' '), lambda t, i:
      CASE WHEN (i - 1) % 11 = 10 THEN NULL WHEN (i - 1) % 13 = 12 THEN 'nan'::DOUBLE
           ELSE -length(t) / 16.0::DOUBLE END) AS token_logprobs
  FROM pred),
finite AS (SELECT *, list_filter(token_logprobs, lambda x: x IS NOT NULL AND isfinite(x)) AS kept FROM lp),
scored AS (
  SELECT *, CASE WHEN len(kept) > 0 THEN list_sum(kept) / len(kept) END AS mean_logprob,
    CASE WHEN len(kept) > 0 THEN exp(list_sum(kept) / len(kept)) END AS confidence
  FROM finite)"""

REPEATED = """
rep AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS source, CAST(l_linenumber AS VARCHAR) AS question_key,
    lower(l_returnflag) AS answer_key, l_returnflag AS answer, l_linestatus AS complexity,
    CASE WHEN l_suppkey % 3 = 0 THEN 'test' ELSE 'train' END AS origin, l_partkey AS partkey,
    sha256(l_partkey || '|' || l_suppkey || '|' || l_linestatus || '|' || l_returnflag) AS row_digest
  FROM lineitem)"""

FLAGGED = f"""{REPEATED},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source, question_key, answer_key
    ORDER BY CASE WHEN origin = 'train' THEN 0 ELSE 1 END, row_digest) AS rn FROM rep),
collapsed AS (
  SELECT source, question_key, answer_key, count(*) AS rows, count(DISTINCT complexity) > 1 AS metadata_conflict,
    max(CASE WHEN rn = 1 THEN partkey END) AS partkey, max(CASE WHEN rn = 1 THEN complexity END) AS complexity,
    CASE WHEN bool_or(origin = 'train') AND bool_or(origin = 'test') THEN 'train,test' ELSE max(origin) END AS origins
  FROM ranked GROUP BY ALL),
flagged AS (
  SELECT *, count(*) OVER (PARTITION BY source, question_key) > 1 AS answer_conflict,
    metadata_conflict OR count(*) OVER (PARTITION BY source, question_key) > 1 AS excluded
  FROM collapsed)"""

CONFIDENT = """
conf AS (
  SELECT event_id, user_id, event_type, value / (value + 50.0::DOUBLE) AS confidence,
    CAST(event_type IN ('purchase', 'signup') AS INT) AS correct
  FROM events)"""

_CASES = " ".join(f"WHEN '{p}' THEN '{c}'" for p, c in PRIORITY_CATEGORY.items())

TASKS = f"""
tasks AS (
  SELECT 'task ' || o_orderkey AS task, CAST(o_orderdate AS DATE) AS start,
    CAST(o_orderdate AS DATE) + CAST(o_custkey % 90 AS INT) AS finish,
    CASE o_orderpriority {_CASES} ELSE o_orderpriority END AS category, o_orderstatus AS status
  FROM orders)"""

MARKED = """
marked AS (
  SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l, j:
    CASE WHEN (j - 1) % 9 = 4 THEN '---'
         WHEN (j - 1) % 4 = 0 THEN repeat('#', CAST(1 + ((j - 1) // 4) % 4 AS INT)) || ' ' || l
         WHEN (j - 1) % 4 = 1 THEN '- ' || l
         WHEN (j - 1) % 8 = 2 THEN '**' || l || '**:'
         WHEN (j - 1) % 8 = 6 THEN '*' || l || '*'
         ELSE l END), chr(10)) AS text
  FROM documents)"""
