"""Queries on conversations: intents, guarded answers, commands, access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import fixed
from sparkloom.operators import policy
from sparkloom.plans.documents import _literal
from sparkloom.plans.registry import query
from sparkloom.session import table

SAMPLES = [
    (9200001, 0, "GM everyone"), (9200002, 0, "hello!?"), (9200003, 0, "how do i fix the fragment"), (9200004, 0, "  "), (9200005, 0, "what is the price"), (9200006, 0, "who are you"),
    (9200007, 0, "my old modem"), (9200008, 0, "/crawl https://a.example 3"), (9200009, 0, "/crawl https://a.example 9"), (9200010, 0, "/crawl"), (9200011, 0, "/audit@bot https://x"),
    (9200012, 0, "/help me"), (9200013, 0, "/nope"), (9200014, 0, "/sigil " + "w" * 201), (9200015, 0, "/sigil some words"), (9200016, 0, "/audit a b"), (9200017, 0, "/start pay-load_1 x"),
    (9200018, 0, "One sentence here that is long enough. " * 30), (9200019, 0, "l1\nl2\nl3\nl4\nl5\nl6\nl7"), (9200020, 0, "see https://x"), (9200021, 0, "x" * 800), (9200022, 0, "/crawl https://a.example x"), (9200023, 0, ""), (9200024, 0, "what is This Bot"),
]
TALK_SQL = f"(SELECT conv_id, turn, text FROM conversations UNION ALL SELECT * FROM (VALUES {_literal(SAMPLES)}) AS lit(conv_id, turn, text))"


def _talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text").unionByName(spark.createDataFrame(SAMPLES, "conv_id long, turn long, text string"))


def _any_sql(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


@query(f"""SELECT conv_id, turn, CASE WHEN trim(t) = '' THEN 'unknown' {' '.join(f"WHEN {_any_sql('t', [*w, *(['what is this bot'] if n == 'identity' else [])])} THEN '{n}'" for n, w in fixed.INTENTS)}
  WHEN rtrim(trim(t), '?! ') IN ({', '.join(f"'{g}'" for g in fixed.GREETINGS)}) THEN 'greeting' WHEN {_any_sql('t', fixed.QUESTIONS)} THEN 'code_q' ELSE 'banter' END AS intent
  FROM (SELECT conv_id, turn, regexp_replace(concat(' ', lower(trim(text)), ' '), '[ \\t\\n\\r\\f]+', ' ', 'g') AS t FROM {TALK_SQL})""")
def conv_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _talk(spark, sf_dir).select("conv_id", "turn", policy.intent(F.col("text")).alias("intent"))


@query(f"""WITH c AS (SELECT conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM {TALK_SQL}),
  r AS (SELECT conv_id, turn, t, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '\\S')) AS ls FROM c),
  w AS (SELECT conv_id, turn, t, len(ls) AS n, regexp_replace(array_to_string(ls, chr(10)), '\\s+(\\n|$)', '\\1', 'g') AS whole FROM r)
  SELECT conv_id, turn, length(answer)::BIGINT AS chars, answer <> '' AS kept FROM (SELECT conv_id, turn, CASE WHEN t = '' OR n > 6 OR {_any_sql('lower(t)', fixed.FORBIDDEN)} THEN ''
    WHEN length(whole) <= 700 THEN whole WHEN length(regexp_extract(left(whole, 700), '(?s)^(.*[.!?]) ', 1)) > 41 THEN regexp_extract(left(whole, 700), '(?s)^(.*[.!?]) ', 1)
    ELSE concat(regexp_replace(left(whole, 700), '\\s+$', ''), chr(8230)) END AS answer FROM w)""")
def conv_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _talk(spark, sf_dir).select("conv_id", "turn", policy.guarded(F.col("text")).alias("answer"))
    return rows.select("conv_id", "turn", F.length("answer").cast("long").alias("chars"), (F.col("answer") != "").alias("kept"))


@query(f"""WITH c AS (SELECT conv_id, turn, text, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS s FROM {TALK_SQL}),
  p AS (SELECT *, split_part(regexp_extract(s, '^(\\S+)', 1), '@', 1) AS name, list_filter(regexp_split_to_array(regexp_extract(s, '(?s)^\\S+\\s+(.*)$', 1), '\\s+'), lambda x: x <> '') AS ws, regexp_extract(s, '(?s)^\\S+\\s+(.*)$', 1) AS rest FROM c)
  SELECT conv_id, turn, coalesce(CASE WHEN error IS NULL THEN substr(name, 2) END, 'reject') AS kind, error FROM (SELECT conv_id, turn, name, CASE WHEN text = '' THEN 'empty message' WHEN length(text) > 4000 THEN 'message too long'
    WHEN NOT starts_with(s, '/') THEN 'not a command' WHEN name NOT IN ({', '.join(f"'{c}'" for c in fixed.COMMANDS)}) THEN 'unknown command'
    WHEN name IN ({', '.join(f"'/{c}'" for c in fixed.ONE_URL)}) AND len(ws) <> 1 THEN concat('usage: ', name, ' <url>')
    WHEN name = '/sigil' AND rest = '' THEN 'usage: /sigil <words>' WHEN name = '/sigil' AND length(rest) > 200 THEN 'sigil too long (max 200)'
    WHEN name = '/crawl' AND (len(ws) NOT IN (1, 2) OR (len(ws) = 2 AND TRY_CAST(ws[2] AS INT) IS NULL)) THEN 'usage: /crawl <url> [depth 1-4]'
    WHEN name = '/crawl' AND len(ws) = 2 AND TRY_CAST(ws[2] AS INT) NOT BETWEEN 1 AND 4 THEN 'usage: depth must be 1-4' END AS error FROM p)""")
def conv_command(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _talk(spark, sf_dir).select("conv_id", "turn", policy.command(F.col("text")).alias("c"))
    return rows.select("conv_id", "turn", "c.kind", "c.error")


UPDATES = [(1, "private", 7, 70, False), (2, "private", 8, 80, False), (3, "group", 8, 100, False), (4, "supergroup", 8, 101, True), (5, "group", 7, 100, True), (6, "channel", 7, 70, False)]


@query(f"""SELECT id, CASE WHEN chat_type = 'private' THEN CASE WHEN user_id IN (7) THEN 'dm' ELSE 'sender not allowlisted' END
  WHEN chat_type IN ('group', 'supergroup') THEN CASE WHEN chat_id NOT IN (100) THEN 'group not allowlisted' WHEN is_bot THEN 'group-bot' ELSE 'group' END ELSE concat('chat type not allowed: ', chat_type) END AS reason
  FROM (VALUES {_literal(UPDATES)}) AS u(id, chat_type, user_id, chat_id, is_bot)""")
def lit_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(UPDATES, "id int, chat_type string, user_id long, chat_id long, is_bot boolean")
    users = spark.createDataFrame([(7,)], "user_id long").withColumn("user_known", F.lit(True))
    groups = spark.createDataFrame([(100,)], "chat_id long").withColumn("group_known", F.lit(True))
    rows = rows.join(F.broadcast(users), "user_id", "left").join(F.broadcast(groups), "chat_id", "left").na.fill(False)
    return rows.select("id", policy.access(F.col("chat_type"), F.col("user_known"), F.col("group_known"), F.col("is_bot")).alias("reason"))
