"""Evaluation entities from the driver's tables, as DataFrames.

``questions`` and ``turns`` come from ``conversations``: ten conversations in
order are the sessions of one question; the evidence is one long turn chosen by
a hash.  ``HAYSTACK_SQL`` derives them in plain SQL that Spark and DuckDB share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: turns(question_id, session_id, session_index, session_date, turn_index, role, content, has_answer)
TURNS_SQL = """
    SELECT question_id, session_id, session_index, session_date, turn_index, role, content,
           CASE WHEN pick = 1 AND long_enough AND k % 10 <> 9 THEN true ELSE false END AS has_answer
    FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY CASE WHEN long_enough THEN 0 ELSE 1 END, md5(concat(question_id, '|', session_id, '|', turn_index))) AS pick
          FROM (SELECT k, concat('q', k, CASE WHEN k % 10 = 9 THEN '_abs' ELSE '' END) AS question_id, concat('s', conv_id) AS session_id,
                       CAST(conv_id % 10 AS INT) AS session_index,
                       concat('2023/', lpad(CAST(1 + conv_id % 12 AS VARCHAR(9)), 2, '0'), '/', lpad(CAST(1 + conv_id % 28 AS VARCHAR(9)), 2, '0'), ' (Mon) 10:00') AS session_date,
                       CAST(row_number() OVER (PARTITION BY k ORDER BY conv_id, turn) - 1 AS INT) AS turn_index, role, coalesce(text, '') AS content,
                       length(coalesce(text, '')) >= 60 AS long_enough
                FROM (SELECT *, CAST(floor(conv_id / 10.0) AS BIGINT) AS k FROM conversations) c) t) u"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = TURNS_SQL.replace("FROM conversations)", "FROM {conversations})")
    return spark.sql(sql, conversations=read(spark, sf_dir, "conversations"))


#: asked(question_id, question_date) from turns: the latest or first session's day or a late one, at a
#: time before or after the sessions'; every seventh date is impossible.
ASKED_SQL = """
    SELECT question_id, CASE WHEN k % 7 = 6 THEN '2023/02/30 (Mon) 10:00'
           ELSE concat(CASE k % 3 WHEN 0 THEN last_day WHEN 1 THEN first_day ELSE '2023/12/31' END, CASE WHEN k % 2 = 0 THEN ' (Mon) 09:30' ELSE ' (Mon) 18:00' END) END AS question_date
    FROM (SELECT question_id, CAST(regexp_replace(question_id, '[a-z_]', '', 'g') AS BIGINT) AS k, max(substr(session_date, 1, 10)) AS last_day, min(substr(session_date, 1, 10)) AS first_day
          FROM turns GROUP BY question_id) d"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = ASKED_SQL.replace("FROM turns ", "FROM {turns} ").replace(", 'g')", ")")
    return spark.sql(sql, turns=turns(spark, sf_dir))
