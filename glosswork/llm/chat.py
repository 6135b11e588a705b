"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as a set of structs (by hash, map side first) and sorted by (turn, role, text). Adjacent turns of one role are
merged: the places where a run begins come from one filter over the positions, and each run is sliced and joined, so
the work is that of sorting the turns. Messages are concatenated as <|role|> line, text, <|end|>.

Defined cases. Rows of null conv_id belong to no conversation and are left out. A null role is "unknown", a null text
is empty, a null turn sorts first. Repeated rows (same turn, role and text) count once; turns with one number and
different content all stay, ordered by role, then text. Empty texts stay as empty lines. An empty table: an empty
result. Columns of other names aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read


def formatted(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, n_turns, n_messages, roles (joined by blanks), chat."""
    t = F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(role_col, F.lit("unknown")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    got = turns.where(F.col(conv_col).isNotNull()).groupBy(F.col(conv_col).alias("conv_id")).agg(F.array_sort(F.collect_set(t)).alias("ts"))
    # array_sort puts null fields last; turns without a number come first
    got = got.withColumn("ts", F.concat(F.filter("ts", lambda x: x["turn"].isNull()), F.filter("ts", lambda x: x["turn"].isNotNull())))
    starts = F.filter(F.sequence(F.lit(1), F.size("ts")), lambda i: (i == 1) | (F.element_at("ts", i)["role"] != F.element_at("ts", F.greatest(i - 1, F.lit(1)))["role"]))
    got = got.withColumn("at", starts)

    def message(s, k):
        end = F.coalesce(F.get("at", k + 1), F.size("ts") + 1)
        return F.struct(F.element_at("ts", s)["role"].alias("role"), F.array_join(F.transform(F.slice("ts", s, end - s), lambda x: x["text"]), "\n").alias("text"))

    got = got.withColumn("ms", F.transform("at", message))
    chat = F.array_join(F.transform("ms", lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["text"], F.lit("<|end|>\n"))), "")
    return got.select("conv_id", F.size("ts").cast("long").alias("n_turns"), F.size("ms").cast("long").alias("n_messages"), F.array_join(F.transform("ms", lambda m: m["role"]), " ").alias("roles"), chat.alias("chat"))


SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER w AS n, lag(role) OVER w AS before FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
r AS (SELECT *, sum(CASE WHEN before = role THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY n) AS run FROM o),
m AS (SELECT conv_id, run, role, string_agg(text, chr(10) ORDER BY n) AS text, count(*) AS k FROM r GROUP BY conv_id, run, role)
SELECT conv_id, CAST(sum(k) AS BIGINT) AS n_turns, count(*) AS n_messages, string_agg(role, ' ' ORDER BY run) AS roles,
       string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY run) AS chat
FROM m GROUP BY conv_id
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted(read(spark, sf_dir, "conversations"))
