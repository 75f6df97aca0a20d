"""Preference formatting of paired conversations: the longest common turn prefix is the prompt, rendered once, and what
follows on either side is a completion with the spans that a loss may count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"


def _render(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(CLOSE), turn["text"], F.lit(END))


def _joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _render), "")


def _mask(turns: Column) -> Column:
    """`start:end` in code points, comma-joined: text and end mark of each trained turn."""
    def step(acc, t):
        head = acc["at"] + F.length(t["role"]) + len(OPEN) + len(CLOSE)
        stop = head + F.length(t["text"]) + len(END)
        return F.struct(stop.alias("at"), F.when(t["role"] == TRAINED, F.concat(acc["spans"], F.array(F.concat_ws(":", head, stop)))).otherwise(acc["spans"]).alias("spans"))

    return F.array_join(F.aggregate(turns, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans")), step, lambda acc: acc["spans"]), ",")


def format_preferences(turns: DataFrame, pair_col: str = "pair_id", chosen_col: str = "chosen", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each pair: pair_id, status, n_prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask.

    Input rows are turns; `chosen_col` tells (boolean) which side a turn is on. Turns are equal if role and text are. Rows that
    repeat a turn number are ordered by role and text, and all count. A null role is `unknown`, a null text empty; rows with
    a null pair or side are left out, as they belong to no conversation. `<|` in a text becomes `< |`, so no text can forge a mark.
    status: ok; same (nothing differs); prefix (one side has no more turns, its completion is empty); unpaired (one side has no
    turns at all: no prompt, the other side is rendered whole). Other columns are ignored. A pair is gathered
    into one row, as its result is: pairs, not the corpus, bound a task.
    """
    rows = turns.select(F.col(f"`{pair_col}`").alias("pair_id"), F.col(f"`{chosen_col}`").alias("side"), F.struct(F.col(f"`{turn_col}`").cast("long").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), F.lit("unknown")).alias("role"), F.replace(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.lit("<|"), F.lit("< |")).alias("text")).alias("t"))
    rows = rows.where(F.col("pair_id").isNotNull() & F.col("side").isNotNull())
    side = lambda s: F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col("t"))))
    pairs = rows.groupBy("pair_id").agg(side(True).alias("c"), side(False).alias("r"))
    same = F.zip_with("c", "r", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    pairs = pairs.withColumn("differs", F.array_position(same, False)).withColumn("n", F.when(F.col("differs") > 0, F.col("differs") - 1).otherwise(F.size("c").cast("long")))
    rest = lambda c: F.slice(c, F.col("n").cast("int") + 1, F.greatest(F.size(c), F.lit(1)))
    pairs = pairs.select("*", F.slice("c", F.lit(1), F.col("n").cast("int")).alias("p"), rest("c").alias("cc"), rest("r").alias("rr"))
    status = F.when((F.size("c") == 0) | (F.size("r") == 0), "unpaired").when(F.col("differs") == 0, "same").when((F.size("cc") == 0) | (F.size("rr") == 0), "prefix").otherwise("ok")
    return pairs.select("pair_id", status.alias("status"), F.col("n").alias("n_prompt_turns"), _joined(F.col("p")).alias("prompt"), _joined(F.col("cc")).alias("chosen"), _mask(F.col("cc")).alias("chosen_mask"), _joined(F.col("rr")).alias("rejected"), _mask(F.col("rr")).alias("rejected_mask"))


ORACLE = """
WITH t AS (SELECT conv_id // 2 AS pair_id, conv_id % 2 = 0 AS side, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM conversations),
sizes AS (SELECT pair_id, count(*) FILTER (side) AS nc, count(*) FILTER (NOT side) AS nr FROM t GROUP BY 1),
diff AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, min(coalesce(a.i, b.i)) FILTER (NOT coalesce(a.role = b.role AND a.text = b.text, false)) AS d
  FROM (SELECT * FROM t WHERE side) a FULL JOIN (SELECT * FROM t WHERE NOT side) b ON a.pair_id = b.pair_id AND a.i = b.i GROUP BY 1),
n AS (SELECT pair_id, nc, nr, d, coalesce(d - 1, nc) AS n FROM sizes JOIN diff USING (pair_id)),
o AS (SELECT t.*, n.n, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS x FROM t JOIN n USING (pair_id)),
q AS (SELECT *, coalesce(sum(CASE WHEN i > n THEN length(x) END) OVER (PARTITION BY pair_id, side ORDER BY i), 0) AS stop FROM o),
g AS (SELECT pair_id, coalesce(string_agg(x, '' ORDER BY i) FILTER (side AND i <= n), '') AS prompt,
  coalesce(string_agg(x, '' ORDER BY i) FILTER (side AND i > n), '') AS chosen, coalesce(string_agg(x, '' ORDER BY i) FILTER (NOT side AND i > n), '') AS rejected,
  coalesce(string_agg(CAST(stop - length(text) - 8 AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY i) FILTER (side AND i > n AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(CAST(stop - length(text) - 8 AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY i) FILTER (NOT side AND i > n AND role = 'assistant'), '') AS rejected_mask FROM q GROUP BY 1)
SELECT g.pair_id, CASE WHEN nc = 0 OR nr = 0 THEN 'unpaired' WHEN d IS NULL THEN 'same' WHEN nc <= n.n OR nr <= n.n THEN 'prefix' ELSE 'ok' END AS status, CAST(n.n AS BIGINT) AS n_prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask
FROM g JOIN n USING (pair_id)
"""
