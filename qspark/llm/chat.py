"""Preference formatting of conversations, in DataFrame operations only.

Input: pair_id, side (`chosen` or `rejected`), turn, role, text. The longest common turn prefix of the two sides is found by an
aggregate (the first turn at which they differ), rendered once as prompt from the chosen side; what follows on each side is that
side's completion. Output is a row a turn: pair_id, part (`prompt`, `chosen` or `rejected`), turn, role, rendered text, and loss,
true where a trainer learns (assistant turns of a completion). No conversation is gathered into a row, so its length has no bound;
`assemble` joins a pair's rows to one training record where conversations are known to fit.

Defined cases: several rows of one pair, side and turn are one turn; it is equal to the other side's if the rows are the same with
their repeats. A null turn comes before all others, a null text renders as empty, a null role as an empty role without loss. A pair
needs rows on both sides; a null pair_id or another side is no pair. Equal sides are all prompt. Empty tables give no rows, and
other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import ranking
from .common import stage

OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"
TRAINED = "assistant"
_FIRST = -(2**63)


def rendered(role: Column, text: Column) -> Column:
    a, b = OPEN.split("{}")
    return F.concat(F.lit(a), F.coalesce(role, F.lit("")), F.lit(b), F.coalesce(text, F.lit("")), F.lit("\n" + CLOSE))


def pairs(conversations: DataFrame) -> DataFrame:
    """Pairs of conversations 2k and 2k + 1: the first is chosen; it is rejected with its last assistant turn, and all after it, replaced by the second's last assistant turn."""
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).where(F.col("conv_id").isNotNull())
    pair, first = F.floor(F.col("conv_id") / 2).cast("long"), F.pmod(F.col("conv_id"), F.lit(2)) == 0
    rows = c.withColumn("pair_id", pair).withColumn("first", first)
    answer = F.struct(F.col("turn"), F.col("text"))
    last = rows.where((F.col("role") == TRAINED) & F.col("turn").isNotNull()).groupBy("pair_id").agg(F.max(F.when(F.col("first"), F.col("turn"))).alias("at"), F.max(F.when(~F.col("first"), answer)).alias("other"))
    last = last.where(F.col("at").isNotNull() & F.col("other").isNotNull())
    chosen = rows.where("first").select("pair_id", F.lit("chosen").alias("side"), "turn", "role", "text")
    kept = rows.where("first").join(last.select("pair_id", "at"), "pair_id").where(F.col("turn").isNull() | (F.col("turn") < F.col("at"))).select("pair_id", F.lit("rejected").alias("side"), "turn", "role", "text")
    swapped = last.select("pair_id", F.lit("rejected").alias("side"), F.col("at").alias("turn"), F.lit(TRAINED).alias("role"), F.col("other.text").alias("text"))
    return chosen.unionByName(kept).unionByName(swapped)


def all_pairs(conversations: DataFrame) -> DataFrame:
    """A pair of each conversation with an answer (an assistant turn), chosen as it is; its pair_id is its conv_id. It is rejected with its last answer, and all after it, replaced by its partner's last answer.

    Partners are 2k and 2k + 1. Those whose neighbour has no answer are partners two by two in the order of conv_id; the last of an
    odd number gets the other conversation with an answer and the smallest conv_id. Not paired: conversations without an answer or
    with a null conv_id, and the only one with an answer. A partner with the same answer gives a pair that is all prompt.
    """
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).where(F.col("conv_id").isNotNull())
    last = stage(c.where((F.col("role") == TRAINED) & F.col("turn").isNotNull()).groupBy("conv_id").agg(F.max("turn").alias("at"), F.max(F.struct("turn", "text"))["text"].alias("answer")), "answers")
    other = last.select(F.col("conv_id").alias("partner"), F.col("answer").alias("other"))
    near = last.select("conv_id", F.col("conv_id").bitwiseXOR(F.lit(1)).alias("partner"))
    alone = ranking.rank(stage(near.join(other, "partner", "left_anti").select("conv_id"), "alone"), "conv_id")
    least = last.select("conv_id").orderBy("conv_id").limit(2).agg(F.min("conv_id").alias("least"), F.max("conv_id").alias("second"))
    met = alone.join(alone.select(F.col("conv_id").alias("partner"), F.col("rank").bitwiseXOR(F.lit(1)).alias("rank")), "rank", "left").crossJoin(F.broadcast(least))  # one row
    met = met.select("conv_id", F.coalesce("partner", F.when(F.col("least") == F.col("conv_id"), F.col("second")).otherwise(F.col("least"))).alias("partner")).where("partner <> conv_id")
    swap = near.join(other.select("partner"), "partner", "left_semi").select("conv_id", "partner").unionByName(met).join(other, "partner").join(last.select("conv_id", "at"), "conv_id").select("conv_id", "at", "other")
    rows = c.join(swap.select("conv_id", "at"), "conv_id").withColumnRenamed("conv_id", "pair_id")
    chosen = rows.select("pair_id", F.lit("chosen").alias("side"), "turn", "role", "text")
    kept = rows.where(F.col("turn").isNull() | (F.col("turn") < F.col("at"))).select("pair_id", F.lit("rejected").alias("side"), "turn", "role", "text")
    swapped = swap.select(F.col("conv_id").alias("pair_id"), F.lit("rejected").alias("side"), F.col("at").alias("turn"), F.lit(TRAINED).alias("role"), F.col("other").alias("text"))
    return chosen.unionByName(kept).unionByName(swapped)


def preference(turns: DataFrame) -> DataFrame:
    t = turns.select("pair_id", "side", F.col("turn").cast("long").alias("turn"), "role", "text").where(F.col("pair_id").isNotNull() & F.col("side").isin("chosen", "rejected"))
    side = lambda name: F.count(F.when(F.col("side") == name, 1))
    # A turn is equal on both sides if each of its rows is there as often; rows are told apart by two hashes.
    what = [F.xxhash64(F.lit(k), F.col("role").isNull(), "role", F.col("text").isNull(), "text").alias(f"h{k}") for k in range(2)]
    rows = t.groupBy("pair_id", F.coalesce("turn", F.lit(_FIRST)).alias("place"), *what).agg(side("chosen").alias("c"), side("rejected").alias("r"))
    cut = rows.groupBy("pair_id").agg(F.min(F.when(F.col("c") != F.col("r"), F.col("place"))).alias("cut"), F.max("c").alias("c"), F.max("r").alias("r")).where("c > 0 and r > 0").select("pair_id", "cut")
    common = F.col("cut").isNull() | (F.coalesce("turn", F.lit(_FIRST)) < F.col("cut"))
    rows = t.join(cut, "pair_id").withColumn("part", F.when(common, "prompt").otherwise(F.col("side"))).where(~common | (F.col("side") == "chosen"))
    loss = (F.col("part") != "prompt") & F.coalesce(F.col("role") == TRAINED, F.lit(False))
    return rows.select("pair_id", "part", "turn", "role", rendered(F.col("role"), F.col("text")).alias("rendered"), loss.alias("loss"))


def assemble(parts: DataFrame) -> DataFrame:
    """One record a pair: prompt, chosen, rejected, and for either completion the [start, length] spans that carry loss. For conversations that fit into a row."""
    turn = F.struct("turn", "role", "rendered", "loss")
    by = parts.groupBy("pair_id").agg(*(F.array_sort(F.collect_list(F.when(F.col("part") == p, turn))).alias(p) for p in ("prompt", "chosen", "rejected")))
    text = lambda p: F.array_join(F.transform(p, lambda x: x["rendered"]), "").alias(p)

    def spans(p: str) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.expr("array()").cast("array<struct<start:int,length:int>>").alias("spans"))
        step = lambda a, x: F.struct((a["at"] + F.length(x["rendered"])).alias("at"), F.when(x["loss"], F.concat(a["spans"], F.array(F.struct(a["at"].alias("start"), F.length(x["rendered"]).alias("length"))))).otherwise(a["spans"]).alias("spans"))
        return F.aggregate(p, zero, step, lambda a: a["spans"]).alias(f"{p}_loss")

    return by.select("pair_id", text("prompt"), text("chosen"), text("rejected"), spans("chosen"), spans("rejected"))


SQL = """
WITH c AS (SELECT conv_id, turn, role, text, CAST(floor(conv_id / 2.0) AS BIGINT) AS pair_id, conv_id % 2 = 0 AS first FROM conversations WHERE conv_id IS NOT NULL),
last AS (SELECT a.pair_id, a.upto, b.text FROM
    (SELECT pair_id, max(turn) AS upto FROM c WHERE first AND role = 'assistant' GROUP BY 1) a JOIN
    (SELECT pair_id, arg_max(text, turn) AS text FROM c WHERE NOT first AND role = 'assistant' GROUP BY 1) b USING (pair_id)),
t AS (SELECT pair_id, 'chosen' AS side, turn, role, text FROM c WHERE first
    UNION ALL SELECT pair_id, 'rejected', turn, role, c.text FROM c JOIN last USING (pair_id) WHERE first AND turn < upto
    UNION ALL SELECT pair_id, 'rejected', upto, 'assistant', text FROM last),
b AS (SELECT pair_id, turn, list_sort(list(role || chr(1) || text) FILTER (side = 'chosen')) AS x, list_sort(list(role || chr(1) || text) FILTER (side = 'rejected')) AS y FROM t GROUP BY ALL),
cut AS (SELECT pair_id, min(turn) FILTER (x IS DISTINCT FROM y) AS cut FROM b GROUP BY 1 HAVING count(x) > 0 AND count(y) > 0)
SELECT pair_id, part, turn, role, '<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) AS rendered, part <> 'prompt' AND role = 'assistant' AS loss
FROM (SELECT *, CASE WHEN cut IS NULL OR turn < cut THEN 'prompt' ELSE side END AS part FROM t JOIN cut USING (pair_id))
WHERE part <> 'prompt' OR side = 'chosen'
"""

#: One record a pair of all_pairs.
RECORDS_SQL = """
WITH c AS (SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
last AS (SELECT conv_id, max(turn) AS upto, arg_max(text, turn) AS text FROM c WHERE role = 'assistant' AND turn IS NOT NULL GROUP BY 1),
alone AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS r FROM last WHERE xor(conv_id, 1) NOT IN (SELECT conv_id FROM last)),
least AS (SELECT min(conv_id) AS one, (SELECT min(conv_id) FROM last WHERE conv_id > (SELECT min(conv_id) FROM last)) AS two FROM last),
partner AS (SELECT conv_id, xor(conv_id, 1) AS other FROM last WHERE xor(conv_id, 1) IN (SELECT conv_id FROM last)
    UNION ALL SELECT a.conv_id, coalesce(b.conv_id, CASE WHEN least.one = a.conv_id THEN least.two ELSE least.one END) FROM alone a CROSS JOIN least LEFT JOIN alone b ON b.r = xor(a.r, 1)),
p AS (SELECT l.conv_id, l.upto, o.text FROM partner JOIN last l ON l.conv_id = partner.conv_id JOIN last o ON o.conv_id = partner.other),
t AS (SELECT conv_id AS pair_id, 'chosen' AS side, turn, role, c.text FROM c JOIN p USING (conv_id)
    UNION ALL SELECT conv_id, 'rejected', turn, role, c.text FROM c JOIN p USING (conv_id) WHERE turn < upto
    UNION ALL SELECT conv_id, 'rejected', upto, 'assistant', text FROM p),
b AS (SELECT pair_id, turn, list_sort(list(role || chr(1) || text) FILTER (side = 'chosen')) AS x, list_sort(list(role || chr(1) || text) FILTER (side = 'rejected')) AS y FROM t GROUP BY ALL),
cut AS (SELECT pair_id, min(turn) FILTER (x IS DISTINCT FROM y) AS cut FROM b GROUP BY 1),
r AS (SELECT pair_id, part, turn, role, '<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) AS s
    FROM (SELECT *, CASE WHEN cut IS NULL OR turn < cut THEN 'prompt' ELSE side END AS part FROM t JOIN cut USING (pair_id)) WHERE part <> 'prompt' OR side = 'chosen'),
a AS (SELECT *, CAST(coalesce(sum(length(s)) OVER (PARTITION BY pair_id, part ORDER BY turn, role, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS place, part <> 'prompt' AND role = 'assistant' AS loss FROM r)
SELECT pair_id, coalesce(string_agg(s, '' ORDER BY turn, role, s) FILTER (part = 'prompt'), '') AS prompt,
    coalesce(string_agg(s, '' ORDER BY turn, role, s) FILTER (part = 'chosen'), '') AS chosen, coalesce(string_agg(s, '' ORDER BY turn, role, s) FILTER (part = 'rejected'), '') AS rejected,
    coalesce(list(place ORDER BY place) FILTER (part = 'chosen' AND loss), []) AS chosen_starts, coalesce(list(CAST(length(s) AS INTEGER) ORDER BY place) FILTER (part = 'chosen' AND loss), []) AS chosen_lengths,
    coalesce(list(place ORDER BY place) FILTER (part = 'rejected' AND loss), []) AS rejected_starts, coalesce(list(CAST(length(s) AS INTEGER) ORDER BY place) FILTER (part = 'rejected' AND loss), []) AS rejected_lengths
FROM a GROUP BY 1
"""
