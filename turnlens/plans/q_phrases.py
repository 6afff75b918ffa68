"""Phrase-mining keys (M1-M3)."""

from pyspark.sql import functions as F

from turnlens.operators import phrases as PH
from turnlens.plans.common import PHRASE_SLOT, r6
from turnlens.plans.registry import register
from turnlens.session import scratch_folder
from turnlens.sources import fixtures as fx

MIN_COUNT = 10


@register("pattern_rank", f"""
WITH ex AS (SELECT a.turn_key, a.act_pos, t.target FROM acts a JOIN turn_text t ON t.turn_key = a.turn_key WHERE a.slot = '{PHRASE_SLOT}'),
tok AS (SELECT unnest(string_split(s, ' ')) AS tok FROM (SELECT unnest(string_split(target, '.')) AS s FROM ex)),
cnt AS (SELECT tok, count(*) AS count FROM tok WHERE tok <> '' GROUP BY tok HAVING count(*) > {MIN_COUNT}),
uni AS (SELECT token, count(*) AS ucount FROM (SELECT unnest(string_split(target, ' ')) AS token FROM turn_text) GROUP BY token),
tot AS (SELECT sum(ucount) AS total FROM uni),
vals AS (SELECT DISTINCT unnest(string_split(v, ' ')) AS token FROM (SELECT unnest(vals) AS v FROM named_acts WHERE slot = '{PHRASE_SLOT}')),
ps AS (SELECT (SELECT count(*) FROM acts WHERE slot = '{PHRASE_SLOT}') * 1.0 / (SELECT count(*) FROM turn_text) AS p_slot)
SELECT c.tok AS token, CAST(c.count AS BIGINT) AS count,
  round(CASE WHEN u.ucount IS NULL OR u.ucount < 20 OR c.tok IN (SELECT token FROM vals) THEN -1.0
       ELSE (c.count * 1.0 / (SELECT count(*) FROM ex)) * (SELECT p_slot FROM ps) / (u.ucount * 1.0 / (SELECT total FROM tot)) END, 6) AS rank
FROM cnt c LEFT JOIN uni u ON u.token = c.tok""")
def pattern_rank(spark, d):
    """M2 on the first level: every token counted more than ``min_count`` times, with its rank.

    Examples, statistics and values all read the turns: the columns they need are joined and stored once.
    """
    turns = stored_turns(spark, d)
    toks, ex = PH.example_sentences(turns, PHRASE_SLOT)
    cand = toks.select(F.explode("toks").alias("tok")).filter(F.col("tok") != "").groupBy("tok").agg(F.count(F.lit(1)).alias("count")) \
        .filter(F.col("count") > MIN_COUNT).withColumn("prod", F.lit(1.0))
    r = PH.bayes_rank(turns, PHRASE_SLOT, ex.count())(cand)
    return r.select(F.col("tok").alias("token"), "count", r6(F.col("rank")).alias("rank"))


def stored_turns(spark, d):
    """``turn_key, dialog_acts, target`` of all turns, read from files in the shared scratch folder."""
    out = scratch_folder(spark, "turns")
    fx.turns(spark, d).select("turn_key", "dialog_acts", "target").write.parquet(out)
    return spark.read.parquet(out)


def patterns_sql(n_grams: int) -> str:
    """M1 with the levels unrolled: positions count from 1, position 0 is before the first token."""
    parts = [f"""ex AS (SELECT t.target FROM acts a JOIN turn_text t ON t.turn_key = a.turn_key WHERE a.slot = '{PHRASE_SLOT}'),
s0 AS (SELECT string_split(s, ' ') AS toks, '' AS pat, 0 AS fp, '' AS last, CAST(1 AS DOUBLE) AS prod
  FROM (SELECT unnest(string_split(target, '.')) AS s FROM ex)),
uni AS (SELECT token, count(*) AS ucount FROM (SELECT unnest(string_split(target, ' ')) AS token FROM turn_text) GROUP BY token),
slot_vals AS (SELECT DISTINCT unnest(string_split(v, ' ')) AS token FROM (SELECT unnest(vals) AS v FROM named_acts WHERE slot = '{PHRASE_SLOT}')),
info AS (SELECT token, ucount < 20 OR token IN (SELECT token FROM slot_vals) AS bad,
  CAST(ucount AS DOUBLE) / (SELECT sum(ucount) FROM uni) AS ufreq FROM uni),
nums AS (SELECT CAST((SELECT count(*) FROM ex) AS DOUBLE) AS n_ex,
  CAST((SELECT count(*) FROM ex) AS DOUBLE) / (SELECT count(*) FROM turn_text) AS p_slot)"""]
    for i in range(1, n_grams + 1):
        parts.append(f"""c{i} AS (SELECT pat, tok, count(*) AS n, any_value(prod) AS prod FROM
  (SELECT pat, last, prod, unnest(toks[fp + 1:]) AS tok FROM s{i - 1}) WHERE tok <> last GROUP BY pat, tok HAVING count(*) > {MIN_COUNT}),
r{i} AS (SELECT c.pat, c.tok, c.n, c.prod * f.ufreq AS prod, (CAST(c.n AS DOUBLE) / n_ex) * p_slot / (c.prod * f.ufreq) AS rank
  FROM c{i} c JOIN info f ON f.token = c.tok AND NOT f.bad CROSS JOIN nums),
k{i} AS (SELECT *, CASE WHEN pat = '' THEN tok ELSE pat || chr(1) || tok END AS npat FROM
  (SELECT *, row_number() OVER (PARTITION BY pat ORDER BY rank DESC, tok) AS rn FROM r{i} WHERE rank > 0) WHERE rn <= 5),
s{i} AS (SELECT s.toks, k.npat AS pat, s.fp + list_position(s.toks[s.fp + 1:], k.tok) AS fp, k.tok AS last, k.prod
  FROM s{i - 1} s JOIN k{i} k ON k.pat = s.pat WHERE list_contains(s.toks[s.fp + 1:], k.tok))""")
    rows = " UNION ALL ".join(f"SELECT replace(npat, chr(1), ' ') AS pattern, {i} AS level, CAST(n AS BIGINT) AS count, round(rank, 6) AS rank FROM k{i}"
                              for i in range(1, n_grams + 1))
    return f"WITH {', '.join(parts)} {rows}"


@register("slot_patterns", patterns_sql(4))
def slot_patterns(spark, d):
    """M1: gapped patterns of up to 4 tokens indicative of the slot (levels >= 1)."""
    p = PH.mine_patterns(fx.turns(spark, d), PHRASE_SLOT, n_grams=4, min_count=MIN_COUNT, top_k=5)
    return p.filter(F.col("level") > 0).select("pattern", "level", "count", r6(F.col("rank")).alias("rank"))


@register("all_patterns", f"""SELECT pattern, count, rank FROM ({patterns_sql(2)})
UNION ALL SELECT '', CAST(0 AS BIGINT), CAST(0 AS DOUBLE)""")
def all_patterns(spark, d):
    """M3: every kept pattern with count and rank, the root ``('', 0, 0)`` included."""
    p = PH.mine_patterns(fx.turns(spark, d), PHRASE_SLOT, n_grams=2, min_count=MIN_COUNT, top_k=5)
    return p.select("pattern", "count", r6(F.col("rank")).alias("rank"))


def active_sql(n_grams: int) -> str:
    """The mined patterns, then every turn's sentences through the same levels."""
    mined = patterns_sql(n_grams)
    ctes = mined[5:]
    cut = ctes.index(" SELECT replace(npat, chr(1), ' ') AS pattern, 1 AS level")
    parts = [ctes[:cut], """a0 AS (SELECT turn_key, sent - 1 AS sent, string_split(ss[sent], ' ') AS toks, '' AS pat, 0 AS fp FROM (
  SELECT turn_key, ss, unnest(range(1, len(ss) + 1)) AS sent FROM (SELECT turn_key, string_split(target, '.') AS ss FROM turn_text)))"""]
    for i in range(1, n_grams + 1):
        parts.append(f"""a{i} AS (SELECT a.turn_key, a.sent, a.toks, k.npat AS pat, a.fp + list_position(a.toks[a.fp + 1:], k.tok) AS fp, k.n
  FROM a{i - 1} a JOIN k{i} k ON k.pat = a.pat WHERE list_contains(a.toks[a.fp + 1:], k.tok))""")
    rows = " UNION ALL ".join(f"SELECT turn_key, sent, replace(pat, chr(1), ' ') AS pattern, CAST(n AS BIGINT) AS count FROM a{i}"
                              for i in range(1, n_grams + 1))
    return f"WITH {', '.join(parts)} {rows}"


@register("active_patterns", active_sql(3))
def active_patterns(spark, d):
    """M3: the mined patterns that are active at the end of every sentence of every turn."""
    turns = fx.turns(spark, d)
    p = PH.mine_patterns(turns, PHRASE_SLOT, n_grams=3, min_count=MIN_COUNT, top_k=5)
    sentences = turns.select("turn_key", F.posexplode(F.split("target", "[.]")).alias("sent", "s")) \
        .select("turn_key", F.col("sent").cast("long").alias("sent"), F.split("s", " ").alias("toks"))
    return PH.active_patterns(sentences, p)
