"""DuckDB SQL fragments for the oracle strings (tokenizers, n-gram statistics, BLEU formula)."""

from __future__ import annotations


def tok13a(x: str) -> str:
    s = f"replace(replace(replace({x}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
    for a, b in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        s = f"replace({s}, '{a}', '{b}')"
    s = f"(' ' || {s} || ' ')"
    s = rf"regexp_replace({s}, '([\x20-\x26\x28-\x2b\x2f\x3a-\x40\x5b-\x60\x7b-\x7e])', ' \1 ', 'g')"
    s = rf"regexp_replace({s}, '([^0-9])([.,])', '\1 \2 ', 'g')"
    s = rf"regexp_replace({s}, '([.,])([^0-9])', ' \1 \2', 'g')"
    s = rf"regexp_replace({s}, '([0-9])(-)', '\1 \2 ', 'g')"
    return rf"list_filter(regexp_split_to_array({s}, '\s+'), lambda t: t <> '')"


def rouge_tok(x: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: t <> '')"


def ngram_ctes(src: str, ref_tok: str, hyp_tok: str, orders: list[int], name: str = "st") -> str:
    """CTEs ending in ``name``: src columns + ``m{n}, h{n}, r{n}, hyp_len, ref_len`` per row_idx."""
    ol = ", ".join(str(n) for n in orders)
    side = lambda col, s: f"""SELECT row_idx, n, array_to_string(list_slice({col}, i, i + n - 1), ' ') AS g, '{s}' AS s
       FROM (SELECT row_idx, {col}, n, unnest(range(1, len({col}) - n + 2)) AS i FROM tk_{name}, (SELECT unnest([{ol}]) AS n))"""
    ms = ", ".join(f"sum(CASE WHEN n = {n} THEN least(hc, rc) ELSE 0 END) AS m{n}" for n in orders)
    tot = ", ".join(f"greatest(len(_h) - {n} + 1, 0) AS h{n}, greatest(len(_r) - {n} + 1, 0) AS r{n}" for n in orders)
    mc = ", ".join(f"CAST(coalesce(pr_{name}.m{n}, 0) AS BIGINT) AS m{n}" for n in orders)
    return f"""tk_{name} AS (SELECT *, {ref_tok} AS _r, {hyp_tok} AS _h FROM ({src})),
gr_{name} AS ({side('_r', 'r')} UNION ALL {side('_h', 'h')}),
pg_{name} AS (SELECT row_idx, n, g, count(*) FILTER (WHERE s = 'h') AS hc, count(*) FILTER (WHERE s = 'r') AS rc FROM gr_{name} GROUP BY row_idx, n, g),
pr_{name} AS (SELECT row_idx, {ms} FROM pg_{name} GROUP BY row_idx),
{name} AS (SELECT tk_{name}.* EXCLUDE (_r, _h), {tot}, len(_h) AS hyp_len, len(_r) AS ref_len, {mc}
      FROM tk_{name} LEFT JOIN pr_{name} ON pr_{name}.row_idx = tk_{name}.row_idx)"""


def bleu_formula(m: list[str], h: list[str], sys_len: str, ref_len: str) -> str:
    ps = []
    for i in range(len(m)):
        k = " + ".join(f"(CASE WHEN {m[j]} = 0 THEN 1 ELSE 0 END)" for j in range(i + 1))
        ps.append(f"ln(CASE WHEN {m[i]} = 0 THEN 1.0 / (pow(2.0, {k}) * {h[i]}) ELSE {m[i]} * 1.0 / {h[i]} END)")
    bp = f"(CASE WHEN {sys_len} >= {ref_len} THEN 1.0 WHEN {sys_len} = 0 THEN 0.0 ELSE exp(1.0 - {ref_len} * 1.0 / {sys_len}) END)"
    cond = f"least({', '.join(h)}) = 0 OR greatest({', '.join(m)}) = 0"
    return f"(CASE WHEN {cond} THEN 0.0 ELSE 100.0 * {bp} * exp(({' + '.join(ps)}) / {len(m)}) END)"


def bleu_select(by: str | None, src: str = "st") -> str:
    """SELECT of corpus BLEU over the statistics CTE ``src`` (grouped by ``by`` if given)."""
    sums = ", ".join([f"CAST(sum(m{n}) AS DOUBLE) AS m{n}" for n in range(1, 5)] +
                     [f"CAST(sum(h{n}) AS DOUBLE) AS h{n}" for n in range(1, 5)] +
                     ["CAST(sum(hyp_len) AS DOUBLE) AS sl", "CAST(sum(ref_len) AS DOUBLE) AS rl"])
    f = bleu_formula([f"m{n}" for n in range(1, 5)], [f"h{n}" for n in range(1, 5)], "sl", "rl")
    g = f"{by}, " if by else ""
    grp = f" GROUP BY {by}" if by else ""
    return f"SELECT {g}round({f}, 6) AS bleu FROM (SELECT {g}{sums} FROM {src}{grp})"


def bootstrap_sql(src: str, key: str, metrics: dict[str, str], replicates: int, seed: int, per_hash: int, poisson: list[int],
                  confidence: float) -> str:
    """CTEs and SELECT of the bootstrap intervals of the columns of ``src`` (hash weights, percentiles of the means)."""
    hexa = "list_reduce(list_prepend(0, list_transform(range(8 * i + 1, 8 * i + 9), lambda p: strpos('0123456789abcdef', h[p]) - 1)), lambda a, x: a * 16 + x)"
    weight = " + ".join(f"(CASE WHEN u >= {t} THEN 1 ELSE 0 END)" for t in poisson)
    sums = ", ".join(f"sum(w * {m}) / sum(CASE WHEN {m} IS NOT NULL THEN w END) AS {m}" for m in metrics)
    tail = round((1.0 - confidence) / 2.0, 12)
    picks = " UNION ALL ".join(f"SELECT '{name}' AS metric, round(quantile_cont({m}, {tail}), 6) AS low, round(quantile_cont({m}, 0.5), 6) AS mid, "
                               f"round(quantile_cont({m}, {1 - tail}), 6) AS high FROM reps" for m, name in metrics.items())
    return f"""hashes AS (SELECT *, md5('{seed}:' || {key} || ':' || b) AS h FROM {src}, (SELECT unnest(range({-(-replicates // per_hash)})) AS b)),
numbers AS (SELECT * EXCLUDE (h), b * {per_hash} + i AS rep, CAST({hexa} AS BIGINT) AS u FROM hashes, (SELECT unnest(range({per_hash})) AS i)),
weights AS (SELECT *, {weight} AS w FROM numbers WHERE rep < {replicates}),
reps AS (SELECT rep, {sums} FROM weights WHERE w > 0 GROUP BY rep)
{picks}"""
