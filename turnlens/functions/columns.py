"""Pure ``Column -> Column`` functions (scalar functions C*, predicates P*).

All are built-in Spark expressions, so they run inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlens.schemas import ACT_NAMES, PIPE_ESCAPE

__all__ = [
    "act_name", "domain_of", "contains_ci", "escape_pipes", "unescape_pipes", "clean_ws",
    "ws_tokens", "sp_tokens", "sentences", "token_windows", "seen_tag", "mark_unseen",
    "act_map", "decode_with_table", "seeded_hash", "goodbye_override", "placeholder_count", "bleu_tokens", "rouge_tokens", "ngrams",
    "decode_acts",
]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def act_map() -> Column:
    """``MAP<act, act_name>`` of the fixture's act names."""
    return F.create_map(*[x for i, n in enumerate(ACT_NAMES) for x in (F.lit(i), F.lit(n))])


def act_name(act, names: Column | None = None) -> Column:
    """Act id -> act name by a map column; an id without a name is an error (null stays null)."""
    a = _col(act)
    unknown = F.raise_error(F.concat(F.lit("no name for act id "), a.cast("string")))
    return F.when(a.isNotNull(), F.coalesce(F.element_at(act_map() if names is None else names, a), unknown))


def decode_acts(acts, names: Column | None = None) -> Column:
    """P1 over a whole act array: replace ``act`` by its name, keep the other fields."""
    return F.transform(_col(acts), lambda a: a.withField("act", act_name(a["act"], names)))


def decode_with_table(turns: DataFrame, names: DataFrame, acts: str = "dialog_acts") -> DataFrame:
    """P1 with the dataset's own table ``(act, act_name)``, one row per kind of act (a few dozen)."""
    table = names.select(F.map_from_entries(F.collect_list(F.struct("act", "act_name")))).scalar()
    return turns.withColumn("_act_names", table).withColumn(acts, decode_acts(acts, F.col("_act_names"))).drop("_act_names")


def domain_of(service) -> Column:
    """Text before the first ``_``."""
    return F.split(_col(service), "_").getItem(0)


def seeded_hash(key, seed: int) -> Column:
    """A text that orders rows as a repeatable shuffle: md5 of ``key:seed``."""
    return F.md5(F.concat(_col(key).cast("string"), F.lit(f":{seed}")))


def contains_ci(text, value) -> Column:
    """Case-insensitive containment; the empty value is always contained."""
    return F.lower(_col(text)).contains(F.lower(_col(value)))


def escape_pipes(c) -> Column:
    """P5: ``|`` -> ``<vstripe>`` (literal replace)."""
    return F.replace(_col(c), F.lit("|"), F.lit(PIPE_ESCAPE))


def unescape_pipes(c) -> Column:
    """P5: ``<vstripe>`` -> ``|``."""
    return F.replace(_col(c), F.lit(PIPE_ESCAPE), F.lit("|"))


def clean_ws(c) -> Column:
    """Newline and tab -> space."""
    return F.translate(_col(c), "\n\t", "  ")


def ws_tokens(c) -> Column:
    """``str.split()`` — split on (Unicode) whitespace, no empty tokens."""
    return F.filter(F.split(_col(c), r"(?U)\s+"), lambda t: t != "")


def sp_tokens(c) -> Column:
    """``str.split(' ')`` — single-space split that keeps empty tokens."""
    return F.split(_col(c), " ")


def sentences(c) -> Column:
    """Split on every ``.``."""
    return F.split(_col(c), "[.]")


def token_windows(tokens, n) -> Column:
    """C4: for every start position the next ``n`` tokens joined by a space (short tails kept)."""
    t = _col(tokens)
    n = n if isinstance(n, Column) else F.lit(n)
    return F.when(F.size(t) == 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(t)), lambda i: F.array_join(F.slice(t, i, n), " ")))


def seen_tag(domain, unseen_domains: list[str]) -> Column:
    """``unseen`` if the domain is listed, else ``seen``."""
    return F.when(_col(domain).isin(list(unseen_domains)), "unseen").otherwise("seen")


def mark_unseen(domain, unseen_domains: list[str]) -> Column:
    """Append ``*`` to listed domains."""
    d = _col(domain)
    return F.when(d.isin(list(unseen_domains)), F.concat(d, F.lit("*"))).otherwise(d)


def goodbye_override(sr, ref, pred) -> Column:
    """Where the input text contains ``GOODBYE`` the prediction becomes the reference."""
    return F.when(_col(sr).contains("GOODBYE"), _col(ref)).otherwise(_col(pred))


def placeholder_count(c, ch: str = "@") -> Column:
    """Number of occurrences of a one-character placeholder."""
    c = _col(c)
    return F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))


# Punctuation class of the 13a tokenizer, as hex ranges: space..&, (..+, /, :..@, [..`, {..~
_P13A = r"([\x20-\x26\x28-\x2b\x2f\x3a-\x40\x5b-\x60\x7b-\x7e])"


def bleu_tokens(c) -> Column:
    """13a tokenization used by corpus BLEU (HTML entity unescape, line joins, 4 rules)."""
    s = _col(c)
    s = F.replace(s, F.lit("<skipped>"), F.lit(""))
    s = F.replace(s, F.lit("-\n"), F.lit(""))
    s = F.replace(s, F.lit("\n"), F.lit(" "))
    for a, b in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        s = F.replace(s, F.lit(a), F.lit(b))
    s = F.concat(F.lit(" "), s, F.lit(" "))
    s = F.regexp_replace(s, _P13A, " $1 ")
    s = F.regexp_replace(s, r"([^0-9])([.,])", "$1 $2 ")
    s = F.regexp_replace(s, r"([.,])([^0-9])", " $1 $2")
    s = F.regexp_replace(s, r"([0-9])(-)", "$1 $2 ")
    return F.filter(F.split(s, r"\s+"), lambda t: t != "")


def rouge_tokens(c) -> Column:
    """ROUGE tokenization: lowercase, non-alphanumerics -> space, split (no stemming)."""
    s = F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", " ")
    return F.filter(F.split(s, " "), lambda t: t != "")


def ngrams(tokens, n: int) -> Column:
    """All contiguous n-grams of a token array, joined by a space (empty if too short)."""
    t = _col(tokens)
    return F.when(F.size(t) < n, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " ")))
