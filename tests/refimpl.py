"""Independent plain-Python statements of the metric definitions (from the papers / library docs),
used only to cross-check the Spark operators on small inputs."""

import difflib
import math
import re
from collections import Counter


def tok13a(s):
    s = s.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for a, b in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        s = s.replace(a, b)
    s = f" {s} "
    s = re.sub(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 ", s)
    s = re.sub(r"([^0-9])([\.,])", r"\1 \2 ", s)
    s = re.sub(r"([\.,])([^0-9])", r" \1 \2", s)
    s = re.sub(r"([0-9])(-)", r"\1 \2 ", s)
    return s.split()


def corpus_bleu(refs, preds):
    m, t, sl, rl = [0] * 4, [0] * 4, 0, 0
    for r, p in zip(refs, preds):
        rt, pt = tok13a(r), tok13a(p)
        sl += len(pt)
        rl += len(rt)
        for n in range(1, 5):
            pc = Counter(tuple(pt[i:i + n]) for i in range(len(pt) - n + 1))
            rc = Counter(tuple(rt[i:i + n]) for i in range(len(rt) - n + 1))
            m[n - 1] += sum(min(c, rc[g]) for g, c in pc.items())
            t[n - 1] += sum(pc.values())
    if min(t) == 0 or max(m) == 0:
        return 0.0
    smooth, logs = 1.0, []
    for mi, ti in zip(m, t):
        if mi == 0:
            smooth *= 2
            logs.append(math.log(1.0 / (smooth * ti)))
        else:
            logs.append(math.log(mi / ti))
    bp = 1.0 if sl >= rl else (0.0 if sl == 0 else math.exp(1 - rl / sl))
    return 100.0 * bp * math.exp(sum(logs) / 4)


def rouge_tokens(s):
    return [t for t in re.split(r"\s+", re.sub(r"[^a-z0-9]+", " ", s.lower())) if t]


def rouge_n(ref, pred, n):
    r, p = rouge_tokens(ref), rouge_tokens(pred)
    rc = Counter(tuple(r[i:i + n]) for i in range(len(r) - n + 1))
    pc = Counter(tuple(p[i:i + n]) for i in range(len(p) - n + 1))
    inter = sum(min(c, rc[g]) for g, c in pc.items())
    return inter / max(sum(pc.values()), 1), inter / max(sum(rc.values()), 1)


def lcs(a, b):
    dp = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            dp[i + 1][j + 1] = dp[i][j] + 1 if a[i] == b[j] else max(dp[i][j + 1], dp[i + 1][j])
    return dp[-1][-1]


def token_sort_ratio(a, b):
    def proc(s):
        s = "".join(ch for ch in s if not (128 <= ord(ch) <= 255))
        s = re.sub(r"(?ui)\W", " ", s).lower().strip()
        return " ".join(sorted(s.split())).strip()
    x, y = proc(a), proc(b)
    if x == y:
        return 100
    if not x or not y:
        return 0
    return int(round(100 * difflib.SequenceMatcher(None, x, y, autojunk=False).ratio()))


def fuzzy_match(pred, value):
    n = len(value.split())
    toks = pred.split(" ")
    return any(token_sort_ratio(" ".join(toks[i:i + n]), value) / 100.0 > 0.9 for i in range(len(toks)))


def first_position(tokens, pattern):
    """Greedy first position of a gapped pattern's last token, None if it does not occur (-1 for no pattern)."""
    at = -1
    for t in pattern:
        at = next((j for j in range(at + 1, len(tokens)) if tokens[j] == t), None)
        if at is None:
            return None
    return at


def gapped_patterns(texts, n_grams, min_count, top_k, rank):
    """All kept patterns with their counts, straight from the definition: for each kept pattern count
    every later token of every sentence, and keep its best extensions."""
    sentences = [s.split(" ") for t in texts for s in t.split(".")]
    kept, out = [()], {("", 0)}
    for _ in range(n_grams):
        level = []
        for p in kept:
            counts = Counter()
            for tokens in sentences:
                at = first_position(tokens, p)
                if at is not None:
                    counts.update(t for t in tokens[at + 1:] if t != (p[-1] if p else ""))
            good = [(-rank(c), t, c) for t, c in counts.items() if c > min_count and rank(c) > 0]
            level += [(p + (t,), c) for _, t, c in sorted(good)[:top_k]]
        out |= {(" ".join(p), c) for p, c in level}
        kept = [p for p, _ in level]
    return out
