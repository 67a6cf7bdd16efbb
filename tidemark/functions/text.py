"""Text expressions: hashes, ids, tag stripping, keyword sentiment, emotion shares, word differences."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import d

# Keyword lists and emotion vocabularies with their weights.
POSITIVE = ["gain", "rise", "rally", "up", "bull", "strong"]
NEGATIVE = ["fall", "drop", "crash", "down", "bear", "weak"]
EMOTIONS = {
    "fear": [
        "fear", "panic", "crash", "collapse", "crisis", "warning", "danger", "plunge", "tumble", "spiral",
        "contagion", "default", "recession", "depression", "shock", "turmoil", "rout", "meltdown", "carnage",
        "selloff", "bloodbath", "free fall", "systemic"],
    "greed": [
        "rally", "surge", "soar", "bullish", "boom", "gain", "profit", "record", "high", "upside", "breakout",
        "strong", "buy", "inflow", "demand", "optimism", "growth", "momentum", "outperform", "euphoria", "frenzy",
        "fomo", "all-time high"],
    "uncertainty": [
        "uncertain", "unclear", "mixed", "wait", "pending", "ambiguous", "conflicting", "volatile", "choppy",
        "cautious", "hesitant", "undecided", "opaque", "murky", "crosscurrent", "diverge", "unpredictable",
        "unstable", "unknown", "risk"],
    "calm": [
        "stable", "steady", "hold", "flat", "unchanged", "range", "consolidate", "stabilize", "pause", "contained",
        "anchored", "orderly", "balanced", "tempered", "moderate", "gradual"],
}
EMOTION_WEIGHTS = {"fear": 1.4, "greed": 1.2, "uncertainty": 1.0, "calm": 0.9}

# White space as the usual word splitters understand it, beyond ASCII.
SPACE = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]+"


#: All characters that count as white space at the ends of a text.
WHITE = " \t\n\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """`c` without white space at its ends, line ends and non-breaking blanks included."""
    return F.btrim(c, F.lit(WHITE))


def head(c: Column, width: int | None) -> Column:
    """The first `width` characters; all of them if there is no width."""
    return c if width is None else F.substring(c, 1, width)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), SPACE), "")


def keyword_sentiment(tokens: Column, positive: list[str] = POSITIVE, negative: list[str] = NEGATIVE) -> Column:
    """(pos - neg) / (pos + neg + 1e-8) over whole-word hits."""
    def hits(vocab: list[str]) -> Column:
        return F.size(F.filter(tokens, lambda w: w.isin(*vocab))).cast("double")

    pos, neg = hits(positive), hits(negative)
    return (pos - neg) / (pos + neg + 1e-8)


def contains_any(terms: list[str]) -> str:
    """A pattern that finds any of the terms; shared beginnings are factored out, so few branches are tried."""
    root: dict = {}
    for term in terms:
        node = root
        for ch in term:
            node = node.setdefault(ch, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        if "" in node:  # a term ends here: longer ones add nothing
            return ""
        parts = [(ch if ch.isalnum() or ch == " " else "\\" + ch) + pattern(child) for ch, child in sorted(node.items())]
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    return pattern(root)


#: Words that a worker remembers the vocabularies of, at most.
MEMO = 1 << 18


def _word_counts(vocab: dict[str, list[str]]):
    """A struct per text: how many words it has, and how many contain a term of each vocabulary.

    Java's matcher tries every branch at every character, which took ten times as long as counting a text's words and
    matching each distinct word once; hence an Arrow function.
    """
    names = list(vocab)
    patterns = [contains_any([t for t in terms if " " not in t]) for terms in vocab.values()]  # a word holds no blank
    memo: dict[str, tuple[int, ...]] = {}

    @F.pandas_udf(f"`_all` double, {', '.join(f'`{n}` double' for n in names)}")
    def counts(texts: pd.Series) -> pd.DataFrame:
        match = [re.compile(p).search for p in patterns]
        out = np.zeros((len(texts), len(names) + 1))
        for i, text in enumerate(texts):
            if text is None:
                out[i] = np.nan
                continue
            tally = Counter(text.lower().split())
            out[i, 0] = sum(tally.values())
            if len(memo) > MEMO:
                memo.clear()
            for word, n in tally.items():
                found = memo.get(word)
                if found is None:
                    found = memo[word] = tuple(j for j, m in enumerate(match, 1) if m(word))
                for j in found:
                    out[i, j] += n
        return pd.DataFrame(out, columns=["_all", *names])

    return counts


def with_emotions(df: DataFrame, text: str, vocab: dict[str, list[str]] = EMOTIONS,
                  weights: dict[str, float] = EMOTION_WEIGHTS) -> DataFrame:
    """Add `<emotion>_share` per vocabulary: the weighted share of the words of column `text` that contain one of its
    terms, scaled so that the shares sum to one. Null texts have null shares."""
    out = df.withColumn("_n", _word_counts(vocab)(F.col(text).cast("string")))
    n = F.nanvl("_n._all", F.lit(None).cast("double")) + 1e-8
    scores = {name: F.col(f"_n.`{name}`") / n * weights.get(name, 1.0) for name in vocab}
    total = sum(scores.values(), d(0)) + 1e-8
    return out.withColumns({f"{name}_share": s / total for name, s in scores.items()}).drop("_n")


def text_hash(text: Column) -> Column:
    return F.substring(F.md5(text), 1, 12)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def news_id(url: Column, seconds: Column, text: Column) -> Column:
    """Stable id from url and whole second, or from the first 200 characters when there is no url."""
    head = F.when(F.coalesce(F.length(url), F.lit(0)) > 0, url).otherwise(F.substring(text, 1, 200))
    return F.substring(F.sha2(F.concat(head, F.lit("|"), seconds.cast("long").cast("string")), 256), 1, 32)


def strip_html(html: Column) -> Column:
    """Visible text: scripts, styles and tags removed, white space collapsed."""
    out = F.regexp_replace(html, r"(?is)<script.*?</script>", " ")
    out = F.regexp_replace(out, r"(?is)<style.*?</style>", " ")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    return strip(F.regexp_replace(out, r"\s+", " "))


def statement_body(text: Column, start: str = "Information received", stop: tuple[str, ...] = (
        "Voting for", "For media inquiries"), width: int | None = None) -> Column:
    """The part between the opening words and the vote or contact line, else all of it; `width` cuts it."""
    pattern = rf"(?s)({start}.+?)(?:{'|'.join(stop)})"
    body = strip(F.regexp_extract(text, pattern, 1))
    return head(F.coalesce(F.nullif(body, F.lit("")), text), width)


def added_words(previous: Column, current: Column) -> Column:
    """Distinct words of the current text that the previous one lacks."""
    return F.array_except(F.split(F.trim(current), SPACE), F.split(F.trim(F.coalesce(previous, F.lit(""))), SPACE))
