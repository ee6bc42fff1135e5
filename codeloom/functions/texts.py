"""Text expressions that Catalyst evaluates itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.kernels import LEAST_STEM, STOPWORDS, SUFFIXES

#: White space as Python sees it.
SPACE = r"(?U)[\s\x1c-\x1f]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squeeze(text) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(_col(text), SPACE, " "))


def trivial_key(label) -> Column:
    return F.lower(F.regexp_replace(_col(label), SPACE, ""))


def sentence_count(text) -> Column:
    return F.greatest(F.lit(1), F.regexp_count(_col(text), F.lit("[.?!]+")))


def word_count(text) -> Column:
    return F.regexp_count(_col(text), F.lit(r"(?U)[^\s\x1c-\x1f]+"))


def excerpt(text, most: int = 120) -> Column:
    t = _col(text)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.substring(t, 1, most - 3), F.lit("...")))


def stem(token: Column) -> Column:
    """The first fitting suffix goes; a result that would be too short, or an ending in ss, leaves the token as it is."""
    out = F.when((F.length(token) <= LEAST_STEM) | token.endswith("ss"), token)
    for suffix, put in SUFFIXES:
        short = F.concat(F.substring(token, F.lit(1), F.length(token) - len(suffix)), F.lit(put))
        out = out.when(token.endswith(suffix), F.when(F.length(short) >= LEAST_STEM, short).otherwise(token))
    return out.otherwise(token)


def lexical_tokens(text) -> Column:
    found = F.regexp_extract_all(F.lower(_col(text)), F.lit("[a-z0-9]+"), 0)
    return F.transform(F.filter(found, lambda t: ~t.isin(*sorted(STOPWORDS))), stem)


def label_tokens(label) -> Column:
    return F.filter(F.split(F.translate(_col(label), "-", "_"), "_"), lambda x: x != "")


def jaccard(a, b) -> Column:
    """Set similarity; two empty sets are equal."""
    union = F.size(F.array_union(_col(a), _col(b)))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(_col(a), _col(b))) / union)


def interval_jaccard(s1, e1, s2, e2) -> Column:
    s1, e1, s2, e2 = map(_col, (s1, e1, s2, e2))
    common = F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))
    union = (e1 - s1) + (e2 - s2) - common
    return F.when(union > 0, common / union).otherwise(F.lit(0.0))


def overlaps(s1, e1, s2, e2) -> Column:
    s1, e1, s2, e2 = map(_col, (s1, e1, s2, e2))
    return F.least(e1, e2) > F.greatest(s1, s2)


def string_overlap(a, b) -> Column:
    """1 for equal texts, the ratio of lengths where one holds the other, else 0."""
    a, b = _col(a), _col(b)
    small, large = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    return F.when((a == "") | (b == ""), F.lit(0.0)).when(a == b, F.lit(1.0)).when(a.contains(b) | b.contains(a), small / large).otherwise(F.lit(0.0))


def strip_fences(text) -> Column:
    """What stands inside a Markdown fence, or the trimmed text."""
    t = F.trim(_col(text))
    inside = F.regexp_extract(t, r"(?s)^```[a-zA-Z0-9]*\s*\n(.*?)\n?```$", 1)
    return F.when(t.rlike(r"(?s)^```.*```$"), F.trim(inside)).otherwise(t)


def one_of(value, allowed: list[str], default: str) -> Column:
    return F.when(_col(value).isin(*allowed), _col(value)).otherwise(F.lit(default))


def numbered_cell(text) -> Column:
    """'12. text' or '12) text' as (number, text); null if the text is no such cell."""
    pattern = r"(?s)^\s*(\d+)\s*[.)]\s*(.+)$"
    t = _col(text)
    return F.when(t.rlike(pattern), F.struct(F.regexp_extract(t, pattern, 1).cast("long").alias("number"), F.trim(F.regexp_extract(t, pattern, 2)).alias("text")))


def cosine(a, b) -> Column:
    """Cosine of two arrays, 0 where one has no length, kept within [-1, 1]."""
    a, b = _col(a), _col(b)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(size == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / size)))


def route(score, tau_high: float, tau_low: float) -> Column:
    s = _col(score)
    return F.when(s >= tau_high, F.lit("MERGE")).when(s < tau_low, F.lit("CREATE")).otherwise(F.lit("JUDGE"))


#: Characters that a text is cut into before its runs are taken: finding a place in a text costs its distance from the start.
GRAM_BLOCK = 1000


def char_grams(rows: DataFrame, key: str, text: str, n: Column | int) -> DataFrame:
    """(key, at, h): offset and hash of every run of n characters of a text; a shorter text is one run. Linear in the text."""
    n = F.lit(n) if isinstance(n, int) else n
    blocks = F.sequence(F.lit(0), F.floor(F.greatest(F.lit(0), F.length(text) - n) / GRAM_BLOCK).cast("int"))
    parts = F.transform(blocks, lambda k: F.substring(F.col(text), k * GRAM_BLOCK + 1, n + F.lit(GRAM_BLOCK - 1)))
    cut = rows.where(F.length(text) > 0).select(F.col(key).alias("__key"), n.alias("__n"), F.posexplode(parts).alias("__block", "__part"))
    size = F.col("__n")
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("__part") - size + 1)), lambda k: F.xxhash64(F.substring(F.col("__part"), k, size)))
    return cut.select("__key", "__block", F.posexplode(runs).alias("__at", "h")).select(F.col("__key").alias(key), (F.col("__block") * GRAM_BLOCK + F.col("__at")).cast("int").alias("at"), "h")
