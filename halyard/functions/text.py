"""Column expressions for sentiment labelling and tokenisation."""

from __future__ import annotations

import functools
import glob
import os
import zipfile

from pyspark.sql import Column
from pyspark.sql import functions as F

from halyard.functions.numeric import rnd

# ---------------------------------------------------------------------------
# Fixed values that must equal the source application's (do not edit).
# Word-count fallback lexicons.
POSITIVE_WORDS = (
    "good", "great", "excellent", "happy", "satisfied", "fast", "easy",
    "resolved", "helpful", "professional", "quick", "smooth", "best",
)
NEGATIVE_WORDS = (
    "bad", "terrible", "awful", "slow", "broken", "angry", "frustrated",
    "issue", "problem", "failed", "wrong", "never", "worst", "useless",
    "cancelled", "charged", "overcharged", "waiting", "rude", "dismissed",
)
# Score -> label cut-offs of stored feedback, and compound cut-offs.
SCORE_POSITIVE_CUT, SCORE_NEGATIVE_CUT = 0.2, -0.2
COMPOUND_CUT = 0.05
# Model label aliases.
LABEL_ALIASES = {
    "LABEL_0": "negative", "LABEL_1": "neutral", "LABEL_2": "positive",
    "negative": "negative", "neutral": "neutral", "positive": "positive",
    "pos": "positive", "neg": "negative", "neu": "neutral",
}
# ---------------------------------------------------------------------------

# Word tokens: letters, digits or underscore, at least two of them. Works on
# multilingual text (unlike \w in some engines) and matches DuckDB's RE2.
WORD_TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sentiment_from_score(score) -> Column:
    s = _c(score)
    return (
        F.when(s > SCORE_POSITIVE_CUT, "positive")
        .when(s < SCORE_NEGATIVE_CUT, "negative")
        .otherwise("neutral")
    )


def whitespace_token_set(text) -> Column:
    """Distinct lower-case whitespace tokens (empty pieces removed)."""
    toks = F.split(F.lower(F.coalesce(_c(text), F.lit(""))), r"\s+")
    return F.array_distinct(F.filter(toks, lambda t: t != F.lit("")))


def lexicon_sentiment(text, positive=POSITIVE_WORDS, negative=NEGATIVE_WORDS) -> Column:
    """Struct(label, score, positive, neutral, negative, n_pos, n_neg)."""
    toks = whitespace_token_set(text)
    pos_arr = F.array(*[F.lit(w) for w in positive])
    neg_arr = F.array(*[F.lit(w) for w in negative])
    n_pos = F.size(F.array_intersect(toks, pos_arr))
    n_neg = F.size(F.array_intersect(toks, neg_arr))
    label = F.when(n_pos > n_neg, "positive").when(n_neg > n_pos, "negative").otherwise("neutral")
    score = F.when(n_pos != n_neg, F.lit(0.7)).otherwise(F.lit(0.5))
    p_pos = F.when(n_pos > n_neg, 0.7).when(n_neg > n_pos, 0.1).otherwise(0.2)
    p_neu = F.when(n_pos != n_neg, 0.2).otherwise(0.6)
    p_neg = F.when(n_pos > n_neg, 0.1).when(n_neg > n_pos, 0.7).otherwise(0.2)
    return F.struct(
        label.alias("label"), score.alias("score"),
        p_pos.alias("positive"), p_neu.alias("neutral"), p_neg.alias("negative"),
        n_pos.alias("n_pos"), n_neg.alias("n_neg"),
    )


def label_from_compound(compound) -> Column:
    """Struct(label, score): >= .05 positive, <= -.05 negative, else neutral."""
    c = _c(compound)
    label = F.when(c >= COMPOUND_CUT, "positive").when(c <= -COMPOUND_CUT, "negative").otherwise("neutral")
    score = (
        F.when(c >= COMPOUND_CUT, (c + 1) / 2)
        .when(c <= -COMPOUND_CUT, (F.lit(1) - c) / 2)
        .otherwise(F.lit(0.5))
    )
    return F.struct(label.alias("label"), rnd(score, 4).alias("score"))


def normalise_label(raw) -> Column:
    """Map a model's raw label through the alias table; unknown -> neutral."""
    m = F.create_map(*[x for k, v in LABEL_ALIASES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, _c(raw)), F.lit("neutral"))


def expand_confidence(label, conf) -> Column:
    """Struct(positive, neutral, negative) from a label and its confidence."""
    lab, c = _c(label), _c(conf)
    rest = F.lit(1.0) - c
    pos = F.when(lab == "positive", c).when(lab == "negative", rest * 0.6).otherwise(rest * 0.5)
    neu = F.when(lab == "neutral", c).otherwise(rest * 0.4)
    neg = F.when(lab == "negative", c).when(lab == "positive", rest * 0.6).otherwise(rest * 0.5)
    return F.struct(pos.alias("positive"), neu.alias("neutral"), neg.alias("negative"))


def word_tokens(text) -> Column:
    """Lower-case word tokens of at least two characters, in text order."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(text), F.lit(""))), F.lit(WORD_TOKEN_PATTERN), 0)


@functools.lru_cache(maxsize=1)
def english_stop_words() -> tuple[str, ...]:
    """Spark ML's default English stop-word list, read from the installed jar.

    Reading the resource directly (instead of through the JVM) lets the
    SQL oracle and driver-side code use the very same list without a session.
    """
    import pyspark

    jars = glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "spark-mllib_*.jar"))
    for jar in jars:
        with zipfile.ZipFile(jar) as z:
            name = "org/apache/spark/ml/feature/stopwords/english.txt"
            if name in z.namelist():
                words = z.read(name).decode("utf-8").split()
                return tuple(w.strip() for w in words if w.strip())
    from pyspark.ml.feature import StopWordsRemover

    return tuple(StopWordsRemover.loadDefaultStopWords("english"))
