"""Expressions over post texts."""

from __future__ import annotations

import re
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no terms.
STOPWORDS = """
the and is in to of it that you for on with as at by from up about into over after this have or one had word but not what all
were we when your can said there use an each which she do how their if will way many then them write would like so these her long
make thing see him two has look more day could go come did number sound no most people my know water than call first who may down
side been now find any new work part take get place made live where back little only round man year came show every good me give
our under name very through just form sentence great think say help low line differ turn cause much mean before move right boy old
too same tell does set three want air well also play small end put home read hand port large spell add even land here must big high
such follow act why ask men change went light kind off need house picture try us again animal point mother world near build self
earth father http https com www rt amp
""".split()

# Fixed values: (strong, moderate) words of three feelings.
MARKERS = {
    "anxiety": (
        ["panic", "panicked", "panicking", "terrified", "terrifying", "dread", "dreading", "anxiety", "anxious", "anxiously", "paralyzed", "horrified", "freaking out"],
        ["worried", "worry", "worrying", "nervous", "stressed", "stressful", "stress", "uneasy", "apprehensive", "fearful", "troubled", "concerned", "overwhelmed", "hesitant", "distressed"],
    ),
    "excitement": (
        ["hyped", "hype", "ecstatic", "thrilled", "thrilling", "pumped", "electrifying", "unbelievable", "epic", "insane", "fire", "🚀", "🔥", "breathtaking", "phenomenal"],
        ["excited", "exciting", "excitement", "can't wait", "cant wait", "amazing", "great", "fantastic", "awesome", "eager", "enthusiastic", "stoked", "delighted", "energized"],
    ),
    "optimism": (["hope", "hopeful", "optimistic", "optimism", "promising", "bright future"], ["looking forward", "progress", "confident", "positive outlook"]),
}


def hashtags(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?U)#(\w+)"), F.lit(1))


def mentions(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?U)@(\w+)"), F.lit(1))


def urls(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"https?://\S+"), F.lit(0))


def tweet_normalised(c: Column) -> Column:
    """@x becomes @user and http... becomes http, between single blanks."""
    token = lambda t: F.when(t.startswith("@") & (F.length(t) > 1), "@user").when(t.startswith("http"), "http").otherwise(t)
    return F.trim(F.array_join(F.transform(F.split(c, " "), token), " "))


def language_text(c: Column) -> Column:
    """Without URLs, mentions, tags, digits and punctuation, blanks joined."""
    bare = F.regexp_replace(c, r"https?://\S+|[@#]\S+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?U)[^\p{L}\s]+", " "), r"\s+", " "))


def tag_terms(text: Column, tags: Column | None = None) -> Column:
    """Tags in lower case with one # before them: those given, unless none are, else those in the text."""
    found = hashtags(text)
    if tags is not None:
        found = F.when(F.size(F.coalesce(tags, F.array().cast("array<string>"))) > 0, tags).otherwise(found)
    bare = F.filter(F.transform(found, lambda t: F.regexp_replace(F.lower(t), "^#+", "")), lambda t: t != "")
    return F.transform(bare, lambda t: F.concat(F.lit("#"), t))


def key_words(text: Column) -> Column:
    """Words of three ASCII letters or more outside tags and links, in lower case, stop words among them."""
    rest = F.lower(F.regexp_replace(F.regexp_replace(text, r"(?U)#\w+", " "), r"https?://\S+", " "))
    return F.regexp_extract_all(rest, F.lit(r"(?U)(?<!\w)[a-z]{3,}+(?!\w)"), F.lit(0))


def terms(text: Column, tags: Column | None = None, target: str = "all") -> Column:
    """array<string> of tag_terms and key_words, repeated as often as they stand; what has no # is a keyword, and those
    that are stop words are to be left out once the array is exploded: one look-up in generated code for each."""
    if target not in ("all", "hashtags", "keywords"):
        raise ValueError(f"no such target: {target!r}")
    if target == "hashtags":
        return tag_terms(text, tags)
    return key_words(text) if target == "keywords" else F.concat(tag_terms(text, tags), key_words(text))


def whole_word(text: Column, term: str) -> Column:
    """Whether text has the term as a word, with or without #, in any case."""
    bare = term.strip().lstrip("#")
    if not bare:
        return F.lit(False)
    return text.rlike(rf"(?i)(?:^|[^a-zA-Z0-9_])#?{re.escape(bare)}(?:[^a-zA-Z0-9_]|$)")


def intensity(text: Column, feeling: str, cap: float = 2.0) -> Column:
    """Strong words 1, moderate ones 0.5, an exclamation mark and a shouted word 0.25 each; over cap, 1 at most."""
    low, score = F.lower(text), F.lit(0.0)
    for words, weight in zip(MARKERS[feeling], (1.0, 0.5), strict=True):
        part = F.lit(0.0)
        for w in words:
            has = F.contains(low, F.lit(w))  # most texts have none of the words: only those that do are matched
            part = part + F.when(has & low.rlike(rf"\b{re.escape(w)}\b") if w.isascii() else has, weight).otherwise(0.0)
        score = score + part
    score = score + F.when(F.contains(text, F.lit("!")), 0.25).otherwise(0.0)
    loud = F.regexp_extract_all(text, F.lit(r"(?<!\S)[^\sa-z]{3,}+(?!\S)"), F.lit(0))  # words that can be shouted
    shouted = F.exists(loud, lambda w: (F.upper(w) == w) & (F.lower(w) != w))
    return F.least(F.lit(1.0), (score + F.when(shouted, 0.25).otherwise(0.0)) / cap)


# The commonest words of languages.
COMMON = {
    "en": "the and of to in is that it for with was this are".split(),
    "fr": "le la les et des est une dans que pour qui pas du".split(),
    "de": "der die das und ist nicht ein eine mit den von zu auf".split(),
    "es": "el los las y que en una por con para del es se".split(),
}


def language_guess(text: Column) -> Column:
    """struct<lang, confidence> by the share of each language's commonest words; en and 0 for texts without any."""
    words = F.split(F.lower(language_text(text)), " ")
    scored = F.array(*[F.struct((F.size(_among(words, own)) / F.greatest(F.size(words), F.lit(1))).alias("confidence"), F.lit(lang).alias("lang")) for lang, own in COMMON.items()])
    best = F.array_max(scored)
    return F.when(best["confidence"] > 0, F.struct(best["lang"].alias("lang"), F.round(best["confidence"], 4).alias("confidence"))).otherwise(F.struct(F.lit("en").alias("lang"), F.lit(0.0).alias("confidence")))


def _among(words: Column, own: list[str]) -> Column:
    return F.filter(words, lambda w: w.isin(own))
