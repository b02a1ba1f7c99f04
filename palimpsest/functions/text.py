"""Text: normal forms, fillers, overlap, token estimates, summaries and redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that two unrelated sentences share anyway.
STOP_WORDS = (
    "a", "an", "and", "the", "of", "to", "in", "on", "at", "it", "is", "was",
    "they", "them", "their", "he", "she", "his", "her", "i", "me", "my",
    "that", "this", "with", "for", "from", "as", "but", "or", "so", "then",
)

# Whole turns that are acknowledgements and nothing more.
TRIVIAL_TURNS = (
    "yeah", "yep", "yes", "yup", "no", "nope", "ok", "okay", "k", "sure", "right", "got it", "i see",
    "makes sense", "that makes sense", "go on", "continue", "carry on", "thanks", "thank you", "thx", "ty",
    "cool", "nice", "great", "hmm", "hm", "mhm", "mm", "uh huh", "huh", "oh", "ah", "hi", "hey", "hello",
    "bye", "goodbye", "good night", "goodnight", "brb", "one sec", "wait", "interesting", "yeah interesting",
    "fair enough", "true", "exactly", "agreed",
)

# Phrases of distress.
CRISIS_PHRASES = (
    "kill myself", "killing myself", "end my life", "ending my life", "take my own life", "taking my own life",
    "want to die", "wanna die", "better off dead", "suicidal", "suicide", "hurt myself", "hurting myself",
    "harm myself", "harming myself", "cut myself", "cutting myself", "no reason to live",
    "nothing left to live for", "cant go on anymore", "can t go on anymore",
)

# Hesitation sounds, the longer of two spellings first.
FILLERS = ("uh-huh", "mm-hmm", "uhh", "umm", "hmm", "mmm", "erm", "uh", "um", "er")

_FILLER = r"(?i)(?<![\w-])(?:" + "|".join(FILLERS) + r")(?![\w-])"

# What is put right after a removal, in this order.
_TIDY = (
    (r"[ \t]{2,}", " "),
    (r"[ \t]+([,.!?;:])", "$1"),
    (r"([,;:])(?:[ \t]*[,;:])+", "$1"),
    (r"(?m)^[ \t]*[,;:]+[ \t]*", ""),
    (r"[ \t]+\n", "\n"),
)


def fold(text: Column) -> Column:
    """Without case, for comparison: lower case, a sharp s as two of them, and one form of sigma."""
    return F.replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def normalise(text: Column) -> Column:
    """Without case, anything but letters and digits a space, spaces collapsed."""
    return F.trim(F.regexp_replace(fold(text), r"[^\p{L}\p{N}]+", " "))


def flatten(text: Column) -> Column:
    """ASCII words in lower case, with a space on either side, so that a padded word is found whole."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), F.lit(" "))


def mentions(text: Column, name: Column) -> Column:
    """Whether a name stands in a text as whole words; an empty name doesn't."""
    return F.coalesce((F.trim(flatten(name)) != "") & F.contains(flatten(text), flatten(name)), F.lit(False))


def era_key(name: Column) -> Column:
    """Letters and digits in lower case, joined by underscores: one key for spellings of a name."""
    return F.replace(normalise(name), F.lit(" "), F.lit("_"))


def is_trivial(text: Column) -> Column:
    return normalise(text).isin(*TRIVIAL_TURNS)


def in_crisis(text: Column) -> Column:
    return F.coalesce(normalise(text).rlike("|".join(CRISIS_PHRASES)), F.lit(False))


def filler_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(_FILLER))


def strip_fillers(text: Column) -> Column:
    """Without standalone hesitation sounds; a text without any stays as it is."""
    tidy = F.regexp_replace(text, _FILLER, "")
    for pattern, put in _TIDY:
        tidy = F.regexp_replace(tidy, pattern, put)
    return F.when(filler_count(text) > 0, F.regexp_replace(tidy, r"^\s+|\s+$", "")).otherwise(text)


def without_marker(text: Column, marker: str) -> Column:
    """A marker token removed, and blank lines tidied only where one was."""
    gone = F.replace(text, F.lit(marker), F.lit(""))
    tidy = F.regexp_replace(F.regexp_replace(gone, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    return F.when(F.contains(text, F.lit(marker)), tidy).otherwise(text)


def content_words(text: Column) -> Column:
    """Distinct words but the stop words."""
    words = F.array_distinct(F.split(normalise(text), " "))
    return F.array_except(words, F.array(*[F.lit(w) for w in ("", *STOP_WORDS)]))


def overlap(left: Column, right: Column) -> Column:
    """Shared content words over the smaller set; 0 where either has none."""
    a, b = content_words(left), content_words(right)
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def word_overlap(keywords: Column, text: Column) -> Column:
    """Share of distinct keywords that stand in the text, as parts of words too."""
    words = F.array_distinct(F.transform(keywords, normalise))
    words = F.filter(words, lambda w: w != "")
    return F.when(F.size(words) > 0, F.size(F.filter(words, lambda w: F.contains(normalise(text), w))) / F.size(words)).otherwise(0.0)


def token_estimate(text: Column, chars_per_token: float = 4.0) -> Column:
    return F.ceil(F.char_length(text) / max(chars_per_token, 1.0)).cast("long")


def word_count(text: Column) -> Column:
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\s+"))).cast("long")


def fingerprint(text: Column) -> Column:
    """128 bits of SHA-256 in hex."""
    return F.substring(F.sha2(text, 256), 1, 32)


def local_summary(text: Column, limit: int = 80) -> Column:
    """White space collapsed; a longer text is cut and gets an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.char_length(flat) > limit, F.concat(F.rtrim(F.substring(flat, 1, limit)), F.lit("…"))).otherwise(flat)


def preview(columns: list[Column], node_id: Column, limit: int = 240) -> Column:
    """The first of some columns that isn't blank, cut; the id where all are."""
    kept = [F.nullif(F.trim(c), F.lit("")) for c in columns]
    return F.substring(F.coalesce(*kept, node_id), 1, limit)


def erased(at: Column) -> Column:
    """What stands in place of an erased text."""
    return F.concat(F.lit("[ERASED: "), F.date_format(at, "yyyy-MM-dd"), F.lit("]"))


def erased_person(name: Column) -> Column:
    """A placeholder that stays the same for a name without telling it."""
    return F.concat(F.lit("person_"), F.substring(F.sha2(F.trim(name), 256), 1, 8))


def humanise(at: Column, now: Column, cut_over_days: int = 60) -> Column:
    """Relative wording for recent dates, month and year beyond."""
    days = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 86_400_000_000)
    return (
        F.when(at.isNull(), "at an unknown time")
        .when(days <= 0, "today")
        .when(days == 1, "yesterday")
        .when(days < 14, F.concat(days.cast("string"), F.lit(" days ago")))
        .when(days < cut_over_days, F.concat(F.floor(days / 7).cast("string"), F.lit(" weeks ago")))
        .otherwise(F.date_format(at, "MMMM yyyy"))
    )
