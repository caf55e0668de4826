"""Text features as Column expressions. A null text gives null unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that decide what counts as a channel switch, as boilerplate
# around one, and as filler.
LEADING_MENTIONS = r"(?U)^(?:\s*@\w+)+\s*"
URL = r"(?U)https?://\S+"
REDIRECTS = {
    "dm_us": r"\b(?:dm|d\.m\.|pm) (?:us|me)\b|\bsend (?:us|me) a (?:dm|d\.m\.|direct message|private message)\b|\bdirect message us\b",
    "send_us_details": r"\bsend (?:us|me) (?:your|the|a) \b",
    "dm_your_details": r"\b(?:dm|d\.m\.) (?:your|the|me your)\b",
    "follow_and_dm": r"\bfollow (?:and|then) dm\b|\bfollow us (?:and|so)\b",
    "contact_us": r"\b(?:reach out to|contact) (?:us|our|the) \b",
    "call_us": r"\bcall (?:us|our|customer|support)\b|\bgive us a call\b|\b1-8\d\d\b",
    "email_us": r"\b(?:e-?mail (?:us|your)|send (?:us )?an e-?mail)\b",
    "already_dmd": r"\b(?:we|i)(?:'ve| have) (?:just )?(?:sent|dm'?d|replied)\b[^.!?]*\b(?:dm|direct message)\b|\bin touch via dm\b",
}
SIGN_OFF = r"\b(?:feel free to|don'?t hesitate to|please do)\s+(?:reach out|contact)|\b(?:reach out|contact us)[^.!?]*\bagain\b|\bif you (?:need|have)\b[^.!?]*\b(?:reach out|contact us)\b"
BOILERPLATE = (
    r"[\^*][a-z]{1,6}\b",
    r"(?:\s[-/][a-z]{2,6})\s*$",
    r"<url>",
    r"\b(?:hi|hey|hello|good (?:morning|afternoon|evening))\b(?: there)?|\bhelp'?s here\b|\bthank(?:s| you)(?: so much)?(?: for [^.!?,]*)?",
    r"\boh no\b|\bapologies\b|\bwe apologi[sz]e\b|\b(?:we|i)(?:'re| am|'m| are)? ?(?:so |very |really |truly )?sorry\b(?: to hear| for| about| that)?",
    r"\b(?:we|i)(?:'re| are|'d| would| will|'ll)? ?(?:be )?(?:more than )?(?:here to help|happy to (?:help|assist|look)|like to (?:help|assist|look)|love to (?:help|assist)|want to help|can definitely|can certainly)\b|\bhere to help\b|\blet'?s (?:take a look|look into)\b|\btake a (?:closer )?look\b",
    r"\bso (?:that )?(?:we|i|our team) (?:can|may)\b[^.!?]*|\band (?:we|our team) will be\b[^.!?]*|\band (?:we|our team) will\b[^.!?]*|\bso we can\b[^.!?]*",
)
FILLER = (
    "a", "about", "an", "and", "any", "are", "as", "at", "be", "but", "by", "can", "could", "do", "for", "from", "further", "get", "have", "here", "how", "i", "if", "in", "into", "is", "it", "just", "like", "look", "me", "more", "not", "of", "on", "once", "or", "our", "out", "over", "please", "so", "team", "that", "the", "then", "there", "this", "to", "up", "us", "we", "will", "with", "would", "you", "your",
)
MAX_RESIDUAL_WORDS = 3
PART_MARKER = r"(?U)^\s*(?:@\w+\s+)*\(?(\d)\s*(?:/|of)\s*\d{1,2}\)?[\s:.\-]|^\s*(?:@\w+\s+)*\(?(\d)\)?\s*[:.](?:\s|(?=[A-Za-z]))"
SIGNATURE = r"(?U)\s*/([A-Za-z]{1,2})(?=\s*$|\s+https?://\S+\s*$)"
MARKER_ONLY = r"(?U)^\s*(?:\(?\d\s*(?:/|of)\s*\d{1,2}\)?(?:[\s:.\-]|$)|\(?\d\)?\s*[:.](?:\s|$|(?=[A-Za-z])))"
FIRST_MARKER = r"(?U)^((?:\s*@\w+)*\s*)(?:\(?\d\s*(?:/|of)\s*\d{1,2}\)?(?:[\s:.\-]|$)|\(?\d\)?\s*[:.](?:\s|$|(?=[A-Za-z])))"
MULTIPART = r"(?U)^\s*\(?\d{1,2}\s*(?:/|of)\s*\d{1,2}\)?[\s:.\-]|[\s(]\(?\d{1,2}\s*/\s*\d{1,2}\)?\s*$|^\s*\(?\d{1,2}\)?\s*[:.]\s"
FUNCTION_WORDS = {
    "es": ("que", "para", "por", "los", "las", "con", "una", "tu", "te", "cuenta", "gracias", "puedes", "nos"),
    "pt": ("que", "para", "por", "uma", "voce", "você", "nos", "obrigado", "sua", "seu", "com", "mais"),
    "fr": ("que", "pour", "vous", "nous", "votre", "avec", "merci", "une", "est", "sur", "bonjour"),
    "de": ("und", "sie", "wir", "ist", "nicht", "das", "den", "dich", "bitte", "gerne", "danke"),
    "it": ("che", "per", "una", "non", "con", "grazie", "tuo", "ciao", "sono", "puoi"),
}
ENGLISH_WORDS = ("the", "you", "we", "to", "and", "for", "is", "your", "this", "that", "with", "please", "can", "our")
INTENTS = ("playback_library", "app_bug", "content_issue", "account_access", "billing_dispute", "subscription_query", "how_to_question", "feature_request", "other")


def once(value: Column) -> Column:
    """value as a generated column, computed once for all that use it. A select holds one of them."""
    return F.explode(F.array(value))


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it: a lambda's variable is not copied."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def any_of(patterns) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def strip(text: Column) -> Column:
    """Without white space (Unicode) at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def normalize(text: Column) -> Column:
    """Lower case, no mentions in front, links as <url>, single blanks."""
    text = F.regexp_replace(F.regexp_replace(text, LEADING_MENTIONS, ""), URL, "<url>")
    return F.lower(collapse(text))


def has_redirect(normal: Column) -> Column:
    """Whether a channel switch is there, other than a mere sign-off."""
    others = any_of(p for name, p in REDIRECTS.items() if name != "contact_us")
    return normal.rlike(any_of(REDIRECTS.values())) & ~(normal.rlike(SIGN_OFF) & ~normal.rlike(others))


def residual_words(normal: Column) -> Column:
    """The words that are left when boilerplate, channel switches, punctuation and filler go."""
    bare = reduce(lambda t, p: F.regexp_replace(t, p, " "), [*BOILERPLATE, any_of(REDIRECTS.values()), r"[^a-z0-9' ]+"], normal)
    return F.filter(F.split(bare, r"\s+"), lambda w: (w != "") & ~w.isin(*FILLER))


def residual(normal: Column) -> Column:
    return F.array_join(residual_words(normal), " ")


def is_deflection(normal: Column) -> Column:
    return has_redirect(normal) & (F.size(residual_words(normal)) <= MAX_RESIDUAL_WORDS)


def part_number(text: Column) -> Column:
    found = [F.nullif(F.regexp_extract(text, PART_MARKER, i), F.lit("")) for i in (1, 2)]
    return F.coalesce(*found).cast("int")


def signature(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, SIGNATURE, 1), F.lit(""))


def without_signature(text: Column) -> Column:
    return strip(F.regexp_replace(text, SIGNATURE, ""))


def without_prefix(text: Column) -> Column:
    """A later part without mentions and marker; as it is if nothing were left."""
    bare = strip(F.regexp_replace(F.regexp_replace(text, LEADING_MENTIONS, ""), MARKER_ONLY, ""))
    return F.when(F.length(bare) > 0, bare).otherwise(text)


def without_first_marker(text: Column) -> Column:
    return strip(F.regexp_replace(text, FIRST_MARKER, "$1"))


def is_multipart(text: Column) -> Column:
    return text.rlike(MULTIPART)


def is_non_english(normal: Column) -> Column:
    """Mostly letters beyond Latin, or two function words of another language and fewer than two English ones."""
    share = let(F.regexp_count(normal, F.lit(r"\p{L}")), lambda letters: (letters >= 10) & (F.regexp_count(normal, F.lit(r"\p{IsLatin}")) / F.greatest(letters, F.lit(1)) < 0.8))
    hits = lambda found, known: F.size(F.array_intersect(found, F.array(*[F.lit(w) for w in known])))
    foreign = lambda found: reduce(lambda a, b: a | b, [hits(found, w) >= 2 for w in FUNCTION_WORDS.values()])
    spoken = let(F.array_distinct(words(normal)), lambda found: F.when(hits(found, ENGLISH_WORDS) >= 2, False).otherwise(foreign(found)))
    return F.when(share, True).otherwise(spoken)


def first_words(text: Column, n: int = 6) -> Column:
    return F.array_join(F.slice(words(normalize(text)), 1, n), " ")


def parse_intent(raw: Column) -> Column:
    """struct(intent, parse_ok): an exact label, else the only label inside, else other and false."""
    clean = F.regexp_replace(strip(F.regexp_replace(strip(raw), r"^[`\"'.]+|[`\"'.]+$", "")), "[ -]", "_")
    clean = F.lower(clean)
    labels = F.array(*[F.lit(i) for i in INTENTS])
    inside = F.filter(labels, lambda label: F.contains(clean, label))
    ok = F.array_contains(labels, clean) | (F.size(inside) == 1)
    return F.struct(F.when(F.array_contains(labels, clean), clean).when(F.size(inside) == 1, inside[0]).otherwise("other").alias("intent"), ok.alias("parse_ok"))


def tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 3.5)


def cache_key(*parts: Column) -> Column:
    """SHA-256 of the parts, nulls empty, joined by NUL."""
    return F.sha2(F.array_join(F.array(*[F.coalesce(p, F.lit("")) for p in parts]), "\0"), 256)


def comma_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), strip), lambda x: x != "")
