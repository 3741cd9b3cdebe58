"""Text scalar operators (T1-T10) as built-in column expressions.

All regex classes are spelled out so that Spark (Java regex) and the DuckDB
oracle (RE2) agree; white space is what Python's ``str.split`` takes for it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference: the stop-word list of the EDA
# script (128 entries, the last one is the empty string), in its own order.
STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours",
    "yourself", "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself",
    "it", "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which", "who",
    "whom", "this", "that", "these", "those", "am", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or",
    "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against", "between",
    "into", "through", "during", "before", "after", "above", "below", "to", "from", "up", "down", "in",
    "out", "on", "off", "over", "under", "again", "further", "then", "once", "here", "there", "when",
    "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no",
    "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don",
    "should", "now", "",
]

# The AEDA punctuation marks, in the reference's order.
PUNCTUATIONS = [".", ",", "!", "?", ";", ":"]

# The characters that Python's str.split() and str.strip() take for white space,
# spelled out so that Java's and RE2's expressions agree.
WS = r"\t-\r\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WS_CLASS = f"[{WS}]"
NON_WS_CLASS = f"[^{WS}]"


def duck_str_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def is_stop(word: Column) -> Column:
    """T4: lowercase exact match against the fixed list (a hash set, not a walk through it for every word)."""
    return word.isin(STOP_WORDS)


def clean_letters(text: Column) -> Column:
    """Drop apostrophes, lowercase, every non a-z/space char to a space,
    collapse runs of spaces, drop one leading space (a trailing one stays)."""
    t = F.regexp_replace(text, "[’']", "")
    t = F.regexp_replace(F.lower(t), "[^a-z ]", " ")
    t = F.regexp_replace(t, " +", " ")
    return F.regexp_replace(t, "^ ", "")


def clean_decoded(text: Column) -> Column:
    """Remove [unusedN], drop chars outside letters/digits/whitespace/.,!?',
    collapse whitespace, trim, remove ' ##'."""
    t = F.regexp_replace(text, "\\[unused[0-9]+\\]", "")
    t = F.regexp_replace(t, f"[^a-zA-Z0-9{WS}.,!?']", "")
    t = F.regexp_replace(t, WS_CLASS + "+", " ")
    t = F.trim(t)
    return F.replace(t, F.lit(" ##"), F.lit(""))


def split_keep_empty(text: Column) -> Column:
    """Split on single spaces, empty tokens kept."""
    return F.split(text, " ")


def split_nonempty(text: Column) -> Column:
    """Split on single spaces, empty tokens dropped."""
    return F.array_remove(F.split(text, " "), "")


def split_ws(text: Column) -> Column:
    """Split on runs of whitespace, no empty tokens (Python str.split())."""
    return F.array_remove(F.split(text, WS_CLASS + "+"), "")


def not_blank(text: Column) -> Column:
    """T5: text has a non-whitespace character."""
    return text.rlike(NON_WS_CLASS)


def truncate(words: Column, n: int) -> Column:
    """First n tokens."""
    return F.slice(words, 1, n)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, "^" + WS_CLASS + "+|" + WS_CLASS + "+$", "")


def lower_strip(text: Column) -> Column:
    """Lowercase and strip surrounding whitespace."""
    return F.lower(strip(text))


def ids_until_eos(ids: Column, eos: int = 2) -> Column:
    """T9 helper: ids before the first EOS (all ids when there is none)."""
    pos = F.array_position(ids, F.lit(eos))
    return F.when(pos == 0, ids).otherwise(F.slice(ids, F.lit(1), (pos - 1).cast("int")))


def normalise_hypothesis(text: Column) -> Column:
    """Remove the METEOR field separator '|||', then one pass of '  ' -> ' '."""
    return F.replace(F.replace(text, F.lit("|||"), F.lit("")), F.lit("  "), F.lit(" "))


# DuckDB twins used by the oracle SQL ---------------------------------------

DUCK_WS = WS_CLASS


def duck_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{DUCK_WS}+|{DUCK_WS}+$', '', 'g')"


def duck_clean_letters(x: str) -> str:
    t = f"regexp_replace({x}, '[’'']', '', 'g')"
    t = f"regexp_replace(lower({t}), '[^a-z ]', ' ', 'g')"
    t = f"regexp_replace({t}, ' +', ' ', 'g')"
    return f"regexp_replace({t}, '^ ', '')"


def duck_clean_decoded(x: str) -> str:
    t = f"regexp_replace({x}, '\\[unused[0-9]+\\]', '', 'g')"
    t = f"regexp_replace({t}, '[^a-zA-Z0-9{WS}.,!?'']', '', 'g')"
    return f"replace(trim(regexp_replace({t}, '{WS_CLASS}+', ' ', 'g')), ' ##', '')"


def duck_split_ws(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{DUCK_WS}+'), lambda w: w <> '')"


def duck_split_nonempty(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def duck_not_blank(x: str) -> str:
    return f"regexp_matches({x}, '{NON_WS_CLASS}')"
