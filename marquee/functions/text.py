"""String normalisers and tokenisers, and trigram similarity, as Column functions.

Only the Unicode part of normalising (case folding, decomposition) needs Python, in an Arrow-batched UDF; the rest is built-in expressions.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words left out of franchise names, and of award names in queries; number words.
FRANCHISE_STOPLIST = ("the", "of", "and", "a", "in", "to", "on", "my", "i", "for", "at", "by", "with")
AWARD_QUERY_STOPLIST = ("award", "awards", "prize", "prizes", "film", "films", "best", "a", "an", "and", "for", "of", "the")
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
ORDINAL_ONES = "zeroth first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth".split()
MOST_ORDINAL, MOST_CARDINAL = 30, 99
# Characters dropped without a space, besides the full stop.
APOSTROPHES = "'ʼ`"


def fold_text(text: str) -> str:
    """Composed, case-folded and without combining marks; full stops and apostrophes go, other punctuation but hyphens becomes a space."""
    folded = unicodedata.normalize("NFD", unicodedata.normalize("NFC", text).casefold())
    bare = "".join(c for c in folded if unicodedata.category(c) != "Mn")
    bare = re.sub(f"[{APOSTROPHES}.]", "", bare)
    return " ".join(re.sub(r"[^\w\s-]", " ", bare).split())


@F.pandas_udf(StringType())
def _folded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else fold_text(t))


def normalize(text: Column) -> Column:
    """The lookup form of a text; null stays null. ASCII texts stay inside the JVM's own expressions only if the caller knows them to be (see normalize_ascii)."""
    return _folded(text)


def normalize_ascii(text: Column) -> Column:
    """The same for texts known to be ASCII, without Python."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(text), f"[{APOSTROPHES}.]", ""), r"[^\w\s-]", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def cardinal_word(n: int) -> str | None:
    """English word of 0 to 99, compounds with a hyphen."""
    if not 0 <= n <= MOST_CARDINAL:
        return None
    if n < 20:
        return ONES[n]
    return TENS[n // 10 - 2] + (f"-{ONES[n % 10]}" if n % 10 else "")


def ordinal_word(n: int) -> str | None:
    """English ordinal of 1 to 30."""
    if not 1 <= n <= MOST_ORDINAL:
        return None
    if n < 20:
        return ORDINAL_ONES[n]
    return (TENS[n // 10 - 2][:-1] + "ieth") if n % 10 == 0 else f"{TENS[n // 10 - 2]}-{ORDINAL_ONES[n % 10]}"


def _number_map() -> Column:
    words = {f"c{n}": cardinal_word(n) for n in range(MOST_CARDINAL + 1)} | {f"o{n}": ordinal_word(n) for n in range(1, MOST_ORDINAL + 1)}
    return F.create_map(*[F.lit(x) for pair in words.items() for x in pair])


def number_words(text: Column) -> Column:
    """Ordinals to 30 and whole numbers to 99 of a normalised text as words; other numbers stay. A number in a hyphenated word counts alone."""
    words = _number_map()

    def one(part: Column) -> Column:
        digits = F.regexp_extract(part, r"^0*([0-9]{1,2})(st|nd|rd|th)?$", 1)
        kind = F.when(F.regexp_extract(part, r"^0*([0-9]{1,2})(st|nd|rd|th)?$", 2) != "", "o").otherwise("c")
        return F.when(digits == "", part).otherwise(F.coalesce(words[F.concat(kind, digits.cast("int").cast("string"))], part))

    pieces = lambda word: F.array_join(F.transform(F.split(word, "-"), one), "-")
    return F.array_join(F.transform(F.split(text, " "), pieces), " ")


def hyphen_variants(text: Column) -> Column:
    """A normalised text as it is, with spaces for its hyphens, and without them; distinct, in this order; none for an empty text."""
    spaced = F.trim(F.regexp_replace(F.regexp_replace(text, "-", " "), r"\s+", " "))
    return F.filter(F.array_distinct(F.array(text, spaced, F.regexp_replace(text, "-", ""))), lambda x: x != "")


def tokens(text: Column) -> Column:
    """Distinct words of a normalised text in order; a hyphenated word is followed by its parts."""
    parts = F.transform(F.split(text, " "), lambda w: F.when(F.contains(w, F.lit("-")), F.concat(F.array(w), F.split(w, "-"))).otherwise(F.array(w)))
    return F.filter(F.array_distinct(F.flatten(parts)), lambda x: x != "")


def name_tokens(text: Column, stoplist: tuple[str, ...] = ()) -> Column:
    """tokens without those of hyphens alone and those of a stoplist."""
    return F.filter(tokens(text), lambda x: (F.regexp_replace(x, "-", "") != "") & (~x.isin(*stoplist) if stoplist else F.lit(True)))


def straight_quotes(text: Column) -> Column:
    return F.translate(text, "‘’", "''")


def escape_like(text: Column) -> Column:
    """A text that LIKE takes literally."""
    return F.regexp_replace(text, r"([\\%_])", r"\\$1")


def trigrams(word: Column) -> Column:
    """Distinct three-character pieces of a word with two blanks before and one after."""
    padded = F.concat(F.lit("  "), word, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(word) + 1), lambda i: F.substr(padded, i, F.lit(3))))


def word_similarity(query: Column, text: Column) -> Column:
    """Share of the query's trigrams that the words of a text have; 0 for a query without words."""
    of = lambda t: F.array_distinct(F.flatten(F.transform(F.filter(F.split(t, " "), lambda w: w != ""), trigrams)))
    wanted = of(query)
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, of(text))) / F.size(wanted)).otherwise(0.0)
