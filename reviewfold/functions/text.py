"""Text expressions. All of them stay inside the JVM; none is a Python UDF."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters deleted from a review before anything else.
PUNCTUATION = ".,?!"
# Characters the sequence tokenizer turns into spaces.
SEQUENCE_FILTERS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n"
# Two or more word characters make a term.
WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"


def clean_text(col: Column) -> Column:
    return F.translate(col, PUNCTUATION, "")


def normalize_name(col: Column) -> Column:
    """Lower case, commas removed, slashes opened to a space."""
    return F.translate(F.lower(col), "/,", " ")


def padded(col: Column) -> Column:
    """Text with a blank on both sides, so a word test is one substring test."""
    return F.concat(F.lit(" "), col, F.lit(" "))


def contains_word(col: Column, word: str) -> Column:
    """Whole-word or whole-phrase containment."""
    return padded(col).contains(f" {word} ")


def paste(cols: Iterable[Column], sep: str = "/") -> Column:
    """Join with ``sep``; a NULL part shows as the text ``NA``."""
    parts: list[Column] = []
    for col in cols:
        parts += [F.lit(sep)] if parts else []
        parts.append(F.coalesce(col.cast("string"), F.lit("NA")))
    return F.concat(*parts)


def split_part(col: Column, index: int, sep: str = "/") -> Column:
    """Part ``index`` (from 0) of a pasted key; NULL when there is no such part."""
    return F.get(F.split(col, f"\\Q{sep}\\E"), F.lit(index))


def tokens(col: Column) -> Column:
    """Tokens separated by white space of any length."""
    return F.array_remove(F.split(col, r"\s+"), "")


def pick(col: Column, position: int) -> Column:
    """Token at ``position``: 1 is the first one, -1 the last one; NULL when there is none."""
    return F.try_element_at(tokens(col), F.lit(position))


def strip_prefix(col: Column, prefix: str) -> Column:
    """Text after ``prefix``; unchanged where the prefix is absent."""
    return F.when(col.startswith(prefix), F.substring(col, len(prefix) + 1, 1 << 30)).otherwise(col)


def to_class(col: Column) -> Column:
    """Probability to class, rounding half to even: 0.5 is class 0."""
    return F.rint(col)


def sequence_tokens(col: Column, filters: str = SEQUENCE_FILTERS) -> Column:
    """Lower-case tokens with ``filters`` turned into blanks, empties dropped."""
    blanked = F.translate(F.lower(col), filters, " " * len(filters))
    return F.array_remove(F.split(blanked, " "), "")


def word_tokens(col: Column) -> Column:
    """Lower-case terms of at least two word characters."""
    return F.regexp_extract_all(F.lower(col), F.lit(WORD_PATTERN), F.lit(0))


def drop_words(words: Column, stop_words: Iterable[str]) -> Column:
    """Remove stop words and keep the rest in order, repeats included."""
    stop = list(stop_words)
    return F.filter(words, lambda w: ~w.isin(stop)) if stop else words


def bound(col: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once. A lambda that names an expression
    would evaluate it again for every element it visits."""
    return F.get(F.transform(F.array(col), body), F.lit(0))


def word_ngrams(words: Column, low: int = 1, high: int = 3) -> Column:
    """All n-grams of ``low`` to ``high`` words in one bag."""

    def grams(list_: Column, n: int) -> Column:
        def joined(word: Column, i: Column) -> Column:
            return F.concat_ws(" ", word, *[F.get(list_, i + k) for k in range(1, n)])

        starts = F.slice(list_, F.lit(1), F.greatest(F.size(list_) - (n - 1), F.lit(0)))
        return F.transform(starts, joined)

    def bags(list_: Column) -> Column:
        return F.concat(*[list_ if n == 1 else grams(list_, n) for n in range(low, high + 1)])

    return bound(words, bags)


def pad_sequence(ids: Column, length: Column | int, side: str = "pre") -> Column:
    """Bring ``ids`` to ``length`` with zeros; ``side`` is padded and truncated."""
    if side not in ("pre", "post"):
        raise ValueError("side must be 'pre' or 'post'")
    goal = F.lit(length) if isinstance(length, int) else length
    zeros = F.array_repeat(F.lit(0).cast("bigint"), F.greatest(goal - F.size(ids), F.lit(0)))
    wide = ids.cast("array<bigint>")
    if side == "pre":
        start = F.greatest(F.size(ids) - goal, F.lit(0)) + 1
        return F.concat(zeros, F.slice(wide, start, goal))
    return F.concat(F.slice(wide, F.lit(1), goal), zeros)


def hex_uniform(digest: Column, group: int = 0) -> Column:
    """Uniform number in [0, 1) from one of the four groups of eight hex digits
    of an MD5 digest."""
    return F.conv(F.substring(digest, 1 + 8 * group, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
