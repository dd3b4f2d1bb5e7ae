"""Column functions on text: tokens, stems, cleaning, references. They stay in the JVM; Stemmer is for tasks that read text in Arrow batches."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffix, least length of the word, characters dropped, text added. The first that fits applies.
STEM_RULES = [("ies", 6, 3, "y"), ("ion", 7, 3, ""), ("ing", 7, 3, ""), ("ed", 6, 2, ""), ("es", 6, 2, ""), ("s", 5, 1, "")]
STEM_PASSES = 3
#: A short list of our own; callers may pass theirs.
STOP_WORDS = "a an and are as at be by for from had has have he her his i in is it its of on or our she that the their them they this those these to was we were will with you your".split()


#: Stands for an added "y" until the pass is over, so that no later rule of the pass sees it.
HELD = "\x01"


def _pass_patterns() -> tuple[str, str]:
    """Patterns of one pass over words between single spaces: the rule that adds text, and those that only drop."""
    word = lambda suffix, least: f"([^ ]{{{least - len(suffix)},}})"
    (first, n, _, _), *others, (last, m, _, _) = STEM_RULES
    drops = "|".join(f"{word(s, k)}{s}" for s, k, _, _ in others)
    return f"(?<![^ ]){word(first, n)}{first}(?![^ ])", f"(?<![^ ])(?:{drops}|([^ ]{{{m - 2},}}[^s ]){last})(?![^ ])"


def stem(words: Column) -> Column:
    """The rules, up to three passes, on each of the words that single spaces part.

    Each pass is two replacements over the whole string, in compiled code: no call for a word, no array.
    """
    adds, drops = _pass_patterns()
    kept = "".join(f"${k}" for k in range(1, len(STEM_RULES)))
    for _ in range(STEM_PASSES):
        words = F.translate(F.regexp_replace(F.regexp_replace(words, adds, f"$1{HELD}"), drops, kept), HELD, STEM_RULES[0][3])
    return words


def tokens(text: Column) -> Column:
    """Runs of ASCII letters, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def stems(text: Column, stop: list[str] = STOP_WORDS) -> Column:
    """Stemmed tokens in order, without one-letter ones and without stems of stop words."""
    words = F.split(stem(F.trim(F.regexp_replace(F.lower(text), "[^a-z]+", " "))), " ")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*sorted({stem_text(s) for s in stop})))


def stem_text(word: str) -> str:
    """The same rules on a Python string, for word lists."""
    for _ in range(STEM_PASSES):
        if len(word) <= 3:
            return word
        for suffix, least, drop, add in STEM_RULES:
            if word.endswith(suffix) and len(word) >= least and not (suffix == "s" and word.endswith("ss")):
                word = word[: len(word) - drop] + add
                break
        else:
            return word
    return word


class Stemmer(dict):
    """stems() of a Python string, each distinct word worked out once: the stem, or nothing for a word that stems() drops."""

    WORD, MOST = re.compile("[a-z]+"), 500_000

    def __init__(self, stop: list[str] = STOP_WORDS):
        super().__init__()
        self.stop = {stem_text(s) for s in stop}

    def __missing__(self, word: str) -> str:
        if len(self) >= self.MOST:
            self.clear()
        found = stem_text(word)
        self[word] = found = "" if len(found) < 2 or found in self.stop else found
        return found

    def line(self, text: str | None) -> str:
        """The stems of a text with single spaces between them."""
        return " ".join(filter(None, map(self.__getitem__, self.WORD.findall(text.lower())))) if text else ""


def terms_of(line: str) -> list[str]:
    """Unigrams and bigrams of Stemmer.line, as analyse() has them."""
    one = line.split(" ") if line else []
    return one + list(map(" ".join, zip(one, one[1:], strict=False)))


def analyse(text: Column, stop: list[str] = STOP_WORDS) -> Column:
    """Unigrams, then bigrams over what is left after stop words are gone."""
    pairs = lambda one: F.when(F.size(one) > 1, F.zip_with(F.slice(one, F.lit(1), F.size(one) - 1), F.slice(one, F.lit(2), F.size(one) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    return F.get(F.transform(F.array(stems(text, stop)), lambda one: F.concat(one, pairs(one))), F.lit(0))  # the stems are worked out once


def clean_text(text: Column, drop_lines: list[str], most_blank: int = 1) -> Column:
    """Drops matching lines (case-insensitive), collapses blanks, caps blank lines, trims."""
    for pattern in drop_lines:
        text = F.regexp_replace(text, f"(?im)^{pattern}$", "")
    text = F.regexp_replace(text, "[ \\t]+", " ")
    text = F.regexp_replace(text, "\n{%d,}" % (most_blank + 2), "\n" * (most_blank + 1))
    return F.regexp_replace(F.regexp_replace(text, "^[ \n]+", ""), "[ \n]+$", "")


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def ref_nums(ref: Column) -> Column:
    """The integers of a reference, in order."""
    return F.transform(F.regexp_extract_all(ref, F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("int"))


def range_refs(text: Column, most_span: int = 5, most_refs: int = 4) -> Column:
    """'Sections a-b' expanded where the span is short, then single 'Section n', as a list; 'general' for none or too many."""
    wide = F.regexp_extract_all(text, F.lit("(?i)sections ([0-9]+) ?[-–] ?([0-9]+)"), F.lit(0))
    bounds = F.transform(wide, ref_nums)
    spread = F.flatten(F.transform(F.filter(bounds, lambda b: (b[1] >= b[0]) & (b[1] - b[0] <= most_span)), lambda b: F.sequence(b[0], b[1])))
    single = F.transform(F.regexp_extract_all(text, F.lit("(?i)section ([0-9]+)"), F.lit(1)), lambda x: x.cast("int"))
    found = F.array_distinct(F.concat(spread, single))
    return F.when(F.size(found).between(1, most_refs), F.array_join(F.transform(found, lambda x: x.cast("string")), ",")).otherwise(F.lit("general"))


def shingles(text: Column, k: int = 10, step: int = 2) -> Column:
    """Distinct runs of k characters, one every `step`; a shorter text is one run."""
    n = F.length(text)
    return F.when(n <= k, F.array(text)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), n - k + 1, F.lit(step)), lambda i: F.substr(text, i, F.lit(k)))))
