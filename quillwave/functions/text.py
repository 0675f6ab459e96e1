"""Text normalisation as column functions: everything stays in one projection, inside the row.

Each rule is linear in the text's length. Word lists go in one pass: the patterns name all words of a list at once, and what
stands for a word is looked up, in Arrow batches (`folds`). White space before a phrase is matched from its first character only; where a rule looks back
to a boundary, the text is cut there first instead of being searched from every place. Patterns begin with what few places
have, a listed letter, a digit or a sign, and look back or at word boundaries only there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import folds
from . import rules as R

MARK = "\u0001"
HYPHEN = "\ue000"
_ANY = "(?iU)"


def _fold(text: Column, pairs) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, p[0], p[1]), pairs, text)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s(?<!\s\s)\s*+\z", "")


def _let(value: Column, use) -> Column:
    """`use`(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _after_last(text: Column, ends: str) -> Column:
    """What follows the last of the characters `ends`."""
    return F.substring_index(F.translate(text, ends, ends[0] * len(ends)), ends[0], -1)


def count_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def expand_abbreviations(text: Column) -> Column:
    return folds.with_words(text, R.ABBREVIATIONS)


def below_thousand(n: int) -> str:
    """Words of 0 to 999, nothing for 0."""
    tens, ones = divmod(n % 100, 10)
    small = R.UNITS[n % 100] if n % 100 < 20 else "-".join(x for x in (R.TENS[tens], R.UNITS[ones]) if x)
    return " and ".join(x for x in ((R.UNITS[n // 100] + " hundred") * (n >= 100), small) if x)


def number_words(digits: Column) -> Column:
    """A string of digits to words up to 999,999; longer numbers lose leading zeros only."""
    table = F.split(F.lit("|".join(below_thousand(i) for i in range(1000))), r"\|")  # one constant for the optimizer, not a thousand
    n = digits.cast("int")
    low = F.get(table, n % 1000)
    high = F.concat(F.get(table, F.floor(n / 1000).cast("int")), F.lit(" thousand"))
    said = F.when(n == 0, "zero").when(n < 1000, low).when(n % 1000 == 0, high).otherwise(F.concat(high, F.lit(" "), low))
    plain = F.regexp_replace(digits, r"^0+(?=\d)", "")
    return F.when(F.length(plain) <= 6, said).otherwise(plain)


def _each_match(text: Column, pattern: str, change) -> Column:
    """`change` applied to every match of `pattern`: marked, split, changed at the odd places, joined."""
    parts = F.split(F.regexp_replace(text, f"({pattern})", f"{MARK}$1{MARK}"), MARK)
    return F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, change(p)).otherwise(p)), "")


def expand_number_ranges(text: Column) -> Column:
    """`4-7-8` to `four, seven, eight`. Hyphens between digits are marked first, so that the pattern of a range repeats single
    characters only: a repeated group costs the matcher a frame of its stack each time.
    """
    marked = F.regexp_replace(text, r"(?U)-(?<=\d-)(?=\d)", HYPHEN)
    said = _each_match(marked, rf"(?U:(?=\d)\b\d[\d{HYPHEN}]*{HYPHEN}\d+\b)", lambda m: F.array_join(F.transform(F.split(m, HYPHEN), number_words), ", "))
    return F.translate(said, HYPHEN, "-")


def expand_integers(text: Column) -> Column:
    """Whole numbers of 1 to 6 digits to words."""
    return _each_match(text, r"(?U:(?=\d)\b\d{1,6}\b)", number_words)


def expand_text(text: Column) -> Column:
    return expand_integers(expand_number_ranges(expand_abbreviations(text)))


def normalize_punctuation(text: Column) -> Column:
    """Colons and dashes to commas, runs of full stops to one, hyphens inside words removed."""
    return _fold(text, [(":", ","), (r"\.{2,}", "."), ("—|–|--+", ","), ("(?<=[a-zA-Z])-(?=[a-zA-Z])", "")])


def respell(text: Column) -> Column:
    return folds.with_words(text, R.RESPELLINGS)


def mark_sounds(text: Column) -> Column:
    return folds.with_words(text, [(word, f"[{word}](/{sound}/)") for word, sound in R.SOUNDS])


def contract_phrases(text: Column) -> Column:
    """Phrases overlap only where the one that begins first is also the first of the list, so that one pass does."""
    return folds.with_words(text, R.CONTRACTIONS)


def tag_stress_words(text: Column) -> Column:
    """Wraps the listed words with (-1) or (+1) where no bracket stands before them."""
    return folds.with_tags(text, [(R.LESS_STRESS, "-1"), (R.MORE_STRESS, "+1")])


_START = r"(?:^|(?<=\. )|(?<=! )|(?<=\? ))"


def _before(phrase: str) -> tuple[str, str]:
    """A comma before the phrase, if there is none yet; behind a comma with two spaces or more there is."""
    return rf"{_ANY}\s(?<=(?:(?<![,\s])|(?<=,\s))\s)\s*+({phrase})", ", $1"


def punctuate(text: Column) -> Column:
    """The first six prosody rules: final full stop, commas after openers and before continuing phrases."""
    any_of = "|".join
    return _fold(
        text,
        [
            (r"([A-Za-z])(?!\S)\s*+\z", "$1."),
            (rf"Now(?<={_START}Now) ([a-z])", "Now, $1"),
            (rf"(?=[{''.join(sorted({w[0] for w in R.OPENERS}))}])(?U)({_START}(?:{any_of(R.OPENERS)}) (?:{any_of(R.OPENER_WORDS)}) \w+)(?=[^,.!?])", "$1,"),
            _before(f"as (?:you|we) (?:{any_of(R.VERBS)})"),
            _before(rf"(?:{any_of(R.GERUNDS)}) \w"),
            _before(f"with each (?:{any_of(R.BREATH_NOUNS)})"),
        ],
    )


def tidy_punctuation(text: Column) -> Column:
    """Doubled commas, commas before an end, doubled spaces."""
    return strip(_fold(text, [(r"(?U),\s*,", ","), (r"(?U),(\s*[.!?])", "$1"), (" {2,}", " ")]))


def break_long_clauses(text: Column) -> Column:
    """A comma before and, but, while if the clause before has 8 words or more.

    The text is cut before each such conjunction. A piece tells alone whether its end gets a comma; all that is carried is
    how much of it a match before it took, because then the clause begins after that conjunction's next letter.
    """
    return folds.with_clause_commas(text, R.CLAUSE_CONJUNCTIONS, R.CLAUSE_WORDS)


def break_breath_groups(text: Column) -> Column:
    """After 12 words without punctuation a comma before the next conjunction; words and the white space between them are looked at in turn."""
    return folds.with_breaths(text, R.BREATH_CONJUNCTIONS, R.BREATH_WORDS)


def prosody_rules(text: Column) -> Column:
    return tidy_punctuation(break_breath_groups(break_long_clauses(punctuate(text))))


def sensory_ellipsis(text: Column) -> Column:
    """`the warmth` to `the... warmth`, unless punctuation stands right before the determiner."""
    return folds.with_ellipsis(text, R.DETERMINERS, sorted(R.SENSORY))


def vary_sentence_length(text: Column) -> Column:
    """The first comma before a listed conjunction becomes a full stop if ten words or more precede it in the sentence."""
    conj = "|".join(R.VARIED_CONJUNCTIONS)
    parts = F.split(text, rf"(?U)(?=, (?:{conj}) \w)(?<=[^\n])", 2)  # before the first such comma, and from it on
    head, rest = lambda p: F.get(p, F.lit(0)), lambda p: F.get(p, F.lit(1))
    long_enough = lambda p: count_words(_after_last(head(p), "!?.\n")) >= R.VARIED_WORDS
    changed = lambda p: F.concat(head(p), F.lit(". "), F.initcap(F.regexp_extract(rest(p), rf"^, ({conj})", 1)), F.regexp_replace(rest(p), rf"^, (?:{conj})", ""))
    return _let(parts, lambda p: F.when(F.size(p) < 2, head(p)).when(long_enough(p), changed(p)).otherwise(F.concat(head(p), rest(p))))


def normalize_case_space(text: Column) -> Column:
    """White space to one space; words of two capitals or more to lower case."""
    spaced = strip(F.regexp_replace(text, r"(?U)\s+", " "))
    return _each_match(spaced, r"(?U:\b)[A-Z]{2,}(?U:\b)", F.lower)


def preprocess_text(text: Column, stress: bool = True) -> Column:
    """All steps of the first policy in order."""
    text = mark_sounds(contract_phrases(expand_text(text)))
    text = vary_sentence_length(sensory_ellipsis(prosody_rules(tag_stress_words(text) if stress else text)))
    text = _let(text, lambda t: F.when(F.contains(t, F.lit("[pause:")), F.regexp_replace(t, r"(?U)(\w)\s*(\[pause:)", "$1... $2")).otherwise(t))
    return strip(_fold(text, [(r"\.{2,}", "..."), (" {2,}", " ")]))
