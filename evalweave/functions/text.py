"""Text functions of answer checking, filtering and grounding analysis."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalweave.functions.semantics import words
from evalweave.functions.stemming import stem

# Phrasings that count as an abstention, tried in this order.
ABSTENTIONS = [
    r"\bi\s*(?:can(?:not|'?t)|am\s+unable\s+to|do\s*not?\s+have\s+(?:enough\s+)?(?:information|context|details|access)|don'?t\s+have\s+(?:enough\s+)?(?:information|context|details|access))",
    r"\bi\s+(?:cannot|can'?t)\s+(?:see|tell|determine|identify|know|verify|confirm|access|view|watch|hear|listen|provide|infer|read|make\s+out)\b",
    r"\bunable\s+to\s+(?:see|tell|determine|identify|know|verify|confirm|access|view|hear|listen|provide|infer|read|answer|make\s+out)\b",
    r"\b(?:it\s+is|it'?s)\s+not\s+possible\s+to\b",
    r"\bno\s+way\s+to\s+(?:tell|determine|know|verify)\b",
    r"\bthe\s+(?:video|transcript|speaker|lecture|audio|recording|clip|frames?|text|prompt|context|provided\s+information|information\s+provided)\s+(?:does(?:n'?t|\s+not)|do(?:n'?t|\s+not))\s+(?:mention|show|describe|state|say|provide|specify|contain|include|display|indicate|reveal|cover|address|discuss|explain)",
    r"\b(?:does(?:n'?t|\s+not))\s+(?:mention|show|describe|state|say|provide|specify|contain|include|display|indicate|reveal)\b[^.]{0,40}(?:question|answer|information|detail|context|specifics?)",
    r"\bwithout\s+(?:the\s+)?(?:video|transcript|audio|frames?|visual|seeing|watching|listening|access)\b[^.]{0,80}(?:cannot|can'?t|unable|impossible|hard\s+to|difficult\s+to)",
    r"\bnot\s+enough\s+(?:information|context|detail|evidence|content|data)\b",
    r"\binsufficient\s+(?:information|context|detail|evidence|content|data)\b",
    r"\b(?:no|zero)\s+(?:information|context|detail|mention|reference)\b",
    r"\bcannot\s+be\s+(?:determined|established|inferred|known|verified|identified|told|answered)\b",
    r"\b(?:there\s+is|there'?s)\s+no\s+(?:way|indication|mention|reference|information)\b",
    r"\bis\s+not\s+(?:visible|stated|mentioned|provided|shown|specified|described|clear|available|present|given|discussed|explained)\b",
    r"\bare\s+not\s+(?:visible|stated|mentioned|provided|shown|specified|described|clear|available|present|given|discussed|explained)\b",
    r"\b(?:i\s+(?:am\s+sorry|apologi[sz]e|apologi[sz]ed?\s+but)|sorry,)\b[^.]{0,80}(?:cannot|can'?t|unable|don'?t\s+have)",
    r"\b(?:based\s+on|from)\s+(?:the\s+)?(?:transcript|text|audio|video)\s+(?:alone|only|provided|given)\b[^.]{0,80}(?:cannot|can'?t|unable|don'?t\s+have|impossible|hard\s+to)",
]
# Number words and their digits.
NUMBER_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "ten": "10", "eleven": "11", "twelve": "12", "thirteen": "13", "fourteen": "14", "fifteen": "15", "sixteen": "16", "seventeen": "17", "eighteen": "18", "nineteen": "19", "twenty": "20",
    "first": "1", "second": "2", "third": "3", "fourth": "4", "fifth": "5", "sixth": "6", "seventh": "7", "eighth": "8", "ninth": "9", "tenth": "10",
}
# Words that carry no content.
STOP_WORDS = [
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "can", "may", "might", "of",
    "in", "on", "at", "to", "for", "with", "by", "from", "about", "into", "as", "and", "or", "but", "if", "this", "that", "these", "those", "it", "its", "i", "you", "he",
    "she", "we", "they", "them", "his", "her", "their", "my", "our", "your", "said", "says", "say", "also", "just", "then", "than", "so", "too", "very", "out", "up", "down", "off",
    "over", "under", "video", "protagonist", "picture", "screen", "image", "shows", "shown", "appears", "appear", "appeared", "scene", "wearing", "wore", "one", "two",
]
# Colour names.
COLOURS = ["red", "blue", "green", "yellow", "orange", "purple", "pink", "black", "white", "brown", "gray", "grey", "cyan", "magenta", "golden", "silver", "beige", "maroon", "navy", "teal", "violet", "indigo"]
# Units that may follow a number.
UNITS = ["yen", "dollar", "dollars", r"\$", "€", "£", "%", "kg", "cm", "mm", "m", "km", "lbs?", "oz", "ml", "liters?", "minutes?", "seconds?", "hours?", "mph", "km/h", "points?", "goals?"]
# Patterns of numbers, clock times, names and quoted terms.
_NUMBER = r"\b\d[\d,\.]*\b"
_CLOCK = r"\b\d{1,2}:\d{2}(?::\d{2})?\b"
_NAME = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"
_QUOTED = "[\"“”](.*?)[\"“”]"
# Where an answer's letter stands, in the order in which these are tried.
LEADING, BRACKETED, NAMED, ANY = "^([A-E])", r"\(([A-E])\)", r"(?i)(?:answer|option)\s*(?:is\s*)?[:\s]*\(?([A-E])\)?", "([A-E])"
FINAL, BRACKETED_ANY, ALONE, WORD = r"[Ff]inal\s+[Aa]nswer\s*[:：]\s*\(?([A-Ea-e])\)?", r"\(([A-Ea-e])\)", r"(?m)^\s*([A-Ea-e])\s*$", r"(?U)\b([A-E])\b"
MARKED = r"(?i)ANSWER\s*[:\-]?\s*\(?([A-E])\)?"


def straightened(text: Column) -> Column:
    """Straight quotes, single blanks, no blanks at the ends."""
    return F.trim(F.regexp_replace(F.translate(text, "’‘“”", "''\"\""), r"\s+", " "))


def abstains(text: Column) -> Column:
    """Does the answer decline? An empty one does."""
    return F.coalesce(text == "", F.lit(True)) | F.coalesce(straightened(text).rlike("(?i)" + "|".join(ABSTENTIONS)), F.lit(False))


def abstention(text: Column) -> Column:
    """What makes it an abstention: the first match, "empty", or null."""
    hit = F.nullif(F.regexp_extract(straightened(text), "(?i)" + "|".join(ABSTENTIONS), 0), F.lit(""))
    return F.when(F.coalesce(text, F.lit("")) == "", "empty").otherwise(hit)


def alnum_tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-Za-z0-9]+)"), 1), F.lower)


def lcs_length(a: Column, b: Column, most: int = 2_000_000, head: int = 1000) -> Column:
    """Length of the longest common subsequence of two arrays; over ``most`` cells both are cut to ``head`` items."""
    return _lcs(*_shortened(a, b, most, head))


def _shortened(a: Column, b: Column, most: int, head: int) -> list[Column]:
    long = F.size(a).cast("long") * F.size(b) > most
    return [F.when(long, F.slice(x, 1, head)).otherwise(x) for x in (a, b)]


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence: bit j of ``free`` is unset where column j of the last row steps up."""
    at: dict[str, int] = {}
    for j, item in enumerate(b):
        at[item] = at.get(item, 0) | 1 << j
    full = (1 << len(b)) - 1
    free = full
    for item in a:
        hit = free & at.get(item, 0)
        free = (free + hit | free - hit) & full
    return len(b) - free.bit_count()


def shared_runs(a: list[str], b: list[str], n: int) -> int:
    """Size of the multiset intersection of two lists' runs of ``n`` items."""
    x, y = (Counter(zip(*(items[i:] for i in range(n)), strict=False)) for items in (a, b))
    return (x & y).total()


def _of_lists(f: Callable[[list[str], list[str]], int]) -> Callable[[Column, Column], Column]:
    """A function of two arrays of strings, batch by batch; null if either is null."""

    @F.arrow_udf(T.IntegerType())
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else f(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.int32())

    return run


_lcs = _of_lists(common_subsequence)


def _clipped(a: Column, b: Column, n: int) -> Column:
    return _of_lists(lambda x, y: shared_runs(x, y, n))(a, b)


@F.arrow_udf(T.ArrayType(T.StringType()))
def stemmed(tokens: pa.Array) -> pa.Array:
    """Tokens of over three letters as their stems."""
    return pa.array([None if t is None else [stem(w) if len(w) > 3 else w for w in t] for t in tokens.to_pylist()], pa.list_(pa.string()))


def _f1(shared: Column, a: Column, b: Column) -> Column:
    """F1 of what is shared, by both sizes; 0 if either is empty."""
    return F.coalesce(F.try_divide(2 * shared.cast("double"), a + b), F.lit(0.0))


def _tokens(text: Column, stems: bool) -> Column:
    return stemmed(alnum_tokens(text)) if stems else alnum_tokens(text)


def rouge_l(hypothesis: Column, reference: Column, stems: bool = False, most: int = 2_000_000) -> Column:
    """F1 of the longest common subsequence of tokens; 0 if either is empty. Over ``most`` cells both are cut."""
    h, r = _tokens(hypothesis, stems), _tokens(reference, stems)
    x, y = _shortened(h, r, most, 1000)
    return _f1(_lcs(x, y), F.size(h), F.size(r))


def salient_tokens(text: Column) -> Column:
    """Numbers, and lower-cased capitalised words of three characters or more, each once."""
    t = F.coalesce(text, F.lit(""))
    numbers = F.regexp_extract_all(t, F.lit(r"(?U)(\b\d+(?:\.\d+)?(?:e-?\d+)?\b)"), 1)
    names = F.transform(F.regexp_extract_all(t, F.lit(r"(?U)(\b[A-Z][A-Za-z0-9]{2,}\b)"), 1), F.lower)
    return F.array_union(numbers, names)


def keys_covered(chosen: Column, rejected: Column, cover: float = 0.85, least: int = 3) -> Column:
    """Does the rejected text have ``cover`` of the chosen one's salient tokens? Never with fewer than ``least``."""
    keys = salient_tokens(chosen)
    shared = F.size(F.array_intersect(keys, salient_tokens(rejected)))
    return (F.size(keys) >= least) & (F.coalesce(F.try_divide(shared, F.size(keys)), F.lit(0.0)) >= cover)


def digits_for_words(text: Column) -> Column:
    """Lower-cased words without punctuation, number words as digits."""
    table = F.create_map(*(F.lit(x) for pair in NUMBER_WORDS.items() for x in pair))
    plain = words(F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", " "))
    return F.transform(plain, lambda w: F.coalesce(F.try_element_at(table, w), w))


def content_words(text: Column) -> Column:
    """The distinct words of :func:`digits_for_words` that carry content."""
    return F.array_except(digits_for_words(text), F.array(*map(F.lit, STOP_WORDS)))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity, with its rule on popular characters."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype=float)


def choice_score(prediction: Column, choice: Column, weights: tuple[float, float, float] = (3.0, 2.0, 0.5)) -> Column:
    """Weighted sum of: the choice stands in the prediction, recall of its content words, sequence ratio."""
    p, c = digits_for_words(prediction), digits_for_words(choice)
    content = content_words(choice)
    recall = F.when(F.size(content) > 0, F.size(F.array_intersect(content, content_words(prediction))) / F.greatest(F.size(content), F.lit(1)))
    recall = F.coalesce(recall, F.size(F.array_intersect(c, p)) / F.greatest(F.lit(1), F.size(F.array_distinct(c))))
    ps, cs = F.array_join(p, " "), F.array_join(c, " ")
    total = weights[0] * F.contains(ps, cs).cast("double") + weights[1] * recall + weights[2] * sequence_ratio(ps, cs)
    return F.when(cs == "", 0.0).otherwise(total)


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def answer_letter(raw: Column, read: Callable[[str], str] = str) -> Column:
    """A to E: a leading one, one in parentheses, "answer is X", or the first there is.

    ``read``: how patterns are to be read, as for :func:`final_letter`.
    """
    t = F.trim(raw)
    return F.coalesce(_found(t, read(LEADING)), _found(t, read(BRACKETED)), F.upper(_found(t, read(NAMED))), _found(t, read(ANY)), F.lit(""))


def final_letter(raw: Column, read: Callable[[str], str] = str) -> Column:
    """A to E: after "Final Answer:", one in parentheses, one alone on its line, or the first that stands alone.

    ``read``: how patterns are to be read. As they are, letters beyond ASCII are parts of words, as in Python; by ``semantics.re2`` they are not, as in SQL.
    """
    return F.coalesce(F.upper(_found(raw, read(FINAL))), F.upper(_found(raw, read(BRACKETED_ANY))), F.upper(_found(raw, read(ALONE))), _found(raw, read(WORD)), F.lit(""))


def committed_letter(raw: Column, choices: Column) -> Column:
    """A to E: the last "ANSWER: X", else as :func:`answer_letter`, the longest choice named in full before the last resort."""
    t = F.trim(raw)
    marked = F.try_element_at(F.regexp_extract_all(t, F.lit(MARKED), 1), F.lit(-1))

    def hit(c: Column, i: Column) -> Column:
        word = F.lower(F.trim(c))
        # a choice counts where no letter or digit touches it
        near = F.concat(F.lit("(?s).*(?<![A-Za-z0-9])\\Q"), word, F.lit("\\E(?![A-Za-z0-9]).*"))
        return F.struct(F.when((word != "") & F.rlike(F.lower(t), near), -F.length(word)).alias("n"), i.alias("i"))

    named = F.get(F.array_sort(F.filter(F.transform(choices, hit), lambda h: h["n"].isNotNull())), F.lit(0))["i"]
    letters = F.substring(F.lit("ABCDE"), named + 1, F.lit(1))
    return F.coalesce(F.upper(marked), _found(t, LEADING), _found(t, BRACKETED), F.upper(_found(t, NAMED)), letters, _found(t, ANY), F.lit(""))


def options(text: Column, least: int = 4) -> tuple[Column, Column]:
    """The question before "(A)", and the options after each of "(A)" to "(E)", padded to ``least``."""
    parts = F.transform(F.split(text, r"\([A-E]\)"), lambda p: F.trim(p))
    found = F.slice(parts, 2, 5)
    padded = F.concat(found, F.array_repeat(F.lit(""), F.greatest(F.lit(0), F.lit(least) - F.size(found))))
    return F.get(parts, F.lit(0)), padded


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def file_name(title: Column) -> Column:
    """Lower case; blanks and dashes as one underscore; nothing but word characters."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(title)), r"[\s\-]+", "_"), r"[^\w]", "")


def sentence_cut(text: Column, n: int) -> Column:
    """The first ``n`` words, cut back to a sentence end that lies past character n / 2.

    The rule compares a place in characters with half the number of words, as the pipelines
    that this serves do.
    """
    cut = F.array_join(F.slice(words(text), 1, n), " ")
    end = F.length(F.regexp_extract(cut, r"(?s)^(.*[.!?])", 1))
    return F.when(F.size(words(text)) <= n, F.trim(text)).when(end - 1 > n / 2, F.substring(cut, F.lit(1), end)).otherwise(cut)


def first_words(text: Column, n: int | Column) -> Column:
    n = n if isinstance(n, Column) else F.lit(n)
    return F.array_join(F.slice(words(text), F.lit(1), n), " ")


def filled(template: str, **values: Column) -> Column:
    """A template with {name} fields; null values are empty."""
    parts, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(before), F.coalesce(values[name].cast("string"), F.lit(""))]
    return F.concat(*parts, F.lit(rest))


def without_block(text: Column, start: str, end: str) -> Column:
    """The text without its first stretch from ``start`` up to and with ``end``."""
    pattern = rf"(?s)^(.*?)\Q{start}\E.*?\Q{end}\E(.*)$"
    return F.when(text.rlike(pattern), F.regexp_replace(text, pattern, "$1$2")).otherwise(text)


def any_word(text: Column, listed: list[str]) -> Column:
    """Does any listed phrase stand in the text, whatever its case?"""
    return F.exists(F.array(*map(F.lit, listed)), lambda w: F.contains(F.lower(text), w))


def key_entities(text: Column) -> Column:
    """Numbers with units, numbers, times, colours, quoted terms and names, each once."""

    def every(pattern: str, group: int = 1) -> Column:
        return F.regexp_extract_all(text, F.lit(pattern), group)

    united = F.transform(every(rf"(?iU)(\b\d[\d,\.]*\s*(?:{'|'.join(UNITS)})\b)"), lambda x: F.trim(F.lower(x)))
    quoted = F.transform(every(_QUOTED), lambda x: F.lower(F.trim(x)))
    colours = F.transform(every(rf"(?iU)\b({'|'.join(COLOURS)})\b"), F.lower)
    names = F.filter(every(f"(?U)({_NAME})"), lambda x: F.length(x) > 2)
    out = united
    for more in (every(f"(?U)({_NUMBER})"), every(f"(?U)({_CLOCK})"), colours, quoted, names):
        out = F.array_union(out, more)
    return out


def plain_number(text: Column) -> Column:
    """Without commas; whole numbers without a point, others to four digits; anything else in lower case."""
    bare = F.regexp_replace(text, ",", "")
    x = bare.try_cast("double")
    short = F.regexp_replace(F.regexp_replace(F.format_string("%.4f", x), "0+$", ""), r"\.$", "")
    return F.when(x.isNull(), F.lower(bare)).when(x == F.floor(x), x.cast("long").cast("string")).otherwise(short)


def entity_matches(entity: Column, among: Column) -> Column:
    """Is it there as it is, as a number, or whatever the case?"""
    return F.exists(among, lambda p: (p == entity) | (plain_number(p) == plain_number(entity)) | (F.lower(p) == F.lower(entity)))


def entity_recall(reference: Column, prediction: Column) -> Column:
    """Share of the reference's entities that the prediction has; null if it has none."""
    ref, pred = key_entities(reference), key_entities(prediction)
    return F.try_divide(F.size(F.filter(ref, lambda e: entity_matches(e, pred))).cast("double"), F.size(ref))


def without_entities(text: Column) -> Column:
    """The text with entities, longest first, numbers and names as placeholders."""
    ordered = F.array_sort(key_entities(text), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    out = F.aggregate(ordered, text, lambda t, e: F.replace(t, e, F.lit(" _ENT_ ")))
    out = F.regexp_replace(F.regexp_replace(out, f"(?U){_NUMBER}", " _NUM_ "), f"(?U){_NAME}", " _NE_ ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def structural_similarity(reference: Column, prediction: Column) -> Column:
    return sequence_ratio(without_entities(reference), without_entities(prediction))


def numbers_match(reference: Column, prediction: Column) -> Column:
    """Are all numbers and times of the reference in the prediction? Null if it has none."""

    def found(t: Column) -> Column:
        every = F.array_union(F.regexp_extract_all(t, F.lit(f"(?U)({_NUMBER})"), 1), F.regexp_extract_all(t, F.lit(f"(?U)({_CLOCK})"), 1))
        return F.array_distinct(F.transform(every, plain_number))

    r = found(reference)
    return F.when(F.size(r) > 0, F.size(F.array_except(r, found(prediction))) == 0)


def colours_match(reference: Column, prediction: Column) -> Column:
    """Are all colours of the reference in the prediction? Null if it has none."""

    def found(t: Column) -> Column:
        return F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(rf"(?iU)\b({'|'.join(COLOURS)})\b"), 1), F.lower))

    r = found(reference)
    return F.when(F.size(r) > 0, F.size(F.array_except(r, found(prediction))) == 0)


def details_match(reference: Column, prediction: Column) -> Column:
    """All of the checks that apply hold; null if none applies."""
    n, c = numbers_match(reference, prediction), colours_match(reference, prediction)
    return F.when(n.isNull(), c).when(c.isNull(), n).otherwise(n & c)


def token_overlap(prediction: Column, reference: Column) -> tuple[Column, Column]:
    """(shared distinct tokens, distinct tokens of the reference), for a micro average."""
    r = F.array_distinct(words(F.lower(reference)))
    return F.size(F.array_intersect(r, words(F.lower(prediction)))), F.size(r)


def _runs(tokens: Column, n: int) -> Column:
    return F.greatest(F.size(tokens) - n + 1, F.lit(0))


def bleu(prediction: Column, reference: Column, n: int = 4, epsilon: float = 0.1) -> Column:
    """Sentence BLEU up to ``n``-grams of blank-separated lower-case words; a zero count becomes ``epsilon``."""
    p, r = words(F.lower(prediction)), words(F.lower(reference))
    total = F.lit(0.0)
    for k in range(1, n + 1):
        count = _clipped(p, r, k).cast("double")
        total = total + F.log(F.when(count == 0, F.lit(epsilon)).otherwise(count) / F.greatest(F.lit(1), _runs(p, k)))
    short = F.when(F.size(p) < F.size(r), F.exp(1 - F.size(r) / F.greatest(F.size(p), F.lit(1)))).otherwise(1.0)
    return F.when((F.size(p) == 0) | (_clipped(p, r, 1) == 0), 0.0).otherwise(short * F.exp(total / n))


def rouge_n(prediction: Column, reference: Column, n: int = 1, stems: bool = False) -> Column:
    """F1 of shared n-grams of tokens; ``stems``: tokens of over three letters count as their stems."""
    p, r = _tokens(prediction, stems), _tokens(reference, stems)
    return _f1(_clipped(p, r, n), _runs(p, n), _runs(r, n))


def prompt_transcript(srt: Column, timestamps: bool = True, most: int | None = None) -> Column:
    """A subtitle file for a prompt: no cue numbers, single blank lines, clock lines as ``[h:m:s --> h:m:s]`` or left out.

    Over ``most`` characters it is cut to ``most`` - 64 and says so.
    """
    lines = F.transform(F.split(srt, "\r\n|\n|\r"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    lines = F.filter(lines, lambda x: ~x.rlike(r"^\d+$"))
    clock = r"^\d{2}:\d{2}:\d{2}[,\.]\d{3}\s+-->\s+\d{2}:\d{2}:\d{2}[,\.]\d{3}$"
    if timestamps:
        lines = F.transform(lines, lambda x: F.when(x.rlike(clock), F.concat(F.lit("["), F.regexp_replace(x, r"[,\.]\d{3}", ""), F.lit("]"))).otherwise(x))
    else:
        lines = F.filter(lines, lambda x: ~x.rlike(clock))
    text = F.concat(F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"), r"^\s+|\s+$", ""), F.lit("\n"))
    if most is None:
        return text
    cut = F.concat(F.regexp_replace(F.substring(text, 1, most - 64), r"\s+$", ""), F.lit("\n[... transcript truncated ...]\n"))
    return F.when(F.length(text) > most, cut).otherwise(text)


def experiment_tag(*parts: tuple[Column, Column | str]) -> Column:
    """Parts whose condition holds, joined by underscores."""
    return F.concat_ws("_", *(F.when(c, v) for c, v in parts))


def tag_number(tag: Column, letter: str) -> Column:
    """The number after ``_letter`` in a tag."""
    return F.regexp_extract(tag, rf"_{letter}(\d+)", 1).try_cast("int")


def uuid5(name: Column, namespace: str) -> Column:
    """The name-based UUID (SHA-1) in a namespace, itself a UUID."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    third = F.concat(F.lit("5"), F.substring(digest, 14, 3))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), third, F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))
