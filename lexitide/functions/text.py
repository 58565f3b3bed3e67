"""Text expressions over columns. Each is built from Spark's own functions, so that plans stay inside code generation."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexitide.functions import rules

# White space as the recognised texts' source takes it, in a form that Java's and DuckDB's patterns share, and
# in one for Python; the spacing rules of joined tokens; marks that end a sentence or a clause.
WHITE = r"[\t-\r\x1C-\x20\x85\p{Z}]"
PYTHON_WHITE = "[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
SPACING = (("~+([,.!?;:%])", "1"), ("~+-~*", "-"), (r"(?i)~+(['’]s\b)", "1"), (r"(?i)~+n't\b", "n't"))  # ~: white space
WORD = "[A-Za-z']+"
ENDS_SENTENCE = r"[.!?][\"')\]]*$"
ENDS_SOFTLY = r"[,;:][\"')\]]*$"


_SPACING = [(re.compile(p.replace("~", PYTHON_WHITE), re.A), r"\1" if put == "1" else put) for p, put in SPACING]


def stripped(text: Column) -> Column:
    """Without white space at the ends; null stays null."""
    return F.regexp_replace(text, f"^{WHITE}+|{WHITE}+$", "")


def is_blank(text: Column) -> Column:
    """Null, empty, or nothing but white space."""
    return ~F.coalesce(text, F.lit("")).rlike(WHITE.replace("[", "[^", 1))


def collapse(text: Column) -> Column:
    """Runs of white space become one space; ends are trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"{WHITE}+", " "))


def tidy(text: Column) -> Column:
    """Spacing of joined tokens: none before ``,.!?;:%`` or around a hyphen, ``'s`` and ``n't`` reattached."""
    for pattern, put in SPACING:
        text = F.regexp_replace(text, pattern.replace("~", WHITE), "$1" if put == "1" else put)
    return collapse(text)


def tidied(tokens: Iterable[str]) -> str:
    """The text of tokens by the same rules, for folds that see words one at a time."""
    text = " ".join(t for t in map(str.strip, tokens) if t)
    for pattern, put in _SPACING:
        text = pattern.sub(put, text)
    return " ".join(text.split())


def joined(tokens: Column) -> Column:
    """Caption text of an array of tokens."""
    text = F.array_join(F.filter(F.transform(tokens, lambda t: F.trim(t)), lambda t: t != ""), " ")
    odd = rf"{WHITE}[,.!?;:%-]|{WHITE}{WHITE}|^{WHITE}|{WHITE}$|(?! ){WHITE}|(?i){WHITE}(['’]s|n't)\b"
    return F.when(text.rlike(odd), tidy(text)).otherwise(text)  # most texts need no repair


def replaced(text: Column, pairs: list[tuple[str, str]], ignore_case: bool = True) -> Column:
    """Ordered pattern rules, each over the result of the one before."""
    return reduce(lambda t, r: F.regexp_replace(t, ("(?i)" if ignore_case else "") + r[0], r[1].replace("$", r"\$")), pairs, text)


def last_word(text: Column) -> Column:
    return F.regexp_extract(F.lower(text), r"([a-z']+)[^a-z']*$", 1)


def first_word(text: Column) -> Column:
    return F.regexp_extract(F.lower(text), r"([a-z']+)", 1)


def ends_sentence(text: Column) -> Column:
    return F.trim(text).rlike(ENDS_SENTENCE)


def weak_ending(text: Column, listed: list[str] = rules.WEAK_ENDINGS) -> Column:
    last = last_word(text)
    return (last != "") & (last.endswith("ing") | last.isin(listed))


def opens_dependent(text: Column) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z']+)")), " ").rlike("^(" + "|".join(rules.DEPENDENT) + ") ")


def incomplete(text: Column) -> Column:
    """A weak ending, or a dependent clause that ends softly."""
    return weak_ending(F.trim(text)) | (F.trim(text).rlike(ENDS_SOFTLY) & opens_dependent(text))


def continues(text: Column) -> Column:
    """The whole text, without what precedes its first letter, is a word that continues a clause."""
    return F.lower(F.regexp_replace(text, "^[^A-Za-z]+", "")).isin(rules.CONTINUATIONS)


_SENTENCE_END, _CLAUSE_END, _WORD = re.compile(ENDS_SENTENCE, re.A), re.compile(ENDS_SOFTLY, re.A), re.compile("[a-z']+")
_WEAK, _GOES_ON = frozenset(rules.WEAK_ENDINGS), frozenset(rules.CONTINUATIONS)


def stops(text: str) -> bool:
    """``ends_sentence`` of one text; this and what follows serve folds, which see texts one at a time."""
    return bool(_SENTENCE_END.search(text.strip()))


def pauses(text: str) -> bool:
    return bool(_CLAUSE_END.search(text.strip()))


def unfinished(text: str) -> bool:
    """``incomplete`` of one text."""
    found = _WORD.findall(text.lower())
    if found and (found[-1].endswith("ing") or found[-1] in _WEAK):
        return True
    return pauses(text) and any(found[: len(lead)] == lead and len(found) > len(lead) for lead in _LEADS)


_LEADS = [d.split() for d in rules.DEPENDENT]


def bare(text: str) -> str:
    """A text in lower case without what precedes its first letter."""
    return re.sub("^[^A-Za-z]+", "", text).lower()


def goes_on(text: str) -> bool:
    """``continues`` of one text."""
    return bare(text) in _GOES_ON


def corrected(text: Column) -> Column:
    """Recognised text with known slips mended, ``i`` as ``I`` and a capital first letter."""
    out = F.regexp_replace(replaced(collapse(text), rules.CORRECTIONS), r"\bi\b", "I")
    at = F.regexp_instr(out, F.lit("[A-Za-z]"))
    return F.when(at > 0, F.concat(F.substr(out, F.lit(1), at - 1), F.upper(F.substr(out, at, F.lit(1))), F.substr(out, at + 1))).otherwise(out)


def cjk_normalised(text: Column) -> Column:
    """Term fixes; in Chinese text also full-width marks, no space between characters, no leading or doubled marks."""
    out = reduce(lambda t, r: F.replace(t, F.lit(r[0]), F.lit(r[1])), rules.CJK_TERMS, collapse(text))
    out = F.regexp_replace(out, "(?<!防)熊喷雾", "防熊喷雾")
    marks = [(r",\s*", "，"), (r"\.(?=$|\s)", "。"), (r"\?", "？"), ("!", "！"), (rf"(?<={rules.CJK}){WHITE}+(?={rules.CJK})", ""), (rf"^[，。；：！？{WHITE}]+", ""), (r"([，。！？；：])\1+", "$1"), ("，(?=[。！？；：])", "")]
    return F.when(out.rlike(rules.CJK), reduce(lambda t, r: F.regexp_replace(t, r[0], r[1]), marks, out)).otherwise(out)


def clock(ms: Column) -> Column:
    """``mm:ss`` of a time in ms, not below zero."""
    s = F.expr("1000")
    total = F.floor(F.greatest(ms, F.lit(0)) / s).cast("long")
    return F.format_string("%02d:%02d", F.floor(total / 60).cast("long"), (total % 60).cast("long"))


def srt_time(ms: Column) -> Column:
    """``hh:mm:ss,mmm`` of a time in ms, not below zero."""
    t = F.greatest(ms, F.lit(0)).cast("long")
    part = lambda d, m: (F.floor(t / d) % m).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(t / 3600000).cast("long"), part(60000, 60), part(1000, 60), (t % 1000).cast("long"))
