"""Text functions as Spark columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 29 code points that count as white space.
WHITESPACE = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"
#: What full case folding changes beyond lower(): the code points whose folding is another text than their lower case.
FOLDED = {c: c.casefold() for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]) if c.casefold() != c.lower()}
# What a technical term and a run of Han characters are made of, and what ends a sentence.
TERM = "[a-z0-9_+#.-]+"
HAN = "[一-鿿]+"
SENTENCE_END = r"(?<=[。！？.!?；;])\s+"


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, WHITESPACE + "+", " "))


def strip(text: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(text, rf"^{WHITESPACE}+|{WHITESPACE}+\z", "")


def _ranges(chars: list[str], gap: int = 40) -> str:
    """A class of a few ranges that holds all of chars, and others between them."""
    out: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if out and c - out[-1][1] <= gap and c > 0xFF:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in out) + "]"


_MAYBE_FOLDED = _ranges(list(FOLDED))


def casefold(text: Column) -> Column:
    """Full case folding: the lower case, then what else a text has to fold, one kind of code point at a time."""
    table = F.create_map(*[F.lit(x) for pair in FOLDED.items() for x in pair])

    def folded(low: Column) -> Column:
        there = F.array_distinct(F.regexp_extract_all(low, F.lit(_MAYBE_FOLDED), F.lit(0)))
        return F.aggregate(there, low, lambda done, c: F.replace(done, c, F.coalesce(F.element_at(table, c), c)))

    low = F.lower(text)
    return F.when(low.rlike(_MAYBE_FOLDED), F.get(F.transform(F.array(low), folded), 0)).otherwise(low)


def tokens(text: Column) -> Column:
    """Technical terms, then the bigrams of each run of Han characters; repeated ones stay."""
    folded = casefold(F.trim(text))
    pairs = F.transform(
        F.regexp_extract_all(folded, F.lit(HAN), F.lit(0)),
        lambda run: F.when(F.length(run) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2)))).otherwise(F.array().cast("array<string>")),
    )
    return F.concat(F.regexp_extract_all(folded, F.lit(TERM), F.lit(0)), F.flatten(pairs))


_TERM, _HAN = re.compile(TERM), re.compile(HAN)


def tokens_of(text: str) -> list[str]:
    """The same of one text, for what runs in Arrow batches."""
    folded = text.casefold()
    runs = _HAN.findall(folded) if not folded.isascii() else ()
    return _TERM.findall(folded) + [run[i : i + 2] for run in runs for i in range(len(run) - 1)]


def collapse_of(text: str) -> str:
    """collapse() of one text: str.split() parts at the same 29 code points."""
    return " ".join(text.split())


def terms(text: Column) -> Column:
    """Distinct tokens in order of first occurrence."""
    return F.array_distinct(tokens(text))


def coverage(question_terms: Column, text: Column) -> Column:
    """The share of terms that occur anywhere in text; 0 without terms."""
    folded = casefold(text)
    hits = F.size(F.filter(question_terms, lambda t: F.contains(folded, t)))
    return F.when(F.size(question_terms) > 0, hits / F.size(question_terms)).otherwise(F.lit(0.0))


def occurrences(text: Column, term: Column) -> Column:
    """Occurrences of term in text that do not overlap."""
    return ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("long")


def sentences(text: Column) -> Column:
    return F.split(text, SENTENCE_END)


def stable_sha256(*parts: Column) -> Column:
    """SHA-256 of the parts as a compact JSON array of strings; control characters escaped in lower case."""
    json = F.to_json(F.array(*[p.cast("string") for p in parts]))
    codes = F.array(*[F.lit(f"\\u00{code}") for code in ("0B", "0E", "0F", "1A", "1B", "1C", "1D", "1E", "1F")])
    lowered = lambda x: F.aggregate(codes, x, lambda done, code: F.replace(done, code, F.concat(F.lit("\\u00"), F.lower(F.right(code, F.lit(2))))))
    # a lambda's variable: the text is built once, and the generated code stays small where many hashes meet
    return F.get(F.transform(F.array(json), lambda x: F.sha2(F.when(F.contains(x, F.lit("\\u00")), lowered(x)).otherwise(x), 256)), 0)
