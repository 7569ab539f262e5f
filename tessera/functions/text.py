"""Scalar functions on identifiers, texts and vectors, all as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# JSON types by datatype, in the order they are tried.
JSON_TYPES = (
    ("xsd:string", "string"), ("xsd:integer", "integer"), ("xsd:int", "integer"), ("xsd:float", "float"), ("xsd:double", "float"),
    ("xsd:boolean", "boolean"), ("xsd:date", "date"), ("xsd:dateTime", "datetime"),
)


def local_name(uri: Column) -> Column:
    """What follows the last # and then the last /."""
    return F.element_at(F.split(F.element_at(F.split(uri, "#"), -1), "/"), -1)


def spaced_label(uri: Column) -> Column:
    """camelCase local names as lower-case words."""
    return F.lower(F.regexp_replace(local_name(uri), "([a-z0-9])([A-Z])", "$1 $2"))


def json_type(datatype: Column) -> Column:
    """The type whose name an IRI holds, or ends with after its prefix; string otherwise."""
    out = F.lit("string")
    for name, kind in reversed(JSON_TYPES):
        hit = F.contains(datatype, F.lit(name)) | F.endswith(datatype, F.lit(name.removeprefix("xsd:")))
        out = F.when(hit, kind).otherwise(out)
    return out


def compact_id(uri: Column) -> Column:
    """cls: before local names that begin with a capital, rel: before others."""
    return F.concat(F.when(local_name(uri).rlike("^[A-Z]"), "cls:").otherwise("rel:"), local_name(uri))


def tokens(text: Column) -> Column:
    """Lower-cased words between white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements of two arrays; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def dot(a: Column, b: Column) -> Column:
    """Sum of products up to the shorter length, in double precision."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda total, x: total + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 where either vector has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def without_thinking(text: Column) -> Column:
    """A model's answer after its closing thought mark, trimmed."""
    return F.trim(F.substring_index(text, "</think>", -1))


def choice_letter(text: Column) -> Column:
    """The first stand-alone letter A to D of an answer, upper-cased; null if there is none."""
    return F.nullif(F.upper(F.regexp_extract(without_thinking(text), r"(?i)\b([a-d])\b", 1)), F.lit(""))


def truth(text: Column) -> Column:
    """true or false as an answer first says it; null if it says neither."""
    return F.nullif(F.lower(F.regexp_extract(without_thinking(text), r"(?i)\b(true|false)\b", 1)), F.lit(""))


def tuples(text: Column) -> Column:
    """Parenthesised comma lists of two or more parts, quotes stripped."""
    parts = F.transform(F.regexp_extract_all(text, F.lit(r"\(([^()]+)\)"), F.lit(1)), lambda t: F.transform(F.split(t, ","), lambda x: F.regexp_replace(F.trim(x), "^['\"]+|['\"]+$", "")))
    return F.filter(parts, lambda p: F.size(p) >= 2)


def final_answer(text: Column) -> Column:
    """What follows FINAL ANSWER:, or else the last line."""
    marked = F.regexp_extract(text, r"(?is)FINAL ANSWER:\s*(.*)", 1)
    return F.trim(F.when(marked != "", marked).otherwise(F.element_at(F.split(F.trim(text), "\n"), -1)))


def quick_terms(text: Column, most: int = 30, within: int = 2000) -> Column:
    """Words of over two characters near the start that begin with a capital, brackets and stops at their ends then taken off:
    distinct, sorted, at most so many."""
    good = F.filter(F.split(F.substring(text, 1, within), r"\s+"), lambda w: (F.length(w) > 2) & w.rlike(r"^\p{Lu}"))
    bare = F.transform(good, lambda w: F.regexp_replace(w, r"^[.,;:()\[\]]+|[.,;:()\[\]]+$", ""))
    return F.slice(F.array_sort(F.array_distinct(bare)), 1, most)


def theme(text: Column, groups: dict[str, list[str]], other: str = "Other") -> Column:
    """The first group one of whose keywords occurs in the lower-cased text."""
    out = F.lit(other)
    for name, words in reversed(groups.items()):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(F.lower(text), F.lit(w))
        out = F.when(hit, name).otherwise(out)
    return out


# Themes of competency questions with their keywords, in the order they are tried.
THEMES = {
    "Planning & Scheduling": ["plan", "schedule", "sequence", "timeline"],
    "Resource Management": ["resource", "personnel", "budget", "cost"],
    "Safety & Risk": ["safety", "risk", "hazard", "protection"],
    "Equipment & Facilities": ["equipment", "facility", "site", "building"],
    "Regulatory & Compliance": ["regulatory", "compliance", "license", "permit"],
    "Waste Management": ["waste", "disposal", "contamination"],
    "Monitoring & Assessment": ["monitor", "assess", "measure", "evaluate"],
}


def question_theme(question: Column) -> Column:
    """The theme of a competency question, or Other."""
    return theme(question, THEMES)


def rouge_l(candidate: Column, reference: Column) -> Column:
    """F1 of the longest common subsequence of words, as a fold over the candidate's words."""
    a, b = tokens(candidate), tokens(reference)
    zero = F.transform(b, lambda _: F.lit(0))

    def row(above: Column, word: Column) -> Column:
        def cell(left: Column, i: Column) -> Column:
            diagonal = F.when(i == 0, 0).otherwise(F.element_at(above, F.greatest(i, F.lit(1))))
            best = F.when(F.get(b, i) == word, diagonal + 1).otherwise(F.greatest(F.get(above, i), F.when(F.size(left) == 0, 0).otherwise(F.element_at(left, F.greatest(F.size(left), F.lit(1)) * F.lit(1)))))
            return F.concat(left, F.array(best))

        return F.aggregate(F.sequence(F.lit(0), F.size(b) - 1), F.array().cast("array<int>"), cell)

    lcs = F.when((F.size(a) == 0) | (F.size(b) == 0), 0).otherwise(F.array_max(F.aggregate(a, zero, row)))
    return F.when(lcs == 0, 0.0).otherwise(2.0 * lcs / (F.size(a) + F.size(b)))
