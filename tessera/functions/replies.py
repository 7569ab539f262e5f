"""What model replies hold: JSON blocks, answers, ASK queries; and scores of texts against references."""

from __future__ import annotations

import json
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.fuzzy import common
from tessera.functions.stemming import stems, word_list
from tessera.functions.text import truth, without_thinking


def block(text: str) -> str | None:
    """The first balanced JSON object of a text, commas before a closing bracket dropped; None without a sound one."""
    for start in (m.start() for m in re.finditer(r"\{", text)):
        depth, quoted, skip = 0, False, False
        for i in range(start, len(text)):
            c = text[i]
            if skip:
                skip = False
            elif c == "\\":
                skip = quoted
            elif c == '"':
                quoted = not quoted
            elif not quoted and c in "{}":
                depth += 1 if c == "{" else -1
                if depth == 0:
                    tidy = re.sub(r",(\s*[}\]])", r"\1", text[start : i + 1])
                    try:
                        return json.dumps(json.loads(tidy), ensure_ascii=False)
                    except ValueError:
                        break
        if depth:
            return None
    return None


def json_block(text: Column) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else block(t))

    return F.pandas_udf(run, "string")(text)


def ask_query(text: Column) -> Column:
    """ASK and its braces, or a whole text that begins with ASK or PREFIX; null otherwise."""
    found = F.regexp_extract(text, r"(?is)(ASK\s*(?:WHERE\s*)?\{.*\})", 1)
    plain = F.trim(text)
    return F.when(plain.rlike(r"(?i)^(ASK|PREFIX)\b"), plain).when(found != "", found)


def prediction(text: Column, task: Column) -> Column:
    """The answer that a task's type looks for: a letter, true or false, else the text itself, after any thinking."""
    plain = without_thinking(text)
    letter = F.regexp_extract(plain, r"\b([A-D])\b", 1)
    loose = F.upper(F.regexp_extract(plain, r"(?i)\b([a-d])\b", 1))
    return F.when(task == "choice", F.nullif(F.when(letter != "", letter).otherwise(loose), F.lit(""))).when(task == "truth", truth(text)).otherwise(plain)


def picked_range(ranges: Column) -> Column:
    """Of a list of ranges the first XSD type, else the first; null for none."""
    typed = F.filter(ranges, lambda r: F.startswith(F.lower(r), F.lit("xsd:")))
    return F.coalesce(F.get(typed, F.lit(0)), F.get(ranges, F.lit(0)))


def picked_type(text: Column) -> Column:
    """object where it is one of the piped types, else the first, in lower case; other texts as they are."""
    options = F.transform(F.split(text, r"\|"), lambda x: F.lower(F.trim(x)))
    return F.when(~F.contains(text, F.lit("|")), text).when(F.array_contains(options, "object"), "object").otherwise(F.get(options, F.lit(0)))


def ontology_name(iri: Column) -> Column:
    """A name by the IRI's host and path; the last part of the path, without suffix, for hosts that aren't known."""
    # Hosts and the names they stand for, in order.
    hosts = (("spec.edmcouncil.org", "FIBO"), ("geonames", "GeoNames"), ("schema.org", "Schema.org"), ("dbpedia", "DBpedia"), ("foodon", "FoodOn"), ("w3.org", "W3C"), ("linkedgeodata.org", "LinkedGeoData"), ("omg.org", "OMG"))
    path = F.regexp_replace(iri, r"^[a-z]+://[^/]*", "")
    last = F.element_at(F.split(F.regexp_replace(path, "#.*$", ""), "/"), -1)
    bare = F.when(F.contains(last, F.lit(".owl")), F.replace(last, F.lit(".owl"), F.lit(""))).when(F.contains(last, F.lit(".rdf")), F.replace(last, F.lit(".rdf"), F.lit(""))).otherwise(F.split_part(last, F.lit("_"), F.lit(1)))
    out = bare
    for host, name in reversed(hosts):
        out = F.when(F.contains(F.lower(iri) if host == "foodon" else iri, F.lit(host)), name).otherwise(out)
    out = F.when(F.contains(iri, F.lit("bioontology.org")), F.regexp_extract(path, r"/ontology/([^/]+)", 1)).otherwise(out)
    obo = F.coalesce(*[F.nullif(F.upper(F.regexp_extract(iri, p, 1)), F.lit("")) for p in (r"obo/([A-Z]+)_", r"obo/([a-z]+)\.owl", r"obo/([a-z]+)/")], last)
    return F.when(F.contains(iri, F.lit("purl.obolibrary.org/obo/")), obo).otherwise(out)


def overlap(a: list, b: list) -> int:
    return sum((Counter(a) & Counter(b)).values())


def f1(hits: int, a: int, b: int) -> float:
    return 2 * hits / (a + b) if hits else 0.0


def text_scores(candidate: str, reference: str, roots: tuple[list[str], list[str]] | None = None) -> tuple[float, float, float, float]:
    """ROUGE-1, -2 and -L (F1) of both texts' stems, if given, else of their lower-cased words, and BLEU up to four words of the
    words; BLEU is 0 where no run of some length is shared."""
    words = [re.findall(r"[^\W_]+", t.lower()) for t in (candidate, reference)]
    a, b = roots or words
    grams = lambda w, n: list(zip(*(w[i:] for i in range(n)), strict=False))
    numbers = {w: chr(i + 1) for i, w in enumerate(dict.fromkeys(a + b))}
    lcs = common("".join(numbers[w] for w in a), "".join(numbers[w] for w in b))
    rouge = [f1(overlap(grams(a, n), grams(b, n)), max(0, len(a) - n + 1), max(0, len(b) - n + 1)) for n in (1, 2)]
    a, b = words
    hits = [(overlap(grams(a, n), grams(b, n)), len(a) - n + 1) for n in (1, 2, 3, 4)]
    bleu = 0.0
    if all(h > 0 for h, _ in hits):
        bleu = math.exp(min(0.0, 1 - len(b) / len(a)) + sum(math.log(h / n) for h, n in hits) / 4)
    return rouge[0], rouge[1], f1(lcs, len(a), len(b)), bleu


def generation_scores(candidate: Column, reference: Column, stemmed: bool = False) -> Column:
    """A struct (rouge_1, rouge_2, rouge_l, bleu), ROUGE over stems if asked for."""
    names = ["rouge_1", "rouge_2", "rouge_l", "bleu"]
    schema = ", ".join(f"{c} double" for c in names)

    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_scores(x or "", y or "") for x, y in zip(a, b, strict=True)], columns=names)

    def run_stemmed(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_scores(x or "", y or "", (list(s), list(t))) for x, y, s, t in zip(a, b, c, d, strict=True)], columns=names)

    if not stemmed:
        return F.pandas_udf(run, schema)(candidate, reference)
    return F.pandas_udf(run_stemmed, schema)(candidate, reference, stems(word_list(candidate)), stems(word_list(reference)))
