"""Text rules as column expressions: normal form, residue, protected tokens, terms, placeholders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII word boundary: \b follows Unicode in some Java versions.
EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"

# What a translation must keep as it is, and what counts as a term.
PRESERVED = {
    "url": r"https?://\S+|www\.\S+",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "footnote": r"\[[0-9A-Za-z]+]|\([0-9A-Za-z]+\)",
    "tag": r"</?[A-Za-z][^>]{0,120}>",
    "list_prefix": r"^\s*(?:[0-9]+[.)]|[A-Za-z][.)]|[-*+])\s+",
    "code": r"(?s)```.+?```|`[^`]+`|\$[^$]+\$|\\[A-Za-z]+\{[^}]{1,120}}",
    "measurement": r"\b\d+(?:\.\d+)?\s?(?:kg|g|mg|km|cm|mm|m|mi|ft|in|mph|km/h|ml|mL|L|KB|MB|GB|Hz|kHz|MHz|GHz|V|W|kW|%)\b|\b\d+(?:\.\d+)?\s?[°℃℉](?:C|F)?\b",
    "identifier": r"\b[A-Z]{2,}[A-Z0-9_-]*\d+[A-Z0-9_-]*\b|\b[A-Za-z]+(?:[._-][A-Za-z0-9]+){2,}\b",
}
TERM = r"\b(?:[A-Z][a-z]{2,}|[A-Z]{2,})(?:\s+(?:of|the|and|for|in|on|[A-Z][a-z]{2,}|[A-Z]{2,}))*\b"
#: The same for Java, whose groups recurse once for each word unless they never give a word back: each word ends where it ends.
#: It looks for a capital first, as most characters are none, and only then at what is before it.
TERM_RUN = r"[A-Z](?<!\w[A-Z])(?:[a-z]{2,}|[A-Z]+)(?!\w)(?:\s+(?:of|the|and|for|in|on|[A-Z][a-z]{2,}|[A-Z]{2,})(?!\w))*+"
STOP_TERMS = "A An And As At Book Chapter For From He Her His I In It One She That The This To We You".split()
PLACEHOLDER = r"\[id\d+\]"
URL_ONLY = r"(?i)^(https?://|www\.).+"


def java(pattern: str) -> str:
    return pattern.replace(r"\b", EDGE)


#: Characters up to a space.
CONTROL = "".join(map(chr, range(0x21)))


def trim(x: Column) -> Column:
    """Characters up to a space trimmed off."""
    return F.btrim(x, F.lit(CONTROL))


def norm(x: Column) -> Column:
    """Characters up to a space trimmed off, runs of white space made one space; null gives ''. A lone space is
    no match, so that most words need no replacement."""
    return F.regexp_replace(trim(F.coalesce(x, F.lit(""))), r"\s{2,}|[\t\n\x0B\f\r]", " ")


def preview(x: Column, limit: int = 160) -> Column:
    return F.when(F.length(x) <= limit, x).otherwise(F.concat(F.substring(x, 1, limit - 3), F.lit("...")))


def english_residue(x: Column) -> Column:
    runs = F.regexp_extract_all(x, F.lit("[A-Za-z]{4,}"), F.lit(0))
    return (F.size(runs) >= 3) | (F.aggregate(runs, F.lit(0), lambda a, w: a + F.length(w)) >= 24)


def suspicious_ratio(source: Column, translated: Column) -> Column:
    ratio = F.length(translated) / F.length(source)
    return (F.length(source) >= 30) & ((ratio < 0.15) | (ratio > 3.5))


def source_repeated(source: Column, translated: Column) -> Column:
    return (F.length(source) >= 20) & translated.contains(source)


def _may_hold(x: Column, name: str) -> Column:
    """What a text must hold for the pattern to match, by tests that are cheap: most texts hold none of it."""
    any_of = lambda *parts: reduce(lambda a, b: a | b, [x.contains(p) for p in parts])
    return {
        "url": any_of("://", "www."),
        "email": any_of("@"),
        "footnote": any_of("[", "("),
        "tag": any_of("<"),
        "list_prefix": F.lit(True),
        "code": any_of("`", "$", "\\"),
        "measurement": x.rlike("[0-9]"),
        "identifier": x.rlike(r"[A-Z]{2}[A-Z0-9_-]*[0-9]|[A-Za-z][._-][A-Za-z0-9]+[._-][A-Za-z0-9]"),
    }[name]


def missing_tokens(source: Column, translated: Column) -> Column:
    """Protected tokens of the source, in order and once each, that the translation lacks."""
    extract = lambda name: F.regexp_extract_all(source, F.lit(java(PRESERVED[name])), F.lit(0))
    none = F.array().cast("array<string>")
    found = F.concat(*[F.when(_may_hold(source, name), extract(name)).otherwise(none) for name in PRESERVED])
    trimmed = F.filter(F.transform(found, trim), lambda t: t != "")
    return F.array_distinct(F.filter(trimmed, lambda t: ~translated.contains(t)))


def post_process(x: Column) -> Column:
    y = F.regexp_replace(F.regexp_replace(F.replace(F.coalesce(x, F.lit("")), F.lit("\u00a0"), F.lit(" ")), r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")
    return trim(y)


def terms(x: Column) -> Column:
    """Useful proper-noun candidates, in order."""
    found = F.transform(F.regexp_extract_all(x, F.lit(TERM_RUN), F.lit(0)), lambda t: F.regexp_replace(F.trim(t), r"\s+", " "))
    return F.filter(found, lambda t: F.length(t).between(4, 80) & ~t.isin(STOP_TERMS) & ~F.split_part(t, F.lit(" "), F.lit(1)).isin(STOP_TERMS))


def mock_terms(x: Column) -> Column:
    words = F.filter(F.split(x, r"[^\p{L}\p{N}']+"), lambda w: (F.length(w) >= 4) & w.rlike(r"^\p{Lu}"))
    return F.array_distinct(words)


def non_translatable(x: Column) -> Column:
    bare = F.regexp_replace(x, r"\s+", "")
    return (bare == "") | bare.rlike(URL_ONLY) | bare.rlike(r"^[\p{P}\p{S}]+$") | bare.rlike(r"^\p{N}+$") | ((F.length(bare) <= 3) & bare.rlike(r"^[\p{N}\p{P}\p{S}]+$"))


def has_letter_or_digit(x: Column) -> Column:
    return x.rlike(r"[\p{L}\p{N}]")


def is_dialogue(x: Column) -> Column:
    """By the first and last characters only, so that a long text costs no more."""
    t = F.trim(x)
    low = F.lower(F.substring(t, 1, 8))
    begins, ends = [t.startswith(c) for c in ("\"", "'", "“", "‘", "—", "- ")], [t.endswith(c) for c in ("\"", "”")]
    return reduce(lambda a, b: a | b, [*begins, *ends, *[low.startswith(c) for c in ("he said", "she said", "said ")]])


def placeholders(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(PLACEHOLDER), F.lit(0))


def strip_placeholders(x: Column) -> Column:
    return F.regexp_replace(x, PLACEHOLDER, "")


def placeholder_fault(expected: Column, translated: Column) -> Column:
    """The first fault, or null: missing all, extra, missing, duplicate, out of order."""
    actual = placeholders(translated)
    extra, missing = F.array_except(actual, expected), F.filter(expected, lambda t: ~F.array_contains(actual, t))
    twice = F.array_distinct(F.filter(actual, lambda t: F.size(F.filter(actual, lambda u: u == t)) > 1))
    listed = lambda what, x: F.concat(F.lit(what), F.array_join(x, ", "))
    return (
        F.when(F.coalesce(F.trim(translated), F.lit("")) == "", "no placeholder is left")
        .when(F.size(extra) > 0, listed("placeholders too many: ", extra))
        .when(F.size(missing) > 0, listed("placeholders lost: ", missing))
        .when(F.size(twice) > 0, listed("placeholders twice: ", twice))
        .when(actual != expected, "placeholders in another order")
    )


def nesting_fault(expected: Column, translated: Column) -> Column:
    """The first fault of nesting, or null, by an automaton with a stack over the placeholders of a text: one that is
    unknown, an end that isn't that of the last open start, a start that is never closed. ``expected``: (token, kind) in
    order of the source; a start's end has the next number."""
    state = lambda stack, fault: F.struct(stack.alias("stack"), fault.alias("fault"))
    kinds = F.map_from_entries(expected)
    end = lambda start: F.concat(F.lit("[id"), (F.regexp_extract(start, r"\d+", 0).cast("long") + 1).cast("string"), F.lit("]"))
    none = F.lit(None).cast("string")

    def step(a: Column, token: Column) -> Column:
        kind, n = kinds[token], F.size(a["stack"])
        closes = (n > 0) & (end(F.get(a["stack"], n - 1)) == token)
        return (
            F.when(a["fault"].isNotNull(), a)
            .when(kind.isNull(), state(a["stack"], F.concat(F.lit("unknown placeholder "), token)))
            .when(kind == "OPEN", state(F.concat(a["stack"], F.array(token)), none))
            .when(closes, state(F.slice(a["stack"], F.lit(1), n - 1), none))
            .otherwise(state(a["stack"], F.concat(F.lit("placeholders cross at "), token)))
        )

    left = lambda a: F.when(a["fault"].isNull() & (F.size(a["stack"]) > 0), F.concat(F.lit("never closed: "), F.element_at(a["stack"], -1))).otherwise(a["fault"])
    return F.aggregate(placeholders(translated), state(F.array().cast("array<string>"), none), step, left)


def provider_source(source: Column, template: Column, tokens: Column) -> Column:
    """What a provider is given: the template, where there is one with placeholders."""
    return F.when((F.trim(F.coalesce(template, F.lit(""))) != "") & (F.size(tokens) > 0), template).otherwise(source)


def display(translated: Column, tokens: Column) -> Column:
    """A translation without its known placeholders, in normal form; unchanged where there are none."""
    return F.when(translated.isNotNull() & (F.size(tokens) > 0), norm(F.aggregate(tokens, translated, lambda a, t: F.replace(a, t, F.lit(""))))).otherwise(translated)


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


#: A segment's place in its book's files.
LOCATOR = "path string, index int, tokens array<string>"


def locator_json(path: Column, index: Column, tokens: Column) -> Column:
    """A place as JSON; what is empty is left out."""
    return F.to_json(F.struct(F.nullif(path, F.lit("")).alias("path"), index.alias("index"), F.when(F.size(tokens) > 0, tokens).alias("tokens")))


def read_locator(json: Column) -> Column:
    """The place again: fields that are not known are ignored, and what is no JSON gives nulls."""
    return F.from_json(json, LOCATOR)


def ids_json(ids: Column) -> Column:
    return F.to_json(ids)


def read_ids(json: Column) -> Column:
    """Ids of a list as JSON; null where it is none."""
    return F.from_json(json, "array<bigint>")


def output_text(body: Column) -> Column:
    """The text of a provider's answer: the first that is a string of ``output_text``, the first choice's message, and the parts of
    all outputs in order; null if the body is no JSON or has none."""
    v = F.try_parse_json(body)
    at = lambda x, path: F.try_variant_get(x, path, "variant")
    text = lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))
    items = lambda x, path: F.coalesce(F.try_variant_get(x, path, "array<variant>"), F.array().cast("array<variant>"))
    parts = F.flatten(F.transform(items(v, "$.output"), lambda o: items(o, "$.content")))
    first = F.get(F.filter(F.transform(parts, lambda p: text(at(p, "$.text"))), lambda t: t.isNotNull()), F.lit(0))
    return F.coalesce(text(at(v, "$.output_text")), text(at(v, "$.choices[0].message.content")), first)
