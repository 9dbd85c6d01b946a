"""Column expressions: text, paths, similarity, references.  All run in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.config import BUILTIN_TYPES, DEFAULT_INTENT, IGNORED_NAMES, IGNORED_PARTS, INTENT_ALIASES, INTENTS, SUFFIX_LANGUAGE

TOKEN = r"(\p{L}+|\p{N}+|[^\s\p{L}\p{N}])"
#: What may stand before or after a whole word; \b differs between regex engines.
EDGE = r"[^\p{L}\p{M}\p{N}_]"
TEST_PATH = r"(?i)(?:^|/)(?:tests?|__tests__)/|\.(?:spec|test)\.[^/]+$"
TEST_QUERY = rf"(?i)(^|{EDGE})(e2e|fixture|mock|spec|tests?)($|{EDGE})"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def token_count(text: Column | str) -> Column:
    """Offline stand-in for a tokenizer: letters in a row, digits in a row, or any other sign."""
    return F.size(F.regexp_extract_all(_c(text), F.lit(TOKEN), F.lit(1))).cast("long")


def strip(text: Column | str) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(_c(text), r"(?U)^\s+|\s+$", "")


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity of two arrays in double precision, 0 where either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    a, b = _c(a), _c(b)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def word_set(text: Column | str) -> Column:
    """Distinct words by white space, of the lower-case text."""
    words = F.split(F.lower(strip(text)), r"(?U)\s+")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Of two word sets; 0 if either is empty."""
    a, b = _c(a), _c(b)
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(F.lit(0.0))


def basename(path: Column | str) -> Column:
    return F.regexp_extract(_c(path), r"([^/]*)$", 1)


def language_of(path: Column | str) -> Column:
    """Language by the last suffix, whatever its case; null if it has none or an unknown one."""
    suffix = F.lower(F.regexp_extract(basename(path), r"[^.](\.[^.]+)$", 1))
    table = F.create_map(*[F.lit(x) for pair in sorted(SUFFIX_LANGUAGE.items()) for x in pair])
    return F.when(suffix != "", F.element_at(table, suffix))


def ignored(path: Column | str, names: frozenset[str] = IGNORED_NAMES, parts: tuple[str, ...] = IGNORED_PARTS) -> Column:
    """A part of the path is an ignored name, or the file name contains an ignored part."""
    exact = F.arrays_overlap(F.split(_c(path), "/"), F.array(*[F.lit(n) for n in sorted(names)]))
    name = basename(path)
    return reduce(lambda a, b: a | b, [name.contains(p) for p in parts], exact)


def is_test_file(path: Column | str) -> Column:
    return F.replace(_c(path), F.lit("\\"), F.lit("/")).rlike(TEST_PATH)


def mentions_tests(query: Column | str) -> Column:
    return _c(query).rlike(TEST_QUERY)


def resolve_intent(intent: Column | str) -> Column:
    """Canonical intent; aliases are followed, what is unknown, blank or null is the default."""
    known = {k: k for k in INTENTS} | INTENT_ALIASES
    table = F.create_map(*[F.lit(x) for pair in sorted(known.items()) for x in pair])
    return F.coalesce(F.element_at(table, F.lower(strip(intent))), F.lit(DEFAULT_INTENT))


def token_budget(requested: Column | str, configured: int) -> Column:
    """The request within its limits; null means the configured budget."""
    r = _c(requested)
    low = 1 if configured < 256 else 256
    return F.when(r.isNull(), F.lit(configured)).otherwise(F.greatest(F.lit(low), F.least(r, F.lit(configured))))


def type_refs(signature: Column | str) -> Column:
    """Sorted distinct capitalised names of two characters or more that aren't built in."""
    found = F.regexp_extract_all(_c(signature), F.lit(r"(?U)\b([A-Z]\w+)\b"), F.lit(1))
    return F.array_sort(F.array_except(F.array_distinct(found), F.array(*[F.lit(n) for n in sorted(BUILTIN_TYPES)])))


def imported_symbols(imports: Column | str) -> Column:
    """Names that import statements bring in: those in braces, else those after `from x import`.

    `as` keeps the name before it, `*` is nothing, and parentheses stay part of a name.
    """

    def names(statement: Column) -> Column:
        braces = F.regexp_extract(statement, r"import(?:\s+type)?\s+[{]([^}]+)[}]", 1)
        plain = F.regexp_extract(statement, r"from\s+[^\s]+\s+import\s+([^#\n]+)(?:#|\Z)", 1)
        listed = F.split(F.when(braces != "", braces).otherwise(plain), ",")
        stripped = F.transform(listed, lambda n: strip(F.split(strip(n), " as ")[0]))
        return F.filter(stripped, lambda n: (n != "") & ((n != "*") | (braces != "")))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(_c(imports), names))))


def module_names(imports: Column | str) -> Column:
    """Top-level modules in the order of first mention, of the statements that one of four forms fits."""
    forms = (r"^import\s+(\w+)", r"^from\s+([.\w]+)\s+import", *(rf"^{word}\s+[\"'](.+?)[\"']" for word in ("import", "from")))

    def module(statement: Column) -> Column:
        s = strip(statement)
        first = F.coalesce(*[F.when(F.regexp_extract(s, f, 1) != "", F.regexp_extract(s, f, 1)) for f in forms])
        return F.split(first, r"\.")[0]

    return F.array_distinct(F.filter(F.transform(_c(imports), module), lambda m: m.isNotNull() & (m != "")))


def line_count(text: Column | str) -> Column:
    """Line feeds plus one, so an empty text has one line."""
    return (F.size(F.split(_c(text), "\n", -1))).cast("long")


def chunk_id(*columns: Column | str) -> Column:
    return F.xxhash64(*columns)


def embedding_text(language: Column | str = "language") -> Column:
    """What is embedded for a chunk: a line of context, then the text."""
    meta = F.col("context_metadata")
    named = lambda name, value: F.when(value.isNotNull() & (value != ""), F.concat(F.lit(name + "="), value))
    head = F.concat_ws(
        " | ",
        F.concat(F.lit("filepath="), F.col("filepath")),
        F.concat(F.lit("language="), _c(language)),
        F.concat(F.lit("chunk_type="), F.col("chunk_type")),
        named("symbol", F.col("symbol_name")),
        named("parent_class", meta["parent_class"]),
        named("imports", F.array_join(F.slice(F.coalesce(meta["imports"], F.array().cast("array<string>")), 1, 5), "; ")),
        named("signature", meta["signature"]),
    )
    return F.concat(F.lit("[context] "), head, F.lit("\n"), F.col("chunk_text"))


def format_result() -> Column:
    """A result as a fenced block under a line that says where it is from."""
    modules = F.array_join(module_names(F.slice(F.coalesce(F.col("imports"), F.array().cast("array<string>")), 1, 5)), ", ")
    head = F.concat_ws(
        " | ",
        F.when(F.col("is_cross_file_ref"), F.lit("[Referenced Type]")),
        F.concat(F.lit("File: "), F.col("filepath"), F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string")),
        F.when(F.col("symbol_name").isNotNull() & (F.col("symbol_name") != ""), F.concat(F.lit("Symbol: "), F.col("symbol_name"))),
        F.concat(F.lit("Type: "), F.col("chunk_type")),
        F.when(modules != "", F.concat(F.lit("Imports: "), modules)),
    )
    return F.concat(F.lit("```\n"), head, F.lit("\n---\n"), F.col("chunk_text"), F.lit("\n```"))


def slug(title: Column | str) -> Column:
    """Lower case, letters, digits and single hyphens, at most 50 characters."""
    s = F.regexp_replace(F.lower(_c(title)), r"[^\p{L}\p{M}\p{N}_\s-]", "")
    s = F.regexp_replace(F.regexp_replace(s, r"[\s_]+", "-"), r"-+", "-")
    return F.substring(F.regexp_replace(s, r"^-+|-+$", ""), 1, 50)


def chapter_title(order: Column | str, title: Column, h1: Column, h2: Column, h3: Column) -> Column:
    """The item's own title, else the first heading of under 200 characters, else its number."""
    short = lambda h: F.when((h != "") & (F.length(h) < 200), h)
    own = F.when(title != "", title)
    return F.coalesce(own, short(h1), short(h2), short(h3), F.concat(F.lit("Section "), (_c(order) + 1).cast("string")))
