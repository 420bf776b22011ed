"""Text functions as columns: normal forms, tokens, n-grams, word forms, phrase tests."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def collapse(c: Column) -> Column:
    """White space runs as one blank, none at the ends; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def plain(c: Column) -> Column:
    """Lower case, micro signs as u, everything but letters, digits, / and % as one blank."""
    low = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[µμ]", "u")
    return F.trim(F.regexp_replace(low, r"(?U)[^\w/%]+", " "))


def padded(c: Column) -> Column:
    """plain() with a blank at either end, so that `contains` finds whole phrases only."""
    return F.concat(F.lit(" "), plain(c), F.lit(" "))


#: Unicode normal forms have no built-in function: Arrow batches through the standard library.
@F.pandas_udf(StringType())
def folded(c: pd.Series) -> pd.Series:
    """Compatibility form (NFKC), then full case folding."""
    return c.str.normalize("NFKC").str.casefold()


@F.pandas_udf(StringType())
def without_marks(c: pd.Series) -> pd.Series:
    """Decomposed (NFKD), folded, and without combining marks: é as e."""
    return c.str.normalize("NFKD").str.casefold().map(lambda t: "".join(x for x in t if not unicodedata.combining(x)), na_action="ignore")


def search_text(*parts: Column) -> Column:
    """The parts that aren't null, folded, as words with one blank between."""
    return F.trim(F.regexp_replace(folded(F.concat_ws(" ", *parts)), r"(?U)[^\w]+", " "))


def words(c: Column, least: int = 1) -> Column:
    """Lower-case runs of letters and digits, of any script, of at least some length."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), lambda w: F.length(w) >= least)


def joined_words(c: Column) -> Column:
    """Like words, but an apostrophe or hyphen between two of them is inside one."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}\p{N}]+(?:['-][\p{L}\p{N}]+)*)"), F.lit(1))


def _cut(c: Column, n: int) -> Column:
    return F.substring(c, F.lit(1), F.length(c) - n)


def singular(c: Column) -> Column:
    """berries: berry; apples: apple; glass stays."""
    return F.when(F.endswith(c, F.lit("ies")) & (F.length(c) > 3), F.concat(_cut(c, 3), F.lit("y"))).when(F.endswith(c, F.lit("s")) & ~F.endswith(c, F.lit("ss")) & (F.length(c) > 2), _cut(c, 1)).otherwise(c)


def singular_term(c: Column, irregular: dict[str, str] | None = None) -> Column:
    """For vocabulary terms: longer words only, and none in -us; irregular ones by a table."""
    rule = F.when(F.endswith(c, F.lit("ies")) & (F.length(c) > 5), F.concat(_cut(c, 3), F.lit("y"))).when(F.endswith(c, F.lit("s")) & ~F.endswith(c, F.lit("ss")) & ~F.endswith(c, F.lit("us")) & (F.length(c) > 4), _cut(c, 1)).otherwise(c)
    return rule if not irregular else F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in irregular.items() for x in kv]), c), rule)


def singular_token(c: Column) -> Column:
    """For typed tokens: also potatoes: potato, and none in -us or -is."""
    ends = lambda x: F.endswith(c, F.lit(x))
    rule = F.when(ends("ies") & (F.length(c) > 4), F.concat(_cut(c, 3), F.lit("y"))).when(ends("oes") & (F.length(c) > 4), _cut(c, 2))
    return rule.when(ends("s") & (F.length(c) > 3) & ~ends("ss") & ~ends("us") & ~ends("is"), _cut(c, 1)).otherwise(c)


def singular_known(c: Column, keep: tuple[str, ...]) -> Column:
    """singular(), but some tokens are left as they are."""
    return F.when(c.isin(*keep), c).otherwise(singular(c))


def token_variants(c: Column) -> Column:
    """A token, its singular and the plurals that could be made of it."""
    s = singular_token(c)
    made = F.array(c, s, F.concat(s, F.lit("s")), F.concat(s, F.lit("oes")), F.when(F.endswith(s, F.lit("y")), F.concat(_cut(s, 1), F.lit("ies"))))
    return F.array_distinct(F.filter(made, lambda x: F.length(x) >= 2))


def deletion_variants(c: Column) -> Column:
    """A token of four or more letters with each one left out, where three or more remain."""
    n = F.length(c)
    out = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, n)))
    return F.when(n >= 4, F.array_distinct(F.filter(out, lambda x: F.length(x) >= 3))).otherwise(F.array().cast("array<string>"))


def edge_ngrams(c: Column, stop: tuple[str, ...], least: int = 3) -> Column:
    """Runs of two and of three words whose first and last aren't stop words; a word has letters alone, `least` or more."""
    w = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(rf"\b([a-z]{{{least},}})\b"), F.lit(1))
    ends = lambda run: ~F.substring_index(run, " ", 1).isin(*stop) & ~F.substring_index(run, " ", -1).isin(*stop)
    return bound(w, lambda t: F.filter(F.concat(_runs(t, 2), _runs(t, 3)), ends))


def table_label(c: Column) -> Column:
    """`Table 3A` of a text that names a table; null of others."""
    n = F.regexp_extract(F.coalesce(c, F.lit("")), r"(?iU)\b(?:table|tablo|çizelge)\s*[.:#-]?\s*([0-9]+[A-Za-z]?)", 1)
    return F.when(n != "", F.concat(F.lit("Table "), F.upper(n)))


def page_hint(c: Column) -> Column:
    """The page that a text names, or is; null of others and of page 0."""
    text = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    n = F.when(text.rlike("^[0-9]{1,4}$"), text).otherwise(F.regexp_extract(text, r"(?iU)\b(?:p(?:age)?\.?|sayfa)\s*([0-9]{1,4})\b", 1)).try_cast("int")
    return F.when(n > 0, n)


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c computed once for each row, however often a lambda inside f uses it."""
    return F.transform(F.array(c), f)[0]


def _runs(tokens: Column, n: int) -> Column:
    last = F.size(tokens) - n + 1
    joined = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(last >= 1, joined).otherwise(F.array().cast("array<string>"))


def with_runs(d: DataFrame, listed: Column, out: str, of: Callable[[Column, Column], Column]) -> DataFrame:
    """d with the list of of(x, the structs of ``listed`` whose first field is x), for each distinct x in order: a grouping inside each
    row, by sorting its list, without a shuffle and in n log n steps."""
    d = d.withColumn("__sorted", F.sort_array(listed))
    first = d.schema["__sorted"].dataType.elementType.names[0]
    x = lambda i: F.get("__sorted", i)[first]
    begins = F.filter(F.sequence(F.lit(0), F.greatest(F.size("__sorted") - 1, F.lit(0))), lambda i: (i < F.size("__sorted")) & ((i == 0) | (x(i) != x(i - 1))))
    d = d.withColumn("__begin", begins)
    run = lambda b, j: F.slice("__sorted", b + 1, F.coalesce(F.get("__begin", j + 1), F.size("__sorted")) - b)
    return d.withColumn(out, F.transform("__begin", lambda b, j: of(x(b), run(b, j)))).drop("__sorted", "__begin")


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of n tokens, joined with blanks; none if there are fewer."""
    return bound(tokens, lambda t: _runs(t, n))


def distinct_ngrams(tokens: Column, most: int = 3, longest: int = 40) -> Column:
    """n-grams of 1 to `most` tokens in the order they are first seen, up to `longest` characters."""
    every = bound(tokens, lambda t: F.flatten(F.array(*[_runs(t, n) for n in range(1, most + 1)])))
    return F.array_distinct(F.filter(every, lambda x: F.length(x) <= longest))


def first_hits(text: Column, terms: list[str], limit: int | None = None) -> Column:
    """Those terms, in the order given, that a padded text contains."""
    hits = bound(text, lambda x: F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(x, F.concat(F.lit(" "), t, F.lit(" ")))))
    return hits if limit is None else F.slice(hits, 1, limit)


def head_and_tail(c: Column, most: int) -> Column:
    """A long text as its first and last halves of `most` characters, with a mark between."""
    half = most // 2
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, half), F.lit("\n...\n"), F.right(c, F.lit(half)))).otherwise(c)


def one_edit_apart(a: Column, b: Column) -> Column:
    """Whether swapping two neighbouring characters of a gives b."""
    n = F.length(a)
    swaps = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, n)))
    return (n >= 2) & (n == F.length(b)) & F.exists(swaps, lambda x: x == b)
