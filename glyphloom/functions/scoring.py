"""Scores of generated text and id sequences, and prompt cutting."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphloom.functions import patterns as p
from glyphloom.functions import text as t

BRACKETS = {")": "(", "]": "[", "}": "{"}
QUOTES = ('"', "'", "`")


def nonempty_content(text: Column) -> Column:
    """Something is left without private-use characters, metaspace and white space."""
    left = F.regexp_replace(text, rf"(?U)[{p.PUA_WIDE}{p.METASPACE}\s]", "")
    return F.coalesce(F.length(left) > 0, F.lit(False))


def lower_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")


def repetition_rate(text: Column, n: int = 2) -> Column:
    """1 - distinct / all word n-grams; 0 when there are fewer than ``n`` words."""
    def rate(words: Column) -> Column:
        # Words hold no white space, so the joined form stands for the n-gram, and
        # strings, unlike arrays, are told apart by hash.
        grams = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)),
                            lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))
        return t.let(grams, lambda g: F.lit(1.0) - F.size(F.array_distinct(g)) / F.size(g))

    return t.let(lower_words(text), lambda w: F.when(F.size(w) >= n, rate(w)).otherwise(F.lit(0.0)))


def tokens_before_collapse(ids: Column, max_consecutive: int = 3) -> Column:
    """Start of the first run longer than ``max_consecutive``, else the length."""
    def start(xs: Column) -> Column:
        hits = F.filter(
            F.sequence(F.lit(0), F.size(xs) - 1),
            lambda i: (i >= max_consecutive) & F.forall(
                F.sequence(F.lit(1), F.lit(max_consecutive)),
                lambda k: F.get(xs, i - k) == F.get(xs, i)))
        return F.coalesce(F.get(hits, F.lit(0)) - max_consecutive, F.size(xs))

    return t.let(ids, lambda xs: F.when(F.size(xs) > 0, start(xs)).otherwise(F.lit(0)))


def truncate_generation(ids: Column, sep: Column, cap: int) -> Column:
    """Ids up to and including the first stop: ``sep``, a fourth equal id in a row, or ``cap``."""
    def cut(xs: Column) -> Column:
        stops = F.filter(
            F.sequence(F.lit(0), F.size(xs) - 1),
            lambda i: (F.get(xs, i) == sep) | ((i >= 3) & F.forall(
                F.sequence(F.lit(1), F.lit(3)), lambda k: F.get(xs, i - k) == F.get(xs, i))))
        n = F.least(F.coalesce(F.get(stops, F.lit(0)) + 1, F.size(xs)), F.lit(cap))
        return F.slice(xs, F.lit(1), n)

    return t.let(ids, lambda xs: F.when(F.size(xs) > 0, cut(xs)).otherwise(xs))


def prose_prompt(text: Column) -> Column:
    """First 50 characters, cut at their last space when it lies past index 20.

    Null for texts of 60 characters or fewer.
    """
    head = F.substring(text, 1, 50)
    cut = F.regexp_extract(head, "(?s)^(.{21,}) ", 1)
    return F.when(F.length(text) > 60, F.when(cut != "", cut).otherwise(head))


def prose_target(text: Column) -> Column:
    return F.substring(text, F.length(prose_prompt(text)) + 1, F.length(text))


def code_prompt(code: Column) -> Column:
    """First line when it opens a Python or Go function, else null."""
    line = F.split(code, "\n", 2)[0]
    bare = F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
    python = bare.startswith("def ") & bare.endswith(":")
    return F.when(python | bare.startswith("func "), line)


def code_target(code: Column) -> Column:
    return F.coalesce(F.get(F.split(code, "\n", 2), F.lit(1)), F.lit(""))


def go_source(prompt: Column, completion: Column) -> Column:
    """Prompt and completion as a Go file; a missing closing brace is added."""
    full = F.concat(F.lit("package main\n\n"), prompt, F.lit(" "), completion)
    closed = F.regexp_like(full, F.lit(r"(?U)\}\s*$"))
    return F.when(closed, full).otherwise(F.concat(full, F.lit("\n}")))


def brackets_balanced(code: Column) -> Column:
    """Brackets nest and quotes close; quoted text and escaped characters are skipped.

    Only brackets, quotes and backslashes decide, so all else is dropped first,
    save one character after each backslash.
    """
    signs = F.regexp_extract_all(code, F.lit(r"(?s)\\.?|[()\[\]{}\"'`]"), F.lit(0))
    state = F.expr("named_struct('open', '', 'quote', '', 'bad', false)")

    def step(acc: Column, c: Column) -> Column:
        def with_(open_=None, quote=None, bad=None) -> Column:
            return F.struct(
                (acc["open"] if open_ is None else open_).alias("open"),
                (acc["quote"] if quote is None else quote).alias("quote"),
                (acc["bad"] if bad is None else bad).alias("bad"))

        expected = F.lit(None).cast("string")
        for close, opening in BRACKETS.items():
            expected = F.when(c == close, F.lit(opening)).otherwise(expected)
        top = F.substring(acc["open"], 1, 1)  # the stack grows at the front
        pops = with_(open_=F.substring(acc["open"], F.lit(2), F.length(acc["open"])))
        return (F.when(acc["bad"] | c.startswith("\\"), acc)
                .when(acc["quote"] != "", F.when(c == acc["quote"], with_(quote=F.lit(""))).otherwise(acc))
                .when(c.isin(*QUOTES), with_(quote=c))
                .when(c.isin(*BRACKETS.values()), with_(open_=F.concat(c, acc["open"])))
                .otherwise(F.when(top == expected, pops).otherwise(with_(bad=F.lit(True)))))

    return F.aggregate(signs, state, step,
                       lambda s: ~s["bad"] & (s["quote"] == "") & (s["open"] == ""))
