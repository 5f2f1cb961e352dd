"""Line-first quality rules, in DataFrame operations only.

Each line with a word is tried against three rules, and lines that fail one are
removed:

* punctuation: more than one symbol of SYMBOLS, or more than one exclamation
  mark, for every five words; or under 10 words and no terminal mark at the end;
* navigation: the whole line is a menu word, or parts between separators
  (|, >, », •) are 3 words long at most on average;
* boilerplate: it holds a stock phrase of web pages.

Signs of structure (marks, separators, short lines) hold in any language;
terminal marks are those of many scripts. The menu words and phrases are English
and one more sign only.

A document is then rejected if what is left has under half of its word
characters, or if the base rules reject it: under MIN_WORDS words, or over half
of the words in 3-word windows that occur twice or more in the text.

Everything is computed inside a row, in time linear in the text but for one
sort of its windows; there is no shuffle, so hot sources and copies do not
matter.

Cases: a null text counts as one without words (kept false). Null ids and
repeated rows are passed through, a result row for each input row. An empty
table gives an empty result. Input columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
SPACES = r"\x20\x09-\x0D"  # the same in a character class
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
SHORT_LINE = 10

# Menu words that make up a whole line, and stock phrases of web pages.
MENU = ["home", "menu", "login", "log in", "sign in", "sign up", "register", "next", "previous", "next page", "back to top", "read more", "share", "contact", "contact us", "about", "about us", "search", "sitemap", "skip to content"]
PHRASES = ["cookie", "javascript", "all rights reserved", "terms of use", "terms of service", "privacy policy", "lorem ipsum", "subscribe to our newsletter", "click here", "add to cart", "powered by"]

# Marks that end a sentence or quote, in Latin, Greek, CJK, Arabic, Devanagari, Armenian and Ethiopic script.
TERMINAL = """.!?…:;。！？；：｡｣」』）"'”’»›)]؟۔।॥։።፧"""
MENU_LINE = r"(?i)^[^\p{L}]*(" + "|".join(MENU) + r")[^\p{L}]*$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, whatever the body's use of it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than the six ASCII spaces."""
    return F.array_remove(F.split(text, f"[{SPACES}]+"), "")


def _count(text: Column, characters: str) -> Column:
    # not by translate(), which looks each character up in a map of strings
    return F.regexp_count(text, F.lit(f"[{characters}]"))


def _has_word(line: Column) -> Column:
    return line.rlike(f"[^{SPACES}]")


def line_passes(line: Column) -> Column:
    """Whether a line with a word meets the three rules."""
    n = F.regexp_count(line, F.lit(f"[^{SPACES}]+"))
    marks = _count(line, SYMBOLS)
    parts = _count(line, "|>»•") + 1
    ended = F.instr(F.lit(TERMINAL), F.right(F.rtrim(line, F.lit(SPACE)), F.lit(1))) > 0
    calls = F.length(line) - F.length(F.replace(line, F.lit("!"), F.lit("")))
    punctuation = (marks * 5 <= n) & (calls * 5 <= n + 4) & ((n >= SHORT_LINE) | ended)
    navigation = ~line.rlike(MENU_LINE) & ((parts == 1) | (parts * 3 < n))
    return punctuation & navigation & ~let(F.lower(line), lambda x: reduce(lambda a, b: a | b, [x.contains(p) for p in PHRASES]))


def repeated_words(words: Column, window: int = 3) -> Column:
    """How many words lie in windows that occur twice or more.

    Window hashes are sorted with their positions in the low bits; neighbours
    with the same whole hash are repeats. Should two unlike windows share the
    bits that are left of the hash, one may stand between equal ones; then
    hashes and positions are sorted as pairs.
    """

    def covered(w: Column) -> Column:
        n = F.size(w)
        hashes = F.transform(F.sequence(F.lit(0), n - window), lambda i: F.xxhash64(*[w[i + k] for k in range(window)]))
        return let(hashes, lambda h: let(F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(n))) - 1, lambda low: ranked(h, low)))

    def ranked(h: Column, low: Column) -> Column:
        packed = F.transform(h, lambda x, i: x.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long")))
        return let(F.sort_array(packed), lambda s: F.when(mixed(h, low, s), in_pairs(h, low)).otherwise(spread(h, low, s)))

    def mixed(h: Column, low: Column, s: Column) -> Column:
        def odd(p: Column, k: Column) -> Column:
            q = F.get(s, k + 1)
            same = p.bitwiseXOR(q).bitwiseAND(F.bitwise_not(low)) == 0
            return same & (h[p.bitwiseAND(low).cast("int")] != h[q.bitwiseAND(low).cast("int")])

        return F.exists(F.transform(s, lambda p, k: F.when(k < F.size(s) - 1, odd(p, k)).otherwise(False)), lambda x: x)

    def in_pairs(h: Column, low: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.cast("long").alias("i"))))
        return spread(h, low, F.transform(pairs, lambda p: p["i"]))

    def spread(h: Column, low: Column, s: Column) -> Column:
        last = F.size(s) - 1

        def at(k: Column) -> Column:
            return h[F.get(s, k).bitwiseAND(low).cast("int")]

        def repeat(p: Column, k: Column) -> Column:
            own = h[p.bitwiseAND(low).cast("int")]
            before = F.when(k > 0, at(k - 1) == own).otherwise(False)
            after = F.when(k < last, at(k + 1) == own).otherwise(False)
            return F.when(before | after, p.bitwiseAND(low).cast("int")).otherwise(-1)

        places = F.sort_array(F.filter(F.transform(s, repeat), lambda p: p >= 0))
        return let(places, total)

    def total(p: Column) -> Column:
        gaps = F.transform(p, lambda x, k: F.when(k < F.size(p) - 1, F.least(F.lit(window), p[k + 1] - x)).otherwise(window))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    return let(words, lambda w: F.when(F.size(w) <= window, F.lit(0).cast("long")).otherwise(covered(w)))


def _judged(text: Column) -> Column:
    def with_words(w: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), _has_word)
        return let(lines, lambda ls: with_lines(w, ls))

    def with_lines(w: Column, ls: Column) -> Column:
        return let(F.filter(ls, line_passes), lambda good: result(w, ls, good))

    def result(w: Column, ls: Column, good: Column) -> Column:
        solid = F.length(F.array_join(w, ""))
        left = F.length(F.regexp_replace(F.array_join(good, ""), f"[{SPACES}]+", ""))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            solid.cast("long").alias("word_chars"),
            _count(text, SYMBOLS).cast("long").alias("n_symbols"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
            left.cast("long").alias("left_chars"),
            F.array_join(good, "\n").alias("clean_text"),
        )

    return let(words_of(text), with_words)


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_left: int = 50) -> DataFrame:
    """Counts, verdicts and the cleaned text of each row of df; min_left in percent."""
    # a generator, since the planner would work out a struct anew for each of its fields
    judged = df.select(F.col(f"`{id_col}`").alias("_id"), F.inline(F.array(_judged(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))))
    fails = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select(
        F.col("_id").alias(id_col),
        *("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"),
        fails.alias("base_failed"),
        (~fails & (100 * F.col("left_chars") >= min_left * F.col("word_chars"))).alias("kept"),
        "left_chars",
        "clean_text",
    )
