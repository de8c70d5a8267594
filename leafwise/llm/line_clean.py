"""Line-first cleaning with DataFrame functions only.

Every line with a word is judged on its own; failing lines go; a document that loses too much of its
text that way is rejected, as is one that fails the base rules on the whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwise.functions.frames import settle

BLANKS = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"
BLANK_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MARKS = "#*$%&|<>!?~^=_"
SEPARATORS = "|»›•·→"
FINISHED = "[.!?…:;\"'”’»)\\]][\\x20\\x09-\\x0D]*\\z"
BOILERPLATE = (
    "all rights reserved|copyright ©|terms of (use|service)|privacy policy|cookie policy|use cookies|enable javascript"
    "|licensed under|released under the|click here|read more|sign in|log in|subscribe to|share (this|on)|powered by"
    "|skip to (content|main)|back to top|lorem ipsum"
)
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT = 20  # per cent of words in repeated windows
SHORT_LINE = 10  # a line with fewer words must end with a mark
BOILERPLATE_WORDS = 30  # boilerplate is looked for in lines with fewer words
MAX_LOSS = 30  # per cent of word characters that lines may take away


def count_of(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are in ``chars``."""
    return F.char_length(text) - F.char_length(F.translate(text, chars, ""))


def line_fails(line: Column) -> Column:
    """Whether a line with a word breaks a rule: unfinished, mostly marks, navigation or boilerplate."""
    n = F.regexp_count(line, F.lit(WORD))
    marks, separators = count_of(line, MARKS), count_of(line, SEPARATORS)
    return (
        ((n < SHORT_LINE) & ~F.rlike(line, F.lit(FINISHED)))
        | ((marks >= 3) & (2 * marks > n))
        | ((separators >= 3) & (3 * separators >= n))
        | ((n < BOILERPLATE_WORDS) & F.rlike(F.lower(line), F.lit(BOILERPLATE)))
    )


def repeated_words(windows: Column) -> Column:
    """Words covered by windows that stand twice or more, from the hashes of all windows in order.

    Hashes are sorted with their places; equal neighbours mark repeated windows; the gaps between
    their places give the words covered. Documents without a repeated hash skip all that.
    """
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = F.transform(
        F.array(pairs),
        lambda p: F.filter(
            p,
            lambda x, k: F.coalesce(F.get(p, k - 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get(p, k + 1)["h"] == x["h"], F.lit(False)),
        ),
    )[0]
    places = F.array_sort(F.transform(twice, lambda x: x["i"]))
    covered = F.transform(
        F.array(places),
        lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.coalesce(F.least(F.get(p, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))),
            F.lit(0),
            lambda total, x: total + x,
        ),
    )[0]
    none = windows.isNull() | (F.size(F.array_distinct(windows)) == F.size(windows))
    return F.when(none, F.lit(0)).otherwise(covered)


def clean_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measures, ``base_failed``, ``kept`` and ``clean_text`` to ``docs``.

    Measures (long): ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars``. ``clean_text`` is
    the text without failing lines; lines without a word stay. A null text has no words and is rejected;
    its ``clean_text`` is empty. Rows are judged alone, so repeated rows, ties and empty tables need no rule; other
    columns are kept, those with a name added here are replaced. Windows are compared by 64-bit hashes within one
    document.
    """
    added = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", "base_failed", "kept", "clean_text")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in added]
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    cut = docs.select(
        *kept,
        whole.alias("__text"),
        F.filter(F.split(whole, BLANKS), lambda w: w != "").alias("__words"),
        F.split(whole, "\n").alias("__lines"),
    )
    size = F.size("__words")
    windows = F.when(
        size >= WINDOW,
        F.transform(F.sequence(F.lit(0), size - WINDOW), lambda i: F.xxhash64(*[F.get("__words", i + k) for k in range(WINDOW)])),
    )
    has_word = lambda line: F.rlike(line, F.lit(WORD))
    worded = F.filter("__lines", has_word)
    measured = cut.select(
        *kept,
        "__text",
        "__lines",
        size.alias("n_words"),
        windows.alias("__windows"),
        worded.alias("__worded"),
        F.filter(worded, line_fails).alias("__failed"),
    )
    chars = lambda c: F.char_length(F.translate(c, BLANK_CHARS, ""))
    # Settled, so that a filter on a result is never rewritten into these formulas.
    counted = settle(
        measured,
        {
            "n_words": F.col("n_words").cast("long"),
            "word_chars": chars(F.col("__text")).cast("long"),
            "n_symbols": count_of(F.col("__text"), SYMBOLS).cast("long"),
            "n_dup_lines": (F.size("__worded") - F.size(F.array_distinct("__worded"))).cast("long"),
            "n_repeat_words": repeated_words(F.col("__windows")).cast("long"),
            "lost_chars": F.aggregate("__failed", F.lit(0), lambda total, line: total + chars(line)).cast("long"),
            "clean_text": F.when(F.size("__failed") == 0, F.col("__text")).otherwise(
                F.array_join(F.filter("__lines", lambda line: ~has_word(line) | ~line_fails(line)), "\n")
            ),
        },
    )
    counted = counted.select(*kept, *added[:6], "clean_text")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    lossy = 100 * F.col("lost_chars") > MAX_LOSS * F.col("word_chars")
    return counted.withColumn("base_failed", failed).withColumn("kept", ~failed & ~lossy)


def _sql_text(value: str) -> str:
    return value.replace("'", "''")


#: DuckDB SQL: the table ``lines_judged`` (rid, doc_id, t, measures, base_failed, kept, clean_text) over ``documents``.
JUDGED_SQL = f"""
  rows_ AS (SELECT row_number() OVER () AS rid, *, coalesce(text, '') AS t FROM {{docs}}),
  cut_ AS (SELECT rid, t, regexp_extract_all(t, '{WORD}') AS ws FROM rows_),
  win_ AS (SELECT rid, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS win
           FROM (SELECT rid, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM cut_)),
  twice_ AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM win_) WHERE n > 1),
  cover_ AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + {WINDOW})) AS p FROM twice_)
             GROUP BY rid),
  line_ AS (SELECT rid, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS k
            FROM rows_),
  sized_ AS (SELECT *, len(regexp_extract_all(line, '{WORD}')) AS n,
               length(line) - length(translate(line, '{MARKS}', '')) AS marks,
               length(line) - length(translate(line, '{SEPARATORS}', '')) AS seps,
               length(regexp_replace(line, '{BLANKS}', '', 'g')) AS chars FROM line_),
  fail_ AS (SELECT *, n > 0 AND ((n < {SHORT_LINE} AND NOT regexp_matches(line, '{_sql_text(FINISHED)}'))
               OR (marks >= 3 AND 2 * marks > n) OR (seps >= 3 AND 3 * seps >= n)
               OR (n < {BOILERPLATE_WORDS} AND regexp_matches(lower(line), '{BOILERPLATE}'))) AS bad FROM sized_),
  doc_ AS (SELECT rid, coalesce(sum(n), 0)::BIGINT AS n_words, coalesce(sum(chars), 0)::BIGINT AS word_chars,
             (count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0))::BIGINT AS n_dup_lines,
             coalesce(sum(chars) FILTER (bad), 0)::BIGINT AS lost_chars,
             coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT bad), '') AS clean_text FROM fail_ GROUP BY rid),
  base_ AS (SELECT r.*, n_words, word_chars, (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
              n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, lost_chars, clean_text
            FROM rows_ r JOIN doc_ USING (rid) LEFT JOIN cover_ c USING (rid)),
  lines_judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed,
      NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words)
      AND 100 * lost_chars <= {MAX_LOSS} * word_chars AS kept FROM base_)"""
OUT = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept"
SQL = f"WITH {JUDGED_SQL.format(docs='documents')} SELECT {OUT} FROM lines_judged"
