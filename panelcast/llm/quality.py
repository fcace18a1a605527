"""Line-first cleaning with DataFrame functions only.

Every line is judged by punctuation, navigation and boilerplate rules; failing lines are removed,
and a document that loses too much of its text is rejected. Documents also carry the base counts.

Defined cases: a null text counts as empty (no words, rejected); a text without lines that hold a
word keeps nothing; very long texts are judged whole (all work is on arrays of the row); repeated
rows are judged alike; an empty table gives an empty result; extra columns pass through ``judge``.
Two different 8-word windows count as equal only if their 64-bit hashes collide within one text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import WORD

MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_SHARE = 30          # per cent of words in repeated windows
#: A document is kept when its surviving lines hold at least this share of its words.
MIN_KEPT_SHARE = 0.5
#: Line rules; a line fails on any of them.
MAX_MARK_SHARE = 0.2           # punctuation and navigation: menu separators, symbol and shout runs against words
MIN_END_WORDS = 4              # punctuation: a line of at least so many words needs a sentence mark
NOTICE_WORDS = 30              # boilerplate: a notice is a line of at most so many words
# fixed values: symbols, sentence marks, menu separators, phrases of notices and licence lines
SYMBOLS = r"[#*$%&|<>]"
SENTENCE_MARK = r"[.!?…。！？:;,][\"'”’)\]]*([\x20\x09-\x0D]|$)"
MARKS = r"[#*$%&<>]{2,}|[!?]{2,}|[|»•·>](?=[\x20\x09-\x0D]|$)"
MARK_SIGNS = r"[#*$%&<>!?|»•·]"  # any sign that MARKS can begin with
BOILERPLATE = (r"\b(all rights reserved|cookie policy|privacy policy|terms of (use|service)|accept cookies|"
               r"subscribe to|sign in|log in|click here|read more|share this|follow us|powered by|skip to content|"
               r"lorem ipsum|enable javascript|licensed under|released under the)\b")
BLANK = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row instead of at each mention."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words covered by windows that occur twice or more in ``words``, the first one included."""
    def doubled(hashes: Column, step: int) -> Column:
        """Hashes of twice as long windows; those over the end are cut off below."""
        return _once(hashes, lambda h: F.zip_with(h, F.slice(h, step + 1, F.greatest(F.size(h), F.lit(1))), lambda x, y: F.xxhash64(x, y)))

    def of_hashes(hashes: Column) -> Column:
        at = _once(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), repeated_starts)
        total = _once(at, lambda a: F.aggregate(
            F.transform(a, lambda p, k: F.coalesce(F.least(F.get(a, k + 1) - p, F.lit(window)), F.lit(window))), F.lit(0), lambda acc, x: acc + x))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), total).otherwise(F.lit(0)).cast("long")

    def repeated_starts(s: Column) -> Column:
        """Starts, in order, of the windows whose hash stands next to an equal one."""
        last = F.size(s) - 1
        equal = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k < last) & (F.get(s, k + 1)["h"] == x["h"])))
        return F.sort_array(F.transform(equal, lambda x: x["i"]))

    n = F.size(words) - (window - 1)
    hashes, length = F.transform(words, lambda w: F.xxhash64(w)), 1
    while length < window:  # the window is a power of two: 1, 2, 4, 8 words
        hashes, length = doubled(hashes, length), 2 * length
    return F.when(n > 1, _once(F.slice(hashes, 1, F.greatest(n, F.lit(1))), of_hashes)).otherwise(F.lit(0).cast("long"))


def line_passes(line: Column, n_words: Column) -> Column:
    """The line rules for a line with ``n_words`` (one or more) words."""
    return (((n_words < MIN_END_WORDS) | line.rlike(SENTENCE_MARK))
            & (~line.rlike(MARK_SIGNS) | (F.size(F.split(line, MARKS)) - 1 <= MAX_MARK_SHARE * n_words))
            & ((n_words > NOTICE_WORDS) | ~F.lower(line).rlike(BOILERPLATE)))


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``quality``: a struct of the counts, the cleaned text, base_failed and kept."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    worded = F.filter(F.split(t, "\n"), lambda line: line.rlike(WORD))
    lines = F.transform(worded, lambda line: F.struct(line.alias("line"), F.split(F.btrim(line, F.lit(BLANKS)), BLANK).alias("words")))
    step = docs.withColumn("__lines", lines)
    at = F.col("__lines")
    judged = F.transform(at, lambda x: F.struct(x["line"].alias("line"), F.size(x["words"]).alias("n"),
                                                line_passes(x["line"], F.size(x["words"])).alias("ok")))
    words = F.flatten(F.transform(at, lambda x: x["words"]))
    step = step.withColumn("__q", _once(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        repeat_words(w).alias("n_repeat_words")))).withColumn("__judged", judged)
    q, ok = F.col("__q"), F.filter(F.col("__judged"), lambda x: x["ok"])
    step = step.withColumn("__ok", ok)
    kept_words = F.aggregate(F.col("__ok"), F.lit(0), lambda acc, x: acc + x["n"])
    base_failed = (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEAT_SHARE * q["n_words"])
    step = step.withColumn("__kept_words", kept_words.cast("long"))
    return step.withColumn("quality", F.struct(
        q["n_words"].alias("n_words"), q["word_chars"].alias("word_chars"),
        (F.size(F.split(t, SYMBOLS)) - 1).cast("long").alias("n_symbols"),
        (F.size(at) - F.size(F.array_distinct(F.transform(at, lambda x: x["line"])))).cast("long").alias("n_dup_lines"),
        q["n_repeat_words"].alias("n_repeat_words"), base_failed.alias("base_failed"),
        (~base_failed & (F.col("__kept_words") >= MIN_KEPT_SHARE * q["n_words"])).alias("kept"),
        F.size(at).cast("long").alias("n_lines"), F.size("__ok").cast("long").alias("n_lines_kept"), F.col("__kept_words").alias("n_words_kept"),
        F.array_join(F.transform(F.col("__ok"), lambda x: x["line"]), "\n").alias("clean_text"))
    ).drop("__lines", "__q", "__judged", "__ok", "__kept_words")


def report(docs: DataFrame) -> DataFrame:
    """One row per document: counts and verdict, without the texts."""
    q = judge(docs.select("doc_id", "text"))
    return q.select("doc_id", *[F.col("quality")[c].alias(c) for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_lines_kept", "n_words_kept")])


#: DuckDB form of :func:`report`, by relational windows over words and lines.
REPORT_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, string_split_regex(trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g'), ' '), ' ') AS ws FROM t),
n AS (SELECT rid, list_filter(ws, lambda x: x <> '') AS ws FROM w),
win AS (SELECT rid, unnest(range(1, len(ws) - 6)) AS i, ws FROM n WHERE len(ws) >= 8),
winh AS (SELECT rid, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS k FROM win),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM winh) WHERE c > 1),
cov AS (SELECT rid, sum(least(8, coalesce(nxt - i, 8))) AS c FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM rep) GROUP BY rid),
l AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM t),
lw AS (SELECT rid, line, len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS nw FROM l),
lj AS (SELECT rid, line, nw, (nw < 4 OR regexp_matches(line, '[.!?…。！？:;,]["''”’)\]]*([\x20\x09-\x0D]|$)'))
         AND len(regexp_extract_all(line, '[#*$%&<>]{2,}|[!?]{2,}|[|»•·>]([\x20\x09-\x0D]|$)')) <= 0.2 * nw
         AND (nw > 30 OR NOT regexp_matches(lower(line), '\b(all rights reserved|cookie policy|privacy policy|terms of (use|service)|accept cookies|subscribe to|sign in|log in|click here|read more|share this|follow us|powered by|skip to content|lorem ipsum|enable javascript|licensed under|released under the)\b')) AS ok FROM lw WHERE nw > 0),
la AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup, count(*) FILTER (ok) AS n_ok, coalesce(sum(nw) FILTER (ok), 0)::BIGINT AS nw_kept FROM lj GROUP BY rid),
b AS (SELECT t.doc_id, len(n.ws)::BIGINT AS n_words, len(regexp_replace(t.text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        (len(t.text) - len(regexp_replace(t.text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        coalesce(la.n_dup, 0)::BIGINT AS n_dup_lines, coalesce(cov.c, 0)::BIGINT AS n_repeat_words,
        coalesce(la.n_lines, 0)::BIGINT AS n_lines, coalesce(la.n_ok, 0)::BIGINT AS n_lines_kept, coalesce(la.nw_kept, 0)::BIGINT AS n_words_kept
      FROM t JOIN n USING (rid) LEFT JOIN la USING (rid) LEFT JOIN cov USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words_kept >= 0.5 * n_words AS kept,
  n_lines, n_lines_kept, n_words_kept FROM b
"""
