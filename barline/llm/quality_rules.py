r"""Line-first cleaning rules on native expressions.

Words are ``[^\x20\x09-\x0D]+``. Each line is judged on its own: a line fails when it is
navigation (three or more separators), boilerplate (a fixed phrase in a short line), mostly
punctuation, or long without an ending mark near its end (a few closing quotes, brackets or
marks may follow; the last line of a text may be cut short and needs none). Failed lines are removed; a document that keeps fewer than
``min_kept_pct`` percent of its words is rejected, as is one that fails the base rules.

Repeated 3-word windows are found inside a row: each window's 64-bit hash carries its
position in its low bits, the array is sorted as plain longs, and neighbours with equal high
bits are candidates. Nothing is shuffled. The words of neighbouring candidates are compared;
only where some differ (the hash keeps 64 bits less those of the word count, so chance alone
does it in very long texts) are the row's candidates sorted by their words. The count is exact.

Defined results: null or empty texts have no words, fail the base rules and are not kept; an
empty table gives an empty result; repeated rows are judged alike; other columns pass by,
whatever their names, but for those of the results, which replace them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WHITE, fresh, text_of

MIN_WORDS = 50
MAX_REPEAT_PCT = 50
MIN_KEPT_PCT = 50
#: A line with at least so many words needs an ending mark; a phrase condemns a line of at most so many words.
LONG_LINE, SHORT_LINE = 8, 16
#: Percent of a line's non-blank characters that may be punctuation or symbols.
MAX_MARK_PCT = 20
SEPARATORS = "|›»•·"
SYMBOLS = "#*$%&|<>"
MARKS = "#*$%&|<>!?.,;:=+-_/~^@()[]{}\"'"
ENDINGS = ".!?…:;。！？"
#: What may follow an ending mark.
CLOSING = "\"'”’»)]}*_"
BOILERPLATE = ("we use cookies", "accept cookies", "cookie policy", "cookie settings", "all rights reserved", "enable javascript", "requires javascript", "terms of use", "terms of service", "privacy policy", "lorem ipsum", "subscribe to our newsletter", "sign up for our newsletter", "click here to", "alle rechte vorbehalten", "datenschutzerklärung", "tous droits réservés", "todos los derechos reservados")


def _without(text: Column, chars: str) -> Column:
    """text without some characters; a search for each of a few costs less than a look-up of every character."""
    if len(chars) > 10:
        return F.translate(text, chars, "")
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(_without(text, chars))


def _any(text: Column, parts: tuple[str, ...] | str) -> Column:
    found = F.contains(text, F.lit(parts[0]))
    for p in parts[1:]:
        found = found | F.contains(text, F.lit(p))
    return found


def parted(lines: Column) -> Column:
    """Lines with what several rules look at, made once each."""
    solid = lambda x: F.length(_without(x, WHITE))
    words = lambda x: F.size(F.split(F.trim(x, F.lit(WHITE)), r"[\x20\x09-\x0D]+"))
    return F.transform(lines, lambda x: F.struct(x.alias("line"), F.lower(x).alias("low"), solid(x).alias("solid"), words(x).alias("words")))


def line_fails(x: Column, is_last: Column, long_line: int = LONG_LINE, max_mark_pct: int = MAX_MARK_PCT) -> Column:
    """Whether a line (of `parted`) with at least one word is to be removed; the last line of a text may lack an ending."""
    line = x["line"]
    navigation = _count(line, SEPARATORS) >= 3
    marks = _count(line, MARKS) * 100 > x["solid"] * max_mark_pct
    ended = F.contains(F.lit(ENDINGS), F.right(F.rtrim(line, F.lit(WHITE + CLOSING)), F.lit(1)))
    unended = (x["words"] >= long_line) & ~is_last & ~ended
    return navigation | unended | ((x["words"] <= SHORT_LINE) & _any(x["low"], BOILERPLATE)) | marks


def measured(docs: DataFrame) -> DataFrame:
    """docs with the base measures, words of the removed lines and both verdicts."""
    names = fresh(docs, "_words", "_p", "_s", "_c", "_e", "_d", "_lines", "_n")
    words, p, s, c, e, d, lines, n = names
    text = text_of()
    bare = F.trim(text, F.lit(WHITE))
    df = docs.withColumn(words, F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+")))
    df = df.withColumn(n, F.size(words).cast("long")).withColumn(p, F.expr(f"shiftleft(1L, length(bin({n})))"))
    mask, low = -F.col(p), F.col(p) - 1
    window = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(mask).bitwiseOR(i.cast("long"))
    df = df.withColumn(s, F.sort_array(F.when(F.col(n) >= 3, F.transform(F.sequence(F.lit(0), F.col(n).cast("int") - 3), window)).otherwise(F.array().cast("array<long>"))))
    high = lambda x: x.bitwiseAND(mask)
    twice = lambda x, j: (high(F.get(s, j + 1)).eqNullSafe(high(x))) | ((j > 0) & high(F.get(s, j - 1)).eqNullSafe(high(x)))
    place = lambda x: x.bitwiseAND(low)
    word = lambda x, k: F.get(words, place(x).cast("int") + k)
    differ = lambda x, y: (word(x, 0) != word(y, 0)) | (word(x, 1) != word(y, 1)) | (word(x, 2) != word(y, 2))
    df = df.withColumn(c, F.filter(s, twice))
    mixed = F.size(F.filter(c, lambda x, j: (j > 0) & high(F.get(c, j - 1)).eqNullSafe(high(x)) & differ(F.get(c, j - 1), x))) > 0
    by_words = F.sort_array(F.transform(c, lambda x: F.struct(F.struct(word(x, 0), word(x, 1), word(x, 2)).alias("w"), place(x).alias("at"))))
    same = lambda x, j: (F.get(e, j + 1)["w"].eqNullSafe(x["w"])) | ((j > 0) & F.get(e, j - 1)["w"].eqNullSafe(x["w"]))
    df = df.withColumn(e, F.when(mixed, by_words))
    exact = F.transform(F.filter(e, same), lambda x: x["at"])
    df = df.withColumn(d, F.sort_array(F.when(F.col(e).isNull(), F.transform(c, place)).otherwise(exact)))
    zero = F.lit(0).cast("long")
    covered = F.aggregate(d, F.struct(F.lit(-3).cast("long").alias("last"), zero.alias("n")), lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3).cast("long"), x - a["last"])).alias("n")), lambda a: a["n"])
    df = df.withColumn(lines, F.filter(F.split(text, "\n", -1), lambda x: F.trim(x, F.lit(WHITE)) != ""))
    gone = F.aggregate(F.filter(parted(F.col(lines)), lambda x, i: line_fails(x, i == F.size(lines) - 1)), zero, lambda a, x: a + x["words"])
    return df.withColumns({
        "n_words": F.col(n),
        "word_chars": F.length(_without(text, WHITE)).cast("long"),
        "n_symbols": _count(text, SYMBOLS).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": covered,
        "n_lost_words": gone.cast("long"),
    }).drop(*names)


def quality_rules(docs: DataFrame, min_words: int = MIN_WORDS, max_repeat_pct: int = MAX_REPEAT_PCT, min_kept_pct: int = MIN_KEPT_PCT) -> DataFrame:
    """docs with measures, base_failed and kept."""
    base = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_pct)
    stays = (F.col("n_words") - F.col("n_lost_words")) * 100 >= F.col("n_words") * min_kept_pct
    return measured(docs).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & stays)


def clean_text(docs: DataFrame) -> DataFrame:
    """docs with clean_text: the text without its failed lines (blank lines stay)."""
    parts = parted(F.split(text_of(), "\n", -1))
    blank = lambda x: F.trim(x["line"], F.lit(WHITE)) == ""
    last = F.size(F.split(F.rtrim(text_of(), F.lit(WHITE)), "\n", -1)) - 1
    kept = F.transform(F.filter(parts, lambda x, i: blank(x) | ~line_fails(x, i == last)), lambda x: x["line"])
    return docs.withColumn("clean_text", F.array_join(kept, "\n"))


def op6_quality_rules(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_rules(docs).drop("text")


_Q = lambda s: "'" + s.replace("'", "''") + "'"
OP6_SQL = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) AS white FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
win AS (
  SELECT doc_id, i, list_slice(words, i, i + 2) AS tri
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, tri) > 1),
cover AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
lines AS (
  SELECT doc_id, white, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM t),
real AS (
  SELECT *, trim(line, white) AS bare, translate(line, white, '') AS solid,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
         pos = max(pos) OVER (PARTITION BY doc_id) AS is_last
  FROM lines WHERE trim(line, white) <> ''),
judged AS (
  SELECT *, length(line) - length(translate(line, {_Q(SEPARATORS)}, '')) >= 3
    OR (n <= {SHORT_LINE} AND regexp_matches(lower(line), {_Q("|".join(BOILERPLATE))}))
    OR (length(line) - length(translate(line, {_Q(MARKS)}, ''))) * 100 > length(solid) * {MAX_MARK_PCT}
    OR (n >= {LONG_LINE} AND NOT is_last AND NOT contains({_Q(ENDINGS)}, right(rtrim(line, white || {_Q(CLOSING)}), 1))) AS fails
  FROM real),
by_doc AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines,
         coalesce(sum(n) FILTER (WHERE fails), 0)::BIGINT AS n_lost_words
  FROM judged GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(translate(text, white, ''))::BIGINT AS word_chars,
         (length(text) - length(translate(text, {_Q(SYMBOLS)}, '')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(n_lost_words, 0) AS n_lost_words
  FROM w LEFT JOIN by_doc USING (doc_id) LEFT JOIN cover USING (doc_id))
SELECT *, n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT_PCT} AS base_failed,
       NOT (n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT_PCT})
       AND (n_words - n_lost_words) * 100 >= n_words * {MIN_KEPT_PCT} AS kept
FROM m
"""
