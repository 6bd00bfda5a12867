"""Quality rules, line first: lines that fail a rule are removed, then documents that lost too much.

Everything is built-in column functions; no Python runs on the executors.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS, WS_CHARS, let

#: The symbols that a document's n_symbols counts.
SYMBOLS = r"[#*$%&|<>]"
#: Lower-case phrases of boilerplate lines in English, German, French and Spanish.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of service", "terms of use", "accept cookies",
    "enable javascript", "click here", "subscribe to our", "sign up for our", "lorem ipsum", "skip to content",
    "alle rechte vorbehalten", "cookie-richtlinie", "datenschutzerklärung", "nutzungsbedingungen", "cookies akzeptieren",
    "javascript aktivieren", "hier klicken", "klicken sie hier", "newsletter abonnieren", "zum inhalt springen",
    "tous droits réservés", "politique de cookies", "politique de confidentialité", "conditions d'utilisation",
    "accepter les cookies", "activer javascript", "cliquez ici", "abonnez-vous à", "aller au contenu",
    "todos los derechos reservados", "política de cookies", "política de privacidad", "términos de uso", "términos de servicio",
    "aceptar cookies", "aceptar las cookies", "habilite javascript", "haga clic aquí", "suscríbase a", "saltar al contenido",
)
#: Ends of sentences, also behind closing quotes and brackets.
TERMINAL = "[.!?…。！？:;][\"'”’»)\\]]*[\\x20\\x09-\\x0D]*$"
WINDOW = 8


def _words(text: Column) -> Column:
    return let(F.btrim(text, F.lit(WS_CHARS)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, WS)))


def _chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, WS, ""))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of `window` words which the text has twice or more."""

    def covered(hashes: Column) -> Column:
        ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = let(ranked, lambda s: F.filter(s, lambda e, k: F.coalesce(F.get(s, k - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False))))
        places = F.sort_array(F.transform(again, lambda e: e["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(places, start, lambda a, i: F.struct((a["n"] + F.least(F.lit(window), i + window - a["end"])).alias("n"), (i + window).alias("end")), lambda a: a["n"])

    def count(ws: Column) -> Column:
        hashes = F.transform(F.slice(ws, F.lit(1), F.size(ws) - (window - 1)), lambda _, i: F.xxhash64(F.slice(ws, i + 1, F.lit(window))))
        return F.when(F.size(ws) < window, 0).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h))))

    return let(words, count)


def line_fails(line: Column) -> Column:
    """Whether one line with a word is navigation, symbols, boilerplate or a loose fragment."""
    words, symbols = F.size(_words(line)), F.regexp_count(line, F.lit(SYMBOLS))
    fails = symbols * 10 > F.length(line)
    fails = fails | (F.regexp_count(line, F.lit(r"\|")) >= 3)
    fails = fails | ((words < 6) & ~line.rlike(TERMINAL))
    return fails | let(F.lower(line), lambda low: functools.reduce(lambda a, b: a | b, (F.contains(low, F.lit(phrase)) for phrase in BOILERPLATE)))


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def _counts(t: Column) -> Column:
    """(n_words, n_repeat_words)"""
    return let(_words(t), lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), repeated_words(ws).cast("long").alias("n_repeat_words")))


def _lost(t: Column) -> Column:
    """The word characters of the lines that fail."""
    return F.aggregate(F.filter(F.split(t, "\n"), _has_word), F.lit(0).cast("long"), lambda a, line: a + F.when(line_fails(line), _chars(line)).otherwise(0))


def _failed(counts: Column) -> Column:
    return (counts["n_words"] < 20) | (100 * counts["n_repeat_words"] > 30 * counts["n_words"])


def quality(df: DataFrame, text: str = "text", max_lost: float = 0.5) -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept.

    kept is false where base_failed holds, or where the lines that fail hold more than `max_lost`
    of the text's word characters. A null text counts as empty: all counts are 0 and base_failed
    is true. Columns of df stay, but for those that have one of the new names, which are replaced.
    Rows are judged one by one, so ties, repeated rows and empty tables need no rule.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    own = {
        "__counts": _counts(t),
        "word_chars": _chars(t).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": let(F.filter(F.split(t, "\n"), _has_word), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "__lost": _lost(t),
    }
    out = df.withColumns(own).withColumns({k: F.col("__counts")[k] for k in ("n_words", "n_repeat_words")})
    failed = _failed(F.col("__counts"))
    kept = ~failed & (F.col("__lost") <= max_lost * F.col("word_chars"))
    return out.withColumn("base_failed", failed).withColumn("kept", kept).drop("__counts", "__lost")


def cleaned_text(text: Column) -> Column:
    """text without the lines that fail a rule; lines without a word stay."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.array_join(F.filter(lines, lambda line: ~(_has_word(line) & line_fails(line))), "\n")


def cleaned(text: Column, max_lost: float = 0.5) -> Column:
    """cleaned_text() where quality() would keep the text, else null; each line is judged once."""
    t = F.coalesce(text.cast("string"), F.lit(""))

    def judged(lines: Column) -> Column:
        lost = F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + F.when(x["fails"], _chars(x["line"])).otherwise(0))
        rest = F.array_join(F.transform(F.filter(lines, lambda x: ~x["fails"]), lambda x: x["line"]), "\n")
        return F.when(lost <= max_lost * _chars(t), rest)

    lines = F.transform(F.split(t, "\n"), lambda line: F.struct(line.alias("line"), (_has_word(line) & line_fails(line)).alias("fails")))
    return F.when(~let(_counts(t), _failed), let(lines, judged))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_PHRASES = " OR ".join("contains(lower(line), '{}')".format(p.replace("'", "''")) for p in BOILERPLATE)
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM d),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW}),
wins AS (SELECT doc_id, i, list_slice(ws, i, i + {WINDOW - 1}) AS win FROM starts),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM wins) WHERE n >= 2),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(0, {WINDOW}) AS r(k) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
judged AS (SELECT doc_id, length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g')) AS chars,
  10 * length(regexp_replace(line, '[^#*$%&|<>]+', '', 'g')) > length(line)
  OR length(regexp_replace(line, '[^|]+', '', 'g')) >= 3
  OR (len(list_filter(string_split_regex(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) < 6
      AND NOT regexp_matches(line, '[.!?…。！？:;]["''”’»)\\]]*[\\x20\\x09-\\x0D]*$'))
  OR {_PHRASES} AS fails
  FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
lost AS (SELECT doc_id, sum(chars) AS n FROM judged WHERE fails GROUP BY doc_id),
base AS (SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
  len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))
  - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))) AS n_dup_lines,
  coalesce(rep.n, 0) AS n_repeat_words, coalesce(lost.n, 0) AS lost
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND lost <= 0.5 * word_chars AS kept
FROM base
"""
