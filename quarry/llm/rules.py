"""Quality rules, line first: Spark expressions only, no shuffle.

Every line with a word is judged by itself; failing lines are removed, and a document that loses too much of its text
with them is rejected. A line fails if it has no letter or digit, or if many of its words end in runs of signs
(punctuation rule); if it is a row of short cells between separators (navigation rule); or if it is stock text such
as licence, copyright or cookie notices (boilerplate rule). Stock text is short: a paragraph that only begins like it is
prose and stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import WORD_PATTERN, table

BLANKS = r"[\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Share of a line's words that may end in two or more signs.
MAX_SIGN_WORDS = 0.3
SIGN_RUN = r"[#*$%&|<>!?~=_+^]{2,}(?=[\x20\x09-\x0D]|$)"
#: Cells of a navigation line have at most so many words on average, and there are at least MIN_CELLS of them.
MAX_CELL_WORDS, MIN_CELLS = 4, 3
SEPARATOR = r"[\x20\x09-\x0D](?:\||>|»|·|•)(?=[\x20\x09-\x0D]|$)"
BOILERPLATE = (
    r"(?i)^[\x20\x09-\x0D]*(?:©|copyright (?:©|\(c\)|[0-9]{4})|all rights reserved|(?:licensed|released|distributed) under (?:the |a )?[a-z]"
    r"|this (?:work|file|software|program) is licensed|terms (?:of use|of service|and conditions)|privacy policy|cookie policy"
    r"|(?:we|this (?:site|website)) uses? cookies|by continuing to (?:use|browse)|please enable javascript|subscribe to our newsletter"
    r"|(?:click|tap) here to|share (?:this|on)|read more|back to top|skip to (?:main )?content|lorem ipsum"
    # German
    r"|alle rechte vorbehalten|(?:lizenziert|veröffentlicht) unter (?:der |einer )?[a-z]|nutzungsbedingungen|datenschutz(?:erklärung|richtlinie|hinweise)"
    r"|cookie-richtlinie|(?:wir verwenden|diese (?:seite|website) verwendet) cookies|mit der nutzung (?:dieser|unserer)|bitte aktivieren sie javascript"
    r"|(?:abonnieren sie|newsletter abonnieren)|(?:hier klicken|klicken sie hier)|weiterlesen|mehr lesen|nach oben|zum (?:haupt)?inhalt springen"
    # French
    r"|tous droits r[ée]serv[ée]s|(?:publi[ée]|distribu[ée]) sous (?:la )?licence|conditions (?:d'utilisation|g[ée]n[ée]rales)|politique de (?:confidentialit[ée]|cookies)"
    r"|(?:nous utilisons|ce site utilise) des cookies|en poursuivant votre navigation|veuillez activer javascript|abonnez-vous [àa] notre|cliquez ici"
    r"|partager (?:sur|cet)|lire la suite|haut de page|aller au contenu"
    # Spanish
    r"|todos los derechos reservados|(?:publicado|distribuido) bajo (?:la |una )?licencia|(?:condiciones|t[ée]rminos) de (?:uso|servicio)|pol[íi]tica de (?:privacidad|cookies)"
    r"|(?:utilizamos|este sitio utiliza) cookies|al continuar navegando|por favor,? active javascript|suscr[íi]bete a nuestro|haga clic aqu[íi]"
    r"|compartir en|leer m[áa]s|volver arriba|saltar al contenido)"
)
#: A line of more words is no stock text.
MAX_STOCK_WORDS = 40
#: A document is rejected if it loses more than this share of its word characters.
MAX_LOST = 0.5


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def word_chars_of(text: Column) -> Column:
    return F.length(F.translate(text, BLANK_CHARS, ""))


def line_fails(line: Column) -> Column:
    """Whether a line with a word is removed."""
    n_words = F.regexp_count(line, F.lit(WORD_PATTERN))
    sign_words = F.regexp_count(line, F.lit(SIGN_RUN))
    cells = F.regexp_count(line, F.lit(SEPARATOR)) + 1
    punctuation = ~line.rlike(r"[\p{L}\p{N}]") | (line.rlike(SIGN_RUN) & (sign_words > MAX_SIGN_WORDS * n_words))
    navigation = line.rlike(SEPARATOR) & (cells >= MIN_CELLS) & (n_words - cells + 1 <= MAX_CELL_WORDS * cells)
    return punctuation | navigation | ((n_words <= MAX_STOCK_WORDS) & line.rlike(BOILERPLATE))


def repeated_words(df: DataFrame, words: str) -> DataFrame:
    """Adds ``n_repeat_words``: words inside three-word windows that the array column ``words`` has twice or more.

    Most texts repeat no window, which a set of window hashes shows; only in others windows are sorted beside their
    places, compared with their neighbours, and the places of repeated ones counted once each.
    """
    w = F.col(words)
    n = F.size(w)
    places = F.sequence(F.lit(0), n - 3)
    hashes = F.when(n >= 4, F.transform(places, lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2])))
    df = df.withColumn("__any", F.coalesce(F.size(F.array_distinct(hashes)) < n - 2, F.lit(False)))
    windows = F.transform(places, lambda i: F.struct(F.concat_ws(" ", w[i], w[i + 1], w[i + 2]).alias("g"), i.alias("i")))
    df = df.withColumn("__sorted", F.when(F.col("__any"), F.array_sort(windows)))
    s = F.col("__sorted")
    last = F.size(s) - 1
    twice = F.filter(s, lambda x, k: F.when(k > 0, x["g"] == s[F.greatest(k - 1, F.lit(0))]["g"]).otherwise(False) | F.when(k < last, x["g"] == s[F.least(k + 1, last)]["g"]).otherwise(False))
    df = df.withColumn("__at", F.when(F.col("__any"), F.array_sort(F.transform(twice, lambda x: x["i"]))))
    at = F.col("__at")
    end = F.size(at) - 1
    each = F.transform(at, lambda p, k: F.when(k < end, F.least(F.lit(3), at[F.least(k + 1, end)] - p)).otherwise(3))
    total = F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).drop("__any", "__sorted", "__at")


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", max_lost: float = MAX_LOST) -> DataFrame:
    """One row per row of ``docs``: the counts, ``base_failed``, ``kept``, ``clean_text`` and ``lines_removed``.

    A null text has no words and is kept out; so has an empty one. ``clean_text`` is the text without its failing
    lines (lines without a word stay). Rows that repeat an id are judged each on its own, other columns are ignored. A
    text is judged as a whole by the task that reads it, however long: beside it stand arrays of its words, its lines and,
    where a window of words repeats, its windows, some ten times its size.
    """
    df = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    t = F.col("__text")
    df = df.withColumn("__words", words_of(t)).withColumn("__lines", F.split(t, "\n"))
    df = repeated_words(df.withColumn("n_words", F.size("__words").cast("long")), "__words").drop("__words")
    df = df.withColumn("__worded", F.filter("__lines", lambda x: x.rlike(WORD_PATTERN)))
    df = df.withColumn("__failing", F.filter("__worded", line_fails))
    lost = F.aggregate("__failing", F.lit(0).cast("long"), lambda a, x: a + word_chars_of(x))
    return (
        df.withColumn("word_chars", word_chars_of(t).cast("long"))
        .withColumn("n_symbols", (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"))
        .withColumn("n_dup_lines", (F.size("__worded") - F.size(F.array_distinct("__worded"))).cast("long"))
        .withColumn("lines_removed", F.size("__failing").cast("long"))
        .withColumn("lost_chars", lost)
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
        .withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") <= max_lost * F.col("word_chars")))
        .withColumn("clean_text", F.array_join(F.filter("__lines", lambda x: ~(x.rlike(WORD_PATTERN) & line_fails(x))), "\n"))
        .drop("__text", "__lines", "__worded", "__failing")
    )


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select(*COLUMNS)


_SQL_BOILERPLATE = BOILERPLATE.replace("'", "''")
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{WORD_PATTERN}') AS ws FROM d),
g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
      FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 1)) AS i)),
two AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
rep AS (SELECT r, count(DISTINCT i + o) AS n FROM two, (VALUES (0), (1), (2)) v(o) GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d),
lines AS (SELECT r, x, length(regexp_replace(x, '{BLANKS}', '', 'g')) AS chars, len(regexp_extract_all(x, '{WORD_PATTERN}')) AS n,
                 len(regexp_extract_all(x || ' ', '[#*$%&|<>!?~=_+^]{{2,}}[\x20\x09-\x0D]')) AS signs,
                 len(regexp_extract_all(x || ' ', '[\x20\x09-\x0D](?:\||>|»|·|•)')) AS seps,
                 len(regexp_extract_all(regexp_replace(x || ' ', '[\x20\x09-\x0D]', '  ', 'g'), '[\x20\x09-\x0D](?:\||>|»|·|•)[\x20\x09-\x0D]')) + 1 AS cells
          FROM l WHERE regexp_matches(x, '{WORD_PATTERN}')),
judged AS (SELECT r, x, chars, NOT regexp_matches(x, '[\p{{L}}\p{{N}}]') OR (signs > 0 AND signs > {MAX_SIGN_WORDS} * n)
                  OR (cells > 1 AND cells >= {MIN_CELLS} AND n - cells + 1 <= {MAX_CELL_WORDS} * cells)
                  OR (n <= {MAX_STOCK_WORDS} AND regexp_matches(x, '{_SQL_BOILERPLATE}')) AS bad FROM lines),
per AS (SELECT r, count(*) - count(DISTINCT x) AS dup, coalesce(sum(chars) FILTER (bad), 0) AS lost FROM judged GROUP BY r),
f AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '{BLANKS}', '', 'g')) AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
             coalesce(lost, 0) AS lost
      FROM w LEFT JOIN rep USING (r) LEFT JOIN per USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost <= {MAX_LOST} * word_chars AS kept
FROM f
"""
