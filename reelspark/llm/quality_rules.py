"""Quality rules: line-first cleaning, with only DataFrame functions.

Every line is held against punctuation, navigation and boilerplate rules; lines
that fail are removed, and a document that loses more than `max_lost` of its
characters is rejected. Base rules on whole documents come first. What is left of a
text comes back as clean_text: of repeated lines the first stays, as they count as
lost too, and an empty line stands wherever lines of two paragraphs meet.

A short line without a sentence end is held against its neighbours, so that prose
broken at a fixed width, or verse, stays. The lines of a paragraph up to one that ends
a sentence are a run. The line passes if a sentence end closes its run or the next
line goes on in lower case, and it is at least half as long as the longest of the run
(so a menu above a long line fails); or if it is a run's last and goes on from the line before in lower case.

Cases: a null or empty text has no words and fails the base rules. Very long
texts cost n log n in their words. Repeated rows are judged alike. An empty table
gives an empty result. Extra columns pass through `keep` only; one that bears the name
of a result column comes back with "_input" appended.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACES, kept_names, let, table

#: Phrases of lines that belong to the site, not to the text, in English, German, French and Spanish (fixed values).
BOILERPLATE = (
    "(?i)(all rights reserved|terms of (use|service)|privacy policy|cookie (policy|settings|consent)|accept (all )?cookies|"
    "enable javascript|click here|read more|sign (in|up)|log ?in|subscribe (now|to)|share (this|on)|skip to content|lorem ipsum|"
    "alle rechte vorbehalten|nutzungsbedingungen|datenschutz(erkl[äÄ]rung|richtlinie)|cookies? (akzeptieren|zulassen)|weiterlesen|hier klicken|jetzt (anmelden|abonnieren)|"
    "tous droits r[éÉ]serv[éÉ]s|conditions d.utilisation|politique de confidentialit[éÉ]|accepter (les )?cookies|lire la suite|cliquez ici|s.inscrire|se connecter|"
    "todos los derechos reservados|t[éÉ]rminos (de uso|del servicio)|pol[íÍ]tica de privacidad|aceptar (las )?cookies|leer m[áÁ]s|haz clic aqu[íÍ]|iniciar sesi[óÓ]n|suscr[íÍ]bete)"
)
#: A line that ends a sentence, at its end; a line that goes on in lower case, at its start.
CLOSED = r"[.!?…:;][\x22'”»)]{0,3}[\x20\x09\x0B-\x0D]{0,3}"
LOWER = r"^[\x20\x09-\x0D]*[\x22'“«(]{0,3}\p{Ll}"


OWN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text", "clean_chars", "line_chars")


@dataclass(frozen=True)
class LineRules:
    #: A line of prose ends in, or holds, one of these.
    sentence_end: str = r"[.!?…:;][\x22'”»)]*([\x20\x09-\x0D]|$)"
    #: Marks that prose hardly uses.
    marks: str = r"[#*$%&|<>{}~^=]"
    #: Lines of fewer words than this need a sentence end to stay.
    prose_words: int = 12
    #: Unless neighbours carry the sentence on, from a line of at least this many words. None: each line alone.
    wrapped_words: int | None = 4
    #: Most marks for each 100 words, and most runs of "!!" or "??" for each 100 words.
    most_marks: int = 15
    most_shouts: int = 15
    #: Separators that make a line a menu or a table row.
    separators: str = r"[|»›·•>]"
    menu_separators: int = 3
    #: A boilerplate phrase fails a line of at most this many words.
    boilerplate_words: int = 12
    #: Share of the text's characters, in percent, that a kept document may lose.
    max_lost: int = 50


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def word_count(line: Column) -> Column:
    return F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur at least twice.

    Each window becomes one long: the high bits of its hash over its position, so that
    a primitive sort brings equal windows together; neighbours are then compared by
    their words.
    """
    below = (F.pow(F.lit(2), F.length(F.bin(F.size(words)))) - 1).cast("long")
    keys = lambda m: F.transform(F.sequence(F.lit(0).cast("long"), F.size(words).cast("long") - 3), lambda i: F.bitwise_not(m).bitwiseAND(F.xxhash64(at(i), at(i + 1), at(i + 2))).bitwiseOR(i))
    at = lambda i: F.get(words, i.cast("int"))

    def marked(s: Column, m: Column) -> Column:
        def same(x: Column, y: Column) -> Column:
            i, j = x.bitwiseAND(m), y.bitwiseAND(m)
            return x.bitwiseXOR(y).between(0, m) & (at(i) == at(j)) & (at(i + 1) == at(j + 1)) & (at(i + 2) == at(j + 2))

        pairs = F.filter(F.sequence(F.lit(1), F.size(s) - 1), lambda k: same(F.get(s, k), F.get(s, k - 1)))
        here, before = F.transform(pairs, lambda k: F.get(s, k).bitwiseAND(m)), F.transform(pairs, lambda k: F.get(s, k - 1).bitwiseAND(m))
        return F.sort_array(F.array_distinct(F.concat(here, before)))

    def covered(p: Column) -> Column:
        reach = lambda k: F.least(F.lit(3).cast("long"), F.coalesce(F.get(p, k + 1) - F.get(p, k), F.lit(3).cast("long")))
        return F.when(F.size(p) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0).cast("long"), lambda n, k: n + reach(k)))

    counted = let(below, lambda m: let(F.sort_array(keys(m)), lambda s: let(marked(s, m), covered)))
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(counted)


def line_fails(line: Column, carried: Column, rules: LineRules) -> Column:
    """carried: whether the line's neighbours continue its sentence."""

    def judged(n: Column) -> Column:
        often = lambda pattern, most: F.rlike(line, F.lit(pattern)) & (F.regexp_count(line, F.lit(pattern)) * 100 > n * most)
        unended = (n < rules.prose_words) & ~F.rlike(line, F.lit(rules.sentence_end))
        unended &= ~carried
        navigation = F.rlike(line, F.lit(rules.separators)) & (F.regexp_count(line, F.lit(rules.separators)) >= rules.menu_separators)
        boilerplate = (n <= rules.boilerplate_words) & F.rlike(line, F.lit(BOILERPLATE))
        return unended | often(rules.marks, rules.most_marks) | often(r"[!?]{2,}", rules.most_shouts) | navigation | boilerplate

    return let(word_count(line), judged)


def carried(lines: Column, words: int) -> Column:
    """A struct of line and carried for each line of a run: whether its neighbours continue its sentence."""

    def judged(seen: Column) -> Column:
        lower = lambda x: F.coalesce(F.rlike(x, F.lit(LOWER)), F.lit(False))

        long = lambda x: word_count(x) >= words

        def one(x: Column, i: Column) -> Column:
            ahead = (i < F.size(lines) - 1) & long(x) & (2 * F.length(x) >= seen["longest"]) & (seen["closed"] | lower(F.get(lines, i + 1)))
            return F.struct(x.alias("line"), (ahead | (i > 0) & (i == F.size(lines) - 1) & lower(x) & long(F.get(lines, i - 1))).alias("carried"))

        return F.transform(lines, one)

    seen = F.struct(F.array_max(F.transform(lines, lambda x: F.length(x))).alias("longest"), F.rlike(F.get(lines, F.size(lines) - 1), F.lit(CLOSED + "$")).alias("closed"))
    alone = F.transform(lines, lambda x: F.struct(x.alias("line"), F.lit(False).alias("carried")))
    return F.when(F.size(lines) < 2, alone).otherwise(let(seen, judged))


def lines_of(text: Column, wrapped: int | None) -> Column:
    """A struct of line, its place i, its paragraph p and carried for each line that is not blank."""
    full = lambda t: F.filter(F.split(t, "\n", -1), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    alone = lambda t: F.transform(full(t), lambda x: F.struct(x.alias("line"), F.lit(False).alias("carried")))
    runs = lambda t: F.flatten(F.transform(F.split(t, rf"\n(?<={CLOSED}\n)", -1), lambda r: let(full(r), lambda ls: carried(ls, wrapped))))
    lines = lambda t, p: F.transform((alone if wrapped is None else runs)(t), lambda x: F.struct(x["line"].alias("line"), p.alias("p"), x["carried"].alias("carried")))
    found = F.flatten(F.transform(F.split(text, r"\n[\x20\x09-\x0D]*\n", -1), lines))
    return F.transform(found, lambda x, i: F.struct(x["line"].alias("line"), i.alias("i"), x["p"].alias("p"), x["carried"].alias("carried")))


def firsts(lines: Column) -> Column:
    """Of equal lines the first, in order."""
    one = lambda s: F.filter(s, lambda x, k: (k == 0) | (x["line"] != F.get(s, k - 1)["line"]))
    return F.sort_array(F.transform(let(F.sort_array(lines), one), lambda x: F.struct(x["i"].alias("i"), x["p"].alias("p"), x["line"].alias("line"))))


def joined(lines: Column) -> Column:
    gap = lambda x, k: F.when(k == 0, F.lit("")).when(x["p"] != F.get(lines, k - 1)["p"], F.lit("\n\n")).otherwise(F.lit("\n"))
    return F.array_join(F.transform(lines, lambda x, k: F.concat(gap(x, k), x["line"])), "")


def measures(text: Column, rules: LineRules) -> Column:
    """A struct of all counts of one text, and what its passing lines make."""
    whole = F.coalesce(text, F.lit(""))
    left = lambda ls: F.struct(
        joined(ls).alias("clean_text"),
        F.aggregate(ls, F.lit(0).cast("long"), lambda n, x: n + F.length(x["line"])).alias("clean_chars"),
    )
    seen = lambda ls: F.struct(
        (F.size(ls) - F.size(F.array_distinct(ls["line"]))).cast("long").alias("n_dup_lines"),
        F.aggregate(ls, F.lit(0).cast("long"), lambda n, x: n + F.length(x["line"])).alias("line_chars"),
        let(firsts(F.filter(ls, lambda x: ~line_fails(x["line"], x["carried"], rules))), left).alias("c"),
    )
    said = lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeat_words(w).cast("long").alias("n_repeat_words"))
    return F.struct(let(words_of(text), said).alias("w"), F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), let(lines_of(whole, rules.wrapped_words), seen).alias("l"))


def judge(docs: DataFrame, keep: list[str], text: str = "text", rules: LineRules = LineRules(), min_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """keep, the counts, base_failed, kept, clean_text, clean_chars and line_chars for every row of docs."""
    counted = docs.select(*[F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)], measures(F.col(text), rules).alias("m"))
    base_failed = (F.col("m.w.n_words") < min_words) | (F.col("m.w.n_repeat_words") * 100 > F.col("m.w.n_words") * most_repeated)
    lost = (F.col("m.l.line_chars") - F.col("m.l.c.clean_chars")) * 100 > F.col("m.l.line_chars") * rules.max_lost
    return counted.select(
        *[F.col(f"k_{i}").alias(c) for i, c in enumerate(kept_names(keep, OWN))],
        F.col("m.w.n_words").alias("n_words"), F.col("m.w.word_chars").alias("word_chars"), F.col("m.n_symbols").alias("n_symbols"),
        F.col("m.l.n_dup_lines").alias("n_dup_lines"), F.col("m.w.n_repeat_words").alias("n_repeat_words"),
        base_failed.alias("base_failed"), (~base_failed & ~lost).alias("kept"),
        F.col("m.l.c.clean_text").alias("clean_text"), F.col("m.l.c.clean_chars").alias("clean_chars"), F.col("m.l.line_chars").alias("line_chars"),
    )


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The columns of the SQL, which judges each line alone; neighbours, clean_text and its counts are for the pipeline."""
    return judge(table(spark, sf_dir, "documents"), ["doc_id"], rules=LineRules(wrapped_words=None)).drop("clean_text", "clean_chars", "line_chars")


ORACLE = {
    "op10_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
keyed AS (SELECT rid, i, [w[i], w[i + 1], w[i + 2]] AS k FROM win),
hits AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM keyed),
marks AS (SELECT DISTINCT rid, unnest([i, i + 1, i + 2]) AS p FROM hits WHERE n > 1),
rep AS (SELECT rid, count(*) AS n FROM marks GROUP BY rid),
dl AS (SELECT DISTINCT rid, unnest(ls) AS x FROM w),
lf AS (SELECT rid, length(x) AS n_chars, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n, x FROM dl),
cl AS (SELECT rid, sum(n_chars) FILTER (WHERE NOT (
    (n < 12 AND NOT regexp_matches(x, '[.!?\x{2026}:;][\x22''\x{201d}\x{bb})]*([\x20\x09-\x0D]|$)'))
    OR len(regexp_extract_all(x, '[#*$%&|<>{}~^=]')) * 100 > n * 15
    OR len(regexp_extract_all(x, '[!?]{2,}')) * 100 > n * 15
    OR len(regexp_extract_all(x, '[|\x{bb}\x{203a}\x{b7}\x{2022}>]')) >= 3
    OR (n <= 12 AND regexp_matches(x, '(?i)(all rights reserved|terms of (use|service)|privacy policy|cookie (policy|settings|consent)|accept (all )?cookies|enable javascript|click here|read more|sign (in|up)|log ?in|subscribe (now|to)|share (this|on)|skip to content|lorem ipsum|alle rechte vorbehalten|nutzungsbedingungen|datenschutz(erkl[äÄ]rung|richtlinie)|cookies? (akzeptieren|zulassen)|weiterlesen|hier klicken|jetzt (anmelden|abonnieren)|tous droits r[éÉ]serv[éÉ]s|conditions d.utilisation|politique de confidentialit[éÉ]|accepter (les )?cookies|lire la suite|cliquez ici|s.inscrire|se connecter|todos los derechos reservados|t[éÉ]rminos (de uso|del servicio)|pol[íÍ]tica de privacidad|aceptar (las )?cookies|leer m[áÁ]s|haz clic aqu[íÍ]|iniciar sesi[óÓ]n|suscr[íÍ]bete)'))
  )) AS clean FROM lf GROUP BY rid),
m AS (SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(list_aggregate(w.w, 'string_agg', '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(w.t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(len(w.ls) - len(list_distinct(w.ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
  coalesce(list_sum(list_transform(w.ls, lambda x: length(x))), 0) AS line_chars, coalesce(cl.clean, 0) AS clean_chars
  FROM w LEFT JOIN rep USING (rid) LEFT JOIN cl USING (rid))
SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT ((line_chars - clean_chars) * 100 > line_chars * 50) AS kept
FROM m
"""
}
QUERIES = {"op10_quality_rules": op10_quality_rules}
