"""Quality rules: line-first cleaning.

Every line is judged on its own by three rules, failing lines are removed, and a document is rejected if it
fails the base limits or loses too large a share of its characters. Everything is one projection of built-in
functions over whole texts: no shuffle, and a task holds one row at a time.

Line rules, for lines with a word (characters: code points that are not white space):

* punctuation: marks of ``#*$%&|<>!=~^_+{}[]\\`` make up over 10 % of the line's characters
* navigation: at least 3 separators ``| > » • ·`` stand alone as words, and over a fifth of the words are such
* boilerplate: at most 25 words, with a phrase of FORMS between word boundaries, or a topic of TOPICS as the whole line;
  both lists are in English, German, French and Spanish, and ask for a form that boilerplate takes, so that a sentence
  about cookies or copyright stays

The windows of the repeat count are hashes of two halves' hashes, down to single words, so a word is hashed once.

Cases: null text counts as empty; an empty text has no words and so fails the base limits; a very long text is one row
of one task, with arrays of its words and lines; equal rows get equal results, and lines are judged alike wherever they
stand; an empty table gives an empty result; input columns other than the id and the text don't matter to `measure`,
and `clean` returns them as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curves.llm.common import SPACES, free, let, quoted, words

#: Base limits.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: Limits of the line rules, and of the share of characters that may go.
MARK_PERCENT, MIN_SEPARATORS, SEPARATOR_PERCENT, BOILERPLATE_WORDS, MAX_LOST_PERCENT = 10, 3, 20, 25, 50
# Forms of boilerplate within a line, and topics that are boilerplate as a whole line.
FORMS = (
    r"all rights reserved", r"licensed under (?:the|an?|cc)", r"(?:released|distributed|available) under (?:the|an?) (?:\S+ ){0,5}licen[cs]e", r"lorem ipsum",
    r"copyright (?:\(c\)|©|notice|holders?|owners?|(?:19|20)\d\d)", r"(?:©|\(c\)) ?(?:copyright|(?:19|20)\d\d)",
    r"(?:accept|reject|manage|allow|enable|uses?|using|store|set) (?:all |our |the |some |these |necessary )*cookies", r"cookies? (?:policy|settings|preferences|notice|consent|banner)",
    r"(?:our|your|the|this|see|read|view|accept) (?:privacy policy|terms of (?:use|service))", r"privacy policy (?:and|\||-|·)", r"terms of (?:use|service) (?:and|\||-|·)",
    r"subscribe to (?:our|the|this|my)", r"(?:sign up (?:for|to)|join|get) (?:our|the) (?:\S+ )?newsletter", r"enable javascript",
    r"click here (?:to|for|if)", r"(?:sign|log) in (?:to (?:your|the|our|continue|view|post|comment|reply|read)|or|with your|here|now)",
    r"alle rechte vorbehalten", r"(?:lizenziert|veröffentlicht) unter (?:der|einer|dem|cc)", r"(?:akzeptieren|verwenden|nutzen) (?:sie )?(?:alle |unsere )?cookies", r"cookies? (?:akzeptieren|ablehnen|verwalten|zulassen)", r"cookie-?(?:einstellungen|richtlinien?|hinweis)",
    r"(?:unsere|die) (?:datenschutzerklärung|nutzungsbedingungen)", r"(?:unseren|den) newsletter (?:abonnieren|bestellen)", r"javascript (?:aktivieren|einschalten)", r"(?:klicken sie|klick) hier", r"melden sie sich (?:an|hier)",
    r"tous droits réservés", r"sous licence (?:cc|mit|gnu|apache|creative)", r"(?:accepter|refuser|gérer|utilise|utilisons) (?:tous |les |des |nos )*cookies", r"(?:notre|nos|la|les) (?:politique de confidentialité|conditions d'utilisation)",
    r"(?:abonnez-vous|inscrivez-vous|s'abonner|s'inscrire) (?:à|au) (?:notre|la|nos)", r"activer javascript", r"cliquez ici (?:pour|si)", r"connectez-vous (?:pour|à|ici)",
    r"todos los derechos reservados", r"bajo (?:la |una )?licencia (?:cc|mit|gnu|apache|creative|de)", r"(?:aceptar|rechazar|gestionar|utiliza|utilizamos|usamos) (?:todas |las |nuestras )*cookies", r"(?:nuestra|la|nuestros|los) (?:política de (?:privacidad|cookies)|términos de (?:uso|servicio))",
    r"(?:suscríbete|suscríbase|suscribirse) (?:a|al) (?:nuestro|nuestra|la)", r"(?:activar|habilitar|habilite|active) javascript", r"(?:haz|haga) clic aquí", r"(?:inicia|inicie|iniciar) sesión (?:para|en|con|aquí)",
)
TOPICS = (
    r"(?:©|copyright)(?: \S+){0,4}", r"(?:cookies?|newsletter|privacy policy|terms of (?:use|service)|click here|(?:sign|log) in)(?: (?:here|now|today|page|signup|sign-up|register|sign up))?",
    r"powered by(?: \S+){1,4}", r"subscribe to(?: \S+){1,5}",
    r"impressum|datenschutz(?:erklärung|hinweise?)?|nutzungsbedingungen|anmelden|registrieren|newsletter abonnieren",
    r"mentions légales|politique de confidentialité|conditions d'utilisation|se connecter|s'inscrire|s'abonner",
    r"aviso legal|política de (?:privacidad|cookies)|términos (?:de uso|y condiciones)|iniciar sesión|registrarse|suscribirse",
)
_GAP = r"[\x00-/:-@\[-`{-\x{BF}\x{2000}-\x{206F}\x{3000}-\x{303F}]"  # what isn't part of a word
#: Without look-around, so that every engine of regular expressions can run it.
BOILERPLATE = rf"(?:^|{_GAP})(?:{'|'.join(FORMS)})(?:{_GAP}|$)|^{_GAP}*?(?:{'|'.join(TOPICS)}){_GAP}*$"
MARKS_RE = r"[#*$%&|<>!=~^_+{}\[\]\\]"
SEPARATORS = ("|", ">", "»", "•", "·")


def _chars(text: Column) -> Column:
    return F.length(F.translate(text, SPACES, ""))


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def line_fails(line: Column, boilerplate: str = BOILERPLATE) -> Column:
    """Whether a line with a word breaks one of the rules."""
    separators = lambda ws: F.size(F.filter(ws, lambda w: w.isin(*SEPARATORS)))
    return (_count(line, MARKS_RE) * 100 > _chars(line) * MARK_PERCENT) | let(
        words(line),
        lambda ws: ((separators(ws) >= MIN_SEPARATORS) & (separators(ws) * 100 > F.size(ws) * SEPARATOR_PERCENT))
        | ((F.size(ws) <= BOILERPLATE_WORDS) & F.lower(line).rlike(boilerplate)),
    )


def repeated_words(ws: Column, size: int = WINDOW) -> Column:
    """Words inside windows of `size` words, a power of two, that a text holds twice or more, the first included."""

    def covered(hashes: Column) -> Column:
        by_hash = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(
            by_hash,
            lambda s: F.filter(s, lambda e, k: (e["h"] == F.get(s, k - 1)["h"]) | (e["h"] == F.get(s, k + 1)["h"])),
        )
        starts = F.array_sort(F.transform(twice, lambda e: e["i"]))
        steps = let(starts, lambda p: F.transform(p, lambda x, k: F.least(F.lit(size), F.coalesce(F.get(p, k + 1) - x, F.lit(size)))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def doubled(own: Column, n: int) -> Column:
        """Hashes of the windows of `size` words from each place, made of those of n words; null at the end."""
        if n == size:
            return F.slice(own, 1, F.size(own) - (size - 1))
        return let(F.transform(own, lambda h, i: F.xxhash64(h, F.get(own, i + n))), lambda pairs: doubled(pairs, 2 * n))

    own = F.transform(ws, lambda w: F.xxhash64(w))
    hashes = F.when(F.size(ws) >= size, let(own, lambda h: doubled(h, 1))).otherwise(F.array().cast("array<bigint>"))
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))


def verdict(text: Column, boilerplate: str = BOILERPLATE) -> Column:
    """Struct of the measures of a text, its cleaned text and whether it is kept."""

    def judge(t: Column, ws: Column, lines: Column, full: Column) -> Column:
        failed = F.filter(lines, lambda x: x["bad"])
        chars, lost = _chars(t), F.aggregate(failed, F.lit(0), lambda a, x: a + _chars(x["s"]))
        n, repeats = F.size(ws), repeated_words(ws)
        return let(
            F.struct(n.alias("n"), repeats.alias("r"), chars.alias("c"), lost.alias("l")),
            lambda m: F.struct(
                m["n"].cast("long").alias("n_words"),
                m["c"].cast("long").alias("word_chars"),
                _count(t, r"[#*$%&|<>]").cast("long").alias("n_symbols"),
                (F.size(full) - F.size(F.array_distinct(full))).cast("long").alias("n_dup_lines"),
                m["r"].cast("long").alias("n_repeat_words"),
                F.size(failed).cast("long").alias("n_failed_lines"),
                m["l"].cast("long").alias("lost_chars"),
                _base_failed(m).alias("base_failed"),
                (~_base_failed(m) & (m["l"] * 100 <= m["c"] * MAX_LOST_PERCENT)).alias("kept"),
                F.array_join(F.transform(F.filter(lines, lambda x: ~x["bad"]), lambda x: x["s"]), "\n").alias("clean_text"),
            ),
        )

    def with_lines(t: Column, ws: Column) -> Column:
        has_word = lambda x: F.translate(x, SPACES, "") != ""
        return let(
            F.transform(F.split(t, "\n"), lambda x: F.struct(x.alias("s"), (has_word(x) & line_fails(x, boilerplate)).alias("bad"))),
            lambda lines: let(
                F.filter(F.transform(lines, lambda x: x["s"]), has_word),
                lambda full: judge(t, ws, lines, full),
            ),
        )

    return let(F.coalesce(text, F.lit("")), lambda t: let(words(t), lambda ws: with_lines(t, ws)))


def _base_failed(m: Column) -> Column:
    return (m["n"] < MIN_WORDS) | (m["r"].cast("long") * 100 > m["n"].cast("long") * MAX_REPEAT_PERCENT)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the verdict of every document, as columns."""
    return docs.select(quoted(id_col), F.inline(F.array(verdict(quoted(text_col)))))


def clean(docs: DataFrame, text_col: str = "text", boilerplate: str = BOILERPLATE) -> DataFrame:
    """The kept documents, with failing lines removed from their texts; other columns as they were."""
    (new,) = free(docs, "text")
    judged = F.filter(F.array(verdict(quoted(text_col), boilerplate)), lambda v: v["kept"])
    out = docs.select("*", F.inline(F.transform(judged, lambda v: F.struct(v["clean_text"].alias(new)))))
    return out.select(*[F.col(new).alias(c) if c == text_col else quoted(c) for c in docs.columns])


def op4_quality_rules(spark, sf_dir):
    """Base measures and the line-first verdict of every document."""
    return measure(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("clean_text")


_W = r"[^\x20\x09-\x0D]+"
_MARKS, _BOILERPLATE = (x.replace("'", "''") for x in (MARKS_RE, BOILERPLATE))
ORACLE = rf"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '{_W}') AS ws FROM t),
win AS (SELECT r, i, list_slice(ws, i, i + {WINDOW - 1}) AS g
        FROM (SELECT r, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW})),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n
        FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM twice) GROUP BY r),
li AS (SELECT r, line, len(regexp_extract_all(line, '{_W}')) AS n,
              length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS c,
              length(line) - length(regexp_replace(line, '{_MARKS}', '', 'g')) AS marks,
              len(list_filter(regexp_extract_all(line, '{_W}'), lambda x: x IN ({", ".join(f"'{s}'" for s in SEPARATORS)}))) AS seps
       FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM t)),
judged AS (SELECT *, (marks * 100 > c * {MARK_PERCENT} OR (seps >= {MIN_SEPARATORS} AND seps * 100 > n * {SEPARATOR_PERCENT})
                      OR (n <= {BOILERPLATE_WORDS} AND regexp_matches(lower(line), '{_BOILERPLATE}'))) AS bad
           FROM li WHERE n > 0),
per AS (SELECT r, count(*) - count(DISTINCT line) AS dup, count(*) FILTER (bad) AS bad,
               coalesce(sum(c) FILTER (bad), 0) AS lost FROM judged GROUP BY r),
m AS (SELECT doc_id, len(ws) AS n, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS c,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS sym,
             coalesce(dup, 0) AS dup, coalesce(rep.n, 0) AS rep, coalesce(bad, 0) AS bad, coalesce(lost, 0) AS lost
      FROM t JOIN w USING (r) LEFT JOIN per USING (r) LEFT JOIN rep USING (r))
SELECT doc_id, n::BIGINT AS n_words, c::BIGINT AS word_chars, sym::BIGINT AS n_symbols, dup::BIGINT AS n_dup_lines,
       rep::BIGINT AS n_repeat_words, bad::BIGINT AS n_failed_lines, lost::BIGINT AS lost_chars,
       (n < {MIN_WORDS} OR rep * 100 > n * {MAX_REPEAT_PERCENT}) AS base_failed,
       NOT (n < {MIN_WORDS} OR rep * 100 > n * {MAX_REPEAT_PERCENT}) AND lost * 100 <= c * {MAX_LOST_PERCENT} AS kept
FROM m
"""
