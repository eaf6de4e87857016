"""Toxicity: a weighted finite-state pattern grammar over clauses.

Six small transducers read the word classes of a clause side by side; their composition is one deterministic
machine, built once, whose states are the tuples of theirs:

* negation remembers a negator for the next two words and weakens what they say
* reported speech remembers a verb of saying until the clause ends and weakens what follows
* target remembers a person for the next four words
* insult holds an insulting word until the clause shows what it belongs to
* threat waits three words for a target after a word of violence, and after a determiner for the next word alone; it
  remembers whether the word was negated
* object remembers for four words a person who stands before the verb, as in German and Romance clauses

A word alone says little, so an arc emits the pattern that a clause has matched, not a word:

* aimed: an insult at a target up to four words before or two words after it
* piled: a second insult in the clause, or an insult beside a threat
* threat: a target up to three words after a word of violence, or an object up to four words before it
* lone: the clause ended with one insult that nothing was found for

A pattern's weight times the insulting word's weight (and what negation and reported speech leave of it) is the
probability that it is toxic. The document's machine reads what the clauses emit: its first lone insult counts as LONE,
which keeps one isolated word below the threshold whatever its weight; if another clause had one before, it is the pattern
``repeated``. A document's score is the probability that any of its emissions is right, 1 - prod(1 - p).

The words of violence, negation, reported speech and targets are fixed lists in four languages, with the forms of verbs,
plurals of insults, and contractions. A verb of violence that is meant otherwise, with a person beside it, is a false positive: "they shot her an email
today" scores as a threat. The insults are
fixed ones and those learned: words and word beginnings of 4 to 6 letters, weighted by their precision over a
sample of labelled rows (max_rows, on average at most) outside the held-out fold. Of near copies, which share the
least hash of their five-word shingles, one is counted, or every rare word of a copied text would look toxic.
Document counts of the terms are summed in Spark; the terms that pass a likelihood test come to the driver, whose number is
bounded by the sample. A beginning goes if a longer term has nearly all of its documents. The patterns' weights are
learned from the same sample, as their precision with a prior of PRIOR documents at the default.

Cases: null and empty texts score 0; a null id counts as an empty text in the fold rule; repeated rows get equal
scores; a very long text is read once from end to end, with a state of a few numbers; terms with equal counts are all kept;
without usable labels the fixed words alone score; an empty table gives an empty result; other input columns don't matter.
"""

import re
import zlib
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curves.llm.common import held_out, stored, table, training_rows

MAX_ROWS, CAP, THRESHOLD = 20_000, 0.8, 0.3
MIN_DOCS, MIN_PRECISION, MIN_GAIN, SAME = 6, 0.8, 12.0, 0.9
NEGATED, REPORTED, FIXED = 0.3, 0.6, 0.7
LONE, PRIOR = 0.2, 20
#: Weights of the patterns before any learning. LONE is never learned.
PATTERNS = {"aimed": 1.0, "piled": 0.9, "threat": 0.8, "repeated": 0.5}

# Seed words of each class.
INSULTS = "idiot moron loser scum trash clown stupid pathetic worthless disgusting dummkopf abschaum imbécile ordure basura estúpido".split()
THREATS = "kill hurt destroy beat shoot stab strangle töten umbringen schlagen tuer frapper matar golpear".split()
TARGETS = "you your he him she her they them people everyone du dich sie ihr tu te toi vous usted ustedes ellos".split()
NEGATORS = "not no never isn't aren't wasn't don't nicht kein keine nie jamais pas nunca ningún".split()
REPORTERS = "said says called quoted claimed wrote according sagte schrieb dit écrit dijo escribió".split()

#: Forms of the words above: of violence, with those of more verbs; of insults; and contractions that negate.
VIOLENT = re.compile(
    r"kill(?:s|ed|ing)?|murder(?:s|ed|ing)?|hurt(?:s|ing)?|destroy(?:s|ed|ing)?|beat(?:s|ing|en)?|shoot(?:s|ing)?|shot|stab(?:s|bed|bing)?|strangl(?:e|es|ed|ing)|"
    r"(?:ge)?töt(?:e|en|est|et|ete|eten)|um(?:zu)?bring(?:e|en|st|t)|umgebracht|ermord(?:e|en|est|et)|schlag(?:e|en|t)|schläg(?:st|t)|(?:ver|zusammen|er)schlagen|"
    r"tu(?:er|erai|era|erons|eront|é)|assassin(?:er|e|era|erai)|frapp(?:er|e|es|ent|erai|era|é)|mat(?:ar|aré|ará|arán|ando|aron|arte|aros)|asesin(?:ar|aré|ará)|golpe(?:ar|aré|ará|ando|arte)"
)
INSULTING = re.compile(rf"(?:{'|'.join(w for w in INSULTS if len(w) > 4)})(?:s|es|e|en|n)?")
CONTRACTED = re.compile(r"\w+n['’]t|cannot|wont|dont|cant")
# Objects that stand before their verb, and words after which a verb has another object than a person.
OBJECTS = "dich euch te toi os".split()
DETERMINERS = "the a an this that these those my its our der die das den dem ein eine einen le la les un une des el los las una unos".split()

OTHER, INSULT, VIOLENCE, TARGET, NEGATION, REPORT, OBJECT, DETERMINER = range(8)
#: How many of the words after it a negator, a target, an insult and a word of violence are remembered for.
NEGATION_SPAN, BEFORE, AFTER, THREAT_SPAN = 2, 4, 2, 3
_STRIP = ".,!?;:\"'()[]{}«»“”„…*#$%&|<>"


def _countdown(symbols: tuple[int, ...], span: int):
    """Machine that is on for `span` words after one of the symbols: (states, step)."""
    return range(span + 1), lambda state, read: span if read in symbols else max(state - 1, 0)


def _threat():
    """0, or the words left to wait for a target; those of a negated threat lie THREAT_SPAN higher. After a determiner only the
    next word can be it."""
    n = THREAT_SPAN

    def step(state: int, read: int) -> int:
        if read == VIOLENCE:
            return n
        if read == DETERMINER and state:
            return 1 if state <= n else n + 1
        return 0 if state in (0, 1, n + 1) else state - 1

    return range(2 * n + 1), step


def _held():
    """What is known of the clause's insults: 0 none, 1 to AFTER + 1 one that nothing was found for, with the words left in
    which a target counts, and AFTER + 2 if one has been matched."""
    matched = AFTER + 2
    return range(matched + 1), lambda state, read: state if state in (0, 1, matched) else state - 1


def compose() -> dict:
    """{(state, symbol): (next state, pattern or None, factor, whether the insult read is held)} of the composed
    machine. The factor is what negation and reported speech leave of the pattern."""
    said = (range(2), lambda s, read: int(s or read == REPORT))
    parts = [_countdown((NEGATION,), NEGATION_SPAN), said, _countdown((TARGET, OBJECT), BEFORE), _held(), _threat(), _countdown((OBJECT,), BEFORE)]
    arcs, matched = {}, AFTER + 2
    for state in product(*(states for states, _ in parts)):
        for read in range(8):
            negated, reported, target, held, violent, fronted = state
            spoken = REPORTED if reported else 1.0
            factor = spoken * (NEGATED if negated else 1.0)
            after = [step(s, read) for s, (_, step) in zip(state, parts, strict=True)]
            pattern, holds = None, False
            if read == INSULT:
                if target or held or violent:
                    pattern, after[3] = "aimed" if target else "piled", matched
                else:
                    after[3], holds = AFTER + 1, True
            elif read in (TARGET, OBJECT):
                if violent:
                    pattern, factor = "threat", spoken * (NEGATED if violent > THREAT_SPAN else 1.0)
                    after[4] = 0  # a threat meets one target
                elif 1 < held < matched:
                    pattern, factor, after[3] = "aimed", 1.0, matched  # how it was said was weighed when it was read
            elif read == VIOLENCE and fronted:
                pattern, after[4], after[5] = "threat", 0, 0
            elif read == VIOLENCE and negated:
                after[4] = 2 * THREAT_SPAN
            arcs[state, read] = (tuple(after), pattern, factor, holds)
    return arcs


class Grammar:
    """The composed machine, the classes and weights of words, and the weights of patterns."""

    def __init__(self, learned: dict[str, float], patterns: dict[str, float] | None = None):
        self.arcs, self.learned, self.known = compose(), learned, {}
        self.patterns = PATTERNS | (patterns or {})
        kinds = ((DETERMINERS, DETERMINER), (TARGETS, TARGET), (OBJECTS, OBJECT), (NEGATORS, NEGATION), (REPORTERS, REPORT), (THREATS, VIOLENCE), (INSULTS, INSULT))
        self.fixed = {w: (kind, FIXED) for names, kind in kinds for w in names}

    def read(self, word: str) -> tuple[int, float, bool]:
        """(class, weight, whether the clause ends here) of a raw word."""
        bare = word.strip(_STRIP)
        kind, weight = self.fixed.get(bare) or self.formed(bare)
        if kind in (OTHER, INSULT) and (found := max((self.learned.get(t, 0.0) for t in terms(bare)), default=0.0)):
            kind, weight = INSULT, max(weight, found)
        return kind, weight, word[-1] in ".!?;:"

    def formed(self, bare: str) -> tuple[int, float]:
        """(class, weight) of a form of a listed word."""
        for pattern, kind in ((VIOLENT, VIOLENCE), (INSULTING, INSULT), (CONTRACTED, NEGATION)):
            if pattern.fullmatch(bare):
                return kind, FIXED
        return OTHER, 0.0

    def emissions(self, text: str) -> list[tuple[str, float]]:
        """(pattern, probability before its weight) of what the clauses of a text emit, in order."""
        known, seen, active = self.known, [], False
        for word in text.lower().replace("\n", " . ").split():
            if (got := known.get(word)) is None:
                if len(known) > 500_000:
                    known.clear()
                got = known[word] = self.read(word)
            if got[0] in (INSULT, VIOLENCE):
                active = True
            if got[0] or got[2]:
                seen.append((got, 0))
            elif seen:
                seen[-1] = (seen[-1][0], seen[-1][1] + 1)
        return self.match(seen) if active else []

    def match(self, seen: list[tuple[tuple[int, float, bool], int]]) -> list[tuple[str, float]]:
        """Emissions of (class, weight, clause end) words, each with the number of plain words after it."""
        out, start, before = [], (0, 0, 0, 0, 0, 0), False
        state, held = start, 0.0
        for k, ((kind, weight, ends), others) in enumerate(seen):
            if kind:
                state, pattern, factor, holds = self.arcs[state, kind]
                if holds:
                    held = weight * factor
                elif pattern:
                    strength = max(held, weight * factor) if kind == INSULT else held * factor if pattern == "aimed" else factor
                    out.append((pattern, strength))
                    if pattern != "threat":
                        held = 0.0
            else:
                state = self.arcs[state, OTHER][0]
            if ends or k + 1 == len(seen):
                if held:
                    out.append(("repeated" if before else "lone", held))
                    before = True
                state, held = start, 0.0
            if not ends:
                for _ in range(min(others, BEFORE)):
                    state = self.arcs[state, OTHER][0]
        return out

    def score(self, text: str) -> float:
        clean = 1.0
        for pattern, strength in self.emissions(text):
            clean *= 1.0 - min(CAP, strength * (LONE if pattern == "lone" else self.patterns[pattern]))
        return 1.0 - clean


def terms(bare: str) -> list[str]:
    """The terms that can be learned from a word: itself, and its beginnings of 4 to 6 letters."""
    return [f"={bare}", *(f"{bare[:k]}*" for k in (4, 5, 6) if len(bare) >= k)] if len(bare) > 2 else []


def _sketches(batches):
    for pdf in batches:
        least = []
        for text in pdf["text"]:
            ws = text.lower().encode().split()
            least.append(min((zlib.crc32(b" ".join(ws[i : i + 5])) for i in range(max(len(ws) - 4, 1)))))
        yield pdf.assign(sketch=np.array(least, "int64"))


def _counts(batches):
    for pdf in batches:
        counts: dict[str, list[int]] = {}
        for text, label in zip(pdf["text"], pdf["label"], strict=True):
            for t in {t for w in set(text.lower().split()) for t in terms(w.strip(_STRIP))}:
                counts.setdefault(t, [0, 0])[label] += 1
        yield pd.DataFrame([(t, a, b) for t, (a, b) in counts.items()], columns=["term", "n0", "n1"])


def lexicon(rows: DataFrame, base: float) -> dict[str, float]:
    """Weights of the terms whose share of toxic documents is high beyond chance. base: that share of all rows."""
    counted = (
        rows.mapInPandas(_counts, "term string, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    )
    share = F.col("n1") / (F.col("n1") + F.col("n0"))
    gain = F.col("n1") * F.log(share / base) + F.col("n0") * F.log(F.greatest(1 - share, F.lit(1e-9)) / (1 - base))
    strong = counted.filter((F.col("n1") >= MIN_DOCS) & (share >= MIN_PRECISION) & (gain >= MIN_GAIN)).collect()
    kept: dict[str, float] = {}
    most: dict[str, int] = {}  # by beginning: documents of its longest-reaching kept term
    for r in sorted(strong, key=lambda r: (r["term"][0] != "=", -len(r["term"]), r["term"])):
        word = r["term"].strip("=*")
        if r["term"][0] == "=" or most.get(word, 0) < SAME * r["n1"]:
            kept[r["term"]] = min(CAP, (r["n1"] - 1) / (r["n1"] + 3 * r["n0"] + 1))
            for k in (4, 5, 6):
                most[word[:k]] = max(most.get(word[:k], 0), r["n1"])
    return kept


def pattern_weights(rows: DataFrame, learned: dict[str, float]) -> dict[str, float]:
    """Share of toxic documents among those in which a pattern is matched, drawn to its default by PRIOR documents."""

    def matched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grammar = Grammar(learned)
        for pdf in batches:
            found = [(p, int(y)) for t, y in zip(pdf["text"], pdf["label"], strict=True) for p in {p for p, _ in grammar.emissions(t)}]
            yield pd.DataFrame(found, columns=["pattern", "label"])

    counts = rows.mapInPandas(matched, "pattern string, label int").groupBy("pattern").agg(F.sum("label").alias("n1"), F.count("*").alias("n"))
    return {r["pattern"]: (r["n1"] + PRIOR * PATTERNS[r["pattern"]]) / (r["n"] + PRIOR) for r in counts.collect() if r["pattern"] in PATTERNS}


def learn(docs: DataFrame, labels: DataFrame, folds: int, fold: int, max_rows: int = MAX_ROWS) -> tuple[dict[str, float], dict[str, float]]:
    """Weights of terms and of patterns."""
    rows, _ = training_rows(docs, labels, "toxic", folds, fold, max_rows)
    sketched = rows.filter("label in (0, 1)").mapInPandas(_sketches, "text string, label int, sketch long")
    rows = stored(sketched.groupBy("sketch", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")))
    totals = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if not totals.get(1) or not totals.get(0):
        return {}, {}
    learned = lexicon(rows, totals[1] / (totals[0] + totals[1]))
    return learned, pattern_weights(rows, learned)


def scorer(learned: dict[str, float], patterns: dict[str, float]):
    """Pandas UDF from text to score; a worker builds the grammar once for each batch run."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        grammar = Grammar(learned, patterns)
        for texts in batches:
            yield pd.Series([grammar.score(t) for t in texts], dtype="float64")

    return score


def toxicity(docs: DataFrame, labels: DataFrame, folds: int, fold: int, max_rows: int = MAX_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    score = scorer(*learn(docs, labels, folds, fold, max_rows))
    scored = docs.select("doc_id", held_out(F.col("doc_id"), folds, fold), score(F.coalesce("text", F.lit(""))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op1_toxicity(spark, sf_dir):
    """Toxicity score of every document, learned outside fold 2 of 4."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), 4, 2)
