"""Facts from sentences, as Columns: a sentence is cut at a verb phrase into subject, relation and object."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What somebody says of themselves or their team: phrase, relation, negated, confidence.
FIRST_PERSON = [
    ("no longer use", "uses", True, 0.9),
    ("stopped using", "uses", True, 0.9),
    ("don't use", "uses", True, 0.9),
    ("do not use", "uses", True, 0.9),
    ("quit using", "uses", True, 0.9),
    ("are using", "uses", False, 0.85),
    ("am using", "uses", False, 0.85),
    ("use", "uses", False, 0.85),
    ("prefer", "prefers", False, 0.85),
    ("learned", "learned", False, 0.8),
    ("know", "learned", False, 0.8),
    ("decided to", "decided", False, 0.8),
    ("agreed to", "decided", False, 0.8),
]
#: What is said of a thing: phrase, relation, confidence.
OF_THINGS = [
    ("is built with", "built_with", 0.8),
    ("is built on", "built_with", 0.8),
    ("was built with", "built_with", 0.8),
    ("is enforced by", "enforced_by", 0.8),
    ("depends on", "depends_on", 0.75),
    ("runs on", "runs_on", 0.75),
    ("is an", "is_a", 0.7),
    ("is a", "is_a", 0.7),
    ("owns", "owns", 0.75),
    ("uses", "uses", 0.75),
]
#: What happened: the verb is the relation.
HAPPENED = ["deployed", "released", "launched", "migrated", "finished", "completed", "started", "fixed", "merged", "installed", "upgraded", "created", "removed"]
SPEAKERS = ["i", "we", "our team", "the team"]
ADVERBS = ["just", "finally", "always", "also", "now", "usually"]
#: Words that make a sentence a guess, and words that end an object.
GUESSES = ["maybe", "might", "perhaps", "probably", "possibly", "i think", "i guess", "not sure"]
ENDS = [",", " because ", " since ", " when ", " so that ", " which ", " for "]


def sentences(text: Column) -> Column:
    """Sentences in lower case with a space at either side; a dot ends one only before white space, and guesses say nothing."""
    parts = F.transform(F.split(F.regexp_replace(text, r"\.(?=\s|$)", "\n"), r"[!?;\n]+"), lambda s: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(s), r"\s+", " ")), F.lit(" ")))

    def sure(s: Column) -> Column:
        out = F.trim(s) != ""
        for word in GUESSES:
            out = out & ~F.contains(s, F.lit(f" {word} "))
        return out

    return F.filter(parts, sure)


def _until_end(text: Column) -> Column:
    for end in ENDS:
        text = F.substring_index(text, end, 1)
    return F.trim(text)


def _fact(subject: Column, relation: str, obj: Column, negated: bool, confidence: float) -> Column:
    return F.struct(subject.alias("subject"), F.lit(relation).alias("relation"), _until_end(obj).alias("object"), F.lit(negated).alias("is_negation"), F.lit(confidence).alias("confidence"))


def facts(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """``id, subject, relation, object, is_negation, confidence`` of each sentence, by the first phrase that cuts it.

    "use A instead of B" also says that B isn't used, "switched from A to B"
    that A isn't; what somebody says of themselves has the subject 'user'.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.explode(sentences(text)).alias("s"))
    said = F.regexp_replace("s", rf"\s(?:{'|'.join(ADVERBS)})(?=\s)", "")
    speaker = rf"^ (?:{'|'.join(SPEAKERS)}) "
    rows = rows.select("id", said.alias("s")).select("id", "s", F.regexp_replace("s", speaker, " ").alias("own"), F.col("s").rlike(speaker).alias("first"))
    user, own, s = F.lit("user"), F.col("own"), F.col("s")

    def after(c: Column, phrase: str) -> Column:
        return F.substr(c, F.locate(f" {phrase} ", c) + len(phrase) + 2)

    cases: list[tuple[Column, Column]] = []
    moved = own.startswith(" switched from ") & F.contains(own, F.lit(" to "))
    rest = after(own, "switched from")
    cases.append((F.col("first") & moved, F.array(_fact(user, "uses", F.substring_index(rest, " to ", 1), True, 0.9), _fact(user, "uses", F.substring_index(rest, " to ", -1), False, 0.9))))
    swapped = own.startswith(" use ") & F.contains(own, F.lit(" instead of "))
    rest = after(own, "use")
    cases.append((swapped, F.array(_fact(user, "uses", F.substring_index(rest, " instead of ", -1), True, 0.85), _fact(user, "uses", F.substring_index(rest, " instead of ", 1), False, 0.85))))
    for phrase, relation, negated, confidence in FIRST_PERSON:
        obj = F.substring_index(after(own, phrase), " over ", 1)
        cases.append((F.col("first") & own.startswith(f" {phrase} "), F.array(_fact(user, relation, obj, negated, confidence))))
    for verb in HAPPENED:
        cases.append((F.col("first") & own.startswith(f" {verb} "), F.array(_fact(user, verb, after(own, verb), False, 0.8))))
    for phrase, relation, confidence in OF_THINGS:
        subject = F.trim(F.substring_index(s, f" {phrase} ", 1))
        cases.append((~F.col("first") & F.contains(s, F.lit(f" {phrase} ")) & F.length(subject).between(2, 40), F.array(_fact(subject, relation, after(s, phrase), False, confidence))))
    found = F.when(cases[0][0], cases[0][1])
    for condition, made in cases[1:]:
        found = found.when(condition, made)
    return rows.select("id", F.explode(found).alias("f")).select("id", "f.*").where("object <> ''").distinct()
