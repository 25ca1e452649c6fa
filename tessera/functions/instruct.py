"""Instructions in words for question headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.articles import vowel_sound, with_article
from tessera.functions.headers import labels, strip

#: Subjects written with a capital, modifiers that ask for a subsection, and the sentences of others.
LANGUAGES = ("French", "English", "Dutch", "Spanish", "German")
SECTIONS = ("With Answer", "With Material", "With Prerequisites", "With Context", "With Hint")
SENTENCES = {
    "With Illustration": " The exercise should contain some kind of a graphic component (illustration, diagram, table, etc).",
    "With Marks": " There should be marks/points assigned to the question.",
    "With Instruction": " The exercise should have a top sentence that serve as instructions.",
    "Multi-part": " It should have multiple steps.",
}


def ordinal_suffix(n: Column) -> Column:
    return F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")


def exercise_type(t: Column) -> Column:
    """What kind of exercise is asked for; ``t`` is a comma list or the placeholder ``T``."""
    # articles go by the labels as they are written, so that initialisms count as such
    named = F.transform(labels(t), lambda x: F.concat(F.when(vowel_sound(x), "an ").otherwise("a "), F.lower(x)))
    n = F.size(named)
    init = F.array_join(F.slice(named, 1, F.greatest(n - 1, F.lit(1))), ", ")
    several = F.concat(F.lit("Give me a combination of "), init, F.when(n > 2, ",").otherwise(""), F.lit(" and "), F.element_at(named, -1))
    return F.when(t.isNull() | (t == "T"), "Give me an exercise").when(n == 1, F.concat(F.lit("Give me "), named[0])).otherwise(several)


def grade_and_subject(g: Column, s: Column) -> Column:
    n = F.try_to_number(g, F.lit("999999999")).cast("int")
    who = F.when(g.isNull() | (g == "G"), "for a student").otherwise(F.concat(F.lit("for a "), g, ordinal_suffix(n), F.lit(" grade student")))
    subject = F.when(s.isin(*LANGUAGES), s).otherwise(F.lower(s))
    return F.concat(who, F.when(s.isNull() | (s == "S"), ".").otherwise(F.concat(F.lit(" learning "), subject, F.lit("."))))


def modifier(m: Column, compat: bool = False) -> Column:
    """Sentences for a comma list of modifiers; empty for the placeholder ``M``.

    ``compat``: a modifier is a subsection if it is part of their names joined by
    blanks, as it stands between commas, so the first name is none after a comma.
    """
    each = labels(m)
    if compat:
        raw, joined = F.split(m, ","), F.lit(" ".join(SECTIONS))
        member = lambda x: F.exists(raw, lambda y: (strip(y) == x) & (F.instr(joined, y) > 0))
    else:
        member = lambda x: x.isin(*SECTIONS)
    sections = F.transform(F.filter(each, member), lambda x: F.lower(F.replace(x, F.lit("With "), F.lit(""))))
    plural = F.transform(sections, lambda x: F.when((x == "context") | x.endswith("s"), x).otherwise(F.concat(x, F.lit("s"))))
    n = F.size(plural)
    first = F.array_join(F.slice(plural, 1, F.greatest(n - 1, F.lit(1))), ", ")
    listed = F.when(n == 0, "").otherwise(F.concat(F.lit(" It should have a subsection for "), first, F.when(n > 1, F.concat(F.lit(", and "), F.element_at(plural, -1))).otherwise(""), F.lit(".")))

    def sentence(x: Column) -> Column:
        words = F.split(x, " ")
        at = F.instr(x, "with")
        involving = F.when(F.get(words, F.lit(1)) == "with", F.concat(F.substr(x, F.lit(1), at - 1), F.lit("involving"), F.substr(x, at + 4))).otherwise(x)
        out = F.concat(F.lit(" It should be "), with_article(F.replace(involving, words[0], F.lower(words[0]))), F.lit("."))
        for name, text in SENTENCES.items():
            out = F.when(x == name, text).otherwise(out)
        return out

    others = F.array_join(F.transform(F.filter(each, lambda x: ~member(x)), sentence), "")
    return F.when(m.isNull() | (m == "M"), "").otherwise(F.concat(listed, others))


def instruction(s: Column, t: Column, g: Column, m: Column) -> Column:
    return F.concat(exercise_type(t), F.lit(" "), grade_and_subject(g, s), modifier(m))
