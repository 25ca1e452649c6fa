"""Articles by sound: a table of words, checked word by word."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tessera.functions import articles, instruct

AN = """apple essay exercise art algebra answer umbrella uncle ugly under urgent ulcer ultimate upper utter usher urban urn
unimportant uninteresting Uninformed uninvited unidentified unintended unimpressed unimaginative uninhabited uninstalled unironic unillustrated unissued
unable uneven unusual unused unequal uneasy unopened unofficial unaware unarmed unabridged unordered understanding unfair upright upon upended up us
onerous onion only onward online oncoming onset ongoing hour hourly hourglass honest honesty honour honorary heir heirloom heiress
X-ray S-bend F-test A-level L-shaped M-class N-gram R-value H-bomb 8 8th 80 88 800 8,000 11 11th 18 18-year 11,000 18,000,000 1850 1100 8.5
MCQ MCQs MRI FAQ LED IQ ADHD EU SQL HTML NGO FBI SAT ESL OCR HTTP ICT LCD RSVP AI x
école État ice-cream idea oak ear eel egg eight eleven eighteen elephant evening euro-free-not ytterbium yttrium umami üben "apple [exercise
I a e""".replace("euro-free-not", "energy").split()
A = """book quiz word reading game hat hotel house history horse herb hospital history-lesson human hero happy
unit unique uniform union universe universal university unicorn unilateral unison unisex united unity unified unimodal unidirectional unidimensional unanimous
use useful user usual usage utility utopia utensil uranium urine Uruguay Ugandan Ukrainian ukulele ubiquitous uvula usurper UFO Ural
one one-day once oneself oneness European eulogy euphoria euro eucalyptus ewe ouija yes year yellow young yard yoga Y
T-shirt U-turn P-value D-day C-major B-flat G-string K-means Q-tip V-neck W-shaped Z-score J-curve
1 7 10 12 100 110 180 1,800,00 1000 17 19 70 1.8 9 2nd 3rd 15-minute 181 1,100
PDF URL USB UK USA UN PhD TV CD DNA GPS BBC VIP UFOs NASA UNESCO NATO STEM
dog cat zebra xylophone xenon year-long walk whale "book (quiz
b u""".replace("1,800,00 ", "").split()


def test_table(spark):
    assert len(AN) + len(A) >= 200
    rows = [(w, "an") for w in AN] + [(w, "a") for w in A]
    df = spark.createDataFrame(rows, "w string, want string").select("w", "want", articles.with_article(F.col("w")).alias("got"))
    assert [(r["w"], r["got"]) for r in df.collect() if r["got"] != f"{r['want']} {r['w']}"] == []


def test_trie_is_the_longest_match():
    words = ["", "u", "un", "uni", "unit", "units", "unid", "unidi", "one", "ones", "onesie", "oner", "y", "yt", "ya", "hour", "hou", "euro", "ew", "ewes"]
    pattern = re.compile(articles.trie_pattern(articles.SOUNDS, "an"))
    for w in words:
        fits = [(len(s), kind) for kind, sounds in articles.SOUNDS.items() for s in sounds if (w == s[:-1] if s.endswith("$") else w.startswith(s))]
        assert bool(pattern.match(w)) == (max(fits, default=(0, "a"))[1] == "an"), w


def test_instructions_use_them(spark):
    df = spark.createDataFrame([("MCQ, unimportant Essay, 8 Step Plan",), ("Unit Test",), ("",), (None,)], "t string")
    got = [r["x"] for r in df.select(instruct.exercise_type(F.col("t")).alias("x")).collect()]
    assert got == ["Give me a combination of an mcq, an unimportant essay, and an 8 step plan", "Give me a unit test", "Give me a ", "Give me an exercise"]
