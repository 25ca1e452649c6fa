"""The indefinite article of a phrase, by how its first word sounds.

Words go by their longest listed beginning; the list is a trie, compiled to one
regular expression. Numbers, single letters and initialisms go by how they are
read aloud.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Beginnings of words and whether a vowel sound follows the article; the longest one counts.
#: ``$`` stands for the word's end.
SOUNDS = {
    "an": ("a e i o u à á â ã ä å æ è é ê ë ì í î ï ò ó ô õ ö ø ù ú û ü "
           "hour honest honor honour heir "
           "un uber unid unim unin unir unill uniss unig upo upe "
           "y yt").split(),
    "a": ("eu ewe ouija once one$ ones$ oneself oneness "
          "uni unidi unimo unit unanim unesco "
          "uba ubi uda ufo uga uka uke uki uko uku ukr uly ura ure uri uro uru usa use usi usu uta ute uti uto uva uvu "
          "ya ye yi yo yu y$").split(),
}
#: Letters whose names begin with a vowel sound.
VOWEL_NAMES = "AEFHILMNORSX"
_VOWELS = "AEIOU"


def trie_pattern(sounds: dict[str, list[str]], accept: str) -> str:
    """A pattern that matches a lower-case word exactly if its longest listed beginning is one of ``sounds[accept]``.

    Each node takes its letter and goes on, or stops where no listed letter follows, so nothing is tried twice.
    """
    trie: dict = {}
    for kind, words in sounds.items():
        for w in words:
            node = trie
            for c in w:
                node = node.setdefault(c, {})
            node[""] = kind

    def at(node: dict, inherited: str | None) -> str | None:
        kind = node.get("", inherited)
        letters = sorted(c for c in node if c)
        parts = [("(?![\\w])" if c == "$" else c) + below for c in letters if (below := at(node[c], kind)) is not None]
        if kind == accept:
            if "$" in letters:
                parts.append("(?=\\w)" + (f"(?![{''.join(c for c in letters if c != '$')}])" if len(letters) > 1 else ""))
            else:
                parts.append(f"(?![{''.join(letters)}])" if letters else "")
        if not parts:
            return None
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    return "^" + (at(trie, None) or "(?!)")


VOWEL_WORD = "(?U)" + trie_pattern(SOUNDS, "an")
#: Eight, eighty, eight hundred; eleven and eighteen, alone, in thousands, millions, or as hundreds of a year.
VOWEL_NUMBER = r"^(?:8|1[18](?:(?![0-9])|[0-9]{2}(?![0-9,])|(?:,?[0-9]{3})+(?![0-9])))"
#: One letter, or capitals that are read letter by letter: two or three of them, or more without a vowel; an s may follow.
LETTERS = rf"^(?:\p{{L}}(?![\p{{L}}\p{{N}}'])|[A-Z]{{2,3}}s?(?![\p{{L}}\p{{N}}])|(?![A-Z]*[{_VOWELS}])[A-Z]{{4,}}s?(?![\p{{L}}\p{{N}}]))"


def vowel_sound(x: Column) -> Column:
    """Whether a phrase begins with a vowel sound; marks before its first letter or digit do not count."""
    word = F.regexp_replace(x, r"^[^\p{L}\p{N}]+", "")
    spelled = F.upper(F.substr(word, F.lit(1), F.lit(1))).isin(*VOWEL_NAMES)
    return F.when(word.rlike(r"^[0-9]"), word.rlike(VOWEL_NUMBER)).when(word.rlike(LETTERS), spelled).otherwise(F.lower(word).rlike(VOWEL_WORD))


def with_article(x: Column) -> Column:
    """"a" or "an" and the phrase; null stays null."""
    return F.concat(F.when(vowel_sound(x), "an ").otherwise("a "), x)
