"""English word stems in columns: the published suffix-stripping algorithm known as Porter2.

A stem is built from some fifty regular expressions, so stems() takes a table of different words, not texts. Words
are lower-case letters; digits and letters of other alphabets count as consonants and pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The algorithm's classes, endings and exceptions.
V = "[aeiouy]"
NOT_V = "[^aeiouy]"
#: What stands before the first region: through the first consonant after a vowel, or one of three beginnings.
BEFORE_R1 = f"(?:gener|commun|arsen|(?!gener|commun|arsen){NOT_V}*{V}+{NOT_V})"
R1 = f"^{BEFORE_R1}"
R2 = f"^{BEFORE_R1}{NOT_V}*{V}+{NOT_V}"
SHORT_END = f"(?:^{V}{NOT_V}|{NOT_V}{V}[^aeiouywxY])$"
EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
UNCHANGED = ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")
UNCHANGED_AFTER_PLURAL = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
STEP_2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less",
    "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful",
    "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
#: Words that searches leave out.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this "
    "that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through "
    "during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not "
    "only own same so than too very s t can will just don should now"
).split()


def _ends(w: Column, ending: str) -> Column:
    return F.endswith(w, F.lit(ending))


def _without(w: Column, ending: str, instead: str = "") -> Column:
    return F.concat(F.substring(w, F.lit(1), F.length(w) - len(ending)), F.lit(instead))


def _within(w: Column, ending: str, region: str) -> Column:
    """Whether the ending stands wholly in a region (R1 or R2)."""
    return F.substring(w, F.lit(1), F.length(w) - len(ending)).rlike(region)


def _longest(w: Column, rules: dict[str, tuple[Column, Column]]) -> Column:
    """The result of the longest of the endings that w has, if its condition holds, else w."""
    out = None
    for ending in sorted(rules, key=len, reverse=True):
        holds, result = rules[ending]
        done = F.when(holds, result).otherwise(w)
        out = F.when(_ends(w, ending), done) if out is None else out.when(_ends(w, ending), done)
    return out.otherwise(w)


def _plural(w: Column) -> Column:
    dies = F.when(F.length(w) > 4, _without(w, "ies", "i")).otherwise(_without(w, "ies", "ie"))
    always = F.lit(True)
    return _longest(w, {"sses": (always, _without(w, "sses", "ss")), "ied": (always, dies), "ies": (always, dies), "us": (~always, w), "ss": (~always, w), "s": (w.rlike(f"{V}.+s$"), _without(w, "s"))})


def _past(w: Column) -> Column:
    def cut(ending: str) -> tuple[Column, Column]:
        rest = _without(w, ending)
        short = rest.rlike(SHORT_END) & ~rest.rlike(R1 + ".")
        mended = F.when(rest.rlike("(?:at|bl|iz)$"), F.concat(rest, F.lit("e"))).when(rest.rlike("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), _without(rest, "x")).when(short, F.concat(rest, F.lit("e"))).otherwise(rest)
        return rest.rlike(V), mended

    return _longest(w, {e: cut(e) for e in ("ed", "edly", "ing", "ingly")} | {e: (_within(w, e, R1), _without(w, e, "ee")) for e in ("eed", "eedly")})


def _derived(w: Column) -> Column:
    rules = {e: (_within(w, e, R1), _without(w, e, to)) for e, to in STEP_2.items()}
    rules["ogi"] = (_within(w, "ogi", R1) & _ends(w, "logi"), _without(w, "ogi", "og"))
    rules["li"] = (_within(w, "li", R1) & w.rlike("[cdeghkmnrt]li$"), _without(w, "li"))
    return _longest(w, rules)


def _adjective(w: Column) -> Column:
    rules = {e: (_within(w, e, R1), _without(w, e, to)) for e, to in STEP_3.items()}
    rules["ative"] = (_within(w, "ative", R2), _without(w, "ative"))
    return _longest(w, rules)


def _noun(w: Column) -> Column:
    rules = {e: (_within(w, e, R2), _without(w, e)) for e in STEP_4}
    rules["ion"] = (_within(w, "ion", R2) & w.rlike("[st]ion$"), _without(w, "ion"))
    return _longest(w, rules)


def _last(w: Column) -> Column:
    rest = _without(w, "e")
    goes = rest.rlike(R2) | (rest.rlike(R1) & ~rest.rlike(SHORT_END))
    return F.when(_ends(w, "e"), F.when(goes, rest).otherwise(w)).when(_ends(w, "ll") & _within(w, "l", R2), _without(w, "l")).otherwise(w)


def _named(w: Column, step: Callable[[Column], Column]) -> Column:
    """step(w), with w a name inside it: an expression that a step reads often stays one."""
    return F.get(F.transform(F.array(w), step), F.lit(0))


def _stem(word: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in EXCEPTIONS.items() for x in pair))
    marked = F.regexp_replace(F.regexp_replace(word, "^y", "Y"), "(?<=[aeiouy])y", "Y")

    def rest(w: Column) -> Column:
        for step in (_past, lambda x: F.regexp_replace(x, f"(?<=.{NOT_V})[yY]$", "i"), _derived, _adjective, _noun, _last):
            w = _named(w, step)
        return w

    whole = F.lower(_named(_named(marked, _plural), lambda w: F.when(w.isin(*UNCHANGED_AFTER_PLURAL), w).otherwise(rest(w))))
    return F.when(word.isin(*UNCHANGED) | (F.length(word) <= 2), word).otherwise(F.coalesce(F.element_at(known, word), whole))


def stems(words: DataFrame, word: str = "term", out: str = "stem") -> DataFrame:
    """words with the stem of each; null stays null."""
    return words.withColumn(out, _named(F.col(word), _stem))
