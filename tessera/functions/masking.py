"""Blanking of what stands in comments, scripts, styles and quoted attribute values, by state and in plain expressions.

A text is cut at the few strings that can change the state. A mark is a function from states to states, written as the
string of the states that it leads to; applying it to a state, or composing it with another one, is one `translate`. The
states after each mark are the running composition of these functions from the start on, so no piece of text is looked at
twice. Lengths, line breaks and places stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: States: text between tags, inside a tag, inside a quoted value of either kind, a comment, a script or a style.
TEXT, TAG, DOUBLE, SINGLE, COMMENT, SCRIPT, STYLE = range(7)
#: What can change the state. A `<` begins a tag only before a letter, a slash or an exclamation mark.
MARK = r"(?i)<!--|-->|<script\b|<style\b|</script\s*>|</style\s*>|<[a-z/!]|>|\"|'"
#: Scripts and styles begin at the end of their opening tag, so such a tag and the values in it have states of their own.
IN_SCRIPT_TAG, IN_STYLE_TAG, SCRIPT_DOUBLE, SCRIPT_SINGLE, STYLE_DOUBLE, STYLE_SINGLE = range(7, 13)
NEXT: dict[str, dict[int, int]] = {
    "<!--": {TEXT: COMMENT}, "-->": {COMMENT: TEXT, TAG: TEXT, IN_SCRIPT_TAG: SCRIPT, IN_STYLE_TAG: STYLE},
    "<script": {TEXT: IN_SCRIPT_TAG}, "<style": {TEXT: IN_STYLE_TAG}, "</script>": {SCRIPT: TEXT}, "</style>": {STYLE: TEXT},
    "<": {TEXT: TAG}, ">": {TAG: TEXT, IN_SCRIPT_TAG: SCRIPT, IN_STYLE_TAG: STYLE},
    '"': {TAG: DOUBLE, DOUBLE: TAG, IN_SCRIPT_TAG: SCRIPT_DOUBLE, SCRIPT_DOUBLE: IN_SCRIPT_TAG, IN_STYLE_TAG: STYLE_DOUBLE, STYLE_DOUBLE: IN_STYLE_TAG},
    "'": {TAG: SINGLE, SINGLE: TAG, IN_SCRIPT_TAG: SCRIPT_SINGLE, SCRIPT_SINGLE: IN_SCRIPT_TAG, IN_STYLE_TAG: STYLE_SINGLE, STYLE_SINGLE: IN_STYLE_TAG},
}
#: States whose text is blanked.
BLANKED = (DOUBLE, SINGLE, COMMENT, SCRIPT, STYLE, SCRIPT_DOUBLE, SCRIPT_SINGLE, STYLE_DOUBLE, STYLE_SINGLE)


def blank(text: Column) -> Column:
    """Spaces for all but line breaks."""
    return F.regexp_replace(text, r"[^\r\n]", " ")


NAMES = "0123456789abc"


def function_of(moves: dict[int, int]) -> str:
    """A mark as the states that it leads to from each state."""
    return "".join(NAMES[moves.get(s, s)] for s in range(len(NAMES)))


def effect(mark: Column) -> Column:
    """The function of a mark as it stands in a text."""
    name = F.regexp_replace(F.lower(mark), r"\s+", "")
    name = F.when(name.rlike("^<[a-z/!]$"), "<").otherwise(name)
    return F.element_at(F.create_map(*[F.lit(x) for n, moves in NEXT.items() for x in (n, function_of(moves))]), name)


def masked_markup(html: Column) -> Column:
    """The text with comments, scripts, styles and quoted attribute values blanked, of the same length. What is not closed is
    blanked to the end. A null text stays null."""
    marks = F.regexp_extract_all(html, F.lit(MARK), F.lit(0))
    pieces = F.split(html, MARK, -1)
    apply = lambda state, mark: F.call_function("translate", state, F.lit(NAMES), effect(mark))
    start = F.struct(F.lit(NAMES[TEXT]).alias("now"), F.lit(NAMES[TEXT]).alias("all"))

    def fold(acc: Column, mark: Column) -> Column:
        now = apply(acc["now"], mark)
        return F.struct(now.alias("now"), F.concat(acc["all"], now).alias("all"))

    # The states at the pieces, the first before any mark, as single characters.
    states = F.split(F.aggregate(marks, start, fold, lambda acc: acc["all"]), "")
    inside = lambda s: s.isin(*[NAMES[b] for b in BLANKED])
    rows = F.arrays_zip(pieces.alias("piece"), F.concat(F.array(F.lit("")), marks).alias("mark"), states.alias("after"), F.concat(F.array(F.lit(NAMES[TEXT])), states).alias("before"))

    def shown(x: Column) -> Column:
        """A mark and the piece after it. A mark is blanked where it neither opens nor closes what it stands in."""
        mark = F.when(inside(x["before"]) & (x["before"] == x["after"]), blank(x["mark"])).otherwise(x["mark"])
        return F.concat(mark, F.when(inside(x["after"]), blank(x["piece"])).otherwise(x["piece"]))

    return F.array_join(F.transform(F.slice(rows, F.lit(1), F.size(pieces)), shown), "")
