"""Answer extraction and normalisation as native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that define which answer is extracted.
BOXED = r"\\boxed\{([^}]+)\}"
MCQ_COLON = r"(?i)answer\s*:\s*([A-Z])"
MCQ_OPTION = r"(?i)(?:option|choice|select)[:\s]*([A-Z])"
MCQ_ALT = r"(?i)(?:the\s+)?(?:answer|choice)\s*[:\-]\s*([A-Z])"
LETTER = r"(?<![\p{L}\p{N}_])([A-Z])(?![\p{L}\p{N}_])"
MATH = [
    r"(?i)(?:the\s+)?(?:final\s+)?answer\s*[:\-]\s*([^\n]+)",
    r"(?i)(?:result|solution)\s*[:\-]\s*([^\n]+)",
    r"(?i)(?:answer|result)\s*[:\-]\s*(\d+(?:\.\d+)?)",
    r"(?i)(?:the\s+)?(?:answer|result)\s+is\s+([^\n]+)",
]
NUMBER = r"\b(\d+(?:\.\d+)?)\b"
QUOTED, PARENTHESES, BRACKETS = r"[\"']([^\"']+)[\"']", r"\(([^)]+)\)", r"\[([^\]]+)\]"
COLON_TAIL = r"(?i)(?:answer|result|solution)[:\s]+([^\n]+)"
CHESS, CHESS_ALT = r"(?i)\b([a-h][1-8][a-h][1-8])\b", r"(?i)(?:move|play)[:\s]*([a-h][1-8][a-h][1-8])"
FENCE_PYTHON, FENCE = r"(?is)```python\s*\n(.*?)\n```", r"(?is)```(?:python)?\s*\n(.*?)\n```"
FUNCTION_BODY = r"(?is)def\s+\w+\([^)]*\):\s*\n(.*?)(?=\n\w|\n```|\z)"
CLEANUP = [
    r"^(?:the\s+)?(?:answer|result|solution)\s*[:\-]\s*",
    r"^(?:option|choice)\s*[:\-]\s*",
    r"^(?:letter|choice)\s*[:\-]\s*",
    r"\s*[:\-]\s*(?:is\s+)?the\s+(?:answer|result|solution)\.?$",
    r"\s*[:\-]\s*(?:is\s+)?correct\.?$",
    r"^[:\-\s]+",
    r"[:\-\s]+$",
    r"\.$",
    r"^[\"']|[\"']$",
    r"^(?:the\s+)?(?:final\s+)?answer\s+is\s+",
    r"^(?:the\s+)?answer\s+is\s+",
    r"^(?:the\s+)?result\s+is\s+",
]
#: White space as Python's strip() sees it.
_SPACE = "[\\s\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{_SPACE}|{_SPACE}$", "")


def filled(c: Column) -> Column:
    """Null for an empty text: a falsy value falls through. (``nullif`` would have ``c`` twice, and
    ladders of it outgrow a method of generated code.)"""
    return F.get(F.filter(F.array(c), lambda x: x != ""), F.lit(0))


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f(c)`` with ``c`` evaluated once."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(1))


def first_match(c: Column, pattern: str) -> Column:
    return F.try_element_at(_all(c, pattern), F.lit(1))


def last_match(c: Column, pattern: str) -> Column:
    return F.try_element_at(_all(c, pattern), F.lit(-1))


def has_boxed(c: Column) -> Column:
    return F.contains(c, F.lit("\\boxed{"))


def boxed(c: Column) -> Column:
    """The first box's content without its text macro; null if blank, later boxes are not tried."""
    return filled(strip(first_match(F.replace(c, F.lit("\\text{"), F.lit("")), BOXED)))


def boxed_balanced(c: Column) -> Column:
    """The first box with balanced braces; null if it is not closed or empty."""
    start = F.locate("\\boxed{", c)
    rest = c.substr(start + 7, F.length(c))
    state = F.aggregate(
        F.split(rest, ""),
        F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n")),
        lambda s, ch: F.when(s["depth"] == 0, s).otherwise(
            F.struct((s["depth"] + F.when(ch == "{", 1).when(ch == "}", -1).otherwise(0)).alias("depth"), (s["n"] + 1).alias("n"))
        ),
    )
    nested = F.when(state["depth"] == 0, filled(strip(rest.substr(F.lit(1), state["n"] - 1))))
    # a box without inner braces needs no count of them
    return F.when(has_boxed(c), F.when(rest.rlike(r"^[^{}]*\}"), filled(strip(F.substring_index(rest, "}", 1)))).otherwise(nested))


def clean(c: Column) -> Column:
    out = strip(c)
    for p in CLEANUP:
        out = F.regexp_replace(out, "(?i)" + p, "")
    return strip(F.regexp_replace(out, _SPACE, " "))


def mcq(c: Column) -> Column:
    """Letter of a multiple-choice answer; null if none."""
    up = lambda p: F.upper(first_match(c, p))
    return F.coalesce(up(MCQ_COLON), up(MCQ_OPTION), up(MCQ_ALT), last_match(c, LETTER))


def math_ladder(c: Column) -> Column:
    return F.coalesce(*[filled(clean(first_match(c, p))) for p in MATH])


def math_or_number(c: Column) -> Column:
    return F.coalesce(math_ladder(c), last_match(c, NUMBER))


def general(c: Column) -> Column:
    tails = [strip(last_match(c, p)) for p in (QUOTED, PARENTHESES, BRACKETS)]
    return F.coalesce(*tails, filled(clean(last_match(c, COLON_TAIL))))


def code_block(c: Column) -> Column:
    return F.coalesce(*[strip(last_match(c, p)) for p in (FENCE_PYTHON, FENCE, FUNCTION_BODY)])


def fallback(c: Column) -> Column:
    return F.coalesce(last_match(c, LETTER), strip(c))


def answer(c: Column, dataset: str | None = None) -> Column:
    """The extracted answer of a text; blank gives the empty text."""

    def ladder(t: Column) -> Column:
        if dataset == "LiveCodeBench":
            found = code_block(t)
        elif dataset == "SuperGLUE-ClozeTest":
            found = F.upper(t.substr(1, 1))
        else:
            found = F.coalesce(mcq(t), math_ladder(t), filled(general(t)))
        return F.when(t == "", "").otherwise(F.coalesce(boxed(t), filled(found), fallback(t)))

    return let(strip(F.coalesce(c, F.lit(""))), ladder)


def math_answer(c: Column) -> Column:
    return let(strip(F.coalesce(c, F.lit(""))), lambda t: F.when(t == "", "").otherwise(F.coalesce(boxed_balanced(t), math_or_number(t), t)))


def chess_squares(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def chess_move(c: Column) -> Column:
    return let(strip(F.coalesce(c, F.lit(""))), lambda t: F.when(t == "", "").otherwise(chess_squares(F.coalesce(boxed(t), last_match(t, CHESS), last_match(t, CHESS_ALT), fallback(t)))))


def normalize_english(c: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces, in this order."""
    t = F.regexp_replace(F.lower(c), r"[!-/:-@\[-`{-~]", "")
    t = F.regexp_replace(t, r"(?<![\p{L}\p{N}_])(a|an|the)(?![\p{L}\p{N}_])", " ")
    return strip(F.regexp_replace(t, _SPACE, " "))


# The marks that Chinese normalisation takes off, besides those of ASCII.
CJK_MARKS = "！？｡。＂＃＄％＆＇（）＊＋，－／：；＜＝＞＠［＼］＾＿｀｛｜｝～｟｠｢｣､、〃》「」『』【】〔〕〖〗〘〙〚〛〜〝〞〟〰〾〿–—‘’‛“”„‟…‧﹏."


def normalize_chinese(c: Column) -> Column:
    """Lower case without ASCII and CJK marks and without any white space."""
    marks = "".join(f"\\u{ord(x):04x}" for x in CJK_MARKS)
    return F.regexp_replace(F.lower(c), f"[!-/:-@\\[-`{{-~{marks}]|{_SPACE}", "")


def characters(c: Column) -> Column:
    """A text's words for languages without spaces: each CJK character, and runs of other letters."""
    return F.regexp_extract_all(F.lower(c), F.lit("([\u4e00-\u9fff]|[^\\s\u4e00-\u9fff]+)"), F.lit(1))


def normalize_exact(c: Column) -> Column:
    return strip(F.regexp_replace(F.lower(F.replace(c, F.lit("_"), F.lit(" "))), _SPACE, " "))


def tokens(c: Column) -> Column:
    """Lower-cased words; a text with a CJK character is cut into characters."""
    t = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", " ")
    own = F.when(t.rlike("[\u4e00-\u9fff]"), F.split(F.regexp_replace(t, _SPACE, ""), "")).otherwise(F.split(strip(t), _SPACE))
    return F.filter(own, lambda x: x != "")
