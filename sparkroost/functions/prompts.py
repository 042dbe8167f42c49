"""Prompt construction: brace escaping, template filling, option blocks, truncation, key names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Data set names that stand for others.
DATASET_ALIASES = {"ArcMMLU": "MMLUPro", "Ethics": "Ethics_commonsense", "GeoGraphyData": "GeoGraphyData_100k", "SuperGLUE": "SuperGLUE-RC", "WMT19": "WMT19-cs-en"}


def escape_braces(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\{\{?", "{{"), r"\}\}?", "}}")


def fill(template: str, **values: Column) -> Column:
    """The template with its ``{name}`` parts filled. It is cut on the driver, so filled values are
    never read as templates; their braces are escaped and stay doubled, the template's own doubled
    braces become single."""
    parts = []
    for piece in re.split(r"(\{\{|\}\}|\{\w+\})", template):
        if piece in ("{{", "}}"):
            parts.append(F.lit(piece[0]))
        elif re.fullmatch(r"\{\w+\}", piece):
            parts.append(F.coalesce(escape_braces(values[piece[1:-1]].cast("string")), F.lit("None")))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts) if parts else F.lit("")


def options_block(options: Column, past_z: bool = False) -> Column:
    """``A. first\\n`` and so on. Letters past Z are ``-``, or the next code points with ``past_z``."""
    letter = lambda i: F.char(i + 65) if past_z else F.when(i < 26, F.char(i + 65)).otherwise("-")
    return F.array_join(F.transform(options, lambda o, i: F.concat(letter(i), F.lit(". "), o, F.lit("\n"))), "")


def truncate_middle(c: Column, limit: int = 10_000) -> Column:
    half = limit // 2
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(half)), F.lit("..."), F.right(c, F.lit(half)))).otherwise(c)


def dataset_of(key: Column) -> Column:
    """Data set of a key, by its prefix and the alias table."""
    prefix = F.substring_index(key, "_", 1)
    out = prefix
    for name, other in DATASET_ALIASES.items():
        out = F.when(prefix == name, other).otherwise(out)
    return out


def dataset_for_prompt(key: Column, name: Column) -> Column:
    """The given data set name, else by the key: Ethics keeps two parts, ChessInstruct_mcq is whole."""
    by_key = F.when(key.startswith("Ethics"), F.substring_index(key, "_", 2)).when(key.startswith("ChessInstruct_mcq"), "ChessInstruct_mcq").otherwise(F.substring_index(key, "_", 1))
    return F.coalesce(F.nullif(name, F.lit("")), by_key)


def in_slice(name: str, dataset: Column) -> Column:
    """Rows of a data set's slice: by containment for the grouped names, else by equality."""
    if name.startswith("Ethics") or name in ("MMLUPro", "OpenTDB", "QANTA"):
        return F.contains(dataset, F.lit(name))
    if "MMLU" in name:
        return F.contains(dataset, F.lit("MMLU_"))
    return dataset == name


def prompt(template: str, question: Column, context: Column, options: Column | None = None) -> Column:
    """A prompt of one data set, truncated; an empty context is the word None."""
    text = fill(template, Question=question, Context=F.nullif(context, F.lit("")), Options=options_block(options) if options is not None else F.lit(""))
    return truncate_middle(text)


def dispatch(templates: dict[str, dict], dataset: Column, question: Column, context: Column, options: Column, answer: Column, is_stdin: Column) -> Column:
    """The prompt of a row by its data set's configuration (``prompt``, or for code ``is_stdin_prompt``
    and ``not_is_stdin_prompt``), truncated; null for a data set without one. An empty context is the
    word None, except where context and question are compared."""
    shown, out = F.nullif(context, F.lit("")), F.lit(None).cast("string")
    for name, own in templates.items():
        template = own.get("prompt") or "{Question}"
        if name == "LiveCodeBench":
            text = F.when(is_stdin, fill(own.get("is_stdin_prompt") or "{Question}", Question=question)).otherwise(fill(own.get("not_is_stdin_prompt") or "{Question}", Question=question))
        elif name == "SuperGLUE-RC":
            text = fill(template, Question=question, Answer=answer)
        elif name == "SuperGLUE-Wic":
            text = fill(template, Question=question, Context=context)
        else:
            text = fill(template, Question=question, Context=shown, Options=F.coalesce(options_block(options), F.lit("")))
        out = F.when(dataset == name, truncate_middle(text)).otherwise(out)
    return out


def file_name(c: Column, log: bool = False) -> Column:
    """A model's name as part of a file's name; for logs colons and spaces go too."""
    return F.translate(c, "/\\: " if log else "/\\", "____" if log else "__")


def has_test_type(tests: Column, kind: str) -> Column:
    """Does any test in a JSON array have this type? Malformed text: no."""
    parsed = F.from_json(tests, "array<struct<testtype:string>>")
    return F.coalesce(F.exists(parsed, lambda t: t["testtype"] == kind), F.lit(False))


def dialogue(prompt: Column) -> Column:
    """The plain-text dialogue form of a prompt, for models without a chat template."""
    gap = "\n\n" + " " * 16
    # The dialogue's opening.
    opening = f"User: hi{gap}Assistant: Hi. I am your assistant and I will provide expert full response in full details. Please feel free to ask any question and I will always answer it."
    return F.concat(F.lit(f"{opening}{gap}User: "), prompt, F.lit(f"{gap}Assistant:"))


def chat(prompt: Column, template: Column, around: dict[str, tuple[str, str]], default: tuple[str, str] = ("", "")) -> Column:
    """A prompt in the chat form of its row's template (``around``: by part of a template's name, what
    stands before and after, the first that fits; ``default`` for other names). Without a template the
    prompt is as it is; the form ``rwkv`` is :func:`dialogue`."""
    out = F.concat(F.lit(default[0]), prompt, F.lit(default[1]))
    for name, (before, after) in reversed(around.items()):
        out = F.when(F.contains(F.lower(template), F.lit(name)), F.concat(F.lit(before), prompt, F.lit(after))).otherwise(out)
    return F.when(template.isNull(), prompt).when(F.contains(template, F.lit("rwkv")), dialogue(prompt)).otherwise(out)
