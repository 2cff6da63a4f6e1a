"""Nested LaTeX environments: checked, or cut out of a text, in one pass over its marks."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = re.compile(r"\\(begin|end)\{([^}]+)\}")


def nesting_errors(text: str) -> list[str]:
    """Messages about environments that close out of order, close nothing or stay open. One pass with the names still open;
    nothing after the last brace can name one."""
    names, errors = [], []
    for hit in MARK.finditer(text, 0, text.rfind("}") + 1):
        name = hit.group(2)
        if hit.group(1) == "begin":
            names.append(name)
            continue
        last = names.pop() if names else None
        if last is None:
            errors.append("Unmatched \\end{" + name + "}")
        elif last != name:
            errors.append("Environment nesting error: expected \\end{" + last + "}, found \\end{" + name + "}")
    return errors + (["Unclosed environments remaining: " + ", ".join(names)] if names else [])


@F.pandas_udf(T.ArrayType(T.StringType()))
def environment_errors(latex: pd.Series) -> pd.Series:
    return pd.Series([None if text is None else nesting_errors(text) for text in latex], dtype=object)


def drop_environment(text: str, name: str, replacement: str) -> str:
    """Replace every outermost environment of that name; an unclosed one runs to the end of the text."""
    token = re.compile(r"\\(begin|end)\{" + re.escape(name) + r"\}")
    out, depth, start, kept_from = [], 0, 0, 0
    for hit in token.finditer(text):
        if hit.group(1) == "begin":
            if depth == 0:
                out.append(text[kept_from : hit.start()])
                start = hit.start()
            depth += 1
        elif depth:
            depth -= 1
            if depth == 0:
                out.append(replacement)
                kept_from = hit.end()
    if depth:
        return "".join(out) + replacement
    return "".join(out) + text[kept_from:]


def environment_dropper(names: list[str], replacement: str):
    """Arrow function that replaces nested environments by name."""

    @F.pandas_udf(T.StringType())
    def drop(latex: pd.Series) -> pd.Series:
        for name in names:
            latex = latex.map(lambda text: drop_environment(text, name, replacement) if text and "\\begin{" + name + "}" in text else text)
        return latex

    return drop
