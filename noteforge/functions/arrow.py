"""Arrow functions where SQL has no form: line similarity, diffs, hashtags in context, small YAML, JSON in prose."""

from __future__ import annotations

import bisect
import difflib
import json
import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from noteforge.session import ship_package


def _line_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([1.0 if x == y else difflib.SequenceMatcher(None, x.splitlines(), y.splitlines()).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def _unified_diff(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([list(difflib.unified_diff(x.splitlines(), y.splitlines(), "original", "duplicate", lineterm="", n=3))[:20] for x, y in zip(a, b, strict=True)])


HASHTAG = re.compile("(?<![`\\w])#([\U0001f300-\U0001f9ff☀-➿]*[a-zA-Z][a-zA-Z0-9_/-]*)")
MARKS = {"[[": re.compile(r"(?=\[\[)"), "]]": re.compile(r"(?=\]\])"), "(": re.compile(r"\("), ")": re.compile(r"\)"), "```": re.compile("```")}


def find_hashtags(text: str) -> list[tuple[int, int, str]]:
    """(start, end, tag) of hashtags to escape: behind the frontmatter, without a slash, and not inside code or a link.
    Code: an odd number of ``` in front of the tag, or of single backticks in its line. Links: a [[ in front without ]]
    behind it, or the last ( in front follows a ] and has no ) behind it. The places of marks are looked up by bisection."""
    begin = text.find("---", 3) + 3 if text.startswith("---") and text.find("---", 3) >= 0 else 0
    found = [m for m in HASHTAG.finditer(text, begin) if "/" not in m.group(1)]
    places = {k: [m.start() for m in p.finditer(text)] for k, p in MARKS.items()} if found else {}

    def last(mark: str, end: int) -> int:
        """Where the last such mark stands that ends before `end`; -1 without."""
        i = bisect.bisect_right(places[mark], end - len(mark))
        return places[mark][i - 1] if i else -1

    out = []
    for m in found:
        at = m.start()
        line = text[text.rfind("\n", 0, at) + 1 : at]
        fence = bisect.bisect_right(places["```"], at - 3) % 2 == 1
        inline = (line.count("`") - 3 * line.count("```")) % 2 == 1
        wiki = last("[[", at) > last("]]", at)
        paren = last("(", at)
        url = paren > 0 and text[paren - 1] == "]" and last(")", at) < paren
        if not (fence or inline or wiki or url):
            out.append((at, m.end(), m.group(1)))
    return out


def _hashtags(text: str | None) -> list[tuple[int, int, str]]:
    return find_hashtags(text or "")


def _escape_hashtags(text: str | None) -> str | None:
    if text is None:
        return None
    at, parts = 0, []
    for a, b, _ in find_hashtags(text):
        parts += [text[at:a], "`", text[a:b], "`"]
        at = b
    return "".join(parts) + text[at:]


def small_yaml(text: str) -> dict[str, str]:
    """Keys of a frontmatter block. A value of | or > takes all lines that follow as they are; lines with two blanks in
    front and no colon continue another value; quotes go from a value that starts with one. A key with nothing behind
    its colon is left out unless lines follow, one with empty quotes is empty."""
    rows = text.split("\n")
    end = next((i for i, r in enumerate(rows) if i and r.strip() == "---"), 0)
    if not text.startswith("---") or not end:
        return {}
    entries: list[tuple[str, list[str]]] = []
    block = False
    for row in rows[1:end]:
        if block:
            entries[-1][1].append(row)
        elif ":" in row:
            key, value = (x.strip() for x in row.split(":", 1))
            block = value in ("|", ">")
            entries.append((key, [] if block or not value else [value.strip('"').strip("'") if value[0] in "\"'" else value]))
        elif entries and row.startswith("  "):
            entries[-1][1].append(row.strip())
    return {key: "\n".join(held).strip() for key, held in entries if key and held}


def _mini_yaml(text: str | None) -> dict[str, str]:
    return small_yaml(text or "")


def json_object(text: str) -> str | None:
    """The first {...} of a reply as JSON text, braces counted wherever they stand; null if it does not parse."""
    text = re.sub(r"```(?:json)?", "", text)
    start = text.find("{")
    if start < 0:
        return None
    depth = 0
    for i in range(start, len(text)):
        depth += {"{": 1, "}": -1}.get(text[i], 0)
        if depth == 0:
            try:
                return json.dumps(json.loads(text[start : i + 1]))
            except ValueError:
                return None
    return None


def _json_object_span(text: pd.Series) -> pd.Series:
    return pd.Series([json_object(x) if isinstance(x, str) else None for x in text], dtype=object)


# Functions of columns. Each makes its Arrow function on the driver when it is called: workers import this module too.


def arrow_function(f, kind: str, *cols) -> Column:
    ship_package(SparkSession.getActiveSession())
    return F.pandas_udf(f, kind)(*cols)


def line_similarity(a, b) -> Column:
    """Ratcliff-Obershelp ratio of the lines of a and b, in that order; equal texts are 1."""
    return arrow_function(_line_similarity, "double", a, b)


def unified_diff(a, b) -> Column:
    """The first 20 lines of the unified diff of a and b."""
    return arrow_function(_unified_diff, "array<string>", a, b)


def row_function(f, kind: str, *cols) -> Column:
    """A function of single rows, which a worker gets a hundred at a time: whole notes in Arrow batches of 10,000 rows
    hold hundreds of megabytes in each worker."""
    ship_package(SparkSession.getActiveSession())
    return F.udf(f, kind, useArrow=False)(*cols)


def hashtags(text) -> Column:
    return row_function(_hashtags, "array<struct<start:int,end:int,tag:string>>", text)


class HashtagTable:
    """Handler of hashtag_table()."""

    def eval(self, text: str | None):
        yield from find_hashtags(text or "")


def hashtag_table():
    """A table function for lateral joins: start, end, tag of each hashtag of a text, in order. In SQL, after
    spark.udtf.register("inline_hashtags", hashtag_table()): SELECT path, h.* FROM notes, LATERAL inline_hashtags(content) h"""
    ship_package(SparkSession.active())
    return F.udtf(HashtagTable, returnType="start int, end int, tag string", useArrow=True)


def escape_hashtags(text) -> Column:
    """The text with each found hashtag between backticks."""
    return row_function(_escape_hashtags, "string", text)


def mini_yaml(text) -> Column:
    return row_function(_mini_yaml, "map<string,string>", text)


def json_object_span(text) -> Column:
    return arrow_function(_json_object_span, "string", text)
