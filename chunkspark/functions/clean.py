"""Cleaning of raw paper text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chunkspark.functions.text import SPACE, col, lines, rstrip, strip

# Markdown levels of the sectioning commands.
LATEX_LEVELS = (("section", "###"), ("subsection", "####"), ("subsubsection", "#####"))


def latex_headings(c: Column | str) -> Column:
    r"""``\section{T}`` and its two sublevels, starred or not, become markdown headings."""
    out = col(c)
    for command, mark in LATEX_LEVELS:
        out = F.regexp_replace(out, rf"\\{command}\*?\{{{SPACE}*([^}}]*?){SPACE}*\}}", f"{mark} $1")
    return out


def numeric_headings(c: Column | str) -> Column:
    """Lines that begin with a section number: number, one blank, title, all runs of blanks as one. Other lines stay; all
    line breaks become newlines and the last one is dropped."""
    head = rf"^{SPACE}*(\d+(?:\.\d+)*){SPACE}+(.+?){SPACE}*$"
    return F.array_join(F.transform(lines(c), lambda x: F.when(x.rlike(head), F.regexp_replace(strip(x), f"{SPACE}+", " ")).otherwise(x)), "\n")


def drop_references(c: Column | str) -> Column:
    """The first line that starts with References or Bibliography and all behind it go; otherwise nothing changes."""
    block = rf"(?imd)^{SPACE}*(?:References|Bibliography)\b[\s\S]*\z"
    return F.when(col(c).rlike(block), F.concat(rstrip(F.regexp_replace(col(c), block, "")), F.lit("\n"))).otherwise(col(c))


def _blank_lines(c: Column) -> Column:
    return F.regexp_replace(c, rf"\n{SPACE}*\n+", "\n\n")


def newlines(c: Column | str) -> Column:
    """Newline as the only line break, at most one blank line in a row, no blanks at line ends."""
    out = F.regexp_replace(col(c), r"\r\n?", "\n")
    return F.array_join(F.transform(lines(_blank_lines(out)), lambda x: rstrip(x)), "\n")


def ascii_and_greek(c: Column | str) -> Column:
    """Other characters than ASCII and Greek become blanks; runs of blanks and tabs become one blank."""
    return F.regexp_replace(F.regexp_replace(col(c), r"[^\x20-\x7E\n\t\x{0370}-\x{03FF}]", " "), r"[ \t]+", " ")


def clean_text(c: Column | str) -> Column:
    """All stages in order; ends in one newline. Null stays null."""
    out = ascii_and_greek(newlines(drop_references(numeric_headings(latex_headings(c)))))
    return F.concat(strip(_blank_lines(out)), F.lit("\n"))

