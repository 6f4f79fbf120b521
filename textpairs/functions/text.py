"""Column-level text functions (T1, T5, T6, T8, T9, S13).  All are Catalyst
expressions: they stay inside whole-stage codegen and let filters push down."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The prompt texts the reference prepends.
PARAPHRASE_PREFIX = "paraphrase: "
NLI_HYPOTHESIS = "{task} hypothesis: "
NLI_PREMISE = " premise: "

# White space stripped at the ends (spelled out so Java and RE2 agree).
_WS = r"[ \t\n\r\f\x0B]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_space(c) -> Column:
    return F.regexp_replace(_c(c), f"^{_WS}+|{_WS}+$", "")


def normalise_space(c) -> Column:
    """Collapse runs of U+0020 to one, then strip white space at both ends."""
    return strip_space(F.regexp_replace(_c(c), " +", " "))


def paraphrase_prompt(c, prefix: str = PARAPHRASE_PREFIX) -> Column:
    """T5: ``paraphrase: <sentence>``."""
    return F.concat(F.lit(prefix), _c(c))


def nli_prompt(premise, hypothesis, task: str = "mnli") -> Column:
    """``<task> hypothesis: H premise: P``."""
    return F.concat(F.lit(NLI_HYPOTHESIS.format(task=task)), _c(hypothesis), F.lit(NLI_PREMISE), _c(premise))


def space_split(c) -> Column:
    """Split on single spaces; runs of spaces give empty tokens (kept)."""
    return F.split(_c(c), " ")


def equal_ignoring_space(a, b) -> Column:
    """Null-safe equality after removing every U+0020."""
    return F.replace(_c(a), F.lit(" "), F.lit("")).eqNullSafe(F.replace(_c(b), F.lit(" "), F.lit("")))


def path_parts(c) -> dict[str, Column]:
    """Parts of a path or URL -- parent folder, file name, stem and the
    corpus name (folder text before the first ``_``).  Query and fragment of a
    URL are removed first."""
    path = F.regexp_replace(_c(c), r"[?#].*$", "")
    seg = F.split(path, "/")
    file = F.element_at(seg, -1)
    folder = F.when(F.size(seg) >= 2, F.element_at(seg, -2)).otherwise(F.lit(""))
    stem = F.regexp_replace(file, r"\.[^.]*$", "")
    return {
        "folder": folder,
        "file_name": file,
        "stem": stem,
        "corpus": F.split(folder, "_").getItem(0),
    }
