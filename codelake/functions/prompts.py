"""Prompt triage as native Column functions.

Every function maps columns to a column; nothing here leaves the JVM.
Regexes are written for Java with ``(?d)`` where ``.`` must stop at ``\\n``
only, as Python's ``re`` does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codelake.functions.text import pystrip, splitlines

# ---------------------------------------------------------------- fixed values
DEFAULT_MENTION = "@assistant"
REVIEW_COMMAND = "/agent-build"
CODER_COMMAND = "/agent-coder"
NO_INSTRUCTION = "(no instruction)"

# compiler/linker markers, searched in lower-cased text (fixed values).
COMPILER_MARKERS = (
    "error:", "undefined reference", "ld returned", "collect2:", "fatal error:",
    "mpif90", "gfortran", "ifort", "nvfortran", "linker", "undefined symbol",
)

# F14 rule tables (fixed values), searched in lower-cased text, first match wins.
SCAFFOLDING = (
    "i want an existing template code for",
    "give a template for a fortran program",
    "starter code for",
    "example project code for",
)
ADVISING_FORTRAN = (
    "how to ", "give code snippets for", "give a sample code for", "give the program",
    "show me how to implement", "example.*code", "function .* example", "routine .* example",
)
ADVISING_CPP = (
    "how to ", "give code snippets for", "give the code for", "give the program",
    "show me how to implement", "example.*code", "function .* example", "routine .* example",
)
MODIFICATION_CPP = ("implement a new function", "implement a new method", "implement a method")
GENERATION_FORTRAN = (
    "modify this routine", "modify this file", "update this subroutine",
    "change .* in file", "rewrite .* in file",
)
EXPLAINING = (
    "can you explain", "what does .* do", "explain this code", "how does .* work",
    "describe .* function",
)
RULESETS = {
    "fortran": (("compilation", None), ("scaffolding", SCAFFOLDING), ("codeadvising", ADVISING_FORTRAN),
                ("code_generation", GENERATION_FORTRAN), ("explaining", EXPLAINING)),
    "cpp": (("compilation", None), ("scaffolding", SCAFFOLDING), ("codeadvising", ADVISING_CPP),
            ("codemodification", MODIFICATION_CPP), ("explaining", EXPLAINING)),
}

# F15 task labels and F16 intent labels (fixed values).
TASK_LABELS = (
    "ADD_CLASS_METHOD", "MERGE_CODE_SNIPPET_AS_FUNCTION", "CALL_EXISTING_FUNCTION",
    "ADD_MEMBER_VARIABLE", "MODIFY_EXISTING_METHOD", "WIRE_TWO_SUBSYSTEMS",
)
DEFAULT_TASK = "ADD_CLASS_METHOD"
INTENT_LABELS = ("scaffolding", "compilation", "codeadvising", "explaining", "code_generation", "refactor")
DEFAULT_INTENT = "codeadvising"

# P5: slot lines dropped before retrieval (fixed values).
SLOT_PREFIXES = ("class:", "file:", "function:")

# Model-unavailable error words (fixed values).
MODEL_ERROR_WORDS = ("not found", "does not exist", "unknown", "invalid")

# F11 / F13 slot patterns (fixed values).  The DuckDB oracle uses these
# texts as they are; the Spark side adds (?U) so \s, \w and \b follow
# Unicode as in Python's re (see ``_u``).
CLASS_PATTERNS = (
    r"(?m)^\s*class\s*:\s*([A-Za-z_][A-Za-z0-9_]*)",
    r"in\s+the\s+([A-Z][A-Za-z0-9_]*)\s+class",
    r"\bclass\s+([A-Z][A-Za-z0-9_]*)",
)
FILE_PATTERNS = (
    r"(?m)^\s*file\s*:\s*([^\s]+)",
    r"\bin\s+([A-Za-z0-9_/\\.-]+\.(?:cpp|cc|cxx|C|hpp|h|H))",
    r"\b([A-Za-z0-9_/\\.-]+\.(?:cpp|cc|cxx|C|hpp|h|H))\b",
)
FUNCTION_PATTERNS = (r"(?m)^\s*function\s*:\s*([A-Za-z_][A-Za-z0-9_]*)",)
TARGET_FILE_PATTERN = r"(?i)(\S+\.(cpp|cxx|cc|h|H|hpp))"


def _u(pattern: str) -> str:
    """Java regex with Python's Unicode classes."""
    return "(?U)" + pattern


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _any_contains(text: Column, needles) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | (F.instr(text, n) > 0)
    return out


def _any_rlike(text: Column, patterns) -> Column:
    return text.rlike("(?d)" + "|".join(f"(?:{p})" for p in patterns))


def has_compiler_marker(text) -> Column:
    """P4."""
    return _any_contains(F.lower(_c(text)), COMPILER_MARKERS)


def classify_intent(text, ruleset: str = "fortran") -> Column:
    """first matching group wins; ``null`` when none matches (the
    reference then asks a model, see ``parse_intent_reply``)."""
    low = F.lower(_c(text))
    out = None
    for label, pats in RULESETS[ruleset]:
        cond = has_compiler_marker(_c(text)) if pats is None else _any_rlike(low, pats)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(None).cast("string"))


def strip_slot_lines(text) -> Column:
    """P5: drop lines whose stripped form starts with a slot prefix."""
    def keep(line):
        s = pystrip(line)
        cond = F.lit(True)
        for p in SLOT_PREFIXES:
            cond = cond & ~F.startswith(s, F.lit(p))
        return cond
    return F.array_join(F.filter(splitlines(_c(text)), keep), "\n")


def classify_call_error(msg) -> Column:
    """P6: 'model_unavailable' when the error names an unavailable model, else 'other'."""
    low = F.lower(_c(msg))
    cond = (F.instr(low, "model") > 0) & _any_contains(low, MODEL_ERROR_WORDS)
    return F.when(cond, F.lit("model_unavailable")).otherwise(F.lit("other"))


def mention_prompt(body, marker: str = DEFAULT_MENTION) -> Column:
    """F8: text after the first case-insensitive ``marker``, stripped; null if absent."""
    b = _c(body)
    pos = F.instr(F.lower(b), marker.lower())
    return F.when(pos > 0, pystrip(F.substring(b, pos + len(marker), 1 << 30)))


def agent_instruction(body) -> Column:
    """lines after a first line starting ``/agent-coder``; placeholder when empty."""
    lines = splitlines(_c(body))
    first = F.lower(pystrip(F.try_element_at(lines, F.lit(1))))
    rest = pystrip(F.array_join(F.slice(lines, 2, 1 << 30), "\n"))
    return F.when(F.startswith(first, F.lit(CODER_COMMAND)),
                  F.when(rest == "", F.lit(NO_INSTRUCTION)).otherwise(rest))


def compiler_block(body) -> Column:
    """lines after the first line containing ``/agent-build``; every such line dropped."""
    lines = splitlines(_c(body))
    has = F.transform(lines, lambda l: F.instr(F.lower(l), REVIEW_COMMAND) > 0)
    first = F.array_position(has, F.lit(True))
    after = F.when(first > 0, F.slice(lines, F.greatest(first, F.lit(1)) + 1, 1 << 30)).otherwise(
        F.array().cast("array<string>"))
    kept = F.filter(after, lambda l: ~(F.instr(F.lower(l), REVIEW_COMMAND) > 0))
    out = pystrip(F.array_join(kept, "\n"))
    return F.when(out != "", out)


def _first_hit(text: Column, patterns) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(text, _u(p), 1), F.lit("")) for p in patterns])


def extract_class(text) -> Column:
    return _first_hit(_c(text), CLASS_PATTERNS)


def extract_file(text) -> Column:
    return _first_hit(_c(text), FILE_PATTERNS)


def extract_function(text) -> Column:
    return _first_hit(_c(text), FUNCTION_PATTERNS)


def target_file(text) -> Column:
    """first ``name.ext`` with a C++ extension, any case; null when none."""
    return F.nullif(F.regexp_extract(_c(text), _u(TARGET_FILE_PATTERN), 1), F.lit(""))


def clean_task_label(raw) -> Column:
    """upper-cased first token before ``:`` or whitespace; unknown → default."""
    tok = F.upper(F.element_at(F.split(pystrip(_c(raw)), r"[:\s]", -1), 1))
    return F.when(tok.isin(*TASK_LABELS), tok).otherwise(F.lit(DEFAULT_TASK))


def parse_intent_reply(raw) -> Column:
    """F16: ``{"intent": ..}``; invalid JSON or unknown label → default.

    The whole text must be one JSON value: as the only element of an array,
    trailing text makes it invalid or a second element."""
    one = F.from_json(F.concat(F.lit("["), _c(raw), F.lit("]")), "array<struct<intent:string>>", {"allowSingleQuotes": "false"})
    v = F.when(F.size(one) == 1, F.get(one, F.lit(0))["intent"])
    return F.when(v.isin(*INTENT_LABELS), v).otherwise(F.lit(DEFAULT_INTENT))


def render_context(code, style: str = "code", meta=None) -> Column:
    """one retrieved chunk as prompt context.

    ``code``: the bare indented block; ``features``: FUNCTION/FEATURES/FILE/CODE;
    ``purpose``: PURPOSE/KEYWORDS/CONTEXT/FILE/CODE.  ``meta`` is a
    ``map<string,string>`` column; missing keys print as empty.
    """
    code = _c(code)
    pad = " " * 12
    if style == "code":
        return F.concat(F.lit("\n" + pad), code, F.lit("\n" + pad))

    def m(k):
        return F.coalesce(meta[k], F.lit("")) if meta is not None else F.lit("")
    if style == "features":
        return F.concat(F.lit("\nFUNCTION: "), m("function"), F.lit("\nFEATURES: "), m("features"),
                        F.lit("\nFILE: "), m("source_file"), F.lit("\n\nCODE:\n"), code, F.lit("\n"))
    if style == "purpose":
        return F.concat(F.lit("\nPURPOSE: "), m("purpose"), F.lit("\nKEYWORDS: "), m("keywords"),
                        F.lit("\nCONTEXT: "), m("context"), F.lit("\nFILE: "), m("source_file"),
                        F.lit("\n\nCODE:\n"), code, F.lit("\n"))
    raise ValueError(f"unknown context style {style}")
