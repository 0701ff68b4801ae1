"""prompt templates as native ``concat`` expressions (our own wording).

Each template is a fixed text with slots; ``render_prompt`` fills the slots
from columns.  Disabled parts (no retrieval context, no member list, no
function body) render as empty strings, as in the reference.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Template texts (fixed values).  {name} marks a slot.
TEMPLATES = {
    "compilation": (
        "You are an experienced C++/HPC developer.\n\n"
        "Diagnose the compiler or linker errors below and fix them briefly.\n\n"
        "Answer as:\nROOT CAUSE: <one sentence>\nFIX: <exact change>\nWHY: <one short sentence>\n\n"
        "Compiler output:\n----------------\n{body}\n----------------\n"),
    "compilation_fortran": (
        "You are an experienced Fortran/HPC developer.\n\n"
        "Diagnose the compiler or linker errors below and fix them briefly.\n\n"
        "Answer as:\nROOT CAUSE: <one sentence>\nFIX: <exact change>\nWHY: <one short sentence>\n\n"
        "Compiler output:\n----------------\n{body}\n----------------\n"),
    "codeadvising": (
        "You are an expert C++/HPC developer.\n\nRelevant examples:\n{context}\n\n"
        "Answer with a short code example for the request below.\n\nRequest:\n{body}\n"),
    "codeadvising_fortran": (
        "You are an expert Fortran/HPC developer.\n\nRelevant examples:\n{context}\n\n"
        "Answer with a short code example for the request below.\n\nRequest:\n{body}\n"),
    "explaining": (
        "You are an expert C++/HPC developer.\n\nRelevant code:\n{context}\n\n"
        "Explain clearly what is asked below.\n\nQuestion:\n{body}\n"),
    "explaining_fortran": (
        "You are an expert Fortran/HPC developer.\n\nRelevant code:\n{context}\n\n"
        "Explain clearly what is asked below.\n\nQuestion:\n{body}\n"),
    "add_method": (
        "Add a new method to class {class_name} in file {file_name}.\n\n"
        "Reference code:\n{context}\n\nMember variables:\n{members}\n\n"
        "Existing function:\n{function}\n\nUser request:\n{body}\n"),
    "review": (
        "You review a pull request to fix its build errors.\n\n"
        "Compiler errors:\n{errors}\n\nSource files:\n{sources}\n\n"
        "Suggest only minimal line changes, as:\nFILE: <path>\nLINE <n>: <old line>\n"
        "REPLACE WITH: <new line>\n"),
    "agent_task": "Apply this change to the repository and keep the build green:\n{body}\n",
    "intent": ("Choose exactly one intent for the request below from: scaffolding, compilation, "
               "codeadvising, explaining, code_generation, refactor.\n"
               "Return only JSON: {\"intent\": \"<label>\"}\n\nRequest:\n{body}\n"),
    "task_type": ("Classify the request below as one task type: ADD_CLASS_METHOD, "
                  "MERGE_CODE_SNIPPET_AS_FUNCTION, CALL_EXISTING_FUNCTION, ADD_MEMBER_VARIABLE, "
                  "MODIFY_EXISTING_METHOD, WIRE_TWO_SUBSYSTEMS.\nReturn only the keyword.\n\n"
                  "Request:\n\"{body}\"\n"),
}


def _split(template: str):
    """Split a template into literal and slot parts."""
    import re

    parts = []
    pos = 0
    for m in re.finditer(r"\{([a-z_]+)\}", template):
        parts.append(("lit", template[pos:m.start()]))
        parts.append(("slot", m.group(1)))
        pos = m.end()
    parts.append(("lit", template[pos:]))
    return parts


def render_prompt(kind: str, **slots: Column) -> Column:
    """Fill template ``kind``; a missing or null slot renders as ''."""
    out = []
    for t, v in _split(TEMPLATES[kind]):
        if t == "lit":
            if v:
                out.append(F.lit(v))
        else:
            out.append(F.coalesce(slots[v], F.lit("")) if v in slots else F.lit(""))
    return F.concat(*out)


def render_by_kind(kind_col: Column, **slots: Column) -> Column:
    """Pick the template per row from ``kind_col`` (a template name)."""
    out = None
    for kind in TEMPLATES:
        e = render_prompt(kind, **slots)
        out = F.when(kind_col == kind, e) if out is None else out.when(kind_col == kind, e)
    return out


def sql_render(kind: str, **slots: str) -> str:
    """The same template as DuckDB SQL text (oracle side)."""
    out = []
    for t, v in _split(TEMPLATES[kind]):
        if t == "lit":
            if v:
                out.append("'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'")
        else:
            out.append(f"coalesce({slots[v]}, '')" if v in slots else "''")
    return "(" + " || ".join(out) + ")"
