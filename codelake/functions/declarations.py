"""which names a piece of C++ declares, found by a scan of its tokens.

The scanner knows comments, strings (raw ones too), preprocessor lines,
brackets, template arguments and initialisers; it builds no tree.  A
declaration stands at the start of a statement, or of the head of ``if``,
``for``, ``while`` and ``switch``: a type, then a declarator (a name, ``[a, b]``
after ``auto``, or ``(*f)(``), then one of ``= ; , [ ( {``.  Its names are the
identifiers from the declarator to the end, those of initialisers included, as
a tree walk would give them; not type names, namespaces, members after ``.``
or ``->``, or keywords.  Parameters of functions and lambdas are no locals.
The variable of a range ``for`` is none either, as in the reference.

Every step passes over the tokens once, so a text's cost is linear in its
length.  Defined cases: null gives null; text that is no C++ gives the names of what
reads as a declaration; a string without an end ends with its line, a comment or
raw string with the text; unmatched brackets are plain signs.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The language's own words (fixed values).
BUILTIN = frozenset("auto bool char char8_t char16_t char32_t double float int long short signed size_t unsigned void wchar_t".split())
QUALIFIER = frozenset("const constexpr constinit consteval extern inline mutable register static thread_local volatile".split())
KEYWORD = BUILTIN | QUALIFIER | frozenset("""alignas alignof and asm bitand bitor break case catch class co_await co_return
co_yield compl concept const_cast continue decltype default delete do dynamic_cast else enum explicit export false final for
friend goto if namespace new noexcept not nullptr operator or override private protected public reinterpret_cast requires
return sizeof static_assert static_cast struct switch template this throw true try typedef typeid typename union using virtual
while xor""".split())
ELABORATED = frozenset("class enum struct typename union".split())
HEADS = frozenset("for if while switch".split())
LABELS = frozenset("case default public private protected".split())

TOKEN = re.compile(r'''
  (?=\S)(?: (?P<word> [^\W\d]\w*+(?!["]) )
| (?P<skip> //[^\n]* | /\*.*?(?:\*/|\Z) | (?m:^)\#(?:\\\n|[^\n])* )
| (?P<text> (?:u8|[uUL])?R"(?P<mark>[^()\\\s"]{0,16})\(.*?(?:\)(?P=mark)"|\Z) | (?:u8|[uUL])?"(?:\\.|[^"\\\n])*"?
          | '(?:\\[^\n]{1,10}?|[^'\\\n]{1,4})' )
| (?P<plain> [^\W\d]\w* ) | (?P<number> \d(?:'?[\w.])* ) | (?P<sign> :: | -> | \S ) )
| (?P<line> (?m:^)[ \t]+\#(?:\\\n|[^\n])* )''', re.S | re.X)
KINDS = {"plain": "word"}      # a word that only looks like the prefix of a string
TEXTS = 64                     # texts that are Python objects at a time
CLOSES = {")": "(", "]": "[", "}": "{"}


class Scan:
    """Names declared in a text (``declared``) and its parameters (``params``)."""

    def __init__(self, code: str) -> None:
        tokens = [(m.lastgroup, m[0]) for m in TOKEN.finditer(code)]
        if any(k in ("skip", "line") for k, _ in tokens):
            tokens = [t for t in tokens if t[0] not in ("skip", "line")]
        self.n = len(tokens)
        self.kind = [KINDS.get(k, k) for k, _ in tokens] + [""] * 3
        self.w = [t for _, t in tokens] + [""] * 3          # reading a little past the end gives nothing
        self.declared: set[str] = set()
        self.params: set[str] = set()
        self._match()
        self._parameter_lists()
        self._statements()

    def _match(self) -> None:
        """``close``: from an opening bracket (``<`` only where it closes as one) to its end, and ``open`` back."""
        self.close, self.open, held = {}, {}, []
        for i, t in enumerate(self.w[:self.n]):
            if self.kind[i] != "sign":
                continue
            if t in ("(", "[", "{", "<"):
                held.append(i)
            elif t == ">" and held and self.w[held[-1]] == "<" and self.w[i - 1] != "-":
                self._pair(held.pop(), i)
            elif t in (";", "=") or t in CLOSES:
                while held and self.w[held[-1]] == "<":
                    held.pop()
                if t in CLOSES and held and self.w[held[-1]] == CLOSES[t]:
                    self._pair(held.pop(), i)

    def _pair(self, a: int, b: int) -> None:
        self.close[a], self.open[b] = b, a

    def _name(self, i: int) -> bool:
        return self.kind[i] == "word" and self.w[i] not in KEYWORD

    def _is_lambda_intro(self, end: int) -> bool:
        at = self.open.get(end)
        return self.w[end] == "]" and at is not None and (at == 0 or not self._name(at - 1) and self.w[at - 1] not in (")", "]", "auto", "&"))

    def _parameter_lists(self) -> None:
        self.lists = set()
        for i, c in self.close.items():
            if self.w[i] != "(" or not i:
                continue
            after = self.w[c + 1]
            if self._name(i - 1) and (after in ("{", "const", "noexcept", "override", "final") or after == ":" and (
                    i == 1 or self.w[i - 2] in ("::", "{", "}", ";", ":", "explicit"))):
                self._parameters(i)
            elif self._is_lambda_intro(i - 1) and after in ("{", "mutable", "noexcept", "->", "-"):
                self._parameters(i)

    def _parameters(self, at: int) -> None:
        """Reads the names of ``( type name, ... )``."""
        words, last, stop, i, end = 0, "", False, at + 1, self.close[at]
        self.lists.add(at)
        while i <= end:
            t = self.w[i]
            if i == end or t == ",":
                if words >= 2 and last:
                    self.params.add(last)
                words, last, stop = 0, "", False
            elif t == "(" and self.w[i + 1] == "*" and not stop and self._name(i + 2):      # type (*name)(...)
                words, last, stop = 2, self.w[i + 2], True
            elif t in ("=", "["):
                stop = True
            elif self.kind[i] == "word" and not stop and t not in QUALIFIER and self.w[i - 1] != "::":
                words += 1
                last = t if self._name(i) and words >= 2 else ""
            if t in ("(", "[", "{", "<") and i in self.close:
                i = self.close[i]
            i += 1

    def _type(self, i: int) -> tuple[int, bool, str]:
        """The end of a type that starts at ``i``, whether there is one, and its last word of the language."""
        w, seen, own = self.w, False, ""
        while True:
            if w[i] in QUALIFIER or w[i] in ELABORATED and not seen:
                own, i = own or w[i], i + 1
            elif w[i] in BUILTIN:
                seen, own, i = True, w[i], i + 1
            elif not seen and (self._name(i) or w[i] == "::" and self._name(i + 1)):
                seen, i = True, i + 1 if w[i] != "::" else i + 2
                while w[i] == "<" and i in self.close or w[i] == "::" and self._name(i + 1):
                    i = self.close[i] + 1 if w[i] == "<" else i + 2
            else:
                return i, seen, own

    def _is_prototype(self, at: int) -> bool:
        """Whether the brackets after a declared name hold parameters, not initial values."""
        i, seen, own = self._type(at + 1)
        return at + 1 == self.close[at] or seen and (self._name(i) or bool(own) and self.w[i] in ("*", "&", ",", ")"))

    def _declarator(self, i: int) -> int:
        """Where the declarator of a declaration that starts at ``i`` begins, or -1."""
        w = self.w
        i, seen, own = self._type(i)
        if not seen:
            return -1
        while w[i] in ("*", "&", "const", "volatile"):
            i += 1
        if w[i] == "[" and own == "auto" and i in self.close:
            return i if w[self.close[i] + 1] in ("=", "(", "{") else -1
        if w[i] == "(" and w[i + 1] == "*" and i in self.close:
            return i if w[self.close[i] + 1] == "(" else -1
        if not self._name(i):
            return -1
        after = w[i + 1]
        if after in ("(", "{"):
            c = self.close.get(i + 1)
            if c is None or w[c + 1] not in (";", ",", "="):
                return -1
            if after == "(" and self._is_prototype(i + 1):
                self._parameters(i + 1)
            return i
        return i if after in ("=", ";", ",", "[") else -1

    def _end(self, i: int) -> int:
        """The end of the declaration whose declarator begins at ``i``."""
        while i < self.n and self.w[i] not in (";", ")", "}", "]"):
            i = self.close.get(i, i) + 1 if self.w[i] != "<" else i + 1
        return i

    def _opens_block(self, i: int, start: bool, inside: bool) -> bool:
        before = self.w[i - 1] if i else ""
        return start or before in (")", "else", "do", "try", "const", "noexcept", "override", "mutable") \
            or i > 0 and self._is_lambda_intro(i - 1) or not inside and before not in ("=", ",", "(", "return")

    def _statements(self) -> None:
        w, i, start, first, inside = self.w, 0, True, 0, 0
        heads: set[int] = set()
        blocks: list[tuple[int, bool]] = []          # the end of each open pair of braces, whether it holds members
        while i < self.n:
            while blocks and i >= blocks[-1][0]:
                blocks.pop()
            if start:
                first, start = i, False
                d = -1 if blocks and blocks[-1][1] else self._declarator(i)
                if d >= 0:
                    if d >= inside:
                        inside = self._end(d)
                    i = d
            t = w[i]
            if t in (";", "}") or t in ("else", "do", "try") and i == first:
                start = True
            elif t == "{":
                start = self._opens_block(i, i == first, i < inside)
                members = w[first] in ELABORATED and w[i - 1] not in (")", "const", "noexcept", "override")
                blocks.append((self.close.get(i, self.n), members and first < i))
            elif t in HEADS and i == first:
                j = i + 2 if w[i + 1] == "constexpr" else i + 1
                if w[j] == "(":
                    i, start = j, True
                    heads.add(self.close.get(j, -1))
            elif i in heads:                         # what follows the head of an if is a statement
                start = True
            elif t == ":" and (w[first] in LABELS or i == first + 1):
                start = True
            elif t == "(" and i in self.lists or t == "<" and i in self.close and w[self.close[i] + 1] in ("(", "{", "::"):
                i = self.close[i]
            elif i < inside and self._name(i) and w[i + 1] != "::" and not (
                    i and (w[i - 1] in (".", "->") or w[i - 1] == ">" and w[i - 2] == "-")):
                self.declared.add(t)
            i += 1


def locals_of(code: str) -> list[str]:
    """The names declared in ``code`` that are not parameters, sorted."""
    s = Scan(code)
    return sorted(s.declared - s.params)


def renamed(code: str) -> str:
    """``code`` with its locals, sorted, replaced one after the other by ``VAR1..n`` as whole words, in one pass."""
    names = locals_of(code)
    at = {n: k for k, n in enumerate(names, 1)}
    final: dict[str, str] = {}
    for k in range(len(names), 0, -1):               # a new name that is itself a later local is replaced again
        new = f"VAR{k}"
        final[names[k - 1]] = final[new] if at.get(new, 0) > k else new
    return re.sub(r"\w+", lambda m: final.get(m[0], m[0]), code) if final else code


def _per_text(fn, kind: str, arrow: pa.DataType):
    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        # a few texts at a time: their Python objects never add up to a batch
        parts = [pa.array([None if t is None else fn(t) for t in texts.slice(i, TEXTS).to_pylist()], arrow) for i in range(0, len(texts), TEXTS)]
        return pa.concat_arrays(parts) if parts else pa.array([], arrow)

    return run


def declared_locals(code) -> Column:
    """F19's names: ``array<string>``, sorted."""
    return _per_text(locals_of, "array<string>", pa.list_(pa.string()))(code)


def canonicalize_locals(code) -> Column:
    """locally declared names that are not parameters, sorted by name, become ``VAR1..n``."""
    return _per_text(renamed, "string", pa.string())(code)
