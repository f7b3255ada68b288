"""What one Python file says in its statements: logical lines with strings and comments blanked, its imports and the names that it binds at its top."""

from __future__ import annotations

import re

#: What is no plain code: strings, comments, continued lines, brackets, line ends.
_LEX = re.compile(r'''("""|\'\'\')(?:\\.|(?!\1).)*+(?:\1|\Z)|"(?:\\.|[^"\\\n])*+"?|'(?:\\.|[^'\\\n])*+'?|#[^\n]*|\\\r?\n|[()\[\]{}]|;|\r?\n''', re.S)
_FROM = re.compile(r"from\s+(\.*)\s*([\w.]*)\s+import\s+\(?([^()]*)\)?\s*$")
_IMPORT = re.compile(r"import\s+([\w., \t]+)$")
_ALIAS = re.compile(r"([\w.]+|\*)(?:\s+as\s+(\w+))?$")
_NAMED = re.compile(r"(?:(?:async\s+)?def|class)\s+(\w+)")
_TYPED = re.compile(r"([^\W\d]\w*)\s*:(?!=)")
_EQUALS = re.compile(r"(?<![=!<>:+\-*/%&|^@])=(?!=)")
_TARGET = re.compile(r"[\s*(\[]*([^\W\d]\w*)[\s)\]]*$")
_WORD = re.compile(r"(if|elif|else|for|while|with|try|except|finally|return|raise|assert|del|global|nonlocal|yield|await|async|lambda|not|match|case|def|class|from|import|pass|print)\b")

Statement = tuple[int, int, str, str]  # line, indent, code, text as written


def statements(text: str) -> list[Statement] | None:
    """The logical lines of a file; strings are empty in ``code``, and what brackets or backslashes continue is one line. None where brackets do not close."""
    found: list[Statement] = []
    depth, line, start, at, begin, code = 0, 1, 1, 0, 0, []
    shared: int | None = None  # the indent of a line's first statement holds for those after a semicolon

    def end(to: int) -> int:
        whole = "".join(code)
        indent = len(whole) - len(whole.lstrip(" \t")) if shared is None else shared
        if whole.strip():
            found.append((start, indent, whole.strip(), text[begin:to]))
        code.clear()
        return indent

    for m in _LEX.finditer(text):
        code.append(text[at : m.start()])
        at, said = m.end(), m[0]
        if said[0] in "\"'":
            code.append('""')
            line += said.count("\n")
        elif said[0] == "\\":
            code.append(" ")
            line += 1
        elif said in "([{":
            depth += 1
            code.append(said)
        elif said in ")]}":
            depth -= 1
            code.append(said)
            if depth < 0:
                return None
        elif said == ";" and not depth:
            shared = end(m.start())
            begin = at
        elif said[0] in "\r\n":
            line += 1
            if depth:
                code.append(" ")
            else:
                end(m.start())
                start, begin, shared = line, at, None
    code.append(text[at:])
    end(len(text))
    return None if depth else found


def imports(found: list[Statement]) -> list[tuple[int, int, str, str | None, str]]:
    """(line, dots before the module, module, name, name that it binds) of all imports; the name is None where a module is imported."""
    out = []
    for line, _, code, _ in found:
        if m := _FROM.match(code):
            for part in m[3].split(","):
                if a := _ALIAS.match(part.strip()):
                    out.append((line, len(m[1]), m[2], a[1], a[2] or a[1]))
        elif m := _IMPORT.match(code):
            for part in m[1].split(","):
                if a := _ALIAS.match(part.strip()):
                    out.append((line, 0, a[1], None, a[2] or a[1].split(".")[0]))
    return out


def bound(found: list[Statement]) -> tuple[list[str], bool]:
    """Names that the top of a file binds, branches of a top ``if`` included, and whether it binds others when asked (``__getattr__``)."""
    top, inside, dynamic = [], False, False
    for s in found:
        code = s[2]
        if s[1] == 0:
            inside = bool(re.match(r"(?:if|elif|else)\b", code)) and (inside or code.startswith("if"))
            dynamic |= bool(re.match(r"(?:async\s+)?def\s+__getattr__\b", code))
        if s[1] == 0 or inside:
            top.append(s)
    names: set[str] = {n for *_, n in imports(top) if n != "*"}
    for _, _, code, text in top:
        if m := _NAMED.match(code):
            names.add(m[1])
            continue
        if _WORD.match(code):
            continue
        if m := _TYPED.match(code):
            names.add(m[1])
            continue
        for target in _EQUALS.split(code)[:-1]:
            names.update(m[1] for part in target.split(",") if (m := _TARGET.match(part)))
        if re.match(r"__all__\s*=", code):
            names.update(x[1] for x in re.findall(r"""(["'])(\w+)\1""", text))
    return sorted(names), dynamic


def decorated(found: list[Statement]) -> list[tuple[int, str, str]]:
    """(line of the decorator, its dotted name, the function) of every decorated function; a decorator is named by what stands before its call."""
    out, waiting = [], []
    for line, _, code, _ in found:
        if m := re.match(r"@\s*([\w.]+)\s*(?:\(.*\))?$", code):
            waiting.append((line, m[1]))
        elif not code.startswith("@"):
            if m := re.match(r"(?:async\s+)?def\s+(\w+)", code):
                out += [(n, name, m[1]) for n, name in waiting]
            waiting = []
    return out
