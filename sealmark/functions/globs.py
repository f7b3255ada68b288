"""Path predicates: globs compiled to regular expressions on the driver, matched as columns.

There are two grammars. In the wide one ``*`` crosses ``/`` and a glob covers more than it spells; in the strict one
``*`` stays inside a segment and only ``**`` crosses. Paths may hold any character, line breaks included.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What each sign of a grammar stands for; everything else stands for itself.
WIDE = {"*": ".*", "?": "."}
STRICT = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
_WIDE_SIGN = re.compile(r"\[!?\]?[^\]]*\]|.", re.S)
_STRICT_SIGN = re.compile(r"\*\*/?|.", re.S)


def _sign(sign: str, table: dict[str, str]) -> str:
    if len(sign) > 2 and sign[0] == "[":  # a set of characters
        negated = sign[1] == "!"
        body = "".join(f"\\{c}" if c in "\\[]^&" else c for c in sign[2 if negated else 1 : -1])
        return f"[{'^' * negated}{body}]"
    return table.get(sign) or re.escape(sign)


def _spelled(glob: str, signs: re.Pattern, table: dict[str, str]) -> str:
    return "".join(_sign(x, table) for x in signs.findall(glob))


def _wide(glob: str) -> list[str]:
    """What a glob reaches, as expressions over normal paths.

    A glob is a body and perhaps a closing slash. The body reaches itself, unless the slash says that only what is below it is meant, and all that is below.
    A body that may begin at any depth reaches the top as well, there without what is below. A glob with a star reaches the folder that it names before the first one.
    """
    body, depth = glob.rstrip("/"), "**/"
    below = "/.*"
    reach = {_spelled(body, _WIDE_SIGN, WIDE) + (below if body != glob else f"(?:{below})?")}
    if glob[: len(depth)] == depth:
        reach.add(_spelled(glob[len(depth) :], _WIDE_SIGN, WIDE))
    folder = re.match(r"[^*]*", glob)[0].rstrip("/")
    return sorted(reach | {re.escape(folder)} - {""})


def normal(path: Column) -> Column:
    """A path with ``/`` between its parts, without ``./`` before it and without ``/`` after it, unless nothing else is left."""
    own = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"\A\./", "")
    bare = F.regexp_replace(own, r"/+\z", "")
    return F.when(bare == "", own).otherwise(bare)


def any_match(path: Column | str, globs: list[str], strict: bool = False) -> Column:
    """Whether a path matches any glob; an empty list matches nothing."""
    forms = [f for g in globs for f in ([_spelled(g, _STRICT_SIGN, STRICT)] if strict else _wide(g))]
    col = F.col(path) if isinstance(path, str) else path
    return (col if strict else normal(col)).rlike(rf"(?s)\A(?:{'|'.join(forms)})\z") if forms else F.lit(False)


def keep(path: Column | str, excluded: list[str]) -> Column:
    """Paths that are not blank and not excluded."""
    col = F.col(path) if isinstance(path, str) else path
    return (F.trim(col) != "") & ~any_match(col, excluded)


def readable(path: Column | str, reads: list[str]) -> Column:
    """Whether a program that declares ``reads`` reads this path; a program that declares nothing reads all."""
    return any_match(path, reads) if reads else F.lit(True)


def first_layer(path: Column | str, layers: dict[str, list[str]]) -> Column:
    """Name of the first layer whose globs match; the empty string if none does."""
    out = None
    for name, globs in layers.items():
        hit = any_match(path, globs)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit("") if out is None else out.otherwise("")


def test_file(path: Column | str) -> Column:
    """Test files by name or place."""
    return (F.col(path) if isinstance(path, str) else path).rlike(r"(^|/)tests?/|(^|/)test_[^/]*\.py$|_test\.(py|go)$|\.(test|spec)\.[jt]sx?$")


def common_dirs(dirs: list[str]) -> list[str]:
    """The shallowest directories that cover all given ones."""
    kept: list[str] = []
    for d in sorted({x.strip("/") for x in dirs}):
        if not any(k == "" or d == k or d.startswith(k + "/") for k in kept):
            kept.append(d)
    return kept


def dotted_match(dotted: Column, pattern: Column) -> Column:
    """``.x`` is attribute x of any receiver; ``a.b`` is that name or a longer one that ends in ``.a.b``."""
    attribute = F.startswith(pattern, F.lit("."))
    return F.when(attribute, (F.instr(dotted, ".") > 0) & F.endswith(dotted, pattern)).otherwise((dotted == pattern) | F.endswith(dotted, F.concat(F.lit("."), pattern)))
