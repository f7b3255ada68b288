import ast
import random

import pytest

from sealmark.functions import statements as S
from sealmark.operators import code

SOURCE = '''"""Doc.

import os
from pkg.b import nothing
"""
import os, sys as system  # import json
from pkg.b import (x,
    y as z,  # why
)
from . import q; from ..up import r
from pkg \\
    import w
A = B = {"k": (1,
 2)}
(c, d), *e = f()
g.h = i[0] = 5
J: int = 1
K: list[str]
s = "from pkg.b import s1; x = '#'"; t = r"\\\\"
if A:
    L = 1
    def M(): N = 2
elif B:
    import P
else:
    from pkg.b import Q as R
for T in x: U = 1
else:
    V = 1
try:
    import W
except ImportError:
    W = None
def X(a=1, *, b: int = 2):
    import inner
    Y = 3
@deco
async def Z(): pass
class AA(B, k=1): pass
assert A == 1
A += 1
__all__ = ["BB", 'CC']
x == y
lambda_ = lambda q: q
'''


def by_parser(text):
    """Imports and top names as Python's own parser has them."""
    tree = ast.parse(text)
    brought = sorted((n.lineno, getattr(n, "level", 0) or 0, (n.module or "") if isinstance(n, ast.ImportFrom) else a.name, a.name if isinstance(n, ast.ImportFrom) else None, a.asname or (a.name if isinstance(n, ast.ImportFrom) else a.name.split(".")[0])) for n in ast.walk(tree) if isinstance(n, (ast.Import, ast.ImportFrom)) for a in n.names)
    names = set()

    def binds(n):
        if isinstance(n, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
            names.add(n.name)
        elif isinstance(n, ast.Assign):
            names.update(x.id for t in n.targets for x in ast.walk(t) if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Store))
        elif isinstance(n, ast.AnnAssign) and isinstance(n.target, ast.Name):
            names.add(n.target.id)
        elif isinstance(n, (ast.Import, ast.ImportFrom)):
            names.update(a.asname or a.name.split(".")[0] for a in n.names if a.name != "*")

    for n in tree.body:
        binds(n)
        for x in ast.walk(n) if isinstance(n, ast.If) else ():
            binds(x)
        if isinstance(n, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in n.targets):
            names.update(e.value for e in n.value.elts)
    return brought, sorted(names)


def check(text):
    found = S.statements(text)
    got = sorted(S.imports(found), key=lambda i: (i[0], i[1], i[2], i[3] or "", i[4]))
    brought, names = by_parser(text)
    assert got == sorted(brought, key=lambda i: (i[0], i[1], i[2], i[3] or "", i[4])), text
    assert S.bound(found)[0] == names, text


def test_statements_equal_the_parser():
    check(SOURCE.replace("def M(): N = 2", "def M():\n        N = 2"))
    check("")
    check("x = 1")


def test_random_files_equal_the_parser():
    parts = SOURCE.splitlines(keepends=True)
    blocks, now = [], []
    for line in parts:  # statements at the top, with what belongs to them
        if now and not line.startswith((" ", ")", "elif", "else", "except", "async", '"""', "from pkg.b import nothing", "import os\n", "\n")):
            blocks.append("".join(now))
            now = []
        now.append(line)
    blocks.append("".join(now))
    blocks = [b.replace("def M(): N = 2", "def M():\n        N = 2") for b in blocks]
    good = []
    for b in blocks:
        try:
            ast.parse(b)
            good.append(b)
        except SyntaxError:
            pass
    rng = random.Random(1)
    assert len(good) > 15
    for _ in range(200):
        check("".join(rng.choice(good) for _ in range(rng.randint(1, 8))))


def test_files_that_do_not_close_are_not_read():
    assert S.statements("x = (1,\n") is None and S.statements("x = 1)\n") is None
    assert S.statements('"""open\nimport os\n') == [(1, 0, '""', '"""open\nimport os\n')]


@pytest.mark.parametrize(("part", "n"), [('"""', 200_000), ("(", 200_000), ("'", 300_000), ("\\\n", 200_000), ("x = 1; ", 100_000), ("a = ", 200_000)])
def test_long_files_take_linear_time(part, n):
    import time

    began = time.perf_counter()
    found = S.statements(part * n)
    if found:
        S.imports(found), S.bound(found)
    assert time.perf_counter() - began < 10


def test_dangling_imports(spark):
    files = [
        ("pkg/__init__.py", "from .b import y\n"), ("pkg/b.py", "y = 1\nif y:\n    z = 2\n__all__ = ['told']\n"), ("pkg/sub/c.py", "def f(): pass\n"), ("pkg/lazy.py", "def __getattr__(name): ...\n"), ("pkg/star.py", "from os import *\n"), ("other.py", "v = 1\n"), ("pkg/doc.txt", "import"), ("bad.py", "x = ("), ("none.py", None),
        ("pkg/a.py", '"""\nfrom pkg.b import in_a_docstring\n"""\nfrom pkg.b import (y,\n    lost)\nfrom pkg.b import z, told, s as y\nfrom . import b, sub, gone\nfrom .sub import c, d\nfrom .sub.c import f, g\nfrom pkg.lazy import any\nfrom pkg.star import any\nfrom pkg.b.deep import y, deeper\nfrom elsewhere import x\nfrom ... import far\nfrom .. import other, nothing\nfrom bad import q\ndef h():\n    from other import v, w\n'),
    ]
    got = sorted(tuple(r) for r in code.dangling_imports(spark.createDataFrame(files, "path string, text string")).collect())
    assert got == [("pkg/a.py", 4, "pkg.b", "lost"), ("pkg/a.py", 6, "pkg.b", "s"), ("pkg/a.py", 7, "pkg", "gone"), ("pkg/a.py", 8, "pkg.sub", "d"), ("pkg/a.py", 9, "pkg.sub.c", "g"), ("pkg/a.py", 12, "pkg.b.deep", "deeper"), ("pkg/a.py", 18, "other", "w")]
