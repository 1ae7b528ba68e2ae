"""Names of modules: a second definition of a function would silently take the place of the first."""

import ast
import pathlib
from collections import Counter

import pytest

ROOT = pathlib.Path(__file__).parent.parent


@pytest.mark.parametrize("path", sorted(ROOT.glob("barloom/**/*.py")), ids=lambda p: str(p.relative_to(ROOT)))
def test_no_name_is_defined_twice(path):
    kinds = (ast.FunctionDef, ast.ClassDef)
    names = Counter(x.name for x in ast.parse(path.read_text()).body if isinstance(x, kinds))
    assert [x for x, n in names.items() if n > 1] == []
