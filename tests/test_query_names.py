"""A name that a query module lacks shows only when its query runs; here every global name is looked up."""

import builtins
import dis
import importlib
import pkgutil
import types

import pytest

import signalgrid.queries

MODULES = [m.name for m in pkgutil.iter_modules(signalgrid.queries.__path__, "signalgrid.queries.")]


def _codes(code: types.CodeType):
    yield code
    for const in code.co_consts:
        if isinstance(const, types.CodeType):
            yield from _codes(const)


@pytest.mark.parametrize("name", MODULES)
def test_global_names_exist(name):
    module = importlib.import_module(name)
    with open(module.__file__) as text:
        code = compile(text.read(), module.__file__, "exec")
    used = {i.argval for c in _codes(code) for i in dis.get_instructions(c) if i.opname in ("LOAD_GLOBAL", "LOAD_NAME")}
    assert {n for n in used if not hasattr(module, n) and not hasattr(builtins, n)} <= {"__file__", "__module__", "__qualname__"}
