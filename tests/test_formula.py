import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from modalgraph.functions.formula import And, Box, Diamond, FormulaError, Imp, Not, Or, Var, junction, parse

ATOMS = st.builds(Var, st.sampled_from(["a", "b", "two words", "brand#25"]))
FORMULAS = st.recursive(ATOMS, lambda f: st.one_of(st.builds(Not, f), st.builds(Box, f), st.builds(Diamond, f), *(st.builds(k, f, f) for k in (And, Or, Imp))), max_leaves=6)


def written(f):
    if isinstance(f, Var):
        return f"(Var {f.name})"
    head = {Box: "[]", Diamond: "<>"}.get(type(f), type(f).__name__)
    return f"({head} {' '.join(map(written, f.parts))})"


@given(FORMULAS)
@settings(max_examples=100)
def test_what_is_written_is_read(f):
    assert parse(written(f)) == f


def test_printing():
    assert str(parse("(Imp (And (Var a) (Not (Var b))) ([] (<> (Var a))))")) == '(("a" & !"b") -> []<>"a")'


@pytest.mark.parametrize("text", ["", "  ", "(Var a", "(Foo (Var a))", "(And (Var a))", "(Var a) (Var b)", "Var a"])
def test_what_is_no_formula(text):
    with pytest.raises(FormulaError):
        parse(text)


def test_modal_heads_can_be_refused():
    with pytest.raises(FormulaError):
        parse("(Not ([] (Var a)))", modal=False)


def test_atoms_and_renaming():
    f = parse("(Or (Var b) (And (Var a) (Var b)))")
    assert list(f.atoms()) == ["b", "a"]
    assert list(f.mapped(str.upper).atoms()) == ["B", "A"]
    assert junction(And, []) is None
    assert junction(Or, ["x", "y", "z"]) == Or(Or(Var("x"), Var("y")), Var("z"))
