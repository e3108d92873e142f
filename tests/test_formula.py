import pytest

from inkspark.functions.formula import expand_shared, render, shifted, tokens

#: Own formulas; what is expected follows from the rules: quotes of sheet names go, doubled quotes become one, blanks beside
#: operators go, one between two areas is the intersection, arrays become calls, signs at the front and @ have no effect.
RENDER = [
    ("'Year Plan'!C7*2", "Year Plan!C7*2"), ("'It''s here'!B1", "It's here!B1"), ("=SUM(B2:B9) / COUNT(B2:B9)", "SUM(B2:B9)/COUNT(B2:B9)"),
    ('CONCAT("he said ""no""",F1)', 'CONCAT("he said "no"",F1)'), ("MMULT({5,6;7,8},K1:L2)", "MMULT(ARRAY(ARRAYROW(5,6),ARRAYROW(7,8)),K1:L2)"),
    ("IF(P3 >= 10,TRUE,#REF!)", "IF(P3>=10,TRUE,#REF!)"), ("12.5%", "12.5%"), ("-Q8^2", "-Q8^2"), ("@INDEX(Z1:Z9,3)", "INDEX(Z1:Z9,3)"),
    ("(J1:J3 J2:K2)", "(J1:J3 J2:K2)"), ("6.02E+23*H2", "6.02E+23*H2"), ("+M4<>N4", "M4<>N4"),
]


@pytest.mark.parametrize(("formula", "want"), RENDER)
def test_render(formula, want):
    assert render(tokens(formula)) == want


def test_shared_formulas():
    assert expand_shared('MAX(C$4,$D5)*Rates!E6&"C4"', 3, 2) == 'MAX(E$4,$D8)*Rates!G9&"C4"'
    assert expand_shared("SUM(F:G)+SUM(4:5)", 2, 1) == "SUM(G:H)+SUM(6:7)"
    assert expand_shared("B3", -5, 0) == ""
    assert shifted("$C$9", 7, 7) == "$C$9" and shifted("B1048576", 1, 0) == "" and shifted("XFC2", 1, 1) == "XFD3"
