"""Tokens of source texts: what they are, against the plain alternatives tried place by place."""

import re

from hypothesis import given, settings, strategies as st

from codeaudit.functions import calls as C

_WORD = rf"(?P<word>{C._NAME}|\d[\w.]*+)"
_REST = rf"(?P<call>{C._NAME}\s*\()|{_WORD}|(?P<open>[(\[{{])|(?P<close>[)\]}}])|(?P<comma>,)"
PLAIN = {True: re.compile(rf"(?ms)(?P<head>{C._HEAD})|(?P<comment>#[^\n]*+)|(?P<string>{C._PY_STRING})|{_REST}"),
         False: re.compile(rf"(?s)(?P<comment>//[^\n]*+|/\*.*?\*/)|(?P<string>{C._JS_STRING})|{_REST}")}
PIECES = ["def f(", "class C(", "async def g (", "\n", " ", "\t", "rb'", 'f"', '"""', "'", '"', "`", "#", "//", "/*", "*/", "/", "\\",
          "(", ")", "[", "]", "{", "}", ",", ".", "a", "abc.d", " .e", "é", "x²", "٣", "1.5e3", "$", "_", "don't", "=", "\r\n", "日本", "print("]


def test_words_are_no_tokens():
    for python in (True, False):
        assert list(C.tokens("word " * 1000 + "a.b 1.5 é $x _y 'open", python)) == []


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=30).map("".join))
def test_tokens_are_those_of_the_plain_pattern(text):
    for python in (True, False):
        want = [(m.lastgroup, *m.span()) for m in PLAIN[python].finditer(text) if m.lastgroup != "word"]
        assert list(C.tokens(text, python)) == want


def test_injection_hits_of_one_text_have_their_own_lines(spark, files_table):
    from codeaudit.operators import rules
    lines = [f"x{i} = {i}" for i in range(60)]
    lines[2], lines[50] = "os.system(a)", "os.system(b)"
    rows = rules.rule_findings(files_table({"a.py": "\n".join(lines), "b.py": "x"}), "injection").collect()
    assert {r.line: r.evidence for r in rows} == {
        3: "\n".join(lines[:18])[:500], 51: "\n".join(lines[35:])[:500]}
