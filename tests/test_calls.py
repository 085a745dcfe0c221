"""Calls and argument lists by the bracket automaton."""

import re
import time

from hypothesis import given, settings, strategies as st

from codeaudit.functions.calls import calls, plain_heads
from codeaudit.operators import rules
from codeaudit.operators.structure import classes, functions
from codeaudit.sources.files import with_language

ANY = re.compile("")


def told(text, python=True):
    return [(name, args) for _, name, args in calls(text, python, ANY)]


def test_nesting_strings_comments():
    assert told('f(a, k=g(h(i(1, [2, {3: 4}]))), *r)') == [
        ("f", [(None, "a"), ("k", "g(h(i(1, [2, {3: 4}])))"), (None, "*r")]),
        ("g", [(None, "h(i(1, [2, {3: 4}]))")]), ("h", [(None, "i(1, [2, {3: 4}])")]),
        ("i", [(None, "1"), (None, "[2, {3: 4}]")])]
    assert told('f(")", \'(\', """a)\n"b""", r"\\)")') == [("f", [(None, '")"'), (None, "'('"), (None, '"""a)\n"b"""'), (None, 'r"\\)"')])]
    assert told("f(a,  # not ) here, no\n  b,\n)") == [("f", [(None, "a"), (None, "b")])]
    assert told("f(`)${x}`, /* ) */ b, // ,\n c)", False) == [("f", [(None, "`)${x}`"), (None, "b"), (None, "c")])]
    assert told("client\n  .chat.create(x)\na() == b(c == d)") == [
        ("client.chat.create", [(None, "x")]), ("a", []), ("b", [(None, "c == d")])]
    assert told("word.\nprint(x)") == [("print", [(None, "x")])]


def test_what_is_never_closed():
    assert told("f(\ng(1)\nh[2\nk(3)}") == [("g", [(None, "1")]), ("k", [(None, "3")])]
    assert told(")))f(1)") == [("f", [(None, "1")])]
    for text in ("(" * 50_000, "f(" * 50_000, "def f(\n" * 30_000, "([{" * 10_000 + "f(1)" + ")" * 10_000, "a." * 50_000, "'" * 50_000, '"""' * 9999):
        start = time.time()
        calls(text, True, ANY), plain_heads(text)
        assert time.time() - start < 10


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='()[]{}"\'#,=\n ad ef\\', max_size=60))
def test_any_text(text):
    calls(text, True, ANY), calls(text, False, ANY)
    plain = plain_heads("def f(" + text + "\n")
    assert len(plain) == len(text) + 7 and [c == "\n" for c in plain] == [c == "\n" for c in "def f(" + text + "\n"]


def test_functions_and_classes(spark, files_table):
    code = with_language(files_table({"a.py": 'def f(a=g(h(i(1)))):\n    return a\ndef k(x=")", y="(", z=1):\n    pass\n'
                                              "def deep(" + "a=(" + "(" * 50 + ")" * 50 + "), b=2):\n    pass\n"
                                              "class C(A, m(n(o(p(1)))), B):\n    def q(self): pass\nbroken(\ndef last(z): pass"}))
    assert {r.name: r.params for r in functions(code).collect()} == {
        "f": ["a"], "k": ["x", "y", "z"], "deep": ["a", "b"], "q": ["self"], "last": ["z"]}
    assert [(r.name, r.bases) for r in classes(code).collect()] == [("C", ["A", "B"])]


def test_rules_over_lines(spark, files_table):
    def hits(text, path="a.py", family="sast"):
        rows = rules.rule_findings(files_table({path: text}), family).collect()
        return sorted((r.title.removeprefix("va-"), r.line) for r in rows)
    assert hits("x\nCORS(\n  app,\n  origins='*')\nCORS(app, origins=f('*'))") == [("broad-cors", 2)]
    assert hits("m(C, allow_origins=[\n '*'\n])  # x") == [("broad-cors", 1)]
    assert hits("# CORS(app, origins='*')\ns = \"\"\"\nCORS(app, origins='*')\n\"\"\"") == []
    assert hits("jwt.encode(\n  f(a, 'b'),\n  'k')\njwt.encode(f(a, 'b'), K)") == [("hardcoded-jwt", 1)]
    assert hits("print(\n user.email,\n)\nprint(mask(user.email))\nx.print(user.email)", family="gdpr") == [("pii-in-logs", 1)]
    assert hits("eval(\n reply\n)\neval('1')\nm.eval(x)\neval(f(a, b))", family="injection") == [
        ("llm-output-to-eval", 1), ("llm-output-to-eval", 6)]
    assert hits("subprocess.run(\n cmd,\n shell=True)\nsubprocess.run(cmd, env=f(shell=True))\nos.system(\n c)", family="injection") == [
        ("llm-output-to-subprocess", 1), ("llm-output-to-subprocess", 5)]
    assert hits("<p\n dangerouslySetInnerHTML={\n {__html: h}} />\nn.innerHTML =\n x\nif (n.innerHTML == x) {}", "a.jsx", "injection") == [
        ("missing-output-validation", 1), ("missing-output-validation", 4)]
    deep = "c.messages.create(a=f(g(h(i(j())))), messages=[{'role': 'user', 'content': f'{q}'}])"
    assert hits(deep, family="injection") == [("user-input-to-llm", 1)]
    route = "@app.get('/')\ndef f(a=g(h(i(j(1)))), u={}):\n  pass"
    assert hits(route.format("Depends(x(y(z(1))))"), family="soc2") == [] and hits(route.format("1"), family="soc2") == [("no-auth-middleware", 1)]
