from __future__ import annotations

import pytest

from contextloom.functions.code_spans import spans_of
from contextloom.llm.code_docs import function_docs, is_trivial, once, prose_of

CASES = {
    "a.go": ("package p\n\n// Sum adds all the numbers up and returns them.\nfunc Sum(a ...int) int {\n\treturn 0\n}\n\n// Detached comment with many more words.\n\nfunc Lone() {}\n", [(4, "Sum")]),
    "a.c": ("/**\n * Walks the whole list and frees every node.\n * @param a x\n */\nstatic inline int\nfree_all(struct n *a)\n{\n  return 0;\n}\n/* Declared only, so it has no body at all. */\nint f(void);\n", [(6, "free_all")]),
    "a.cpp": ("/// Picks the cheapest of all the candidates found.\ntemplate <typename T>\nT A<T>::pick(int x) const noexcept {\n  return x;\n}\n", [(3, "pick")]),
    "A.java": ("class A {\n  /** Opens the file and reads all of it. */\n  @Deprecated\n  @Named(\n    value = \"x\")\n  public <T> List<T> open(String p) throws E {\n    return null;\n  }\n  /** {@inheritDoc} */\n  void b() {}\n  // Has an interface with no body there.\n  abstract void c();\n}\n", [(6, "open")]),
    "a.ts": ("export class C {\n  /**\n   * Sends the message and waits for its answer.\n   */\n  @Log({ a: 1 })\n  async send(m: { a: string }): Promise<{ b: number }> {\n    return go();\n  }\n}\n// Doubles the given number without any rounding.\nexport const twice = (x: number): number => x * 2;\n// Is not bound to a constant, so no case here.\nlet no = (x) => x;\n", [(6, "send"), (11, "twice")]),
    "a.rs": ("impl A {\n    /// Returns the first of the elements that matches.\n    #[must_use]\n    #[cfg(\n        test\n    )]\n    pub(crate) async fn first<'a, F: Fn(i64) -> bool>(&'a self, f: F) -> Option<i64>\n    where F: Send {\n        None\n    }\n}\n", [(7, "first")]),
    "a.py": ("@deco\ndef outer(a):\n    '''Builds the table out of all its rows.'''\n    async def inner(b):\n        \"\"\"Yields each row after it has been checked.\"\"\"\n        yield b\n    return inner\n\n# A comment above is no docstring in this language.\ndef bare():\n    pass\n", [(2, "outer"), (4, "inner")]),
    "a.jsx": ("/* Renders the list with one entry per item. */\nexport default function List({ items }) {\n  const re = /\"{/;\n  return <ul>{items}</ul>;\n}\n", [(2, "List")]),
    "a.txt": ("// Would be a documented function in another file.\nfunc F() {}\n", []),
}


@pytest.mark.parametrize("path", CASES)
def test_languages(spark, make_files, path):
    source, want = CASES[path]
    got = once(function_docs(make_files((1, "r", path, source), (1, "r", path, source))).select("file_id", "fn_line", "fn_name"))
    assert sorted((r.fn_line, r.fn_name) for r in got.collect()) == want


def test_pairs_hold_code_and_prose(make_files):
    row = function_docs(make_files((1, "r", "a.c", CASES["a.c"][0]))).first()
    assert row.code.startswith("static inline int") and row.code.endswith("}") and row.description == "Walks the whole list and frees every node."


@pytest.mark.parametrize(
    ("doc", "name", "trivial"),
    [
        ("// load user table now", "loadUserTable", True), ("// Loads rows from disk", "f", False), ("// three words only", "f", True), ("// TODO: write down what this function does", "f", True),
        ("/** Auto-generated method stub for this very function */", "f", True), ("// a = b(c);\n// return a;", "f", True), ("/** @param a the first of many words\n * @return b the next of many */", "f", True),
        ("", "f", True), ("Args:\n    a: the very first argument given here", "f", True), ("// Description of the function goes here", "f", True), ("/** 1 2 3 4 5 */", "f", True), ("// Öffnet die große Datei", "f", False),
    ],
)
def test_trivial(doc, name, trivial):
    assert is_trivial(doc, name) is trivial


def test_intervening_statement_and_trailing_comment():
    source = "// This comment belongs to the variable below it.\nvar x = 1\nfunc F() {\n}\nvar y = 2 // trailing words that say nothing about G\nfunc G() {\n}\n"
    comments, functions = spans_of(source, "go")
    from contextloom.llm.code_docs import documented

    assert documented(comments, functions) == []


def test_nulls_and_odd_texts(make_files):
    rows = [(1, "r", None, "func F() {}"), (2, "r", "a.go", None), (3, "r", "a.go", ""), (4, "r", "a.js", "`" * 99 + "{" * 500), (5, "r", "a.py", "def f(:\n  '''x"), (6, "r", "a.c", "/*"), (7, "r", "a.rs", "fn f(")]
    assert function_docs(make_files(*rows)).count() == 0
    assert function_docs(make_files()).count() == 0


def test_prose():
    assert prose_of("/**\n * One.\n * @param x y\n */") == "One."
