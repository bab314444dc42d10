from __future__ import annotations

import pytest

from contextloom.functions.code_spans import spans_of
from contextloom.functions.signatures import by_patterns, compressed_toml, compressed_yaml, signatures

SOURCES = {
    "go": ("package p\n\nimport \"x\"\n\n// Doc of F.\nfunc (r *T) F(a map[string]struct{}) (int, error) {\n\treturn 1, nil\n}\n\ntype T struct {\n\tn int\n}\n", "return 1"),
    "java": ("package p;\nimport a.B;\npublic class C<T> extends D {\n  /** Doc. */\n  @Override\n  public <X> List<X> m(int a) throws E {\n    call();\n  }\n}\n", "call()"),
    "typescript": ("import { a } from './a';\nexport class C {\n  private async m(x: { a: number }): Promise<{ b: string }> {\n    work();\n  }\n}\nexport const f = (x: number): number => {\n  return work();\n};\n", "work()"),
    "rust": ("use a::b;\n\n/// Doc.\n#[inline]\npub fn f<'a, T: Fn(i64) -> i64>(x: &'a str) -> Option<T>\nwhere T: Clone {\n    body()\n}\n", "body()"),
    "c": ("#include <a.h>\n#define N 3\nstatic int\nf(int a, char *b)\n{\n    return work(a);\n}\n", "work("),
    "cpp": ("#include <a>\nnamespace n {\ntemplate <typename T>\nT A::f(int x) const noexcept {\n  return work(x);\n}\n}\n", "work("),
    "python": ("import os\n\n@deco\ndef f(a,\n      b) -> int:\n    \"\"\"Doc.\"\"\"\n    return work()\n\nclass C(B):\n    x: int = 1\n    async def m(self):\n        return work()\n", "work()"),
}


@pytest.mark.parametrize("language", SOURCES)
def test_verbatim_without_bodies(language):
    source, body = SOURCES[language]
    status, found = signatures(source, language)
    assert status == "ast" and found
    kept = "\n\n".join(s[2] for s in found)
    assert body not in kept
    assert all(s[2].strip() in source for s in found)
    assert [s[3] for s in found] == sorted(s[3] for s in found)


def test_nothing_in_strings_or_comments():
    source = 'int a = 1;\n/* int hidden(int x) {\n} */\nconst char *s = "int fake(void) { }";\nint real(void) {\n  return 0;\n}\n'
    assert [f.name for f in spans_of(source, "c")[1]] == ["real"]
    assert [f.name for f in spans_of("s = 'def no(): pass'\n# def no(): pass\ndef yes(): pass\n", "python")[1]] == ["yes"]


def test_declarations_without_body():
    assert spans_of("int f(int a);\nstruct s { int x; };\n", "c")[1] == []
    assert spans_of("interface I {\n  m(a: number): void;\n  n(): string\n}\nabstract class A { abstract q(): void; }\n", "js")[1] == []
    assert spans_of("trait T { fn a(&self) -> i64; }\n", "rust")[1] == []


def test_broken_python_falls_back():
    assert [f.name for f in spans_of("print 'old'\ndef f(a):\n    '''Doc.'''\n    return a\n", "python")[1]] == ["f"]


def test_patterns_over_lines():
    assert [s[3:] for s in by_patterns("func F(\n\ta int,\n) {\n}\nvar x = 1\n", "go")] == [(1, 3), (5, 5)]


def test_data_files():
    assert "[/* 6 items */]" in compressed_toml("a = [1, 2, 3, 4, 5, 6]\nb = [\n 1,\n 2,\n]\n") and "[/* 2 items */]" in compressed_toml("b = [\n 1,\n 2,\n]\n")
    assert "# ... (2 more items)" in compressed_yaml("k:\n" + "".join(f"  - {n}\n" for n in range(7)))
    assert compressed_yaml("") == "" and compressed_toml("") == ""
