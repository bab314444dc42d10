from __future__ import annotations

import random
import re

import numpy as np

from contextloom.llm import minhash, origin
from contextloom.llm.globs import attribute_glob_regex, parse_attributes
from contextloom.llm.origin import source_origins
from contextloom.llm.origin_marks import content_marks

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def code(seed: int, lines: int = 60) -> str:
    rng = random.Random(seed)
    shapes = ("{} = {}({}, {})", "if {} < {}:", "    return {} + {}", "for {} in {}({}):", "{}.{}({})", "while {}: {} -= {}", "x[{}] = {} * {} - {}", "{}, {} = {}", "yield {}", "print({}, end={})")
    return "\n".join((s := rng.choice(shapes)).format(*(rng.choice(WORDS) + str(rng.randrange(9)) for _ in range(s.count("{}")))) for _ in range(lines))


def origins(df):
    return {r.file_id: r.origin for r in source_origins(df).collect()}


def test_kinds(make_files):
    library = code(1)
    stamped = "\n".join(f"int get_a{n}(void) {{ return f{n}; }}" for n in range(40))
    df = make_files(
        (1, "r", "src/a.py", code(2)), (2, "r", "src/b.py", "# Code generated by x. DO NOT EDIT.\n" + code(3)), (3, "r", "yarn.lock", "a"), (4, "r", "vendor/l/c.py", library),
        (5, "s", "src/copy.py", library.replace("\n", "\n\n", 3) + "\n# local change\n"), (6, "r", "src/d.c", stamped), (7, "r", "web/x.js", "function a(b){return b}" * 60),
        (8, "r", "src/e.py", "# Once generated, now kept by hand.\n# Code generated by x. DO NOT EDIT.\n" + code(5)), (9, "r", "src/f.py", "banner = 'Code generated by x. DO NOT EDIT.'\n" + code(6)),
        (10, "r", "vendors/g.py", code(7)), (11, "r", None, None), (12, "r", "src/empty.py", ""), (13, None, None, "x = 1"), (1, "r", "src/a.py", code(2)),
    )
    got = origins(df)
    assert {k for k, v in got.items() if v == "hand_written"} == {1, 8, 9, 10, 12, 13}
    assert (got[2], got[3], got[4], got[5], got[6], got[7]) == ("generated", "generated", "vendored", "vendored", "generated", "minified")
    assert 11 not in got


def test_attribute_files(make_files):
    df = make_files(
        (1, "r", ".gitattributes", "out/** linguist-generated\nout/keep/* -linguist-generated\n*.lib.py linguist-vendored=true\n# no\n"), (2, "r", "out/a.py", code(1)), (3, "r", "out/keep/b.py", code(2)),
        (4, "r", "sub/x.lib.py", code(3)), (5, "r", "sub/.gitattributes", "*.lib.py linguist-vendored=false\n"), (6, "r", "sub2/y.lib.py", code(4)), (7, "other", "out/a.py", code(5)),
    )
    got = origins(df)
    assert (got[2], got[3], got[4], got[6], got[7]) == ("generated", "hand_written", "hand_written", "vendored", "hand_written")


def test_mined_patterns(make_files):
    rows = [(n, f"r{n}", f"src/m{n}/a{n}_b{n}_pb2.py", "# @generated\n" + code(n)) for n in range(12)]
    rows += [(20, "q", "src/c_d_pb2.py", code(20)), (21, "q", "src/c_d.py", code(21))]
    rows += [(30 + n, f"r{n}", f"lib/m{n}/check_of_pb2.py", code(40 + n)) for n in range(5)]
    got = origins(make_files(*rows))
    assert got[20] == "generated" and got[21] == "hand_written" and got[30] == "hand_written"


def test_empty(make_files):
    assert origins(make_files()) == {}


def test_globs():
    import re

    hit = lambda g, p: bool(re.search(attribute_glob_regex(g), p))
    assert hit("*.js", "a/b.js") and not hit("/*.js", "a/b.js") and hit("a/**", "a/b/c") and hit("**/x/*.c", "q/x/y.c") and not hit("a?c", "a/c") and attribute_glob_regex("dir/") is None
    assert hit("a/**/b.c", "a/b.c") and hit("a/**/b.c", "a/x/y/b.c") and hit("x[!0-9].c", "q/xa.c") and not hit("x[!0-9].c", "x1.c") and hit(r"a\*b", "a*b") and not hit(r"a\*b", "axb")
    assert parse_attributes("a b c\n*.x -linguist-generated linguist-vendored\n") == [(1, attribute_glob_regex("*.x"), "generated", False), (1, attribute_glob_regex("*.x"), "vendored", True)]


def test_attribute_file_grammar():
    text = '[attr]made linguist-generated\n*.pb.go made text\n"a b/\\143.x" linguist-vendored\n*.lock !linguist-generated\n!no linguist-vendored\nd/ linguist-vendored\n*.q other-generated -made\n'
    assert [(n, a, v) for n, _, a, v in parse_attributes(text)] == [(1, "generated", True), (2, "vendored", True), (3, "generated", None)]
    assert re.search(parse_attributes(text)[1][1], "a b/c.x")


def test_patterns_of_declaring_repositories_reach_the_others(make_files):
    rows = []
    for r in range(6):  # six repositories declare, by directory and by ending
        rows += [(r * 100, f"d{r}", ".gitattributes", "emitted/** linguist-generated\n*_ext_copy.py linguist-vendored\nemitted/own.py !linguist-generated\n")]
        rows += [(r * 100 + 1 + n, f"d{r}", f"emitted/m{r}{n}.py", code(r * 100 + n)) for n in range(4)]
        rows += [(r * 100 + 20 + n, f"d{r}", f"lib/a{r}{n}_ext_copy.py", code(2000 + r * 100 + n)) for n in range(3)]
        rows += [(r * 100 + 40 + n, f"d{r}", f"lib/p{r}{n}.py", code(4000 + r * 100 + n)) for n in range(3)]
    rows += [(900, "u", "emitted/x.py", code(900)), (901, "u", "lib/z_ext_copy.py", code(901)), (902, "u", "lib/q.py", code(902)), (60, "d0", "emitted/own.py", code(903)), (903, "d0", "more/emitted/y.py", code(904))]
    got = origins(make_files(*rows))
    assert (got[900], got[901], got[902]) == ("generated", "vendored", "hand_written")
    assert got[1] == "generated" and got[20] == "vendored" and got[40] == "hand_written"
    assert got[60] == "hand_written" and got[903] == "hand_written"  # the repository has spoken


def test_data_written_as_code(make_files):
    rng = random.Random(4)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    base = "BLOB = (\n" + "\n".join('    "' + "".join(rng.choice(letters) for _ in range(64)) + '"' for _ in range(60)) + "\n)\n"
    escapes = "package a\n\nvar b = []byte(\n" + "\n".join('\t"' + "".join(f"\\x{rng.randrange(256):02x}" for _ in range(20)) + '" +' for _ in range(60)) + "\n)\n"
    numbers = "static const int T[] = {\n" + "\n".join("  " + ", ".join(str(rng.randrange(9999)) for _ in range(12)) + "," for _ in range(60)) + "\n};\n"
    got = origins(make_files((1, "r", "a.py", base), (2, "r", "b.go", escapes), (3, "r", "c.c", numbers), (4, "r", "d.py", code(5) + "\nK = '" + "".join(rng.choice(letters) for _ in range(64)) + "'\n")))
    assert got == {1: "data", 2: "data", 3: "data", 4: "hand_written"}


def test_hot_buckets(make_files, monkeypatch):
    monkeypatch.setattr(origin, "HOT_BUCKET", 2)
    head = "\n".join(f"# licence line {n} of the common text" for n in range(12)) + "\n"
    rows = [(n, "r", f"vendor/l/a{n}.py", head + code(500 + n, 40)) for n in range(25)]
    rows += [(100 + n, "s", f"src/b{n}.py", head + code(500 + n, 40) + "\nlocal = 1\n") for n in range(25)] + [(200, "s", "src/own.py", head + code(900, 40))]
    got = origins(make_files(*rows))
    assert all(got[100 + n] == "vendored" for n in range(25)) and got[200] == "hand_written"


def test_copies_by_exact_similarity(make_files):
    rows, expected = [], {}
    for seed in range(300, 340):
        library = code(seed, 24)
        words = [w for line in library.split("\n") for w in line.split(" ")]
        for n in range(seed % 4):
            words[(n * 37 + 11) % len(words)] = f"changed{seed}x{n}"
        copy = " ".join(words)
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (re.findall(r"\w+", text) for text in (library, copy)))
        rows += [(seed, "r", f"vendor/l/a{seed}.py", library), (1000 + seed, "s", f"src/b{seed}.py", copy)]
        expected[1000 + seed] = len(a & b) >= 0.8 * len(a | b)
    assert 0 < sum(expected.values()) < len(expected)
    got = origins(make_files(*rows))
    assert {k: got[k] == "vendored" for k in expected} == expected


def test_signature_estimates_similarity():
    rng = random.Random(3)
    words = [f"w{rng.randrange(500)}" for _ in range(800)]
    changed = words[:700] + [f"v{n}" for n in range(100)]
    a, b = minhash.signatures([" ".join(words), " ".join(changed)])
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    true = len(shingles(words) & shingles(changed)) / len(shingles(words) | shingles(changed))
    assert abs(np.mean(a == b) - true) < 0.2
    same = minhash.signatures([" ".join(words), None, "", "one"])
    assert (same[0] == a).all() and same[1] is None and same[2] is None and same[3] is not None


def test_signature_at_the_foot():
    licence = "".join(f"// Licence, line {n}.\n" for n in range(40))
    for text in (code(1) + "\n# Code generated by x. DO NOT EDIT.\n", licence + "// Code generated by x. DO NOT EDIT.\n" + code(2), "a = `\n" + code(3) + "\n// @generated\n"):
        assert content_marks("a.js", text)["signed"] is True
    assert content_marks("a.py", code(4) + "\n# Code generated by x. DO NOT EDIT.\n# Now maintained by hand.\n")["kept"] is True
    assert content_marks("a.c", code(5) + "\n// Imported from zlib, revision 12.\n")["foreign"] is True


def test_signature_in_a_literal_is_none():
    for opened, closed in (("x = `", "`"), ('x = """', '"""'), ("cat <<EOF", "EOF")):
        text = code(1) + f"\n{opened}\n# Code generated by x. DO NOT EDIT.\n// @generated\n{closed}\n" + code(2)
        assert content_marks("a.py", text)["signed"] is False


def test_marks_never_fail():
    for text in ("", "\n", "﻿", "\x00", "/*", '"' * 5000, "x" * 100_000, "'\\"):
        assert content_marks("a.py", text)["signed"] is False
