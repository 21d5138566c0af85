import random

import numpy as np
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from cipherledger.llm.code_origin import file_origins, file_traits, literal_ratio, passages, re_pair

OWN = "import hashlib\n\n" + "\n".join(f"def {a}_{b}({c}):\n    {d} = {c}.get('{e}')\n    return {d}\n" for a, b, c, d, e in [("seal", "order", "x", "y", "k1"), ("open", "batch", "tenant", "size", "width"), ("merge", "cache", "left", "total", "name"), ("parse", "line", "text", "head", "first")])
BEAN = "\n".join(f"    public String getField{i:03}() {{ return this.field{i:03}; }}" for i in range(40))
_R = random.Random(3)
_W = "seal open merge parse order batch cache ledger vault session width name size head left total rotate export".split()
LIB = "\n".join(f"{_R.choice(['let', 'const', 'if', 'return', 'await'])} {' '.join(_R.choice(_W) + _R.choice(['(', '=', '.', ' +', ');']) for _ in range(_R.randint(2, 7)))}" for _ in range(60))
SCHEMA = "file_id long, system_name string, file_path string, content string, repo string"


def origins(spark, *files):
    df = spark.createDataFrame([(i, s, p, c, "clash") for i, s, p, c in files], SCHEMA)
    return dict(rows(file_origins(df), "file_id", "origin"))


def test_each_origin(spark):
    blob = "DATA = \"\"\"\n" + "\n".join("q9Zr4tPw0LkV7yHs2dGfXa" * 3 for _ in range(3)) + "".join(chr(97 + (i * i * 7) % 26) + str(i * 7919 % 97) for i in range(300)) + "\n\"\"\"\n"
    mini = ";".join(f"e.f{i}=function(t){{for(var n=0;n<{i};n++)t[n]^={i}}}" for i in range(40))
    got = origins(
        spark,
        (1, "a", "src/own.py", OWN),
        (2, "a", "src/bean.java", BEAN),
        (3, "a", "web/x.js", mini),
        (4, "a", "src/data.py", blob),
        (5, "a", "src/copy.js", LIB),
        (6, "b", "lib\\other\\name.js", LIB.replace("\n", "\n\n").replace(LIB.split("\n")[20], "patched();")),
        (7, "a", "src/x.go", "// Code generated by tool v1. DO NOT EDIT.\npackage x\n" + OWN),
        (8, "a", "tools/emit.py", OWN + "\nHEADER = '# Code generated by emit. DO NOT EDIT.'\n"),
        (9, "a", "src/vendor/FetchVendorInvoice1.py", OWN.replace("order", "vendor_invoice")),
        (10, "a", "config/a.json", "{" + ",".join(f'"k{i}": "{i}"' for i in range(100)) + "}"),
        (11, "a", "core/vendor/lib-1.2.3/z.py", OWN.replace("seal", "wrap")),
        (12, "a", "src/n.py", None),
        (13, "a", "src/e.py", ""),
        (14, None, None, "x = 1"),
    )
    assert got == {1: "own", 2: "generated", 3: "minified", 4: "data", 5: "vendored", 6: "vendored", 7: "generated", 8: "own", 9: "own", 10: "own", 11: "vendored", 14: "own"}


def test_repeated_rows_are_no_other_repository(spark):
    assert origins(spark, (1, "a", "x.js", LIB), (1, "a", "x.js", LIB)) == {1: "own"}
    assert origins(spark) == {}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=200))
def test_re_pair_never_grows_and_absorbs_repeats(tokens):
    left, rules, uses = re_pair(np.array(tokens, dtype=np.int64))
    assert left + uses == len(tokens) and uses >= 0 and rules <= uses


def test_re_pair_of_a_repeat():
    left, rules, uses = re_pair(np.array([1, 2, 3, 4] * 64))
    assert left <= 4 and rules >= 2


def test_equal_passages_have_equal_rules_anywhere():
    lines = LIB.split("\n")
    moved = [f"own line {i}" for i in range(17)] + lines + [f"more {i}" for i in range(9)]
    shared = {r for r, _ in passages(lines)} & {r for r, _ in passages(moved)}
    assert len(shared) >= len(passages(lines)) - 3 > 0
    assert sum(n for _, n in passages(lines)) == len(lines)


def test_a_mark_behind_a_long_licence_header_counts():
    header = "".join(f"// Licence text, paragraph {n}.\n" for n in range(40))
    mark = "// Code generated by protoc. DO NOT EDIT.\n"
    assert file_traits(header + mark + "int x = 1;\n", "src/x.c")["generated_mark"]
    assert not file_traits(header + "int x = 1;\n" + mark, "src/x.c")["generated_mark"]


def test_licences_and_bans_on_one_part_leave_a_file_own(spark):
    got = origins(
        spark,
        (1, "a", "src/a.py", "# SPDX-License-Identifier: Apache-2.0\n" + OWN),
        (2, "a", "src/b.py", "# Do not edit the constants below without telling ops.\n" + OWN.replace("seal", "fold")),
        (3, "a", "src/c.py", "# Produced from x.proto. DO NOT EDIT.\n" + OWN.replace("seal", "wrap")),
        (4, "a", "src/d.java", "// Erzeugt von jaxgen aus d.xsd - nicht von Hand ändern\n" + OWN.replace("seal", "draw")),
        (5, "a", "src/e.py", "# keys are generated by the client service and must not be edited by users\n" + OWN.replace("seal", "lift")),
        (6, "a", "src/f.js", "// SPDX-License-Identifier: MIT\n" + LIB),
        (7, "b", "src/g.js", "// SPDX-License-Identifier: MIT\n" + LIB + "\n".join(f"own{i}(x{i * 7});" for i in range(150))),
    )
    assert got == {1: "own", 2: "own", 3: "generated", 4: "generated", 5: "own", 6: "vendored", 7: "vendored"}


def test_literals_that_grammars_do_not_shorten():
    r = random.Random(1)
    assert literal_ratio("".join(r.choice("0123456789abcdef") for _ in range(3000))) > 0.3 > literal_ratio("abcdefgh" * 300)
    assert literal_ratio("aaaa" * 100) == 0.0 and literal_ratio("short") == 0.0 and literal_ratio("") == 0.0
