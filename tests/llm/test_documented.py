import pytest

from lodestone.llm import documented as dc

SAYS = [
    ("Removes entries older than 14 days and reports how many remain.", "prune"), ("Never touches the disk.", "load_item"), ("TODO: speed this up later.\nKeeps at most 602 entries.", "store"), ("Deprecated.\nSplits the row into parts.", "split"),
    ("/**\n * @param a the first matrix to start from\n */", "run"), ("Liefert den Wert zurück, dessen Größe stimmt.", "get"), ("返回缓存中最旧的记录。", "oldest"), ("NOTE\nCosts one lookup per archive.", "x"), ("\\brief Keeps at most 602 entries.", "store"), ("// Copyright 2020 me\n// Panics on an empty journal.", "f"),
]
SAYS_NOTHING = [
    (None, "f"), ("", "f"), (" \n ", "f"), ("----------", "f"), ("Backup layer.", "backup_layer"), ("This is the restore ratio function, which is called restore ratio.", "restoreRatio"), ("Dispatches the slot.", "dispatchSlot"), ("Wrapper.", "f"),
    ("TODO: somebody should describe what this does\n(left open since the last release)", "f"), ("@param target the target\n@param address\n@return", "f"), ("See base class.", "f"), ("Auto-generated method stub, fill in the description later on.", "f"),
    ("Author: planner team\nDate: 2023-06-10\nVersion: 1.0", "f"), ("// SPDX-License-Identifier: MPL-2.0", "f"), ("# noqa", "f"), ("// const a = call(b);", "f"), ("# x = compute(y)", "f"), ("merge_packet()", "merge_packet"), ("{@inheritDoc}", "f"), ("\\brief @param target the target", "f"), ("Siehe oben.", "f"),
    ("Vendored from lib 2.4.4; upstream changes are not applied here.", "f"),
]


@pytest.mark.parametrize("text,name", SAYS)
def test_says(text, name):
    assert dc.says_something(text, name)


@pytest.mark.parametrize("text,name", SAYS_NOTHING)
def test_says_nothing(text, name):
    assert not dc.says_something(text, name)


DOC = "Removes entries older than 14 days."
BODIES = [
    (1, "python", f'def f(a):\n    """{DOC}"""\n    return 1', True), (2, "python", f"def f(a):\n    x = 1\n    # {DOC}\n    return x", False), (3, "rust", f"/// {DOC}\n#[inline]\npub fn f() {{\n}}", True), (4, "go", f"// {DOC}\n\nfunc f() {{\n}}", False),
    (5, "java", f"/**\n * {DOC}\n */\n@Override\npublic int f() {{\n  return 1;\n}}", True), (6, "javascript", f"function f() {{\n  // {DOC}\n  return 1;\n}}", False), (7, "python", f"def f(\n    a,\n    b,\n):\n    '''{DOC}'''\n", True),
    (8, "python", f'def f():\n    x = """{DOC}"""\n', False), (9, "unknown", f"// {DOC}\r\nfunction f() {{\r\n}}", True), (10, "python", f"def f():\n    def g():\n        '''{DOC}'''\n    return g", False), (11, None, None, False),
]


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, unit_type string, name string, full_signature string, docstring string, body string, language string, file_path string, depth string")


def test_places_of_documentation(spark):
    rows = [(i, "function", "f", None, None, body, language, "a.js" if language == "unknown" else "a", "x") for i, language, body, _ in BODIES]
    rows += [rows[0], (20, "method", "f", "", DOC, None, "go", "a", "x"), (21, "class", "f", None, DOC, f"// {DOC}\nclass f {{}}", "java", "a", "x"), (22, "function", None, None, None, "", "python", "a", "x"), (None, "function", "f", None, DOC, "x", "go", "a", "x")]
    got = [r["id"] for r in dc.documented(table(spark, rows)).where("number = 1").collect()]
    assert sorted(got) == [i for i, _, _, there in BODIES if there] + [20]
    pairs = {(r["id"], r["number"]): r for r in dc.documented_pairs(table(spark, rows)).collect()}
    assert pairs[1, 1]["description"] == DOC and pairs[1, 1]["code"].startswith("def f") and pairs[20, 1]["full_signature"] is None
    assert pairs[10, 2]["name"] == "g" and pairs[10, 2]["code"] == f"    def g():\n        '''{DOC}'''"
    assert dc.documented(table(spark, [])).count() == 0


def test_functions_of_a_whole_file(spark):
    text = f"// {DOC}\nfunc a() {{\n\tif x {{\n\t}}\n}}\n\nfunc b() {{\n}}\n// first\n// second\nfunc c() {{\n}}\n"
    rows = dc.functions(table(spark, [(1, "function", "a", None, None, text, "go", "x.go", None)])).orderBy("number").collect()
    assert [(r["name"], r["comment"]) for r in rows] == [("a", f"// {DOC}"), ("b", None), ("c", "// first\n// second")]
    assert [text[r["begin"] : r["end"]] for r in rows] == ["func a() {\n\tif x {\n\t}\n}\n", "func b() {\n}\n", "func c() {\n}\n"]


OTHER = "Splits the row into equal parts."
FILES = {
    "python": (f"import os\n\n\ndef f(a,\n      b):\n    \"\"\"{DOC}\"\"\"\n    if a:\n        return {{1: 2}}\n    return b\n\n\n# {OTHER}\n@cached\ndef g():\n    for x in y:\n        pass\n\nz = 1\n", ["def f(a,\n      b):\n    \"\"\"" + DOC + "\"\"\"\n    if a:\n        return {1: 2}\n    return b", "def g():\n    for x in y:\n        pass"]),
    "rust": (f"/// {DOC}\nfn f(a: &str) -> u8 {{\n    let s = \"}}\";\n    if a {{ 1 }} else {{\n        2\n    }}\n}}\n\n/// {OTHER}\npub fn g()\n{{\n    h()\n}}\n", ['fn f(a: &str) -> u8 {\n    let s = "}";\n    if a { 1 } else {\n        2\n    }\n}', "pub fn g()\n{\n    h()\n}"]),
    "go": (f"// {DOC}\nfunc f() {{\n\tif a {{\n\t}} else {{\n\t}}\n}}\n\n// {OTHER}\nfunc (r *T) g(x int) int {{\n\treturn 1\n}}\n", ["func f() {\n\tif a {\n\t} else {\n\t}\n}", "func (r *T) g(x int) int {\n\treturn 1\n}"]),
    "javascript": (f"// {DOC}\nfunction f() {{\n  try {{\n    a();\n  }} catch (e) {{\n  }}\n}}\n\n/** {OTHER} */\nexport const g = (x) => {{\n  return x;\n}};\n", ["function f() {\n  try {\n    a();\n  } catch (e) {\n  }\n}", "export const g = (x) => {\n  return x;\n};"]),
    "java": (f"/** {DOC} */\npublic int f() {{\n  return 1;\n}}\n\n/**\n * {OTHER}\n */\n@Override\nvoid g(int a) throws X {{\n  while (a) {{\n  }}\n}}\n", ["public int f() {\n  return 1;\n}", "void g(int a) throws X {\n  while (a) {\n  }\n}"]),
    "cpp": (f"// {DOC}\nint f() {{\n  return 1;\n}}\n\n// {OTHER}\nvoid A::g(int a) const {{\n  for (;;) {{\n  }}\n}}\n", ["int f() {\n  return 1;\n}", "void A::g(int a) const {\n  for (;;) {\n  }\n}"]),
}


def test_two_functions_of_a_text_make_two_pairs_with_their_own_code(spark):
    rows = []
    for i, (language, (text, _)) in enumerate(sorted(FILES.items())):
        body = text.removeprefix("import os\n\n\n")
        rows += [(10 * i + j, "function", "f", "sig", None, body.replace("\n", end), language, "x", None) for j, end in enumerate(("\n", "\r\n"))]
    got = {}
    for r in dc.documented_pairs(table(spark, rows)).collect():
        got.setdefault(r["id"], {})[r["number"]] = (r["name"], r["full_signature"], r["code"].replace("\r\n", "\n"))
    for i, language in enumerate(sorted(FILES)):
        codes = FILES[language][1]
        for j in (0, 1):
            assert got[10 * i + j] == {1: ("f", "sig", codes[0]), 2: ("g", None, codes[1])}, language
