import pytest
from pyspark.sql import functions as F

from lodestone.llm import handwritten as hw

PATHS = {
    "node_modules/a/b.js": "vendored", "src/third_party/x.cpp": "vendored", "Godeps/_workspace/a.py": "vendored", "a\\vendor\\b.go": "vendored", "src/__generated__/a.ts": "generated", "src/x/gen/a.go": "generated", "a/b.pb.go": "generated", "a/b_pb2_grpc.py": "generated",
    "web/a.min.js": "generated", "web/a-min.js": "generated", "a/XGrpc.java": "generated", "a/b.d.ts": "generated", "tools/gen/a.py": None, "scripts/dist/a.py": None, "build/a.java": None, "app/vendors/a.py": None, "vendor_portal/a.rs": None, "codegen/a.py": None,
    "src/gen_report.py": None, "src/minify_rules.rs": None, "src/min_max.java": None, "item_log_gen.py": None, "a/b_pb.rs": None, "generated.py": None, "vendor": None, "": None,
}


def test_paths(spark):
    rows = spark.createDataFrame([(p,) for p in PATHS] + [(None,)], "p string")
    got = {r["p"]: r["k"] for r in rows.select("p", hw.path_kind(F.col("p")).alias("k")).collect()}
    assert got == PATHS | {None: None}


HAND = "def f(a):\n    x = [1, 2, 3, 4, 5, 6, 7, 8]\n    out.write('// AUTOGENERATED FILE')\n    # Code generated by tool; DO NOT EDIT.\n    return x\n"
BODIES = [
    (HAND, "python", None), ("// Code generated by tool v1; DO NOT EDIT.\nfunc f() {}\n", "go", "generated"), ("# Third-party: lib release 3\ndef f():\n    return 1\n", "python", "generated"), ("/** Auto-generated method stub, fill in later. */\nint f() {\n}\n", "cpp", None),
    ("function a(b){" + "if(b>1){c=d(e)}var f=g.h(i,2);" * 40 + "}", "javascript", "minified"), ("def f():\n    return g(\"" + "Ab3/" * 200 + '")\n', "python", "data"), ('def f(a):\n    q = "' + "select a, b " * 60 + '"\n    r = run(q)\n    return r\n', "python", None),
    ("int f() {\n  return {" + "\n".join("    1%02d, 2, 3, 4, 5, 6, 7, 8," % i for i in range(12)) + "\n  };\n}\n", "cpp", "data"), ("def f():\n" + "".join(f"    reg({i}, name{i}, {i * 7}, ctx)\n" for i in range(9)), "python", "generated"),
    ("class A {\n" + "".join(f"  private B{i} x{i} = new B{i}({i});\n" for i in range(9)) + "}\n", "java", None), ("", "python", None),
]


@pytest.mark.parametrize("at", range(len(BODIES)))
def test_bodies(at):
    body, language, kind = BODIES[at]
    stats = {k: v[0] for k, v in hw.layout([body.encode()]).items()}
    assert hw.body_kind(body, stats, language) == kind


def test_layout_of_a_batch_equals_that_of_each():
    bodies = [b.encode() for b, _, _ in BODIES] + ["é\r\n\t中 1.5 x".encode(), b"\n\n"]
    whole = hw.layout(bodies)
    for i, b in enumerate(bodies):
        assert {k: v[i] for k, v in whole.items()} == {k: v[0] for k, v in hw.layout([b]).items()}


def test_table(spark):
    index = spark.createDataFrame([("r", "vendor/a.py", "x"), ("r", "src/b.py", None), ("r", None, None), (None, "vendor/a.py", None)], "repo string, file_path string, kind string")
    units = spark.createDataFrame([("r", "src/c.py", "python", BODIES[2][0]), ("r", "src/c.py", "python", HAND), ("r", "src/b.py", "python", HAND), ("r", "src/d.py", None, None), ("r", "src/c.py", "python", BODIES[2][0])], "repo string, file_path string, language string, body string")
    got = {(r["repo"], r["file_path"]) for r in hw.not_handwritten(index, units).collect()}
    assert got == {("r", "vendor/a.py"), (None, "vendor/a.py"), ("r", "src/c.py")}
    assert hw.not_handwritten(index.where("false"), units.where("false")).count() == 0


def test_markers_by_the_way_words_stand_together():
    for text in ("# emitted by schemac 2.1", "// This file is transpiled from a.ts", "/* auto-generated */", "// local edits get overwritten", "# Mirrored unchanged from the upstream project", "// This module was generated with idlgen"):
        assert hw.marked(text + "\nx = 1\n"), text
    for text in ("# Generates the code of all clients", "// Reports edits that a user made", "# Imports prices from the vendor's feed", "// Auto-generated method stub", "# The generated report is kept", "// Never loses changes"):
        assert not hw.marked(text + "\nx = 1\n"), text
