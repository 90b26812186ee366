import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plyweave.functions import setexpr as E
from plyweave.operators import analyze as Z
from plyweave.operators import presence as P
from plyweave.operators import traces as R
from plyweave.sources import features as FX
from plyweave.sources import files as S
from plyweave.sources import matrix as M
from plyweave.sources import syntax as X

JAVA = """package p.q;
import java.util.List;
/** doc */
public class A extends B {
  private int x = 1;
  A(int a) { x = a; }
  public final void run(final String s, List<String> t, int... more) throws E { // c
    if (s == null) { return; }
    call(s);
  }
  static class Inner { void deep() {} }
}
"""


def table(text, language="java", atomic=()):
    names = [c.split()[0] for c in X.COLUMNS.split(", ")]
    return [dict(zip(names, r, strict=True)) for r in X.parse(text, language, frozenset(atomic))]


def test_java_tree():
    nodes = table(JAVA)
    tags = [n["tag"] for n in nodes]
    for tag in ("package_declaration", "import_declaration", "class_declaration", "class_body", "constructor_declaration", "method_declaration", "formal_parameters", "spread_parameter", "block_comment", "line_comment", "modifiers"):
        assert tag in tags
    assert "".join(n["text"] for n in nodes if n["is_leaf"]).replace(" ", "") == "".join(JAVA.split())
    for n in nodes:
        assert n["ancestors"] == ([] if n["parent_id"] is None else [*nodes[n["parent_id"]]["ancestors"], n["parent_id"]])
        assert n["node_id"] <= n["end_id"] < len(nodes)


def test_equal_subtrees_have_equal_hashes():
    nodes = table("class A { void f() { a(); } } class B { void f() { a(); } void g() { a(); } }")
    methods = [n["subtree_hash"] for n in nodes if n["tag"] == "method_declaration"]
    assert methods[0] == methods[1] != methods[2]


def test_atomic_tags_make_leaves():
    nodes = table(JAVA, atomic=S.ATOMIC["java"])
    assert [n["text"] for n in nodes if n["tag"] == "package_declaration"] == ["package p.q;"]
    assert all(n["is_leaf"] for n in nodes if n["tag"] in S.ATOMIC["java"])


@pytest.mark.parametrize("text", ["", "}", "class", "class A {", "void f(", "((((", "@", "a.b.", "class A { int f(int", "/* open", '"open', "import", "{}{}", "é ü"])
def test_java_never_fails(text):
    nodes = table(text)
    assert "".join(n["text"] for n in nodes if n["is_leaf"]).replace(" ", "") == "".join(text.split())


def test_empty_file_is_one_leaf():
    nodes = table("")
    assert len(nodes) == 1 and nodes[0]["text"] == "" and nodes[0]["is_leaf"]


def test_cpp_and_html():
    cpp = table("#include <a>\nint f() { return 1; } // x\n", "cpp")
    assert [n["tag"] for n in cpp][:2] == ["translation_unit", "preproc_directive"] and "compound_statement" in [n["tag"] for n in cpp]
    page = table("<html><body><p>Hi <b>you</b><br></p></body>", "html")
    assert [n["tag"] for n in page] == ["document", "html", "body", "p", "text", "b", "text", "br"]
    with pytest.raises(ValueError):
        X.parse("", "cobol")


def found(text, language, tag, atomic=()):
    """The source of every node with a tag, white space aside."""
    nodes = table(text, language, atomic)
    inside = lambda n: [m["text"] for m in nodes[n["node_id"] : n["end_id"] + 1] if m["is_leaf"]]
    return ["".join("".join(inside(n)).split()) for n in nodes if n["tag"] == tag]


JAVA_BODY = """class A { int x = f(1) + 2 * a[3] + 4; int[] t = {1, 2}; void m() {
  for (int i = 0; i < n; i++) { a.b(c.d, !e); }
  throw new E("x" + y);
  if (o instanceof B && A.class == z) return; else { q(); }
  try { q(); } catch (E | G e) { } finally { r(); }
  List<String> l = new ArrayList<>(); this.x = y = -1; run(() -> { z(); }); k = a >> 2; } }"""


@pytest.mark.parametrize("tag, want", [
    ("method_invocation", ["f(1)", "a.b(c.d,!e)", "q()", "q()", "r()", "run(()->{z();})", "z()"]), ("array_access", ["a[3]"]), ("field_access", ["c.d", "this.x"]),
    ("class_literal", ["A.class"]), ("instanceof_expression", ["oinstanceofB"]), ("throw_statement", ['thrownewE("x"+y);']), ("catch_formal_parameter", ["E|Ge"]),
    ("binary_expression", ["f(1)+2*a[3]+4", "2*a[3]", "i<n", '"x"+y', "oinstanceofB&&A.class==z", "A.class==z", "a>>2"]), ("generic_type", ["List<String>"]),
    ("object_creation_expression", ['newE("x"+y)', "newArrayList<>()"]), ("variable_declarator", ["x=f(1)+2*a[3]+4", "i=0", "l=newArrayList<>()"]), ("unary_expression", ["!e", "-1"]),
    ("try_statement", ["try{q();}catch(E|Ge){}finally{r();}"]), ("field_declaration", ["intx=f(1)+2*a[3]+4;", "int[]t={1,2};"]),
])
def test_java_expressions(tag, want):
    assert found(JAVA_BODY, "java", tag) == want


CPP_BODY = """#include <a>
namespace n { class A : public B { public: int f(const X& a) { return 1; } }; }
int A::f(const X& a) { if (a.b(1) > 'c' && !x) { return p->q[2] + 1; } else { y = 2; } for (int i = 0; i < 3; ++i) foo(i); int v[] = {1, 2}; }
std::vector<int> z;"""


@pytest.mark.parametrize("tag, want", [
    ("function_declarator", ["f(constX&a)", "A::f(constX&a)"]), ("class_specifier", ["classA:publicB{public:intf(constX&a){return1;}}"]), ("call_expression", ["a.b(1)", "foo(i)"]),
    ("char_literal", ["'c'"]), ("unary_expression", ["!x"]), ("parenthesized_expression", ["(a.b(1)>'c'&&!x)", "(inti=0;i<3;++i)"]), ("access_specifier", ["public:"]),
    ("binary_expression", ["a.b(1)>'c'&&!x", "a.b(1)>'c'", "p->q[2]+1", "i<3"]), ("if_statement", ["if(a.b(1)>'c'&&!x){returnp->q[2]+1;}else{y=2;}"]), ("subscript_expression", ["p->q[2]"]),
])
def test_cpp_structure(tag, want):
    assert found(CPP_BODY, "cpp", tag) == want


def test_cpp_atomic_tags_make_leaves():
    nodes = table(CPP_BODY, "cpp", S.ATOMIC["cpp"])
    assert all(n["is_leaf"] for n in nodes if n["tag"] in S.ATOMIC["cpp"])
    assert "foo(i)" in [n["text"] for n in nodes if n["tag"] == "call_expression"] and "(a.b(1) > 'c' && !x)" in [n["text"] for n in nodes if n["tag"] == "parenthesized_expression"]


def test_a_long_chain_of_operators_is_shallow():
    nodes = table("class A { String s = " + " + ".join(["x"] * 5000) + "; }")
    assert max(n["depth"] for n in nodes) < 8


@given(st.lists(st.sampled_from("a b1 if else for new class catch throw instanceof this public int ( ) [ ] { } ; , . :: -> < > >> = == + - ! & ++ ? : 1 'c' \"s\" // @ /*x*/ #p namespace struct void enum".split(" ")), max_size=40), st.sampled_from(["java", "cpp"]))
@settings(max_examples=600, deadline=None)
def test_no_text_is_lost(words, language):
    text = "\n".join(words)
    nodes = table(text, language)
    assert "".join("".join(n["text"].split()) for n in nodes if n["is_leaf"]) == "".join(text.split())
    for n in nodes:
        assert n["node_id"] <= n["end_id"] < len(nodes) and n["ancestors"] == ([] if n["parent_id"] is None else [*nodes[n["parent_id"]]["ancestors"], n["parent_id"]])


def names(spark, atomic):
    contents = spark.createDataFrame([("c", JAVA)], "content_id string, content string")
    nodes, errors = X.parse_contents(contents, "java", atomic)
    assert errors.count() == 0
    return {r.class_fqn for r in R.class_fqns(nodes).collect()}, {r.method_fqn for r in R.method_fqns(nodes).collect()}


@pytest.mark.parametrize("atomic", [(), S.ATOMIC["java"]])
def test_names_do_not_depend_on_atomic_tags(spark, atomic):
    classes, methods = names(spark, atomic)
    assert classes == {"p.q.A", "p.q.A.Inner"}
    assert methods == {"A(int)", "run(String,List<String>)", "deep()"}


def lines(spark, rows):
    return spark.createDataFrame(rows, "feature string, kind string, class_fqn string, method_fqn string")


def pruned(spark, rows):
    return {tuple(r)[1:] for r in R.prune(lines(spark, [("f", *r) for r in rows]), "feature").collect()}


def test_pruning(spark):
    assert pruned(spark, [("class", "p.A", ""), ("class", "p.A.B", ""), ("method", "p.A.B", "m()"), ("refinement", "p.A", "")]) == {("class", "p.A", "")}
    assert pruned(spark, [("class", "p.A", ""), ("refinement", "p.AB", "")]) == {("class", "p.A", ""), ("refinement", "p.AB", "")}
    kept = {("method", "p.C", "m()"), ("refinement", "p.C", "")}
    assert pruned(spark, [("method", "p.C", "m()"), ("refinement", "p.C", "m()"), ("refinement", "p.C", "")]) == kept
    assert pruned(spark, kept) == kept


@pytest.fixture(scope="module")
def product_line(tmp_path_factory):
    root = tmp_path_factory.mktemp("line")
    base = "package p;\nclass A {\n  int x;\n%s}\n"
    extra = "  void b() { x = 1; y = 2; z = 3; }\n"
    for name, body in (("1", base % ""), ("2", base % extra), ("10.v", base % extra)):
        (root / name / "src").mkdir(parents=True)
        (root / name / "src" / "A.java").write_text(body)
        (root / name / "notes.txt").write_text("no")
    (root / "2" / "src" / "Only.java").write_text("class Only {}")
    (root / "Loose.java").write_text("class Loose {}")
    return str(root)


def test_discovery(spark, product_line):
    files = {(r.family, r.variant): r for r in S.discover(spark, product_line, "java").collect()}
    assert set(files) == {("src_A.java", "1"), ("src_A.java", "2"), ("src_A.java", "10"), ("src_Only.java", "2")}
    assert [files["src_A.java", v].variant_idx for v in ("1", "2", "10")] == [0, 1, 2]
    assert files["src_A.java", "2"].content_id == files["src_A.java", "10"].content_id
    with pytest.raises(ValueError):
        S.discover(spark, product_line, "cobol")


def test_from_sources_to_traces(spark, product_line, tmp_path):
    t = Z.align_sources(spark, product_line, "java")
    rows = M.machine_texts(t["cells"], t["variants"])
    M.write_named(rows, f"file://{tmp_path}/matrix", ".output")
    assert (tmp_path / "matrix/src_A.java.output").read_text().startswith("src_A.java\n1\n")
    (tmp_path / "matrix/notes.txt").write_text("not a matrix\n1\n2\n3\n")
    back = {(r.family, r.system): r.bits for r in M.read_matrix(spark, f"file://{tmp_path}/matrix").filter("family = 'src_A.java'").collect()}
    assert len({len(b) for b in back.values()}) == 1
    assert back["src_A.java", 2] == back["src_A.java", 10] == "1" * len(back["src_A.java", 1])
    human = {r.family: r.content for r in M.human_texts(t["cells"], t["variants"]).collect()}
    assert human["src_A.java"].startswith("Alignment for: src_A.java:\n") and human["src_A.java"].endswith("\n\n")
    features = spark.createDataFrame([("1 2 10", "Base"), ("2 10", "Extra ∧ ¬Core"), ("2", "Two")], FX.SCHEMA)
    out = Z.analyze(t["nodes"], t["cells"], features)
    got = {}
    for r in out.collect():
        got.setdefault(r.feature, set()).add(r.line)
    assert got["Extra_and_not_Core"] == {"p.A b()"}
    assert got["Base"] == {"p.A"} and got["Two"] == {"Only"}
    texts = {r.feature: r.content for r in Z.trace_texts(out).collect()}
    assert texts["Base"] == "p.A\n"
    page = Z.view(t["nodes"], t["cells"], features, "src_A.java")
    assert page.count("<pre>") == 3 and 'class="Extra_and_not_Core"' in page and "___" not in page


def test_atomic_file(spark, tmp_path):
    (tmp_path / "tags.txt").write_text("# tags\r\nfield_access\r\n\r\nmodifiers\n")
    assert S.atomic_tags(spark, f"file://{tmp_path}/tags.txt") == ["field_access", "modifiers"]


def test_matrix_records(spark, tmp_path):
    (tmp_path / "f.output").write_text("fam\n1\n/a\n0110\n1\n/b\n1111\n2\n/c\n10\nx\n/d\n1\n3\n/e\n1\n")
    rows = {r.system: (r.source, r.bits) for r in M.read_matrix(spark, f"file://{tmp_path}/f.output").collect()}
    assert rows == {1: ("/a", "0110"), 2: ("/c", "10")}


def test_external_features(spark, tmp_path):
    program = tmp_path / "say"
    program.write_text('#!/bin/sh\necho "$1 $3"\n')
    program.chmod(0o755)
    keys = spark.createDataFrame([("1 2",), ("1 2",), ("3",)], "systems_key string")
    assert {tuple(r) for r in FX.from_program(keys, str(program), "spec").collect()} == {("1 2", "expr 1 2"), ("3", "expr 3")}


def test_set_expressions(spark, tmp_path):
    assert E.parse("a & ~b: { S1 & S2 } \\ { S3 | S4 }") == E.SetExpression("a & ~b", ("S1", "S2"), ("S3", "S4"))
    assert E.parse("True: { S1 } \\ {  }").rhs == () and E.parse("x: { S1 & S2 }").rhs == ()
    assert E.parse("x: { S1 & S2").lhs == ("S1",)
    (tmp_path / "e.txt").write_text("a: { S1 & S2 } \\ { S3 | S4 }\nTrue: { S1 } \\ {  }\n")
    assert [tuple(r) for r in E.read(spark, f"file://{tmp_path}/e.txt").orderBy("label").collect()] == [("True", ["S1"], []), ("a", ["S1", "S2"], ["S3", "S4"])]
    columns = spark.createDataFrame([(1, ["S1", "S2"]), (2, ["S1", "S2", "S3"])], "col int, systems array<string>")
    got = E.evaluate(columns, [E.parse("a: {S1 & S2} \\ {S3 | S9}"), E.parse("b: {S9} \\ {}"), E.parse("c: {S1} \\ {S9}")], ["col"])
    assert sorted(map(tuple, got.collect())) == [("a", 1), ("c", 1), ("c", 2)]


def test_truth_table():
    table = E.truth_table(["a", "b"], ["1", "2", "3", "4"])
    for label in ("a & b", "~a", "a & ~b", "True"):
        e = E.of_label(label, ["a", "b"], table)
        assert set(e.lhs) | set(e.rhs) == set(table) and not set(e.lhs) & set(e.rhs)
    assert FX.minterms(table, ["a", "b"], ["3", "4"]) == "a" and FX.minterms(table, ["a", "b"], ["1", "4"]) == "¬a ∧ ¬b ∨ a ∧ b"


def test_stream_of_masks(spark, tmp_path):
    from plyweave.streaming.presence import masks

    events = spark.createDataFrame([(1, 0), (1, 2), (2, 1), (1, 0)], "col int, system int")
    events.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/in")
    q = masks(stream, "col", "system").writeStream.outputMode("complete").format("memory").queryName("masks").option("checkpointLocation", f"file://{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("masks").collect())) == [(1, 5), (2, 2)] == sorted(map(tuple, masks(events, "col", "system").collect()))


def test_atomic_tags_are_the_fixed_ones():
    assert S.ATOMIC["cpp"] == ("identifier", "call_expression", "number_literal", "char_literal", "preproc_defined", "unary_expression", "binary_expression", "parenthesized_expression")
    assert S.ATOMIC["java"] == (
        "throw_statement", "import_declaration", "instanceof_expression", "method_invocation", "field_access", "array_access", "class_literal", "modifiers", "formal_parameter",
        "catch_formal_parameter", "package_declaration",
    )


def test_keys_of_twelve_systems(spark):
    rows = [("f", 0, str(k)) for k in range(1, 13)] + [("f", 1, "10"), ("f", 1, "9"), ("f", 1, "x"), ("f", 1, "B")]
    got = {r.col: r.systems_key for r in P.present_systems(spark.createDataFrame(rows, "family string, col int, variant string"), ["family", "col"], "variant").collect()}
    assert got == {0: "1 2 3 4 5 6 7 8 9 10 11 12", 1: "9 10 B x"}


def test_a_page_that_breaks_the_parser_is_an_error_row(spark):
    pages = spark.createDataFrame([(1, "<![foo[ x ]]>"), (2, "<p>fine</p>")], "content_id long, content string")
    nodes, errors = X.parse_contents(pages, "html")
    assert {r.content_id for r in nodes.collect()} == {2} and [r.content_id for r in errors.collect()] == [1]


def test_a_program_that_fails_ends_the_job(spark):
    keys = spark.createDataFrame([("1 2",)], "systems_key string")
    with pytest.raises(Exception, match="false"):
        FX.from_program(keys, "false", "spec").collect()


def test_bit_rows(spark):
    rows = [("a", 0), ("a", 3), ("a", 4), ("a", 9), ("b", 7), ("c", 2)]
    got = {r.system: r.bits for r in P.bit_rows(spark.createDataFrame(rows, "system string, col long"), ["system"], 8).collect()}
    assert got == {"a": "10011000", "b": "00000001", "c": "00100000"}


def test_command_line_from_sources_and_from_a_matrix(spark, product_line, tmp_path):
    from plyweave import cli

    out = tmp_path / "out"
    cli.main(["align", "java", product_line, "--output", f"file://{out}"])
    assert sorted(p.name for p in out.glob("*.output")) == ["src_A.java.output", "src_Only.java.output"] and (out / "src_A.java.txt").read_text().startswith("Alignment for: src_A.java:\n")
    program = tmp_path / "told"
    program.write_text("#!/bin/sh\ncase \"$3\" in '1 2 10 ') echo Base;; '2 10 ') echo 'Extra ∧ ¬Core';; '2 ') echo Two;; esac\n")
    program.chmod(0o755)
    features = ["--program", str(program), "--spec", "s"]
    cli.main(["analyze", "java", product_line, "--output", f"file://{tmp_path}/one", *features])
    cli.main(["analyze", "java", f"file://{out}", "--matrix", "--output", f"file://{tmp_path}/two", *features])
    read = lambda d: {p.name: p.read_text() for p in (tmp_path / d / "traces").glob("*.txt")}
    assert read("one") == read("two") and read("two")["Two.txt"] == "Only\n" and read("two")["Extra_and_not_Core.txt"] == "p.A b()\n"
    cli.main(["render", "java", f"file://{out}/src_A.java.output", "--matrix", "--output", f"file://{tmp_path}/page", *features])
    assert (tmp_path / "page/page.html").read_text().count("<pre>") == 3
    cli.main(["systems", "java", product_line])


def test_families_are_dealt_by_size(spark):
    from plyweave.operators import align as A

    rows = [(f"f{k}", v, ["t"] * k) for k in range(1, 30) for v in (0, 1)] + [(None, 0, ["a"])]
    frame = spark.createDataFrame(rows, "family string, variant_idx int, tokens array<string>")
    grouped = A.largest_first(frame).applyInPandas(lambda r: r[["family"]].head(1).assign(n=len(r)), "family string, n long")
    assert {r.family: r.n for r in grouped.collect()} == {f"f{k}": 2 for k in range(1, 30)} | {None: 1}
    plan = grouped._jdf.queryExecution().executedPlan().toString()
    first = next(x for x in plan.splitlines() if "Exchange" in x)
    assert "rangepartitioning" in first, plan  # not exchanged again after it
