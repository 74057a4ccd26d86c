"""Functions with their documentation."""

import pytest

from corvane.llm import docpairs as dp


def found(text, lang):
    out = {}
    for name, _, _, _, defined, doc, _, _ in dp.symbols_of(text, lang):
        if defined and doc is not None and not dp.is_trivial(dp.clean_documentation(doc), name):
            out[name] = dp.clean_documentation(doc)
    return out


CASES = [
    ("python", 'def f(a,\n      b):\n    # x\n    r"""Read the first open row."""\n    return 1\n', {"f"}),
    ("python", 'def f():\n    x = """Read the first open row."""\n', set()),
    ("python", '@deco\nasync def f() -> int:\n    "Read the first open row."\n', {"f"}),
    ("python", "# Read the first open row.\n@deco\ndef f():\n    pass\n", {"f"}),
    ("python", "# Read the first open row.\n\ndef f():\n    pass\n", set()),
    ("python", "def f():  # Read the first open row.\n    # Read the first open row again.\n    pass\n", set()),
    ("python", 'x = """\ndef g():\n    \\"\\"\\"Read the first open row.\\"\\"\\"\n"""\ndef f():\n    """Args:\n        a: the value to be read\n    """\n', set()),
    ("js", "/**\n * Read the first open row.\n * @param a the value\n */\n@Deco()\nexport async function f(a) {\n}\n", {"f"}),
    ("js", "// Read the first open row.\nconst f = async (a, b) => {\n};\n", {"f"}),
    ("js", "class A {\n  // Read the first open row.\n  f(a) {\n    if (a) {\n    }\n  }\n}\n", {"f"}),
    ("js", "/* Read the first open row.\nfunction old() {}\n*/\n\nfunction f() {}\n", set()),
    ("js", "// f(a, 88);\nfunction f() {}\n// eslint-disable-next-line no-shadow -- for this line\nfunction g() {}\n", set()),
    ("js", "// Read the first open row.\nfunction f(a)\n{\n}\n// Read the first open row.\nfunction g(a): void\n\nlet x = 1\n", {"f"}),
    ("go", "// F read the first open row.\n//nolint:gocyclo\nfunc (s *T) F(a int) error {\n}\n", {"F"}),
    ("rust", "/// Read the first open row.\n#[must_use]\npub(crate) fn f(a: &str) -> usize {\n}\n", {"f"}),
    ("java", "/// <summary>Read the first open row.</summary>\n[Obsolete]\npublic int F(int a)\n{\n}\n", {"F"}),
    ("java", "class A {\n    /**\n     * Read the first open row.\n     */\n\n    public int f() {\n    }\n}\n", set()),
    ("kotlin", "/** Read the first open row. */\nprivate suspend fun f(a: Int): Int {\n}\n", {"f"}),
    ("ruby", "# Read the first open row.\ndef self.f(a)\nend\n", {"f"}),
    ("lua", "--- Read the first open row.\nfunction M.f(a)\nend\n", {"f"}),
    ("shell", "# Read the first open row.\nf() {\n}\n# Read the first open row.\nfunction g {\n}\n", {"f", "g"}),
    ("c", "// Read the first open row.\nstatic int *f(int a) {\n}\n", {"f"}),
    ("c", "// Read the first open row.\nint f(int a);\n", set()),
]


@pytest.mark.parametrize("lang,text,names", CASES)
def test_documentation_is_what_stands_with_the_function(lang, text, names):
    assert set(found(text, lang)) == names


@pytest.mark.parametrize("doc,name", [
    ("", "f"), ("Helper.", "f"), ("Parses the token assets.", "parse_token_asset"), ("Widening a cargo", "widenCargo"), ("TODO: write the docs before release", "f"),
    ("todo - add docs for this one please", "f"), ("Description of what f does goes here.", "f"), ("Auto-generated method stub", "f"), ("-----------", "f"),
    ("@param a the first value to read", "f"), (":param a: the first value to read", "f"), ("Args:\n    a: the first value to read", "f"), ("保存します", "f"),
    ("[short description of f here]", "f"), ("<Insert description of the function here>", "f"), ("Add a summary here.", "f"), ("The the the scan", "scan"),
])
def test_trivial(doc, name):
    assert dp.is_trivial(dp.clean_documentation(doc), name)


@pytest.mark.parametrize("doc,name", [
    ("Read the first open row.", "f"), ("申請を重みしてから、古い列を返します。", "f"), ("Parses the token into assets quickly.", "parse_token"), ("f\nReturns all rows that are open.\n@return x", "f"),
])
def test_not_trivial(doc, name):
    assert not dp.is_trivial(dp.clean_documentation(doc), name)


CHUNKS = "chunk_id string, source_file string, content string, section string, name string, doc string"
RAW = "raw_id long, source_file string, content string, lang string"


def test_declarations_document_definitions_elsewhere(spark):
    rows = [
        ("a", "p/a.h", "// Read the first open row.\nint f(int a);\n// Count the rows of one page.\nint f(char *a);\n"),
        ("b", "p/a.c", "int f(int x) {\n    return 1;\n}\n"),
        ("c", "q/a.c", "int f(int x) {\n    return 1;\n}\n"),
        ("b", "p/a.c", "int f(int x) {\n    return 1;\n}\n"),
        ("n", None, "x"), ("m", "p/x.py", None), ("e", "p/y.py", ""), ("t", "p/z.txt", "def f(): pass"), (None, "p/a.c", "int f(int x) {\n}\n"),
    ]
    chunks = spark.createDataFrame([(*r, None, "clash", "clash") for r in rows], CHUNKS)
    raw = spark.createDataFrame([(7, ".\\p\\r.py", 'def g():\r\n    """Read the first open row."""\r\n', "x"), (8, None, None, None)], RAW)
    got = {(r.origin, r.rec_id, r.name, r.doc_from, r.clean) for r in dp.documented_functions(chunks, raw).collect()}
    assert got == {("chunks", "b", "f", "declaration", "Read the first open row."), ("raw_chunks", "7", "g", "own", "Read the first open row.")}
    assert dp.documented_functions(chunks.limit(0), raw.limit(0)).count() == 0


def described(spark, *files):
    """What each definition of the files (path, content) gets, by qualified name."""
    chunks = spark.createDataFrame([(str(i), p, c, "proj", None, None) for i, (p, c) in enumerate(files)], "chunk_id string, source_file string, content string, scope string, name string, doc string")
    raw = spark.createDataFrame([], RAW)
    full = dp.documented_functions(chunks, raw).collect()
    bare = dp.documented_functions(chunks, raw, with_texts=False).collect()
    assert sorted((r.rec_id, r.name, r.doc_from) for r in full) == sorted((r.rec_id, r.name, r.doc_from) for r in bare)
    return sorted((f"{r.container}.{r.name}", r.doc_from, r.clean) for r in full)


DOC = "Read the first open row."


@pytest.mark.parametrize("files,want", [
    # members declared in a class of a namespace, defined elsewhere, in another first folder
    ([("include/a.hpp", f"namespace n {{\nclass Foo : public Base {{\n public:\n  // {DOC}\n  int add(const int a, char *b);\n  int add(int a);\n}};\n}}\n"),
      ("src/a.cpp", "namespace n {\nint Foo::add(int x, char *y) {\n  return g(x);\n}\nint Foo::add(int x) {\n  return x;\n}\n}\n")], [("n.Foo.add", "declaration", DOC)]),
    ([("include/a.hpp", f"class Foo {{\n  // {DOC}\n  int add(int a);\n}};\n"), ("src/b.cpp", "int Bar::add(int x) {\n  return x;\n}\n")], []),
    ([("a.h", f"// {DOC}\nint f(int, char *);\n"), ("b.c", "int f(int x, char *y)\n{\n  return 1;\n}\n")], [(".f", "declaration", DOC)]),
    # interfaces
    ([("i.ts", f"export interface Store {{\n  // {DOC}\n  load(a: string): Row;\n}}\n"), ("s.ts", "export class Disk implements Store {\n  load(a: string): Row {\n    return get(a);\n  }\n}\n")], [("Disk.load", "declaration", DOC)]),
    ([("I.java", f"interface Store {{\n    /** {DOC} */\n    Row load(String a);\n}}\n"), ("D.java", "class Disk extends Base implements Store {\n    public Row load(final String key) {\n        return get(key);\n    }\n}\n")], [("Disk.load", "declaration", DOC)]),
    ([("t.rs", f"pub trait Store {{\n    /// {DOC}\n    fn load(&self, a: &str) -> Row;\n}}\n"), ("d.rs", "impl Store for Disk {\n    fn load(&self, key: &str) -> Row {\n        get(key)\n    }\n}\n")], [("Disk.load", "declaration", DOC)]),
    ([("k.kt", f"interface Store {{\n    /** {DOC} */\n    fun load(a: String): Row\n}}\n"), ("d.kt", "class Disk(val x: Int) : Base(x), Store {\n    override fun load(key: String): Row {\n        return get(key)\n    }\n}\n")], [("Disk.load", "declaration", DOC)]),
    # stubs and overloads
    ([("m.pyi", f'class A:\n    def f(self, a: int) -> int:\n        """{DOC}"""\n'), ("m.py", "class A:\n    def f(self, a: int) -> int:\n        return a\n\n    def g(self, a: int):\n        return a\n")], [("A.f", "declaration", DOC)]),
    # own documentation goes first; a trivial one doesn't hide the declaration's
    ([("a.h", f"// {DOC}\nint f(int a);\n"), ("a.c", "// Count the rows of one page.\nint f(int x) {\n}\n")], [(".f", "own", "Count the rows of one page.")]),
    ([("a.h", f"// {DOC}\nint f(int a);\n"), ("a.c", "// TODO\nint f(int x) {\n}\n")], [(".f", "declaration", DOC)]),
    # calls within functions are no declarations
    ([("a.c", f"int g(void) {{\n  // {DOC}\n  row f(int_a, b);\n  return 1;\n}}\n"), ("b.c", "int f(int x, int y) {\n}\n")], []),
])
def test_descriptions_go_by_qualified_name_and_signature(spark, files, want):
    assert described(spark, *files) == want


def test_signatures_by_language():
    sig = dp.normal_signature
    assert sig("a, b int", "go") == sig("x int, y int", "go") == sig("int, int", "go") == "2:int,int" and sig("m map[string]int, xs ...T", "go") == "2:map[string]int,...T"
    assert sig("final int a, @Nullable String b", "java") == sig("int x, String y", "java") == "2:int,String" and sig("Map<String, Integer> m", "java") == "1:Map<String, Integer>"
    assert sig("const char *s, unsigned int n", "c") == sig("char *, unsigned int", "c") and sig("void", "c") == sig("", "c") == "0"
    assert sig("&self, a: &str", "rust") == "1:&str" and sig("a, b = {}", "js") == "2" and sig("a: string, b?: number", "js") == "2:string,number"


def test_signatures():
    assert dp.normal_signature("a: int, b: str = 'x'") == dp.normal_signature("x:int,y : str") == "2:int,str"
    assert dp.normal_signature("int a, char *b") == dp.normal_signature("int x, char *", "c") == "2:int,char *" and dp.normal_signature("self, a, b=1") == "2" and dp.normal_signature("") == "0"


def test_code_ends_with_the_function():
    text = "def f():\n    return 1\n\n\ndef g():\n    return 2\n"
    assert [x[6] for x in dp.symbols_of(text, "python")] == ["def f():\n    return 1", "def g():\n    return 2"]
    text = "function f() {\n  if (x) {\n  }\n}\n\nfunction g() {\n}\n"
    assert [x[6] for x in dp.symbols_of(text, "js")][0] == "function f() {\n  if (x) {\n  }\n}"
