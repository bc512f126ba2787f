import gzip

import pytest
from pyspark.sql import functions as F

from spanloom.operators import checks, weights
from spanloom.sources import annotated, text


@pytest.fixture()
def put(tmp_path):
    def write(name, content):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(gzip.compress(content.encode()) if name.endswith(".gz") else content.encode())
        return str(p)

    return write


CONLLX = "1\tThe\t_\tDET\tDT\t_\t2\tdet\t_\t_\n2\tdog\t_\tNOUN\tNN\t_\t0\tROOT\t_\t_\n\n1\tRun\t_\tVERB\tVB\t_\t0\tROOT\t_\t_"


def test_conllx(spark, put):
    w = annotated.conllx(spark, put("tiny.conllx", CONLLX))
    assert [(r.sent, r.tok, r.form, r.pos, r.head_index) for r in w.orderBy("sent", "tok").collect()] == [(0, 0, "The", "DT", 1), (0, 1, "dog", "NN", None), (1, 0, "Run", "VB", None)]
    assert [(r.sent, r.parent, r.child, r.label) for r in annotated.dependency_edges(w).collect()] == [(0, 1, 0, "det")]
    assert sorted((r.sent, r.parent, r.child) for r in annotated.dependency_edges(w, wall=True).collect()) == [(0, 1, 0), (0, 2, 1), (1, 1, 0)]
    assert w.filter("_corrupt is not null").count() == 0
    bad = annotated.conllx(spark, put("bad.conllx", "1\tThe\n3\tx\t_\tD\tD\t_\t0\tR\t_\t_"))
    assert [r._corrupt for r in bad.orderBy("tok").collect()] == ["1\tThe", "id"]


def test_conllu(spark, put):
    w = annotated.conllu(spark, put("t.conllu.gz", "# c\n1\ta\ta\tX\tY\tA=b|C=d\t0\troot\t_\t_\r\n2\tb\tb\tX\tY\t_\t1\tdep\t_\t_\n\n\n# d\n1\tc\tc\tX\tY\t\t0\troot\t_\t_\n"))
    rows = w.orderBy("sent", "tok").collect()
    assert [r.form for r in rows] == ["a", "b", "c"] and rows[0].feats_map == {"A": "b", "C": "d"} and rows[1].feats_map is None and rows[0].misc == "_"


def test_brackets(spark):
    nodes = annotated.parse_brackets("(S (NP (DT The) (NN dog)) (VP (VBZ runs)) (. .))")
    assert [(n["id"], n["parent"], n["category"], n["word"], n["first_leaf"], n["last_leaf"]) for n in nodes] == [
        (0, None, "S", None, 0, 3), (1, 0, "NP", None, 0, 1), (2, 1, "DT", "The", 0, 0), (3, 1, "NN", "dog", 1, 1), (4, 0, "VP", None, 2, 2), (5, 4, "VBZ", "runs", 2, 2), (6, 0, ".", ".", 3, 3),
    ]
    df = spark.createDataFrame([(1, "(S (EDITED (UH uh)) (NP (-NONE- *)))"), (2, "(S (X"), (3, None), (4, ""), (5, "x)")], "id int, t string")
    got = annotated.brackets(df, "id", "t").collect()
    assert {r.id: r._corrupt for r in got if r._corrupt} == {2: "bracket left open", 5: "text outside brackets at 1"}
    assert [r.category for r in got if r.is_trace] == ["-NONE-"] and [r.category for r in got if r.skipped] == ["EDITED"]


def test_svmlight(spark, put):
    df = annotated.svmlight(spark, put("t.svm", "+1 1:0.5 3:2 # hello there\n-1 2:1\n2 1:1\n\n-1\n"))
    rows = df.collect()
    assert [(r.y, r.indices, r.vals, r.comment) for r in rows[:2]] == [(True, [1, 3], [0.5, 2.0], "hello there"), (False, [2], [1.0], None)]
    assert rows[2]._corrupt == "2 1:1" and rows[3].indices == []
    assert [r.value for r in annotated.svmlight_lines(df.filter("_corrupt is null")).collect()][:2] == ["+1 2:0.5 4:2.0\t# hello there", "-1 3:1.0"]


def test_triples(spark, put):
    lines = ['# c', "", "<http://a/ns/m.02x> <http://p> <http://b> .", '<s> <p> "lit"@en .', '<s> <p> "5"^^<http://x#integer> .', '<s> <p> "1999-01-01"^^<http://x#date> .', "<s> <p> other", '<s> <p> "x"@de . more']
    df = annotated.triples(spark, put("t.ttl", "\n".join(lines)))
    rows = df.collect()
    assert [(r.o.type, r.o.value, r.valid) for r in rows] == [("entity", "http://b", True), ("string", "lit", True), ("integer", "5", True), ("date", "1999-01-01", True), ("other", "other", False), ("other", '"x"@de', False)]
    assert abs(annotated.skipped_share(df).head().skipped - 2 / 6) < 1e-12
    assert df.select(annotated.machine_id(F.col("s.value"))).head()[0] == "/m/02x" and df.select(annotated.is_knowledge_node(F.col("s.value"))).head()[0]


def test_vectors_and_clusters(spark, put):
    v = annotated.word_vectors(spark, put("v.txt", "2 3\nthe 0.1 0.2 0.3\nof 1 2 3\n")).collect()
    assert [r.word for r in v] == ["the", "of"] and v[1].vec == [1.0, 2.0, 3.0]
    p = annotated.cluster_paths(spark, put("paths", '0101\tthe\t100\n0111\t"quo\t3\n01\trare\t2\n'))
    assert {r.word: r.bit_path for r in p.collect()} == {"the": "0101", '"quo': "0111"}
    c = annotated.cluster_of(spark.createDataFrame([("the",), ("zzz",), (None,)], "w string"), p, "w", (2,))
    assert sorted((str(r.w), r.cluster, r.cluster_2) for r in c.collect()) == [("None", "???", "??"), ("the", "0101", "01"), ("zzz", "???", "??")]


FRAME = """<frameset><predicate lemma="run"><roleset id="run.01" name="operate" vncls="26.3"><roles>
<role n="0" f="PAG" descr="operator"><vnrole vncls="26.3" vntheta="agent"/></role><role n="M" f="LOC" descr="where"/><role descr="unnamed"/></roles></roleset></predicate></frameset>"""


def test_frames(spark, put, tmp_path):
    put("frames/run.xml", FRAME)
    r = annotated.frames(spark, str(tmp_path / "frames")).head()
    assert (r.file, r.lemma, r.id, r.name) == ("run", "run", "run.01", "operate") and [x.role for x in r.roles] == ["0", "M"] and r.roles[0].vnroles[0]._vntheta == "agent"
    put("frames/twice.xml", FRAME)
    with pytest.raises(ValueError, match="twice"):
        annotated.frames(spark, str(tmp_path / "frames"))


def test_mentions_and_tools(spark):
    df = spark.createDataFrame([(0, "/m/0x 1-3 m.02 4-5"), (1, ""), (2, None)], "s int, value string")
    assert [(r.s, r.ord, r.mid, r.first, r.end) for r in annotated.mentions(df, "s").collect()] == [(0, 0, "0x", 1, 3), (0, 1, "m.02", 4, 5)]
    t = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "doc_id int, tool string")
    assert annotated.tool_rows(t, "a").count() == 2
    with pytest.raises(ValueError):
        annotated.tool_rows(t, "b")


def test_lines_pairs_counts(spark, put, tmp_path):
    p = put("kv.tsv", "a\t1\tx\nb\t2\na\t3\nnone\n")
    assert [(r.key, r["value"]) for r in text.pairs(spark, p).collect()] == [("a", "1\tx"), ("b", "2"), ("a", "3")]
    assert text.pairs(spark, p, key_first=False).head().key == "1\tx"
    with pytest.raises(ValueError, match="more than once"):
        text.pairs(spark, p, unique=True)
    assert {r.name: r.n for r in text.counted_names(spark, put("wc", "  12 a name\n3 b\n")).collect()} == {"a name": 12, "b": 3}
    assert [r["value"] for r in text.doubles(spark, put("d", "1.5\n x\n-2\n")).collect()] == [1.5, None, -2.0]
    assert text.lines(spark, put("x.gz", "one\ntwo\n")).count() == 2
    assert text.whole(spark, put("w", "a\nb"), one_line=True).head()["value"] == "a b" and text.contents(spark, put("b", "xyz")).head().length == 3
    put("deep/a/one.txt", "1"), put("deep/b/two.txt", "2"), put("deep/b/no.csv", "3")
    assert text.find(spark, str(tmp_path / "deep"), "*.txt").count() == 2
    with pytest.raises(Exception):
        text.lines(spark, str(tmp_path / "missing")).count()


def test_document_frequencies_add(spark, put, tmp_path):
    a, b = put("a.idf", "10\nthe\t9\nx\t1\n"), put("b.idf", "5\nthe\t4\n")
    got = text.document_frequencies(spark, [a, b])
    assert {r.term: (r.df, r.n_docs) for r in got.collect()} == {"the": (13, 15), "x": (1, 15)}
    text.write_document_frequencies(got.select("term", "df"), 15, str(tmp_path / "out"))
    assert {r.term: r.df for r in text.document_frequencies(spark, [str(tmp_path / "out")]).collect()} == {"the": 13, "x": 1}


def test_dictionary_file(spark, put, tmp_path):
    d = text.dictionary(spark, put("alphabet.tsv", "word\t0\tNULL\nword\t1\tthe\npos\t0\tDT\n"))
    assert sorted((r.space, r.id, r["value"]) for r in d.collect() if r["value"]) == [("pos", 0, "DT"), ("word", 1, "the")]
    text.write_pairs(d, str(tmp_path / "again"))
    assert text.dictionary(spark, str(tmp_path / "again")).count() == 3
    with pytest.raises(ValueError, match="dense"):
        text.dictionary(spark, put("bad.tsv", "w\t1\tx\n"))


def test_labels_and_index(spark, put):
    r = text.labelled_keys(spark, put("pairs.txt", "1 q:a/b r:c z:d\n"), "q", "r").head()
    assert (r.label, r.left, r.right) == ("1", ["a", "b"], ["c"])
    assert {(x.word, x.pos) for x in text.index_words(spark, put("index.noun", "  1 licence\ndog n 1\ncat n 2\n")).collect()} == {("dog", "noun"), ("cat", "noun")}


def test_cache_computes_what_is_missing(spark, tmp_path):
    asked = []

    def compute(missing):
        asked.append(sorted(r.k for r in missing.collect()))
        return missing.select("k", F.length("k").alias("n"))

    path = str(tmp_path / "cache")
    a = text.cached(spark.createDataFrame([("a",), ("bb",), ("a",)], "k string"), path, "k", compute)
    assert {r.k: r.n for r in a.collect()} == {"a": 1, "bb": 2}
    b = text.cached(spark.createDataFrame([("bb",), ("ccc",)], "k string"), path, "k", compute)
    assert {r.k: r.n for r in b.collect()} == {"bb": 2, "ccc": 3} and asked == [["a", "bb"], ["ccc"]]
    text.rehash(spark, path, str(tmp_path / "cache2"), "k", 3)
    assert spark.read.parquet(str(tmp_path / "cache2")).count() == 3


def test_checks(spark):
    df = spark.createDataFrame([(1, 0, 2, 3), (2, -1, 0, 3), (3, 2, 1, 3), (4, 0, 3, 3), (5, None, 1, 3)], "i int, a int, b int, n int")
    assert {r.i: r.problem for r in checks.token_bounds(df, ["i"], "a", "b", "n").collect()} == {2: "first below 0", 3: "last before first", 4: "last beyond the text"}
    assert checks.repeated_keys(df, ["n"]).head().n_rows == 5
    ids = spark.createDataFrame([(1,)], "i int")
    assert checks.out_of_dictionary(df, "i", ids).count() == 4


def test_terms_of_odd_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "  \n"), (4, " a  b a "), (5, "x" * 100_000)], "doc_id int, text string")
    tf = {(r.doc, r.term): r.tf for r in weights.term_frequencies(weights.whitespace_terms(df)).collect()}
    assert tf == {(4, "a"): 2, (4, "b"): 1, (5, "x" * 100_000): 1}
    assert weights.important_terms(weights.term_frequencies(weights.whitespace_terms(df.limit(0))), 3).count() == 0
