import json
import os
import struct
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sonde.operators import chunking as C
from sonde.plans.index import CodeIndex
from sonde.plans.session import SearchError, SearchSession
from sonde.sources import store as S
from sonde.sources import walk as W
from sonde.sources.model_files import StaticModel
from sonde.sources.syntax import Indented, Node, PythonAst, provider_for
from sonde.streaming import incremental


def tree(root, files):
    for name, text in files.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(text if isinstance(text, bytes) else text.encode())


def safetensors(tensors):
    header, body = {}, b""
    for name, (kind, a) in tensors.items():
        header[name] = {"dtype": kind, "shape": list(a.shape), "data_offsets": [len(body), len(body) + a.nbytes]}
        body += a.tobytes()
    h = json.dumps(header).encode()
    return struct.pack("<Q", len(h)) + h + body


def test_walk(tmp_path):
    tree(tmp_path, {"lib/b.py": "", "lib/a.dart": "", "README.md": "", ".git/x.py": "", "node_modules/a.js": "", "build/y.py": "", "gen/x.g.dart": "", "ignored_dir/z.py": "", "private/p.dart": "", "pkg/__init__.py": "", ".gitignore": "# c\n\n!keep\n*.g.dart\nignored_dir/\n", ".sondeignore": "private/*.dart"})
    assert [x[1] for x in W.list_files(str(tmp_path))] == ["lib/a.dart", "lib/b.py", "pkg/__init__.py"]
    with pytest.raises(ValueError):
        W.list_files(str(tmp_path / "none"))
    assert W.grammar("x.TSX") == "tsx" and W.grammar("dart") is None


def test_model_files():
    m = np.array([[3, 4], [0, 0], [1, 0]], np.float32)
    got = StaticModel.parse(safetensors({"other": ("F32", m * 2), "embeddings": ("F32", m), "mapping": ("I64", np.array([2, 1, 0])), "weights": ("F64", np.ones(2))}))
    assert (got.embeddings == m).all() and list(got.mapping) == [2, 1, 0] and got.sif is None
    assert np.allclose(got.encode([2]), [0.6, 0.8]) and np.allclose(got.encode([9]), [0, 0]) and (got.row(7) == 0).all()
    assert (StaticModel.parse(safetensors({"w": ("F32", m)})).embeddings == m).all()
    for bad in (b"", b"\xff" * 8, safetensors({"a": ("I64", np.arange(3))}), struct.pack("<Q", 2) + b"{x"):
        with pytest.raises(ValueError):
            StaticModel.parse(bad)


def flat(sizes, gap=0, kind="stmt"):
    kids, at = [], 0
    for n in sizes:
        kids.append(Node(kind, at, at + n))
        at += n + gap
    return Node("root", 0, at, kids)


def test_packing_of_nodes():
    assert [(s.start, s.end) for s in C.merge(C.pack(flat([300, 300, 300, 800, 10])))] == [(0, 600), (600, 900), (900, 1700), (1700, 1710)]
    assert C.pack(flat([10, 10])) == [C.Span(0, 20, "root")]
    nested = Node("root", 0, 1000, [Node("big", 0, 900, [Node("a", 0, 450), Node("b", 450, 900)]), Node("c", 900, 1000)])
    assert [s.kind for s in C.pack(nested)] == ["a", "b", "c"]
    assert [s.kind for s in C.merge(C.pack(nested))] == ["a", "b+c"]
    assert C.merge([C.Span(0, 5, "x"), C.Span(5, 9, "x")]) == [C.Span(0, 9, "x")]


def test_cap_keeps_characters_and_lines():
    src = ("é" * 149 + "\n") * 40
    raw = src.encode()
    parts = C.cap(C.Span(0, len(raw), "x"), raw)
    assert all(p.size <= C.CAP for p in parts) and b"".join(raw[p.start : p.end] for p in parts) == raw
    assert all(raw[p.end - 1 : p.end] == b"\n" for p in parts)
    one = ("é" * 5000).encode()
    assert "".join(one[p.start : p.end].decode() for p in C.cap(C.Span(0, len(one), "x"), one)) == "é" * 5000


def test_chunk_source():
    assert C.chunk_source(" \n", Indented().parse(" \n")) == []
    src = "def foo():\n    return 1\n"
    got = C.chunk_source(src, PythonAst().parse(src))
    assert len(got) == 1 and got[0][:2] == (1, 2) and got[0][4] == src
    body = "def f():\n" + "".join(f"    x{i} = 'ü' * {i}\n" for i in range(200))
    got = C.chunk_source(body, PythonAst().parse(body))
    assert got[0][0] == 1 and got[-1][1] == 201 and all(b[2] >= a[3] for a, b in zip(got, got[1:]))
    cls = "class A:\n" + "".join(f"    def m{i}(self): return {i}\n\n" for i in range(300))
    assert any(c[6] for c in C.chunk_source(cls, PythonAst().parse(cls)))
    assert PythonAst().parse("def broken(:\n  x").kind == "source"
    assert Indented().parse("a\n  b\n  c\n\nd\n").flat()[0][5:] == (0, 13)


def test_merge_expression_equals_the_function(spark):
    import random

    rng = random.Random(3)
    for _ in range(5):
        spans, at = [], 0
        for _ in range(30):
            n = rng.randrange(1, 500)
            spans.append(C.Span(at, at + n, rng.choice("ab")))
            at += n
        df = spark.createDataFrame([([(s.start, s.end, s.kind) for s in spans],)], "x array<struct<start_byte:int,end_byte:int,node_type:string>>")
        got = df.select(C.merge_adjacent(F.col("x")).alias("m")).first().m
        assert [(r.start_byte, r.end_byte, r.node_type) for r in got] == [(s.start, s.end, s.kind) for s in C.merge(spans)]


PROJECT = {"auth.py": "def authenticate(token):\n    return refresh_token(token)\n", "theme.py": "def color():\n    return 'red theme'\n", "bad.py": b"\xff\xfe\x00", "tests/test_auth.py": "def test_authenticate():\n    assert authenticate('token')\n"}


def test_store_and_index(spark, tmp_path):
    root, folder = str(tmp_path / "src"), str(tmp_path / "store")
    tree(root, PROJECT)
    store = S.ChunkStore(spark, folder)
    files = W.listing(spark, root)
    assert store.split(files)[0].count() == 0 and store.split(files)[1].count() == 4
    chunks = S.chunk_tree(spark, root, store=store).orderBy("chunk_idx").collect()
    assert [(c.chunk_idx, c.file_path) for c in chunks] == [(0, "auth.py"), (1, "tests/test_auth.py"), (2, "theme.py")]
    assert chunks == S.chunk_tree(spark, root).select(*chunks[0].__fields__).orderBy("chunk_idx").collect()
    hits, misses = store.split(W.listing(spark, root))
    assert hits.count() == 3 and misses.count() == 1
    time.sleep(0.05)
    tree(root, {"theme.py": "def color():\n    return 'blue'\n"})
    os.utime(os.path.join(root, "theme.py"), (1, 2_000_000_000))
    assert {r.file_path for r in store.split(W.listing(spark, root))[1].collect()} == {"theme.py", "bad.py"}
    tree(folder, {"generation=broken/part-0.parquet": b"no parquet"})
    assert store.read().count() >= 3
    store.remove([os.path.join(root, "auth.py")])
    assert "auth.py" in {r.file_path for r in store.split(W.listing(spark, root))[1].collect()}
    assert S.from_json(S.to_json(CodeIndex.from_path(spark, root).chunks)).count() == 3


def test_store_keeps_every_key_of_a_path(spark, tmp_path):
    store = S.ChunkStore(spark, str(tmp_path / "store"))
    rows = lambda *times: spark.createDataFrame([("a.py", t, 5, []) for t in times], f"path string, mtime_ms long, size long, chunks {S.CHUNKS}")
    found = lambda *times: sorted(r.mtime_ms for r in store.split(rows(*times).drop("chunks"))[0].collect())
    store.add(rows(1, 2))
    store.add(rows(2, 3))
    assert found(1, 2, 3, 4) == [1, 2, 3]
    store.remove(["a.py"])
    assert found(1, 2, 3, 4) == []
    store.add(rows(2))
    assert found(1, 2, 3, 4) == [2]


def test_chunks_leave_by_the_megabyte(spark):
    sources = {f"f{i}": f"line {i}\n" * (n * 1000) for i, n in enumerate((60, 0, 400, 1, 390))} | {"g": None}
    batch = pa.RecordBatch.from_arrays([pa.array(list(sources)), pa.array([None] * 6, pa.string()), pa.array(list(sources.values()))], ["file_path", "language", "source"])
    out = list(C.chunk_batches(iter([batch])))
    assert len(out) > 5 and max(b.nbytes for b in out) < 3 << 20
    whole = {}
    for r in (r for b in out for r in b.to_pylist()):
        whole[r["file_path"]] = whole.get(r["file_path"], "") + r["content"]
    assert {k: v.strip() for k, v in whole.items()} == {k: v.strip() for k, v in sources.items() if v}
    C.chunk_files(spark.createDataFrame([("a", None, "x")], "file_path string, language string, source string"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2000


def test_quarantine(spark, tmp_path):
    tree(tmp_path, PROJECT)
    rows = {r.file_path: r for r in W.read_sources(W.listing(spark, str(tmp_path))).collect()}
    assert rows["bad.py"].source is None and "UnicodeDecodeError" in rows["bad.py"].error and rows["auth.py"].error is None


def test_session(spark, tmp_path):
    root = str(tmp_path / "src")
    tree(root, PROJECT)
    m = tmp_path / "m.safetensors"
    vocab = {"[UNK]": 0, "token": 1, "def": 2, "red": 3}
    m.write_bytes(safetensors({"embeddings": ("F32", np.eye(4, dtype=np.float32))}))
    (tmp_path / "t.json").write_text(json.dumps({"model": {"type": "WordPiece", "unk_token": "[UNK]", "vocab": vocab}}))
    with pytest.raises(ValueError):
        SearchSession(spark, model_path=str(m))
    s = SearchSession(spark, str(m), str(tmp_path / "t.json"), str(tmp_path / "store"))
    assert s.prewarm(root) and s.search("refresh token", root).first().file_path == "auth.py"
    assert s.search("red", root).first().file_path == "theme.py"
    assert s.find_related(os.path.join(root, "auth.py"), 1, root).count() >= 1
    tree(root, {"new.py": "def brandnew():\n    pass\n"})
    s.refresh(root)
    assert s.search("brandnew", root).first().file_path == "new.py"
    with pytest.raises(SearchError):
        s.search("x", str(tmp_path / "none"))
    assert s.prewarm(str(tmp_path / "none"), quiet=True) is False
    s.shutdown()


def test_stream(spark, tmp_path):
    schema = "chunk_idx long, file_path string, start_line int, end_line int, content string"
    for k in range(2):
        spark.createDataFrame([(2 * k + j, f"f{k}{j}.py", 1, 2, f"alpha w{k} {'beta' * j}") for j in range(2)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        incremental.start(stream, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    chunks, index = incremental.load(spark, str(tmp_path / "out"))
    assert chunks.count() == 4 and index.corpus.first().n_docs == 4
    assert {r.term: r.df for r in index.terms.collect()}["alpha"] == 4


DECLARED = {
    "go": ("package a\n\nimport (\n\t\"fmt\"\n)\n\n// Add {\nfunc Add(a, b int) int {\n\tif a > 0 {\n\t\treturn '}'\n\t}\n\treturn b\n}\n\ntype P struct {\n\tX int\n}\n\nfunc (p *P) Move() { p.X++ }\n", ["import", "import", "comment", "function", "class", "function"]),
    "dart": ("import 'a.dart';\n\nclass A extends B {\n  A(this.x);\n  int twice() => x * 2;\n  void run() { print('} ${s}'); }\n}\n\nvoid main() {\n  run(\"}\");\n}\n", ["import", "class", "function"]),
    "typescript": ("import { a } from './a'\nexport interface P { x: number }\nexport const f = (x) => {\n  return x\n}\nclass A {\n  m(): void { this.x = `}` }\n}\nfunction g() {\n  return 1\n}\n", ["import", "class", "function", "class", "function"]),
    "rust": ("use std::io;\n\n#[derive(Debug)]\nstruct P<'a> { x: &'a str }\n\nimpl<'a> P<'a> {\n    fn get(&self) -> char { '}' }\n}\n\npub fn main() {\n    if x { a(); } else { b(); }\n}\n", ["import", "class", "class", "function"]),
    "cpp": ("#include <a.h>\nclass A {\n public:\n  int f() const { return 1; }\n};\nint g(int x) {\n  return x; /* } */\n}\n", ["import", "class", "function"]),
    "java": ("package a.b;\n/** {doc */\n@Foo(1)\npublic class A {\n  int x = 1;\n  int get() { return x; }\n}\n", ["import", "comment", "class"]),
    "php": ("<?php\nclass B {\n  public function c($x) { # }\n    return $x;\n  }\n}\nfunction d() { return '}'; }\n", ["expression", "class", "function"]),
    "ruby": ("require 'x'\n# class\nmodule M\n  def f(x)\n    return 1 if x\n    [1].each do |y|\n      puts y\n    end\n  end\nend\ndef g\n  1\nend\n", ["line", "comment", "module", "method"]),
}


@pytest.mark.parametrize("language", DECLARED)
def test_declarations_are_nodes(language):
    source, kinds = DECLARED[language]
    raw, root = source.encode(), provider_for(language).parse(source)
    assert [c.kind.split("_")[0] for c in root.children] == kinds
    for c in root.children:
        if c.kind.split("_")[0] in ("class", "function", "method", "module"):
            assert raw[c.end - 1 : c.end] in (b"}", b"d", b";") and raw[c.start : c.start + 1].strip()

    def inside(n):
        for a, b in zip(n.children, n.children[1:]):
            assert a.end <= b.start
        for c in n.children:
            assert n.start <= c.start <= c.end <= n.end
            inside(c)

    inside(root)
    many = "".join(source if language != "php" else source.replace("<?php", "") for _ in range(40))
    chunks = C.chunk_source(many, provider_for(language).parse(many))
    assert len(chunks) > 3 and all(e - s <= 2000 for _, _, s, e, *_ in chunks) and any(c[6] for c in chunks)
    assert all(many.encode()[s:e].decode() == t for _, _, s, e, t, *_ in chunks)


@pytest.mark.parametrize("language", [*DECLARED, "javascript", "tsx", None])
def test_broken_code_is_read(language):
    for source in ("", "}}}{{{(((", "class A {", "'\"`", "def f(\n" * 50, "{" * 3000 + "x", "\u00fc {\u00e4;} \u65e5"):
        root = provider_for(language).parse(source)
        assert root.end == len(source.encode())
        C.chunk_source(source, root)


def test_dump(tmp_path):
    from sonde.dump import dump

    (tmp_path / "a.go").write_text(DECLARED["go"][0])
    out = list(dump(str(tmp_path / "a.go")))
    assert "go, read by Braced" in out[0] and any("definition" in x for x in out)


def test_requests_that_fail_or_take_too_long(spark, tmp_path):
    root = tmp_path / "t"
    root.mkdir()
    (root / "a.py").write_text("def parse_config():\n    return 1\n")
    s = SearchSession(spark)
    with pytest.raises(SearchError, match="more than 0.01 s"):
        s.index(str(root), timeout=0.01)
    assert s.prewarm(str(root), wait=False) and s.search("parse config", str(root), timeout=120).count() == 1
    index = s.index(str(root))
    index.chunks = index.chunks.withColumn("content", F.expr("raise_error('broken')"))
    with pytest.raises(SearchError, match="broken"):
        s.search("parse config", str(root))
    s.shutdown()
