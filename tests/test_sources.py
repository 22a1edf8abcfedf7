"""Readers and sinks: JSON arrays by blocks, published folders, marked-up documents."""

import json
import os
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import markup, passages
from tessera.sources import json_array, published
from tessera.sources.json_array import json_elements, read_json_array, write_json_array

SCHEMA = "id long, text string, tags array<string>, more struct<a: long, b: string>"


def objects(n, seed):
    rng = random.Random(seed)
    odd = ['{"', "}]", "\\", '\\"', "[,]", "é日", "\n", "}" * 5, '"', ",", " ", "a" * 40]
    text = lambda: "".join(rng.choice(odd) for _ in range(rng.randrange(12)))
    return [{"id": i, "text": text(), "tags": [text() for _ in range(rng.randrange(3))], "more": {"a": rng.randrange(9), "b": text()} if rng.random() < 0.8 else None} for i in range(n)]


def read_in_blocks(spark, read, size):
    """With files cut into blocks of `size` bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        return read()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize(("blocks", "style"), [(1, {}), (2, {"ensure_ascii": False, "separators": (",", ":")}), (7, {"indent": 2}), (50, {"ensure_ascii": False})])
def test_json_array_in_blocks(spark, tmp_path, blocks, style):
    rows = objects(150, blocks)
    path = tmp_path / "one.json"
    path.write_text("\n " + json.dumps(rows, **style) + "\n\n", encoding="utf-8")
    size = os.path.getsize(path) // blocks + 1
    got = read_in_blocks(spark, lambda: read_json_array(spark, str(path), SCHEMA).collect(), size)
    assert sorted((r.asDict(recursive=True) for r in got), key=lambda r: r["id"]) == rows
    order = read_in_blocks(spark, lambda: json_elements(spark, str(path)).orderBy("file", "block", "number").collect(), size)
    assert [json.loads(r.element)["id"] for r in order] == list(range(150))


@pytest.mark.parametrize("slab", [1, 64, 1 << 20])
def test_blocks_are_scanned_in_slabs(monkeypatch, slab):
    monkeypatch.setattr(json_array, "SLAB", slab)
    text = json.dumps(objects(60, 9), ensure_ascii=False).encode()
    pieces = text.split(b"}")
    for each in (3, 10, len(pieces)):
        batch = lambda lo, hi, each=each: pa.RecordBatch.from_pydict({"value": pa.array(pieces[lo:hi], pa.binary()), "file": ["f"] * (hi - lo), "block": [i // each for i in range(lo, hi)]})
        batches = lambda batch=batch: iter([batch(lo, min(lo + 7, len(pieces))) for lo in range(0, len(pieces), 7)])
        maps = [r for b in json_array._maps(batches()) for r in b.to_pylist()]
        parts = [r for b in json_array._parts(json_array._starts(maps, "f"))(batches()) for r in b.to_pylist()]
        assert "".join(r["text"] + r["end"] for r in parts).encode() == text
        assert [r["number"] for r in parts if r["block"] == 0] == list(range(sum(r["block"] == 0 for r in parts)))
        assert sum(r["end"] == "," for r in parts) == 59


def test_json_array_of_other_values_and_wrong_files(spark, tmp_path):
    def read(text, size=1 << 20):
        path = tmp_path / f"{random.random()}.json"
        path.write_bytes(text.encode())
        return read_in_blocks(spark, lambda: [r.element for r in json_elements(spark, str(path)).orderBy("block", "number").collect()], size)

    assert read('[1, "a,]}", [2, [3]], null, {"a": [1, 2]}]') == ["1", '"a,]}"', "[2, [3]]", "null", '{"a": [1, 2]}']
    assert read("[]") == read(" [ \n ] ") == []
    long = json.dumps([{"a": "x" * 5_000}, {"a": "}" * 300}, 5])
    assert read(long, 97) == [json.dumps({"a": "x" * 5_000}), json.dumps({"a": "}" * 300}), "5"]
    for wrong in ('[{"a": 1}', '[{"a": 1}, {"b": 2}', '[{"a": "x}]', "[1", '[{"a": 1}]]', '[{"a": 1}] x', 'x [{"a": 1}]', '{"a": 1}', '[{"a": 1}][2]', "[1,,2]", "[1,]", "[,1]", "", " "):
        for size in (1 << 20, 3):
            if wrong:
                with pytest.raises(Exception, match="array"):
                    read(wrong, size)
    assert read("") == []
    path = tmp_path / "no.json"
    path.write_text('[{"id": 1}, {"id" 2}]')
    with pytest.raises(Exception, match="not JSON"):
        read_json_array(spark, str(path), SCHEMA).collect()


def test_json_arrays_are_written_by_partitions(spark, tmp_path):
    rows = objects(40, 3)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    write_json_array(df, str(tmp_path / "all"))
    files = [f for f in os.listdir(tmp_path / "all") if f.startswith("part-")]
    assert len(files) == 5 and sum(len(json.loads((tmp_path / "all" / f).read_text())) for f in files) == 40
    assert sorted((r.asDict(recursive=True) for r in read_json_array(spark, str(tmp_path / "all"), SCHEMA).collect()), key=lambda r: r["id"]) == rows
    write_json_array(df.where("false"), str(tmp_path / "none"))
    assert read_json_array(spark, str(tmp_path / "none"), SCHEMA).count() == 0


def files_of(path):
    return {os.path.relpath(os.path.join(at, f), path): os.stat(os.path.join(at, f)).st_mtime_ns for at, _, names in os.walk(path) for f in names if f.endswith(".parquet") or f.endswith(".csv") or f.endswith(".json") and "manifests" not in at}


def test_publishing_writes_only_what_changed(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = [(1, "train", "a"), (2, "train", None), (3, "test", "a"), (4, None, "a"), (4, None, "a"), (5, "te/st=1", "b")]
    df = spark.createDataFrame(rows, "id long, split string, class string")
    same = lambda a: sorted(map(tuple, published.read_published(spark, path).collect()), key=repr) == sorted(a, key=repr)
    assert published.publish(df, path, ["split", "class"]) == published.Report(5, 0, 0, 0) and same(rows)
    before = files_of(path)
    assert published.publish(df.repartition(3), path, ["split", "class"]) == published.Report(0, 5, 0, 0) and files_of(path) == before
    fewer = [(1, "train", "a"), (2, "train", None), (3, "test", "c"), (4, None, "a"), (5, "te/st=1", "b")]  # a row less, a class renamed
    assert published.publish(spark.createDataFrame(fewer, df.schema), path, ["split", "class"]) == published.Report(2, 3, 1, 2) and same(fewer)
    kept = files_of(path)
    assert {f: t for f, t in kept.items() if f in before} and len(set(kept) - set(before)) == 2 and len(os.listdir(f"{path}/manifests")) == 2  # the manifest, and its checksum
    assert published.publish(df.where("false"), path, ["split", "class"]).removed == 5 and same([]) and not files_of(path)


def test_a_crash_between_the_phases_leaves_the_old_state(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string")
    published.publish(df, path, ["x"])
    other = df.withColumn("id", F.col("id") + 10)
    with monkeypatch.context() as m:
        m.setattr(published._Folder, "rename", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            published.publish(other, path, ["x"])
    assert sorted(r.id for r in published.read_published(spark, path).collect()) == [1, 2]
    assert len(files_of(path)) == 4  # what was written is there, but no manifest names it
    report = published.publish(df, path, ["x"])
    assert (report.written, report.unchanged, report.deleted) == (0, 2, 1) and len(files_of(path)) == 2
    with monkeypatch.context() as m:  # another call commits between the reading of the manifest and the rename
        newest = published._newest
        m.setattr(published, "_newest", lambda folder: (0, newest(folder)[1]))
        with pytest.raises(FileExistsError):
            published.publish(other, path, ["x"])
    assert sorted(r.id for r in published.read_published(spark, path).collect()) == [1, 2]
    with pytest.raises(FileNotFoundError):
        published.read_published(spark, str(tmp_path / "nothing"))


@pytest.mark.parametrize("kind", ["csv", "json"])
def test_publishing_text_formats(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, 'a "b", c\nd'), (2, None), (3, "é")], "id long, x string")
    options = {"header": "true", "multiLine": "true", "escape": '"'} if kind == "csv" else {}
    published.publish(df, str(tmp_path / "out"), ["id"], kind, options)
    assert sorted(map(tuple, published.read_published(spark, str(tmp_path / "out")).collect())) == [(1, 'a "b", c\nd'), (2, None), (3, "é")]
    assert published.publish(df.withColumn("y", F.lit(1)), str(tmp_path / "out"), ["id"], kind, options).written == 3  # another schema


CHAPTER = """<book-part><book-part-meta><title-group><title>A <i>title</i></title></title-group><year>2019</year><year>2021</year><year>n.d.</year>
<permissions><license><p>Free: https://creativecommons.org/licenses/by/4.0/.</p></license></permissions></book-part-meta><body><p>First.</p>
<sec><title>Activity</title><p>Sum one.</p><p>Sum two.</p></sec><sec><title> Intro
 duction </title><p>One <b>bold</b> &amp; two<fig><caption><p>cap</p></caption></fig> tail.</p><sec><title>Inner</title><p>In.</p>
<list><list-item><p>i1</p></list-item><list-item><p>i2</p><p>i2b</p></list-item></list></sec><p>With <list><list-item><p>x</p></list-item><list-item>y</list-item></list>end</p>
<table-wrap><p>no</p></table-wrap></sec><sec><title>Empty</title><fig/></sec><sec><title>References</title><p>gone</p></sec><sec><title>Z</title><p>gone</p></sec></body></book-part>"""


def test_sections_of_marked_up_documents(spark):
    texts = {
        "chapter": (CHAPTER, ("A title", 2021, "https://creativecommons.org/licenses/by/4.0/", "Sum one. Sum two.", [("", ["First."]), ("Intro duction", ["One bold & two tail.", "In.", "i1", "i2 i2b", "With x y end"])])),
        "broken": ('<h1>T</h1><p><b>Unclosed.<br><p>Second</p>stray<ul><li>a<li>b</ul><p>open <i>end', ("T", None, "", "", [("T", ["Unclosed.", "Second", "a", "b", "open end"])])),
        "marks": ("a < b <p a=\">\">q &lt; r</p><script>var t='</p><p>';</script><p>z</p></div></p><!-- <p>c</p> --><p><![CDATA[x < y]]></p><style>p{}", ("", None, "", "", [("", ["q < r", "z", "x < y"])])),
        "heads": ("<html><head><title>H</title></head><body><nav><ul><li>n</ul></nav><h1>A<p>x<h2>B</h2><p>y<figure>f<p>g</figure> tail</p><h2>References</h2><p>gone", ("H", None, "", "", [("A", ["x"]), ("B", ["y tail"])])),
        "linked": ('<front><license xlink:href="http://l/?a=1&amp;b"><p>words</p></license></front><body><sec><p>p</p></sec></body>', ("", None, "http://l/?a=1&b", "", [("", ["p"])])),
        "empty": ("", ("", None, "", "", [])),
        "open": ("<p", ("", None, "", "", [])),
        "long": ("<b>" * 2_000 + "<p>" + "w " * 50_000 + "</p>" * 2_000, ("", None, "", "", [("", [" ".join(["w"] * 50_000)])])),
    }
    df = spark.createDataFrame([(k, t) for k, (t, _) in texts.items()] + [("null", None)], "k string, html string").withColumn("record", F.lit("clash"))
    got = {r.k: r.read for r in markup.records(df, roles=markup.Roles(summary=("activity",)), out="read").collect()}
    assert got.pop("null") is None
    for k, r in got.items():
        assert (r.title, r.year, r.licence, r.summary, [(s.title, s.paragraphs) for s in r.sections]) == texts[k][1], k
        assert [s.number for s in r.sections] == list(range(1, len(r.sections) + 1))
    rows = [tuple(r) for r in markup.paragraphs(df.where("k = 'heads'"), ["k"]).orderBy("section", "pos").collect()]
    assert rows == [("heads", 1, "A", 1, "x"), ("heads", 2, "B", 1, "y tail")]


def test_passages_of_sections_never_join_two_of_them(spark):
    words = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    page = f"<h1>A</h1><p>{words('a', 30)}</p><p>{words('b', 30)}</p><h2>B</h2><p>{words('c', 25)}</p><p>short</p>"
    df = spark.createDataFrame([(1, page), (2, f"<p>{words('a', 30)}</p>")], "page long, html string")
    sections = markup.section_texts(df, ["page"])
    got = [(r.page, r.section, r.words) for r in passages.passages(sections, ["page", "section"]).orderBy("page", "section", "pos").collect()]
    assert got == [(1, 1, 60), (1, 2, 26), (2, 1, 30)]
    asked = spark.createDataFrame([(7, words("c", 13))], "item_id long, text string")
    found = passages.library(sections, asked, "page", [F.asc("page")], section="section").orderBy("page", "section").collect()
    assert [(r.page, r.section, r.passage_id) for r in found] == [(1, 1, "1-001"), (2, 1, "2-001")]


def test_steps_are_made_once(spark, tmp_path):
    from tessera.operators.steps import Step, Steps, content_fingerprint

    calls = []

    def step(name, needs, f, **params):
        return Step(name, needs, lambda *dfs, **p: calls.append(name) or f(*dfs, **p), params)

    def graph(add=1, version=1):
        return Steps(step("plus", ("given",), lambda d, add: d.select((F.col("x") + add).alias("x")), add=add), step("twice", ("plus",), lambda d: d.unionByName(d)), step("other", ("given2",), lambda d: d), step("both", ("twice", "other"), lambda a, b: a.crossJoin(b)))

    given = {"given": spark.createDataFrame([(1,), (2,), (2,)], "x long"), "given2": spark.createDataFrame([("a",)], "y string")}
    folder = str(tmp_path)
    first = graph().run(spark, folder, given, ["both"])
    assert first.made == ("plus", "twice", "other", "both") and first.kept == () and first.tables["both"].count() == 6
    again = graph().run(spark, folder, {k: d.repartition(3) for k, d in given.items()}, ["both"])
    assert again.made == () and again.kept == first.made and calls == list(first.made)
    assert graph(add=5).run(spark, folder, given, ["both"]).made == ("plus", "twice", "both")
    assert graph().run(spark, folder, given | {"given2": spark.createDataFrame([("b",)], "y string")}, ["both"]).made == ("other", "both")
    assert graph().run(spark, folder, given, ["twice"]).kept == ("plus", "twice")
    os.remove(next(tmp_path / p / "_SUCCESS" for p in os.listdir(tmp_path) if p.startswith("twice-")))  # a write that was cut off
    assert len(graph().run(spark, folder, given, ["twice"]).made) <= 1
    with pytest.raises(ValueError, match="step plus needs given"):
        graph().order(["both"], {"given2"})
    with pytest.raises(ValueError, match="rests on itself"):
        Steps(step("a", ("b",), None), step("b", ("c",), None), step("c", ("a",), None)).order(["a"], set())
    with pytest.raises(ValueError, match="no step makes z"):
        graph().order(["z"], set())
    with pytest.raises(ValueError, match="one name"):
        Steps(step("a", (), None), step("a", (), None))
    one, two = spark.createDataFrame([(1,), (1,)], "x long"), spark.createDataFrame([(1,)], "x long")
    assert content_fingerprint(one) != content_fingerprint(two) and content_fingerprint(one.where("false")) == content_fingerprint(two.where("false"))


def test_files_of_a_tree(spark, tmp_path):
    import hashlib
    import io
    import struct
    import tarfile

    from tessera.sources import files

    png = bytes.fromhex("89504E470D0A1A0A") + b"\0\0\0\rIHDR" + struct.pack(">II", 640, 300) + b"rest"
    gif = b"GIF89a" + struct.pack("<HH", 513, 7) + b"rest"
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 6) + b"JFIF" + b"\xff\xc0" + struct.pack(">HBHH", 11, 8, 77, 1200) + b"rest"
    made = {"a/p.png": png, "a/b/q.gif": gif, "r.jpg": jpeg, "cut.png": png[:12], "cut.jpg": jpeg[:8], "t.txt": "zwei Wörter".encode(), "empty.bin": b"", "b/t.txt": b"x"}
    for name, content in made.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    got = {r.path.split(str(tmp_path) + "/")[1]: r for r in files.inventory(spark, str(tmp_path)).collect()}
    assert {k: (r.size, r.sha256) for k, r in got.items()} == {k: (len(c), hashlib.sha256(c).hexdigest()) for k, c in made.items() if c}
    assert {k: (r.media, r.width, r.height) for k, r in got.items() if r.media} == {"a/p.png": ("png", 640, 300), "a/b/q.gif": ("gif", 513, 7), "r.jpg": ("jpeg", 1200, 77), "cut.png": ("png", None, None), "cut.jpg": ("jpeg", None, None)}
    assert files.find_one(spark, str(tmp_path), "p.png").endswith("/a/p.png")
    for name, told in (("t.txt", "2 files"), ("no.txt", "no files")):
        with pytest.raises(FileNotFoundError, match=told):
            files.find_one(spark, str(tmp_path), name)
    assert sorted((r.text, r.words) for r in files.texts(spark, str(tmp_path)).collect()) == [("x", 1), ("zwei Wörter", 2)]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.txt").write_bytes(b"\xff\xfe\xfd")
    with pytest.raises(Exception, match="(?i)malformed|utf"):
        files.texts(spark, str(tmp_path / "bad")).collect()

    def archive(name, members, cut=None):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w:gz") as t:
            for m, c in members:
                info = tarfile.TarInfo(m)
                info.size = len(c)
                t.addfile(info, io.BytesIO(c))
        (tmp_path / name).write_bytes(out.getvalue()[:cut])

    noise = random.Random(1).randbytes(200_000)
    archive("one.tar.gz", [("x/1.xml", b"<a/>"), ("x/2.txt", b"no"), ("x/3.xml", b"")])
    archive("two.tar.gz", [("1.xml", b"<b/>"), ("2.xml", noise)], 100_000)
    (tmp_path / "three.tar.gz").write_bytes(b"not packed")
    rows = files.archive_members(spark, str(tmp_path))
    name = F.element_at(F.split("archive", "/"), -1).alias("archive")
    assert sorted((r.archive, r.member, bytes(r.content)) for r in rows.where("member IS NOT NULL").select(name, "member", "content").collect()) == [("one.tar.gz", "x/1.xml", b"<a/>"), ("one.tar.gz", "x/3.xml", b""), ("two.tar.gz", "1.xml", b"<b/>")]
    assert sorted(map(tuple, files.unreadable(rows).select(name, "read", "problems").collect())) == [("one.tar.gz", 2, 0), ("three.tar.gz", 0, 1), ("two.tar.gz", 1, 1)]


def test_rules_of_tables_records_and_views(spark):
    from tessera.operators import constraints

    sha = lambda c: c * 64
    rows = [(1, "train", "a", "train/a/1.jpg", sha("a"), "f", [("p/1.png", sha("1"))]), (2, "dev", "a", "dev/a/2.JPG", sha("b"), " ", []), (3, "test", "a", "test/b/3.jpg", sha("A"), "f", None), (4, "test", "a", "test/a/..", sha("c"), None, [("../x.png", sha("2"))]),
            (5, "test", "a", "test/a/5.txt", sha("a"), "f", [("p/5.gif", "1")]), (6, "train", "a", "train/a/1.jpg", None, "f", [("p/1.png", sha("3"))]), (7, None, None, None, sha("d"), "f", [("p/7.png", sha("1"))])]
    df = spark.createDataFrame(rows, "line int, split string, label string, path string, sha256 string, facts string, pics array<struct<path: string, sha256: string>>")
    got = sorted(map(tuple, constraints.table_problems(df, constraints.TableRules(facts="facts", pictures="pics")).collect()))
    shape, ending, digest, inside = "the path is not split/label/file", "the file has another ending", "the sha256 is not 64 hexadecimal characters", "a picture is not a picture file inside the folder"
    assert got == sorted([(2, "the split is not known"), (2, "the facts are empty"), (2, "no picture is listed"), (3, shape), (3, digest), (3, "no picture is listed"), (4, shape), (4, ending), (4, "the facts are empty"), (4, inside), (5, ending), (5, inside),
                          (5, "the sha256 of a picture is not 64 hexadecimal characters"), (5, "the same content is also on line 1"), (6, digest), (6, "the same path is also on line 1"), (6, "the same picture is also on line 1"), (7, "the split is not known"), (7, shape), (7, ending), (7, "the same picture is also on line 1")])
    assert constraints.table_problems(df.where("line = 1")).count() == 0
    fields = [constraints.Field("Age", "age", "age"), constraints.Field("Site", "site", "site"), constraints.Field("Bleeds", "bleeds", "yes_no")]
    rows = [(1, "034", "ARM", "TRUE"), (2, "0", "Leg", "not recorded"), (3, "121", "x", "TRUE"), (4, "3.5", "not recorded", "maybe"), (5, None, None, None), (6, "-1", "x", "FALSE")]
    df = spark.createDataFrame(rows, "k int, age string, site string, bleeds string")
    broken = Counter(r.k for r in constraints.record_problems(df, "k", fields).collect())
    assert broken == {3: 1, 4: 3, 5: 3, 6: 1}
    assert [r.record for r in constraints.with_record(df.where("k < 3"), "k", fields).orderBy("k").collect()] == ["1. Age: 34\n2. Site: arm\n3. Bleeds: yes", "1. Age: 0\n2. Site: leg\n3. Bleeds: unknown"]
    for k in (3, 4, 5, 6):
        with pytest.raises(Exception, match=f"can't be printed: {k}"):
            constraints.with_record(df.where(f"k = {k}"), "k", fields).count()
    view = lambda *rows: spark.createDataFrame(rows, "q int, g string, label string")
    a = view((1, "x", "m"), (2, "x", "n"), (3, "y", "m"))
    told = lambda b, **more: sorted(map(tuple, constraints.view_problems(a, b, "q", "g", "label", **more).collect()))
    assert told(a) == [] and told(view((1, "x", "m"), (2, "z", "n"), (3, "y", "m"), (3, "y", "m"))) == [("2", "another group"), ("3", "twice in the second")]
    assert told(view((1, "x", "m"), (4, "y", "o"))) == [("2", "only in the first"), ("3", "only in the first"), ("4", "only in the second"), ("n", "the answer option is only in the first"), ("o", "the answer option is only in the second")]
    assert told(view((1, "x", "m"), (2, "x", "n"), (3, "y", "m"), (9, "y", "n")), subset=True) == []


def test_references_without_a_semicolon_are_text_in_paragraphs(spark):
    df = spark.createDataFrame([("k", "<h1>a&amp;&amp; b&amp</h1><p>x &lt;&#x27;&#65; &notit; &ampc; &lt d &eacute;</p>")], "k string, html string")
    assert [tuple(r) for r in markup.paragraphs(df, ["k"]).collect()] == [("k", 1, "a&& b&amp", 1, "x <'A &notit; &ampc; &lt d é")]


def test_references_without_a_semicolon_are_text_in_records(spark):
    df = spark.createDataFrame([("k", "<head><title>a&amp;&amp</title></head><body><h1>b</h1><p>c&amp;</p></body>"), ("l", "<title>&#x27;&quot</title>")], "k string, html string")
    got = {r.k: r.record for r in markup.records(df).collect()}
    assert (got["k"].title, got["k"].sections[0].paragraphs, got["l"].title) == ("a&&amp", ["c&"], "'&quot")


def test_marked_up_texts_are_read_in_slabs(monkeypatch):
    import pyarrow as pa

    texts = pa.array([f"<h1>t{i}</h1>" + "<p>x</p>" * i if i % 3 else None for i in range(40)])
    whole, built = markup._records(markup.Roles())(texts), []
    monkeypatch.setattr(markup, "SLAB_CHARS", 100)
    made = pa.array
    monkeypatch.setattr(pa, "array", lambda rows, kind: built.append(len(rows)) or made(rows, kind))
    assert markup._records(markup.Roles())(texts).equals(whole) and len(whole) == 40
    assert len(built) > 5 and sum(built) == 40


def test_records_of_odd_pages_agree_with_their_sql(spark, tmp_path):
    import duckdb
    import pyarrow.parquet as pq

    from tessera.plans import catalog

    page = lambda title, h1, *ps: f"<html><head>{title}</head><body><article><h1>{h1}</h1>{''.join(f'<p>{p}</p>' for p in ps)}</article></body></html>"
    titled = lambda t: f"<title>{t}</title>"
    pages = [
        (1, None), (2, ""), (3, page("", "A heading alone", "x")), (4, page(titled(""), "b", "y")), (5, page(titled("none"), "none", "", " <br>")),
        (6, page(titled("twice"), "c", "one", "two")), (6, page(titled("again"), "c", "three")), (6, None), (None, page(titled("no id"), "d", "x")), (None, None),
        (7, page(titled("References"), "References", "kept", "too")), (8, page(titled("a\u00a0b\u2003"), "e", "\u00a0x\u00a0 y\u3000", "\u00a0")), (9, page(titled("\x0bv\x1f\n w"), "f", "\x0b", "\x85 z")),
    ]
    cut = "&lt;&#x27;&amp;quot;&amp;"
    pages += [(100 + n, page(titled(cut[:n]), cut[:n], "p" + cut[:n])) for n in range(len(cut) + 1)]
    table = pa.table({"page_id": pa.array([k for k, _ in pages], pa.int64()), "html": pa.array([h for _, h in pages], pa.string())})
    pq.write_table(table, str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet'")
    got = Counter(map(tuple, catalog.QUERIES["N06_records"](spark, str(tmp_path)).collect()))
    assert got == Counter(con.sql(catalog.ORACLE["N06_records"]).fetchall())
    assert got[(1, None, 0, 0)] == 1 and got[(6, "again", 3, 11)] == 1 and got[(None, "no id", 0, 0)] == 1 and got[(3, "", 1, 1)] == 1 and got[(7, "References", 2, 7)] == 1


def test_paragraphs_of_odd_pages_agree_with_their_sql(spark, tmp_path):
    import duckdb
    import pyarrow.parquet as pq

    from tessera.plans import catalog

    htmls = [None, "<article><h1>References</h1><p>kept</article>", "<article><h1>a\u00a0b</h1><p>\u00a0x\u00a0 y\u3000<p>\x0b\n z</article>"]
    pq.write_table(pa.table({"page_id": pa.array(range(3), pa.int64()), "html": pa.array(htmls, pa.string())}), str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet'")
    got = sorted(map(tuple, catalog.QUERIES["N05_paragraphs"](spark, str(tmp_path)).collect()))
    assert got == sorted(con.sql(catalog.ORACLE["N05_paragraphs"]).fetchall())
    assert got == [(1, "References", 1, "kept"), (2, "a\u00a0b", 1, "x\u00a0 y"), (2, "a\u00a0b", 2, "\x0b z")]


def test_white_space_and_names_of_records_are_roles(spark):
    df = spark.createDataFrame([("k", "<h1>a\u00a0b</h1><p>c\u00a0\u00a0d</p>")], "k string, html string")
    told = lambda roles: [(r.record.title, r.record.sections[0].title, r.record.sections[0].paragraphs) for r in markup.records(df, roles=roles).collect()]
    assert told(markup.Roles()) == [("a b", "a b", ["c d"])]
    assert told(markup.Roles(blanks=markup.BLANKS_OF_HTML, named_by_text=False)) == [("", "a\u00a0b", ["c\u00a0\u00a0d"])]
