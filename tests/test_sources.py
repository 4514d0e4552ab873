import io
import zipfile

from pyspark.sql import functions as F

from granary.functions import markup
from granary.operators.structured import fitted, kinds_of, pieces_of, q_gold_remap, structured
from granary.sources import docx, index
from granary.streaming import calls

WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def package(body, names=("[Content_Types].xml",)):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name in names:
            z.writestr(name, "<x/>")
        z.writestr("word/document.xml", f'<w:document xmlns:w="{WORD}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def paragraph(text, style=None):
    return f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>" if style else ""}<w:r><w:t>{text}</w:t></w:r></w:p>'


def test_docx(spark, tmp_path):
    cell = lambda t: f"<w:tc>{paragraph(t)}</w:tc>"
    body = paragraph("Top", "Heading1") + paragraph("") + paragraph("Some  text") + paragraph("Sub", "Heading2") + f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr></w:tbl>" + paragraph("Next", "Heading1")
    (tmp_path / "a.DOCX").write_bytes(package(body))
    (tmp_path / "b.docx").write_bytes(b"no zip")
    (tmp_path / "c.docx").write_bytes(package("", names=()))
    (tmp_path / "d.md").write_text("# x\ny")
    rows = [tuple(r)[1:] for r in docx.read_docx(spark, str(tmp_path)).orderBy("path", "kind", "index").collect()]
    assert rows == [
        ("paragraph", 1, "Top", "Top", None), ("paragraph", 3, "Top", "Some text", None), ("paragraph", 4, "Top > Sub", "Sub", None), ("paragraph", 5, "Next", "Next", None),
        ("table", 1, "Top > Sub", "a | b", None), (None, None, None, None, "zip"), (None, None, None, None, "parts"),
    ]
    assert [r.text for r in docx.read_text(spark, str(tmp_path)).collect()] == ["# x\ny"]


def test_docx_white_space_tables_and_styles():
    run = "<w:p><w:r><w:t>one</w:t><w:tab/><w:t>two</w:t><w:br/><w:t>three</w:t></w:r></w:p>"
    cell = lambda t, more="": f"<w:tc><w:tcPr>{more}</w:tcPr>{paragraph(t)}</w:tc>"
    table = f"<w:tbl><w:tr>{cell('a', '<w:gridSpan w:val=%s2%s/>' % (chr(34), chr(34)))}{cell('b')}</w:tr><w:tr>{cell('')}{cell('')}{cell('')}</w:tr><w:tr>{cell('', '<w:vMerge/>')}{cell('c')}{cell('d')}</w:tr></w:tbl>"
    body = paragraph("First", "a1") + run + table + paragraph("Kein", "Heading9")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", f'<Types><Override PartName="/word/document.xml" ContentType="{docx.MAIN_TYPE}"/></Types>')
        z.writestr("word/styles.xml", f'<w:styles xmlns:w="{WORD}"><w:style w:styleId="a1"><w:name w:val="标题 1"/></w:style></w:styles>')
        z.writestr("word/document.xml", f'<w:document xmlns:w="{WORD}"><w:body>{body}</w:body></w:document>')
    assert docx.problems(out.getvalue()) == []
    assert list(docx.blocks(out.getvalue())) == [("paragraph", 1, "First", "First"), ("paragraph", 2, "First", "one two three"), ("table", 1, "First", "a | a | b\n | c | d"), ("paragraph", 3, "First", "Kein")]
    macro = io.BytesIO()
    with zipfile.ZipFile(macro, "w") as z:
        z.writestr("[Content_Types].xml", '<Types><Override PartName="/word/document.xml" ContentType="application/vnd.ms-word.document.macroEnabled.main+xml"/></Types>')
        z.writestr("word/document.xml", "<x/>")
    assert docx.problems(macro.getvalue()) == ["type"]


def test_structured_chunks():
    one = structured("# Guide\n## Retrieval\n\nA paragraph\nof two lines.\n\n- first\n- second\n\n```\ncode  here\n```\n")
    assert one == [("Guide > Retrieval", "# Guide\n## Retrieval\n\nA paragraph\nof two lines.\n\n- first\n- second\n\n```\ncode  here\n```")]
    two = structured("# A\none\n\ntwo\n# B\nthree")
    assert two == [("A", "# A\n\none\n\ntwo"), ("B", "# B\n\nthree")]
    three = structured("First short sentence. Second short one. Third.", 32, markdown=False)
    assert all(len(c) <= 32 for _, c in three) and " ".join(c for _, c in three) == "First short sentence. Second short one. Third."
    assert [len(c) for _, c in structured("x" * 70, 30, markdown=False)] == [30, 30, 10]
    assert structured("") == structured(" \n ") == []


def test_line_kinds_and_plans():
    assert kinds_of(["# A", "#no", "- x", "2) y", "", "~~~", "# in", "~~~", "``` open"], True) == "hpll ccCc"
    assert kinds_of(["# A", "- x", "```"], False) == "plp"
    assert fitted(["aa", "b", "cccc", "d"], "-", 4) == ["aa-b", "cccc", "d"]
    assert pieces_of("one two\nthree", 8, True) == ["one two", "three"] and pieces_of("one two\nthree", 9, False) == ["one two", "three"]
    words = " ".join(["word"] * 50)
    assert all(len(p) <= 20 for p in pieces_of(words, 20, False)) and " ".join(pieces_of(words, 20, False)) == words


def test_latex_of_any_depth():
    deep = "\\mathrm{" * 3000 + "x" + "}" * 3000
    assert markup.plain_text(deep) == "x" and markup.plain_text(r"\frac{\frac{1}{2}}{\sqrt{\text{z}}}") == "((1)/(2))/(√(z))"
    assert markup.plain_text(r"a {b} } {c \frac{1} z") == r"a {b} } {c \frac{1} z"


def test_latex(spark):
    cases = {
        r"$\frac{a}{\sqrt{b}} \leq \alpha_{12}$ 。": "(a)/(√(b)) ≤ α_12。",
        r"\(x^{n + 1}\) \to \infty": "x^(n + 1) → ∞",
        r"\mathrm{Var}(X) \approx 95\%": "Var(X) ≈ 95%",
        r"\left( a \right)": "(a)",
    }
    frame = spark.createDataFrame(list(cases.items()), "answer string, expected string")
    assert frame.filter(markup.plain(F.col("answer")) != F.col("expected")).select(markup.plain(F.col("answer")), "expected").collect() == []


def test_index_versions(spark, tmp_path):
    path = str(tmp_path / "index")
    frame = lambda *ids: spark.createDataFrame([(i, f"text {i}") for i in ids], "chunk_id string, content string")
    index.build(frame("a", "b"), path, "1", {"dimension": 4, "chunker_version": "fixed"})
    assert index.sync(spark, path, frame("b", "c", "d"), "2") == {"add": 2, "delete": 1, "unchanged": 1}
    assert sorted(r.chunk_id for r in index.current(spark, path).collect()) == ["b", "c", "d"]
    assert index.compatible(index.manifest_of(spark, path), {"dimension": 5, "chunker_version": "fixed"}) == ["dimension"]
    for bad in (lambda: index.sync(spark, path, frame("x").limit(0), "3"), lambda: index.build(frame("a", "a"), path, "4", {})):
        try:
            bad()
        except ValueError:
            continue
        raise AssertionError("no error")


def test_streams(spark, tmp_path):
    source = str(tmp_path / "calls")
    rows = [("a", 0.0, 1), ("a", 1.0, 2), ("a", 1.0, 3), ("a", 60.0, 4), ("b", 5.0, 5)]
    spark.createDataFrame(rows[:3], "key string, at double, event_id long").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("key string, at double, event_id long").parquet(source)
    for name in ("first", "second"):  # the state outlives a run
        query = calls.limited_stream(stream, 60, 2).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        if name == "first":
            spark.createDataFrame(rows[3:], "key string, at double, event_id long").coalesce(1).write.mode("append").parquet(source)
    found = {r.event_id: (r.accepted, r.retry_after) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == {1: (True, None), 2: (True, None), 3: (False, 59), 4: (True, None), 5: (True, None)}
    (tmp_path / "events").mkdir()
    events = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "events"))
    assert calls.windowed_counts(events).isStreaming


def test_gold_remap_against_brute_force(spark, tmp_path):
    """Every character but white space belongs to one structured chunk; a fixed chunk is mapped if all of its own belong to the same."""
    same = "again and again the same words stand here in a long line of text. "
    texts = [None, "", "short", "a" * 70 + "\n\n" + "b" * 150, "\n\n".join("w%d " % k + "x" * 90 for k in range(30)), same * 40, "y" * 1500, "- one\n- two\n\nthree\xa0four " * 60]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    expected = {"mapped": 0, "missing": 0}
    for text in filter(None, texts):
        owners = [k for k, (_, c) in enumerate(structured(text, markdown=False)) for _ in "".join(c.split())]
        content, at = " ".join(text.replace("\xa0", "\x00").split()).replace("\x00", " "), 0
        for a in range(0, len(content), 180):
            n = len("".join(content[a : a + 180].split()))
            expected["mapped" if len(set(owners[at : at + n])) == 1 else "missing"] += 1
            at += n
    assert {r.state: r.n for r in q_gold_remap(spark, str(tmp_path)).collect()} == expected
