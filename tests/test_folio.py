"""The document folder source: the rows of the plain readers, pruning, and streams that go on where they stopped."""

import io
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from folioforge.sources import files, folio


def docx(*lines):
    body = "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in lines)
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("[Content_Types].xml", "<x/>")
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return data.getvalue()


def folder(path):
    (path / "deep").mkdir(parents=True)
    for name, data in {"a.docx": docx("one", "two"), "deep/b.DOCX": docx("é"), "c.pdf": b"%PDF-1 %%EOF", "d.pdf": b"%PDF-1 /Encrypt %%EOF", "e.docx": b"PK broken", "f.txt": b"text", "g.pdf": b"", "h.docx": docx("x" * 3000)}.items():
        (path / name).write_bytes(data)
    return str(path)


def test_rows_of_the_plain_readers(spark, tmp_path):
    folio.register(spark)
    root = folder(tmp_path / "in")
    got = {r.path.rsplit("/", 1)[1]: (r.error, r.page_number, r.text, r.length) for r in spark.read.format("folio").option("splitBytes", "500").load(root).collect()}
    checked = files.validate(files.scan_all(spark, root)).cache()
    want = {r.path.rsplit("/", 1)[1]: (r.error_code, None, None, r.length) for r in checked.where("error_code IS NOT NULL").collect()}
    want |= {r.path.rsplit("/", 1)[1]: (r.error, r.page_number, r.text, r.length) for r in files.parse(checked).join(checked.select("path", "length"), "path").collect()}
    assert got == want and len(got) == 8
    hashes = {r.path.rsplit("/", 1)[1]: r.sha256 for r in spark.read.format("folio").load(root).select("path", "sha256").collect()}
    assert hashes == {r.path.rsplit("/", 1)[1]: r.sha256 for r in checked.collect()}
    assert spark.read.format("folio").option("splitBytes", "500").load(root).rdd.getNumPartitions() > 2
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("folio").load(str(tmp_path / "nowhere")).count()
    (tmp_path / "empty").mkdir()
    assert spark.read.format("folio").load(str(tmp_path / "empty")).count() == 0


def test_pruning(spark, tmp_path):
    folio.register(spark)
    root = folder(tmp_path / "in")
    (tmp_path / "in" / "z.pdf").write_bytes(b"%PDF-1 %%EOF")
    rows = spark.read.format("folio").load(root).where(F.col("extension") == ".docx")
    assert rows.count() == 4
    names = spark.read.format("folio").schema("path string, length long").load(root)
    assert names.count() == 9 and names.columns == ["path", "length"]
    one = spark.read.format("folio").load(root).where(F.col("path").startswith(f"{root}/deep") & (F.col("page_number") == 1)).collect()
    assert [r.text for r in one] == ["é"]
    reader = folio.FolioReader(folio._Options({"path": root}, spark.read.format("folio").load(root).schema))
    left = list(reader.pushFilters([folio.EqualTo(("extension",), ".docx"), folio.EqualTo(("text",), "x")]))
    assert len(left) == 1 and {f.extension for p in reader.partitions() for f in p.files} == {".docx"}


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    folio.register(spark)
    root = folder(tmp_path / "in")

    def run():
        stream = spark.readStream.format("folio").option("settleMs", "0").load(root)
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="0 seconds").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return sorted(r.path.rsplit("/", 1)[1] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    first = run()
    assert len(first) == 8
    assert run() == first  # nothing new, nothing again
    time.sleep(0.05)
    for k in range(3):
        (tmp_path / "in" / f"new{k}.docx").write_bytes(docx(f"new {k}"))
    assert run() == sorted([*first, "new0.docx", "new1.docx", "new2.docx"])


def test_offsets():
    assert [len(p.files) for p in folio.cut([folio.Found(str(k), s, k) for k, s in enumerate((5, 5, 100, 0, 3, 9))], 10)] == [2, 1, 2, 1]
    assert folio.cut([], 10) == []
