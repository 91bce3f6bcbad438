import io
import zipfile

from pyspark.sql import functions as F

from taleweave.sources import files
from taleweave.streaming import live


def epub():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("content.opf", '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="b" href="t/two.xhtml"/><item id="a" href="t/one.xhtml"/><item id="n" href="nav.xhtml"/></manifest><spine><itemref idref="n"/><itemref idref="a"/><itemref idref="b"/></spine></package>')
        z.writestr("t/one.xhtml", f"<html><head><title>One</title></head><body><h1>One</h1><p>{'first words ' * 20}</p><hr/><h2>Sub</h2><p>a<br/>b</p></body></html>")
        z.writestr("t/two.xhtml", f"<html><head><title>Two</title></head><body><p>{'other words ' * 20}</p></body></html>")
        z.writestr("nav.xhtml", "<p>contents</p>" * 40)
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "a.epub").write_bytes(epub())
    (tmp_path / "b.txt").write_bytes("第一章 开始了".encode("gb18030"))
    (tmp_path / "c.txt").write_bytes(b"%PDF-1.4")
    (tmp_path / "d.exe").write_bytes(b"MZ")
    (tmp_path / "e.epub").write_bytes(b"PK\x03\x04broken")
    found = files.binary_files(spark, str(tmp_path)).withColumn("error", files.upload_error(F.col("path"), F.col("content")))
    errors = {r.path.rsplit('/', 1)[1][0]: r.error for r in found.select("path", "error").collect()}
    assert errors["a"] is None and errors["b"] is None and errors["c"] == "content is pdf" and "exe" in errors["d"]
    texts = files.read_texts(found.where(F.col("path").endswith("b.txt"))).first()
    assert (texts.text, texts.encoding) == ("第一章 开始了", "gb18030")
    books = files.read_books(found.where(F.col("path").endswith(".epub"))).orderBy("chapter_order").collect()
    assert [(b.chapter_order, b.title) for b in books if b.chapter_order >= 0] == [(0, "One"), (1, "Two")]
    assert "---" in books[1].text and "## Sub" in books[1].text and "a\nb" in books[1].text and books[0].chapter_order == -1


def test_keyed_tables(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, text string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, text string")
    assert sorted(map(tuple, files.upserted(old, new, "id").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert files.without(old, new, "id").count() == 1
    known = files.unseen(old, old.select(F.lit("none").alias("fingerprint")), "text").select("fingerprint")
    assert files.unseen(old.unionByName(new), known, "text").count() == 2


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"2024-01-01 0{i % 4}:10:00", "k", 1) for i in range(12)], "id int, ts string, kind string, value int").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for n, (name, df) in enumerate({"counted": live.windowed_counts(stream, "ts", "kind", "value"), "used": live.running_budget(stream, "kind", "value", 10)}.items()):
        q = df.writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", str(tmp_path / f"c{n}")).start()
        q.processAllAvailable()
        q.stop()
    assert {r.n for r in spark.sql("SELECT * FROM counted").collect()} == {3}
    assert spark.sql("SELECT max(used) AS u, bool_or(over) AS o FROM used").first() == (12, True)
