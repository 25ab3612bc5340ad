"""XML corpus, tables and streams."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rdfloom.operators import integrity
from rdfloom.sources import tabular, xml_corpus
from rdfloom.streaming import streams

ENTRY = """<entry category="{cat}" eid="{eid}" size="{size}"><modifiedtripleset><mtriple>A | p | B</mtriple><mtriple>A | q | 3</mtriple></modifiedtripleset>
<spanishtripleset><striple>A | p | B</striple><striple></striple></spanishtripleset><catalantripleset><ctriple>A | p | B</ctriple><ctriple>A | q | 3</ctriple></catalantripleset>
<lex lang="en" lid="Id1">A &amp; B.</lex><lex lang="en" lid="Id2">Two.</lex><lex lang="ca" lid="Id1">A  i B.</lex><lex lang="ca" lid="Id1">Repetit.</lex><lex lang="es" lid="Id3"></lex></entry>"""


@pytest.fixture
def corpus(tmp_path):
    root = tmp_path / "corpus"
    for name, body in (
        ("dev/2triples/City.xml", ENTRY.format(cat="City", eid="Id1", size="2") + ENTRY.format(cat="City", eid="Id2", size="two")), ("dev/2triples/City-checkpoint.xml", ENTRY.format(cat="City", eid="Id9", size="2")),
        ("dev/2triples/.hidden/City.xml", ENTRY.format(cat="City", eid="Id8", size="2")), ("train/1triples/Bad.xml", None),
    ):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"<benchmark><entries>{body}</entries></benchmark>" if body else "<benchmark><entries><entry")
    return str(root)


def test_xml(spark, corpus):
    usable = {r.path.rsplit("/", 1)[1]: r.usable for r in xml_corpus.listing(spark, corpus).collect()}
    assert usable["City.xml"] and not usable["City-checkpoint.xml"]
    files = xml_corpus.documents(spark, corpus)
    assert [r.xml_path for r in xml_corpus.errors(files).collect()] == ["train/1triples/Bad.xml"]
    entries = xml_corpus.entries(files)
    got = {r.eid: r for r in entries.collect()}
    assert set(got) == {"Id1", "Id2"} and got["Id1"].split == "dev" and got["Id1"].triple_bucket == "2triples" and got["Id1"].triples_es == ["A | p | B", ""]
    assert got["Id2"].declared_size is None and got["Id2"].expected_triple_count == 2 and got["Id1"].record_key == "dev/2triples/City.xml::Id1"
    checks = {(r.eid, r.language): r for r in integrity.entry_integrity(xml_corpus.integrity_entries(entries)).collect()}
    assert not checks["Id1", "es"].target_rdf_well_formed and checks["Id1", "ca"].target_rdf_well_formed and not checks["Id1", "ca"].lexicalisation_id_unique
    rows = {(r.lid, r.language): r for r in xml_corpus.manifest(entries).where("record_key like '%Id1'").collect()}
    assert rows["Id1", "ca"].xml_duplicate_target_lex and rows["Id1", "ca"].target_text == "A i B." and rows["Id1", "ca"].source_text == "A & B." and rows["Id2", "es"].target_text is None and rows["Id3", "es"].source_text is None


def test_sinks(spark, tmp_path):
    frame = spark.createDataFrame([("a", ["x", 'y "z"'], 1), ("b", None, 2)], "k string, l array<string>, n int")
    tabular.write_csv(frame, str(tmp_path / "c"))
    back = tabular.read_csv(spark, str(tmp_path / "c"), ("l",), "source")
    assert sorted((r.k, r.l) for r in back.collect()) == [("a", ["x", 'y "z"']), ("b", None)] and back.first().source.startswith("part-")
    tabular.write_jsonl(frame, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    tabular.write_xml(frame.select(F.col("k").alias("_k"), "l"), str(tmp_path / "x"))
    assert spark.read.format("xml").option("rowTag", "entry").load(str(tmp_path / "x")).count() == 2
    for _ in range(2):
        kept = tabular.append_registry(spark, frame.select("k", "n"), str(tmp_path / "r"), ["k"])
    assert kept.count() == 2
    tabular.write_views(frame.withColumn("t", F.lit("QA1")), str(tmp_path / "v"), "t", {"one": ["QA1"], "none": ["QA2"]})
    assert spark.read.parquet(str(tmp_path / "v" / "one")).count() == 2 and tabular.read_first(spark, str(tmp_path / "no"), str(tmp_path / "v" / "one")).count() == 2
    assert "code_sha256" in tabular.write_metadata(str(tmp_path / "m.json"), {"a": 1}, [__file__]) and "\\midrule" in tabular.latex_table([{"a": 1.0}], ["a"])


def test_streams_equal_batch(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(minutes=7 * i), i % 3, float(i)) for i in range(100)]
    frame = spark.createDataFrame(rows, "id bigint, ts timestamp, u bigint, v double")
    frame.write.parquet(str(tmp_path / "in"))
    stream = streams.file_stream(spark, str(tmp_path / "in"), frame)
    query = streams.tumbling(stream, "ts", "1 hour", "2 hours", "u").writeStream.format("memory").queryName("t").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = streams.tumbling(frame, "ts", "1 hour", "2 hours", "u")
    assert sorted(map(tuple, spark.table("t").collect())) == sorted(map(tuple, batch.collect()))
    sink = streams.upsert_latest(str(tmp_path / "out"), ["u"], "ts")
    query = stream.writeStream.foreachBatch(sink).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(120)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out" / "version=0")).collect()) == [97, 98, 99]
    twice = streams.first_deliveries(frame.unionByName(frame), "ts", "1 hour", "id")
    assert twice.count() == 100 and streams.sessions(frame, "ts", "10 minutes", "1 hour").count() == 1 and streams.sliding(frame, "ts", "2 hours", "1 hour", "1 hour").count() > 0
