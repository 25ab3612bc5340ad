"""Packed fields: every packing must give back what was packed."""

import csv
import io
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rdfloom.operators.packed import explode_packed, form_items, triple_items

TRIPLES = [
    ["Ferry_Orl | homePort | Varòrn, Drovna", 'Ferry_Orl | launchDate | "1889-12-11"', "Ferry_Orl | lengthInMetres | 229,9"],
    ["Museu_X | dataD'Inauguració | 1995-11-01", "Museu_X | material | granit; ferro_forjat", "Museu_X | ocupació | novel·lista"],
    ["A | p | x / y"],
    ["S_T | crew | 12", "S_T | owner | B"],
]


def packings(items):
    yield json.dumps(items)
    yield json.dumps(items, ensure_ascii=False)
    yield repr(items)
    for d in ("\n", "; ", ";", " ~ ", "||", " || ", " /// ", "<br />", "<br>", "\t", "\r\n", " ## ", " ¦ ", ",", ", ", "\n\n", ";;"):
        yield d.join(items)
        yield f"  {d.join(items)} "
    yield "; ".join(items) + ";"
    for mark in ("- ", "* ", "• "):
        yield "\n".join(mark + x for x in items)
    yield "\n".join(f"{i}. {x}" for i, x in enumerate(items, 1))
    yield " ".join(f"({i}) {x}" for i, x in enumerate(items, 1))
    for d in (",", ";"):
        out = io.StringIO()
        csv.writer(out, delimiter=d, quoting=csv.QUOTE_ALL, lineterminator="").writerow(items)
        yield out.getvalue()


def split(spark, fields, items):
    frame = spark.createDataFrame(list(enumerate(fields)), "i int, f string")
    return [r.x for r in frame.select("i", items(F.col("f")).alias("x")).orderBy("i").collect()]


def test_triples_round_trip(spark):
    packed = [(p, items) for items in TRIPLES for p in packings(items)]
    for (p, items), got in zip(packed, split(spark, [p for p, _ in packed], triple_items), strict=True):
        assert got == items, p


def test_triples_without_values(spark):
    assert split(spark, [None, "", "  ", "[]", " [ ] ", "\n"], triple_items) == [None, [], [], [], [], []]


def test_placeholders_do_not_collide(spark):
    odd = 'A | p | "0"; B | q | \ue0000\ue001; C | r | \ue0033\ue002'
    assert split(spark, [odd], triple_items) == [['A | p | "0"', "B | q | \ue0000\ue001", "C | r | \ue0033\ue002"]]


FORMS = [("port orl", 3), ("l'estofat x", 1), ("casa (gran)", 12), ("a; b", 2), ("x | y", 4), ("p / q", 5), ("torre 1909", 1)]


def counted(forms):
    yield json.dumps(dict(forms)), True
    yield json.dumps(dict(forms), ensure_ascii=False), True
    yield repr(dict(forms)), True
    yield json.dumps([{"form": f, "n": n} for f, n in forms]), True
    for d in ("; ", ";", " | ", "|", "\t", "\n", " / "):
        yield d.join(f"{f}={n}" for f, n in forms), True
        yield d.join(f"{f} ({n})" for f, n in forms), True
        yield d.join(f"{f}: {n}" for f, n in forms), True
    yield ", ".join(f"{n} x {f}" for f, n in forms), True
    yield "; ".join("'" + f.replace("'", "''") + f"'={n}" for f, n in forms), True


def test_forms_round_trip(spark):
    packed = [p for p, _ in counted(FORMS)]
    for p, got in zip(packed, split(spark, packed, form_items), strict=True):
        assert got == [f for f, _ in FORMS], p
    single = [p for p, _ in counted(FORMS[:1])]
    assert split(spark, single, form_items) == [["port orl"]] * len(single)
    assert split(spark, [None, "", "{}", "[]"], form_items) == [None, [], [], []]


def test_positions_and_duplicates(spark):
    frame = spark.createDataFrame([(1, "A | p | b; C | q | d", 9), (1, "A | p | b; C | q | d", 9), (2, None, 1), (None, "A | p | b", 1)], "id bigint, f string, pos int")
    rows = sorted(explode_packed(frame.where("id is not null"), "id", triple_items(F.col("f")), "t").collect())
    assert [tuple(r) for r in rows] == [("t", 1, 1, "A | p | b"), ("t", 1, 2, "C | q | d")]
    assert explode_packed(frame.limit(0), "id", triple_items(F.col("f")), "t").count() == 0


word = st.text("abcxyzàé", min_size=1, max_size=6)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(word, word, word), min_size=1, max_size=4), st.sampled_from(["; ", "\n", " || ", "\t", ", "]))
def test_any_words(spark, triples, delimiter):
    items = [" | ".join(t) for t in triples]
    assert split(spark, [delimiter.join(items)], triple_items) == [items]


@pytest.mark.parametrize("size", [200_000])
def test_long_field(spark, size):
    items = [f"S_{i} | p | v{i}" for i in range(size // 40)]
    assert split(spark, ["; ".join(items)], triple_items)[0] == items
