"""Readers and writers of files."""

import pytest

from flowloom.sources import files


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text, encoding="utf-8")
    return str(tmp_path / name)


def test_csv_with_quoted_commas(spark, tmp_path):
    path = put(tmp_path, "a.csv", 'case_id,activity,timestamp,resource\nA,"Review, then pay",2026-01-01T00:00:00Z,"Ann, Bo"\nA,Pay,2026-01-02T00:00:00Z,Ann\n')
    got = files.read_log(spark, path).orderBy("seq").collect()
    assert [r["activity"] for r in got] == ["Review, then pay", "Pay"] and got[0]["resource"] == "Ann, Bo"


def test_csv_with_semicolons_and_other_names(spark, tmp_path):
    path = put(tmp_path, "b.csv", "﻿id_caso;Atividade;dataHora;Responsável;valor;ciclo\n1;Abrir;2026-01-01; Zé ;1200,50;START\n1;Fechar;2026-01-02;;;\n;;;;;\n")
    got = files.read_log(spark, path).orderBy("seq").collect()
    assert [(r["activity"], r["resource"], r["lifecycle"]) for r in got] == [("Abrir", "Zé", "start"), ("Fechar", "Não informado", "unknown")]
    assert got[0]["attributes"] == {"valor": "1200,50"}


def test_csv_without_a_column_names_it(spark, tmp_path):
    with pytest.raises(ValueError, match="timestamp"):
        files.read_log(spark, put(tmp_path, "c.csv", "case_id,activity\n1,a\n"))


XES = """<?xml version="1.0"?><log><trace><string key="concept:name" value="OC-1"/>
<event><string key="concept:name" value="A &amp; B"/><date value="2026-01-01T00:00:00Z" key='time:timestamp'/><string key="org:resource" value="Ann"/></event>
<event><string key="concept:name" value="C"/><date key="time:timestamp" value="2026-01-02T00:00:00Z"/></event></trace>
<trace><event><string key="concept:name" value="D"/><date key="time:timestamp" value="2026-01-03T00:00:00Z"/></event></trace></log>"""


def test_xes(spark, tmp_path):
    got = files.read_log(spark, put(tmp_path, "a.xes", XES)).orderBy("ts_ms").collect()
    assert [(r["case_id"], r["activity"], r["resource"]) for r in got] == [("OC-1", "A & B", "Ann"), ("OC-1", "C", "Não informado"), ("caso-2", "D", "Não informado")]


def test_xes_with_entities_is_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        files.read_log(spark, put(tmp_path, "b.xes", '<!DOCTYPE x [<!ENTITY y "z">]>' + XES))


@pytest.mark.parametrize("block", ["128m", "100"])
def test_round_trips(spark, tmp_path, block):
    from flowloom.schema import LOG_SCHEMA

    rows = [(i, f"case {i % 7}", ['Review, then "pay"', "a;b", "line\nbreak", 'x""y', " & <tag> '"][i % 5].strip(), 1_767_225_600_000 + i * 3_600_000, f"R{i % 3}", "start", {"amount": f"{i},5", "note": 'a "b", c'}) for i in range(60)]
    log, fields = spark.createDataFrame(rows, LOG_SCHEMA), ["case_id", "activity", "ts_ms", "resource"]
    wanted = sorted(map(tuple, log.select(*fields).collect()))
    files.write_csv(log.coalesce(1), str(tmp_path / "csv"))
    files.write_xes(log, str(tmp_path / "xes"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        back = files.read_log(spark, str(tmp_path / "csv"))
        assert sorted(map(tuple, back.select(*fields).collect())) == wanted
        assert {r["attributes"]["note"] for r in back.collect()} == {'a "b", c'}
        back = files.read_log(spark, str(tmp_path / "xes"))
        assert sorted(map(tuple, back.select(*fields).collect())) == wanted
        assert [r["activity"] for r in back.where("case_id = 'case 1'").orderBy("seq").collect()] == [r[2] for r in rows if r[1] == "case 1"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_csv_quotes_anywhere_and_rows_like_the_header(spark, tmp_path):
    path = put(tmp_path, "q.csv", 'case_id,activity,timestamp,resource\r\n1,ab"c,d"e,2026-01-01,"R ""x"""\r\ncase_id,activity,timestamp,resource\r\n1,"two\r\nlines",2026-01-02,\r\n')
    got = files.raw_csv(spark, path).orderBy("seq").collect()
    assert [(r["case_id"], r["activity"], r["timestamp"], r["resource"]) for r in got] == [("1", "abc,de", "2026-01-01", 'R "x"'), ("case_id", "activity", "timestamp", "resource"), ("1", "two\r\nlines", "2026-01-02", "")]
    with pytest.raises(ValueError, match="aspas"):
        files.raw_csv(spark, put(tmp_path, "open.csv", 'case_id,activity,timestamp\n1,"a,2026-01-01\n'))
    with pytest.raises(ValueError, match="cabeçalho"):
        files.raw_csv(spark, put(tmp_path, "none.csv", ""))


def raw(spark, read, path):
    fields = ["case_id", "activity", "timestamp", "resource", "lifecycle"]
    return [tuple(r[f] for f in fields) for r in read(spark, path).orderBy("seq").collect()]


@pytest.mark.parametrize("block", ["128m", "60"])
def test_line_ends_within_quotes_stay(spark, tmp_path, block):
    """Carriage returns, line feeds and both, in quotes and outside."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        text = 'case_id,activity,timestamp\r\n1,"a\rb",t1\r2,"c\nd",t2\n\n\r3,"e\r\nf",t3\r\n4,g,t4'
        (tmp_path / "a.csv").write_bytes(text.encode())
        assert [r[:3] for r in raw(spark, files.read_raw, str(tmp_path / "a.csv"))] == [("1", "a\rb", "t1"), ("2", "c\nd", "t2"), ("3", "e\r\nf", "t3"), ("4", "g", "t4")]
        (tmp_path / "b.csv").write_bytes(b"case_id,activity,timestamp\r1,a,t1\r2,b,t2\n3,c,t3\r\n4,d,t4")
        assert [r[0] for r in raw(spark, files.read_raw, str(tmp_path / "b.csv"))] == ["1", "2", "3", "4"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_every_csv_file_has_its_own_header(spark, tmp_path):
    put(tmp_path, "a.csv", "case_id,activity,timestamp,cost,cost\n1,a,t1,5,6\n")
    put(tmp_path, "b.csv", "Nível;Data Hora;ATIVIDADE;Responsável;Id_Caso\nalto;t2;b;Zé;2\n")
    assert sorted(raw(spark, files.read_raw, str(tmp_path))) == [("1", "a", "t1", "", ""), ("2", "b", "t2", "Zé", "")]
    assert sorted(map(str, (r["attributes"] for r in files.read_raw(spark, str(tmp_path)).collect()))) == ["{'Nível': 'alto'}", "{'cost': '6'}"]
    put(tmp_path, "c.csv", "case_id,what\n1,a\n")
    with pytest.raises(ValueError, match="activity, timestamp"):
        files.read_raw(spark, str(tmp_path))


def test_a_folder_with_both_kinds_gives_all_events(spark, tmp_path):
    put(tmp_path, "a.csv", "case_id,activity,timestamp\n1,a,2026-01-01\n2,b,2026-01-02\n")
    put(tmp_path, "b.xes", XES)
    put(tmp_path, "c.txt", XES.replace("OC-1", "OC-9"))
    got = raw(spark, files.read_raw, str(tmp_path))
    assert sorted(r[0] for r in got) == ["1", "2", "OC-1", "OC-1", "OC-9", "OC-9", "caso-2", "caso-2"]
    assert [r[0] for r in got[:2]] == ["1", "2"]
    assert files.read_raw(spark, str(tmp_path)).select("seq").distinct().count() == 8


def event(name, tag="event", end="event"):
    return f'<{tag}><string key="concept:name" value="{name}"/><date key="time:timestamp" value="2026-01-01"/></{end}>'


@pytest.mark.parametrize("block", ["128m", "80"])
@pytest.mark.parametrize("ends", [("</trace>", "</trace>"), ("</TRACE>", "</TRACE>"), ("</trace>", "</TRACE>"), ("</Trace>", "</trace>")])
def test_traces_and_events_however_they_are_tagged(spark, tmp_path, ends, block):
    one = f'<trace><string key="concept:name" value="c/1"/>{event("x", 'event id="a/b"')}{event("y", "EVENT", "Event")}' + ends[0]
    two = f'\n<TRACE id="2">{event("z")}' + ends[1]
    open_ = f"<trace>{event('lost')}</log>"
    put(tmp_path, "a.xes", "<log>" + one + two + one.replace("c/1", "c/3") + open_)
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        got = [r[:2] for r in raw(spark, files.read_raw, str(tmp_path / "a.xes"))]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [("c/1", "x"), ("c/1", "y"), ("caso-2", "z"), ("c/3", "x"), ("c/3", "y")]


def test_ids_of_rows_that_do_not_fit_are_an_error(spark):
    from pyspark.sql import functions as F

    from flowloom.sources.pieces import within

    at = F.lit((3 << 33) + 5).cast("long")
    assert spark.range(1).select(within(at, F.lit(2), 20, 23, 20)).first()[0] == (3 << 43) + (5 << 20) + 2
    with pytest.raises(Exception, match="too many"):
        spark.range(1).select(within(at, F.lit(1 << 20), 20, 23, 20)).collect()
