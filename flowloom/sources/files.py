"""Event logs from CSV and XES files, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowloom.functions.text import folded, trim_all
from flowloom.operators.quality import clean
from flowloom.schema import NO_RESOURCE
from flowloom.sources.pieces import counted_before, numbered, pieces, quotes, records, within
from flowloom.sources.scratch import written

# Names of columns that are taken for a field.
ALIASES = {
    "case_id": ["case_id", "caseid", "case", "trace_id", "traceid", "id_caso", "caso"],
    "activity": ["activity", "atividade", "concept:name", "task", "event", "nomeatividade"],
    "timestamp": ["timestamp", "time", "event_time", "completion_time", "datahora", "datetime", "time:timestamp"],
    "resource": ["resource", "org:resource", "usuario", "responsavel", "worker", "assignee", "owner"],
    "lifecycle": ["lifecycle:transition", "lifecycle", "ciclo"],
}
REQUIRED = ["case_id", "activity", "timestamp"]
EMPTY = "O CSV precisa ter cabeçalho e pelo menos um evento."


def _separator(line: Column) -> Column:
    """The semicolon if a line has more of them than of commas."""
    count = lambda c: F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))
    return F.when(count(";") > count(","), ";").otherwise(",")


def _fields(line: Column, sep: str) -> Column:
    """The trimmed fields of a record. Quotes may stand anywhere in a field; within them separators are text and two quotes are one."""
    field = rf'((?:[^"{sep}]++|"[^"]*+")*+)(?:{sep}|\z)'
    raw = F.regexp_extract_all(F.concat(line, F.lit(sep)), F.lit(field), F.lit(1))
    raw = F.slice(raw, F.lit(1), F.size(raw) - 1)  # after the last separator nothing comes
    inner = lambda x: F.replace(F.regexp_replace(x, '"((?:[^"]++|"")*+)"', "$1"), F.lit('""'), F.lit('"'))
    return F.transform(raw, lambda x: trim_all(inner(x)))


def _places(head: Column) -> dict[str, Column]:
    """Field -> place of the first column of a header that may be it; null if there is none."""
    place = lambda known: F.array_min(F.filter(F.transform(head, lambda h, i: F.when(folded(h).isin(known), i)), lambda i: i.isNotNull()))
    return {field: place(known) for field, known in ALIASES.items()}


def headers(cells: DataFrame) -> DataFrame:
    """(file, head, first, place of each field): the first row of each file. cells: file, block, at, n, cells. A missing field is an error."""
    order = F.struct("block", "at", "n")
    tops = cells.groupBy("file").agg(F.min_by("cells", order).alias("head"), F.min(order).alias("first"))
    heads = written(tops.select("*", F.struct(*(p.alias(f) for f, p in _places(F.col("head")).items())).alias("place")), "headers")
    missing = F.concat_ws(", ", *(F.when(F.col("place")[f].isNull(), F.lit(f)) for f in REQUIRED))
    bad = heads.where(missing != "").orderBy("file").select(missing).first()
    if bad:
        raise ValueError(f"Colunas obrigatórias ausentes: {bad[0]}.")
    if heads.isEmpty():
        raise ValueError(EMPTY)
    return heads


def raw_csv(spark: SparkSession, path: str, only: DataFrame | None = None) -> DataFrame:
    """Rows of CSV files as raw text: seq, case_id, activity, timestamp, resource, lifecycle, attributes.

    Every file has its own separator, the semicolon if its first line has more of them than of commas, and its own header, its
    first row. All fields are trimmed, line ends within quotes stay as they are, rows without any value go, missing fields are
    empty. Columns that are no field become attributes under their own names; of equal names the last holds. Rows are
    ordered by file, block and place. A quote that is never closed is refused before any row is put together. Files are read
    in blocks, also where records span lines; `only` limits them, a row for each file.
    """
    lines = pieces(spark, path, only=only)
    odd = quotes("value") % 2
    first = F.regexp_replace(F.min_by("value", F.struct("block", "at")), "^\ufeff", "")
    told = written(lines.groupBy("file").agg(_separator(first).alias("sep"), (F.sum(odd) % 2).alias("open"), F.max(odd).alias("odd")), "csv_files")
    whole = told.agg(F.max("open"), F.max("odd")).first()
    if whole[0] is None:
        raise ValueError(EMPTY)
    if whole[0]:
        raise ValueError("O CSV contém um campo com aspas não fechado.")
    value = F.regexp_replace("value", "^\ufeff", "")
    if whole[1]:
        # a record spans lines: their ends are kept, and a carriage return alone ends a record outside of quotes
        cut = F.regexp_extract_all(F.concat(value, F.lit("\r")), F.lit(r'((?:[^"\r]++|"[^"]*+")*+)\r'), F.lit(1))
        rows = records(pieces(spark, path, "\n", only)).select("file", "block", "at", F.posexplode(cut).alias("n", "value"))
    else:
        rows = lines.select("file", "block", "at", F.lit(0).alias("n"), value.alias("value"))
    line = F.col("value")
    cells = F.when(F.col("sep") == ";", _fields(line, ";")).otherwise(_fields(line, ","))
    cells = rows.join(F.broadcast(told.select("file", "sep")), "file").select("file", "block", "at", "n", cells.alias("cells")).where(F.array_join("cells", "") != "")
    cells = written(cells, "cells")  # read for the headers and for the rows: records are put together once
    heads = headers(cells)
    cell = lambda i: F.coalesce(F.get("cells", i), F.lit(""))
    taken = F.array_compact(F.array(*(F.col("place")[f] for f in ALIASES)))
    own = F.filter(F.transform("head", lambda h, i: F.when((h != "") & ~F.array_contains(taken, i), F.struct(h.alias("key"), cell(i).alias("value")))), lambda x: x.isNotNull())
    # of equal names the last holds
    last = F.filter(own, lambda x, i: ~F.exists(F.slice(own, i + 2, F.size(own)), lambda y: y["key"] == x["key"]))
    events = cells.join(F.broadcast(heads), "file").where(F.struct("block", "at", "n") != F.col("first"))
    return events.select(within(F.col("at"), F.col("n"), 20, 28, 15).alias("seq"), *(cell(F.col("place")[f]).alias(f) for f in ALIASES), F.when(F.size(own) > 0, F.map_from_entries(last)).alias("attributes"))


def _traces(spark: SparkSession, path: str, only: DataFrame | None) -> DataFrame:
    """(file, block, at, trace): from the start tag of a trace to its end, which may be written in any case."""
    end = F.col("value").rlike("(?i)</trace$")
    tags = pieces(spark, path, ">", only)
    told = written(tags.groupBy("file").agg(F.count_if(end).alias("ends"), F.collect_set(F.when(end, F.right("value", F.lit(7)))).alias("forms"), F.max(F.col("value").rlike("(?i)<!DOCTYPE|<!ENTITY")).alias("typed")), "xes_files")
    forms = sorted(r["form"] for r in told.select(F.explode("forms").alias("form")).distinct().collect())
    if not told.where("typed").isEmpty():
        raise ValueError("O XES não pode conter DOCTYPE ou entidades.")
    trace = F.regexp_extract("value", r"(?is)<trace\b.*$", 0)
    if len(forms) <= 1:
        # a piece is a trace; what follows the last end of a file is none
        parts = pieces(spark, path, (forms or ["</trace"])[0] + ">", only)
        counted = parts.groupBy("file").agg(F.count("*").alias("n"), F.max(F.struct("block", "at")).alias("last"))
        after = counted.join(told, "file").where("n > ends").select("file", "last")
        parts = parts.join(F.broadcast(after), "file", "left").where(F.col("last").isNull() | (F.struct("block", "at") != F.col("last"))).drop("last")
    else:
        # ends are written in several ways: tags are put together by the number of ends before them
        rows = tags.withColumn("e", end.cast("long"))
        own = Window.partitionBy("file", "block").orderBy("at")
        k = F.col("before") + F.sum("e").over(own) - F.col("e")
        rows = rows.join(F.broadcast(counted_before(rows, F.col("e"))), ["file", "block"]).withColumn("k", k)
        made = rows.groupBy("file", "k").agg(F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("l"), F.max("e").alias("closed")).where("closed = 1")
        parts = made.select("file", F.col("l")[0]["block"].alias("block"), F.col("l")[0]["at"].alias("at"), F.array_join(F.transform("l", lambda x: x["value"]), ">").alias("value"))
    return parts.select("file", "block", "at", trace.alias("trace")).where("trace <> ''")


def raw_xes(spark: SparkSession, path: str, only: DataFrame | None = None) -> DataFrame:
    """Events of XES files as raw text; the case is the name of the trace, else caso- and its number in the file.

    Traces and events are what stands from a start tag, whatever is in it, to the next end tag, in any case; one that is
    never closed is none. A file with a document type or an entity is refused. Files are split at the ends of traces, so a row
    holds a trace; `only` limits them, a row for each file.
    """
    traces = numbered(_traces(spark, path, only))
    before = F.when(F.contains("trace", F.lit("<event")), F.substring_index("trace", "<event", 1)).otherwise("")
    name = _attribute(before, "concept:name")
    cases = traces.select("at", F.when(name == "", F.concat(F.lit("caso-"), F.col("n").cast("string"))).otherwise(name).alias("case_id"), "trace")
    events = cases.select("at", "case_id", F.posexplode(F.regexp_extract_all("trace", F.lit(r"(?is)<event\b.*?</event>"), F.lit(0))).alias("m", "event"))
    e = F.col("event")
    return events.select(
        # traces in the order of reading, events in that of the trace
        within(F.col("at"), F.col("m"), 20, 23, 20).alias("seq"), "case_id", _attribute(e, "concept:name").alias("activity"), _attribute(e, "time:timestamp").alias("timestamp"),
        _attribute(e, "org:resource").alias("resource"), _attribute(e, "lifecycle:transition").alias("lifecycle"), F.lit(None).cast("map<string,string>").alias("attributes"),
    )


def _attribute(block: Column, key: str) -> Column:
    """The value of the first element with this key, its attributes in any order; empty if there is none."""
    pattern = rf"""(?is)<\w+(?=[^>]*\bkey=["']{key}["'])[^>]*\bvalue=["']([^"']*)["']"""
    text = F.regexp_extract(block, pattern, 1)
    for entity, plain in (("&quot;", '"'), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return trim_all(text)


def kinds(spark: SparkSession, path: str) -> DataFrame:
    """(file, xes): whether a file is XES, by its name or by its first thousand characters."""
    lines = pieces(spark, path).where("block = 0")
    first = lines.withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy("at"))).where("n <= 1000").withColumn("value", F.left("value", F.lit(1000)))
    start = F.lower(F.left(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "value"))), lambda x: x["value"]), "\n"), F.lit(1000)))
    return first.groupBy("file").agg(start.alias("start")).select("file", (F.lower("file").endswith(".xes") | F.col("start").rlike(r"<log\b|<trace\b")).alias("xes"))


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Each file by its kind, XES or CSV; of a folder with both, the events of all."""
    told = written(kinds(spark, path), "kinds")
    some = {r["xes"] for r in told.select("xes").distinct().collect()}
    if len(some) < 2:
        return raw_xes(spark, path) if some == {True} else raw_csv(spark, path)
    # CSV rows go before XES events, as their order is told within a kind only
    csv, xes = (read(spark, path, told.where(F.col("xes") == flag).select("file")) for read, flag in ((raw_csv, False), (raw_xes, True)))
    return csv.unionByName(xes.withColumn("seq", F.col("seq").bitwiseOR(F.lit(1 << 62))))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The clean event log of a file. Less than two events are an error."""
    log = written(clean(read_raw(spark, path)), "clean")
    if log.limit(2).count() < 2:
        raise ValueError("O arquivo não contém eventos válidos suficientes.")
    return log


def _iso(ms: str) -> Column:
    return F.concat(F.date_format(F.timestamp_millis(F.col(ms)), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))


def attribute_names(log: DataFrame) -> DataFrame:
    """The names of all attributes that some event has."""
    return log.select(F.explode(F.map_keys("attributes")).alias("name")).distinct()


def csv_frame(log: DataFrame) -> DataFrame:
    """The log as text columns, an attribute to a column, in the order of their names."""
    names = [r["name"] for r in attribute_names(log).orderBy("name").collect()]  # columns, not rows
    blank = lambda c: F.coalesce(c, F.lit(""))
    return log.select("case_id", "activity", _iso("ts_ms").alias("timestamp"), blank(F.col("resource")).alias("resource"), F.coalesce("lifecycle", F.lit("unknown")).alias("lifecycle"), *(blank(F.col("attributes")[n]).alias(n) for n in names))


def write_csv(log: DataFrame, path: str) -> None:
    csv_frame(log).write.csv(path, header=True, quoteAll=True, escape='"')


def _escaped(c: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def xes_traces(log: DataFrame) -> DataFrame:
    """One trace element for each case, its events in the order of input."""
    def tag(kind: str, key: str, value: Column) -> Column:
        return F.concat(F.lit(f'<{kind} key="{key}" value="'), value, F.lit('"/>'))

    event = F.concat(F.lit("    <event>\n      "), tag("string", "concept:name", _escaped(F.col("activity"))), F.lit("\n      "), tag("date", "time:timestamp", _iso("ts_ms")), F.lit("\n      "), tag("string", "org:resource", _escaped(F.coalesce("resource", F.lit(NO_RESOURCE)))), F.lit("\n    </event>"))
    by_case = log.select("case_id", "seq", event.alias("event")).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("seq", "event"))).alias("events"))
    body = F.array_join(F.transform("events", lambda x: x["event"]), "\n")
    return by_case.select(F.concat(F.lit("  <trace>\n    "), tag("string", "concept:name", _escaped(F.col("case_id"))), F.lit("\n"), body, F.lit("\n  </trace>")).alias("value"))


def write_xes(log: DataFrame, path: str) -> None:
    """A folder of XES files, one for each task, each a whole log."""
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<log xes.version="1.0"><string key="concept:name" value="export"/>'

    def wrapped(frames):
        yield_head = True
        for f in frames:
            if yield_head:
                yield f.iloc[:0].reindex(range(1)).assign(value=head)
                yield_head = False
            yield f
        if not yield_head:
            import pandas as pd

            yield pd.DataFrame({"value": ["</log>"]})

    xes_traces(log).mapInPandas(wrapped, "value string").write.text(path)
