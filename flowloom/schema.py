"""The canonical event log and fixed values of its semantics.

An event log is a DataFrame of seq BIGINT, case_id STRING, activity STRING, ts_ms BIGINT, resource STRING, lifecycle STRING,
attributes MAP<STRING,STRING>. seq carries the order of the input: it breaks ties of equal timestamps.
"""

# Texts and numbers that results must show as they are.
NO_RESOURCE = "Não informado"
NO_CASE = "desconhecido"
SEPARATOR = "\u001f"
DAY_MS = 86_400_000
ONE_MINUTE_IN_DAYS = 1 / 1440

LOG_COLUMNS = ["seq", "case_id", "activity", "ts_ms", "resource", "lifecycle", "attributes"]
LOG_SCHEMA = "seq bigint, case_id string, activity string, ts_ms bigint, resource string, lifecycle string, attributes map<string,string>"
