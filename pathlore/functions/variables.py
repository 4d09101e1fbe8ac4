"""What varies in the typed texts of a recorded procedure: found, named, put in place of, and filled in again."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame

from . import patterns as p

_FOUND = [(kind, re.compile(pattern, re.ASCII)) for kind, pattern in p.VARIABLES]
_OTHER = re.compile("[^a-zA-Z0-9]")


def spans(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of what may vary: the earliest begins win, of equal ones the kind named first; none overlap."""
    hits = [(m.start(), m.end(), kind, m[0]) for kind, pattern in _FOUND for m in pattern.finditer(text or "")]
    out, last = [], -1
    for hit in sorted(hits, key=lambda h: h[0]):
        if hit[0] >= last:
            out.append(hit)
            last = hit[1]
    return out


def suggested(kind: str, value: str) -> str:
    if kind == "email":
        return _OTHER.sub("_", value.split("@")[0]) + "_email"
    if kind == "url":
        try:
            return _OTHER.sub("_", urlsplit(value).hostname or "") + "_url"
        except ValueError:
            return "url"
    if kind in ("home_path", "absolute_path"):
        return _OTHER.sub("_", value.split("/")[-1]) + "_path"
    return {"date_iso": "date", "date_slash": "date", "phone": "phone_number", "money": "amount"}[kind]


def named(texts: list[str | None]) -> list[tuple[int, int, int, str, str, str]]:
    """(text's number, start, end, kind, value, name) of a procedure's texts in order; equal values have one name, different ones different names."""
    names, out = {}, []
    for i, text in enumerate(texts):
        for start, end, kind, value in spans(text):
            if value not in names:
                base, n = suggested(kind, value), 0
                name, used = base, set(names.values())
                while name in used:
                    n += 1
                    name = f"{base}_{n}"
                names[value] = name
            out.append((i, start, end, kind, value, names[value]))
    return out


def extracted(macros: DataFrame) -> DataFrame:
    """(id, step, start, end, kind, value, name) of ``macros`` (id, texts array): each procedure by itself, so nothing is shuffled."""
    kind = macros.schema["id"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(i, *x) for i, texts in zip(part["id"], part["texts"], strict=True) for x in named([] if texts is None else list(texts))]
            yield pd.DataFrame(rows, columns=["id", "step", "start", "end", "kind", "value", "name"])

    return macros.select("id", "texts").mapInPandas(run, f"id {kind}, step long, start long, end long, kind string, value string, name string")


def parameterised(macros: DataFrame) -> DataFrame:
    """(id, texts, variables map): texts with ``{{name}}`` for each value, and the values by name."""
    kind = macros.schema["id"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for i, texts in zip(part["id"], part["texts"], strict=True):
                new = [] if texts is None else list(texts)
                found = named(new)
                for step, start, end, _, _, name in sorted(found, key=lambda x: (x[0], -x[1])):
                    new[step] = new[step][:start] + "{{" + name + "}}" + new[step][end:]
                rows.append((i, new, {x[5]: x[4] for x in reversed(found)}))
            yield pd.DataFrame(rows, columns=["id", "texts", "variables"])

    return macros.select("id", "texts").mapInPandas(run, f"id {kind}, texts array<string>, variables map<string,string>")
