"""Lookups of street candidates: answers kept as a table, missing ones asked for one at a time."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinity.functions import text

# The service's limit.
SECONDS_EACH = 1.1
LIMIT = 5
ANSWERS = "candidate string, ok boolean, body string"
RESULT = "array<struct<lat:string,lon:string,name:string,display_name:string,address:map<string,string>,geojson:string>>"


def address(base: str, candidate: Column, city: str | None) -> Column:
    """The request's address, with the city after a comma if there is one."""
    query = F.concat(candidate, F.lit(f", {city}")) if city else candidate
    return F.concat(F.lit(f"{base}?q="), text.url_encode(query), F.lit(f"&format=jsonv2&addressdetails=1&polygon_geojson=1&limit={LIMIT}"))


def ask(candidates: DataFrame, known: DataFrame, lookup: Callable[[str], str | None], seconds: float = SECONDS_EACH) -> DataFrame:
    """Answers (candidate, ok, body) for candidates not known yet: ``lookup`` gives a body, or null for
    a failure that passes.  The service allows one request at a time, so the lookups, and nothing before
    them, are one task on purpose; known candidates never come here.  Write the result once: reading it
    again asks again."""
    new = candidates.select("candidate").distinct().join(known.where("ok").select("candidate"), "candidate", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for c in batch["candidate"]:
                body = lookup(c)
                rows.append((c, body is not None, body))
                time.sleep(seconds)
            yield pd.DataFrame(rows, columns=["candidate", "ok", "body"])

    return new.repartition(1).mapInPandas(run, ANSWERS)


def answers(table: DataFrame) -> DataFrame:
    """Rows of answers for :func:`vicinity.functions.streets.validated_hits`."""

    def shape(body: pd.Series) -> pd.Series:
        out = []
        for b in body:
            try:
                got = json.loads(b) if b else []
            except ValueError:
                got = []
            rows = []
            for x in got if isinstance(got, list) else []:
                place = x.get("address") or {}
                rows.append({k: x.get(k) for k in ("lat", "lon", "name", "display_name")} | {"address": {str(k): str(v) for k, v in place.items()}, "geojson": json.dumps(x["geojson"]) if x.get("geojson") else None})
            out.append(rows)
        return pd.Series(out, dtype=object)

    parse = F.pandas_udf(shape, RESULT)
    rows = table.where("ok").select("candidate", F.posexplode(parse("body")).alias("pos", "r"))
    return rows.select("candidate", "pos", "r.*")


def failed(table: DataFrame) -> DataFrame:
    """Candidates to ask for again."""
    return table.where("not ok").select("candidate")
