"""Cursor-paged search and full text over HTTP, as a Python data source; one partition a year.

Failures are loud: a page that cannot be had after all attempts ends the task, and a failed count
is an error instead of 0. The transport can be injected, which is how the tests run without a network.
"""

from __future__ import annotations

import http.client
import json
import random
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Transport = Callable[[str, float], tuple[int, str]]
RETRIED = (429, 500, 502, 503, 504)


def quoted(values: list[str], field: str) -> str:
    return "(" + " OR ".join(f'{field}:"{v}"' for v in values) + ")"


def base_query(*, journals: list[str] | None = None, issns: list[str] | None = None, open_access: bool = False) -> str:
    """Journal articles in the archive that are no preprints, of the journals or ISSNs given."""
    parts = ['PUB_TYPE:"Journal Article"', "IN_EPMC:Y", "NOT PREPRINT:Y"]
    if open_access:
        parts.append("OPEN_ACCESS:Y")
    if issns is not None:
        clean = sorted({i.strip().upper() for i in issns if i.strip()})
        if not clean:
            raise ValueError("no ISSN is left after cleaning")
        parts.append(quoted(clean, "ISSN"))
    if journals:
        parts.append(quoted(journals, "JOURNAL"))
    return " AND ".join(parts)


def keyword_clause(terms: list[str]) -> str:
    return "(" + " OR ".join(f'"{t}"' for t in terms) + ")"


def with_years(query: str, first: int, last: int | None = None) -> str:
    return f"({query}) AND PUB_YEAR:{first}" if last in (None, first) else f"({query}) AND PUB_YEAR:[{first} TO {last}]"


#: How the variants ask: v1 tries every failure again after a fixed wait, v2 with growing waits and pauses.
POLICIES = {"v1": {"attempts": 5, "wait": 10.0, "growth": 1.0, "retry_all": True}, "v2": {"attempts": 5, "wait": 2.0, "growth": 2.0}}


def urllib_transport(url: str, timeout: float) -> tuple[int, str]:
    request = urllib.request.Request(url, headers={"Accept": "application/json, application/xml"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.status, answer.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, ""


class PooledTransport:
    """Keeps one connection a host open and uses it again; a connection that was closed is opened once more."""

    def __init__(self) -> None:
        self.open: dict[tuple[str, str], http.client.HTTPConnection] = {}

    def __getstate__(self) -> dict:
        return {"open": {}}

    def __call__(self, url: str, timeout: float) -> tuple[int, str]:
        at = urllib.parse.urlsplit(url)
        key = (at.scheme, at.netloc)
        for again in (True, False):
            fresh = key not in self.open
            if fresh:
                kind = http.client.HTTPSConnection if at.scheme == "https" else http.client.HTTPConnection
                self.open[key] = kind(at.netloc, timeout=timeout)
            try:
                self.open[key].request("GET", f"{at.path}?{at.query}" if at.query else at.path, headers={"Accept": "application/json, application/xml"})
                answer = self.open[key].getresponse()
                return answer.status, answer.read().decode("utf-8", "replace")
            except (OSError, http.client.HTTPException) as e:
                self.open.pop(key).close()
                if fresh or not again:
                    raise e if isinstance(e, OSError) else OSError(str(e)) from e
        raise AssertionError


def fetch(url: str, transport: Transport, *, attempts: int = 5, wait: float = 2.0, growth: float = 2.0, timeout: float = 30.0, retry_all: bool = False, delay: tuple[float, float] = (0.0, 0.0)) -> str:
    """The body of a 200 answer, trying again on the retried codes and on errors of the connection.

    With ``retry_all`` (v1), any other status is tried again too. Waits grow by ``growth``. ``delay`` gives the
    bounds of a random pause before the request, out of politeness.
    """
    if delay[1] > 0:
        time.sleep(random.uniform(*delay))
    for attempt in range(attempts):
        try:
            status, body = transport(url, timeout)
            if status == 200:
                return body
            if status not in RETRIED and not retry_all:
                raise ValueError(f"status {status} for {url}")
        except OSError:
            if attempt == attempts - 1:
                raise
        if attempt < attempts - 1:
            time.sleep(wait * growth**attempt)
    raise TimeoutError(f"no answer from {url} in {attempts} attempts")


def pages(address: str, query: str, transport: Transport, *, size: int = 200, most: int | None = None, kind: str = "core", stop_at_hits: bool = True, **policy: object) -> Iterator[dict]:
    """Results of all pages: until a page is empty, the cursor stays, or (v1) the hits or ``most`` are reached."""
    cursor, seen = "*", 0
    while most is None or seen < most:
        asked = urllib.parse.urlencode({"query": query, "format": "json", "pageSize": size, "cursorMark": cursor, "resultType": kind})
        page = json.loads(fetch(f"{address}?{asked}", transport, **policy))
        found = (page.get("resultList") or {}).get("result") or []
        if most is not None:
            found = found[: most - seen]
        yield from found
        seen += len(found)
        following = page.get("nextCursorMark")
        if not found or not following or following == cursor or (stop_at_hits and seen >= page.get("hitCount", seen + 1)):
            return
        cursor = following


def hit_count(address: str, query: str, transport: Transport = urllib_transport, **policy: object) -> int:
    asked = urllib.parse.urlencode({"query": query, "format": "json", "pageSize": 1, "resultType": "lite", "synonym": "false"})
    return int(json.loads(fetch(f"{address}?{asked}", transport, **policy))["hitCount"])


def full_text(address: str, pmcid: str, transport: Transport, *, refuse_html: bool = True, **policy: object) -> str | None:
    """The XML of an article; None if there is none, it is blank, or (v1) it is an HTML page."""
    try:
        body = fetch(address.format(pmcid=pmcid), transport, **policy)
    except ValueError:
        return None
    head = body.lstrip()[:200].lower()
    if not head or (refuse_html and head.startswith(("<!doctype html", "<html"))):
        return None
    return body


@dataclass
class Year(InputPartition):
    year: int


class SearchReader(DataSourceReader):
    def __init__(self, options: dict, transport: Transport):
        self.options, self.transport = options, transport

    def partitions(self) -> list[Year]:
        return [Year(y) for y in range(int(self.options["first"]), int(self.options["last"]) + 1)]

    def read(self, partition: Year) -> Iterator[tuple]:
        o = self.options
        variant = o.get("variant", "v1")
        policy = POLICIES[variant] | {k: float(o[k]) for k in ("wait",) if k in o}
        most = int(o["most"]) if "most" in o else None
        for r in pages(o["address"], with_years(o["query"], partition.year), self.transport, size=int(o.get("size", 200)), most=most, stop_at_hits=variant == "v1", **policy):
            yield partition.year, json.dumps(r, ensure_ascii=False)


def full_texts(articles: DataFrame, address: str, *, variant: str = "v2", transport: Transport | None = None, pmcid: str = "pmcid", **policy: object) -> DataFrame:
    """(pmcid, xml): the full text of every article that has one, asked for where the rows are.

    v1 refuses HTML pages, v2 takes any body that is not blank. Null and empty ids are left out, repeated ones asked once.
    """
    ask = transport or PooledTransport()
    how = POLICIES[variant] | {"retry_all": False} | policy

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(p, full_text(address, p, ask, refuse_html=variant == "v1", **how)) for p in frame["pmcid"]]
            yield pd.DataFrame([x for x in found if x[1] is not None], columns=["pmcid", "xml"], dtype=object)

    own = articles.select(articles[pmcid].cast("string").alias("pmcid")).where("pmcid <> ''").distinct()
    return own.mapInPandas(run, "pmcid string, xml string")


class SearchSource(DataSource):
    """spark.dataSource.register(SearchSource); spark.read.format("literature_search").option(...): address,
    query, first, last, size, most, variant. Rows: (year, value), value the JSON text of one result."""

    transport: Transport = staticmethod(urllib_transport)

    @classmethod
    def name(cls) -> str:
        return "literature_search"

    def schema(self) -> str:
        return "year int, value string"

    def reader(self, schema: object) -> SearchReader:
        return SearchReader(dict(self.options), type(self).transport)
