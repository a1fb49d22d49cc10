"""An index over a table of articles that answers like the remote one, for dry runs and tests without a network."""

from __future__ import annotations

import json
import re
import urllib.parse
from functools import lru_cache

import pyarrow.dataset as ds

FIELDS = {"id": "id", "source": "source", "pmid": "pmid", "pmcid": "pmcid", "title": "title", "abstract": "abstractText", "journal": "journalTitle", "pub_year": "pubYear", "pub_type": "pubType"}


@lru_cache(8)
def found(path: str, first: str, last: str) -> list[str]:
    """The results of the years asked for, as JSON texts in order of arrival."""
    table = ds.dataset(path.removeprefix("file://")).to_table(columns=["rec_no", *FIELDS], filter=(ds.field("pub_year") >= first) & (ds.field("pub_year") <= last))
    rows = table.sort_by("rec_no").to_pylist()
    return [json.dumps({to: r[of] for of, to in FIELDS.items() if r[of] is not None}) for r in rows if re.fullmatch(r"\d{4}", r["pub_year"])]


class LocalIndex:
    """A transport: pages with cursors and hit counts for queries by year, over a Parquet table of the metadata's columns.

    Every ``busy``-th new page is first answered 503, so that runs go through the retries.
    """

    def __init__(self, path: str, busy: int = 3):
        self.path, self.busy, self.refused = path, busy, set()

    def __call__(self, url: str, timeout: float) -> tuple[int, str]:
        asked = dict(urllib.parse.parse_qsl(urllib.parse.urlsplit(url).query))
        years = re.search(r"PUB_YEAR:\[?(\d{4})(?: TO (\d{4})\])?", asked["query"])
        rows = found(self.path, years[1], years[2] or years[1])
        start = 0 if asked.get("cursorMark", "*") == "*" else int(asked["cursorMark"])
        size = int(asked["pageSize"])
        if (start // size + 1) % self.busy == 0 and url not in self.refused:
            self.refused.add(url)
            return 503, ""
        page = rows[start : start + size]
        return 200, json.dumps({"hitCount": len(rows), "nextCursorMark": str(start + len(page)), "resultList": {"result": [json.loads(r) for r in page]}})


def numbered_texts(url: str, timeout: float) -> tuple[int, str]:
    """A transport for full texts: by the id's last digit a missing article, a blank body, an HTML page or XML."""
    pmcid = urllib.parse.unquote(urllib.parse.urlsplit(url).path.rsplit("/", 1)[-1])
    match pmcid[-1:]:
        case "0" | "5":
            return 404, "none"
        case "1":
            return 200, " \n"
        case "2" | "7":
            return 200, f"\n<!DOCTYPE HTML><p>{pmcid}"
        case _:
            return 200, f"<article><front><article-title>About {pmcid}</article-title></front></article>"
