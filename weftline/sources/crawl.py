"""Crawling a wiki by its API: listing with a cursor, batches of pages, a cache of responses, polite pauses.

The network is met only by ``fetch``, which is a parameter. What it returns is staged as lines of JSON, which Spark
parses as it parses responses staged by anything else.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from weftline.operators import dialogue
from weftline.sources import files, wikitext

#: Statuses worth another try, and the pages that one request may name.
RETRY_STATUSES = (429, 500, 502, 503, 504)
BATCH = 50


def http_get(address: str, agent: str = "weftline/1.0 (wiki API client)", retries: int = 4, pause: float = 0.5) -> str:
    """The body at an address; some failures are tried again, after pauses that double."""
    for attempt in range(retries + 1):
        time.sleep(pause * 2**attempt)
        try:
            with urllib.request.urlopen(urllib.request.Request(address, headers={"User-Agent": agent}), timeout=60) as answer:
                return answer.read().decode()
        except urllib.error.HTTPError as error:
            if error.code not in RETRY_STATUSES or attempt == retries:
                raise
    raise AssertionError("not reached")


@dataclasses.dataclass
class Wiki:
    """One category of a wiki; responses younger than ``fresh`` seconds are taken from ``cache``."""

    base: str
    category: str
    fetch: Callable[[str], str] = http_get
    cache: str | None = None
    fresh: float = 7 * 24 * 3600

    def ask(self, **params: object) -> dict:
        address = f"{self.base}/api.php?{urllib.parse.urlencode({'format': 'json', 'formatversion': 2, 'maxlag': 5, **params})}"
        kept = Path(self.cache) / hashlib.sha256(address.encode()).hexdigest() if self.cache else None
        if kept and kept.exists() and time.time() - kept.stat().st_mtime < self.fresh:
            return json.loads(kept.read_text())
        body = json.loads(self.fetch(address))
        if kept:
            kept.parent.mkdir(parents=True, exist_ok=True)
            kept.write_text(json.dumps(body))
        return body

    def titles(self, limit: int | None = None) -> Iterator[list[str]]:
        """The titles of each listing response, ``limit`` in all; cursors are followed until one is missing."""
        left, cursor = limit, {}
        while cursor is not None:
            body = self.ask(action="query", list="categorymembers", cmtitle=self.category, cmnamespace=0, cmlimit=500, **cursor)
            found = [m["title"] for m in body["query"]["categorymembers"]][:left]
            yield found
            left = None if left is None else left - len(found)
            token = body.get("continue", {}).get("cmcontinue")
            cursor = {"cmcontinue": token} if token and left != 0 else None

    def pages(self, limit: int | None = None) -> Iterator[dict]:
        for found in self.titles(limit):
            for at in range(0, len(found), BATCH):
                yield self.ask(action="query", prop="revisions", rvprop="content", rvslots="main", titles="|".join(found[at : at + BATCH]), redirects=1)


def crawl(spark: SparkSession, wiki: Wiki, staged: str, output: str, limit: int | None = None) -> DataFrame:
    """Valid items of a category, each page once, as JSON lines at ``output``, which replace what was there."""
    Path(staged).parent.mkdir(parents=True, exist_ok=True)
    with open(staged, "w", encoding="utf-8") as file:
        for body in wiki.pages(limit):
            file.write(json.dumps(body) + "\n")
    found = wikitext.normalised(wikitext.validated(wikitext.parse_pages(files.wiki_pages(spark.read.text(staged)))))
    files.write_records(dialogue.keep_first(found, ["page_id"], ["title"]), output)
    return spark.read.json(output)
