"""A paged price listing as a Python data source, with two predicates pushed to it: service and region.

The listing is a callable that answers (service, region, offset, limit) with (total, records), as a paged API does. A page that
fails makes the read fail: an unknown listing must not look like an empty one. The count is checked against the total.
"""

from __future__ import annotations

import json
import re
import urllib.parse
import urllib.request
from collections.abc import Iterable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

SCHEMA = "id string, service string, flavor string, region string, unit string, currency string, price decimal(18,6), tier_from long, tier_to long"
PAGE, MAX_PAGES = 10_000, 100
_AMOUNT = re.compile(r"(-?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?)\s+[A-Z]{3}")


def amount(text: object) -> str | None:
    """``0.085000 EUR`` or ``1,234.50 EUR`` to its number; a decimal comma or anything else is unreadable, so null."""
    m = _AMOUNT.fullmatch(str(text or "").strip())
    return m[1].replace(",", "") if m else None


class Page(InputPartition):
    def __init__(self, offset: int, limit: int):
        self.offset, self.limit = offset, limit


class ListingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.size = options["url"], int(options.get("pagesize", PAGE))
        self.asked: dict[str, str] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute in (("service",), ("region",)):
                self.asked[f.attribute[0]] = f.value
            else:
                yield f

    def _get(self, offset: int, limit: int) -> dict:
        query = urllib.parse.urlencode({**self.asked, "offset": offset, "limit": limit})
        if self.url.startswith("file:"):
            with urllib.request.urlopen(self.url) as answer:
                rows = [r for r in json.load(answer)["records"] if all(r.get(k) == v for k, v in self.asked.items())]
            return {"total": len(rows), "records": rows[offset : offset + limit]}
        with urllib.request.urlopen(f"{self.url}?{query}", timeout=60) as answer:
            return json.load(answer)

    def partitions(self) -> list[Page]:
        total = self._get(0, 1)["total"]
        if total > self.size * MAX_PAGES:
            raise ValueError("the listing is longer than its pages reach")
        return [Page(at, min(self.size, total - at)) for at in range(0, total, self.size)] or [Page(0, 0)]

    def read(self, page: Page) -> Iterator[tuple]:
        from decimal import Decimal

        if not page.limit:
            return
        records = self._get(page.offset, page.limit)["records"]
        if len(records) != page.limit:
            raise ValueError(f"{len(records)} records of {page.limit} at {page.offset}")
        for r in records:
            price = amount(r.get("priceAmount"))
            yield (r.get("id"), (r.get("service") or "").lower(), r.get("flavor"), r.get("region"), r.get("unit"), r.get("currency"), None if price is None else Decimal(price), r.get("fromOn"), r.get("upTo"))


class PagedListing(DataSource):
    """``spark.read.format("paged_listing").option("url", ...)``; register with ``spark.dataSource.register(PagedListing)`` and set
    spark.sql.python.filterPushdown.enabled."""

    @classmethod
    def name(cls) -> str:
        return "paged_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ListingReader:
        return ListingReader(dict(self.options))
