"""Clients of paged JSON services, as Python data sources. Nothing here runs unless a caller names an address.

``register(spark)`` adds the format ``paged_json``: options ``url`` (with
``{page}`` where pages are walked), ``member`` (the list of a page),
``page_size``, ``max_pages``, ``budget`` with ``budget_file`` (a file in a shared
folder, where readers count together), ``token`` or ``token_url``, ``client_id``,
``client_secret`` and ``scope`` (a token is fetched, and again before it runs
out), ``param.<name>`` and ``header.<name>`` (the parameters of a search and the
headers that go with it; names in lower case). One partition walks one address; several addresses, separated by blanks, are walked in parallel. Each
row is a page: url, page, complete, body. ``land_search`` posts one search, with
the filters of a query pushed into it.
"""

from __future__ import annotations

import base64
import json
import math
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual


class BudgetSpent(RuntimeError):
    """The day's calls are used up."""


class Unavailable(RuntimeError):
    """The service answered with an error."""


@dataclass
class DailyBudget:
    """Calls left on a UTC day; what a response says is left counts too."""

    calls: int = 5000
    now: Callable[[], datetime] = lambda: datetime.now(UTC)
    day: str = ""
    used: int = 0
    said: int | None = None

    def _roll(self) -> None:
        today = self.now().strftime("%Y-%m-%d")
        if today != self.day:
            self.day, self.used, self.said = today, 0, None

    def left(self) -> int:
        """Calls that may still be made today."""
        self._roll()
        own = self.calls - self.used
        return max(0, own if self.said is None else min(own, self.said))

    def reserve(self) -> None:
        """Takes one call, or raises."""
        if self.left() <= 0:
            raise BudgetSpent(self.day)
        self.used += 1
        if self.said is not None:
            self.said -= 1

    def hear(self, remaining: str | None) -> None:
        """Notes the remaining calls a response states."""
        self._roll()
        if remaining and remaining.strip().isdigit():
            self.said = int(remaining)


@dataclass
class SharedBudget(DailyBudget):
    """A budget that all readers of a day share, kept in the file ``path`` of a folder that all of them see."""

    path: str = ""

    @contextmanager
    def _held(self) -> Iterator[None]:
        """The state of the file, for one reader at a time."""
        lock = f"{self.path}.lock"
        for _ in range(600):
            try:
                os.close(os.open(lock, os.O_CREAT | os.O_EXCL))
                break
            except FileExistsError:
                time.sleep(0.05)
        else:
            raise Unavailable(f"{lock} is held")
        try:
            if os.path.exists(self.path):
                with open(self.path) as file:
                    self.day, self.used, self.said = json.load(file)
            yield
            with open(f"{self.path}.new", "w") as file:
                json.dump([self.day, self.used, self.said], file)
            os.replace(f"{self.path}.new", self.path)
        finally:
            os.remove(lock)

    def reserve(self) -> None:
        with self._held():
            super().reserve()

    def hear(self, remaining: str | None) -> None:
        with self._held():
            super().hear(remaining)


def client_token(url: str, client: str, secret: str, scope: str = "", opener=urllib.request.urlopen) -> tuple[str, float]:
    """(token, seconds it holds) for a client's id and secret."""
    body = urllib.parse.urlencode({"grant_type": "client_credentials"} | ({"scope": scope} if scope else {})).encode()
    basic = base64.b64encode(f"{client}:{secret}".encode()).decode()
    headers = {"Authorization": f"Basic {basic}", "Content-Type": "application/x-www-form-urlencoded"}
    got = json.loads(patient_get(url, headers, data=body, opener=opener))
    if not got.get("access_token"):
        raise Unavailable("no token in the answer")
    return got["access_token"], float(got.get("expires_in", 0))


@dataclass
class TokenCache:
    """A bearer token, fetched again a minute before it runs out."""

    fetch: Callable[[], tuple[str, float]]
    clock: Callable[[], float] = time.monotonic
    margin: float = 60.0
    token: str = ""
    until: float = field(default=-1.0)

    def get(self) -> str:
        if not self.token or self.clock() >= self.until:
            self.token, seconds = self.fetch()
            self.until = self.clock() + seconds - self.margin
        return self.token


def patient_get(url: str, headers: dict[str, str], budget: DailyBudget | None = None, data: bytes | None = None, opener=urllib.request.urlopen, sleep=time.sleep, retries: int = 3, default_wait: float = 30, longest_wait: float = 120) -> bytes:
    """The body at ``url``. Only a 429 is tried again, after the wait it asks for, within limits."""
    for attempt in range(retries + 1):
        if budget:
            budget.reserve()
        try:
            with opener(urllib.request.Request(url, data=data, headers=headers), timeout=15) as response:
                if budget:
                    budget.hear(response.headers.get("X-RateLimit-Remaining"))
                if response.status == 202:
                    raise Unavailable("an asynchronous answer is not supported")
                return response.read()
        except urllib.error.HTTPError as e:
            if e.code != 429 or attempt == retries:
                raise Unavailable(message_of(e.code, e.read())) from e
            asked = (e.headers.get("Retry-After") or "").strip()
            sleep(min(float(asked) if asked.isdigit() else default_wait, longest_wait))
    raise Unavailable("no answer")


def message_of(status: int, body: bytes) -> str:
    """What an error response says: code, message and request id of its envelope, where it has one."""
    try:
        error = json.loads(body).get("error", {})
        return f"{status}: {error.get('code', '')} {error.get('message', '')} {error.get('request_id', '')}".strip()
    except (ValueError, AttributeError):
        return str(status)


def walk(url: str, get: Callable[[str], bytes], member: str, page_size: int, max_pages: int) -> Iterator[tuple[str, int, bool, str]]:
    """(url, page, complete, body) of pages up to an empty or short one, which is a row too; ``complete`` is true on every row only if the walk got there."""
    rows, complete = [], False
    for page in range(1, max_pages + 1):
        body = get(url.replace("{page}", str(page))).decode("utf-8", "replace")
        n = len(json.loads(body).get(member) or [])
        rows.append((page, body))
        if n < page_size or "{page}" not in url:
            complete = "{page}" in url
            break
    for page, body in rows:
        yield url, page, complete, body


class _Address(InputPartition):
    def __init__(self, url: str) -> None:
        self.url = url


class PagedJson(DataSource):
    """The format ``paged_json``."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "url string, page int, complete boolean, body string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _PagedReader(dict(self.options))


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [_Address(u) for u in self.options["url"].split()]

    def read(self, partition: _Address) -> Iterator[tuple]:
        o = self.options
        fixed = {"Accept": "application/json"} | {k.removeprefix("header."): v for k, v in o.items() if k.startswith("header.")}
        calls = int(o.get("budget", 5000))
        budget = SharedBudget(calls, path=o["budget_file"]) if o.get("budget_file") else DailyBudget(calls)
        token = TokenCache(lambda: client_token(o["token_url"], o.get("client_id", ""), o.get("client_secret", ""), o.get("scope", ""))) if o.get("token_url") else None

        def get(url: str) -> bytes:
            bearer = token.get() if token else o.get("token")
            return patient_get(url, fixed | ({"Authorization": f"Bearer {bearer}"} if bearer else {}), budget)

        yield from walk(with_parameters(partition.url, {k.removeprefix("param."): v for k, v in o.items() if k.startswith("param.")}), get, o.get("member", "products"), int(o.get("page_size", 250)), int(o.get("max_pages", 4)))


def with_parameters(url: str, parameters: dict[str, str]) -> str:
    """``url`` with the parameters that are not empty, such as the words, limit and filter of a search."""
    more = urllib.parse.urlencode({k: v for k, v in sorted(parameters.items()) if v})
    return url + (("&" if "?" in url else "?") + more if more else "")


def land_request(box: tuple[float, float, float, float], filters: list, most: int = 25) -> tuple[dict, list]:
    """(request body, filters that the service does not apply): a land search, with what a query asks for pushed into it.

    Bounds on acres, price in cents and days go upstream; the rest is left to Spark.
    """
    west, south, east, north = box
    body: dict = {"bounds": {"west": west, "south": south, "east": east, "north": north}, "maxItems": max(1, min(most, 50))}
    left = []
    for f in filters:
        name, value = ".".join(getattr(f, "attribute", ())), getattr(f, "value", None)
        if isinstance(f, (GreaterThanOrEqual, GreaterThan)) and name == "acres":
            body.setdefault("lotSize", {})["min"] = math.floor(value * 43_560)
        elif isinstance(f, (LessThanOrEqual, LessThan)) and name == "price_cents":
            body.setdefault("price", {})["max"] = math.ceil(value / 100)
        elif isinstance(f, (LessThanOrEqual, LessThan)) and name == "days":
            body["daysOnMarket"] = value
        left.append(f)  # the service rounds, so that Spark looks again
    return body, left


class LandSearch(DataSource):
    """The format ``land_search``: options url, token, west, south, east, north, max_items."""

    @classmethod
    def name(cls) -> str:
        return "land_search"

    def schema(self) -> str:
        return "acres double, price_cents bigint, days int, body string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _LandReader(dict(self.options))


class _LandReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options
        self.body, _ = land_request(self._box(), [], int(options.get("max_items", 25)))

    def _box(self) -> tuple[float, float, float, float]:
        return tuple(float(self.options[k]) for k in ("west", "south", "east", "north"))

    def pushFilters(self, filters: list) -> list:  # noqa: N802
        self.body, left = land_request(self._box(), filters, int(self.options.get("max_items", 25)))
        return left

    def read(self, partition) -> Iterator[tuple]:  # noqa: ANN001
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {self.options.get('token', '')}"}
        yield from lot_rows(patient_get(self.options["url"], headers, data=json.dumps(self.body).encode()))


def lot_rows(answer: bytes) -> Iterator[tuple]:
    """(acres, price in cents, days, body) of each lot of a search answer."""
    for lot in json.loads(answer).get("data") or []:
        home = (lot.get("hdpData") or {}).get("homeInfo") or {}
        value, unit = home.get("lotAreaValue"), (home.get("lotAreaUnit") or "").strip().lower()
        size = value if unit in ("acres", "acre", "ac") else value / 43_560 if value and unit in ("sqft", "sq ft", "") else None
        price = lot.get("unformattedPrice") or 0
        yield size, math.floor(price * 100 + 0.5), lot.get("daysOnZillow"), json.dumps(lot)


def register(spark: SparkSession) -> None:
    """Adds the formats to a session."""
    spark.dataSource.register(PagedJson)
    spark.dataSource.register(LandSearch)
