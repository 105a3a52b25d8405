"""Quotes of venues: parsing of raw responses, and a data source that fetches them, once or as a stream.

The stream asks every venue once in a poll. Polls are numbered by the clock (seconds since 1970 / ``every``), and an offset is the
number of the last one, so a stream that starts again goes on with the present poll: a number comes once at most, what was
not asked while the stream was down does not exist, and a batch that is run again asks again under the same number.

Status codes of a fetch: 0 ok, 1 timeout, 2 interface error, 3 network, 4 rate limit, 5 unknown, 6 no data.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from fathom.sources.rules import SYMBOLS

OK, TIMEOUT, INTERFACE, NETWORK, LIMITED, UNKNOWN, EMPTY = range(7)
PAUSE = 1.0
WAIT = 10
EVERY = 60.0
RESPONSE = "exchange string, coin string, pair string, status int, body string"
# The venues' public addresses and response shapes.
ADDRESSES = {
    "Kraken": ("https://api.kraken.com/0/public/Ticker?pair={pair}",),
    "Coinbase": ("https://api.coinbase.com/v2/exchange-rates?currency={coin}", "https://api.coinbase.com/v2/prices/{pair}/spot"),
}
TICKER = "error array<string>, result map<string, struct<c: array<string>>>"
RATES = "errors array<struct<message: string>>, data struct<rates: map<string, string>, amount: string>"


def ticker_price(body, pair) -> Column:
    """The last trade's price of a ticker response: the pair's entry, else the first one. Null for errors, missing or
    unreadable prices."""
    r = F.from_json(body, TICKER)
    entry = F.coalesce(F.try_element_at(r["result"], pair), F.try_element_at(F.map_values(r["result"]), F.lit(1)))
    price = F.try_element_at(entry["c"], F.lit(1)).try_cast("double")
    return F.when(F.coalesce(F.size(r["error"]), F.lit(0)) <= 0, price)


def rates_price(body) -> Column:
    """The USD rate of an exchange-rates response, or the amount of a spot response. Null for errors."""
    r = F.from_json(body, RATES)
    price = F.coalesce(F.try_element_at(r["data"]["rates"], F.lit("USD")).try_cast("double"), r["data"]["amount"].try_cast("double"))
    return F.when(r["errors"].isNull(), price)


def parse_quotes(responses: DataFrame) -> DataFrame:
    """(exchange, coin, pair, body) to (exchange, coin, price), without rows that have no price."""
    price = F.when(F.col("exchange") == "Kraken", ticker_price(F.col("body"), F.col("pair"))).otherwise(rates_price(F.col("body")))
    return responses.select("exchange", F.upper("coin").alias("coin"), price.alias("price")).where("price IS NOT NULL")


def ticks_of(responses: DataFrame) -> DataFrame:
    """Responses of a stream to ticks: seq (the poll), exchange, coin, price."""
    price = F.when(F.col("exchange") == "Kraken", ticker_price(F.col("body"), F.col("pair"))).otherwise(rates_price(F.col("body")))
    return responses.select(F.col("poll").alias("seq"), "exchange", F.upper("coin").alias("coin"), price.alias("price")).where("price IS NOT NULL")


class Venue(InputPartition):
    def __init__(self, name: str, coins: list[str], poll: int = 0):
        self.name, self.coins, self.poll = name, coins, poll


class QuoteReader(DataSourceReader):
    """One partition for each venue; requests of a venue are at least PAUSE seconds apart. Options: venues, pause, timeout, and
    address.<venue> in place of a venue's public one."""

    def __init__(self, options: dict):
        self.venues = [v for v in options.get("venues", ",".join(SYMBOLS)).split(",") if v in SYMBOLS]
        self.pause, self.wait = float(options.get("pause", PAUSE)), float(options.get("timeout", WAIT))
        given = {v: options.get(f"address.{v.lower()}") for v in ADDRESSES}
        self.addresses = {v: (given[v],) if given[v] else own for v, own in ADDRESSES.items()}

    def partitions(self):
        return [Venue(v, list(SYMBOLS[v])) for v in self.venues]

    def fetch(self, url: str) -> tuple[int, str | None]:
        try:
            with urllib.request.urlopen(url, timeout=self.wait) as r:
                body = r.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            return (LIMITED if e.code == 429 else INTERFACE), None
        except TimeoutError:
            return TIMEOUT, None
        except (urllib.error.URLError, OSError):
            return NETWORK, None
        try:
            parsed = json.loads(body)
        except ValueError:
            return UNKNOWN, None
        return (INTERFACE, None) if parsed.get("error") or "errors" in parsed else (OK, body)

    def read(self, venue: Venue):
        first = True
        for coin in venue.coins:
            pair, status, body = SYMBOLS[venue.name][coin], EMPTY, None
            for address in self.addresses[venue.name]:
                if not first:
                    time.sleep(self.pause)
                first = False
                status, body = self.fetch(address.format(pair=pair, coin=coin))
                if body:
                    break
            yield venue.name, coin, pair, status, body


class QuoteStreamReader(DataSourceStreamReader):
    """A poll of all venues in each batch, ``every`` seconds at least apart."""

    def __init__(self, options: dict):
        self.once, self.every = QuoteReader(options), float(options.get("every", EVERY))

    def initialOffset(self) -> dict:
        return {"poll": int(time.time() / self.every) - 1}

    def latestOffset(self) -> dict:
        return {"poll": int(time.time() / self.every)}

    def partitions(self, start: dict, end: dict):
        return [Venue(v, list(SYMBOLS[v]), end["poll"]) for v in self.once.venues] if end["poll"] > start["poll"] else []

    def read(self, venue: Venue):
        for row in self.once.read(venue):
            yield (*row, venue.poll)

    def commit(self, end: dict) -> None:
        """Nothing is kept that could be dropped."""


class QuoteSource(DataSource):
    """spark.dataSource.register(QuoteSource); spark.read.format("venue_quotes").load() gives raw responses for
    parse_quotes(), spark.readStream with the option ``every`` (seconds) those of every poll for ticks_of()."""

    @classmethod
    def name(cls) -> str:
        return "venue_quotes"

    def schema(self) -> str:
        return RESPONSE if "every" not in self.options else f"{RESPONSE}, poll long"

    def reader(self, schema) -> DataSourceReader:
        return QuoteReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return QuoteStreamReader(self.options)
