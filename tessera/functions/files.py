"""File functions over Hadoop file systems, row pacing, and calls to web services.

Services need an address and a network; the caller gives a `fetch(url) -> str`, so that a test or a proxy may stand in. Each task keeps what it
has fetched, paces its calls, and calls once for each distinct request of a batch.
"""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import add


def list_files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """path, name, modified, length of each file; contents aren't read."""
    r = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive)
    return r.load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("modificationTime").alias("modified"), "length")


def read_binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")


def read_text(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))


def save(df: DataFrame, folder: str, name: str, data: str, duplicate: str = "abend") -> DataFrame:
    """Writes each row's data to the file folder/name, on the executors; gives the path written, null where it was left alone.

    duplicate: abend, ignore, unique (a number is added to the name) or overwrite. Folders are local or mounted paths that executors share.
    """
    schema = "path string"

    def run(batches):
        import os

        os.makedirs(folder, exist_ok=True)
        for b in batches:
            out = []
            for n, d in zip(b[name], b[data], strict=True):
                path, k = os.path.join(folder, os.path.basename(n)), 0
                raw = b"" if d is None else bytes(d) if isinstance(d, (bytes, bytearray)) else str(d).encode()
                while True:
                    try:
                        with open(path, "wb" if duplicate == "overwrite" else "xb") as f:
                            f.write(raw)
                        out.append(path)
                    except FileExistsError:
                        if duplicate == "abend":
                            raise
                        if duplicate == "unique":
                            k += 1
                            stem, ext = os.path.splitext(os.path.basename(n))
                            path = os.path.join(folder, f"{stem}_{k}{ext}")
                            continue
                        out.append(None)
                    break
            yield pd.DataFrame({"path": pd.Series(out, dtype=object)})

    return df.select(name, data).mapInPandas(run, schema)


def throttle(df: DataFrame, rows: int, seconds: float = 1.0) -> DataFrame:
    """At most so many rows per period in each task. Streams are better paced by their source's own limits."""

    def run(batches):
        for b in batches:
            for lo in range(0, len(b), rows):
                began = time.monotonic()
                yield b.iloc[lo : lo + rows]
                time.sleep(max(0.0, seconds - (time.monotonic() - began)))

    return df.mapInPandas(run, df.schema)


def get_url(url: str) -> str:
    with urllib.request.urlopen(url, timeout=30) as r:
        return r.read().decode()


def service(df: DataFrame, template: str, columns, path: str = "", output: str = "response", fetch=get_url, per_minute: int = 60, **constants) -> DataFrame:
    """Adds the response (JSON text, or the part of it at a dotted path) of a GET of the template filled with columns and constants."""
    columns = list(columns)

    def run(batches):
        held: dict[str, str | None] = {}
        last = 0.0
        for b in batches:
            out = []
            for row in b[columns].itertuples(index=False):
                if any(v is None or v != v for v in row):
                    out.append(None)
                    continue
                values = {k: urllib.parse.quote(str(v)) for k, v in (dict(zip(columns, row, strict=True)) | constants).items() if k != "base"}
                url = template.format(base=constants.get("base", ""), **values)
                if url not in held:
                    if len(held) >= 1000:
                        held.pop(next(iter(held)))
                    if fetch is get_url:
                        time.sleep(max(0.0, last + 60 / per_minute - time.monotonic()))
                        last = time.monotonic()
                    value = json.loads(fetch(url))
                    for step in [p for p in path.split(".") if p]:
                        value = value[int(step)] if isinstance(value, list) else value.get(step)
                        if value is None:
                            break
                    held[url] = None if value is None else value if isinstance(value, str) else json.dumps(value)
                out.append(held[url])
            yield b.assign(**{output: pd.Series(out, index=b.index, dtype=object)})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{output}` string"
    return df.mapInPandas(run, schema)


def _service(template: str, columns, path: str = ""):
    return lambda df, fetch=get_url, columns=columns, **constants: service(df, template, columns, path, fetch=fetch, **constants)


#: Templates take {base}, the service's address, and {key} from the caller.
SERVICES = {
    "CurrencyRateLive": _service("{base}/live?access_key={key}&source={from_}&currencies={to}", ("from_", "to"), "quotes"),
    "CurrencyConvertLive": _service("{base}/convert?access_key={key}&from={from_}&to={to}&amount={value}", ("from_", "to", "value"), "result"),
    "CurrenciesLive": _service("{base}/live?access_key={key}&source={from_}", ("from_",), "quotes"),
    "CurrencyRateHistorical": _service("{base}/historical?access_key={key}&date={date}&source={from_}&currencies={to}", ("date", "from_", "to"), "quotes"),
    "CurrencyConvertHistorical": _service("{base}/convert?access_key={key}&date={date}&from={from_}&to={to}&amount={value}", ("date", "from_", "to", "value"), "result"),
    "CurrenciesHistorical": _service("{base}/historical?access_key={key}&date={date}&source={from_}", ("date", "from_"), "quotes"),
    "CurrencyCodes": _service("{base}/list?access_key={key}", (), "currencies"),
    "CountryCurrencyCodes": _service("{base}/all?fields=name,currencies", ()),
    "IpToGeolocation": _service("{base}/{ip}?access_key={key}", ("ip",)),
    "WeatherByCityName": _service("{base}/weather?appid={key}&q={city}&units={units}", ("city",)),
    "WeatherByCityId": _service("{base}/weather?appid={key}&id={city_id}&units={units}", ("city_id",)),
    "WeatherByCoordinates": _service("{base}/weather?appid={key}&lat={lat}&lon={lon}&units={units}", ("lat", "lon")),
    "WeatherByZipCode": _service("{base}/weather?appid={key}&zip={zip},{country}&units={units}", ("zip", "country")),
    "WeatherCities": _service("{base}/cities?appid={key}", ()),
    "LatestStockInfo": _service("{base}/query?function=TIME_SERIES_INTRADAY&apikey={key}&symbol={symbol}&interval={interval}&outputsize=compact", ("symbol",)),
    "LatestStockHistory": _service("{base}/query?function=TIME_SERIES_INTRADAY&apikey={key}&symbol={symbol}&interval={interval}&outputsize=full", ("symbol",)),
}
add("external", "estimator", **SERVICES)
add("file", "estimator", SaveBinaryFile=save, SaveTextFile=save, ReadBinaryFile=read_binary, ReadTextFile=read_text, GetFileList=list_files, GetFileListInfo=list_files, GetFileInformation=list_files)
add("throttle", "estimator", Throttle=throttle)
