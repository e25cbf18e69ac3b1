"""Documents of a web service as a data source: fetched by the executors, within one rate for all, and kept in a shared folder.

``spark.read.format("fetched_documents")`` gives a row for each company asked
for. A document that is in the folder isn't asked for again. One that can't be
had, or not in a few tries, is a row with an error, and the others come.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import files

FORMAT = "fetched_documents"
COLUMNS = "cik bigint, json string, source string, error string"
#: Statuses of an answer after which asking again may help.
PASSING = frozenset({408, 425, 429, 500, 502, 503, 504})


@dataclass
class Companies(InputPartition):
    ciks: list[int]


class DocumentReader(DataSourceReader):
    def __init__(self, options: dict):
        self.ciks = json.loads(options["ciks"])
        self.url, self.folder, self.agent = options["url"], options["folder"].rstrip("/"), options.get("useragent", "tideline")
        self.partitions_, self.tries = int(options.get("partitions", 4)), int(options.get("tries", 3))
        # All partitions may run at once: each waits as many times longer.
        self.pause = min(self.partitions_, max(1, len(self.ciks))) / float(options.get("persecond", 8))

    def partitions(self) -> list[Companies]:
        n = min(self.partitions_, len(self.ciks)) or 1
        return [Companies(self.ciks[k::n]) for k in range(n)]

    def read(self, partition: Companies) -> Iterator[pa.RecordBatch]:
        asked = 0.0
        for cik in partition.ciks:
            kept = f"{self.folder}/CIK{cik:010d}.json"
            text, source, error = files.text_of(kept), "folder", None
            for attempt in range(self.tries if text is None else 0):
                time.sleep(max(0.0, asked + self.pause - time.monotonic()))
                asked = time.monotonic()
                try:
                    text, source, error = self._ask(cik), "service", None
                    files.put_text(kept, text)
                    break
                except urllib.error.HTTPError as e:
                    error = f"status {e.code}"
                    if e.code not in PASSING:
                        break
                except (OSError, ValueError) as e:
                    error = str(e) or type(e).__name__
            yield pa.record_batch([pa.array([cik], pa.int64()), *(pa.array([v], pa.string()) for v in (text, source if text is not None else None, error))], names=["cik", "json", "source", "error"])

    def _ask(self, cik: int) -> str:
        request = urllib.request.Request(self.url.format(cik=cik), headers={"User-Agent": self.agent})
        with urllib.request.urlopen(request, timeout=120) as answer:
            return answer.read().decode("utf-8")


class DocumentSource(DataSource):
    """Options: ``ciks``, a JSON list; ``url``, with {cik}; ``folder``; ``userAgent``, ``perSecond``, ``partitions``, ``tries``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> DocumentReader:
        return DocumentReader({k.lower(): v for k, v in self.options.items()})


def documents(spark: SparkSession, ciks: Sequence[int], url: str, folder: str, per_second: float = 8.0, partitions: int = 4, tries: int = 3, user_agent: str = "tideline") -> DataFrame:
    """(cik, json, source, error): source is "folder" or "service", null where there is an error."""
    spark.dataSource.register(DocumentSource)
    options = {"ciks": json.dumps(sorted(set(ciks))), "url": url, "folder": folder, "perSecond": per_second, "partitions": partitions, "tries": tries, "userAgent": user_agent}
    return spark.read.format(FORMAT).options(**options).load()
